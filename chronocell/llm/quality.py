"""Quality classification from weak labels.

Heuristic labellers each vote good, bad or nothing on a text.  Expectation-maximisation over
the vote patterns of all documents estimates how often each labeller says what about good and
bad documents, without any given labels; the posterior of a pattern is its documents' weak
label.  Those posteriors train a linear scorer over hashed features, which decides.

Statistics and features are over whole texts, however long.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronocell.llm.samples import lowest_texts

#: Places of the hashed scorer; byte grams of this length, and named buckets of statistics.
DIMENSIONS = 1 << 12
GRAM = 3
UPPER = bytes(range(65, 91))
LETTERS = UPPER + bytes(range(97, 123)) + bytes(range(128, 256))
DIGITS = b"0123456789"
SYMBOLS = b"#$%&*|~^<>{}[]\\=+_@"
#: Bytes that begin no character in UTF-8; words in a stretch whose repeats are counted.
CONTINUATION = bytes(range(0x80, 0xC0))
STRETCH = 200
ABSTAIN, GOOD, BAD = 0, 1, 2


@dataclass(frozen=True)
class Labeller:
    """Votes on one statistic: bad from ``bad`` on, good up to ``good``, else nothing; only with ``words`` words."""

    name: str
    good: float
    bad: float
    words: int = 1

    def vote(self, stats: dict[str, float]) -> int:
        if stats["words"] < self.words:
            return ABSTAIN
        value = stats[self.name]
        return BAD if value >= self.bad else GOOD if value <= self.good else ABSTAIN


#: The production labellers.  They overlap: junk of one kind moves several statistics.
LABELLERS = (
    Labeller("symbols", 0.01, 0.05),
    Labeller("capitals", 0.10, 0.30),
    Labeller("shouts", 0.05, 0.15),
    Labeller("echoes", 0.03, 0.20, 10),
    Labeller("sameness", 0.50, 0.70, 20),
    Labeller("same_lines", 0.34, 0.50, 20),
    Labeller("length", 7.0, 7.4, 10),
    Labeller("marked", 0.05, 0.25, 5),
    Labeller("bare_marks", 0.0, 0.10, 5),
    Labeller("digits", 0.20, 0.50),
)


def _without(data: bytes, chars: bytes) -> int:
    return len(data) - len(data.translate(None, chars))


def _sameness(words: list[bytes]) -> float:
    """Share of words that came before in their stretch, so long texts count as short ones do."""
    if len(words) <= STRETCH:
        return 1 - len(set(words)) / len(words)
    # The last stretch begins early enough to be a whole one.
    starts = [*range(0, len(words) - STRETCH, STRETCH), len(words) - STRETCH]
    return 1 - sum(len(set(words[k : k + STRETCH])) for k in starts) / (STRETCH * len(starts))


def statistics(text: str | None) -> dict[str, float]:
    """Shares that the labellers look at; 0 words for a null text or one of white space."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    n, size = len(words), max(1, len(data))
    if not n:
        return {"words": 0.0, **{k.name: 0.0 for k in LABELLERS}}
    lines = [x for x in data.split(b"\n") if x]
    return {
        "words": float(n),
        "symbols": _without(data, SYMBOLS) / size,
        "capitals": _without(data, UPPER) / max(1, _without(data, LETTERS)),
        "shouts": data.count(b"!") / n,
        "echoes": sum(map(operator.eq, words, words[1:])) / n,
        "sameness": _sameness(words),
        "same_lines": 1 - len(set(lines)) / len(lines) if len(lines) > 3 else 0.0,
        "length": (sum(map(len, words)) - _without(data, CONTINUATION)) / n,
        "marked": sum(w[-1] in SYMBOLS for w in words) / n,
        "bare_marks": sum(not w.isalnum() for w in words if len(w) == 1) / n,
        "digits": _without(data, DIGITS) / size,
    }


def votes_of(stats: dict[str, float], labellers: tuple[Labeller, ...] = LABELLERS) -> str:
    """A digit for each labeller: 0 nothing, 1 good, 2 bad."""
    return "".join(str(k.vote(stats)) for k in labellers)


def features(text: str | None, stats: dict[str, float]) -> tuple[np.ndarray, list[int]]:
    """Places of all byte grams (repeated as they occur) and of the buckets that the statistics fall in."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    grams = data[: max(0, len(data) - GRAM + 1)].copy()
    for k in range(1, GRAM):
        grams = grams * np.uint32(0x9E3779B1) + data[k : k + len(grams)]
    grams = (grams * np.uint32(0x85EBCA6B)) >> np.uint32(20)
    named = [crc32(f"{k.name}={min(int(stats[k.name] / k.bad * 3), 4)}".encode()) % DIMENSIONS for k in LABELLERS]
    return grams, named


@dataclass
class LabelModel:
    """``prior`` of good, and ``said[class, labeller, vote]`` with class 0 good and 1 bad.

    ``said`` is over the votes that a labeller gives; giving none tells nothing.
    """

    prior: float
    said: np.ndarray

    def posterior(self, patterns: list[str]) -> np.ndarray:
        """The probability that a document with such votes is good."""
        votes = np.array([[int(c) for c in p] for p in patterns], dtype=int).reshape(len(patterns), self.said.shape[1])
        place = np.arange(self.said.shape[1])
        good = np.log(self.prior) + np.log(self.said[0, place, votes]).sum(axis=1)
        bad = np.log(1 - self.prior) + np.log(self.said[1, place, votes]).sum(axis=1)
        return 1 / (1 + np.exp(np.clip(bad - good, -60, 60)))

    @property
    def accuracies(self) -> np.ndarray:
        """Of each labeller, how often a vote it gives is right."""
        return self.prior * self.said[0, :, GOOD] + (1 - self.prior) * self.said[1, :, BAD]


def fit_labels(patterns: list[str], counts: list[int], rounds: int = 100, smoothing: float = 1.0) -> LabelModel:
    """Expectation-maximisation from pattern counts, begun where any bad vote makes bad likely.

    The first round's guess alone breaks the symmetry; labels of documents are never used.
    """
    m = len(patterns[0])
    votes = np.array([[int(c) for c in p] for p in patterns])
    weight = np.array(counts, dtype=float)
    chosen = np.eye(3)[votes]
    good = np.where((votes == BAD).any(axis=1), 0.1, np.where((votes == GOOD).any(axis=1), 0.95, 0.5))
    model = LabelModel(0.5, np.full((2, m, 3), 1 / 3))
    for _ in range(rounds):
        said = np.stack([np.einsum("p,pmv->mv", weight * c, chosen) + smoothing for c in (good, 1 - good)])
        prior = ((weight * good).sum() + smoothing) / (weight.sum() + 2 * smoothing)
        said[:, :, ABSTAIN] = 0
        said /= said.sum(axis=2, keepdims=True)
        said[:, :, ABSTAIN] = 1
        model = LabelModel(float(prior), said)
        new = model.posterior(patterns)
        if np.abs(new - good).max() < 1e-9:
            break
        good = new
    return model


@dataclass
class Scorer:
    weights: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        """The probability that a text is good; 0 for one without words."""
        stats = statistics(text)
        if not stats["words"]:
            return 0.0
        grams, named = features(text, stats)
        z = self.bias + float(self.weights[named].sum()) + (float(self.weights[grams].mean()) * SCALE if len(grams) else 0.0)
        return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


#: Weight of the mean over grams against the named features.
SCALE = 8.0


def fit_scorer(rows: np.ndarray, target: np.ndarray, steps: int = 300, rate: float = 0.05, decay: float = 1e-3) -> Scorer:
    """Logistic regression of soft labels on dense feature rows, by Adam over all rows."""
    w, b = np.zeros(rows.shape[1], np.float32), np.float32(0)
    m, v = np.zeros(len(w) + 1, np.float32), np.zeros(len(w) + 1, np.float32)
    target = target.astype(np.float32)
    for k in range(steps):
        error = 1 / (1 + np.exp(-np.clip(rows @ w + b, -60, 60))) - target
        g = np.append(rows.T @ error / len(rows) + decay * w, error.mean()).astype(np.float32)
        m += np.float32(0.1) * (g - m)
        v += np.float32(0.01) * (g * g - v)
        step = np.float32(rate) * (m / np.float32(1 - 0.9 ** (k + 1))) / (np.sqrt(v / np.float32(1 - 0.99 ** (k + 1))) + np.float32(1e-8))
        w -= step[:-1]
        b -= step[-1]
    return Scorer(w, float(b))


def vote_counts(docs: DataFrame) -> DataFrame:
    """``votes, n`` over all texts of ``docs`` (column ``text``): at most ``3 ** labellers`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = (statistics(v.as_py()) for v in batch.column("text"))
            yield pa.RecordBatch.from_arrays([pa.array([votes_of(s) for s in stats if s["words"]], pa.string())], names=["votes"])

    return docs.select("text").mapInArrow(run, "votes string").groupBy("votes").agg(F.count(F.lit(1)).alias("n"))


def training_rows(docs: DataFrame, sample: int) -> tuple[list[str], np.ndarray]:
    """Votes and dense feature rows of the ``sample`` distinct texts with the lowest keys; no more reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes, rows = [], []
            for value in batch.column("text"):
                text = value.as_py()
                stats = statistics(text)
                grams, named = features(text, stats)
                row = np.bincount(grams, minlength=DIMENSIONS) * (SCALE / max(1, len(grams)))
                np.add.at(row, named, 1.0)
                votes.append(votes_of(stats))
                rows.append(row.astype(np.float16).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(votes, pa.string()), pa.array(rows, pa.binary())], names=["votes", "features"])

    worded = docs.where(F.col("text").rlike(r"[^\x09-\x0D\x20]")).select("text")
    table = lowest_texts(worded, sample, 7).select("text").mapInArrow(run, "votes string, features binary").toArrow()
    found = sorted(zip(table["votes"].to_pylist(), table["features"].to_pylist(), strict=True))
    rows = np.frombuffer(b"".join(f for _, f in found), np.float16).reshape(-1, DIMENSIONS).astype(np.float32)
    return [x for x, _ in found], rows


def fit(docs: DataFrame, sample: int = 2500) -> tuple[LabelModel, Scorer] | None:
    """Label model from all of ``text``, scorer from ``sample`` distinct texts of it at most; ``None`` without words."""
    rows = vote_counts(docs).collect()  # a row a pattern that occurs
    if not rows:
        return None
    rows.sort(key=lambda r: r["votes"])
    model = fit_labels([r["votes"] for r in rows], [r["n"] for r in rows])
    votes, dense = training_rows(docs, sample)
    return model, fit_scorer(dense, model.posterior(votes))


def classify(docs: DataFrame, threshold: float = 0.5, fitted: tuple[LabelModel, Scorer] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, votes, weak_label, score, kept`` for every row of ``docs``.

    ``weak_label`` is the label model's probability of good, ``score`` the scorer's, and
    ``kept`` whether it reaches ``threshold``, that itself included.  Null texts and those
    without words have no votes, a null ``weak_label`` and score 0.  Equal texts get equal
    scores, repeated rows repeat; a null id stays; other columns are ignored; an empty table
    gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return score(rows, fitted or fit(rows), ["doc_id"]).withColumn("kept", F.col("score") >= threshold)


def score(rows: DataFrame, fitted: tuple[LabelModel, Scorer] | None, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` of ``rows`` with ``votes, weak_label, score`` of the texts; plain column names, without dots or backticks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes, scores = [], []
            for value in batch.column(text_col):
                text = value.as_py()
                stats = statistics(text)
                votes.append(votes_of(stats) if stats["words"] else None)
                scores.append(fitted[1].score(text) if fitted else 0.0)
            labels = pa.nulls(len(votes), pa.float64())
            if fitted:
                known = sorted({v for v in votes if v})
                of = dict(zip(known, fitted[0].posterior(known).tolist() if known else [], strict=True))
                labels = pa.array([of.get(v) for v in votes], pa.float64())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(votes, pa.string()), labels, pa.array(scores, pa.float64())], names=[*keep, "votes", "weak_label", "score"])

    source = rows.select(*dict.fromkeys([*keep, text_col]))
    kept = [T.StructField(c, source.schema[c].dataType) for c in keep]
    return source.mapInArrow(run, T.StructType([*kept, T.StructField("votes", T.StringType()), T.StructField("weak_label", T.DoubleType()), T.StructField("score", T.DoubleType())]))
