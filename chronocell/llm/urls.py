"""URL filtering by rules and by a character language-model ratio.

Two variable-order Markov models over URL characters, one of accepted and one of rejected
URLs, score every URL: an order-n estimate is interpolated with the order below it by
Witten-Bell weights, down to the uniform one.  The difference of the two log-likelihoods
divided by the length is compared with a threshold that is calibrated on URLs kept out of
the counts.

Characters fold into an alphabet of fixed size, so the counts have a bounded number of
cells whatever the corpus; they are summed over all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters, one digit, these marks, and one for everything else (fixed values of the models).
MARKS = "/.-_?=&#%:~+"
LETTERS = 26 + 1 + len(MARKS) + 1
#: Characters that a context sees before it.
ORDER = 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    allow: bool

    @property
    def text(self) -> str:
        return self.host + self.path


#: The production rules.
RULES = (
    Rule("org", "/", True),
    Rule("example.org", "/es/", False),
    Rule("example.org", "/en/1", False),
    Rule("com", "/fr/", True),
    Rule("com", "/de/", False),
)


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/ ? #``, A-Z lower-cased; empty without one."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``? #``; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matched_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """Struct ``(rule, allow)`` of the longest rule that fits, the first of equals; null for none."""
    out = F.lit(None).cast("struct<rule:string,allow:boolean>")
    for r in sorted(reversed(rules), key=lambda r: len(r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.allow).alias("allow"))).otherwise(out)
    return out


def _alphabet() -> np.ndarray:
    """Symbol 1.. of each byte; 0 pads the start."""
    table = np.full(256, LETTERS, dtype=np.int32)
    for k, c in enumerate(LOWER):
        table[ord(c)] = table[ord(UPPER[k])] = k + 1
    table[ord("0") : ord("9") + 1] = 27
    for k, c in enumerate(MARKS):
        table[ord(c)] = 28 + k
    return table


_SYMBOL = _alphabet()
BASE = LETTERS + 1


def grams(urls: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """For every character of every URL the code of it and its ``ORDER`` predecessors; and each URL's length."""
    parts = [np.frombuffer((u or "").encode("utf-8", "surrogatepass"), np.uint8) for u in urls]
    lengths = np.array([len(p) for p in parts], dtype=np.int64)
    pad = np.zeros(ORDER, dtype=np.int64)
    line = np.concatenate([x for p in parts for x in (pad, _SYMBOL[p].astype(np.int64))]) if parts else pad[:0]
    code = np.zeros(max(0, len(line) - ORDER), dtype=np.int64)
    for k in range(ORDER + 1):
        code = code * BASE + line[k : k + len(code)]
    return code[code % BASE > 0], lengths


def _fold(key: str) -> Column:
    """A quarter of the URLs, by their text, is kept from the counts to calibrate on."""
    return F.pmod(F.xxhash64(F.coalesce(F.col(key), F.lit(""))), F.lit(4)) == 0


def gram_counts(judged: DataFrame) -> DataFrame:
    """``allow, gram, n`` over all rows of ``url, allow``: summed in each task, then by gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {flag: np.zeros(BASE ** (ORDER + 1), dtype=np.int32) for flag in (False, True)}
        seen = False
        for batch in batches:
            flags = np.array(batch.column("allow").to_pylist(), dtype=bool)
            urls = batch.column("url").to_pylist()
            for flag in (False, True):
                codes = grams([u for u, f in zip(urls, flags, strict=True) if f == flag])[0]
                np.add.at(sums[flag], codes, 1)
            seen = True
        for flag, counts in sums.items() if seen else ():
            cells = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cells), flag)), pa.array(cells, pa.int64()), pa.array(counts[cells], pa.int64())], names=["allow", "gram", "n"])

    partial = judged.select("url", "allow").mapInArrow(run, "allow boolean, gram long, n long")
    return partial.groupBy("allow", "gram").agg(F.sum("n").alias("n"))


def log_probabilities(counts: np.ndarray) -> np.ndarray:
    """Log-probability of each gram's last character given the others, from flat gram counts.

    Order by order from the uniform estimate: ``(count + kinds * lower) / (total + kinds)``
    where ``kinds`` is the number of different characters that the context was followed by.
    """
    full = counts.reshape((BASE,) * (ORDER + 1)).astype(np.float64)
    estimate = np.full(BASE, 1.0 / LETTERS)
    estimate[0] = 0.0
    for order in range(ORDER + 1):
        c = full.sum(axis=tuple(range(ORDER - order)))
        total = c.sum(axis=-1, keepdims=True)
        kinds = (c > 0).sum(axis=-1, keepdims=True)
        lower = np.broadcast_to(estimate, c.shape)
        estimate = np.where(total > 0, (c + kinds * lower) / np.maximum(total + kinds, 1), lower)
    with np.errstate(divide="ignore"):
        return np.log(estimate).astype(np.float32).ravel()


def fit_ratio(judged: DataFrame) -> np.ndarray:
    """The log-ratio accepted : rejected of every gram.  The driver gets ``2 * BASE**4`` counts at most."""
    counts = np.zeros((2, BASE ** (ORDER + 1)), dtype=np.int64)
    table = gram_counts(judged).toArrow()
    if table.num_rows:
        counts[table["allow"].to_numpy(zero_copy_only=False).astype(int), table["gram"].to_numpy()] = table["n"].to_numpy()
    accepted, rejected = log_probabilities(counts[1]), log_probabilities(counts[0])
    with np.errstate(invalid="ignore"):
        return np.nan_to_num(accepted - rejected, nan=0.0)


def ratio_scores(urls: DataFrame, ratio: np.ndarray, columns: list[str]) -> DataFrame:
    """``columns`` and ``score``: mean log-ratio of each URL's characters; 0 for none."""
    shared = urls.sparkSession.sparkContext.broadcast(ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            codes, lengths = grams(batch.column("url").to_pylist())
            upto = np.concatenate([[0.0], np.cumsum(table[codes], dtype=np.float64)])
            ends = np.cumsum(lengths)
            score = (upto[ends] - upto[ends - lengths]) / np.maximum(lengths, 1)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(score)], names=[*columns, "score"])

    rows = urls.select(*columns)
    return rows.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", score double")


def calibrate(scored: DataFrame, bins: int = 400, reach: float = 4.0) -> float:
    """The threshold on ``score`` with the least balanced error on ``allow``; 0 without both kinds.

    Scores are counted in ``bins`` bins of ``[-reach, reach]``, those beyond in the outer ones.
    """
    place = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.col("score") + reach) * (bins / 2 / reach)))).cast("int")
    rows = scored.groupBy(place.alias("bin"), "allow").agg(F.count(F.lit(1)).alias("n")).collect()
    counts = np.zeros((2, bins))
    for r in rows:
        counts[int(r["allow"]), r["bin"]] = r["n"]
    if not counts.sum(axis=1).all():
        return 0.0
    share = counts / counts.sum(axis=1, keepdims=True)
    # With the threshold at the lower edge of bin k: accepted below it, rejected from it on.
    missed = np.concatenate([[0.0], np.cumsum(share[1])])
    passed = 1.0 - np.concatenate([[0.0], np.cumsum(share[0])])
    error = missed + passed
    best = np.flatnonzero(error <= error.min() + 1e-12)
    return float(best[len(best) // 2] * 2 * reach / bins - reach)


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id, url, host, path, rule, score, verdict`` for every row of ``pages``.

    URLs that a rule fits get the rule's verdict; they are also what the models learn from
    and, a quarter by text, what the threshold is set on.  All others are allowed if their
    score reaches it.  A null URL has empty host and path, no rule and score 0; URLs under rules of one kind
    only leave all ratios as they come and the threshold at 0.  Repeated rows repeat and get
    equal verdicts; other columns are ignored; an empty table gives an empty result.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    rows = rows.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    rows = rows.withColumn("r", matched_rule(F.col("host"), F.col("path"), rules))
    rows = rows.select("page_id", "url", "host", "path", F.col("r.rule").alias("rule"), F.col("r.allow").alias("allow"))
    judged = rows.where("rule is not null").select("url", "allow")
    ratio = fit_ratio(judged.where(~_fold("url")))
    threshold = calibrate(ratio_scores(judged.where(_fold("url")), ratio, ["url", "allow"]))
    scored = ratio_scores(rows, ratio, ["page_id", "url", "host", "path", "rule", "allow"])
    verdict = F.when(F.coalesce("allow", F.col("score") >= threshold), F.lit("allow")).otherwise(F.lit("block"))
    return scored.withColumn("verdict", verdict).drop("allow")
