"""Language identification by a bidirectional gated recurrent network over bytes.

Two gated recurrent layers read a text's UTF-8 bytes, one in each direction, and a softmax
over both states labels every position.  A document's probabilities are the mean over all its
positions.  Texts are read in windows of ``WINDOW`` bytes, each from zero states, so all
windows of a batch advance together and long texts need no long recurrences.

The network is trained in numpy by backpropagation through time with Adam.  Gates and
candidates use piecewise linear squashing (clipped lines), whose gradient is one inside the
line and zero outside it: what is followed is the gradient of the loss itself.  An eighth of
the sampled texts validates; the weights kept are those with the least validation loss, and a
run that does not get far is begun again at a lower rate.

Very long texts are read whole, a batch of windows at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronocell.llm.samples import lowest_texts

UNDETERMINED = "und"
WINDOW = 128
#: Fills windows; no byte of UTF-8.  Its update gate is shut, so states pass it unchanged.
PAD = 0xFF
SHUT = -1e6
#: Learning rates of the runs, in turn, and the validation loss, of that of an even guess, that ends the search.
RATES, ENOUGH = (0.02, 0.01, 0.005), 0.1
#: One text in so many validates; a run looks at it every so many steps.
VALIDATING, EVERY = 8, 20
#: Windows that advance together, and positions times labels held at once, which bound them where labels are many.
TOGETHER, CELLS = 4096, 1 << 24


@dataclass
class Layer:
    """One direction: input rows by byte and recurrent weights of update, reset and candidate."""

    x: list[np.ndarray]
    u: list[np.ndarray]

    @staticmethod
    def fresh(rng: np.random.Generator, hidden: int) -> Layer:
        x = [rng.normal(scale=0.3, size=(256, hidden)).astype(np.float32) for _ in range(3)]
        x[0] += np.float32(0.3)
        x[1] += np.float32(0.6)
        return Layer(x, [rng.normal(scale=0.4 / np.sqrt(hidden), size=(hidden, hidden)).astype(np.float32) for _ in range(3)])

    def states(self, x: np.ndarray) -> np.ndarray:
        """States ``[T, B, H]`` after each of ``x`` ``[T, B]``."""
        steps, n = x.shape
        hidden = self.u[0].shape[0]
        out = np.empty((steps, n, hidden), dtype=np.float32)
        z, r, c = (np.empty((n, hidden), dtype=np.float32) for _ in range(3))
        s, a = np.empty_like(z), np.empty_like(z)
        xz, xr, xc = self.x[0].copy(), self.x[1], self.x[2]
        xz[PAD] = SHUT
        uz, ur, uc = self.u
        h = np.zeros((n, hidden), dtype=np.float32)
        for t in range(steps):
            at = x[t]
            np.take(xz, at, axis=0, out=z, mode="clip")
            np.dot(h, uz, out=a)
            z += a
            np.clip(z, 0, 1, out=z)
            np.take(xr, at, axis=0, out=r, mode="clip")
            np.dot(h, ur, out=a)
            r += a
            np.clip(r, 0, 1, out=r)
            r *= h
            np.take(xc, at, axis=0, out=c, mode="clip")
            np.dot(r, uc, out=s)
            c += s
            np.clip(c, -1, 1, out=c)
            c -= h
            c *= z
            h = np.add(h, c, out=out[t])
        return out

    def gradients(self, x: np.ndarray, states: np.ndarray, d_out: np.ndarray) -> list[np.ndarray]:
        """Backpropagation through time: gradients of ``x`` and ``u`` for those of all states."""
        steps, n, hidden = states.shape
        gx, gu = [np.zeros_like(m) for m in self.x], [np.zeros_like(m) for m in self.u]
        xz = self.x[0].copy()
        xz[PAD] = SHUT
        dh = np.zeros((n, hidden), dtype=np.float32)
        for t in range(steps - 1, -1, -1):
            dh = dh + d_out[t]
            h = states[t - 1] if t else np.zeros((n, hidden), dtype=np.float32)
            az, ar = xz[x[t]] + h @ self.u[0], self.x[1][x[t]] + h @ self.u[1]
            z, r = np.clip(az, 0, 1), np.clip(ar, 0, 1)
            ac = self.x[2][x[t]] + (r * h) @ self.u[2]
            c = np.clip(ac, -1, 1)
            live = (x[t] != PAD)[:, None]
            dz = dh * (c - h) * ((az > 0) & (az < 1) & live)
            dc = dh * z * (np.abs(ac) < 1)
            d_rh = dc @ self.u[2].T
            dr = d_rh * h * ((ar > 0) & (ar < 1))
            for k, d in enumerate((dz, dr, dc)):
                np.add.at(gx[k], x[t], d)
            gu[0] += h.T @ dz
            gu[1] += h.T @ dr
            gu[2] += (r * h).T @ dc
            dh = dh * (1 - z) + d_rh * r + dz @ self.u[0].T + dr @ self.u[1].T
        return gx + gu


@dataclass
class Network:
    labels: list[str]
    forward: Layer
    backward: Layer
    v: np.ndarray
    bias: np.ndarray
    _moments: dict = field(default_factory=dict, repr=False)

    @staticmethod
    def fresh(labels: list[str], hidden: int = 8, seed: int = 10) -> Network:
        rng = np.random.default_rng(seed)
        layers = Layer.fresh(rng, hidden), Layer.fresh(rng, hidden)
        return Network(labels, *layers, rng.normal(scale=0.3, size=(2 * hidden, len(labels))).astype(np.float32), np.zeros(len(labels), np.float32))

    def positions(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Label probabilities ``[T, B, L]`` of every position, and both layers' states."""
        ahead, back = self.forward.states(x), self.backward.states(x[::-1])
        hidden = ahead.shape[2]
        p = ahead @ self.v[:hidden] + self.bias
        p += back[::-1] @ self.v[hidden:]
        p -= p.max(axis=2, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(axis=2, keepdims=True)
        return p, ahead, back

    def window_sums(self, x: np.ndarray) -> np.ndarray:
        """Probabilities ``[B, L]`` summed over the positions of each window ``x`` ``[T, B]`` that are no filling."""
        p = self.positions(x)[0]
        if (x == PAD).any():
            p *= (x != PAD)[:, :, None]
        return p.sum(axis=0)

    def parameters(self) -> list[np.ndarray]:
        return [*self.forward.x, *self.forward.u, *self.backward.x, *self.backward.u, self.v, self.bias]

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy over all positions and its gradients."""
        p, ahead, back = self.positions(x)
        live = (x != PAD).astype(np.float32)[:, :, None]
        hit = np.take_along_axis(p, np.broadcast_to(y[None, :, None], (*x.shape, 1)), 2)
        loss = float(-(np.log(np.maximum(hit, 1e-12)) * live).sum() / live.sum())
        d = p.copy()
        np.put_along_axis(d, np.broadcast_to(y[None, :, None], (*x.shape, 1)), hit - 1, 2)
        d *= live / live.sum()
        hidden = ahead.shape[2]
        g_ahead = self.forward.gradients(x, ahead, d @ self.v[:hidden].T)
        g_back = self.backward.gradients(x[::-1], back, (d @ self.v[hidden:].T)[::-1])
        flat = d.reshape(-1, d.shape[2])
        gv = np.concatenate([ahead.reshape(-1, hidden).T @ flat, back[::-1].reshape(-1, hidden).T @ flat])
        return loss, [*g_ahead, *g_back, gv, flat.sum(axis=0)]

    def batch_gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """``gradients``, of a few windows at a time where there are many labels."""
        together = max(1, CELLS // (len(x) * len(self.labels)))
        if len(y) <= together:
            return self.gradients(x, y)
        live, loss, total = (x != PAD).sum(), 0.0, [np.zeros_like(p) for p in self.parameters()]
        for k in range(0, len(y), together):
            part = np.ascontiguousarray(x[:, k : k + together])
            weight = np.float32((part != PAD).sum() / live)
            some, grads = self.gradients(part, y[k : k + together])
            loss += float(weight) * some
            for t, g in zip(total, grads, strict=True):
                t += weight * g
        return loss, total

    def loss(self, windows: np.ndarray, y: np.ndarray) -> float:
        """Mean cross-entropy over the positions of ``windows`` ``[N, T]``, each language of ``y`` alike."""
        if not len(y):
            return 0.0
        total, size = np.zeros(len(self.labels)), np.zeros(len(self.labels))
        together = max(1, min(TOGETHER, CELLS // (windows.shape[1] * len(self.labels))))
        for k in range(0, len(y), together):
            x, of = np.ascontiguousarray(windows[k : k + together].T), y[k : k + together]
            hit = np.take_along_axis(self.positions(x)[0], np.broadcast_to(of[None, :, None], (*x.shape, 1)), 2)[:, :, 0]
            live = x != PAD
            np.add.at(total, of, (-np.log(np.maximum(hit, 1e-12)) * live).sum(axis=0))
            np.add.at(size, of, live.sum(axis=0))
        return float((total[size > 0] / size[size > 0]).mean())

    def train(self, windows: np.ndarray, y: np.ndarray, steps: int = 300, batch: int = 256, rate: float = 0.02, seed: int = 11, held: tuple[np.ndarray, np.ndarray] | None = None) -> float:
        """Adam on random batches of ``windows`` ``[N, T]``, languages alike; the rate falls to a tenth.

        The weights that stay are those of the step with the least loss on ``held`` (on
        ``windows`` where there is none); that loss is returned.
        """
        rng = np.random.default_rng(seed)
        held = (windows, y) if held is None or not len(held[1]) else held
        order, counts = np.argsort(y, kind="stable"), np.bincount(y)
        starts, present = np.cumsum(counts) - counts, np.flatnonzero(counts)
        ms, vs = ([np.zeros_like(p) for p in self.parameters()] for _ in range(2))
        best, kept = math.inf, None
        for k in range(steps + 1):
            if k % EVERY == 0 or k == steps:
                loss = self.loss(*held)
                if loss < best:
                    best, kept = loss, [p.copy() for p in self.parameters()]
            if k == steps:
                break
            of = present[rng.integers(0, len(present), batch)]
            pick = order[starts[of] + (rng.random(batch) * counts[of]).astype(np.int64)]
            grads = self.batch_gradients(np.ascontiguousarray(windows[pick].T), y[pick])[1]
            scale = min(1.0, 1.0 / (1e-6 + np.sqrt(sum(float((g * g).sum()) for g in grads))))
            lr = rate * (1 - 0.9 * k / steps)
            for p, g, m, v in zip(self.parameters(), grads, ms, vs, strict=True):
                g = g * np.float32(scale)
                m += np.float32(0.1) * (g - m)
                v += np.float32(0.01) * (g * g - v)
                p -= np.float32(lr) * (m / np.float32(1 - 0.9 ** (k + 1))) / (np.sqrt(v / np.float32(1 - 0.99 ** (k + 1))) + np.float32(1e-6))
        for p, q in zip(self.parameters(), kept or [], strict=kept is not None):
            p[...] = q
        return best


def windows_of(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, width: int) -> np.ndarray:
    """``[len(starts), width]`` bytes of ``data``, filled with ``PAD`` beyond each length."""
    place = np.arange(width)
    out = data[np.minimum(starts[:, None] + place, max(len(data) - 1, 0))]
    out[place >= lengths[:, None]] = PAD
    return out


def document_probabilities(net: Network, texts: list[bytes]) -> np.ndarray:
    """Mean label probabilities ``[N, L]`` over all bytes of each text; zeros for an empty one."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    count = -(-sizes // WINDOW)
    owner = np.repeat(np.arange(len(texts)), count)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    starts = np.repeat(np.cumsum(sizes) - sizes, count) + inner * WINDOW
    lengths = np.minimum(np.repeat(sizes, count) - inner * WINDOW, WINDOW)
    order = np.argsort(-lengths, kind="stable")
    total = np.zeros((len(texts), len(net.labels)))
    together = max(1, min(TOGETHER, CELLS // (WINDOW * len(net.labels))))
    for k in range(0, len(order), together):
        part = order[k : k + together]
        x = windows_of(data, starts[part], lengths[part], int(lengths[part[0]]))
        np.add.at(total, owner[part], net.window_sums(np.ascontiguousarray(x.T)))
    return total / np.maximum(sizes, 1)[:, None]


def has_letter(text: str | None) -> bool:
    return next(filter(str.isalpha, text or ""), None) is not None


def held_out(key: Column) -> Column:
    """A quarter of all documents, by the checksum of the id's text, is never learned from."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def training_windows(docs: DataFrame, per_language: int, pieces: int, width: int) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Languages, windows, their languages' places, and which of them validate.

    Every language of a document that may be learned from is a label.  Of each, the
    ``per_language`` distinct texts with the lowest keys are taken, whatever their ids; each gives
    ``pieces`` windows at places drawn by its key, every other one shorter.  The driver gets at
    most ``per_language * pieces`` windows of ``width`` bytes a language.
    """
    usable = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, keys, found = [], [], []
            for lang, key, text in zip(batch.column("lang").to_pylist(), batch.column("key").to_pylist(), batch.column("text"), strict=True):
                data = text.as_py().encode("utf-8", "surrogatepass")
                rng = np.random.default_rng(key & (1 << 63) - 1)
                for k in range(pieces):
                    size = width if k % 2 == 0 else int(rng.integers(6, width))
                    at = int(rng.integers(0, max(1, len(data) - size + 1)))
                    langs.append(lang)
                    keys.append(key)
                    found.append(data[at : at + size])
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(keys, pa.int64()), pa.array(found, pa.binary())], names=["lang", "key", "piece"])

    taken = lowest_texts(usable.select("lang", "text"), per_language, 10, "lang")
    rows = taken.select("lang", "key", "text").mapInArrow(run, "lang string, key long, piece binary").toArrow()
    rows = rows.sort_by([("lang", "ascending"), ("key", "ascending"), ("piece", "ascending")])
    labels = sorted(pc.unique(rows["lang"]).to_pylist())
    y = pc.index_in(rows["lang"], value_set=pa.array(labels, pa.string())).to_numpy().astype(np.int64)
    data = np.frombuffer(b"".join(rows["piece"].to_pylist()), np.uint8)
    sizes = pc.binary_length(rows["piece"]).to_numpy().astype(np.int64)
    windows = windows_of(data, np.cumsum(sizes) - sizes, sizes, width) if len(data) else np.empty((0, width), np.uint8)
    validates = rows["key"].to_numpy().astype(np.int64) % VALIDATING == 0
    return labels, windows, y, validates


#: Rows whose windows are in memory at once.
PREDICTED = 1000


def fit(docs: DataFrame, per_language: int = 600, pieces: int = 6, width: int = 64, hidden: int | None = None, steps: int | None = None) -> Network | None:
    """A network that has learned from ``doc_id, text, lang``; ``None`` where there is nothing to learn from.

    Unless given, ``steps`` grow with the number of languages, so each window is drawn as often
    whatever their number, and ``hidden`` with its root.  Of the runs at ``RATES`` the first whose
    validation loss is ``ENOUGH`` is taken, else the best.
    """
    labels, windows, y, validates = training_windows(docs, per_language, pieces, width)
    if not len(windows):
        return None
    learns = ~validates
    # Each language is learned from, though all its few texts validate.
    learns |= ~np.isin(y, np.unique(y[learns]))
    best, least = None, math.inf
    for seed, rate in enumerate(RATES):
        net = Network.fresh(labels, hidden or max(8, math.ceil(4 * math.sqrt(len(labels)))), seed=10 + seed)
        if len(labels) == 1:
            return net
        loss = net.train(windows[learns], y[learns], steps or max(300, 75 * len(labels)), rate=rate, held=(windows[validates], y[validates]))
        if best is None or loss < least:
            best, least = net, loss
        if least <= ENOUGH * math.log(len(labels)):
            break
    return best


def identify(docs: DataFrame, net: Network | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row of ``docs``.

    Without ``net`` one is fitted on the table's own documents that are not held out.  The
    prediction sees the text alone.  ``score`` is the pooled probability of ``lang_pred``.  Null
    texts, empty ones and those without a letter are ``und`` with score 0, as are all where there
    was nothing to learn from.  Of equal probabilities the label that sorts first is taken.  Equal
    texts get equal answers whatever their ids, and repeated rows repeat; a null id counts as
    empty text; very long texts are read whole; other columns are ignored; an empty table gives
    an empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    net = net or fit(rows)
    return predict(rows, net, ["doc_id"]).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def predict(rows: DataFrame, net: Network | None, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` of ``rows`` with ``lang_pred, score`` of the texts; plain column names, without dots or backticks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A part at a time: what windows of a whole batch take stays with the worker for all stages that follow.
        for batch in (whole.slice(k, PREDICTED) for whole in batches for k in range(0, len(whole), PREDICTED)):
            texts = batch.column(text_col).to_pylist()
            live = [k for k, t in enumerate(texts) if net is not None and has_letter(t)]
            names = np.full(len(texts), UNDETERMINED, dtype=object)
            scores = np.zeros(len(texts))
            if live:
                p = document_probabilities(net, [texts[k].encode("utf-8", "surrogatepass") for k in live])
                best = p.argmax(axis=1)
                names[live] = [net.labels[k] for k in best]
                scores[live] = np.clip(p[np.arange(len(live)), best], 0.0, 1.0)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(names, pa.string()), pa.array(scores)], names=[*keep, "lang_pred", "score"])

    source = rows.select(*dict.fromkeys([*keep, text_col]))
    kept = [T.StructField(c, source.schema[c].dataType) for c in keep]
    return source.mapInArrow(run, T.StructType([*kept, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def position_labels(net: Network, text: str) -> list[str]:
    """The label of every byte of a text."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    out: list[str] = []
    for k in range(0, len(data), WINDOW):
        p = net.positions(np.ascontiguousarray(data[k : k + WINDOW, None]))[0]
        out += [net.labels[j] for j in p[:, 0].argmax(axis=1)]
    return out
