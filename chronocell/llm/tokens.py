"""Exact token counts of every prefix of a text for a byte-level BPE vocabulary.

The encoding of a text under byte-level BPE is the one sequence of tokens in which every
two neighbours encode to themselves when joined.  So the last token of a prefix's encoding
is the only token that ends there and is compatible with the last token of the shorter
prefix before it, and ``count[p] = count[p - len(last[p])] + 1``: one pass of prefix
dynamic programming, linear in the text, gives the count at every prefix.

Merges never cross the pieces that the vocabulary's pattern cuts a text into, so tables
are kept by piece and added up; only the piece that a prefix ends in needs a look inside.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

#: Pieces of byte-level BPE (fixed value of the vocabulary).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space of that pattern (fixed value: the Unicode property White_Space).
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Totals of chunks that a worker remembers in a generation, and whole tables and beginnings before it starts afresh.
REMEMBERED = 600_000
KEPT_TABLES = 100_000
#: Bytes of a piece whose tables words with the same beginning share.
HEAD = 6


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, extra = [""] * 256, 256
    for b in range(256):
        if b in plain:
            letters[b] = chr(b)
        else:
            letters[b], extra = chr(extra), extra + 1
    return letters


class PrefixCounter:
    """Prefix tables for one vocabulary file of the ``tokenizers`` library."""

    def __init__(self, path: str):
        self._model = Tokenizer.from_file(path).model
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self._letters = _byte_letters()
        to_byte = {c: b for b, c in enumerate(self._letters)}
        self._id = {bytes(to_byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if all(c in to_byte for c in t)}
        self._bytes = {i: t for t, i in self._id.items()}
        self._longest = max(map(len, self._id))
        special = [t["content"] for t in spec["added_tokens"]]
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self._pieces = regex.compile(PIECES)
        # Chunks: runs without white space with one space before, or white space.  Pieces nest in them.
        self._chunks = re.compile(f"[{SPACE}]+(?![^{SPACE}])| ?[^{SPACE}]+|[{SPACE}]+")
        self._spaces = re.compile(f"[{SPACE}]+")
        self._fits: dict[int, bool] = {}
        self._begun: dict[bytes, tuple[tuple[int, ...], tuple[int, ...]]] = {}
        self._tables: dict[str, bytes] = {}
        self._totals: dict[str, int] = {}
        self._old: dict[str, int] = {}

    def _compatible(self, left: int, right: int) -> bool:
        """Whether the two tokens (left -1: none) encode to themselves when joined."""
        key = (left + 1) << 20 | right
        known = self._fits.get(key)
        if known is None:
            text = self._bytes.get(left, b"") + self._bytes[right]
            ids = [t.id for t in self._model.tokenize("".join(map(self._letters.__getitem__, text)))]
            known = ids == ([right] if left < 0 else [left, right])
            if len(self._fits) > REMEMBERED:
                self._fits.clear()
            self._fits[key] = known
        return known

    def byte_prefixes(self, piece: bytes) -> list[int]:
        """Tokens of each prefix of one piece, by bytes, from 0 to all of it."""
        find, known, check, longest = self._id.get, self._fits.get, self._compatible, self._longest
        n, head = len(piece), piece[:HEAD]
        begun = self._begun.get(head)
        last, count = (list(begun[0]), list(begun[1])) if begun else ([-1], [0])
        for end in range(len(last), n + 1):
            for start in range(end - longest if end > longest else 0, end):
                token = find(piece[start:end])
                if token is not None:
                    left = last[start]
                    fits = known((left + 1) << 20 | token)
                    if fits or fits is None and check(left, token):
                        last.append(token)
                        count.append(count[start] + 1)
                        break
            else:
                raise ValueError("the vocabulary lacks a byte")
            if end == HEAD and not begun:
                if len(self._begun) >= KEPT_TABLES:
                    self._begun.clear()
                self._begun[head] = tuple(last), tuple(count)
        return count

    def _piece_table(self, piece: str) -> list[int] | bytes:
        """Tokens of each prefix of a piece, by code points."""
        table = self._tables.get(piece)
        if table is None:
            raw = piece.encode("utf-8", "surrogatepass")
            table = self.byte_prefixes(raw)
            if len(raw) != len(piece):
                heads = np.frombuffer(raw, dtype=np.uint8) & 0xC0 != 0x80
                table = np.array(table)[np.append(np.flatnonzero(heads), len(raw))].tolist()
            if len(piece) > 2 and piece[0] == "'" and piece[1].isalpha():
                table[2] = 2  # 'r of 're: apart, an apostrophe and a letter
            if len(piece) < 64:
                table = bytes(table)
                if len(self._tables) >= KEPT_TABLES:
                    self._tables.clear()
                self._tables[piece] = table
        return table

    def _total(self, chunk: str) -> int:
        """Tokens of a chunk, remembered in two generations: what the young one misses the old one may have."""
        total = self._old.get(chunk)
        if total is None:
            pieces = self._pieces.findall(chunk)
            if len(pieces) == 1:
                total = self._piece_table(chunk)[-1]
            else:
                get = self._totals.get
                total = sum([get(p) or self._total(p) for p in pieces])
        if len(chunk) < 64:
            if len(self._totals) >= REMEMBERED:
                self._old, self._totals = self._totals, {}
            self._totals[chunk] = total
        return total

    def _runs(self, text: str) -> list[tuple[str, bool]]:
        """The text cut at special strings: parts and whether each is special."""
        if not text:
            return []
        if not self._special or not self._special.search(text):
            return [(text, False)]
        return [(part, i % 2 == 1) for i, part in enumerate(self._special.split(text)) if part]

    def totals(self, text: str) -> tuple[list[str], np.ndarray]:
        """The text's chunks and the tokens up to the end of each."""
        chunks: list[str] = []
        counts: list[int] = []
        slow = self._total
        for part, special in self._runs(text):
            if special:
                chunks.append(part)
                counts.append(1)
                continue
            found = self._chunks.findall(part)
            chunks += found
            get = self._totals.get
            counts += [get(c) or slow(c) for c in found]
        return chunks, np.cumsum(counts, dtype=np.int64) if counts else np.zeros(0, np.int64)

    def count(self, text: str | None) -> int:
        upto = self.totals(text or "")[1]
        return int(upto[-1]) if len(upto) else 0

    def _ordinary(self, part: str) -> np.ndarray:
        """Tokens of ``part[:p]`` for every ``p`` from 1, special strings not looked for."""
        tail = np.empty(len(part), dtype=np.int64)
        at = before = 0
        for piece in self._pieces.findall(part):
            tail[at : at + len(piece)] = before + np.array(list(self._piece_table(piece)[1:]))
            at, before = at + len(piece), int(tail[at + len(piece) - 1])
        # A prefix that ends in white space ends in one piece: that run so far.
        for run in self._spaces.finditer(part):
            start = run.start()
            tail[start : run.end()] = (int(tail[start - 1]) if start else 0) + np.array(list(self._piece_table(run[0])[1:]))
        return tail

    def prefixes(self, text: str | None) -> np.ndarray:
        """Tokens of ``text[:p]`` for every ``p`` from 0 to its length, each as if encoded alone."""
        out = [np.zeros(1, dtype=np.int64)]
        before, ordinary = 0, ""
        for part, special in [*self._runs(text or ""), ("", True)]:
            if not special:
                ordinary = part
                continue
            # A special string that is not whole is ordinary text that continues the part before it.
            out.append(before + self._ordinary(ordinary + part[:-1]))
            before += self.count(ordinary)
            if part:
                before += 1
                out.append(np.array([before], dtype=np.int64))
            ordinary = ""
        return np.concatenate(out)

    def truncate(self, text: str | None, budget: int) -> int:
        """The length in code points of the longest prefix of at most ``budget`` tokens."""
        text = text or ""
        return self.fitting(text, *self.totals(text), budget)

    def fitting(self, text: str, chunks: list[str], upto: np.ndarray, budget: int) -> int:
        """``truncate`` of a text whose ``totals`` are given."""
        if not len(upto) or upto[-1] <= budget:
            return len(text)
        # Counts of prefixes can fall by a token or two where a piece grows; look a few chunks on.
        last = int(np.searchsorted(upto, budget + 2, side="right"))
        near = max(0, last - 3)
        while near and chunks[near - 1].isspace():
            near -= 1
        start = sum(map(len, chunks[:near]))
        base = int(upto[near - 1]) if near else 0
        window = "".join(chunks[near : last + 3])
        if self._special and near and self._special.search("".join(chunks[max(0, near - 1) : last + 3])):
            near, start, base, window = 0, 0, 0, "".join(chunks[: last + 3])
        counts = base + self.prefixes(window)
        return start + int(np.flatnonzero(counts <= budget)[-1])


@lru_cache(maxsize=4)
def counter(path: str) -> PrefixCounter:
    """One counter a worker and file; its tables serve every batch."""
    return PrefixCounter(path)


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit, fits_chars`` for every row of ``docs``.

    ``fits_chars`` is the length of the longest prefix of at most ``limit`` tokens, read from
    the prefix tables.  Null and empty texts have 0 of all.  Rows that repeat are counted
    each; a null id stays null; other columns are ignored; an empty table gives an empty
    result.  ``vocabulary`` is a path that every executor has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = counter(vocabulary)
        for batch in batches:
            n_bytes, n_tokens, fits = [], [], []
            for value in batch.column("text"):
                text = value.as_py() or ""
                chunks, upto = tables.totals(text)
                n_bytes.append(len(text.encode("utf-8", "surrogatepass")))
                n_tokens.append(int(upto[-1]) if len(upto) else 0)
                fits.append(tables.fitting(text, chunks, upto, limit))
            numbers = [pa.array(x, pa.int64()) for x in (n_bytes, n_tokens, fits)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *numbers], names=["doc_id", "n_bytes", "n_tokens", "fits_chars"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, fits_chars long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def prefix_tables(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, counts``: tokens of every prefix of each text by code points, 0 first.

    Null and empty texts have the empty prefix alone, ``[0]``.  Rows that repeat have a row each; a null
    id stays null; other columns are ignored; an empty table gives an empty result.  A very long text
    has as many counts as it has code points, and takes memory by that.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = counter(vocabulary)
        for batch in batches:
            counts = pa.array([tables.prefixes(v.as_py()).astype(np.int32) for v in batch.column("text")], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), counts], names=["doc_id", "counts"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, counts array<int>")
