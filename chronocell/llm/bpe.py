"""Encoding and decoding by byte-level BPE over contiguous rank arrays.

A word is an array of part boundaries with an array beside it that holds, for each two neighbours,
the rank of the merge that would join them.  The least rank is found by a scan, its boundary is
deleted, and only the two ranks beside it are looked up anew; words are short, so the scans run
over a few numbers that lie together.  Of equal ranks the leftmost goes first, as in the library.

A word of more than ``SHORT`` bytes would make the scans quadratic; it keeps its parts in a linked
list and its ranks in a heap instead, which merges in the same order.
"""

from __future__ import annotations

import heapq
import json
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronocell.llm.tokens import PIECES, SPACE, _byte_letters

#: Bytes of a word beyond which its ranks are kept in a heap.
SHORT = 96
#: Encoded words in a generation of what a worker remembers, and code points of the longest of them.
REMEMBERED = 400_000
LONGEST = 64
#: Stands for a merge that the vocabulary does not have.
NEVER = 1 << 40


class Codec:
    """One vocabulary file of the ``tokenizers`` library: byte-level, merges in order of rank."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        letters = _byte_letters()
        to_byte = {c: b for b, c in enumerate(letters)}
        self._byte_id = [vocab[c] for c in letters]
        self._rank: dict[int, int] = {}
        self._joined: list[int] = []
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self._rank[vocab[left] << 32 | vocab[right]] = rank
            self._joined.append(vocab[left + right])
        # The ranks of all pairs of bytes, for the first look at a word.
        self._first = [self._rank.get(a << 32 | b, NEVER) for a in self._byte_id for b in self._byte_id]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special = {text: np.array([i], "<u4").tobytes() for text, i in special.items()}
        self._cut = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self._bytes = [b""] * (max([*vocab.values(), *special.values()]) + 1)
        for text, i in vocab.items():
            self._bytes[i] = bytes(map(to_byte.__getitem__, text)) if all(c in to_byte for c in text) else text.encode()
        for text, i in special.items():
            # The library's decoder reads an added token by the same letters where it can.
            self._bytes[i] = bytes(map(to_byte.__getitem__, text)) if all(c in to_byte for c in text) else text.encode()
        self._pieces = regex.compile(PIECES)
        # Runs without white space with one space before, or white space: pieces nest in them, and they repeat.
        self._words = re.compile(f"[{SPACE}]+(?![^{SPACE}])| ?[^{SPACE}]+|[{SPACE}]+")
        self._known: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}

    def merged(self, piece: bytes) -> list[int]:
        """The tokens of one piece."""
        return self._scanned(piece) if len(piece) <= SHORT else self._heaped(piece)

    def _scanned(self, piece: bytes) -> list[int]:
        """``merged`` by scans for the least rank.

        What lies between two boundaries is held by its token, so deleting the boundary at the
        right of part k takes token k + 1 out; the merge over that boundary has its rank at k.
        """
        rank = self._rank.get
        parts = list(map(self._byte_id.__getitem__, piece))
        ranks = [self._first[a << 8 | b] for a, b in zip(piece, piece[1:])]
        while ranks and (least := min(ranks)) != NEVER:
            k = ranks.index(least)
            parts[k] = joined = self._joined[least]
            del parts[k + 1], ranks[k]
            if k:
                ranks[k - 1] = rank(parts[k - 1] << 32 | joined, NEVER)
            if k < len(ranks):
                ranks[k] = rank(joined << 32 | parts[k + 1], NEVER)
        return parts

    def _heaped(self, piece: bytes) -> list[int]:
        """``merged`` by a heap of ranks and places over a linked list of parts."""
        rank = self._rank.get
        n = len(piece)
        ids = [self._byte_id[b] for b in piece]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, k) for k in range(n - 1) if (r := rank(ids[k] << 32 | ids[k + 1], NEVER)) != NEVER]
        heapq.heapify(heap)
        while heap:
            least, k = heapq.heappop(heap)
            right = after[k]
            if ids[k] < 0 or right >= n or rank(ids[k] << 32 | ids[right], NEVER) != least:
                continue  # a part of it has been merged meanwhile
            ids[k], ids[right] = self._joined[least], -1
            after[k] = right = after[right]
            if right < n:
                before[right] = k
            for a, b in ((before[k], k), (k, right)):
                if a >= 0 and b < n and (r := rank(ids[a] << 32 | ids[b], NEVER)) != NEVER:
                    heapq.heappush(heap, (r, a))
        return [i for i in ids if i >= 0]

    def _word(self, word: str) -> bytes:
        """The packed tokens of a word, whose pieces are merged apart.

        Words and pieces are remembered in two generations: what the young one misses the old one may have.
        """
        known = self._old.get(word)
        if known is None:
            pieces = self._pieces.findall(word)
            if len(pieces) == 1:
                ids = self.merged(word.encode("utf-8", "surrogatepass"))
                known = struct.pack(f"<{len(ids)}I", *ids)
            else:
                get = self._known.get
                known = b"".join([get(p) or self._word(p) for p in pieces])
        if len(word) <= LONGEST:
            if len(self._known) >= REMEMBERED:
                self._old, self._known = self._known, {}
            self._known[word] = known
        return known

    def encode(self, text: str | None) -> bytes:
        """The text's tokens as little-endian unsigned 32-bit integers; special strings give their tokens."""
        if not text:
            return b""
        parts = self._cut.split(text) if self._cut and self._cut.search(text) else [text]
        out: list[bytes] = []
        get, slow = self._known.get, self._word
        for k, part in enumerate(parts):
            if k % 2:
                out.append(self._special[part])
            else:
                out += [get(w) or slow(w) for w in self._words.findall(part)]
                get = self._known.get
        return b"".join(out)

    def decode(self, packed: bytes | None) -> str:
        """The text of packed tokens, special tokens as their strings; bytes that are no UTF-8 give U+FFFD."""
        ids = np.frombuffer(packed or b"", "<u4").tolist()
        return b"".join(map(self._bytes.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    """One codec a worker and file; what it remembers serves every batch."""
    return Codec(path)


def _mapped(rows: DataFrame, kept: str, given: str, made: str, kind: pa.DataType, schema: str, one) -> DataFrame:
    """``kept`` and ``made``, which ``one`` makes of each value of ``given``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = pa.array([one(v.as_py()) for v in batch.column(given)], kind)
            yield pa.RecordBatch.from_arrays([batch.column(kept), out], names=[kept, made])

    return rows.select(kept, given).mapInArrow(run, schema)


def encoded(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids`` of every row of ``docs``: the text's tokens, packed as ``Codec.encode`` does.

    Null and empty texts have no tokens, an empty value and not null.  Rows that repeat are encoded
    each; a null id stays null; other columns are ignored; an empty table gives an empty result.  A
    very long text takes memory by its length, and so does a very long word.  ``vocabulary`` is a
    path that every executor has.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return _mapped(rows, "doc_id", "text", "ids", pa.binary(), "doc_id long, ids binary", lambda text: codec(vocabulary).encode(text))


def decoded(tokens: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id, text`` of the rows ``doc_id, ids`` of ``encoded``; null tokens give an empty text."""
    return _mapped(tokens, "doc_id", "ids", "text", pa.string(), "doc_id long, text string", lambda ids: codec(vocabulary).decode(ids))


def n_tokens(ids: Column) -> Column:
    """How many tokens a packed value holds."""
    return (F.octet_length(ids) / 4).cast("long")


def token_at(ids: Column, place: Column) -> Column:
    """The token at a place from 0 of a packed value; null past its end."""
    digits = F.hex(F.substring(ids, place.cast("int") * 4 + 1, F.lit(4)))
    return F.when(place < n_tokens(ids), F.conv(F.concat(*[F.substring(digits, k, 2) for k in (7, 5, 3, 1)]), 16, 10).cast("long"))


def round_trip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids, text``: each row's packed tokens and the text decoded from them; cases as in ``encoded``.

    Both ways in one pass, so that a task has one worker with one set of tables.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary)
        for batch in batches:
            ids = [own.encode(v.as_py()) for v in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary()), pa.array(map(own.decode, ids), pa.string())], names=["doc_id", "ids", "text"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids binary, text string")
