"""Benchmark decontamination by winnowing, with DataFrame functions only.

A text's k-grams of words are hashed and of every ``w`` consecutive hashes the smallest
(the last of equals) is kept.  Two texts that share ``k + w - 1`` words in a row keep a
common fingerprint in that stretch, so with ``k + w - 1 = window`` every shared window is
found.  Each joint fingerprint is a hit that is extended to both sides as far as the
words agree; a stretch of at least ``window`` words (or the whole of a shorter item)
counts.  Items shorter than the window keep one fingerprint a length: the hash of their
whole, looked up among the document's stretches of that length.

Texts are searched whole, however long; a text's words are one row of one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronocell.sources.scratch import Scratch

SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of the fingerprint table up to which each executor gets a copy of it.
BROADCAST_BYTES = 64 << 20
#: Places in items that one row of a fingerprint lists where it is shuffled; one that is more frequent has more rows.
PLACES_A_ROW = 64


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; the quick function where the text has only ASCII."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def word_list(text: Column) -> Column:
    """The words of a text in order; an empty array for null."""
    parts = F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATOR)
    # Only the first and the last part can be empty.
    first = F.when(parts[0] == "", 2).otherwise(1)
    last = F.size(parts) - F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)
    return F.slice(parts, first, F.greatest(last - first + 1, F.lit(0)))


def word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _gram(hashes: str, at: str, length: int) -> str:
    """SQL: the hash of ``length`` words from place ``at`` (from 0), made of their hashes."""
    return "xxhash64(" + ", ".join(f"{hashes}[{at} + {k}]" for k in range(length)) + ")"


def _grams(hashes: str, length: int) -> str:
    """SQL: hashes of the ``length``-grams of an array that has at least that many word hashes."""
    return f"transform(sequence(0, size({hashes}) - {length}), i -> {_gram(hashes, 'i', length)})"


def _winnowed(w: int) -> Column:
    """Array of ``(h, pos)`` (``pos`` from 1) kept from the array ``grams``: of ``w`` in a row the last smallest."""
    last = "1"
    for k in range(1, w):
        before = [f"grams[j + {m}]" for m in range(k)]
        smallest = before[0] if k == 1 else f"least({', '.join(before)})"
        last = f"CASE WHEN grams[j + {k}] <= {smallest} THEN {k + 1} ELSE {last} END"
    places = f"array_distinct(transform(sequence(0, size(grams) - {w}), j -> j + {last}))"
    return F.expr(f"transform({places}, p -> named_struct('h', grams[p - 1], 'pos', p))")


def _whole(window: int) -> Column:
    """The hash of all of ``hashes`` where those are fewer than ``window``."""
    out = F.lit(None).cast("long")
    for n in range(1, window):
        out = F.when(F.size("hashes") == n, F.expr(_gram("hashes", "0", n))).otherwise(out)
    return out


def item_fingerprints(items: DataFrame, window: int, k: int) -> DataFrame:
    """``h, pos, item_id, item_words, length`` of all items: winnowed, or one for a short item.

    Items are the same only where id and words are; texts that share an id each keep all theirs.
    """
    w = window - k + 1
    items = items.select("item_id", "item_words").distinct().withColumn("hashes", word_hashes(F.col("item_words")))
    full = items.where(F.size("item_words") >= window)
    full = full.withColumn("grams", F.expr(_grams("hashes", k))).withColumn("f", F.explode(_winnowed(w)))
    full = full.select("f.h", "f.pos", "item_id", "item_words", F.lit(k).alias("length"))
    short = items.where((F.size("item_words") > 0) & (F.size("item_words") < window))
    short = short.select(_whole(window).alias("h"), F.lit(1).alias("pos"), "item_id", "item_words", F.size("item_words").alias("length"))
    return full.unionByName(short)


def _document_prints(docs: DataFrame, window: int, k: int, short_lengths: list[int]) -> DataFrame:
    """``docs`` (with array ``words``) with one row a fingerprint: ``h, pos, length``."""
    w = window - k + 1
    n = F.size("words")
    docs = docs.withColumn("hashes", word_hashes(F.col("words")))
    docs = docs.withColumn("grams", F.when(n >= window, F.expr(_grams("hashes", k))))
    empty = "cast(array() as array<struct<h:bigint,pos:int,length:int>>)"
    kept = F.when(n >= window, F.transform(_winnowed(w), lambda f: F.struct(f["h"].alias("h"), f["pos"].alias("pos"), F.lit(k).alias("length"))))
    parts = [F.coalesce(kept, F.expr(empty))]
    for length in short_lengths:
        hashed = F.expr(f"transform(sequence(0, size(hashes) - {length}), i -> named_struct('h', {_gram('hashes', 'i', length)}, 'pos', i + 1, 'length', {length}))")
        parts.append(F.when(n >= length, hashed).otherwise(F.expr(empty)))
    prints = F.concat(*parts) if len(parts) > 1 else parts[0]
    return docs.select(*[c for c in docs.columns if c not in ("hashes", "grams")], F.inline(prints).alias("h", "pos", "length"))


def _extended(seeds: DataFrame, window: int) -> DataFrame:
    """``start, end`` (end exclusive, from 1) of the stretch around each seed on which the words agree."""
    ahead = "array_position(zip_with(slice(words, pos, least(size(words) - pos, size(item_words) - ipos) + 1), slice(item_words, ipos, least(size(words) - pos, size(item_words) - ipos) + 1), (a, b) -> a = b), false)"
    behind = "array_position(reverse(zip_with(slice(words, pos - least(pos, ipos) + 1, least(pos, ipos) - 1), slice(item_words, ipos - least(pos, ipos) + 1, least(pos, ipos) - 1), (a, b) -> a = b)), false)"
    seeds = seeds.withColumn("ahead", F.expr(ahead)).withColumn("behind", F.expr(behind))
    reach = F.least(F.size("words") - F.col("pos"), F.size("item_words") - F.col("ipos")) + 1
    back = F.least("pos", "ipos") - 1
    ahead_n = F.when(F.col("ahead") > 0, F.col("ahead") - 1).otherwise(reach)
    behind_n = F.when(F.col("behind") > 0, F.col("behind") - 1).otherwise(back)
    out = seeds.withColumn("start", F.col("pos") - behind_n).withColumn("end", F.col("pos") + ahead_n)
    return out.where(F.col("end") - F.col("start") >= F.least(F.lit(window), F.size("item_words")))


def covered(spans: Column) -> Column:
    """Length of the union of an array of ``(start, end)``."""
    zero = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("upto"))

    def step(acc, s):
        start = F.greatest(acc["upto"], s["start"].cast("long"))
        return F.struct((acc["total"] + F.greatest(s["end"].cast("long") - start, F.lit(0).cast("long"))).alias("total"), F.greatest(acc["upto"], s["end"].cast("long")).alias("upto"))

    return F.aggregate(F.array_sort(spans), zero, step, lambda acc: acc["total"])


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 10,
    k: int = 6,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``doc_id, n_words, n_hit, spans, items`` for every row of ``docs``.

    ``spans`` are the maximal agreeing stretches as ``(start, end)`` word places, from 1
    and end exclusive; ``n_hit`` the words in their union; ``items`` the distinct ids of
    items found.  Null or wordless texts have no words and no hits, as do items; equal
    rows get equal results, repeated rows repeat; null ids are ids; empty tables on either side
    are fine.  Other columns are ignored.

    The fingerprint table is written first, so its size is known: up to
    ``broadcast_bytes`` every executor gets it and hits are found where the document is
    read; beyond, fingerprints are shuffled by hash and the documents that have hits are
    joined to them afterwards.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "winnow")
    items = benchmark.select(F.col(item_col).alias("item_id"), word_list(F.col(item_text_col)).alias("item_words"))
    prints = scratch.keep(item_fingerprints(items, window, k), "items")
    about = prints.groupBy("length").agg(F.sum(F.octet_length(F.to_json("item_words")) + 64).alias("bytes"), F.max("length").alias("l")).collect()
    short_lengths = sorted({r["l"] for r in about if r["l"] < window} - {k}) + ([k] if prints.where((F.size("item_words") == k)).limit(1).count() else [])
    small = sum(r["bytes"] for r in about) <= broadcast_bytes

    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    keyed = base.withColumn("text_key", F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    worded = base.withColumn("words", word_list(F.col("text")))
    right = prints.select(F.col("h"), F.col("length"), F.col("pos").alias("ipos"), "item_id", "item_words")
    if small:
        found = _document_prints(worded, window, k, short_lengths).join(F.broadcast(right), ["h", "length"])
    else:
        # Only numbers meet by hash; items' words come to the places that are left.
        item_key = F.md5(F.concat_ws("/", F.col("item_id").isNull().cast("string"), F.col("item_id").cast("string"), F.array_join("item_words", " ")).cast("binary"))
        right = right.withColumn("item_key", item_key)
        words_of = right.select("item_key", "item_id", "item_words").dropDuplicates(["item_key"])
        # A fingerprint is one row to the documents, however many items have it: their places follow in rows of bounded length.
        known = right.groupBy("h", "length").agg(F.ceil(F.count(F.lit(1)) / PLACES_A_ROW).cast("int").alias("rows"))
        in_items = right.join(known, ["h", "length"]).withColumn("row", F.pmod(F.xxhash64("item_key", "ipos"), F.col("rows")).cast("int"))
        in_items = in_items.groupBy("h", "length", "row").agg(F.collect_list(F.struct("ipos", "item_key")).alias("in_items"))
        narrow = _document_prints(keyed.withColumn("words", word_list(F.col("text"))).drop("text"), window, k, short_lengths)
        places = narrow.select("doc_id", "text_key", "h", "length", "pos").join(known, ["h", "length"])
        places = scratch.keep(places, "places")
        same = (F.col("d.text_key") == F.col("p.text_key")) & F.col("d.doc_id").eqNullSafe(F.col("p.doc_id"))
        hit = keyed.alias("d").join(places.select("doc_id", "text_key").distinct().alias("p"), same, "left_semi")
        hit = hit.dropDuplicates(["doc_id", "text_key"]).withColumn("words", word_list(F.col("text")))
        met = places.withColumn("row", F.explode(F.sequence(F.lit(0), F.col("rows") - 1))).join(in_items, ["h", "length", "row"])
        met = scratch.keep(met.select("doc_id", "text_key", "pos", F.inline("in_items").alias("ipos", "item_key")), "met")
        found = hit.alias("d").join(met.alias("p"), same).select("d.doc_id", "d.text", "d.words", "p.pos", "p.ipos", "p.item_key").join(words_of, "item_key")
    spans = _extended(found, window)
    spans = spans.select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_key"), "start", "end", "item_id").distinct()
    hits = spans.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", "end")).alias("spans"), F.collect_set(F.struct("item_id")).alias("items"))
    hits = hits.withColumn("items", F.col("items.item_id"))  # collect_set of the ids themselves leaves out null
    hits = scratch.keep(hits, "hits")

    n_words = F.coalesce(F.size(F.split(F.coalesce("text", F.lit("")), r"[0-9A-Za-z\x{80}-\x{10FFFF}]+")) - 1, F.lit(0)).cast("long")
    rows = keyed.select("doc_id", "text_key", n_words.alias("n_words"))
    out = rows.alias("r").join(hits.alias("h"), (F.col("r.text_key") == F.col("h.text_key")) & F.col("r.doc_id").eqNullSafe(F.col("h.doc_id")), "left")
    none = F.expr("cast(array() as array<struct<start:int,end:int>>)")
    return out.select(
        "r.doc_id",
        "n_words",
        F.coalesce(covered(F.col("spans")), F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.array_sort("spans"), none).alias("spans"),
        F.coalesce("items", F.array().cast(benchmark.select(F.col(item_col)).schema[0].dataType.simpleString().join(("array<", ">")))).alias("items"),
    )
