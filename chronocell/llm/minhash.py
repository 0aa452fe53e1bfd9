"""Near-duplicate groups by b-bit MinHash.

1. One pass over the texts: the set of distinct word shingles, its minima under
   ``bands * rows`` hash functions, a key for each band of minima, the low bits of
   the minima packed as bit planes, and a 128-bit digest of the whole set.
2. Documents with equal sets are one class; only its smallest id goes on.
3. Documents that share a band key form a bucket.  Each member is paired with the
   bucket's smallest id, so a bucket of m gives m - 1 pairs.  Similarity is estimated from
   the packed bits and corrected for chance collisions; pairs far below the threshold are
   ruled out, and of the others each member's likeliest are confirmed on the full sets.
4. Confirmed links give components.  Where many members of large buckets are outside the
   bucket's largest component, they meet a few hubs from it in turns, linear in the bucket,
   as long as that connects them; again the likeliest are confirmed.
5. Then the members that are still outside are compared with those of the other components
   of the bucket in the same way, so every pair in a bucket is either confirmed, ruled
   out, or already connected.  Where that would be many pairs, as among unlike texts that
   share some boilerplate, only those meet that share a longer band of longer signatures.
6. Components again, spread to all members of each class.

With 48 bands of 4 rows a pair at similarity 0.75 shares no bucket with probability
1.2e-8; the estimate's standard deviation there is 0.038 and the margin is six of them.  With
256 bands of 8 rows, the longer ones, it shares none with probability 2e-12.

Texts are compared whole, however long.  Scratch tables go as soon as nothing reads them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronocell.llm.components import connected_components
from chronocell.llm.presence import BITS, may_be_in, presence
from chronocell.llm.shingles import mix64, shingle_set
from chronocell.sources.scratch import Scratch

SIGNATURE = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n", T.LongType()),
        T.StructField("set1", T.LongType()),
        T.StructField("set2", T.LongType()),
        T.StructField("keys", T.ArrayType(T.LongType())),
        T.StructField("planes", T.ArrayType(T.LongType())),
    ]
)


#: Members of a bucket's main component that an outside member meets in a turn.
HUBS = 4
#: Pairs of a member that are confirmed in a turn; more wait for the next.
LIKELIEST = 8
#: Pairs for each member of all buckets up to which the pairs left are compared at once, without hubs first.
PAIRS_A_MEMBER = 4
#: The same where hubs no longer help.  Longer bands would make a row of each member for every band, and that is so many.
LOOKS_A_MEMBER = 256
#: Members of a bucket up to which that is done at all, and of a part of a bucket: two parts meet in a task.
LARGEST_BUCKET = 1_000_000
BUCKET_PART = 4096

#: Bands, rows and bits of the longer signatures for pairs that are left.
FINE_BANDS, FINE_ROWS, FINE_BITS = 256, 8, 2
FINE = FINE_BANDS * FINE_ROWS

NONE = np.empty(0, dtype=np.int64)


def lists(arrays: list[np.ndarray]) -> pa.Array:
    """An Arrow array of lists of longs."""
    ends = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays) if arrays else NONE))


class MinHasher:
    """``bands * rows`` minima of a set of 64-bit shingles; the product is a multiple of 64."""

    def __init__(self, bands: int = 48, rows: int = 4, bits: int = 2, seed: int = 5):
        if bands * rows % 64:
            raise ValueError("bands * rows must be a multiple of 64")
        self.bands, self.rows, self.bits = bands, rows, bits
        rng = np.random.default_rng(seed)
        self.k = bands * rows
        self.a = (rng.integers(0, 2**32, self.k, dtype=np.uint32) | np.uint32(1))[:, None]
        self.b = rng.integers(0, 2**32, self.k, dtype=np.uint32)[:, None]
        self.band_seed = rng.integers(0, 2**63, bands, dtype=np.uint64)

    def minima(self, shingles: np.ndarray) -> np.ndarray:
        x = (shingles >> np.uint64(32)).astype(np.uint32)[None, :]
        out = np.full(self.k, np.uint32(0xFFFFFFFF))
        for at in range(0, x.shape[1], 1024):
            hashed = x[:, at : at + 1024] * self.a
            hashed += self.b
            np.minimum(out, hashed.min(axis=1), out=out)
        return out

    def keys(self, minima: np.ndarray) -> np.ndarray:
        parts = minima.reshape(self.bands, self.rows).astype(np.uint64)
        key = self.band_seed.copy()
        for r in range(self.rows):
            key = mix64(key ^ parts[:, r]) + np.uint64(r)
        return key.view(np.int64)

    def planes(self, minima: np.ndarray) -> np.ndarray:
        # A bijective mix first: the low bits of a * x + b depend on the low bits of x alone.
        low = mix64(minima.astype(np.uint64))
        rows = [np.packbits(((low >> np.uint64(p)) & np.uint64(1)).astype(np.uint8)).view(np.int64) for p in range(self.bits)]
        return np.concatenate(rows)


def signatures(docs: DataFrame, hasher: MinHasher, words: int, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, n, set1, set2, keys, planes`` for every row; without shingles both arrays are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, set1, set2, keys, planes = [], [], [], [], []
            for text in batch.column("text"):
                s = shingle_set(text.as_py(), words)
                n.append(len(s))
                set1.append(int(np.bitwise_xor.reduce(mix64(s)).view(np.int64)) if len(s) else 0)
                set2.append(int(s.sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
                minima = hasher.minima(s) if len(s) else None
                keys.append(hasher.keys(minima) if len(s) else NONE)
                planes.append(hasher.planes(minima) if len(s) else NONE)
            columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(set1, pa.int64()), pa.array(set2, pa.int64()), lists(keys), lists(planes)]
            yield pa.RecordBatch.from_arrays(columns, names=SIGNATURE.names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SIGNATURE)


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """``doc_id, shingles``: the full sets as arrays of longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), words).view(np.int64) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists(sets)], names=["doc_id", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, shingles array<long>")


def fine_signatures(docs: DataFrame, words: int) -> DataFrame:
    """``doc_id, fine, fine_keys``: longer packed signatures, and their band keys, of each text that has shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = MinHasher(FINE_BANDS, FINE_ROWS, FINE_BITS, seed=6)
        for batch in batches:
            sets = [shingle_set(t.as_py(), words) for t in batch.column("text")]
            minima = [hasher.minima(s) if len(s) else None for s in sets]
            planes, keys = ([f(m) if m is not None else NONE for m in minima] for f in (hasher.planes, hasher.keys))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists(planes), lists(keys)], names=["doc_id", "fine", "fine_keys"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fine array<long>, fine_keys array<long>").where("size(fine) > 0")


def estimated_similarity(left: str, right: str, k: int, bits: int) -> Column:
    """Jaccard similarity from two packed signatures: matches corrected for 2**-bits chance hits."""
    words = k // 64
    differ = None
    for w in range(words):
        bad = None
        for p in range(bits):
            x = F.col(left)[p * words + w].bitwiseXOR(F.col(right)[p * words + w])
            bad = x if bad is None else bad.bitwiseOR(x)
        differ = F.bit_count(bad) if differ is None else differ + F.bit_count(bad)
    chance = 2.0**-bits
    return (1 - differ / F.lit(float(k)) - chance) / (1 - chance)


def _margin(threshold: float, k: int, bits: int, deviations: float = 6) -> float:
    chance = 2.0**-bits
    hit = threshold + (1 - threshold) * chance
    return deviations * sqrt(hit * (1 - hit) / k) / (1 - chance)


def near_duplicates(
    docs: DataFrame,
    threshold: float = 0.75,
    words: int = 5,
    hasher: MinHasher | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``.

    Documents whose shingle sets have ``intersection >= threshold * union`` are linked;
    ``component_id`` is the smallest id that links lead to, the document's own included.
    ``kept`` marks that document.

    Null or empty texts and texts without words have no shingles, are linked with
    nothing and are kept.  Rows that repeat an id are one node, linked as any of them is;
    each row is returned.  A null id is never linked and gets a null
    component.  Other columns are ignored; an empty table gives an empty result.
    """
    spark, hasher = docs.sparkSession, hasher or MinHasher()
    scratch = Scratch(spark, "minhash")
    percent = round(threshold * 100)
    signed = scratch.keep(signatures(docs, hasher, words, id_col, text_col), "signatures")

    usable = signed.where("n > 0 AND doc_id IS NOT NULL")
    classes = usable.groupBy("set1", "set2", "n").agg(F.min("doc_id").alias("rep"))
    classes = scratch.keep(classes, "classes")
    is_rep = (F.col("doc_id") == F.col("c.rep")) & (F.col("s.n") == F.col("c.n")) & (F.col("s.set1") == F.col("c.set1")) & (F.col("s.set2") == F.col("c.set2"))
    reps = usable.alias("s").join(classes.alias("c"), is_rep, "left_semi").dropDuplicates(["doc_id", "n", "set1", "set2"])
    reps = scratch.keep(reps.select(F.col("doc_id").alias("id"), "n", "keys", "planes"), "representatives")
    of_rows = scratch.keep(signed.select("doc_id", "n", "set1", "set2"), "rows")
    scratch.drop(signed)

    # An id that is on rows of different texts links their classes.
    of_id = of_rows.where("n > 0 AND doc_id IS NOT NULL")
    text_of = F.struct("set1", "set2", "n")
    several = of_id.groupBy("doc_id").agg(F.min(text_of).alias("low"), F.max(text_of).alias("high")).where("low < high").select("doc_id")
    several = of_id.join(several, "doc_id", "left_semi").distinct().join(classes, ["set1", "set2", "n"]).select("doc_id", "rep")
    first = several.groupBy("doc_id").agg(F.min("rep").alias("a"))
    own = several.join(first, "doc_id").select("a", F.col("rep").alias("b")).where("a < b")

    # Buckets: members of every band key that at least two representatives have.
    keyed = reps.select("id", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("id").alias("head"), F.max("id").alias("last")).where("head < last")
    members = keyed.join(shared.select("key", "head"), "key")
    members = scratch.keep(members, "members")

    least = threshold - _margin(threshold, hasher.k, hasher.bits)
    card = reps.select("id", "n", "planes")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def texts_of(ids: DataFrame, most: int) -> DataFrame:
        """The texts of ``ids`` (``doc_id``, ``most`` rows), and a few others: told apart where they are read, not shuffled.

        Where there may be more ids than the filter tells apart well, they are joined too.
        """
        rows, there = may_be_in(texts, "doc_id", presence(ids))
        rows = rows.where(there).select("doc_id", "text")
        return rows if most <= BITS // 8 else rows.join(ids.distinct(), "doc_id", "left_semi")

    def likeliest(pairs: DataFrame, *of: str) -> DataFrame:
        """Of pairs ``a, b`` that sizes and packed bits do not rule out, the ``LIKELIEST`` of each ``of``.

        The others are not lost: what they would connect and this does not is still open afterwards.
        """
        both = pairs.join(card.toDF("a", "na", "pa"), "a").join(card.toDF("b", "nb", "pb"), "b")
        fits = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent
        both = both.withColumn("alike", estimated_similarity("pa", "pb", hasher.k, hasher.bits)).where(fits & (F.col("alike") >= least))
        place = F.row_number().over(Window.partitionBy(*of).orderBy(F.desc("alike"), "a", "b"))
        return both.withColumn("place", place).where(F.col("place") <= LIKELIEST).select("a", "b").distinct()

    def confirmed(pairs: DataFrame, label: str) -> DataFrame:
        """Of pairs ``a, b``: those whose full sets pass the threshold."""
        ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id"))
        sets = scratch.keep(shingle_sets(texts_of(ids, 2 * pairs.count()), words), f"{label}-sets")
        both = pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
        # 100 * i >= percent * (a + b - i), with i once.
        similar = F.size(F.array_intersect("sa", "sb")) * (100 + percent) >= (F.size("sa") + F.size("sb")) * percent
        links = scratch.keep(both.where(similar).select("a", "b"), f"{label}-links")
        scratch.drop(sets)
        return links

    def all_of(parts: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, parts)

    stars = members.where("id > head").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct()
    compared = scratch.keep(likeliest(stars, "b"), "star-pairs")
    links = [confirmed(compared, "star"), scratch.keep(own, "own-links")]
    labels = connected_components(all_of(links), scratch)
    tried = [compared]

    # What is left: members of one bucket outside the bucket's largest component.
    total, before, turn = members.count(), None, 0
    while True:
        placed = members.join(labels, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
        parts = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("size"))
        main = parts.groupBy("key").agg(F.max_by("component", F.struct("size", "component")).alias("main"), F.sum("size").alias("size"), F.max("size").alias("inside"), F.count(F.lit(1)).alias("parts"))
        main = scratch.keep(main.where("parts > 1"), "main")
        open_members = scratch.keep(placed.join(main.select("key", "main", F.ceil(F.col("size") / BUCKET_PART).cast("int").alias("parts")), "key"), "open-members")
        cost, outside, largest = main.agg(F.sum(F.col("size") * (F.col("size") - F.col("inside"))), F.sum(F.col("size") - F.col("inside")), F.max("size")).first()
        # A bucket that has become one component stays one.
        scratch.drop(main, members)
        members = open_members.select("key", "id")
        members.scratch_location = open_members.scratch_location
        # All pairs at once if they are few beside the members, or if hubs no longer help.
        if not cost or cost <= PAIRS_A_MEMBER * total or before is not None and outside > 0.9 * before:
            break
        before, turn = outside, turn + 1
        # Those outside meet some members of the main component, others in each turn.
        spread = F.xxhash64("id", F.lit(turn))
        inside = open_members.where("component = main").withColumn("slot", F.pmod(spread, F.lit(HUBS)))
        hubs = inside.groupBy("key", "slot").agg(F.min_by("id", spread).alias("hub"))
        pairs = open_members.where("component <> main").select("key", "id", "main").join(hubs.select("key", "hub"), "key")
        pairs = pairs.select("id", "main", F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()
        compared = scratch.keep(likeliest(pairs.join(all_of(tried), ["a", "b"], "left_anti"), "id", "main"), "hub-pairs")
        tried.append(compared)
        links.append(confirmed(compared, "hub"))
        scratch.drop(labels)
        labels = connected_components(all_of(links), scratch)

    if cost:
        rest = _rest(open_members, reps, texts_of, tried, scratch, hasher, words, threshold, least, cost <= LOOKS_A_MEMBER * total and largest <= LARGEST_BUCKET)
        if not rest.isEmpty():
            links.append(confirmed(rest, "rest"))
            scratch.drop(labels)
            labels = connected_components(all_of(links), scratch)
        scratch.drop(rest)
    scratch.drop(open_members, reps, *tried, *links)

    # Every row takes its class's component.
    of_class = classes.join(labels.withColumnRenamed("id", "rep"), "rep", "left")
    of_class = of_class.select("set1", "set2", "n", F.coalesce("component", "rep").alias("component"))
    rows = of_rows.join(of_class, ["set1", "set2", "n"], "left")
    component = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    out = rows.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _rest(open_members: DataFrame, reps: DataFrame, texts_of, tried: list[DataFrame], scratch: Scratch, hasher: MinHasher, words: int, threshold: float, least: float, few: bool) -> DataFrame:
    """Pairs ``a, b`` of ``open_members`` in different components that longer signatures do not rule out.

    With ``few`` all pairs of a bucket meet, each in the first band that it shares: a bucket is dealt
    to parts on both sides, and each part of one side meets each of the other in a task of its own.
    Else those meet that share a longer band, wherever they are.  An id of several texts has no one signature, so its
    pairs are not ruled out here.
    """
    percent = round(threshold * 100)
    ids = open_members.select(F.col("id").alias("doc_id")).distinct()
    signed = fine_signatures(texts_of(ids, open_members.count()).join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]), words)
    fine = scratch.keep(signed if not few else signed.drop("fine_keys"), "fine")
    one = fine.groupBy("doc_id").agg(F.when(F.count(F.lit(1)) == 1, F.max("fine")).alias("fine"))
    sketch = reps.join(one, F.col("id") == F.col("doc_id")).select("id", "n", "planes", "fine", *(["keys"] if few else []))

    def named(rows: DataFrame, end: str, *also: str) -> DataFrame:
        return rows.select(*also, *[F.col(c).alias(c + end) for c in rows.columns if c not in ("key", "main", "parts", *also)])

    fits = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent
    alike = (estimated_similarity("planesa", "planesb", hasher.k, hasher.bits) >= least) & F.coalesce(
        estimated_similarity("finea", "fineb", FINE, FINE_BITS) >= threshold - _margin(threshold, FINE, FINE_BITS, 5), F.lit(True)
    )
    if few:
        side = open_members.join(sketch, "id")
        part, every = F.pmod(F.xxhash64("id", F.lit("part")), F.col("parts")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
        small = named(side.where("component <> main").withColumn("i", part).withColumn("j", every), "a", "key", "i", "j", "main")
        other = named(side.withColumn("j", part).withColumn("i", every), "b", "key", "i", "j")
        apart = (F.col("componenta") != F.col("componentb")) & ((F.col("componentb") == F.col("main")) | (F.col("ida") < F.col("idb")))
        first_shared = F.expr("array_position(zip_with(keysa, keysb, (x, y) -> x = y), true) = array_position(keysa, key)")
        pairs = small.join(other, ["key", "i", "j"]).where(apart & fits & alike & first_shared).select(F.least("ida", "idb").alias("a"), F.greatest("ida", "idb").alias("b"))
    else:
        member = open_members.groupBy("id", "component").agg(F.bool_or(F.col("component") != F.col("main")).alias("outside"))
        side = fine.withColumnRenamed("doc_id", "id").join(member, "id")
        banded = scratch.keep(side.select("id", "component", "outside", F.explode("fine_keys").alias("band")), "fine-bands")
        met = named(banded.where("outside"), "a", "band").join(named(banded, "b", "band"), "band")
        met = met.where((F.col("componenta") != F.col("componentb")) & (~F.col("outsideb") | (F.col("ida") < F.col("idb"))))
        met = met.select(F.col("ida"), F.col("idb")).distinct()
        card = sketch.select("id", "n", "planes", "fine")
        both = met.join(named(card, "a"), "ida").join(named(card, "b"), "idb")
        pairs = both.where(fits & alike).select(F.least("ida", "idb").alias("a"), F.greatest("ida", "idb").alias("b"))
    out = scratch.keep(pairs.distinct().join(reduce(DataFrame.unionByName, tried), ["a", "b"], "left_anti"), "rest-pairs")
    scratch.drop(fine, *([] if few else [banded]))
    return out
