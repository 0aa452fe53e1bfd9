"""Mixing sources to target weights with hash-threshold histograms.

Every document has a place in [0, 2**48) given by a hash of its id.  A source
takes whole rounds of all its documents and, for the rest of its budget, the
documents whose place is below a threshold.  The threshold comes from nested
histograms: token sums by (source, leading hash bits), a running sum over those
bounded buckets, then the same again inside the one bucket where the budget is
crossed.  Nothing is sorted and no document leaves its partition.

A larger budget has a higher threshold, so mixes of growing budgets are nested.  Words of
whole texts are counted, however long; documents at one place are taken or left together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronocell.llm.samples import free_name
from chronocell.sources.scratch import Scratch

WORD = r"[^\x20\x09-\x0D]+"
#: Hash bits that each level of the histograms resolves; three levels are 2**36 places.
LEVEL_BITS = (12, 12, 12)


def word_count(text: Column) -> Column:
    """Words between ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def place(key: Column) -> Column:
    """48 hash bits of the key's text as a long; null keys share one place."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long")


def _place(key: Column) -> Column:
    """The 36 leading bits of ``place``."""
    return F.shiftright(place(key), 12)


def _named(source: str) -> Column:
    """The source as a join key that no null has: ``1`` and the name, or ``0``."""
    return F.when(F.col(source).isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col(source)))


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """One row a source: ``source, source_size, target``.

    Sources in code-point order, null last, carry ``weights`` in turn.  They share
    ``share`` times the sum of all sizes by weight; no source gets more than ``most``
    times its own size, and what it leaves is shared again by weight.  That process
    ends where each target is ``min(cap, level * weight)``, so the level is found
    directly from running sums over the sources ordered by cap / weight.  That order is over a
    short row a source in one task, which spills: good for sources by the million, not for one
    a document.
    """
    own = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = Window.orderBy(F.col("source").isNull(), F.col("source"))
    slot = (F.row_number().over(rank) - 1) % len(weights)
    own = own.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (slot + 1).cast("int")))
    own = own.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy(F.lit(1))
    level = (F.sum("source_size").over(whole) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    own = own.withColumn("level", level).withColumn("fits", F.col("level") * F.col("weight") <= F.col("cap"))
    chosen = F.min(F.when(F.col("fits"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(whole)["level"]
    target = F.least(F.col("cap"), F.coalesce(chosen * F.col("weight"), F.col("cap")))
    return own.select("source", "source_size", target.alias("target"))


def _thresholds(places: DataFrame, budgets: DataFrame) -> DataFrame:
    """``source, threshold``: documents whose 36 leading bits are below it sum to nearest the budget.

    ``budgets``: ``source, budget`` with the budget below the source's size.  The first
    histogram covers all documents.  Each later one covers only the documents of each
    source's boundary bucket, found by a join on (source, bucket), which spreads a source
    that holds most rows over all its buckets.
    """
    named = places.withColumn("s", _named("source"))
    total = sum(LEVEL_BITS)
    shift = total - LEVEL_BITS[0]
    edge = budgets.select(_named("source").alias("s"), F.lit(0).cast("long").alias("prefix"), F.col("budget").cast("double").alias("rest"))
    inside = named
    for level, bits in enumerate(LEVEL_BITS):
        if level:
            inside = named.withColumn("prefix", F.shiftright("h", shift)).join(edge.select("s", "prefix"), ["s", "prefix"], "left_semi")
            shift -= bits
        histogram = inside.groupBy("s", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("in_bucket"))
        running = Window.partitionBy("s").orderBy("bucket")
        upto = histogram.withColumn("upto", F.sum("in_bucket").over(running)).join(edge.select("s", "rest"), "s")
        edge = (
            upto.where("upto > rest")
            .groupBy("s")
            .agg(F.min(F.struct("bucket", "in_bucket", "upto", "rest")).alias("e"))
            .select("s", F.col("e.bucket").alias("prefix"), (F.col("e.rest") - F.col("e.upto") + F.col("e.in_bucket")).alias("rest"), F.col("e.in_bucket").alias("width"))
        )
    # The last bucket is one place: it goes in if that comes nearer the budget.
    return edge.select("s", (F.col("prefix") + F.when(F.col("rest") * 2 >= F.col("width"), 1).otherwise(0)).alias("threshold"))


def mix_plan(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """The documents' ``doc_id, source, size, h`` and a row a source: ``s, source_size, target, rounds, threshold``."""
    scratch = Scratch(docs.sparkSession, "mix")
    sizes = scratch.keep(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).cast("string").alias("source"),
            word_count(F.col(text_col)).alias("size"),
            _place(F.col(id_col)).alias("h"),
        ),
        "sizes",
    )
    targets = scratch.keep(source_targets(sizes, weights, share, most), "targets")
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    budgets = targets.withColumn("rounds", rounds).withColumn("budget", F.col("target") - F.col("rounds") * F.col("source_size"))
    thresholds = scratch.keep(_thresholds(sizes.select("source", "size", "h"), budgets.where("budget > 0").select("source", "budget")), "thresholds")
    plan = budgets.withColumn("s", _named("source")).join(thresholds, "s", "left").withColumn("threshold", F.coalesce("threshold", F.lit(0)))
    # A row a source: Spark broadcasts it by its file size, else splits the hot sources of the join.
    return sizes, scratch.keep(plan.select("s", "source_size", "target", "rounds", "threshold"), "plan")


def _copies() -> Column:
    return F.col("rounds") + F.when(F.col("h") < F.col("threshold"), 1).otherwise(0)


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken`` for every row of ``docs``.

    ``copies`` says how often the mix repeats the document, ``taken = copies * size``.
    Options are those of ``mix_plan``.

    Null text has size 0; a null source is a source of its own; rows of equal id have
    equal places and so equal ``copies``; an empty table gives an empty result; other
    columns are ignored.  Sources whose sizes sum to 0 have target 0 and take nothing.
    """
    sizes, plan = mix_plan(docs, **options)
    out = sizes.withColumn("s", _named("source")).join(plan, "s")
    out = out.select("doc_id", "source", "size", "source_size", "target", _copies().alias("copies"))
    return out.withColumn("taken", F.col("copies") * F.col("size"))


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", **options) -> DataFrame:
    """The rows of ``docs`` that the mix takes, with ``copies``, how often it repeats each.

    Where ``docs`` has a column of that name, in any case, the count is ``copies_1`` and so on.
    See ``mix_sources`` for the cases.
    """
    plan = mix_plan(docs, id_col=id_col, source_col=source_col, **options)[1]
    held = [f"c{k}" for k in range(len(docs.columns))]
    rows = docs.toDF(*held).withColumn("source", F.col(held[docs.columns.index(source_col)]).cast("string"))
    rows = rows.withColumn("s", _named("source")).withColumn("h", _place(F.col(held[docs.columns.index(id_col)])))
    taken = rows.join(plan, "s").withColumn("copies", _copies()).where("copies > 0")
    return taken.select(*held, "copies").toDF(*docs.columns, free_name("copies", docs.columns))
