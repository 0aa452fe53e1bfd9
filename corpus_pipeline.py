"""The corpus pipeline: stages over ``documents``, each on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronocell.llm import langid, quality
from chronocell.llm.minhash import near_duplicates
from chronocell.llm.mixture import mixed_rows
from chronocell.llm.winnow import contamination
from chronocell.sources.scratch import Scratch
from chronocell.sources.tables import table

#: Least pooled probability of the best language, and least quality score, of documents that stay.
LEAST_LANGUAGE = 0.4
LEAST_QUALITY = 0.5


def _plain(docs: DataFrame) -> tuple[DataFrame, list[str], str]:
    """``docs`` under names that no helper uses, ``c0, c1...``; those names; and that of the text."""
    names = [f"c{k}" for k in range(len(docs.columns))]
    return docs.toDF(*names), names, names[docs.columns.index("text")]


def _judged(docs: DataFrame, judge) -> DataFrame:
    """The rows of ``docs`` for which ``judge(rows, columns, text_column)``, which adds to them, says ``stays``."""
    held, names, text = _plain(docs)
    return judge(held, names, text).where("stays").select(*names).toDF(*docs.columns)


def _without_ids(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id is not in the only column of ``gone``; null is an id."""
    held, names, _ = _plain(docs)
    key = names[docs.columns.index("doc_id")]
    return held.join(gone.toDF("gone"), F.col(key).eqNullSafe(F.col("gone")), "left_anti").toDF(*docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that is known: not ``und``, nor as good as evenly split.

    Texts that are null, empty or without a letter go, as do all where no document has a language
    to learn from.  Equal texts go or stay together whatever their ids; repeated rows stay as often
    as they are; very long texts are judged whole; a probability of just ``LEAST_LANGUAGE`` stays.
    Columns are those of ``docs``, by any names; an empty table stays empty.
    """
    net = langid.fit(docs.select("doc_id", "text", "lang"))
    stays = (F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_LANGUAGE)
    return _judged(docs, lambda rows, columns, text: langid.predict(rows, net, columns, text).withColumn("stays", stays))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label scorer calls good, a score of just ``LEAST_QUALITY`` included.

    Null and empty texts and those without words go.  Equal texts go or stay together; repeated
    rows stay as often as they are; very long texts are scored whole.  Columns are those of
    ``docs``, by any names; an empty table stays empty.
    """
    fitted = quality.fit(docs.select("doc_id", "text"))
    stays = F.col("score") >= LEAST_QUALITY
    return _judged(docs, lambda rows, columns, text: quality.score(rows, fitted, columns, text).withColumn("stays", stays))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that with the smallest id.

    Rows of that id all stay; rows of a null id, null and empty texts and those without words are
    in no group and stay.  Very long texts are compared whole.  Columns are those of ``docs``, by
    any names; an empty table stays empty.
    """
    return _without_ids(docs, near_duplicates(docs.select("doc_id", "text")).where("not kept").select("doc_id").distinct())


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item.

    Rows of equal ids, null ids included, go or stay together.  Null and empty texts hold nothing and
    stay; very long ones are searched whole.  Columns are those of ``docs``, by any names; an empty
    table stays empty, and an empty benchmark takes nothing.
    """
    found = contamination(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return _without_ids(docs, found.where("n_hit > 0").select("doc_id").distinct())


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes and how many ``copies`` of each.

    A null source is a source; null and empty texts have size 0 and go with their hash as any
    others; rows of one id are taken alike.  Beside the columns of ``docs`` there is the count,
    under ``copies_1`` where ``copies`` is taken; an empty table gives none.
    """
    return mixed_rows(docs)


STAGES = [
    ("language_id", language_id),
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("source_mixture", source_mixture),
]

#: Models and near-duplicate groups are beyond SQL; ``tests/llm/test_pipeline.py`` holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written to shared scratch and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return docs
