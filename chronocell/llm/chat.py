"""Reply trees as chat-formatted conversations.

A message names its parent.  Paths from root to leaf are enumerated by self-joins that
double their reach: round k joins every message's ancestor at distance 2**k to that
ancestor's own, so a tree of depth d takes log2(d) rounds over narrow rows, each over those
messages alone that are deeper than the last reached.  Leaves are
ranked by the summed score of their path, the chosen ones are expanded to their messages
by the same tables from the longest jump to the shortest, and each path becomes one text.

Format of a conversation: for each message ``<|role|>``, newline, text, ``</s>``, newline.
In roles and texts a backslash follows each of ``< [ | \\``, so no control string occurs
in them, and dropping those backslashes gives the text back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronocell.operators.scan import Scan
from chronocell.sources.scratch import Scratch

OPEN, CLOSE, END = "<|", "|>\n", "</s>\n"
SPECIAL = r"([<\[|\\])"
_ESCAPED = re.compile(r"([<\[|\\])\\")


def escape(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPECIAL, r"$1\\")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def reply_paths(messages: DataFrame, scratch: Scratch, top: int | None = None) -> DataFrame:
    """``conv_id, branch, msg_id, position`` of the best ``top`` root-to-leaf paths of each conversation.

    ``messages``: ``conv_id, msg_id, parent_id, score`` with ``msg_id`` unique in the table and
    not null.  A parent that is null or missing makes a root; null scores count 0.  ``branch``
    is the rank by summed score, ties by leaf id; ``position`` counts from 1 at the root.
    Messages on or below a cycle have no root and are on no path.
    """
    node = messages.select("conv_id", "msg_id", "parent_id", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    known = node.select(F.col("msg_id").alias("parent_id"), F.lit(True).alias("known"))
    node = node.join(known, "parent_id", "left").withColumn("parent_id", F.when(F.col("known"), F.col("parent_id"))).drop("known")
    node = scratch.keep(node, "nodes")  # narrow: no roles or texts

    # active: messages whose ancestor 2**k up exists, with that and the score on the way to it;
    # rooted: the others, with their distance from above the root and the score on all of it.
    active = node.select("msg_id", F.col("parent_id").alias("up"), F.lit(1).cast("long").alias("steps"), F.col("score").alias("sum"))
    rooted = [scratch.keep(active.where("up is null").drop("up"), "rooted")]
    active = scratch.keep(active.where("up is not null"), "active")
    jumps, most = [], node.count().bit_length() + 1
    # Messages on a cycle stay active for ever.
    while not active.isEmpty() and len(jumps) <= most:
        jumps.append(active)
        ended = [r.select("msg_id", F.lit(None).cast(active.schema["up"].dataType).alias("up"), "steps", "sum") for r in rooted]
        far = reduce(DataFrame.unionByName, ended, active).toDF("up", "up2", "steps2", "sum2")
        moved = active.join(far, "up").select("msg_id", F.col("up2").alias("up"), (F.col("steps") + F.col("steps2")).alias("steps"), (F.col("sum") + F.col("sum2")).alias("sum"))
        moved = scratch.keep(moved, "moved")
        rooted.append(moved.where("up is null").drop("up"))
        active = moved.where("up is not null")
    rooted = reduce(DataFrame.unionByName, rooted)
    parents = node.where("parent_id is not null").select(F.col("parent_id").alias("msg_id")).distinct()
    leaves = node.select("conv_id", "msg_id").join(rooted, "msg_id").join(parents, "msg_id", "left_anti")
    leaves = Scan(leaves, ["conv_id"], [F.col("sum").desc(), F.col("msg_id")]).add(sums={"branch": F.lit(1)}).rows().withColumn("branch", F.col("branch").cast("int"))
    if top is not None:
        leaves = leaves.where(F.col("branch") <= top)
    parts = [scratch.keep(leaves.select("conv_id", "branch", "msg_id", F.col("steps").alias("position")), "path")]
    while jumps:
        # What is on a path so far stays where it is; only the messages that a jump adds are written.
        step = jumps.pop().select("msg_id", "up")
        higher = reduce(DataFrame.unionByName, parts).join(step, "msg_id")
        higher = higher.select("conv_id", "branch", F.col("up").alias("msg_id"), (F.col("position") - 2 ** len(jumps)).alias("position"))
        parts.append(scratch.keep(higher, "path"))
    scratch.clear(*parts)
    return reduce(DataFrame.unionByName, parts)


def format_paths(paths: DataFrame, texts: DataFrame) -> DataFrame:
    """``conv_id, branch, n_turns, formatted, loss_spans``, one row a path.

    ``texts``: ``msg_id, role, text``; null role or text is the empty string.  ``loss_spans``
    are ``(start, length)`` of the assistant texts as escaped, in code points from 0.
    """
    parts = paths.join(texts, "msg_id").select(
        "conv_id",
        "branch",
        "position",
        F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(CLOSE)).alias("head"),
        escape(F.col("text")).alias("body"),
        F.coalesce(F.col("role") == "assistant", F.lit(False)).alias("loss"),
    )
    piece = F.struct("position", F.concat("head", "body", F.lit(END)).alias("piece"), F.length("head").alias("head"), F.length("body").alias("body"), "loss")
    whole = parts.groupBy("conv_id", "branch").agg(F.array_sort(F.collect_list(piece)).alias("parts"))
    empty = F.expr("named_struct('upto', 0L, 'spans', cast(array() as array<struct<start:bigint,length:bigint>>))")

    def step(acc, p):
        start = acc["upto"] + p["head"]
        span = F.array(F.struct(start.cast("long").alias("start"), p["body"].cast("long").alias("length")))
        return F.struct((start + p["body"] + len(END)).alias("upto"), F.when(p["loss"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return whole.select(
        "conv_id",
        "branch",
        F.size("parts").cast("long").alias("n_turns"),
        F.array_join(F.col("parts.piece"), "").alias("formatted"),
        F.aggregate("parts", empty, step, lambda acc: acc["spans"]).alias("loss_spans"),
    )


def format_replies(messages: DataFrame, top: int | None = 1) -> DataFrame:
    """Each conversation's best ``top`` paths (all for ``None``) as formatted texts.

    ``messages``: ``conv_id, msg_id, parent_id, role, text, score``; other columns are
    ignored and an empty table gives an empty result.  See ``reply_paths`` and ``format_paths``
    for nulls.  A path is one row and so fits one task; trees of any size do not have to.
    """
    scratch = Scratch(messages.sparkSession, "chat")
    return format_paths(reply_paths(messages, scratch, top), messages.select("msg_id", "role", "text"))


def turns_as_messages(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """Linear conversations ``conv_id, turn, role, text`` as messages, each the reply to the one before.

    Rows of equal turn follow by role and text, nulls first; null conversations are one.  A message's
    id is a number of the conversation's own and the place.  A conversation of very many rows is
    numbered in stretches; its formatted text is one row in the end.
    """
    rows = turns.select("conv_id", "turn", "role", "text")
    rows = Scan(rows, ["conv_id"], [F.col("turn"), F.col("role"), F.col("text")]).add(sums={"place": F.lit(1)}).rows().withColumn("place", F.col("place").cast("long"))
    # Exact decimals: conversations are 2**31 apart, null is past the largest.
    wide = F.coalesce(F.col("conv_id").cast("decimal(19,0)"), F.lit("9223372036854775808").cast("decimal(19,0)"))
    of = (wide * F.lit(1 << 31).cast("decimal(10,0)")).cast("decimal(38,0)")
    rows = rows.select(
        "conv_id",
        (of + F.col("place")).cast("decimal(38,0)").alias("msg_id"),
        F.when(F.col("place") > 1, (of + F.col("place") - 1).cast("decimal(38,0)")).alias("parent_id"),
        "role",
        "text",
        F.lit(0.0).alias("score"),
    )
    return scratch.keep(rows, "messages")


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The roles and texts of a formatted conversation."""
    turns = []
    for part in formatted.split(END)[:-1]:
        role, _, text = part.removeprefix(OPEN).partition(CLOSE)
        turns.append((unescape(role), unescape(text)))
    return turns


def digests(formatted: DataFrame) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``, read back from the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for text, spans in zip(batch.column("formatted").to_pylist(), batch.column("loss_spans").to_pylist(), strict=True):
                turns = read_turns(text)
                said = "".join(f"{role}\n{words}\n" for role, words in turns)
                loss = "".join(unescape(text[s["start"] : s["start"] + s["length"]]) for s in spans)
                out.append((len(turns), *(hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in (said, loss)), len(loss), len(text)))
            n, a, b, chars, size = zip(*out, strict=True) if out else ((),) * 5
            columns = [batch.column("conv_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(chars, pa.int64()), pa.array(b, pa.string()), pa.array(size, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(run, schema)
