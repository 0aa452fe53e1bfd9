"""Conversations brought into an order that a chat template takes, by their cheapest edits.

Roles must read, by their initials, ``(s?(ua)+)?``.  A row is kept (0), given the role user or
assistant (2) or deleted (3, a must for blank and duplicate rows), and an empty turn of either may
be inserted anywhere (2); a truncated row that stays costs 1 more.  Backward dynamic programming
over (row, state of the grammar) gives the cost to go; a forward walk then takes, among the edits
that are on a cheapest way, the one whose letter is least: D, I, K, R.

The state has four values, so what a run of rows does to the cost to go is a 4 by 4 matrix over
(min, +), and what the walk does to the state a map of four.  A conversation is cut into chunks;
their matrices, one small row each, are multiplied from the end, which gives the cost to go at the
end of each chunk; then all chunks are walked on their own, from the states they can be entered in,
and their maps are chained from the beginning.  Only the text, which a digest reads in order, goes
through one task a conversation, a chunk at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronocell.llm import ordered
from chronocell.sources.scratch import Scratch

#: Costs of edits.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: States: at the start, after a system, a user, an assistant turn.  Where each initial leads, and what an inserted or renamed turn is.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
FORCED = (2, 2, 3, 2)
NAMES = {2: "user", 3: "assistant"}
FAR = 1 << 40
#: Pairs of initials that may follow each other (fixed value).
LEGAL = {"su", "ua", "au"}
SPACE = " \t\n\x0b\x0c\r"

Costs = list[int]


def _closed(c: Costs) -> Costs:
    """Costs to go once turns may be inserted first."""
    user, assistant = min(c[2], INSERT + c[3]), min(c[3], INSERT + c[2])
    return [min(c[0], INSERT + user), min(c[1], INSERT + user), user, assistant]


#: Costs to go behind the last row.
END = _closed([0, FAR, FAR, 0])


def _before(mark: str, c: Costs) -> Costs:
    """Costs to go before a row, from those behind it; ``mark`` is its role's initial and its fault."""
    initial, fault = mark
    out = [DELETE + x for x in c]
    if fault not in "bd":
        stay = TRUNCATED if fault == "t" else 0
        for q in range(4):
            out[q] = min(out[q], REROLE + stay + c[FORCED[q]])
            if initial in NEXT[q]:
                out[q] = min(out[q], stay + c[NEXT[q][initial]])
    return _closed(out)


def _marks(text: str) -> list[str]:
    """The marks of a chunk, two letters each; rows that are gone (``x``) have none."""
    return [m for m in map("".join, zip(text[::2], text[1::2])) if m[1] != "x"]


def matrix(marks: list[str]) -> Costs:
    """Least costs through the rows by state before and state behind, row by row: 16 numbers."""
    columns = []
    for leave in range(4):
        c = [0 if q == leave else FAR for q in range(4)]
        for mark in reversed(marks):
            c = _before(mark, c)
        columns.append(c)
    return [min(FAR, columns[leave][q]) for q in range(4) for leave in range(4)]


def times(m: Costs, c: Costs) -> Costs:
    return [min(m[q * 4 + leave] + c[leave] for leave in range(4)) for q in range(4)]


def walk(marks: list[str], end: Costs, state: int, last: bool) -> tuple[int, str]:
    """The state behind the rows and the letters of the edits, entering in ``state``; ``last`` ends the conversation."""
    costs = [end]
    for mark in reversed(marks):
        costs.append(_before(mark, costs[-1]))
    costs.reverse()
    letters, i = [], 0
    while i < len(marks) or (last and costs[i][state]):
        togo, rows_left = costs[i][state], i < len(marks)
        if rows_left and togo == DELETE + costs[i + 1][state]:
            letters.append("D")
            i += 1
        elif togo == INSERT + costs[i][FORCED[state]]:
            letters.append("I")
            state = FORCED[state]
        else:
            initial, fault = marks[i]
            stay = TRUNCATED if fault == "t" else 0
            kept = NEXT[state].get(initial) if fault not in "bd" else None
            if kept is not None and togo == stay + costs[i + 1][kept]:
                letters.append("K")
                state = kept
            else:
                letters.append("R")
                state = FORCED[state]
            i += 1
    return state, "".join(letters)


def rebuilt(audit: str, state: int, rows: list[tuple[str, str]]) -> tuple[list[str], list[str]]:
    """Roles and texts after the edits of ``audit`` on ``rows``."""
    roles, texts, left = [], [], iter(rows)
    for letter in audit:
        if letter == "I":
            state = FORCED[state]
            roles.append(NAMES[state])
            texts.append("")
            continue
        role, text = next(left)
        if letter == "D":
            continue
        if letter == "K":
            state = NEXT[state][role[:1]]
        else:
            state = FORCED[state]
            role = NAMES[state]
        roles.append(role)
        texts.append(text)
    return roles, texts


def damaged(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, copies`` of turns damaged by the hash of their place; nulls are one space there.

    Of 20 hashes 0 drops a turn (``copies`` 0), 1 empties its text, 2 takes out its ``.!?``, 3 repeats it, 4 makes its role user.
    """
    space = F.lit(" ")
    place = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind = F.crc32(place.cast("binary")) % 20
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    return turns.select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def _fault(text: Column) -> Column:
    """``b`` for a blank text, ``t`` for one that ends in the middle of a sentence, else a dot."""
    seen = F.rtrim(text, F.lit(SPACE))
    return F.when(seen == "", "b").when(F.right(seen, F.lit(1)).isin(".", "!", "?"), ".").otherwise("t")


def _chunks(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """``conv_id, chunk, turns, roles, texts, marks, said``: the rows in order, at most ``ordered.CHUNK`` in one.

    ``marks`` does not know duplicates yet; ``said`` has a digest of role and text, null for rows that are gone.
    """
    said = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256))
    initial = F.when(F.left("role", F.lit(1)).isin("s", "u", "a"), F.left("role", F.lit(1))).otherwise("o")
    rows = rows.withColumn("tie", F.monotonically_increasing_id())
    rows = rows.select(
        "conv_id",
        "turn",
        "role",
        "text",
        F.concat(initial, F.when(F.col("copies") == 0, "x").otherwise(_fault(F.col("text")))).alias("mark"),
        F.when(F.col("copies") > 0, said).alias("said"),
        "tie",
        F.explode(F.sequence(F.lit(1), F.greatest("copies", F.lit(1)))).alias("copy"),
    )
    # Of one turn: by role and the text's beginning, then by digest; the tie parts rows that are all the same.
    rows = ordered.placed(rows, "conv_id", "turn", ordered.beginning(F.col("role")), ordered.beginning(F.col("text")), "said", "tie", "copy")
    items = F.array_sort(F.collect_list(F.struct("place", "turn", "role", "text", "mark", "said"))).alias("items")
    packed = rows.withColumn("chunk", ordered.chunk()).groupBy("conv_id", "chunk").agg(items)
    # A chunk's first place names it: chunks of two conversations may share a stretch of places.
    return scratch.keep(
        packed.select("conv_id", F.col("items")[0]["place"].alias("chunk"), F.col("items.turn").alias("turns"), F.col("items.role").alias("roles"), F.col("items.text").alias("texts"), F.array_join("items.mark", "").alias("marks"), F.col("items.said").alias("said")),
        "chunks",
    )


def _with_duplicates(chunks: DataFrame) -> DataFrame:
    """``conv_id, chunk, marks, matrix``: ``d`` marks rows whose role and text were seen before, blank rows aside."""
    each = chunks.select("conv_id", "chunk", F.posexplode("said").alias("at", "said")).where("said is not null")
    firsts = each.groupBy("conv_id", "said").agg(F.min(F.struct("chunk", "at")).alias("first")).select("first.*")
    firsts = firsts.groupBy("chunk").agg(F.collect_list("at").alias("firsts"))

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for conv, place, marks, first in rows:
            own = set(first or ())
            marks = "".join(m if i in own or m[1] in "bx" else m[0] + "d" for i, m in enumerate(map("".join, zip(marks[::2], marks[1::2]))))
            yield conv, place, marks, matrix(_marks(marks))

    kind = dict(chunks.dtypes)["conv_id"]
    joined = chunks.select("conv_id", "chunk", "marks").join(firsts, "chunk", "left").select("conv_id", "chunk", "marks", "firsts")
    return ordered.per_row(joined, run, f"conv_id {kind}, chunk long, marks string, matrix array<long>")


def _ends(steps: DataFrame) -> DataFrame:
    """``chunk, end, begins, ends``: the costs to go behind each chunk, and whether it is its conversation's first or last."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        held = None  # a chunk that may be the first, that is, the last to come
        c, conv = END, None
        for own, place, m in rows:
            if held is not None:
                yield (*held[:2], own != conv, held[2])
            if held is None or own != conv:
                c, conv, last = END, own, True
            else:
                last = False
            held = (place, c, last)
            c = times(m, c)
        if held is not None:
            yield (*held[:2], True, held[2])

    back = steps.select("conv_id", (-F.col("chunk")).alias("back"), "matrix")
    found = ordered.streamed(back, ["conv_id"], ["back"], run, "chunk long, end array<long>, begins boolean, ends boolean")
    return found.withColumn("chunk", -F.col("chunk"))


def _walks(steps: DataFrame, ends: DataFrame) -> DataFrame:
    """``conv_id, chunk, marks, begins, cost, exits, audits``: for each state that a chunk can be entered in."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for conv, place, marks, end, begins, last in rows:
            own = _marks(marks)
            ways = [walk(own, end, state, last) for state in range(1 if begins else 4)]
            cost = end
            for mark in reversed(own if begins else ()):
                cost = _before(mark, cost)
            yield conv, place, marks, begins, cost[0], [w[0] for w in ways], [w[1] for w in ways]

    kind = dict(steps.dtypes)["conv_id"]
    both = steps.select("conv_id", "chunk", "marks").join(ends, "chunk").select("conv_id", "chunk", "marks", "end", "begins", "ends")
    return ordered.per_row(both, run, f"conv_id {kind}, chunk long, marks string, begins boolean, cost long, exits array<long>, audits array<string>")


#: Columns that ``_forward`` makes of a chunk, after its conversation.
PARTS = "chunk long, begins boolean, cost long, turns array<long>, marks string, audit string, roles array<string>, texts array<string>"


def _forward(rows: DataFrame) -> DataFrame:
    """Repaired chunks of damaged ``rows``, whole conversations a partition and in order within it."""
    scratch = Scratch(rows.sparkSession, "repair")
    chunks = _chunks(rows, scratch)
    steps = scratch.keep(_with_duplicates(chunks), "steps")
    walks = _walks(steps, _ends(steps))
    said = chunks.select("conv_id", "chunk", F.lit(1).alias("kind"), F.col("turns").cast("array<long>").alias("turns"), "roles", "texts")
    both = walks.withColumn("kind", F.lit(0)).unionByName(said, allowMissingColumns=True)
    both = both.select("conv_id", "chunk", "kind", "marks", "begins", "cost", "exits", "audits", "turns", "roles", "texts")

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        state, way = 0, None
        for conv, place, kind, marks, begins, cost, exits, audits, turns, roles, texts in rows:
            if kind == 0:  # the chunk's walk comes just before its text
                way = marks, begins, cost, exits, audits
                continue
            marks, begins, cost, exits, audits = way
            state = 0 if begins else state
            here = [m != "x" for m in marks[1::2]]
            audit = audits[state]
            new_roles, new_texts = rebuilt(audit, state, [(r, t) for r, t, ok in zip(roles, texts, here) if ok])
            yield conv, place, begins, cost, [t for t, ok in zip(turns, here) if ok], "".join(_marks(marks)), audit, new_roles, new_texts
            state = exits[state]

    kind = dict(chunks.dtypes)["conv_id"]
    return ordered.streamed(both, ["conv_id"], ["chunk", "kind"], run, f"conv_id {kind}, {PARTS}")


def repaired_turns(rows: DataFrame) -> DataFrame:
    """``conv_id, chunk, place, role, text`` of ``rows`` (``conv_id, turn, role, text, copies``) as repaired, in order of chunk and place.

    ``copies`` tells how often a row is there, 0 for a row that is gone; roles and texts are not null.
    """
    parts = _forward(rows)
    each = F.posexplode(F.arrays_zip("roles", "texts")).alias("place", "t")
    return parts.select("conv_id", "chunk", each).select("conv_id", "chunk", "place", F.col("t.roles").alias("role"), F.col("t.texts").alias("text"))


def repair_reports(rows: DataFrame) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` of every conversation of ``rows``.

    ``rows`` are as in ``repaired_turns``.  A row's first fault counts.  Turns are in order, null
    first, then by role and text; a null ``conv_id`` is a conversation; one whose rows are all gone,
    or that are none at all, has zeros and empty texts.  Very long texts and conversations go by
    chunks; other columns are ignored; an empty table gives an empty result.
    """

    def run(parts: Iterator[tuple]) -> Iterator[tuple]:
        conv = digest = None

        def report() -> tuple:
            gaps = 0 if low is None else high - low + 1 - distinct
            return conv, gaps, faults["b"], faults["d"], faults["t"], illegal, total, "".join(audits), digest.hexdigest()

        for own, _, begins, cost, turns, marks, audit, roles, texts in parts:
            if begins:
                if digest is not None:
                    yield report()
                conv, digest, total, said, audits = own, hashlib.sha256(), cost, False, []
                low = high = turn = before = None
                distinct = illegal = 0
                faults = dict.fromkeys("bdt", 0)
            for fault in faults:
                faults[fault] += marks[1::2].count(fault)
            for t in turns:
                if t is not None and t != turn:
                    low, high, turn, distinct = (t if low is None else low), t, t, distinct + 1
            initials = ([before] if before else []) + list(marks[::2])
            illegal += sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))
            before = initials[-1] if initials else before
            audits.append(audit)
            for role, text in zip(roles, texts):
                digest.update((("\n" if said else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
                said = True
        if digest is not None:
            yield report()

    parts = _forward(rows)
    kind = dict(parts.dtypes)["conv_id"]
    return ordered.per_row(parts, run, f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")
