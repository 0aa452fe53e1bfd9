"""Generated histories for demonstrations and measurements.

Every cell is a function of the row's id, the column, the step and the seed, so snapshots
are computed where they are needed and any step can be made on its own.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronocell.sources.store import Store

KEY = "id"
COLUMNS = 20
WRITE_ONCE = ("cohort", "record_no", "birth_year", "site")
#: Of 1000 cells that may change, so many do in a step.
CHANGED = 25
FIRST_DAY = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)


def _draw(seed: int, *parts) -> Column:
    return F.xxhash64(F.col(KEY), F.lit(seed), *[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _under(draw: Column, n: int) -> Column:
    return F.pmod(draw, F.lit(n))


def _word(draw: Column, words: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), (_under(draw, len(words)) + 1).cast("int"))


def snapshot(spark: SparkSession, step: int, rows: int, steps: int, seed: int = 42, violations: int = 0, cols: int = COLUMNS) -> DataFrame:
    """The whole table at ``step`` (from 0): ``id`` and ``cols`` columns, of which the first four are written once.

    About one row in twenty is born after the first step, as many are deleted, and most of
    those come back.  ``violations`` rows, which live throughout, change one write-once cell
    half-way.
    """
    violator = F.col(KEY) * violations % rows < violations
    fate = F.when(violator, 99).otherwise(_under(_draw(seed, "fate"), 100))
    turn = _under(_draw(seed, "turn"), max(1, steps - 1)) + 1
    absent = ((fate < 5) & (F.lit(step) < turn)) | (fate.between(5, 9) & (F.lit(step) >= turn) & ((fate >= 8) | (F.lit(step) < turn + 1)))

    def version(name: str) -> Column:
        """How often a cell has changed by this step."""
        changes = F.filter(F.sequence(F.lit(1), F.lit(step)), lambda j: _under(_draw(seed, name, j), 1000) < CHANGED) if step else F.array()
        return F.size(changes)

    late = violator & F.lit(step >= max(1, steps // 2))
    cells = [
        F.when(late, "moved").otherwise(_word(_draw(seed, "cohort"), ("A", "B", "C"))).alias("cohort"),
        F.format_string("R%012d", _under(_draw(seed, "record"), 10**12)).alias("record_no"),
        (_under(_draw(seed, "birth"), 80) + 1930).alias("birth_year"),
        _word(_draw(seed, "site"), ("north", "east", "south", "west")).alias("site"),
    ]
    for k in range(6):
        cells.append((_under(_draw(seed, f"measure_{k}", version(f"measure_{k}")), 100_000) / 100).alias(f"measure_{k}"))
    for k in range(5):
        cells.append(_under(_draw(seed, f"count_{k}", version(f"count_{k}")), 1000).alias(f"count_{k}"))
    for k in range(3):
        cells.append(_word(_draw(seed, f"status_{k}", version(f"status_{k}")), ("new", "open", "held", "done", "void")).alias(f"status_{k}"))
    for k in range(2):
        cells.append((_under(_draw(seed, f"flag_{k}", version(f"flag_{k}")), 2) == 1).alias(f"flag_{k}"))
    for k in range(COLUMNS, cols):
        cells.append((_under(_draw(seed, f"extra_{k}", version(f"extra_{k}")), 100_000) / 100).alias(f"extra_{k}"))
    return spark.range(1, rows + 1).where(~absent).select(KEY, *cells[:cols])


def generate(store: Store, rows: int = 1000, steps: int = 40, seed: int = 42, violations: int = 0, cols: int = COLUMNS, checkpoint_every: int = 0) -> dict:
    """Captures ``steps`` daily snapshots; the same arguments give the same events.

    After every ``checkpoint_every`` captures, if any, the store is folded into a checkpoint.
    """
    if cols < len(WRITE_ONCE):
        raise ValueError(f"the history has {len(WRITE_ONCE)} columns at least")
    if not 0 <= violations <= rows:
        raise ValueError("violations must be from 0 to the number of rows")
    added = []
    for step in range(steps):
        made = store.capture(snapshot(store.spark, step, rows, steps, seed, violations, cols), KEY, FIRST_DAY + dt.timedelta(days=step))
        added.append(made["events_added"])
        if checkpoint_every and (step + 1) % checkpoint_every == 0:
            store.checkpoint()
    rates = [n / (rows * cols) for n in added[1:]]
    return {"rows": rows, "cols": cols, "steps": steps, "seed": seed, "violations": violations, "events": sum(added), "mean_change": sum(rates) / len(rates) if rates else 0.0}


def generate_schema_churn(store: Store) -> list[dict]:
    """Six captures: a base table, a column added, a birth, a column dropped, one renamed, one back."""
    names, regions = ["ann", "ben", "cleo", "dan", "eva"], ["N", "E", "S", "W", "N"]
    score = {1: [1.0, 2.0, 3.0, 4.0], 2: [1.5, 2.0, 3.5, 4.0], 3: [1.5, 2.5, 3.5, 4.0, 5.0], 6: [9.0, 8.0, 7.0, 6.0, 5.0]}
    done = []
    for day in range(1, 7):
        n = 4 if day < 3 else 5
        columns = {"id": list(range(1, n + 1)), "full_name" if day >= 5 else "name": names[:n], "region": regions[:n]}
        if day >= 2:
            columns["email"] = [f"{x}@example.org" for x in names[:n]]
        if day in score:
            columns["score"] = score[day]
        kinds = ", ".join(f"{c} {({int: 'long', float: 'double'}).get(type(v[0]), 'string')}" for c, v in columns.items())
        done.append(store.capture(store.spark.createDataFrame(list(zip(*columns.values(), strict=True)), kinds), "id", FIRST_DAY + dt.timedelta(days=day)))
    return done
