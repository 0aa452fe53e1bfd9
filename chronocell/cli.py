"""Commands over change-log stores; each is one call of the library.

Ends with 0, with 2 for bad arguments or inputs, and with 1 where there is no store.
"""

from __future__ import annotations

import argparse
import datetime as dt
import json
import sys

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronocell.functions import codec
from chronocell.operators import diff, log
from chronocell.sources import exports, history, snapshots
from chronocell.sources.store import Store, StoreError


class BadInput(Exception):
    """Ends the command with code 2."""


def instant(text: str | None) -> dt.datetime | None:
    """A time in ISO form; ``None`` for none and for ``now``."""
    if text is None or text.strip().lower() == "now":
        return None
    try:
        return codec.utc(dt.datetime.fromisoformat(text))
    except ValueError:
        raise BadInput(f"not a time in ISO form: {text!r}") from None


def _input(spark: SparkSession, path: str) -> DataFrame:
    try:
        return snapshots.load(spark, path)
    except (AnalysisException, ValueError) as e:
        raise BadInput(str(e).splitlines()[0]) from None


def _opened(spark: SparkSession, path: str) -> Store:
    store = Store(spark, path)
    if not store.exists():
        raise FileNotFoundError(f"no store at {path}")
    return store


def _say(found: dict, as_json: bool) -> None:
    print(json.dumps(found, default=str) if as_json else "\n".join(f"{k}={v}" for k, v in found.items()))


#: Rows of a table of text; JSON has all.
SHOWN = 1000


def _show(view: DataFrame, as_json: bool) -> None:
    """JSON gives an array of every row; text is Spark's table of the first ``SHOWN``, and says so where there are more."""
    if not as_json:
        view.show(SHOWN, truncate=False)
        if view.offset(SHOWN).isEmpty():
            return
        print(f"the first {SHOWN} of {view.count()} rows; --json has all")
        return
    sys.stdout.write("[")
    for k, line in enumerate(exports.json_lines(view)):
        sys.stdout.write(("," if k else "") + "\n" + line)
    sys.stdout.write("\n]\n")


def capture(spark: SparkSession, a: argparse.Namespace) -> None:
    at = instant(a.at)
    made = Store(spark, a.store).capture(_input(spark, a.input), a.key, at)
    _say({k: made[k] for k in ("noop", "events_added", "snapshot_id", "file")}, a.json)


def compare(spark: SparkSession, a: argparse.Namespace) -> None:
    """Both inputs as the two captures of a store, and the counts of their differences."""
    at = [instant(t) or dt.datetime(1970, 1, d, tzinfo=dt.UTC) for t, d in ((a.at_before, 1), (a.at_after, 2))]
    sides = [_input(spark, a.before), _input(spark, a.after)]
    missing = [k for k in a.key if any(k not in s.columns for s in sides)]
    if missing:
        raise BadInput(f"key columns that an input lacks: {', '.join(missing)}")
    key = a.key_name or (a.key[0] if len(a.key) == 1 else "row_key")
    if a.key != [key]:
        sides = [s.withColumn(key, diff.composite_key(a.key)) for s in sides]
    for name, side in zip(("before", "after"), sides, strict=True):
        repeated = diff.duplicate_keys(side, [key]).agg(F.sum("n")).first()[0]
        if repeated:
            raise BadInput(f"{repeated} rows of {name} share their key {key!r}; name more key columns")
    store = Store(spark, a.store)
    made = [store.capture(s, key, t)["events_added"] for s, t in zip(sides, at, strict=True)]
    counts = diff.compare_counts(*sides, key).first().asDict()
    names = {"n_before": "before", "n_after": "after"}
    _say({"store": a.store, "key": key, "captures": 2, "before_events": made[0], "after_events": made[1]} | {names.get(k, k): v for k, v in counts.items()}, a.json)


def travel(spark: SparkSession, a: argparse.Namespace) -> None:
    at = instant(a.as_of)
    _show(_opened(spark, a.store).view(at), a.json)


def timeline(spark: SparkSession, a: argparse.Namespace) -> None:
    """A field's values are typed; over all fields they are their texts, as types differ by row."""
    store = _opened(spark, a.store)
    found = log.timeline(store.events(), a.entity_id, a.field)
    if a.field:
        found = found.withColumn("value", codec.decoded(F.col("value"), store.fields().get(a.field, "utf8")))
    _show(found, a.json)


def row_state(spark: SparkSession, a: argparse.Namespace) -> None:
    at = instant(a.as_of)
    events = _opened(spark, a.store).events(at).where(F.col("entity_id") == a.entity_id)
    found = log.row_states(events).first()
    _say({"state": found["state"], "resurrected": found["resurrected"]} if found else {"state": "unborn", "resurrected": False}, a.json)


def view(spark: SparkSession, a: argparse.Namespace) -> None:
    at = instant(a.as_of)
    shown = _opened(spark, a.store).view(at)
    if a.format not in ("parquet", "csv"):
        return _show(shown, a.json)
    if not a.out:
        raise BadInput(f"--format {a.format} needs --out")
    out = exports.export(shown, a.format, parquet=a.out, csv=a.out)
    if a.json:
        return _say({"format": a.format, "out": out}, True)
    print(out)


def info(spark: SparkSession, a: argparse.Namespace) -> None:
    _say(_opened(spark, a.store).info(), a.json)


def checkpoint(spark: SparkSession, a: argparse.Namespace) -> None:
    made = _opened(spark, a.store).checkpoint()
    _say({"noop": made is None} | (made or {"file": None, "as_of": None}), a.json)


def generate(spark: SparkSession, a: argparse.Namespace) -> None:
    _say(history.generate(Store(spark, a.store), a.rows, a.steps, a.seed, a.violations, a.cols, a.checkpoint_every), a.json)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="chronocell", description="Change history of tables.")
    commands = top.add_subparsers(required=True)

    def command(name: str, run, *positional: str) -> argparse.ArgumentParser:
        p = commands.add_parser(name)
        p.set_defaults(run=run)
        for x in ("store", *positional):
            p.add_argument(x)
        p.add_argument("--json", action="store_true")
        return p

    p = command("capture", capture, "input")
    p.add_argument("--key", required=True)
    p.add_argument("--at")
    p = command("compare", compare, "before", "after")
    p.add_argument("--key", nargs="+", required=True)
    for x in ("--key-name", "--at-before", "--at-after"):
        p.add_argument(x)
    command("travel", travel).add_argument("--as-of", required=True)
    command("timeline", timeline, "entity_id").add_argument("--field")
    command("row-state", row_state, "entity_id").add_argument("--as-of")
    p = command("view", view)
    p.add_argument("--as-of")
    p.add_argument("--format", choices=exports.FORMATS, default="dataframe")
    p.add_argument("--out")
    command("info", info)
    command("checkpoint", checkpoint)
    p = command("gen-fixture", generate)
    for x, n in (("--rows", 1000), ("--cols", history.COLUMNS), ("--steps", 40), ("--seed", 42), ("--violations", 0), ("--checkpoint-every", 0)):
        p.add_argument(x, type=int, default=n)
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("chronocell").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        a.run(spark, a)
    except FileNotFoundError as e:
        print(e, file=sys.stderr)
        return 1
    except (BadInput, StoreError, ValueError) as e:
        print(e, file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
