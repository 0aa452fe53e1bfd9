"""The change log on a file system: immutable Parquet event files under a manifest.

A store is a folder with ``manifest.json``, ``commits/<number>.json``, ``events/<stamp>/`` and, once
made, ``checkpoints/<stamp>_<captures>/`` and ``index/<stamp>/``.  Each commit adds one entry, a
capture or a checkpoint, and is a file that is made only if there is none of its number; that is the
commit point.  The manifest is what commits fold to, kept up to date for readers that know nothing
of them; readers here fold what it does not have yet.  What a failed capture leaves behind is never
read.  Of several writers one gets a number and the others begin their capture anew on what is then
there, so captures are kept in the order of their commits and none is lost.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronocell.functions import codec
from chronocell.operators import diff, filters, log
from chronocell.sources.scratch import Scratch

#: Columns of event files and, below, keys of the manifest (fixed values of the format).
EVENTS = T.StructType(
    [
        T.StructField("entity_id", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("field", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("dtype", T.StringType()),
        T.StructField("snapshot_id", T.StringType()),
    ]
)
#: Columns of checkpoints: those of events and a capture's place.
FOLDED = T.StructType([*EVENTS.fields, T.StructField("seq", T.IntegerType())])
RESERVED = {log.DELETED, "entity_id"}
#: What checkpoints hold beside a cell's last event: a summary of all its events.
SUMMED = T.StructType([*FOLDED.fields, *[f for f in log.SUMMARY.fields if f.name not in FOLDED.names]])
#: File systems on which a rename is one step that fails where the target is there.
RENAMING = {"hdfs", "viewfs"}
#: How often a capture begins anew because another writer was first.
ATTEMPTS = 20
#: Bits of a Bloom filter for each entity of a file, the bits set for one, and bits of all at most.
BITS_EACH, PROBES, MOST_BITS = 10, 4, 1 << 28


class StoreError(ValueError):
    """A store that is missing, or a snapshot that cannot be captured."""


class Conflict(StoreError):
    """Another writer has made the commit of that number."""


def _folds(checkpoint: dict) -> int:
    """How many captures a checkpoint folds.  Its name tells, as the manifest's form has no place for it."""
    return int(checkpoint["file"].split("_")[1])


def _bit(entity_id: Column, k: int, bits: int) -> Column:
    """The bit that probe ``k`` sets for an entity."""
    return F.pmod(F.xxhash64(entity_id, F.lit(k)), F.lit(bits))


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # -- manifest --------------------------------------------------------------

    def exists(self) -> bool:
        return self._there("manifest.json") or self._there(self._commit_file(0))

    def _there(self, name: str) -> bool:
        return self._fs.exists(self._path(f"{self.path}/{name}"))

    def _local(self, name: str):
        """The file on this machine's disk; ``None`` where the store is elsewhere.  No checksums are kept of these small files."""
        if self._fs.getUri().getScheme() != "file":
            return None
        path = self._fs.makeQualified(self._path(f"{self.path}/{name}")).toUri().getPath()
        return self.spark.sparkContext._jvm.java.io.File(path).toPath()

    def _read(self, name: str) -> dict:
        jvm = self.spark.sparkContext._jvm
        if local := self._local(name):
            return json.loads(bytes(jvm.java.nio.file.Files.readAllBytes(local)))
        stream = self._fs.open(self._path(f"{self.path}/{name}"))
        try:
            return json.loads(bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()

    @staticmethod
    def _commit_file(number: int) -> str:
        return f"commits/{number:08d}.json"

    def manifest(self) -> dict:
        """What is committed; an empty manifest where there is none yet."""
        found = {"schema_version": 1, "store_name": self.path.rsplit("/", 1)[-1], "key_column": None, "schema": {}, "events": [], "checkpoints": []}
        if self._there("manifest.json"):
            found = self._read("manifest.json")
        # A commit adds one entry, so entries count the commits that are folded in.
        while self._there(name := self._commit_file(len(found["events"]) + len(found["checkpoints"]))):
            found = self._folded(found, self._read(name))
        return found

    @staticmethod
    def _folded(manifest: dict, commit: dict) -> dict:
        if "checkpoint" in commit:
            return {**manifest, "checkpoints": [*manifest["checkpoints"], commit["checkpoint"]]}
        return {**manifest, "key_column": commit["key_column"], "schema": commit["schema"], "events": [*manifest["events"], commit["event"]]}

    def _commit(self, commit: dict, expected: dict) -> None:
        """Makes the commit that comes after ``expected``; ``Conflict`` where another writer has made it."""
        self._claim(self._commit_file(len(expected["events"]) + len(expected["checkpoints"])), commit)
        # Other readers' manifest: whoever writes last may be behind, and readers here fold on from any.
        self._replace("manifest.json", self.manifest())

    def _put(self, name: str, content: dict, overwrite: bool) -> None:
        stream = self._fs.create(self._path(f"{self.path}/{name}"), overwrite)
        try:
            stream.write(bytearray(json.dumps(content, indent=1).encode()))
        finally:
            stream.close()

    def _aside(self, content: dict) -> str:
        """A file of its own with the content, to be linked or renamed to where it goes."""
        name = f".staging/{uuid.uuid4().hex}.json"
        if local := self._local(name):
            self._fs.mkdirs(self._path(f"{self.path}/.staging"))
            jvm, sc = self.spark.sparkContext._jvm, self.spark.sparkContext
            jvm.java.nio.file.Files.write(local, bytearray(json.dumps(content, indent=1).encode()), sc._gateway.new_array(jvm.java.nio.file.OpenOption, 0))
        else:
            self._put(name, content, True)
        return name

    def _claim(self, name: str, content: dict) -> None:
        """Makes a file, whole at once and only if it is not there: a link, a rename or a conditional write, as the file system has it."""
        self._fs.mkdirs(self._path(f"{self.path}/commits"))
        files = self.spark.sparkContext._jvm.java.nio.file.Files
        try:
            if local := self._local(name):
                source = self._local(self._aside(content))
                try:
                    files.createLink(local, source)
                finally:
                    files.delete(source)
            elif self._fs.getUri().getScheme() in RENAMING:
                self._rename(self._aside(content), name, overwrite=False)
            else:
                self._put(name, content, False)
        except Py4JJavaError as e:
            if self._there(name):
                raise Conflict(f"another writer has made {name}") from e
            raise

    def _rename(self, old: str, new: str, overwrite: bool) -> None:
        jvm, sc = self.spark.sparkContext._jvm, self.spark.sparkContext
        kind = jvm.org.apache.hadoop.fs.Options.Rename
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.path).toUri(), sc._jsc.hadoopConfiguration())
        how = sc._gateway.new_array(kind, 1)
        how[0] = kind.OVERWRITE if overwrite else kind.NONE
        context.rename(self._path(f"{self.path}/{old}"), self._path(f"{self.path}/{new}"), how)

    def _replace(self, name: str, content: dict) -> None:
        """Writes a file over what is there, in one step."""
        if local := self._local(name):
            jvm, sc = self.spark.sparkContext._jvm, self.spark.sparkContext
            how = sc._gateway.new_array(jvm.java.nio.file.CopyOption, 2)
            how[0], how[1] = jvm.java.nio.file.StandardCopyOption.ATOMIC_MOVE, jvm.java.nio.file.StandardCopyOption.REPLACE_EXISTING
            jvm.java.nio.file.Files.move(self._local(self._aside(content)), local, how)
        elif self._fs.getUri().getScheme() in RENAMING:
            self._rename(self._aside(content), name, overwrite=True)
        else:
            self._put(name, content, True)

    # -- reading ---------------------------------------------------------------

    def files(self, instant: dt.datetime | None = None) -> list[dict]:
        """The manifest's entries that can hold events not after ``instant``."""
        if not self.exists():
            raise StoreError(f"no store at {self.path}")
        return self._files(self.manifest(), instant)

    @staticmethod
    def _files(manifest: dict, instant: dt.datetime | None) -> list[dict]:
        until = None if instant is None else codec.utc(instant).isoformat()
        return [{**e, "seq": k} for k, e in enumerate(manifest["events"]) if until is None or e["ts_min"] <= until]

    def events(self, instant: dt.datetime | None = None) -> DataFrame:
        """The log with ``seq``, a capture's place; files past ``instant`` are not opened."""
        return self._placed(self.files(instant), instant)

    def _placed(self, files: list[dict], instant: dt.datetime | None, paths: list[str] | None = None) -> DataFrame:
        """The events of some entries of the manifest, or of some of their part files, each with its capture's place."""
        paths = [e["file"] for e in files] if paths is None else paths
        if not paths:
            return self.spark.createDataFrame([], FOLDED)
        rows = self.spark.read.schema(EVENTS).parquet(*[f"{self.path}/{p}" for p in paths])
        # One small row a listed capture, by the folder that its files lie in.
        places = self.spark.createDataFrame([(e["file"].rpartition("/")[2], e["seq"]) for e in files], "folder string, seq int")
        folder = F.substring_index(F.substring_index(F.col("_metadata.file_path"), "/", -2), "/", 1)
        rows = rows.withColumn("folder", folder).join(F.broadcast(places), "folder").select(*EVENTS.names, "seq")
        return rows if instant is None else rows.where(F.col("timestamp") <= F.lit(codec.utc(instant)))

    def latest(self, instant: dt.datetime | None = None) -> DataFrame:
        """Events enough for any view as of ``instant``: the newest checkpoint not after it and what came later.

        A capture made after the checkpoint counts whatever its instant.  Without a checkpoint: all events.
        """
        return self._latest(self.manifest(), instant)

    def _newest(self, manifest: dict, instant: dt.datetime | None) -> dict | None:
        until = None if instant is None else codec.utc(instant).isoformat()
        usable = [c for c in manifest["checkpoints"] if until is None or c["as_of"] <= until]
        return max(usable, key=_folds, default=None)

    def _latest(self, manifest: dict, instant: dt.datetime | None = None) -> DataFrame:
        newest, files = self._newest(manifest, instant), self._files(manifest, instant)
        if newest is None:
            return self._placed(files, instant)
        base = self.spark.read.schema(FOLDED).parquet(f"{self.path}/{newest['file']}")
        return base.unionByName(self._placed([e for e in files if e["seq"] >= _folds(newest)], instant))

    def summary(self, instant: dt.datetime | None = None) -> DataFrame:
        """``log.summary`` of all events by ``instant``, from the newest checkpoint and only the events after it."""
        manifest = self.manifest()
        newest, files = self._newest(manifest, instant), self._files(manifest, instant)
        if newest is not None:
            base = self.spark.read.parquet(f"{self.path}/{newest['file']}")
            if set(SUMMED.names) <= set(base.columns):  # checkpoints of earlier stores hold last events only
                later = self._placed([e for e in files if e["seq"] >= _folds(newest)], instant)
                return log.merged(base.select(*log.SUMMARY.names).unionByName(log.summary(later)))
        return log.summary(self._placed(files, instant))

    def row_states(self, instant: dt.datetime | None = None) -> DataFrame:
        """``log.row_states`` from ``summary``."""
        return log.states_of(self.summary(instant))

    def change_counts(self, instant: dt.datetime | None = None) -> DataFrame:
        """``log.change_counts`` from ``summary``."""
        return log.counts_of(self.summary(instant))

    def kpis(self, write_once: Sequence[str] = (), instant: dt.datetime | None = None) -> DataFrame:
        """``log.kpis`` from ``summary``."""
        return log.kpis_of(self.summary(instant), write_once)

    # -- looking entities up ---------------------------------------------------

    def _index_runs(self) -> list[str]:
        """The finished runs of ``index``, each named by a number and the bits of its filters."""
        if not self._there("index"):
            return []
        return sorted(f.getPath().getName() for f in self._fs.listStatus(self._path(f"{self.path}/index")))

    def index(self) -> int:
        """Indexes the captures that no run has indexed yet; how many those are.

        For each event file there is the span of its entities and a Bloom filter of them, as the words of its
        bits that are not zero, in order of the words: a lookup reads the few row groups that hold its own.
        All filters of a run have as many bits as its largest file needs.
        """
        done = {r["folder"] for r in self._zones().select("folder").distinct().collect()} if self._index_runs() else set()
        todo = [e["file"] for e in self.manifest()["events"] if e["file"].rpartition("/")[2] not in done]
        if not todo:
            return 0
        scratch = Scratch(self.spark, "index")
        try:
            place = F.substring_index(F.col("_metadata.file_path"), "/", -2)
            ids = self.spark.read.schema(EVENTS).parquet(*[f"{self.path}/{p}" for p in todo]).select(place.alias("file"), "entity_id").where("entity_id IS NOT NULL")
            ids = scratch.keep(ids.distinct(), "ids")
            zones = ids.groupBy("file").agg(F.min("entity_id").alias("low"), F.max("entity_id").alias("high"), F.count(F.lit(1)).alias("ids"))
            zones = zones.select(F.substring_index("file", "/", 1).alias("folder"), "file", "low", "high", "ids")
            most = zones.agg(F.max("ids")).first()[0] or 1
            bits = min(MOST_BITS, 1 << max(6, (BITS_EACH * most - 1).bit_length()))
            own = ids.select("file", F.explode(F.array(*[_bit(F.col("entity_id"), k, bits) for k in range(PROBES)])).alias("bit"))
            words = own.groupBy((F.expr("bit div 64")).alias("word"), "file").agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("set"))
            aside = f"{self.path}/.staging/{uuid.uuid4().hex}"
            # One file for the captures' zones, and words in order.
            zones.coalesce(1).write.parquet(f"{aside}/zones")
            words.orderBy("word").write.parquet(f"{aside}/words")
            self._fs.mkdirs(self._path(f"{self.path}/index"))
            self._fs.rename(self._path(aside), self._path(f"{self.path}/index/{uuid.uuid4().hex[:8]}_{bits}"))
        finally:
            scratch.clear()
        return len(todo)

    def _zones(self) -> DataFrame:
        return self.spark.read.schema("folder string, file string, low string, high string, ids long").parquet(*[f"{self.path}/index/{r}/zones" for r in self._index_runs()])

    def paths_of(self, entity_ids: Sequence[str], instant: dt.datetime | None = None) -> list[str]:
        """The part files, and the captures that no index knows, that may hold events of some entities by ``instant``."""
        files, runs = self.files(instant), self._index_runs()
        if not runs:
            return [e["file"] for e in files]
        known = {r["folder"] for r in self._zones().select("folder").distinct().collect()}
        wanted = self.spark.createDataFrame([(i,) for i in dict.fromkeys(entity_ids)], "entity_id string")
        found: set[str] = set()
        for run in runs:
            bits = int(run.rpartition("_")[2])
            asked = wanted.select("entity_id", F.explode(F.array_distinct(F.array(*[_bit(F.col("entity_id"), k, bits) for k in range(PROBES)]))).alias("bit"))
            asked = asked.withColumn("word", F.expr("bit div 64")).withColumn("mask", F.expr("shiftleft(1L, cast(bit % 64 as int))"))
            probes = asked.groupBy("entity_id", "word").agg(F.bit_or("mask").alias("mask"))
            probes = [tuple(r) for r in probes.collect()]  # at most ``PROBES`` for each of the ids that were given
            words = self.spark.read.schema("word long, file string, set long").parquet(f"{self.path}/index/{run}/words").where(F.col("word").isin([w for _, w, _ in probes]))
            probed = self.spark.createDataFrame(probes, "entity_id string, word long, mask long")
            need = probed.groupBy("entity_id").agg(F.count(F.lit(1)).alias("need"))
            hits = words.join(F.broadcast(probed), "word").where(F.col("set").bitwiseAND(F.col("mask")) == F.col("mask"))
            hits = hits.groupBy("entity_id", "file").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(need), "entity_id").where("n = need")
            zones = self.spark.read.parquet(f"{self.path}/index/{run}/zones").select("file", "low", "high")
            inside = hits.join(zones, "file").where("entity_id BETWEEN low AND high")
            found |= {r["file"] for r in inside.select("file").distinct().collect()}
        live = {e["file"].rpartition("/")[2] for e in files}
        return [e["file"] for e in files if e["file"].rpartition("/")[2] not in known] + [f"events/{f}" for f in sorted(found) if f.partition("/")[0] in live]

    def events_of(self, entity_ids: Sequence[str], instant: dt.datetime | None = None) -> DataFrame:
        """``events`` of some entities; only files that may hold them are opened."""
        rows = self._placed(self.files(instant), instant, self.paths_of(entity_ids, instant))
        return log.of_entities(rows, entity_ids)

    def fields(self) -> dict[str, str]:
        """Tags of all columns ever seen but the key, in order of appearance; the latest tag of each."""
        m = self.manifest()
        return {c: t for c, t in m["schema"].items() if c != m["key_column"]}

    def view(self, instant: dt.datetime | tuple | None = None) -> DataFrame:
        """The typed table as of ``instant``, or of the end of a range of two, by key; all columns and no rows before history."""
        return self._view(instant).orderBy(F.col(f"`{self.manifest()['key_column'] or 'entity_id'}`"))

    def _view(self, instant: dt.datetime | tuple | None = None) -> DataFrame:
        """``view`` in no order, for those who filter or write it."""
        m = self.manifest()
        tags = self.fields()
        view = log.mirror_view(self.latest(instant[1] if isinstance(instant, tuple) else instant), list(tags))
        key = m["key_column"] or "entity_id"
        cells = [codec.decoded(F.col(f"`{c}`"), t).alias(c) for c, t in tags.items()]
        return view.select(codec.decoded(F.col("entity_id"), m["schema"].get(key, "utf8")).alias(key), *cells)

    def filter(self, wanted: dict, instant: dt.datetime | tuple | None = None) -> DataFrame:
        """The rows of ``view`` with some values, or for which callables hold: ``filters.equals``."""
        return filters.equals(self._view(instant), wanted)

    def with_nulls(self, column: str | None = None, instant: dt.datetime | tuple | None = None) -> DataFrame:
        """The rows of ``view`` with a null in ``column``, or anywhere but the key: ``filters.with_nulls``."""
        return filters.with_nulls(self._view(instant), self.manifest()["key_column"] or "entity_id", column)

    def info(self) -> dict:
        """Counts from the manifest alone."""
        m = self.manifest()
        e = m["events"]
        return {"store": m["store_name"], "key_column": m["key_column"], "columns": len(m["schema"]), "files": len(e), "events": sum(x["row_count"] for x in e), "snapshots": len({x["snapshot_id"] for x in e}), "ts_min": min((x["ts_min"] for x in e), default=None), "ts_max": max((x["ts_max"] for x in e), default=None)}

    # -- writing ---------------------------------------------------------------

    def capture(self, snapshot: DataFrame, key: str, captured_at: dt.datetime | None = None, idempotency: str = "any", allow_out_of_order: bool = True, strict_resurrection: bool = False) -> dict:
        """Records what a full snapshot changes: ``events_added, snapshot_id, file, noop``.

        Keys must be there, unique and not null.  A snapshot with the same columns and content
        as any earlier one (with ``idempotency="latest"`` as the latest) is a no-op.  It is compared
        with the latest state even where ``captured_at`` is before that; unless
        ``allow_out_of_order``, such a capture is an error.  New keys give their non-null cells, common ones their
        changed cells, missing ones a deletion, and columns that went a null for each live cell.
        A key that comes back with a null shows what its cell had before it went, unless
        ``strict_resurrection``, which records the null.
        """
        names = snapshot.columns
        if key not in names:
            raise StoreError(f"no key column {key!r}")
        if RESERVED & set(names) - {key}:
            raise StoreError(f"reserved column names: {sorted(RESERVED & set(names))}")
        if idempotency not in ("any", "latest"):
            raise StoreError(f"idempotency is 'any' or 'latest', not {idempotency!r}")
        stamp = codec.utc(captured_at or dt.datetime.now(dt.UTC))
        tags = {f.name: codec.tag(f.dataType) for f in snapshot.schema.fields}
        scratch = Scratch(self.spark, "capture")
        try:
            text = scratch.keep(snapshot.select(*[codec.encoded(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in snapshot.schema.fields]), "snapshot")
            own = F.col(f"`{key}`")
            bad = text.groupBy(own.alias("key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR key IS NULL").limit(10).collect()
            if bad:
                kind = "null" if any(r[0] is None for r in bad) else "duplicate"
                raise StoreError(f"{kind} keys: {[r[0] for r in bad]}")
            snapshot_id = codec.snapshot_digest(text, key)
            for _ in range(ATTEMPTS):
                try:
                    return self._captured(text, key, tags, stamp, snapshot_id, idempotency, allow_out_of_order, strict_resurrection)
                except Conflict:
                    continue
            raise StoreError(f"other writers were first {ATTEMPTS} times")
        finally:
            scratch.clear()

    def _captured(self, text: DataFrame, key: str, tags: dict, stamp: dt.datetime, snapshot_id: str, idempotency: str, allow_out_of_order: bool, strict_resurrection: bool) -> dict:
        """One attempt of ``capture``: what a snapshot's ``text`` changes of what is committed now; ``Conflict`` if that changes."""
        old = self.manifest()
        if old["key_column"] not in (None, key):
            raise StoreError(f"the store's key is {old['key_column']!r}")
        columns = [c for c in text.columns if c != key]
        seen = [c for c in old["schema"] if c != key]
        drift = bool(seen) and set(seen) != set(columns)
        if not allow_out_of_order and any(stamp.isoformat() < e["ts_max"] for e in old["events"]):
            raise StoreError(f"the store has events after {stamp.isoformat()}")
        noop = {"events_added": 0, "snapshot_id": snapshot_id, "file": None, "noop": True}
        known = old["events"] if idempotency == "any" else old["events"][-1:]
        if not drift and any(e["snapshot_id"] == snapshot_id for e in known):
            return noop

        prior = log.mirror_view(self._latest(old) if old["events"] else self.spark.createDataFrame([], FOLDED), seen).withColumnRenamed("entity_id", key)
        shared = [c for c in seen if c in columns]
        events = diff.diff_events(prior.select(*[F.col(f"`{c}`") for c in (key, *shared)]), text, key)
        dropped = [c for c in seen if c not in columns]
        if dropped:
            events = events.unionByName(diff.tombstones(prior, key, dropped))
        if strict_resurrection and seen:
            gone = log.mirror_view(self._latest(old), seen, deleted=True).withColumnRenamed("entity_id", key)
            events = events.unionByName(diff.returned_nulls(gone, text, key))
        all_tags = {**old["schema"], **tags}
        of = F.create_map(*[F.lit(x) for pair in all_tags.items() for x in pair])
        # A type that changed while the text did not is no change; a deletion has no type.
        rows = events.select("entity_id", F.lit(stamp).cast("timestamp").alias("timestamp"), "field", "value", F.coalesce(of[F.col("field")], F.lit("null")).alias("dtype"), F.lit(snapshot_id).alias("snapshot_id"))
        place = f"events/{stamp.strftime('%Y%m%dT%H%M%S%fZ')}_{uuid.uuid4().hex[:8]}"
        count = self._publish(rows, place)
        if not count:
            return noop
        iso = stamp.isoformat()
        entry = {"file": place, "snapshot_id": snapshot_id, "ts_min": iso, "ts_max": iso, "row_count": count}
        try:
            self._commit({"event": entry, "key_column": key, "schema": all_tags}, old)
        except Conflict:
            self._fs.delete(self._path(f"{self.path}/{place}"), True)
            raise
        return {"events_added": count, "snapshot_id": snapshot_id, "file": place, "noop": False}

    def _publish(self, rows: DataFrame, place: str) -> int:
        """Writes ``rows`` as ``place`` and counts them; nothing is left where there are none.

        They are written aside and moved, so that nobody who lists the folder meets files that are not whole.
        """
        aside = f"{self.path}/.staging/{uuid.uuid4().hex}"
        rows.write.option("parquet.enable.dictionary", "true").parquet(aside)
        count = self.spark.read.schema(rows.schema).parquet(aside).count()
        if not count:
            self._fs.delete(self._path(aside), True)
            return 0
        self._fs.mkdirs(self._path(f"{self.path}/{place.partition('/')[0]}"))
        if not self._fs.rename(self._path(aside), self._path(f"{self.path}/{place}")):
            raise StoreError(f"could not move the rows to {place}")
        return count

    def checkpoint(self) -> dict | None:
        """Folds all committed events, from the last checkpoint on, into a new one; its entry in the manifest.

        It holds each cell's last event, which captures and views read with later events only, and a
        summary of all its events, from which ``row_states``, ``change_counts`` and ``kpis`` go on in
        the same way.  Timelines go on reading events, which all stay.  ``None`` where nothing came
        since the last checkpoint.
        """
        for _ in range(ATTEMPTS):
            old = self.manifest()
            done = len(old["events"])
            if done == max(map(_folds, old["checkpoints"]), default=0):
                return None
            as_of = max(e["ts_max"] for e in old["events"])
            stamp = dt.datetime.fromisoformat(as_of).strftime("%Y%m%dT%H%M%S%fZ")
            place = f"checkpoints/{stamp}_{done:06d}_{uuid.uuid4().hex[:8]}"
            self._publish(self._summed(old), place)
            entry = {"file": place, "as_of": as_of}
            try:
                self._commit({"checkpoint": entry}, old)
                return entry
            except Conflict:
                self._fs.delete(self._path(f"{self.path}/{place}"), True)
        raise StoreError(f"other writers were first {ATTEMPTS} times")

    def _summed(self, manifest: dict) -> DataFrame:
        """``SUMMED``: the last event and the summary of every cell, from the last checkpoint on."""
        newest, files = self._newest(manifest, None), self._files(manifest, None)
        base = None if newest is None else self.spark.read.parquet(f"{self.path}/{newest['file']}")
        if base is None or not set(SUMMED.names) <= set(base.columns):
            rows = log.summarised(self._placed(files, None))
        else:
            later = self._placed([e for e in files if e["seq"] >= _folds(newest)], None)
            rows = log.merged(base.select(*SUMMED.names).unionByName(log.summarised(later)), EVENTS.names)
        return rows.select(*SUMMED.names)
