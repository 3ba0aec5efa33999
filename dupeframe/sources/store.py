"""Fingerprint store: bucketed Parquet folders and numbered versions.

Rows are dealt by algorithm and by a hash of the path into buckets, with Spark's own bucketed
files, so a join on the path reads them without a shuffle. ``data/<run>/<algorithm>`` holds a full set of
rows or the changes of one run; ``v<number>/_layout.json`` lists, for each algorithm, the full
set and the changes after it that make up the version. A run writes its changes only; they are
merged into a new full set once they are a good part of it.

A version counts once its marker is there, and a marker is created whole and only where there was
none. Each run builds on the last marker and goes for the next number, so of two runs one finds
its number taken and merges again, on top of the other's version. Files are never changed.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession, functions as F

from dupeframe import hadoop
from dupeframe.operators.cache import answered, lookup, removed_rows, written_rows
from dupeframe.schemas import STORE, STORE_KEY
from dupeframe.staging import stage

_MARKER = "_layout.json"
_ROW = ("filepath", "size", "mtime", "hash")
_COLUMNS = "filepath string, size bigint, mtime double, hash string, removed boolean, layer int"

#: Rows of one algorithm for which it gets one more bucket, when a full set is written.
BUCKET_ROWS_KEY = "spark.dupeframe.storeBucketRows"
BUCKET_ROWS = 1_000_000
#: Changes are merged when they are more than this share of the full set, or in more folders.
MERGE_SHARE, MERGE_FOLDERS = 0.25, 8
ATTEMPTS = 20


def _layout() -> dict:
    return {
        "columns": {f.name: f.dataType.simpleString() for f in STORE.fields},
        "key": list(STORE_KEY),
    }


@dataclass
class Part:
    """The rows of one algorithm: folders with their row counts, the full set first."""

    buckets: int
    folders: list[tuple[str, int]] = field(default_factory=list)


@dataclass
class Version:
    """``number`` is the last marker's, 0 for none; ``data`` that of the version with the rows."""

    number: int
    data: int | None
    parts: dict[str, Part]


class FingerprintStore:
    def __init__(self, spark: SparkSession, directory: str):
        self.spark = spark
        self.directory = directory.rstrip("/")

    # -- versions

    def _versions(self) -> list[int]:
        names = hadoop.list_names(self.spark, self.directory)
        return sorted(int(n[1:]) for n in names if re.fullmatch(r"v\d{8}", n))

    def _path(self, version: int) -> str:
        return f"{self.directory}/v{version:08d}"

    def _marker(self, version: int) -> dict | None:
        marker = f"{self._path(version)}/{_MARKER}"
        if not hadoop.exists(self.spark, marker):
            return None
        return json.loads(hadoop.read_text(self.spark, marker))

    def _state(self) -> Version:
        last = 0
        for version in reversed(self._versions()):
            marker = self._marker(version)
            if marker is None:
                continue
            last = last or version
            if "void" in marker:
                continue
            if not self._fits(version, marker):
                return Version(last, version, {})
            return Version(last, version, {
                name: Part(part["buckets"], [tuple(folder) for folder in part["folders"]])
                for name, part in marker["parts"].items()
            })
        return Version(last, None, {})

    @staticmethod
    def _fits(version: int, marker: dict) -> bool:
        """False for a marker of another layout, or one that was copied from elsewhere."""
        return (
            {key: marker.get(key) for key in ("columns", "key")} == _layout()
            and marker.get("version") == version and "parts" in marker
        )

    def current_version(self) -> int | None:
        return self._state().data

    def _publish(self, state: Version, parts: dict[str, Part]) -> bool:
        """Make ``parts`` the version after ``state``; False if another run was first."""
        number = state.number + 1
        while hadoop.exists(self.spark, self._path(number)):
            # the remains of a run that did not end: its number is closed, so they never count
            void = json.dumps({"void": True})
            if not hadoop.create_new(self.spark, f"{self._path(number)}/{_MARKER}", void):
                return False
            number += 1
        marker = _layout() | {"version": number, "parts": {
            name: {"buckets": part.buckets, "folders": part.folders} for name, part in parts.items()
        }}
        return hadoop.create_new(self.spark, f"{self._path(number)}/{_MARKER}", json.dumps(marker))

    def _commit(self, build: Callable[[Version], dict[str, Part] | None]) -> None:
        """Publish what ``build`` makes of the last version, again if another run was first.

        ``build`` may return None: there is nothing to publish.
        """
        for _ in range(ATTEMPTS):
            state = self._state()
            parts = build(state)
            if parts is None or self._publish(state, parts):
                return
        raise RuntimeError(f"store {self.directory}: other runs were first {ATTEMPTS} times")

    # -- folders

    def _write(
        self, rows: DataFrame, run: str, algorithm: str, buckets: int, layer: int = 0, dealt: bool = False
    ) -> tuple[str, int]:
        """Write ``rows`` (with ``removed``) as one file per bucket; rows that are already
        ``dealt`` into those buckets are not shuffled, and leave two. Returns the folder and its row
        count. ``layer`` is its place among the algorithm's folders."""
        folder = f"data/{run}/{quote(algorithm, safe='')}-{uuid.uuid4().hex[:8]}"
        name = f"spark_catalog.default.dupeframe_{uuid.uuid4().hex}"
        path = f"{self.directory}/{folder}"
        # only a table's writer makes bucketed files; the table itself goes, its files stay
        rows = rows.select(*_ROW, "removed", F.lit(layer).alias("layer"))
        rows = rows if dealt else rows.repartition(buckets, "filepath")
        rows.write.format("parquet").bucketBy(buckets, "filepath").sortBy("filepath").option(
            "path", path).saveAsTable(name)
        self.spark.sql(f"DROP TABLE {name}")
        return folder, self.spark.read.schema(_COLUMNS).parquet(path).count()

    def _folder(self, folder: str, buckets: int) -> DataFrame:
        name = f"spark_catalog.default.dupeframe_{uuid.uuid4().hex}"
        path = f"{self.directory}/{folder}".replace("\\", "\\\\").replace("'", "\\'")
        self.spark.sql(
            f"CREATE TABLE {name} ({_COLUMNS}) USING parquet CLUSTERED BY (filepath) "
            f"SORTED BY (filepath) INTO {buckets} BUCKETS LOCATION '{path}'")
        rows = self.spark.table(name)
        self.spark.sql(f"DROP TABLE {name}")
        return rows

    def _layers(self, part: Part) -> tuple[DataFrame, DataFrame | None]:
        """The full set of an algorithm, in its buckets, and the last change of each changed path.

        Changes are few beside the full set, so only they are shuffled, never the full set.
        """
        full, *changes = [self._folder(folder, part.buckets) for folder, _ in part.folders]
        full = full.select(*_ROW)
        if not changes:
            return full, None
        last = F.max(F.struct("layer", *_ROW[1:], "removed")).alias("last")
        return full, reduce(DataFrame.unionByName, changes).groupBy("filepath").agg(last).select(
            "filepath", *[f"last.{name}" for name in (*_ROW[1:], "removed")])

    def _rows(self, part: Part) -> DataFrame:
        full, changes = self._layers(part)
        if changes is None:
            return full
        return full.join(changes.select("filepath"), "filepath", "left_anti").unionByName(
            changes.where("NOT removed").select(*_ROW))

    def _attach(self, items: DataFrame, part: Part) -> DataFrame:
        """``items`` with ``_stored``: size, mtime and hash of their path, or NULL."""
        full, changes = self._layers(part)
        stored = F.struct(*_ROW[1:])
        joined = items.join(
            full.select(F.col("filepath").alias("path"), stored.alias("_stored")), "path", "left")
        if changes is None:
            return joined
        changed = changes.select(F.col("filepath").alias("path"), stored.alias("_changed"), "removed")
        last = F.when(F.col("removed").isNull(), F.col("_stored")).when(~F.col("removed"), F.col("_changed"))
        return joined.join(changed, "path", "left").withColumn("_stored", last).drop("_changed", "removed")

    def _buckets(self, rows: int) -> int:
        """A power of two that grows with the rows, so that no bucket grows with the store."""
        each = int(self.spark.conf.get(BUCKET_ROWS_KEY, str(BUCKET_ROWS)))
        return 1 << max(0, (rows - 1) // each).bit_length()

    def _merged(self, part: Part, run: str, algorithm: str) -> Part:
        """``part`` as one full set; without a shuffle of the full set if the buckets' number stays."""
        buckets = self._buckets(sum(rows for _, rows in part.folders))
        rows = self._rows(part).withColumn("removed", F.lit(False))
        dealt = buckets == part.buckets
        return Part(buckets, [self._write(rows, run, algorithm, buckets, dealt=dealt)])

    def _with_changes(self, part: Part | None, changes: DataFrame, run: str, algorithm: str) -> Part | None:
        """``part`` after ``changes`` (one row per path); None if there are none."""
        if part is None:
            fresh = changes.where("NOT removed")
            buckets = self._buckets(fresh.count())
            return Part(buckets, [self._write(fresh, run, algorithm, buckets)])
        folder = self._write(changes, run, algorithm, part.buckets, len(part.folders))
        if not folder[1]:
            hadoop.delete(self.spark, f"{self.directory}/{folder[0]}")
            return None
        after = Part(part.buckets, [*part.folders, folder])
        changed = sum(rows for _, rows in after.folders[1:])
        if changed > MERGE_SHARE * after.folders[0][1] or len(after.folders) > MERGE_FOLDERS:
            return self._merged(after, run, algorithm)
        return after

    # -- reading and writing

    def has(self, algorithm: str) -> bool:
        return algorithm in self._state().parts

    def read(self, algorithm: str | None = None) -> DataFrame:
        """All rows, or those of one algorithm, from its folders alone.

        A join of the rows of one algorithm on ``filepath`` shuffles the other side only.
        """
        state = self._state()
        names = sorted(state.parts) if algorithm is None else [algorithm] * (algorithm in state.parts)
        if not names:
            return self.spark.createDataFrame([], STORE)
        return reduce(DataFrame.unionByName, [
            self._rows(state.parts[name]).withColumn("algorithm", F.lit(name)) for name in names
        ]).select(*STORE.names)

    def replace(self, rows: DataFrame) -> DataFrame:
        """Make ``rows`` the whole store, whatever other runs wrote; returns a reader."""
        rows = stage(rows.select(*STORE.names), "store-rows")
        counts = dict(rows.groupBy("algorithm").count().collect())
        run = uuid.uuid4().hex
        parts = {}
        for name, count in counts.items():
            buckets = self._buckets(count)
            own = rows.where(F.col("algorithm") == name).withColumn("removed", F.lit(False))
            parts[name] = Part(buckets, [self._write(own, run, name, buckets)])
        self._commit(lambda state: parts)
        return self.read()

    def upsert(self, fresh: DataFrame) -> DataFrame:
        """Insert or replace rows by (filepath, algorithm); ``fresh`` has one row per key."""
        fresh = stage(fresh.select(*STORE.names).withColumn("removed", F.lit(False)), "store-fresh")
        names = [row[0] for row in fresh.select("algorithm").distinct().collect()]
        run = uuid.uuid4().hex

        def build(state: Version) -> dict[str, Part]:
            made = {name: self._with_changes(
                state.parts.get(name), fresh.where(F.col("algorithm") == name), run, name)
                for name in names}
            return state.parts | {name: part for name, part in made.items() if part is not None}

        self._commit(build)
        return self.read()

    def apply_scan(
        self, found: DataFrame, algorithm: str, roots: list[str] | None, file_roots: list[str] = ()
    ) -> None:
        """Record a scan: ``found`` (staged, one row per path, each with a hash) under ``algorithm``;
        rows of any algorithm beneath the roots go if their path was not found.

        Only rows that differ are written. If another run publishes first, the differences to its
        version are taken again.
        """
        run = uuid.uuid4().hex

        def build(state: Version) -> dict[str, Part] | None:
            made = {}
            for name in sorted({algorithm, *state.parts}):
                part = state.parts.get(name)
                if part is None:
                    changes = found.select(
                        F.col("path").alias("filepath"), "size", "mtime", "hash", F.lit(False).alias("removed"))
                else:
                    changes = self._scan_changes(part, found, roots, file_roots, name == algorithm)
                made[name] = self._with_changes(part, changes, run, name)
            changed = {name: part for name, part in made.items() if part is not None}
            return state.parts | changed if changed else None

        self._commit(build)

    def _scan_changes(
        self, part: Part, found: DataFrame, roots: list[str] | None, file_roots: list[str], fresh: bool
    ) -> DataFrame:
        """``scan_changes`` of the algorithm's current rows; joins leave the full set in its buckets."""
        full, changes = self._layers(part)
        seen = found.select(F.col("path").alias("filepath"))
        layers = [full] if changes is None else [
            full.join(changes.select("filepath"), "filepath", "left_anti"),
            changes.where("NOT removed").select(*_ROW),
        ]
        made = [removed_rows(layer, seen, roots, file_roots) for layer in layers]
        if fresh:
            made.append(written_rows(self._attach(found, part)))
        return reduce(DataFrame.unionByName, made)

    def look_up(self, manifest: DataFrame, algorithm: str) -> DataFrame:
        """``operators.cache.lookup`` in this store: only the manifest is shuffled."""
        part = self._state().parts.get(algorithm)
        if part is None:
            return lookup(manifest, self.spark.createDataFrame([], STORE), algorithm)
        return answered(self._attach(manifest, part), manifest.columns)

    def compact(self) -> None:
        """Merge all changes into full sets, whose number of buckets follows their size."""
        run = uuid.uuid4().hex

        def build(state: Version) -> dict[str, Part] | None:
            merged = {name: self._merged(part, run, name)
                      for name, part in state.parts.items() if len(part.folders) > 1}
            return state.parts | merged if merged else None

        self._commit(build)

    def vacuum(self, keep: int = 2, older_than: float = 86400) -> None:
        """Delete all but the last ``keep`` versions, and data that none of them lists.

        Data of runs that have not ended yet is not listed either, so it must be ``older_than``
        seconds old. Not while another run reads an older version.
        """
        markers = {version: self._marker(version) for version in self._versions()}
        complete = [v for v, marker in markers.items() if marker is not None and "void" not in marker]
        if not complete:
            return
        kept = complete[-keep:]
        for version in markers:
            if version not in kept and version < complete[-1]:
                hadoop.delete(self.spark, self._path(version))
        listed = {
            folder for version in kept for part in markers[version].get("parts", {}).values()
            for folder, _ in part["folders"]
        }
        before = time.time() - older_than
        for run in hadoop.list_names(self.spark, f"{self.directory}/data"):
            below = f"{self.directory}/data/{run}"
            names = hadoop.list_names(self.spark, below)
            unused = [name for name in names if f"data/{run}/{name}" not in listed]
            if hadoop.modified(self.spark, below) > before:
                continue
            for name in [""] if len(unused) == len(names) else unused:
                hadoop.delete(self.spark, f"{below}/{name}".rstrip("/"))


def open_store(spark: SparkSession, directory: str) -> FingerprintStore:
    """Open or create a store. An unusable location is an error, never a scan without store."""
    store = FingerprintStore(spark, directory)
    try:
        if hadoop.exists(spark, directory) and not hadoop.is_directory(spark, directory):
            raise OSError("not a directory")
        hadoop.mkdirs(spark, directory)
        if not hadoop.is_directory(spark, directory):
            raise OSError("the folder could not be created")
        ensure_store_schema(store)
    except Exception as error:
        raise RuntimeError(f"cannot open fingerprint store {directory}: {error}") from error
    return store


def ensure_store_schema(store: FingerprintStore) -> bool:
    """Start an empty version if the current one has other columns or another key.

    Returns True if the store was reset.
    """
    version = store.current_version()
    if version is None:
        foreign = [
            n for n in hadoop.list_names(store.spark, store.directory)
            if n[0] not in "_." and n != "data"
        ]
        if not foreign:
            return False
    elif store._fits(version, store._marker(version)) and _stored_columns_match(store):
        return False
    store.replace(store.spark.createDataFrame([], STORE))
    return True


def _stored_columns_match(store: FingerprintStore) -> bool:
    """True if the files of the full sets have the columns that their version states."""
    expected = store.spark.createDataFrame([], _COLUMNS).schema
    for part in store._state().parts.values():
        folder, rows = part.folders[0]
        if rows:
            stored = store.spark.read.parquet(f"{store.directory}/{folder}").schema
            if {(f.name, f.dataType) for f in stored} != {(f.name, f.dataType) for f in expected}:
                return False
    return True
