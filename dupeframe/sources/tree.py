"""File trees on a file system that the executors mount, and objects of stores."""

from __future__ import annotations

import os
from collections import deque
from functools import reduce
from itertools import batched
from stat import S_ISDIR, S_ISREG

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from dupeframe.schemas import MANIFEST
from dupeframe.sources.places import absolute, is_uri, objects, resolved, stat
from dupeframe.staging import stage

_FOUND = (
    "kind string, path string, root string, root_ord int, size long, mtime double, names array<string>"
)
_ROWS_PER_BATCH = 10_000
_NAMES_PER_ROW = 1_000


def read_tree(
    spark: SparkSession,
    includes: list[str],
    excludes: list[str] = (),
    entries_per_task: int = 50_000,
) -> DataFrame:
    """Manifest of all regular files equal to or beneath ``includes``, which are paths that the
    executors mount, or URIs of stores.

    Hidden and empty files are listed; symlinked files are skipped and symlinked directories
    are not entered; absent roots and unreadable directories are passed over; excluded
    directories are not entered. A path below several roots is listed once, for its first root.

    Listing runs in rounds. A task walks its directories until it has seen
    ``entries_per_task`` entries and hands back the directories it has not entered, and the names
    of a directory that go past the allowance in chunks, which the next round spreads over all
    tasks. So one subtree holding most files is split again and again, at any depth, and the files
    of one flat directory are looked at by many tasks; only their names are read by one. The
    allowance doubles per round, which keeps rounds few. (A store answers with sizes and times, so
    its names need no second look.)
    """
    roots = [(i, absolute(root)) for i, root in enumerate(includes)]
    dropped = [absolute(path) for path in excludes]
    tasks = spark.sparkContext.defaultParallelism * 4
    frontier = spark.createDataFrame(
        [("root", path, path, order, None, None, None) for order, path in roots], _FOUND
    )
    waiting = len(roots)
    rounds = []
    while True:
        walk = _walker(roots, dropped, entries_per_task)
        spread = frontier.repartition(max(1, min(tasks, waiting)))
        found = stage(spread.mapInArrow(walk, _FOUND), "tree")
        rounds.append(found.where("kind = 'file'").select(*MANIFEST.names))
        frontier = found.where("kind IN ('dir', 'names')")
        waiting = frontier.count()
        if not waiting:
            return reduce(DataFrame.unionByName, rounds)
        entries_per_task *= 2


def stat_paths(paths: DataFrame) -> DataFrame:
    """``path, size, mtime`` of those ``paths`` that are files now."""
    def look(batches):
        for batch in batches:
            rows = []
            for path in batch.column("path").to_pylist():
                if path is None:
                    continue
                kind, size, mtime = stat(path)
                if kind == "file":
                    rows.append((path, size, mtime))
            yield _batch(rows, _STATS)

    return paths.select("path").mapInArrow(look, "path string, size long, mtime double")


_STATS = pa.schema([("path", pa.string()), ("size", pa.int64()), ("mtime", pa.float64())])
_ENTRIES = pa.schema([
    ("kind", pa.string()), ("path", pa.string()), ("root", pa.string()),
    ("root_ord", pa.int32()), ("size", pa.int64()), ("mtime", pa.float64()),
    ("names", pa.list_(pa.string())),
])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in schema]
    return pa.record_batch(
        [pa.array(list(c), type=f.type) for c, f in zip(columns, schema)], schema=schema
    )


def _beneath(path: str, bases) -> bool:
    return any(path == base or path.startswith(base.rstrip("/") + "/") for base in bases)


def _walker(roots: list[tuple[int, str]], excludes: list[str], allowance: int):
    """A task that lists directories within ``allowance`` entries."""

    def walk(batches):
        places = [(order, resolved(path)) for order, path in roots]
        dropped = {resolved(path) for path in excludes}
        seen = 0
        rows: list[tuple] = []
        for batch in batches:
            for kind, path, root, order, names in zip(
                *(batch.column(name).to_pylist() for name in ("kind", "path", "root", "root_ord", "names"))
            ):
                # what lies at or beneath an earlier root belongs to that root
                earlier = {base for number, base in places if number < order}
                if kind == "root":
                    path = root = resolved(path)
                    if _beneath(path, earlier) or _beneath(path, dropped):
                        continue
                    found, size, mtime = stat(path)
                    if found == "file":
                        rows.append(("file", path, root, order, size, mtime, None))
                    if found != "dir":
                        continue
                pending = deque([path] if names is None else [])
                directory, listed = path, iter(names or ())
                while seen < allowance:
                    entry = next(listed, None)
                    if entry is None:
                        if not pending:
                            break
                        directory = pending.popleft()
                        listed = objects(directory) if is_uri(directory) else _entries(directory)
                        continue
                    seen += 1
                    found, place, size, mtime = _look(directory, entry)
                    if place in earlier or place in dropped:
                        continue
                    if found == "file":
                        rows.append(("file", place, root, order, size, mtime, None))
                    elif found == "dir" and len(pending) < allowance:
                        pending.append(place)
                    elif found == "dir":
                        rows.append(("dir", place, root, order, None, None, None))
                    if len(rows) >= _ROWS_PER_BATCH:
                        yield _batch(rows, _ENTRIES)
                        rows = []
                if is_uri(directory):  # the rest of this answer of the store, with all it says
                    left = (x for x in listed if x[1] not in earlier and x[1] not in dropped)
                    rows.extend((found, place, root, order, size, mtime, None)
                                for found, place, size, mtime in left if found != "none")
                else:  # the rest of this directory's names, not looked at
                    for chunk in batched((getattr(x, "name", x) for x in listed), _NAMES_PER_ROW):
                        rows.append(("names", directory, root, order, None, None, list(chunk)))
                        if len(rows) * _NAMES_PER_ROW >= _ROWS_PER_BATCH:
                            yield _batch(rows, _ENTRIES)
                            rows = []
                rows.extend(("dir", place, root, order, None, None, None) for place in pending)
        yield _batch(rows, _ENTRIES)

    return walk


def _look(directory: str, entry: os.DirEntry | str | tuple) -> tuple[str, str, int, float]:
    """(kind, path, size, mtime) of an entry of a directory, without following links; the kind is
    file, dir or none."""
    if isinstance(entry, tuple):  # a store has said it all
        return entry
    place = os.path.join(directory, getattr(entry, "name", entry))
    try:
        if isinstance(entry, os.DirEntry):
            if entry.is_symlink() or not entry.is_file(follow_symlinks=False):
                is_dir = entry.is_dir(follow_symlinks=False)
                return ("dir" if is_dir else "none"), place, 0, 0.0
            status = entry.stat(follow_symlinks=False)
        else:
            status = os.lstat(place)
    except (PermissionError, FileNotFoundError, NotADirectoryError):  # gone since it was listed
        return "none", place, 0, 0.0
    kind = "file" if S_ISREG(status.st_mode) else "dir" if S_ISDIR(status.st_mode) else "none"
    return kind, place, status.st_size, status.st_mtime


def _entries(directory: str):
    try:
        with os.scandir(directory) as entries:
            yield from entries
    except (PermissionError, FileNotFoundError, NotADirectoryError):
        return
