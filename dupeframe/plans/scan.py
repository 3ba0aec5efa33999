"""Scans: from items to numbered duplicate groups."""

from __future__ import annotations

import datetime
import os
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from dupeframe.functions.fingerprint import check_algorithm, fingerprint
from dupeframe.operators.bitmap import among
from dupeframe.operators.groups import (
    group_table,
    number_groups,
    number_members,
    size_candidates,
)
from dupeframe.operators.scope import dedupe_paths, exclude, in_scope
from dupeframe.schemas import MANIFEST
from dupeframe.sources.files import fingerprint_files
from dupeframe.sources.places import is_uri, resolved, stat
from dupeframe.sources.report import Summary, check_report_paths, write_reports
from dupeframe.sources.store import FingerprintStore, open_store
from dupeframe.sources.tree import read_tree
from dupeframe.staging import stage, stage_root
from dupeframe.streaming.progress import ReadProgress, observe_scan, reported


@dataclass
class ScanResult:
    """``fingerprints``, ``groups`` and ``members`` are DataFrames over staged tables.

    ``fingerprints`` has a row for every item of the scan; ``hash`` is NULL where a size that
    occurs once, or an error, left an item without one. ``errors`` has ``path, error`` of the
    items that could not be read, None where nothing could be skipped.
    """

    fingerprints: DataFrame
    groups: DataFrame
    members: DataFrame
    total_files: int
    cache_hits: int
    duplicate_groups: int
    scan_folders: list[str]
    algorithm: str
    scan_time: str
    elapsed_seconds: float
    errors: DataFrame | None = None

    @property
    def hit_rate(self) -> float | None:
        return self.cache_hits / self.total_files * 100 if self.total_files else None

    def summary(self) -> Summary:
        return Summary(
            self.total_files, self.duplicate_groups, self.elapsed_seconds,
            self.scan_folders, self.algorithm, self.scan_time,
        )

    def write(self, paths: list[str], single_file: bool = False) -> None:
        write_reports(self.members, self.summary(), paths, single_file)


def scan_table(
    manifest: DataFrame,
    includes: list[str] | None = None,
    excludes: list[str] = (),
    algorithm: str = "xxh3",
    store: str | None = None,
    size_prefilter: bool = False,
    paths_unique: bool = False,
    outputs: list[str] = (),
) -> ScanResult:
    """Scan a table: ``manifest`` has the manifest columns and ``content``.

    Content is read once and never shuffled. Scopes are predicates in the scan stage, content
    becomes a fingerprint there, and only metadata moves on. ``size_prefilter`` skips hashing
    items of a size that occurs once; it pays where ``size`` is a stored column, since
    otherwise the sizes cost one more pass over the content. ``paths_unique`` saves the
    shuffle that removes repeated paths. Store rows of vanished items are pruned beneath
    ``includes``; without includes the scan answers for all paths.
    """
    started = time.perf_counter()
    check_algorithm(algorithm)
    check_report_paths(list(outputs))
    opened = open_store(manifest.sparkSession, store) if store else None
    scoped = exclude(manifest, [*excludes, *(_spellings(store) if store else [])], store)
    if includes is not None:
        scoped = in_scope(scoped, includes)
    if opened is not None:
        hashed = _reuse_table(scoped, opened, algorithm, paths_unique)
    else:
        wanted = scoped
        if size_prefilter:
            items = stage(scoped.select(*MANIFEST.names), "manifest")
            wanted = _prefilter_content(scoped, items)
        hashed = _hash_table(wanted, algorithm)
        if not paths_unique:
            hashed = dedupe_paths(hashed)
        if size_prefilter:
            hashed = _with_hashes(items if paths_unique else dedupe_paths(items), hashed)
        hashed = hashed.withColumn("hit", F.lit(False))
    return _finish(hashed, includes, (), algorithm, opened, outputs, started)


def scan_tree(
    spark: SparkSession,
    includes: list[str],
    excludes: list[str] = (),
    algorithm: str = "xxh3",
    store: str | None = None,
    size_prefilter: bool = True,
    on_error: str = "fail",
    outputs: list[str] = (),
    on_progress: Callable[[ReadProgress], None] | None = None,
    every: float = 1.0,
) -> ScanResult:
    """Scan file trees that all executors mount, or the objects below URIs of stores.

    Sizes come from the listing, so files of a size that occurs once are not read at all. With
    a store every file is fingerprinted, as the store must hold all of them. ``on_progress`` is
    called ``every`` so many seconds while files are read.
    """
    started = time.perf_counter()
    check_algorithm(algorithm)
    check_report_paths(list(outputs))
    progress = ReadProgress(spark) if on_progress else None
    opened = open_store(spark, store) if store else None
    # the library's own files are no items where a root is above them
    own = [store] * bool(store)
    staged = stage_root(spark)
    if not any(f"{resolved(local_path(root))}/".startswith(f"{resolved(local_path(staged))}/") for root in includes):
        own.append(staged)
    dropped = [*excludes, *[name for path in own for name in _spellings(path)]]
    manifest = read_tree(spark, includes, dropped)
    if opened is not None:
        looked = stage(opened.look_up(manifest, algorithm), "lookup")
        read = _read(looked.where(~F.col("hit")).select(*MANIFEST.names), algorithm, on_error, progress, on_progress, every)
        fresh = read.drop("error").withColumn("hit", F.lit(False))
        hashed = looked.where("hit").unionByName(fresh)
    else:
        manifest = stage(manifest, "manifest")
        wanted = stage(size_candidates(manifest), "candidates") if size_prefilter else manifest
        read = _read(wanted, algorithm, on_error, progress, on_progress, every)
        hashed = read.drop("error")
        if size_prefilter:
            hashed = _with_hashes(manifest, hashed)
        hashed = hashed.withColumn("hit", F.lit(False))
    errors = read.where(F.col("error").isNotNull()).select("path", "error")
    folders = [resolved(root) for root in includes]
    files = [root for root in folders if stat(root)[0] == "file"]
    return _finish(hashed, folders, files, algorithm, opened, outputs, started, errors)


def _read(
    wanted: DataFrame, algorithm: str, on_error: str, progress: ReadProgress | None,
    on_progress: Callable[[ReadProgress], None] | None, every: float,
) -> DataFrame:
    """The staged fingerprints of the files ``wanted``."""
    if progress is None:
        return stage(fingerprint_files(wanted, algorithm, on_error), "read")
    progress.total = wanted.count()
    with reported(progress, on_progress, every):
        return stage(fingerprint_files(wanted, algorithm, on_error, progress), "read")


def _spellings(path: str) -> list[str]:
    """A path as a mounted one and as a URI, as items may be named either way."""
    local = local_path(path)
    return [local] if is_uri(local) else [local, f"file:{local}", f"file://{os.path.realpath(local)}"]


def local_path(name: str) -> str:
    """A ``file:`` URI as a path; other names as they are."""
    from urllib.parse import unquote, urlparse

    parsed = urlparse(name)
    return unquote(parsed.path) if parsed.scheme == "file" and not parsed.netloc else name


def _with_hashes(items: DataFrame, hashed: DataFrame) -> DataFrame:
    """All items, with the hashes of those that have one; paths are unique on both sides."""
    return items.join(hashed.select("path", "hash"), "path", "left").select(*items.columns, "hash")


def _hash_table(manifest: DataFrame, algorithm: str) -> DataFrame:
    return manifest.select(
        *MANIFEST.names, fingerprint(F.col("content"), algorithm).alias("hash")
    )


def _prefilter_content(manifest: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """Keep rows of repeated sizes (and some others, which form no group), where they are read.
    ``items`` is the staged metadata, so that sizes are derived from the content once."""
    items = manifest if items is None else items
    sizes = items.groupBy("size").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("size")
    return among(manifest, F.col("size"), stage(sizes, "sizes"))


def _reuse_table(
    manifest: DataFrame, opened: FingerprintStore, algorithm: str, paths_unique: bool
) -> DataFrame:
    """Fingerprints of a table, computed only for rows the store does not answer.

    The look-up joins metadata. A filter of the misses is broadcast, so that content is hashed where
    it is read and does not move; what passes the filter by chance is dropped by the join on the
    path. Stored hashes win for hits.
    """
    def one_per_path(rows: DataFrame) -> DataFrame:
        return rows if paths_unique else dedupe_paths(rows)

    if not opened.has(algorithm):
        return one_per_path(_hash_table(manifest, algorithm)).withColumn("hit", F.lit(False))
    looked = stage(
        opened.look_up(one_per_path(manifest.select(*MANIFEST.names)), algorithm), "lookup")
    misses = looked.where(~F.col("hit")).select(*MANIFEST.names)
    to_hash = among(manifest, F.col("path"), misses.select("path"))
    hashed = one_per_path(_hash_table(to_hash, algorithm)).select("path", "hash")
    fresh = misses.join(hashed, "path").withColumn("hit", F.lit(False))
    return looked.where("hit").unionByName(fresh)


def _finish(
    hashed: DataFrame,
    roots: list[str] | None,
    file_roots: list[str],
    algorithm: str,
    opened: FingerprintStore | None,
    outputs: list[str],
    started: float,
    errors: DataFrame | None = None,
) -> ScanResult:
    observed, progress = observe_scan(hashed, F.col("hit"))
    fingerprints = stage(observed, "fingerprints")
    groups, n_groups, largest = number_groups(group_table(fingerprints))
    result = ScanResult(
        fingerprints=fingerprints,
        groups=groups,
        members=number_members(fingerprints, groups, largest),
        total_files=progress.get["total_files"],
        cache_hits=progress.get["cache_hits"],
        duplicate_groups=n_groups,
        scan_folders=list(roots or []),
        algorithm=algorithm,
        scan_time=datetime.datetime.now().strftime("%Y-%m-%d %H:%M:%S"),
        elapsed_seconds=time.perf_counter() - started,
        errors=errors,
    )
    if opened is not None:
        directories = None if roots is None else [root for root in roots if root not in file_roots]
        opened.apply_scan(
            fingerprints.where(F.col("hash").isNotNull()), algorithm, directories, file_roots)
    if outputs:
        result.write(list(outputs))
    return result
