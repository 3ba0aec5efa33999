"""Reuse of stored fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from dupeframe.functions.paths import is_beneath_any

# Fixed value: seconds by which a stored time may differ and still count as unchanged.
MTIME_TOLERANCE = 1e-4


def is_fresh(size: Column, mtime: Column, stored_size: Column, stored_mtime: Column) -> Column:
    return (size == stored_size) & (F.abs(mtime - stored_mtime) < F.lit(MTIME_TOLERANCE))


def lookup(manifest: DataFrame, store: DataFrame, algorithm: str) -> DataFrame:
    """Add ``hash`` (NULL if it must be computed) and ``hit`` to each item.

    The algorithm filter prunes store partitions; paths are unique on both sides, so the join
    has no hot key. An empty stored hash is a miss.
    """
    stored = store.where(
        (F.col("algorithm") == F.lit(algorithm)) & (F.col("hash") != "")
    ).select(F.col("filepath").alias("path"), F.struct("size", "mtime", "hash").alias("_stored"))
    return answered(manifest.join(stored, "path", "left"), manifest.columns)


def answered(attached: DataFrame, columns: list[str]) -> DataFrame:
    """``columns``, ``hash`` and ``hit`` of items that have the store's row of their path as
    ``_stored`` (size, mtime, hash; NULL without one)."""
    stored = F.col("_stored")
    fresh = is_fresh(F.col("size"), F.col("mtime"), stored["size"], stored["mtime"]) & (stored["hash"] != "")
    return (
        attached.withColumn("hash", F.when(fresh, stored["hash"]))
        .withColumn("hit", F.col("hash").isNotNull())
        .select(*columns, "hash", "hit")
    )


def cache_stats(looked_up: DataFrame) -> DataFrame:
    """One row: ``hits, total, hit_rate`` in percent (NULL for an empty scan)."""
    return looked_up.agg(
        F.count_if("hit").alias("hits"), F.count(F.lit(1)).alias("total")
    ).withColumn(
        "hit_rate", F.when(F.col("total") > 0, F.col("hits") / F.col("total") * 100)
    )


def latest_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row per key in ``order``, combined on the map side."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    return (
        df.groupBy(*keys)
        .agg(F.max(F.struct(*order, *rest)).alias("last"))
        .select(*keys, "last.*")
        .select(*df.columns)
    )


def upsert(base: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Insert or replace by ``keys``; ``fresh`` has one row per key."""
    kept = base.join(fresh.select(*keys), keys, "left_anti")
    return kept.unionByName(fresh.select(*base.columns))


def in_prune_scope(path: Column, roots: list[str] | None, file_roots: list[str] = ()) -> Column:
    """Rows a scan of ``roots`` answers for: beneath a directory (or vanished) root, or equal
    to a root that is a file. Prefixes are literal and case-sensitive. None is every path."""
    if roots is None:
        return F.lit(True)
    exact = path.isin(*file_roots) if file_roots else F.lit(False)
    return is_beneath_any(path, list(roots)) | exact


def prune(
    store: DataFrame, roots: list[str] | None, keep: DataFrame, file_roots: list[str] = ()
) -> DataFrame:
    """Store rows that survive a scan: out of its scope, or of a path it found.

    Rows of all algorithms go together, as only the path decides.
    """
    found = keep.select(F.col("path").alias("filepath")).distinct().withColumn("_found", F.lit(True))
    scope = in_prune_scope(F.col("filepath"), roots, file_roots)
    return (
        store.join(found, "filepath", "left")
        .where(~scope | F.col("_found").isNotNull())
        .select(*store.columns)
    )


def stale_rows(
    store: DataFrame, roots: list[str] | None, keep: DataFrame, file_roots: list[str] = ()
) -> DataFrame:
    """The rows that ``prune`` removes."""
    found = keep.select(F.col("path").alias("filepath"))
    return store.where(in_prune_scope(F.col("filepath"), roots, file_roots)).join(
        found, "filepath", "left_anti"
    ).select(*store.columns)


def merge_scan(
    store: DataFrame, found: DataFrame, algorithm: str, roots: list[str] | None,
    file_roots: list[str] = (),
) -> DataFrame:
    """``upsert`` and ``prune`` after a scan in one join: the store with the fingerprints
    ``found`` (all items of the scan, one row per path) under ``algorithm``."""
    fresh = found.select(
        F.col("path").alias("filepath"), "size", "mtime", "hash",
        F.lit(algorithm).alias("algorithm"),
    )
    seen = fresh.select("filepath", F.lit(True).alias("_found"))
    outside = ~in_prune_scope(F.col("filepath"), roots, file_roots)
    kept = store.join(seen, "filepath", "left").where(
        F.when(F.col("_found"), F.col("algorithm") != F.lit(algorithm)).otherwise(outside)
    )
    return kept.select(*store.columns).unionByName(fresh.select(*store.columns))


def removed_rows(
    current: DataFrame, seen: DataFrame, roots: list[str] | None, file_roots: list[str] = ()
) -> DataFrame:
    """The rows of a scan's scope whose ``filepath`` was not ``seen``, marked as removed."""
    return current.where(in_prune_scope(F.col("filepath"), roots, file_roots)).join(
        seen, "filepath", "left_anti"
    ).select("filepath", "size", "mtime", "hash", F.lit(True).alias("removed"))


def written_rows(attached: DataFrame) -> DataFrame:
    """The rows of found items that differ from the store's row ``_stored``, or have none."""
    differs = ~F.struct("size", "mtime", "hash").eqNullSafe(F.col("_stored"))
    return attached.where(differs).select(
        F.col("path").alias("filepath"), "size", "mtime", "hash", F.lit(False).alias("removed"))
