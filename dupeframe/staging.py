"""Staged tables: intermediate results written once to shared storage.

A staged table cuts lineage, so a lost executor costs a re-read and not a second pass over
content. It is columnar, so later readers prune columns, and its size on disk gives the
planner a measured basis for join choices.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from dupeframe import hadoop

_local_roots: dict[str, str] = {}
CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage_root(spark: SparkSession) -> str:
    """Folder for staged tables: ``spark.checkpoint.dir``, or a temporary one in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if configured:
        return f"{configured.rstrip('/')}/dupeframe-{app}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="dupeframe-")
    return _local_roots[app]


def stage_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the staging folder."""
    return f"{stage_root(spark)}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and return a reader of what was written. The shuffle files of the write go
    with its end, so that disk holds those of one step at a time."""
    spark = df.sparkSession
    path = stage_path(spark, label)
    before = spark.conf.get(CLEANUP_KEY, None)
    spark.conf.set(CLEANUP_KEY, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP_KEY)
        else:
            spark.conf.set(CLEANUP_KEY, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_stages(spark: SparkSession) -> None:
    """Delete this application's staged tables, after the last use of their readers."""
    hadoop.delete(spark, stage_root(spark))


def with_global_index(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Add a gap-free 1-based LONG position in ``order`` without a one-task window.

    A global sort range-partitions the rows; monotonically_increasing_id() then holds the
    partition number (upper bits) and the position in it (lower 33 bits). The result is staged
    before partition sizes are read, as a second sort could sample other ranges. ``order`` must
    be unique, which also keeps any range from being larger than the others. Only one row per
    partition reaches the driver.
    """
    return global_index(df, order, name)[0]


def global_index(
    df: DataFrame, order: list[str], name: str, largest: str | None = None
) -> tuple[DataFrame, int, int]:
    """``with_global_index`` plus the number of rows and the maximum of column ``largest``."""
    spark = df.sparkSession
    staged = stage(df.orderBy(*order).withColumn("_rid", F.monotonically_increasing_id()), name)
    part = F.shiftright("_rid", 33)
    local = F.col("_rid").bitwiseAND(F.lit((1 << 33) - 1))
    maximum = F.lit(0) if largest is None else F.max(largest)
    sizes = sorted(
        staged.groupBy(part.alias("part"))
        .agg(F.count(F.lit(1)).alias("rows"), maximum.alias("largest")).collect()
    )
    starts, total = [], 0
    for number, rows, _ in sizes:
        starts.append((number, total))
        total += rows
    highest = max((row["largest"] for row in sizes), default=0)
    if len(sizes) <= 1:
        return staged.withColumn(name, local + 1).drop("_rid"), total, highest
    offsets = spark.createDataFrame(starts, "_part long, _offset long")
    indexed = (
        staged.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + local + 1)
        .drop("_rid", "_part", "_offset")
    )
    return indexed, total, highest
