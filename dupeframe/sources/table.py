"""Manifests from tables that hold one item per row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def manifest_from_table(
    df: DataFrame,
    path: Column,
    content: Column | str,
    size: Column | None = None,
    mtime: Column | None = None,
    root: Column | None = None,
    root_ord: Column | None = None,
) -> DataFrame:
    """Manifest of ``df`` plus its ``content``.

    ``size`` defaults to the bytes of the content, for which the content must be read; give a
    stored size where there is one. Without ``root`` every item belongs to root ``/``.
    """
    body = F.col(content) if isinstance(content, str) else content
    return df.select(
        path.alias("path"),
        (F.lit("/") if root is None else root).alias("root"),
        (F.lit(0) if root_ord is None else root_ord).cast("int").alias("root_ord"),
        (F.octet_length(body) if size is None else size).cast("long").alias("size"),
        (F.lit(0.0) if mtime is None else mtime).cast("double").alias("mtime"),
        body.alias("content"),
    )


def manifest_from_objects(spark: SparkSession, includes: list[str]) -> DataFrame:
    """Manifest with content of the objects below ``includes``, for stores that executors reach
    through Spark and not as a mounted tree.

    Sizes and times come from the listing, so scan with ``size_prefilter=True``: content is
    then read for repeated sizes only. Differences from ``read_tree``: empty objects and names
    that start with ``.`` or ``_`` are left out, links are followed, and an object must fit in
    one row (2 GiB).
    """
    listed = [
        manifest_from_table(
            spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root),
            F.col("path"), "content",
            size=F.col("length"),
            mtime=F.unix_micros("modificationTime") / 1000000,
            root=F.lit(root), root_ord=F.lit(order),
        )
        for order, root in enumerate(includes)
    ]
    return reduce(DataFrame.unionByName, listed)
