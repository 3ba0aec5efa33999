"""What a selection frees, and what it leaves."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def reclaim_plan(selection: DataFrame, members: DataFrame) -> DataFrame:
    """The confirm list: every path marked for trash with ``exists`` and ``size``, by path."""
    trash = selection.where("decision = 'trash'").select("hash", "path").distinct()
    sizes = members.select("hash", "path", "exists", "size")
    return (
        trash.join(sizes, ["hash", "path"], "left")
        .groupBy("path")
        .agg(
            F.coalesce(F.bool_or("exists"), F.lit(False)).alias("exists"),
            F.coalesce(F.max("size"), F.lit(0)).cast("long").alias("size"),
        )
        .orderBy("path")
    )


def reclaim_totals(plan: DataFrame) -> DataFrame:
    """One row: all marked paths, the existing ones among them, and their bytes."""
    return plan.agg(
        F.count(F.lit(1)).alias("n_marked"),
        F.count_if("exists").alias("n_existing"),
        F.coalesce(F.sum(F.when(F.col("exists"), F.col("size"))), F.lit(0)).cast("long")
        .alias("bytes"),
    )


def survivors(manifest: DataFrame, plan: DataFrame) -> DataFrame:
    """The items that are left once a plan is carried out."""
    return manifest.join(plan.select("path"), "path", "left_anti").select(*manifest.columns)


def moved_totals(outcome: DataFrame) -> DataFrame:
    """One row: files really moved and the bytes they held."""
    moved = F.col("status") == "moved"
    return outcome.agg(
        F.count_if(moved).alias("count"),
        F.coalesce(F.sum(F.when(moved, F.col("bytes"))), F.lit(0)).cast("long")
        .alias("reclaimed_bytes"),
    )
