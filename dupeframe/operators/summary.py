"""Run facts and per-group display values."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def scan_summary(fingerprints: DataFrame, groups: DataFrame) -> DataFrame:
    """One row: ``total_files, duplicate_groups``."""
    totals = [
        fingerprints.select(F.lit(1).alias("file"), F.lit(0).alias("dup_group")),
        groups.select(F.lit(0).alias("file"), F.lit(1).alias("dup_group")),
    ]
    return totals[0].unionByName(totals[1]).agg(
        F.coalesce(F.sum("file"), F.lit(0)).cast("long").alias("total_files"),
        F.coalesce(F.sum("dup_group"), F.lit(0)).cast("long").alias("duplicate_groups"),
    )


def group_sizes(members: DataFrame) -> DataFrame:
    """Size of the first member of each group, NULL if it is not known."""
    return members.groupBy("group_idx", "hash").agg(F.min_by("size", "member_pos").alias("size"))
