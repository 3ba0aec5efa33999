"""Decisions handed over as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from dupeframe.schemas import ACTIONS


def read_actions(spark: SparkSession, path: str) -> DataFrame:
    """Read ``{"actions": {hash: {keep, trash}}}`` documents as a selection."""
    return parse_actions(spark.read.text(path, wholetext=True), "value")


def parse_actions(payloads: DataFrame, column: str) -> DataFrame:
    """Selection rows ``hash, path, decision`` of JSON payloads; ``keep`` is a path or a list.

    Of a hash that a payload has several times, the last entry counts.
    """
    numbered = payloads.select(
        F.monotonically_increasing_id().alias("payload"),
        F.from_json(F.col(column), ACTIONS)["actions"].alias("actions"))
    entries = numbered.select(
        "payload", F.posexplode("actions").alias("place", "hash", "detail")
    ).groupBy("payload", "hash").agg(F.max_by("detail", "place").alias("detail"))
    keep = F.coalesce(
        F.when(F.col("detail.keep").startswith("["), F.from_json("detail.keep", "array<string>")),
        F.array("detail.keep"),
    )
    decisions = F.array(
        F.struct(F.lit("keep").alias("decision"), keep.alias("paths")),
        F.struct(F.lit("trash").alias("decision"), F.col("detail.trash").alias("paths")),
    )
    return (
        entries.select("hash", F.explode(decisions).alias("own"))
        .select("hash", F.explode("own.paths").alias("path"), "own.decision")
        .where(F.col("path").isNotNull())
    )
