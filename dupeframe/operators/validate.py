"""Checks that a selection is safe to carry out."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from dupeframe.operators.decisions import decision_sets
from dupeframe.staging import stage, with_global_index

# Messages of the checks, in the language of the report.
OVERLAP_MESSAGE = "安全防护：文件同时被标记为保留和删除："
ALL_TRASHED_MESSAGE = "安全防护：重复组 {} 的所有文件都标记了删除，必须至少保留一个文件！"
NONE_EXISTS_MESSAGE = (
    "安全防护：重复组 {} 保留的文件均在磁盘上不存在，必须确保至少保留一个物理存在的文件！"
)
NOT_IN_REPORT_MESSAGE = "安全防护：待回收文件不在报告中：{}"


class UnsafeSelection(ValueError):
    """A selection would lose content; nothing was moved."""


def path_marks(selection: DataFrame) -> DataFrame:
    """One row per path of a selection: ``kept`` and ``trashed``, over all groups."""
    return selection.groupBy("path").agg(
        F.bool_or(F.col("decision") == "keep").alias("kept"),
        F.bool_or(F.col("decision") == "trash").alias("trashed"),
    )


def overlapping_paths(selection: DataFrame) -> DataFrame:
    """Paths marked both to keep and to trash."""
    sets = decision_sets(selection)
    return (
        sets.where("decision = 'keep'").select("path")
        .intersect(sets.where("decision = 'trash'").select("path"))
    )


def _trash(marks: DataFrame) -> DataFrame:
    return marks.where("trashed").select("path")


def untrashed_members(members: DataFrame, selection: DataFrame) -> DataFrame:
    """Group members that are not marked for trash."""
    return members.where(F.col("path").isNotNull()).join(
        _trash(path_marks(selection)), "path", "left_anti"
    ).select(*members.columns)


def group_flags(members: DataFrame, selection: DataFrame) -> DataFrame:
    """Per group: ``all_trashed`` and ``none_exists`` (no untrashed member exists)."""
    return _flags(members, path_marks(selection))


def _flags(members: DataFrame, marks: DataFrame) -> DataFrame:
    marked = members.join(_trash(marks).withColumn("_trash", F.lit(True)), "path", "left")
    # the one row of an empty group has no path, and nothing in it survives
    trashed = F.col("path").isNull() | F.coalesce("_trash", F.lit(False))
    return marked.groupBy("group_idx", "hash").agg(
        F.bool_and(trashed).alias("all_trashed"),
        (~F.bool_or(F.col("exists") & ~trashed)).alias("none_exists"),
    )


def validate(members: DataFrame, selection: DataFrame, strict: bool = True) -> DataFrame:
    """All violations as ``severity, group_idx, check, hash, path``; none means safe.

    Every group of the report is checked, also those without a decision. ``strict`` adds
    ``not_in_report`` for trash paths that are no group's member.
    """
    none_long, none_text = F.lit(None).cast("long"), F.lit(None).cast("string")
    marks = stage(path_marks(selection), "marks")
    overlap = marks.where("kept AND trashed").select(
        F.lit(1).alias("severity"), none_long.alias("group_idx"),
        F.lit("overlap").alias("check"), none_text.alias("hash"), "path",
    )
    groups = _flags(members, marks).where("all_trashed OR none_exists").select(
        F.lit(2).alias("severity"), "group_idx",
        F.when(F.col("all_trashed"), F.lit("all_trashed")).otherwise(
            F.lit("none_exists")).alias("check"),
        "hash", none_text.alias("path"),
    )
    violations = overlap.unionByName(groups)
    if strict:
        foreign = _trash(marks).join(members.select("path"), "path", "left_anti")
        violations = violations.unionByName(foreign.select(
            F.lit(3).alias("severity"), none_long.alias("group_idx"),
            F.lit("not_in_report").alias("check"), none_text.alias("hash"), "path",
        ))
    return violations


def first_violation(violations: DataFrame) -> DataFrame:
    """The first violation as ``check, hash, position, path, message``, empty if there is none.

    Overlap comes before groups, groups in report order. An overlap has one row for each of its
    paths, in order; any other violation is one row.
    """
    spark = violations.sparkSession
    staged = stage(violations, "violations")
    schema = "check string, hash string, position long, path string, message string"
    top = staged.orderBy("severity", "group_idx", "path").limit(1).collect()
    if not top:
        return spark.createDataFrame([], schema)
    check, hash_value, path = top[0]["check"], top[0]["hash"], top[0]["path"]
    if check != "overlap":
        message = {
            "all_trashed": ALL_TRASHED_MESSAGE,
            "none_exists": NONE_EXISTS_MESSAGE,
            "not_in_report": NOT_IN_REPORT_MESSAGE,
        }[check].format(hash_value or path)
        return spark.createDataFrame([(check, hash_value, 1, path, message)], schema)
    numbered = with_global_index(
        staged.where("check = 'overlap'").select("path"), ["path"], "position"
    )
    return numbered.select(
        F.lit(check).alias("check"), F.lit(None).cast("string").alias("hash"), "position", "path",
        F.concat(F.lit(OVERLAP_MESSAGE), "path").alias("message"),
    )


def require_safe(violations: DataFrame) -> None:
    """Raise the first violation, before anything is moved.

    An overlap can have any number of paths: the error states how many, and the staged table
    that names them all.
    """
    if violations.isEmpty():
        return
    found = stage(first_violation(violations), "first-violation")
    first = found.first()
    if first["check"] != "overlap":
        raise UnsafeSelection(first["message"])
    table = found.inputFiles()[0].rpartition("/")[0]
    raise UnsafeSelection(f"{OVERLAP_MESSAGE}{found.count()} ({table})")
