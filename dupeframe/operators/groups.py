"""Grouping items by fingerprint, and numbering groups and members."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from dupeframe.operators.skew import skew_join
from dupeframe.session import hot_rows
from dupeframe.staging import global_index, stage, with_global_index


def group_table(fingerprints: DataFrame) -> DataFrame:
    """One row per hash held by more than one path, with its first member in scan order.

    Counts and first members are combined on the map side, so a hash shared by a third of all
    rows reaches the reducer as one row per map task.
    """
    return (
        fingerprints.where(F.col("hash").isNotNull())
        .groupBy("hash")
        .agg(
            F.count(F.lit(1)).alias("n_members"),
            F.min(F.struct("root_ord", "path")).alias("first"),
        )
        .where("n_members > 1")
        .select(
            "hash",
            "n_members",
            F.col("first.root_ord").alias("first_root_ord"),
            F.col("first.path").alias("first_path"),
        )
    )


def number_groups(groups: DataFrame) -> tuple[DataFrame, int, int]:
    """Add ``group_idx``: 1-based, in the order in which a scan first meets each group.

    Also gives the number of groups and the member count of the largest one.
    """
    return global_index(groups, ["first_root_ord", "first_path"], "group_idx", "n_members")


def number_members(
    fingerprints: DataFrame, groups: DataFrame, largest: int | None = None
) -> DataFrame:
    """Members of numbered ``groups`` with ``member_pos``, 1-based in scan order.

    ``fingerprints`` and ``groups`` should be staged: both are read again if there are groups
    of more than ``hot_rows`` members. ``largest`` is the member count of the largest group,
    if the caller knows it.
    """
    limit = hot_rows(fingerprints.sparkSession)
    columns = groups.select("hash", "n_members", "group_idx")
    hot = columns.where(F.col("n_members") > limit)
    if hot.isEmpty() if largest is None else largest <= limit:
        members = _ranked(fingerprints.join(columns, "hash"), ["root_ord", "path"], "member_pos")
    else:
        # at most (rows / hot_rows) hashes are hot, so these broadcasts are bounded
        cold = columns.where(F.col("n_members") <= limit)
        rest = fingerprints.join(F.broadcast(hot.select("hash")), "hash", "left_anti")
        spread = fingerprints.join(F.broadcast(hot), "hash")
        members = _ranked(rest.join(cold, "hash"), ["root_ord", "path"], "member_pos").unionByName(
            _ranked_hot(spread, ["root_ord", "path"], "member_pos")
        )
    return members.select(
        "group_idx", "hash", "n_members", "member_pos", "path", "size", "mtime"
    )


def number_in_group(members: DataFrame, order: list[str], name: str) -> DataFrame:
    """Add the 1-based position of each row among the given rows of its group."""
    limit = hot_rows(members.sparkSession)
    hot = members.where(F.col("n_members") > limit)
    if hot.isEmpty():
        return _ranked(members, order, name)
    cold = members.where(F.col("n_members") <= limit)
    return _ranked(cold, order, name).unionByName(_ranked_hot(hot, order, name))


def _ranked(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Position by window: one task per hash, for groups of up to ``hot_rows`` members. It
    reuses the partitioning of a join on the hash."""
    window = Window.partitionBy("hash").orderBy(*order)
    return rows.withColumn(name, F.row_number().over(window).cast("long"))


def _ranked_hot(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Position by global index: the rows of one group are range-sorted over many tasks."""
    indexed = with_global_index(rows, ["group_idx", *order], "_position")
    starts = indexed.groupBy("hash").agg(F.min("_position").alias("_start"))
    return (
        indexed.join(F.broadcast(starts), "hash")
        .withColumn(name, F.col("_position") - F.col("_start") + 1)
        .drop("_position", "_start")
    )


def report_order(members: DataFrame) -> DataFrame:
    """Groups by first-seen member, members by scan order; the sort key is unique."""
    return members.orderBy("group_idx", "member_pos")


def group_parts(members: DataFrame, rows_per_part: int = 10_000) -> DataFrame:
    """Nested form ``hash, part, paths``: arrays in member order, of bounded length.

    A group with more members than ``rows_per_part`` has several parts, so no array grows with
    the size of a group.
    """
    part = F.floor((F.col("member_pos") - 1) / rows_per_part).cast("long")
    return (
        members.withColumn("part", part + 1)
        .groupBy("group_idx", "hash", "part")
        .agg(F.array_sort(F.collect_list(F.struct("member_pos", "path"))).alias("items"))
        .select("group_idx", "hash", "part", F.col("items.path").alias("paths"))
    )


def duplicate_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Values of ``columns`` that occur in more than one row, with ``n_copies``."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n_copies")).where("n_copies > 1")


def duplicate_row_members(df: DataFrame, columns: list[str], row_id: list[str]) -> DataFrame:
    """The rows behind ``duplicate_rows``; ``row_id`` names columns that tell rows apart."""
    repeated = stage(duplicate_rows(df, columns), "repeated")
    largest = repeated.agg(F.max("n_copies")).first()[0] or 0
    return skew_join(df, repeated, columns, "n_copies", row_id, null_safe=True, largest=largest)


def row_digest(columns: list[str]) -> Column:
    """SHA-256 of the values of ``columns``; NULL differs from any value, and no two lists of
    values are written alike."""
    written = [
        F.coalesce(F.concat(F.octet_length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-"))
        for c in columns
    ]
    return F.sha2(F.concat(*written), 256)


def duplicate_wide_rows(df: DataFrame, columns: list[str], row_id: list[str]) -> DataFrame:
    """``row_id``, ``digest`` and ``n_copies`` of rows that agree in ``columns``, for columns that are
    too long to be shuffled: rows are grouped by their digest, made where they are read.

    That rows of one digest agree is checked by a second hash; RuntimeError if not.
    """
    keyed = stage(df.select(
        *row_id, row_digest(columns).alias("digest"), F.xxhash64(*columns).alias("_check")), "digests")
    repeated = stage(keyed.groupBy("digest").agg(
        F.count(F.lit(1)).alias("n_copies"), F.min("_check").alias("_least"), F.max("_check").alias("_most")
    ).where("n_copies > 1"), "repeated")
    largest, unequal = repeated.agg(F.max("n_copies"), F.count_if(F.col("_least") != F.col("_most"))).first()
    if unequal:
        raise RuntimeError(f"{unequal} digests stand for rows that differ")
    return skew_join(
        keyed.drop("_check"), repeated.select("digest", "n_copies"), ["digest"], "n_copies", row_id,
        largest=largest or 0)


def size_candidates(manifest: DataFrame) -> DataFrame:
    """Items whose size occurs more than once: only they can have equal content.

    Works on metadata; ``content`` must not be in ``manifest``, as it would be shuffled.
    """
    sizes = stage(
        manifest.groupBy("size").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"), "sizes")
    largest = sizes.agg(F.max("_n")).first()[0] or 0
    return skew_join(manifest, sizes, ["size"], "_n", ["path"], "left_semi", largest=largest)
