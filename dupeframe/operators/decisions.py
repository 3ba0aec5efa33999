"""Choosing one member to keep per group.

Operators take members in long form with ``exists`` (see ``enrich``) and give a selection:
``hash, path, decision`` with decision ``keep`` or ``trash``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from dupeframe.functions.paths import path_length
from dupeframe.operators.groups import number_in_group
from dupeframe.operators.skew import skew_join
from dupeframe.staging import stage


def enrich(members: DataFrame, present: DataFrame) -> DataFrame:
    """Add ``exists, size, mtime`` from the items present now; zeros for missing ones."""
    now = present.select(
        "path",
        F.lit(True).alias("_exists"),
        F.col("size").alias("_size"),
        F.col("mtime").alias("_mtime"),
    )
    kept = [c for c in members.columns if c not in ("exists", "size", "mtime")]
    return members.join(now, "path", "left").select(
        *kept,
        F.coalesce("_exists", F.lit(False)).alias("exists"),
        F.coalesce("_size", F.lit(0).cast("long")).alias("size"),
        F.coalesce("_mtime", F.lit(0.0)).alias("mtime"),
    )


def existing(members: DataFrame) -> DataFrame:
    return members.where(F.col("exists"))


def _rule_key(rule: str) -> Column:
    # the largest value is the smallest negated one, so that ties always go to the earliest
    keys = {
        "first": F.lit(0),
        "oldest": F.col("mtime"),
        "newest": -F.col("mtime"),
        "shortest": path_length(F.col("path")),
        "longest": -path_length(F.col("path")),
    }
    if rule not in keys:
        raise ValueError(f"unknown rule {rule!r}, use one of {tuple(keys)}")
    return keys[rule]


def choose_keep(members: DataFrame, rule: str) -> DataFrame:
    """``hash, keep, n_existing`` for each group with more than one existing member.

    ``rule`` is ``oldest``, ``newest``, ``shortest`` or ``longest`` (path length in UTF-16
    units), or ``first`` for the default selection. Ties go to the earliest member.
    """
    key = F.struct(_rule_key(rule).alias("key"), F.col("member_pos"))
    return (
        existing(members)
        .groupBy("hash")
        .agg(F.min_by("path", key).alias("keep"), F.count(F.lit(1)).alias("n_existing"))
        .where("n_existing > 1")
    )


def largest_group(members: DataFrame) -> int:
    """The member count of the largest group; ``members`` should be staged."""
    return members.agg(F.max("n_members")).first()[0] or 0


def _decide(members: DataFrame, keepers: DataFrame, n_col: str, largest: int | None) -> DataFrame:
    joined = skew_join(
        existing(members).select("hash", "path"), keepers, ["hash"], n_col, ["path"], largest=largest
    )
    decision = F.when(F.col("path") == F.col("keep"), F.lit("keep")).otherwise(F.lit("trash"))
    return joined.select("hash", "path", decision.alias("decision"))


def apply_rule(
    members: DataFrame, rule: str, prior: DataFrame | None = None, largest: int | None = None
) -> DataFrame:
    """Selection by ``rule`` for every eligible group; other groups keep ``prior``.

    ``largest`` is the member count of the largest group, if the caller knows it (``largest_group``).
    """
    keepers = choose_keep(members, rule)
    selection = _decide(members, keepers, "n_existing", largest)
    if prior is None:
        return selection
    untouched = skew_join(
        prior, keepers.select("hash", "n_existing"), ["hash"], "n_existing", ["path"], "left_anti",
        largest=largest,
    )
    return selection.unionByName(untouched.select("hash", "path", "decision"))


def default_selection(members: DataFrame, largest: int | None = None) -> DataFrame:
    """The first existing member is kept, the other existing ones are trash."""
    return apply_rule(members, "first", largest=largest)


def apply_overrides(
    members: DataFrame, selection: DataFrame, edits: DataFrame, largest: int | None = None
) -> DataFrame:
    """Apply ordered edits ``seq, hash, action, path`` to the groups of ``selection``.

    ``keep p`` keeps p. ``trash p`` matters only if p is the kept one: then the first other
    existing member is kept. Edits of paths that are not existing members, or of groups
    without a selection, have no effect. Where ``selection`` keeps several members of an edited
    group, the first of them counts as the kept one and the others become trash.

    No edit list is collected. The outcome depends on three facts per group, all of them
    aggregates that combine on the map side: the last ``keep``, the first later ``trash`` of
    that path, and the last later ``trash`` of one of the first two existing members. Once the
    kept path has been trashed only those two can be kept, and trashing one keeps the other.
    """
    pairs = existing(members).select("hash", "path")
    valid = stage(edits.join(pairs, ["hash", "path"], "left_semi"), "edits")
    start = selection.where("decision = 'keep'").join(
        existing(members).select("hash", "path", "member_pos"), ["hash", "path"]
    ).groupBy("hash").agg(F.min_by("path", "member_pos").alias("_start"))
    place = F.row_number().over(Window.partitionBy("hash").orderBy("member_pos"))
    heads = (
        existing(members)
        .select("hash", "path", "member_pos", "n_members")
        .withColumn("_place", place)
        .where("_place <= 2")
        .groupBy("hash")
        .agg(
            F.max("n_members").alias("n_members"),
            F.max(F.when(F.col("_place") == 1, F.col("path"))).alias("_m1"),
            F.max(F.when(F.col("_place") == 2, F.col("path"))).alias("_m2"),
        )
    )
    states = stage(
        valid.groupBy("hash")
        .agg(
            F.count(F.lit(1)).alias("_n_edits"),
            F.max(F.when(F.col("action") == "keep", F.struct("seq", "path"))).alias("_last"),
        )
        .join(start, "hash")
        .join(heads, "hash")
        .select(
            "hash", "_n_edits", "n_members", "_m1", "_m2",
            F.coalesce("_last.path", "_start").alias("_kept"),
            F.col("_last.seq").alias("_since"),
        ),
        "edit-states",
    )
    most_edits = states.agg(F.max("_n_edits")).first()[0] or 0
    trashed = skew_join(
        valid.where("action = 'trash'"), states, ["hash"], "_n_edits", ["path"], largest=most_edits
    ).where(F.col("_since").isNull() | (F.col("seq") > F.col("_since")))
    facts = trashed.groupBy("hash").agg(
        F.min(F.when(F.col("path") == F.col("_kept"), F.col("seq"))).alias("_lost"),
        F.max(F.when(
            (F.col("path") == F.col("_m1")) | (F.col("path") == F.col("_m2")),
            F.struct("seq", "path"),
        )).alias("_head"),
    )
    m1, m2 = F.col("_m1"), F.col("_m2")
    kept = (
        F.when(F.col("_lost").isNull() | m2.isNull(), F.col("_kept"))
        .when(F.col("_head.seq") > F.col("_lost"),
              F.when(F.col("_head.path") == m1, m2).otherwise(m1))
        .otherwise(F.when(F.col("_kept") == m1, m2).otherwise(m1))
    )
    outcome = states.join(facts, "hash", "left").select(
        "hash", "n_members", kept.alias("_keep")
    )
    updated = skew_join(selection, outcome, ["hash"], "n_members", ["path"], "left", largest=largest)
    decision = F.when(F.col("_keep").isNull(), F.col("decision")).otherwise(
        F.when(F.col("path") == F.col("_keep"), F.lit("keep")).otherwise(F.lit("trash"))
    )
    return updated.select("hash", "path", decision.alias("decision"))


def apply_choices(
    members: DataFrame, choices: DataFrame, largest: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Apply one choice per group and return ``(selection, rejected choices)``.

    ``choice`` is the number of an existing member, counted among the existing ones: it is
    kept and the others are trash. ``s`` leaves a group alone. Anything else is rejected.
    """
    numbered = number_in_group(
        existing(members).select("group_idx", "hash", "n_members", "member_pos", "path"),
        ["member_pos"], "_number",
    )
    text = F.lower(F.trim("choice"))
    # no group has 10**18 members, and more digits would not fit a LONG
    wanted = choices.where(text != "s").withColumn(
        "_number", F.when(text.rlike("^[0-9]{1,18}$"), text.cast("long"))
    )
    chosen = wanted.join(
        numbered.select("hash", "_number", "n_members", F.col("path").alias("keep")),
        ["hash", "_number"], "left",
    )
    rejected = chosen.where(F.col("keep").isNull()).select("hash", "choice")
    keepers = chosen.where(F.col("keep").isNotNull()).select("hash", "keep", "n_members")
    return _decide(members, keepers, "n_members", largest), rejected


def decision_sets(selection: DataFrame) -> DataFrame:
    """The sets of kept and trashed paths over all groups, as ``decision, path``."""
    return selection.select("decision", "path").distinct()
