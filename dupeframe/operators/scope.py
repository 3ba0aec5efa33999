"""Include and exclude scopes, and one row per path."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from dupeframe.functions.paths import beginnings, is_beneath_any, is_relative_to
from dupeframe.staging import stage


def in_scope(manifest: DataFrame, roots: list[str]) -> DataFrame:
    """Keep items equal to or beneath a root and tag each with the first such root.

    Roots are a short list given by the caller, so this is a predicate in the scan stage: the
    row is neither exploded per root nor shuffled, and content stays where it is.
    """
    order = F.coalesce(
        *[F.when(is_relative_to(F.col("path"), root), F.lit(i)) for i, root in enumerate(roots)],
        F.lit(None).cast("int"),
    )
    names = F.array(*[F.lit(root.rstrip("/") or "/") for root in roots]).cast("array<string>")
    return (
        manifest.where(is_beneath_any(F.col("path"), roots))
        .withColumn("root_ord", order)
        .withColumn("root", F.get(names, F.col("root_ord")))
    )


def exclude(manifest: DataFrame, excludes: list[str], store: str | None = None) -> DataFrame:
    """Drop items equal to or beneath an exclude, and everything in the fingerprint store."""
    dropped = [*excludes, store] if store else list(excludes)
    if not dropped:
        return manifest
    return manifest.where(~is_beneath_any(F.col("path"), dropped))


def dedupe_paths(manifest: DataFrame) -> DataFrame:
    """One row per path, from its first root.

    For metadata only: with ``content`` still in the rows this would shuffle all content.
    """
    if "content" in manifest.columns:
        raise ValueError("fingerprint or drop 'content' before removing repeated paths")
    rest = [c for c in manifest.columns if c not in ("path", "root_ord")]
    return (
        manifest.groupBy("path")
        .agg(F.min(F.struct("root_ord", *rest)).alias("first"))
        .select("path", "first.*")
        .select(*manifest.columns)
    )


def union_roots(manifests: list[DataFrame]) -> DataFrame:
    """All manifests together, one row per path; earlier manifests have the earlier roots."""
    ordered = [
        manifest.withColumn("_source", F.lit(i)) for i, manifest in enumerate(manifests)
    ]
    union = reduce(lambda a, b: a.unionByName(b), ordered)
    rest = [c for c in union.columns if c not in ("path", "_source", "root_ord")]
    return (
        union.groupBy("path")
        .agg(F.min(F.struct("_source", "root_ord", *rest)).alias("first"))
        .select("path", "first.*")
        .select(*manifests[0].columns)
    )


# -- scopes of any number ---------------------------------------------------------------------


def in_scope_table(manifest: DataFrame, roots: DataFrame) -> DataFrame:
    """``in_scope`` for a table ``root, root_ord`` of any size: items equal to or beneath a root,
    each with the first of its roots by ``root_ord`` (ties: by name).

    For metadata only, as paths are sorted. See ``_owners`` for how.
    """
    tagged = _owners(manifest.drop("root", "root_ord"), roots)
    return tagged.where(F.col("root_ord").isNotNull()).select(
        *[c for c in manifest.columns if c not in ("root", "root_ord")], "root", "root_ord")


def exclude_table(manifest: DataFrame, excludes: DataFrame) -> DataFrame:
    """``exclude`` for a table with one column of paths, of any size."""
    roots = excludes.select(F.col(excludes.columns[0]).alias("root"), F.lit(0).alias("root_ord"))
    kept = [c for c in manifest.columns if c not in ("root", "root_ord")]
    own = {name: f"_own_{name}" for name in ("root", "root_ord") if name in manifest.columns}
    tagged = _owners(manifest.withColumnsRenamed(own), roots).where(F.col("root_ord").isNull())
    return tagged.select(*kept, *[F.col(f"_own_{c}").alias(c) for c in own]).select(*manifest.columns)


def _owners(items: DataFrame, roots: DataFrame) -> DataFrame:
    """``items`` with root and root_ord of the scope that they lie in, NULL in none.

    What lies beneath ``r`` is the interval from ``r/`` to ``r0`` (``0`` follows ``/``) of paths with
    a closing ``/``, in the order of their bytes. Nested roots cut an interval into pieces: at its end a
    root hands over to the innermost root around it. So the owner of a path is that of the last
    boundary before it. Boundaries and paths are range-sorted together; a task carries the owner
    on from boundary to boundary, and the driver from one range to the next, one row for each.
    A scope that holds most paths is spread over as many tasks as any others.
    """
    if "content" in items.columns:
        raise ValueError("drop 'content' before paths are sorted")
    named = roots.select(F.regexp_replace("root", "/+$", "").alias("stem"), F.col("root_ord").cast("int")).groupBy(
        "stem").agg(F.min("root_ord").alias("root_ord"))
    # roots around each root, itself included: those among its beginnings
    around = named.select("stem", F.explode(F.array_append(beginnings(F.col("stem")), F.col("stem"))).alias("outer"))
    held = around.distinct().join(
        named.select(F.col("stem").alias("outer"), F.col("root_ord").alias("outer_ord")), "outer")
    first = F.min(F.struct("outer_ord", "outer"))
    scopes = stage(held.groupBy("stem").agg(
        first.alias("first"),
        F.max(F.when(F.col("outer") != F.col("stem"), F.struct(F.length("outer").alias("n"), "outer"))).alias("parent"),
    ).select("stem", "first", F.col("parent.outer").alias("parent")), "scopes")
    parents = scopes.select(F.col("stem").alias("parent"), F.col("first").alias("after"))
    starts = scopes.select(F.concat("stem", F.lit("/")).alias("_key"), F.col("first").alias("_owner"))
    ends = scopes.join(parents, "parent", "left").select(F.concat("stem", F.lit("0")).alias("_key"), F.col("after").alias("_owner"))
    none = F.struct(F.lit(None).cast("int").alias("outer_ord"), F.lit(None).cast("string").alias("outer"))
    row = F.struct(*items.columns)
    bounds = starts.unionByName(ends).select(
        "_key", F.lit(0).alias("_kind"), F.coalesce("_owner", none).alias("_owner"),
        F.lit(None).cast(items.schema).alias("_row"))
    paths = items.select(
        F.concat("path", F.lit("/")).alias("_key"), F.lit(1).alias("_kind"), F.lit(None).cast(
            "struct<outer_ord: int, outer: string>").alias("_owner"), row.alias("_row"))
    order = ["_key", "_kind"]
    mixed = bounds.unionByName(paths).repartitionByRange(*order).sortWithinPartitions(*order)
    columns = ["_kind", "_known", "_ord", "_root", "_part", "_seq", "_row"]
    kinds = ("_kind int, _known boolean, _ord int, _root string, _part int, _seq long, _row "
             + items.schema.simpleString())

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen, known, owner = TaskContext.get().partitionId(), 0, False, (None, None)
        for batch in batches:
            size = len(batch)
            if not size:
                continue
            kind = batch.column("_kind")
            at = pc.fill_null_forward(pc.if_else(
                pc.equal(kind, 0), pa.array(range(size), pa.int32()), pa.scalar(None, pa.int32())))
            before = pc.is_null(at)  # rows ahead of this batch's first boundary
            found = [pc.if_else(before, pa.scalar(value, column.type), column.take(at))
                     for value, column in zip(owner, batch.column("_owner").flatten())]
            yield pa.RecordBatch.from_arrays([
                kind, pc.or_(pc.invert(before), pa.scalar(known)), *found, pa.array([part] * size, pa.int32()),
                pa.array(range(seen, seen + size), pa.int64()), batch.column("_row")], names=columns)
            seen += size
            if at[size - 1].is_valid:
                known, owner = True, tuple(column[size - 1].as_py() for column in found)

    carried = stage(mixed.mapInArrow(carry, kinds), "owners")
    last = F.max_by(F.struct("_ord", "_root"), F.when(F.col("_kind") == 0, F.col("_seq")))
    finals = carried.groupBy("_part").agg(last.alias("last"), F.count_if(F.col("_kind") == 0).alias("n")).collect()
    incoming, owner = [], (None, None)
    for part, final, n in sorted(finals, key=lambda row: row[0]):
        incoming.append((part, *owner))
        owner = tuple(final) if n else owner
    table = items.sparkSession.createDataFrame(incoming, "_part int, _in_ord int, _in_root string")
    joined = carried.where("_kind = 1").join(F.broadcast(table), "_part")
    root = F.when(F.col("_known"), F.col("_root")).otherwise(F.col("_in_root"))
    return joined.select(
        "_row.*", F.when(root == "", F.lit("/")).otherwise(root).alias("root"),
        F.when(F.col("_known"), F.col("_ord")).otherwise(F.col("_in_ord")).alias("root_ord"))
