"""Operator 5: a time-varying curriculum over sources, in column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from dupeframe.llm.words import WORD

# (time, relative weight) knots of a source's schedule; times rise from 0 to 1.
Schedule = list[tuple[float, float]]
STEADY: Schedule = [(0.0, 1.0), (1.0, 1.0)]
RISING: Schedule = [(0.0, 0.5), (1.0, 1.5)]
FALLING: Schedule = [(0.0, 1.5), (0.5, 1.0), (1.0, 0.5)]
BUCKETS = 4096


def integrated(schedule: Schedule) -> list[tuple[float, float, float, float, float]]:
    """Pieces (time, weight, slope, area before, area up to the end) with a total area of 1."""
    areas = [(t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(schedule, schedule[1:])]
    if schedule[0][0] != 0 or schedule[-1][0] != 1 or sum(areas) <= 0 or min(areas) < 0 or min(
            w for _, w in schedule) < 0:
        raise ValueError(f"not a schedule over 0..1 with weights of 0 or more: {schedule}")
    total, before, pieces = sum(areas), 0.0, []
    for (t0, w0), (t1, w1), area in zip(schedule, schedule[1:], areas):
        if t1 > t0:
            pieces.append((t0, w0 / total, (w1 - w0) / total / (t1 - t0),
                           before / total, (before + area) / total))
        before += area
    return pieces


def inverse_demand(share: Column, schedule: Schedule) -> Column:
    """The time at which a source has met ``share`` (0..1) of its demand: the integral of the
    schedule, inverted. Each piece is a quadratic, solved in the form that is stable for slope 0."""
    time, pieces = F.lit(1.0), integrated(schedule)
    for t0, weight, slope, before, upto in reversed(pieces):
        area = share - F.lit(before)
        root = F.sqrt(F.greatest(F.lit(weight * weight) + F.lit(2 * slope) * area, F.lit(0.0)))
        at = F.lit(t0) + F.when(area <= 0, F.lit(0.0)).otherwise(2 * area / (F.lit(weight) + root))
        time = F.when(share < F.lit(upto), at).otherwise(time)
    return F.least(time, F.lit(1.0))


def source_targets(
    sizes: DataFrame, weights: list[float], share: float, most_repeats: float
) -> DataFrame:
    """Per source of ``sizes`` (source, source_size): rank, weight and target.

    ``share`` of all sizes is dealt out by weight; no source gets over ``most_repeats`` times its
    size and the excess goes to the others by weight: target = min(most, level * weight) for one
    level. Sorted by most / weight, the sources below the level are the first ones, so the level
    follows from running sums. One row per source: the windows see sources, not documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    table = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("rank", F.row_number().over(by_name) - 1).withColumn(
        "weight", F.element_at(table, F.pmod(F.col("rank"), F.lit(len(weights))) + 1)
    ).withColumn("most", most_repeats * F.col("source_size").cast("double"))
    filling = Window.orderBy(F.col("most") / F.col("weight"), "rank").rowsBetween(
        Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    levels = (
        ranked.withColumn("below", F.coalesce(F.sum("most").over(filling), F.lit(0.0)))
        .withColumn("weight_below", F.coalesce(F.sum("weight").over(filling), F.lit(0.0)))
        .withColumn("demand", share * F.sum("source_size").over(everything).cast("double"))
        .withColumn("level", (F.col("demand") - F.col("below"))
                    / (F.sum("weight").over(everything) - F.col("weight_below")))
    )
    # the first source in filling order that its level does not fill sets the level of all
    level = F.min(F.when(F.col("level") * F.col("weight") < F.col("most"), F.struct(
        F.col("most") / F.col("weight"), "rank", "level"))).over(everything)["level"]
    return levels.withColumn("_level", level).select(
        "source", "source_size", "rank", "weight",
        F.coalesce(F.least("most", F.col("_level") * F.col("weight")), "most").alias("target"))


def assign_positions(
    docs: DataFrame,
    weights: list[float],
    share: float = 1.5,
    most_repeats: int = 2,
    schedules: list[Schedule] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    buckets: int = BUCKETS,
) -> DataFrame:
    """All columns of ``docs`` and one struct column ``_mix``: size, source_size, target, taken,
    copies (array of struct<words, position>).

    Source k by code point (null last) has weight and schedule k, repeating. Its documents stand
    in the order of a hash of id and text and are passed over again and again until the target is
    met, the last one up to the word that meets it; so taken words differ from the target by less
    than one. The n-th word is due when the integral of the source's schedule reaches n of its
    target, and the position of a copy (0 to 1) is the time at which its first word is due.

    Running sums are taken within (source, bucket of the hash) and over the buckets of a source,
    so a source with a third of all rows is still spread over ``buckets`` groups. Reruns agree.
    Null text has size 0 and is never taken. Null ids, ties and repeated rows count on their own
    (equal rows are interchangeable). Clashing names: a column ``_mix`` is replaced.
    """
    schedules = schedules or [STEADY]
    own = [c for c in docs.columns if c != "_mix"]
    # under names of their own, so that what a caller does not use is never shuffled
    carried = {f"_own{k}": c for k, c in enumerate(own)}
    measured = docs.select(
        *[F.col(f"`{c}`").alias(name) for name, c in carried.items()],
        F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.lit("curriculum"), id_col, text_col).alias("hash"),
    ).withColumn("bucket", F.pmod("hash", F.lit(buckets)))
    by_bucket = measured.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    before = Window.partitionBy("source").orderBy("bucket")
    starts = by_bucket.withColumn(
        "bucket_start", F.sum("bucket_size").over(before) - F.col("bucket_size"))
    sizes = by_bucket.groupBy("source").agg(F.sum("bucket_size").alias("source_size"))
    targets = source_targets(sizes, weights, share, most_repeats)
    known = starts.join(
        targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))
    ).select(
        F.col("source").alias("_source"), F.col("bucket").alias("_bucket"),
        "bucket_start", "source_size", "rank", "target")
    inside = Window.partitionBy("source", "bucket").orderBy("hash", "size").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    placed = measured.withColumn("upto", F.sum("size").over(inside)).join(
        known,
        F.col("source").eqNullSafe(F.col("_source")) & (F.col("bucket") == F.col("_bucket")),
        "left",
    ).withColumn("start", F.col("bucket_start") + F.col("upto") - F.col("size"))
    wanted = F.floor(F.col("target"))

    def position(first: Column) -> Column:
        # of the words taken, so that shares end at 1
        due = first.cast("double") / wanted.cast("double")
        choice = F.lit(None).cast("double")
        for k, schedule in enumerate(schedules):
            choice = F.when(F.pmod(F.col("rank"), F.lit(len(schedules))) == k,
                            inverse_demand(due, schedule)).otherwise(choice)
        return choice

    def copy(k: int) -> Column:
        first = F.col("start") + F.lit(k) * F.col("source_size")
        words = F.greatest(F.least(wanted - first, F.col("size")), F.lit(0).cast("long"))
        return F.when(words > 0, F.struct(words.alias("words"), position(first).alias("position")))

    copies = F.filter(F.array(*[copy(k) for k in range(most_repeats)]), lambda c: c.isNotNull())
    return placed.withColumn("copies", copies).select(
        *[F.col(name).alias(c) for name, c in carried.items()],
        F.struct(
            "size", "source_size", F.col("target"),
            F.aggregate("copies", F.lit(0).cast("long"), lambda n, c: n + c["words"]).alias("taken"),
            "copies",
        ).alias("_mix"))


def training_order(mixed: DataFrame, text_col: str = "text") -> DataFrame:
    """One row per copy of ``assign_positions``, range-sorted by position; the copy that meets a
    source's target is cut after its last word. ``_mix`` becomes struct<words, position, size>."""
    copies = mixed.withColumn("_copy", F.explode("_mix.copies"))
    # each piece is a word with the white space after it (the first may be white space alone)
    pieces = F.split(F.col(text_col), r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    leading = F.col(text_col).rlike(r"^[\x20\x09-\x0D]").cast("int")
    cut = F.array_join(F.slice(pieces, F.lit(1), F.col("_copy.words").cast("int") + leading), "")
    whole = F.col("_copy.words") == F.col("_mix.size")
    return copies.withColumn(
        text_col, F.when(whole, F.col(text_col)).otherwise(cut)
    ).withColumn("_mix", F.struct(
        F.col("_copy.words").alias("words"), F.col("_copy.position").alias("position"),
        F.col("_mix.size").alias("size"))).drop("_copy").orderBy("_mix.position")


WEIGHTS, SCHEDULES = [3.0, 1.0, 2.0], [STEADY, RISING, FALLING]


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    """All documents with their source's target, the words taken and the position of the first copy."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    mixed = assign_positions(docs, WEIGHTS, 1.5, 2, SCHEDULES)
    return mixed.select(
        "doc_id", "_mix.size", "_mix.source_size", "_mix.target", "_mix.taken",
        F.get("_mix.copies", F.lit(0))["position"].alias("position"),
    ).orderBy("position", "doc_id")
