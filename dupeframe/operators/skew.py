"""Joins that survive a key holding a large share of all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from dupeframe.session import hot_rows


def skew_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    n_col: str,
    salt_by: list[str],
    how: str = "inner",
    null_safe: bool = False,
    largest: int | None = None,
) -> DataFrame:
    """Join to ``right``, which has one row per key and the key's ``left`` row count ``n_col``.

    A key with more than ``hot_rows`` rows is split into ceil(n / hot_rows) salts: its left rows
    are spread by the hash of ``salt_by`` and its one right row is repeated per salt. Other
    keys keep salt 0. The broadcast table holds 64-bit hashes of hot keys only, at most
    (left rows / hot_rows) of them, so its bytes are bounded by construction; a key whose hash
    agrees with a hot one's is spread as well, on both sides, which changes no result. ``null_safe`` lets
    NULL keys match each other, as they do in a ``groupBy``. ``largest`` is a bound of ``n_col``, if
    the caller knows one: when no key can be hot, nothing is salted.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type {how!r}")
    limit = hot_rows(left.sparkSession)
    if largest is not None and largest <= limit:
        return _join(left, right, keys, how, null_safe)
    salts = F.ceil(F.col(n_col) / F.lit(limit)).cast("int")
    hot = F.broadcast(
        right.where(F.col(n_col) > limit)
        .groupBy(F.xxhash64(*keys).alias("_key")).agg(F.max(salts).alias("_salts"))
    )

    def salted(side: DataFrame) -> DataFrame:
        return side.withColumn("_key", F.xxhash64(*keys)).join(hot, "_key", "left").drop("_key")

    spread = salted(left).withColumn(
        "_salt",
        F.pmod(F.xxhash64(*salt_by), F.coalesce("_salts", F.lit(1)).cast("long")).cast("int"),
    ).drop("_salts")
    repeated = salted(right).withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))
    ).drop("_salts")
    return _join(spread, repeated, [*keys, "_salt"], how, null_safe).drop("_salt")


def _join(
    left: DataFrame, right: DataFrame, keys: list[str], how: str, null_safe: bool
) -> DataFrame:
    if not null_safe:
        return left.join(right, keys, how)
    renamed = right.withColumnsRenamed({key: f"_right_{key}" for key in keys})
    condition = reduce(
        lambda a, b: a & b, [F.col(key).eqNullSafe(F.col(f"_right_{key}")) for key in keys]
    )
    return left.join(renamed, condition, how).drop(*[f"_right_{key}" for key in keys])
