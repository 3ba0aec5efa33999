"""Content fingerprints as column expressions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, functions as F

# Algorithm names and their report labels.
NATIVE = ("sha256", "md5")
STREAMED = ("xxh3", "blake3")
LABELS = {"xxh3": "XXH3-128"}


def check_algorithm(algorithm: str) -> str:
    """Fail on the driver, before any job runs, when an algorithm cannot be used."""
    if algorithm not in NATIVE + STREAMED:
        raise ValueError(f"unknown algorithm {algorithm!r}, use one of {NATIVE + STREAMED}")
    if algorithm in STREAMED:
        new_hasher(algorithm)
    return algorithm


def new_hasher(algorithm: str):
    """An object with ``update`` and ``hexdigest`` for one item."""
    if algorithm == "xxh3":
        import xxhash
        return xxhash.xxh3_128()
    if algorithm == "blake3":
        try:
            from blake3 import blake3
        except ImportError as error:
            raise RuntimeError("algorithm 'blake3' needs the blake3 package") from error
        return blake3()
    import hashlib
    return hashlib.new(algorithm)


def _digest_udf(algorithm: str):
    def digest(values: pa.Array) -> pa.Array:
        if algorithm == "xxh3":
            from xxhash import xxh3_128_hexdigest as one
        else:
            def one(buffer):
                hasher = new_hasher(algorithm)
                hasher.update(buffer)
                return hasher.hexdigest()
        kind = pa.large_binary() if pa.types.is_large_string(values.type) else pa.binary()
        raw = values if pa.types.is_binary(values.type) or pa.types.is_large_binary(
            values.type) else values.cast(kind)
        # as_buffer() is a view on the Arrow batch: content is not copied into Python objects
        return pa.array(
            [one(v.as_buffer()) if v.is_valid else None for v in raw], type=pa.string()
        )

    digest.__annotations__ = {"values": pa.Array, "return": pa.Array}
    return F.arrow_udf(digest, "string")


def fingerprint(content: Column | str, algorithm: str = "xxh3") -> Column:
    """Lower-case hex digest of a STRING (its UTF-8 bytes) or BINARY column.

    ``sha256`` and ``md5`` are built in and run in generated code; ``xxh3`` and ``blake3`` go
    through Arrow batches.
    """
    check_algorithm(algorithm)
    column = F.col(content) if isinstance(content, str) else content
    if algorithm == "sha256":
        return F.sha2(column, 256)
    if algorithm == "md5":
        return F.md5(column)
    return _digest_udf(algorithm)(column)


def algorithm_label(algorithm: Column) -> Column:
    """Name of an algorithm as reports print it."""
    label = F.upper(algorithm)
    for name, text in LABELS.items():
        label = F.when(algorithm == name, F.lit(text)).otherwise(label)
    return label
