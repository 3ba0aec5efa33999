"""Fingerprints of files, read where the tasks run."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from dupeframe.functions.fingerprint import check_algorithm, new_hasher
from dupeframe.sources.places import open_stream
from dupeframe.staging import stage
from dupeframe.streaming.progress import ReadProgress

CHUNK_BYTES = 1024 * 1024
BYTES_PER_TASK = 256 * 1024 * 1024
FILES_PER_TASK = 20_000


def fingerprint_files(
    manifest: DataFrame, algorithm: str = "xxh3", on_error: str = "fail",
    progress: ReadProgress | None = None,
) -> DataFrame:
    """Add ``hash`` and ``error`` to a manifest of files.

    Files are streamed in 1 MiB chunks, so memory does not depend on file size. An unreadable
    file fails the job, or with ``on_error='skip'`` has a NULL hash and the reason in
    ``error``. Tasks get about equal bytes to read. Paths with a scheme are objects of a store.
    ``progress`` is raised as files are read.
    """
    check_algorithm(algorithm)
    if on_error not in ("fail", "skip"):
        raise ValueError("on_error is 'fail' or 'skip'")
    fields = [*manifest.schema.fields]
    schema = ", ".join(
        [f"`{f.name}` {f.dataType.simpleString()}" for f in fields]
        + ["hash string", "error string"]
    )

    count = progress.counter() if progress else None

    def read(batches):
        for batch in batches:
            hashes, errors = [], []
            for path in batch.column("path").to_pylist():
                try:
                    hashes.append(_digest_file(path, algorithm))
                    errors.append(None)
                except OSError as error:
                    if on_error == "fail":
                        raise RuntimeError(f"cannot read {path}: {error}") from error
                    hashes.append(None)
                    errors.append(str(error))
            if count:
                count(len(batch), sum(filter(None, batch.column("size").to_pylist())))
            yield batch.append_column(
                "hash", pa.array(hashes, type=pa.string())
            ).append_column("error", pa.array(errors, type=pa.string()))

    return spread_files(manifest).mapInArrow(read, schema)


def spread_files(manifest: DataFrame) -> DataFrame:
    """Deal files into tasks of about equal bytes.

    A file larger than ``BYTES_PER_TASK`` has a task to itself. The others are laid end to end in
    path order, each as long as its size plus a share for opening it, and cut every ``BYTES_PER_TASK``:
    no task has more than twice as many bytes, nor more than ``FILES_PER_TASK`` files. Lengths are
    summed within the ranges of a sort, and the driver adds up one sum for each range.
    """
    spark = manifest.sparkSession
    large = F.col("size") > BYTES_PER_TASK
    length = F.when(large, F.lit(0)).otherwise(
        F.coalesce("size", F.lit(0)) + F.lit(BYTES_PER_TASK // FILES_PER_TASK))
    ordered = stage(
        manifest.withColumns({"_length": length, "_large": F.coalesce(large, F.lit(False)).cast("int")})
        .orderBy("path", "size").withColumn("_part", F.spark_partition_id())
        .withColumn("_place", F.monotonically_increasing_id()), "files")
    sums = sorted(ordered.groupBy("_part").agg(F.sum("_length"), F.sum("_large")).collect())
    if not sums:
        return ordered.select(*manifest.columns)
    bytes_before = files_before = 0
    offsets = []
    for part, bytes_of, large_of in sums:
        offsets.append((part, bytes_before, files_before))
        bytes_before, files_before = bytes_before + bytes_of, files_before + large_of
    # a small scan still uses every core
    each = max(1, min(BYTES_PER_TASK, -(-bytes_before // spark.sparkContext.defaultParallelism)))
    tasks = -(-bytes_before // each)
    before = Window.partitionBy("_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    placed = ordered.join(
        F.broadcast(spark.createDataFrame(offsets, "_part int, _bytes long, _files long")), "_part")

    def start(own: str, offset: str) -> Column:
        return F.coalesce(F.sum(own).over(before), F.lit(0)) + F.col(offset)

    task = F.when(F.col("_large") == 1, F.lit(tasks) + start("_large", "_files")).otherwise(
        F.floor(start("_length", "_bytes") / F.lit(each)))
    return placed.withColumn("_task", task.cast("int")).repartitionById(
        max(1, int(tasks + files_before)), "_task").select(*manifest.columns)


def _digest_file(path: str, algorithm: str) -> str:
    hasher = new_hasher(algorithm)
    with open_stream(path) as stream:
        while chunk := stream.read(CHUNK_BYTES):
            hasher.update(chunk)
    return hasher.hexdigest()
