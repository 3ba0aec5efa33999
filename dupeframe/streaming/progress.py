"""Progress of a scan: counts while it runs, and metrics without a job of their own."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F


def observe_scan(df: DataFrame, hit: Column | None = None) -> tuple[DataFrame, Observation]:
    """Attach counts of processed items and cache hits; read ``.get`` after the next action."""
    observation = Observation()
    hits = F.count_if(F.lit(False) if hit is None else hit)
    observed = df.observe(
        observation,
        F.count(F.lit(1)).alias("total_files"),
        hits.alias("cache_hits"),
    )
    return observed, observation


class ReadProgress:
    """Files and bytes read so far, raised by the tasks that read them.

    ``total`` is the number of files to read, None until they are listed. A task's counts arrive
    when it ends; tasks read about equal bytes, so they arrive evenly.
    """

    def __init__(self, spark: SparkSession):
        self.total: int | None = None
        self._files = spark.sparkContext.accumulator(0)
        self._bytes = spark.sparkContext.accumulator(0)

    @property
    def files(self) -> int:
        return self._files.value

    @property
    def bytes(self) -> int:
        return self._bytes.value

    def counter(self) -> Callable[[int, int], None]:
        """What a task calls with the files and bytes that it has read."""
        files, size = self._files, self._bytes

        def add(n: int, of: int) -> None:
            files.add(n)
            size.add(of)

        return add


@contextmanager
def reported(progress: ReadProgress, report: Callable[[ReadProgress], None], every: float = 1.0) -> Iterator[None]:
    """Call ``report`` every so many seconds while the block runs, and once at its end."""
    ended = threading.Event()

    def poll() -> None:
        while not ended.wait(every):
            report(progress)

    reader = threading.Thread(target=poll, daemon=True)
    reader.start()
    try:
        yield
    finally:
        ended.set()
        reader.join()
        report(progress)
