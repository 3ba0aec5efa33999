"""Operator 2: order-preserving packing by dynamic programming."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from itertools import accumulate, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from dupeframe.llm.tokens import worker_encoder
from dupeframe.llm.words import text_bytes

SCHEMA = (
    "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, "
    "ids binary"
)
BLOCK_TOKENS = 1 << 20


def best_cuts(lengths: list[int], penalties: list[float], capacity: int) -> list[int]:
    """The unit counts after which windows end, at the least total cost.

    A window holds consecutive units of at most ``capacity`` tokens together and costs its
    padding; ``penalties[j]`` is paid for a cut after unit j. With S the running sum of lengths,
    cost[j] = capacity - S[j] + penalty[j] + min(cost[i] + S[i]) over the i that fit; the
    minimum comes from a queue of rising values, so the whole is linear.
    """
    # (place, sums, best + sums), by rising values
    queue: deque[tuple[int, int, float]] = deque([(0, 0, 0.0)])
    back = [0]
    total = 0
    for j, (length, penalty) in enumerate(zip(lengths, penalties), 1):
        total += length
        least = total - capacity
        while queue[0][1] < least:
            queue.popleft()
        start, _, before = queue[0]
        back.append(start)
        value = before + capacity - total + penalty + total  # cost[j] + sums[j]
        while queue and queue[-1][2] >= value:
            queue.pop()
        queue.append((j, total, value))
    cuts, at = [], len(lengths)
    while at:
        cuts.append(at)
        at = back[at]
    return cuts[::-1]


def split_units(ends: np.ndarray, longest: int) -> tuple[list[int], list[int]]:
    """Unit lengths from sentence ends, and their kinds (1: a sentence ends, 2: inside one).
    A longer sentence becomes units of at most ``longest`` tokens."""
    lengths, kinds, before = [], [], 0
    for end in ends.tolist():
        while end - before > longest:
            lengths.append(longest)
            kinds.append(2)
            before += longest
        if end > before:
            lengths.append(end - before)
            kinds.append(1)
            before = end
    return lengths, kinds


def pack_in_order(
    docs: DataFrame,
    tokenizer: str,
    order_by: list[str] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 4096,
    end_id: int = 2,
    sentence_penalty: float = 32.0,
    inner_penalty: float = 256.0,
    longest_unit: int = 256,
    by_word: bool = True,
    block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """One row per piece of a document, with its ids and its place in a sequence.

    Documents follow each other by ``order_by`` (ranges of it are sorted in tasks of their own);
    None keeps the order in which the table is read. Within a task windows are cut at document
    ends (free), sentence ends (``sentence_penalty`` tokens) or inside a sentence of over
    ``longest_unit`` tokens (``inner_penalty``), at the least total padding and penalty. The
    programme runs over blocks of about ``block_tokens``; the last, unfilled window of a block
    opens the next block, so memory is bounded and a block's end costs no padding. Only the last
    window of a task's range can stay unfilled. ``ids`` are little-endian unsigned 32-bit.

    Null or empty text: a document of ``end_id`` alone. Null ids, ties of the order and repeated
    rows are documents of their own; other columns are not read unless ordered by. No rows: none.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = worker_encoder(tokenizer, end_id, by_word)
        sequence = TaskContext.get().partitionId() << 33
        # units waiting for a window: (document, start, length), a document being (id, ids)
        units: list[tuple] = []
        lengths: list[int] = []
        penalties: list[float] = []
        held = 0
        paid = (0.0, sentence_penalty, inner_penalty)

        def emit(cuts: list[int]) -> pa.RecordBatch:
            nonlocal sequence
            out: list[tuple] = []
            first = 0
            for cut in cuts:
                offset = 0
                for (doc, start), length in zip(units[first:cut], lengths[first:cut]):
                    last = out[-1] if out else None
                    if offset and last[0] is doc:  # goes on in the same window
                        out[-1] = (doc, last[1], last[2] + length, last[3], last[4])
                    else:
                        out.append((doc, start, length, sequence, offset))
                    offset += length
                sequence, first = sequence + 1, cut
            columns = list(zip(*out))
            return pa.RecordBatch.from_arrays([
                pa.array([doc[0] for doc in columns[0]], pa.int64()),
                pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()),
                pa.array([len(doc[1]) for doc in columns[0]], pa.int64()),
                pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.int64()),
                pa.array([doc[1][s:s + n].astype("<u4").tobytes()
                          for doc, s, n, _, _ in out], pa.binary()),
            ], names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

        for batch in rows:
            for doc_id, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids, ends = encoder.encode(data.as_py())
                sizes, kinds = split_units(ends, min(longest_unit, capacity))
                units.extend(zip(repeat((doc_id, ids)), accumulate(sizes, initial=0)) if sizes else ())
                del units[len(lengths) + len(sizes):]  # the end of the document starts no unit
                lengths.extend(sizes)
                penalties.extend(map(paid.__getitem__, kinds))
                penalties[-1] = 0.0
                held += len(ids)
                if held >= block_tokens:
                    cuts = best_cuts(lengths, penalties, capacity)
                    if len(cuts) > 1:
                        yield emit(cuts[:-1])
                        done = cuts[-2]
                        del units[:done], lengths[:done], penalties[:done]
                        held = sum(lengths)
        if units:
            yield emit(best_cuts(lengths, penalties, capacity))

    names = [f"_order{k}" for k in range(len(order_by or []))]
    read = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("text"),
        *[F.col(column).alias(name) for column, name in zip(order_by or [], names)])
    if names:
        read = read.repartitionByRange(*names).sortWithinPartitions(*names, F.xxhash64("text"))
    return read.select("doc_id", "text").mapInArrow(run, SCHEMA)


def op2_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in the order of their ids, in sequences of at most 4096 tokens."""
    from public_tokenizers import path

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digests(pack_in_order(docs, path("word_bpe_49k.json"), order_by=["doc_id"]))


def digests(pieces: DataFrame) -> DataFrame:
    """Pieces with a checksum in place of their ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"),
                         "doc_tokens", "sequence_id", "offset")
