"""Operator 1: token ids packed into a matrix, best fit decreasing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from dupeframe.llm.tokens import worker_encoder
from dupeframe.llm.words import text_bytes

SCHEMA = (
    "sequence_id long, input_ids array<int>, position_ids array<int>, cu_seqlens array<int>, "
    "doc_ids array<long>, starts array<long>, n_tokens int"
)
BLOCK_TOKENS = 1 << 22


class CapacityTree:
    """A segment tree over free capacities 0..top: how many open rows have each."""

    def __init__(self, top: int):
        self.size = 1 << top.bit_length()
        self.counts = [0] * (2 * self.size)

    def add(self, capacity: int, change: int) -> None:
        node = self.size + capacity
        while node:
            self.counts[node] += change
            node >>= 1

    def at_least(self, need: int) -> int | None:
        """The smallest capacity >= need that an open row has."""
        counts, node = self.counts, self.size + need
        if not counts[node]:
            while True:
                while node & 1:  # a right child: nothing larger below this parent
                    node >>= 1
                if not node:
                    return None
                if counts[node + 1]:
                    node += 1
                    break
                node >>= 1
            while node < self.size:
                node = 2 * node if counts[2 * node] else 2 * node + 1
        return node - self.size


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Rows of item numbers: the longest items first, each into the fullest row that it fits.
    Ties keep the order of the input."""
    tree, open_rows, rows = CapacityTree(capacity), [[] for _ in range(capacity + 1)], []
    for item in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        length = lengths[item]
        free = tree.at_least(length)
        if free is None:
            row, free = len(rows), capacity
            rows.append([])
        else:
            row = open_rows[free].pop()
            tree.add(free, -1)
        rows[row].append(item)
        open_rows[free - length].append(row)
        tree.add(free - length, 1)
    return rows


def pack_token_ids(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 4096,
    end_id: int = 2,
    pad_id: int = 0,
    by_word: bool = True,
    block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """One row per packed sequence of ``capacity`` ids.

    Each task packs what it reads in blocks of about ``block_tokens`` tokens, so nothing is
    shuffled and memory does not grow with the table; a block holds about a thousand sequences,
    which leaves best fit nothing to gain from a larger one. A longer document is split into
    full rows and a rest, losslessly. ``cu_seqlens`` has the cumulative segment lengths (first 0),
    ``position_ids`` restart at 0 in each segment and in the padding, ``doc_ids`` and ``starts``
    say which ids of which document each segment holds. ``sequence_id`` is unique.

    Null or empty text: a document of ``end_id`` alone. Null ids and repeated rows are kept as
    documents of their own; other columns are not read, whatever their names. No rows: no rows.
    """

    def pack(pieces: list[tuple]) -> dict:
        rows = best_fit_decreasing([len(ids) for _, _, ids in pieces], capacity)
        matrix = np.full((len(rows), capacity), pad_id, np.int32)
        positions = np.empty((len(rows), capacity), np.int32)
        count = np.arange(capacity, dtype=np.int32)
        out: dict[str, list] = {k: [] for k in ("cu_seqlens", "doc_ids", "starts", "n_tokens")}
        for r, row in enumerate(rows):
            ends = [0]
            for item in row:
                ids = pieces[item][2]
                at, end = ends[-1], ends[-1] + len(ids)
                matrix[r, at:end] = ids
                positions[r, at:end] = count[:len(ids)]
                ends.append(end)
            positions[r, ends[-1]:] = count[:capacity - ends[-1]]
            out["cu_seqlens"].append(ends)
            out["doc_ids"].append([pieces[item][0] for item in row])
            out["starts"].append([pieces[item][1] for item in row])
            out["n_tokens"].append(ends[-1])
        return out | {"input_ids": matrix, "position_ids": positions}

    def batches(packed: dict, first: int) -> Iterator[pa.RecordBatch]:
        step = 256
        for at in range(0, len(packed["n_tokens"]), step):
            part = slice(at, at + step)
            n = len(packed["n_tokens"][part])
            offsets = pa.array(np.arange(0, (n + 1) * capacity, capacity, dtype=np.int32))

            def matrix(name: str) -> pa.Array:
                return pa.ListArray.from_arrays(offsets, pa.array(packed[name][part].ravel()))

            yield pa.RecordBatch.from_arrays([
                pa.array(np.arange(first + at, first + at + n)),
                matrix("input_ids"), matrix("position_ids"),
                pa.array(packed["cu_seqlens"][part], pa.list_(pa.int32())),
                pa.array(packed["doc_ids"][part], pa.list_(pa.int64())),
                pa.array(packed["starts"][part], pa.list_(pa.int64())),
                pa.array(packed["n_tokens"][part], pa.int32()),
            ], names=["sequence_id", "input_ids", "position_ids", "cu_seqlens", "doc_ids",
                      "starts", "n_tokens"])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = worker_encoder(tokenizer, end_id, by_word)
        number, pieces, held = TaskContext.get().partitionId() << 33, [], 0
        for batch in rows:
            texts = (data.as_py() for data in batch.column(1))
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode_all(texts)):
                for start in range(0, len(ids), capacity):
                    pieces.append((doc_id, start, ids[start:start + capacity]))
                    held += len(pieces[-1][2])
                    if held >= block_tokens:
                        packed = pack(pieces)
                        yield from batches(packed, number)
                        number, pieces, held = number + len(packed["n_tokens"]), [], 0
        if pieces:
            yield from batches(pack(pieces), number)

    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("text"))
    return read.mapInArrow(run, SCHEMA)


def op1_token_output(spark, sf_dir: str) -> DataFrame:
    """All documents as packed sequences of 4096 ids."""
    from public_tokenizers import path

    return pack_token_ids(
        spark.read.parquet(f"{sf_dir}/documents.parquet"), path("word_bpe_49k.json"))
