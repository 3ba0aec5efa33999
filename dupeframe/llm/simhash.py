"""Operator 9: SimHash fingerprints and their search by block tables with an inner radius."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from dupeframe.llm.words import WordHashes, mixed, text_bytes, windows
from dupeframe.staging import stage

BITS = 256
TERM_WORDS = 3
# Single changed words that leave two texts a Jaccard similarity of 0.8 in five-word shingles change
# about 1 in 15 word trigrams, and so about 30 of 256 bits.
RADIUS = 30
BLOCKS = 12
_STEP = 4096


class SimHash:
    """Fingerprints of whole texts; word hashes are remembered within a task."""

    def __init__(self, bits: int = BITS, term_words: int = TERM_WORDS):
        if bits % 64:
            raise ValueError("bits must be a multiple of 64")
        self.bits, self.term_words, self.hashes = bits, term_words, WordHashes()
        self.lanes = np.arange(1, bits // 64 + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)

    def of(self, data: bytes) -> np.ndarray:
        """The fingerprint as bits // 64 unsigned words.

        Terms are windows of ``term_words`` words (a shorter text: its words); a term that occurs
        n times has the integer weight 1 + floor(2 log2 n), adds it to each bit that its hash
        sets and takes it from the others. Votes above zero set the fingerprint's bit. Sums of
        integers are exact, so equal texts have equal fingerprints. No words: no bits.
        """
        words = self.hashes.of(data)
        terms = windows(words, self.term_words) if len(words) >= self.term_words else mixed(words)
        terms, counts = np.unique(terms, return_counts=True)
        weights = (1 + np.floor(2 * np.log2(counts))).astype(np.float32)
        votes = np.zeros(self.bits, np.float64)
        for at in range(0, len(terms), _STEP):
            lanes = mixed(terms[at:at + _STEP, None] + self.lanes)
            bits = np.unpackbits(lanes.view(np.uint8), axis=1, bitorder="little")
            votes += weights[at:at + _STEP] @ bits.astype(np.float32)
        above = 2 * votes > float(weights.sum(dtype=np.float64))
        return np.packbits(above, bitorder="little").view(np.uint64)

    def likeness(self, a: np.ndarray, b: np.ndarray) -> float:
        """The cosine of the angle that the differing bits estimate; 0 for a right angle or more."""
        apart = int(np.bitwise_count(a ^ b).sum())
        return max(0.0, float(np.cos(np.pi * apart / self.bits)))


def hexadecimal(words: np.ndarray) -> str:
    return "".join(f"{int(word):016x}" for word in words)


def fingerprints(docs: DataFrame, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, fingerprint, words): the fingerprint in hexadecimal and as array<long>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = SimHash(bits)
        for batch in batches:
            made = [maker.of(x.as_py()) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array([hexadecimal(w) for w in made], pa.string()),
                pa.array([w.view(np.int64) for w in made], pa.list_(pa.int64())),
            ], names=["doc_id", "fingerprint", "words"])

    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("text"))
    return read.mapInArrow(run, "doc_id long, fingerprint string, words array<long>")


def _tables(radius: int, blocks: int, bits: int) -> list[tuple[int, int, int, int]]:
    """(word, low bit, length, inner radius) of each table's block."""
    each = blocks * 64 // bits
    share, more = divmod(radius + 1, blocks)
    made = []
    for k in range(blocks):
        word, place = divmod(k, each)
        low, high = 64 * place // each, 64 * (place + 1) // each
        made.append((word, low, high - low, share - 1 + (k < more)))
    return [table for table in made if table[3] >= 0]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def within_radius(
    queries: DataFrame, index: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, bits: int = BITS
) -> DataFrame:
    """Pairs (query, found, distance) of distinct fingerprints at most ``radius`` bits apart.

    Both sides have ``fingerprint`` and ``words``. Fingerprints are cut into ``blocks`` runs of
    bits, as many in each word, and there is a table keyed by each run. The runs' inner radii,
    each plus one, sum to radius + 1, so two fingerprints within ``radius`` are within the inner
    radius in one run at least; a query is looked up there under every key within it (1734 keys
    for 30 of 256 bits in 12 runs), a fingerprint of the index stands under its own key only.
    Equal fingerprints are collapsed before, so a group of copies is one entry; a pair is
    reported by the first table in which it meets, and only pairs within ``radius`` leave the
    join. Exact: no candidate is left out, and distances are computed from all bits.
    """
    if bits % 64 or not (radius >= 0 and 0 < blocks <= bits and blocks * 64 % bits == 0):
        raise ValueError("radius >= 0 and as many blocks in each 64-bit word")
    tables = _tables(radius, blocks, bits)
    masks = [_signed(((1 << length) - 1) << low) for _, low, length, _ in tables]
    probes = [(t, _signed(sum(1 << low + bit for bit in flipped)))
              for t, (_, low, length, inner) in enumerate(tables)
              for n in range(min(inner, length) + 1) for flipped in combinations(range(length), n)]

    def run_of(words: str, t: int) -> Column:
        return F.col(words)[tables[t][0]].bitwiseAND(F.lit(masks[t]))

    def distinct(side: DataFrame, name: str) -> DataFrame:
        keys = F.array(*[run_of(f"{name}_words", t) for t in range(len(tables))])
        return side.groupBy("fingerprint").agg(F.first("words").alias(f"{name}_words")).select(
            F.col("fingerprint").alias(name), f"{name}_words", keys.alias("keys"))

    flips = queries.sparkSession.createDataFrame(probes, "table int, flip long")  # fixed by the arguments
    asked = distinct(queries, "query").crossJoin(F.broadcast(flips)).select(
        "query", "query_words", "table", F.col("keys")[F.col("table")].bitwiseXOR(F.col("flip")).alias("key"))
    there = distinct(index, "found").select(
        "found", "found_words", F.posexplode("keys").alias("place", "own"))
    apart = [F.bit_count(run_of("query_words", t).bitwiseXOR(run_of("found_words", t))) for t in range(len(tables))]
    first = F.coalesce(*[F.when(apart[t] <= tables[t][3], F.lit(t)) for t in range(len(tables))])
    distance = reduce(lambda x, y: x + y, [
        F.bit_count(F.col("query_words")[k].bitwiseXOR(F.col("found_words")[k])) for k in range(bits // 64)])
    return asked.join(there, (F.col("table") == F.col("place")) & (F.col("key") == F.col("own")) & (
        distance <= radius) & (first == F.col("table"))).select("query", "found", distance.alias("distance"))


COMPARED = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
    "edited_fingerprint string, near_edited double, near_next double, words array<long>"
)


def compare_with_next(docs: DataFrame, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each document, in descending order of ids, its fingerprint against that of an edited
    text (the last half of the code points replaced by the first as many of the next document)
    and that of the next document; after the last comes the first.

    Texts are shuffled once, into ranges of ids; a task then walks its range and holds two
    documents at a time. The first and last of each range are written beside the result and
    joined with those of the following range, two rows for each task. Null ids come last, ties in
    the order of a hash of the text; null text is empty; other columns are not read.
    """

    def measure(maker: SimHash, data: bytes, own: np.ndarray, following: bytes, other: np.ndarray) -> tuple:
        text = data.decode("utf-8", "replace")
        half = len(text) // 2
        # four bytes a code point at most
        edited = (text[:len(text) - half] + following[:4 * half].decode("utf-8", "ignore")[:half]).encode()
        changed = maker.of(edited)
        return (len(text), hashlib.sha256(edited).hexdigest(), hexadecimal(own), hexadecimal(changed),
                maker.likeness(own, changed), maker.likeness(own, other), own.view(np.int64).tolist())

    names = [part.split()[0] for part in COMPARED.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(),
             pa.list_(pa.int64())]
    empty = (None,) * 7

    def table(rows: list[tuple], ends: bool) -> pa.RecordBatch:
        columns = list(zip(*rows))
        extra = [("part", pa.int32()), ("place", pa.string()), ("text", pa.binary())] if ends else []
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, [*kinds, *[k for _, k in extra]])],
            names=[*names, *[n for n, _ in extra]])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        maker, part, before = SimHash(bits), TaskContext.get().partitionId(), None
        for batch in batches:
            rows = []
            for doc_id, data in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                data = data.as_py()
                own = maker.of(data)
                if before is None:
                    rows.append((doc_id, *empty, part, "first", data))
                else:
                    rows.append((before[0], *measure(maker, before[1], before[2], data, own), part, "row", None))
                before = (doc_id, data, own)
            if rows:
                yield table(rows, True)
        if before is not None:
            yield table([(before[0], *empty, part, "last", before[1])], True)

    def join_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = SimHash(bits)
        for batch in batches:
            rows = []
            for doc_id, data, following in zip(*[column.to_pylist() for column in batch.columns]):
                rows.append((doc_id, *measure(maker, data, maker.of(data), following, maker.of(following))))
            if rows:
                yield table(rows, False)

    order = F.col("doc_id").desc_nulls_last()
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("text"))
    walked = stage(
        read.repartitionByRange(order).sortWithinPartitions(order, F.xxhash64("text"))
        .mapInArrow(walk, f"{COMPARED}, part int, place string, text binary"), "simhash")
    parts = sorted(row.part for row in walked.where("place = 'last'").select("part").collect())
    following = read.sparkSession.createDataFrame(
        list(zip(parts, [*parts[1:], *parts[:1]])), "part int, next_part int")  # one row per task
    first = walked.where("place = 'first'").select(F.col("part").alias("next_part"), F.col("text").alias("following"))
    ends = walked.where("place = 'last'").select("part", "doc_id", "text").join(following, "part").join(
        first, "next_part").select("doc_id", "text", "following").mapInArrow(join_ends, COMPARED)
    return walked.where("place = 'row'").select(*names).unionByName(ends)


def with_counts(compared: DataFrame, queried: Column, counts: DataFrame) -> DataFrame:
    """``compared`` with n_within of ``counts`` (query, n_within); rows that are not ``queried``
    have null and take no part in the join."""
    asked = F.coalesce(queried, F.lit(False))
    joined = compared.where(asked).join(counts, F.col("fingerprint") == F.col("query"), "left").drop("query")
    return joined.unionByName(compared.where(~asked).withColumn("n_within", F.lit(None).cast("long")))


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and their edited texts; for every id divisible by 50 also
    the number of documents within ``RADIUS`` bits, itself included (else null)."""
    compared = compare_with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    queried = F.col("doc_id") % 50 == 0
    compared = stage(compared, "simhash-compared")
    found = within_radius(compared.where(queried), compared)
    copies = compared.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("copies"))
    counts = found.join(copies, F.col("found") == F.col("fingerprint")).groupBy("query").agg(
        F.sum("copies").alias("n_within"))
    return with_counts(compared, queried, counts).select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited",
        "near_next", "n_within")
