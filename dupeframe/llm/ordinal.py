"""Operator 6: ordinal regression on graded ratings, with hashed text features."""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from dupeframe.llm.words import chunks, text_bytes

DIMENSIONS = 1 << 18
SAMPLE_ROWS = 8000
STRIP = b".,;:!?\"'()[]{}<>*$%&#|-_/"


class Features:
    """Hashed features of whole texts: words, word beginnings and a few shares in steps.

    A text's features are (number, value) with value 1 + log2(count), halved for beginnings.
    The features of a word are looked up once per task.
    """

    def __init__(self, dimensions: int = DIMENSIONS, cached: int = 1 << 19):
        self.dimensions, self.cached = dimensions, cached
        self._clear()

    def _clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.facts = array("i")  # three for each word: its number, its beginning's, its style

    def _number(self, name: bytes) -> int:
        from xxhash import xxh3_64_intdigest

        return xxh3_64_intdigest(name) % self.dimensions

    def _learn(self, words: Iterable[bytes]) -> None:
        if len(self.index) > self.cached:
            self._clear()
        for word in words:
            if word not in self.index:
                bare = word.strip(STRIP).decode("utf-8", "replace")
                low = bare.lower()
                shouts = b"!!" in word or len(low) > 3 and bare == low.upper() != low
                marks = len(word) > len(word.translate(None, b"#*$%&|<>"))
                self.index[word] = len(self.facts) // 3
                self.facts.extend((self._number(b"w" + low.encode()),
                                   self._number(b"b" + low[:6].encode()), shouts + 2 * marks))

    def of(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        total, repeated = 0, 0
        tallies: list[tuple[np.ndarray, np.ndarray]] = []
        for piece in chunks(data):
            words = piece.split()
            total += len(words)
            repeated += sum(map(eq, words, islice(words, 1, None)))
            tally = Counter(words)
            self._learn(tally)
            at = np.fromiter(map(self.index.__getitem__, tally), np.int64, len(tally))
            facts = np.frombuffer(self.facts, np.int32).reshape(-1, 3)[at] if len(at) else (
                np.empty((0, 3), np.int32))
            tallies.append((facts, np.fromiter(tally.values(), np.int64, len(tally))))
        facts = np.concatenate([t[0] for t in tallies])
        counts = np.concatenate([t[1] for t in tallies])
        both = np.concatenate([facts[:, 0], facts[:, 1] + self.dimensions])
        numbers, inverse = np.unique(both, return_inverse=True)
        values = 1 + np.log2(np.bincount(inverse, np.tile(counts, 2), len(numbers)))
        values[numbers >= self.dimensions] *= 0.5
        style = facts[:, 2]
        shares = [counts[style % 2 > 0].sum(), counts[style > 1].sum(), repeated]
        steps = [self._number(b"s%d:%d" % (k, min(10, int(20 * n / max(total, 1)))))
                 for k, n in enumerate(shares)]
        # a long text has more chance words: damp them without hiding a few telling ones
        values = values / max(1.0, total / 50) ** 0.25
        return (np.append(numbers % self.dimensions, steps).astype(np.int32),
                np.append(values, [4.0] * len(steps)).astype(np.float32))


_BLOCK = 1 << 18  # features that the fit handles at once


@dataclass
class OrdinalModel:
    """P(grade <= k) = sigmoid(thresholds[k] - weights . features); thresholds rise."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, numbers: np.ndarray, values: np.ndarray) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2), ... of one text."""
        return _sigmoid(float(self.weights[numbers] @ values) - self.thresholds)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _chosen(source: np.ndarray, used: np.ndarray, target: np.ndarray) -> np.ndarray:
    """``source[used]`` in ``target``, block by block."""
    start = 0
    for at in range(0, len(source), _BLOCK):
        part = source[at:at + _BLOCK][used[at:at + _BLOCK]]
        target[start:start + len(part)] = part
        start += len(part)
    return target


def _joined(column: pa.ChunkedArray, order: np.ndarray, sizes: np.ndarray, kind: type) -> np.ndarray:
    """The bytes of all rows of ``column``, in ``order``, as one array; ``sizes`` are its rows' lengths."""
    starts = np.zeros(len(order), np.int64)
    starts[order] = np.cumsum(sizes[order]) - sizes[order]
    joined = np.empty(int(sizes.sum()), kind)
    for start, x in zip(starts.tolist(), column):
        own = np.frombuffer(x.as_buffer(), kind)
        joined[start:start + len(own)] = own
    return joined


def fit_ordinal(
    grades: np.ndarray, rows: np.ndarray, numbers: np.ndarray, values: np.ndarray, n_grades: int,
    dimensions: int = DIMENSIONS, min_rows: int = 8, rounds: int = 200, rate: float = 0.04,
    decay: float = 3e-4,
) -> OrdinalModel:
    """Full-batch Adam on the cumulative-link likelihood of sparse rows, from zero weights: the
    same rows in the same order give the same model. Grades count alike, not by frequency;
    features of fewer than ``min_rows`` rows keep weight 0."""
    tally = np.zeros(dimensions, np.int64)
    for at in range(0, len(numbers), _BLOCK):
        tally += np.bincount(numbers[at:at + _BLOCK], minlength=dimensions)
    common = np.flatnonzero(tally >= min_rows)
    place = np.full(dimensions, -1, np.int32)
    place[common] = np.arange(len(common), dtype=np.int32)
    # 32 bits for what is kept for all features; what is derived from them is made block by block, and
    # each argument goes before the next is copied
    kept = int(tally[common].sum())
    used = np.empty(len(numbers), bool)
    for at in range(0, len(numbers), _BLOCK):
        used[at:at + _BLOCK] = place[numbers[at:at + _BLOCK]] >= 0
    rows = _chosen(rows, used, np.empty(kept, np.int32))
    values = _chosen(values, used, np.empty(kept, values.dtype))
    numbers = _chosen(numbers, used, np.empty(kept, np.int32))
    del used
    blocks = [slice(at, at + _BLOCK) for at in range(0, kept, _BLOCK)]
    for part in blocks:
        numbers[part] = place[numbers[part]]
    full, dimensions = dimensions, len(common)
    n = len(grades)
    share = np.bincount(grades, minlength=n_grades)
    weight = (1 / np.maximum(share, 1))[grades] / np.count_nonzero(share)
    # thresholds as a first value and logarithms of gaps, so that they always rise
    params = np.zeros(dimensions + n_grades - 1)
    mean, spread = np.zeros_like(params), np.zeros_like(params)
    ends = np.arange(n_grades + 1)

    def thresholds(free: np.ndarray) -> np.ndarray:
        return np.cumsum(np.concatenate([free[:1], np.exp(np.clip(free[1:], -5, 5))]))

    for step in range(1, rounds + 1):
        free = params[dimensions:]
        cuts = thresholds(free)
        edges = np.concatenate([[-40.0], cuts, [40.0]])
        score = np.zeros(n)
        for part in blocks:
            score += np.bincount(rows[part], values[part] * params[numbers[part]], minlength=n)
        upper, lower = _sigmoid(edges[ends[grades] + 1] - score), _sigmoid(edges[grades] - score)
        chance = np.maximum(upper - lower, 1e-9)
        du, dl = upper * (1 - upper) / chance, lower * (1 - lower) / chance
        by_score = weight * (du - dl)  # of the negative log-likelihood
        by_cut = np.zeros(n_grades + 1)
        np.add.at(by_cut, grades + 1, -weight * du)
        np.add.at(by_cut, grades, weight * dl)
        by_cut = by_cut[1:-1]
        chain = np.cumsum(by_cut[::-1])[::-1]
        chain[1:] *= np.exp(np.clip(free[1:], -5, 5))
        slope = np.concatenate([decay * params[:dimensions], chain])
        for part in blocks:
            slope[:dimensions] += np.bincount(
                numbers[part], values[part] * by_score[rows[part]], minlength=dimensions)
        mean = 0.9 * mean + 0.1 * slope
        spread = 0.99 * spread + 0.01 * slope * slope
        params -= rate * (mean / (1 - 0.9 ** step)) / (np.sqrt(spread / (1 - 0.99 ** step)) + 1e-8)
    weights = np.zeros(full, np.float32)
    weights[common] = params[:dimensions]
    return OrdinalModel(weights, thresholds(params[dimensions:]))


def rated(labels: DataFrame) -> DataFrame:
    """doc_id and grade from labels: 0 of low quality, 1 good but toxic, 2 good. Ratings without
    a quality are left out; a null ``toxic`` is 0; of several, the lowest grade counts."""
    grade = F.when(F.col("quality") == 0, 0).when(F.coalesce("toxic", F.lit(0)) == 1, 1).otherwise(2)
    return labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(
        F.min(grade).alias("grade"))


def train(
    docs: DataFrame,
    grades: DataFrame,
    n_grades: int = 3,
    sample_rows: int = SAMPLE_ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> OrdinalModel | None:
    """A model from at most about ``sample_rows`` rated documents; None if none is rated.

    The sample is bounded by its documented parameter: rated ids below a hash limit that lets
    about as many through, the same at every run, with one text each (of several, that with the
    least hash). Only its hashed features reach the driver
    (features of a text are at most as many as ``DIMENSIONS``).
    """
    n_rated = grades.count()
    if not n_rated:
        return None
    limit = min(1.0, sample_rows / n_rated)
    chosen = grades.where(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30)) < int(limit * (1 << 30)))
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), text_bytes(text_col).alias("text"))
    sample = texts.join(F.broadcast(chosen), F.col("_id") == chosen["doc_id"]).groupBy("_id").agg(
        F.first("grade").alias("grade"), F.min_by("text", F.xxhash64("text")).alias("text"))

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            found = [features.of(x.as_py()) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([
                batch.column("_id"), batch.column("grade").cast(pa.int32()),
                pa.array([f[0].tobytes() for f in found], pa.binary()),
                pa.array([f[1].tobytes() for f in found], pa.binary()),
            ], names=["id", "grade", "numbers", "values"])

    rows = sample.mapInArrow(featured, "id long, grade int, numbers binary, values binary").toArrow()
    if not len(rows):
        return None
    # the driver holds what is fitted and no second copy of it: a column goes once it is joined
    order = np.argsort(np.array(rows["id"]), kind="stable")
    sizes = np.array(pc.binary_length(rows["numbers"]), np.int64) // 4
    grades = np.array(rows["grade"])[order]
    numbers = [_joined(rows["numbers"], order, sizes, np.int32)]
    rows = rows.drop_columns("numbers")
    values = [_joined(rows["values"], order, sizes, np.float32)]
    del rows
    pa.default_memory_pool().release_unused()
    # popped, so that the fit can let go of them
    return fit_ordinal(
        grades, np.repeat(np.arange(len(order), dtype=np.int32), sizes[order]), numbers.pop(), values.pop(), n_grades)


def grade_documents(
    docs: DataFrame,
    model: OrdinalModel | None,
    text_col: str = "text",
    select_grade: int = 2,
    at_least: float = 0.5,
) -> DataFrame:
    """All columns of ``docs`` and a struct column ``_grade``: expected (the mean grade), tails
    (P(grade >= 1), P(grade >= 2), ...), kept (P(grade >= select_grade) >= at_least).

    Texts are read whole, one row at a time; nothing is shuffled, and the broadcast model has
    ``DIMENSIONS`` weights whatever the corpus. Null text is an empty text, whose grade comes
    from the thresholds alone. Without a model (nothing was rated) the numbers are null and every
    document is kept. An existing column ``_grade`` is replaced.
    """
    kind = "struct<expected: double, tails: array<double>, kept: boolean>"
    if model is None:
        return docs.withColumn("_grade", F.from_json(F.lit('{"kept": true}'), kind))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def graded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        features, known = Features(), shared.value
        for texts in batches:
            tails = [known.tails(*features.of(x.as_py())) for x in texts]
            yield pa.StructArray.from_arrays([
                pa.array([float(t.sum()) for t in tails], pa.float64()),
                pa.array([t.tolist() for t in tails], pa.list_(pa.float64())),
                pa.array([bool(t[select_grade - 1] >= at_least) for t in tails], pa.bool_()),
            ], names=["expected", "tails", "kept"])

    graded.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return docs.withColumn("_grade", F.arrow_udf(graded, kind)(text_bytes(text_col)))


def op6_ordinal_quality(spark, sf_dir: str) -> DataFrame:
    """Expected grade, tail probabilities and the selection of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, rated(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return grade_documents(docs, model).select(
        "doc_id", F.col("_grade.expected").alias("expected_grade"),
        F.get("_grade.tails", F.lit(0)).alias("p_fair"), F.get("_grade.tails", F.lit(1)).alias("p_good"),
        "_grade.kept")
