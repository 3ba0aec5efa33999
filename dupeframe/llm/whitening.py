"""Operator 11: whitening of embeddings; eigenvalues by spectrum slicing."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from dupeframe.staging import stage

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
# Entries beyond this are taken as this: their doubles no longer tell neighbouring integers apart.
LARGEST = 1 << 53
_EXACT = 1 << 53
_DECIMAL = pa.decimal128(38, 0)


# -- spectrum of a symmetric matrix ------------------------------------------------------------


def inertia_above(matrix: np.ndarray, shift: float) -> int:
    """The number of eigenvalues above ``shift``: the positive pivots of an LDLᵀ factorisation of
    ``matrix - shift`` with 1 x 1 and 2 x 2 pivots (Bunch and Kaufman's choice), by Sylvester's law.
    """
    a = np.array(matrix, dtype=np.float64)
    a[np.diag_indices_from(a)] -= shift
    tiny = np.finfo(float).tiny
    limit, above = (1 + 17 ** 0.5) / 8, 0

    def swap(p: int, q: int) -> None:
        if p != q:
            a[[p, q]] = a[[q, p]]
            a[:, [p, q]] = a[:, [q, p]]

    k, size = 0, len(a)
    while k < size:
        column = np.abs(a[k + 1:, k])
        r = k + 1 + int(column.argmax()) if len(column) else k
        most, step = column.max(initial=0.0), 1
        if most > tiny and abs(a[k, k]) < limit * most:
            others = np.abs(a[r, k:])
            others[r - k] = 0
            along = others.max()
            if abs(a[k, k]) * along >= limit * most * most:
                pass
            elif abs(a[r, r]) >= limit * along:
                swap(k, r)
            else:
                swap(k + 1, r)
                step = 2
        if step == 1:
            pivot = a[k, k]
            above += pivot > 0
            if abs(pivot) > tiny:
                a[k + 1:, k + 1:] -= np.outer(a[k + 1:, k], a[k, k + 1:] / pivot)
        else:
            block = a[k:k + 2, k:k + 2]
            above += 1 if block[0, 0] * block[1, 1] < block[0, 1] ** 2 else 2 * int(block[0, 0] > 0)
            a[k + 2:, k + 2:] -= a[k + 2:, k:k + 2] @ np.linalg.solve(block, a[k:k + 2, k + 2:])
        k += step
    return int(above)


def _solve(matrix: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A solution that may be large: the shift may hit an eigenvalue exactly."""
    try:
        found = np.linalg.solve(matrix, right)
        if np.isfinite(found).all():
            return found
    except np.linalg.LinAlgError:
        pass
    nudge = np.finfo(float).eps * max(float(np.abs(matrix).max()), np.finfo(float).tiny)
    return np.linalg.solve(matrix + nudge * np.eye(len(matrix)), right)


def _start(matrix: np.ndarray, shift: float, known: np.ndarray, seed: int) -> np.ndarray:
    """A unit vector of the eigenspace near ``shift``, at right angles to the columns ``known``."""
    one = np.eye(len(matrix))

    def clean(z: np.ndarray) -> np.ndarray:
        for _ in range(2):
            z = z - known @ (known.T @ z)
        return z / np.linalg.norm(z)

    z = clean(np.random.default_rng(seed).standard_normal(len(matrix)))
    for _ in range(4):  # inverse iteration brings the quotient into the interval of its eigenvalue
        z = clean(_solve(matrix - shift * one, z))
    return z


def _refine(matrix: np.ndarray, precise: np.ndarray, z: np.ndarray, bounds: tuple[float, float],
            scale: float) -> tuple[float, np.ndarray] | None:
    """Rayleigh quotient iteration from ``z``, then two corrections whose residuals are taken
    in extended precision; None if the quotient leaves ``bounds``."""
    one = np.eye(len(matrix))
    for _ in range(30):
        quotient = float(z @ (matrix @ z))
        rest = np.linalg.norm(matrix @ z - quotient * z)
        if not bounds[0] <= quotient <= bounds[1]:
            return None
        if rest <= 4 * np.finfo(float).eps * scale:
            break
        after = _solve(matrix - quotient * one, z)
        after /= np.linalg.norm(after)
        z = after if after @ z >= 0 else -after
    wide = z.astype(np.longdouble)
    for _ in range(2):
        wide /= np.sqrt(wide @ wide)
        quotient = wide @ (precise @ wide)
        rest = (quotient * wide - precise @ wide).astype(np.float64)
        z = wide.astype(np.float64)
        bordered = np.block([[matrix - float(quotient) * one, -z[:, None]], [z[None, :], np.zeros((1, 1))]])
        step = _solve(bordered, np.append(rest, 0.0))[:-1]
        if np.linalg.norm(step) > 1e-3:  # a close neighbour: the iteration's own vector is as good
            break
        wide = wide + step
    wide /= np.sqrt(wide @ wide)
    return float(wide @ (precise @ wide)), wide.astype(np.float64)


def leading_eigenpairs(precise: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues (falling) and their unit eigenvectors (columns) of a symmetric,
    positive semidefinite matrix.

    Inertia counts of shifted matrices bisect the spectrum until an interval holds the k-th
    eigenvalue alone; Rayleigh quotient iteration converges inside it; two more counts, just below
    and just above the found value, certify that it is number k. Eigenvalues that agree to rounding are found
    together, as vectors at right angles in their joint space. Eigenvalues of no more than rounding size are left out,
    so there may be fewer than ``wanted``. A vector's largest entry is positive.
    """
    matrix = precise.astype(np.float64)
    size, scale = len(matrix), float(np.abs(matrix).sum(axis=1).max(initial=0.0))
    eps = np.finfo(float).eps
    floor = 8 * size * eps * scale
    values, vectors = [], np.zeros((size, 0))
    counts: dict[float, int] = {}

    def above(shift: float) -> int:
        if shift not in counts:
            counts[shift] = inertia_above(matrix, shift)
        return counts[shift]

    top = scale * (1 + 8 * eps)
    wanted = min(wanted, size, above(floor)) if scale > 0 else 0
    while len(values) < wanted:
        k = len(values) + 1  # above(low) >= k and above(high) < k hold throughout
        low = max([floor, *[s for s, n in counts.items() if n >= k]])
        high = min([top, *[s for s, n in counts.items() if n < k and s > low]])
        found = None
        while found is None:
            group = above(low) - k + 1
            if group == 1 and above(high) == k - 1 or high - low <= 16 * size * eps * scale:
                margin = 4 * size * eps * scale
                made = []
                for number in range(group):
                    basis = np.column_stack([vectors, *[v for _, v in made]])
                    start = _start(matrix, (low + high) / 2, basis, k + number)
                    pair = _refine(matrix, precise, start, (low - margin, high + margin), scale)
                    if pair is None or group > 1:  # equal to rounding: any basis of the space
                        v = start if pair is None or np.abs(basis.T @ pair[1]).max(initial=0) > 1e-9 else pair[1]
                        pair = (float(v @ (precise @ v)), v)
                        if group == 1 and not low - margin <= pair[0] <= high + margin:
                            made = []
                            break
                    made.append(pair)
                certain = len(made) == group and (
                    above(min(v for v, _ in made) - margin) >= k + group - 1
                    and above(max(v for v, _ in made) + margin) <= k - 1)
                if certain or high - low <= 16 * size * eps * scale:
                    found = sorted(made, key=lambda pair: -pair[0])
                    break
            middle = (low + high) / 2
            if above(middle) >= k:
                low = middle
            else:
                high = middle
        for value, vector in found:
            values.append(value)
            sign = 1.0 if vector[np.abs(vector).argmax()] > 0 else -1.0
            vectors = np.column_stack([vectors, sign * vector])
    return np.array(values[:wanted]), vectors[:, :wanted]


# -- vectors of a batch ------------------------------------------------------------------------


def _usable(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, lengths, entries one after the other) of the vectors without null or non-finite entries."""
    column = column.cast(pa.list_(pa.float64()))
    flat = column.flatten()
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    entries = flat.fill_null(np.nan).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    good = ~np.array(column.is_null(), dtype=bool) & (lengths > 0)
    good[owner[~np.isfinite(entries)]] = False
    return np.flatnonzero(good), lengths[good], entries[good[owner]]


def _integers(entries: np.ndarray, scale: int, shift: int) -> np.ndarray:
    """floor(scale * entry) + shift, within +-LARGEST."""
    with np.errstate(over="ignore"):
        scaled = np.floor(entries * scale)
    return np.clip(scaled, -LARGEST, LARGEST).astype(np.int64) + shift


def _of_length(column: pa.Array, dims: int, scale: int, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, matrix of integers) of the usable vectors with ``dims`` entries."""
    rows, lengths, entries = _usable(column)
    fits = lengths == dims
    return rows[fits], _integers(entries[np.repeat(fits, lengths)], scale, shift).reshape(-1, dims)


@dataclass
class Whitening:
    """What ``fit`` finds: ``n`` vectors, their exact sums, and unit eigenvectors (columns)."""

    n: int
    sums: list[int]
    trace: float
    eigenvalues: np.ndarray
    eigenvectors: np.ndarray
    scale: int
    shift: int

    @property
    def dims(self) -> int:
        return len(self.sums)


def fit(df: DataFrame, components: int = COMPONENTS, vector_col: str = "embedding",
        scale: int = SCALE, shift: int = SHIFT) -> Whitening:
    """The whitening of the vectors' integers x = floor(scale * entry) + shift, over all rows.

    Two passes. The first sums x by dimension, the second the products of y = x - floor(mean),
    in integers, added up by Spark for each pair of dimensions; from the sums of y and of its products the
    covariance is exact before it is rounded once. Only sums of that size (dimensions squared, whatever the rows) reach the
    driver, and neither the order of rows nor their partitions matter. Vectors of another length
    than the most frequent (ties: the longest) are not used, nor null, empty or non-finite ones.
    """
    read = df.select(F.col(vector_col).alias("vector"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, list] = {}
        for batch in batches:
            _, lengths, entries = _usable(batch.column("vector"))
            starts = np.cumsum(lengths) - lengths
            for dims in np.unique(lengths).tolist():
                at = starts[lengths == dims]
                x = _integers(entries[at[:, None] + np.arange(dims)], scale, shift)
                kept = totals.setdefault(dims, [0, [0] * dims])
                # halves of 32 bits: their sums over a batch fit 64 bits
                high, low = (x >> 32).sum(axis=0).tolist(), (x & 0xFFFFFFFF).sum(axis=0).tolist()
                kept[0] += len(x)
                kept[1] = [total + (h << 32) + w for total, h, w in zip(kept[1], high, low)]
        rows = [(dims, i, n, total) for dims, (n, sums) in totals.items() for i, total in enumerate(sums)]
        yield _batch(rows, [pa.int32(), pa.int32(), pa.int64(), _DECIMAL], ["dims", "i", "n", "total"])

    summed = read.mapInArrow(add, "dims int, i int, n long, total decimal(38,0)")
    lengths = summed.where("i = 0").groupBy("dims").agg(F.sum("n").alias("n")).orderBy(
        F.desc("n"), F.desc("dims")).limit(1).collect()
    if not lengths:
        return Whitening(0, [], 0.0, np.zeros(0), np.zeros((0, 0)), scale, shift)
    dims, n = lengths[0]
    sums = [0] * dims
    for i, total in summed.where(F.col("dims") == dims).groupBy("i").agg(F.sum("total")).collect():
        sums[i] = int(total)
    centre = np.array([total // n for total in sums], np.int64)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products: Counter = Counter()
        upper = np.triu_indices(dims)
        for batch in batches:
            _, x = _of_length(batch.column("vector"), dims, scale, shift)
            y = x - centre
            largest = int(np.abs(y).max(initial=0))
            if largest ** 2 * max(1, len(y)) < _EXACT:  # every sum of products is a double's integer
                values = (y.T.astype(np.float64) @ y.astype(np.float64))[upper].astype(np.int64)
            else:
                values = (y.T.astype(object) @ y.astype(object))[upper]
            for place, value in enumerate(values.tolist()):
                products[place] += value
        rows = [(int(upper[0][place]), int(upper[1][place]), value) for place, value in products.items()]
        yield _batch(rows, [pa.int32(), pa.int32(), _DECIMAL], ["i", "j", "total"])

    moments = read.mapInArrow(multiply, "i int, j int, total decimal(38,0)").groupBy("i", "j").agg(
        F.sum("total").alias("total")).collect()
    rest = [total - n * int(c) for total, c in zip(sums, centre)]
    precise = np.zeros((dims, dims), np.longdouble)
    for i, j, total in moments:
        exact = Fraction(n * int(total) - rest[i] * rest[j], n * n)
        precise[i, j] = precise[j, i] = _longdouble(exact)
    values, vectors = leading_eigenpairs(precise, components)
    return Whitening(n, sums, float(np.trace(precise)), values, vectors, scale, shift)


def _longdouble(value: Fraction) -> np.longdouble:
    """The fraction, rounded to extended precision."""
    if value == 0:
        return np.longdouble(0)
    bits = 70 - (value.numerator.bit_length() - value.denominator.bit_length())
    scaled = round(value * Fraction(2) ** bits)
    high, low = divmod(scaled, 1 << 32)
    return np.ldexp(np.longdouble(high) * np.longdouble(1 << 32) + np.longdouble(low), -bits)


def _batch(rows: list[tuple], kinds: list, names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def whiten(df: DataFrame, model: Whitening, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows (id, deviation decimal, whitened array<double>): the sum over dimensions of
    (n x - S)^2, exact (null beyond 38 digits), and (x - S/n) on each component over the root of its
    eigenvalue.

    One row for each used vector, repeated rows and ids included; a null id stays null. Map-only.
    """
    dims, n = model.dims, model.n
    scale, shift = model.scale, model.shift
    sums = model.sums
    centre = np.array([total // n for total in sums], np.int64) if n else np.zeros(0, np.int64)
    rest = np.array([total - n * int(c) for total, c in zip(sums, centre)], object)
    weights = model.eigenvectors / np.sqrt(model.eigenvalues)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not dims:
                continue
            rows, x = _of_length(batch.column("vector"), dims, scale, shift)
            y = x - centre
            largest = n * (int(np.abs(y).max(initial=0)) + 1)
            if largest ** 2 * dims < 1 << 63:
                apart = n * y - rest.astype(np.int64)
                squares = (apart * apart).sum(axis=1).tolist()
            else:  # beyond 64 bits: the same in Python's integers
                apart = n * y.astype(object) - rest
                squares = [s if s < 10 ** 38 else None for s in (apart * apart).sum(axis=1).tolist()]
            made = (apart.astype(np.float64) / n) @ weights
            yield pa.RecordBatch.from_arrays([
                batch.column("id").take(pa.array(rows)), pa.array(squares, _DECIMAL),
                pa.array(list(made), pa.list_(pa.float64()))], names=["id", "deviation", "whitened"])

    kind = df.schema[id_col].dataType.simpleString()
    read = df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
    return read.mapInArrow(run, f"id {kind}, deviation decimal(38,0), whitened array<double>").withColumnRenamed(
        "id", id_col)


def identity_error(whitened: DataFrame, components: int) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity."""
    if not components:
        return 0.0
    pairs = [(i, j) for i in range(components) for j in range(i, components)]
    row = whitened.agg(*[F.covar_pop(F.col("whitened")[i], F.col("whitened")[j]) for i, j in pairs]).first()
    return max(abs(value - (i == j)) for value, (i, j) in zip(row, pairs) if value is not None)


def op11_whitening(spark, sf_dir: str) -> DataFrame:
    """All embeddings on up to eight components; a deviation beyond 64 bits is null."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    model = fit(vectors)
    found = stage(whiten(vectors, model), "whitened")
    count = len(model.eigenvalues)
    if not count:
        return spark.createDataFrame([], StructType([StructField("vec_id", LongType())])).selectExpr(
            "vec_id", "0 AS component", "0L AS n", "0L AS deviation", "0D AS whitened", "0D AS explained",
            "0D AS identity_error")
    error = identity_error(found, count)
    explained = F.array(*[F.lit(float(e / model.trace)) for e in model.eigenvalues])
    return found.select("vec_id", "deviation", F.posexplode("whitened").alias("k", "whitened")).select(
        "vec_id", (F.col("k") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"),
        F.col("deviation").try_cast("long").alias("deviation"), "whitened", explained[F.col("k")].alias("explained"),
        F.lit(error).alias("identity_error"))
