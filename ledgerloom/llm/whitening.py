"""Whitening of embeddings by the exact characteristic polynomial of their scatter.

Entries become whole numbers, so the scatter of all vectors is summed up exactly.
Its characteristic polynomial is computed modulo many primes, one Hessenberg
reduction each in Spark tasks, and put together by Chinese remainders. As all
roots are real, the signs of its shifted coefficients count the roots above any
point, which isolates the eigenvalues; bisection refines them to 192 bits.
Components are null-space vectors by inverse iteration in fixed-point numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction
from math import comb, isqrt, prod, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCALE = 64
COMPONENTS = 32
# Scaled entries beyond this count as this; doubles below it are exact.
MOST = 1 << 52
LIMB = 20
# Bits of an eigenvalue, and of the fixed-point numbers its vector is solved in.
VALUE_BITS = 192
VECTOR_BITS = 448
# Eigenvalues that agree in so many bits share a space of vectors.
SAME_BITS = 160


def finite(vector: Column) -> Column:
    """Not null and not empty, without null or non-finite entries."""
    entries = F.forall(vector, lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False)))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & entries, F.lit(False))


def _whole(column: pa.Array, dims: int) -> np.ndarray:
    """floor(64 c) of a batch of vectors."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, dims)
    return np.clip(np.floor(SCALE * values), -MOST, MOST).astype(np.int64)


def exact_products(whole: np.ndarray) -> np.ndarray:
    """Sum of the outer products of the rows, as Python integers.

    Floating-point products are exact as long as they stay below 2**53, so rows
    are cut into batches, and large entries into limbs.
    """
    dims = whole.shape[1]
    total = np.zeros((dims, dims), object)
    limbs, rest = [], whole
    while len(rest) and np.abs(rest).max() >= 1 << LIMB:
        limbs.append(rest & ((1 << LIMB) - 1))
        rest = rest >> LIMB
    limbs.append(rest)
    step = 1 << (53 - 2 * LIMB)
    for start in range(0, len(whole), step):
        parts = [limb[start : start + step].astype(np.float64) for limb in limbs]
        for i, left in enumerate(parts):
            for j, right in enumerate(parts):
                product = (left.T @ right).astype(np.int64).astype(object)
                total += product << (LIMB * (i + j)) if i + j else product
    return total


def scatter(vectors: DataFrame, dims: int) -> tuple[int, list[int], np.ndarray]:
    """Number of vectors, sums per dimension and n times their scatter about the mean, all exact.

    Every task sends one number per pair of dimensions, which Spark adds up.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, line, square = 0, np.zeros(dims, object), np.zeros((dims, dims), object)
        for batch in batches:
            if batch.num_rows:
                whole = _whole(batch.column(0), dims)
                count += len(whole)
                line += whole.astype(object).sum(0)
                square += exact_products(whole)
        if count:
            rows, columns = np.tril_indices(dims)
            values = [count, *line, *square[rows, columns]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([[-1], np.arange(dims), rows]), pa.int32()),
                    pa.array(np.concatenate([[-1], np.full(dims, -1), columns]), pa.int32()),
                    pa.array([Decimal(value) for value in values], pa.decimal128(38, 0)),
                ],
                ["i", "j", "value"],
            )

    added = vectors.mapInArrow(sums, "i int, j int, value decimal(38, 0)").groupBy("i", "j").agg(F.sum("value").alias("value"))
    # One row per pair of dimensions, however many vectors there are.
    values = {(row["i"], row["j"]): int(row["value"]) for row in added.collect()}
    if not values:
        return 0, [], np.zeros((0, 0), object)
    count, line = values[-1, -1], [values[i, -1] for i in range(dims)]
    matrix = np.zeros((dims, dims), object)
    for i in range(dims):
        for j in range(i + 1):
            matrix[i, j] = matrix[j, i] = count * values[i, j] - line[i] * line[j]
    return count, line, matrix


def _is_prime(number: int) -> bool:
    if any(number % small == 0 for small in (2, 3, 5, 7, 11, 13)):
        return False
    odd, twos = number - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):  # decides every number below 3,215,031,751
        value = pow(base, odd, number)
        if value not in (1, number - 1) and not any((value := value * value % number) == number - 1 for _ in range(twos - 1)):
            return False
    return True


def primes_above(bits: float) -> list[int]:
    """The largest primes below 2**31 whose product has more than ``bits`` bits, and one more."""
    found, product, number = [], 1, (1 << 31) - 1
    while product.bit_length() <= bits + 1:
        if _is_prime(number):
            found.append(number)
            product *= number
        number -= 2
    while not _is_prime(number):
        number -= 2
    return [*found, number]


def polynomial_modulo(matrix: np.ndarray, prime: int) -> np.ndarray:
    """Coefficients of det(x - matrix), constant first, by reduction to Hessenberg form."""
    size = len(matrix)
    h = (matrix % prime).astype(np.int64)
    for k in range(size - 2):
        below = np.flatnonzero(h[k + 1 :, k])
        if not len(below):
            continue
        pivot = k + 1 + below[0]
        if pivot != k + 1:
            h[[k + 1, pivot]] = h[[pivot, k + 1]]
            h[:, [k + 1, pivot]] = h[:, [pivot, k + 1]]
        factors = h[k + 2 :, k] * pow(int(h[k + 1, k]), -1, prime) % prime
        h[k + 2 :] = (h[k + 2 :] - factors[:, None] * h[k + 1] % prime) % prime
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2 :] * factors % prime).sum(1)) % prime
    polynomials = np.zeros((size + 1, size + 1), np.int64)
    polynomials[0, 0] = 1
    for k in range(1, size + 1):
        now = np.roll(polynomials[k - 1], 1)
        now -= polynomials[k - 1] * h[k - 1, k - 1] % prime
        weights, path = [], 1
        for i in range(1, k):
            path = path * int(h[k - i, k - i - 1]) % prime
            weights.append(int(h[k - 1 - i, k - 1]) * path % prime)
            if not path:
                break
        if weights:
            earlier = polynomials[k - 1 - len(weights) : k - 1][::-1]
            now -= (earlier * np.array(weights)[:, None] % prime).sum(0)
        polynomials[k] = now % prime
    return polynomials[size]


def characteristic_polynomial(spark: SparkSession, matrix: np.ndarray) -> list[int]:
    """Exact coefficients for a whole positive semidefinite matrix, constant first.

    The k-th elementary symmetric sum of eigenvalues that add up to t is at most
    comb(d, k) (t / d)**k, which bounds the primes needed. One more prime is
    kept to test the result.
    """
    size = len(matrix)
    trace = int(sum(matrix[i, i] for i in range(size)))
    most = max(comb(size, k) * (trace // size + 1) ** k for k in range(size + 1))
    primes = primes_above(most.bit_length() + 1)
    shared = spark.sparkContext.broadcast(matrix)

    def residues(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chosen = batch.column(0).to_pylist()
            found = [polynomial_modulo(shared.value, prime).tolist() for prime in chosen]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["prime", "rest"])

    tasks = min(len(primes), 4 * spark.sparkContext.defaultParallelism)
    frame = spark.createDataFrame([(prime,) for prime in primes], "prime long").repartition(tasks)
    rests = {row["prime"]: row["rest"] for row in frame.mapInArrow(residues, "prime long, rest array<long>").collect()}
    *used, last = primes
    product = prod(used)
    basis = [(prime, product // prime * pow(product // prime, -1, prime)) for prime in used]
    coefficients = []
    for place in range(size + 1):
        value = sum(rests[prime][place] * unit for prime, unit in basis) % product
        coefficients.append(value - product if 2 * value > product else value)
    if any((value - rest) % last for value, rest in zip(coefficients, rests[last])):
        raise ArithmeticError("the residues of the characteristic polynomial do not fit together")
    return coefficients


class _Roots:
    """Roots of a polynomial whose roots are all real and not negative."""

    def __init__(self, coefficients: list[int]):
        zeros = next(place for place, value in enumerate(coefficients) if value)
        self.coefficients = coefficients[zeros:]
        self.degree = len(self.coefficients) - 1

    def _stretched(self, shift: int) -> list[int]:
        """Coefficients whose roots are 2**shift times as large."""
        if shift >= 0:
            return [value << (shift * (self.degree - place)) for place, value in enumerate(self.coefficients)]
        return [value << (-shift * place) for place, value in enumerate(self.coefficients)]

    def above(self, point: int, shift: int) -> int:
        """How many roots are above point / 2**shift, each as often as it is one.

        Descartes' rule is exact where all roots are real.
        """
        rest = self._stretched(shift)
        signs = []
        for start in range(self.degree + 1):
            for place in range(self.degree - 1, start - 1, -1):
                rest[place] += point * rest[place + 1]
            if rest[start]:
                signs.append(rest[start] > 0)
        return sum(a != b for a, b in zip(signs, signs[1:]))

    def sign(self, point: int, shift: int) -> int:
        value = 0
        for coefficient in reversed(self._stretched(shift)):
            value = value * point + coefficient
        return (value > 0) - (value < 0)

    def _refined(self, point: int, shift: int, higher: int) -> Fraction:
        """The only root in (point, point + 1] / 2**shift; ``higher`` roots are above."""
        outside = -1 if higher % 2 else 1
        while point.bit_length() < VALUE_BITS:
            middle, shift = 2 * point + 1, shift + 1
            sign = self.sign(middle, shift)
            if not sign:
                return Fraction(middle) / Fraction(2) ** shift
            point = middle - 1 if sign == outside else middle
        return Fraction(2 * point + 1) / Fraction(2) ** (shift + 1)

    def largest(self, count: int) -> list[tuple[Fraction, int]]:
        """The largest positive roots, falling, each with how many are counted as it, ``count`` or more in all."""
        if not self.degree:
            return []
        bits = (-self.coefficients[-2]).bit_length()
        found, total = [], 0
        # Intervals (point, point + 1] / 2**shift with their roots and those above, the highest on top.
        stack = [(0, -bits, self.degree, 0)]
        while stack and total < count:
            point, shift, own, higher = stack.pop()
            if not own:
                continue
            if own == 1:
                found.append((self._refined(point, shift, higher), 1))
                total += 1
            elif point.bit_length() > SAME_BITS:
                found.append((Fraction(2 * point + 1) / Fraction(2) ** (shift + 1), own))
                total += own
            else:
                upper = self.above(2 * point + 1, shift + 1) - higher
                stack.append((2 * point, shift + 1, own - upper, higher + upper))
                stack.append((2 * point + 1, shift + 1, upper, higher))
        return found


def null_vectors(matrix: np.ndarray, value: Fraction, count: int, rounds: int = 3) -> np.ndarray:
    """Orthonormal vectors that ``matrix - value`` all but maps to zero, by inverse iteration."""
    size, bits = len(matrix), VECTOR_BITS
    unit = max(int(abs(entry)) for entry in matrix.ravel()).bit_length()
    a = np.array([[int(entry) << (bits - unit) if bits >= unit else int(entry) >> (unit - bits) for entry in row] for row in matrix], object)
    moved = round(value * Fraction(2) ** (bits - unit))
    for place in range(size):
        a[place, place] -= moved
    order = list(range(size))
    for k in range(size):
        pivot = max(range(k, size), key=lambda row: abs(a[row, k]))
        if pivot != k:
            a[[k, pivot]] = a[[pivot, k]]
            order[k], order[pivot] = order[pivot], order[k]
        if not a[k, k]:
            a[k, k] = 1
        if k + 1 < size:
            factors = (a[k + 1 :, k] << bits) // a[k, k]
            a[k + 1 :, k] = factors
            a[k + 1 :, k + 1 :] -= (factors[:, None] * a[k, k + 1 :][None, :]) >> bits
    draw = np.random.default_rng(3)
    vectors = [np.array([int(x) << bits for x in draw.integers(1, 1000, size)], object) for _ in range(count)]
    for _ in range(rounds):
        for number, vector in enumerate(vectors):
            solved = vector[order]
            for k in range(size - 1):
                solved[k + 1 :] -= (a[k + 1 :, k] * solved[k]) >> bits
            for k in range(size - 1, -1, -1):
                solved[k] = (solved[k] << bits) // a[k, k]
                if k:
                    solved[:k] -= (a[:k, k] * solved[k]) >> bits
            solved = _unit(solved, bits)
            for other in vectors[:number]:
                solved = _unit(solved - ((other * (int((other * solved).sum()) >> bits)) >> bits), bits)
            vectors[number] = solved
    result = np.array([[float(Fraction(int(entry), 1 << bits)) for entry in vector] for vector in vectors])
    signs = np.sign(np.take_along_axis(result, np.abs(result).argmax(1)[:, None], 1))
    return result * np.where(signs == 0, 1, signs)


def _unit(vector: np.ndarray, bits: int) -> np.ndarray:
    length = isqrt(int((vector * vector).sum())) or 1
    return np.array([(int(entry) << bits) // length for entry in vector], object)


@dataclass
class Whitening:
    """Fitted on ``count`` vectors with ``sums`` of floor(64 c); ``roots`` are the eigenvalues times count**2."""

    dims: int
    count: int
    sums: list[int]
    vectors: np.ndarray
    roots: list[Fraction]
    trace: int

    @property
    def explained(self) -> np.ndarray:
        return np.array([float(root / self.trace) for root in self.roots])

    def centred(self, whole: np.ndarray) -> np.ndarray:
        """n x - S, in 64 bits where they suffice."""
        most = int(np.abs(whole).max()) * self.count + max(map(abs, self.sums))
        kind = np.int64 if most < 1 << 62 else object
        return whole.astype(kind) * self.count - np.array(self.sums, kind)

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        scales = np.array([sqrt(root) for root in self.roots])
        return centred.astype(np.float64) @ self.vectors.T / scales


def usable(embeddings: DataFrame, id_column: str, vector: str) -> tuple[DataFrame, int]:
    """``id`` and ``vector`` of the finite vectors of the most frequent length, and that length."""
    rows = embeddings.select(F.col(id_column).alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    rows = rows.where(finite(F.col("vector")))
    sizes = rows.groupBy(F.size("vector").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    dims = sizes["dims"] if sizes else 0
    return rows.where(F.size("vector") == dims), dims


def fit(rows: DataFrame, dims: int, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of vectors of equal length; None if they do not vary at all."""
    spark = rows.sparkSession
    count, sums, matrix = scatter(rows.select("vector"), dims) if dims else (0, [], np.zeros((0, 0), object))
    trace = int(sum(matrix[i, i] for i in range(dims))) if count else 0
    if not trace:
        return None
    found = _Roots(characteristic_polynomial(spark, matrix)).largest(min(components, dims))
    shared = spark.sparkContext.broadcast((matrix, found))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, values = shared.value
        for batch in batches:
            numbers = batch.column(0).to_pylist()
            solved = [null_vectors(whole, *values[number]).tolist() for number in numbers]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(solved, pa.list_(pa.list_(pa.float64())))], ["number", "vectors"]
            )

    # One row per eigenvalue: at most ``components`` vectors and the rest of a last space of equal ones.
    frame = spark.createDataFrame([(number,) for number in range(len(found))], "number int").repartition(len(found))
    solved = {row["number"]: row["vectors"] for row in frame.mapInArrow(solve, "number int, vectors array<array<double>>").collect()}
    vectors = np.array([vector for number in range(len(found)) for vector in solved[number]])
    roots = [value for value, times in found for _ in range(times)]
    return Whitening(dims, count, sums, vectors[:components], roots[:components], trace)


def _identity_error(rows: DataFrame, fitted: Whitening) -> float:
    """Largest entry of the whitened rows' covariance minus the identity."""
    size = len(fitted.roots)
    shared = rows.sparkSession.sparkContext.broadcast(fitted)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, count, line, square = shared.value, 0, np.zeros(size), np.zeros((size, size))
        for batch in batches:
            if not batch.num_rows:
                continue
            values = model.whitened(model.centred(_whole(batch.column(1), model.dims)))
            # Products of values about their own mean, moved to the mean of both lots.
            mean, own = values.mean(0), len(values)
            gap = mean - line
            square += (values - mean).T @ (values - mean) + np.outer(gap, gap) * (count * own / (count + own))
            count += own
            line += gap * (own / count)
        if count:
            i, j = np.tril_indices(size)
            about = square[i, j] + count * line[i] * line[j]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([np.arange(size), i]), pa.int32()),
                    pa.array(np.concatenate([np.full(size, -1), j]), pa.int32()),
                    pa.array(np.concatenate([count * line, about])),
                ],
                ["i", "j", "value"],
            )

    added = rows.mapInArrow(sums, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value"))
    values = {(row["i"], row["j"]): row["value"] / fitted.count for row in added.collect()}
    mean = [values[i, -1] for i in range(size)]
    return max(abs(values[i, j] - mean[i] * mean[j] - (i == j)) for i in range(size) for j in range(i + 1))


def whiten(embeddings: DataFrame, id_column: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Every vector's whitened components, one row each, from the largest eigenvalue down.

    Vectors that are null, empty, hold null or non-finite entries or have
    another length than most take no part. Entries are floor(64 c), cut at
    2**52; adding a constant to all of them would change nothing below. Returns
    the id, ``component`` from 1, ``n`` (vectors), ``deviation`` (sum of squares
    of n x - S, exact; null beyond 64 bits), ``whitened``, ``explained`` (share
    of all variance) and ``identity_error`` (of the covariance of all rows).
    Components without variance have no rows; equal vectors, a single one and an
    empty table thus give none. Ids may repeat or be null; equal eigenvalues
    share a space in which any orthonormal vectors serve. Other columns are not
    read. Only sums per pair of dimensions, residues and vectors of the
    components reach the driver.
    """
    spark = embeddings.sparkSession
    rows, dims = usable(embeddings, id_column, vector)
    id_type = rows.schema["id"].dataType.simpleString()
    fitted = fit(rows, dims, components)
    shape = f"`{id_column}` {id_type}, component int, deviation long, whitened double, explained double"
    if fitted is None:
        empty = spark.createDataFrame([], shape)
        return _ordered(empty.withColumns({"n": F.lit(0).cast("long"), "identity_error": F.lit(0.0)}), id_column)
    error = _identity_error(rows, fitted)
    shared = spark.sparkContext.broadcast(fitted)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        size, explained = len(model.roots), model.explained
        for batch in batches:
            if not batch.num_rows:
                continue
            centred = model.centred(_whole(batch.column(1), model.dims))
            exact = int(np.abs(centred).max()) ** 2 * model.dims < 1 << 63
            squares = (centred if exact else centred.astype(object)) ** 2
            totals = [int(total) if total < 1 << 63 else None for total in squares.sum(1)]
            each = np.repeat(np.arange(batch.num_rows), size)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, size + 1, dtype=np.int32), batch.num_rows)),
                    pa.array(totals, pa.int64()).take(pa.array(each)),
                    pa.array(model.whitened(centred).ravel()),
                    pa.array(np.tile(explained, batch.num_rows)),
                ],
                [id_column, "component", "deviation", "whitened", "explained"],
            )

    projected = rows.mapInArrow(project, shape)
    return _ordered(projected.withColumns({"n": F.lit(fitted.count).cast("long"), "identity_error": F.lit(error)}), id_column)


def _ordered(df: DataFrame, id_column: str) -> DataFrame:
    return df.select(id_column, "component", "n", "deviation", "whitened", "explained", "identity_error")
