"""Whitened embeddings by spectrum slicing of the covariance.

Entries become whole numbers x = floor(256 * c).  The fit list, each distinct vector
once, gives their covariance V (divisor: the number of vectors).  Tasks centre the
vectors by the rounded means, so the products are sums of small whole numbers: they are
added up exactly, in any order, and the rest of the means is taken off exactly too.

An LDL' factorisation of V - shift with symmetric pivoting (blocks of one or two) has
as many positive pivots as V has eigenvalues above the shift (Sylvester's law).  By
such counts bisection isolates each leading eigenvalue from those above and below it;
Rayleigh quotient iteration, which converges cubically, then finds it with its vector,
kept orthogonal to those before; and counts on both sides of what it found certify its
number.  Equal eigenvalues, which no shift tells apart, are certified as a group.

V is dimension by dimension, whatever the number of rows; only it, the sums and one row
of 4 by 4 check values reach the driver.  Rows are never shuffled but for the distinct
vectors, which are aggregated in the tasks first.

Defined results: rows whose vector is null or empty, or holds null, NaN or infinite
entries, are left out, as are those with an entry of 2**44 or more in size and those whose
dimension is not the commonest one (of equally common ones, the largest); repeated rows and
null ids are kept; a component without variance has no whitened values (null) and does not
count in the identity's error; a deviation that no long can hold is null; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tallyframe.llm.common import named, staged, table

SCALE = 256
LIMIT = 2.0**44
COMPONENTS = 4
ROWS_AT_ONCE = 4096
EXACT = 1 << 53  # whole numbers up to here are exact as doubles
TURNS = 100  # of halving an interval until the quotient stays in it
ALPHA = (1 + 17**0.5) / 8  # Bunch and Parlett's bound for pivots of one


def pivots(matrix: np.ndarray) -> tuple[int, int]:
    """(positive, zero) pivots of the LDL' factorisation with complete symmetric pivoting."""
    a = np.array(matrix, float)
    positive = zero = 0
    while a.size:
        n = a.shape[0]
        diagonal = np.abs(np.diagonal(a))
        k = int(diagonal.argmax())
        off = np.abs(np.tril(a, -1))
        i, j = divmod(int(off.argmax()), n)
        if not max(diagonal[k], off[i, j]) > 0:
            return positive, zero + n
        if diagonal[k] >= ALPHA * off[i, j]:
            keep = np.delete(np.arange(n), k)
            positive += a[k, k] > 0
            column = a[keep, k]
            a = a[np.ix_(keep, keep)] - np.outer(column, column) / a[k, k]
        else:  # the block's determinant is negative: one pivot of either sign
            keep = np.delete(np.arange(n), [i, j])
            positive += 1
            block, columns = a[np.ix_([i, j], [i, j])], a[np.ix_(keep, [i, j])]
            a = a[np.ix_(keep, keep)] - columns @ np.linalg.solve(block, columns.T)
            a = (a + a.T) / 2
    return int(positive), zero


def above(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues are greater than the shift."""
    return pivots(matrix - shift * np.eye(len(matrix)))[0]


def isolated(matrix: np.ndarray, number: int, low: float, high: float, least: float) -> tuple[float, float]:
    """An interval with the eigenvalue of this number (from 1, falling) and, unless it is narrower
    than ``least``, no other; ``low`` has at least so many eigenvalues above it, ``high`` fewer."""
    up, down = above(matrix, high), above(matrix, low)
    while (up != number - 1 or down != number) and high - low > least:
        middle = (low + high) / 2
        n = above(matrix, middle)
        if n >= number:
            low, down = middle, n
        else:
            high, up = middle, n
    return low, high


def leading(matrix: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their unit eigenvectors as columns.

    A vector's sign makes its entry of largest size (the first of equals) positive.
    """
    d = len(matrix)
    wanted = min(wanted, d)
    scale = float(np.abs(matrix).sum(1).max()) or 1.0  # bounds every eigenvalue
    tiny = 4 * d * np.finfo(float).eps * scale
    values, vectors = np.zeros(wanted), np.zeros((d, wanted))
    draw = np.random.default_rng(12)

    def orthogonal(x: np.ndarray, k: int) -> np.ndarray:
        for _ in range(2):
            x = x - vectors[:, :k] @ (vectors[:, :k].T @ x)
        return x / np.linalg.norm(x)

    def solved(shift: float, x: np.ndarray) -> np.ndarray:
        while True:
            try:
                y = np.linalg.solve(matrix - shift * np.eye(d), x)
                if np.isfinite(y).all() and y.any():
                    return y / np.abs(y).max()
            except np.linalg.LinAlgError:
                pass
            shift += np.finfo(float).eps * scale  # exactly singular: beside it

    for k in range(wanted):
        low, high = isolated(matrix, k + 1, -scale - tiny, scale + tiny, tiny)
        x = orthogonal(draw.standard_normal(d), k)
        for _ in range(TURNS):
            # Inverse iteration at the middle brings the quotient into the interval; then it is the shift.
            for _ in range(3):
                x = orthogonal(solved((low + high) / 2, x), k)
            value, residual = 0.0, np.inf
            for _ in range(30):
                value = float(x @ matrix @ x)
                now = float(np.linalg.norm(matrix @ x - value * x))
                if now >= residual / 2 and now <= tiny:
                    break
                residual = now
                x = orthogonal(solved(value, x), k)
            middle = (low + high) / 2
            if now <= tiny and low - tiny <= value <= high + tiny:
                break
            # It went to a neighbour: halve the interval.
            low, high = (middle, high) if above(matrix, middle) > k else (low, middle)
        else:
            raise ArithmeticError(f"no vector was found for eigenvalue {k + 1}")
        # Certified: at least k + 1 eigenvalues above it less the error, at most k above it plus the error,
        # or more where they are equal within the error.
        if above(matrix, value - 2 * tiny) < k + 1 or above(matrix, value + 2 * tiny) > k:
            raise ArithmeticError(f"eigenvalue {k + 1} could not be certified")
        values[k], vectors[:, k] = value, x * np.sign(x[np.abs(x).argmax()])
    return values, vectors


def vectors_of(batch: pa.RecordBatch, name: str, d: int) -> np.ndarray:
    column = batch.column(batch.schema.names.index(name))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def sums_in(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[pa.RecordBatch]:
    """(i, sum) over all rows of a task; i = d counts the rows."""
    total = [0] * d
    n = 0
    for batch in batches:
        x = vectors_of(batch, "x", d)
        n += len(x)
        for at in range(0, len(x), 1024):  # so many numbers of up to 2**52 fit a long
            total = [a + b for a, b in zip(total, x[at : at + 1024].sum(0).tolist())]
    yield pa.RecordBatch.from_arrays(
        [pa.array(range(d + 1), pa.int32()), pa.array([Decimal(v) for v in [*total, n]], pa.decimal128(38, 0))], names=["i", "v"]
    )


def products_in(batches: Iterator[pa.RecordBatch], centre: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(i, sum) of the products y_p * y_q, p <= q, of the centred vectors y of a task, exactly."""
    d = len(centre)
    total = np.zeros((d, d), object)
    for batch in batches:
        y = vectors_of(batch, "x", d) - centre
        most = int(np.abs(y).max(initial=1))
        rows = EXACT // (most * most)
        if rows:
            rows = min(rows, ROWS_AT_ONCE)
            for at in range(0, len(y), rows):  # every sum stays exact as a double
                part = y[at : at + rows].astype(float)
                total += (part.T @ part).astype("i8").astype(object)
        else:
            for row in y.astype(object):
                total += np.outer(row, row)
    upper = np.triu_indices(d)
    values = [Decimal(int(v)) for v in total[upper]]
    places = (upper[0] * d + upper[1]).astype("i4")
    yield pa.RecordBatch.from_arrays([pa.array(places), pa.array(values, pa.decimal128(38, 0))], names=["i", "v"])


def added_up(df: DataFrame) -> dict[int, int]:
    """The tasks' sums by place; as many rows as there are places."""
    return {r["i"]: int(r["v"]) for r in df.groupBy("i").agg(F.sum("v").cast("decimal(38,0)").alias("v")).collect()}


class Fit:
    """Number of vectors, sums, covariance (rounded once from exact fractions), components."""

    def __init__(self, fit: DataFrame, d: int, components: int) -> None:
        sums = added_up(fit.mapInArrow(lambda it: sums_in(it, d), "i int, v decimal(38,0)"))
        self.n = n = sums.pop(d)
        self.sums = [sums[i] for i in range(d)]
        centre = [(2 * s + n) // (2 * n) for s in self.sums]
        shift = np.array(centre, "i8")
        products = added_up(fit.mapInArrow(lambda it: products_in(it, shift), "i int, v decimal(38,0)"))
        rest = [s - n * c for s, c in zip(self.sums, centre)]
        self.covariance = np.zeros((d, d))
        for place, total in products.items():
            p, q = divmod(place, d)
            self.covariance[p, q] = self.covariance[q, p] = float(Fraction(n * total - rest[p] * rest[q], n * n))
        self.centre, self.rest = shift, np.array([float(Fraction(r, n)) for r in rest])
        self.values, self.vectors = leading(self.covariance, components)
        self.trace = float(np.trace(self.covariance))
        self.has_variance = self.values > 4 * d * np.finfo(float).eps * self.trace

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over the dimensions of (n * x - S)^2, exactly."""
        most = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums))
        if most * most * len(self.sums) < 1 << 63:
            centred = self.n * x - np.array(self.sums, "i8")
            return (centred * centred).sum(1).tolist()
        centred = self.n * x.astype(object) - np.array(self.sums, object)
        return [v if v < 1 << 63 else None for v in (centred * centred).sum(1).tolist()]

    def whitened(self, x: np.ndarray) -> np.ndarray:
        centred = (x - self.centre) - self.rest
        return centred @ self.vectors / np.sqrt(np.where(self.has_variance, self.values, 1.0))


def projected(batches: Iterator[pa.RecordBatch], fit: Fit, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """For each row its columns but x, its deviation, and its whitened values."""
    d = len(fit.centre)
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            part = batch.slice(at, ROWS_AT_ONCE)
            x = vectors_of(part, "x", d)
            flat = pa.array(fit.whitened(x).ravel())
            ends = pa.array(np.arange(len(x) + 1) * len(fit.values), pa.int32())
            kept = [part.column(i) for i in range(part.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(fit.deviations(x), pa.int64()), pa.ListArray.from_arrays(ends, flat)], names=schema.names
            )


def whole_vectors(embeddings: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, x) of the rows whose vectors have only finite entries."""
    rows = named(embeddings, vec_id=id_col, v=vector_col).withColumn("v", F.col("v").cast("array<double>"))
    usable = F.forall("v", lambda c: F.coalesce(F.abs(c) < LIMIT, F.lit(False)))  # NaN is greater than all numbers
    x = F.transform("v", lambda c: F.floor(c * SCALE).cast("long"))
    return rows.filter(usable & (F.size("v") > 0)).select("vec_id", x.alias("x"))


def whitened(
    embeddings: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """For each usable row and component: (vec_id, component, n, deviation, whitened, explained, identity_error)."""
    rows = whole_vectors(embeddings, id_col, vector_col)
    spark = embeddings.sparkSession
    out = T.StructType(
        [rows.schema["vec_id"], T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()),
         T.StructField("deviation", T.LongType())] + [T.StructField(c, T.DoubleType()) for c in ("whitened", "explained", "identity_error")]
    )
    dimensions = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if dimensions is None:
        return spark.createDataFrame([], out)
    d = dimensions["d"]
    rows = rows.filter(F.size("x") == d)
    fit_list = staged(rows.select("x").distinct(), "whitening-fit")
    fit = Fit(fit_list, d, components)

    def values(df: DataFrame) -> DataFrame:
        fields = [*df.schema.fields[:-1], T.StructField("deviation", T.LongType()), T.StructField("w", T.ArrayType(T.DoubleType()))]
        schema = to_arrow_schema(T.StructType(fields))
        return df.mapInArrow(lambda it: projected(it, fit, schema), T.StructType(fields))

    numbers = [k for k, has in enumerate(fit.has_variance) if has]
    error = identity_error(values(fit_list), numbers)

    def constant(numbers_: list) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in numbers_]), F.col("place") + 1)

    each = values(rows).select("vec_id", "deviation", F.posexplode("w").alias("place", "w"))
    share = [float(v / fit.trace) if fit.trace else 0.0 for v in np.maximum(fit.values, 0.0)]
    return each.select(
        "vec_id", (F.col("place") + 1).alias("component"), F.lit(fit.n).cast("long").alias("n"), "deviation",
        F.when(constant([bool(h) for h in fit.has_variance]), F.col("w")).alias("whitened"),
        constant(share).alias("explained"), F.lit(error).alias("identity_error"),
    )


def identity_error(found: DataFrame, numbers: list[int]) -> float:
    """The largest entry, in size, of the whitened values' covariance (centred, by the JVM) less the identity."""
    if not numbers:
        return 0.0
    pairs = list(combinations_with_replacement(numbers, 2))
    w = [F.get("w", F.lit(k)) for k in range(max(numbers) + 1)]
    row = found.agg(*[F.covar_pop(w[p], w[q]).alias(f"c{p}_{q}") for p, q in pairs]).first()
    return max(abs(row[f"c{p}_{q}"] - (p == q)) for p, q in pairs)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings on their first four whitened components."""
    return whitened(table(spark, sf_dir, "embeddings"))
