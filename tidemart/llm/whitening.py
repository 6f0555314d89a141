"""Embedding whitening by the exact characteristic polynomial of an integer scatter matrix.

Vectors are integers x = floor(scale * c). Spark sums, over the distinct vectors, their entries and the products of their entries
centred on the integer below the mean, without rounding; so the covariance times n squared is a known integer matrix. Its
characteristic polynomial is found modulo one prime a Spark row and put together on the driver, where the matrix (dimension
squared) and all that follows from it is all there is: see charpoly.py. Rows are projected where they lie.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemart.llm import charpoly, scratch
from tidemart.llm.tables import table

SCALE, COMPONENTS = 256, 4
#: The polynomial's primes and the roots' arithmetic grow as the cube of the dimension and more; beyond this it would take hours.
MOST_DIMENSIONS = 1024
_EXACT = "decimal(38,0)"


def integers(vector: Column, scale: int = SCALE) -> Column:
    """array<bigint>, null for a vector that is null or has a null or non-finite entry."""
    finite = F.forall(vector, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float("inf")))
    return F.when(finite, F.transform(vector, lambda c: F.floor(c.cast("double") * scale).cast("long")))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _products(y: np.ndarray) -> np.ndarray:
    """y.T @ y of integers without rounding, as Python ints: in doubles as long as sums stay below 2^53, else in ints."""
    d = y.shape[1]
    top = max(int(y.max(initial=0)), -int(y.min(initial=0)), 1)
    rows = (1 << 53) // (top * top)
    out = np.zeros((d, d), object)
    if not rows:
        z = y.astype(object)
        return z.T @ z if len(z) else out
    for i in range(0, len(y), rows):
        part = y[i : i + rows].astype(np.float64)
        out += (part.T @ part).astype(np.int64).astype(object)
    return out


def _sums(vectors: DataFrame, d: int) -> list[int]:
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(d, object)
        for b in batches:
            x = _matrix(b.column(0), d)
            total += (x >> 31).sum(0).astype(object) * (1 << 31) + (x & ((1 << 31) - 1)).sum(0).astype(object)
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([Decimal(int(v)) for v in total], pa.decimal128(38, 0))], names=["i", "v"])

    found = vectors.mapInArrow(add, f"i int, v {_EXACT}").groupBy("i").agg(F.sum("v").alias("v")).collect()  # d rows
    return [int(v) for _, v in sorted((r.i, r.v) for r in found)]


def _scatter(vectors: DataFrame, d: int, n: int, sums: list[int]) -> charpoly.Matrix:
    """n squared times the covariance: products are summed about floor(sums / n), the rest is corrected exactly."""
    center = [s // n for s in sums]
    rest = [s - n * c for s, c in zip(sums, center, strict=True)]
    i, j = np.triu_indices(d)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d), object)
        about = np.array(center, np.int64)
        for b in batches:
            total += _products(_matrix(b.column(0), d) - about)
        arrays = [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([Decimal(int(v)) for v in total[i, j]], pa.decimal128(38, 0))]
        yield pa.RecordBatch.from_arrays(arrays, names=["i", "j", "v"])

    found = vectors.mapInArrow(add, f"i int, j int, v {_EXACT}").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()  # d * (d + 1) / 2 rows
    out = [[0] * d for _ in range(d)]
    for r in found:
        out[r.i][r.j] = out[r.j][r.i] = n * int(r.v) - rest[r.i] * rest[r.j]
    return out


def polynomial(spark: SparkSession, matrix: charpoly.Matrix) -> list[int]:
    """det(x - matrix), constant first; residues are rows of their own."""
    chosen = charpoly.enough_primes(matrix)
    parts = min(len(chosen), max(1, spark.sparkContext.defaultParallelism))

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ps = [chosen[k] for k in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(ps, pa.int64()), pa.array([charpoly.residues(matrix, p) for p in ps], pa.list_(pa.int64()))], names=["p", "c"])

    rows = spark.range(0, len(chosen), 1, parts).mapInArrow(reduce, "p long, c array<long>").collect()
    return charpoly.remaindered({r.p: list(r.c) for r in sorted(rows)})


def _root(numerator: int, denominator: int) -> float:
    """The square root of a ratio of integers to the last bit of a double, of whatever size they are."""
    shift = max(0, 256 - numerator.bit_length() + denominator.bit_length())
    shift += shift % 2
    return float(Decimal(isqrt((numerator << shift) // denominator)) / Decimal(1 << (shift // 2)))


def whitened(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """rows: id_col, vector_col (array of numbers; others are ignored). For each usable row and component from 1 to components: id_col, component int,
    n, deviation decimal(38,0), whitened, explained, identity_error.

    Vectors that are null or hold null, infinite or no numbers are left out; so are those of another length than the commonest among the distinct ones
    (of equals the longest). The fit is on the distinct integer vectors; repeated rows and null ids come back as rows of their own. Components with
    eigenvalue 0 can't be whitened and have no rows: so none if there are no two different vectors. Of equal eigenvalues' components any orthonormal
    ones are taken. Raises for more than MOST_DIMENSIONS.
    """
    spark = rows.sparkSession
    names = [T.StructField("id", rows.schema[id_col].dataType), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("deviation", T.DecimalType(38, 0))]
    schema = T.StructType([*names, *[T.StructField(c, T.DoubleType()) for c in ("whitened", "explained", "identity_error")]])
    usable = rows.select(F.col(id_col).alias("id"), integers(F.col(vector_col), scale).alias("x")).where("size(x) > 0")
    with scratch.scope(spark):
        distinct = scratch.written(usable.select("x").distinct(), "vectors")
        lengths = distinct.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
        if not lengths:
            return spark.createDataFrame([], schema).withColumnRenamed("id", id_col)
        d, n = lengths[0]
        if d > MOST_DIMENSIONS:
            raise ValueError(f"vectors have {d} dimensions, more than {MOST_DIMENSIONS}")
        same = F.size("x") == d
        fitted = distinct.where(same)
        sums = _sums(fitted, d)
        matrix = _scatter(fitted, d, n, sums)
        roots = charpoly.largest_roots(polynomial(spark, matrix), components)
        if not roots:
            return spark.createDataFrame([], schema).withColumnRenamed("id", id_col)
        axes = charpoly.vectors(matrix, roots)
        unit, trace = 1 << charpoly.PLACES, sum(matrix[k][k] for k in range(d))
        deviations = np.array([_root(r, unit * n * n) for r in roots])
        shares = [float(Decimal(r) / Decimal(unit * trace)) for r in roots]
        center = [s // n for s in sums]
        rest = [s - n * c for s, c in zip(sums, center, strict=True)]
        offset = np.array([float(Decimal(r) / Decimal(n)) for r in rest])
        about = np.array(center, np.int64)

        def project(y: np.ndarray) -> np.ndarray:
            return (y - offset) @ axes.T / deviations

        error = _identity_error(fitted, d, about, project)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            y = _matrix(b.column(1), d) - about
            k, count = len(roots), len(y)
            dev, w = _deviation(y, n, rest), project(y)
            times = np.repeat(np.arange(count), k)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(pa.array(times)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), count)), pa.array(np.full(count * k, n)),
                    dev.take(pa.array(times)), pa.array(w.ravel()), pa.array(np.tile(shares, count)), pa.array(np.full(count * k, error)),
                ],
                names=schema.names,
            )

    return usable.where(same).mapInArrow(apply, schema).withColumnRenamed("id", id_col)


def _deviation(y: np.ndarray, n: int, rest: list[int]) -> pa.Array:
    """Sums of (n * y - rest) squared, exactly, as decimals."""
    top = n * max(int(y.max()), -int(y.min()), 1) + max(rest, default=0)
    if len(rest) * top * top < 1 << 63:
        z = n * y - np.array(rest, np.int64)
        return pc.cast(pa.array((z * z).sum(1)), pa.decimal128(38, 0))
    z = n * y.astype(object) - np.array(rest, object)
    return pa.array([Decimal(int(v)) for v in (z * z).sum(1)], pa.decimal128(38, 0))


def _identity_error(fitted: DataFrame, d: int, about: np.ndarray, project) -> float:
    """The largest entry of the whitened vectors' covariance minus the identity. Tasks centre on their own mean; parts are joined about the whole mean."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                w = project(_matrix(b.column(0), d) - about)
                mean = w.mean(0)
                arrays = [[len(w)], [mean.tolist()], [((w - mean).T @ (w - mean)).ravel().tolist()]]
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=["n", "m", "c"])

    schema = "n long, m array<double>, c array<double>"
    parts = scratch.written(fitted.mapInArrow(part, schema), "parts")  # a row for each batch of vectors
    places = parts.select("n", F.posexplode("m").alias("i", "m"))
    n = parts.agg(F.sum("n")).first()[0]
    mean = [r.m for r in places.groupBy("i").agg((F.sum(F.col("n") * F.col("m")) / n).alias("m")).orderBy("i").collect()]  # one a component
    k = len(mean)
    off = [F.col("m")[i] - F.lit(mean[i]) for i in range(k)]
    sums = parts.agg(*[F.sum(F.col("c")[i * k + j] + F.col("n") * off[i] * off[j]).alias(f"s{i}_{j}") for i in range(k) for j in range(k)]).first()
    return float(np.abs(np.array(list(sums)).reshape(k, k) / n - np.eye(k)).max())


def op13_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deviation that no bigint can hold is null."""
    return whitened(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").try_cast("long"))
