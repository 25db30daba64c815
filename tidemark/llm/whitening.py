"""Embedding whitening by the covariance of exactly centred rows.

Entries become integers, x = floor(1024 * c) + 100000, so the sums S of the n
rows are exact and so is n * x - S; a row is centred by one division of that
number by n.  ``RowMatrix`` of Spark's MLlib sums the outer products of centred
rows (``computeGramianMatrix``), which divided by n is their covariance.  Its
eigenvectors are found on the driver, where a matrix of dimension by dimension
is all that arrives, and tasks project their rows on the first components and
divide by the square root of each eigenvalue.

What comes out has the identity as its covariance, and this is measured: the
whitened rows are centred, multiplied and summed once more.

Defined results: vectors that are null, hold null or non-finite components, hold
one beyond ``LARGEST`` (its sums would not be exact in 64 bits), or have another
length than most (of equally frequent lengths the shorter one stays) take no
part; zero vectors, rows without an id and repeated rows do.  Components in which
nothing varies can't be scaled to variance 1 and are left out, so a single row,
or equal ones, give no rows, as does an empty table.  A ``deviation`` beyond 64
bits is null.  Other columns are not read by ``digest``; ``whiten`` keeps them.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bound_batches, cut

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
LARGEST = float(1 << 40)
#: Eigenvalues up to this share of the largest one, times the dimension, are rounding and not variance.
_NOTHING = 1e-13


class Whitening(NamedTuple):
    """What was learned: rows and exact sums, and the components as rows with their eigenvalues and the trace."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    values: np.ndarray
    trace: float


def _points(rows: DataFrame, vector: str) -> DataFrame:
    """The rows that take part, packed in ``row``, with their integers ``x``."""
    value = F.col(vector).cast("array<double>")
    usable = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= LARGEST))
    packed = rows.select(F.struct("*").alias("row"), value.alias("v"))
    packed = packed.filter(F.col("v").isNotNull() & (F.size("v") > 0) & usable)
    points = packed.select("row", F.transform("v", lambda c: F.floor(c * float(SCALE)) + SHIFT).alias("x"))
    most = points.groupBy(F.size("x").alias("length")).count().orderBy(F.desc("count"), "length").first()
    return points.filter(F.size("x") == (most.length if most else 0))


def _matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    column = batch.column(name)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _sums(points: DataFrame) -> tuple[int, np.ndarray]:
    """Rows and exact sums of each dimension; tasks send one row a dimension."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            if batch.num_rows:
                here = _matrix(batch, "x").astype(np.int64).sum(0)
                n, total = n + batch.num_rows, here if total is None else total + here
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total, pa.int64()), pa.array([n] * len(total), pa.int64())], ["at", "part", "n"])

    parts = points.select("x").mapInArrow(add, "at int, part long, n long").groupBy("at").agg(F.sum("part").alias("s"), F.sum("n").alias("n")).orderBy("at").collect()
    return (parts[0].n, np.array([r.s for r in parts], np.int64)) if parts else (0, np.zeros(0, np.int64))


def covariance(centred: DataFrame, column: str, n: int, dimension: int) -> np.ndarray:
    """The Gramian of centred rows, given as arrays of doubles, divided by n."""
    vectors = MLUtils.convertVectorColumnsFromML(centred.select(array_to_vector(column).alias("v")), "v")
    return RowMatrix(vectors, n, dimension).computeGramianMatrix().toArray() / n


def _centred(x: Column, n: int, sums: np.ndarray) -> Column:
    """(n * x - S) / n: the subtraction is exact in integers, the division rounds once."""
    return F.zip_with(x, F.array(*(F.lit(int(s)) for s in sums)), lambda a, s: (F.lit(n) * a - s) / F.lit(float(n)))


def _fitted(points: DataFrame, components: int) -> Whitening:
    n, sums = _sums(points)
    if not n:
        return Whitening(0, sums, np.zeros((0, 0)), np.zeros(0), 0.0)
    v = covariance(points.select(_centred(F.col("x"), n, sums).alias("y")), "y", n, len(sums))
    values, vectors = np.linalg.eigh((v + v.T) / 2)
    values, vectors = values[::-1], vectors[:, ::-1].T
    there = int((values > max(values[0], 0) * len(values) * _NOTHING).sum()) if values[0] > 0 else 0
    return Whitening(n, sums, vectors[: min(components, there)], values[: min(components, there)], float(np.trace(v)))


def fit(rows: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitening:
    """The whitening of the vectors of ``rows``."""
    return _fitted(_points(rows, vector), components)


def _project(x: np.ndarray, found: Whitening) -> tuple[list, list]:
    """For rows of integers the whitened entries, and the exact deviation or None beyond 64 bits."""
    scaled = (found.components / np.sqrt(found.values)[:, None]).T if len(found.values) else np.zeros((len(found.sums), 0))
    exact = found.n * x - found.sums
    most = int(np.abs(exact).max(initial=0))
    if most * most * max(len(found.sums), 1) < 1 << 63:
        deviation = (exact * exact).sum(1).tolist()
    else:
        deviation = [d if d < 1 << 63 else None for d in (sum(e * e for e in row) for row in exact.tolist())]
    return list((exact / max(found.n, 1)) @ scaled), deviation


def whiten(rows: DataFrame, vector: str = "embedding", whitened: str = "whitened", found: Whitening | None = None, components: int = COMPONENTS) -> DataFrame:
    """``rows`` that take part, with the column ``whitened`` of up to so many entries; by what was learned from other rows, if given."""
    bound_batches(rows.sparkSession, 4096)
    points = _points(rows, vector)
    held = rows.sparkSession.sparkContext.broadcast(found or _fitted(points, components))

    @F.pandas_udf("array<double>")
    def project(x: pd.Series) -> pd.Series:
        return pd.Series(_project(np.array(x.tolist(), np.int64).reshape(len(x), -1), held.value)[0], dtype=object)

    return points.withColumn("w", project("x")).select("row.*", F.col("w").alias(whitened))


def digest(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """A row for each vector and component, with the exact distance from the mean and how well the whitening came out."""
    bound_batches(rows.sparkSession, 4096)
    points = _points(rows.select("vec_id", "embedding"), "embedding").select("row.vec_id", "x")
    found = _fitted(points, components)
    held = rows.sparkSession.sparkContext.broadcast(found)  # components times dimension

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            whitened, deviation = _project(np.array(batch["x"].tolist(), np.int64).reshape(len(batch), -1), held.value)
            yield pd.DataFrame({"vec_id": batch["vec_id"].astype("Int64"), "whitened": pd.Series(whitened, dtype=object), "deviation": pd.Series(deviation, dtype="Int64")})

    done = cut(points.select(F.col("vec_id").cast("long").alias("vec_id"), "x").mapInPandas(project, "vec_id long, whitened array<double>, deviation long"))
    error = 0.0
    if len(found.values):
        means = done.agg(*(F.avg(F.get("whitened", F.lit(i))).alias(f"m{i}") for i in range(len(found.values)))).first()
        again = F.zip_with("whitened", F.array(*map(F.lit, means)), lambda w, m: w - m)
        error = float(np.abs(covariance(done.select(again.alias("y")), "y", found.n, len(found.values)) - np.eye(len(found.values))).max())
    explained = F.array(*(F.lit(float(e) / found.trace) for e in found.values)) if len(found.values) else F.array().cast("array<double>")
    each = done.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(found.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.coalesce(F.get(explained, F.col("at")), F.lit(0.0)).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
