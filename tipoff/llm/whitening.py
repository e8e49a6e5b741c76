"""Whitening of embeddings with distributed block matrices.

Entries become whole numbers, so means are exact. The distinct vectors are dealt into blocks by hash, centred, and indexed as rows of a
``BlockMatrix``; its transpose times itself is the scatter matrix, summed over many tasks. The eigenvectors of that small matrix come from the driver
(dimension by dimension, whatever the number of rows), and a second block product with the whitening matrix projects all rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tipoff.llm.frames import schema_of
from tipoff.session import written

#: Entries are counted in parts of 1 / STEPS; components in the result; distinct vectors in a block, on average.
STEPS, COMPONENTS, BLOCK_VECTORS = 256, 4, 4096
#: Components whose variance is at most this share of the largest one, times the dimension, are rounding noise.
NOISE = 1e-13

SCHEMA = schema_of(vec_id=T.LongType(), component=T.IntegerType(), n=T.LongType(), deviation=T.LongType(), whitened=T.DoubleType(),
                   explained=T.DoubleType(), identity_error=T.DoubleType())


def usable(embeddings: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, x) of the rows whose vector is there and has no null, infinite or undefined entry; x in whole steps.

    Shorter vectors are filled with zeros up to the longest one.
    """
    entry = lambda e: F.coalesce(F.abs(e.cast("double")) < F.lit(math.inf), F.lit(False))  # noqa: E731  NaN is larger than infinity
    rows = embeddings.where(F.col(vector).isNotNull() & F.forall(vector, entry))
    whole = F.transform(vector, lambda e: F.floor(e.cast("double") * STEPS))
    rows = written(rows.select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("x")), "vectors")
    shortest, longest = rows.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
    if shortest == longest:
        return rows
    return rows.select("vec_id", F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(longest) - F.size("x"))).alias("x"))


def _numbers(values: list[int] | np.ndarray, kind: str) -> Column:
    """One small vector of the driver's as a constant."""
    return F.lit(np.array(values, np.int64 if kind == "long" else np.float64)).cast(f"array<{kind}>")


class Scatter:
    """The distinct vectors as rows of a block matrix, and their moments."""

    def __init__(self, rows: DataFrame, block_vectors: int = BLOCK_VECTORS):
        counted = rows.groupBy("x").agg(F.count(F.lit(1)).alias("copies"))  # equal vectors meet already on the map side
        distinct = written(counted.select("x"), "distinct")
        self.n, self.dimension = distinct.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
        self.dimension = self.dimension or 0
        if not self.n or not self.dimension:
            return
        sums = dict(distinct.select(F.posexplode("x").alias("k", "v")).groupBy("k").agg(F.sum(F.col("v").cast("decimal(38,0)"))).collect())  # a row a dimension
        self.sums = [int(sums[k]) for k in range(self.dimension)]
        blocks = -(-self.n // block_vectors)
        block = F.pmod(F.xxhash64("x"), F.lit(blocks))
        place = F.row_number().over(Window.partitionBy("block").orderBy("x")) - 1  # about block_vectors rows, as distinct vectors hash evenly
        placed = written(distinct.select("x", block.alias("block")).select("x", "block", place.cast("long").alias("place")), "placed")
        self.stride = placed.agg(F.max("place")).first()[0] + 1  # missing rows of a block are zeros and add nothing
        centre = _numbers([s / self.n for s in self.sums], "double")
        self.rows = written(placed.select(
            "x", (F.col("block") * self.stride + F.col("place")).alias("index"),
            F.zip_with(F.col("x"), centre, lambda v, m: v.cast("double") - m).alias("centred")), "centred")
        self.blocks = blocks
        vectors = MLUtils.convertVectorColumnsFromML(self.rows.select("index", array_to_vector("centred").alias("vector")), "vector")
        self.matrix = IndexedRowMatrix(vectors, blocks * self.stride, self.dimension).toBlockMatrix(self.stride, self.dimension)

    def covariance(self) -> np.ndarray:
        """The transpose times the matrix, over the number of vectors. The one block of the result is summed from many tasks' parts."""
        left, right = self.matrix.transpose(), self.matrix
        # the Python method has no argument for the number of parts of the inner dimension; one part would be one task for all rows
        parts = max(1, min(self.blocks, 1024))
        product = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, parts)
        scatter = BlockMatrix(product, self.dimension, self.dimension).toLocalMatrix().toArray() / self.n
        return (scatter + scatter.T) / 2

    def projected(self, directions: np.ndarray) -> DataFrame:
        """(index, y): every row times the matrix of directions (a column each)."""
        rows, columns = directions.shape
        local = Matrices.dense(rows, columns, directions.flatten(order="F").tolist())
        blocks = self.rows.sparkSession.sparkContext.parallelize([((0, 0), local)], 1)
        product = self.matrix.multiply(BlockMatrix(blocks, rows, columns, rows, columns)).toIndexedRowMatrix()
        width = range(columns)
        rows_of = product.rows.map(lambda r: (int(r.index), [float(r.vector[k]) for k in width]))
        return written(self.rows.sparkSession.createDataFrame(rows_of, "index long, y array<double>"), "projected")


def directions(covariance: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The largest variances, falling, and their unit eigenvectors as columns; the largest entry of each is positive."""
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(values, kind="stable")[::-1][:most]
    values, vectors = values[order], vectors[:, order]
    held = values > max(values[0], 0) * NOISE * len(covariance) if len(values) else values > 0
    values, vectors = values[held], vectors[:, held]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))]) if len(values) else 1
    return values, vectors * signs


def whiten(embeddings: DataFrame, vector: str = "embedding", components: int = COMPONENTS, block_vectors: int = BLOCK_VECTORS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each usable row and component.

    The fit has each distinct vector once, so copies weigh nothing; every copy gets its row. Components without variance (fewer distinct vectors than
    dimensions, or constant entries) have no whitened value and are left out: one vector alone, or an empty table, has no rows. A null vec_id stays null,
    repeated ones are rows of their own, other columns play no part. A deviation beyond a long is null.
    """
    rows = usable(embeddings, vector)
    fit = Scatter(rows, block_vectors)
    if not fit.n or not fit.dimension:
        return embeddings.sparkSession.createDataFrame([], SCHEMA)
    covariance = fit.covariance()
    values, vectors = directions(covariance, components)
    k = len(values)
    if not k:
        return embeddings.sparkSession.createDataFrame([], SCHEMA)
    projected = fit.projected(vectors / np.sqrt(values))
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    y = [F.get("y", F.lit(i)) for i in range(k)]
    moments = projected.agg(*[F.sum(e) for e in y], *[F.sum(y[i] * y[j]) for i, j in pairs]).first()  # one row
    mean = [moments[i] / fit.n for i in range(k)]
    error = max(abs(moments[k + at] / fit.n - mean[i] * mean[j] - (i == j)) for at, (i, j) in enumerate(pairs))
    centre = F.array(*[F.lit(str(v)).cast("decimal(38,0)") for v in fit.sums])
    wide = lambda v: v.cast("decimal(38,0)")
    steps = F.zip_with(F.col("x"), centre, lambda v, s: wide(F.try_subtract(F.try_multiply(v.cast("decimal(19,0)"), F.lit(fit.n).cast("decimal(18,0)")), s)))
    squares = F.transform(steps, lambda d: wide(F.try_multiply(d.try_cast("decimal(19,0)"), d.try_cast("decimal(19,0)"))))
    deviation = F.aggregate(squares, wide(F.lit(0)), lambda total, d: wide(F.try_add(total, d)))
    scored = fit.rows.select("index", "x", deviation.try_cast("long").alias("deviation")).join(projected, "index").select("x", "deviation", "y")
    explained = _numbers(values / np.trace(covariance), "double")
    # a vector that very many rows share is on the side that Spark can split; the other side has it once
    joined = rows.join(scored, "x").select("vec_id", "deviation", F.posexplode("y").alias("k", "whitened"))
    return joined.select("vec_id", (F.col("k") + 1).alias("component"), F.lit(fit.n).cast("long").alias("n"), "deviation", "whitened",
                         F.get(explained, F.col("k")).alias("explained"), F.lit(float(error)).alias("identity_error"))
