"""Whiten embeddings with distributed block matrices."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from earlywarn.llm.common import map_arrow, stored


@dataclass(frozen=True)
class WhitenSpec:
    """``scale`` and ``shift`` turn an entry c into the whole number floor(scale * c) + shift.

    ``components``: at most so many are returned. ``block_rows``: rows of a block; a block of d columns
    holds ``8 * d * block_rows`` bytes. ``max_dimensions`` guards the one d x d matrix that the driver
    decomposes (4,096: 128 MB).
    """

    scale: int = 64
    shift: int = 1_000_000
    components: int = 32
    block_rows: int = 4096
    max_dimensions: int = 4096


@dataclass(frozen=True)
class Whitener:
    """Directions (columns), eigenvalues falling, sums of each dimension, rows fitted on, trace of V."""

    vectors: np.ndarray
    values: np.ndarray
    sums: list[int]
    rows: int
    trace: float

    @property
    def kept(self) -> int:
        return len(self.values)


def whole_vectors(rows: DataFrame, spec: WhitenSpec, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, x``: the rows whose vector and every entry of it is there and finite, in whole numbers."""
    entries = F.col(vector_col).cast("array<double>")
    finite = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = F.transform(entries, lambda c: F.floor(c * spec.scale).cast("long") + F.lit(spec.shift).cast("long"))
    good = rows.where(F.col(vector_col).isNotNull()).where(finite)
    return good.select(F.col(id_col).alias("vec_id"), whole.alias("x"))


def _numbered(rows: DataFrame) -> DataFrame:
    """Add ``index``: 0, 1, 2… in the order of the files, so that blocks are full. No rows move."""
    marked = stored(rows.withColumn("_at", F.monotonically_increasing_id()), "vectors")
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = marked.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    sizes = sizes.select("_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    placed = marked.withColumns({"_part": part, "_place": place}).join(F.broadcast(sizes), "_part")
    return placed.withColumn("index", F.col("_before") + F.col("_place")).drop("_at", "_part", "_place", "_before")


def _dimension_sums(rows: DataFrame, d: int) -> list[int]:
    """Exact sums: tasks add up a batch at a time, and send one row for each."""

    def partial(batches):
        for batch in batches:
            if batch.num_rows:
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                total = x.sum(axis=0, dtype="int64").tolist()
                yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array(total)], ["k", "total"])

    sums = map_arrow(rows.select("x"), partial, "k int, total long").groupBy("k").agg(F.sum("total").alias("s"))
    return [r.s for r in sums.orderBy("k").collect()]


def _centred(rows: DataFrame, sums: list[int], n: int) -> DataFrame:
    """Add ``deviation`` and ``centred``: n*x - S is exact in whole numbers, so x - S/n is rounded once."""

    def centre(batches):
        s = np.array(sums, "int64")
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(sums))
            small = not x.size or max(abs(int(x.min())), abs(int(x.max()))) < 2**62 // max(n, 1)
            d = n * x - s if small else n * x.astype(object) - np.array(sums, object)
            far = max((abs(int(v)) for v in (d.min(), d.max())), default=0) if d.size else 0
            exact = d if far * far * max(1, d.shape[1]) < 2**63 else d.astype(object)
            squares = [int(v) for v in (exact * exact).sum(axis=1)] if d.size else []
            out = [
                batch.column("vec_id"), batch.column("index"),
                pa.array([v if v < 2**63 else None for v in squares], pa.int64()),
                pa.array(list(np.asarray(d / n, "float64")), pa.list_(pa.float64())),
            ]
            yield pa.RecordBatch.from_arrays(out, ["vec_id", "index", "deviation", "centred"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    return map_arrow(rows, centre, f"vec_id {kind}, index long, deviation long, centred array<double>")


def block_matrix(rows: DataFrame, column: str, n: int, d: int, spec: WhitenSpec) -> BlockMatrix:
    """Rows ``index, <column>`` dealt into blocks of ``block_rows`` rows and all columns."""
    vectors = rows.select("index", array_to_vector(column).alias("vector"))
    indexed = IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "vector"), n, d)
    return indexed.toBlockMatrix(spec.block_rows, d)


def scatter(matrix: BlockMatrix) -> np.ndarray:
    """The transposed matrix times the matrix.

    All products of a row block with itself belong to one block of the result. The middle dimension is
    therefore split, a form of ``multiply`` that only the JVM class has: each split is added up in a task
    of its own, and one d x d block for each of them meets in the end.
    """
    splits = max(1, matrix.numRowBlocks)
    turned = matrix.transpose()._java_matrix_wrapper._java_model
    product = turned.multiply(matrix._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, matrix.colsPerBlock, matrix.colsPerBlock).toLocalMatrix().toArray()


def fit_whitener(matrix: BlockMatrix, sums: list[int], n: int, spec: WhitenSpec) -> Whitener:
    """Eigenvectors of the covariance, those of the largest eigenvalues first.

    Directions without variance, to the precision of doubles, cannot be whitened and are left out.
    """
    covariance = scatter(matrix) / n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1], vectors[:, ::-1]
    enough = values > max(values[0], 0) * len(values) * np.finfo("float64").eps
    kept = min(spec.components, int(enough.sum()))
    return Whitener(vectors[:, :kept], values[:kept], sums, n, float(np.trace(covariance)))


def whiten(
    rows: DataFrame, spec: WhitenSpec | None = None, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``, a row for each vector and component.

    Vectors that are null or have a null, infinite or NaN entry are dropped; so are those of another
    length than most have (of equally frequent lengths, the longer). Repeated rows and ids keep a row
    each, null ids too. ``deviation`` is null beyond 64 bits. Directions without variance have no rows,
    so one vector, equal vectors, vectors of length 0 and empty tables give none. Other columns are not
    read.

    Rows are numbered where they lie and centred exactly; block matrices give the scatter (the middle
    dimension split over tasks), the driver decomposes one d x d matrix, and a product of blocks projects
    the rows. The covariance of what comes out is measured the same way.
    """
    spec, spark = spec or WhitenSpec(), rows.sparkSession
    kind = rows.schema[id_col].dataType.simpleString()
    nothing = spark.createDataFrame(
        [], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    )
    whole = whole_vectors(rows, spec, id_col, vector_col)
    lengths = whole.groupBy(F.size("x").alias("d")).count()
    most = lengths.orderBy(F.desc("count"), F.desc("d")).first()
    if most is None or most.d == 0:
        return nothing
    n, d = most["count"], most.d
    if d > spec.max_dimensions:
        raise ValueError(f"{d} dimensions; the driver decomposes at most {spec.max_dimensions}")
    numbered = _numbered(whole.where(F.size("x") == d))
    sums = _dimension_sums(numbered, d)
    centred = stored(_centred(numbered, sums, n), "centred")
    matrix = block_matrix(centred, "centred", n, d, spec)
    model = fit_whitener(matrix, sums, n, spec)
    if not model.kept:
        return nothing
    weights = DenseMatrix(d, model.kept, (model.vectors / np.sqrt(model.values)).ravel(order="F"))
    weights = spark.sparkContext.parallelize([((0, 0), weights)], 1)
    projected = matrix.multiply(BlockMatrix(weights, d, model.kept)).toIndexedRowMatrix()
    projected = callMLlibFunc("getIndexedRows", projected._java_matrix_wrapper._java_model)
    projected = stored(projected.select("index", vector_to_array("vector").alias("whitened")), "whitened")

    identity = whitened_covariance(projected, n, model.kept, spec) - np.eye(model.kept)
    explained = F.array(*[F.lit(float(e / model.trace)) for e in model.values])
    each = centred.select("index", "vec_id", "deviation").join(projected, "index")
    each = each.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        explained[F.col("at")].alias("explained"), F.lit(float(np.abs(identity).max())).alias("identity_error"),
    )


def whitened_covariance(projected: DataFrame, n: int, k: int, spec: WhitenSpec) -> np.ndarray:
    """Covariance of rows ``index, whitened``: centred on their own means, then multiplied."""
    means = projected.agg(*[F.avg(F.col("whitened")[i]).alias(f"m{i}") for i in range(k)]).first()
    means = F.array(*[F.lit(float(m)) for m in means])
    again = projected.select("index", F.zip_with("whitened", means, lambda a, m: a - m).alias("centred"))
    return scatter(block_matrix(again, "centred", n, k, spec)) / n
