"""Embedding whitening with MLlib's distributed matrices.

Entries become whole numbers x = floor(scale * c) + shift. Rows are numbered and their
centred vectors x - S/n (S the sums over all rows, n their number) become the blocks of a
BlockMatrix Y. The scatter is the product of Y transposed with Y, its eigenvectors are
found on the driver (it is dimensions squared, whatever the number of rows), and Y times
the whitening matrix (eigenvectors over the roots of their eigenvalues) gives the
projected rows.

A product of a wide with a tall matrix has few blocks, and each would be summed up in
one task. So the middle dimension is split: some `SPLIT_BLOCKS` blocks of rows at a time
are multiplied, and the small products are added up.

Sums and deviations are exact: whole numbers, as decimals where they may pass 64 bits.
A row's number is a place in a table in the shared folder, so a repeated task finds the
same numbers.

Edge cases: rows without a vector, with null or non-finite entries, or with entries whose
x does not fit 53 bits, are left out, as are vectors of another length than the
commonest (the longer at a tie). Repeated and null vec_ids are rows like any other.
Components with an eigenvalue of no more than 1e-12 of the largest do not vary and are
left out: equal rows alone, or a single row, give an empty result, as does an empty
table. A deviation beyond 64 bits is null. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix, RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, functions as F

from absentia.operators.numbering import numbered
from absentia.sources.storage import settle

SCALE, SHIFT = 64, 1_000_000
BLOCK_BYTES = 2 << 20
SPLIT_BLOCKS = 16
NO_VARIANCE = 1e-12


def whole_numbers(vectors: DataFrame, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """vec_id and x for the rows that count."""
    c = F.col("embedding")
    usable = F.forall(
        c,
        lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double") * scale) < float(1 << 53)),
    )
    kept = vectors.select("vec_id", "embedding").where(
        c.isNotNull() & (F.size(c) > 0) & F.coalesce(usable, F.lit(False))
    )
    # At most a row for each length there is.
    lengths = kept.groupBy(F.size(c).alias("d")).count()
    d = lengths.orderBy(F.desc("count"), F.desc("d")).select("d").first()
    if d is None:
        return kept.select("vec_id", F.array().cast("array<long>").alias("x"))
    x = F.transform(c, lambda v: F.floor(v.cast("double") * scale) + F.lit(shift).cast("long"))
    return kept.where(F.size(c) == d[0]).select("vec_id", x.alias("x"))


def _blocks(rows: DataFrame, n: int, d: int) -> BlockMatrix:
    """Rows (index, vector) as blocks of all columns and about `BLOCK_BYTES`."""
    old = MLUtils.convertVectorColumnsFromML(rows.select("index", "vector"), "vector")
    return IndexedRowMatrix(old, n, d).toBlockMatrix(max(1, BLOCK_BYTES // (8 * d)), d)


def scatter(blocks: BlockMatrix) -> np.ndarray:
    """The matrix transposed times itself, its middle dimension split over tasks."""
    splits = max(1, -(-blocks.numRows() // (SPLIT_BLOCKS * blocks.rowsPerBlock)))
    left = blocks.transpose()._java_matrix_wrapper._java_model
    product = left.multiply(blocks._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, blocks.colsPerBlock, blocks.colsPerBlock).toLocalMatrix().toArray()


def components(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns; those that vary."""
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1], vectors[:, ::-1]
    kept = min(most, int((values > NO_VARIANCE * max(values[0], 0)).sum()) if values[0] > 0 else 0)
    return values[:kept], vectors[:, :kept]


def _deviation(n: int, sums: list[int], least: list[int], most: list[int]) -> Column:
    """Sum of (n x - S)^2, exact; null beyond 64 bits."""
    bound = sum(max(n * hi - s, s - n * lo) ** 2 for s, lo, hi in zip(sums, least, most))
    wide = "long" if bound < 1 << 63 else "decimal(38,0)"
    s = F.array(*[F.lit(v).cast(wide) for v in sums])
    apart = F.zip_with("x", s, lambda x, t: x.cast(wide) * F.lit(n).cast(wide) - t)
    total = F.aggregate(
        apart, F.lit(0).cast(wide), lambda a, v: F.try_add(a, F.try_multiply(v, v)).cast(wide)
    )
    return total.try_cast("long")


def whiten(vectors: DataFrame, most: int = 32, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error."""
    spark = vectors.sparkSession
    rows = numbered(whole_numbers(vectors, scale, shift), "at")
    # As many rows as dimensions.
    stats = (
        rows.select(F.posexplode("x").alias("i", "x"))
        .groupBy("i")
        .agg(F.count("*").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("s"),
             F.min("x").alias("lo"), F.max("x").alias("hi"))
        .orderBy("i")
        .collect()
    )
    empty = spark.createDataFrame(
        [],
        "vec_id long, component int, n long, deviation long, whitened double, explained double, "
        "identity_error double",
    )
    if not stats:
        return empty
    n, d = stats[0]["n"], len(stats)
    sums = [int(r["s"]) for r in stats]
    # x - S/n = (x - q) - r/n with S = q n + r: no digits are lost on large shifts.
    whole = F.array(*[F.lit(s // n) for s in sums])
    part = F.array(*[F.lit(s % n / n) for s in sums])
    centred = F.zip_with(
        F.zip_with("x", whole, lambda x, q: (x - q).cast("double")), part, lambda x, r: x - r
    )
    indexed = rows.select(F.col("at").alias("index"), array_to_vector(centred).alias("vector"))
    y = _blocks(indexed, n, d)
    covariance = scatter(y) / n
    values, directions = components(covariance, most)
    if not len(values):
        return empty
    k = len(values)
    whitening = Matrices.dense(d, k, (directions / np.sqrt(values)).flatten(order="F").tolist())
    local = BlockMatrix(spark.sparkContext.parallelize([((0, 0), whitening)], 1), d, k, d, k)
    projected = y.multiply(local).toIndexedRowMatrix()
    z = callMLlibFunc("getIndexedRows", projected._java_matrix_wrapper._java_model)
    z = settle(
        MLUtils.convertVectorColumnsToML(z, "vector").select(
            F.col("index").alias("at"), F.col("vector")
        ),
        "projected",
    )
    error = _identity_error(z, n, k)
    explained = F.array(*[F.lit(float(v / np.trace(covariance))) for v in values])
    deviations = rows.select(
        "at", "vec_id",
        _deviation(n, sums, [r["lo"] for r in stats], [r["hi"] for r in stats]).alias("deviation"),
    )
    wide = deviations.join(z.select("at", vector_to_array("vector").alias("z")), "at")
    return wide.select(
        "vec_id", "deviation", F.posexplode(F.arrays_zip("z", explained.alias("e"))).alias("i", "of")
    ).select(
        "vec_id", (F.col("i") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"),
        "deviation", F.col("of.z").alias("whitened"), F.col("of.e").alias("explained"),
        F.lit(error).alias("identity_error"),
    )


def _identity_error(z: DataFrame, n: int, k: int) -> float:
    """The largest absolute entry of the covariance of the projected rows minus one on
    the diagonal, from those rows, centred (MLlib divides by n - 1)."""
    if n < 2:
        return float("nan")
    old = MLUtils.convertVectorColumnsFromML(z.select("vector"), "vector")
    found = RowMatrix(old, n, k).computeCovariance().toArray() * (n - 1) / n
    return float(np.abs(found - np.eye(k)).max())
