"""Small helpers the text operators share."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Iterable, Iterator
from functools import cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a text column; null counts as empty."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def slices(
    batches: Iterable[pa.RecordBatch], text: str, limit: int = SLICE_BYTES
) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Runs of rows whose texts add up to about `limit` bytes, with those texts.

    A row is never cut: a longer text is a slice of its own.
    """
    for batch in batches:
        texts = as_bytes(batch.column(batch.schema.get_field_index(text)))
        start = size = 0
        for i, t in enumerate(texts):
            if size and size + len(t) > limit:
                yield batch.slice(start, i - start), texts[start:i]
                start, size = i, 0
            size += len(t)
        if start < len(texts):
            yield batch.slice(start), texts[start:]


@cache
def _package(application: str) -> str:
    """This package as an archive, made once for each application."""
    root = Path(__file__).resolve().parents[1]
    path = os.path.join(tempfile.mkdtemp(prefix="absentia-"), "absentia.zip")
    with zipfile.ZipFile(path, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    return path


def ship(spark: SparkSession) -> None:
    """Give workers this package: Spark hands the archive to every executor."""
    context = spark.sparkContext
    path = _package(context.applicationId)
    if not any(f.endswith("/absentia.zip") for f in context.listFiles):
        context.addPyFile(path)


def map_batches(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """mapInArrow, with this package at hand in the workers."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """Bytes of all texts: sets sizes of work, never what is looked at."""
    return df.agg(F.sum(F.octet_length(column))).first()[0] or 0


def hash_share(column: Column | str, rows: int, limit: int) -> Column:
    """True for about `limit` of `rows` rows, by a hash of a column."""
    whole = 1 << 40
    share = int(min(1.0, limit / max(rows, 1)) * whole)
    return F.pmod(F.xxhash64(column), F.lit(whole)) < share


def text_key(column: str = "text") -> Column:
    """Tells rows of one id apart; null and empty text are alike."""
    return F.xxhash64(F.coalesce(F.col(column), F.lit("")))


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, so that added columns never meet their names."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")
