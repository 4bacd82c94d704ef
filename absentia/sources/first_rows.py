"""The first rows of files as they stand, reading no more than it takes.

Files go by name, rows by their place. A file is read split by split from its start
until there are enough rows; small files are read some at a time. Files behind the last
row shown are not opened, not even for their header.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from absentia.functions.text import ref
from absentia.operators.rules import rule3_keep
from absentia.sources.csv_files import layouts_of, listed, scan_csv
from absentia.sources.headers import as_path, header_names
from absentia.sources.storage import size_of
from absentia.vocabulary import (
    DATE,
    MISMATCH_MESSAGES,
    MISMATCH_SAMPLE_ROWS,
    PREVIEW_ROWS,
    ROW_ORDER,
    SCHOOL_YEAR,
)

# Files up to this many bytes in all are read together.
TOGETHER_BYTES = 32 << 20


def _runs_of_files(spark: SparkSession, paths: str | Sequence[str]) -> Iterator[list[str]]:
    """The files in order of their names, small ones in runs that double in number."""
    run, size, most = [], 0, 1
    for uri in sorted(spark.read.text(listed(paths)).inputFiles()):
        file, length = as_path(uri), size_of(spark, uri)
        if run and (len(run) == most or size + length > TOGETHER_BYTES):
            yield run
            run, size, most = [], 0, most * 2
        run.append(file)
        size += length
    if run:
        yield run


def first_rows(
    spark: SparkSession,
    paths: str | Sequence[str],
    n: int = PREVIEW_ROWS,
    multi_line: bool = False,
) -> DataFrame:
    """The first n rows in file order, all cells as text, null where one is missing.

    The first file that has a header names the columns; a later one that is met may
    order them differently. A bounded table: n rows, whatever the size of the files.
    """
    rows: list[tuple] = []
    names: list[str] | None = None
    for run in _runs_of_files(spark, paths):
        try:
            layouts = layouts_of(spark, run, multi_line)
        except ValueError as error:
            if "empty" not in str(error):
                raise
            continue  # files without a line
        # Layouts come by frequency; the names are those of the first file.
        leading = min(layouts, key=lambda x: x.example)
        names = names or header_names(leading.cells)
        scanned = scan_csv(spark, run, multi_line, with_row_order=True)
        if set(scanned.columns) - {ROW_ORDER} != set(names):
            raise ValueError(f"files with other columns: {leading.example}")
        left = n - len(rows)
        if len(run) > 1:
            scanned = scanned.orderBy(ROW_ORDER)
        # Without an order Spark takes from the first split on, and more only if need be.
        rows += map(tuple, scanned.select([ref(c) for c in names]).limit(left).collect())
        if len(rows) >= n:
            break
    if names is None:
        raise ValueError("the file is empty")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in names])
    return spark.createDataFrame(rows, schema)


def date_mismatches(
    spark: SparkSession,
    paths: str | Sequence[str],
    n: int = MISMATCH_SAMPLE_ROWS,
    messages: int = MISMATCH_MESSAGES,
) -> DataFrame:
    """Messages on dates outside their school year among the first n rows."""
    head = first_rows(spark, paths, n)
    kept = rule3_keep(head)
    text = F.format_string("School Year %s has date %s", ref(SCHOOL_YEAR), ref(DATE))
    if kept is None:
        return head.limit(0).select(F.lit("").alias("issue"))
    return head.where(~kept).limit(messages).select(text.alias("issue"))
