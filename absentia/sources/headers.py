"""What the files under a path have for headings, before any of them is scanned.

One task looks at one file. Only its first lines reach Python; the rest is read as lines
and passed over, for Spark has no end to a scan there. Only layouts come back, not files: a folder of
one layout answers with one row, whatever the number of files. Files by name are asked
for only where layouts differ.
"""

from __future__ import annotations

import csv
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

# A heading may span that many lines where cells may hold line breaks.
_LINES = 32
# Beyond any file: a file is one split, and two splits never share a task.
_WHOLE = str(1 << 50)
NAMED_FILES = 10
# What Python's strip() leaves something of.
_TEXT = r"(?U)[^\s\x1c-\x1f]"
_WITHIN_TASK = (1 << 33) - 1


@dataclass(frozen=True)
class Layout:
    """Files with the same first line. `files` is None where all files have it."""

    cells: tuple[str, ...]
    n_files: int
    example: str
    has_rows: bool
    files: tuple[str, ...] | None = None


def header_names(cells: Sequence[str | None]) -> list[str]:
    """Usable names: blanks numbered, repeats suffixed .1, .2 and so on.

    Headings that differ only in case count as repeats; Spark would take them
    for one column.
    """
    taken: set[str] = set()
    names = []
    for i, cell in enumerate(cells):
        base = cell if cell not in (None, "") else f"Unnamed: {i}"
        name, n = base, 0
        while name.lower() in taken:
            n += 1
            name = f"{base}.{n}"
        taken.add(name.lower())
        names.append(name)
    return names


def _first_record(lines: Sequence[str], multi_line: bool) -> tuple[list[str], bool]:
    """Cells of the first record, and whether something follows it."""
    if not multi_line:
        if lines[0].count('"') % 2:
            raise ValueError(f"a heading holds a line break; set multi_line: {lines[0]!r}")
        return next(csv.reader(lines[:1])), len(lines) > 1
    reader = csv.reader(line + "\n" for line in lines)
    return next(reader), next(reader, None) is not None


def _first_lines(most: int) -> Callable:
    """For mapInArrow: the first lines with text of the task's file; the rest is not read.

    An inner function: Spark sends it whole, so workers need not have this package.
    """

    def run(batches):
        file, lines = None, []
        for batch in batches:
            for file, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if line.strip():
                    lines.append(line)
                if len(lines) == most:
                    break
            if len(lines) == most:
                break
        if lines:
            # A byte order mark is no part of a heading.
            lines[0] = lines[0].removeprefix("\ufeff")
            columns = [pa.array([file]), pa.array([lines])]
            yield pa.RecordBatch.from_arrays(columns, ["file", "lines"])

    return run


def _file_starts(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """file, lines: a row for each file that has a line with text."""
    session = spark.newSession()  # its settings are its own
    session.conf.set("spark.sql.files.maxPartitionBytes", _WHOLE)
    session.conf.set("spark.sql.files.openCostInBytes", _WHOLE)
    session.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", _LINES)
    lines = session.read.text(list(paths)).select("_metadata.file_path", "value")
    # A worker that stops reading is fed the rest of the file all the same, so only the
    # first lines with text go there. Lines are numbered within the task, from 0.
    met = lines.where(F.col("value").rlike(_TEXT)).withColumn("_id", F.monotonically_increasing_id())
    first = met.where(F.col("_id").bitwiseAND(_WITHIN_TASK) < _LINES).select("file_path", "value")
    return first.mapInArrow(_first_lines(_LINES), "file string, lines array<string>")


def as_path(uri: str) -> str:
    """A file's address as a path to read: no escapes of a URI, nothing to expand."""
    plain = unquote(uri)
    return "".join("\\" + c if c in "*?[]{}\\" else c for c in plain)


def catalogue(spark: SparkSession, paths: Sequence[str], multi_line: bool = False) -> list[Layout]:
    """The layouts under paths (files, folders or globs), the commonest first."""
    starts = _file_starts(spark, paths)
    seen = F.when(F.lit(multi_line), F.col("lines")).otherwise(F.slice("lines", 1, 1))
    found = (
        starts.groupBy(seen.alias("first"))
        .agg(
            F.count("*").alias("n"), F.min("file").alias("example"),
            F.max(F.size("lines")).alias("longest"),
        )
        .collect()
    )
    layouts: dict[tuple[str, ...], list] = {}
    for r in found:
        cells, more = _first_record(list(r["first"]), multi_line)
        entry = layouts.setdefault(tuple(cells), [0, r["example"], False])
        entry[0] += r["n"]
        entry[1] = min(entry[1], r["example"])
        entry[2] |= more or (not multi_line and r["longest"] > 1)
    files: dict[tuple[str, ...], list[str]] = {}
    if len(layouts) > 1:
        for r in starts.collect():
            cells, _ = _first_record(list(r["lines"]), multi_line)
            files.setdefault(tuple(cells), []).append(as_path(r["file"]))
    listed = [
        Layout(cells, n, example, has_rows, tuple(sorted(files[cells])) if files else None)
        for cells, (n, example, has_rows) in layouts.items()
    ]
    return sorted(listed, key=lambda x: (-x.n_files, x.example))
