"""Absence records in CSV files."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from absentia.functions.text import null_if_missing, ref
from absentia.operators.columns import rename_map
from absentia.sources.headers import NAMED_FILES, Layout, catalogue, header_names
from absentia.sources.storage import exists, publish
from absentia.vocabulary import ROW_ORDER

_RECORD = "_record"
_MANIFEST = "_manifest"
_BROKEN = (
    "a record with an odd number of quote marks: a cell holds a line break. "
    "Read with multi_line=True, or with check_records=False to take lines as records"
)


def _options(multi_line: bool) -> dict:
    return {"escape": '"', "multiLine": multi_line, "mode": "PERMISSIVE", "encoding": "UTF-8"}


def listed(paths: str | Sequence[str]) -> list[str]:
    paths = [paths] if isinstance(paths, str) else list(paths)
    for path in paths:
        last = path.rstrip("/").rsplit("/", 1)[-1]
        if "." in last and not last.lower().endswith((".csv", ".csv.gz", ".csv.bz2")):
            raise ValueError(f"unsupported file format: {path}; only CSV files are read")
    return paths


def layouts_of(
    spark: SparkSession, paths: str | Sequence[str], multi_line: bool = False
) -> list[Layout]:
    """The layouts under the paths, the commonest first; an error if no file has a line."""
    found = catalogue(spark, listed(paths), multi_line)
    if not found:
        raise ValueError("the file is empty")
    return found


def scan_layout(
    spark: SparkSession,
    layout: Layout,
    paths: str | Sequence[str],
    multi_line: bool = False,
    with_row_order: bool = False,
    check_records: bool = True,
) -> DataFrame:
    """The files of one layout under its own names, as `scan_csv` gives them."""
    names = header_names(layout.cells)
    fields = [T.StructField(f"c{i}", T.StringType()) for i in range(len(names))]
    checked = check_records and not multi_line
    if checked:
        fields.append(T.StructField(_RECORD, T.StringType()))
    cells = (
        spark.read.schema(T.StructType(fields))
        .options(header=True, columnNameOfCorruptRecord=_RECORD, columnPruning=not checked)
        .options(**_options(multi_line))
        .csv(list(layout.files) if layout.files else listed(paths))
    )
    columns = [null_if_missing(F.col(f"c{i}")).alias(n) for i, n in enumerate(names)]
    if with_row_order:
        columns.append(
            F.struct(
                F.col("_metadata.file_path").alias("file"),
                F.col("_metadata.file_block_start").alias("block"),
                F.monotonically_increasing_id().alias("row"),
            ).alias(ROW_ORDER)
        )
    if checked:
        # Spark keeps the text of a record with too few or too many cells.
        record = F.col(_RECORD)
        odd = (F.length(record) - F.length(F.replace(record, F.lit('"'), F.lit("")))) % 2 == 1
        begins = F.concat(F.lit(f"{_BROKEN}; the record begins with "), F.coalesce("c0", F.lit("")))
        broken = F.when(odd, F.raise_error(begins).cast("boolean")).otherwise(True)
        cells = cells.filter(F.when(record.isNull(), True).otherwise(broken))
    return cells.select(columns)


def scan_csv(
    spark: SparkSession,
    paths: str | Sequence[str],
    multi_line: bool = False,
    with_row_order: bool = False,
    check_records: bool = True,
) -> DataFrame:
    """All cells as text, or null where the cell stands for "no value".

    `paths` are files, folders or globs. Every file is read under its own header: files
    may order the same columns differently (the commonest order shows), but a file with
    other columns is an error that names it; `scan_known` reads several layouts.
    Identifiers keep their leading zeros. Files are split across tasks unless
    `multi_line` is set, which is needed only for line breaks inside cells; a broken
    cell without it is an error, found in the scan itself. (The one case that cannot be
    told is a file of a single column.) `with_row_order` adds a column that orders rows
    as they stand in the files.
    """
    layouts = layouts_of(spark, paths, multi_line)
    wanted = set(header_names(layouts[0].cells))
    others = [x for x in layouts if set(header_names(x.cells)) != wanted]
    if others:
        raise ValueError(
            f"files with other columns than {layouts[0].example}: {named(others)}"
        )
    parts = [
        scan_layout(spark, x, paths, multi_line, with_row_order, check_records) for x in layouts
    ]
    return reduce(DataFrame.unionByName, parts)


def named(layouts: Iterable[Layout]) -> str:
    """Some of the files of layouts, and how many there are."""
    layouts = list(layouts)
    files = [f for x in layouts for f in (x.files or (x.example,))]
    more = sum(x.n_files for x in layouts) - len(files[:NAMED_FILES])
    return ", ".join(files[:NAMED_FILES]) + (f" and {more} more" if more > 0 else "")


def require_rows(df: DataFrame) -> DataFrame:
    """Fail on a frame without rows; looks at one row."""
    if df.isEmpty():
        raise ValueError("the file has no rows")
    return df


def scan_layouts(
    spark: SparkSession, layouts: Iterable[tuple[str | Sequence[str], Mapping[str, str]]]
) -> DataFrame:
    """Files of several layouts as one frame.

    Each entry gives the paths of one layout and its {original: standard} map;
    columns a layout lacks are null. The plan grows with layouts, not files.
    """
    parts = [rename_map(scan_csv(spark, paths), mapping) for paths, mapping in layouts]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def scan_known(
    spark: SparkSession,
    paths: str | Sequence[str],
    known: Sequence[Mapping[str, str]],
    unknown: str = "error",
    multi_line: bool = False,
    with_row_order: bool = False,
) -> DataFrame:
    """Files of known layouts under one path, told apart by their headers.

    A file belongs to the first of the {original: standard} maps whose originals it
    has, all of them; other columns keep their names, and columns a layout lacks are
    null. A file that fits none is an error that names it, or with unknown="leave out"
    is not read. Each file is scanned once.
    """
    if unknown not in ("error", "leave out"):
        raise ValueError(f'unknown is "error" or "leave out", not {unknown!r}')
    parts, strangers = [], []
    for layout in layouts_of(spark, paths, multi_line):
        names = header_names(layout.cells)
        fitting = next((m for m in known if set(m) <= set(names)), None)
        if fitting is None:
            strangers.append(layout)
            continue
        scanned = scan_layout(spark, layout, paths, multi_line, with_row_order)
        parts.append(rename_map(scanned, fitting))
    if strangers and (unknown == "error" or not parts):
        raise ValueError(f"files of no known layout: {named(strangers)}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _shown(df: DataFrame, shown: Mapping[str, str] | None) -> list[Column]:
    names = {c: (shown or {}).get(c, c) for c in df.columns if c != ROW_ORDER}
    return [ref(c).alias(n) for c, n in names.items()]


def sink_csv(df: DataFrame, folder: str, shown: Mapping[str, str] | None = None) -> None:
    """Write all rows as CSV with a header, under display names if given."""
    # Quote marks double inside cells, as the scan expects; blanks around text stay.
    df.select(_shown(df, shown)).write.options(
        header=True,
        escape='"',
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    ).csv(folder)


def export_csv(
    df: DataFrame,
    folder: str,
    order_by: Sequence[str] = (ROW_ORDER,),
    shown: Mapping[str, str] | None = None,
) -> None:
    """Write all rows as CSV parts that follow one another, and a manifest of them.

    Rows are dealt out by ranges of the order, so part after part gives the whole in
    order. Parts and manifest are written aside and published as `folder` in one step:
    an export that stops half way leaves no folder. An existing folder is an error.
    """
    spark = df.sparkSession
    if exists(spark, folder):
        raise ValueError(f"the folder exists: {folder}")
    parent, _, name = folder.rstrip("/").rpartition("/")
    staged = f"{parent}/_{name}-{uuid.uuid4().hex}"
    order = [ref(c) for c in order_by]
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    sink_csv(dealt, staged, shown)
    cells = spark.read.options(header=True, **_options(multi_line=True)).csv(staged)
    # Part files are numbered by range. A row for each part.
    parts = cells.groupBy(F.col("_metadata.file_name").alias("part")).agg(F.count("*").alias("n_rows"))
    numbered = parts.withColumn("place", F.regexp_extract("part", r"^part-(\d+)", 1).cast("int"))
    numbered.write.parquet(f"{staged}/{_MANIFEST}")
    if not publish(spark, staged, folder):
        raise ValueError(f"the folder exists: {folder}")


def export_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """place, part, n_rows of an export; reading parts by place gives the order."""
    return spark.read.parquet(f"{folder}/{_MANIFEST}").select("place", "part", "n_rows").orderBy("place")


def read_export(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of an export with `ROW_ORDER`: the place of the part, then of the row."""
    first = export_manifest(spark, folder).head()
    if first is None:
        raise ValueError(f"the export has no rows: {folder}")
    scanned = scan_csv(spark, folder, multi_line=True, with_row_order=True)
    file = F.substring_index(F.col(f"{ROW_ORDER}.file"), "/", -1)
    place = F.regexp_extract(file, r"^part-(\d+)", 1).cast("int")
    order = F.struct(place.alias("place"), F.col(f"{ROW_ORDER}.row").alias("row"))
    return scanned.withColumn(ROW_ORDER, order)
