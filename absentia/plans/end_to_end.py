"""A file of absence records, from scan to rating and history row."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from absentia.config import RatingParams, RowFilters, RuleConfig
from absentia.operators.columns import (
    drop_hire_date,
    mapping_warnings,
    merge_mappings,
    rename_map,
    select_present,
    suggest_mapping,
)
from absentia.operators.filters import filter_rows
from absentia.operators.profile import fingerprint_of
from absentia.operators.validation import record_columns
from absentia.plans.cleaning import clean_adaptive
from absentia.plans.judged import (
    checks_report,
    judge,
    judged_ledger,
    ledger_of,
    row_counts,
    step_counts,
)
from absentia.plans.rate import RatingTables
from absentia.sources.csv_files import layouts_of, scan_layout
from absentia.sources.runs import append_failed_run, append_run, run_row
from absentia.sources.storage import settle
from absentia.vocabulary import ROW_ORDER


@dataclass(frozen=True)
class RatedFile:
    """Everything a run leaves behind.

    `book` is the ledger with the rows that fell beside it; `validation`, `stats` and
    `tables` are derived from it. `raw`, `selected` and `cleaned` are lazy and scan the
    files when they are used.
    """

    mapping: Mapping[str, str]
    warnings: Sequence[str]
    raw: DataFrame
    selected: DataFrame
    cleaned: DataFrame
    validation: DataFrame
    stats: DataFrame
    tables: RatingTables
    book: DataFrame


def renamed_records(
    raw: DataFrame, columns: Sequence[str] | None, mapping: Mapping[str, str]
) -> DataFrame:
    """Chosen columns (all but hire dates by default) under standard names."""
    wanted = list(columns or drop_hire_date(raw).columns)
    if not set(wanted) & set(raw.columns):
        raise ValueError("none of the selected columns is in the data")
    return rename_map(select_present(raw, [*wanted, ROW_ORDER]), mapping)


def select_records(
    raw: DataFrame,
    columns: Sequence[str] | None,
    mapping: Mapping[str, str],
    filters: RowFilters,
) -> DataFrame:
    """Chosen columns, standard names, row filters."""
    return filter_rows(renamed_records(raw, columns, mapping), filters)


def _together(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def rate_file(
    spark: SparkSession,
    paths: str | Sequence[str],
    columns: Sequence[str] | None = None,
    mapping: Mapping[str, str] | None = None,
    filters: RowFilters = RowFilters(),
    rules: RuleConfig = RuleConfig(),
    params: RatingParams = RatingParams(),
    runs_folder: str | None = None,
    user_email: str | None = None,
    run_id: str | None = None,
    keep_ledger: bool = True,
    multi_line: bool = False,
) -> RatedFile:
    """Scan, select, clean and rate; append to the run history if there is one.

    The files are scanned once: row counts, validation and cleaning steps come out of
    the aggregate that makes the ledger (`plans/judged.py`). Headers are read before,
    some lines a file.

    Files may have different headers: each layout gets its own mapping, and columns a
    layout lacks are null. `mapping` is the user's {original: standard} choice; aliases
    fill the rest. A filter on employee types switches Rule 2 off. On failure the
    history gets the step and the traceback, and the error goes on. With a `run_id` a
    run that is already in the history is not added again.
    """
    known = {
        "filename": paths if isinstance(paths, str) else ",".join(paths),
        "user_email": user_email,
        "run_id": run_id,
        "filters": {k: v for k, v in asdict(filters).items() if v},
    }
    step = "upload"
    try:
        layouts = layouts_of(spark, paths, multi_line)
        if not any(x.has_rows for x in layouts):
            raise ValueError("the file has no rows")
        scans = [scan_layout(spark, x, paths, multi_line, with_row_order=True) for x in layouts]
        step = "select"
        final_map, renamed = {}, []
        for raw in scans:
            headings = [c for c in raw.columns if c != ROW_ORDER]
            candidates = [c for c in (columns or headings) if c in headings]
            own = merge_mappings(mapping or {}, suggest_mapping(candidates), candidates)
            final_map = own | final_map
            renamed.append(renamed_records(raw, columns, own))
        records = _together(renamed)
        step = "clean"
        if filters.employee_type:
            rules = RuleConfig(**{**asdict(rules), "user_filtered_types": True})
        judged = judge(records, filters, rules)
        step = "calculate"
        book = judged_ledger(judged, with_names=True, order_by=[ROW_ORDER])
        if keep_ledger:
            book = settle(book, "ledger")
        tables = RatingTables(ledger_of(book), params)
        selected = filter_rows(records, filters)
        cleaned = clean_adaptive(selected, rules)
        if runs_folder:
            names = record_columns(cleaned)
            append_run(
                run_row(spark, "success", _measured(book, tables, names), **known), runs_folder
            )
    except Exception as error:
        if runs_folder:
            append_failed_run(spark, runs_folder, step, error, **known)
        raise
    return RatedFile(
        final_map,
        mapping_warnings(final_map),
        _together(scans),
        selected,
        cleaned,
        checks_report(book, record_columns(records)),
        step_counts(book),
        tables,
        book,
    )


def _measured(book: DataFrame, tables: RatingTables, names: Sequence[str]) -> DataFrame:
    """The history row's figures in one frame, still to be computed.

    Each part is one row with some of the columns; unioned and reduced by `max` they
    make one row without a join.
    """
    counts = row_counts(book)
    parts = [
        counts.withColumn("dataset_fingerprint", fingerprint_of(names, F.col("rows_cleaned"))),
        tables.summary.select(
            F.col("overall_total_staff").alias("total_teachers"), "total_premium"
        ),
    ]
    wide = parts[0].unionByName(parts[1], allowMissingColumns=True)
    return wide.agg(*[F.max(c).alias(c) for c in wide.columns])
