"""History of ratings: one row per run, successful or not, added once."""

from __future__ import annotations

import json
import traceback
import uuid
from collections.abc import Mapping
from datetime import datetime, timezone
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from absentia.sources.storage import folders_in, publish, remove

RUN_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("created_at", T.StringType()),
        T.StructField("user_email", T.StringType()),
        T.StructField("filename", T.StringType()),
        T.StructField("filters_json", T.StringType()),
        T.StructField("rows_raw", T.LongType()),
        T.StructField("rows_selected", T.LongType()),
        T.StructField("rows_cleaned", T.LongType()),
        T.StructField("total_teachers", T.LongType()),
        T.StructField("total_premium", T.DoubleType()),
        T.StructField("status", T.StringType()),
        T.StructField("error_message", T.StringType()),
        T.StructField("step", T.StringType()),
        T.StructField("run_id", T.StringType()),
        T.StructField("model_name", T.StringType()),
        T.StructField("dataset_fingerprint", T.StringType()),
    ]
)


def run_row(
    spark: SparkSession,
    status: str,
    measured: DataFrame | None = None,
    filters: Mapping | None = None,
    **known,
) -> DataFrame:
    """One history row: values known on the driver and, from the one-row frame
    `measured`, values still to be computed by Spark."""
    unknown = set(known) - set(RUN_SCHEMA.fieldNames())
    if unknown:
        raise ValueError(f"not columns of the run history: {sorted(unknown)}")
    values = {
        "id": uuid.uuid4().hex,
        "created_at": datetime.now(timezone.utc).replace(tzinfo=None).isoformat(),
        "status": status,
        "filters_json": json.dumps(filters, default=str) if filters else None,
        **known,
    }
    base = measured if measured is not None else spark.range(1)
    columns = []
    for f in RUN_SCHEMA.fields:
        computed = measured is not None and f.name in measured.columns and f.name not in known
        value = F.col(f.name) if computed else F.lit(values.get(f.name))
        columns.append(value.cast(f.dataType).alias(f.name))
    return base.select(columns)


def append_run(row: DataFrame, folder: str) -> bool:
    """Add a history row; False if its run is in the history already.

    The row is written aside and then published under its run's name in one step, so
    a reader never meets half of it, an attempt that died leaves nothing, and a second
    attempt adds nothing. A run is told by its run_id; a failed one, or one without an
    id, is an event of its own.
    """
    spark = row.sparkSession
    staged = f"{folder}/_staging/{uuid.uuid4().hex}"
    row.write.parquet(staged)
    (written,) = spark.read.schema(RUN_SCHEMA).parquet(staged).select("id", "run_id", "status").collect()
    keyed = written["run_id"] is not None and written["status"] == "success"
    if keyed and _has_run(spark, folder, written["run_id"]):
        remove(spark, staged)
        return False
    name = f"run-{quote(written['run_id'], safe='')}" if keyed else f"event-{written['id']}"
    return publish(spark, staged, f"{folder}/{name}")


def _has_run(spark: SparkSession, folder: str, run_id: str) -> bool:
    if not folders_in(spark, folder):
        return False
    same = (F.col("run_id") == run_id) & (F.col("status") == "success")
    return not read_runs(spark, folder).where(same).isEmpty()


def append_failed_run(
    spark: SparkSession,
    folder: str,
    step: str,
    error: BaseException,
    measured: DataFrame | None = None,
    **known,
) -> None:
    """Record a failure: the step, the message and the whole traceback."""
    trace = "".join(traceback.format_exception(error))
    message = f"{error}\n\nTraceback:\n{trace}"
    row = run_row(spark, "error", measured, step=step, error_message=message, **known)
    append_run(row, folder)


def read_runs(spark: SparkSession, folder: str) -> DataFrame:
    """The history, each row once, also while it is being compacted."""
    files = spark.read.schema(RUN_SCHEMA).option("recursiveFileLookup", True)
    return files.parquet(folder).dropDuplicates(["id"])


def compact_runs(spark: SparkSession, folder: str) -> None:
    """Many small files into one folder. Rows that come meanwhile stay as they are.

    The new folder is published before the old ones go; what is in both is read once.
    """
    old = folders_in(spark, folder)
    if not old:
        return
    staged = f"{folder}/_staging/{uuid.uuid4().hex}"
    rows = spark.read.schema(RUN_SCHEMA).parquet(*[f"{folder}/{n}" for n in old])
    rows.dropDuplicates(["id"]).write.parquet(staged)
    if publish(spark, staged, f"{folder}/compacted-{uuid.uuid4().hex}"):
        for name in old:
            remove(spark, f"{folder}/{name}")
