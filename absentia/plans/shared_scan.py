"""Six profiles of a data set from one scan.

Null counts, structure, date range, distinct types, the validation report and the
cleaning steps are sums, minima and maxima over rows. One aggregate by employee type
makes them all; its table has a row for each type and place where rows fell, and every
profile is a small aggregate of it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F, types as T

from absentia.config import RowFilters, RuleConfig
from absentia.functions.text import ref
from absentia.operators.validation import record_columns
from absentia.plans.judged import CHECKS, checks_report, judge, step_counts
from absentia.sources.storage import settle
from absentia.vocabulary import DATE, EMPLOYEE_TYPE


@dataclass(frozen=True)
class Profiles:
    """The one table, kept in the shared folder, and what derives from it."""

    table: DataFrame
    schema: T.StructType

    @property
    def columns(self) -> list[str]:
        return [f.name for f in self.schema.fields]

    @property
    def structure_profile(self) -> DataFrame:
        totals = [F.sum(f"nulls_{i}").alias(f"nulls_{i}") for i in range(len(self.columns))]
        row = self.table.agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"), *totals)
        fields = [
            F.struct(
                F.lit(f.name).alias("column_name"),
                F.lit(f.dataType.simpleString()).alias("data_type"),
                F.coalesce(f"nulls_{i}", F.lit(0)).alias("n_nulls"),
            )
            for i, f in enumerate(self.schema.fields)
        ]
        return row.select("n_rows", F.inline(F.array(*fields)))

    @property
    def null_counts(self) -> DataFrame:
        return self.structure_profile.select("column_name", "n_nulls")

    @property
    def date_range(self) -> DataFrame:
        return self.table.agg(F.min("min_date").alias("min_date"), F.max("max_date").alias("max_date"))

    @property
    def distinct_types(self) -> DataFrame:
        named = self.table.where(F.trim("employee_type") != "")
        return named.select("employee_type").distinct().orderBy("employee_type")

    @property
    def validation_report(self) -> DataFrame:
        return checks_report(self.table, self.columns)

    @property
    def cleaning_stats(self) -> DataFrame:
        return step_counts(self.table)


def profiles_of(df: DataFrame, config: RuleConfig = RuleConfig()) -> Profiles:
    """Scan once; each of the profiles equals the operator of its name."""
    names = record_columns(df)
    nulls = [ref(c).isNull().alias(f"_null_{i}") for i, c in enumerate(names)]
    judged = judge(df, RowFilters(), config, nulls)
    kind = ref(EMPLOYEE_TYPE).cast("string") if EMPLOYEE_TYPE in names else F.lit(None).cast("string")
    moment = ref(DATE) if DATE in names else F.lit(None).cast("timestamp_ntz")
    table = judged.groupBy(kind.alias("employee_type"), F.col("_fell").alias("fell")).agg(
        F.count("*").alias("n_rows"),
        F.min(moment).alias("min_date"),
        F.max(moment).alias("max_date"),
        *[F.count_if(f"_null_{i}").alias(f"nulls_{i}") for i in range(len(names))],
        *[F.count_if(f"_{c}").alias(c) for c in CHECKS if f"_{c}" in judged.columns],
    )
    schema = T.StructType([df.schema[c] for c in names])
    return Profiles(settle(table, "profiles"), schema)
