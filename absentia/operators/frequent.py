"""The most frequent values of many columns, exact, without shuffling all values.

One scan leaves a mergeable summary for each column (the built-in frequent-items
sketch, `TRACKED` values at most), a second counts the summaries' candidates exactly.
What is shuffled is bounded by columns times `TRACKED` a task, whatever the data. A
column counts as settled if

* its candidates make up all its rows, so there is no other value, or
* the last value asked for is met more often than any value outside the summary can be.

Where neither can be shown (values that are mostly different, ties near the cut), that
column's values are counted in full.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from absentia.functions.numbers import to_number
from absentia.functions.text import ref

TRACKED = 768
# The sketch's table for `TRACKED` values, and its bound: no count is off by more than
# 3.5 / size of all rows, and a value above twice that is always among the candidates.
_TABLE = 1024
_MISSED = 2 * 3.5 / _TABLE
COUNTED = "column_name string, value string, number_value double, n bigint"


def _cells(
    df: DataFrame, columns: Sequence[str], numbers: bool = True
) -> dict[str, tuple[Column, Column]]:
    """Text and number of each column; text is null where the cell does not count, and
    the number is null if numbers are not asked for."""
    cells = {}
    for c in columns:
        dtype = df.schema[c].dataType
        text, number = ref(c).cast("string"), to_number(ref(c), dtype)
        if isinstance(dtype, T.NumericType):
            text = F.when(number.isNotNull(), text)
        cells[c] = text, number if numbers else F.lit(None).cast("double")
    return cells


def _summaries(df: DataFrame, columns: Sequence[str], numbers: bool = True) -> list[dict]:
    """A row for each column: cells, numbers, range, a mask of the numbers' hashes, and
    the candidates. One aggregate, one row."""
    named = [
        x
        for i, (text, number) in enumerate(_cells(df, columns, numbers).values())
        # Adding zero makes one number of 0 and -0.
        for x in (text.alias(f"t{i}"), (F.when(text.isNotNull(), number) + 0.0).alias(f"x{i}"))
    ]
    wanted = []
    for i in range(len(columns)):
        bit = F.expr(f"shiftleft(1L, cast(pmod(xxhash64(x{i}), 64) AS int))")
        wanted.append(
            F.struct(
                F.count(f"t{i}").alias("n"),
                F.count(f"x{i}").alias("n_numbers"),
                F.min(f"x{i}").alias("low"),
                F.max(f"x{i}").alias("high"),
                F.bit_count(F.bit_or(F.when(F.col(f"x{i}").isNotNull(), bit))).alias("n_bits"),
                F.expr(f"approx_top_k(t{i}, {TRACKED}, {TRACKED})").alias("top"),
            ).alias(f"s{i}")
        )
    row = df.select(named).agg(*wanted).first()
    return [row[f"s{i}"].asDict() for i in range(len(columns))]


def _pairs(df: DataFrame, columns: Sequence[str], numbers: bool = True) -> DataFrame:
    """column_name, value, number_value: a row for each cell that counts."""
    structs = [
        F.struct(F.lit(c).alias("column_name"), text.alias("value"), number.alias("number_value"))
        for c, (text, number) in _cells(df, columns, numbers).items()
    ]
    return df.select(F.inline(F.array(*structs))).where(F.col("value").isNotNull())


def _grouped(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("column_name", "value", "number_value").agg(F.count("*").alias("n"))


def leading_values(
    df: DataFrame, wanted: Mapping[str, int], numbers: bool = True
) -> tuple[DataFrame, dict[str, dict]]:
    """Counts of values (COUNTED), among them at least the `wanted` leading ones of each
    column, ties included, and what is known of each column.

    Known are n and n_numbers (cells and those that read as numbers), low, high, and
    n_distinct: how many numbers there are, or None for "more than wanted". With
    `numbers` off no cell is read as a number: all columns are judged by their texts.
    """
    spark, columns = df.sparkSession, list(wanted)
    read = {} if numbers else {"numbers": False}
    known = dict(zip(columns, _summaries(df, columns, **read)))
    candidates = [
        (c, r["item"]) for c in columns for r in known[c].pop("top") if r["item"] is not None
    ]
    # At most TRACKED rows a column.
    few = spark.createDataFrame(candidates, "column_name string, value string")
    met = _pairs(df, columns, **read).join(F.broadcast(few), ["column_name", "value"])
    counted = _grouped(met).collect()
    open_columns = []
    for c, k in known.items():
        rows = [r for r in counted if r["column_name"] == c]
        complete = sum(r["n"] for r in rows) == k["n"]
        numbers = {r["number_value"] for r in rows if r["number_value"] is not None}
        only_numbers = k["n"] > 0 and k["n_numbers"] == k["n"]
        cut = sorted((r["n"] for r in rows), reverse=True)[wanted[c] - 1 : wanted[c]]
        if only_numbers:
            many = max(len(numbers), k["n_bits"] or 0) > wanted[c]
            k["n_distinct"] = None if many else len(numbers)
            settled = complete or many
        else:
            k["n_distinct"] = None
            settled = complete or (bool(cut) and cut[0] > _MISSED * k["n"])
        if not settled:
            open_columns.append(c)
    exact = spark.createDataFrame([r for r in counted if r["column_name"] not in open_columns], COUNTED)
    if not open_columns:
        return exact, known
    rest = _grouped(_pairs(df, open_columns, **read))
    for c in open_columns:
        if known[c]["n_numbers"] == known[c]["n"]:
            numbers = rest.where(F.col("column_name") == c).select("number_value").distinct()
            found = numbers.limit(wanted[c] + 1).count()
            known[c]["n_distinct"] = found if found <= wanted[c] else None
    return exact.unionByName(rest), known
