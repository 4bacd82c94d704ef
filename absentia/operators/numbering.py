"""Dense numbers for the rows of a table, without a window over all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from absentia.sources.storage import settle

_GROUPS = 1024


def numbered(rows: DataFrame, name: str = "number") -> DataFrame:
    """`rows`, kept in the shared folder, with numbers from 0 without gaps.

    A row's number is how many rows the files before its own hold, plus its place in
    the file, so reading again gives the same.
    """
    table = settle(rows, "numbered")
    placed = table.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    # A row for each file, summed up in hash groups first.
    sizes = placed.groupBy("_file").agg(F.count("*").alias("_n"))
    grouped = sizes.withColumn("_g", F.pmod(F.xxhash64("_file"), F.lit(_GROUPS)))
    before = Window.orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    totals = grouped.groupBy("_g").agg(F.sum("_n").alias("_t"))
    starts = totals.select("_g", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_s"))
    within = Window.partitionBy("_g").orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    inside = grouped.select("_file", "_g", F.coalesce(F.sum("_n").over(within), F.lit(0)).alias("_i"))
    offsets = inside.join(F.broadcast(starts), "_g")  # _GROUPS rows at most
    offsets = settle(offsets.select("_file", (F.col("_s") + F.col("_i")).alias("_before")), "offsets")
    met = placed.join(offsets, "_file")
    return met.withColumn(name, F.col("_before") + F.col("_row")).drop("_file", "_row", "_before")
