"""Joins that hold when one key has a third of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from absentia.functions.text import ref

HEAVY = 1000


def attach(
    rows: DataFrame, groups: DataFrame, key: str, values: Sequence[str], spread: Column, name: str
) -> DataFrame:
    """`rows` with a struct `name` of the values of their group; null without one.

    `groups` has one row for each (text) key, `n` being about the number of `rows` with
    it. Keys with more than one in `HEAVY` of all those rows are fewer than `HEAVY`: they
    are broadcast. For the others Spark chooses by the size of their table; if it
    shuffles, no key in it is large. `spread` tells rows apart; it places those that need
    no second look.
    """
    total = groups.agg(F.sum("n")).first()[0] or 0
    value = F.struct(*[ref(v) for v in values])
    is_heavy = F.col("n") * HEAVY > total
    heavy = groups.where(is_heavy).select(ref(key).alias("_heavy"), value.alias("_found"))
    light = groups.where(~is_heavy).select(ref(key).alias("_light"), value.alias("_other"))
    looked = rows.join(F.broadcast(heavy), rows[f"`{key}`"] == F.col("_heavy"), "left")
    placed = looked.withColumn(
        "_key",
        F.when(F.col("_heavy").isNull() & ref(key).isNotNull(), ref(key)).otherwise(
            F.concat(F.lit("\u0000"), spread.cast("string"))
        ),
    )
    met = placed.join(light, F.col("_key") == F.col("_light"), "left")
    return met.withColumn(name, F.coalesce("_found", "_other")).drop(
        "_heavy", "_found", "_key", "_light", "_other"
    )
