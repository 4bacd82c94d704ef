"""Compute costly columns once."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from absentia.functions.text import ref


def with_computed(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """`withColumns`, but each expression is evaluated once per row.

    Later filters on a plain computed column are pushed below its projection
    with the whole expression copied into them, so a parsed date would be parsed
    again by every rule that looks at it. A lateral one-row `inline` keeps the
    filters on the finished value; filters on other columns still pass through.
    Columns that are only renamed or passed on need none of this.
    """
    stand_ins = {name: f"_computed_{i}" for i, name in enumerate(columns)}
    finished = df.select("*", *[columns[n].alias(s) for n, s in stand_ins.items()])
    one_row = F.array(F.struct(*[F.col(s).alias(f"{s}_out") for s in stand_ins.values()]))
    wide = finished.select(*[ref(c) for c in df.columns], F.inline(one_row))
    names = list(df.columns) + [n for n in columns if n not in df.columns]
    return wide.select(
        [F.col(f"{stand_ins[n]}_out").alias(n) if n in stand_ins else ref(n) for n in names]
    )
