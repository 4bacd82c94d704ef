"""Numbers out of free text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from absentia.functions.text import ref, strip

_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d{1,2})?$"


def to_number(c: Column, dtype: T.DataType | None = None) -> Column:
    """Double value of a column; anything that is not a finite number is null.

    Text passes a pattern before the cast: the cast alone reads "1d" and "0f"
    as numbers, and each parse it fails, of an empty text too, costs an exception.
    """
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        value = c.cast("double")
        return F.when(F.abs(value) < F.lit(float("inf")), value)
    if isinstance(dtype, (T.NumericType, T.BooleanType)):
        return c.cast("double")
    text = strip(c)
    return F.when(text.rlike(_NUMBER), F.regexp_extract(text, _NUMBER, 0).try_cast("double"))


def number_of(df: DataFrame, name: str) -> Column:
    return to_number(ref(name), df.schema[name].dataType)


def round6(c: Column) -> Column:
    """Sums of doubles depend on the order of addition; six decimals do not."""
    return F.round(c, 6)
