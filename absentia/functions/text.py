"""Text helpers, all plain column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from absentia.vocabulary import MISSING_TOKENS

_WHITESPACE = " \t\n\r\f\v"


def ref(name: str) -> Column:
    """Column by its exact name; headings from files may hold dots or backticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def strip(c: Column) -> Column:
    return F.btrim(c.cast("string"), F.lit(_WHITESPACE))


def norm_token(c: Column) -> Column:
    """Trimmed lower-case text, for matching words written in any style."""
    return F.lower(strip(c))


def clean_name(c: Column) -> Column:
    return F.coalesce(strip(c), F.lit(""))


def null_if_missing(c: Column) -> Column:
    """Cell text that stands for "no value" becomes null."""
    return F.when(~c.isin(*MISSING_TOKENS), c)


def money(c: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(c, 2))
