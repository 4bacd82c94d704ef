"""Dates and times out of mixed exports.

One column may mix ISO, US, day-first and written-out dates. A cell is first
sent by its look to one rewrite into "year-month-day [clock]" text, then one
cast reads it; what none of the rewrites knows goes word by word (`date_words`). The cast is a plain parser: no formatter to choose, no exception
for a bad cell and no session time zone. A cell meets two or three patterns at
most, and the common year-first form only one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from absentia.functions.date_words import canonical
from absentia.functions.lateral import with_computed
from absentia.functions.text import ref, strip

# --- fixed values: accepted shapes -------------------------------------------
# Years a nanosecond clock covers in full; other years count as unreadable.
_YEAR = r"(?:167[89]|16[89]\d|1[7-9]\d\d|2[01]\d\d|22[0-5]\d|226[01])"
# 2021-03-04, 2021/3/4
_YEAR_FIRST = rf"^{_YEAR}[-/]\d"
# 25/12/2021, 25-12-2021: the first number cannot be a month
_DAY_FIRST = rf"^(1[3-9]|[23]\d)([-/])(\d{{1,2}})\2({_YEAR})(?!\d)"
# 3/4/2021, 3-4-2021
_MONTH_FIRST = rf"^(\d{{1,2}})([-/])(\d{{1,2}})\2({_YEAR})(?!\d)"
# 20210304
_COMPACT = rf"^({_YEAR})(\d\d)(\d\d)$"
# March 4, 2021 and 04-Mar-2021
_MONTH = (
    r"(?:january|jan|february|feb|march|mar|april|apr|may|june|jun|july|jul|"
    r"august|aug|september|sept|sep|october|oct|november|nov|december|dec)"
)
_NAMED = rf"(?i)^(?:{_MONTH}\s+(\d{{1,2}}),\s+|(\d{{1,2}})-{_MONTH}-)({_YEAR})(?!\d)"
_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
# Two-digit years from 69 on are in the 1900s.
_SHORT_YEAR_PIVOT = "69"
_READABLE = rf"^({_YEAR}-.*?)\s*(?:[aApP][mM])?$"
_LONGEST = 60
_BARE_CLOCK = r"^\d{1,2}:\d{1,2}(:\d{1,2}(\.\d{1,6})?)?(\s*[aApP][mM])?$"


def _from_numbers(text: Column) -> Column:
    """Month first; day first only where the first number cannot be a month."""
    short = F.substring(text, -2, 2)
    century = F.when(short >= _SHORT_YEAR_PIVOT, F.lit("/19")).otherwise(F.lit("/20"))
    full = F.when(
        F.substring(text, -3, 1) == "/", F.concat(F.substring_index(text, "/", 2), century, short)
    ).otherwise(text)
    day_first = F.regexp_replace(full, _DAY_FIRST, "$4-$3-$1")
    return F.regexp_replace(day_first, _MONTH_FIRST, "$4-$1-$3")


def _from_month_name(text: Column) -> Column:
    name = F.when(text.rlike("^[A-Za-z]"), text).otherwise(
        F.substring_index(F.substring_index(text, "-", 2), "-", -1)
    )
    at = F.instr(F.lit(_MONTHS), F.lower(F.substring(name, 1, 3)))
    month = F.floor((at + F.lit(2)) / F.lit(3)).cast("string")
    return F.regexp_replace(
        text, F.lit(_NAMED), F.concat(F.lit("$3-"), month, F.lit("-$1$2"))
    )


def _year_month_day(text: Column) -> Column:
    """Date part rewritten to "year-month-day"; text of no known shape as it is."""
    return (
        F.when(text.rlike(_YEAR_FIRST), F.translate(text, "/", "-"))
        .when(text.rlike("[A-Za-z]{3}"), _from_month_name(text))
        .when((F.length(text) == 8) & text.rlike(_COMPACT), F.regexp_replace(text, _COMPACT, "$1-$2-$3"))
        .otherwise(_from_numbers(text))
    )


def _read(written: Column, text: Column) -> Column:
    """Cast rewritten text; a trailing AM or PM, as in `text`, shifts the clock.

    What the rewrites left alone must not pass for a date by itself, so the text
    has to begin with a year and a dash.
    """
    half = F.lower(F.substring(text, -2, 2))
    hour = F.regexp_extract(text, r"(?:^|[T\s])(\d{1,2}):", 1).try_cast("int")
    shift = (
        F.when(half == "pm", F.when(hour < 12, 12).otherwise(0))
        .when(half == "am", F.when(hour == 12, -12).otherwise(0))
        .otherwise(0)
    )
    dated = F.regexp_extract(written, _READABLE, 1)
    return F.regexp_replace(dated, r"\s+", " ").try_cast("timestamp_ntz") + F.make_dt_interval(
        hours=shift
    )


def parse_common_date(c: Column) -> Column:
    """`timestamp_ntz` from text in one of the common shapes, null if none fits."""
    text = strip(c)
    return _read(_year_month_day(text), text)


def parse_free_date(c: Column) -> Column:
    """`timestamp_ntz` from text in any wording `date_words` lists, null if none fits."""
    text = strip(c)
    # A cell without a digit, or one as long as a sentence, is no date in any wording.
    worth = (F.length(text) <= _LONGEST) & text.rlike(r"\d")
    return F.regexp_extract(canonical(F.when(worth, text)), _READABLE, 1).try_cast("timestamp_ntz")


def parse_mixed_date(c: Column) -> Column:
    """`timestamp_ntz` from text in any accepted shape, null if none fits.

    Only what has none of the common shapes is looked at word by word.
    """
    return F.coalesce(parse_common_date(c), parse_free_date(c))


def as_moment(c: Column, dtype: T.DataType) -> Column:
    """A date-like column as `timestamp_ntz`; text is parsed, the rest is cast."""
    if isinstance(dtype, T.TimestampNTZType):
        return c
    if isinstance(dtype, (T.DateType, T.TimestampType)):
        return c.cast("timestamp_ntz")
    return parse_mixed_date(c)


def moment_of(df: DataFrame, name: str) -> Column:
    return as_moment(ref(name), df.schema[name].dataType)


# A bare clock time is put on this day, which no absence falls on.
_CLOCK_YEAR = 1678
_CLOCK_DAY = f"{_CLOCK_YEAR}-01-01 "


def moment_or_clock(c: Column) -> Column:
    """A full moment, or a bare clock time on a day set aside for those."""
    text = strip(c)
    dated = F.when(text.rlike(_BARE_CLOCK), F.concat(F.lit(_CLOCK_DAY), text)).otherwise(
        _year_month_day(text)
    )
    return _read(dated, text)


def hours_from(start: Column, end: Column) -> Column:
    """Hours between two results of `moment_or_clock`; null if negative, or if
    one is a clock time and the other a moment."""
    same_kind = (F.year(start) == _CLOCK_YEAR) == (F.year(end) == _CLOCK_YEAR)
    micros = F.timestamp_diff("MICROSECOND", start, end)
    return F.when(same_kind & (start <= end), micros / F.lit(3.6e9))


def hours_between(df: DataFrame, start: str, end: str, target: str) -> DataFrame:
    """Add the hours from one text column to another as `target`."""
    parsed = with_computed(df, {"_start": moment_or_clock(ref(start))})
    parsed = with_computed(parsed, {"_end": moment_or_clock(ref(end))})
    hours = hours_from(F.col("_start"), F.col("_end"))
    return parsed.withColumn(target, hours).drop("_start", "_end")


def school_year_of(moment: Column) -> Column:
    """Label of the July-to-June year a date falls in."""
    first = F.year(F.add_months(moment.cast("date"), -6))
    return F.concat(first.cast("string"), F.lit("-"), (first + 1).cast("string"))


def label_years(label: Column) -> tuple[Column, Column]:
    """The two years of a "YYYY-YYYY" label; both null unless both can be read.

    Any two whole numbers from 1 to 9999 with one dash between them are accepted.
    """
    first, last = F.substring_index(label, "-", 1), F.substring_index(label, "-", -1)
    one_dash = F.length(first) + F.length(last) + 1 == F.length(label)
    first_year, last_year = first.try_cast("int"), last.try_cast("int")
    readable = one_dash & (first_year > 0) & (first_year < 10000) & (last_year > 0) & (last_year < 10000)
    return F.when(readable, first_year), F.when(readable, last_year)


def school_year_bounds(label: Column) -> tuple[Column, Column]:
    """First and last moment of a label: 1 July and 30 June, 00:00."""

    def bound(year: Column, day: str) -> Column:
        return F.concat(F.lpad(year.cast("string"), 4, "0"), F.lit(day)).try_cast("timestamp_ntz")

    first, last = label_years(label)
    return bound(first, "-07-01"), bound(last, "-06-30")


def outside_school_year(moment: Column, label: Column) -> Column:
    """Before 1 July of the first year or after 30 June, 00:00, of the last.

    Null if either is unknown. Counts months instead of building the bounds: a
    day less a moment later, 30 June at midnight is still June, and what follows
    is July.
    """
    first, last = label_years(label)
    later = moment + F.expr("INTERVAL '23:59:59.999999' HOUR TO SECOND")

    def months(t: Column) -> Column:
        return F.year(t) * 12 + F.month(t)

    return (months(moment) < first * 12 + 7) | (months(later) > last * 12 + 6)


def school_year_wellformed(label: Column) -> Column:
    return (F.length(label) == 9) & (F.substring(label, 5, 1) == "-")
