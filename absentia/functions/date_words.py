"""Dates in free wording, by the classes of their words.

A text is cut into tokens: numbers by their length, names of months and weekdays, halves
of the day. Each token stands for its class in one letter, and what is left between
them for itself. The letters of a text, its wording, are looked up in a table that says
which token is the year, month, day, hour and so on. New wordings are new table rows,
not new patterns. A text of no listed wording is null.

Months come first in all-number wordings unless the first number cannot be one. A time
zone is not accepted: a column of moments has none.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# --- fixed values: words and their classes -----------------------------------
_MONTHS = (
    "jan(?:uary)?", "feb(?:ruary)?", "mar(?:ch)?", "apr(?:il)?", "may", "june?", "july?",
    "aug(?:ust)?", "sept?(?:ember)?", "oct(?:ober)?", "nov(?:ember)?", "dec(?:ember)?",
)
_WEEKDAYS = (
    "mon(?:day)?|tue(?:s(?:day)?)?|wed(?:nesday)?|thu(?:rs?(?:day)?)?|fri(?:day)?|"
    "sat(?:urday)?|sun(?:day)?"
)
# Words that say nothing, as in "4th of March 2021 at 10:00".
_FILLERS = "at|on|of|and"
# Classes: M month name, P half of the day; numbers of 1-2, 4, 6, 8, 12, 14 digits.
_NUMBERS = (("D", "1,2"), ("Y", "4"), ("S", "6"), ("C", "8"), ("E", "12"), ("F", "14"))

# --- fixed values: wordings of dates and of clocks ----------------------------
# Parts in token order: y year, m month, d day, t two-digit year; "a" and "b" are month
# and day, or day and month if "a" cannot be a month; c, e, f hold several parts.
_DATES = {
    "D M Y": "dmy", "M D Y": "mdy", "Y M D": "ymd", "Y D M": "ydm",
    "D M D": "dmt", "M D D": "mdt", "M Y": "my", "Y M": "ym",
    "Y D D": "ymd", "D D Y": "aby", "D D D": "abt", "D Y": "my",
    "C": "c", "E": "e", "F": "f",
}
# H hour, I minute, S second, N fraction, P half; G is hour and minute, J with seconds.
_CLOCKS = {
    "": "", "D:D": "HI", "D:D:D": "HIS", "D:D:D.N": "HISN",
    "D:D P": "HIP", "D:D:D P": "HISP", "D:D:D.N P": "HISNP", "D P": "HP",
}
_COMPACT_CLOCKS = {"Y": "G", "S": "J"}
_PIVOT = 69


def _wordings() -> dict[str, str]:
    """Every wording with its parts: a date, a clock before or behind it."""
    table = {}
    for date, parts in _DATES.items():
        for clock, more in _CLOCKS.items():
            if clock and parts in "ef":
                continue
            table[f"{date} {clock}".strip()] = parts + more
            if clock and clock != "D P":
                table[f"{clock} {date}"] = more + parts
    for clock, more in _COMPACT_CLOCKS.items():
        table[f"C {clock}"] = "c" + more
    return table


_TABLE = _wordings()
_PARTS = "ymdtabcefHISNPGJ"


def _tokens(text: Column) -> Column:
    """The text in lower case with one blank between tokens: names of months by their
    number, marked M; halves marked P; fractions marked N."""
    steps = [
        (r"(?<=\d)(?:st|nd|rd|th)\b", ""),
        (r"(?<=[\d ])([ap])\.?m\b\.?", " P$1 "),
        (rf"\b(?:{_WEEKDAYS})\b\.?", " "),
        *[(rf"(?<![a-z])(?:{name})(?![a-z])\.?", f" M{i} ") for i, name in enumerate(_MONTHS, 1)],
        (rf"\b(?:{_FILLERS})\b", " "),
        (r"(:\d{1,2})[.,](\d{1,9})(?!\d)", "$1 N$2"),
        (r"(?<=\d)t(?=\d)", " "),
        (r"[\s,;/.'-]+", " "),
    ]
    done = reduce(lambda t, s: F.regexp_replace(t, *s), steps, F.lower(text))
    return F.trim(done)


def _wording(tokens: Column) -> Column:
    """Classes for tokens; what is no token, or of no known class, stays."""
    shape = F.regexp_replace(F.regexp_replace(tokens, r"M\d+", "M"), " N\\d+", ".N")
    shape = F.regexp_replace(shape, "P[ap]", "P")
    for name, digits in _NUMBERS:
        shape = F.regexp_replace(shape, rf"(?<!\d)\d{{{digits}}}(?!\d)", name)
    return shape


def _two(c: Column) -> Column:
    return F.lpad(c, 2, "0")


def canonical(text: Column) -> Column:
    """ "year-month-day hour:minute:second.fraction" of a text in a listed wording."""
    table = F.create_map(*[F.lit(x) for pair in _TABLE.items() for x in pair])

    # Each step hands one finished value to the next, so nothing is worked out twice.
    def read(tokens: Column) -> Column:
        return F.struct(
            F.element_at(table, _wording(tokens)).alias("parts"),
            F.regexp_extract_all(tokens, F.lit(r"(\d+|P[ap])"), 1).alias("values"),
        )

    cells = F.filter(F.array(text), lambda t: t.isNotNull())
    found = F.transform(F.transform(cells, _tokens), read)
    listed = F.filter(found, lambda x: x["parts"].isNotNull())
    return F.get(F.transform(listed, lambda x: _canonical(x["values"], x["parts"])), 0)


def _canonical(values: Column, parts: Column) -> Column:
    def part(name: str) -> Column:
        at = F.instr(parts, name)
        return F.when(at > 0, F.get(values, at - 1))

    packed = F.coalesce(part("c"), part("e"), part("f"))

    def cut(start: int, length: int) -> Column:
        return F.when(F.length(packed) >= start + length - 1, F.substring(packed, start, length))

    short = part("t")
    century = F.when(short.try_cast("int") >= _PIVOT, "19").otherwise("20")
    a, b = part("a"), part("b")
    swapped = a.try_cast("int") > 12
    year = F.coalesce(part("y"), F.concat(century, _two(short)), cut(1, 4))
    month = F.coalesce(part("m"), F.when(swapped, b).otherwise(a), cut(5, 2))
    day = F.coalesce(part("d"), F.when(swapped, a).otherwise(b), cut(7, 2), F.lit("1"))
    compact = F.coalesce(part("G"), part("J"), F.substring(F.when(F.length(packed) > 8, packed), 9, 6))

    def clock(start: int) -> Column:
        return F.when(F.length(compact) > start, F.substring(compact, start, 2))

    half, hour = part("P"), F.coalesce(part("H"), clock(1), F.lit("0")).cast("int")
    shifted = (
        F.when(half.isNull(), hour)
        .when((hour < 1) | (hour > 12), None)
        .otherwise(hour % 12 + F.when(half == "Pp", 12).otherwise(0))
    )
    minute, second = F.coalesce(part("I"), clock(3), F.lit("0")), F.coalesce(part("S"), clock(5), F.lit("0"))
    fraction = F.coalesce(F.concat(F.lit("."), F.substring(part("N"), 1, 6)), F.lit(""))
    return F.concat(
        year, F.lit("-"), _two(month), F.lit("-"), _two(day), F.lit(" "),
        _two(shifted.cast("string")), F.lit(":"), _two(minute), F.lit(":"), _two(second), fraction,
    )
