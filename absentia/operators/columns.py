"""Column selection, renaming and harmonisation.

All decisions are taken on the driver from the list of column names; the data
is touched by one projection.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from absentia.functions.dates import moment_of, school_year_of
from absentia.functions.numbers import to_number
from absentia.functions.text import ref
from absentia.vocabulary import (
    ABSENCE_DAYS,
    ABSENCE_TYPE,
    CALCULATION_ALIASES,
    CALCULATION_COLUMNS,
    DATE,
    DURATION,
    EMPLOYEE_ID,
    FIRST_NAME_HEADINGS,
    FIRST_NAME_OVERRIDES,
    KEEP_AS_IS,
    LAST_NAME_HEADINGS,
    LAST_NAME_OVERRIDES,
    SCHOOL_YEAR,
    STANDARD_COLUMNS,
    START_TIME,
    SUGGESTION_ALIASES,
)


def _squeeze(name: str) -> str:
    return name.strip().lower().replace(" ", "").replace("_", "")


def _about_hiring(name: str) -> bool:
    return "hire" in name.lower()


def _positional(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """The frame under unique stand-in names, so repeated names can be told apart."""
    stand_ins = [f"_column_{i}" for i in range(len(df.columns))]
    return df.toDF(*stand_ins), stand_ins


def _final_names(names: Iterable[str]) -> dict[str, str]:
    """Tell apart names that differ only in case, which Spark takes for one.

    Standard names keep their spelling; the others get a suffix.
    """
    taken: set[str] = set()
    final = {}
    for name in sorted(names, key=lambda n: n not in STANDARD_COLUMNS):
        unique, n = name, 0
        while unique.lower() in taken:
            n += 1
            unique = f"{name}.{n}"
        taken.add(unique.lower())
        final[name] = unique
    return final


def _first_of_each(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Give the columns these names, keeping the first of equal ones."""
    plain, stand_ins = _positional(df)
    first: dict[str, str] = {}
    for stand_in, name in zip(stand_ins, names):
        first.setdefault(name, stand_in)
    final = _final_names(first)
    return plain.select([F.col(s).alias(final[n]) for n, s in first.items()])


def dedup_header(df: DataFrame) -> DataFrame:
    """Keep the first of several columns of the same name."""
    return _first_of_each(df, df.columns)


def select_strict(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """These columns, each once; an unknown one is an error."""
    wanted = list(dict.fromkeys(columns))
    missing = [c for c in wanted if c not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}")
    return df.select([ref(c) for c in wanted])


def select_present(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Those of the columns that exist; an error only if none does."""
    present = [c for c in dict.fromkeys(columns) if c in df.columns]
    if not present:
        raise ValueError("none of the selected columns is in the data")
    return df.select([ref(c) for c in present])


def drop_hire_date(df: DataFrame) -> DataFrame:
    """Leave out hire dates, however written; alone, such a column stays."""
    kept = [c for c in df.columns if _squeeze(c) != "hiredate"]
    return df.select([ref(c) for c in kept or df.columns])


def rename_map(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename {original: standard}; of several for one standard the first wins.

    A column called "date" mapped to the school year is no rename: the year's
    label is derived from it and the date itself goes.
    """
    applicable = {
        c: s for c, s in mapping.items() if c in df.columns and s and s != KEEP_AS_IS
    }
    year_from = [
        c for c, s in applicable.items() if s == SCHOOL_YEAR and c.strip().lower() == "date"
    ]
    names = [applicable.get(c, c) for c in df.columns if c not in year_from]
    kept = df.select([ref(c) for c in df.columns if c not in year_from] + [
        school_year_of(moment_of(df, c)).alias(f"_year_{i}") for i, c in enumerate(year_from)
    ])
    return _first_of_each(kept, names + [SCHOOL_YEAR] * len(year_from))


def _alias_fits(column: str, alias: str) -> bool:
    plain = column.strip().lower()
    return _squeeze(column) == _squeeze(alias) or alias in plain or plain in alias


def suggest_mapping(
    columns: Iterable[str], standards: Sequence[str] = STANDARD_COLUMNS
) -> dict[str, str]:
    """{original: standard} by the first alias that equals or contains the name
    or is contained in it. Hire dates never pass for absence dates."""
    suggested = {}
    for column in columns:
        fits = (
            standard
            for alias, standard in SUGGESTION_ALIASES.items()
            if standard in standards
            and not (standard == DATE and _about_hiring(column))
            and _alias_fits(column, alias)
        )
        standard = next(fits, None)
        if standard:
            suggested[column] = standard
    return suggested


def valid_suggestion(
    suggested: Mapping[str, str],
    columns: Iterable[str],
    standards: Sequence[str] = STANDARD_COLUMNS,
) -> dict[str, str]:
    """The entries of a proposed mapping that make sense for these columns."""
    columns = set(columns)
    return {
        c: s
        for c, s in suggested.items()
        if c in columns and s in standards and not (s == DATE and _about_hiring(c))
    }


def merge_mappings(
    chosen: Mapping[str, str], suggested: Mapping[str, str], columns: Iterable[str]
) -> dict[str, str]:
    """The user's choice first; suggestions fill in the columns left open."""
    return {**valid_suggestion(suggested, columns), **chosen}


def mapping_warnings(mapping: Mapping[str, str]) -> list[str]:
    """What a rating would miss under this mapping."""
    mapped = set(mapping.values())
    warnings = []
    if not mapped & {DATE, SCHOOL_YEAR}:
        warnings.append("no column is mapped to Date or School Year")
    if EMPLOYEE_ID not in mapped:
        warnings.append("no column is mapped to Employee Identifier")
    if not mapped & {ABSENCE_DAYS, DURATION, START_TIME, ABSENCE_TYPE}:
        warnings.append(
            "no column is mapped to Absence_Days, Duration, Start Time or Absence Type"
        )
    return warnings


def mapping_check(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """(warning, n_rows): each warning with the number of rows it concerns."""
    warnings = F.array(*[F.lit(w) for w in mapping_warnings(mapping)]).cast("array<string>")
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.explode(warnings).alias("warning"), "n_rows"
    )


def _merge_under(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Give the columns these names and merge equal ones.

    Day counts are added up row by row, a missing one counting as 0; of any
    other name the first column stays.
    """
    plain, stand_ins = _positional(df)
    groups: dict[str, list[int]] = {}
    for i, name in enumerate(names):
        groups.setdefault(name, []).append(i)

    def merged(name: str, at: list[int]) -> Column:
        if name != ABSENCE_DAYS:
            return F.col(stand_ins[at[0]])
        counts = [to_number(F.col(stand_ins[i]), df.schema[i].dataType) for i in at]
        if len(counts) == 1:
            return counts[0]
        return reduce(lambda a, b: a + b, [F.coalesce(n, F.lit(0.0)) for n in counts])

    final = _final_names(groups)
    return plain.select([merged(n, at).alias(final[n]) for n, at in groups.items()])


def merge_duplicates(df: DataFrame) -> DataFrame:
    """One column per name: day counts summed, of others the first."""
    return _merge_under(df, df.columns)


def _calculation_name(column: str) -> str:
    plain = column.strip().lower()
    return CALCULATION_ALIASES.get(plain) or CALCULATION_ALIASES.get(
        plain.replace(" ", ""), column
    )


def normalize_for_rating(df: DataFrame) -> DataFrame:
    """Standard names by exact alias, duplicates merged.

    A second day column, such as "Days" beside computed days, is added to it.
    """
    return _merge_under(df, [_calculation_name(c) for c in df.columns])


def derive_school_year(df: DataFrame) -> DataFrame:
    """Add the school year from the date where there is no such column."""
    if SCHOOL_YEAR in df.columns or DATE not in df.columns:
        return df
    return df.withColumn(SCHOOL_YEAR, school_year_of(moment_of(df, DATE)))


def require_columns(df: DataFrame, columns: Sequence[str] = CALCULATION_COLUMNS) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(
            f"the rating needs the columns {missing}; the data has {df.columns}. "
            "Map a date or school year, an employee identifier and a source of days."
        )
    return df


def display_names(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Show "standard (original)" for every mapped column."""
    shown = {s: f"{s} ({c})" for c, s in mapping.items()}
    return df.withColumnsRenamed({s: n for s, n in shown.items() if s in df.columns})


def _pick(columns: Sequence[str], part: str, headings: Sequence[str], overrides: Sequence[str]):
    plain = {c: c.strip().lower().replace("_", " ").replace("-", " ") for c in columns}
    overriding = [c for c in columns if plain[c] in overrides]
    if overriding:
        return overriding[-1]
    return next(
        (
            c
            for c in columns
            if plain[c] in headings or (part in plain[c] and "name" in plain[c])
        ),
        None,
    )


def pick_name_columns(columns: Sequence[str]) -> tuple[str | None, str | None]:
    """Headings that hold first and last names.

    The first fitting heading counts, except that a bare "First", "Given",
    "Last", "Surname" or the like overrides it, the last such one winning.
    """
    return (
        _pick(columns, "first", FIRST_NAME_HEADINGS, FIRST_NAME_OVERRIDES),
        _pick(columns, "last", LAST_NAME_HEADINGS, LAST_NAME_OVERRIDES),
    )
