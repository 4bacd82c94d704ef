"""The fixture views and common steps in plain SQL.

Written from the table definitions, not from the Spark code: dates are taken
from the original column, never parsed back from text.
"""

from __future__ import annotations

_Y = "(year(l_shipdate) - CASE WHEN month(l_shipdate) < 7 THEN 1 ELSE 0 END)"


def _label(y: str) -> str:
    return f"(CAST({y} AS VARCHAR) || '-' || CAST({y} + 1 AS VARCHAR))"


_SCHOOL_YEAR = f"""CASE WHEN l_discount > 0.095 AND l_linenumber = 1 THEN 'FY' || CAST({_Y} AS VARCHAR)
    WHEN l_tax > 0.075 THEN {_label(_Y + ' - 1')} ELSE {_label(_Y)} END"""
_EMPLOYEE_TYPE = """CASE l_linenumber WHEN 3 THEN 'Teacher Music' WHEN 4 THEN 'Teacher SpecEd'
    WHEN 5 THEN 'Aide' WHEN 7 THEN NULL ELSE 'Teacher' END"""
_ABSENCE_TYPE = """CASE CAST(l_quantity AS INT) % 5 WHEN 0 THEN 'Full Day' WHEN 1 THEN 'AM Half Day'
    WHEN 2 THEN 'PM Half Day' WHEN 3 THEN 'Custom Duration' ELSE 'Sick' END"""
_DURATION = """CASE WHEN l_linenumber = 2 AND l_discount < 0.005 THEN -1.0::DOUBLE
    WHEN l_linenumber = 1 OR CAST(l_quantity AS INT) % 5 = 3 THEN l_quantity / 4 END"""
_LOOKUPS = """lineitem
  LEFT JOIN supplier ON s_suppkey = l_suppkey
  LEFT JOIN nation ON n_nationkey = s_nationkey
  LEFT JOIN part ON p_partkey = l_partkey"""

# Typed records: sy, d, e, fn, ln, school, etype, atype, dur, filled, needs.
ABSENCES = f"""absences AS (SELECT
  {_SCHOOL_YEAR} AS sy,
  l_shipdate AS d,
  CAST(l_partkey AS VARCHAR) AS e,
  p_brand AS fn, p_name AS ln, n_name AS school,
  {_EMPLOYEE_TYPE} AS etype,
  {_ABSENCE_TYPE} AS atype,
  {_DURATION} AS dur,
  CASE WHEN l_linestatus = 'F' THEN 'Filled' ELSE 'Unfilled' END AS filled,
  CASE l_returnflag WHEN 'N' THEN 'NO' WHEN 'A' THEN 'YES' END AS needs,
  l_orderkey, l_linenumber, l_orderkey * 8 + l_linenumber AS row_no
FROM {_LOOKUPS})"""

_MINUTES_START = "(420 + (l_linenumber % 3) * 30)"
_MINUTES_SPAN = "(CASE WHEN l_linenumber = 3 THEN -30 ELSE CAST(l_quantity * 6 AS INT) END)"


def _clock(minutes: str) -> str:
    hour, minute = f"({minutes} // 60)", f"({minutes} % 60)"
    return f"""CASE WHEN l_linenumber % 2 = 1
      THEN CAST(CASE WHEN {hour} % 12 = 0 THEN 12 ELSE {hour} % 12 END AS VARCHAR) || ':'
        || lpad(CAST({minute} AS VARCHAR), 2, '0') || CASE WHEN {hour} < 12 THEN ' AM' ELSE ' PM' END
      ELSE CAST({hour} AS VARCHAR) || ':' || lpad(CAST({minute} AS VARCHAR), 2, '0') END"""


_DATE_TEXT = """CASE l_orderkey % 12
    WHEN 0 THEN strftime(l_shipdate, '%Y-%m-%d 08:30:00')
    WHEN 1 THEN strftime(l_shipdate, '%Y-%m-%d')
    WHEN 2 THEN strftime(l_shipdate, '%-m/%-d/%Y')
    WHEN 3 THEN strftime(l_shipdate, '%m-%d-%Y')
    WHEN 4 THEN CASE WHEN day(l_shipdate) > 12 THEN strftime(l_shipdate, '%d/%m/%Y')
                     ELSE strftime(l_shipdate, '%m/%d/%Y') END
    WHEN 5 THEN strftime(l_shipdate, '%Y/%-m/%-d')
    WHEN 6 THEN strftime(l_shipdate, '%B %-d, %Y')
    WHEN 7 THEN strftime(l_shipdate, '%b %d, %Y')
    WHEN 8 THEN strftime(l_shipdate, '%-m/%-d/%y')
    WHEN 9 THEN strftime(l_shipdate, '%d-%b-%Y')
    WHEN 10 THEN '  ' || strftime(l_shipdate, '%Y-%m-%dT08:30')
    ELSE CASE WHEN l_linenumber = 7 THEN 'bad' ELSE strftime(l_shipdate, '%Y%m%d') END END"""

# The same records as text, with what each cell should be read as beside it:
# d (date), dur (hours), span (hours between the times, null if negative).
RAW = f"""raw_cells AS (SELECT
  {_SCHOOL_YEAR} AS sy0, {_DURATION} AS dur0, {_EMPLOYEE_TYPE} AS etype0, {_ABSENCE_TYPE} AS atype0,
  l_orderkey % 97 = 0 AND l_linenumber = 1 AS blank,
  CAST(l_quantity AS INT) % 5 = 4 AS timed,
  {_MINUTES_SPAN} AS span_minutes,
  {_clock(_MINUTES_START)} AS start0,
  {_clock('(' + _MINUTES_START + ' + ' + _MINUTES_SPAN + ')')} AS end0,
  {_DATE_TEXT} AS date0,
  *
FROM {_LOOKUPS}),
raw AS (SELECT
  CASE WHEN NOT blank AND NOT (l_linenumber = 6 AND l_tax < 0.005) THEN sy0 END AS sy,
  CASE WHEN NOT blank THEN date0 END AS date_text,
  CASE WHEN blank OR (l_orderkey % 12 = 11 AND l_linenumber = 7) THEN NULL
       WHEN l_orderkey % 12 IN (0, 10) THEN l_shipdate + INTERVAL '510' MINUTE
       ELSE l_shipdate END AS d,
  CASE WHEN NOT blank AND NOT (l_linenumber = 7 AND l_tax < 0.005)
       THEN lpad(CAST(l_partkey AS VARCHAR), 9, '0') END AS e,
  CASE WHEN NOT blank THEN ' ' || p_brand || ' ' END AS fn,
  CASE WHEN NOT blank AND l_partkey % 50 <> 0 THEN p_name END AS ln,
  CASE WHEN NOT blank THEN n_name END AS school,
  CASE WHEN NOT blank THEN etype0 END AS etype,
  CASE WHEN NOT blank THEN atype0 END AS atype,
  CASE WHEN blank THEN NULL WHEN CAST(l_quantity AS INT) % 7 = 0
       THEN CAST(CAST(l_quantity AS INT) AS VARCHAR) || 'd' ELSE CAST(dur0 AS VARCHAR) END AS dur_text,
  CASE WHEN blank OR CAST(l_quantity AS INT) % 7 = 0 THEN NULL ELSE dur0 END AS dur,
  CASE WHEN NOT blank AND timed THEN start0 END AS start_text,
  CASE WHEN NOT blank AND timed THEN end0 END AS end_text,
  CASE WHEN NOT blank AND timed AND span_minutes >= 0 THEN span_minutes / 60.0::DOUBLE END AS span,
  CASE WHEN blank THEN NULL WHEN l_linenumber = 5 AND l_quantity > 45 THEN '1'
       WHEN l_linenumber = 5 AND l_quantity < 5 THEN '-1' END AS day_count,
  CASE WHEN NOT blank AND l_linenumber = 6 THEN '7.5' END AS usage_hours,
  CASE WHEN blank THEN NULL WHEN l_linestatus = 'F' THEN 'Filled' WHEN l_orderkey % 4 = 0 THEN 'Unfilled'
       WHEN l_orderkey % 4 = 1 THEN 'No' WHEN l_orderkey % 4 = 2 THEN '0' ELSE ' unfilled' END AS filled,
  CASE WHEN blank THEN NULL WHEN l_returnflag = 'N' AND l_orderkey % 4 = 2 THEN '0.00'
       WHEN l_returnflag = 'N' AND l_orderkey % 4 = 3 THEN 'n' WHEN l_returnflag = 'N' THEN 'NO'
       WHEN l_returnflag = 'A' THEN 'YES' END AS needs,
  CASE WHEN NOT blank THEN strftime(l_shipdate - INTERVAL '3' YEAR, '%Y-%m-%d') END AS hired,
  NOT blank AND l_linestatus <> 'F' AND l_returnflag = 'N' AS rule1_drops,
  blank, l_orderkey, l_linenumber, l_orderkey * 8 + l_linenumber AS row_no
FROM raw_cells)"""

TEACHERS = "('Teacher', 'Teacher Music', 'Teacher SpecEd')"
RULE1_EXACT = "NOT coalesce(filled = 'Unfilled' AND needs = 'NO', false)"
RULE2 = f"coalesce(etype IN {TEACHERS}, false)"
YEAR_START = """CASE WHEN regexp_full_match(sy, '[0-9]{4}-[0-9]{4}')
  THEN CAST(split_part(sy, '-', 1) || '-07-01 00:00:00' AS TIMESTAMP) END"""
YEAR_END = """CASE WHEN regexp_full_match(sy, '[0-9]{4}-[0-9]{4}')
  THEN CAST(split_part(sy, '-', 2) || '-06-30 00:00:00' AS TIMESTAMP) END"""
RULE3 = f"NOT coalesce(d < {YEAR_START} OR d > {YEAR_END}, false)"
BY_TYPE = "CASE WHEN atype = 'Full Day' THEN 1.0 WHEN atype IN ('AM Half Day', 'PM Half Day') THEN 0.5 ELSE 0.0 END"
DAYS_EXACT = f"""CAST(CASE WHEN atype = 'Custom Duration' THEN coalesce(dur / 7.5::DOUBLE, 0)
  ELSE {BY_TYPE} END AS DOUBLE)"""
DAYS_TYPED = f"CAST(CASE WHEN dur >= 0 THEN dur / 7.5::DOUBLE ELSE {BY_TYPE} END AS DOUBLE)"
DAYS_RAW = f"""CAST(CASE WHEN CAST(day_count AS DOUBLE) >= 0 THEN CAST(day_count AS DOUBLE)
  WHEN coalesce(dur, CAST(usage_hours AS DOUBLE)) >= 0
    THEN coalesce(dur, CAST(usage_hours AS DOUBLE)) / 7.5::DOUBLE
  WHEN span IS NOT NULL THEN span / 7.5::DOUBLE
  ELSE {BY_TYPE} END AS DOUBLE)"""

# Cleaned records of the typed form, all three rules, days by priority.
CLEANED = f"""{ABSENCES}, cleaned AS (
  SELECT *, {DAYS_TYPED} AS days FROM absences WHERE {RULE1_EXACT} AND {RULE2} AND {RULE3})"""
# Cleaned records of the text form.
RAW_CLEANED = f"""{RAW}, cleaned AS (
  SELECT *, {DAYS_RAW} AS days FROM raw WHERE d IS NOT NULL AND NOT rule1_drops AND {RULE2} AND {RULE3})"""


def staff(cleaned: str = CLEANED) -> str:
    """Totals per known (year, employee) and per employee, unrounded."""
    return f"""{cleaned},
  staff_years AS (SELECT sy, e, coalesce(sum(days), 0) AS t FROM cleaned
    WHERE sy IS NOT NULL AND e IS NOT NULL GROUP BY sy, e),
  staff AS (SELECT e, sum(t) AS t FROM staff_years GROUP BY e)"""


def bands(t: str, deductible: int, cc_days: int) -> dict[str, str]:
    r, top = f"round({t}, 6)", deductible + cc_days
    inside = f"{r} > {deductible} AND {r} <= {top}"
    return {
        "below": f"count(*) FILTER (WHERE {r} <= {deductible})",
        "inside": f"count(*) FILTER (WHERE {inside})",
        "high": f"count(*) FILTER (WHERE {r} > {top})",
        "cc": f"coalesce(sum(least({t} - {deductible}, {cc_days})) FILTER (WHERE {inside}), 0)",
        "cc_all": f"coalesce(sum({t}) FILTER (WHERE {inside}), 0)",
        "excess": f"coalesce(sum({t} - {top}) FILTER (WHERE {r} > {top}), 0)",
        "excess_all": f"coalesce(sum({t}) FILTER (WHERE {r} > {top}), 0)",
    }


def breakdown(deductible: int, cc_days: int, cleaned: str = CLEANED) -> str:
    """CTE `breakdown`: the year breakdown, unrounded."""
    b = bands("t", deductible, cc_days)
    return f"""{staff(cleaned)},
  banded AS (SELECT sy, count(*) AS n, {b['below']} AS below, {b['inside']} AS inside,
    {b['high']} AS high, {b['cc']} AS cc, {b['excess']} AS excess FROM staff_years GROUP BY sy),
  breakdown AS (SELECT sy AS school_year, n AS total_teachers, below AS below_deductible,
    inside AS in_cc_range, high AS high_claimant, cc AS total_cc_days, excess AS excess_days,
    cc * 150.0 AS replacement_cost_cc, cc * 150.0 * 0.15 AS carrier_margin,
    cc * 150.0 * 0.15 AS acquisition_cost, cc * 150.0 * 1.3 AS premium FROM banded)"""


BREAKDOWN_COLUMNS = """school_year, total_teachers, below_deductible, in_cc_range, high_claimant,
  round(total_cc_days::DOUBLE, 6) AS total_cc_days, round(excess_days::DOUBLE, 6) AS excess_days,
  round(replacement_cost_cc::DOUBLE, 6) AS replacement_cost_cc,
  round(carrier_margin::DOUBLE, 6) AS carrier_margin,
  round(acquisition_cost::DOUBLE, 6) AS acquisition_cost, round(premium::DOUBLE, 6) AS premium"""


def metrics(cleaned: str = CLEANED) -> str:
    """CTE `metrics`: the year metrics, unrounded."""
    return f"""{cleaned}, metrics AS (SELECT sy AS school_year, count(DISTINCT e) AS total_staff,
    coalesce(sum(days), 0) AS total_absences, coalesce(sum(days), 0) * 150.0 AS total_replacement_cost
    FROM cleaned WHERE sy IS NOT NULL GROUP BY sy)"""


METRIC_COLUMNS = """school_year, total_staff, round(total_absences::DOUBLE, 6) AS total_absences,
  round(total_replacement_cost::DOUBLE, 6) AS total_replacement_cost"""


def summary(deductible: int, cc_days: int, cleaned: str = CLEANED) -> str:
    """CTE `summary`: the all-years result in one row."""
    b = bands("t", deductible, cc_days)
    return f"""{staff(cleaned)},
  everyone AS (SELECT count(DISTINCT e) AS n, coalesce(sum(days), 0) AS days FROM cleaned),
  banded AS (SELECT count(*) AS n, {b['below']} AS below, {b['inside']} AS inside,
    {b['high']} AS high, {b['cc']} AS cc, {b['excess']} AS excess FROM staff),
  summary AS (SELECT
    (SELECT n FROM everyone) AS overall_total_staff,
    CAST(trunc(round((SELECT days FROM everyone), 6)) AS BIGINT) AS overall_total_absences,
    round((SELECT days FROM everyone), 6)::DOUBLE AS overall_total_absences_exact,
    round(((SELECT days FROM everyone) * 150.0)::DOUBLE, 6) AS overall_total_replacement_cost,
    n AS total_teachers, below AS below_deductible_count, inside AS num_staff_cc_range,
    round(cc::DOUBLE, 6) AS total_cc_days, round((cc * 150.0)::DOUBLE, 6) AS replacement_cost_cc,
    high AS num_high_claimant, round(excess::DOUBLE, 6) AS excess_days,
    round((excess * 150.0)::DOUBLE, 6) AS high_claimant_cost,
    round((cc * 150.0 * 0.15)::DOUBLE, 6) AS carrier_margin,
    round((cc * 150.0 * 0.15)::DOUBLE, 6) AS acquisition_cost,
    round((cc * 150.0 * 1.3)::DOUBLE, 6) AS total_premium,
    {deductible} AS deductible, {cc_days} AS cc_days, {deductible + cc_days} AS cc_maximum,
    150.0::DOUBLE AS replacement_cost, 180 AS school_year_days
  FROM banded)"""
