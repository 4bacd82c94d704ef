"""Column names, word lists and lookup tables the engine agrees on.

Everything here is a fixed value: results depend on these exact spellings (and,
for the alias tables, on their order), so they are listed plainly in one place.
"""

from __future__ import annotations

# --- fixed values: standard column names ------------------------------------
SCHOOL_YEAR = "School Year"
EMPLOYEE_ID = "Employee Identifier"
FIRST_NAME = "Employee First Name"
LAST_NAME = "Employee Last Name"
ABSENCE_DAYS = "Absence_Days"
DATE = "Date"
SCHOOL_NAME = "School Name"
REASON = "Reason"
EMPLOYEE_TITLE = "Employee Title"
EMPLOYEE_TYPE = "Employee Type"
ABSENCE_TYPE = "Absence Type"
START_TIME = "Start Time"
END_TIME = "End Time"
FILLED = "Filled"
NEEDS_SUBSTITUTE = "Needs Substitute"
DURATION = "Duration"
USAGE_DAYS = "Absence Reason Usage (Days)"
USAGE_HOURS = "Absence Reason Usage (Hours)"
DAYS_OF_ABSENCE = "Days of Absence"
IS_FILLED = "Is Filled"
SUBSTITUTE_REQUIRED = "Substitute Is Required"

STANDARD_COLUMNS = (
    SCHOOL_YEAR,
    EMPLOYEE_ID,
    FIRST_NAME,
    LAST_NAME,
    ABSENCE_DAYS,
    DATE,
    SCHOOL_NAME,
    REASON,
    EMPLOYEE_TITLE,
    EMPLOYEE_TYPE,
    ABSENCE_TYPE,
    START_TIME,
    END_TIME,
    FILLED,
    NEEDS_SUBSTITUTE,
)
# A user may also map a column to Duration; a suggestion may not.
MAPPABLE_COLUMNS = STANDARD_COLUMNS + (DURATION,)
VALIDATION_COLUMNS = (DATE, SCHOOL_YEAR, EMPLOYEE_ID, ABSENCE_TYPE)
CALCULATION_COLUMNS = (SCHOOL_YEAR, EMPLOYEE_ID, ABSENCE_DAYS)
KEEP_AS_IS = "Keep as-is"
# Where a row stands in its files; carried along, never part of the record.
ROW_ORDER = "_row_order"

# --- fixed values: aliases tried, in this order, when nothing is mapped -------
SUGGESTION_ALIASES = {
    "school year": SCHOOL_YEAR,
    "schoolyear": SCHOOL_YEAR,
    "sy": SCHOOL_YEAR,
    "employee identifier": EMPLOYEE_ID,
    "employee id": EMPLOYEE_ID,
    "emp id": EMPLOYEE_ID,
    "employee_id": EMPLOYEE_ID,
    "employee first name": FIRST_NAME,
    "first name": FIRST_NAME,
    "employee first": FIRST_NAME,
    "first": FIRST_NAME,
    "employee last name": LAST_NAME,
    "last name": LAST_NAME,
    "employee last": LAST_NAME,
    "last": LAST_NAME,
    "absence_days": ABSENCE_DAYS,
    "absence days": ABSENCE_DAYS,
    "percent of day": ABSENCE_DAYS,
    "date": DATE,
    "school name": SCHOOL_NAME,
    "reason": REASON,
    "employee title": EMPLOYEE_TITLE,
    "employee type": EMPLOYEE_TYPE,
    "absence type": ABSENCE_TYPE,
    "start time": START_TIME,
    "end time": END_TIME,
    "filled": FILLED,
    "is filled": FILLED,
    "needs substitute": NEEDS_SUBSTITUTE,
    "substitute is required": NEEDS_SUBSTITUTE,
}

# --- fixed values: aliases recognised just before the rating ------------------
CALCULATION_ALIASES = {
    "school year": SCHOOL_YEAR,
    "schoolyear": SCHOOL_YEAR,
    "sy": SCHOOL_YEAR,
    "fiscal year": SCHOOL_YEAR,
    "date": DATE,
    "absence date": DATE,
    "absent date": DATE,
    "day": DATE,
    "date of absence": DATE,
    "employee identifier": EMPLOYEE_ID,
    "employee id": EMPLOYEE_ID,
    "emp id": EMPLOYEE_ID,
    "employee_id": EMPLOYEE_ID,
    "employee first name": FIRST_NAME,
    "employee first": FIRST_NAME,
    "first name": FIRST_NAME,
    "first_name": FIRST_NAME,
    "firstname": FIRST_NAME,
    "given name": FIRST_NAME,
    "given": FIRST_NAME,
    "employee last name": LAST_NAME,
    "employee last": LAST_NAME,
    "last name": LAST_NAME,
    "last_name": LAST_NAME,
    "lastname": LAST_NAME,
    "surname": LAST_NAME,
    "family name": LAST_NAME,
    "absence_days": ABSENCE_DAYS,
    "absence days": ABSENCE_DAYS,
    "total_days": ABSENCE_DAYS,
    "days": ABSENCE_DAYS,
    "percent of day": ABSENCE_DAYS,
    "absence": ABSENCE_DAYS,
}

# --- fixed values: headings that hold a person's names -----------------------
FIRST_NAME_HEADINGS = ("employee first name", "first name", "employee first", "first")
LAST_NAME_HEADINGS = ("employee last name", "last name", "employee last", "last")
FIRST_NAME_OVERRIDES = ("first", "given name", "given")
LAST_NAME_OVERRIDES = ("last", "surname", "family name")

# --- fixed values: cell text read as missing in a CSV file -------------------
MISSING_TOKENS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)

# --- fixed values: words of the cleaning rules -------------------------------
UNFILLED_WORDS = ("unfilled", "no", "n", "false", "0", "0.0")
NOT_NEEDED_WORDS = ("no", "n", "false", "0", "0.0")
BLANK_WORDS = ("", "nan", "none", "nat")
TEACHER_TYPES = ("Teacher", "Teacher Music", "Teacher SpecEd")

# --- fixed values: day counts ------------------------------------------------
HOURS_PER_DAY = 7.5
DAYS_BY_ABSENCE_TYPE = {"Full Day": 1.0, "AM Half Day": 0.5, "PM Half Day": 0.5}
CUSTOM_DURATION = "Custom Duration"
DAY_COUNT_COLUMNS = (ABSENCE_DAYS, USAGE_DAYS, DAYS_OF_ABSENCE)

# --- fixed values: report limits and labels ----------------------------------
PREVIEW_ROWS = 5000
TOP_CATEGORIES = 50
TOP_SCHOOL_YEARS = 20
VALUE_VIEW_CATEGORIES = 12
MISMATCH_SAMPLE_ROWS = 20
MISMATCH_MESSAGES = 10
METRICS_AVERAGE_LABEL = "5-Yr Avg"
BREAKDOWN_AVERAGE_LABEL = "5 yr Avg"
