"""Dates with a precision, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names as they are read.
MONTHS = {
    "jan": "01", "january": "01", "feb": "02", "february": "02", "mar": "03", "march": "03", "apr": "04", "april": "04",
    "may": "05", "jun": "06", "june": "06", "jul": "07", "july": "07", "aug": "08", "august": "08", "sep": "09",
    "sept": "09", "september": "09", "oct": "10", "october": "10", "nov": "11", "november": "11", "dec": "12", "december": "12",
}
# End of fixed values.

TIMESTAMP = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"


def is_date(text: Column) -> Column:
    """YYYY-MM-DD that the calendar has."""
    return F.coalesce(F.rlike(text, F.lit(r"^\d{4}-\d{2}-\d{2}\z")) & text.try_cast("date").isNotNull(), F.lit(False))


def is_timestamp(text: Column) -> Column:
    return F.coalesce(F.rlike(text, F.lit(TIMESTAMP)) & is_date(F.left(text, F.lit(10))) & F.try_to_timestamp(text).isNotNull(), F.lit(False))


def month_number(name: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in MONTHS.items() for x in pair))
    return F.try_element_at(known, F.lower(name))


def _dated(date: Column, precision: str) -> Column:
    return F.struct(date.alias("date"), F.lit(precision).alias("precision"))


def source_date(text: Column) -> Column:
    """(date, precision) that a source's text shows, or null: the forms are tried in a fixed order."""
    t = F.regexp_replace(text, r"^\s+|\s+$", "")
    got = lambda pattern, g: F.regexp_extract(t, pattern, g)
    iso = got(r"^(\d{4}-\d{2}-\d{2})(?:$|[T\s])", 1)
    month = r"^(\d{4})-(0[1-9]|1[0-2])$"
    year = r"^(\d{4})$"
    numeric = r"\b(\d{1,2})/(\d{1,2})/(\d{4})\b"
    slashed = F.concat(got(numeric, 3), F.lit("-"), F.lpad(got(numeric, 2), 2, "0"), F.lit("-"), F.lpad(got(numeric, 1), 2, "0"))
    worded = r"\b(\d{1,2})\s+([A-Za-z]+)\s+(\d{4})\b"
    named = month_number(got(worded, 2))
    spoken = F.concat(got(worded, 3), F.lit("-"), named, F.lit("-"), F.lpad(got(worded, 1), 2, "0"))
    pair = r"^([A-Za-z]+)\s+(\d{4})$"
    return (
        F.when(is_date(iso), _dated(iso, "day"))
        .when(got(month, 1) != "", _dated(F.concat(got(month, 1), F.lit("-"), got(month, 2), F.lit("-01")), "month"))
        .when(got(year, 1) != "", _dated(F.concat(got(year, 1), F.lit("-01-01")), "year"))
        .when(is_date(slashed), _dated(slashed, "day"))
        .when(named.isNotNull() & is_date(spoken), _dated(spoken, "day"))
        .when(named.isNotNull(), F.lit(None))
        .when(month_number(got(pair, 1)).isNotNull(), _dated(F.concat(got(pair, 2), F.lit("-"), month_number(got(pair, 1)), F.lit("-01")), "month"))
    )


def shown(date: Column, precision: Column) -> Column:
    """A date as it is displayed at its precision."""
    day = F.try_to_date(date, "yyyy-MM-dd")
    return F.when(precision == "year", F.date_format(day, "yyyy")).when(precision == "month", F.date_format(day, "MMMM yyyy")).otherwise(F.date_format(day, "d MMMM yyyy"))


def primary(dates: Column, effective: Column) -> Column:
    """The first primary date of an array, else the first, else the effective date to the day."""
    marked = F.filter(dates, lambda d: F.coalesce(d["primary"], F.lit(False)))
    synthetic = F.struct(F.lit("effective").alias("type"), effective.alias("date"), F.lit("day").alias("precision"), F.lit(True).alias("primary"))
    return F.coalesce(F.try_element_at(marked, F.lit(1)), F.try_element_at(dates, F.lit(1)), synthetic)


def after(a: Column, b: Column) -> Column:
    """Null-safe order of two times."""
    return F.coalesce(a > b, F.lit(False))
