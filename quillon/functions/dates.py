"""Dates inside texts: duration phrases, partial dates, month arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions.vocabulary import MONTHS

_MONTH = "|".join(MONTHS)


def duration_class(t: Column) -> Column:
    """week, six_months, 28_days or other, by the first phrase that fits."""
    low = F.lower(t)
    return (
        F.when(low.rlike("past (week|seven days)"), "week").when(low.rlike("past six months"), "six_months").when(low.rlike("past 28 days|past month"), "28_days").otherwise("other")
    )


def from_to(t: Column) -> tuple[Column, Column]:
    """The two sides of a closing ``from … to …``."""
    p = r"(?i)from\s+(.+?)\s+to\s+(.+?)\.?\s*$"
    return F.regexp_extract(t, p, 1), F.regexp_extract(t, p, 2)


def partial_date(s: Column, other: Column) -> Column:
    """(month, day, year) of ``Month day[, year]`` or ``Month year``; a missing year is taken from the other side."""
    text = F.regexp_replace(F.trim(s), "[.,]+$", "")
    number = lambda g, p: F.nullif(F.regexp_extract(text, p, g), F.lit("")).cast("int")
    day_form = rf"^(?:{_MONTH})\s+(\d{{1,2}})(?:,\s*(\d{{4}}))?$"
    year_form = rf"^(?:{_MONTH})\s+(\d{{4}})$"
    month = F.nullif(F.array_position(F.array(*map(F.lit, MONTHS)), F.regexp_extract(text, rf"^({_MONTH})\b", 1)), F.lit(0)).cast("int")
    is_day = text.rlike(day_form)
    year = F.when(is_day, F.coalesce(number(2, day_form), F.nullif(F.regexp_extract(other, r"(\d{4})", 1), F.lit("")).cast("int"))).otherwise(number(1, year_form))
    fits = is_day | text.rlike(year_form)
    return F.when(fits, F.struct(month.alias("month"), F.when(is_day, number(1, day_form)).alias("day"), year.alias("year")))


def month_shift(month: Column, year: Column, delta: Column | int) -> tuple[Column, Column]:
    """Month and year ``delta`` months later, with floor division."""
    index = month - 1 + delta
    return (F.pmod(index, F.lit(12)) + 1).cast("int"), (year + F.floor(index / 12)).cast("int")


def month_name(m: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, MONTHS)), m.cast("int"))


def period_slot(month: Column, day: Column, year: Column, six_months: bool) -> Column:
    """The sentence for the period that ends at a date: six months, or a week. February always has 28 days and a
    missing day of a week is the 28th."""
    if six_months:
        m, y = month_shift(month, year, -6)
        start, end = F.concat_ws(" ", month_name(m), F.concat(day.cast("string"), F.lit(","))), F.concat_ws(" ", month_name(month), F.concat(day.cast("string"), F.lit(",")))
        return F.concat(F.lit("The past six months from "), start, F.lit(" "), y.cast("string"), F.lit(" to "), end, F.lit(" "), year.cast("string"), F.lit("."))
    d = F.coalesce(day, F.lit(28))
    pm, _ = month_shift(month, year, -1)
    length = F.element_at(F.array(*map(F.lit, [31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])), pm)
    first = F.when(d > 7, F.concat(month_name(month), F.lit(" "), (d - 7).cast("string"))).otherwise(F.concat(month_name(pm), F.lit(" "), (length + d - 7).cast("string")))
    return F.concat(F.lit("The past week from "), first, F.lit(" to "), month_name(month), F.lit(" "), d.cast("string"), F.lit(", "), year.cast("string"), F.lit("."))
