"""Normalised time values: their ranges, order and containment, as column functions.

With compat=True ranges keep three conventions of the corpus tools: a value without a month starts in
February, one without a day ends on the 28th, and winter ends before it begins. compat=False gives the
calendar's ranges.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Months (from 1) and days that seasons, halves and quarters run over, and hours of parts of a day.
SEASONS = {"SP": (3, 20, 6, 20), "SU": (6, 21, 9, 21), "FA": (9, 22, 12, 20), "WI": (12, 21, 3, 19)}
PARTS = {"H1": (1, 6), "H2": (7, 12), "Q1": (1, 3), "Q2": (4, 6), "Q3": (7, 9), "Q4": (10, 12)}
HOURS = {"MO": (4, 7), "MI": (8, 11), "AF": (12, 15), "EV": (16, 19), "NI": (20, 23), "DT": (0, 3)}

# All forms of a value that has a range: year; month and day, week, season, or half or quarter; clock or part of a day.
FORM = (
    r"^(\d{1,4})X{0,3}(?:-(?:(\d\d|XX)(?:-(\d\d|XX))?|W(\d\d|XX)(?:-(?:WE|\d|X))?|(SP|SU|FA|WI)|([HQ][1-4X])))?"
    r"(?:T(?:(\d\d)(?::(\d\d)(?::(\d\d))?)?|(MO|MI|AF|EV|NI|DT))?.*)?$"
)
WEEKS_A_MONTH = 4.33


@dataclass(frozen=True)
class Span:
    """Two timestamps: the first and the last second of a value; both null if it has no range."""

    low: Column
    high: Column


def _int(text: Column) -> Column:
    """A group of digits as a number; null where it is empty or stands for any number. No failing cast is tried: that costs an exception."""
    return F.when(~text.isin("", "XX"), text.cast("int"))


def _from(table: dict, key: Column, k: int) -> Column:
    out = F.lit(None).cast("int")
    for name, values in table.items():
        out = F.when(key == name, F.lit(values[k])).otherwise(out)
    return out


def _moment(year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column) -> Column:
    """A lenient calendar: days and hours beyond their range roll over."""
    first = F.make_date(year, month, F.lit(1))
    return F.timestamp_seconds(F.unix_seconds(F.date_add(first, day - 1).cast("timestamp")) + hour * 3600 + minute * 60 + second)


def span_of(value: Column, compat: bool = True) -> Column:
    """Struct low and high, or null, of a value: parsed once, by one pattern, into an array that a lambda holds."""
    found = F.split(F.regexp_replace(value, FORM, "\u0001".join(f"${k}" for k in range(1, 11))), "\u0001", -1)
    return F.element_at(F.transform(F.array(found), lambda g: _span(value, g, compat)), 1)


def _span(value: Column, groups: Column, compat: bool) -> Column:
    def group(k: int) -> Column:
        return F.coalesce(F.get(groups, F.lit(k - 1)), F.lit(""))

    year_low, year_high = _int(F.rpad(group(1), 4, "0")), _int(F.rpad(group(1), 4, "9"))
    month, day, week, season, part = _int(group(2)), _int(group(3)), _int(group(4)), group(5), group(6)
    by_week = F.when(week.isNotNull(), F.ceil(F.least(F.lit(12.0), week / WEEKS_A_MONTH)).cast("int"))
    month_low = F.coalesce(month, by_week, _from(SEASONS, season, 0), _from(PARTS, part, 0))
    month_high = F.coalesce(month, by_week, _from(SEASONS, season, 2), _from(PARTS, part, 1))
    day_low, day_high = F.coalesce(day, _from(SEASONS, season, 1)), F.coalesce(day, _from(SEASONS, season, 3))
    clock, named = {k: _int(group(7 + k)) for k in range(3)}, group(10)
    low_month = F.coalesce(month_low, F.lit(2 if compat else 1))
    high_month = F.coalesce(month_high, F.lit(12))
    high_year = year_high if compat else year_high + F.when(season == "WI", 1).otherwise(0)
    last_day = F.lit(28) if compat else F.dayofmonth(F.last_day(F.make_date(high_year, high_month, F.lit(1))))
    low = _moment(year_low, low_month, F.coalesce(day_low, F.lit(1)), F.coalesce(clock[0], _from(HOURS, named, 0), F.lit(0)), F.coalesce(clock[1], F.lit(0)), F.coalesce(clock[2], F.lit(0)))
    high = _moment(high_year, high_month, F.coalesce(day_high, last_day), F.coalesce(clock[0], _from(HOURS, named, 1), F.lit(23)), F.coalesce(clock[1], F.lit(59)), F.coalesce(clock[2], F.lit(59)))
    # A clock needs a day or a week before it.
    ok = (F.size(groups) == 10) & F.coalesce(month, F.lit(1)).between(1, 12) & (~value.contains("T") | (group(3) != "") | (group(4) != ""))
    return F.when(ok, F.struct(low.alias("low"), high.alias("high")))


def span(value: Column, compat: bool = True) -> Span:
    """The range of a value; null for durations, sets, references and values of no known form."""
    both = span_of(value, compat)
    return Span(both["low"], both["high"])


def ranged(rows, type_: str = "type", value: str = "value", compat: bool = True):
    """rows with low and high; durations and sets have none, whatever their value."""
    return spanned(rows.withColumn("_value", F.when(~F.coalesce(F.col(type_).isin("DURATION", "SET"), F.lit(False)), F.col(value))), "_value", compat).drop("_value")


def is_reference(value: Column) -> Column:
    return value.isin("PAST_REF", "PRESENT_REF", "FUTURE_REF")


def ordered(low1: Column, high1: Column, low2: Column, high2: Column) -> Column:
    """The relation of two ranges; null where one is missing or they share one end only."""
    return (
        F.when((low1 == low2) & (high1 == high2), "SIMULTANEOUS")
        .when(high1 <= low2, "BEFORE")
        .when(low1 >= high2, "AFTER")
        .when((low1 < low2) & (high1 > high2), "INCLUDES")
        .when((low1 > low2) & (high1 < high2), "IS_INCLUDED")
        .when(((low1 < low2) & (high1 < high2)) | ((low1 > low2) & (high1 > high2)), "VAGUE")
    )


def spanned(rows, value: str = "value", compat: bool = True):
    """rows with low and high, the range of column value: worked out once for each value, before values meet in pairs."""
    return rows.withColumn("_span", span_of(F.col(value), compat)).withColumns({"low": F.col("_span.low"), "high": F.col("_span.high")}).drop("_span")


def _related(type1: Column, value1: Column, a: Span, type2: Column, value2: Column, b: Span) -> Column:
    place = lambda v: F.when(v == "PAST_REF", -1).when(v == "FUTURE_REF", 1).otherwise(0)
    by_place = F.when(place(value1) < place(value2), "BEFORE").when(place(value1) > place(value2), "AFTER")
    either_present = (value1 == "PRESENT_REF") | (value2 == "PRESENT_REF")
    related = F.when(either_present, F.lit(None)).when(is_reference(value1) | is_reference(value2), by_place).otherwise(ordered(a.low, a.high, b.low, b.high))
    return F.when(type1.isin("DATE", "TIME") & type2.isin("DATE", "TIME"), related)


def related_columns() -> Column:
    """As ordered_values(), on the columns type, value, low and high of both sides of a pair."""
    c = F.col
    return _related(c("type1"), c("value1"), Span(c("low1"), c("high1")), c("type2"), c("value2"), Span(c("low2"), c("high2")))


def ordered_values(type1: Column, value1: Column, type2: Column, value2: Column, compat: bool = True) -> Column:
    """The relation of two dates or times; past and future references are placed around the present, PRESENT_REF nowhere."""
    return _related(type1, value1, span(value1, compat), type2, value2, span(value2, compat))


def _field(value: Column, k: int) -> Column:
    return F.substring(value, (1, 6, 9)[k], (4, 2, 2)[k]).try_cast("int")


def earlier(value1: Column, value2: Column) -> Column:
    """Whether a dated value lies before another, year by year, then month, then day, as far as both go."""
    dated = F.regexp_like(value1, F.lit(r"^\d")) & F.regexp_like(value2, F.lit(r"^\d"))
    out = F.lit(False)
    for k in (2, 1, 0):
        a, b = _field(value1, k), _field(value2, k)
        both = a.isNotNull() & b.isNotNull()
        out = F.when(both & (a < b), True).when(both & (a > b), False).when(both, out).otherwise(F.lit(False))
    return dated & out


def includes(value1: Column, value2: Column) -> Column:
    """Whether a year holds a month or day of it, or a month a day of it."""
    coarse = F.regexp_like(value1, F.lit(r"^\d{4}(-\d\d)?$"))
    finer = F.regexp_like(value2, F.lit(r"^\d{4}-\d\d(-\d\d)?"))
    return coarse & finer & (F.length(value1) < F.length(value2)) & F.startswith(value2, F.concat(value1, F.lit("-")))


def known_relation(value1: Column, value2: Column) -> Column:
    return F.when(earlier(value1, value2), "BEFORE").when(earlier(value2, value1), "AFTER").when(includes(value1, value2), "INCLUDES").when(includes(value2, value1), "IS_INCLUDED").otherwise("SIMULTANEOUS")


def day_of(value: Column) -> Column:
    """The day that a value starts with, or null."""
    day = F.regexp_extract(value, r"^(\d{4}-\d\d-\d\d)", 1)
    return F.when(day != "", day)


def to_day(value: Column) -> Column:
    """A time of day cut off; references stay."""
    return F.when(~is_reference(value) & F.regexp_like(value, F.lit(r"^\d{4}-\d\d-\d\d.+")), F.substring(value, 1, 10)).otherwise(value)


def is_quarter(value: Column) -> Column:
    return F.regexp_like(value, F.lit(r"^\d{4}-Q\d$"))


def quarter_of(month: Column, back: int = 0) -> Column:
    """The fiscal quarter of a month: 1 from October on; July counts with the third. back: quarters before it."""
    own = F.when(month >= 10, 1).when(month <= 3, 2).when(month <= 7, 3).otherwise(4)
    return F.pmod(own - 1 - back, F.lit(4)) + 1


def fiscal_fix(text: Column, value: Column, dct: Column) -> Column:
    """Values of phrases about years and quarters, as seen from the document's day."""
    year, month = F.substring(dct, 1, 4), F.substring(dct, 6, 2).try_cast("int")
    quarter = F.concat(F.lit("-Q"), quarter_of(month, 2).cast("string"))
    lowered = F.lower(text)
    return (
        F.when(lowered.isin("a year ago", "a year earlier"), F.concat((year.try_cast("int") - 1).cast("string"), quarter))
        .when((lowered == "last year") | lowered.contains("years ago"), F.substring(value, 1, 4))
        .when((lowered == "the latest quarter") | ((lowered == "the quarter") & F.regexp_like(value, F.lit(r"^P\d+M$"))), F.concat(year, quarter))
        .otherwise(value)
    )


def is_day_of_week(text: Column) -> Column:
    return F.lower(text).isin("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
