"""Trading days of the New York exchanges by their holiday rules, and dates of research by policy."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Days on which the exchanges stayed closed for other reasons, since 1990.
CLOSED = (
    date(1994, 4, 27), date(2001, 9, 11), date(2001, 9, 12), date(2001, 9, 13), date(2001, 9, 14), date(2004, 6, 11), date(2007, 1, 2),
    date(2012, 10, 29), date(2012, 10, 30), date(2018, 12, 5), date(2025, 1, 9),
)
#: First years of holidays that came later.
KING, JUNETEENTH = 1998, 2022


def good_friday(year: Column) -> Column:
    """Two days before Easter Sunday, by the Gregorian computus."""
    div = lambda a, b: F.floor(a / b)
    golden, century = year % 19, div(year, F.lit(100))
    full = (19 * golden + century - div(century, F.lit(4)) - div(century - div(century + 8, F.lit(25)) + 1, F.lit(3)) + 15) % 30
    sunday = (32 + 2 * (century % 4) + 2 * div(year % 100, F.lit(4)) - full - year % 100 % 4) % 7
    late = div(golden + 11 * full + 22 * sunday, F.lit(451))
    march = full + sunday - 7 * late + 22  # as a day of March
    return F.date_add(F.make_date(year, F.lit(3), F.lit(1)), (march - 3).cast("int"))


def is_session(day: Column) -> Column:
    """Whether the exchanges trade on a day (rules of 1990 and later)."""
    year, month, of_month, week = F.year(day), F.month(day), F.dayofmonth(day), F.weekday(day)  # Monday is 0
    monday, friday = week == 0, week == 4
    # A fixed holiday on a Sunday is kept on Monday, one on a Saturday on Friday, but for New Year.
    kept = lambda m, d: (month == m) & ((of_month == d) | (monday & (of_month == d + 1)) | (friday & (of_month == d - 1)))
    new_year = (month == 1) & ((of_month == 1) | (monday & (of_month == 2)))
    nth = lambda m, at, low: (month == m) & (week == at) & of_month.between(low, low + 6)
    holiday = (
        new_year | (nth(1, 0, 15) & (year >= KING)) | nth(2, 0, 15) | nth(5, 0, 25) | (kept(6, 19) & (year >= JUNETEENTH)) | kept(7, 4) | nth(9, 0, 1) | nth(11, 3, 22) | kept(12, 25)
        | (day == good_friday(year)) | day.isin(*CLOSED)
    )
    return (week < 5) & ~holiday


def research_dates(spark: SparkSession, start: date, end: date, policy: str = "sessions") -> DataFrame:
    """(date) from `start` to `end`: trading `sessions`, or all `calendar-days`."""
    if end < start:
        raise ValueError("the end lies before the start")
    if policy not in ("sessions", "calendar-days"):
        raise ValueError(f"no policy {policy!r}: sessions or calendar-days")
    days = spark.range((end - start).days + 1).select(F.date_add(F.lit(start), F.col("id").cast("int")).alias("date"))
    return days.where(is_session(F.col("date"))) if policy == "sessions" else days
