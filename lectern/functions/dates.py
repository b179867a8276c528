"""Dates and times. Session time zone is UTC; KST (UTC+9, no summer time) is explicit."""

from functools import reduce

from pyspark.sql import Column, functions as F

from lectern.sources import vocab


def moment(as_of) -> Column:
    """An as-of time given as text, datetime or column."""
    return as_of if isinstance(as_of, Column) else F.lit(str(as_of)).cast("timestamp_ntz")


def days_before(as_of, days: int) -> Column:
    return moment(as_of) - F.expr(f"INTERVAL {int(days)} DAYS")


def kst_date(ts) -> Column:
    return F.to_date(moment(ts).cast("timestamp_ntz") + F.expr("INTERVAL 9 HOURS"))


def utc_date(ts) -> Column:
    return F.to_date(moment(ts))


def day_start(day: Column) -> Column:
    return day.cast("timestamp_ntz")


def age_in_days(as_of, day: Column) -> Column:
    """Whole days from `day` to the as-of time."""
    return F.datediff(utc_date(as_of), day)


def fractional_age_in_days(as_of, day: Column) -> Column:
    seconds = F.timestamp_diff("SECOND", day_start(day), moment(as_of))
    return seconds.cast("double") / F.lit(86400.0)


def publication_date(year: Column, month: Column, day: Column) -> Column:
    """Date from the parts printed in an article.

    A month is a number or a three-letter name, a missing month or day is 1. Parts that
    are no numbers fall back to January 1st of the year; a date that does not exist, or
    one without a year, is NULL.
    """
    given_month = F.trim(F.coalesce(month, F.lit("01")))
    given_day = F.trim(F.coalesce(day, F.lit("01")))
    named = reduce(
        lambda chain, item: chain.when(F.lower(given_month) == item[0], F.lit(item[1])),
        list(vocab.MONTHS.items())[1:],
        F.when(F.lower(given_month) == "jan", F.lit(1)),
    )
    month_number = F.coalesce(named, given_month.try_cast("int"))
    day_number = given_day.try_cast("int")
    readable = month_number.isNotNull() & day_number.isNotNull()
    padded = F.concat_ws(
        "-",
        F.trim(year),
        F.lpad(month_number.cast("string"), 2, "0"),
        F.lpad(day_number.cast("string"), 2, "0"),
    )
    text = F.when(readable, padded).otherwise(F.concat(F.trim(year), F.lit("-01-01")))
    return F.when(F.trim(year) != "", text.try_cast("date"))
