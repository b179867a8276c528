"""Day calendars derived from the as-of time."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lectern.functions.dates import utc_date


def last_days(as_of, days: int) -> Column:
    """Array of `days` + 1 dates ending on the as-of day, oldest first."""
    today = utc_date(as_of)
    return F.sequence(F.date_sub(today, days), today)


def day_calendar(spark: SparkSession, as_of, days: int = 30) -> DataFrame:
    return spark.range(1).select(F.explode(last_days(as_of, days)).alias("day"))


def heat_days(as_of, weeks: int) -> Column:
    """The last 7 x weeks days, oldest first; week and slot are position div and mod 7."""
    return last_days(as_of, 7 * weeks - 1)


def heat_calendar(spark: SparkSession, as_of, weeks: int) -> DataFrame:
    cells = spark.range(1).select(F.posexplode(heat_days(as_of, weeks)).alias("pos", "day"))
    return cells.select(
        F.floor(F.col("pos") / 7).cast("int").alias("week"),
        (F.col("pos") % 7).alias("slot"),
        "day",
    )


def week_days(as_of, weeks: int) -> Column:
    """One date per week, oldest first: the same weekday as the as-of day."""
    today = utc_date(as_of)
    return F.transform(
        F.sequence(F.lit(0), F.lit(weeks - 1)),
        lambda i: F.date_sub(today, (F.lit(weeks - 1) - i) * F.lit(7)),
    )
