"""Dwell time from activity pulses."""

from pyspark.sql import Column, DataFrame, Window, functions as F

IDLE_SECONDS = 30
CAP_SECONDS = 300
FLOOR_SECONDS = 10


def _micros(earlier: Column, later: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", earlier, later)


def _as_seconds(micros: Column) -> Column:
    return micros / F.lit(1e6)


def dwell_totals(pulses: DataFrame, idle: int = IDLE_SECONDS, slice_seconds: int = 3600) -> DataFrame:
    """Sum over the pulses of (user, paper) of min(gap to the next pulse, idle).

    The last pulse counts the whole idle time. Gaps are taken inside slices of time first,
    and then between the last pulse of a slice and the first of the next one, so the
    pulses of a very active pair are spread over many tasks.
    """
    longest = F.lit(idle * 1_000_000).cast("bigint")
    since_epoch = F.timestamp_diff(
        "SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz")
    )
    pair = ["user_id", "paper_id"]
    sliced = pulses.select(*pair, "ts", F.floor(since_epoch / slice_seconds).alias("slice"))
    inside = Window.partitionBy(*pair, "slice").orderBy("ts")
    following = F.lead("ts").over(inside)
    # the last pulse of a slice has no next one here: its gap is added below
    gap = F.when(following.isNotNull(), F.least(_micros(F.col("ts"), following), longest))
    per_slice = (
        sliced.withColumn("gap", gap)
        .groupBy(*pair, "slice")
        .agg(
            F.min("ts").alias("first"),
            F.max("ts").alias("last"),
            F.coalesce(F.sum("gap"), F.lit(0)).alias("inner"),
        )
    )
    between = Window.partitionBy(*pair).orderBy("slice")
    to_next = F.least(_micros(F.col("last"), F.lead("first").over(between)), longest)
    return (
        per_slice.withColumn("outer", to_next)
        .groupBy(*pair)
        .agg(
            _as_seconds(F.sum(F.col("inner") + F.col("outer"))).alias("seconds"),
            F.max("last").alias("last_pulse"),
        )
    )


def recorded(totals: DataFrame, floor: int = FLOOR_SECONDS, cap: int = CAP_SECONDS) -> DataFrame:
    """Dwell rows that are kept: at least the floor, cut to the cap, whole seconds."""
    seconds = F.least(F.floor(F.col("seconds") + F.lit(0.5)), F.lit(cap)).cast("int")
    return (
        totals.withColumn("dwell_seconds", seconds)
        .where(F.col("dwell_seconds") >= floor)
        .drop("seconds")
    )


def dwell_from_pulses(
    pulses: DataFrame,
    idle: int = IDLE_SECONDS,
    floor: int = FLOOR_SECONDS,
    cap: int = CAP_SECONDS,
) -> DataFrame:
    return recorded(dwell_totals(pulses, idle), floor, cap)


def dwell_sessions(pulses: DataFrame, idle: int = IDLE_SECONDS) -> DataFrame:
    """Views that end after `idle` seconds without a pulse; works on a table and a stream.

    `ts` is a timestamp with time zone, as watermarks need. A session ends `idle` seconds
    after its last pulse, so the idle time is counted. Pulses without a user make sessions of
    no pulses.
    """
    return (
        pulses.groupBy(
            "user_id", "paper_id", F.session_window("ts", f"{idle} seconds").alias("view")
        )
        .agg(F.count("user_id").alias("pulses"))
        .select(
            "user_id",
            "paper_id",
            F.col("view.start").alias("started"),
            F.col("view.end").alias("ended"),
            "pulses",
            _as_seconds(_micros(F.col("view.start"), F.col("view.end"))).alias("seconds"),
        )
    )
