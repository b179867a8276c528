"""Dwell sessions of a pulse stream.

A session is emitted once the watermark has passed its end, and the watermark only moves with
pulses. When the source is known to be complete, a closing mark (a row with a time and nothing
else) moves it past all sessions that are still open.
"""

from pyspark.sql import DataFrame, functions as F

from lectern.operators.dwell import IDLE_SECONDS, dwell_sessions
from lectern.session import path_exists

LATENESS = "1 minute"


def stream_dwell_sessions(
    pulses: DataFrame, idle: int = IDLE_SECONDS, lateness: str = LATENESS
) -> DataFrame:
    """A session is emitted once the watermark has passed its end; pulses behind the
    watermark are dropped.

    Sessions without a user, which closing marks make, are left out by their count: a filter on
    the user would be pushed below the watermark, which then would not see the marks.
    """
    timed = pulses.withColumn("ts", F.col("ts").cast("timestamp"))
    sessions = dwell_sessions(timed.withWatermark("ts", lateness), idle)
    return sessions.where(F.col("pulses") > 0)


def with_marks(pulses: DataFrame, folder: str) -> DataFrame:
    """The pulse stream together with the closing marks of `folder`, which is made if missing."""
    spark = pulses.sparkSession
    if not path_exists(spark, folder):
        spark.createDataFrame([], "ts timestamp").write.parquet(folder)
    marks = spark.readStream.schema("ts timestamp").parquet(folder)
    empty = [
        (F.col("ts") if c == "ts" else F.lit(None)).cast(kind).alias(c) for c, kind in pulses.dtypes
    ]
    return pulses.unionByName(marks.select(*empty))


def close_sessions(source: DataFrame, folder: str, idle: int = IDLE_SECONDS) -> None:
    """Add the mark that closes all sessions of a complete source (its pulses as a table).

    The next run of the stream emits them. Pulses that land later are behind the watermark.
    """
    end = F.max(F.col("ts").cast("timestamp")) + F.make_dt_interval(days=F.lit(1), secs=F.lit(2 * idle))
    source.agg(end.alias("ts")).where(F.col("ts").isNotNull()).write.mode("append").parquet(folder)


def write_sessions(sessions: DataFrame, path: str, checkpoint: str):
    """Run the stream over what has arrived and append the closed sessions to a table."""
    return (
        sessions.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
