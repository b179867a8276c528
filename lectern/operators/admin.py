"""Usage analytics over all users."""

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from lectern.functions.dates import day_start, days_before, utc_date
from lectern.sources.calendars import day_calendar


def _one_row(*frames: DataFrame) -> DataFrame:
    """One-row frames with different columns put into one row."""
    names = [name for frame in frames for name in frame.columns]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return rows.agg(*[F.max(name).alias(name) for name in names])


def _half_up(col):
    return F.floor(col + F.lit(0.5)).cast("bigint")


def like_rate(likes, total):
    """Likes per hundred feedbacks, 0 without feedback."""
    return F.when(total > 0, _half_up(likes / total * 100)).otherwise(F.lit(0)).cast("bigint")


def overall_stats(profiles, papers, feedbacks, reads, as_of) -> DataFrame:
    since = days_before(as_of, 7)
    dwelt = F.when(F.col("dwell_seconds") > 0, F.col("dwell_seconds"))
    stats = _one_row(
        profiles.agg(F.count("*").alias("total_users")),
        papers.agg(
            F.count("*").alias("total_papers"),
            F.count_if(F.col("fetched_at") > since).alias("papers_7d"),
        ),
        feedbacks.agg(
            F.count("*").alias("total_feedbacks"),
            F.count_if(F.col("action") == "like").alias("total_likes"),
            F.count_if(F.col("action") == "dislike").alias("total_dislikes"),
        ),
        reads.agg(
            F.count("*").alias("total_reads"),
            F.coalesce(_half_up(F.sum(dwelt) / F.count(dwelt)), F.lit(0)).alias(
                "avg_dwell_seconds"
            ),
        ),
        reads.where(F.col("clicked_at") > since).agg(
            F.count_distinct("user_id").alias("active_users_7d")
        ),
    )
    return stats.withColumn(
        "like_rate", like_rate(F.col("total_likes"), F.col("total_feedbacks"))
    )


def daily_activity(papers, feedbacks, reads, as_of, days: int = 30) -> DataFrame:
    """One row per day of the span, days without events included."""
    first = day_start(F.date_sub(utc_date(as_of), days))
    end = day_start(F.date_add(utc_date(as_of), 1))

    def per_day(table, time, *measures):
        in_span = table.where((F.col(time) >= first) & (F.col(time) < end))
        return in_span.groupBy(F.to_date(time).alias("day")).agg(*measures)

    # every side below has at most days + 1 rows
    calendar = F.broadcast(day_calendar(papers.sparkSession, as_of, days))
    readers = per_day(reads, "clicked_at", F.count_distinct("user_id").alias("active_users"))
    votes = per_day(
        feedbacks,
        "created_at",
        F.count_if(F.col("action") == "like").alias("likes"),
        F.count_if(F.col("action") == "dislike").alias("dislikes"),
    )
    fresh = per_day(papers, "fetched_at", F.count("*").alias("new_papers"))
    joined = calendar
    for side in (readers, votes, fresh):
        joined = joined.join(F.broadcast(side), "day", "left")
    return joined.na.fill(0).select(
        "day", "active_users", "likes", "dislikes", "new_papers"
    )


def activity_bars(daily: DataFrame) -> DataFrame:
    """Bar heights in percent of the busiest day; `daily` has one row per calendar day."""
    total = F.col("likes") + F.col("dislikes")
    busiest = F.greatest(F.max(total).over(Window.partitionBy()), F.lit(1))
    height = F.greatest(F.lit(2.0), total / busiest * 100)
    return daily.withColumn("bar_height", height).withColumn(
        "like_part",
        F.when(total > 0, F.col("likes") / total * F.col("bar_height")).otherwise(0.0),
    )


def top_papers(feedbacks, papers, limit: int = 20) -> DataFrame:
    """Most liked papers. Counted before the join, so a popular paper is one row in it."""
    counted = (
        feedbacks.where(F.col("action") == "like")
        .groupBy(F.col("paper_id").alias("id"))
        .agg(F.count("*").alias("like_count"))
    )
    described = papers.select(
        "id", "title", "journal", "pub_date", "study_type", "clinical_relevance"
    )
    return (
        counted.join(described, "id").orderBy(F.desc("like_count"), "id").limit(limit)
    )


def popular_keywords(profiles, limit: int = 30) -> DataFrame:
    return (
        profiles.select(F.explode("keywords").alias("keyword"))
        .groupBy("keyword")
        .agg(F.count("*").alias("user_count"))
        .orderBy(F.desc("user_count"), "keyword")
        .limit(limit)
    )


def journal_distribution(papers, as_of, limit: int = 30) -> DataFrame:
    return (
        papers.where(F.col("journal").isNotNull())
        .groupBy("journal")
        .agg(
            F.count("*").alias("paper_count"),
            F.count_if(F.col("fetched_at") > days_before(as_of, 7)).alias("recent_count"),
        )
        .orderBy(F.desc("paper_count"), "journal")
        .limit(limit)
    )


def user_engagement(profiles, feedbacks, reads) -> DataFrame:
    """Every profile with its counts, most recently active first."""
    votes = feedbacks.groupBy(F.col("user_id").alias("id")).agg(
        F.count_if(F.col("action") == "like").alias("likes"),
        F.count_if(F.col("action") == "dislike").alias("dislikes"),
    )
    visits = reads.groupBy(F.col("user_id").alias("id")).agg(
        F.count("*").alias("reads"), F.max("clicked_at").alias("last_active")
    )
    return (
        profiles.select("id", "name", "institution")
        .join(votes, "id", "left")
        .join(visits, "id", "left")
        .na.fill(0, ["likes", "dislikes", "reads"])
        .orderBy(F.desc_nulls_last("last_active"), "id")
    )


def json_rows(result: DataFrame) -> DataFrame:
    """One JSON object per row, for results of any size."""
    return result.select(F.to_json(F.struct("*")).alias("json"))


def json_array(result: DataFrame, order: list, limit: int) -> DataFrame:
    """The first `limit` rows in order as one JSON array, NULL without rows.

    Only for results that are short by definition (a top list, a calendar).
    """
    first = result.orderBy(*order).limit(limit)
    position = F.row_number().over(Window.orderBy(*order)).alias("position")
    row = F.struct(*result.columns).alias("row")
    listed = first.select(position, row).agg(
        F.array_sort(F.collect_list(F.struct("position", "row"))).alias("rows")
    )
    return listed.select(
        F.when(
            F.size("rows") > 0, F.to_json(F.transform("rows", lambda r: r["row"]))
        ).alias("json")
    )
