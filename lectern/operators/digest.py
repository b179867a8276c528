"""Picks of a day and the digest built from them."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from lectern.functions.dates import kst_date
from lectern.functions.text import (
    array_or_empty, article_url, author_list, relevance_label,
)


def picks_for_date(
    recommendations: DataFrame, papers: DataFrame, feedbacks: DataFrame, day: Column
) -> DataFrame:
    """Stored picks of one day with the paper and the reader's own feedback, best first."""
    picked = recommendations.where(F.col("rec_date") == day)
    described = papers.select(
        F.col("id").alias("paper_id"), "pmid", "title", "journal", "pub_date",
        "clinical_relevance",
    )
    own = feedbacks.select("user_id", "paper_id", F.col("action").alias("feedback_action"))
    best = Window.partitionBy("user_id").orderBy(F.desc("score"), "paper_id")
    return (
        picked.join(described, "paper_id")
        .join(own, ["user_id", "paper_id"], "left")
        .withColumn("position", F.row_number().over(best))
        .withColumn("relevance", relevance_label(F.col("clinical_relevance")))
    )


def feedback_progress(picks: DataFrame) -> DataFrame:
    """Per reader: picks, reviewed picks, and whether all are reviewed."""
    return picks.groupBy("user_id").agg(
        F.count("*").alias("picks"),
        F.count("feedback_action").alias("reviewed"),
        (F.count("feedback_action") == F.count("*")).alias("all_done"),
    )


def digest_users(profiles: DataFrame) -> DataFrame:
    """Readers who want the digest and have an address."""
    return profiles.where(
        F.col("email_digest") & (F.coalesce("digest_address", F.lit("")) != "")
    )


def digest_items(
    recommendations: DataFrame, papers: DataFrame, profiles: DataFrame, as_of, per_user: int = 5
) -> DataFrame:
    """Ranked items of every digest of the day (KST)."""
    best = Window.partitionBy("user_id").orderBy(F.desc("score"), "paper_id")
    wanted = digest_users(profiles).select(
        F.col("id").alias("user_id"), "name", "digest_address"
    )
    top = (
        recommendations.where(F.col("rec_date") == kst_date(as_of))
        .join(wanted, "user_id")
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= per_user)
    )
    described = papers.select(
        F.col("id").alias("paper_id"), "pmid", "title", "journal", "pub_date", "authors"
    )
    items = top.join(described, "paper_id")
    if "reasons" in recommendations.columns:
        labels = F.transform(
            F.slice(F.coalesce(F.col("reasons.reasons"), F.array()), 1, 3), lambda r: r["label"]
        )
        why = F.array_join(labels, " | ")
    else:
        why = F.lit("")
    greeting = F.when(F.coalesce("name", F.lit("")) != "", F.col("name")).otherwise("there")
    return items.select(
        "user_id",
        "digest_address",
        greeting.alias("greeting"),
        "rank",
        "paper_id",
        F.coalesce("title", F.lit("Untitled")).alias("title"),
        "journal",
        "pub_date",
        author_list(array_or_empty(F.col("authors")), 3).alias("authors"),
        article_url(F.col("pmid")).alias("url"),
        why.alias("why"),
        "score",
    )


def digest_payload(
    recommendations: DataFrame, papers: DataFrame, profiles: DataFrame, as_of,
    per_user: int = 5, subject: str = "Your daily picks",
) -> DataFrame:
    """One row per reader with at least one pick: subject, greeting, ranked items."""
    items = digest_items(recommendations, papers, profiles, as_of, per_user)
    entry = F.struct(
        "rank", "paper_id", "title", "journal", "pub_date", "authors", "url", "why", "score"
    )
    day = F.date_format(kst_date(as_of), "MMMM dd")
    return (
        items.groupBy("user_id", "digest_address", "greeting")
        .agg(F.array_sort(F.collect_list(entry)).alias("items"))
        .select(
            "user_id",
            "digest_address",
            F.concat(F.lit(f"{subject} - "), day).alias("subject"),
            "greeting",
            "items",
        )
    )


def digest_report(profiles: DataFrame, payload: DataFrame) -> DataFrame:
    """Digests asked for, ready to send, and skipped for want of an address or of picks."""
    wanted = profiles.where("email_digest").select(F.col("id").alias("user_id"), "digest_address")
    ready = payload.select("user_id", F.lit(True).alias("ready"))
    joined = wanted.join(ready, "user_id", "left")
    no_address = F.coalesce("digest_address", F.lit("")) == ""
    return joined.agg(
        F.count("*").alias("wanted"),
        F.count_if(F.coalesce("ready", F.lit(False))).alias("ready"),
        F.count_if(no_address).alias("no_address"),
        F.count_if(~no_address & F.col("ready").isNull()).alias("no_picks"),
    )
