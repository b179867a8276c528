"""Reader feedback and reads: current state of a change feed, collections, appends."""

from pyspark.sql import DataFrame, Window, functions as F

from lectern.sources import vocab


def latest_change(log: DataFrame) -> DataFrame:
    """Last change per (user, paper); a partial maximum is taken before the shuffle."""
    change = F.struct("ts", "event_id", "action")
    return (
        log.groupBy("user_id", "paper_id")
        .agg(F.max(change).alias("last"))
        .select("user_id", "paper_id", "last.action", "last.ts", "last.event_id")
    )


def current_feedback(log: DataFrame) -> DataFrame:
    """One row per (user, paper): the last action wins, `none` takes the row away."""
    return (
        latest_change(log)
        .where(F.col("action") != "none")
        .select("user_id", "paper_id", "action", F.col("ts").alias("created_at"))
    )


def collection_key(user, name):
    """Deterministic collection id."""
    return F.md5(F.concat_ws("/", user.cast("string"), name))


def liked_collections(log: DataFrame, collections: DataFrame) -> DataFrame:
    """Collections to create: one per user with a like who has none of that name yet."""
    name = F.lit(vocab.LIKED_COLLECTION_NAME)
    users = log.where(F.col("action") == "like").select("user_id").distinct()
    present = collections.where(F.col("name") == name).select("user_id")
    return users.join(present, "user_id", "left_anti").select(
        collection_key(F.col("user_id"), name).alias("id"),
        "user_id",
        name.alias("name"),
        F.lit(vocab.LIKED_COLLECTION_COLOR).alias("color"),
    )


def liked_collection_papers(
    log: DataFrame, collections: DataFrame, members: DataFrame
) -> DataFrame:
    """Memberships to append. Liking adds a paper; taking the like back removes nothing.

    `collections` already holds the rows of `liked_collections`. Where a user has several
    of that name the smallest id is used.
    """
    target = (
        collections.where(F.col("name") == vocab.LIKED_COLLECTION_NAME)
        .groupBy("user_id")
        .agg(F.min("id").alias("collection_id"))
    )
    liked = log.where(F.col("action") == "like").select("user_id", "paper_id").distinct()
    return (
        liked.join(target, "user_id")
        .select("collection_id", "paper_id")
        .join(members, ["collection_id", "paper_id"], "left_anti")
    )


def reads_to_append(dwells: DataFrame, floor: int = 10, cap: int = 300) -> DataFrame:
    """Visits long enough to record, cut to the cap."""
    return dwells.where(F.col("dwell_seconds") >= floor).withColumn(
        "dwell_seconds", F.least(F.col("dwell_seconds"), F.lit(cap))
    )


def dwelt(reads: DataFrame, seconds: int = 30) -> DataFrame:
    return reads.where(F.col("dwell_seconds") >= seconds)


def recent_reads(reads: DataFrame, per_user: int | None = None) -> DataFrame:
    """The newest `per_user` reads of every user; all reads without it."""
    if per_user is None:
        return reads
    newest = Window.partitionBy("user_id").orderBy(F.desc("clicked_at"), F.desc("id"))
    return (
        reads.withColumn("rank", F.row_number().over(newest))
        .where(F.col("rank") <= per_user)
        .drop("rank")
    )


def seen_papers(feedbacks: DataFrame, reads: DataFrame) -> DataFrame:
    """Distinct (user, paper) with any feedback or read."""
    return (
        feedbacks.select("user_id", "paper_id")
        .union(reads.select("user_id", "paper_id"))
        .distinct()
    )
