"""The daily jobs over stored tables: ingest, reclassify, recommend, digest.

Tables live under one root folder, named and typed as in `sources.tables.SCHEMAS`.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from lectern.functions.dates import kst_date, moment
from lectern.operators import classify, digest, ingest, maintain, recommend
from lectern.session import staged
from lectern.sources.articles import article_metadata, read_articles
from lectern.sources.tables import append_rows, patch_rows, read_table


def ingest_articles(spark: SparkSession, root: str, xml_path: str, as_of) -> DataFrame:
    """Append the new articles found in landed XML files, and return them."""
    found = ingest.found_by_search(read_articles(spark, xml_path), as_of)
    fresh = ingest.new_articles(found, read_table(spark, root, "papers", ["pmid"]))
    rows = staged(
        fresh.withColumn("id", F.col("pmid").cast("bigint")).withColumn(
            "fetched_at", moment(as_of).cast("timestamp")
        ),
        "new",
    )
    append_rows(rows, root, "papers")
    return rows


def last_of_each(metadata: DataFrame) -> DataFrame:
    """The last record of every pmid, in the order of the scan."""
    placed = metadata.withColumn("_place", F.monotonically_increasing_id())
    row = F.struct(*metadata.columns)
    return placed.groupBy("pmid").agg(F.max_by(row, "_place").alias("_row")).select("_row.*")


def reclassify(spark: SparkSession, root: str, xml_path: str) -> DataFrame:
    """Classify what is unclassified from fresh metadata; returns the count per type."""
    papers = read_table(spark, root, "papers")
    metadata = last_of_each(article_metadata(read_articles(spark, xml_path)))
    changes = staged(classify.reclassified(classify.unclassified(papers), metadata), "changes")
    patch_rows(changes, root, "papers", ["study_type", "topic_tags", "mesh_terms"])
    return classify.classification_summary(changes)


def recommend_day(spark: SparkSession, root: str, as_of) -> str:
    """Write the picks of the KST day of `as_of` in place of earlier ones; returns the day."""
    picks = recommend.daily_recommendations(
        read_table(spark, root, "profiles"),
        read_table(spark, root, "papers"),
        read_table(spark, root, "feedbacks"),
        read_table(spark, root, "read_history"),
        as_of,
    )
    day = str(spark.range(1).select(kst_date(as_of)).first()[0])
    stored = picks.withColumn("is_read", F.lit(False)).drop("rank")
    maintain.replace_day(stored, f"{root}/recommendations", day)
    return day


def write_digests(spark: SparkSession, root: str, as_of, path: str) -> None:
    """One JSON line per reader with picks today, ready to be sent."""
    payload = digest.digest_payload(
        read_table(spark, root, "recommendations"),
        read_table(spark, root, "papers"),
        read_table(spark, root, "profiles"),
        as_of,
    )
    payload.write.mode("overwrite").json(path)
