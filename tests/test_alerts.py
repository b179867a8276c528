from pyspark.sql import functions as F

from lectern.operators import alerts
from lectern.plans.catalog import QUERIES


def test_alert_words_of_four_letters(spark, tmp_path):
    """Alerts look for the first word of four letters or more, not only for long ones."""
    texts = ["In kidney stones.", "A kidneys and extraordinary case.", "None of it.", "Ear."]
    spark.createDataFrame(
        [(k, t, "src0", "en") for k, t in enumerate(texts)],
        "doc_id long, text string, source string, lang string",
    ).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(
        [(3 * k, "c", "m", 1.0) for k in range(4)],
        "c_custkey long, c_name string, c_mktsegment string, c_acctbal double",
    ).write.parquet(str(tmp_path / "customer.parquet"))
    found = QUERIES["alert_match"](spark, str(tmp_path)).collect()
    # customer 3k reads document 21k % 4: its first word of four letters is the alert's
    assert {r["alert_id"]: r["value"] for r in found} == {0: "kidney", 3: "kidneys", 6: "none"}
    assert {(r["alert_id"], r["paper_id"]) for r in found} == {(0, 0), (0, 1), (3, 1), (6, 2)}


def test_alerts_of_one_value_are_no_single_task(spark):
    watch = spark.range(3000).select(
        "id", F.lit("u").alias("user_id"), F.lit("journal").alias("alert_type"),
        F.lit("Urology").alias("value"), F.lit(True).alias("is_active"),
    )
    papers = spark.range(20).select(
        "id", F.lit("t").alias("title"), F.lit("a").alias("abstract"),
        F.array().cast("array<string>").alias("authors"), F.lit("European Urology").alias("journal"),
    )
    before = {
        name: spark.conf.get(name)
        for name in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")
    }
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = alerts.alert_matches(watch, papers).withColumn("task", F.spark_partition_id())
        per_task = found.groupBy("task").count().collect()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert sum(r["count"] for r in per_task) == 60_000
    assert max(r["count"] for r in per_task) < 45_000
