"""Shape of the physical plans: what is pushed down, and what must not be there."""

import pytest

from lectern.operators import admin, digest, feedback, pool
from lectern.plans.catalog import QUERIES
from lectern.plans.given import AS_OF, Given
from lectern.sources.tables import SCHEMAS
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def plan(df, mode="formatted"):
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode)
    )


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_pair_products_and_no_python(spark, name):
    if name.endswith("_stream"):
        pytest.skip("runs a stream")
    text = plan(QUERIES[name](spark, SF))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas"):
        assert bad not in text, bad


@pytest.fixture
def stored(spark, tmp_path):
    def table(name):
        path = f"{tmp_path}/{name}"
        spark.createDataFrame([], SCHEMAS[name]).write.mode("overwrite").parquet(path)
        return spark.read.schema(SCHEMAS[name]).parquet(path)

    return table


def test_the_pool_is_not_cut(spark, stored):
    text = plan(pool.recent_pool(stored("papers"), AS_OF).select("id", "pub_date"))
    assert "Limit" not in text and "TakeOrdered" not in text
    assert "ReadSchema: struct<id:bigint,pub_date:date,fetched_at:timestamp>" in text
    assert "GreaterThanOrEqual(fetched_at" in text


def test_picks_prune_days(spark, tmp_path):
    schema = "user_id string, paper_id long, score double, rec_date date"
    rows = [("u", 1, 1.0, "2024-01-01"), ("u", 2, 1.0, "2024-01-02")]
    data = spark.createDataFrame(rows, "user_id string, paper_id long, score double, d string")
    data.withColumn("rec_date", F.col("d").cast("date")).drop("d").write.partitionBy("rec_date").parquet(f"{tmp_path}/r")
    recs = spark.read.schema(schema).parquet(f"{tmp_path}/r")
    g = Given(spark, SF)
    text = plan(digest.picks_for_date(recs, g.papers, g.feedbacks, F.lit("2024-01-02").cast("date")))
    assert "PartitionFilters: [isnotnull(rec_date" in text


def test_top_papers_reads_narrow_and_counts_before_the_join(spark, stored):
    text = plan(admin.top_papers(stored("feedbacks"), stored("papers")))
    assert "TakeOrderedAndProject" in text
    assert "EqualTo(action,like)" in text
    assert "abstract" not in text
    assert text.count("partial_count(1)") >= 1


def test_recent_reads_limits_before_the_shuffle(spark, stored):
    text = plan(feedback.recent_reads(stored("read_history"), 200), "simple")
    assert text.count("WindowGroupLimit") == 2


def test_last_change_aggregates_before_the_shuffle(spark):
    assert "partial_max(struct(" in plan(Given(spark, SF).feedbacks)


def test_daily_activity_reads_its_days_only(spark, stored):
    text = plan(admin.daily_activity(stored("papers"), stored("feedbacks"), stored("read_history"), AS_OF))
    assert "GreaterThanOrEqual(clicked_at" in text and "LessThan(created_at" in text
