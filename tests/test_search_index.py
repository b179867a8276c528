from pyspark.sql import functions as F

from lectern.operators.search_index import search_postings

PAPERS = [
    (1, "Stones of the kidney", "Kidney stones, kidney."),
    (2, None, "The of"),
    (3, "A b", None),
    (4, "one", "two one"), (4, "one", "two"),
    (None, "x", "y"), (None, None, "x y"),
]


def postings(spark, rows):
    papers = spark.createDataFrame(rows, "id long, title string, abstract string")
    return search_postings(papers)


def test_positions_of_single_and_repeated_ids(spark):
    found = {
        (r["paper_id"], r["term"], r["weight"]): r["positions"]
        for r in postings(spark, PAPERS).collect()
    }
    assert found == {
        (1, "stones", "A"): [1], (1, "kidney", "A"): [4],
        (1, "kidney", "B"): [5, 7], (1, "stones", "B"): [6],
        (3, "b", "A"): [2],
        (4, "one", "A"): [1, 1], (4, "two", "B"): [2, 2], (4, "one", "B"): [3],
        (None, "x", "A"): [1], (None, "y", "B"): [2, 2], (None, "x", "B"): [1],
    }


def test_texts_are_shuffled_and_not_their_words(spark):
    papers = spark.range(400).select(
        "id", F.lit("a title").alias("title"), F.lit("kidney stone " * 100).alias("abstract")
    )
    plan = search_postings(papers)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.index("Generate explode") < plan.index("Exchange hashpartitioning")
