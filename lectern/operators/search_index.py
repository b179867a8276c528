"""Weighted word index of titles (A) and abstracts (B), as a posting table."""

from pyspark.sql import Column, DataFrame, functions as F

from lectern.functions.text import lowered
from lectern.sources import vocab


def _words(text: Column) -> Column:
    return F.filter(F.split(lowered(text), r"[^a-z0-9]+"), lambda w: w != "")


def _last_indexed(words: Column) -> Column:
    """Position of the last word that is no stop word, 0 without one."""
    stop = F.array(*[F.lit(w) for w in vocab.ENGLISH_STOP_WORDS])
    places = F.transform(words, lambda w, i: F.when(~F.array_contains(stop, w), i + 1))
    return F.coalesce(F.array_max(places), F.lit(0))


def search_postings(papers: DataFrame) -> DataFrame:
    """(paper, term, weight) with all positions, in order.

    Positions count every word, stop words included; those of the abstract go on after the
    title's last indexed word. Words are not stemmed. Texts are dealt by paper before they are
    cut, so that the words of a paper are grouped where they are made and not shuffled.
    """
    texts = papers.select(F.col("id").alias("paper_id"), "title", "abstract").repartition("paper_id")
    split = texts.select(
        "paper_id",
        _words(F.col("title")).alias("title_words"),
        _words(F.col("abstract")).alias("abstract_words"),
    ).withColumn("shift", _last_indexed(F.col("title_words")))

    def placed(words, weight, shift):
        return F.transform(
            words,
            lambda w, i: F.struct(
                w.alias("term"), F.lit(weight).alias("weight"), (i + 1 + shift).alias("position")
            ),
        )

    tokens = split.select(
        "paper_id",
        F.explode(
            F.concat(
                placed(F.col("title_words"), "A", F.lit(0)),
                placed(F.col("abstract_words"), "B", F.col("shift")),
            )
        ).alias("token"),
    ).select("paper_id", "token.*")
    return (
        tokens.where(~F.col("term").isin(vocab.ENGLISH_STOP_WORDS))
        .groupBy("paper_id", "term", "weight")
        .agg(F.array_sort(F.collect_list("position")).alias("positions"))
    )
