"""The corpus pipeline: quality, exact copies, near copies, secrets, packing.

Each stage takes (spark, docs, sf_dir), works on all documents that its predecessor kept and
returns documents again, the last one pieces with their places. `run` writes the result of
every stage but the last as Parquet to the shared folder and reads it back, so a lost executor
repeats part of one stage only.
"""

import public_tokenizers

from lectern.llm.common import documents, labels
from lectern.llm.exact_dedup import without_copies
from lectern.llm.packing import packed
from lectern.llm.quality_classifier import accepted, fit, fold
from lectern.llm.secrets import without_secrets
from lectern.llm.simhash import without_near_copies
from lectern.session import staged

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Trees, tokenizers and a walk over tries are not SQL.
ORACLE_SQL = None


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier takes; it learns from four of five folds."""
    known = labels(spark, sf_dir).filter(fold(F.col("doc_id"), 5) != 0)
    return accepted(docs, fit(docs, known))


def one_of_equal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of largest doc_id of each group of equal texts."""
    return without_copies(docs)


def one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of each group of near copies."""
    return without_near_copies(docs)


def masked_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark."""
    return without_secrets(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all pieces in sequences of 4096 tokens."""
    return packed(docs, public_tokenizers.path("word_bpe_49k.json"), 1)


STAGES = [
    ("quality classifier", good_documents),
    ("exact dedup", one_of_equal),
    ("simhash near-dedup", one_of_near),
    ("secret scan", masked_secrets),
    ("best-fit packing", sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
