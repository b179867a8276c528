"""The operators over the given tables, and the SQL that checks them."""

import public_tokenizers
from pyspark.sql import functions as F

from lectern.llm import clustering, hard_negatives
from lectern.llm.byte_bpe import encoded
from lectern.llm.common import documents, labels
from lectern.llm.exact_dedup import exact_groups
from lectern.llm.packing import packed
from lectern.llm.passages import repeated_passages
from lectern.llm.personal_data import personal_data
from lectern.llm.quality_classifier import fold, quality
from lectern.llm.quality_rules import check_sql, verdicts
from lectern.llm.secrets import secrets
from lectern.llm.simhash import near_duplicates
from lectern.llm.token_files import round_trip
from lectern.llm.toxicity import toxicity
from lectern.llm.vectors import embeddings

QUERIES = {
    "op1_secret_scan": lambda spark, sf_dir: secrets(documents(spark, sf_dir)),
    "op2_quality_rules": lambda spark, sf_dir: verdicts(documents(spark, sf_dir)),
    "op3_packing": lambda spark, sf_dir: packed(
        documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), 1
    ),
    "op4_toxicity": lambda spark, sf_dir: toxicity(
        documents(spark, sf_dir), labels(spark, sf_dir), lambda doc_id: fold(doc_id, 4) != 2
    ),
    "op5_quality_classifier": lambda spark, sf_dir: quality(
        documents(spark, sf_dir), labels(spark, sf_dir), lambda doc_id: fold(doc_id, 5) != 0
    ),
    "op6_passages": lambda spark, sf_dir: repeated_passages(documents(spark, sf_dir)),
    "op7_exact_dedup": lambda spark, sf_dir: exact_groups(documents(spark, sf_dir)),
    "op8_simhash": lambda spark, sf_dir: near_duplicates(documents(spark, sf_dir)),
    "op10_byte_bpe": lambda spark, sf_dir: encoded(
        documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken")
    ),
    "op9_simple8b": lambda spark, sf_dir: round_trip(
        documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), 2
    ),
    "op11_clustering": lambda spark, sf_dir: clustering.clusters(embeddings(spark, sf_dir)),
    "op12_personal_data": lambda spark, sf_dir: personal_data(documents(spark, sf_dir)),
    "op13_hard_negatives": lambda spark, sf_dir: hard_negatives.hard_negatives(
        embeddings(spark, sf_dir), F.col("vec_id") % 100 == 0, hard_negatives.relabelled()
    ),
}

CHECKS = {
    "op2_quality_rules": check_sql(),
    "op7_exact_dedup": """
        WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, h AS text_sha256
        FROM d WINDOW g AS (PARTITION BY h)
    """,
    "op11_clustering": clustering.check_sql(),
    "op13_hard_negatives": hard_negatives.check_sql(),
}
