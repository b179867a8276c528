"""Exact duplicates by a tree merge of sorted digest runs.

Every input partition gives one run of (digest, kept row, count). In each round, nodes join
the runs of FAN neighbours, which is as many binomial rounds of pairwise exchange at once; a
node's run is spread over tasks by digest and keeps the best identifier and the sum of counts.
The result goes down the same tree, so rows of a digest that a third of all documents share
meet it in as many places as there are runs, and no task gets them all.

Built from DataFrame functions alone.
"""

from pyspark.sql import DataFrame, functions as F

from lectern.llm.common import only
from lectern.session import staged

#: Runs joined by a node: 2 ** BITS, that is BITS binomial rounds in one exchange.
BITS = 4
KEY = ["digest", "n_bytes"]


def _best(smallest: bool):
    """Order of rows in a group: by doc_id, then by place in the input."""
    one = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    other = F.struct("doc_id", (-F.col("row")).alias("row"))
    return F.min(one) if smallest else F.max(other)


def digests(docs: DataFrame) -> DataFrame:
    """(run, row, doc_id, digest, n_bytes, text_key): written once, without texts.

    `digest` is the SHA-256 of the text in UTF-8, null as empty; `n_bytes` and `text_key`
    (another hash) verify that equal digests stand for equal texts.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.spark_partition_id().alias("run"),
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
        F.octet_length(text).alias("n_bytes"),
        F.xxhash64(text).alias("text_key"),
    )
    return staged(rows, "digests")


def merged(rows: DataFrame, smallest: bool = False) -> DataFrame:
    """The rows of `digests` with the kept row of their group.

    Adds keep_id, group_size, kept. Of equal texts the largest doc_id stays (the smallest
    with `smallest`), null ids last, of equal ids the first row. An empty table gives none.
    """
    last = rows.agg(F.max("run")).first()[0] or 0
    levels = [
        rows.groupBy("run", *KEY, "text_key").agg(
            _best(smallest).alias("best"), F.count("*").alias("size")
        )
    ]
    while last > 0:
        last >>= BITS
        best = F.min("best") if smallest else F.max("best")
        levels.append(
            levels[-1]
            .withColumn("run", F.shiftright("run", BITS))
            .groupBy("run", *KEY, "text_key")
            .agg(best.alias("best"), F.sum("size").alias("size"))
        )
    down = levels.pop()
    while levels:
        parent = down.withColumnRenamed("run", "parent")
        child = levels.pop().drop("best", "size")
        child = child.withColumn("parent", F.shiftright("run", BITS))
        down = child.join(parent, ["parent", *KEY, "text_key"]).drop("parent")
    row = F.col("best.row") if smallest else -F.col("best.row")
    return rows.join(down, ["run", *KEY, "text_key"]).select(
        "row",
        "doc_id",
        "digest",
        "text_key",
        F.col("best.doc_id").alias("keep_id"),
        F.col("size").alias("group_size"),
        (F.col("row") == row).alias("kept"),
    )


def exact_groups(docs: DataFrame, smallest: bool = False) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty, so all empty documents are one group; repeated rows are
    members of their group and only one of them is kept.
    """
    found = merged(digests(docs), smallest)
    return found.select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


def without_copies(docs: DataFrame, smallest: bool = False) -> DataFrame:
    """`docs` with one row of every group of equal texts, all its columns."""
    return only(docs, merged(digests(docs), smallest).filter("kept"))
