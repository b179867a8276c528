"""What the training-data operators share: input columns, batches, winners of a group."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lectern.session import reachable

#: Bytes of text that are worked on at once in a task; a longer document is a batch of its own.
CHUNK_BYTES = 2 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """(doc_id long, text string): null texts are empty, other columns do not matter."""
    reachable(docs.sparkSession)
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows with about CHUNK_BYTES of `column` each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes, dtype=np.int64) // CHUNK_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for start, end in zip(cuts, cuts[1:]):
            yield batch.slice(start, end - start)


def raw(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column without nulls."""
    return column.cast(pa.binary()).to_pylist()


def text_key() -> F.Column:
    """Tells rows with one doc_id and different texts apart."""
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def only(docs: DataFrame, winners: DataFrame) -> DataFrame:
    """The rows of `docs` named by `winners` (doc_id, text_key), each name once.

    Rows with one doc_id and one text count as one document; of these the one whose other columns
    come first as JSON stays. Each row is carried in one column, so no name can clash. One shuffle
    of `docs` by the name; the window that drops repeats reuses it.
    """
    names = winners.select(F.col("doc_id").alias("w_id"), F.col("text_key").alias("w_key"))
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    rest = F.to_json(F.struct(*others)) if others else F.lit("")
    mine = docs.select(
        F.struct(*docs.columns).alias("row"),
        F.col("doc_id").cast("long").alias("id"),
        text_key().alias("key"),
        rest.alias("rest"),
    )
    found = mine.join(
        names.distinct(),
        F.col("id").eqNullSafe(F.col("w_id")) & F.col("key").eqNullSafe(F.col("w_key")),
        "left_semi",
    )
    place = F.row_number().over(Window.partitionBy("id", "key").orderBy("rest"))
    return found.withColumn("place", place).filter("place = 1").select("row.*")


def free_name(docs: DataFrame, name: str) -> str:
    """`name`, with underscores after it until no column of `docs` is called so."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name
