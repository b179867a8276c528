"""Files of token ids in document order, coded as Simple-8b words.

A file row holds a run of whole documents: their ids and sizes, the words of all their tokens
and the first word of each block. Rows are written by Spark's Parquet writer into the shared
folder, so a lost task is simply written again. Reading needs nothing but a row.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from lectern.llm import simple8b
from lectern.llm.common import pieces, raw, texts
from lectern.llm.token_ids import Spaced, encoder
from lectern.session import staged

SCHEMA = (
    "shard int, start long, n_ids long, doc_ids array<long>, n_tokens array<long>,"
    " heads array<int>, words binary"
)


def token_rows(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """Rows of the format for all documents, in ascending doc_id (null first), not yet written.

    A shard is a range of doc_id; `start` counts the ids of the shard before a row. Null texts
    count as empty, an empty text is its end id alone. Documents with one doc_id are ordered
    by a hash of the text.
    """

    def work(batches):
        coder = encoder(path, end_id, Spaced)
        shard, start = TaskContext.get().partitionId(), 0
        for batch in pieces(batches):
            ids, sizes = coder.encode(raw(batch.column("text")))
            words, heads = simple8b.pack(ids)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([shard], pa.int32()),
                    pa.array([start], pa.int64()),
                    pa.array([len(ids)], pa.int64()),
                    pa.array([batch.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                    pa.array([sizes], pa.list_(pa.int64())),
                    pa.array([heads], pa.list_(pa.int32())),
                    pa.array([words.astype("<u8").tobytes()], pa.binary()),
                ],
                names=["shard", "start", "n_ids", "doc_ids", "n_tokens", "heads", "words"],
            )
            start += len(ids)

    rows = texts(docs).withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    return ordered.select("doc_id", "text").mapInArrow(work, SCHEMA)


def write_tokens(docs: DataFrame, folder: str, path: str, end_id: int) -> None:
    token_rows(docs, path, end_id).write.parquet(folder)


def read_tokens(files: DataFrame, with_ids: bool = False) -> DataFrame:
    """One row per document from rows of the format: doc_id, start, n_tokens, ids_crc32[, ids].

    `start` counts the ids of all documents before it; ids of shards before are a running sum
    over one row per shard.
    """

    def work(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(name)[k] for name in batch.schema.names}
                sizes = row["n_tokens"].values.to_numpy()
                words = np.frombuffer(row["words"].as_buffer(), "<u8")
                heads = row["heads"].values.to_numpy()
                ids = simple8b.unpack(words, heads, row["n_ids"].as_py()).astype("<u4")
                ends = np.cumsum(sizes)
                own = [ids[a:b] for a, b in zip(ends - sizes, ends)]
                columns = {
                    "shard": pa.array(np.full(len(sizes), row["shard"].as_py(), np.int32)),
                    "doc_id": row["doc_ids"].values,
                    "inside": pa.array(row["start"].as_py() + ends - sizes),
                    "n_tokens": pa.array(sizes),
                    "ids_crc32": pa.array([zlib.crc32(x.tobytes()) for x in own], pa.int64()),
                }
                if with_ids:
                    columns["ids"] = pa.array([x.astype(np.int64) for x in own], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_pydict(columns)

    schema = "shard int, doc_id long, inside long, n_tokens long, ids_crc32 long"
    found = files.mapInArrow(work, schema + ", ids array<long>" * with_ids)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    totals = files.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    base = totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return found.join(base, "shard").select(
        "doc_id",
        (F.col("base") + F.col("inside")).alias("start"),
        "n_tokens",
        "ids_crc32",
        *(["ids"] if with_ids else []),
    )


def round_trip(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """Write all documents as token files to the shared folder and read them back."""
    return read_tokens(staged(token_rows(docs, path, end_id), "tokens"))
