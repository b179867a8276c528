"""Quality of documents: boosted trees over statistics of the text.

Statistics are made from whole texts in numpy, a few MB at a time. The trees are fitted on a
bounded sample of labelled rows (SAMPLE) on the driver; every document is scored in the scan
that makes its statistics, without a shuffle.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lectern.llm.boosting import Forest, train
from lectern.llm.common import free_name, pieces, raw, reachable, texts

#: Most labelled documents that trees are fitted on, chosen by a hash of their id.
SAMPLE = 20_000
#: Share of label 1 from which a document is taken.
TAKE = 0.3

#: Classes of bytes: those listed are one class each, others by range.
SINGLE = b" \n.,!?|#*$%&;:-_=/<>(){}[]\"'"
LOWER, UPPER, DIGIT, LEAD, TRAIL, OTHER = range(len(SINGLE), len(SINGLE) + 6)
CLASSES = OTHER + 1


def _classes() -> np.ndarray:
    of = np.full(256, OTHER, np.int64)
    of[ord("a") : ord("z") + 1] = LOWER
    of[ord("A") : ord("Z") + 1] = UPPER
    of[ord("0") : ord("9") + 1] = DIGIT
    of[0x80:0xC0] = TRAIL
    of[0xC0:] = LEAD
    of[np.frombuffer(SINGLE, np.uint8)] = np.arange(len(SINGLE))
    return of


CLASS_OF = _classes()
SPACE = np.isin(np.arange(256), np.frombuffer(b" \t\n\r\x0b\x0c", np.uint8))


def statistics(docs: list[bytes]) -> np.ndarray:
    """A row of numbers for each text; an empty text has zeros.

    Shares of byte classes, logarithms of the numbers of words and lines, mean word and line
    length, shares of words that begin with a capital, end with a mark, are long, or occur
    for the first time, share of distinct lines.
    """
    sizes = np.array([len(d) for d in docs], np.int64)
    data = np.frombuffer(b"".join(docs), np.uint8)
    of = np.repeat(np.arange(len(docs)), sizes)
    shares = np.bincount(of * CLASSES + CLASS_OF[data], minlength=len(docs) * CLASSES)
    shares = shares.reshape(len(docs), CLASSES) / np.maximum(sizes, 1)[:, None]
    blank = SPACE[data]
    begins = np.zeros(len(data), bool)
    begins[np.cumsum(sizes)[sizes > 0] - sizes[sizes > 0]] = True
    before = np.roll(blank, 1) if len(data) else blank
    head = ~blank & (before | begins)
    after = np.append(blank[1:] | begins[1:], True) if len(data) else blank
    tail = ~blank & after
    kind = CLASS_OF[data]

    def count(mask):
        return np.bincount(of[mask], minlength=len(docs))

    words = count(head)
    each = np.maximum(words, 1)
    spans = np.flatnonzero(tail) - np.flatnonzero(head) + 1
    long_words = np.bincount(of[head][spans > 20], minlength=len(docs))
    marks = tail & (kind < len(SINGLE)) & (data != ord(",")) & (data != ord("."))
    more = []
    for text in docs:
        lines = [x for x in text.split(b"\n") if x.strip()]
        parts = text.split()
        trios = set(zip(parts, parts[1:], parts[2:]))
        more.append(
            (
                len(set(parts)) / max(1, len(parts)),
                len(trios) / max(1, len(parts) - 2),
                len(set(lines)) / max(1, len(lines)),
                len(lines),
            )
        )
    own = np.array(more, float).reshape(len(docs), 4)
    return np.column_stack(
        [
            shares,
            np.log1p(words),
            np.log1p(own[:, 3]),
            count(~blank) / each,
            words / np.maximum(own[:, 3], 1),
            count(head & (kind == UPPER)) / each,
            count(marks) / each,
            long_words / each,
            own[:, :3],
        ]
    )


def fold(doc_id: Column, folds: int) -> Column:
    """The fold of a document: crc32 of its id as text, modulo `folds`."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def training_rows(docs: DataFrame, labels: DataFrame, label: str, limit: int) -> DataFrame:
    """(doc_id, text, label) of at most `limit` labelled documents, by a hash of the id.

    Rows without id or label are left out. The sample is bounded, so it is broadcast.
    """
    known = labels.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")
    ).filter("doc_id IS NOT NULL AND label IS NOT NULL")
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(limit)
    return texts(docs).join(F.broadcast(known), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", limit: int = SAMPLE) -> Forest:
    """Trees for `label` from all given labelled rows, or the first `limit` by hash.

    Labels of documents that are not there do not count. Without labels all scores are 0.5.
    """

    def work(batches):
        for batch in pieces(batches):
            rows = statistics(raw(batch.column("text")))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r.tobytes() for r in rows], pa.binary()), batch.column("label")],
                names=["row", "label"],
            )

    sample = training_rows(docs, labels, label, limit).select("text", "label")
    found = sample.mapInArrow(work, "row binary, label int").toArrow()
    if not found.num_rows:
        return train(np.zeros((0, 1)), np.zeros(0))
    rows = np.frombuffer(b"".join(found["row"].to_pylist())).reshape(found.num_rows, -1)
    target = found["label"].to_numpy().astype(float)
    order = np.lexsort(np.column_stack([target, rows]).T)
    return train(rows[order], target[order])


def scored(docs: DataFrame, model: Forest) -> DataFrame:
    """(doc_id, score) of every document; null texts count as empty."""

    def work(batches):
        for batch in pieces(batches):
            score = model.probability(statistics(raw(batch.column("text"))))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(score)], names=["doc_id", "score"]
            )

    return texts(docs).mapInArrow(work, "doc_id long, score double")


def accepted(docs: DataFrame, model: Forest, take: float = TAKE) -> DataFrame:
    """The rows of `docs`, all columns, with a score of at least `take`."""
    reachable(docs.sparkSession)
    names, whole = docs.columns, free_name(docs, "whole_text")

    def work(batches):
        for batch in pieces(batches, whole):
            score = model.probability(statistics(raw(batch.column(whole))))
            yield batch.filter(pa.array(score >= take)).select(names)

    rows = docs.withColumn(whole, F.coalesce(F.col("text").cast("string"), F.lit("")))
    return rows.mapInArrow(work, docs.schema)


def quality(docs: DataFrame, labels: DataFrame, learn, take: float = TAKE) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    `learn` makes a condition of the column doc_id; labels of other rows are not read. Each
    of repeated rows has its row; a document without id is not held out.
    """
    model = fit(docs, labels.filter(learn(F.col("doc_id"))))
    return scored(docs, model).select(
        "doc_id",
        F.coalesce(~learn(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= take).cast("int").alias("predicted"),
    )
