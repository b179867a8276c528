"""Hard-negative mining with slots of scores.

A positive of score s admits negatives up to a share of s. The upper limits of an anchor's
positives cut the scores below them into disjoint slots; tasks keep the best few negatives of
each slot, Spark merges them, and the negatives of a positive are the head of its own slot
followed by the lower ones. So one pass over the vectors answers all overlapping windows.

Anchors are taken in blocks of bounded size; every block meets all vectors where they lie, so
vectors are never shuffled, and what leaves a task is a few rows for each anchor and slot.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from lectern.llm.common import reachable
from lectern.llm.vectors import doubles, finite, matrix, products, whole
from lectern.session import dropped, staged

#: Anchors that are handed to the tasks at once: 8 MB with 64 components.
BLOCK = 16_384
#: Anchors and vectors of one matrix product.
SIDE_A, SIDE_V = 512, 4096
LEAST = np.iinfo(np.int64).min
FOUND = "number long, slot int, score long, id long"


class Lanes:
    """The best `k` (score, id) of each lane: higher scores first, then smaller ids."""

    def __init__(self, lanes: int, k: int):
        self.score = np.full((lanes, k), LEAST)
        self.id = np.zeros((lanes, k), np.int64)
        self.held = np.zeros(lanes, np.int64)
        self.k = k

    def floor(self) -> np.ndarray:
        """What a score must reach in each lane to be of use."""
        return self.score[:, -1]

    def offer(self, lane: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(lane):
            return
        touched = np.unique(lane)
        old = np.arange(self.k)[None, :] < self.held[touched][:, None]
        lane = np.concatenate([np.repeat(touched, self.held[touched]), lane])
        score = np.concatenate([self.score[touched][old], score])
        ids = np.concatenate([self.id[touched][old], ids])
        order = np.lexsort((ids, -score, lane))
        lane, score, ids = lane[order], score[order], ids[order]
        first = np.flatnonzero(np.r_[True, lane[1:] != lane[:-1]])
        place = np.arange(len(lane)) - np.repeat(first, np.diff(np.r_[first, len(lane)]))
        kept = place < self.k
        self.score[lane[kept], place[kept]] = score[kept]
        self.id[lane[kept], place[kept]] = ids[kept]
        self.held[touched] = np.minimum(np.diff(np.r_[first, len(lane)]), self.k)

    def rows(self):
        """(lane, score, id) of all that is held."""
        lane, place = np.nonzero(np.arange(self.k)[None, :] < self.held[:, None])
        return lane, self.score[lane, place], self.id[lane, place]


@dataclass
class Block:
    """A bounded number of anchors; `limits` has the upper limits of slots, falling."""

    number: np.ndarray
    id: np.ndarray
    label: np.ndarray
    x: np.ndarray
    limits: np.ndarray | None = None
    lower: np.ndarray | None = None


def best_of_task(batches, block: Block, k: int):
    """The best `k` rows of a task for each anchor and slot.

    Without limits: rows of the anchor's label, in slot 0. With limits: rows of other labels, in
    the slot of the least limit that they do not pass, if they reach the anchor's lower limit.
    Rows with the anchor's own id are neither.
    """
    slots = 1 if block.limits is None else block.limits.shape[1]
    lanes = Lanes(len(block.id) * slots, k)
    for batch in batches:
        for at in range(0, batch.num_rows, SIDE_V):
            part = batch.slice(at, SIDE_V)
            ids = part.column("vec_id").to_numpy()
            label = part.column("label").to_numpy()
            x = matrix(part.column("x"), block.x.shape[1], np.int64)
            for a in range(0, len(block.id), SIDE_A):
                own = slice(a, a + SIDE_A)
                score = products(block.x[own], x)
                same = block.label[own, None] == label[None, :]
                free = (same if block.limits is None else ~same) & (
                    block.id[own, None] != ids[None, :]
                )
                if block.limits is None:
                    slot = np.zeros_like(score)
                else:
                    slot = (score[:, :, None] <= block.limits[own, None, :]).sum(2) - 1
                    free &= (slot >= 0) & (score >= block.lower[own, None])
                    slot = np.maximum(slot, 0)
                lane = (np.arange(a, a + len(score)) * slots)[:, None] + slot
                free &= (score >= lanes.floor()[lane]) & (score >= top(score, free, slot, slots, k))
                row, column = np.nonzero(free)
                lanes.offer(lane[row, column], score[row, column], ids[column])
    lane, score, ids = lanes.rows()
    columns = [block.number[lane // slots], (lane % slots).astype(np.int32), score, ids]
    yield pa.RecordBatch.from_arrays(
        [pa.array(c) for c in columns], names=["number", "slot", "score", "id"]
    )


def top(score, free, slot, slots, k) -> np.ndarray:
    """For each entry the k-th best score of its row and slot, or the least number."""
    if score.shape[1] <= k:
        return np.full((1, 1), LEAST)
    out = np.full(score.shape, LEAST)
    for s in range(slots):
        here = free & (slot == s)
        bar = np.partition(np.where(here, score, LEAST), -k, axis=1)[:, -k]
        out[here] = np.broadcast_to(bar[:, None], score.shape)[here]
    return out


def usable(vectors: DataFrame, label: F.Column, anchor: F.Column) -> DataFrame:
    """(vec_id, label, anchor, x array<long>) of the rows that take part."""
    reachable(vectors.sparkSession)
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        label.cast("long").alias("label"),
        F.coalesce(anchor, F.lit(False)).alias("anchor"),
        doubles().alias("v"),
    ).filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite(F.col("v")))

    def work(batches):
        for batch in batches:
            v = batch.column("v")
            values = whole(v.flatten().to_numpy(zero_copy_only=False))
            sizes = v.value_lengths().to_numpy(zero_copy_only=False)
            starts = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.ListArray.from_arrays(starts, pa.array(values))],
                names=["vec_id", "label", "anchor", "x"],
            )

    return rows.mapInArrow(work, "vec_id long, label long, anchor boolean, x array<long>")


def in_blocks(anchors: DataFrame, count: int) -> DataFrame:
    """Anchors with the number of their block, blocks together, so that one is read cheaply."""
    blocks = max(1, -(-count // BLOCK))
    block = F.pmod(F.xxhash64("number"), F.lit(blocks)).cast("int")
    return anchors.withColumn("block", block).repartitionByRange("block").sortWithinPartitions("block")


def block_of(rows: pa.Table) -> Block:
    x = rows.column("x").combine_chunks()
    width = max(x.value_lengths().to_pylist(), default=0)
    parts = [rows.column(c).to_numpy() for c in ("number", "vec_id", "label")]
    out = Block(*parts, matrix(x, width, np.int64))
    if "limits" in rows.column_names:
        limits = rows.column("limits").combine_chunks()
        most = max(limits.value_lengths().to_pylist(), default=0)
        out.limits = np.full((len(limits), most), LEAST)
        for k, own in enumerate(limits.to_pylist()):
            out.limits[k, : len(own)] = own
        out.lower = rows.column("lower").to_numpy()
    return out


def pass_over(rows: DataFrame, anchors: DataFrame, k: int, name: str) -> DataFrame:
    """The best `k` of each anchor and slot over all rows, one block of anchors at a time."""
    parts = []
    for (number,) in anchors.select("block").distinct().orderBy("block").collect():
        block = block_of(anchors.filter(F.col("block") == number).toArrow())
        found = rows.select("vec_id", "label", "x").mapInArrow(
            lambda batches, block=block: best_of_task(batches, block, k), FOUND
        )
        place = F.row_number().over(
            Window.partitionBy("number", "slot").orderBy(F.desc("score"), "id")
        )
        parts.append(
            staged(found.withColumn("place", place).filter(F.col("place") <= k), name)
        )
    spark = rows.sparkSession
    if not parts:
        return spark.createDataFrame([], FOUND + ", place int")
    return spark.read.schema(parts[0].schema).parquet(*[p.staged_at for p in parts])


def hard_negatives(
    vectors: DataFrame,
    anchor: F.Column,
    label: F.Column | None = None,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Components become floor(256 * x), a score is the inner product with the anchor; higher
    scores come first, then smaller vec_id. Positives are the first rows of the anchor's label,
    negatives of a positive the first rows of other labels with
    low * positive_score <= 100 * negative_score <= high * positive_score.

    Rows with a null vec_id, label or vector, or a null or non-finite component, take no part.
    Rows with the anchor's own vec_id are neither its positives nor its negatives; equal anchors
    count once, all other repeated rows each count. Of vectors of different lengths the
    longer one counts as cut. Components too large for exact
    64-bit products raise an error. No rows, anchors, positives or negatives give no rows.
    """
    rows = staged(usable(vectors, F.col("label") if label is None else label, anchor), "vectors")
    own = rows.filter("anchor").select("vec_id", "label", "x").distinct()
    anchors = staged(own.withColumn("number", F.monotonically_increasing_id()), "anchors")
    count = anchors.count()
    first = staged(in_blocks(anchors, count), "anchor-blocks")
    taken = pass_over(rows, first, positives, "positives")
    share = lambda p, s: F.expr(f"({p} * {s} - pmod({p} * {s}, 100)) div 100")
    near = taken.select(
        "number",
        F.col("id").alias("positive_id"),
        F.col("score").alias("positive_score"),
        F.col("place").alias("positive_place"),
        share(high, "score").alias("upper"),
        (-share(-low, "score")).alias("lower"),
    ).filter("lower <= upper")
    of = near.groupBy("number").agg(
        F.reverse(F.sort_array(F.collect_set("upper"))).alias("limits"),
        F.min("lower").alias("lower"),
    )  # at most `positives` limits each
    second = staged(in_blocks(anchors.join(of, "number"), count), "anchor-limits")
    found = pass_over(rows, second, negatives, "negatives")
    dropped(first)
    entry = F.struct(F.col("score"), F.col("id"))
    lanes = found.groupBy("number", "slot").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("place", entry.alias("e")))), lambda p: p["e"]
        ).alias("best")
    )  # at most `negatives` each
    lists_of = lanes.groupBy("number").agg(F.collect_list(F.struct("slot", "best")).alias("lanes"))
    windows = near.join(anchors.select("number", F.col("vec_id").alias("anchor_id")), "number")
    windows = windows.join(second.select("number", "limits"), "number").join(lists_of, "number")
    slot = F.array_position("limits", F.col("upper")) - 1
    windows = windows.withColumn("slot", slot).withColumn("suffix", suffix(negatives))
    inside = F.filter("suffix", lambda e: e["score"] >= F.col("lower"))
    return windows.select(
        "anchor_id", "positive_id", "positive_score", F.posexplode(inside).alias("at", "e")
    ).select(
        "anchor_id",
        "positive_id",
        (F.col("at") + 1).cast("int").alias("rank"),
        F.col("e.id").alias("negative_id"),
        "positive_score",
        F.col("e.score").alias("negative_score"),
    )


def suffix(k: int) -> F.Column:
    """The first `k` entries of the own slot and all lower ones.

    Slots are numbered by falling scores, so the merge of sorted lists is their concatenation.
    """
    mine = F.filter("lanes", lambda lane: lane["slot"] >= F.col("slot"))
    return F.slice(F.flatten(F.transform(F.sort_array(mine), lambda lane: lane["best"])), 1, k)


def relabelled() -> F.Column:
    """The labels of the registered query: shifted where vec_id is divisible by 7."""
    moved = (F.col("label") + 1) % 10
    return F.when(F.col("vec_id") % 7 == 0, moved).otherwise(F.col("label"))


def check_sql() -> str:
    """All scores of all anchors in plain SQL, a window of its own for each positive."""
    return """
        WITH v AS MATERIALIZED (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
                  = len(embedding)),
        s AS MATERIALIZED (
            SELECT a.vec_id AS a, o.vec_id AS o, a.label = o.label AS same,
                   list_inner_product(a.e, o.e)::BIGINT AS score
            FROM v a JOIN v o ON a.vec_id <> o.vec_id WHERE a.vec_id % 100 = 0),
        p AS (
            SELECT a, o AS p, score AS ps FROM s WHERE same
            QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, o) <= 5)
        SELECT a AS anchor_id, p AS positive_id,
               (row_number() OVER (PARTITION BY a, p ORDER BY score DESC, o))::INTEGER AS rank,
               o AS negative_id, ps AS positive_score, score AS negative_score
        FROM p JOIN s USING (a)
        WHERE NOT same AND 30 * ps <= 100 * score AND 100 * score <= 90 * ps
        QUALIFY row_number() OVER (PARTITION BY a, p ORDER BY score DESC, o) <= 10
    """
