"""Packing of tokenized documents into sequences: dominance reduction, then best fit.

Documents become pieces of at most `capacity` tokens. How many pieces there are of each
length is a table of at most `capacity` rows whatever the input, and the packing is made on
that table: sets of lengths that provably dominate all alternatives are fixed first
(Martello and Toth), what remains is packed by best fit. The result is a plan of ranges:
pieces `first` to `first + count - 1` of a length go to that many sequences in turn. Spark
ranks the pieces of every length and looks up their places, so no task and no driver ever
holds the pieces themselves.
"""

import zlib
from bisect import bisect_left, insort
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from lectern.llm.common import pieces as parts, raw, texts
from lectern.llm.token_ids import Words, encoder
from lectern.session import staged

CAPACITY = 4096
#: Pieces of one length that are ranked together.
SPREAD = 512


@dataclass
class Plan:
    """Ranges (length, first rank, count, first sequence, offset)."""

    capacity: int
    left: Counter
    ranges: list[tuple[int, int, int, int, int]] = field(default_factory=list)
    sequences: int = 0
    used: Counter = field(default_factory=Counter)

    def put(self, length: int, count: int, sequence: int, offset: int):
        self.ranges.append((length, self.used[length], count, sequence, offset))
        self.used[length] += count
        self.left[length] -= count
        if not self.left[length]:
            del self.left[length]

    def fix(self, lengths: list[int], count: int):
        """`count` sequences that hold just `lengths`."""
        offset = 0
        for length in lengths:
            self.put(length, count, self.sequences, offset)
            offset += length
        self.sequences += count


def largest(lengths: list[int], left: Counter, limit: int, but: Counter) -> int:
    """The largest length up to `limit` of which a piece is left besides `but`; 0 if none."""
    k = bisect_left(lengths, limit + 1) - 1
    while k >= 0 and left[lengths[k]] - but[lengths[k]] <= 0:
        k -= 1
    return lengths[k] if k >= 0 else 0


def reduce(plan: Plan):
    """Fix sets that dominate every other set with their longest piece.

    A piece that no other fits beside is alone. A pair that fills a sequence dominates, as
    whatever else would lie beside one can lie in place of the other. Of the longest piece j:
    if no two others fit beside it, j with the longest that fits; if no three fit, j with the
    longest a and the longest b beside both, if no pair beside j has a smaller member above b.
    """
    room = plan.capacity
    while plan.left:
        before = plan.sequences
        for length in sorted(plan.left, reverse=True):
            other = room - length
            if length == room:
                plan.fix([length], plan.left[length])
            elif other == length:
                if plan.left[length] > 1:
                    plan.fix([length, length], plan.left[length] // 2)
            elif other < length and plan.left[other] > 0:
                plan.fix([length, other], min(plan.left[length], plan.left[other]))
        lengths = sorted(plan.left)
        while lengths:
            j = lengths[-1]
            small, k = [], 0
            while len(small) < 3 and k < len(lengths):
                extra = plan.left[lengths[k]] - (lengths[k] == j)
                small += [lengths[k]] * min(3 - len(small), extra)
                k += 1
            beside = room - j
            if not small or small[0] > beside:
                plan.fix([j], plan.left[j] if j != (small[0] if small else 0) else 1)
            elif len(small) < 2 or small[0] + small[1] > beside:
                a = largest(lengths, plan.left, beside, Counter([j]))
                count = plan.left[j] // 2 if a == j else min(plan.left[j], plan.left[a])
                plan.fix([j, a], max(1, count))
            elif len(small) < 3 or sum(small) > beside:
                a = largest(lengths, plan.left, beside, Counter([j]))
                b = largest(lengths, plan.left, beside - a, Counter([j, a]))
                if not b or lower_member(lengths, plan.left, beside, j) > b:
                    break
                need = Counter([j, a, b])
                plan.fix([j, a, b], min(plan.left[s] // need[s] for s in need))
            else:
                break
            lengths = [s for s in lengths if plan.left[s] > 0]
        if plan.sequences == before:
            return


def lower_member(lengths: list[int], left: Counter, room: int, j: int) -> int:
    """The largest y of pairs x >= y with x + y <= room beside a piece j; 0 if none."""
    for k in range(bisect_left(lengths, room // 2 + 1) - 1, -1, -1):
        y = lengths[k]
        spare = left[y] - (y == j)
        if spare >= 2:
            return y
        if spare == 1 and k + 1 < len(lengths):
            x = next((x for x in lengths[k + 1 :] if left[x] - (x == j) > 0), room)
            if x + y <= room:
                return y
    return 0


def best_fit(plan: Plan):
    """Longest first, each piece where least room is left; many like pieces at once."""
    groups: list[tuple[int, int, int]] = []  # (room, first sequence, count)
    for length in sorted(plan.left, reverse=True):
        while left := plan.left[length]:
            k = bisect_left(groups, (length, -1, -1))
            if k == len(groups):
                each = plan.capacity // length
                room, first, count = plan.capacity, plan.sequences, -(-left // each)
                plan.sequences += count
            else:
                room, first, count = groups.pop(k)
                each = room // length
            whole = min(count, left // each)
            if whole:
                fill, bins = each, whole
            else:
                fill, bins = left, 1
            for t in range(fill):
                plan.put(length, bins, first, plan.capacity - room + t * length)
            if room > fill * length:
                insort(groups, (room - fill * length, first, bins))
            if count > bins:
                insort(groups, (room, first + bins, count - bins))


def pack(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """A plan for `counts` pieces of each length; no pieces give an empty plan."""
    if any(not 0 < length <= capacity for length in counts):
        raise ValueError("lengths are from 1 to the capacity")
    plan = Plan(capacity, Counter({s: n for s, n in counts.items() if n}))
    reduce(plan)
    best_fit(plan)
    return plan


def token_pieces(
    docs: DataFrame, path: str, end_id: int, capacity: int = CAPACITY, with_ids: bool = False
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]), written once; null texts are empty.

    Every document has `end_id` after its tokens, so an empty one is a piece of one token.
    """

    def work(batches):
        coder = encoder(path, end_id, Words)
        for batch in parts(batches):
            ids, sizes = coder.encode(raw(batch.column("text")))
            ids = ids.astype("<u4", copy=False)
            ends = np.cumsum(sizes)
            rows = [
                (row, k, int(at), int(min(at + capacity, end)))
                for row, (begin, end) in enumerate(zip(ends - sizes, ends))
                for k, at in enumerate(range(begin, end, capacity))
            ]
            row, piece, first, last = (np.array(c, np.int64) for c in zip(*rows))
            columns = {
                "doc_id": batch.column("doc_id").take(pa.array(row)),
                "piece": pa.array(piece.astype(np.int32)),
                "start": pa.array(piece * capacity),
                "length": pa.array(last - first),
                "ids_crc32": pa.array(
                    [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(first, last)], pa.int64()
                ),
            }
            if with_ids:
                columns["ids"] = pa.array(
                    [ids[a:b].astype(np.int32) for a, b in zip(first, last)],
                    pa.list_(pa.int32()),
                )
            yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    found = texts(docs).mapInArrow(work, schema + ", ids array<int>" * with_ids)
    return staged(found, "pieces")


def ranked(found: DataFrame, most: int) -> DataFrame:
    """`found` with `rank`, from 0, among the pieces of a length.

    Pieces of a length are ranked in buckets of about SPREAD and counted bucket by bucket, so
    a length that a third of all pieces have is spread over tasks.
    """
    buckets = max(1, -(-most // SPREAD))
    name = F.xxhash64("doc_id", "piece", "ids_crc32")
    rows = found.withColumn("bucket", F.pmod(name, F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    counts = rows.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    base = counts.select(
        "length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")
    )
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    return (
        rows.join(base, ["length", "bucket"])
        .withColumn("rank", F.col("base") + F.row_number().over(inside) - 1)
        .drop("bucket", "base")
    )


def packed(
    docs: DataFrame, path: str, end_id: int, capacity: int = CAPACITY, with_ids: bool = False
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids].

    Only documents longer than `capacity` are cut, into pieces of `capacity` tokens and a
    rest. Offsets in a sequence are gapless. Repeated rows are packed as often as they occur;
    no documents give no rows.
    """
    found = token_pieces(docs, path, end_id, capacity, with_ids)
    counts = dict(found.groupBy("length").count().collect())
    plan = pack(counts, capacity)
    table = np.array(sorted(plan.ranges), np.int64).reshape(-1, 5)
    lengths = np.searchsorted(table[:, 0], np.arange(capacity + 2))

    def work(batches):
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            at = np.empty(len(rank), np.int64)
            for s in np.unique(length):
                mine = length == s
                low, high = lengths[s], lengths[s + 1]
                at[mine] = low + np.searchsorted(table[low:high, 1], rank[mine], "right") - 1
            out = batch.drop_columns(["rank"])
            out = out.append_column("sequence_id", pa.array(table[at, 3] + rank - table[at, 1]))
            yield out.append_column("offset", pa.array(table[at, 4]))

    rows = ranked(found, max(counts.values(), default=0))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.drop("rank").schema)
    placed = rows.mapInArrow(work, f"{kinds}, sequence_id long, offset long")
    order = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return placed.select(*order, *(["ids"] if with_ids else []))
