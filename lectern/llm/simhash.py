"""SimHash fingerprints and their self-join over a binary trie.

Fingerprints come from hashes of word shingles. Distinct fingerprints are joined by walking a
binary trie against itself: pairs of nodes go down together, differing bits add up, a pair
that exceeds the error budget is dropped. The top levels are walked by Spark: every
fingerprint goes to the pairs of top nodes that can still meet. Two errors in 64 bits leave at
most one in one of the halves, so the walk is done twice, once with either half on top, and
top nodes need only differ by one bit. The levels below are walked in a task on sorted arrays.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from lectern.functions.skew import spread_join
from lectern.llm.common import only, pieces, raw, texts
from lectern.llm.components import components
from lectern.session import staged

#: Distinct fingerprints below a top node, on average.
NODE = 1 << 11
#: Pairs of fingerprints that a pair of trie nodes may stand for before they are compared.
LEAF = 32
#: Pairs of trie nodes that are walked at once.
FRONT = 1 << 18


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    """Bit i is 1 if it is set in over half of the XXH64 of the word shingles.

    A-Z are lower-cased, words are split at ASCII white space, shingles are joined by one
    space and count as often as they occur. A text of fewer words is one shingle; without
    words the fingerprint is zero.
    """
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, seed)
    starts = [0]
    for word in words:
        starts.append(starts[-1] + len(word) + 1)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(joined[a : b - 1], seed) for a, b in zip(starts, starts[width:])),
        np.uint64,
        len(words) - width + 1,
    )
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp long, text_key long), written once; null texts count as empty."""

    def work(batches):
        for batch in pieces(batches):
            found = [fingerprint(t, width, seed) for t in raw(batch.column("text"))]
            fp = pa.array(np.array(found, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), fp, batch.column("text_key")],
                names=["doc_id", "fp", "text_key"],
            )

    rows = texts(docs).withColumn("text_key", F.xxhash64("text"))
    return staged(rows.mapInArrow(work, "doc_id long, fp long, text_key long"), "fingerprints")


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def near_pairs(left: np.ndarray, right: np.ndarray, errors: int):
    """Index pairs (i, j) with at most `errors` differing bits, from two sorted arrays.

    Walks the binary tries of both, a level at a time. A frontier of more than FRONT node
    pairs is walked in parts, so memory is bounded whatever the number of fingerprints.
    """
    if not len(left) or not len(right):
        return
    start = np.array([[0, len(left), 0, len(right)]], np.int64)
    todo = [(63, start, np.zeros((1, 2), np.uint64), np.zeros(1, np.int64))]
    while todo:
        bit, spans, heads, seen = todo.pop()
        sizes = (spans[:, 1] - spans[:, 0]) * (spans[:, 3] - spans[:, 2])
        ripe = (sizes <= LEAF) | (bit < 0)
        for part in np.array_split(spans[ripe], max(1, int(sizes[ripe].sum()) >> 20)):
            n = (part[:, 1] - part[:, 0]) * (part[:, 3] - part[:, 2])
            which = np.repeat(np.arange(len(part)), n)
            place = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
            wide = (part[:, 3] - part[:, 2])[which]
            i, j = part[which, 0] + place // wide, part[which, 2] + place % wide
            near = differing(left[i], right[j]) <= errors
            yield i[near], j[near]
        spans, heads, seen = spans[~ripe], heads[~ripe], seen[~ripe]
        if not len(spans):
            continue
        if len(spans) > FRONT:
            for part in np.array_split(np.arange(len(spans)), len(spans) // FRONT + 1):
                todo.append((bit, spans[part], heads[part], seen[part]))
            continue
        one = np.uint64(1 << bit)
        middle_a = np.clip(np.searchsorted(left, heads[:, 0] | one), spans[:, 0], spans[:, 1])
        middle_b = np.clip(np.searchsorted(right, heads[:, 1] | one), spans[:, 2], spans[:, 3])
        nodes = []
        for x in (0, 1):
            for y in (0, 1):
                a = (middle_a, spans[:, 1]) if x else (spans[:, 0], middle_a)
                b = (middle_b, spans[:, 3]) if y else (spans[:, 2], middle_b)
                wrong = seen + (x != y)
                live = (wrong <= errors) & (a[0] < a[1]) & (b[0] < b[1])
                head = heads | np.array([one * np.uint64(x), one * np.uint64(y)], np.uint64)
                nodes.append((np.stack([*a, *b], 1)[live], head[live], wrong[live]))
        todo.append((bit - 1, *(np.concatenate(part) for part in zip(*nodes))))


def forest(count: int, pairs) -> np.ndarray:
    """The least index that each of `count` indices is linked with through `pairs`."""
    root = np.arange(count)
    for i, j in pairs:
        while True:
            a, b = root[i], root[j]
            apart = a != b
            if not apart.any():
                break
            np.minimum.at(root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
            while not np.array_equal(up := root[root], root):
                root = up
    return root


def _turned(values: np.ndarray, half: int) -> np.ndarray:
    """The bits in the order of a walk: as they are, or with the lower half on top."""
    if not half:
        return values
    return (values << np.uint64(32)) | (values >> np.uint64(32))


def near_links(found: DataFrame, errors: int = 2) -> DataFrame:
    """(u, v): links that connect all fingerprints within `errors` bits (at most 3) of another.

    `found` holds distinct values in column fp. Each pair of top nodes gives a spanning
    forest of its links, never all pairs, so a large group gives as many rows as members.
    """
    depth = min(24, max(0, int(found.count() // NODE).bit_length()))
    flips = F.array(*(F.lit(x).cast("long") for x in [0, *(1 << i for i in range(depth))]))
    halves = F.array(F.lit(0), F.lit(1))
    top = F.when(F.col("half") == 0, F.shiftrightunsigned("fp", 64 - depth)).otherwise(
        F.shiftrightunsigned(F.shiftleft("fp", 32), 64 - depth)
    )
    if not depth:
        top = F.lit(0).cast("long")
    spread = (
        found.select("fp", F.explode(halves).alias("half"))
        .select("fp", "half", top.alias("top"))
        .select("fp", "half", "top", F.explode(flips).alias("flip"))
        .select(
            "fp",
            "half",
            F.least("top", F.col("top").bitwiseXOR(F.col("flip"))).alias("low"),
            F.greatest("top", F.col("top").bitwiseXOR(F.col("flip"))).alias("high"),
        )
    )

    def walk(key, rows):
        half, low, high = key
        values = np.sort(_turned(rows["fp"].to_numpy(np.int64).view(np.uint64), half))
        on_low = (
            values >> np.uint64(64 - depth) == np.uint64(low)
            if depth
            else np.ones(len(values), bool)
        )
        if low == high:
            pairs = near_pairs(values, values, errors)
        else:
            first = np.flatnonzero(on_low)
            second = np.flatnonzero(~on_low)
            pairs = (
                (first[i], second[j])
                for i, j in near_pairs(values[first], values[second], errors)
            )
        root = forest(len(values), pairs)
        linked = np.flatnonzero(root != np.arange(len(values)))
        plain = _turned(values, half).view(np.int64)
        return pd.DataFrame({"u": plain[linked], "v": plain[root[linked]]})

    return spread.groupBy("half", "low", "high").applyInPandas(walk, "u long, v long")


def near_groups(found: DataFrame, errors: int = 2) -> DataFrame:
    """`found` (doc_id, fp, text_key) with component_id, the least doc_id within reach.

    Documents of one fingerprint are linked, also those without words. A null doc_id is no
    candidate for component_id, which is null only where no document of the group has an id.
    """
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    distinct = staged(found.groupBy("fp").agg(F.min(first).alias("first")), "distinct")
    roots = components(near_links(distinct.select("fp"), errors))
    linked = distinct.join(roots, distinct["fp"] == roots["node"])
    least = linked.groupBy("root").agg(F.min("first").alias("least"))
    moved = linked.select("fp", "root").join(least, "root").select(
        F.col("fp").alias("node"), "least"
    )
    whole = distinct.join(moved, distinct["fp"] == moved["node"], "left").select(
        "fp", F.coalesce("least", "first").alias("least")
    )
    return spread_join(found, whole, "fp", ["doc_id", "text_key"]).select(
        "doc_id",
        "fp",
        "text_key",
        F.col("least.doc_id").alias("component_id"),
        F.col("least").alias("least"),
    )


def near_duplicates(docs: DataFrame, width: int = 3, errors: int = 2) -> DataFrame:
    """One row per document: doc_id, fingerprint (hex), component_id."""
    return near_groups(fingerprints(docs, width), errors).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def without_near_copies(docs: DataFrame, width: int = 3, errors: int = 2) -> DataFrame:
    """`docs` with the document of least doc_id of every group, all its columns."""
    groups = near_groups(fingerprints(docs, width), errors)
    names = groups.select("least.doc_id", "least.text_key").distinct()
    return only(docs, names)
