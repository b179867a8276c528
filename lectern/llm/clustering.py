"""Centroid clustering with an incremental distance matrix.

Each vector keeps the exact integer inner products with all centroids in its row. When the
centroids move, only the components that changed are multiplied with their change and added;
distances follow from the products, and the nearest centroid is read off anew. The rows are
written to the shared folder after each round, so a lost executor repeats part of one round.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lectern.llm.common import reachable
from lectern.llm.vectors import ROWS, doubles, finite, lists, matrix, products, whole
from lectern.session import dropped, staged

STATE = "vec_id long, x array<long>, dots array<long>, cluster int, distance long"
RESULT = (
    "vec_id long, cluster int, distance long, cluster_inertia long, inertia long,"
    " centroid_sha256 string"
)


def kept_vectors(vectors: DataFrame, width: int) -> DataFrame:
    """(vec_id, v array<double>) of the vectors with `width` finite components."""
    reachable(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), doubles().alias("v"))
    return rows.filter((F.size("v") == width) & finite(F.col("v")))


def first_centroids(kept: DataFrame, k: int, prefix: str, width: int) -> np.ndarray:
    """The `k` vectors of least sha256 of `prefix` and vec_id, as integers.

    Ties (repeated ids) are broken by components. Vectors without id are never chosen.
    """
    key = F.sha2(F.concat(F.lit(prefix), F.col("vec_id").cast("string")), 256)
    rows = (
        kept.filter("vec_id IS NOT NULL").select(key.alias("h"), "v").orderBy("h", "v").limit(k)
    ).collect()  # at most k rows
    return whole(np.array([r["v"] for r in rows], float).reshape(-1, width))


def updated(dots: np.ndarray, x: np.ndarray, change: np.ndarray) -> np.ndarray:
    """`dots` plus the inner products of `x` with `change`, by its nonzero components only."""
    out = dots.copy()
    for c in np.flatnonzero(change.any(axis=1)):
        at = np.flatnonzero(change[c])
        out[:, c] += products(x[:, at], change[c : c + 1, at])[:, 0]
    return out


def nearest(x: np.ndarray, dots: np.ndarray, centroids: np.ndarray):
    """Number of the nearest centroid (ties: smaller) and squared distance, all in integers."""
    most = max((int(np.abs(m).max()) for m in (x, centroids) if m.size), default=0)
    if 4 * most * most * x.shape[1] >= 2**63:
        raise OverflowError("components are too large for 64-bit distances")
    far = (centroids * centroids).sum(1)[None, :] - 2 * dots
    cluster = far.argmin(axis=1)
    return cluster, far[np.arange(len(x)), cluster] + (x * x).sum(1)


def first_state(kept: DataFrame, centroids: np.ndarray) -> DataFrame:
    """All inner products, the only time that they are computed in full."""
    width = centroids.shape[1]

    def work(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                x = whole(matrix(part.column("v"), width, np.float64))
                yield state_rows(part.column("vec_id"), x, products(x, centroids), centroids)

    return kept.mapInArrow(work, STATE)


def next_state(state: DataFrame, centroids: np.ndarray, change: np.ndarray) -> DataFrame:
    width, k = centroids.shape[1], len(centroids)

    def work(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                x = matrix(part.column("x"), width, np.int64)
                dots = updated(matrix(part.column("dots"), k, np.int64), x, change)
                yield state_rows(part.column("vec_id"), x, dots, centroids)

    return state.select("vec_id", "x", "dots").mapInArrow(work, STATE)


def state_rows(ids, x, dots, centroids) -> pa.RecordBatch:
    cluster, distance = nearest(x, dots, centroids)
    columns = [ids, lists(x), lists(dots), pa.array(cluster.astype(np.int32)), pa.array(distance)]
    return pa.RecordBatch.from_arrays(columns, names=["vec_id", "x", "dots", "cluster", "distance"])


def moved(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Floor of the mean of each centroid's vectors; empty ones stay.

    The sums are partial sums in Spark; one row per centroid reaches the driver.
    """
    width = centroids.shape[1]
    sums = [F.sum(F.col("x")[j]).alias(f"s{j}") for j in range(width)]
    out = centroids.copy()
    for r in state.groupBy("cluster").agg(F.count("*").alias("n"), *sums).collect():
        out[r["cluster"]] = [r[f"s{j}"] // r["n"] for j in range(width)]
    return out


def clusters(
    vectors: DataFrame, k: int = 40, rounds: int = 5, prefix: str = "2:", width: int = 64
) -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Components become floor(256 * x). Vectors of another length, null vectors, and vectors with
    a null or non-finite component are left out; `label` and other columns are not read. Rows
    with equal ids or equal vectors each count and each have a row. Rows without vec_id are
    clustered but never first centroids. Fewer vectors than `k` give fewer centroids; no
    vectors give no rows. Components too large for exact 64-bit distances raise an error.
    """
    spark = vectors.sparkSession
    kept = kept_vectors(vectors, width)
    centroids = first_centroids(kept, k, prefix, width)
    if not len(centroids):
        return spark.createDataFrame([], RESULT)
    state = staged(first_state(kept, centroids), "clusters")
    for _ in range(rounds):
        now = moved(state, centroids)
        before, state = state, staged(next_state(state, now, now - centroids), "clusters")
        dropped(before)
        centroids = now
    digests = [
        (c, hashlib.sha256(",".join(map(str, row)).encode()).hexdigest())
        for c, row in enumerate(centroids.tolist())
    ]
    # one row per centroid: k rows at most are broadcast
    inertia = state.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    total = inertia.agg(F.sum("cluster_inertia")).first()[0]
    of = inertia.join(spark.createDataFrame(digests, "cluster int, centroid_sha256 string"), "cluster")
    return state.join(F.broadcast(of), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia",
        F.lit(total).cast("long").alias("inertia"), "centroid_sha256",
    )


def check_sql(k: int = 40, rounds: int = 5, prefix: str = "2:", width: int = 64) -> str:
    """The same in plain SQL: components as rows, every distance in full in every round."""
    parts = [f"""
        kept AS MATERIALIZED (
            SELECT vec_id, embedding AS e FROM embeddings
            WHERE len(embedding) = {width}
              AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {width}),
        x AS MATERIALIZED (
            SELECT vec_id, unnest(range({width})) AS j,
                   floor(256 * unnest(e)::DOUBLE)::BIGINT AS v FROM kept),
        c0 AS MATERIALIZED (
            SELECT c, j, v FROM x JOIN (
                SELECT vec_id, row_number() OVER (ORDER BY sha256('{prefix}' || vec_id)) - 1 AS c
                FROM kept) USING (vec_id) WHERE c < {k})"""]
    for r in range(rounds + 1):
        parts.append(f"""
        a{r} AS MATERIALIZED (
            SELECT vec_id, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
                SELECT vec_id, c, sum((x.v - m.v) * (x.v - m.v))::BIGINT AS d
                FROM x JOIN c{r} m USING (j) GROUP BY ALL)
            GROUP BY vec_id)""")
        if r < rounds:
            parts.append(f"""
        c{r + 1} AS MATERIALIZED (
            SELECT c, j, coalesce(m.v, o.v) AS v FROM c{r} o LEFT JOIN (
                SELECT c, j, ((s - (((s % n) + n) % n)) // n)::BIGINT AS v FROM (
                    SELECT c, j, sum(v) AS s, count(*) AS n
                    FROM x JOIN a{r} USING (vec_id) GROUP BY ALL)) m USING (c, j))""")
    return f"""
        WITH {",".join(parts)}
        SELECT vec_id, c::INTEGER AS cluster, d AS distance,
               (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia,
               (sum(d) OVER ())::BIGINT AS inertia, h AS centroid_sha256
        FROM a{rounds} JOIN (
            SELECT c, sha256(string_agg(v::VARCHAR, ',' ORDER BY j)) AS h
            FROM c{rounds} GROUP BY c) USING (c)
    """
