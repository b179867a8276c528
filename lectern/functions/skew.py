"""A join whose left side may hold a large share of its rows under a few keys."""

from pyspark.sql import DataFrame, functions as F

#: Shares of all rows that a shuffle partition gets on average; a sub-key has at most one.
SHARES = 16


def spread_join(
    facts: DataFrame,
    dims: DataFrame,
    key: str | list[str],
    spread_by: list[str],
    how: str = "inner",
    counted: DataFrame | None = None,
) -> DataFrame:
    """`facts.join(dims, key, how)` for `how` in inner, left, left_semi, left_anti.

    All rows are divided by SHARES per shuffle partition. A key with more rows than such a
    share is cut by the hash of `spread_by` into as many sub-keys as it has shares, and its
    rows on the other side are repeated for each. No more keys than shares can be that large,
    so the broadcast list has at most that many rows and the repeats at most twice as many
    groups, whatever the data. Null keys match nothing and are spread over all shares.

    The keys are counted on `counted` where the same keys can be had without computing
    `facts`; it may hold them in other numbers.
    """
    keys = [key] if isinstance(key, str) else list(key)
    shares = SHARES * int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = (facts if counted is None else counted).groupBy(*keys).count()
    share = F.greatest(counts.agg(F.sum("count")).scalar() / shares, F.lit(1))
    hot = counts.where(F.col("count") > share).select(
        *keys, F.ceil(F.col("count") / share).cast("int").alias("_salts")
    )
    unmatched = F.lit(False)
    for name in keys:
        unmatched |= F.col(name).isNull()
    salts = F.when(unmatched, F.lit(shares)).otherwise(F.coalesce("_salts", F.lit(1)))
    left = (
        facts.join(F.broadcast(hot), keys, "left")
        .withColumn("_salt", F.pmod(F.xxhash64(*spread_by), salts).cast("int"))
        .drop("_salts")
    )
    right = (
        dims.join(F.broadcast(hot), keys, "left")
        .withColumn(
            "_salt",
            F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)),
        )
        .drop("_salts")
    )
    return left.join(right, keys + ["_salt"], how).drop("_salt")
