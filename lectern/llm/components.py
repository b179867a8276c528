"""Connected components of links between 64-bit keys, as Spark joins."""

from pyspark.sql import DataFrame, functions as F

from lectern.session import staged


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """One round: neighbours are linked with the smallest neighbour instead.

    Large: the larger neighbours of each node. Small: the smaller ones and the node itself.
    The smallest neighbour is a partial minimum, so a node with many links is no hot group.
    """
    turned = links.select(F.col("v").alias("u"), F.col("u").alias("v"))
    sides = links.unionByName(turned).distinct() if large else links.select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    ).distinct()
    least = sides.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    met = sides.join(least, "u")
    if large:
        out = met.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
    return out.filter("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node in `links` (u long, v long); root is the least of them.

    Alternates both rounds until the links are stars. Each round is written to the shared
    folder, so its lineage is short and a lost executor costs one round. Loops are allowed;
    no links give no rows.
    """
    now = staged(links.filter("u <> v").select("u", "v").distinct(), "links")
    before = None
    while True:
        now = staged(_stars(_stars(now, True), False), "stars")
        state = now.agg(
            F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if state == before:
            break
        before = state
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
