"""Connected components by alternating large and small stars."""

from pyspark.sql import DataFrame, functions as F

from driftpool.session import staged


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node that has an edge to another; root is its component's smallest node.

    Every round replaces an edge by one to the smallest neighbour. A hub's neighbours are only ever reduced
    by ``min`` before the shuffle and met by a join that can be split, so no group is gathered. Rounds are
    written to shared storage; their number grows with the logarithm of the longest path. Edges with a null
    end and loops are dropped.
    """
    pairs = staged(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
                   .filter(F.col(a).isNotNull() & F.col(b).isNotNull()).filter("u != v").distinct())
    state = _state(pairs)
    while state[0]:
        both = pairs.unionAll(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .distinct())
        large = staged(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        pairs = staged(small.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                       .unionAll(least.select("u", F.col("m").alias("v"))).filter("u != v").distinct())
        before, state = state, _state(pairs)
        if state == before:
            break
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(
        pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _state(pairs):
    row = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]
