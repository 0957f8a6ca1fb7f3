"""Merkle fixity audit of WARC records: trees over ordered offset ranges, compared from the root down."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from driftpool.llm.bounds import measured
from driftpool.session import staged

FANOUT = 16


def record(url: Column, payload: Column) -> Column:
    """Bytes of a WARC response record as text."""
    body = F.coalesce(payload.cast("string"), F.lit(""))
    return F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(url.cast("string"), F.lit("")),
                    F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body,
                    F.lit("\r\n\r\n"))


def laid_out(rows: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Staged (id, seq, start, end, digest): records in ascending order of id, equal ids by digest.

    The records are hashed where they are read; only their digests and lengths are ordered. Each range of ids sums
    its own lengths and takes the total of the ranges before it, one number a range. A null id comes first.
    """
    text = record(F.col(f"`{url_col}`"), F.col(f"`{payload_col}`"))
    hashed = rows.select(F.col(f"`{id_col}`").alias("id"), F.octet_length(text).cast("bigint").alias("length"),
                         F.sha2(text.cast("binary"), 256).alias("digest"))
    parts = staged(staged(hashed).repartitionByRange("id", "digest").withColumn("part", F.spark_partition_id()))
    totals = parts.groupBy("part").agg(F.sum("length").alias("bytes"), F.count("*").alias("rows"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)   # one row a range
    totals = measured(totals.select("part", F.coalesce(F.sum("bytes").over(ahead), F.lit(0)).alias("bytes"),
                                    F.coalesce(F.sum("rows").over(ahead), F.lit(0)).alias("rows")))
    inside = Window.partitionBy("part").orderBy("id", "digest").rowsBetween(Window.unboundedPreceding, 0)
    placed = parts.withColumn("end", F.sum("length").over(inside)).withColumn("n", F.count("*").over(inside))
    return staged(placed.join(totals, "part").select(
        "id", (F.col("rows") + F.col("n") - 1).alias("seq"), (F.col("bytes") + F.col("end") - F.col("length")).alias("start"),
        (F.col("bytes") + F.col("end")).alias("end"), "digest"))


def tree(layout: DataFrame, fanout: int = FANOUT) -> list[DataFrame]:
    """Levels of the tree, leaves first, each (node, start, end, digest).

    A leaf hashes its range and its record's digest; a node hashes its range and the digests of at most ``fanout``
    children in order. The last level is the root. No records, no levels.
    """
    level = layout.select(F.col("seq").alias("node"), "start", "end", F.sha2(F.concat_ws(
        ":", F.col("start").cast("string"), F.col("end").cast("string"), "digest"), 256).alias("digest"))
    most = layout.agg(F.max("seq")).first()[0]
    if most is None:
        return []
    levels = [staged(level)]
    while most:
        most //= fanout
        below = levels[-1].groupBy(F.expr(f"node div {fanout}").alias("node")).agg(
            F.min("start").alias("start"), F.max("end").alias("end"),
            F.array_sort(F.collect_list(F.struct("node", "digest"))).alias("children"))
        levels.append(staged(below.select("node", "start", "end", F.sha2(F.concat_ws(
            ":", F.col("start").cast("string"), F.col("end").cast("string"),
            F.array_join(F.col("children.digest"), "")), 256).alias("digest"))))
    return levels


def root(levels: list[DataFrame]) -> str | None:
    return levels[-1].first()["digest"] if levels else None


def differing(one: list[DataFrame], other: list[DataFrame], fanout: int = FANOUT) -> DataFrame:
    """(seq, start, end, what) of the leaves that differ: ``damaged``, ``missing`` in the second tree or ``extra``.

    From the roots down, only children of nodes that differ are read on. A tree without a level counts as missing.
    """
    spark = (one or other)[0].sparkSession if (one or other) else None
    if spark is None:
        raise ValueError("two trees without records")
    empty = (one or other)[0].limit(0)
    height = max(len(one), len(other))
    suspects = None
    for level in range(height - 1, -1, -1):
        a = one[level] if level < len(one) else empty
        b = other[level] if level < len(other) else empty
        if suspects is not None:
            up = measured(suspects)
            parent = F.expr(f"node div {fanout}")
            a = a.join(up, parent == F.col("up"), "left_semi")
            b = b.join(up, parent == F.col("up"), "left_semi")
        b = b.select(F.col("node").alias("n"), F.col("start").alias("s"), F.col("end").alias("e"), F.col("digest").alias("d"))
        both = a.join(b, F.col("node") == F.col("n"), "full").filter(~F.col("digest").eqNullSafe(F.col("d")))
        met = both.select(F.coalesce("node", "n").alias("seq"), F.coalesce("start", "s").alias("start"),
                          F.coalesce("end", "e").alias("end"), F.when(F.col("n").isNull(), "missing")
                          .when(F.col("node").isNull(), "extra").otherwise("damaged").alias("what"))
        suspects = met.select(F.col("seq").alias("up")) if level else None
    return met


def audited(layout: DataFrame, replica: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """(id, seq, start, end, digest, what) of every record of ``layout``; ``what`` is null where the replica agrees."""
    mine, theirs = tree(layout, fanout), tree(replica, fanout)
    if not mine:
        return layout.withColumn("what", F.lit(None).cast("string"))
    if root(mine) == root(theirs):
        return layout.withColumn("what", F.lit(None).cast("string"))
    found = measured(differing(mine, theirs, fanout).select("seq", "what"))
    return layout.join(found, "seq", "left").select("id", "seq", "start", "end", "digest", "what")
