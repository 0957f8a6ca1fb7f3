"""Order of a stream, and windows that never need a whole stream in one task.

A stream's order is explicit: ``seq`` counts from 1 in the given order. A
stream may hold a third of all rows, so the count is taken in two levels and
count-based windows run on chunks of ``seq`` that carry a halo of neighbours.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from driftpool.session import staged

CHUNK_ROWS = 8192
TASK_ROWS = 200_000     # rows that one task sorts


def tasks_for(spark: SparkSession, rows: int) -> int:
    """Number of tasks of a shuffle that sorts ``rows`` rows: no task grows with the input."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))


def number_rows(df: DataFrame, keys: list[str], order: list[str], buckets: list[Column],
                seq: str = "seq") -> DataFrame:
    """Exact row number per key without sorting a key in one task.

    ``buckets`` are expressions that never decrease along ``order``, coarse to
    fine (a day, then a range of ids). Bucket sizes are counted with map-side
    combine; running totals per level give each bucket its base, so not even
    the list of buckets of a hot key meets in one task; only rows of one
    finest bucket are sorted together. Counts are written once, so the rows are
    read twice; a mark with the base goes in front of the rows of its bucket, so
    the rows are shuffled once. Null keys are a stream of their own, null buckets
    come first.
    """
    names = [f"_b{i}" for i in range(len(buckets))]
    tagged = df.select("*", *[b.alias(n) for n, b in zip(names, buckets)])
    place = keys + names
    counts = staged(tagged.groupBy(*place).agg(F.count("*").alias("_n")))
    base = None
    for level in range(len(names), 0, -1):
        outer, upto = keys + names[:level - 1], keys + names[:level]
        totals = counts if level == len(names) else counts.groupBy(*upto).agg(F.sum("_n").alias("_n"))
        before = (Window.partitionBy(*outer).orderBy(names[level - 1])
                  .rowsBetween(Window.unboundedPreceding, -1))
        part = totals.select(*upto, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias(f"_t{level}"))
        base = part if base is None else join_same(base, part, upto)
    start = F.lit(0)
    for level in range(1, len(names) + 1):
        start = start + F.col(f"_t{level}")
    base = base.select(*place, start.alias("_base"))
    rows = counts.agg(F.sum("_n")).first()[0] or 0
    marked = tagged.withColumn("_base", F.lit(None).cast("bigint")).unionByName(base, allowMissingColumns=True)
    marked = marked.repartition(tasks_for(df.sparkSession, rows), *place)
    inside = Window.partitionBy(*place).orderBy(F.col("_base").isNull(), *order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    return (marked.withColumn(seq, F.first("_base", True).over(upto) + F.row_number().over(inside) - 1)
            .filter(F.col("_base").isNull()).drop("_base", *names))


def join_same(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on columns of equal name in which nulls are equal."""
    other = right.select(*[F.col(c).alias(f"_same_{c}" if c in keys else c) for c in right.columns])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_same_{k}"))
    return left.join(other, on).drop(*[f"_same_{k}" for k in keys])


def number_short(df: DataFrame, keys: list[str], order: list[str], seq: str = "seq") -> DataFrame:
    """Row number for keys known to be short."""
    return df.withColumn(seq, F.row_number().over(
        Window.partitionBy(*keys).orderBy(*order)).cast("bigint"))


def with_halo(df: DataFrame, ahead: int = 0, behind: int = 0,
              chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Give every row its chunk, plus copies for chunks whose frames reach it.

    Adds ``chunk`` and ``home`` (true on the one copy that yields a result).
    """
    low = F.greatest(F.floor((F.col("seq") - ahead) / chunk_rows), F.lit(0))
    high = F.floor((F.col("seq") + behind) / chunk_rows)
    return (df.withColumn("chunk", F.explode(F.sequence(low, high)))
            .withColumn("home", F.col("chunk") == F.floor(F.col("seq") / chunk_rows)))


def chunk_window(keys: list[str]):
    return Window.partitionBy(*keys, "chunk").orderBy("seq")


def next_over_chunks(df: DataFrame, keys: list[str], value: Column, name: str,
                     chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``lead(value)`` by ``seq`` within keys, in two levels.

    Inside a chunk it is a plain lead; the last row of a chunk takes the first
    value of the next chunk that has rows.
    """
    parts = df.withColumn("chunk", F.floor(F.col("seq") / chunk_rows)).withColumn("_v", value)
    heads = parts.groupBy(*keys, "chunk").agg(F.min_by("_v", "seq").alias("_head"))
    heads = heads.withColumn("_after", F.lead("_head").over(
        Window.partitionBy(*keys).orderBy("chunk"))).drop("_head")
    return (parts.join(heads, keys + ["chunk"])
            .withColumn(name, F.coalesce(F.lead("_v").over(chunk_window(keys)), F.col("_after")))
            .drop("_v", "_after", "chunk"))


def running_sum(df: DataFrame, keys: list[str], value: Column, name: str,
                chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Running sum by ``seq`` within keys: chunk totals first, then inside chunks."""
    parts = df.withColumn("chunk", F.floor(F.col("seq") / chunk_rows)).withColumn("_v", value)
    before = (Window.partitionBy(*keys).orderBy("chunk")
              .rowsBetween(Window.unboundedPreceding, -1))
    totals = (parts.groupBy(*keys, "chunk").agg(F.sum("_v").alias("_t"))
              .withColumn("_base", F.coalesce(F.sum("_t").over(before), F.lit(0))).drop("_t"))
    inside = chunk_window(keys).rowsBetween(Window.unboundedPreceding, 0)
    return (parts.join(totals, keys + ["chunk"])
            .withColumn(name, F.col("_base") + F.sum("_v").over(inside))
            .drop("_v", "_base", "chunk"))
