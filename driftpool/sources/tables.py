"""Streams derived from the given tables."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from driftpool.functions import labels
from driftpool.plans import sequence

CONCEPT_ROWS = 500
LINE_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
              "l_extendedprice", "l_discount", "l_tax"]
FEATURES = ["x1", "x2", "x3", "x4", "x5"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def line_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as numbered streams, one per return flag and line status.

    Columns: domain, seq, x1..x5 in [0,1], plus the columns other queries need.
    """
    rows = table(spark, folder, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("domain"), *LINE_ORDER)
    # a ship date holds a bounded share of a stream; the order key splits it further
    numbered = sequence.number_rows(rows, ["domain"], LINE_ORDER,
                                    [F.col("l_shipdate"), F.floor(F.col("l_orderkey") / 1_000_000)])
    return numbered.select(
        "domain", "seq", F.col("l_shipdate").alias("ts"), "l_suppkey", "l_linenumber",
        (F.col("l_quantity") / 50.0).alias("x1"),
        (F.col("l_discount") * 10.0 + 0.0).alias("x2"),
        (F.col("l_tax") * 12.5 + 0.0).alias("x3"),
        (F.col("l_extendedprice") / 100000.0).alias("x4"),
        (F.col("l_partkey") % 100 / 100.0).alias("x5"))


def drifting_label(concept, x1, x2, x3, x4, x5):
    """Label of four recurring concepts; the last one contradicts the first."""
    first = labels.mean_score([x1, x2, x3])
    return labels.unit(
        F.when(concept == 0, first)
        .when(concept == 1, labels.cosine_score([x2, x3, x4]))
        .when(concept == 2, labels.sine_score([x1, x4, x5]))
        .otherwise(1 - first))


def line_stream(spark: SparkSession, folder: str) -> DataFrame:
    """``line_rows`` with a concept and a drifting label ``y``."""
    rows = line_rows(spark, folder)
    rows = rows.withColumn("concept", labels.concept_at(F.col("seq"), CONCEPT_ROWS, 4))
    return rows.withColumn("y", drifting_label(F.col("concept"), *[F.col(c) for c in FEATURES]))


def as_stream(rows: DataFrame, features: list[str] = FEATURES, label: str = "y") -> DataFrame:
    """Feature / label split: ``domain, seq, features, y``."""
    return rows.select("domain", "seq", F.array(*features).alias("features"),
                       F.col(label).alias("y"))


def event_rows(spark: SparkSession, folder: str, domain: str) -> DataFrame:
    """Events as streams by ``user_id`` or ``event_type``, numbered by time."""
    rows = table(spark, folder, "events").select(
        F.col(domain).cast("string").alias("domain"), "ts", "event_id", "value", "event_type")
    return sequence.number_rows(rows, ["domain"], ["ts", "event_id"],
                                [F.date_trunc(unit, F.col("ts")) for unit in ("hour", "minute", "second")])
