"""Readers, replay and the result sink."""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import (DateType, DoubleType, IntegerType, StringType, StructField, StructType)

from driftpool.plans import sequence

HEATING = StructType([
    StructField("date", DateType()), StructField("time", IntegerType()),
    StructField("oTemp", DoubleType()), StructField("rain", IntegerType()),
    StructField("dTemp", DoubleType()), StructField("heatingOn", IntegerType())])


def hyperplane_schema(features: int) -> StructType:
    names = [str(i) for i in range(1, features + 1)] + ["y"]
    return StructType([StructField(n, DoubleType()) for n in names])


def following_schema(features: list[str]) -> StructType:
    return StructType([StructField("Time", StringType())]
                      + [StructField(n, DoubleType()) for n in features + ["FollowingTime"]])


def read_commented(spark: SparkSession, path, schema: StructType) -> DataFrame:
    """CSV with a header row and ``#`` comment lines, under an explicit schema."""
    return spark.read.schema(schema).csv(path, header=True, comment="#", enforceSchema=True)


def read_following(spark: SparkSession, path, schema: StructType, order: list[str]) -> DataFrame:
    """Following record: rows with any null are dropped, the rest is numbered per file."""
    rows = (spark.read.schema(schema).csv(path, header=True)
            .na.drop("any").withColumn("domain", F.input_file_name()))
    return sequence.number_rows(rows, ["domain"], order, [F.substring(order[0], 1, 10)])


def with_date_parts(df: DataFrame, date: str = "date") -> DataFrame:
    """Year, month, day and weekday (Monday = 0) of a date column."""
    d = F.col(date)
    return (df.withColumn("year", F.year(d)).withColumn("month", F.month(d))
            .withColumn("day", F.dayofmonth(d)).withColumn("day_of_week", F.weekday(d).cast("bigint")))


def read_heating(spark: SparkSession, path) -> DataFrame:
    rows = with_date_parts(read_commented(spark, path, HEATING))
    return rows.withColumn("time", F.col("time").cast("bigint")).withColumn("rain", F.col("rain").cast("bigint"))


def read_daily_weather(spark: SparkSession, paths: list[str], columns: dict[str, str]) -> DataFrame:
    """Daily files of several years as one table with only the named columns.

    ``columns`` maps a file column to its type. Every file's own header gives
    the order of its columns; files of one header are read together, the rest
    of the columns is read as text and pruned by the reader.
    """
    headers = {}
    for path in paths:
        headers.setdefault(tuple(spark.read.option("header", True).csv(path).columns), []).append(path)
    parts = []
    for header, same in headers.items():
        schema = StructType([StructField(c, StringType()) for c in header])
        rows = spark.read.schema(schema).csv(same, header=True)
        parts.append(rows.select(*[F.col(c).cast(t).alias(c) for c, t in columns.items()]))
    return reduce(DataFrame.unionByName, parts)


def replay(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int = 1) -> DataFrame:
    """Replay parquet files as a stream, oldest file first, a few per micro-batch."""
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
            .option("latestFirst", False).parquet(folder))


def choose_streams(streams: DataFrame, n: int, seed: str) -> DataFrame:
    """First ``n`` streams in the order of a hash of their name and a seed; 0 keeps all."""
    if n == 0:
        return streams
    return streams.orderBy(F.md5(F.concat("domain", F.lit(seed))), "domain").limit(n)


def select_ranges(rows: DataFrame, ranges: DataFrame, date: str) -> DataFrame:
    """Rows of each configured stream within its date range, both ends included."""
    d = F.col(date)
    return rows.join(ranges, "domain").filter(d.between(F.col("from"), F.col("to"))).drop("from", "to")


RESULT_PARTITIONS = ["detector", "workload", "framework", "ensemble"]


def write_results(results: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Append result rows, partitioned by experiment."""
    (results.repartition(*RESULT_PARTITIONS).write.mode("append").format(fmt)
     .partitionBy(*RESULT_PARTITIONS).save(path))
