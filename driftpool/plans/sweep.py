"""Repeating an experiment under several settings and comparing the results."""

from pyspark.sql import DataFrame, functions as F


def expand(rows: DataFrame, settings: list[dict]) -> DataFrame:
    """Give every stream one copy per setting: the setting becomes part of its key.

    The number of settings is fixed by the caller, so rows grow by a constant.
    """
    structs = [F.struct(*[F.lit(v).alias(k) for k, v in s.items()], F.lit(i).alias("config")) for i, s in enumerate(settings)]
    names = list(settings[0]) + ["config"]
    wide = rows.withColumn("_s", F.explode(F.array(*structs)))
    return wide.select(*rows.columns, *[F.col(f"_s.{n}").alias(n) for n in names])


def summarise(results: DataFrame, settings: list[str], values: list[str]) -> DataFrame:
    """Mean and deviation of each value over streams and repeats, by setting."""
    aggregates = [F.count("*").alias("streams")]
    for v in values:
        aggregates += [F.avg(v).alias(f"mean_{v}"), F.stddev_samp(v).alias(f"sd_{v}")]
    return results.groupBy(*settings).agg(*aggregates)
