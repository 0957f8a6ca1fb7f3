"""Readers and the result sink on hand-made files."""

import datetime as dt

from pyspark.sql import functions as F

from driftpool.functions import weather
from driftpool.plans.config import WORKLOADS
from driftpool.operators.stream_ops import split
from driftpool.sources import ingest


def test_commented_csv(spark, tmp_path):
    path = tmp_path / "h.csv"
    path.write_text("#Concepts: 2\n#Noise: 0.2\n1,2,y\n0.1,0.2,0.3\n0.4,0.5,0.6\n")
    rows = ingest.read_commented(spark, str(path), ingest.hyperplane_schema(2)).collect()
    assert [tuple(r) for r in rows] == [(0.1, 0.2, 0.3), (0.4, 0.5, 0.6)]


def test_following_drops_nulls_and_numbers(spark, tmp_path):
    path = tmp_path / "f.csv"
    path.write_text("Time,speed,gap,FollowingTime\n2020-01-01 00:00:03,1,2,3\n2020-01-01 00:00:01,1,,3\n2020-01-01 00:00:02,4,5,6\n")
    rows = ingest.read_following(spark, str(path), ingest.following_schema(["speed", "gap"]), ["Time"])
    got = {r.Time: r.seq for r in rows.collect()}
    assert got == {"2020-01-01 00:00:02": 1, "2020-01-01 00:00:03": 2}
    out = split(rows.select("domain", "seq", "Time", "speed", "gap", "FollowingTime"), WORKLOADS["following"].label, list(WORKLOADS["following"].drop))
    assert sorted(map(tuple, (r.features for r in out.collect()))) == [(1.0, 2.0), (4.0, 5.0)]


def test_heating(spark, tmp_path):
    path = tmp_path / "heat.csv"
    path.write_text("#a\n#b\ndate,time,oTemp,rain,dTemp,heatingOn\n2024-01-07,30,4.5,1,12,1\n2024-01-08,100,4,0,12,0\n")
    rows = ingest.read_heating(spark, str(path))
    assert dict(rows.dtypes)["time"] == "bigint"
    got = [(r.date, r.day_of_week, r.year, r.month, r.day) for r in rows.orderBy("date").collect()]
    assert got == [(dt.date(2024, 1, 7), 6, 2024, 1, 7), (dt.date(2024, 1, 8), 0, 2024, 1, 8)]
    w = WORKLOADS["heating"]
    assert split(rows.withColumnRenamed("day_of_week", "dayOfWeek"), w.label, list(w.drop)).first().features[0] == 30.0


def test_daily_weather_reads_only_named_columns(spark, tmp_path):
    for year in (2013, 2014):
        (tmp_path / f"w{year}.csv").write_text(f"GMT,Max,Mean,Min,Events\n{year}-1-1,10,5,1,1\n{year}-01-02,11,6,2,0\n")
    rows = ingest.read_daily_weather(spark, [str(tmp_path / f"w{y}.csv") for y in (2013, 2014)],
                                     {"GMT": "date", "Max": "int", "Min": "int", "Events": "int"})
    assert rows.columns == ["GMT", "Max", "Min", "Events"] and rows.count() == 4
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Mean" not in plan.split("ReadSchema")[1]


def test_sunrise_matrix(spark):
    wide = spark.createDataFrame([(28, 700, 600), (30, 701, 0)], ["day", "1", "2"])
    got = sorted(tuple(r) for r in weather.long_sunrise(wide).collect())
    assert got == [(28, 1, 700), (28, 2, 600), (30, 1, 701)]


def test_choice_is_repeatable(spark):
    streams = spark.range(20).select(F.concat(F.lit("d"), "id").alias("domain"))
    a = [r.domain for r in ingest.choose_streams(streams, 5, "x").collect()]
    b = [r.domain for r in ingest.choose_streams(streams.repartition(7), 5, "x").collect()]
    assert a == b and len(set(a)) == 5
    assert ingest.choose_streams(streams, 0, "x").count() == 20
    assert a != [r.domain for r in ingest.choose_streams(streams, 5, "y").collect()]


def test_results_are_appended_by_experiment(spark, tmp_path):
    row = spark.createDataFrame([("windowed", "hyperplane", "pool", "ols", "a", 0.5)],
                                "detector string, workload string, framework string, ensemble string, domain string, r2 double")
    for _ in range(2):
        ingest.write_results(row, str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r")).filter("detector = 'windowed' and ensemble = 'ols'").count() == 2
