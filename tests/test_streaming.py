"""Streaming runner: same result as the batch loop for any split into files."""

import datetime as dt

import pytest
from pyspark.sql import Window, functions as F

from driftpool.operators import loop
from driftpool.plans.config import LoopConfig
from driftpool.sources import ingest, tables
from driftpool.streaming import runner


KEY = "spark.sql.streaming.stateStore.providerClass"


def _write(rows, folder, parts, columns):
    total = rows.count()
    for i in range(parts):
        part = rows.filter((F.col("_at") >= total * i // parts) & (F.col("_at") < total * (i + 1) // parts))
        part.select(*columns).coalesce(1).write.mode("append").parquet(folder)


@pytest.fixture(scope="module")
def source(spark, small):
    """Event streams by type, with a label the features explain, in time order."""
    rows = tables.event_rows(spark, small, "event_type")
    x = F.array((F.hour("ts") / 24.0), (F.minute("ts") / 60.0))
    y = F.when(F.col("seq") < 100, x[0]).otherwise(1 - x[0] * 0.5)
    out = rows.select("domain", "seq", "ts", x.alias("features"), y.alias("y"))
    return out.withColumn("_at", F.row_number().over(Window.orderBy("ts")) - 1).cache()


def _stream(spark, source, folder, parts, checkpoint, cfg, name):
    columns = ["domain", "ts", "features", "y"]
    _write(source, folder, parts, columns)
    stream = ingest.replay(spark, folder, source.select(*columns).schema)
    query = (runner.run_stream(stream, cfg).writeStream.format("memory").queryName(name)
             .option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start())
    query.awaitTermination(240)
    return spark.table(name)


@pytest.mark.parametrize("parts", [1, 3])
def test_streaming_equals_batch(spark, source, tmp_path, parts):
    cfg = LoopConfig(window=20, eps=0.05)
    got = _stream(spark, source, str(tmp_path / "in"), parts, str(tmp_path / "cp"), cfg, f"out{parts}").toPandas()
    want = loop.run(source, cfg).toPandas()
    a = got[got.kind == "row"].set_index(["domain", "seq"])["p"]
    b = want[want.kind == "row"].set_index(["domain", "seq"])["p"]
    assert len(a) == len(b) and (a - b.reindex(a.index)).abs().max() < 1e-9
    kinds = ["learn", "reuse", "drift", "publish"]
    def events(t):
        return sorted((r.domain, r.kind, int(r.seq), r.model_id) for r in t[t.kind.isin(kinds)].itertuples())
    assert events(got) == events(want) and events(got)


def test_restart_and_late_rows(spark, source, tmp_path):
    cfg = LoopConfig(window=20, eps=0.05)
    folder, checkpoint = str(tmp_path / "in"), str(tmp_path / "cp")
    columns = ["domain", "ts", "features", "y"]
    seen = []

    def collect(batch, epoch):
        seen.extend(batch.select("domain", "kind", "seq", "p", "model_id").collect())

    def go():
        stream = ingest.replay(spark, folder, source.select(*columns).schema)
        (runner.run_stream(stream, cfg).writeStream.foreachBatch(collect).option("checkpointLocation", checkpoint)
         .outputMode("append").trigger(availableNow=True).start().awaitTermination(240))
    total = source.count()
    source.filter(F.col("_at") < total // 2).select(*columns).coalesce(1).write.mode("append").parquet(folder)
    go()
    half = len([r for r in seen if r.kind == "row"])
    assert half == total // 2
    # the first half once more, and the rest: the repeated rows are late
    source.filter(F.col("_at") < total // 4).select(*columns).coalesce(1).write.mode("append").parquet(folder)
    go()
    source.filter(F.col("_at") >= total // 2).select(*columns).coalesce(1).write.mode("append").parquet(folder)
    go()
    assert len([r for r in seen if r.kind == "late"]) == total // 4
    rows = {(r.domain, r.seq): r.p for r in seen if r.kind == "row"}
    want = {(r.domain, r.seq): r.p for r in loop.run(source, cfg).filter("kind = 'row'").collect()}
    assert rows.keys() == want.keys() and max(abs(rows[k] - want[k]) for k in rows) < 1e-9


def test_rows_of_one_time_are_ordered_by_id(spark, source, tmp_path):
    """Batch and stream agree where many rows share a time, also over a cut between them."""
    cfg = LoopConfig(window=20, eps=0.05)
    ties = source.withColumn("ts", F.date_trunc("day", "ts")).withColumn("event_id", F.col("_at") + 1)
    columns = ["domain", "ts", "event_id", "features", "y"]
    folder = str(tmp_path / "in")
    _write(ties, folder, 3, columns)
    stream = ingest.replay(spark, folder, ties.select(*columns).schema)
    (runner.run_stream(stream, cfg, id_col="event_id").writeStream.format("memory").queryName("tied")
     .option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start().awaitTermination(240))
    got = {(r.domain, r.seq): r.p for r in spark.table("tied").filter("kind = 'row'").collect()}
    want = {(r.domain, r.seq): r.p for r in loop.run(source, cfg).filter("kind = 'row'").collect()}
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in got) < 1e-9
    with pytest.raises(ValueError):
        spark.conf.unset(KEY), runner.run_stream(stream, cfg)
    spark.conf.set(KEY, runner.STORE)


def test_tumbling_accuracy_and_registry(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [("a", start + dt.timedelta(minutes=i), float(i % 7), float(i % 7) + (0.5 if i >= 60 else 0.0)) for i in range(120)]
    df = spark.createDataFrame(rows, "domain string, ts timestamp, y double, p double")
    out = runner.windowed_accuracy(df, "5 minutes", "1 hour").orderBy("span").collect()
    assert [r.n for r in out] == [60, 60] and out[0].r2 == 1.0 and abs(out[1].mae - 0.5) < 1e-12
    batch = spark.createDataFrame([("a", "publish", "0", [1.0], 0.5, None)],
                                  "domain string, kind string, model_id string, coef array<double>, intercept double, pcs array<array<double>>")
    write = runner.publish_to(str(tmp_path / "registry"))
    write(batch, 0), write(batch, 0), write(batch, 1)
    back = spark.read.parquet(str(tmp_path / "registry"))
    assert sorted((r.epoch, r.model_id) for r in back.select("epoch", "model_id").collect()) == [(0, "a-0"), (1, "a-0")]


def _exchanging(n, first, order, seed):
    import numpy as np
    rng = np.random.default_rng(seed)
    X = rng.random((n, 3))
    kind = np.array([order[k // 130 % len(order)] for k in range(n)])
    y = np.select([kind == 0, kind == 1], [X[:, 0], 1 - X[:, 1]], X[:, 2] * 0.5 + X[:, 0] * 0.4) + rng.normal(0, 0.03, n)
    return [(first + k, X[k].tolist(), float(y[k])) for k in range(n)]


def test_exchange_in_a_stream_equals_batch(spark, tmp_path):
    """Streams that publish to each other: each file of an epoch's rows is a micro-batch; a restart in between."""
    from driftpool.operators import exchange
    cfg = LoopConfig(window=30, eps=0.1, acc=0.6)
    begin = dt.datetime(2024, 1, 1)
    streams = {"a": _exchanging(800, 1, [0, 1, 0, 2], 1), "b": _exchanging(600, 201, [0, 0, 1, 2], 2),
               "c": _exchanging(700, 101, [1, 0, 2], 3)}
    rows = [(d, s, begin + dt.timedelta(minutes=s), x, y) for d, part in streams.items() for s, x, y in part]
    table = spark.createDataFrame(rows, "domain string, seq long, ts timestamp, features array<double>, y double")
    edges = spark.createDataFrame([(a, b) for a in "abc" for b in "abc" if a != b], "src string, dst string")
    folder, source = str(tmp_path / "x"), str(tmp_path / "in")

    def go(epochs):
        for e in epochs:
            table.filter(F.floor((F.col("seq") - 1) / 100) == e).coalesce(1).write.mode("append").parquet(source)
        running = runner.StreamingExchange(spark, folder, edges, cfg, "distance")
        stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(source)
        query = (running.run(stream).writeStream.foreachBatch(running.settle).outputMode("append")
                 .option("checkpointLocation", str(tmp_path / "cp")).start())
        query.processAllAvailable()
        query.stop()
    go(range(3))
    go(range(3, 8))
    got = spark.read.parquet(folder + "/out")
    result, book = exchange.run(table, edges, cfg, 100, "distance")
    want = result.join(table.select("domain", "seq", "ts"), ["domain", "seq"]).filter("kind = 'row'")
    a = {(r.domain, r.ts): (r.p, r.model_id) for r in got.filter("kind = 'row'").collect()}
    b = {(r.domain, r.ts): (r.p, r.model_id) for r in want.collect()}
    assert a.keys() == b.keys()
    assert [k for k in a if a[k][1] != b[k][1]] == [] and max(abs(a[k][0] - b[k][0]) for k in a) < 1e-9
    mine = exchange.Book.at(spark, folder + "/book")

    def counted(log):
        return sorted((r.domain, r.kind, r.model_id, r.other or "") for r in log.upto(1000).collect())
    assert counted(mine.counted) == counted(book.counted)
    assert {"published", "received", "delayed"} <= {k for _, k, *_ in counted(book.counted)}


def test_silent_streams_are_closed(spark, tmp_path):
    import time
    cfg = LoopConfig(window=30, eps=0.1, acc=0.6)
    begin = dt.datetime(2024, 1, 1)
    rows = [("a", begin + dt.timedelta(minutes=s), x, y) for s, x, y in _exchanging(400, 1, [0, 1], 1)]
    table = spark.createDataFrame(rows, "domain string, ts timestamp, features array<double>, y double")
    edges = spark.createDataFrame([], "src string, dst string")
    source, folder = str(tmp_path / "in"), str(tmp_path / "x")
    table.coalesce(1).write.parquet(source)
    running = runner.StreamingExchange(spark, folder, edges, cfg, "distance", close_ms=500)
    query = (running.run(spark.readStream.schema(table.schema).parquet(source)).writeStream.foreachBatch(running.settle)
             .outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start())
    try:
        ended = time.time() + 90
        segments = []
        while time.time() < ended and not any(r.end_seq == 400 for r in segments):
            time.sleep(2)
            try:
                segments = spark.read.schema(runner.STREAM_OUTPUT).parquet(folder + "/out").filter("kind = 'segment'").collect()
            except Exception:  # noqa: BLE001, PERF203
                segments = []  # not written yet, or just being replaced
    finally:
        query.stop()
    want = loop.segments_of(loop.run(table.withColumn("seq", F.row_number().over(
        Window.orderBy("ts")).cast("long")), cfg)).collect()
    assert sorted((r.model_id, r.start_seq, r.end_seq) for r in segments) == sorted(
        (r.model_id, r.start_seq, r.end_seq) for r in want)
