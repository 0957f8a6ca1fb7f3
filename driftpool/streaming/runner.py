"""The keyed loop as a Structured Streaming job.

The same state machine as the batch runner is kept per stream in the state
store. Rows of a micro-batch are put in order of time and id per stream; a row
that does not come after the last one used is reported as late and never fed.
Rows are numbered as they are used, so the split into micro-batches does not
matter.
"""

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType, TimestampType

from driftpool.functions import linalg, metrics
from driftpool.operators import exchange
from driftpool.operators.loop import OUTPUT, StreamLoop, row_columns
from driftpool.plans.config import LoopConfig

STREAM_OUTPUT = StructType(OUTPUT.fields + [StructField("ts", TimestampType())])
STATE = StructType([StructField("loop", StringType()), StructField("last", TimestampType()),
                    StructField("last_id", LongType())])
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _frame(columns: dict, size: int) -> pd.DataFrame:
    out = {}
    for f in STREAM_OUTPUT:
        value = columns.get(f.name)
        if f.name in ("seq", "start_seq", "end_seq", "n"):
            out[f.name] = pd.array([None] * size if value is None else value, dtype="Int64")
        elif f.name in ("y", "p", "intercept"):
            out[f.name] = pd.Series([None] * size if value is None else value, dtype="float64")
        elif f.name == "ts":
            out[f.name] = pd.Series([None] * size if value is None else value, dtype="datetime64[us]")
        else:
            out[f.name] = pd.Series([None] * size if value is None else value, dtype="object")
    return pd.DataFrame(out)


class LoopProcessor(StatefulProcessor):
    def __init__(self, cfg: LoopConfig, idle_ms: int | None = None):
        self.cfg, self.idle_ms = cfg, idle_ms
        self.registered = dict(linalg.REGISTERED)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("loop", STATE, self.idle_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True).sort_values(["ts", "id"], kind="stable")
        kept = self.kept.get() if self.kept.exists() else None
        loop = StreamLoop(self.cfg, kept[0] if kept else None, self.registered)
        last = pd.Timestamp(kept[1]) if kept else None
        domain = key[0]
        ts = pd.to_datetime(batch["ts"])
        if ts.dt.tz is not None:
            ts = ts.dt.tz_convert("UTC").dt.tz_localize(None)
        if last is not None and last.tzinfo is not None:
            last = last.tz_convert("UTC").tz_localize(None)
        ids = batch["id"].to_numpy()
        new = np.ones(len(batch), dtype=bool)
        if last is not None:
            # without an id (0) rows of one time are all fed, in the order they came
            new = ((ts > last) | ((ts == last) & ((ids > kept[2]) | (ids == 0)))).to_numpy()
        if not new.all():
            late = batch[~new]
            yield _frame({"domain": [domain] * len(late), "kind": ["late"] * len(late), "y": late["y"].to_numpy(),
                          "ts": ts[~new].to_numpy()}, len(late))
        fresh = batch[new]
        if len(fresh):
            y = fresh["y"].to_numpy(dtype=float)
            first, p, runs = loop.feed(np.stack(fresh["features"].to_numpy()), y)
            size = len(fresh)
            yield _frame({"domain": [domain] * size, "kind": ["row"] * size, "ts": ts[new].to_numpy(),
                          **row_columns(np.arange(first, first + size), y, p, runs)}, size)
            if loop.events:
                names = [f.name for f in OUTPUT if f.name != "domain"]
                columns = {n: [e.get(n) for e in loop.events] for n in names}
                yield _frame({"domain": [domain] * len(loop.events), **columns}, len(loop.events))
                loop.events = []
            self.kept.update((loop.dump(), ts[new].iloc[-1].to_pydatetime(), int(ids[new][-1])))

    def close(self) -> None:
        pass


def run_stream(stream: DataFrame, cfg: LoopConfig, idle_ms: int | None = None, id_col: str | None = None) -> DataFrame:
    """Loop over a stream of ``domain, ts, features, y``.

    The session has to use the state store named by ``STORE``. Rows of one time
    are ordered by ``id_col``, a positive long, as the batch loop breaks ties; without it they are
    taken as they come. ``idle_ms`` drops the state of streams without rows for
    that long (processing time).
    """
    name = "spark.sql.streaming.stateStore.providerClass"
    if stream.sparkSession.conf.get(name, None) != STORE:
        raise ValueError(f"set {name} to {STORE}")
    mode = "ProcessingTime" if idle_ms else "None"
    tie = F.col(id_col).cast("long") if id_col else F.lit(0).cast("long")
    rows = stream.select("domain", F.col("ts").cast("timestamp").alias("ts"), tie.alias("id"), "features", "y")
    return rows.groupBy("domain").transformWithStateInPandas(
        LoopProcessor(cfg, idle_ms), STREAM_OUTPUT, "Append", mode)


def windowed_accuracy(rows: DataFrame, delay: str, span: str) -> DataFrame:
    """Accuracy by stream and tumbling event-time window of predicted rows."""
    return (rows.withWatermark("ts", delay).groupBy("domain", F.window("ts", span).alias("span"))
            .agg(F.count("*").alias("n"), metrics.r2("y", "p").alias("r2"), metrics.mae("y", "p").alias("mae")))


def publish_to(path: str):
    """``foreachBatch`` sink that appends published models to the registry table, once per batch."""
    def write(batch: DataFrame, epoch: int) -> None:
        found = batch.filter("kind = 'publish'").select(
            F.lit(epoch).alias("epoch"), F.col("domain").alias("source"),
            F.concat_ws("-", "domain", "model_id").alias("model_id"), "coef", "intercept", "pcs")
        # a replayed batch writes to the same folder, so a model is never published twice
        found.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")
    return write


class ExchangeProcessor(StatefulProcessor):
    """The loop that exchanges models: rows of a key, and orders of the exchange as rows with a ``state``.

    Orders of a micro-batch come before its rows. ``close_ms`` after its last rows (processing time) a stream is
    closed: its last segment and its transitions are put out and its state is dropped.
    """

    def __init__(self, cfg: LoopConfig, rule: str, close_ms: int | None = None):
        self.cfg, self.rule, self.close_ms = cfg, rule, close_ms
        self.registered = dict(linalg.REGISTERED)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("exchange", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True)
        domain = key[0]
        kept = self.kept.get() if self.kept.exists() else None
        loop = exchange.ExchangeLoop(self.cfg, self.rule, kept[0] if kept else None, self.registered)
        told = batch["state"].notna()
        for order in map(json.loads, sorted(batch["state"][told])):
            loop.obey(order) if "waiting" not in order else loop.wait(order["waiting"])
        batch = batch[~told].sort_values(["ts", "id"], kind="stable")
        ts, ids = _plain_times(batch["ts"]), batch["id"].to_numpy()
        last, last_id = (_plain_time(kept[1]), kept[2]) if kept else (None, None)
        new = np.ones(len(batch), dtype=bool)
        if last is not None and len(batch):
            new = ((ts > last) | ((ts == last) & ((ids > last_id) | (ids == 0)))).to_numpy()
        late, fresh = batch[~new], batch[new]
        if len(late):
            yield _frame({"domain": [domain] * len(late), "kind": ["late"] * len(late), "y": late["y"].to_numpy(),
                          "ts": ts[~new].to_numpy()}, len(late))
        if len(fresh):
            first, p, runs = loop.feed(np.stack(fresh["features"].to_numpy()), fresh["y"].to_numpy(dtype=float))
            size = len(fresh)
            yield _frame({"domain": [domain] * size, "kind": ["row"] * size, "ts": ts[new].to_numpy(),
                          **row_columns(np.arange(first, first + size), fresh["y"].to_numpy(dtype=float), p, runs)}, size)
            last, last_id = ts[new].iloc[-1], int(ids[new][-1])
            if self.close_ms:
                for timer in list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.close_ms)
        yield from self._said(domain, loop)
        self.kept.update((loop.dump(), None if last is None else last.to_pydatetime(), last_id))

    def _said(self, domain, loop):
        if loop.events:
            names = [f.name for f in OUTPUT if f.name != "domain"]
            columns = {n: [e.get(n) for e in loop.events] for n in names}
            yield _frame({"domain": [domain] * len(loop.events), **columns}, len(loop.events))
            loop.events = []

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.kept.exists():
            loop = exchange.ExchangeLoop(self.cfg, self.rule, self.kept.get()[0], self.registered)
            loop.finish()
            loop.transitions()
            yield from self._said(key[0], loop)
            self.kept.clear()

    def close(self) -> None:
        pass


def _plain_times(ts):
    ts = pd.to_datetime(ts)
    return ts.dt.tz_convert("UTC").dt.tz_localize(None) if ts.dt.tz is not None else ts


def _plain_time(ts):
    if ts is None:
        return None
    ts = pd.Timestamp(ts)
    return ts.tz_convert("UTC").tz_localize(None) if ts.tzinfo is not None else ts


class StreamingExchange:
    """Loops of a stream that exchange models: micro-batch ``e`` publishes what batch ``e + 1`` can use.

    ``folder`` holds the book of the exchange and, under ``orders``, what it tells the streams: the query reads that
    folder as a second source, so a model published in one batch reaches its targets with the next. A batch that is
    run again after a failure replaces its part of both. The query needs a trigger that looks for new files while it
    runs (the default one, or one by processing time).
    """

    def __init__(self, spark, folder: str, edges: DataFrame, cfg: LoopConfig, rule: str = "information",
                 close_ms: int | None = None):
        if spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) != STORE:
            raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {STORE}")
        self.spark, self.folder, self.cfg, self.rule, self.close_ms = spark, folder, cfg, rule, close_ms
        self.edges = edges.select("src", "dst").filter("src <> dst").distinct()
        self.orders = f"{folder}/orders"
        # a source needs its folder
        spark.createDataFrame([], "domain string, state string").write.mode("append").parquet(self.orders)

    def run(self, stream: DataFrame, id_col: str | None = None) -> DataFrame:
        """Rows and events of the loops over ``domain, ts, features, y``; its sink has to be ``settle``."""
        tie = F.col(id_col).cast("long") if id_col else F.lit(0).cast("long")
        rows = stream.select("domain", F.col("ts").cast("timestamp").alias("ts"), tie.alias("id"),
                             F.col("features").cast("array<double>").alias("features"),
                             F.col("y").cast("double").alias("y"), F.lit(None).cast("string").alias("state"))
        none = lambda kind: F.lit(None).cast(kind)
        told = self.spark.readStream.schema("domain string, state string").option("recursiveFileLookup", "true").parquet(
            self.orders).select("domain", none("timestamp").alias("ts"), F.lit(0).cast("long").alias("id"),
                                none("array<double>").alias("features"), none("double").alias("y"), "state")
        mode = "ProcessingTime" if self.close_ms else "None"
        return rows.unionByName(told).groupBy("domain").transformWithStateInPandas(
            ExchangeProcessor(self.cfg, self.rule, self.close_ms), STREAM_OUTPUT, "Append", mode)

    def settle(self, batch: DataFrame, epoch: int) -> None:
        """``foreachBatch`` sink: rows go to ``out``, events through the exchange, orders to the streams."""
        path = f"{self.folder}/out/epoch={epoch}"
        batch.write.mode("overwrite").parquet(path)
        events = self.spark.read.schema(STREAM_OUTPUT).parquet(path).filter("kind <> 'row'")
        if events.isEmpty():
            return
        book = exchange.Book.at(self.spark, f"{self.folder}/book")
        exchange.settle(book, events, self.edges, epoch)
        before = book.queued.of(book.queued.before(epoch)).select(F.col("source").alias("domain")).distinct()
        decided = events.filter("kind IN ('confirm', 'substitute')").select("domain").distinct()
        waits = book.queued.of(epoch).select(F.col("source").alias("domain")).distinct()
        told = exchange.orders(book, epoch).filter("NOT startswith(state, '{\"waiting')")
        # only what changes: whoever waits anew, or decided and waits still, and whoever waits no more
        still = waits.join(before, "domain", "left_semi").join(decided, "domain", "left_semi")
        told = told.unionByName(waits.join(before, "domain", "left_anti").unionByName(still).select(
            "domain", F.lit('{"waiting": true}').alias("state")))
        told = told.unionByName(before.join(waits, "domain", "left_anti").select(
            "domain", F.lit('{"waiting": false}').alias("state")))
        path = f"{self.folder}/told/epoch={epoch}"
        told.write.mode("overwrite").parquet(path)
        told = self.spark.read.schema("domain string, state string").parquet(path)
        if not told.isEmpty():
            told.coalesce(1).write.mode("overwrite").parquet(f"{self.orders}/batch={epoch}")
