"""Predict-then-learn loop of every stream, as one keyed Spark job.

Each stream is a state machine: burn-in, first fit, detection, choice of the
next model. ``StreamLoop`` consumes rows in blocks (matrix products between
events, never row by row for predictions) and is fed by the batch runner here
and by the streaming runner, so both give the same result.
"""

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import (ArrayType, DoubleType, LongType, StringType, StructField, StructType)

from driftpool.functions import linalg
from driftpool.operators.adaptive import AdaptiveWindow
from driftpool.operators.memory import Memory, Model
from driftpool.plans.config import LoopConfig
from driftpool.plans.sequence import tasks_for
from driftpool.session import new_folder, staged

BLOCK = 8192

OUTPUT = StructType([
    StructField("domain", StringType()), StructField("kind", StringType()), StructField("seq", LongType()),
    StructField("y", DoubleType()), StructField("p", DoubleType()), StructField("model_id", StringType()),
    StructField("start_seq", LongType()), StructField("end_seq", LongType()), StructField("n", LongType()),
    StructField("coef", ArrayType(DoubleType())), StructField("intercept", DoubleType()),
    StructField("pcs", ArrayType(ArrayType(DoubleType()))), StructField("state", StringType())])


class StreamLoop:
    """State of one stream: at most one window of rows, the memory, the detector."""

    def __init__(self, cfg: LoopConfig, kept: str | None = None, registered: dict | None = None):
        self.cfg = cfg
        self.learner = linalg.learner(cfg.learner, registered)
        self.places = {}            # given number of rows that later events may name
        self.seen = 0
        self.x, self.y = None, np.zeros(0)
        self.memory = Memory()
        self.current, self.model = None, None
        self.lowest = None          # windowed: first row that may open a window
        self.collecting = None      # first row of the window being collected
        self.temporary = False
        self.publish_at, self.published = None, set()
        self.window = self._detector()
        self.events = []
        if kept:
            self._restore(json.loads(kept))

    def _detector(self):
        c = self.cfg
        return AdaptiveWindow(c.window, c.delta, c.max_buckets, c.min_side)

    def dump(self) -> str:
        return json.dumps({
            "seen": self.seen, "x": None if self.x is None else self.x.tolist(), "y": self.y.tolist(),
            "memory": self.memory.dump(), "current": self.current,
            "model": None if self.model is None else [list(self.model.coef), self.model.intercept],
            "lowest": self.lowest, "collecting": self.collecting, "temporary": self.temporary,
            "publish_at": self.publish_at, "published": sorted(self.published), "window": self.window.dump(),
            "places": sorted(self.places.items())})

    def _restore(self, kept: dict) -> None:
        self.seen, self.y = kept["seen"], np.asarray(kept["y"], dtype=float)
        self.x = None if kept["x"] is None else np.asarray(kept["x"], dtype=float)
        self.memory = Memory.restore(kept["memory"])
        self.current = kept["current"]
        if kept["model"] is not None:
            self.model = Model(kept["model"][0], kept["model"][1])
        self.lowest, self.collecting = kept["lowest"], kept["collecting"]
        self.temporary, self.publish_at = kept["temporary"], kept["publish_at"]
        self.published = set(kept["published"])
        self.window.restore(kept["window"])
        self.places = dict(kept["places"])

    # -- feeding ----------------------------------------------------------

    def feed(self, X: np.ndarray, y: np.ndarray, default: np.ndarray | None = None):
        """Take the next rows; returns predictions and ``(offset, model)`` runs.

        Rows of the burn-in get ``default``, one value a row, or the one of the settings.
        """
        n = len(y)
        p, runs = np.empty(n), []
        first = self.seen + 1
        buffer_x = X if self.x is None else np.vstack([self.x, X])
        buffer_y = np.concatenate([self.y, y])
        head = len(self.y)
        at, block = 0, self.cfg.window
        while at < n:
            runs.append((at, self.current))
            here = head + at
            if self.seen < self.cfg.window:
                take = min(self.cfg.window - self.seen, n - at)
                p[at:at + take] = self.cfg.default if default is None else default[at:at + take]
                self.seen += take
                at += take
                continue
            if self.current is None:
                self._first_model(buffer_x[:here], buffer_y[:here])
                runs[-1] = (at, self.current)
                p[at] = self.model.predict(buffer_x[here:here + 1])[0]
                self.seen += 1
                at += 1
                self._publish_from(self.seen + 1, 0)
                continue
            take = min(block, n - at)
            if self.collecting is not None:
                take = min(take, self._milestone())
            p[at:at + take] = self.model.predict(buffer_x[here:here + take])
            done, handle = self._scan(buffer_x, buffer_y, p[at:at + take], here, take)
            self.seen += done
            self._watched(buffer_x, buffer_y, here + done)
            self._pass_publish()
            at += done
            block = self.cfg.window if handle else min(2 * block, BLOCK)
            if handle:
                handle(buffer_x[:head + at], buffer_y[:head + at])
        keep = self.cfg.window
        self.x, self.y = buffer_x[-keep:].copy(), buffer_y[-keep:].copy()
        return first, p, runs

    def _watched(self, X, y, end: int) -> None:
        """Rows up to place ``end`` of the buffers have been predicted; what follows them is not yet decided."""

    def _drifted(self, X, y, newer: int) -> None:
        """The model in use has drifted on its last ``newer`` rows and is about to be changed."""

    def _fit(self, X, y) -> Model:
        w, b = self.learner(X, y)
        pcs = None
        if self.cfg.components:
            pcs = linalg.components(linalg.Moments.of_rows(X, y), self.cfg.left_out).T.tolist()
        return Model([float(v) for v in w], float(b), pcs=pcs)

    def _emit(self, kind: str, seq: int, model_id: str, model: Model | None = None, **more) -> None:
        row = {"kind": kind, "seq": seq, "model_id": model_id, **more}
        if model is not None:
            row.update(coef=[float(v) for v in model.coef], intercept=float(model.intercept), pcs=model.pcs)
        self.events.append(row)

    def _first_model(self, X, y) -> None:
        w = self.cfg.window
        model = self._fit(X[-w:], y[-w:])
        self.current = self.memory.learn(model, None)
        self.model = model
        self.memory.start(self.current, w + 2)
        self.lowest = w + 2
        self._emit("learn", w + 1, self.current, model)

    def name_rows(self, first: int, given: np.ndarray) -> None:
        """Put the rows' given numbers into the events of the rows just fed, the first of which was the ``first``."""
        last = first + len(given) - 1

        def place(n):
            if n is None or n < first:
                return self.places.get(n, n)
            return int(given[n - first]) if n <= last else int(given[-1]) + n - last
        for e in self.events:
            for k in ("seq", "start_seq", "end_seq"):
                if k in e:
                    e[k] = place(e[k])
        begun = self.memory.runs[-1][1] if self.memory.runs else None
        self.places = {n: place(n) for n in (begun, last) if n is not None and n <= last}

    # -- publishing -------------------------------------------------------

    def _publish_from(self, seq: int, used: int) -> None:
        """A model is published once it has been in use for the stable number of rows."""
        self.publish_at = None
        if self.current not in self.published:
            self.publish_at = seq + max(self.cfg.stable - used, 0)

    def _pass_publish(self) -> None:
        if self.publish_at is not None and self.seen >= self.publish_at:
            self._emit("publish", self.publish_at, self.current, self.memory.models[self.current])
            self.published.add(self.current)
            self.publish_at = None

    # -- detection --------------------------------------------------------

    def _scan(self, X, y, p, here: int, take: int):
        """Rows used up to the next event, and what to do then."""
        if self.collecting is not None:
            reached = self.seen + take - self.collecting + 1
            if reached >= self.cfg.window:
                return take, self._window_full
            if self.cfg.detector == "combined" and reached == self.cfg.window // 2:
                return take, self._half_full
            return take, None
        if self.cfg.detector == "windowed":
            return self._scan_windows(X, y, here, take)
        add = self.window.add
        for i, error in enumerate(np.abs(p - y[here:here + take]).tolist()):
            cut = add(error)
            if cut:
                return i + 1, lambda X, y: self._cut(X, y, cut[0])
        return take, None

    def _scan_windows(self, X, y, here: int, take: int):
        w = self.cfg.window
        low = here - w + 1
        offset = self.seen - here + 1          # seq of buffer row i is i + offset
        span = slice(low, here + take)
        fit, truth = self.model.predict(X[span]), y[span]
        starts = np.arange(take) + low
        opened = (np.abs(fit - truth)[:take] > self.cfg.eps) & (starts + offset >= self.lowest)
        picked = np.flatnonzero(opened)
        if not len(picked):
            return take, None
        squares, at, piece = (fit - truth) ** 2, 0, 4
        while at < len(picked):         # few windows at first: where drifts are close, the rest is not looked at
            frames = picked[at:at + piece, None] + np.arange(w)
            errors, labels = squares[frames], truth[frames]
            residual = errors.sum(axis=1)
            total = ((labels - labels.mean(axis=1, keepdims=True)) ** 2).sum(axis=1)
            flat = labels.min(axis=1) == labels.max(axis=1)
            with np.errstate(divide="ignore", invalid="ignore"):
                r2 = np.where(flat, (residual == 0.0).astype(float), 1.0 - residual / total)
            bad = np.flatnonzero(r2 < self.cfg.acc)
            if len(bad):
                return int(picked[at + bad[0]]) + 1, self._window_drift
            at, piece = at + piece, 8 * piece
        return take, None

    def _window_drift(self, X, y) -> None:
        self._emit("drift", self.seen, self.current, n=self.cfg.window)
        self._drifted(X, y, self.cfg.window)
        self._next(X[-self.cfg.window:], y[-self.cfg.window:])
        self.lowest = self.seen - self.cfg.window + 2

    def _cut(self, X, y, newer: int) -> None:
        w = self.cfg.window
        self._emit("drift", self.seen, self.current, n=newer)
        self._drifted(X, y, newer)
        if newer >= w:
            self._next(X[-w:], y[-w:])
            return
        rows, labels = X[-newer:], y[-newer:]
        if self.cfg.detector == "combined" and newer >= w / 2:
            if self.memory.reusable(rows, labels, self.cfg):
                self._next(rows, labels)
                return
            self._temporary(rows, labels)
        self.collecting = self.seen - newer + 1

    def _milestone(self) -> int:
        """Rows until the collected window is checked again."""
        length = self.seen - self.collecting + 1
        half = self.cfg.window // 2
        goal = half if self.cfg.detector == "combined" and length < half else self.cfg.window
        return max(goal - length, 1)

    def _half_full(self, X, y) -> None:
        half = self.cfg.window // 2
        self._temporary(X[-half:], y[-half:])

    def _window_full(self, X, y) -> None:
        self.collecting = None
        self._next(X[-self.cfg.window:], y[-self.cfg.window:])

    # -- change of model --------------------------------------------------

    def _close(self) -> str:
        model_id, start, length = self.memory.close(self.seen - 1)
        self._emit("segment", self.seen, model_id, start_seq=start, end_seq=self.seen - 1, n=length)
        return self.memory.settle(length, self.cfg.stable)

    def _temporary(self, X, y) -> None:
        """Use a model of a half-full window until the window is full."""
        self._close()
        self.current, self.temporary, self.publish_at = f"temp{self.seen}", True, None
        self.model = self._fit(X, y)
        self._emit("temporary", self.seen, self.current, self.model)

    def _next(self, X, y) -> None:
        memory, cfg = self.memory, self.cfg
        # after a temporary model the transition leaves from the newest own model
        source = str(memory.own - 1) if self.temporary else self._close()
        chosen = None if cfg.detector == "adaptive" else memory.choose(source, X, y, cfg)
        if chosen is None:
            chosen = memory.learn(self._fit(X, y), source)
            self._emit("learn", self.seen, chosen, memory.models[chosen])
        else:
            memory.repeat(chosen, source)
            self._emit("reuse", self.seen, chosen, memory.models[chosen])
        memory.start(chosen, self.seen)
        memory.forget(cfg.stable)
        self.current, self.model, self.temporary = chosen, memory.models[chosen], False
        self.window = self._detector()
        used = 0 if cfg.detector == "windowed" else self.model.used_for
        self._publish_from(self.seen + 1, used)

    def finish(self) -> None:
        """Close the last run and report the transitions."""
        if self.memory.open:
            model_id, start, length = self.memory.close(self.seen)
            self._emit("segment", self.seen, model_id, start_seq=start, end_seq=self.seen, n=length)

    def transitions(self) -> None:
        for a, row in self.memory.moves.items():
            for b, n in row.items():
                if n:
                    self._emit("transition", self.seen, a, n=n, state=b)


# -- output batches -----------------------------------------------------------

def row_columns(seq, y, p, runs) -> dict:
    names = np.empty(len(y), dtype=object)
    for (start, model), (stop, _) in zip(runs, runs[1:] + [(len(y), None)]):
        names[start:stop] = model
    return {"seq": seq, "y": y, "p": p, "model_id": names}


def to_batch(domain: str, columns: dict, kind: str | None, size: int, schema: pa.Schema) -> pa.RecordBatch:
    arrays = []
    for f in schema:
        if f.name == "domain":
            arrays.append(pa.repeat(pa.scalar(domain, f.type), size))
        elif f.name == "kind" and kind:
            arrays.append(pa.repeat(pa.scalar(kind, f.type), size))
        elif f.name in columns:
            arrays.append(pa.array(columns[f.name], type=f.type))
        else:
            arrays.append(pa.nulls(size, f.type))
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def event_batch(domain: str, events: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    names = [f.name for f in schema if f.name != "domain"]
    return to_batch(domain, {k: [e.get(k) for e in events] for k in names}, None, len(events), schema)


END = "end"         # state of the mark behind the last row of a stream that goes on from epoch to epoch


def _grouped(cfg, with_state: bool):
    """``cfg`` is one configuration, or a function that gives each stream its own."""
    schema = to_arrow_schema(OUTPUT)
    registered = dict(linalg.REGISTERED)

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loop, domain, ended = None, None, not with_state
        for batch in batches:
            names = batch.schema.names
            if batch.num_rows == 0:
                continue
            if with_state and batch.column(names.index("state"))[batch.num_rows - 1].as_py() == END:
                ended = True
                batch = batch.slice(0, batch.num_rows - 1)
                if batch.num_rows == 0:
                    continue
            if loop is None:
                domain = batch.column(names.index("domain"))[0].as_py()
                kept = None
                if with_state:
                    kept = batch.column(names.index("state"))[0].as_py()
                    if kept is not None:
                        batch = batch.slice(1)
                loop = StreamLoop(cfg(domain) if callable(cfg) else cfg, kept, registered)
                if batch.num_rows == 0:
                    continue
            y = batch.column(names.index("y")).to_numpy(zero_copy_only=False)
            x = batch.column(names.index("features")).flatten().to_numpy(zero_copy_only=False)
            given = batch.column(names.index("seq")).to_numpy(zero_copy_only=False)
            default = None
            if "default" in names:
                default = batch.column(names.index("default")).to_numpy(zero_copy_only=False)
            first, p, runs = loop.feed(x.reshape(len(y), -1), y, default)
            loop.name_rows(first, given)
            yield to_batch(domain, row_columns(given, y, p, runs), "row", len(y), schema)
            if loop.events:
                yield event_batch(domain, loop.events, schema)
                loop.events = []
        if loop is None:
            return
        if ended:
            loop.finish()
            loop.transitions()
            for e in loop.events:
                for k in ("seq", "start_seq", "end_seq"):
                    if k in e:
                        e[k] = loop.places.get(e[k], e[k])
        else:
            loop._emit("state", loop.seen, loop.current, state=loop.dump())
        if loop.events:
            yield event_batch(domain, loop.events, schema)
    return one


def in_order(rows: DataFrame, n: int) -> DataFrame:
    """Streams of ``n`` rows in all in order, hashed to as many tasks as rows need.

    The number is given because Python work per byte is high: sizing tasks by
    shuffle bytes alone would leave most cores idle.
    """
    return rows.repartition(tasks_for(rows.sparkSession, n), "domain").sortWithinPartitions("domain", "seq")


def _inputs(stream: DataFrame) -> list[str]:
    return ["domain", "seq", "features", "y"] + (["default"] if "default" in stream.columns else [])


def run(stream: DataFrame, cfg: LoopConfig | Callable[[str], LoopConfig]) -> DataFrame:
    """Loop over ``domain, seq, features, y``: rows, events and transitions by ``kind``.

    A column ``default``, if there is one, predicts the rows of the burn-in.

    One shuffle by stream and one external sort; a task then reads its streams
    in order, batch by batch, and holds one window of rows and the memory.
    """
    ordered = in_order(stream.select(*_inputs(stream)), stream.count())
    return ordered.groupBy("domain").applyInArrow(_grouped(cfg, False), OUTPUT)


def run_in_epochs(stream: DataFrame, cfg: LoopConfig, epoch_rows: int) -> DataFrame:
    """Same result, in jobs that see at most ``epoch_rows`` numbers of a stream.

    State moves from epoch to epoch through tables in shared storage, so no
    task is larger than an epoch and a failure costs at most one epoch. Numbers
    may have gaps: only epochs with rows are run.
    """
    spark = stream.sparkSession
    parts = staged(stream.select(*_inputs(stream))
                   .withColumn("epoch", F.floor((F.col("seq") - 1) / epoch_rows).cast("int")), "epoch")
    ends = staged(parts.groupBy("domain").agg(F.max("epoch").alias("epoch")))
    # two numbers for each epoch
    epochs = sorted((r["epoch"], r["count"]) for r in parts.groupBy("epoch").count().collect())
    state = None
    folder = new_folder(spark)
    none = F.lit(None).cast("string").alias("state")
    for epoch, n in epochs:
        rows = parts.filter(F.col("epoch") == epoch).drop("epoch").select("*", none)
        # the mark of a stream's end sorts behind its rows, the kept state in front of them
        marks = ends.filter(F.col("epoch") == epoch).select(
            "domain", F.lit(1 << 62).cast("bigint").alias("seq"), F.lit(END).alias("state"))
        rows = rows.unionByName(marks, allowMissingColumns=True)
        if state is not None:
            carried = state.select("domain", F.lit(-(1 << 62)).cast("bigint").alias("seq"), "state")
            rows = rows.unionByName(carried, allowMissingColumns=True)
        done = in_order(rows, n).groupBy("domain").applyInArrow(_grouped(cfg, True), OUTPUT)
        path = f"{folder}/epoch={epoch}"
        done.write.partitionBy("kind").parquet(path)
        state = spark.read.schema(OUTPUT).parquet(path).filter(F.col("kind") == "state").select("domain", "state")
    if state is None:
        return spark.createDataFrame([], OUTPUT)
    whole = spark.read.schema(OUTPUT).parquet(folder)
    return whole.filter(F.col("kind") != "state").select(*OUTPUT.names)


def run_bounded(stream: DataFrame, cfg: LoopConfig, epoch_rows: int = 500_000) -> DataFrame:
    """The loop in epochs, whatever the length of the streams; short ones take a single epoch."""
    return run_in_epochs(stream, cfg, epoch_rows)


def rows_of(result: DataFrame) -> DataFrame:
    return result.filter(F.col("kind") == "row").select("domain", "seq", "model_id", "y", "p")


def models_of(result: DataFrame) -> DataFrame:
    return result.filter(F.col("kind") == "learn").select("domain", "model_id", "seq", "coef", "intercept", "pcs")


def segments_of(result: DataFrame) -> DataFrame:
    return result.filter(F.col("kind") == "segment").select(
        "domain", "model_id", "start_seq", "end_seq", F.col("n").alias("length"))


def published_of(result: DataFrame) -> DataFrame:
    return result.filter(F.col("kind") == "publish").select(
        "domain", "model_id", "seq", "coef", "intercept", "pcs")


def transitions_of(result: DataFrame) -> DataFrame:
    return result.filter(F.col("kind") == "transition").select(
        "domain", F.col("model_id").alias("from_id"), F.col("state").alias("to_id"), "n")


