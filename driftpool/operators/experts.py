"""Ensembles whose members join, decay with their errors and leave.

Only joins depend on each other. Sums of errors between joins are window work
over all rows; the recursion runs over the few joins of a stream, and every
row then takes its weights from closed form.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from driftpool.functions import batches
from driftpool.plans import config
from driftpool.plans.sequence import CHUNK_ROWS, tasks_for
from driftpool.session import join_bounded, staged


def in_spans(rows: DataFrame, spans: DataFrame, keys: list[str], chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Rows with the span ``[start_seq, end_seq]`` they fall in; spans of a key do not overlap.

    Spans are listed once per chunk of ``seq`` they touch and take their place
    among its rows; a row belongs to the last span that began. No row meets
    more than one span, however short the spans are.
    """
    listed = spans.withColumn("_chunk", F.explode(F.sequence(
        F.floor(F.col("start_seq") / chunk_rows), F.floor(F.col("end_seq") / chunk_rows))))
    listed = listed.select(*keys, "_chunk", F.greatest("start_seq", F.col("_chunk") * chunk_rows).alias("_at"),
                           F.struct(*[c for c in spans.columns if c not in keys]).alias("_span"))
    placed = rows.select(*keys, F.floor(F.col("seq") / chunk_rows).alias("_chunk"), F.col("seq").alias("_at"),
                         F.struct(*[c for c in rows.columns if c not in keys]).alias("_row"))
    both = placed.withColumn("_span", F.lit(None).cast(listed.schema["_span"].dataType)).unionByName(
        listed.withColumn("_row", F.lit(None).cast(placed.schema["_row"].dataType)))
    order = (Window.partitionBy(*keys, "_chunk").orderBy("_at", F.col("_row").isNotNull())
             .rowsBetween(Window.unboundedPreceding, 0))
    found = both.withColumn("_span", F.last("_span", True).over(order))
    return found.filter("_row IS NOT NULL AND _at <= _span.end_seq").select(*keys, "_row.*", "_span.*")


def group_choice(pairs: DataFrame, spans: DataFrame, cut: int, least_rows: int,
                 chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Best model of a similarity group over each run of a model, without the run's drifted tail.

    ``pairs`` holds predictions ``domain, seq, member, y, p`` of the group while
    ``spans`` (``domain, model_id, start_seq, end_seq``) were in use. A run
    whose best member is another model is substituted by it; otherwise its
    delayed sends are released.
    """
    from driftpool.functions import metrics
    used = spans.select("domain", "model_id", "start_seq", (F.col("end_seq") - cut).alias("end_seq")).filter("end_seq >= start_seq")
    scored = (in_spans(pairs, used, ["domain"], chunk_rows)
              .groupBy("domain", "model_id", "start_seq", "member")
              .agg(F.count("*").alias("n"), metrics.r2("y", "p").alias("r2")).filter(F.col("n") >= least_rows))
    best = F.max_by(F.struct("member", "r2"), F.struct("r2", "member"))
    return (scored.groupBy("domain", "model_id", "start_seq").agg(best.alias("_b"))
            .select("domain", "model_id", "start_seq", F.col("_b.member").alias("best_id"), "_b.r2",
                    (F.col("_b.member") != F.col("model_id")).alias("substitute")))


def closest_model(wide: DataFrame, keys: list[str], ids: list[str], target: str) -> DataFrame:
    """Model whose predictions differ least, at their worst row, from the target's."""
    t = F.col("preds")[ids.index(target)]
    others = [i for i, name in enumerate(ids) if name != target]
    worst = wide.groupBy(*keys).agg(*[F.max(F.abs(F.col("preds")[i] - t)).alias(f"_d{i}") for i in others])
    listed = F.array(*[F.struct(F.col(f"_d{i}").alias("max_diff"), F.lit(ids[i]).alias("model_id")) for i in others])
    return worst.select(*keys, F.array_min(listed).alias("_b")).select(*keys, "_b.model_id", "_b.max_diff")


SPANS = "domain string, model_id string, start_seq bigint, end_seq bigint, log_weight double, base double"


def _recursion(evict: str, size: int):
    """Weights of the members over the periods between joins.

    Records of a stream come in order: the joins of a row, then what each
    model lost in the period that begins there. Only members are held.
    """
    decay = math.log(config.DECAY)
    schema = pa.schema([("domain", pa.string()), ("model_id", pa.string()), ("start_seq", pa.int64()),
                        ("end_seq", pa.int64()), ("log_weight", pa.float64()), ("base", pa.float64())])

    def run(source):
        stream, at, weights, joined, last, spent = object(), None, {}, {}, {}, {}
        for batch in source:
            out = []
            for r in batch.to_pylist():
                if r["domain"] != stream:
                    stream, at, weights, joined, last, spent = r["domain"], None, {}, {}, {}, {}
                if r["at"] != at:
                    weights = {k: w + decay * spent.get(k, (0.0, 0.0))[0] for k, w in weights.items()}
                    last = {k: spent.get(k, (0.0, 0.0))[1] for k in weights}
                    at, spent = r["at"], {}
                k = r["model_id"]
                if r["joins"]:
                    while len(weights) > size - 1:
                        gone = min(weights, key=(lambda m: (joined[m], m)) if evict == "oldest" else (lambda m: (weights[m], m)))
                        del weights[gone], joined[gone], last[gone]
                    share = config.ADD_WEIGHT * (sum(math.exp(w) * last[m] for m, w in weights.items()) + r["last"])
                    weights[k] = math.log(share) if weights and share > 0 else 0.0
                    joined[k], last[k] = at, r["last"]
                elif k in weights:
                    spent[k] = (r["spent"], r["last"])
                    out.append((stream, k, at, r["end_seq"], weights[k], r["base"]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
    return run


BEFORE = -(1 << 62)     # start of the rows before the first join
HELD_ROWS = 100_000
FEW_SPANS, BLOCKS = 16, 128     # a chunk of more spans is cut into blocks
PACKED = ("domain string, _chunk bigint, seq array<bigint>, member array<int>, w array<double>, y array<double>, "
          "p array<double>")


def _in_blocks(rows: DataFrame, spans: DataFrame, keys: list[str], chunk_rows: int) -> DataFrame:
    """``rows`` with the one of the ``spans`` of their keys and chunk that holds them, as ``_span``; others are left out.

    Spans are listed by chunk, a side that is small enough to be broadcast, so the rows stay where they are. A chunk of
    many spans lists them by block, and a row meets those of its block only.
    """
    place = [*keys, "_chunk"]
    low = F.col("_chunk") * chunk_rows
    step = F.when(F.count("*").over(Window.partitionBy(*place)) <= FEW_SPANS, chunk_rows).otherwise(
        max(chunk_rows // BLOCKS, 1))
    block = lambda seq: F.floor((seq - low) / F.col("_step")).cast("int")
    listed = spans.withColumn("_span", F.struct(*[c for c in spans.columns if c not in place])).withColumn("_step", step)
    listed = listed.withColumn("_block", F.explode(F.sequence(
        block(F.greatest("at", low)), block(F.least(F.col("end_seq"), low + chunk_rows - 1)))))
    listed = listed.groupBy(*place, "_step", "_block").agg(F.array_sort(F.collect_list("_span")).alias("_spans"))
    listed = listed.groupBy(*place, "_step").agg(F.collect_list(F.struct("_block", "_spans")).alias("_listed"),
                                                 F.max("_block").alias("_last"))
    of_block = lambda b: F.get(F.filter("_listed", lambda x: x["_block"] == b), F.lit(0))["_spans"]
    listed = listed.select(*place, "_step", F.transform(F.sequence(F.lit(0), "_last"), of_block).alias("_blocks"))
    inside = lambda x: (x["at"] <= F.col("seq")) & (F.col("seq") <= x["end_seq"])
    met = join_bounded(rows, listed, place, max_rows=1_000_000)
    return (met.withColumn("_span", F.get(F.filter(F.get("_blocks", block(F.col("seq"))), inside), F.lit(0)))
            .filter("_span IS NOT NULL").drop("_step", "_blocks"))


def _pieces(pairs: DataFrame, joins: DataFrame, chunk_rows: int) -> DataFrame:
    """What each model loses in each period between joins, by chunk of ``seq``: sums that combine before their shuffle."""
    ends = pairs.groupBy("domain").agg(F.max("seq").alias("_end"))
    starts = joins.select("domain", F.col("at").alias("start_seq")).filter("start_seq IS NOT NULL").distinct()
    starts = starts.unionByName(starts.select("domain", F.lit(BEFORE).cast("bigint").alias("start_seq")).distinct())
    after = F.lead("start_seq").over(Window.partitionBy("domain").orderBy("start_seq")) - 1
    periods = (starts.withColumn("_next", after).join(ends, "domain")
               .select("domain", "start_seq", F.coalesce("_next", "_end").alias("end_seq"), F.least("_next", "_end").alias("_to"))
               .filter("start_seq <= _to"))
    first = F.floor(F.greatest("start_seq", F.lit(0)) / chunk_rows)
    last = F.floor(F.col("_to") / chunk_rows)
    listed = (periods.filter(first <= last).withColumn("_chunk", F.explode(F.sequence(first, last)))
              .select("domain", "_chunk", F.col("start_seq").alias("at"), "end_seq"))
    placed = _in_blocks(pairs, listed, ["domain"], chunk_rows)
    return (placed.select("domain", "model_id", "_chunk", F.col("_span.at").alias("at"),
                          F.col("_span.end_seq").alias("end_seq"), "seq", "e")
            .groupBy("domain", "model_id", "_chunk", "at", "end_seq")
            .agg(F.sum("e").alias("spent"), F.sum(F.when(F.col("seq") == F.col("end_seq"), F.col("e")).otherwise(0.0)).alias("last"),
                 F.min("seq").alias("first_seq"), F.min_by(F.col("e").isNull(), "seq").alias("blank"), F.count("*").alias("n")))


def _packed(source):
    """Rows of a task as lists by stream and chunk: what is shuffled is little more than the predictions."""
    names = ["seq", "member", "w", "y", "p"]
    types = [pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.float64()]

    def packed(held):
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        found = list(batches.groups(rows, ["domain", "_chunk"]))
        order = pa.array(np.concatenate([at for _, at in found]))
        offsets = pa.array(np.cumsum([0] + [len(at) for _, at in found]), pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, rows.column(n).take(order).cast(t)) for n, t in zip(names, types)]
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in found], pa.string()),
                                           pa.array([k[1] for k, _ in found], pa.int64()), *lists], ["domain", "_chunk", *names])

    held, size = [], 0
    for batch in source:
        if batch.num_rows:
            held.append(batch)
            size += batch.num_rows
        if size > HELD_ROWS:
            yield packed(held)
            held, size = [], 0
    if held:
        yield packed(held)


def _weighted(decay: float):
    """Prediction of every row of a chunk by its members' weights, which fall along the chunk; one chunk is open at a time."""
    def scored(domain, parts):
        seq, member, w, y, p = (pa.concat_arrays([r[i] for r in parts]) for i in range(5))
        no_y, blank = (c.is_null().to_numpy(zero_copy_only=False) for c in (y, w))
        missing = no_y | p.is_null().to_numpy(zero_copy_only=False)
        seq, member, w, y, p = (c.to_numpy(zero_copy_only=False) for c in (seq, member, w, y, p))
        with np.errstate(all="ignore"):
            e, w = np.where(missing, 0.0, np.abs(p - y)), w.copy()
            order = np.lexsort((seq, member))
            for rows in np.split(order, np.flatnonzero(np.diff(member[order])) + 1):
                w[rows] += decay * np.append(0.0, np.cumsum(e[rows])[:-1])
            order = np.argsort(seq, kind="stable")
            starts = np.flatnonzero(np.append(True, np.diff(seq[order]) > 0))
            members = np.diff(np.append(starts, len(seq)))
            w, p = w[order], p[order]
            v = np.exp(w - np.repeat(np.maximum.reduceat(w, starts), members))
            value = np.add.reduceat(v * p, starts) / np.add.reduceat(v, starts)
        lacking = np.logical_or.reduceat((missing | blank)[order], starts)
        first = order[starts]
        return pa.RecordBatch.from_arrays(
            [pa.array([domain] * len(first), pa.string()), pa.array(seq[first]), pa.array(y[first], pa.float64(), mask=no_y[first]),
             pa.array(value, pa.float64(), mask=lacking), pa.array(members, pa.int32())], ["domain", "seq", "y", "p", "members"])

    def run(source):
        key, parts = None, []
        for batch in source:
            for i in range(batch.num_rows):
                at = (batch.column(0)[i].as_py(), batch.column(1)[i].as_py())
                if at != key and parts:
                    yield scored(key[0], parts)
                    parts = []
                key = at
                parts.append([batch.column(c)[i].values for c in range(2, 7)])
        if parts:
            yield scored(key[0], parts)
    return run


def add_experts(pairs: DataFrame, joins: DataFrame, evict: str = "oldest", size: int = config.MAX_ENSEMBLE,
                chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Prediction of every row by the members of that row, weighted by their decayed errors.

    ``pairs`` holds ``domain, seq, model_id, y, p``; ``joins`` holds ``domain,
    model_id, at``. A member's weight falls by ``decay^|error|`` per row; one
    that joins gets a share of the pool's weighted loss on the row before; a
    full pool first drops its ``oldest`` or ``weakest`` member. Weights are
    kept as logarithms, so long streams do not underflow. A model needs pairs
    only for rows at which it predicts; it loses nothing on others. Errors are
    summed by period between joins, and the recursion reads these sums in
    order, so its memory is that of one pool however often models join. Sums
    by chunk and period are all that is written; the pairs are read again for
    the predictions, and those of members are shuffled once, as lists.
    """
    if evict not in ("oldest", "weakest"):
        raise ValueError("evict must be oldest or weakest")
    decay = math.log(config.DECAY)
    # pairs without a name or place belong to no stream
    pairs = pairs.filter("domain IS NOT NULL AND model_id IS NOT NULL AND seq IS NOT NULL").select(
        F.col("domain").cast("string").alias("domain"), F.floor(F.col("seq") / chunk_rows).alias("_chunk"),
        F.col("seq").cast("bigint").alias("seq"), "model_id", F.col("y").cast("double").alias("y"),
        F.col("p").cast("double").alias("p"), F.abs(F.col("p") - F.col("y")).cast("double").alias("e"))
    joins = staged(joins.select(F.col("domain").cast("string").alias("domain"), "model_id",
                                F.col("at").cast("bigint").alias("at")).distinct())
    pieces = staged(_pieces(pairs, joins, chunk_rows))
    begun = pieces.filter(F.col("at") > BEFORE)
    lost = (begun.groupBy("domain", "at", "model_id")
            .agg(F.first("end_seq").alias("end_seq"), F.coalesce(F.sum("spent"), F.lit(0.0)).alias("spent"),
                 F.coalesce(F.sum("last"), F.lit(0.0)).alias("last"),
                 F.when(~F.min_by("blank", "first_seq"), 0.0).alias("base"))
            .select("domain", "at", F.lit(False).alias("joins"), "model_id", "end_seq", "spent", "last", "base"))
    before = pieces.groupBy("domain", "model_id", (F.col("end_seq") + 1).alias("at")).agg(F.sum("last").alias("last"))
    joining = (joins.join(before, ["domain", "model_id", "at"], "left")
               .select("domain", "at", F.lit(True).alias("joins"), "model_id", F.lit(None).cast("bigint").alias("end_seq"),
                       F.lit(0.0).alias("spent"), F.coalesce("last", F.lit(0.0)).alias("last"), F.lit(0.0).alias("base")))
    records = (joining.unionByName(lost)
               .repartition("domain").sortWithinPartitions("domain", "at", F.desc("joins"), "model_id"))
    spans = records.mapInArrow(_recursion(evict, size), SPANS).withColumnRenamed("start_seq", "at").drop("end_seq")
    earlier = (Window.partitionBy("domain", "model_id", "at").orderBy("_chunk")
               .rowsBetween(Window.unboundedPreceding, -1))
    weighed = (begun.withColumn("_spent", F.coalesce(F.sum("spent").over(earlier), F.lit(0.0)))
               .join(spans, ["domain", "model_id", "at"])
               .withColumn("w", F.col("log_weight") + decay * F.col("_spent") + F.col("base"))
               .withColumn("member", F.row_number().over(Window.partitionBy("domain", "_chunk").orderBy("at", "model_id"))))
    weighed = staged(weighed.select("domain", "model_id", "_chunk", "at", "end_seq", "w", "member", "n"))
    many = weighed.agg(F.sum("n")).first()[0] or 0      # one number
    held = _in_blocks(pairs.drop("e"), weighed.drop("n"), ["domain", "model_id"], chunk_rows).select(
        "domain", "_chunk", "seq", F.col("_span.member").alias("member"), F.col("_span.w").alias("w"), "y", "p")
    chunks = (held.mapInArrow(_packed, PACKED).repartition(tasks_for(pairs.sparkSession, many), "domain", "_chunk")
              .sortWithinPartitions("domain", "_chunk"))
    return chunks.mapInArrow(_weighted(decay), "domain string, seq bigint, y double, p double, members int")
