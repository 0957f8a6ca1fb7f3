"""Model pools of streams, and how models travel between them, as tables.

Tables: ``edge(src, dst)``, ``registry(source, model_id, epoch)``,
``delivery(target, model_id, epoch)``, ``replacement(target, model_id, sub_id)``.
A model published in epoch ``e`` is visible from ``e + 1`` on. Topologies are
edge tables, so exchange costs what the edges cost; no operator pairs all
streams unless the caller asks for the complete graph.
"""

import math

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from driftpool.plans import config
from driftpool.session import join_bounded, staged


def complete_edges(domains: DataFrame) -> DataFrame:
    """All ordered pairs of the streams: the complete graph is asked for, so its size is the caller's choice.

    Streams are numbered by hash bucket, then paired by an equality join on
    their numbers. ``unread_counts`` does without the pairs.
    """
    names = staged(domains.select("domain").distinct().withColumn("part", F.pmod(F.xxhash64("domain"), F.lit(256))))
    sizes = names.groupBy("part").agg(F.count("*").alias("n"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)      # at most 256 rows
    sizes = sizes.select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("domain")
    placed = staged(names.join(sizes, "part").select(
        "domain", (F.col("base") + F.row_number().over(inside) - 1).alias("place")))
    n = placed.count()
    steps = placed.select(F.col("domain").alias("src"), F.explode(F.sequence(F.lit(1), F.lit(max(n - 1, 1)))).alias("step"), "place")
    shifted = steps.select("src", ((F.col("place") + F.col("step")) % n).alias("place"))
    return (shifted.join(placed.withColumnRenamed("domain", "dst"), "place")
            .filter("src <> dst").select("src", "dst"))


def unread_counts(registry: DataFrame, marks: DataFrame) -> DataFrame:
    """Unread models per target when every stream reads every other one.

    ``marks(target, epoch)`` is the last epoch a target has read. Counts by
    epoch replace the pairs of streams and models.
    """
    epochs = (registry.select("epoch", F.lit(1).alias("n"))
              .unionByName(marks.select("epoch", F.lit(0).alias("n")).distinct()))
    later = Window.orderBy("epoch").rowsBetween(1, Window.unboundedFollowing)
    # one row per epoch, so this window is as short as the run had epochs
    after = (epochs.groupBy("epoch").agg(F.sum("n").alias("n"))
             .select("epoch", F.coalesce(F.sum("n").over(later), F.lit(0)).alias("all_after")))
    own = (registry.select(F.col("source").alias("target"), F.col("epoch").alias("_e"))
           .join(marks, "target").filter(F.col("_e") > F.col("epoch"))
           .groupBy("target").agg(F.count("*").alias("own_after")))
    return (marks.join(after, "epoch").join(own, "target", "left")
            .select("target", (F.col("all_after") - F.coalesce("own_after", F.lit(0))).alias("unread")))


def inbox(registry: DataFrame, edges: DataFrame) -> DataFrame:
    """Models offered to each target by its neighbours."""
    return edges.join(registry.withColumnRenamed("source", "src"), "src").select(
        F.col("dst").alias("target"), "src", "model_id", "epoch")


def pending(registry: DataFrame, edges: DataFrame, delivery: DataFrame, replacement: DataFrame) -> DataFrame:
    """Deliveries still due: offered, not delivered, not replaced."""
    offered = inbox(registry, edges)
    return (offered.join(delivery, ["target", "model_id"], "left_anti")
            .join(replacement, ["target", "model_id"], "left_anti"))


def held_by_all(registry: DataFrame, edges: DataFrame, delivery: DataFrame) -> DataFrame:
    """Whether all neighbours of a model's source already hold it."""
    got = delivery.select("target", "model_id", F.lit(True).alias("held"))
    offered = inbox(registry, edges).join(got, ["target", "model_id"], "left")
    return offered.groupBy("model_id").agg(
        F.count("*").alias("neighbours"), F.bool_and(F.coalesce("held", F.lit(False))).alias("held_by_all"))


def delayed_split(registry: DataFrame, edges: DataFrame, similar: DataFrame, delivery: DataFrame) -> DataFrame:
    """Per neighbour: delay the model if it already holds, or owns, a similar one."""
    offered = inbox(registry, edges)
    close = offered.join(similar, "model_id")
    source = F.substring_index("similar_id", "-", 1)
    holding = close.join(delivery.select("target", F.col("model_id").alias("similar_id")),
                         ["target", "similar_id"], "left_semi").select("target", "model_id")
    owning = close.filter(source == F.col("target")).select("target", "model_id")
    late = holding.unionByName(owning).distinct().withColumn("delayed", F.lit(True))
    return offered.join(late, ["target", "model_id"], "left").select(
        "target", "model_id", F.coalesce("delayed", F.lit(False)).alias("delayed"))


def replacement_split(replaced: DataFrame, edges: DataFrame, delivery: DataFrame) -> DataFrame:
    """Per neighbour of ``replaced(source, model_id, sub_id)``: swap only, or needs the new model."""
    offered = edges.join(replaced.withColumnRenamed("source", "src"), "src").withColumnRenamed("dst", "target")
    got = delivery.select("target", F.col("model_id").alias("sub_id"), F.lit(True).alias("held"))
    owner = F.substring_index("sub_id", "-", 1) == F.col("target")
    return offered.join(got, ["target", "sub_id"], "left").select(
        "target", "model_id", "sub_id", (F.coalesce("held", F.lit(False)) | owner).alias("swap_only"))


def apply_replacement(split: DataFrame, boxes: DataFrame, epoch: int) -> DataFrame:
    """Append a replacement to the inbox log ``(target, model_id, epoch, replaced)``; latest wins."""
    marked = (split.join(boxes.select("target", "model_id").distinct(), ["target", "model_id"], "left_semi")
              .select("target", "model_id", F.lit(epoch).alias("epoch"), F.lit(True).alias("replaced")))
    fresh = (split.filter(~F.col("swap_only"))
             .select("target", F.col("sub_id").alias("model_id"), F.lit(epoch).alias("epoch"),
                     F.lit(False).alias("replaced")).distinct())
    return latest(boxes.unionByName(marked).unionByName(fresh))


def latest(log: DataFrame) -> DataFrame:
    """Newest state of each inbox entry; an entry that arrives again is active again."""
    newest = F.struct("epoch", "replaced")
    return log.groupBy("target", "model_id").agg(F.max(newest).alias("_s")).select("target", "model_id", "_s.*")


def store_received(boxes: DataFrame, arrived: DataFrame) -> DataFrame:
    """Upsert arrivals: the arrival of a replaced model activates it again."""
    return latest_by_arrival(boxes.withColumn("_new", F.lit(0)).unionByName(
        arrived.withColumn("replaced", F.lit(False)).withColumn("_new", F.lit(1))))


def latest_by_arrival(log: DataFrame) -> DataFrame:
    newest = F.struct("epoch", "_new", "replaced")
    return (log.groupBy("target", "model_id").agg(F.max(newest).alias("_s"))
            .select("target", "model_id", "_s.epoch", "_s.replaced"))


def discard_list(replacement: DataFrame, delivery: DataFrame, discarded: DataFrame) -> DataFrame:
    """Replaced and delivered models whose substitute is neither replaced nor discarded."""
    due = replacement.join(delivery.select("target", "model_id"), ["target", "model_id"], "left_semi")
    gone = (replacement.select("target", F.col("model_id").alias("sub_id"))
            .unionByName(discarded.select("target", F.col("model_id").alias("sub_id"))))
    return due.join(gone, ["target", "sub_id"], "left_anti").select("target", "model_id", "sub_id")


def missing_substitutes(replacement: DataFrame, delivery: DataFrame) -> DataFrame:
    """Replacements whose substitute the target neither owns nor has received."""
    foreign = replacement.filter(F.substring_index("sub_id", "-", 1) != F.col("target"))
    return foreign.join(delivery.select("target", F.col("model_id").alias("sub_id")),
                        ["target", "sub_id"], "left_anti").select("target", "model_id", "sub_id")


def resolve_chains(renames: DataFrame) -> DataFrame:
    """Final substitute of each ``(model_id, sub_id)`` and the number of links to it.

    Pointers are doubled: a round joins what is known to itself, so the number
    of rounds grows with the logarithm of the longest chain, and no row grows.
    Models on or before a cycle never end; they are told apart by the round
    limit of the number of renames and walked to where they would repeat, which
    is the model of the cycle reached first (itself for those on it).
    """
    walk = staged(renames.select("model_id", F.col("sub_id").alias("final_id"), F.lit(1).cast("bigint").alias("links")))
    most = walk.count()
    reach = 1
    while reach < most:
        step = walk.select(F.col("model_id").alias("final_id"), F.col("final_id").alias("_next"), F.col("links").alias("_more"))
        went = walk.join(step, "final_id", "left")
        if went.filter("_next IS NOT NULL").isEmpty():
            return walk.select("model_id", "final_id", F.col("links").cast("int").alias("links"))
        walk = staged(went.select("model_id", F.coalesce("_next", "final_id").alias("final_id"),
                                  (F.col("links") + F.coalesce("_more", F.lit(0))).alias("links")))
        reach *= 2
    step = renames.select(F.col("model_id").alias("final_id"))
    ended = walk.join(step, "final_id", "left_anti").select("model_id", "final_id", F.col("links").cast("int").alias("links"))
    turning = walk.join(step, "final_id", "left_semi").select("model_id")
    if turning.isEmpty():
        return ended
    return ended.unionByName(_cycles(renames.join(turning, "model_id", "left_semi")))


def _cycles(renames):
    # models that end in a cycle: after as many steps as there are models every pointer is on its cycle
    step = staged(renames.select("model_id", F.col("sub_id").alias("next")))
    far = step.select("model_id", F.col("next").alias("far"))
    reach, most = 1, step.count()
    while reach < most:
        far = staged(far.join(far.select(F.col("model_id").alias("far"), F.col("far").alias("_to")), "far")
                     .select("model_id", F.col("_to").alias("far")))
        reach *= 2
    on = staged(far.select(F.col("far").alias("node")).distinct())
    # tails walk until they meet the cycle; models on it come back to themselves
    walk = staged(step.select("model_id", F.col("next").alias("final_id"), F.lit(1).alias("links")))
    done = None
    while True:
        met = walk.join(on.select(F.col("node").alias("_on")), F.col("final_id") == F.col("_on"), "left").join(
            on.select(F.col("node").alias("_own")), F.col("model_id") == F.col("_own"), "left")
        stop = F.when(F.col("_own").isNotNull(), F.col("model_id") == F.col("final_id")).otherwise(F.col("_on").isNotNull())
        met = staged(met.withColumn("_stop", stop))
        ended = met.filter("_stop").select("model_id", "final_id", "links")
        done = ended if done is None else done.unionByName(ended)
        left = met.filter("NOT _stop").select("model_id", "final_id", "links")
        if left.isEmpty():
            return done
        walk = staged(left.join(step.select(F.col("model_id").alias("final_id"), "next"), "final_id").select(
            "model_id", F.col("next").alias("final_id"), (F.col("links") + 1).alias("links")))


def mark_discarded(pool: DataFrame, discarded: DataFrame, keys: list[str]) -> DataFrame:
    """Flag pool entries named by a discard message."""
    gone = discarded.select(*keys, "model_id").distinct().withColumn("_gone", F.lit(True))
    return (pool.join(gone, keys + ["model_id"], "left")
            .withColumn("discard", F.coalesce("_gone", F.lit(False))).drop("_gone"))


def drop_discarded(pairs: DataFrame, discarded: DataFrame, keys: list[str]) -> DataFrame:
    """Remove discarded models from both sides of a distance table."""
    gone = discarded.select(*keys, "model_id").distinct()
    return (pairs.join(gone.withColumnRenamed("model_id", "i"), keys + ["i"], "left_anti")
            .join(gone.withColumnRenamed("model_id", "j"), keys + ["j"], "left_anti"))


def keep_newest(pool: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Evict the oldest entries of a full pool (first in, first out)."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("added"), "model_id"))
    return pool.withColumn("_r", place).filter(F.col("_r") <= size).drop("_r")


def keep_best(pool: DataFrame, keys: list[str], size: int, by: str, ascending: bool) -> DataFrame:
    """Evict the weakest entries: lowest weight, or highest error with ``ascending``."""
    order = F.asc(by) if ascending else F.desc(by)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order, "model_id"))
    return pool.withColumn("_r", place).filter(F.col("_r") <= size).drop("_r")


def new_models(received: DataFrame, pool: DataFrame, keys: list[str]) -> DataFrame:
    return received.join(pool.select(*keys, "model_id"), keys + ["model_id"], "left_anti")


def pool_changed(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Whether a stream's pool differs from the one it was clustered with."""
    a = before.select(*keys, "model_id").distinct().withColumn("_a", F.lit(1))
    b = after.select(*keys, "model_id").distinct().withColumn("_b", F.lit(1))
    odd = F.col("_a").isNull() | F.col("_b").isNull()
    return a.join(b, keys + ["model_id"], "full").groupBy(*keys).agg(F.bool_or(odd).alias("recluster"))


def merged_pool(pool: DataFrame, stable_local: DataFrame, keys: list[str]) -> DataFrame:
    """Pool and stable own models without duplicates."""
    columns = keys + ["model_id"]
    return pool.select(*columns).unionByName(stable_local.select(*columns)).dropDuplicates(columns)


def grow(pool: DataFrame, received: DataFrame, last_stable: DataFrame, keys: list[str]) -> DataFrame:
    """Pool after a drift: received models it lacks, and the last own stable model."""
    return merged_pool(pool.unionByName(new_models(received, pool, keys).select(*pool.columns)), last_stable, keys)


def swap(pool: DataFrame, renames: DataFrame, keys: list[str]) -> DataFrame:
    """Pool after substitution: the old model leaves, its substitute is in."""
    gone = renames.select(*keys, "model_id")
    came = renames.select(*keys, F.col("sub_id").alias("model_id"))
    kept = pool.select(*keys, "model_id").join(gone, keys + ["model_id"], "left_anti")
    return kept.unionByName(came).dropDuplicates(keys + ["model_id"])


def suppressed(published: DataFrame, similar: DataFrame) -> DataFrame:
    """Whether a model is held back: more than one similar model was sent before.

    The first two models of a stream are always sent. ``published`` has
    ``source, model_id, epoch``; a model counts as sent before in order of
    ``epoch`` and id.
    """
    place = F.row_number().over(Window.partitionBy("source").orderBy("epoch", "model_id"))
    ranked = published.select("source", "model_id", place.alias("place"))
    other = ranked.select("source", F.col("model_id").alias("similar_id"), F.col("place").alias("_other"))
    earlier = (ranked.join(similar, "model_id").join(other, ["source", "similar_id"])
               .filter(F.col("_other") < F.col("place"))
               .groupBy("source", "model_id").agg(F.count("*").alias("sent_similar")))
    joined = ranked.join(earlier, ["source", "model_id"], "left")
    count = F.coalesce("sent_similar", F.lit(0))
    return joined.select("source", "model_id", "place", count.alias("sent_similar"),
                         ((F.col("place") > 2) & (count > 1)).alias("suppressed"))


def publishable(models: DataFrame, sent: DataFrame, stable: int) -> DataFrame:
    """Models with enough use, not replaced and not yet sent."""
    return (models.filter((F.col("used_for") >= stable) & ~F.col("substituted"))
            .join(sent.select("model_id"), "model_id", "left_anti"))


def traffic(log: DataFrame, keys: list[str],
            kinds=("sent", "received", "suppressed", "delayed")) -> DataFrame:
    """Messages and bytes by kind, one row per key."""
    k = F.col("kind")
    out = []
    for kind in kinds:
        out += [F.count(F.when(k == kind, 1)).alias(f"{kind}_messages"),
                F.coalesce(F.sum(F.when(k == kind, F.col("bytes"))), F.lit(0)).alias(f"{kind}_bytes")]
    return log.groupBy(*keys).agg(*out)


def _memory(size: int):
    """Members of a pool over its joins in order; a full pool turns out the worst of members and newcomer."""
    schema = pa.schema([("domain", pa.string()), ("model_id", pa.string()), ("start_seq", pa.int64()), ("end_seq", pa.int64())])

    def batch_of(spans):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*spans), schema)], schema=schema)

    def run(source):
        stream, at, since, mse = object(), None, {}, {}
        for batch in source:
            out = []
            for r in batch.to_pylist():
                if r["domain"] != stream:
                    out += [(stream, k, s, None) for k, s in since.items()]
                    stream, at, since, mse = r["domain"], None, {}, {}
                if r["at"] != at:
                    at, mse = r["at"], {}
                k, error = r["model_id"], math.inf if r["mse"] is None else r["mse"]
                if not r["joins"]:
                    if k in since:
                        mse[k] = error
                    continue
                if k in since:
                    continue
                if len(since) >= size:
                    worst = min(since, key=lambda m: (-mse.get(m, math.inf), m))
                    if not error < mse.get(worst, math.inf):
                        continue
                    out.append((stream, worst, since.pop(worst), at))
                since[k], mse[k] = at, error
            if out:
                yield batch_of(out)
        if since:
            yield batch_of([(stream, k, s, None) for k, s in since.items()])
    return run


def remembered(scores: DataFrame, joins: DataFrame, size: int = config.MAX_ENSEMBLE) -> DataFrame:
    """Membership ``[start_seq, end_seq)`` in pools that remember whom they turned out.

    ``joins`` holds ``domain, model_id, at``, ``scores`` the ``mse`` of models
    on the rows before ``at``. While a pool has room a model enters. A full
    pool keeps its members unless the newcomer's error is smaller than that of
    its worst member, which then leaves for good; of equally bad ones the
    smaller id leaves. A missing error counts as infinite, an ``end_seq`` of
    null as still in. Only members are held, joins are read in order.
    """
    asked = joins.select("domain", "model_id", F.col("at").cast("bigint").alias("at")).distinct()
    known = scores.select("domain", "at", F.lit(False).alias("joins"), "model_id", "mse")
    new = asked.join(scores.select("domain", "model_id", "at", "mse"), ["domain", "model_id", "at"], "left").select(
        "domain", "at", F.lit(True).alias("joins"), "model_id", "mse")
    records = known.unionByName(new).repartition("domain").sortWithinPartitions("domain", "at", "joins", "model_id")
    return records.mapInArrow(_memory(size), "domain string, model_id string, start_seq bigint, end_seq bigint")


def recent_rows(rows: DataFrame, moments: DataFrame, window: int) -> DataFrame:
    """Copies of the rows of the last ``window`` before each moment ``domain, at``; other rows are not taken."""
    block = F.floor(F.col("seq") / window)
    near = rows.withColumn("_block", F.explode(F.array(block, block + 1)))
    asked = moments.select("domain", F.col("at").cast("bigint").alias("at")).distinct().withColumn("_block", F.floor((F.col("at") - 1) / window))
    return (join_bounded(near, asked, ["domain", "_block"])
            .filter("seq < at AND seq >= at - %d" % window).drop("_block"))
