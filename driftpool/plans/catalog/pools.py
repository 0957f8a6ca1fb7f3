"""Queries on model pools and on models travelling between streams."""

from pyspark.sql import functions as F

from driftpool.operators import pool, stream_ops
from driftpool.plans.catalog import query
from driftpool.plans.catalog.common import r
from driftpool.session import staged
from driftpool.sources import tables

# suppliers are the streams; each publishes one model per line number, which is its epoch
NET = """
supply AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS source, l_suppkey || '-' || l_linenumber AS model_id,
         l_linenumber AS epoch, count(*) AS used_for, avg(l_discount) AS mse, max(l_shipdate) AS added
  FROM lineitem GROUP BY 1, 2, 3),
edge AS (SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS src, CAST(l_partkey % 100 AS VARCHAR) AS dst
         FROM lineitem WHERE l_suppkey <> l_partkey % 100),
mark AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS target, coalesce(max(CASE WHEN l_tax = 0 AND l_shipdate < TIMESTAMP '1995-02-15'
         THEN l_linenumber END), 0) AS epoch FROM lineitem GROUP BY 1),
offered AS (SELECT dst AS target, src, model_id, s.epoch FROM edge JOIN supply s ON src = source),
delivery AS (SELECT o.target, model_id, o.epoch FROM offered o JOIN mark m ON o.target = m.target AND o.epoch <= m.epoch),
ren AS (SELECT a.source, a.model_id, b.model_id AS sub_id FROM supply a JOIN supply b
        ON a.source = b.source AND b.epoch = a.epoch + 1 WHERE a.used_for < b.used_for),
replaced AS (SELECT d.target, d.model_id, r.sub_id FROM delivery d JOIN ren r ON d.model_id = r.model_id),
near AS (SELECT a.model_id, b.model_id AS similar_id FROM supply a JOIN supply b
         ON a.source = b.source AND b.epoch IN (a.epoch + 1, a.epoch - 1))"""


class Net:
    """Exchange tables derived from the order lines."""

    def __init__(self, spark, folder):
        lines = tables.table(spark, folder, "lineitem")
        source = F.col("l_suppkey").cast("string")
        # the three small tables are made once; everything else joins them
        self.supply = staged(lines.groupBy(
            source.alias("source"), F.concat_ws("-", "l_suppkey", "l_linenumber").alias("model_id"),
            F.col("l_linenumber").alias("epoch")).agg(
            F.count("*").alias("used_for"), F.avg("l_discount").alias("mse"), F.max("l_shipdate").alias("added")))
        other = F.col("l_partkey") % 100
        self.edges = staged(lines.filter(F.col("l_suppkey") != other).select(
            source.alias("src"), other.cast("string").alias("dst")).distinct())
        early = (F.col("l_tax") == 0) & (F.col("l_shipdate") < F.lit("1995-02-15").cast("timestamp_ntz"))
        self.marks = staged(lines.groupBy(source.alias("target")).agg(
            F.coalesce(F.max(F.when(early, F.col("l_linenumber"))), F.lit(0)).alias("epoch")))
        self.registry = self.supply.select("source", "model_id", "epoch")

    @property
    def delivery(self):
        read = self.marks.withColumnRenamed("epoch", "_read")
        return (pool.inbox(self.registry, self.edges).join(read, "target")
                .filter(F.col("epoch") <= F.col("_read")).select("target", "model_id", "epoch"))

    def _beside(self, step):
        other = self.supply.select("source", (F.col("epoch") - step).alias("epoch"),
                                   F.col("model_id").alias("_id"), F.col("used_for").alias("_used"))
        return self.supply.join(other, ["source", "epoch"])

    @property
    def renames(self):
        return self._beside(1).filter(F.col("used_for") < F.col("_used")).select(
            "source", "model_id", F.col("_id").alias("sub_id"))

    @property
    def replacement(self):
        return self.delivery.join(self.renames, "model_id").select("target", "model_id", "sub_id")

    @property
    def similar(self):
        both = self._beside(1).unionByName(self._beside(-1))
        return both.select("model_id", F.col("_id").alias("similar_id"))


@query("complete_edges", """WITH d AS (SELECT DISTINCT l_returnflag || l_linestatus AS domain FROM lineitem)
SELECT a.domain AS src, b.domain AS dst FROM d a JOIN d b ON a.domain <> b.domain""")
def complete_edges(spark, folder):
    lines = tables.table(spark, folder, "lineitem")
    return pool.complete_edges(lines.select(F.concat("l_returnflag", "l_linestatus").alias("domain")))


@query("unread_counts", f"""WITH {NET}
SELECT m.target, count(s.model_id) AS unread FROM mark m LEFT JOIN supply s
ON s.source <> m.target AND s.epoch > m.epoch GROUP BY m.target""")
def unread_counts(spark, folder):
    net = Net(spark, folder)
    return pool.unread_counts(net.registry, net.marks)


@query("pending_deliveries", f"""WITH {NET}
SELECT target, src, model_id, epoch FROM offered o
WHERE NOT EXISTS (SELECT 1 FROM delivery d WHERE d.target = o.target AND d.model_id = o.model_id)
  AND NOT EXISTS (SELECT 1 FROM replaced d WHERE d.target = o.target AND d.model_id = o.model_id)""")
def pending_deliveries(spark, folder):
    net = Net(spark, folder)
    return pool.pending(net.registry, net.edges, net.delivery, net.replacement).select("target", "src", "model_id", "epoch")


@query("held_by_all", f"""WITH {NET}
SELECT o.model_id, count(*) AS neighbours, CAST(bool_and(d.model_id IS NOT NULL) AS INTEGER) AS held_by_all
FROM offered o LEFT JOIN delivery d ON d.target = o.target AND d.model_id = o.model_id GROUP BY o.model_id""")
def held_by_all(spark, folder):
    net = Net(spark, folder)
    out = pool.held_by_all(net.registry, net.edges, net.delivery)
    return out.withColumn("held_by_all", F.col("held_by_all").cast("int"))


@query("delayed_sends", f"""WITH {NET}, late AS (
  SELECT o.target, o.model_id FROM offered o JOIN near n ON o.model_id = n.model_id AND split_part(n.similar_id, '-', 1) = o.target
  UNION
  SELECT o.target, o.model_id FROM offered o JOIN near n ON o.model_id = n.model_id
  JOIN delivery d ON d.target = o.target AND d.model_id = n.similar_id)
SELECT o.target, o.model_id, CAST(l.target IS NOT NULL AS INTEGER) AS delayed
FROM offered o LEFT JOIN late l ON l.target = o.target AND l.model_id = o.model_id""")
def delayed_sends(spark, folder):
    net = Net(spark, folder)
    out = pool.delayed_split(net.registry, net.edges, net.similar, net.delivery)
    return out.withColumn("delayed", F.col("delayed").cast("int"))


@query("replacement_split", f"""WITH {NET}
SELECT e.dst AS target, r.model_id, r.sub_id,
       CAST(d.model_id IS NOT NULL OR split_part(r.sub_id, '-', 1) = e.dst AS INTEGER) AS swap_only
FROM edge e JOIN ren r ON r.source = e.src LEFT JOIN delivery d ON d.target = e.dst AND d.model_id = r.sub_id""")
def replacement_split(spark, folder):
    net = Net(spark, folder)
    out = pool.replacement_split(net.renames, net.edges, net.delivery)
    return out.withColumn("swap_only", F.col("swap_only").cast("int"))


@query("inbox_after_replacement", f"""WITH {NET}, split AS (
  SELECT e.dst AS target, r.model_id, r.sub_id, d.model_id IS NOT NULL AS swap_only
  FROM edge e JOIN ren r ON r.source = e.src LEFT JOIN delivery d ON d.target = e.dst AND d.model_id = r.sub_id),
log AS (
  SELECT target, model_id, CAST(epoch AS INTEGER) AS epoch, 0 AS replaced FROM delivery
  UNION ALL SELECT s.target, s.model_id, 99, 1 FROM split s JOIN delivery d ON d.target = s.target AND d.model_id = s.model_id
  UNION ALL SELECT DISTINCT target, sub_id, 99, 0 FROM split WHERE NOT swap_only)
SELECT target, model_id, max(epoch) AS epoch, CAST(max(replaced) AS INTEGER) AS replaced FROM log GROUP BY 1, 2""")
def inbox_after_replacement(spark, folder):
    net = Net(spark, folder)
    split = pool.replacement_split(net.renames, net.edges, net.delivery)
    boxes = net.delivery.withColumn("replaced", F.lit(False))
    out = pool.apply_replacement(split, boxes, 99)
    return out.withColumn("replaced", F.col("replaced").cast("int"))


@query("received_again", f"""WITH {NET}
SELECT d.target, d.model_id, CAST(d.epoch + CASE WHEN u.used_for > 80 THEN 1 ELSE 0 END AS INTEGER) AS epoch,
       CASE WHEN u.used_for > 80 THEN 0 WHEN r.model_id IS NOT NULL THEN 1 ELSE 0 END AS replaced
FROM delivery d JOIN supply u ON u.model_id = d.model_id
LEFT JOIN replaced r ON r.target = d.target AND r.model_id = d.model_id""")
def received_again(spark, folder):
    net = Net(spark, folder)
    boxes = net.delivery.join(net.replacement.withColumn("_r", F.lit(True)), ["target", "model_id"], "left").select(
        "target", "model_id", "epoch", F.coalesce("_r", F.lit(False)).alias("replaced"))
    often = net.supply.filter("used_for > 80").select("model_id")
    arrived = net.delivery.join(often, "model_id", "left_semi").select(
        "target", "model_id", (F.col("epoch") + 1).alias("epoch"))
    out = pool.store_received(boxes, arrived)
    return out.withColumn("replaced", F.col("replaced").cast("int"))


@query("discard_list", f"""WITH {NET}, gone AS (SELECT target, model_id FROM delivery d WHERE epoch = 1)
SELECT target, model_id, sub_id FROM replaced x
WHERE NOT EXISTS (SELECT 1 FROM replaced y WHERE y.target = x.target AND y.model_id = x.sub_id)
  AND NOT EXISTS (SELECT 1 FROM gone y WHERE y.target = x.target AND y.model_id = x.sub_id)""")
def discard_list(spark, folder):
    net = Net(spark, folder)
    return pool.discard_list(net.replacement, net.delivery, net.delivery.filter("epoch = 1"))


@query("missing_substitutes", f"""WITH {NET}
SELECT target, model_id, sub_id FROM replaced x WHERE split_part(sub_id, '-', 1) <> target
  AND NOT EXISTS (SELECT 1 FROM delivery d WHERE d.target = x.target AND d.model_id = x.sub_id)""")
def missing_substitutes(spark, folder):
    net = Net(spark, folder)
    return pool.missing_substitutes(net.replacement, net.delivery)


@query("replacement_chains", f"""WITH RECURSIVE {NET}, walk AS (
  SELECT model_id, sub_id AS final_id, 1 AS links FROM ren
  UNION ALL SELECT w.model_id, r.sub_id, w.links + 1 FROM walk w JOIN ren r ON r.model_id = w.final_id)
SELECT model_id, max_by(final_id, links) AS final_id, CAST(max(links) AS INTEGER) AS links FROM walk GROUP BY model_id""")
def replacement_chains(spark, folder):
    return pool.resolve_chains(Net(spark, folder).renames)


@query("discard_marks", f"""WITH {NET}
SELECT d.target, d.model_id, CAST(r.model_id IS NOT NULL AS INTEGER) AS discard
FROM delivery d LEFT JOIN replaced r ON r.target = d.target AND r.model_id = d.model_id""")
def discard_marks(spark, folder):
    net = Net(spark, folder)
    out = pool.mark_discarded(net.delivery.select("target", "model_id"), net.replacement, ["target"])
    return out.withColumn("discard", F.col("discard").cast("int"))


@query("pairs_after_discard", f"""WITH {NET}, pairs AS (
  SELECT source, model_id AS i, similar_id AS j FROM near JOIN supply USING (model_id))
SELECT source, i, j FROM pairs WHERE i NOT IN (SELECT model_id FROM ren) AND j NOT IN (SELECT model_id FROM ren)""")
def pairs_after_discard(spark, folder):
    net = Net(spark, folder)
    pairs = net.similar.join(net.registry, "model_id").select("source", F.col("model_id").alias("i"), F.col("similar_id").alias("j"))
    return pool.drop_discarded(pairs, net.renames, ["source"])


@query("newest_models", f"""WITH {NET}, k AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY added DESC, model_id) AS place FROM supply)
SELECT source, model_id FROM k WHERE place <= 4""")
def newest_models(spark, folder):
    return pool.keep_newest(Net(spark, folder).supply, ["source"], 4).select("source", "model_id")


@query("best_models", f"""WITH {NET}, k AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY round(mse, 9), model_id) AS low,
         row_number() OVER (PARTITION BY source ORDER BY used_for DESC, model_id) AS much FROM supply)
SELECT source, model_id, CAST(low <= 3 AS INTEGER) AS low_error, CAST(much <= 3 AS INTEGER) AS high_weight
FROM k WHERE low <= 3 OR much <= 3""")
def best_models(spark, folder):
    supply = Net(spark, folder).supply.withColumn("mse", F.round("mse", 9))
    low = pool.keep_best(supply, ["source"], 3, "mse", ascending=True).select("source", "model_id", F.lit(1).alias("low_error"))
    high = pool.keep_best(supply, ["source"], 3, "used_for", ascending=False).select("source", "model_id", F.lit(1).alias("high_weight"))
    return low.join(high, ["source", "model_id"], "full").na.fill(0, ["low_error", "high_weight"])


@query("new_models", f"""WITH {NET}
SELECT target, model_id FROM offered o WHERE NOT EXISTS (
  SELECT 1 FROM delivery d WHERE d.target = o.target AND d.model_id = o.model_id)""")
def new_models(spark, folder):
    net = Net(spark, folder)
    offered = pool.inbox(net.registry, net.edges).select("target", "model_id")
    return pool.new_models(offered, net.delivery, ["target"])


@query("pool_changes", f"""WITH {NET}, n AS (
  SELECT o.target, o.model_id, d.model_id IS NOT NULL AS had FROM offered o
  LEFT JOIN delivery d ON d.target = o.target AND d.model_id = o.model_id)
SELECT target, CAST(bool_or(NOT had) AS INTEGER) AS recluster FROM n GROUP BY target""")
def pool_changes(spark, folder):
    net = Net(spark, folder)
    out = pool.pool_changed(net.delivery, pool.inbox(net.registry, net.edges), ["target"])
    return out.withColumn("recluster", F.col("recluster").cast("int"))


@query("merged_pool", f"""WITH {NET}
SELECT target, model_id FROM delivery UNION SELECT source, model_id FROM supply WHERE used_for >= 85""")
def merged_pool(spark, folder):
    net = Net(spark, folder)
    local = net.supply.filter("used_for >= 85").select(F.col("source").alias("target"), "model_id")
    return pool.merged_pool(net.delivery, local, ["target"])


@query("grown_pool", f"""WITH {NET}, last AS (
  SELECT source, max_by(model_id, epoch) AS model_id FROM supply WHERE used_for >= 85 GROUP BY source)
SELECT target, model_id FROM offered UNION SELECT source, model_id FROM last""")
def grown_pool(spark, folder):
    net = Net(spark, folder)
    last = net.supply.filter("used_for >= 85").groupBy(F.col("source").alias("target")).agg(F.max_by("model_id", "epoch").alias("model_id"))
    got = net.delivery.select("target", "model_id")
    return pool.grow(got, pool.inbox(net.registry, net.edges).select("target", "model_id"), last, ["target"])


@query("swapped_pool", f"""WITH {NET}
SELECT source, model_id FROM supply WHERE model_id NOT IN (SELECT model_id FROM ren)
UNION SELECT source, sub_id FROM ren""")
def swapped_pool(spark, folder):
    net = Net(spark, folder)
    return pool.swap(net.supply, net.renames, ["source"])


@query("suppressed_sends", f"""WITH {NET}, k AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY used_for, model_id) AS place FROM supply),
c AS (SELECT k.source, k.model_id, count(*) AS n FROM k JOIN near n ON n.model_id = k.model_id
      JOIN k o ON o.model_id = n.similar_id AND o.place < k.place GROUP BY 1, 2)
SELECT k.source, k.model_id, coalesce(n, 0) AS sent_similar,
       CAST(place > 2 AND coalesce(n, 0) > 1 AS INTEGER) AS suppressed
FROM k LEFT JOIN c ON c.model_id = k.model_id""")
def suppressed_sends(spark, folder):
    net = Net(spark, folder)
    published = net.supply.select("source", "model_id", F.col("used_for").alias("epoch"))
    out = pool.suppressed(published, net.similar)
    return out.select("source", "model_id", "sent_similar", F.col("suppressed").cast("int").alias("suppressed"))


@query("publishable_models", f"""WITH {NET}
SELECT source, model_id, used_for FROM supply s WHERE used_for >= 85
  AND model_id NOT IN (SELECT model_id FROM ren) AND s.epoch > (SELECT max(m.epoch) FROM mark m WHERE m.target = s.source)""")
def publishable_models(spark, folder):
    net = Net(spark, folder)
    flagged = pool.mark_discarded(net.supply, net.renames, ["source"]).withColumnRenamed("discard", "substituted")
    read = net.marks.select(F.col("target").alias("source"), F.col("epoch").alias("_read"))
    sent = net.supply.join(read, "source").filter(F.col("epoch") <= F.col("_read"))
    return pool.publishable(flagged, sent, 85).select("source", "model_id", "used_for")


@query("qualified_ids", """SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS source, l_suppkey || '-' || l_linenumber AS model_id,
  CAST(l_linenumber <= 3 AS INTEGER) AS own FROM lineitem""")
def qualified_ids(spark, folder):
    own = F.col("l_linenumber") <= 3
    raw = F.when(own, F.col("l_linenumber").cast("string")).otherwise(F.concat_ws("-", "l_suppkey", "l_linenumber"))
    return tables.table(spark, folder, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("source"),
        stream_ops.qualified(F.col("l_suppkey").cast("string"), raw).alias("model_id"), own.cast("int").alias("own")).distinct()


@query("stable_models", f"""WITH {NET}
SELECT source, model_id, used_for, round(used_for / sum(used_for) OVER (PARTITION BY source), 6) AS share
FROM supply WHERE used_for >= 80 AND model_id NOT IN (SELECT model_id FROM ren)""")
def stable_models(spark, folder):
    net = Net(spark, folder)
    flagged = pool.mark_discarded(net.supply, net.renames, ["source"]).withColumnRenamed("discard", "substituted")
    kept = flagged.filter(stream_ops.is_stable(80)).select("source", "model_id", "used_for", F.col("used_for").alias("weight"))
    return stream_ops.weight_shares(kept, ["source"]).select("source", "model_id", "used_for", r(F.col("share")).alias("share"))
