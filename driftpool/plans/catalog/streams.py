"""Queries on stream order, slices, segments and drift of fixed predictions."""

from pyspark.sql import functions as F

from driftpool.operators import drift, score, stream_ops
from driftpool.plans import sequence
from driftpool.plans.catalog import query
from driftpool.plans.catalog.common import (LINE, SCORED, USER, WINDOW, big, r, scored_lines,
                                            user_rows)
from driftpool.sources import tables


@query("stream_order", f"""WITH {LINE}
SELECT domain, seq, concept, round(x1, 9) + 0.0 AS x1, round(x2, 9) + 0.0 AS x2, round(x4, 9) + 0.0 AS x4,
       round(y, 9) + 0.0 AS y FROM stream""")
def stream_order(spark, folder):
    return tables.line_stream(spark, folder).select(
        "domain", big(F.col("seq")).alias("seq"), "concept", r(F.col("x1"), 9).alias("x1"),
        r(F.col("x2"), 9).alias("x2"), r(F.col("x4"), 9).alias("x4"), r(F.col("y"), 9).alias("y"))


@query("drop_nulls", """WITH kept AS (
  SELECT event_type AS domain, ts, event_id, nullif(value, 0.01) AS value,
         CASE WHEN value >= 1 THEN value END AS x FROM events)
SELECT domain, row_number() OVER (PARTITION BY domain ORDER BY ts, event_id) AS seq, event_id, x
FROM kept WHERE value IS NOT NULL AND x IS NOT NULL""")
def drop_nulls(spark, folder):
    rows = tables.table(spark, folder, "events").select(
        F.col("event_type").alias("domain"), "ts", "event_id", F.expr("nullif(value, 0.01D)").alias("value"),
        F.when(F.col("value") >= 1, F.col("value")).alias("x"))
    kept = stream_ops.drop_nulls(rows, ["domain"], ["ts", "event_id"], [F.date_trunc("hour", F.col("ts"))])
    return kept.select("domain", big(F.col("seq")).alias("seq"), "event_id", "x")


@query("date_parts", """SELECT event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS date,
  CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month, CAST(day(ts) AS INTEGER) AS day,
  CAST((isodow(ts) - 1) AS BIGINT) AS day_of_week,
  CAST(hour(ts) * 100 + minute(ts) AS BIGINT) AS time FROM events""")
def date_parts(spark, folder):
    from driftpool.sources.ingest import with_date_parts
    rows = tables.table(spark, folder, "events").select(
        "event_id", F.to_date("ts").alias("date"),
        (F.hour("ts") * 100 + F.minute("ts")).cast("bigint").alias("time"))
    return with_date_parts(rows).select("event_id", F.col("date").cast("string").alias("date"), "year", "month", "day", "day_of_week", "time")


@query("slice_positions", f"""WITH {LINE}
SELECT domain, seq, round(y, 9) + 0.0 AS y FROM stream WHERE seq > 100 AND seq <= 900""")
def slice_positions(spark, folder):
    rows = stream_ops.between_positions(tables.line_stream(spark, folder), 100, 900)
    return rows.select("domain", big(F.col("seq")).alias("seq"), r(F.col("y"), 9).alias("y"))


@query("slice_dates", """SELECT event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS date, value FROM events
WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'""")
def slice_dates(spark, folder):
    rows = tables.table(spark, folder, "events").select("event_id", F.to_date("ts").alias("date"), "value")
    return stream_ops.between_dates(rows, "date", "2024-01-05", "2024-01-20").withColumn("date", F.col("date").cast("string"))


@query("head_and_remainder", f"""WITH {LINE}
SELECT domain, count(*) FILTER (WHERE seq <= 90) AS head_rows, count(*) FILTER (WHERE seq > 90) AS rest_rows,
       round(avg(y) FILTER (WHERE seq <= 90), 6) AS head_mean,
       round(avg(y) FILTER (WHERE seq > 90), 6) AS rest_mean
FROM stream GROUP BY domain""")
def head_and_remainder(spark, folder):
    first = F.col("seq") <= 90
    return tables.line_stream(spark, folder).groupBy("domain").agg(
        F.count(F.when(first, 1)).alias("head_rows"), F.count(F.when(~first, 1)).alias("rest_rows"),
        r(F.avg(F.when(first, F.col("y")))).alias("head_mean"),
        r(F.avg(F.when(~first, F.col("y")))).alias("rest_mean"))


@query("slice_length", f"""WITH {LINE} SELECT domain, count(*) AS n FROM line
WHERE seq > 200 AND seq <= 700 GROUP BY domain""")
def slice_length(spark, folder):
    return stream_ops.slice_lengths(tables.line_rows(spark, folder), ["domain"], 200, 700)


@query("first_predictions", f"""WITH {SCORED}
SELECT domain, seq, round(CASE WHEN seq <= {WINDOW} THEN 0.5 ELSE p END, 6) + 0.0 AS p FROM scored""")
def first_predictions(spark, folder):
    rows = scored_lines(spark, folder)
    p = score.default_prediction(WINDOW, F.lit(0.5), F.col("p"))
    return rows.select("domain", big(F.col("seq")).alias("seq"), r(p).alias("p"))


@query("large_errors", f"""WITH {SCORED}
SELECT domain, seq FROM scored WHERE abs(p - y) > 0.1 AND seq >= {WINDOW + 2}""")
def large_errors(spark, folder):
    rows = scored_lines(spark, folder).filter(F.col("seq") >= WINDOW + 2)
    return rows.filter(drift.large_error("y", "p", 0.1)).select(
        "domain", big(F.col("seq")).alias("seq"))


@query("rolling_r2", f"""WITH {SCORED}, w AS (
  SELECT domain, seq, count(*) OVER f AS n, sum((y - p) * (y - p)) OVER f AS res,
         var_pop(y) OVER f * {WINDOW} AS tot, min(y) OVER f = max(y) OVER f AS flat
  FROM scored WINDOW f AS (PARTITION BY domain ORDER BY seq ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING))
SELECT domain, seq, round(CASE WHEN flat THEN CAST(res = 0 AS INTEGER) ELSE 1 - res / tot END, 5) + 0.0 AS r2
FROM w WHERE n = {WINDOW}""")
def rolling_r2(spark, folder):
    rows = drift.rolling_r2(scored_lines(spark, folder), ["domain"], WINDOW)
    return rows.filter(F.col("window_r2").isNotNull()).select(
        "domain", big(F.col("seq")).alias("seq"), r(F.col("window_r2"), 5).alias("r2"))


DRIFT = f"""{SCORED}, tested AS (
  SELECT domain, seq, abs(p - y) > 0.1 AS large, count(*) OVER f AS n,
         1 - sum((y - p) * (y - p)) OVER f / (var_pop(y) OVER f * {WINDOW}) AS r2
  FROM scored WHERE seq >= {WINDOW + 2}
  WINDOW f AS (PARTITION BY domain ORDER BY seq ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING))"""


@query("drift_points", f"""WITH {DRIFT}
SELECT domain, seq AS opened_at, seq + {WINDOW - 1} AS drift_at, round(r2, 5) + 0.0 AS r2
FROM tested WHERE large AND n = {WINDOW} AND r2 < 0.5""")
def drift_points(spark, folder):
    found = drift.drift_points(scored_lines(spark, folder), ["domain"], WINDOW, 0.1, 0.5)
    return found.select("domain", big(F.col("opened_at")).alias("opened_at"),
                        big(F.col("drift_at")).alias("drift_at"), r(F.col("window_r2"), 5).alias("r2"))


@query("first_drift", f"""WITH {DRIFT}
SELECT domain, min(seq + {WINDOW - 1}) AS drift_at, count(*) AS windows
FROM tested WHERE large AND n = {WINDOW} AND r2 < 0.5 GROUP BY domain""")
def first_drift(spark, folder):
    found = drift.drift_points(scored_lines(spark, folder), ["domain"], WINDOW, 0.1, 0.5)
    return found.groupBy("domain").agg(big(F.min("drift_at")).alias("drift_at"), F.count("*").alias("windows"))


SEGMENTS = f"""{USER}, marked AS (
  SELECT *, CASE WHEN lag(model_id) OVER w IS DISTINCT FROM model_id THEN 1 ELSE 0 END AS fresh
  FROM usr WINDOW w AS (PARTITION BY domain ORDER BY seq)),
grouped AS (SELECT *, sum(fresh) OVER (PARTITION BY domain ORDER BY seq) AS g FROM marked),
seg AS (
  SELECT domain, g, min(model_id) AS model_id, min(seq) AS start_seq, max(seq) AS end_seq, count(*) AS length
  FROM grouped GROUP BY domain, g),
runs AS (SELECT *, lead(model_id) OVER (PARTITION BY domain ORDER BY g) AS next_model_id FROM seg),
moves AS (
  SELECT domain, model_id AS from_id, next_model_id AS to_id, count(*) AS n
  FROM runs WHERE next_model_id IS NOT NULL GROUP BY 1, 2, 3),
odds AS (SELECT *, n / sum(n) OVER (PARTITION BY domain, from_id) AS probability,
                rank() OVER (PARTITION BY domain, from_id ORDER BY n DESC) AS place FROM moves)"""


def _segments(spark, folder):
    return drift.segments(user_rows(spark, folder), ["domain"])


def _moves(spark, folder):
    return drift.transitions(_segments(spark, folder), ["domain"])


@query("model_segments", f"""WITH {SEGMENTS}
SELECT domain, model_id, start_seq, end_seq, length, next_model_id FROM runs""")
def model_segments(spark, folder):
    return _segments(spark, folder).select(
        "domain", "model_id", big(F.col("start_seq")).alias("start_seq"), big(F.col("end_seq")).alias("end_seq"),
        big(F.col("length")).alias("length"), "next_model_id")


@query("transition_counts", f"WITH {SEGMENTS} SELECT domain, from_id, to_id, n FROM moves")
def transition_counts(spark, folder):
    return _moves(spark, folder)


@query("transition_probabilities", f"""WITH {SEGMENTS}
SELECT domain, from_id, to_id, round(probability, 6) AS probability FROM odds""")
def transition_probabilities(spark, folder):
    odds = drift.transition_probabilities(_moves(spark, folder), ["domain"])
    return odds.select("domain", "from_id", "to_id", r(F.col("probability")).alias("probability"))


@query("likely_successors", f"""WITH {SEGMENTS}
SELECT domain, from_id, to_id, n, round(probability, 6) AS probability FROM odds
WHERE place = 1 AND probability >= 0.3 AND (domain, to_id) NOT IN (
  SELECT domain, model_id FROM usr GROUP BY 1, 2 HAVING avg(value) > 60)""")
def likely_successors(spark, folder):
    rows = user_rows(spark, folder)
    gone = rows.groupBy("domain", "model_id").agg(F.avg("value").alias("m")).filter("m > 60")
    best = drift.likely_successors(_moves(spark, folder), ["domain"], 0.3, gone)
    return best.select("domain", "from_id", "to_id", "n", r(F.col("probability")).alias("probability"))


@query("substituted_transitions", f"""WITH {SEGMENTS}, sub AS (SELECT domain, min(model_id) AS old_id, max(model_id) AS sub_id FROM usr GROUP BY domain
        HAVING min(model_id) <> max(model_id))
SELECT m.domain, CASE WHEN from_id = old_id THEN sub_id ELSE from_id END AS from_id,
       CASE WHEN to_id = old_id THEN sub_id ELSE to_id END AS to_id, CAST(sum(n) AS BIGINT) AS n
FROM moves m LEFT JOIN sub s ON m.domain = s.domain GROUP BY 1, 2, 3""")
def substituted_transitions(spark, folder):
    renames = user_rows(spark, folder).groupBy("domain").agg(
        F.min("model_id").alias("model_id"), F.max("model_id").alias("sub_id")).filter("model_id <> sub_id")
    return drift.substitute(_moves(spark, folder), renames, ["domain"])


@query("model_usage", f"""WITH {USER}, c AS (
  SELECT *, row_number() OVER (PARTITION BY domain, model_id ORDER BY seq) AS use FROM usr)
SELECT domain, model_id, count(*) AS uses, coalesce(min(seq) FILTER (WHERE use >= 10), 0) AS stable_at
FROM c GROUP BY domain, model_id""")
def model_usage(spark, folder):
    used = stream_ops.model_usage(user_rows(spark, folder), ["domain"], 10)
    return used.withColumn("stable_at", F.coalesce(big(F.col("stable_at")), F.lit(0).cast("bigint")))


@query("trailing_history", f"""WITH {LINE}
SELECT domain, seq, round(avg(y) OVER (PARTITION BY domain ORDER BY seq
  ROWS BETWEEN {2 * WINDOW - 1} PRECEDING AND CURRENT ROW), 6) AS trailing_mean FROM stream""")
def trailing_history(spark, folder):
    rows = stream_ops.trailing_mean(tables.line_stream(spark, folder).select("domain", "seq", "y"),
                                    ["domain"], "y", 2 * WINDOW, "m")
    return rows.select("domain", big(F.col("seq")).alias("seq"), r(F.col("m")).alias("trailing_mean"))


@query("refresh_points", f"""WITH {LINE}
SELECT domain, seq, seq // {WINDOW} AS period FROM line WHERE seq % {WINDOW // 2} = 0""")
def refresh_points(spark, folder):
    rows = stream_ops.refresh_points(tables.line_rows(spark, folder), WINDOW)
    return rows.select("domain", big(F.col("seq")).alias("seq"), big(F.col("period")).alias("period"))


@query("running_error", f"""WITH {SCORED}
SELECT domain, seq, round(sum(abs(p - y)) OVER (PARTITION BY domain ORDER BY seq), 5) AS total FROM scored""")
def running_error(spark, folder):
    rows = sequence.running_sum(scored_lines(spark, folder), ["domain"], F.abs(F.col("p") - F.col("y")), "t")
    return rows.select("domain", big(F.col("seq")).alias("seq"), r(F.col("t"), 5).alias("total"))
