"""Queries on accuracy, counters and result rows."""

from pyspark.sql import functions as F

from driftpool.functions import metrics
from driftpool.operators import drift, score, stream_ops
from driftpool.plans.catalog import query
from driftpool.plans.catalog.common import LINE, R2, SCORED, USER, WINDOW, big, r, scored_lines, user_rows
from driftpool.plans.catalog.streams import DRIFT
from driftpool.sources import tables

Y, P = "y", "p"


@query("accuracy_by_stream", f"""WITH {SCORED}
SELECT domain, count(*) AS n, round({R2}, 6) + 0.0 AS r2,
       round(avg((y - p) * (y - p)), 6) AS mse, round(sqrt(avg((y - p) * (y - p))), 6) AS rmse,
       round(avg(abs(y - p)), 6) AS mae, round(corr(p, y), 6) + 0.0 AS pearson
FROM scored GROUP BY domain""")
def accuracy_by_stream(spark, folder):
    return scored_lines(spark, folder).groupBy("domain").agg(
        F.count("*").alias("n"), r(metrics.r2(Y, P)).alias("r2"), r(metrics.mse(Y, P)).alias("mse"),
        r(metrics.rmse(Y, P)).alias("rmse"), r(metrics.mae(Y, P)).alias("mae"),
        r(metrics.pearson(Y, P)).alias("pearson"))


@query("accuracy_by_concept", f"""WITH {SCORED}
SELECT domain, concept, count(*) AS n,
       round({R2}, 6) + 0.0 AS r2,
       round(avg(abs(y - p)), 6) AS mae FROM scored GROUP BY domain, concept""")
def accuracy_by_concept(spark, folder):
    return scored_lines(spark, folder).groupBy("domain", "concept").agg(
        F.count("*").alias("n"), r(metrics.r2(Y, P)).alias("r2"), r(metrics.mae(Y, P)).alias("mae"))


@query("accuracy_by_month", f"""WITH {SCORED}
SELECT domain, strftime(ts, '%Y-%m') AS month, count(*) AS n, round(avg(abs(y - p)), 6) AS mae
FROM scored GROUP BY 1, 2""")
def accuracy_by_month(spark, folder):
    rows = scored_lines(spark, folder)
    return rows.groupBy("domain", F.date_format("ts", "yyyy-MM").alias("month")).agg(
        F.count("*").alias("n"), r(metrics.mae(Y, P)).alias("mae"))


def _significance(groups):
    """SQL for ``s(domain, r, n)``: the t distribution's tail as the finite sum it is for whole degrees of freedom."""
    return f"""WITH {groups},
k AS (SELECT domain, r, n, n - 2 AS v, unnest(generate_series(0, n // 2)) AS k FROM s),
c AS (SELECT *, exp(sum(CASE WHEN k = 0 THEN 0 WHEN v % 2 = 0 THEN ln((2.0 * k - 1) / (2.0 * k))
        ELSE ln(2.0 * k / (2.0 * k + 1)) END) OVER (PARTITION BY domain ORDER BY k)) AS f FROM k),
t AS (SELECT domain, any_value(r) AS r, any_value(n) AS n, any_value(v) AS v,
        coalesce(sum(f * power(1 - r * r, k)) FILTER (k <= (v - 2 - v % 2) // 2 AND v > 1), 0) AS total FROM c GROUP BY domain)
SELECT domain, round(r, 6) + 0.0 AS pearson, CAST(n AS DOUBLE) AS n,
  round(abs(1 - CASE WHEN v % 2 = 0 THEN abs(r) * total
    ELSE 2 / pi() * (asin(abs(r)) + abs(r) * sqrt(1 - r * r) * total) END), 6) AS p_value
FROM t"""


@query("pearson_of_users", _significance(f"""{USER},
s AS (SELECT domain, corr(value, seq) AS r, count(*) AS n FROM usr GROUP BY domain HAVING count(*) >= 3)"""))
def pearson_of_users(spark, folder):
    """Correlation of an event's value with its place in the user's stream, and its p-value, for short streams."""
    stats = user_rows(spark, folder).groupBy("domain").agg(
        metrics.pearson("seq", "value").alias("pearson"), F.count("*").cast("double").alias("n")).filter("n >= 3")
    return stats.withColumn("p_value", r(metrics.pearson_p("pearson", "n"), 6)).withColumn("pearson", r(F.col("pearson"), 6))


@query("pearson_significance", _significance(f"{SCORED}, s AS (SELECT domain, corr(y, p) AS r, count(*) AS n FROM scored GROUP BY domain)"))
def pearson_significance(spark, folder):
    stats = scored_lines(spark, folder).groupBy("domain").agg(
        metrics.pearson(Y, P).alias("pearson"), F.count("*").cast("double").alias("n"))
    return stats.withColumn("p_value", r(metrics.pearson_p("pearson", "n"), 6)).withColumn("pearson", r(F.col("pearson"), 6))


REPORT = f"""WITH {DRIFT}, d AS (
  SELECT domain, min(seq + {WINDOW - 1}) AS first_drift, count(*) AS drift_windows
  FROM tested WHERE large AND n = {WINDOW} AND r2 < 0.5 GROUP BY domain),
a AS (
  SELECT domain, count(*) AS n, round({R2}, 6) + 0.0 AS r2,
         round(sqrt(avg((y - p) * (y - p))), 6) AS rmse, round(avg(abs(y - p)), 6) AS mae,
         round(corr(p, y), 6) + 0.0 AS pearson
  FROM scored GROUP BY domain)
SELECT a.domain, n, r2, rmse, mae, pearson, first_drift, coalesce(drift_windows, 0) AS drift_windows
FROM a LEFT JOIN d ON a.domain = d.domain"""


@query("stream_report", REPORT)
def stream_report(spark, folder):
    """Accuracy of each stream's first model, and where it stops fitting.

    The scored rows feed both halves; accuracy is folded into the window pass,
    so the stream is ordered and scored once.
    """
    rows = scored_lines(spark, folder)
    tested = drift.rolling_r2(rows.withColumn("late", F.col("seq") >= WINDOW + 2), ["domain", "late"], WINDOW)
    hit = (F.col("late") & drift.large_error(Y, P, 0.1) & (F.col("window_r2") < 0.5))
    at = F.when(hit, F.col("seq") + (WINDOW - 1))
    return tested.groupBy("domain").agg(
        F.count("*").alias("n"), r(metrics.r2(Y, P)).alias("r2"), r(metrics.rmse(Y, P)).alias("rmse"),
        r(metrics.mae(Y, P)).alias("mae"), r(metrics.pearson(Y, P)).alias("pearson"),
        big(F.min(at)).alias("first_drift"), F.count(at).alias("drift_windows"))


BASES = LINE + """,
member AS (SELECT domain, seq, list_filter(
  [CASE WHEN x1 >= 0.5 THEN 'x1' END, CASE WHEN x2 >= 0.5 THEN 'x2' END, CASE WHEN x3 >= 0.5 THEN 'x3' END,
   CASE WHEN x4 >= 0.5 THEN 'x4' END, CASE WHEN x5 >= 0.5 THEN 'x5' END], lambda e: e IS NOT NULL) AS bases FROM line)"""


def _members(spark, folder):
    picks = [F.when(F.col(x) >= 0.5, F.lit(x)) for x in tables.FEATURES]
    return tables.line_rows(spark, folder).select("domain", "seq", F.array_compact(F.array(*picks)).alias("bases"))


@query("ensemble_changes", f"""WITH {BASES}, c AS (
  SELECT domain, bases, lag(bases) OVER (PARTITION BY domain ORDER BY seq) AS before FROM member)
SELECT domain, count(*) FILTER (WHERE before IS NOT NULL AND bases <> before) AS changes FROM c GROUP BY domain""")
def ensemble_changes(spark, folder):
    return stream_ops.membership_changes(_members(spark, folder), ["domain"], "bases")


@query("ensemble_size", f"""WITH {BASES}
SELECT domain, count(*) AS n, CAST(max(len(bases)) AS INTEGER) AS largest, round(avg(len(bases)), 6) AS mean_size
FROM member GROUP BY domain""")
def ensemble_size(spark, folder):
    sizes = stream_ops.ensemble_size(_members(spark, folder), ["domain"], "bases")
    return sizes.withColumn("mean_size", r(F.col("mean_size")))


@query("base_usage", f"""WITH {BASES}, e AS (SELECT unnest(bases) AS model_id FROM member)
SELECT model_id, count(*) AS uses FROM e WHERE model_id IN ('x1', 'x3', 'x5') GROUP BY model_id""")
def base_usage(spark, folder):
    received = spark.createDataFrame([("x1",), ("x3",), ("x5",)], "model_id string")
    return stream_ops.base_usage(_members(spark, folder), "bases", received)


@query("weight_snapshot", """WITH w AS (
  SELECT CAST(user_id AS VARCHAR) AS domain, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type AS model_id, sum(value) AS weight
  FROM events GROUP BY 1, 2, 3)
SELECT domain, day, model_id, round(weight / sum(weight) OVER (PARTITION BY domain, day), 6) AS share FROM w""")
def weight_snapshot(spark, folder):
    weights = tables.table(spark, folder, "events").groupBy(
        F.col("user_id").cast("string").alias("domain"), F.to_date("ts").cast("string").alias("day"),
        F.col("event_type").alias("model_id")).agg(F.sum("value").alias("weight"))
    shares = stream_ops.weight_shares(weights, ["domain", "day"])
    return shares.select("domain", "day", "model_id", r(F.col("share")).alias("share"))


@query("traffic_counters", """WITH log AS (
  SELECT CAST(user_id AS VARCHAR) AS domain, event_type AS kind, length(props) AS bytes FROM events)
SELECT domain,
  count(*) FILTER (WHERE kind = 'purchase') AS sent_messages,
  count(*) FILTER (WHERE kind = 'view') AS received_messages,
  count(*) FILTER (WHERE kind = 'error') AS suppressed_messages,
  count(*) FILTER (WHERE kind = 'click') AS delayed_messages,
  CAST(coalesce(sum(bytes) FILTER (WHERE kind = 'purchase'), 0) AS BIGINT) AS sent_bytes,
  CAST(coalesce(sum(bytes) FILTER (WHERE kind = 'view'), 0) AS BIGINT) AS received_bytes
FROM log GROUP BY domain""")
def traffic_counters(spark, folder):
    from driftpool.operators.pool import traffic
    names = {"purchase": "sent", "view": "received", "error": "suppressed", "click": "delayed"}
    kind = F.create_map(*[F.lit(v) for pair in names.items() for v in pair])
    log = tables.table(spark, folder, "events").select(
        F.col("user_id").cast("string").alias("domain"), kind[F.col("event_type")].alias("kind"),
        F.length("props").cast("bigint").alias("bytes"))
    counts = traffic(log, ["domain"])
    return counts.select("domain", "sent_messages", "received_messages", "suppressed_messages",
                         "delayed_messages", "sent_bytes", "received_bytes")


@query("sweep_summary", f"""WITH {SCORED}, c AS (SELECT * FROM (VALUES (0.05), (0.1), (0.2), (0.3)) t(eps)),
g AS (SELECT CAST(eps AS DOUBLE) AS eps, domain, count(*) FILTER (WHERE abs(p - y) > eps) / count(*) AS share
      FROM scored CROSS JOIN c GROUP BY 1, 2)
SELECT eps, count(*) AS streams, round(avg(share), 6) AS mean_share, round(stddev_samp(share), 6) AS sd_share
FROM g GROUP BY eps""")
def sweep_summary(spark, folder):
    """Share of large errors under several settings: settings are columns, rows are read once."""
    from driftpool.plans.sweep import summarise
    settings = [0.05, 0.1, 0.2, 0.3]
    wide = scored_lines(spark, folder).groupBy("domain").agg(
        *[F.avg(drift.large_error(Y, P, e).cast("double")).alias(f"e{i}") for i, e in enumerate(settings)])
    long = wide.select("domain", F.explode(F.array(*[
        F.struct(F.lit(e).alias("eps"), F.col(f"e{i}").alias("share")) for i, e in enumerate(settings)])).alias("s"))
    out = summarise(long.select("domain", "s.*"), ["eps"], ["share"])
    return out.select("eps", "streams", r(F.col("mean_share")).alias("mean_share"), r(F.col("sd_share")).alias("sd_share"))


@query("greatest_difference", f"""WITH {SCORED}
SELECT domain, round(max(abs(p - 0.5)), 6) AS max_diff FROM scored GROUP BY domain""")
def greatest_difference(spark, folder):
    rows = scored_lines(spark, folder).withColumn("d", F.lit(0.5))
    out = score.greatest_difference(rows, ["domain"], "p", "d")
    return out.withColumn("max_diff", r(F.col("max_diff")))
