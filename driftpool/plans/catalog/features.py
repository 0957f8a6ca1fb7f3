"""Queries on labels with drift, weather features and heating rules."""

from pyspark.sql import functions as F

from driftpool.functions import labels, weather
from driftpool.plans.catalog import query
from driftpool.plans.catalog.common import LINE, big, r
from driftpool.session import join_bounded
from driftpool.sources import tables

# daily weather from orders: extremes of the price, an urgent order as the wet-day flag
DAILY = """
daily AS (
  SELECT CAST(o_orderdate AS DATE) AS date, max(o_totalprice) / 15000.0 AS high, min(o_totalprice) / 15000.0 AS low,
         CAST(max(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS INTEGER) AS event
  FROM orders GROUP BY 1),
sun AS (
  SELECT day(o_orderdate) AS day, month(o_orderdate) AS month, 400 + (count(*) % 4) * 100 + (count(*) % 2) * 30 AS sunrise
  FROM orders GROUP BY 1, 2),
rain AS (SELECT month(o_orderdate) AS month, avg(o_totalprice) / 1000.0 AS rain FROM orders GROUP BY 1),
levels AS (
  SELECT month, rain, sum(rain) OVER () AS total,
         (rain - 0.6 * min(rain) OVER ()) / (max(rain) OVER () - min(rain) OVER () / 2.5) AS level FROM rain),
half AS (
  SELECT d.date, d.high, d.low, d.event, CAST(h - k AS INTEGER) AS time, s.sunrise, l.level
  FROM daily d CROSS JOIN range(100, 2401, 100) t(h) CROSS JOIN (VALUES (70), (0)) v(k)
  JOIN sun s ON s.day = day(d.date) AND s.month = month(d.date) JOIN levels l ON l.month = month(d.date)),
hrs AS (
  SELECT *, time // 100 + CASE WHEN time % 100 = 30 THEN 0.5 WHEN time % 100 > 30 THEN 1.0 ELSE 0 END AS hour,
         sunrise // 100 + CASE WHEN sunrise % 100 = 30 THEN 0.5 WHEN sunrise % 100 > 30 THEN 1.0 ELSE 0 END AS rise,
         CAST(('0x' || substr(md5(CAST(date AS VARCHAR) || '|' || time || '|rain'), 1, 8)) AS BIGINT) / 4294967296.0 AS u
  FROM half),
air AS (
  SELECT date, time, CASE
    WHEN hour < rise THEN (low + high) / 2 + (high - low) / 2 * cos(pi() * (hour + 10) / (10 + rise))
    WHEN hour > 14 THEN (low + high) / 2 + (high - low) / 2 * cos(pi() * (hour - 14) / (10 + rise))
    ELSE (low + high) / 2 - (high - low) / 2 * cos(pi() * (hour - rise) / (14 - rise)) END AS temp,
    CAST(CASE WHEN event = 1 AND u < level THEN 1 ELSE 0 END AS INTEGER) AS rain
  FROM hrs)"""


def _monthly(spark, folder):
    orders = tables.table(spark, folder, "orders")
    monthly = orders.groupBy(F.month("o_orderdate").alias("month")).agg((F.avg("o_totalprice") / 1000.0).alias("rain"))
    return weather.rainfall_levels(monthly)


def _air(spark, folder):
    """Half-hourly temperature and rain; day, sunrise and month tables are looked up."""
    orders = tables.table(spark, folder, "orders").select("o_orderdate", "o_totalprice", "o_orderpriority")
    urgent = F.max(F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(0))
    daily = orders.groupBy(F.to_date("o_orderdate").alias("date")).agg(
        (F.max("o_totalprice") / 15000.0).alias("high"), (F.min("o_totalprice") / 15000.0).alias("low"),
        urgent.cast("int").alias("event"))
    n = F.count("o_totalprice")
    matrix = (orders.withColumn("day", F.dayofmonth("o_orderdate")).withColumn("month", F.month("o_orderdate"))
              .groupBy("day").pivot("month", list(range(1, 13)))
              .agg((400 + n % 4 * 100 + n % 2 * 30).cast("int")).na.fill(0))
    days = daily.withColumn("day", F.dayofmonth("date")).withColumn("month", F.month("date"))
    placed = join_bounded(days, weather.long_sunrise(matrix), ["day", "month"])
    placed = join_bounded(placed, _monthly(spark, folder), ["month"])
    rows = weather.half_hours(placed)
    u = labels.uniform(F.col("date"), F.col("time"), seed="rain")
    return rows.select("date", "time",
                       weather.temperature(F.col("sunrise"), F.col("high"), F.col("low"), F.col("time")).alias("temp"),
                       weather.raining(F.col("event"), F.col("level"), u).alias("rain"))


@query("clock_hours", """SELECT event_id, CAST(hour(ts) + CASE WHEN minute(ts) = 30 THEN 0.5
  WHEN minute(ts) > 30 THEN 1.0 ELSE 0.0 END AS DOUBLE) AS hours FROM events""")
def clock_hours(spark, folder):
    hhmm = F.hour("ts") * 100 + F.minute("ts")
    return tables.table(spark, folder, "events").select("event_id", weather.hours(hhmm).alias("hours"))


@query("monthly_rainfall", f"""WITH {DAILY}
SELECT CAST(month AS INTEGER) AS month, round(rain, 6) AS rain, round(total, 6) AS total, round(level, 6) + 0.0 AS level FROM levels""")
def monthly_rainfall(spark, folder):
    m = _monthly(spark, folder)
    return m.select("month", *[r(F.col(c)).alias(c) for c in ("rain", "total", "level")])


@query("half_hourly_weather", f"""WITH {DAILY}
SELECT CAST(date AS VARCHAR) AS date, time, round(temp, 6) + 0.0 AS temp, rain FROM air""")
def half_hourly_weather(spark, folder):
    return _air(spark, folder).select(F.col("date").cast("string").alias("date"), "time", r(F.col("temp")).alias("temp"), "rain")


def _sql_rule(rule, rain, shift, limits):
    parts = [f"WHEN temp < {limit} THEN CASE WHEN {rain} = 1 THEN {wet + shift} ELSE {dry + shift} END"
             for (dry, wet), limit in zip(weather.LEVELS[rule], limits)]
    return f"CASE {' '.join(parts)} END"


def _sql_schedule(threshold):
    parts = []
    for weekend, after, before, rule, shift, limits, wet in weather.BANDS:
        days = ">= 6" if weekend else "< 6"
        heat = _sql_rule(rule, "rain" if wet else "0", shift, [f * threshold + p for f, p in limits])
        parts.append(f"WHEN isodow(date) {days} AND time > {after} AND time < {before} THEN {heat}")
    return f"CASE {' '.join(parts)} ELSE CASE WHEN temp < {threshold} THEN 12.0 END END"


@query("heating_schedule", f"""WITH {DAILY}, heat AS (SELECT date, time, temp, {_sql_schedule(8.0)} AS inside FROM air)
SELECT CAST(date AS VARCHAR) AS date, time, round(CAST(coalesce(inside, temp) AS DOUBLE), 6) + 0.0 AS d_temp,
       CAST(inside IS NOT NULL AS INTEGER) AS heating_on FROM heat""")
def heating_schedule(spark, folder):
    answer = weather.schedule(F.col("date"), F.col("time"), F.col("temp"), F.col("rain"), 8.0, 12.0)
    rows = _air(spark, folder).withColumn("s", answer)
    return rows.select(F.col("date").cast("string").alias("date"), "time", r(F.col("s.temp")).alias("d_temp"),
                       F.col("s.on").alias("heating_on"))


@query("noisy_weather", f"""WITH {DAILY}, n AS (
  SELECT date, time, temp, rain, {{u0}} AS u, {{u1}} AS a, {{u2}} AS b FROM air)
SELECT CAST(date AS VARCHAR) AS date, time,
       round(CASE WHEN u > 0.7 THEN temp + sqrt(0.5) * sqrt(-2 * ln(1 - a)) * cos(2 * pi() * b) ELSE temp END, 6) + 0.0 AS temp,
       CAST(CASE WHEN u > 0.7 THEN (rain + 1) % 2 ELSE rain END AS INTEGER) AS rain FROM n""".format(**{
    k: f"CAST(('0x' || substr(md5(CAST(date AS VARCHAR) || '|' || time || '|{s}'), 1, 8)) AS BIGINT) / 4294967296.0"
    for k, s in (("u0", "noise"), ("u1", "ga"), ("u2", "gb"))}))
def noisy_weather(spark, folder):
    key = [F.col("date"), F.col("time")]
    u = labels.uniform(*key, seed="noise")
    return _air(spark, folder).select(
        F.col("date").cast("string").alias("date"), "time",
        r(weather.noisy(F.col("temp"), 0.5, 0.3, u, weather.gauss(*key, seed="g"))).alias("temp"),
        weather.flipped(F.col("rain"), u, 0.3).cast("int").alias("rain"))


@query("concept_scores", f"""WITH {LINE}
SELECT domain, seq, round((x1 + x3 + x5) / 3, 10) + 0.0 AS mean_score, round((cos(x1) + cos(x3) + cos(x5)) / 3, 10) AS cosine_score,
       round((sin(x1) + sin(x3) + sin(x5)) / 3, 10) + 0.0 AS sine_score,
       round(least(1.0, sqrt(x1 * x1 + x3 * x3 + x5 * x5)), 10) + 0.0 AS norm_score,
       round(abs(abs(abs(x1) - x3) - x5), 10) + 0.0 AS folded_score,
       round(least(1.0, (x1 + x3 + x2 + x4) / 4), 10) + 0.0 AS composite_score FROM line""")
def concept_scores(spark, folder):
    rows = tables.line_rows(spark, folder).withColumn("features", F.array(*tables.FEATURES))
    f, picked = F.col("features"), [0, 2, 4]
    out = {f"{k}_score": labels.score(k, f, picked) for k in ("mean", "cosine", "sine", "norm", "folded")}
    out["composite_score"] = labels.composite_score("mean", f, [0, 2], [1, 3])
    return rows.select("domain", big(F.col("seq")).alias("seq"), *[r(labels.unit(v), 10).alias(k) for k, v in out.items()])


@query("concept_schedule", f"""WITH {LINE}
SELECT domain, seq, CAST(CASE WHEN seq <= 300 THEN 2 WHEN seq <= 1000 THEN 0 WHEN seq <= 1250 THEN 1
  ELSE 3 END AS INTEGER) AS concept FROM line""")
def concept_schedule(spark, folder):
    concept = weather.concept_by_schedule(F.col("seq"), [300, 700, 250, 1 << 40], [2, 0, 1, 3])
    rows = tables.line_rows(spark, folder).withColumn("concept", concept)
    return rows.select("domain", big(F.col("seq")).alias("seq"), "concept")


HASHED = "CAST(('0x' || substr(md5(domain || '|' || seq || '|{}'), 1, 8)) AS BIGINT) / 4294967296.0"


@query("gradual_mix", f"""WITH {LINE}
SELECT domain, seq, round(CASE WHEN {HASHED.format('mix')} <= (100 - (seq - 1) % 100) / 100.0
  THEN (x1 + x2 + x3) / 3 ELSE (sin(x1) + sin(x4) + sin(x5)) / 3 END, 8) + 0.0 AS y FROM line""")
def gradual_mix(spark, folder):
    rows = tables.line_rows(spark, folder)
    x = {c: F.col(c) for c in tables.FEATURES}
    y = labels.mixed(labels.mean_score([x["x1"], x["x2"], x["x3"]]), labels.sine_score([x["x1"], x["x4"], x["x5"]]),
                     (F.col("seq") - 1) % 100, 100, labels.uniform(F.col("domain"), F.col("seq"), seed="mix"))
    return rows.select("domain", big(F.col("seq")).alias("seq"), r(y, 8).alias("y"))


@query("noisy_labels", f"""WITH {LINE}
SELECT domain, seq, round(greatest(0.0, least(1.0, CASE WHEN concept >= 2 THEN 1 - (x1 + x2) / 2 ELSE (x1 + x2) / 2 END
  + CASE WHEN {HASHED.format('noise')} < 0.2 THEN 0.05 ELSE 0.0 END)), 8) + 0.0 AS y FROM stream""")
def noisy_labels(spark, folder):
    rows = tables.line_stream(spark, folder)
    u = labels.uniform(F.col("domain"), F.col("seq"), seed="noise")
    y = labels.label(labels.mean_score([F.col("x1"), F.col("x2")]), u, 0.2, F.col("concept") >= 2)
    return rows.select("domain", big(F.col("seq")).alias("seq"), r(y, 8).alias("y"))


@query("streams_chosen", """WITH d AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS domain FROM events ORDER BY md5(domain || '1'), domain LIMIT 12)
SELECT e.event_type, count(*) AS n, count(DISTINCT e.user_id) AS streams FROM events e JOIN d ON d.domain = CAST(e.user_id AS VARCHAR)
WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-03' AND DATE '2024-01-25' GROUP BY 1""")
def streams_chosen(spark, folder):
    from driftpool.sources.ingest import choose_streams, select_ranges
    rows = tables.table(spark, folder, "events").select(F.col("user_id").cast("string").alias("domain"), "event_type", F.to_date("ts").alias("date"))
    chosen = choose_streams(rows.select("domain").distinct(), 12, "1")
    ranges = chosen.select("domain", F.lit("2024-01-03").cast("date").alias("from"), F.lit("2024-01-25").cast("date").alias("to"))
    return select_ranges(rows, ranges, "date").groupBy("event_type").agg(
        F.count("*").alias("n"), F.countDistinct("domain").alias("streams"))
