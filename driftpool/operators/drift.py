"""Drift of fixed predictions and model segments, as window queries on chunks."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from driftpool.plans.sequence import CHUNK_ROWS, chunk_window, next_over_chunks, tasks_for, with_halo


def _parts(over):
    """Mergeable accuracy of the rows in a frame."""
    y, error = F.col("y"), (F.col("y") - F.col("p"))
    return F.struct(F.count("*").over(over).alias("n"), F.sum(error * error).over(over).alias("res"),
                    F.avg(y).over(over).alias("mean"), F.var_pop(y).over(over).alias("var"),
                    F.min(y).over(over).alias("low"), F.max(y).over(over).alias("top"))


def rolling_r2(rows: DataFrame, keys: list[str], window: int, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """R2 of the ``window`` rows from each row on, in column ``window_r2``.

    Null while fewer rows are left. Rows are cut into blocks of one window, so
    a window is the tail of one block and the head of the next: both are
    running aggregates that cost the same for any window length, and their
    means and variances merge without cancellation. Everything stays inside a
    chunk and its halo, so one long stream is spread over many tasks.
    """
    spread = with_halo(rows, ahead=window - 1, chunk_rows=chunk_rows)
    tasks = tasks_for(rows.sparkSession, rows.count())
    spread = spread.repartition(tasks, *keys, "chunk").withColumn("_block", F.floor(F.col("seq") / window))
    inside = Window.partitionBy(*keys, "chunk", "_block")
    running = (Window.unboundedPreceding, 0)
    parts = (spread.withColumn("_head", _parts(inside.orderBy("seq").rowsBetween(*running)))
             .withColumn("_tail", _parts(inside.orderBy(F.desc("seq")).rowsBetween(*running))))
    last = F.lead(F.struct("_block", "_head"), window - 1).over(chunk_window(keys))
    both = parts.withColumn("_last", last)
    a, b = "_tail.", "_last._head."
    one = F.col("_last._block") == F.col("_block")
    n = F.lit(float(window))
    gap = F.col(b + "mean") - F.col(a + "mean")
    residual = F.when(one, F.col(a + "res")).otherwise(F.col(a + "res") + F.col(b + "res"))
    total = F.when(one, F.col(a + "n") * F.col(a + "var")).otherwise(
        F.col(a + "n") * F.col(a + "var") + F.col(b + "n") * F.col(b + "var")
        + gap * gap * F.col(a + "n") * F.col(b + "n") / n)
    flat = (F.col(a + "low") == F.col(a + "top")) & (one | (
        (F.col(b + "low") == F.col(b + "top")) & (F.col(a + "low") == F.col(b + "low"))))
    value = F.when(flat & (residual == 0), 1.0).when(flat, 0.0).otherwise(1 - residual / total)
    return (both.withColumn("window_r2", F.when(F.col("_last").isNotNull(), value))
            .filter("home").drop("home", "chunk", "_block", "_head", "_tail", "_last"))


def large_error(y: str, p: str, eps: float) -> Column:
    return F.abs(F.col(p) - F.col(y)) > eps


def drift_points(rows: DataFrame, keys: list[str], window: int, eps: float, acc: float,
                 chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Rows at which the windowed detector would report drift under fixed predictions.

    Every row with a large error opens exactly one window; it is tested when it
    holds ``window`` rows. Rows up to ``window + 1`` never enter a window.
    """
    tested = rolling_r2(rows.filter(F.col("seq") >= window + 2), keys, window, chunk_rows)
    return (tested.filter(large_error("y", "p", eps) & (F.col("window_r2") < acc))
            .select(*keys, F.col("seq").alias("opened_at"),
                    (F.col("seq") + (window - 1)).alias("drift_at"), "window_r2"))


def segments(rows: DataFrame, keys: list[str], model: str = "model_id",
             chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Runs of consecutive rows under one model, with the model that follows."""
    previous = F.lag(model).over(chunk_window(keys))
    starts = (with_halo(rows.select(*keys, "seq", model), behind=1, chunk_rows=chunk_rows)
              .withColumn("_new", F.coalesce(F.col(model) != previous, F.lit(True)))
              .filter(F.col("home") & F.col("_new")).select(*keys, "seq", model))
    ends = rows.groupBy(*keys).agg(F.max("seq").alias("_last"))
    runs = next_over_chunks(starts, keys, F.struct(F.col("seq").alias("at"), F.col(model).alias("id")),
                            "_next", chunk_rows)
    end = F.coalesce(F.col("_next.at") - 1, F.col("_last"))
    return runs.join(ends, keys).select(
        *keys, F.col(model).alias("model_id"), F.col("seq").alias("start_seq"),
        end.alias("end_seq"), (end - F.col("seq") + 1).alias("length"),
        F.col("_next.id").alias("next_model_id"))


def transitions(runs: DataFrame, keys: list[str]) -> DataFrame:
    """How often one model followed another."""
    return (runs.filter(F.col("next_model_id").isNotNull())
            .groupBy(*keys, F.col("model_id").alias("from_id"), F.col("next_model_id").alias("to_id"))
            .agg(F.count("*").alias("n")))


def transition_probabilities(counts: DataFrame, keys: list[str]) -> DataFrame:
    total = F.sum("n").over(Window.partitionBy(*keys, "from_id"))
    return counts.withColumn("probability", F.col("n") / total)


def likely_successors(counts: DataFrame, keys: list[str], prob: float,
                      substituted: DataFrame | None = None) -> DataFrame:
    """Most likely successors of each model, ties kept, at least ``prob``, not substituted."""
    place = F.rank().over(Window.partitionBy(*keys, "from_id").orderBy(F.desc("n")))
    best = (transition_probabilities(counts, keys).withColumn("_r", place)
            .filter((F.col("_r") == 1) & (F.col("probability") >= prob)).drop("_r"))
    if substituted is not None:
        gone = substituted.select(*keys, F.col("model_id").alias("to_id"))
        best = best.join(gone, keys + ["to_id"], "left_anti")
    return best


def substitute(counts: DataFrame, renames: DataFrame, keys: list[str]) -> DataFrame:
    """Merge the transitions of replaced models into their substitutes."""
    first = renames.select(*keys, F.col("model_id").alias("from_id"), F.col("sub_id").alias("_from"))
    second = renames.select(*keys, F.col("model_id").alias("to_id"), F.col("sub_id").alias("_to"))
    named = (counts.join(first, keys + ["from_id"], "left").join(second, keys + ["to_id"], "left")
             .select(*keys, F.coalesce("_from", "from_id").alias("from_id"),
                     F.coalesce("_to", "to_id").alias("to_id"), "n"))
    return named.groupBy(*keys, "from_id", "to_id").agg(F.sum("n").alias("n"))
