"""Scoring rows with models: one row, one pool, one ensemble."""

from pyspark.sql import Column, DataFrame, functions as F

from driftpool.session import bounded_groups, join_bounded


def linear(features: Column, coef: Column, intercept: Column) -> Column:
    """Dot product in fixed order, evaluated inside the JVM."""
    return F.aggregate(F.zip_with(features, coef, lambda a, b: a * b), F.lit(0.0),
                       lambda t, v: t + v) + intercept


def linear_columns(xs: list[str], coef: Column, intercept: Column) -> Column:
    """Same for features in plain columns: no array is built per row."""
    total = F.lit(0.0)
    for i, x in enumerate(xs):
        total = total + F.col(x) * coef[i]
    return total + intercept


def biased(features: Column) -> Column:
    """Degree-1 polynomial step with a bias column in front."""
    return F.concat(F.array(F.lit(1.0)), features)


def default_prediction(window: int, value: Column, p: Column) -> Column:
    """Rows of the burn-in get the default, later ones the model."""
    return F.when(F.col("seq") <= window, value).otherwise(p)


def score_pool(rows: DataFrame, models: DataFrame, on: list[str] | None = None,
               features: str = "features", max_models: int = 100_000) -> DataFrame:
    """Every row with every model of its domain's pool: ``model_id`` and ``p`` per pair.

    ``rows`` stay where they are while the model table is small.
    """
    pairs = join_bounded(rows, models, on or ["domain"], max_rows=max_models)
    return (pairs.withColumn("p", linear(F.col(features), F.col("coef"), F.col("intercept")))
            .drop("coef", "intercept"))


def pooled(models: DataFrame, keys: list[str], max_pool: int = 1000) -> DataFrame:
    """A pool as one row: arrays of ids, coefficients and intercepts in id order.

    A pool larger than ``max_pool`` is an error and not cut: its predictions
    belong in the long form of ``score_pool``.
    """
    models = bounded_groups(models.select(*keys, "model_id", "coef", "intercept"), keys, max_pool)
    one = F.struct("model_id", "coef", "intercept")
    return models.groupBy(*keys).agg(F.array_sort(F.collect_list(one)).alias("pool"))


def score_wide(rows: DataFrame, models: DataFrame, keys: list[str],
               features: str = "features") -> DataFrame:
    """One row per input row with an array of predictions ``preds`` in model-id order."""
    joined = join_bounded(rows, pooled(models, keys), keys)
    return joined.withColumn("preds", F.transform(
        "pool", lambda m: linear(F.col(features), m["coef"], m["intercept"]))).drop("pool")


def combined(preds: Column, weights: Column, intercept: Column) -> Column:
    """Weighted prediction of one row's base predictions."""
    return linear(preds, weights, intercept)


def normalised(preds: Column, weights: Column) -> Column:
    """Weighted mean of base predictions; weights that sum to 0 give the plain mean."""
    total = F.aggregate(weights, F.lit(0.0), lambda t, v: t + v)
    plain = F.aggregate(preds, F.lit(0.0), lambda t, v: t + v) / F.size(preds)
    return F.when(total == 0, plain).otherwise(linear(preds, weights, F.lit(0.0)) / total)


def greatest_difference(pairs: DataFrame, keys: list[str], left: str, right: str) -> DataFrame:
    """Largest absolute difference of two models on the same rows."""
    return pairs.groupBy(*keys).agg(F.max(F.abs(F.col(left) - F.col(right))).alias("max_diff"))
