"""Concept scores that make labels drift, and hashed randomness."""

from pyspark.sql import Column, functions as F

# Noise added to a label.
LABEL_NOISE = 0.05


def uniform(*parts: Column, seed: str = "") -> Column:
    """Repeatable number in [0,1) from key columns: first 32 bits of an md5."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts], F.lit(seed))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 4294967296.0


def _total(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out


def mean_score(xs: list[Column]) -> Column:
    return _total(xs) / len(xs)


def cosine_score(xs: list[Column]) -> Column:
    return _total([F.cos(x) for x in xs]) / len(xs)


def sine_score(xs: list[Column]) -> Column:
    return _total([F.sin(x) for x in xs]) / len(xs)


def norm_score(xs: list[Column]) -> Column:
    return F.sqrt(_total([x * x for x in xs]))


def folded_score(xs: list[Column]) -> Column:
    """Fold ``abs(total - x)`` from 0 over the chosen features."""
    out = F.abs(xs[0])
    for x in xs[1:]:
        out = F.abs(out - x)
    return out


SCORES = {"mean": mean_score, "cosine": cosine_score, "sine": sine_score,
          "norm": norm_score, "folded": folded_score}


def score(kind: str, features: Column, picked: list[int]) -> Column:
    """Score of the picked feature positions (from 0); one repeated position folds to its mean."""
    if kind == "folded" and len(set(picked)) == 1:
        kind = "mean"
    return SCORES[kind]([features[i] for i in picked])


def composite_score(kind: str, features: Column, first: list[int], second: list[int]) -> Column:
    """Score over the features of two concepts together."""
    return score(kind, features, list(first) + list(second))


def unit(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def label(value: Column, u: Column, noise: float, conflicting: Column | None = None) -> Column:
    """Turn a score into a label: flip conflicting concepts, add noise, clip."""
    if conflicting is not None:
        value = F.when(conflicting, 1 - value).otherwise(value)
    return unit(value + F.when(u < noise, LABEL_NOISE).otherwise(0.0))


def mixed(old: Column, new: Column, step: Column, length: int, u: Column) -> Column:
    """Gradual drift: row ``step`` (from 0) keeps the old concept with falling probability."""
    return F.when(u <= (length - step) / F.lit(float(length)), old).otherwise(new)


def concept_at(seq: Column, length: int, concepts: int) -> Column:
    """Concept of a row when equal segments take turns."""
    return (F.floor((seq - 1) / length) % concepts).cast("int")
