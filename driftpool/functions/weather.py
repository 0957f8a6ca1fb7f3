"""Half-hourly weather from daily values, and heating rules on top of it."""

import math
from itertools import chain

from pyspark.sql import Column, DataFrame, functions as F

from driftpool.functions.labels import uniform

# Hour of the daily maximum, hours from it to midnight and on to sunrise.
WARMEST_HOUR = 14
EVENING_HOURS = 10

# Indoor temperature by rule, as (dry, wet) per level of outside temperature.
LEVELS = {
    "morning": ((22.0, 24.0), (20.0, 20.0)),
    "mid": ((22.0, 22.0), (20.0, 21.0)),
    "night": ((12.0, 14.0),),
}

# Fixed values: (weekend, after, before, rule, shift, limits as (factor, plus) of the threshold, rain counts).
# Times are HHMM and both bounds are strict.
BANDS = (
    (False, 500, 730, "morning", 0.0, ((1.0, 0.0), (2.0, 0.0)), True),
    (False, 1800, 2100, "mid", 0.0, ((1.0, 2.0), (2.0, 1.0)), True),
    (False, 2100, 2330, "night", 0.0, ((1.0, 2.0),), True),
    (True, 630, 900, "night", 4.0, ((1.5, 0.0),), True),
    (True, 1300, 1400, "night", 2.0, ((1.5, 0.0),), False),
    (True, 1600, 1700, "night", 2.0, ((1.5, 0.0),), False),
    (True, 1800, 2100, "mid", -2.0, ((1.0, 2.0), (2.0, 1.0)), True),
    (True, 2100, 2400, "night", -1.0, ((1.0, 2.0),), True),
)


def hours(hhmm: Column) -> Column:
    """HHMM to hours: half past counts half, anything later counts the full hour."""
    past = hhmm % 100
    return F.floor(hhmm / 100) + F.when(past == 30, 0.5).when(past > 30, 1.0).otherwise(0.0)


def temperature(sunrise: Column, high: Column, low: Column, hhmm: Column) -> Column:
    """Daily curve: warming by half a cosine from sunrise to 14:00, cooling outside it."""
    rise, hour = hours(sunrise), hours(hhmm)
    middle, swing = (low + high) / 2, (high - low) / 2
    cooling = F.when(hour < rise, hour + EVENING_HOURS).otherwise(hour - WARMEST_HOUR)
    return F.when(
        (hour < rise) | (hour > WARMEST_HOUR),
        middle + swing * F.cos(math.pi * cooling / (EVENING_HOURS + rise)),
    ).otherwise(middle - swing * F.cos(math.pi * (hour - rise) / (WARMEST_HOUR - rise)))


def half_hours(days: DataFrame) -> DataFrame:
    """48 rows per day: every full hour 100..2400 and the half hour before it."""
    hour = F.explode(F.sequence(F.lit(100), F.lit(2400), F.lit(100)))
    return (days.withColumn("_h", hour)
            .withColumn("time", F.explode(F.array(F.col("_h") - 70, F.col("_h")))).drop("_h"))


def long_sunrise(matrix: DataFrame) -> DataFrame:
    """Day x month matrix to ``day, month, sunrise``; zeros mark days that do not exist."""
    months = [c for c in matrix.columns if c != "day"]
    long = matrix.unpivot("day", months, "month", "sunrise")
    return long.filter(F.col("sunrise") > 0).withColumn("month", F.col("month").cast("int"))


def rainfall_levels(monthly: DataFrame) -> DataFrame:
    """Monthly rainfall with its total and its share of the yearly range (12 rows)."""
    packed = monthly.agg(F.collect_list(F.struct("month", "rain")).alias("m"), F.sum("rain").alias("total"),
                         F.min("rain").alias("low"), F.max("rain").alias("top"))
    return packed.select(F.explode("m").alias("m"), "total", "low", "top").select(
        "m.month", "m.rain", "total",
        ((F.col("m.rain") - F.col("low") * 0.6) / (F.col("top") - F.col("low") / 2.5)).alias("level"))


def raining(event: Column, level: Column, u: Column) -> Column:
    return F.when((event == 1) & (u < level), 1).otherwise(0)


def flipped(rain: Column, u: Column, probability: float) -> Column:
    """Noise on a flag: flip it with the given probability."""
    return F.when(u > 1 - probability, (rain + 1) % 2).otherwise(rain)


def gauss(*parts: Column, seed: str) -> Column:
    """Repeatable standard normal number from two hashed uniforms."""
    a, b = uniform(*parts, seed=seed + "a"), uniform(*parts, seed=seed + "b")
    return F.sqrt(-2 * F.log(1 - a)) * F.cos(2 * math.pi * b)


def noisy(mean: Column, variance: float, probability: float, u: Column, normal: Column) -> Column:
    """Replace a value by a normal draw around it with the given probability."""
    return F.when(u > 1 - probability, mean + math.sqrt(variance) * normal).otherwise(mean)


def _answer(temp: Column, on: int) -> Column:
    return F.struct(temp.cast("double").alias("temp"), F.lit(on).alias("on"))


def unheated(outside: Column, threshold: float, base: float) -> Column:
    return F.when(outside < threshold, _answer(F.lit(base), 1)).otherwise(_answer(outside, 0))


def band_rule(rule: str, outside: Column, rain: Column, shift: float, limits: list[float]) -> Column:
    """Indoor temperature of one rule: levels by outside temperature, wet days differ."""
    out = None
    for (dry, wet), limit in zip(LEVELS[rule], limits):
        level = _answer(F.when(rain == 1, wet + shift).otherwise(dry + shift), 1)
        out = F.when(outside < limit, level) if out is None else out.when(outside < limit, level)
    return out.otherwise(_answer(outside, 0))


def schedule(date: Column, time: Column, outside: Column, rain: Column, threshold: float, base: float) -> Column:
    """``struct(temp, on)`` of the weekday and weekend schedule."""
    weekend = F.weekday(date) >= 5
    out = None
    for on_weekend, after, before, rule, shift, limits, wet in BANDS:
        inside = (weekend == F.lit(on_weekend)) & (time > after) & (time < before)
        value = band_rule(rule, outside, rain if wet else F.lit(0), shift,
                          [f * threshold + p for f, p in limits])
        out = F.when(inside, value) if out is None else out.when(inside, value)
    return out.otherwise(unheated(outside, threshold, base))


def away(outside: Column, threshold: float, base: float) -> Column:
    """Schedule of an empty house."""
    return unheated(outside, threshold, base)


def concept_by_schedule(seq: Column, lengths: list[int], concepts: list[int]) -> Column:
    """Concept of a row under segments of unequal length; null behind the last one."""
    ends, total = [], 0
    for n in lengths:
        total += n
        ends.append(total)
    passed = F.size(F.filter(F.array(*[F.lit(e).cast("bigint") for e in ends]), lambda e: e < seq))
    names = F.create_map(*chain.from_iterable((F.lit(i), F.lit(c)) for i, c in enumerate(concepts)))
    return names[passed]
