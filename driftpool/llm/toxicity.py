"""Toxicity: gradient-boosted trees over dense text features, with isotonic calibration."""

import re

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from driftpool.llm.bounds import narrow, worker_store
from driftpool.session import staged

# fixed values: insults that hold in any corpus; the rest of the lexicon is learned from labels
LEXICON = ("arschloch bastard bitch bullshit clown connard crap cretin cretino damn disgusting dumb dummkopf estupido "
           "filth fool fuck fucking garbage hate idiot idiota idiote idioten imbecile jerk kill loser lowlife merde "
           "mierda moron pathetic pig puta retard scheisse scum shit slut stupid sucks trash ugly useless vermin whore "
           "worthless").split()
SECOND_PERSON = frozenset("you your yours yourself u ur du dein deine dich dir ihr euch tu te toi vous votre usted "
                          "ustedes ti".split())
# fixed values: characters that stand for letters in disguised words
DISGUISE = str.maketrans("013457@$!|", "oieastasil", "*_.-'")

EDGES = ".,;:!?\"'()[]{}<>%&$#*|`~/\\"
INSIDE = re.compile(r"[^\W\d_]+[0-9@$!|*_.\-]+[^\W\d_][\w@$!|*.\-]*")
UPPER = bytes(range(65, 91))
PUNCTUATION = bytes(b for b in range(33, 127) if not chr(b).isalnum())
DIGITS = b"0123456789"
NEAR = 4
NAMES = ("words", "given", "given_density", "learned", "learned_density", "near_second_person", "second_person",
         "capitals", "shouted", "punctuation", "exclamations", "digits", "obfuscated", "disguised", "single_letters",
         "word_length")

MAX_TRAIN_ROWS = 20_000
MIN_SUPPORT = 5
LEARNED_WORDS = 200
THRESHOLD = 0.7


def words_of(text: str | None) -> list[str]:
    return [w for w in (x.strip(EDGES) for x in (text or "").lower().split()) if w]


def features(text: str | None, learned: frozenset, given: frozenset = frozenset(LEXICON)) -> list[float]:
    """Dense features of one whole text, in the order of NAMES; an empty text gives zeros."""
    text = text or ""
    words = words_of(text)
    n, raw = max(1, len(words)), text.encode("utf-8", "replace")
    size = max(1, len(raw))
    hits = [i for i, w in enumerate(words) if w in given]
    more = [i for i, w in enumerate(words) if w in learned]
    second = [i for i, w in enumerate(words) if w in SECOND_PERSON]
    near = 0
    if hits or more:
        at = np.array(second or [-10**9])
        for i in {*hits, *more}:
            k = np.searchsorted(at, i)
            near += min(abs(int(at[j]) - i) for j in (k - 1, k) if 0 <= j < len(at)) <= NEAR
    odd = INSIDE.findall(text.lower())
    disguised = sum(w.strip(EDGES).translate(DISGUISE) in given for w in odd)
    count = lambda kept: size - len(raw.translate(None, kept)) if raw else 0
    return [np.log1p(len(words)), np.log1p(len(hits)), len(hits) / n, np.log1p(len(more)), len(more) / n,
            near / n, len(second) / n, count(UPPER) / size, sum(w.isupper() and len(w) > 1 for w in text.split()) / n,
            count(PUNCTUATION) / size, raw.count(b"!") / size, count(DIGITS) / size, len(odd) / n,
            float(disguised), sum(len(w) == 1 for w in words) / n, sum(map(len, words)) / n]


def _features(learned):
    @pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        worker_store("toxicity")
        return pd.Series([features(t, learned) for t in texts], dtype=object)
    return run


def _distinct_words():
    @pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([sorted(set(words_of(t))) for t in texts], dtype=object)
    return run


def remainder(id_column: Column) -> Column:
    """crc32 of an id's text mod 3; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit(""))) % 3


def unused(df: DataFrame, name: str) -> str:
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


class Model:
    """Learned words, trees and calibration; ``None`` trees mean a constant score."""

    def __init__(self, learned, trees, levels, constant):
        self.learned, self.trees, self.levels, self.constant = learned, trees, levels, constant

    def score(self, docs: DataFrame, text_col: str, name: str = "score") -> DataFrame:
        """All rows and columns of ``docs`` with a score in 0..1 beside them."""
        if self.trees is None:
            return docs.withColumn(name, F.lit(float(self.constant)))
        at = unused(docs, "toxic_features")
        rows = docs.withColumn(at, array_to_vector(_features(self.learned)(F.col(text_col).cast("string"))))
        trees = self.trees.copy().setFeaturesCol(at).setPredictionCol(unused(docs, "toxic_label"))
        trees = trees.setRawPredictionCol(unused(docs, "toxic_raw")).setProbabilityCol(unused(docs, "toxic_chance"))
        raw = vector_to_array(F.col(trees.getProbabilityCol()))[1]
        return trees.transform(rows).select(*[F.col(f"`{c}`") for c in docs.columns],
                                            self._calibrated(raw).alias(name))

    def _calibrated(self, raw):
        # linear between the steps of the isotonic fit, which are a few numbers; a thousandth of the raw
        # score keeps the order of rows within a flat step
        xs, ys = self.levels
        value = F.lit(float(ys[-1]))
        for k in range(len(xs) - 1, 0, -1):
            width = max(xs[k] - xs[k - 1], 1e-12)
            value = F.when(raw < float(xs[k]), float(ys[k - 1]) + (raw - float(xs[k - 1]))
                           * float((ys[k] - ys[k - 1]) / width)).otherwise(value)
        value = F.when(raw < float(xs[0]), float(ys[0])).otherwise(value)
        return 0.999 * value + 0.001 * raw


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        max_rows: int = MAX_TRAIN_ROWS, seed: int = 7) -> Model:
    """Fit on labelled rows whose ``remainder`` is not 1.

    At most ``max_rows`` of them are used, those with the least hash of their id. A quarter of these fits the
    calibration, the rest the learned words and the trees. Rows with a null label are left out; of repeated labels
    of an id the highest counts. Without both classes in either part the score is the share of label 1, or 0.
    """
    narrow(docs.sparkSession)
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("label"))
    marked = (marked.filter(F.col("label").isNotNull() & F.col("id").isNotNull() & (remainder(F.col("id")) != 1))
              .groupBy("id").agg(F.max("label").alias("label"))
              .orderBy(F.xxhash64("id"), "id").limit(max_rows))   # bounded by max_rows: safe to broadcast
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    # copies of one id share its label; they are bounded again after the join
    rows = rows.join(F.broadcast(marked), "id").orderBy(F.xxhash64("id", "text"), "id").limit(max_rows)
    rows = rows.withColumn("part", F.when(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(4)) == 0, "calibrate")
                           .otherwise("trees"))
    rows = staged(rows.repartition(16, "id"))    # the limit leaves them in one partition
    sides = {(r["part"], r["label"]): r["n"] for r in rows.groupBy("part", "label").agg(F.count("*").alias("n")).collect()}
    total, ones = sum(sides.values()), sum(n for (_, y), n in sides.items() if y == 1)
    if any((part, y) not in sides for part in ("trees", "calibrate") for y in (0.0, 1.0)):
        return Model(frozenset(), None, None, ones / total if total else 0.0)
    learned = _learn_words(rows.filter("part = 'trees'"), sides[("trees", 1.0)], sides[("trees", 0.0)])
    table = staged(rows.select("label", "part", _features(learned)("text").alias("x")))
    table = table.select("label", "part", array_to_vector("x").alias("x"))
    trees = GBTClassifier(featuresCol="x", labelCol="label", maxIter=12, maxDepth=3, stepSize=0.3, maxBins=24,
                          seed=seed).fit(table.filter("part = 'trees'").coalesce(2))
    chance = trees.transform(table.filter("part = 'calibrate'")).select(
        "label", vector_to_array("probability")[1].alias("raw"))
    steps = IsotonicRegression(featuresCol="raw", labelCol="label").fit(chance.coalesce(1))
    return Model(learned, trees, (steps.boundaries.toArray(), steps.predictions.toArray()), None)


def _learn_words(rows, ones, zeros):
    counts = (rows.select("label", F.explode(_distinct_words()("text")).alias("word"))
              .groupBy("word").agg(F.sum(F.col("label")).alias("p"), F.sum(1 - F.col("label")).alias("q")))
    odds = F.log((F.col("p") + 0.5) / (ones + 1)) - F.log((F.col("q") + 0.5) / (zeros + 1))
    best = (counts.filter((F.col("p") >= MIN_SUPPORT) & (odds > 2.5))
            .orderBy(F.desc("p"), "word").limit(LEARNED_WORDS).select("word").collect())
    return frozenset(r["word"] for r in best)


def judged(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
           threshold: float = THRESHOLD) -> DataFrame:
    """(id, held_out, score, predicted) of every row. Empty and null texts have all features 0 and a score as well."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return model.score(rows, "text").select(
        "id", (remainder(F.col("id")) == 1).alias("held_out"), "score",
        F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
