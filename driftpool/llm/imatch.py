"""I-Match fingerprints: hashes of the terms of a text that fall into randomised subsets of a lexicon."""

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from driftpool.session import staged

# share of the documents a term of the lexicon is in: bounds of the band of inverse document frequency.
# The lexicon has at most (mean number of distinct words of a text) / LOW terms, whatever the corpus.
LOW, HIGH = 0.0005, 0.2
SUBSETS = 16
LEVELS = 40
SEED = 42
EDGES = ".,;:!?\"'()[]{}<>%&$#*|`~/\\-_+="
FLUSH = 400_000


def distinct_words(text: str | None) -> set[str]:
    words = {w.strip(EDGES) for w in (text or "").lower().split()}
    words.discard("")
    return words


def document_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Staged (word, n): in how many rows a word is; the row with null word counts all rows."""
    def run(batches):
        counts, rows = Counter(), 0
        for batch in batches:
            rows += batch.num_rows
            for text in batch.column(0).to_pylist():
                counts.update(distinct_words(text))
            if len(counts) > FLUSH:
                yield table(counts)
                counts = Counter()
        counts[None] = rows
        yield table(counts)

    def table(counts):
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())],
                                          names=["word", "n"])
    partial = docs.select(F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, "word string, n bigint")
    return partial.groupBy("word").agg(F.sum("n").alias("n"))


def lexicon(docs: DataFrame, text_col: str = "text", low: float = LOW, high: float = HIGH) -> list[str]:
    """Terms of the band, sorted. Their number is bounded by ``low``, so the driver may hold them."""
    counts = document_counts(docs, text_col)
    counts = staged(counts.filter("word IS NULL OR n > 1"))
    total = counts.filter("word IS NULL").agg(F.sum("n")).first()[0] or 0
    found = counts.filter(F.col("word").isNotNull() & (F.col("n") >= low * total) & (F.col("n") <= high * total))
    return sorted(r["word"] for r in found.select("word").collect())


class Matcher:
    """Fingerprints under one lexicon.

    A subset takes each term with a chance of 2 ** -level by a keyed hash. A text uses the level at which about one
    of its terms is left, and the two beside it, so texts of all lengths have subsets that small changes leave alone.
    """

    def __init__(self, words: list[str], subsets: int = SUBSETS, seed: int = SEED):
        self.hash = {w: xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), seed) for w in words}
        keys = np.arange(1, subsets + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        self.keys, self.subsets = keys, subsets

    def fingerprint(self, text: str | None) -> str:
        """``level:hex...``: four digits for every subset of three levels, 0000 for one without terms.

        A text without terms of the lexicon has ``x:`` and a hash of all its words.
        """
        words = distinct_words(text)
        terms = sorted(words & self.hash.keys())
        if not terms:
            return "x:" + xxhash.xxh64_hexdigest("\n".join(sorted(words)).encode("utf-8", "surrogatepass"))
        level = max(1, min(LEVELS - 1, round(float(np.log2(len(terms))))))
        own = np.fromiter(map(self.hash.__getitem__, terms), np.uint64, len(terms))
        with np.errstate(over="ignore"):
            x = (own[None, :] ^ self.keys[:, None]) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(32)
        out = []
        for at in (level - 1, level, level + 1):
            subset, term = np.nonzero(x < np.uint64(1 << (64 - at)) if at else np.ones(x.shape, bool))
            cuts = np.searchsorted(subset, np.arange(self.subsets + 1)).tolist()
            term = term.tolist()
            for a, b in zip(cuts, cuts[1:]):
                value = xxhash.xxh32_intdigest("\n".join([terms[k] for k in term[a:b]]).encode("utf-8", "surrogatepass"))
                out.append(f"{value % 65535 + 1:04x}" if b > a else "0000")
        return f"{level:02d}:" + "".join(out)


def likeness(a: str, b: str) -> float:
    """Share of equal hashes among the subsets, of levels both have, in which either has terms; 1 for equal ones."""
    if a == b:
        return 1.0
    if a[0] == "x" or b[0] == "x":
        return 0.0
    la, lb = int(a[:2]), int(b[:2])
    ha, hb = a[3:], b[3:]
    each = len(ha) // 3
    low, high = max(la, lb) - 1, min(la, lb) + 1
    same = either = 0
    for level in range(low, high + 1):
        x, y = ha[(level - la + 1) * each:(level - la + 2) * each], hb[(level - lb + 1) * each:(level - lb + 2) * each]
        for k in range(0, each, 4):
            p, q = x[k:k + 4], y[k:k + 4]
            if p != "0000" or q != "0000":
                either += 1
                same += p == q
    return same / either if either else 0.0


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by as much of the beginning of ``following``."""
    k = len(text) // 4
    return text[:len(text) - k] + following[:k]


COLUMNS = ("n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, "
           "near_next double")


def _judged(matcher, ids, text, own, following, other):
    changed = edited(text, following)
    print_ = matcher.fingerprint(changed)
    return [ids, len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), own, print_,
            likeness(own, print_), likeness(own, other)]


def compared(docs: DataFrame, words: list[str], id_col: str = "doc_id", text_col: str = "text",
             subsets: int = SUBSETS) -> DataFrame:
    """(id, ...COLUMNS) of every row, beside its edited text and the next row in ascending order of id.

    Null texts are empty. Equal ids follow a hash of their text; a null id comes first; after the last row comes
    the first. Rows are dealt to ordered ranges, so each task sees its rows with their followers; the last row of a
    range meets the first of the next in a second, small job.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"), F.xxhash64(text).alias("tie"))
    ordered = rows.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie")
    sent = spark.sparkContext.broadcast(words)
    names = ["id", *[c.split()[0] for c in COLUMNS.split(", ")]]
    key = pa.field("x", pa.int64())

    def run(batches):
        matcher, part = Matcher(sent.value, subsets), TaskContext.get().partitionId()
        last = None
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                out, texts = [], batch.column(1).slice(lo, 500).to_pylist()
                keys = batch.column(0).slice(lo, 500).to_pylist()
                for i, t in zip(keys, texts):
                    own = matcher.fingerprint(t)
                    if last is None:
                        out.append(["head", part, i, None, None, None, None, None, None, t])
                    else:
                        out.append(["row", part, *_judged(matcher, *last, t, own), None])
                    last = (i, t, own)
                if out:
                    yield table(out, batch.schema.field(0).type)
        if last is not None:
            yield table([["tail", part, last[0], None, None, None, None, None, None, last[1]]], None)

    def table(out, id_type):
        cols = list(zip(*out))
        types = [pa.string(), pa.int32(), id_type or known[0], pa.int64(), pa.string(), pa.string(), pa.string(),
                 pa.float64(), pa.float64(), pa.string()]
        if id_type:
            known[:] = [id_type]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                          names=["what", "part", *names, "text"])
    known = [key.type]
    found = staged(ordered.mapInArrow(run, f"what string, part int, id {kind}, {COLUMNS}, text string"))
    # one number for each range
    parts = sorted(r["part"] for r in found.filter("what = 'tail'").select("part").collect())
    if not parts:
        return found.select(*names)
    order = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part int, next int")
    heads = found.filter("what = 'head'").select(F.col("part").alias("next"), F.col("text").alias("following"))
    ends = found.filter("what = 'tail'").select("part", "id", "text").join(order, "part").join(heads, "next")

    def finish(batches):
        matcher = Matcher(sent.value, subsets)
        for batch in batches:
            out = [_judged(matcher, i, t, matcher.fingerprint(t), f, matcher.fingerprint(f))
                   for i, t, f in zip(*(c.to_pylist() for c in batch.columns))]
            types = [batch.schema.field(0).type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
    closed = ends.select("id", "text", "following").mapInArrow(finish, f"id {kind}, {COLUMNS}")
    return found.filter("what = 'row'").select(*names).unionAll(closed)


def fingerprints(docs: DataFrame, words: list[str], id_col: str = "doc_id", text_col: str = "text",
                 subsets: int = SUBSETS) -> DataFrame:
    """(id, fingerprint) of every row, without comparisons."""
    sent = docs.sparkSession.sparkContext.broadcast(words)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        matcher = Matcher(sent.value, subsets)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(
                [matcher.fingerprint(t) for t in batch.column(1).to_pylist()], pa.string())], names=["id", "fingerprint"])
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(
        run, f"id {kind}, fingerprint string")
