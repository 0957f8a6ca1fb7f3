"""Near-duplicates by MinHash bands, with odd sketches that turn candidates away and full sets that confirm links."""

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from driftpool.llm.bounds import measured
from driftpool.llm.components import connected_components
from driftpool.session import staged, unstaged

SIZE, PERCENT, SEED = 4, 80, 42
BANDS, ROWS = 40, 4
SAMPLES = BANDS * ROWS
WORDS = 16                  # words of 64 bits of an odd sketch of samples
PARITY = 8                  # words of 64 bits of the parities of a whole set
MISS = 1e-9                 # chance that the sketches of a pair of the similarity turn it away
ROUNDS, HEAVY = 4, 1 << 22  # rounds of cheap comparisons, and comparisons of a bucket worth another one
BLOCK = 1 << 12
_CHUNK = 1 << 11


def _factors():
    odd = [xxhash.xxh64_intdigest(str(k), SEED) | 1 for k in range(SAMPLES)]
    return np.array(odd, np.uint64)[:, None]


FACTORS = _factors()


def shingles(text: str | None, size: int = SIZE) -> np.ndarray:
    """Sorted hashes of the distinct word shingles of a whole text; none without words."""
    words = (text or "").encode("utf-8").lower().split()
    n, digest, joined = len(words), xxhash.xxh64_intdigest, b" ".join(words)
    if n <= size:
        return np.array([digest(joined, SEED)] if n else [], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lengths + 1) - 1
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(
        (ends - lengths)[:n - size + 1].tolist(), ends[size - 1:].tolist())], np.uint64))


def samples(hashes: np.ndarray) -> np.ndarray:
    """The least image of a set of hashes under each of SAMPLES permutations of the 64-bit numbers."""
    least = np.full(SAMPLES, np.uint64(2 ** 64 - 1))
    for at in range(0, len(hashes), _CHUNK):
        np.minimum(least, (hashes[None, at:at + _CHUNK] * FACTORS).min(axis=1), out=least)
    return least


def _mixed(x):
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def odd_sketch(least: np.ndarray) -> np.ndarray:
    """Parities of the numbers of samples (place and value) that fall on each of 64 * WORDS bits."""
    at = _mixed(least + FACTORS[:, 0]) % np.uint64(64 * WORDS)
    odd = np.bincount(at.astype(np.int64), minlength=64 * WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def parities(hashes: np.ndarray) -> np.ndarray:
    """Parities of the numbers of shingles of a set on each of 64 * PARITY bits: sets that differ in d shingles differ
    in at most d of them."""
    at = _mixed(hashes) % np.uint64(64 * PARITY)
    odd = np.bincount(at.astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def bands(least: np.ndarray) -> np.ndarray:
    """A hash of each band of ROWS samples and its number."""
    rows = least.reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    return key.view(np.int64)


def most_apart(percent: int = PERCENT) -> int:
    """Differing bits that the sketches of two sets of the similarity exceed with a chance below MISS.

    A sample differs with a chance of 1 - similarity, and a differing sample changes two bits at most.
    """
    p, tail = 1 - percent / 100, 0.0
    for m in range(SAMPLES, -1, -1):
        tail += math.comb(SAMPLES, m) * p ** m * (1 - p) ** (SAMPLES - m)
        if tail >= MISS:
            return 2 * m
    return 0


def similarity(bits: int) -> float:
    """Jaccard similarity that a number of differing bits stands for (unbiased for high similarities)."""
    n = 64 * WORDS
    return 1 + n / (4 * SAMPLES) * math.log(max(1 - 2 * bits / n, 1e-9))


def _few(batches, rows=256):
    # a worker holds the sets of few texts at once
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _lists(parts):
    ends = np.cumsum([0] + [len(p) for p in parts])
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))


def _sketched(given, kind, size):
    none = np.zeros(0, np.int64)

    def run(batches):
        for batch in _few(batches):
            cols = [[] for _ in range(5)]
            with np.errstate(over="ignore"):
                for text in batch.column(1).to_pylist():
                    found = shingles(text, size)
                    whole = xxhash.xxh3_128_intdigest(found.tobytes())
                    least = samples(found) if len(found) else None
                    for c, x in zip(cols, (len(found), whole >> 64, whole & (1 << 64) - 1,
                                           none if least is None else np.append(odd_sketch(least), parities(found)),
                                           none if least is None else bands(least))):
                        c.append(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(cols[0], pa.int64()),
                 *[pa.array(np.array(c, np.uint64).view(np.int64)) for c in cols[1:3]], *map(_lists, cols[3:])],
                names=["id", "mark", "n", "x", "y", "sketch", "bands"])
    return given.mapInArrow(run, f"id {kind}, mark bigint, n bigint, x bigint, y bigint, sketch array<bigint>, "
                                 "bands array<bigint>")


def _sets(rows, size):
    # (node, set) of (node, text)
    def run(batches):
        for batch in _few(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists([
                shingles(t, size).view(np.int64) for t in batch.column(1).to_pylist()])], names=["node", "set"])
    return rows.mapInArrow(run, "node bigint, set array<bigint>")


def _possible(percent):
    """What sizes, sketches and parities of a and b leave open."""
    def apart(words):
        return sum((F.bit_count(F.col("sa")[k].bitwiseXOR(F.col("sb")[k])) for k in words), F.lit(0))
    sizes = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent
    # the shingles in one set only, as numbers of the sizes: (na + nb) * (1 - s) / (1 + s) at most
    whole = apart(range(WORDS, WORDS + PARITY)) * (100 + percent) <= (F.col("na") + F.col("nb")) * (100 - percent)
    return sizes & (apart(range(WORDS)) <= most_apart(percent)) & whole


def _side(rows, s, *keep):
    return rows.select(*keep, F.col("node").alias(s), F.col("n").alias(f"n{s}"), F.col("sketch").alias(f"s{s}"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE,
                    percent: int = PERCENT) -> DataFrame:
    """(id, n, component_id) of every row: size of its set of shingles, and the smallest id of its component.

    Two sets are linked if 100 * intersection >= percent * union, counted on the full sets. Candidates have the same
    samples in one of BANDS bands of ROWS; a pair at 80 % has none with a chance of 7e-10 and its sketches turn it
    away with a chance below MISS. Equal sets are one candidate. In each bucket members are first compared with one
    of them, in heavy buckets with a few; then every member outside the component that most are in is compared with
    all of other components. So each pair that shares a bucket of whatever size is compared or in one component
    already, and a group of copies costs a comparison a member. Null texts and texts without words have an empty set
    and are linked with nothing. Repeated rows are linked like equal texts, rows with a null id take part (a null is
    the smallest id only of a component that has no other). Other columns are not read.
    """
    text = F.col(f"`{text_col}`").cast("string")
    given = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"), F.xxhash64(text).alias("mark"))
    used = []

    def held(df):
        used.append(staged(df))
        return used[-1]

    rows = held(_sketched(given, docs.schema[id_col].dataType.simpleString(), size)
                .withColumn("row", F.monotonically_increasing_id()))
    texts = held(rows.filter("n > 0").groupBy("n", "x", "y").agg(
        F.min(F.struct(F.col("id").isNull(), "id", "mark")).alias("key"), F.min("row").alias("node")))
    marked = rows.join(measured(texts.select("node")), F.col("row") == F.col("node")).select("node", "n", "sketch", "bands")
    marked = held(marked)
    keyed = marked.select("node", F.explode("bands").alias("key"))
    # buckets of the same members are one
    buckets = measured(keyed.groupBy("key").agg(F.count("*").alias("many"), F.min("node").alias("lead"), *[
        F.bit_xor(F.xxhash64(F.lit(k), "node")).alias(f"h{k}") for k in (0, 1)]).filter("many > 1")
        .groupBy("many", "lead", "h0", "h1").agg(F.min("key").alias("key")).select("key", "lead"))
    members = held(keyed.join(buckets, "key"))

    def confirmed(pairs):
        ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        which = measured(texts.join(ends, "node").select("node", F.col("key.id").alias("i"), F.col("key.mark").alias("m")))
        sets = given.join(which, F.col("id").eqNullSafe(F.col("i")) & (F.col("mark") == F.col("m")))
        sets = staged(_sets(sets.select("node", "text").dropDuplicates(["node"]), size))
        # the side that many pairs may share is joined first, while rows are short
        found = held(pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("p")), "a")
                     .join(sets.select(F.col("node").alias("b"), F.col("set").alias("q")), "b")
                     .select("a", "b", F.size(F.array_intersect("p", "q")).alias("both"),
                             (F.size("p") + F.size("q")).alias("all"))
                     .filter(F.col("both") * 100 >= (F.col("all") - F.col("both")) * percent).select("a", "b"))
        unstaged(sets)
        return found

    def starred(leads, rows):
        star = rows.select("key", "node").join(leads.select("key", F.col("lead").alias("a")), "key").filter("a != node")
        star = star.select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct()
        return (star.join(_side(marked, "a"), "a").join(_side(marked, "b"), "b").filter(_possible(percent))
                .select("a", "b"))

    tried = held(starred(buckets, members))
    linked = confirmed(tried)
    for turn in range(1, ROUNDS + 1):
        root = connected_components(linked, "a", "b").select(F.col("node").alias("m"), "root")
        rooted = held(members.join(measured(root), F.col("node") == F.col("m"), "left").select(
            "key", "node", F.coalesce("root", "node").alias("root")))
        open_ = measured(rooted.groupBy("key", "root").agg(F.count("*").alias("c")).groupBy("key").agg(
            F.max_by("root", F.struct("c", "root")).alias("main"), F.sum("c").alias("many"), F.max("c").alias("most"))
            .filter("most < many"))
        heavy = open_.filter((F.col("many") - F.col("most")) * F.col("many") > HEAVY)
        if turn == ROUNDS or heavy.isEmpty():
            break
        some = rooted.join(heavy.select("key", "main"), "key")
        leads = some.filter("root != main").groupBy("key").agg(
            F.min_by("node", F.xxhash64("node", F.lit(turn))).alias("lead"))
        fresh = held(starred(leads, some).join(tried, ["a", "b"], "left_anti"))
        tried, linked = tried.unionAll(fresh), linked.unionAll(confirmed(fresh))
    cuts = F.ceil(F.col("many") / BLOCK)
    apart = rooted.join(open_, "key").join(marked.select("node", "n", "sketch"), "node")
    odd = _side(apart.filter("root != main"), "a", "key", F.col("root").alias("ra"),
                F.explode(F.sequence(F.lit(0).cast("bigint"), cuts - 1)).alias("block"))
    full = _side(apart, "b", "key", "main", F.col("root").alias("rb"), F.pmod(F.xxhash64("node"), cuts).alias("block"))
    rest = (odd.join(full, ["key", "block"]).filter("ra != rb AND (a < b OR rb = main)").filter(_possible(percent))
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    rest = held(rest.join(tried, ["a", "b"], "left_anti"))
    if not rest.isEmpty():
        linked = linked.unionAll(confirmed(rest))
    root = connected_components(linked, "a", "b").select(F.col("node").alias("m"), "root")
    rooted = held(texts.join(measured(root), F.col("node") == F.col("m"), "left").select(
        "n", "x", "y", "key", F.coalesce("root", "node").alias("root")))
    least = rooted.groupBy("root").agg(F.min("key").alias("first"))
    named = measured(rooted.join(least, "root").select("n", "x", "y", F.col("first.id").alias("component_id")))
    linked_rows = rows.select("id", "n", "x", "y").join(named, ["n", "x", "y"], "left")
    result = staged(linked_rows.select("id", "n", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
                                       .alias("component_id")))
    for table in used:
        unstaged(table)
    return result
