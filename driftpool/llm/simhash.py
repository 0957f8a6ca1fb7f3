"""Near-duplicates: SimHashes found through deletion-variant signatures, and links of exact Jaccard similarity behind them."""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from driftpool.llm.bounds import measured, narrow, worker_store
from driftpool.llm.components import connected_components
from driftpool.session import staged, unstaged

BITS = 64
# pairs of members of two neighbouring buckets beyond which masks are enumerated instead of pairs
HOT_PAIRS = 1 << 24
SEED = 42


def fingerprint(text: str | None, size: int) -> int:
    """Unsigned 64-bit SimHash of word shingles; 0 without words."""
    words = (text or "").encode("utf-8").lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if n <= size:
        return digest(joined, SEED)
    lengths = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lengths + 1) - 1
    starts, ends = (ends - lengths)[:n - size + 1].tolist(), ends[size - 1:].tolist()
    total = len(starts)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, total, 1 << 15):
        part = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at:at + (1 << 15)], ends[at:at + (1 << 15)])],
                        "<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > total, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """(id, fingerprint) of every row; the fingerprint is the signed form of 64 bits. Null text has no words: 0."""
    def run(batches):
        for batch in batches:
            values = np.array([fingerprint(t, size) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))],
                                             names=["id", "fp"])
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, fp bigint")


def segments(radius: int) -> list[tuple[int, int]]:
    """(shift, width) of the fewest segments of which one differs in at most one bit."""
    n = radius // 2 + 1
    cuts = [BITS * k // n for k in range(n + 1)]
    return [(lo, hi - lo) for lo, hi in zip(cuts, cuts[1:])]


def _mask(width):
    value = (1 << width) - 1
    return F.lit(value - (1 << 64) if value >= 1 << 63 else value).cast("bigint")


def _cut(fp, shift, width):
    return F.shiftrightunsigned(fp, shift).bitwiseAND(_mask(width))


def links(fps: DataFrame, radius: int = 3, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """Pairs (a, b) of the distinct values in ``fp`` that connect all values at Hamming distance <= ``radius``.

    Of the segments of two such values one differs in at most one bit. Distinct segment values are indexed
    under themselves with one bit deleted, once for each bit; equal keys are neighbouring segment values.
    Members of equal or neighbouring segment values are joined and verified. Where two buckets would give more
    than ``hot_pairs`` comparisons, their members are instead indexed under the rest of their bits with every
    choice of the remaining differences deleted, and linked to the least of each key: linear in the bucket,
    and no link between different values is lost.
    """
    spark = fps.sparkSession
    cuts = segments(radius)
    kept = staged(fps.select("fp").distinct())
    parts = staged(kept.select("fp", F.posexplode(F.array(*[_cut(F.col("fp"), s, w) for s, w in cuts]))
                               .alias("seg", "value")))
    buckets = staged(parts.groupBy("seg", "value").agg(F.count("*").alias("n")))
    wild = None
    for seg, (_, width) in enumerate(cuts):
        own = (buckets.filter(F.col("seg") == seg)
               .select("seg", "value", "n", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("bit")))
        bit = F.expr("shiftleft(1L, bit)")
        own = own.select("seg", "value", "n", "bit", (F.col("value").bitwiseAND(bit) != 0).alias("set"),
                         F.col("value").bitwiseAND(F.bitwise_not(bit)).alias("key"))
        wild = own if wild is None else wild.unionAll(own)
    left = wild.filter(~F.col("set")).select("seg", "bit", "key", F.col("value").alias("v"), F.col("n").alias("nv"))
    right = wild.filter("set").select("seg", "bit", "key", F.col("value").alias("w"), F.col("n").alias("nw"))
    # Spark takes a table for as large as before it was exploded: without the hint it may broadcast all of this one
    near = (left.join(right.hint("merge"), ["seg", "bit", "key"])
            .select("seg", "v", "w", (F.col("nv") * F.col("nw")).alias("pairs")))
    same = buckets.filter("n > 1").select("seg", F.col("value").alias("v"), F.col("value").alias("w"),
                                          (F.col("n") * F.col("n")).alias("pairs"))
    met = staged(near.unionAll(same))
    cold = met.filter(F.col("pairs") <= hot_pairs)
    a = parts.select("seg", F.col("value").alias("v"), F.col("fp").alias("a"))
    b = parts.select("seg", F.col("value").alias("w"), F.col("fp").alias("b"))
    verified = (cold.join(a, ["seg", "v"]).join(b, ["seg", "w"])
                .filter((F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
                        & ((F.col("v") != F.col("w")) | (F.col("a") < F.col("b")))).select("a", "b"))
    hot = met.filter(F.col("pairs") > hot_pairs)
    if hot.isEmpty():
        return verified
    return verified.unionAll(_masked(spark, hot, parts, cuts, radius))


def _masked(spark, hot, parts, cuts, radius):
    sides = hot.select("seg", "v", "w", F.explode(F.array_distinct(F.array("v", "w"))).alias("value"))
    members = sides.join(parts, ["seg", "value"])
    out = []
    for seg, (shift, width) in enumerate(cuts):
        own = members.filter(F.col("seg") == seg)
        rest = [k for k in range(BITS) if not shift <= k < shift + width]
        for apart in (0, 1):
            masks = _choices(spark, rest, radius - apart)
            some = own.filter((F.col("v") == F.col("w")) if apart == 0 else (F.col("v") != F.col("w")))
            # the masks are a fixed table of at most a few thousand numbers, whatever the input
            keyed = some.join(F.broadcast(masks)).withColumn("left", F.col("fp").bitwiseAND(F.bitwise_not("mask")
                                                             .bitwiseAND(F.lit(_outside(shift, width)))))
            keys = ["seg", "v", "w", "mask", "left"]
            # chained in two steps so that one key is never gathered
            least = keyed.groupBy(*keys).agg(F.min("fp").alias("a"), F.max("fp").alias("z")).filter("a < z")
            out.append(least.join(keyed, keys).filter("a != fp").select("a", F.col("fp").alias("b")).distinct())
    result = out[0]
    for more in out[1:]:
        result = result.unionAll(more)
    return result


def _outside(shift, width):
    value = ((1 << BITS) - 1) ^ (((1 << width) - 1) << shift)
    return value - (1 << 64) if value >= 1 << 63 else value


def _choices(spark, bits, many):
    # one number for each choice of `many` bits, built level by level
    one = spark.range(1).select(F.lit(-1).alias("last"), F.lit(0).cast("bigint").alias("mask"))
    for _ in range(many):
        table = F.array(*[F.struct(F.lit(k).alias("k"), F.lit((1 << b) - (1 << 64) if b == 63 else 1 << b).alias("m"))
                          for k, b in enumerate(bits)])
        one = (one.select("last", "mask", F.explode(table).alias("x")).filter("x.k > last")
               .select(F.col("x.k").alias("last"), F.col("mask").bitwiseOR(F.col("x.m")).alias("mask")))
    return one.select("mask")


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3,
                    radius: int = 3, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """(id, fp, component_id) of every row: component_id is the smallest id reachable over links, itself included.

    Null and empty texts have fingerprint 0 and are linked like any other. Repeated rows stay. Rows with a null
    id take part, but a null is never the smallest id (null only if all ids of the component are). Other columns
    of ``docs`` are not read.
    """
    marked = staged(fingerprints(docs, id_col, text_col, size))
    first = marked.groupBy("fp").agg(F.min("id").alias("first"))
    comp = connected_components(links(marked, radius, hot_pairs), "a", "b")
    rooted = staged(first.join(comp, first["fp"] == comp["node"], "left")
                    .select("fp", "first", F.coalesce("root", "fp").alias("root")))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return marked.join(named, "fp").select("id", "fp", "component_id")


SHINGLE, SIMILARITY = 5, 0.8
PARITY = 8             # words of 64 bits in the parities of a set
FINE = 128             # and in those of sets that are about to be compared
SAMPLED, MOST_COMMON = 8192, 250_000   # texts and shingles in the estimate of what is frequent
STARS, LEADS, HEAVY = 2, 16, 1 << 12   # rounds of cheap comparisons, members they take, comparisons worth another one
PRINT, RADIUS = 3, 3   # words of a shingle in the fingerprints of texts, and bits in which candidates may differ
BLOCK = 1 << 12
KNOWN = 64             # keys of a text that are looked through for the first shared bucket


def _mixed(x):
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the distinct word shingles of a whole text; one text without words is like another."""
    words = (text or "").encode("utf-8").lower().split()
    n, digest, joined = len(words), xxhash.xxh64_intdigest, b" ".join(words)
    if n <= size:
        return np.array([digest(joined, SEED)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lengths + 1) - 1
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(
        (ends - lengths)[:n - size + 1].tolist(), ends[size - 1:].tolist())], np.uint64))


def sketch(hashes: np.ndarray, similarity: float, known: np.ndarray, seen: np.ndarray):
    """(two hashes of the set, its parities, its prefix) of a set of shingles.

    The prefix holds the shingles that come first in the order of (estimated frequency, hash), as many as it takes
    for two sets of the similarity to have one in common. Parities tell for each of 64 * PARITY bins of shingles if
    it holds an odd number: sets that differ in d shingles differ in at most d parities.
    """
    n, mixed = len(hashes), _mixed(hashes)
    with np.errstate(over="ignore"):
        x, y = mixed.sum(dtype=np.uint64), _mixed(mixed ^ np.uint64(SEED)).sum(dtype=np.uint64)
    odd = np.bincount((mixed >> np.uint64(20)).astype(np.int64) % (64 * PARITY), minlength=64 * PARITY) & 1
    most = n - int(np.ceil(similarity * n - 1e-9)) + 1
    if len(known):
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        hashes = hashes[np.argsort(np.where(known[at] == hashes, seen[at], 0), kind="stable")]
    return x, y, np.packbits(odd.astype(np.uint8)).view(np.int64), hashes[:min(most, n)].view(np.int64)


def _few(batches, rows=256):
    # a worker holds the shingles of few texts at once, and nothing of other operators
    worker_store("simhash")
    for batch in batches:
        pa.default_memory_pool().release_unused()
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _lists(parts):
    ends = np.cumsum([0] + [len(p) for p in parts])
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.concatenate(parts)))


def _frequent(rows, size, total):
    """(shingles, counts) that recur in a bounded sample of the texts: only an order is taken from it."""
    def run(batches):
        for batch in _few(batches):
            for t in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingles(t, size).view(np.int64))], names=["hash"])
    share = min(1 << 20, -(-(SAMPLED << 20) // max(1, total)))
    some = rows.filter(F.pmod(F.xxhash64("id", "mark"), F.lit(1 << 20)) < share).select("text")
    top = (some.mapInArrow(run, "hash bigint").groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1")
           .orderBy(F.desc("n"), "hash").limit(MOST_COMMON).toArrow())
    known = top.column("hash").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(known)
    return known[order], top.column("n").to_numpy().astype(np.int64)[order]


def _sketches(rows, kind, size, similarity, frequent):
    def run(batches):
        for batch in _few(batches):
            sets = [shingles(t, size) for t in batch.column(1).to_pylist()]
            found = [sketch(s, similarity, *frequent) for s in sets]
            prints = np.array([fingerprint(t, PRINT) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints.view(np.int64)),
                 *[pa.array(np.array([f[k] for f in found], np.uint64).view(np.int64)) for k in (0, 1)],
                 *[_lists([f[k] for f in found]) for k in (2, 3)]],
                names=["id", "mark", "n", "fp", "x", "y", "parity", "prefix"])
    return rows.mapInArrow(run, f"id {kind}, mark bigint, n bigint, fp bigint, x bigint, y bigint, parity array<bigint>, "
                                "prefix array<bigint>")


def _sets(rows, size):
    # (node, n, fine, set) of (node, text)
    def run(batches):
        for batch in _few(batches):
            sets = [shingles(t, size) for t in batch.column(1).to_pylist()]
            odd = [np.bincount((_mixed(x) >> np.uint64(20)).astype(np.int64) % (64 * FINE), minlength=64 * FINE) & 1
                   for x in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) for x in sets], pa.int64()),
                 _lists([np.packbits(x.astype(np.uint8)).view(np.int64) for x in odd]),
                 _lists([x.view(np.int64) for x in sets])], names=["node", "n", "fine", "set"])
    return rows.mapInArrow(run, "node bigint, n bigint, fine array<bigint>, set array<bigint>")


def _printed(prints):
    """Pairs (a, node) of texts that connect all whose SimHashes differ in at most RADIUS bits."""
    lead = measured(prints.groupBy("fp").agg(F.min("node").alias("a")))
    same = prints.join(lead, "fp").filter("a != node").select("a", "node")
    near = links(prints, RADIUS).select(F.col("a").alias("fp"), F.col("b").alias("other")).join(lead, "fp")
    return same.unionAll(near.join(lead.select(F.col("fp").alias("other"), F.col("a").alias("node")), "other")
                         .select("a", "node"))


def _possible(similarity):
    """What the sizes and parities of sets a and b leave open; no pair of the similarity is turned away."""
    apart = sum((F.bit_count(F.col("pa")[k].bitwiseXOR(F.col("pb")[k])) for k in range(PARITY)), F.lit(0))
    most = (F.col("na") + F.col("nb")) * F.lit((1 - similarity) / (1 + similarity)) + 1e-6
    return (F.least("na", "nb") >= F.greatest("na", "nb") * F.lit(similarity) - 1e-6) & (apart <= most)


def _side(rows, s, *keep):
    return rows.select(*keep, F.col("node").alias(s), F.col("n").alias(f"n{s}"), F.col("parity").alias(f"p{s}"))


def _led(members, leads):
    """Pairs (a, node) of members with the leads of their buckets. Buckets of much the same members draw the same
    leads: a member meets each of them once, not in every bucket."""
    met = members.join(leads, "key").groupBy("node").agg(F.array_distinct(F.flatten(F.collect_set("leads"))).alias("leads"))
    return met.select("node", F.explode("leads").alias("a")).filter("a != node")


def _unmet(rooted, open_, marked, similarity):
    """Pairs (a, b) that may be of the similarity, share an open bucket and lie in different components.

    A bucket's members outside its main component are compared with all others, block by block. A pair is left to the
    first bucket that both sides know to be shared (of the KNOWN least keys of a text), so it is made once.
    """
    cuts = F.ceil(F.col("many") / BLOCK)
    known = rooted.join(open_.select("key"), "key").groupBy("node").agg(
        F.slice(F.array_sort(F.collect_set("key")), 1, KNOWN).alias("keys"))
    apart = rooted.join(open_, "key").join(marked.select("node", "n", "parity"), "node").join(known, "node")
    odd = _side(apart.filter("root != main"), "a", "key", F.col("root").alias("ra"), F.col("keys").alias("ka"),
                F.explode(F.sequence(F.lit(0).cast("bigint"), cuts - 1)).alias("block"))
    full = _side(apart, "b", "key", "main", F.col("root").alias("rb"), F.col("keys").alias("kb"),
                 F.pmod(F.xxhash64("node"), cuts).alias("block"))
    first = ~F.coalesce(F.array_min(F.array_intersect("ka", "kb")) < F.col("key"), F.lit(False))
    return (odd.join(full, ["key", "block"]).filter(F.expr("ra != rb AND (a < b OR rb = main)") & _possible(similarity) & first)
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE,
                    similarity: float = SIMILARITY) -> DataFrame:
    """Staged (id, mark, first_id, first_mark, many): the document that stands for the group of each distinct row.

    Rows are told apart by id and ``mark``, a hash of the text; ``many`` counts repeated rows. Texts are linked if
    the Jaccard similarity of their distinct shingles, counted exactly, is at least ``similarity``; groups are the
    components. First candidates are texts whose SimHashes differ in at most RADIUS bits. Links that SimHashes miss
    are found by prefixes: two such texts share a shingle of their prefixes, so the texts with one shingle in their
    prefix are a bucket, and buckets of the same texts are one. Members are first compared with one of them, in heavy
    buckets with a few more, drawn from those outside the component that most are in; then, in every bucket of
    whatever size, each member outside that component is compared with all of other components. No pair of one
    bucket is left that is neither compared nor in one component. The smallest id of a group stands for it (null
    last); null and empty texts are one group.
    """
    narrow(docs.sparkSession)
    text = F.col(f"`{text_col}`").cast("string")
    given = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"), F.xxhash64(text).alias("mark"))
    frequent = _frequent(given, size, docs.count())
    used = []

    def held(df):
        used.append(staged(df))
        return used[-1]

    rows = held(_sketches(given, docs.schema[id_col].dataType.simpleString(), size, similarity, frequent)
                .withColumn("row", F.monotonically_increasing_id()))
    # equal sets are one text to this method: they need no pairs
    texts = held(rows.groupBy("n", "x", "y").agg(F.min(F.struct(F.col("id").isNull(), "id", "mark")).alias("key"),
                                                 F.min("row").alias("node")))
    own = measured(texts.select("node"))
    marked = held(rows.join(own, F.col("row") == F.col("node")).select("node", "n", "fp", "parity"))
    keyed = rows.join(own, F.col("row") == F.col("node")).select("node", F.explode("prefix").alias("key"))
    shared = held(keyed.join(measured(keyed.groupBy("key").agg(F.count("*").alias("many")).filter("many > 1")
                                      .select("key")), "key"))
    buckets = (shared.groupBy("key").agg(F.count("*").alias("many"), F.min("node").alias("lead"), *[
        F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"h{k}") for k in (0, 1)])
        .groupBy("many", "lead", "h0", "h1").agg(F.min("key").alias("key")).select("key", "lead"))
    buckets = measured(buckets)
    members = held(shared.join(buckets.select("key"), "key"))

    def verified(pairs):
        ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        which = measured(texts.join(ends, "node").select("node", F.col("key.id").alias("i"), F.col("key.mark").alias("m")))
        sets = given.join(which, F.col("id").eqNullSafe(F.col("i")) & (F.col("mark") == F.col("m")))
        sets = staged(_sets(sets.select("node", "text").dropDuplicates(["node"]), size))
        # whole sets travel only for pairs that finer parities leave open, however long the texts are
        apart = F.aggregate(F.zip_with("pa", "pb", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, x: s + x)
        most = (F.col("na") + F.col("nb")) * F.lit((1 - similarity) / (1 + similarity)) + 1e-6
        near = staged(pairs.join(sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("fine").alias("pa")), "a")
                      .join(sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("fine").alias("pb")), "b")
                      .filter(apart <= most).select("a", "b"))
        both = F.size(F.array_intersect("x", "y"))
        # the side that many pairs may share is joined first, while rows are short
        found = held(near.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a")
                      .join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
                      .select("a", "b", both.alias("both"), (F.size("x") + F.size("y")).alias("all"))
                      .filter(F.col("both") / (F.col("all") - F.col("both")) >= similarity).select("a", "b"))
        unstaged(sets)
        unstaged(near)
        return found

    def possible(pairs):
        pairs = pairs.select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct()
        return (pairs.join(_side(marked, "a"), "a").join(_side(marked, "b"), "b").filter(_possible(similarity))
                .select("a", "b"))

    def starred(leads, rows):
        # every member beside the lead of its bucket
        return rows.join(leads.select("key", F.col("lead").alias("a")), "key").filter("a != node").select("a", "node")

    tried = held(possible(starred(buckets, members).unionAll(_printed(marked.select("node", "fp")))))
    linked = verified(tried)
    for turn in range(1, STARS + 1):
        root = connected_components(linked, "a", "b").select(F.col("node").alias("m"), "root")
        rooted = held(members.join(root, F.col("node") == F.col("m"), "left").select(
            "key", "node", F.coalesce("root", "node").alias("root")))
        open_ = measured(rooted.groupBy("key", "root").agg(F.count("*").alias("c")).groupBy("key").agg(
            F.max_by("root", F.struct("c", "root")).alias("main"), F.sum("c").alias("many"), F.max("c").alias("most"))
            .filter("most < many"))
        heavy = open_.filter((F.col("many") - F.col("most")) * F.col("many") > HEAVY)
        if turn == STARS or heavy.isEmpty():
            break
        some = rooted.join(heavy.select("key", "main"), "key")
        leads = some.filter("root != main").groupBy("key").agg(F.array_distinct(F.array(*[
            F.min_by("node", F.xxhash64("node", F.lit(LEADS * turn + k))) for k in range(LEADS)])).alias("leads"))
        fresh = held(possible(_led(some, leads)).join(tried, ["a", "b"], "left_anti"))
        tried, linked = tried.unionAll(fresh), linked.unionAll(verified(fresh))
    rest = _unmet(rooted, open_, marked, similarity).distinct()
    rest = held(rest.join(tried, ["a", "b"], "left_anti"))
    if not rest.isEmpty():
        linked = linked.unionAll(verified(rest))
    root = connected_components(linked, "a", "b").select(F.col("node").alias("m"), "root")
    rooted = held(texts.join(root, F.col("node") == F.col("m"), "left").select(
        "n", "x", "y", "key", F.coalesce("root", "node").alias("root")))
    least = rooted.groupBy("root").agg(F.min("key").alias("first"))
    named = rooted.join(least, "root").select("n", "x", "y", "first")
    result = staged(rows.groupBy("id", "mark").agg(F.count("*").alias("many"), *[F.any_value(c).alias(c) for c in "nxy"])
                    .join(named, ["n", "x", "y"]).select(
        "id", "mark", F.col("first.id").alias("first_id"), F.col("first.mark").alias("first_mark"), "many"))
    for table in used:
        unstaged(table)
    return result


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The rows of ``docs`` that stand for their near-duplicate group, all columns; one of repeated rows."""
    found = near_duplicates(docs, id_col, text_col, **settings)
    same = F.col("id").eqNullSafe(F.col("first_id")) & (F.col("mark") == F.col("first_mark"))
    names = {c.lower() for c in docs.columns}
    prefix = "k"
    while f"{prefix}_id" in names or f"{prefix}_mark" in names:
        prefix += "k"
    i, m = f"{prefix}_id", f"{prefix}_mark"
    on = F.col(f"`{id_col}`").eqNullSafe(F.col(i)) & (
        F.xxhash64(F.col(f"`{text_col}`").cast("string")) == F.col(m))
    gone = measured(found.filter(~same).select(F.col("id").alias(i), F.col("mark").alias(m)))
    again = measured(found.filter(same & (F.col("many") > 1)).select(F.col("id").alias(i), F.col("mark").alias(m)))
    kept = docs.join(gone, on, "left_anti")
    if again.isEmpty():
        return kept
    once = kept.join(again, on, "left_semi").dropDuplicates([id_col, text_col])
    return kept.join(again, on, "left_anti").unionAll(once)
