"""Repeated strings of bytes by a two-stage suffix sort of the regions where one can begin."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from driftpool.llm.bounds import measured
from driftpool.session import staged

LENGTH = 400
GRAM = 128
# regions of one anchor beyond which their starts are dealt out by distance to the anchor, STRIDE distances at a
# time; equal strings have equal distances, so nothing is lost
HOT_KINDS, STRIDE = 1000, 32
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
END = 255      # no byte of UTF-8


def _powers(base, n):
    out = np.ones(n, np.uint64)
    if n > 1:
        out[1:] = base
        np.multiply.accumulate(out, out=out)
    return out


def _mixed(x):
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def regions(data: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(anchor hash, region hash, first start, last start, anchor) of the windows of a text, by their anchor.

    The anchor of a window of ``length`` bytes is its leftmost gram of least hash, a function of the window's bytes.
    Consecutive windows with one anchor are a region; the bytes from its first start to ``length`` past its last
    are hashed. Equal windows have equal anchor hashes and equal places in regard to them.
    """
    n = len(data)
    if n < length:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(BASE, n), out=sums[1:])
        back = _powers(INVERSE, n)
        span = length - gram + 1
        grams = _mixed((sums[gram:] - sums[:n + 1 - gram]) * back[:n + 1 - gram])
        # upper bits of the hash, then the place: the least is the leftmost of the least hashes
        shift = np.uint64(max(1, int(n).bit_length()))
        ranked = ((grams >> shift) << shift) | np.arange(len(grams), dtype=np.uint64)
        anchor = (_window_min(ranked, span) & ((np.uint64(1) << shift) - np.uint64(1))).astype(np.int64)
        cut = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
        first, last = cut, np.append(cut[1:], len(anchor)) - 1
        at = anchor[cut]
        whole = _mixed((sums[last + length] - sums[first]) * back[first] + (last - first).astype(np.uint64)
                       + (at - first).astype(np.uint64) * np.uint64(0x94D049BB133111EB))
        return grams[at].view(np.int64), whole.view(np.int64), first, last, at


def _window_min(x, span):
    n = len(x)
    pad = -n % span
    blocks = np.append(x, np.full(pad, np.uint64(2 ** 64 - 1))).reshape(-1, span)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n - span + 1], ahead[span - 1:n])


def _anchored(docs, length, gram):
    def run(batches):
        for batch in batches:
            rows, cols = [], [[] for _ in range(5)]
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = regions(np.frombuffer(text.as_buffer() or b"", np.uint8), length, gram)
                if len(found[0]):
                    rows.append(np.full(len(found[0]), row, np.int64))
                    for c, x in zip(cols, found):
                        c.append(x)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in [rows, *cols]],
                                                 names=["row", "anchor", "region", "first", "last", "at"])
    return docs.select("row", "bytes").mapInArrow(
        run, "row bigint, anchor bigint, region bigint, first bigint, last bigint, at bigint")


def sorted_suffixes(text: bytes, length: int) -> list[int]:
    """Suffixes of ``text`` in the order of their first ``length`` bytes, without those that begin with END.

    Two stages: suffixes smaller than their successor are sorted directly; the others are put at the front of the
    bucket of their first byte, in the order in which a scan from left to right meets their successors. END, which
    is greater than every byte, ends each string.
    """
    t = np.frombuffer(text, np.uint8)
    n = len(t)
    if not n:
        return []
    if text[-1] != END:
        raise ValueError("a text has to end with END")
    change = np.append(np.flatnonzero(t[1:] != t[:-1]), n - 1)
    # the type of a run of one byte is that of its last place
    nearest = change[np.searchsorted(change, np.arange(n))]
    small = np.append(t[:-1] < t[1:], False)[nearest]
    small |= t == END
    direct = np.flatnonzero(small & (t != END)).tolist()
    direct.sort(key=lambda i: text[i:i + length])
    counts = np.bincount(t, minlength=257)
    large = np.bincount(t[~small], minlength=257)
    start = np.cumsum(counts) - counts
    order = [-1] * (n - int(counts[END]))
    place = (start + large).tolist()
    for i in direct:
        b = text[i]
        order[place[b]] = i
        place[b] += 1
    front, is_small = start.tolist(), small.tolist()
    for k in range(len(order)):
        i = order[k] - 1
        if i >= 0 and not is_small[i]:
            b = text[i]
            order[front[b]] = i
            front[b] += 1
    return order


def repeated_starts(strings: list[bytes], starts: list[int], length: int) -> list[np.ndarray]:
    """For each string, which of its first ``starts`` places begin a string of ``length`` bytes that also begins
    at another of these places, here or in another string: neighbours in suffix order with that common prefix."""
    out = [np.zeros(s, bool) for s in starts]
    sizes = np.array([len(s) + 1 for s in strings], np.int64)
    begin = np.cumsum(sizes) - sizes
    text = b"".join(s + bytes([END]) for s in strings)
    owner = np.repeat(np.arange(len(strings)), sizes)
    place = np.arange(len(text)) - begin[owner]
    allowed = place < np.array(starts, np.int64)[owner]
    order = np.array(sorted_suffixes(text, length), np.int64)
    order = order[allowed[order]]
    cut = [text[i:i + length] for i in order.tolist()]
    same = np.fromiter((a == b for a, b in zip(cut, cut[1:])), bool, max(0, len(cut) - 1))
    hit = np.append(same, False) | np.append(False, same)
    for i in order[hit].tolist():
        out[owner[i]][place[i]] = True
    return out


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT_KINDS) -> DataFrame:
    """(row, start, end): bytes covered by a string of ``length`` bytes that also begins elsewhere; parts may overlap.

    ``docs`` has ``row``, which tells rows apart, and ``bytes``. Regions that occur twice as they are are covered
    without their bytes. Where an anchor has several regions, one of each is sorted together with the others; where
    they are more than ``hot``, in groups of STRIDE distances to the anchor.
    """
    if not 1 <= gram <= length:
        raise ValueError("a gram has to fit into the length")
    places = staged(_anchored(docs, length, gram))
    kinds = places.groupBy("anchor", "region").agg(
        F.count("*").alias("n"), *[F.first(c).alias(f"one_{c}") for c in ("row", "first", "last", "at")])
    anchors = kinds.groupBy("anchor").agg(F.count("*").alias("kinds"), F.sum("n").alias("places"))
    kinds = staged(kinds.join(anchors.filter("places > 1"), "anchor"))
    whole = kinds.filter("n > 1").select("anchor", "region")
    covered = places.join(whole, ["anchor", "region"]).select("row", F.col("first").alias("start"),
                                                              (F.col("last") + length).alias("end"))
    single = kinds.filter("kinds > 1").select(
        "anchor", "region", "n", F.when(F.col("kinds") > hot, STRIDE).otherwise(length).alias("stride"),
        *[F.col(f"one_{c}").alias(c) for c in ("row", "first", "last", "at")])
    # starts of a region by their distance to the anchor, cut at multiples of the stride
    low, high = F.col("at") - F.col("last"), F.col("at") - F.col("first")
    stride = F.col("stride")
    cuts = single.withColumn("part", F.explode(F.sequence(F.floor(low / stride), F.floor(high / stride))))
    cuts = cuts.select("anchor", "region", "n", "row", "part",
                       F.greatest("first", F.col("at") - (F.col("part") + 1) * stride + 1).alias("from"),
                       F.least("last", F.col("at") - F.col("part") * stride).alias("to"))
    texts = docs.select(F.col("row").alias("r"), "bytes").join(
        measured(single.select(F.col("row").alias("r")).distinct()), "r", "left_semi")
    strings = cuts.join(texts, F.col("row") == F.col("r")).select(
        "anchor", "part", "n", "row", "from", "to",
        F.substring("bytes", F.col("from").cast("int") + 1, (F.col("to") - F.col("from") + length).cast("int")).alias("s"))
    strings = strings.repartition("anchor", "part").sortWithinPartitions("anchor", "part")

    def run(batches):
        key, held = None, []
        for batch in batches:
            for a, p, n, row, start, end, s in zip(*(c.to_pylist() for c in batch.columns)):
                if (a, p) != key and held:
                    yield from out(held)
                    held = []
                key = (a, p)
                held.append((n, row, start, end, s))
        if held:
            yield from out(held)

    def out(held):
        if len(held) < 2:
            return
        hits = repeated_starts([h[4] for h in held], [h[3] - h[2] + 1 for h in held], length)
        rows, begins, ends = [], [], []
        for (n, row, start, _, _), hit in zip(held, hits):
            at = np.flatnonzero(hit)
            if n > 1 or not len(at):
                continue
            cut = np.flatnonzero(np.append(True, np.diff(at) > 1))
            rows += [row] * len(cut)
            begins += (start + at[cut]).tolist()
            ends += (start + at[np.append(cut[1:], len(at)) - 1] + length).tolist()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (rows, begins, ends)],
                                             names=["row", "start", "end"])

    sorted_ = strings.select("anchor", "part", "n", "row", "from", "to", "s").mapInArrow(
        run, "row bigint, start bigint, end bigint")
    return covered.unionAll(sorted_)


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
            gram: int = GRAM, hot: int = HOT_KINDS) -> DataFrame:
    """(id, n_bytes, spans, kept) of every row: ``spans`` (start, end) are the maximal runs removed, ``kept`` the rest.

    Null and empty texts have no bytes. Repeated rows are rows of their own and cover each other. Spans are in
    bytes and may cut a character.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("id"),
                       F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary").alias("bytes"))
    rows = staged(rows)       # numbers stay with their rows, whatever is computed again
    found = staged(repeats(rows, length, gram, hot))
    spans = _merged(found)
    spans = measured(spans)
    met = rows.join(spans.withColumnRenamed("row", "r"), F.col("row") == F.col("r"), "left")
    last = F.element_at("spans", -1)["end"].cast("int")
    pieces = F.aggregate(
        "spans", F.struct(F.lit(0).cast("bigint").alias("at"), F.lit(b"").alias("kept")),
        lambda acc, s: F.struct(s["end"].alias("at"), F.concat(acc["kept"], F.substring(
            F.col("bytes"), acc["at"].cast("int") + 1, (s["start"] - acc["at"]).cast("int"))).alias("kept")))["kept"]
    kept = F.when(F.col("spans").isNull(), F.col("bytes")).otherwise(
        F.concat(pieces, F.substring("bytes", last + 1, F.lit(2147483647))))
    return met.select("id", F.octet_length("bytes").cast("bigint").alias("n_bytes"),
                      F.coalesce("spans", F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)")).alias("spans"),
                      kept.alias("kept"))


def _merged(found):
    order = Window.partitionBy("row").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = found.distinct().withColumn("apart", F.when(F.col("start") > before, 1).otherwise(0))
    runs = runs.withColumn("run", F.sum("apart").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy("row", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return runs.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
