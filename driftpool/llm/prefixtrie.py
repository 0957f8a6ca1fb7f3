"""Prefix trie of conversations from padded matrices of turn ids, range-sharded, with shared nodes recombined.

A turn's id is 128 bits of its role and text; texts stay where they are read. A conversation is cut into blocks of
WIDTH turns, each below the key of the turns before it, so a matrix is never wider than WIDTH + 1 columns and no
conversation is held whole. Blocks are range-sharded by (key, ids, conversation): a shard is a run of the sorted
whole, however many conversations begin alike or are alike. Only nodes on the paths of a shard's first and last row,
and nodes above the next block, can have members elsewhere; they are added up across shards by key.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from driftpool.llm.bounds import measured
from driftpool.session import staged

WIDTH = 32            # turns of a block
SHARD = 20_000        # blocks of a shard, about
EMPTY = hashlib.sha256(b"").hexdigest()
NODE = ("hi bigint, lo bigint, up_hi bigint, up_lo bigint, depth bigint, open boolean, up_open boolean, conv_id bigint, "
        "parent_conv_id bigint, n_convs bigint, bytes bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, "
        "ends_sha256 string, first_end bigint, ends string")


def ordered_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, place, h1, h2, bytes) of every turn, places from 1 by turn (null first, equal ones by id).

    Null roles and texts are empty. Rows without a conversation are left out, repeated rows are turns of their own.
    """
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in ("role", "text"))
    rows = turns.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn", F.xxhash64(F.lit(1), role, text).alias("h1"),
        F.xxhash64(F.lit(2), role, text).alias("h2"), F.octet_length(text).cast("bigint").alias("bytes"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "h1", "h2")
    return rows.withColumn("place", F.row_number().over(order).cast("bigint")).drop("turn")


def rebuilt(turns: DataFrame, group: int = 5, most: int = 9) -> DataFrame:
    """Turns of conversations that begin like another: (conv_id, part, place, h1, h2, bytes).

    The first h turns of conversation c - c mod ``group`` come first (part 0), then c's own turns after its first h
    (part 1); h is the CRC-32 of c's digits modulo ``most``. Every conversation also has one row of part -1, so those
    without turns stay.
    """
    turns = staged(ordered_turns(turns))
    convs = staged(turns.select("conv_id").distinct())
    taken = F.crc32(F.col("conv_id").cast("string")) % most
    own = turns.filter(F.col("place") > taken).select("conv_id", F.lit(1).alias("part"), "place", "h1", "h2", "bytes")
    near = F.sequence(F.col("head"), F.col("head") + (group - 1))
    heads = (turns.filter((F.pmod("conv_id", F.lit(group)) == 0) & (F.col("place") < most))
             .withColumnRenamed("conv_id", "head").withColumn("conv_id", F.explode(near)))
    heads = heads.filter(F.col("place") <= taken).join(measured(convs), "conv_id", "left_semi").select(
        "conv_id", F.lit(0).alias("part"), "place", "h1", "h2", "bytes")
    zero = F.lit(0).cast("bigint")
    marks = convs.select("conv_id", F.lit(-1).alias("part"), zero.alias("place"), zero.alias("h1"), zero.alias("h2"),
                         zero.alias("bytes"))
    return marks.unionAll(own).unionAll(heads)


def _mixed(x):
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _below(hi, lo, h1, h2):
    """Key of the node that a turn leads to from a node's key."""
    with np.errstate(over="ignore"):
        return (_mixed(hi * np.uint64(0x9E3779B97F4A7C15) + h1 + np.uint64(1)),
                _mixed(lo * np.uint64(0xD1342543DE82EF95) + h2 + np.uint64(2)))


def blocks(turns: DataFrame) -> DataFrame:
    """(path, sizes, conv_id, block, more) of conversations in order, WIDTH turns a row.

    ``path`` holds the key of the turns before the block and the ids of its turns, big-endian, so that bytes sort like
    paths; ``more`` says that another block follows.
    """
    def run(batches):
        now, block, ids, sizes = None, 0, [], []
        root = np.zeros(2, np.uint64)
        out = []

        def cut(many, more):
            nonlocal block, root, ids, sizes
            one = np.concatenate(ids) if ids else np.zeros((0, 2), np.uint64)
            bytes_ = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
            part = one[:many]
            out.append((root.astype(">u8").tobytes() + part.astype(">u8").tobytes(), bytes_[:many].tobytes(), now, block, more))
            if more:
                for h1, h2 in part:
                    root = np.array(_below(root[0], root[1], h1, h2), np.uint64)
                ids, sizes, block = [one[many:]], [bytes_[many:]], block + 1

        def emit():
            rows = list(zip(*out))
            out.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(rows[0], pa.binary()), pa.array(rows[1], pa.binary()), pa.array(rows[2], pa.int64()),
                 pa.array(rows[3], pa.int64()), pa.array(rows[4], pa.bool_())],
                names=["path", "sizes", "conv_id", "block", "more"])

        for batch in batches:
            if not batch.num_rows:
                continue
            conv, part, h1, h2, size = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(5))
            both = np.column_stack([h1, h2]).view(np.uint64)
            cuts = np.append(np.flatnonzero(np.append(True, conv[1:] != conv[:-1])), len(conv))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if conv[a] != now:
                    if now is not None:
                        cut(WIDTH, False)
                    now, block, ids, sizes, root = int(conv[a]), 0, [], [], np.zeros(2, np.uint64)
                if part[a] < 0:
                    a += 1
                ids.append(both[a:b])
                sizes.append(size[a:b])
                while sum(map(len, ids)) > WIDTH:
                    cut(WIDTH, True)
            if len(out) >= 4096:
                yield emit()
        if now is not None:
            cut(WIDTH, False)
        if out:
            yield emit()

    tasks = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = turns.repartition(tasks, "conv_id").sortWithinPartitions("conv_id", "part", "place")
    return ordered.select("conv_id", "part", "h1", "h2", "bytes").mapInArrow(
        run, "path binary, sizes binary, conv_id bigint, block bigint, more boolean")


class Shard:
    """Nodes of a run of sorted blocks."""

    def __init__(self, paths, sizes, conv, block, more):
        self.rows = len(paths)
        length = np.fromiter((len(p) // 16 for p in paths), np.int64, self.rows)
        self.width = int(length.max())
        flat = np.frombuffer(b"".join(paths), ">u8").astype(np.uint64).reshape(-1, 2)
        row = np.repeat(np.arange(self.rows), length)
        col = np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)
        hi, lo = (np.zeros((self.rows, self.width), np.uint64) for _ in range(2))
        hi[row, col], lo[row, col] = flat[:, 0], flat[:, 1]
        weight = np.zeros((self.rows, self.width), np.int64)
        inner = col > 0
        weight[row[inner], col[inner]] = np.frombuffer(b"".join(sizes), np.int64)
        keys = [conv]
        for c in range(self.width - 1, -1, -1):
            keys += [lo[:, c], hi[:, c]]
        order = np.lexsort(keys)
        self.hi, self.lo, self.weight = hi[order], lo[order], weight[order]
        self.last, self.conv, self.block, self.more = length[order] - 1, conv[order], block[order], more[order]
        # a node begins where its column or one before it changes
        change = np.ones((self.rows, self.width), bool)
        change[1:] = ((self.hi[1:] != self.hi[:-1]) | (self.lo[1:] != self.lo[:-1])
                      | ((self.last[1:, None] < np.arange(self.width)) != (self.last[:-1, None] < np.arange(self.width))))
        self.starts = np.logical_or.accumulate(change, axis=1)

    def nodes(self):
        """One dict of columns a depth, root column first."""
        levels, before = [], None
        for j in range(self.width):
            first = np.flatnonzero(self.starts[:, j])
            stop = np.append(first[1:], self.rows)
            there = self.last[first] >= j
            if not there.any():
                break
            ends = (self.last == j) & ~self.more
            on = (self.last == j) & self.more
            n, least = stop - first, np.minimum.reduceat(self.conv, first)
            goes_on = np.logical_or.reduceat(on, first)
            first, stop = first[there], stop[there]
            level = {"first": first, "stop": stop, "n": n[there], "conv": least[there], "on": goes_on[there],
                     "open": (first == 0) | (stop == self.rows) | goes_on[there], "block": self.block[first],
                     "bytes": self.weight[first, j], "ends": ends}
            if before is None:
                level["up"] = np.full(len(first), -1)
                level["hi"], level["lo"] = self.hi[first, 0], self.lo[first, 0]
                # the turns before a block are another block's: open, and counted there
                level["open"] = np.ones(len(first), bool)
            else:
                level["up"] = np.searchsorted(before["first"], first, "right") - 1
                level["hi"], level["lo"] = _below(before["hi"][level["up"]], before["lo"][level["up"]],
                                                  self.hi[first, j], self.lo[first, j])
            levels.append(level)
            before = level
        for level, under in zip(levels[-2::-1], levels[:0:-1]):
            np.logical_or.at(level["open"], under["up"], under["open"])
        # below upwards: what closed nodes hold is final, what open ones hold is part of a sum
        for j in range(len(levels) - 1, -1, -1):
            level = levels[j]
            k = len(level["first"])
            level["children"], level["leaves"], level["saved"] = (np.zeros(k, np.int64) for _ in range(3))
            if j + 1 < len(levels):
                under = levels[j + 1]
                closed = ~under["open"]
                up = under["up"][closed]
                level["children"] = np.bincount(up, minlength=k)
                for c in ("leaves", "saved"):
                    np.add.at(level[c], up, under[c][closed])
            closed = ~level["open"]
            level["leaves"][closed & (level["children"] == 0)] = 1
            level["saved"][closed] += ((level["n"] - 1) * level["bytes"])[closed]
        return levels

    def batches(self):
        levels = self.nodes()
        names = [c.split()[0] for c in NODE.split(", ")]
        for j, level in enumerate(levels):
            k = len(level["first"])
            up = level["up"]
            over = levels[j - 1] if j else None
            sha, first_end, listed = [], [], []
            for a, b, open_ in zip(level["first"].tolist(), level["stop"].tolist(), level["open"].tolist()):
                # shorter rows come first, in the order of their conversations
                mine = ()
                if self.last[a] == j:
                    stop = a + int(np.searchsorted(self.last[a:b], j, "right"))
                    mine = self.conv[a:stop][level["ends"][a:stop]]
                text = ",".join(map(str, mine.tolist())) if len(mine) else ""
                sha.append(None if open_ else hashlib.sha256(text.encode()).hexdigest() if text else EMPTY)
                first_end.append(int(mine[0]) if open_ and len(mine) else None)
                listed.append(text if open_ and text else None)
            root = j == 0
            outer = root & (level["block"] > 0)     # the root column of a later block
            key = [level[c].view(np.int64) for c in ("hi", "lo")]
            above = [over[c][up].view(np.int64) if over else None for c in ("hi", "lo")]
            up_open = over["open"][up] if over else np.ones(k, bool)
            none = pa.nulls(k, pa.int64())
            columns = {
                "hi": pa.array(key[0]), "lo": pa.array(key[1]),
                "up_hi": pa.array(above[0]) if over else none, "up_lo": pa.array(above[1]) if over else none,
                "depth": pa.array(level["block"] * WIDTH + j), "open": pa.array(level["open"]),
                "up_open": pa.array(up_open), "conv_id": pa.array(level["conv"], mask=outer if root else None),
                "parent_conv_id": pa.array(over["conv"][up], mask=up_open) if over else none,
                "n_convs": pa.array(np.where(outer, 0, level["n"])), "bytes": pa.array(level["bytes"]),
                "n_children": pa.array(level["children"]), "n_leaves": pa.array(level["leaves"]),
                "saved_tokens": pa.array(level["saved"]), "ends_sha256": pa.array(sha, pa.string()),
                "first_end": pa.array(first_end, pa.int64()), "ends": pa.array(listed, pa.string())}
            yield pa.RecordBatch.from_arrays([columns[c] for c in names], names=names)


def _sharded(rows):
    def run(batches):
        table = [b for b in batches if b.num_rows]
        if table:
            cols = [[x for b in table for x in b.column(k).to_pylist()] for k in (0, 1)]
            rest = [np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in table]) for k in (2, 3, 4)]
            yield from Shard(*cols, rest[0], rest[1], rest[2].astype(bool)).batches()

    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(tasks, -(-rows.count() // SHARD))
    return rows.repartitionByRange(tasks, "path", "conv_id").mapInArrow(run, NODE)


def _hashed(pieces):
    """SHA-256 of the ends of each shared node: a shard's ends are one piece, pieces follow each other in order."""
    def run(batches):
        now, sha = None, None
        for batch in batches:
            rows = []
            for hi, lo, piece in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if (hi, lo) != now:
                    if now is not None:
                        rows.append((*now, sha.hexdigest()))
                    now, sha = (hi, lo), hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(piece.encode())
            if rows:
                yield _digests(rows)
        if now is not None:
            yield _digests([(*now, sha.hexdigest())])

    ordered = pieces.repartition("hi", "lo").sortWithinPartitions("hi", "lo", "first_end")
    return ordered.select("hi", "lo", "ends").mapInArrow(run, "hi bigint, lo bigint, ends_sha256 string")


def _digests(rows):
    hi, lo, sha = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(sha, pa.string())],
                                      names=["hi", "lo", "ends_sha256"])


def _subtrees(tree):
    """(hi, lo, leaves, saved) summed over each node's shared descendants: pointers double, so the rounds grow with the
    logarithm of the depth; sums are taken before the shuffle, so a node of many children is no large group."""
    deepest = tree.agg(F.max("depth")).first()[0]
    now = tree.select("hi", "lo", "up_hi", "up_lo", F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"))
    step = 1
    while deepest is not None and step <= deepest:
        gained = now.filter("up_hi IS NOT NULL").groupBy(F.col("up_hi").alias("hi"), F.col("up_lo").alias("lo")).agg(
            F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        jump = now.select(F.col("hi").alias("up_hi"), F.col("lo").alias("up_lo"), F.col("up_hi").alias("far_hi"),
                          F.col("up_lo").alias("far_lo"))
        now = staged(now.join(gained, ["hi", "lo"], "left").join(jump, ["up_hi", "up_lo"], "left").select(
            "hi", "lo", F.col("far_hi").alias("up_hi"), F.col("far_lo").alias("up_lo"),
            (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"),
            (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved")))
        step *= 2
    return now.select("hi", "lo", "leaves", "saved")


RESULT = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def nodes(turns: DataFrame) -> DataFrame:
    """Every node of the trie of conversations given as (conv_id, part, place, h1, h2, bytes).

    A node is a distinct sequence of first turns, from the root without turns on; ``conv_id`` is its smallest member,
    ``n_leaves`` and ``saved_tokens`` are sums over its subtree, ``ends_sha256`` is the hash of the members that end
    at it. No conversations: no nodes.
    """
    parts = staged(_sharded(staged(blocks(turns))))
    shared = parts.filter("open")
    tree = staged(shared.groupBy("hi", "lo").agg(
        F.max("up_hi").alias("up_hi"), F.max("up_lo").alias("up_lo"), F.max("depth").alias("depth"),
        F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.max("bytes").alias("bytes"),
        *[F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved_tokens")]))
    under = tree.filter("up_hi IS NOT NULL").groupBy(F.col("up_hi").alias("hi"), F.col("up_lo").alias("lo")).agg(
        F.count("*").alias("shared_children"))
    tree = tree.join(under, ["hi", "lo"], "left").withColumn(
        "n_children", F.col("n_children") + F.coalesce("shared_children", F.lit(0)))
    tree = staged(tree.withColumn("n_leaves", F.col("n_leaves") + (F.col("n_children") == 0).cast("bigint")).withColumn(
        "saved_tokens", F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("bytes")).drop("shared_children"))
    sums = _subtrees(tree)
    ends = _hashed(shared.filter("ends IS NOT NULL").select("hi", "lo", "first_end", "ends"))
    over = measured(tree.select(F.col("hi").alias("up_hi"), F.col("lo").alias("up_lo"),
                                F.col("conv_id").alias("over_conv_id")))
    open_ = (tree.join(sums, ["hi", "lo"]).join(ends, ["hi", "lo"], "left").join(over, ["up_hi", "up_lo"], "left").select(
        "conv_id", "depth", F.col("over_conv_id").alias("parent_conv_id"), "n_convs", "n_children",
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256")))
    closed = parts.filter("NOT open").join(over, ["up_hi", "up_lo"], "left").withColumn(
        "parent_conv_id", F.when(F.col("up_open"), F.col("over_conv_id")).otherwise(F.col("parent_conv_id")))
    return closed.select(*RESULT).unionAll(open_.select(*RESULT))
