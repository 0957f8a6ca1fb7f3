import hashlib
import random
import zlib

import pytest

from driftpool.llm import prefixtrie, queries


def brute(rows):
    """Nodes of the trie by walking every rebuilt conversation; rows are (conv_id, turn, role, text)."""
    given = {}
    for c, turn, role, text in rows:
        if c is not None:
            given.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(v, key=lambda x: x[:2])] for c, v in given.items()}
    nodes = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        path = tuple(turns.get(c - c % 5, [])[:h] + own[h:])
        for d in range(len(path) + 1):
            nodes.setdefault(path[:d], []).append((c, len(path) == d))
    kids = {p: 0 for p in nodes}
    leaves, saved = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for p in nodes:
        if p:
            kids[p[:-1]] += 1
    for p, members in nodes.items():
        own = (len(members) - 1) * len(p[-1][1].encode()) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += own
    first = {p: min(c for c, _ in m) for p, m in nodes.items()}
    return sorted((first[p], len(p), first[p[:-1]] if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(
        ",".join(str(c) for c in sorted(c for c, e in m if e)).encode()).hexdigest()) for p, m in nodes.items())


def found(spark, rows):
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    result = prefixtrie.nodes(prefixtrie.rebuilt(turns)).select(*prefixtrie.RESULT)
    return sorted(tuple(r) for r in result.collect())


def test_query_against_walks(spark):
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select(
        "conv_id", "turn", "role", "text").collect()]
    got = sorted(tuple(r) for r in queries.op11_prefix_trie(spark, folder).select(*prefixtrie.RESULT).collect())
    assert got == brute(rows)


@pytest.mark.parametrize("shard", [7, 20_000])
def test_many_shards_blocks_and_copies(spark, monkeypatch, shard):
    """Copies that fill several shards, beginnings that many share, conversations of several blocks."""
    monkeypatch.setattr(prefixtrie, "SHARD", shard)
    rng = random.Random(3)
    long = [("user" if k % 2 == 0 else "assistant", f"t{k}") for k in range(150)]
    rows = []
    for c in range(300):
        kind = rng.random()
        if kind < 0.35:
            turns = [("user", "same"), ("assistant", "hello")]
        elif kind < 0.6:
            turns = [("user", "same")] + [("assistant", rng.choice("abé")) for _ in range(rng.randint(0, 6))]
        elif kind < 0.7:
            turns = long[:rng.choice([8, 31, 32, 33, 64, 65, 96, 97, 150])]
        elif kind < 0.8:
            turns = long[:rng.randint(33, 90)] + [("user", rng.choice("xy")) for _ in range(rng.randint(1, 70))]
        else:
            turns = [(rng.choice(["user", None]), rng.choice(["", None, "a", "b"])) for _ in range(rng.randint(1, 12))]
        rows += [(c, k, role, text) for k, (role, text) in enumerate(turns)]
    rng.shuffle(rows)
    assert found(spark, rows) == brute(rows)


def test_odd_rows(spark):
    # null conversations are left out, null turns come first, a repeated row is a turn of its own
    rows = [(None, 1, "user", "x"), (7, None, "user", "first"), (7, 2, None, None), (7, 1, "user", "b" * 100_000),
            (7, 3, "user", "c"), (-3, 0, "user", "n"), (-3, 1, "user", "m"), (0, 0, "user", "z"), (2, 5, "user", "q"), (2, 5, "user", "q")]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == []
    extra = spark.createDataFrame([(1, 0, "u", "t", 5, 6)], "conv_id long, turn long, role string, text string, depth int, h1 int")
    assert prefixtrie.nodes(prefixtrie.rebuilt(extra)).count() >= 1
