import random

import numpy as np
import pytest
import xxhash

from driftpool.llm import queries, simhash
from driftpool.llm.components import connected_components


def plain(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
             .translate({9: " ", 10: " ", 11: " ", 12: " ", 13: " "}).split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def closure(values, radius=3):
    """Smallest index reachable from each, comparing everything with everything."""
    values = np.array(values, np.uint64)
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= radius
    best = np.arange(len(values))
    while True:
        new = np.where(near, best[None, :], len(values)).min(1)
        if (new == best).all():
            return best
        best = new


def test_query_against_all_pairs(spark):
    folder = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.op10_simhash(spark, folder).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    ids = sorted(texts)
    assert sorted(got) == ids
    prints = [plain(texts[i]) for i in ids]
    assert [got[i].fingerprint for i in ids] == [f"{p:016x}" for p in prints]
    assert [got[i].component_id for i in ids] == [ids[k] for k in closure(prints)]


@pytest.mark.parametrize("hot", [simhash.HOT_PAIRS, 30])
def test_links_keep_every_class(spark, hot):
    rng, values = random.Random(5), set()
    for _ in range(12):
        middle = rng.getrandbits(64)
        for _ in range(25):
            v = middle
            for b in rng.sample(range(64), rng.randint(0, 5)):
                v ^= 1 << b
            values.add(v)
    values = sorted(values)
    rows = [(i, v - (1 << 64) if v >> 63 else v) for i, v in enumerate(values)]
    fps = spark.createDataFrame(rows, "i long, fp long")
    pairs = simhash.links(fps, 3, hot)
    comp = connected_components(pairs, "a", "b")
    root = {r.node: r.root for r in comp.collect()}
    mine = [root.get(v, v) for _, v in rows]
    want = closure(values)
    assert len({(a, b) for a, b in zip(mine, want)}) == len(set(mine)) == len(set(want))


def test_exploded_segments_are_not_broadcast(spark, monkeypatch):
    """The estimate of an exploded table is that of the table before: 32 rows for one are not to reach the driver."""
    plans, plain_staged = [], simhash.staged
    monkeypatch.setattr(simhash, "staged", lambda df: plans.append(
        df._jdf.queryExecution().executedPlan().toString()) or plain_staged(df))
    simhash.links(spark.createDataFrame([(i * 7919,) for i in range(500)], "fp long")).count()
    joins = [p for p in plans if "Join" in p]
    assert joins and not any("Broadcast" in p for p in joins)


def test_odd_rows(spark):
    rows = [(None, "a b c", 1), (3, None, 2), (3, None, 2), (4, "", 3), (5, "x", 4), (6, "X", 5), (7, "y " * 40000, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = sorted(((r.id is None, r.id), r.component_id) for r in simhash.near_components(docs).collect())
    assert got == [((False, 3), 3), ((False, 3), 3), ((False, 4), 3), ((False, 5), 5), ((False, 6), 5),
                   ((False, 7), 7), ((True, None), None)]
    assert simhash.near_components(docs.limit(0)).count() == 0


def test_components_of_a_path_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, k) for k in range(1001, 1300)] + [(5, 5), (None, 7)]
    got = {r.node: r.root for r in connected_components(
        spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {i: 0 for i in range(61)} | {k: 1000 for k in range(1000, 1300)}
