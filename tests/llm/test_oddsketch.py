import random

import numpy as np
import pytest

from driftpool.llm import oddsketch, queries


def plain(text, size=4):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in words.translate({c: " " for c in range(9, 14)}).split(" ") if w]
    if not words:
        return frozenset()
    return frozenset(" ".join(words[i:i + size]) for i in range(max(1, len(words) - size + 1)))


def components(rows):
    """Smallest id reachable, comparing all sets that share anything."""
    sets = [(i, plain(t)) for i, t in rows]
    root = list(range(len(sets)))

    def find(a):
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a
    holders = {}
    for k, (_, s) in enumerate(sets):
        for g in s:
            holders.setdefault(g, []).append(k)
    seen = set()
    for members in holders.values():
        for x, a in enumerate(members):
            for b in members[x + 1:]:
                if (a, b) not in seen:
                    seen.add((a, b))
                    p, q = sets[a][1], sets[b][1]
                    if 100 * len(p & q) >= 80 * len(p | q):
                        root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        least.setdefault(find(k), []).append(i)
    return [(i, len(s), min((x for x in least[find(k)] if x is not None), default=None) if s else i)
            for k, (i, s) in enumerate(sets)]


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def test_query_against_all_pairs(spark):
    folder = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = queries.op13_odd_sketch(spark, folder).collect()
    assert order((r.doc_id, r.n_shingles, r.component_id) for r in got) == order(components(rows))
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


@pytest.mark.parametrize("heavy", [oddsketch.HEAVY, 500])
def test_chains_stars_and_the_edge_of_80(spark, monkeypatch, heavy):
    """Chains whose ends are unlike, an original with unlike copies, and pairs on either side of 80 %."""
    monkeypatch.setattr(oddsketch, "HEAVY", heavy)
    rng = random.Random(11)
    word = lambda: f"w{rng.getrandbits(40)}"
    texts, now = [], [word() for _ in range(120)]
    for _ in range(150):                       # each like its neighbours only
        texts.append(" ".join(now))
        now[rng.randrange(120)] = word()
        now[rng.randrange(120)] = word()
    base = [word() for _ in range(100)]
    for _ in range(150):                       # like the original, hardly like each other
        copy = list(base)
        for k in rng.sample(range(100), 2):
            copy[k] = word()
        texts.append(" ".join(copy))
    texts.append(" ".join(base))
    for extra in range(20, 32):                # 100 shared shingles of 100 + extra
        mid = [word() for _ in range(103)]
        texts += [" ".join(mid), " ".join(mid + [word() for _ in range(extra)])]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    got = oddsketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert order(tuple(r) for r in got.collect()) == order(components(rows))


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (5, "ONE"), (6, "one two"), (None, "one"), (7, "Ä b c d"),
            (8, "ä b c d"), (9, "y " * 60_000), (10, "y y y y"), (None, None)]
    docs = spark.createDataFrame([(i, t, 0, 0) for i, t in rows], "doc_id long, text string, n int, mark int")
    got = oddsketch.near_duplicates(docs)
    assert order(tuple(r) for r in got.collect()) == order(components(rows))
    assert oddsketch.near_duplicates(docs.limit(0)).count() == 0


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(2)
    for share in (0.8, 0.9, 0.95):
        off = []
        for _ in range(60):
            n = 400
            own = int(n * (1 - share) / (1 + share) + 0.5)
            values = rng.integers(0, 2 ** 63, n + own).astype(np.uint64)
            a, b = values[:n], values[own:]
            true = (n - own) / (n + own)
            bits = int(np.bitwise_count(oddsketch.odd_sketch(oddsketch.samples(a)).view(np.uint64)
                                        ^ oddsketch.odd_sketch(oddsketch.samples(b)).view(np.uint64)).sum())
            off.append(oddsketch.similarity(bits) - true)
            assert bits <= oddsketch.most_apart()
        assert abs(np.mean(off)) < 0.02 and np.std(off) < 0.05
