import corpus_pipeline
from driftpool.llm import sentencepieces, simhash
from tests.llm.test_decontaminate import plain as windows
from tests.llm.test_pii import plain as personal


def shingles(text, size=5):
    words = (text or "").lower().split()
    return {" ".join(words[i:i + size]) for i in range(max(1, len(words) - size + 1))} if words else {""}


def test_stages(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = corpus_pipeline.staged(stage(spark, docs, folder))
        seen[name] = (before, {r.doc_id: r for r in docs.collect()})
        assert docs.columns[:len(columns)] == columns and (name == "encoding" or docs.columns == columns)
    before, after = seen["near_dedup"]
    kept = {}
    for i, t in sorted(before.items()):
        key = " ".join((t or "").lower().split())
        kept.setdefault(key, i)
    assert set(after) <= set(kept.values())                       # equal texts: the first stays
    bags = {i: shingles(t) for i, t in before.items()}
    holders = {}
    for i in before:
        for s in bags[i]:
            holders.setdefault(s, set()).add(i)
    like = lambda a, b: len(bags[a] & bags[b]) / len(bags[a] | bags[b])
    lost, left = 0, 0
    for i in before.keys() - after.keys():
        near = {j for s in bags[i] for j in holders[s] if j != i}
        lost += not any(like(i, j) >= 0.8 for j in near)
    for i in after:
        near = {j for s in bags[i] for j in holders[s] if j < i and j in after}
        left += any(like(i, j) >= 0.8 for j in near)
    assert (lost, left) == (0, 0)
    before, after = seen["decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    found = windows(list(before.items()), items)
    assert set(after) == {i for i, v in found.items() if not v[1]}
    before, after = seen["personal_data"]
    assert set(before) == set(after)
    for i, t in before.items():
        spans = personal(t)
        assert (after[i].text != t) >= bool(spans) and not (set(personal(after[i].text)) & {("email",)})
        assert after[i].n_chars == (len(after[i].text) if spans else after[i].n_chars)
        for kind, a, b in spans:
            assert kind == "card" or t[a:b] not in after[i].text
    before, after = seen["encoding"]
    raw = sentencepieces.pieces(sentencepieces._model(sentencepieces.MODEL)).raw
    assert all(b"".join(raw[k] for k in r.token_ids).decode()[1:] == before[i] for i, r in after.items())


def test_near_duplicates_of_odd_rows(spark):
    words = [f"w{i}" for i in range(400)]
    close = words[:200] + ["changed"] + words[201:]
    rows = [(5, " ".join(words), 1), (4, " ".join(close), 1), (7, None, 1), (8, "", 1), (9, " \n ", 1), (2, "alone here", 1), (2, "alone here", 1),
            (None, " ".join(words), 1), (3, " ".join(reversed(words)), 1), (6, "x " * 100000, 1), (1, " ".join(w.upper() for w in words), 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int").selectExpr("*", "'k' AS k_id", "2 AS node")
    got = simhash.deduplicated(docs)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == [1, 2, 3, 6, 7]
    assert simhash.deduplicated(docs.limit(0)).count() == 0


def test_large_group_of_near_copies(spark):
    rows = []
    for i in range(300):
        words = [f"w{k}" for k in range(300)]
        words[i] = "other"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert simhash.deduplicated(docs).count() == 1


def grouped(texts):
    """How many groups texts have, comparing all pairs."""
    bags, root = [shingles(t) for t in texts], list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, a in enumerate(bags):
        for j, b in enumerate(bags[:i]):
            both = len(a & b)
            if 5 * both >= 4 * (len(a) + len(b) - both):
                root[top(i)] = top(j)
    return len({top(i) for i in range(len(texts))})


def kept(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return simhash.deduplicated(docs).count()


def test_chain_of_revisions(spark):
    """Each text is like its neighbours only, and all share a passage."""
    common, words = [f"c{k}" for k in range(60)], [f"w{k}" for k in range(300 + 10 * 400)]
    texts = [" ".join(common + words[10 * i:10 * i + 240]) for i in range(400)]
    texts = [texts[i * 7 % 400] for i in range(400)]
    assert grouped(texts[:1] + texts[7:8]) == 2 and grouped(texts) == 1
    assert kept(spark, texts) == 1


def test_star_of_copies(spark, monkeypatch):
    """Copies like one original, which is not the first, but not like each other; and some that are like none."""
    words, texts = [f"w{k}" for k in range(300)], []
    for i in range(400):
        copy = list(words)
        for k in range(6):
            copy[5 + k * 48 + i * (2 * k + 1) % 43] = f"x{i} {k}".replace(" ", "-")
        texts.append(" ".join(copy))
    texts.insert(277, " ".join(words))
    texts += [" ".join(words[:200] + [f"y{i}-{k}" for k in range(100)]) for i in range(20)]
    assert grouped(texts[:30]) > 1
    want = grouped(texts)
    assert want == 21 and kept(spark, texts) == want
    monkeypatch.setattr(simhash, "HEAVY", 10)
    monkeypatch.setattr(simhash, "BLOCK", 64)
    assert kept(spark, texts) == want


def test_similarity_is_exact(spark):
    """Pairs of Jaccard 0.8 are found, those just below are kept apart, in short and long texts."""
    texts, groups = [], 0
    for i in range(150):
        for like in (True, False):
            n, same = (9, 8) if i % 3 == 0 else (90, 80) if i % 3 == 1 else (900, 800)
            # of 2 * n - same shingles in all ``same`` are shared: 8 of 10, 80 of 100, 800 of 1000; one less is below
            same -= not like
            at = f"d{i}{like}"
            first = [f"{at}s{k}" for k in range(same + 4)]
            texts += [" ".join(first + [f"{at}a{k}" for k in range(n - same)]),
                      " ".join([f"{at}b{k}" for k in range(n - same)] + first)]
            groups += 1 if like else 2
    assert grouped(texts[:12]) == 18 // 2 and kept(spark, texts) == groups
