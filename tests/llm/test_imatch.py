import hashlib

from driftpool.llm import imatch, queries


def test_query_against_a_plain_walk(spark):
    folder = "/root/testdata/sf0.01"
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{folder}/documents.parquet").collect())
    got = {r.doc_id: r for r in queries.op6_imatch(spark, folder).collect()}
    assert len(got) == len(docs)
    prints = {}
    for k, (i, t) in enumerate(docs):
        r, follow = got[i], docs[(k + 1) % len(docs)]
        n = len(t) // 4
        changed = t[:len(t) - n] + follow[1][:n]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert prints.setdefault(t, r.fingerprint) == r.fingerprint
        assert prints.setdefault(changed, r.edited_fingerprint) == r.edited_fingerprint
        assert r.near_edited == imatch.likeness(r.fingerprint, r.edited_fingerprint)
        assert r.near_next == imatch.likeness(r.fingerprint, got[follow[0]].fingerprint)
    rows = [r for r in got.values() if r.n_chars > 200]
    assert sum(r.near_edited > r.near_next for r in rows) > 0.95 * len(rows)


def test_lexicon_counts_rows(spark):
    rows = [(i, "every " + ("odd" if i % 2 else "even") + f" w{i} dup dup." + (" half" if i < 10 else "")) for i in range(20)] + [(99, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert imatch.lexicon(docs, low=0.3, high=0.5) == ["even", "half", "odd"]
    assert imatch.lexicon(docs.limit(0)) == []


def test_odd_rows(spark):
    rows = [(2, "b c d e f", 1), (1, None, 1), (1, "", 1), (None, "x y", 1), (7, "long " * 30000 + "end", 1), (3, "b c d e f", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part int")
    got = imatch.compared(docs, ["b", "c", "long", "end"]).collect()
    assert len(got) == 6
    by = {r.id: r for r in got}
    assert by[2].fingerprint == by[3].fingerprint and by[2].near_next == 1.0 and by[1].n_chars == 0
    text = "long " * 30000 + "end"      # the first row, with a null id, follows the last
    n = len(text) // 4
    assert by[7].edited_sha256 == hashlib.sha256((text[:len(text) - n] + "x y").encode()).hexdigest()
    assert imatch.compared(docs.limit(0), []).count() == 0
    one = imatch.compared(docs.filter("doc_id = 2"), ["b"]).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert imatch.fingerprints(docs, ["b"]).count() == 6
