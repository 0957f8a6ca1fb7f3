import hashlib
import random

import numpy as np

from driftpool.llm import queries, suffixes


def covered(texts, length):
    """Spans per text from a dictionary of every window."""
    seen = {}
    for d, t in enumerate(texts):
        for i in range(len(t) - length + 1):
            seen.setdefault(t[i:i + length], []).append((d, i))
    marks = [np.zeros(len(t), bool) for t in texts]
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                marks[d][i:i + length] = True
    return marks


def runs(mark):
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mark.astype(int), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def test_suffix_order():
    rng = random.Random(3)
    for letters in (b"a", b"ab", b"abc", bytes(range(200))):
        for _ in range(20):
            text = b"".join(bytes(rng.choices(letters, k=rng.randint(0, 60))) + b"\xff" for _ in range(3))
            got = suffixes.sorted_suffixes(text, 1000)
            want = sorted((i for i in range(len(text)) if text[i] != 255), key=lambda i: text[i:])
            assert got == want


def test_small_windows_against_a_dictionary(spark):
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdé", k=rng.randint(1, 6))) for _ in range(12)]
    block = [" ".join(rng.choices(words, k=30)) for _ in range(4)]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 40))) + rng.choice(block)[:rng.randint(0, 150)]
             + rng.choice(block) for _ in range(40)]
    texts += ["", None, "a" * 500, "ab" * 300, texts[0], texts[0]]
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string")
    raw = [(t or "").encode() for t in texts]
    for length, gram, hot in ((40, 12, 1000), (25, 25, 1), (60, 1, 1000), (60, 20, 1)):
        got = {r.id: r for r in suffixes.removed(docs, length=length, gram=gram, hot=hot).collect()}
        for i, mark in enumerate(covered(raw, length)):
            assert [(s.start, s.end) for s in got[i].spans] == runs(mark), (length, gram, i)
            assert bytes(got[i].kept) == bytes(np.frombuffer(raw[i], np.uint8)[~mark])
    assert suffixes.removed(docs.limit(0)).count() == 0


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in queries.op8_suffix_dedup(spark, folder).collect()}
    docs = sorted((r.doc_id, (r.text or "").encode()) for r in spark.read.parquet(f"{folder}/documents.parquet").collect())
    marks = covered([t for _, t in docs], 400)
    assert any(m.any() for m in marks) and len(got) == len(docs)
    for (i, t), mark in zip(docs, marks):
        kept = bytes(np.frombuffer(t, np.uint8)[~mark])
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans) == (len(t), int(mark.sum()), len(runs(mark)))
        assert got[i].kept_sha256 == hashlib.sha256(kept).hexdigest()
