import random

import numpy as np
import sentencepiece
import xxhash
from pyspark.sql import functions as F

from driftpool.llm import queries, sentencepieces as S

ODD = ["", " ", "  a  b   ", "\n", "\n\nx \n y", "日本語 text\t\tq 😀", "a\r\nb", "x" * 3000, " lead", "trail ", "é́", "0\x00 1"]


def texts(spark):
    return [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]


def agenda(table, part, salt, limit):
    """One merge after the other, looking at every neighbour each time; a candidate's hash decides if it is skipped."""
    raw = part if part[0] in " \n" else " " + part
    u = np.uint64
    sym = [(int(table.symbols[ord(c)]), i, i + 1) for i, c in enumerate(raw)]
    while True:
        best = None
        for k in range(len(sym) - 1):
            (a, s, m), (b, _, e) = sym[k], sym[k + 1]
            code = s << 42 | m << 21 | e
            if limit and int(S._mixed(S._mixed(np.array([salt], u) ^ u(code)) + u(7))[0]) < limit:
                continue
            rank, new = table._candidates(np.array([a]), np.array([b]), None, None)
            if rank[0] < S.NONE and (best is None or rank[0] < best[0]):
                best = (rank[0], k, int(new[0]))
        if best is None:
            break
        _, k, new = best
        sym[k:k + 2] = [(new, sym[k][1], sym[k + 1][2])]
    ids = []
    for s, _, _ in sym:
        ids += [s] if s >= 0 else [table.byte[b] for b in chr(-1 - s).encode()]
    return ids


def drawn(table, text, key, seed=S.SEED, dropout=S.DROPOUT):
    """Ids of a text, word after word, each with its own draws."""
    u = np.uint64
    limit = min(int(dropout * 2 ** 64), 2 ** 64 - 1)
    ids = []
    with np.errstate(over="ignore"):
        own = S._mixed(np.array([key], np.int64).view(u) + u(S.hash_of(seed, 0)))
        for place, part in enumerate(table.parts(text) if text else []):
            ids += agenda(table, part, int(S._mixed(own + u(place))[0]), limit)
    return ids


def test_without_dropout_it_is_the_library(spark):
    data = S._model(S.MODEL)
    encoder = S.Encoder(S.pieces(data), 0.0, 42)
    sp = sentencepiece.SentencePieceProcessor(model_proto=data)
    rows = texts(spark) + ODD
    offsets, flat = encoder.encode(rows, [0] * len(rows))
    for i, t in enumerate(rows):
        assert flat[offsets[i]:offsets[i + 1]].tolist() == sp.encode(t), t[:40]


def test_draws_are_the_agenda(monkeypatch):
    """Outcome trees give what the agenda gives, with few and many drops, and after they are dropped and made again."""
    table = S.pieces(S._model(S.MODEL))
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choices("theonrising é,", k=rng.randint(1, 14))) for _ in range(30)) for _ in range(12)]
    texts += [x for x in ODD if len(x) < 50] + ["the same words the same words"] * 3
    for dropout in (0.1, 0.5, 1.0):
        for kept in (S.KEPT_BYTES, 1000):
            monkeypatch.setattr(S, "KEPT_BYTES", kept)
            encoder = S.Encoder(table, dropout, 7)
            for _ in range(2):
                for at in range(0, len(texts), 5):
                    some = texts[at:at + 5]
                    offsets, flat = encoder.encode(some, [k + at for k in range(len(some))])
                    for k, text in enumerate(some):
                        assert flat[offsets[k]:offsets[k + 1]].tolist() == drawn(table, text, k + at, 7, dropout)


def test_query_against_the_agenda(spark):
    """Every document of the query: lossless, and for the shorter ones the number and hash of the ids."""
    folder = "/root/testdata/sf0.001"
    rows = {r.doc_id: r for r in queries.op7_merge_dropout(spark, folder).collect()}
    assert len(rows) == 200 and all(r.lossless for r in rows.values())
    table = S.pieces(S._model(S.MODEL))
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", F.xxhash64("doc_id").alias("key"))
    want = [(r.doc_id, drawn(table, r.text, r.key)) for r in docs.collect() if len(r.text or "") < 2500]
    assert len(want) > 100
    for r in spark.createDataFrame(want, "doc_id long, ids array<int>").select(
            "doc_id", F.size("ids").alias("n"), F.xxhash64("ids").alias("h")).collect():
        assert (rows[r.doc_id].n_tokens, rows[r.doc_id].ids_hash) == (r.n, r.h)


def test_words_of_one_merge_vary_like_others():
    """Where a word has one candidate, its occurrences drop it one time in ten."""
    table = S.pieces(S._model(S.MODEL))
    encoder = S.Encoder(table, 0.1, 3)
    offsets, flat = encoder.encode(["a " * 20_000 + "a"], [5])
    split = (len(flat) - 20_001) / 20_001
    assert abs(split - 0.1) < 0.01


def test_odd_rows_seeds_and_variety(spark):
    rows = [(i, t, 1) for i, t in enumerate(ODD + ["the same words", "x▁y"])] + [(None, None, 1), (13, "the same words", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, token_ids int")
    out = S.encoded(docs)
    assert out.columns == ["doc_id", "text", "token_ids", "_token_ids"] and out.count() == len(rows)
    back = out.withColumn("back", S.decoded(F.col("_token_ids"))).collect()
    assert all(r.back == (r.text or "") for r in back)
    assert S.encoded(docs.limit(0)).count() == 0
    many = spark.range(60).select(F.col("id").alias("doc_id"), F.lit("understanding internationally considered").alias("text"))
    once, again = (sorted((r.doc_id, tuple(r.token_ids)) for r in S.encoded(many.repartition(n)).collect()) for n in (1, 5))
    other = sorted((r.doc_id, tuple(r.token_ids)) for r in S.encoded(many, seed=1).collect())
    assert once == again != other and len({ids for _, ids in once}) > 1
    plain = S.encoded(many, dropout=0.0).collect()
    assert len({tuple(r.token_ids) for r in plain}) == 1
