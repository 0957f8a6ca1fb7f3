import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from driftpool import session
from driftpool.llm import queries, simple8b as S


@pytest.mark.parametrize("n", [0, 1, 2, 59, 60, 61, 1000, 40000])
@pytest.mark.parametrize("top", [1, 2, 300, 49408, 2 ** 40, 2 ** 64 - 1])
def test_round_trip_of_whole_chunks_and_blocks(n, top):
    x = np.random.default_rng(n).integers(0, top, n, dtype=np.uint64)
    x[:n // 3] = 0
    sizes = np.array([n // 2, n - n // 2])
    data = S.pack(x, sizes, 7)
    got, back, before = S.unpack(data)
    assert (got == x).all() and (back == sizes).all() and before == 7
    parts, k = [], 0
    while sum(map(len, parts)) < n:
        parts.append(S.unpack(data, k, 1)[0])
        k += 1
    assert n == 0 or (np.concatenate(parts) == x).all()
    if top == 49408 and n > 1000:
        assert len(data) < 3 * n


def test_query_against_the_library(spark):
    folder = "/root/testdata/sf0.001"
    tokenizer = Tokenizer.from_file(S.TOKENIZER)
    got = {r.doc_id: r for r in queries.op4_simple8b(spark, folder).collect()}
    start = 0
    for r in spark.read.parquet(f"{folder}/documents.parquet").orderBy("doc_id").collect():
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids + [2]
        one = got[r.doc_id]
        assert (one.start, one.n_tokens, one.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_odd_rows(spark):
    rows = [(3, "b <|endoftext|>x", 0), (1, None, 0), (1, "", 0), (None, "É́ a b", 0), (2, "w " * 50000, 0), (2, "w " * 50000, 0),
            (5, "tab\tand\x1cmore\n\n", 0), (6, "A.. B., c.\nD'S. 3.5 x,y İ.\nΑΣ. É. <|STARTOFTEXT|>. ", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, data int")
    folder = session.new_folder(spark)
    S.write(docs, folder)
    tokenizer = Tokenizer.from_file(S.TOKENIZER)
    got = sorted(S.read(spark, folder).collect(), key=lambda r: r.start)
    assert [r.id for r in got] == [None, 1, 1, 2, 2, 3, 5, 6]
    want = {r[0]: tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [2] for r in rows}
    start = 0
    for r in got:
        assert r.start == start and list(r.tokens) == want[r.id]
        start += r.n_tokens
    folder = session.new_folder(spark)
    S.write(docs.limit(0), folder)
    assert S.read(spark, folder).count() == 0
