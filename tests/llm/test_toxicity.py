import zlib

from driftpool.llm import queries, toxicity


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = queries.op2_toxicity(spark, folder).collect()
    assert len(rows) == 10000
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
        assert r.predicted == (r.score >= 0.7)
    out = [(r.score, r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    ones, zeros = [o for o in out if o[2]], [o for o in out if not o[2]]
    better = sum((a[0] > b[0]) + 0.5 * (a[0] == b[0]) for a in ones for b in zeros) / (len(ones) * len(zeros))
    caught = sum(o[1] for o in ones) / len(ones)
    wrong = sum(o[1] for o in zeros) / len(zeros)
    assert better > 0.85 and caught > 0.7 and wrong < 0.02, (better, caught, wrong)


def test_odd_rows(spark):
    rows = [(i, "you are an idiot and a clown" if i % 3 == 0 else "a calm and friendly text", "x") for i in range(300)]
    docs = spark.createDataFrame(rows + [(None, None, "x"), (5, "", "x"), (5, "", "x"), (900, "so " * 50000, "x")],
                                 "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)] + [(3, None), (6, 0), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = toxicity.judged(docs, model).collect()
    assert len(got) == 304 and all(r.score is not None for r in got)
    assert all(r.predicted == (r.id % 3 == 0) for r in got if r.id is not None and r.id < 300 and r.id != 5)
    beside = model.score(docs, "text", toxicity.unused(docs, "score"))
    assert beside.columns == ["doc_id", "text", "score", "_score"] and beside.count() == 304
    for d, l in ((docs, labels.limit(0)), (docs.limit(0), labels), (docs, labels.filter("toxic = 0"))):
        rows = toxicity.judged(d, toxicity.fit(d, l)).collect()
        assert len(rows) == d.count() and all(r.score == 0.0 for r in rows)
