import hashlib
import re

from driftpool.llm import decontaminate, queries

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, window=10):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - window + 1)) if w else ():
            windows.setdefault(tuple(w[i:i + window]), set()).add(item)
    sizes = {len(k) for k in windows}
    out = {}
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                got = windows.get(tuple(w[i:i + n]))
                if got:
                    found |= got
                    hit |= set(range(i, i + n))
        out[doc] = (len(w), len(hit), sorted(str(i) for i in found if i is not None))
    return out


def test_query_against_every_window(spark):
    folder = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    want = plain(docs, items)
    got = {r.doc_id: r for r in queries.op9_decontaminate(spark, folder).collect()}
    assert got.keys() == want.keys() and any(w[1] for w in want.values())
    for i, (n, hit, found) in want.items():
        assert (got[i].n_words, got[i].n_hit, got[i].n_items, got[i].contaminated) == (n, hit, len(found), hit > 0)
        assert got[i].items_sha256 == hashlib.sha256(",".join(found).encode()).hexdigest()


ITEMS = [(1, "One two three four five six seven eight nine ten eleven twelve"), (2, "Só três É é"), (3, ""), (4, None),
         (5, "the the the the the the the the the the the"), (5, "alpha beta"), (None, "gamma delta")]
DOCS = [(1, "x ONE two,three four-five six seven eight nine ten! y", "a"), (2, "two three four five six seven eight nine ten eleven", "b"),
        (3, None, "c"), (4, "", "d"), (5, "só TRÊS É é; Só trÊs É é. SÓ trÊs É é", "e"), (6, "the " * 30, "f"), (7, "alpha  beta gamma", "g"),
        (8, "gamma delta", "h"), (8, "gamma delta", "h"), (None, "alpha beta", "i"), (9, "one two three four five six seven eight nine", "j"),
        (10, "...", "k"), (11, "w " * 60000 + ITEMS[0][1], "l")]


def test_odd_rows(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, word string")
    items = spark.createDataFrame(ITEMS, "item_id int, text string")
    index = decontaminate.build(docs, items)
    got = sorted((str(r.id), r.n_words, r.n_hit, list(r["items"])) for r in decontaminate.audited(index).collect())
    want = plain([(i, t) for i, (_, t, _) in enumerate(DOCS)], ITEMS)
    assert got == sorted((str(DOCS[i][0]), *v) for i, v in want.items())
    left = sorted(str(r.doc_id) for r in decontaminate.cleaned(docs, items).collect())
    assert left == sorted(str(DOCS[i][0]) for i, v in want.items() if not v[1])
    assert decontaminate.cleaned(docs, items).columns == docs.columns
    for d, b in ((docs.limit(0), items), (docs, items.limit(0))):
        rows = decontaminate.audited(decontaminate.build(d, b)).collect()
        assert len(rows) == d.count() and not any(r.n_hit for r in rows)


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "one two three UM four five six seven eight nine AH ten eleven twelve"),
                                  (2, "twelve one nine three"), (3, "zz")], "doc_id long, text string")
    items = spark.createDataFrame(ITEMS[:1], "item_id int, text string")
    index = decontaminate.build(docs, items)
    assert [r.id for r in decontaminate.near(index, slop=2).collect()] == [1]
    assert decontaminate.phrases(index).count() == 0


def test_proximity_over_the_whole_item(spark):
    """A word put in or left out in the middle of a long item, and a short one whose rarest word is another."""
    long = [f"w{k}" for k in range(60)]
    short = "red orange yellow green blue violet white black grey rare".split()
    docs = spark.createDataFrame([(1, " ".join(["before"] + long[:30] + ["new"] + long[30:])),
                                  (2, " ".join(long[:30] + long[31:])), (3, " ".join(short[:9] + ["other"])),
                                  (4, " ".join(long[:47])), (5, "rare"), (6, " ".join(short[:7]))],
                                 "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(long)), (2, " ".join(short)), (3, " ".join(short[:9] + ["absent"]))],
                                  "item_id int, text string")
    index = decontaminate.build(docs, items)
    got = {(r.id, r.item_id): r.words for r in decontaminate.near(index).collect()}
    assert got == {(1, 1): 60, (2, 1): 59, (3, 2): 9, (3, 3): 9}


def test_postings_are_not_broadcast(spark):
    """Postings take few bytes in files: their estimate is below the limit long after their rows are not."""
    docs = spark.createDataFrame([(1, "a b c d"), (2, "x a b c d y"), (3, "q")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "a b c d")], "item_id long, text string")
    found = decontaminate.aligned(decontaminate.build(docs, items))
    plan = found._jdf.queryExecution().executedPlan().toString()
    last = plan[:plan.index("Join")].splitlines()[-1] + plan[plan.index("Join"):].splitlines()[0]
    assert "SortMergeJoin" in last
    assert sorted({r.id for r in found.collect()}) == [1, 2]
