from driftpool.llm import fixity


def frame(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS seq", "'x' AS digest")


def test_damage_is_found_where_it_is(spark):
    rows = [(i, f"http://h/{i}", "x" * (i % 7)) for i in range(700)] + [(None, None, None), (3, "http://h/3", "xxx"), (800, "u", "y" * 200000)]
    mine = fixity.laid_out(frame(spark, rows))
    bad = [(i, u, h.replace("x", "z", 1) if i in (5, 6, 401) else h) if h else (i, u, h) for i, u, h in rows]
    theirs = fixity.laid_out(frame(spark, bad))
    got = fixity.audited(mine, theirs).collect()
    assert len(got) == len(rows) and sorted(r.id for r in got if r.what) == [5, 6, 401]
    places = sorted((r.seq, r.start, r.end) for r in got)
    assert places[0][:2] == (0, 0) and all(a[2] == b[1] and a[0] + 1 == b[0] for a, b in zip(places, places[1:]))
    assert all(r.what is None for r in fixity.audited(mine, mine).collect())


def test_only_differing_branches_are_read(spark):
    rows = [(i, "u", "x" * 5) for i in range(300)]
    one = fixity.tree(fixity.laid_out(frame(spark, rows)))
    two = fixity.tree(fixity.laid_out(frame(spark, [(i, u, "y" * 5 if i == 17 else h) for i, u, h in rows])))
    assert [level.count() for level in one] == [300, 19, 2, 1] and fixity.root(one) != fixity.root(two)
    for a, b in zip(one, two):
        assert a.join(b, ["node", "digest"]).count() == a.count() - 1


def test_missing_and_extra_records(spark):
    rows = [(i, "u", "x") for i in range(40)]
    mine = fixity.laid_out(frame(spark, rows))
    short = fixity.laid_out(frame(spark, rows[:-3]))
    assert sorted((r.id, r.what) for r in fixity.audited(mine, short).collect() if r.what) == [(37, "missing"), (38, "missing"), (39, "missing")]
    extra = fixity.differing(fixity.tree(short), fixity.tree(mine)).collect()
    assert sorted((r.seq, r.what) for r in extra) == [(37, "extra"), (38, "extra"), (39, "extra")]
    empty = fixity.laid_out(frame(spark, rows).limit(0))
    assert fixity.audited(empty, mine).count() == 0
    assert {r.what for r in fixity.audited(mine, empty).collect()} == {"missing"}
