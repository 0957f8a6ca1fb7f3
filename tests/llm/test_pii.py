import hashlib
import re

from driftpool.llm import pii, queries

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def plain(text):
    found = []
    for kind, rx in BASE.items():
        for m in re.finditer(rx, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if (kind == "ip" and any(int(p) > 255 for p in m[0].split("."))
                    or kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits))
                    or kind == "phone" and not 8 <= len(digits) <= 15):
                continue
            found.append((kind, m.start(), m.end()))
    return found


TEXTS = ["é x@y.z_q@r.s.t mail a.b+c@d-e.fg. a@b", "1.2.3.4.5.6 300.1.1.1 001.02.3.255 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1112",
         "+1 (988) 555-2485 +49.30.123456789012345 +1-2 ++44 20 7946 0958", None, "", "a" * 20000 + "@" + "b." * 3000 + "c", "9" * 30000,
         "+1" + " " * 3000, "x@y.z@w.v 😀 4111111111111111", "1.2.3.4", "0.0.0.0 10.00.0.255 256.1.1.1 1.1.1.000256"]


def test_query_against_plain_patterns(spark):
    folder = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op3_pii(spark, folder).collect()}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        found = plain(t)
        for kind in BASE:
            assert got[i][f"n_{kind}"] == sum(f[0] == kind for f in found)
        spans = [":".join(map(str, f)) for f in found]
        assert got[i].base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert set(spans) <= set(got[i].spans.split(",")) | ({""} if not spans else set())


def test_odd_rows(spark):
    rows = [(i, t, "k", 5) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "k", 5), (None, TEXTS[10], "k", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kind string, row int")
    got = pii.summary(pii.spans(docs)).collect()
    assert len(got) == len(rows)
    for r in got:
        want = plain(TEXTS[10] if r.id is None else TEXTS[r.id])
        assert r.base == ",".join(":".join(map(str, f)) for f in want), r.id
    assert pii.summary(pii.spans(docs.limit(0))).count() == 0


def test_patterns_find_what_no_base_pattern_does(spark):
    seeds = [(i, f"please call desk +1 (555) 010-{1000 + i} today") for i in range(8)]
    seeds += [(20 + i, f"logged from host 10.0.0.{i} again") for i in range(8)]
    more = [(100, "please call desk 555-010-7777 today"), (101, "then (555)0104444 is a part number"),
            (102, "logged from host fe80::1:22 again"), (103, "logged from host 2001 again")]
    docs = spark.createDataFrame(seeds + more, "doc_id long, text string")
    found = pii.spans(docs).filter("NOT is_base").collect()
    texts = dict(more)
    assert sorted((r.kind, texts[r.id][r.start:r.end]) for r in found) == [
        ("ip", "fe80::1:22"), ("phone", "555-010-7777")]


def test_redaction(spark):
    rows = [(1, "é mail a@b.cd or 10.0.0.1, card 4111 1111 1111 1111.", 9, "x"), (2, "nothing", 7, "x"), (3, None, None, "x"),
            (1, "é mail a@b.cd or 10.0.0.1, card 4111 1111 1111 1111.", 9, "x"), (None, "+1 (988) 555-2485", 1, "x"),
            (4, "n 4111-1111-1111-1111, +49 (0) 4111 11111", 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, p_i string")
    got = pii.redacted(docs, pii.spans(docs))
    assert got.columns == docs.columns
    first = "é mail <EMAIL> or <IP>, card <CARD>."
    assert {(r.doc_id, r.text, r.n_chars) for r in got.collect()} == {
        (1, first, len(first)), (2, "nothing", 7), (3, None, None), (None, "<PHONE>", 7), (4, "n <CARD>, <PHONE>", 17)}
    assert got.count() == len(rows)


def card(k):
    digits = f"41111111{k:07d}"
    return next(digits + c for c in "0123456789" if luhn(digits + c))


def test_shapes_that_no_base_pattern_has(spark):
    """Every shape is found by its context: all planted ones (recall), and nothing that stands elsewhere (precision)."""
    seeds = [f"please call desk +1 (555) 010-{1000 + i} today" for i in range(24)]
    seeds += [f"write a mail to person{i}@example.com soon" for i in range(24)]
    seeds += [f"paid with card {card(i)} online" for i in range(24)]
    seeds += [f"open hosts 10.0.0.{i} 10.0.1.{i} 10.0.2.{i} again" for i in range(24)]
    planted = [("please call desk {} today", "phone", v) for v in ("555 010 7777", "(555) 010 7777", "555.010.7778", "555-010-7779")]
    planted += [("write a mail to {} soon", "email", v) for v in ("jane(at)example.com", "joe[at]example.org", "ann@intranet")]
    planted += [("paid with card {} online", "card", v) for v in ("4111 1111 1111 1112", "4111-1111-1111-1113")]
    planted += [("open hosts 10.9.9.1 {} again", "ip", "fe80::1:22"), ("open hosts fe80::7:1 10.9.9.3 {} again", "ip", "fe80::2:33")]
    others = ["then 555 010 7777 is a part number", "a word like what(at)ever stands alone", "section 4111 1111 1111 1112 ends",
              "the year 2001 2002 2003 was", "version 1:2:3 of it"]
    texts = seeds + [t.format(v) for t, _, v in planted] + others
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.id, r.kind, texts[r.id][r.start:r.end]) for r in pii.spans(docs).filter("NOT is_base").collect()}
    want = {(len(seeds) + i, kind, v) for i, (_, kind, v) in enumerate(planted)}
    want.add((len(seeds) + len(planted) - 1, "ip", "fe80::7:1"))
    assert got == want


def test_words_in_runs_and_beside_base_spans(spark):
    rows = [(1, "4111111111111 1112 22"), (2, "10.0.0.1 2001 555 010 7777"), (3, "x " * 300 + "(at)"), (4, "1 " * 5000), (5, "([" * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    placed = pii.occurrences(docs, "doc_id", "text")
    texts = dict(rows)
    got = sorted((r.id, r.value) for r in pii.candidates(placed, pii.base(placed)).collect())
    assert all(r[1] in texts[r[0]] for r in got)
    assert got == [(1, "4111111111111 1112 22")]
