from driftpool.llm import redirects


def page(i, url, canonical=None, refresh=None):
    html = "<html><head>"
    if canonical:
        html += f'<LINK href="{canonical}" rel="canonical">'
    if refresh:
        html += f"<meta http-equiv=refresh content='0; url={refresh}'>"
    return (i, url, html + "</head></html>")


PAGES = [
    page(1, "https://a.example.org/x", canonical="http://blocked.net/home"),     # alias of a blocked URL
    page(2, "https://b.example.org/y?q=1#f", refresh="https://a.example.org/x"),
    page(3, "http://example.net/en/page", canonical="http://blocked.net/home"),   # own allow rule
    page(4, "http://EXAMPLE.net/de/page"), page(5, "http://sub.example.com/de/"), page(6, "http://sub.example.com/den"),
    page(7, "http://free.org/fr/x", refresh="http://blocked.net/home"), page(8, "http://x.net"), page(9, None), page(10, "no-scheme"),
    page(11, "http://notexample.com/de/"), page(12, "https://c.example.org/dir/p", canonical="q"), page(13, "https://c.example.org/dir/q", canonical="//bad.net/z"),
    page(14, "http://b.example.org/y?q=1"), page(15, "http://lone.example.info/"), page(15, "http://lone.example.info/"), (16, "http://u.net/", None)]
WANT = {1: (None, "block"), 2: (None, "block"), 3: ("example.net/en/", "allow"), 4: ("net/", "block"), 5: ("example.com/de/", "block"),
        6: (None, "allow"), 7: ("org/fr/", "allow"), 8: (None, "allow"), 9: (None, "allow"), 10: (None, "allow"), 11: (None, "allow"),
        12: (None, "block"), 13: (None, "block"), 14: (None, "block"), 15: (None, "allow"), 16: ("net/", "block")}


def test_rules_aliases_and_precedence(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "'x' AS node", "1 AS root")
    got = redirects.judged(pages).collect()
    assert len(got) == len(PAGES) and {r.id: (r.rule, r.verdict) for r in got} == WANT
    assert {(r.host, r.path) for r in got if r.id in (9, 10)} == {("", "")}
    assert [(r.host, r.path) for r in got if r.id == 2] == [("b.example.org", "/y")]
    assert redirects.judged(pages.limit(0)).count() == 0


def test_a_hub_of_redirects(spark):
    pages = spark.createDataFrame([(i, f"http://s{i}.example.org/", "") for i in range(500)], "page_id long, url string, html string")
    hops = spark.createDataFrame([(f"http://s{i}.example.org/", "http://hub.example.org/") for i in range(499)]
                                 + [("http://hub.example.org/", "http://end.net/")], "source string, target string")
    got = {r.id: r.verdict for r in redirects.judged(pages, redirects=hops).collect()}
    assert sum(v == "block" for v in got.values()) == 499 and got[499] == "allow"
