"""URL filters: rules by host and path, carried to aliases over redirect and canonical-link edges."""

from pyspark.sql import Column, DataFrame, functions as F

from driftpool.llm.bounds import measured
from driftpool.llm.components import connected_components
from driftpool.session import staged

# fixed values: host, path, verdict
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"),
         ("org", "/fr/", "allow"))

LINK = r"(?i)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
META = r"(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
HREF = r"(?i)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
TARGET = r"(?i)\burl\s*=\s*[\"']?([^\"'\s>]+)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """Between the first ``://`` and the next of ``/ ? #``, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    """From behind the host up to ``?`` or ``#``."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def node(url: Column) -> Column:
    """What stands for a URL in the graph: host, path and query; scheme and fragment do not tell URLs apart."""
    rest = F.regexp_extract(url, r"://[^/?#]*([^#]*)", 1)
    return F.when(F.instr(url, "://") > 0, F.concat(host(url), F.when(rest == "", "/").otherwise(rest)))


def resolved(target: Column, base: Column) -> Column:
    """Absolute form of a link target found on the page ``base``."""
    scheme = F.regexp_extract(base, r"^([^:/?#]*):", 1)
    root = F.concat(scheme, F.lit("://"), F.regexp_extract(base, r"://([^/?#]*)", 1))
    folder = F.regexp_extract(path(base), r"^(.*/)", 1)
    return (F.when(F.instr(target, "://") > 0, target)
            .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
            .when(target.startswith("/"), F.concat(root, target))
            .when(target.startswith("#"), base)
            .otherwise(F.concat(root, F.when(folder == "", "/").otherwise(folder), target)))


def rule(host_: Column, path_: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule as text, its verdict) of the longest rule that fits a host or its subdomains and a path's beginning."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0] + r[1])):
        fits = ((host_ == h) | host_.endswith("." + h)) & path_.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(source, target): nodes joined by the canonical link or the refresh of a page."""
    url, html = F.col(f"`{url_col}`").cast("string"), F.col(f"`{html_col}`").cast("string")
    canonical = F.regexp_extract(F.regexp_extract(html, LINK, 0), HREF, 1)
    refresh = F.regexp_extract(F.regexp_extract(html, META, 0), TARGET, 1)
    rows = pages.select(url.alias("url"), F.explode(F.array(canonical, refresh)).alias("to")).filter(
        "to != '' AND url IS NOT NULL")
    return rows.select(node(F.col("url")).alias("source"), node(resolved(F.col("to"), F.col("url"))).alias("target")).filter(
        "source IS NOT NULL AND target IS NOT NULL")


def blocked_nodes(edges: DataFrame, rules=RULES) -> DataFrame:
    """(node) of all aliases in components with a member that a rule blocks.

    ``edges`` has (source, target); further redirect tables can be added to those of ``links``.
    """
    comp = staged(connected_components(edges, "source", "target"))
    cut = F.instr("node", "/")
    _, verdict = rule(F.expr("substring(node, 1, instr(node, '/') - 1)"),
                      F.regexp_extract("node", r"^[^/]*([^?]*)", 1), rules)
    bad = comp.withColumn("verdict", verdict).filter((cut > 0) & (F.col("verdict") == "block")).select("root").distinct()
    return comp.join(measured(bad), "root", "left_semi").select("node")


def judged(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules=RULES,
           redirects: DataFrame | None = None) -> DataFrame:
    """(id, host, path, rule, verdict) of every row.

    A URL's own rule decides, so an allow rule holds against any alias. A URL without a rule is blocked if a rule
    blocks one of its aliases, and allowed otherwise. ``redirects`` has (source, target) URLs beside those that the
    pages name. Null URLs and URLs without ``://`` have empty host and path, no aliases, and are allowed.
    """
    edges = links(pages, url_col, html_col)
    if redirects is not None:
        edges = edges.unionAll(redirects.select(node(F.col("source")), node(F.col("target"))))
    bad = measured(blocked_nodes(edges, rules).withColumnRenamed("node", "bad"))
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"))
    name, verdict = rule(F.col("host"), F.col("path"), rules)
    rows = rows.select("id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), node(F.col("url")).alias("node"))
    rows = rows.withColumn("rule", name).withColumn("own", verdict)
    return rows.join(bad, F.col("node") == F.col("bad"), "left").select(
        "id", "host", "path", "rule", F.coalesce("own", F.when(F.col("bad").isNotNull(), "block").otherwise("allow")).alias("verdict"))
