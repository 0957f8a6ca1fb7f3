"""The numbered queries: thin digests of what the operators return."""

import corpus_pipeline
from pyspark.sql import functions as F

from driftpool.llm import (decontaminate, fixity, imatch, oddsketch, pii, prefixtrie, redirects, sentencepieces, simhash,
                           simple8b, suffixes, toxicity, vantage)
from driftpool.llm.catalog import query
from driftpool.session import new_folder


def table(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op10_simhash")
def op10_simhash(spark, folder):
    """Fingerprint and near-duplicate component of every document (three words, three bits)."""
    found = simhash.near_components(table(spark, folder, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                        "component_id")


@query("op2_toxicity")
def op2_toxicity(spark, folder):
    """Calibrated toxicity of every document."""
    docs = table(spark, folder, "documents")
    model = toxicity.fit(docs, table(spark, folder, "labels"))
    return toxicity.judged(docs, model).withColumnRenamed("id", "doc_id")


@query("op9_decontaminate")
def op9_decontaminate(spark, folder):
    """Words of every document that lie inside benchmark passages."""
    index = decontaminate.build(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return decontaminate.audited(index).select(
        F.col("id").alias("doc_id"), F.col("n_words").cast("long").alias("n_words"), "n_hit",
        F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


@query("op3_pii")
def op3_pii(spark, folder):
    """Personal data of every document: base spans and what context patterns add."""
    found = pii.summary(pii.spans(table(spark, folder, "documents")))
    return found.select(F.col("id").alias("doc_id"), *[f"n_{k}" for k in pii.KINDS],
                        F.sha2("base", 256).alias("base_sha256"), "spans")


@query("op7_merge_dropout")
def op7_merge_dropout(spark, folder):
    """Pieces of every document under merge-dropout, and the text they decode to."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    rows = sentencepieces.encoded(docs)
    rows = rows.withColumn("back", sentencepieces.decoded(F.col("token_ids")))
    return rows.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"),
                       F.xxhash64("token_ids").alias("ids_hash"), F.sha2("back", 256).alias("decoded_sha256"),
                       (F.col("back") == F.coalesce("text", F.lit(""))).alias("lossless"))


@query("pipeline")
def pipeline(spark, folder):
    """All stages of the corpus pipeline over the documents."""
    return corpus_pipeline.run(spark, folder)


@query("op4_simple8b")
def op4_simple8b(spark, folder):
    """Place, number and check sum of every document's token ids, read back from the files."""
    files = new_folder(spark)
    simple8b.write(table(spark, folder, "documents"), files)
    return simple8b.read(spark, files).select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32")


@query("op8_suffix_dedup")
def op8_suffix_dedup(spark, folder):
    """What is left of every document without strings of 400 bytes that also begin elsewhere."""
    found = suffixes.removed(table(spark, folder, "documents"))
    gone = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return found.select(F.col("id").alias("doc_id"), "n_bytes", gone.alias("n_removed"),
                        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
                        (gone > 0).alias("repeated"))


@query("op6_imatch")
def op6_imatch(spark, folder):
    """I-Match fingerprint of every document, of its edited text, and how like they are."""
    docs = table(spark, folder, "documents")
    found = imatch.compared(docs, imatch.lexicon(docs))
    return found.withColumnRenamed("id", "doc_id")


def _edges_sql():
    quoted = "[\"'']?([^\"''\\s>]+)"
    link = "(?i)<link\\b[^>]*\\brel\\s*=\\s*[\"'']?canonical\\b[^>]*>"
    meta = "(?i)<meta\\b[^>]*\\bhttp-equiv\\s*=\\s*[\"'']?refresh\\b[^>]*>"
    node = "translate(regexp_extract(u, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    key = f"""CASE WHEN contains(u, '://') THEN {node} || CASE WHEN regexp_extract(u, '://[^/?#]*([^#]*)', 1) = '' THEN '/'
        ELSE regexp_extract(u, '://[^/?#]*([^#]*)', 1) END END"""
    fits = lambda h, p, host, path: f"(({host} = '{h}' OR ends_with({host}, '.{h}')) AND starts_with({path}, '{p}'))"

    def case(host, path, named):
        rules = sorted(redirects.RULES, key=lambda r: -len(r[0] + r[1]))
        return "CASE " + " ".join(f"WHEN {fits(h, p, host, path)} THEN '{h + p if named else v}'" for h, p, v in rules) + " END"
    return f"""
WITH RECURSIVE page AS (
  SELECT page_id, url, html,
    coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
target AS (
  SELECT url, host, path, regexp_extract(regexp_extract(html, '{link}', 0), '(?i)\\bhref\\s*=\\s*{quoted}', 1) AS t FROM page
  UNION ALL
  SELECT url, host, path, regexp_extract(regexp_extract(html, '{meta}', 0), '(?i)\\burl\\s*=\\s*{quoted}', 1) FROM page),
full_target AS (
  SELECT url, CASE WHEN contains(t, '://') THEN t
    WHEN starts_with(t, '//') THEN regexp_extract(url, '^([^:/?#]*):', 1) || ':' || t
    WHEN starts_with(t, '/') THEN regexp_extract(url, '^([^:/?#]*):', 1) || '://' || regexp_extract(url, '://([^/?#]*)', 1) || t
    WHEN starts_with(t, '#') THEN url
    ELSE regexp_extract(url, '^([^:/?#]*):', 1) || '://' || regexp_extract(url, '://([^/?#]*)', 1)
      || CASE WHEN regexp_extract(path, '^(.*/)', 1) = '' THEN '/' ELSE regexp_extract(path, '^(.*/)', 1) END || t END AS t
  FROM target WHERE t <> '' AND url IS NOT NULL),
pair AS (
  SELECT (SELECT {key} FROM (SELECT url AS u)) AS a, (SELECT {key} FROM (SELECT t AS u)) AS b FROM full_target),
edge AS (SELECT a, b FROM pair WHERE a IS NOT NULL AND b IS NOT NULL UNION SELECT b, a FROM pair WHERE a IS NOT NULL AND b IS NOT NULL),
reach AS (SELECT a, b FROM edge UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a),
bad AS (
  SELECT DISTINCT a FROM reach WHERE {case("regexp_extract(b, '^([^/]*)', 1)", "regexp_extract(b, '^[^/]*([^?]*)', 1)", False)} = 'block'),
named AS (SELECT page_id, host, path, {case("host", "path", True)} AS rule, {case("host", "path", False)} AS own,
    (SELECT {key} FROM (SELECT url AS u)) AS node FROM page)
SELECT page_id, host, path, rule, coalesce(own, CASE WHEN node IN (SELECT a FROM bad) THEN 'block' ELSE 'allow' END) AS verdict
FROM named"""


@query("op1_redirects", _edges_sql())
def op1_redirects(spark, folder):
    """Verdict on every page's URL under the rules, and under those of its aliases."""
    return redirects.judged(table(spark, folder, "pages")).withColumnRenamed("id", "page_id")


RECORD = """'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: '
    || coalesce(url, '') || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10)
    || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10)"""


@query("op5_merkle_fixity", f"""
WITH r AS (SELECT page_id, {RECORD} AS rec, contains(coalesce(html, ''), '&amp;') AS hit FROM pages)
SELECT page_id, CAST(sum(strlen(rec)) OVER (ORDER BY page_id) - strlen(rec) AS BIGINT) AS warc_offset,
  CAST(strlen(rec) AS BIGINT) AS warc_length, sha256(rec) AS sha256, hit AS damaged
FROM r""")
def op5_merkle_fixity(spark, folder):
    """Every page's record with its place, and whether a replica differs there.

    The replica is the same pages after a faulty copy that changed the letters of an entity but no length.
    """
    pages = table(spark, folder, "pages")
    replica = pages.withColumn("html", F.replace(F.col("html"), F.lit("&amp;"), F.lit("&AMP;")))
    found = fixity.audited(fixity.laid_out(pages), fixity.laid_out(replica))
    return found.select(F.col("id").alias("page_id"), F.col("start").alias("warc_offset"),
                        (F.col("end") - F.col("start")).alias("warc_length"), F.col("digest").alias("sha256"),
                        F.col("what").isNotNull().alias("damaged"))


def _trie_sql():
    # the CRC-32 of digits, four bits at a time: fixed values are the remainders of 0 to 15
    remainders = []
    for k in range(16):
        for _ in range(4):
            k = k >> 1 ^ (0xEDB88320 if k & 1 else 0)
        remainders.append(k)
    digits = "flatten([[ascii(x) & 15, ascii(x) >> 4] for x in string_split(CAST(conv_id AS VARCHAR), '')])"
    crc = f"""xor(list_reduce([4294967295::BIGINT] || [CAST(n AS BIGINT) for n in {digits}],
      lambda c, n: xor(c >> 4, ({remainders}::BIGINT[])[CAST(xor(c, n) & 15 AS INTEGER) + 1])), 4294967295)"""
    return f"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS place,
    {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS t
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list(t ORDER BY place) AS turns, {crc} % 9 AS h FROM t GROUP BY conv_id),
built AS (
  SELECT c.conv_id, coalesce(g.turns[:CAST(c.h AS INTEGER)], []) || c.turns[CAST(c.h AS INTEGER) + 1:] AS turns
  FROM c LEFT JOIN c g ON g.conv_id = c.conv_id - (c.conv_id % 5 + 5) % 5),
member AS (
  SELECT conv_id, len(turns) AS size, d AS depth, turns[:CAST(d AS INTEGER)] AS path
  FROM (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS d FROM built)),
node AS (
  SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs,
    CASE WHEN depth = 0 THEN 0 ELSE strlen(path[depth].text) END AS bytes,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE size = depth), '')) AS ends
  FROM member GROUP BY depth, path),
kid AS (
  SELECT p.depth, p.path, count(k.depth) AS n_children
  FROM node p LEFT JOIN node k ON k.depth = p.depth + 1 AND k.path[:CAST(p.depth AS INTEGER)] = p.path GROUP BY p.depth, p.path),
whole AS (SELECT n.*, k.n_children FROM node n JOIN kid k ON n.depth = k.depth AND n.path = k.path),
below AS (
  SELECT a.depth, a.path, count(*) FILTER (WHERE b.n_children = 0) AS n_leaves, sum((b.n_convs - 1) * b.bytes) AS saved
  FROM whole a JOIN (SELECT w.*, unnest(range(0, depth + 1)) AS up FROM whole w) b
    ON b.up = a.depth AND b.path[:CAST(b.up AS INTEGER)] = a.path GROUP BY a.depth, a.path)
SELECT w.conv_id, CAST(w.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, w.n_convs, w.n_children, b.n_leaves,
  CAST(b.saved AS BIGINT) AS saved_tokens, w.ends AS ends_sha256
FROM whole w JOIN below b ON w.depth = b.depth AND w.path = b.path
  LEFT JOIN node p ON p.depth = w.depth - 1 AND p.path = w.path[:CAST(w.depth - 1 AS INTEGER)] AND w.depth > 0"""


@query("op11_prefix_trie", _trie_sql())
def op11_prefix_trie(spark, folder):
    """Every node of the trie of the rebuilt conversations."""
    return prefixtrie.nodes(prefixtrie.rebuilt(table(spark, folder, "conversations")))


def _clusters_sql():
    squared = "list_sum(list_transform(list_zip(v.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    assign = lambda k: f"""  SELECT vec_id, key, v, c_id, d FROM (
    SELECT v.vec_id, v.key, v.v, c.c_id, CAST({squared} AS BIGINT) AS d,
      row_number() OVER (PARTITION BY v.key, v.vec_id, v.copy ORDER BY {squared}, c.c_id) AS place
    FROM whole v, c{k} c) WHERE place = 1"""  # noqa: E731
    rounds = ""
    for k in range(vantage.ROUNDS):
        rounds += f"""
a{k} AS MATERIALIZED (
{assign(k)}),
m{k} AS (
  SELECT c_id, list(CAST(floor(s / n) AS BIGINT) ORDER BY i) AS v FROM (
    SELECT c_id, i, CAST(sum(v[i]) AS DOUBLE) AS s, count(*) AS n FROM a{k}, range(1, {vantage.DIMENSIONS + 1}) r(i) GROUP BY c_id, i)
  GROUP BY c_id),
c{k + 1} AS MATERIALIZED (SELECT c.c_id, coalesce(m.v, c.v) AS v FROM c{k} c LEFT JOIN m{k} m ON c.c_id = m.c_id),"""
    last = vantage.ROUNDS
    return f"""
WITH whole AS MATERIALIZED (
  SELECT vec_id, sha256('{vantage.SEED}:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS key, row_number() OVER () AS copy,
    [CAST(floor({vantage.SCALE} * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS v
  FROM embeddings WHERE len(embedding) = {vantage.DIMENSIONS}
    AND len([x for x in embedding if x IS NOT NULL AND isfinite(x)]) = {vantage.DIMENSIONS}),
c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY key, v) - 1 AS INTEGER) AS c_id, v
  FROM (SELECT key, v FROM whole ORDER BY key, v LIMIT {vantage.CLUSTERS})),{rounds}
f AS MATERIALIZED (
{assign(last)})
SELECT f.vec_id, f.c_id AS "cluster", f.d AS distance, CAST(sum(f.d) OVER (PARTITION BY f.c_id) AS BIGINT) AS cluster_inertia,
  CAST(sum(f.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM f JOIN c{last} c ON f.c_id = c.c_id"""


@query("op12_vantage_clusters", _clusters_sql())
def op12_vantage_clusters(spark, folder):
    """Cluster of every vector after five rounds, with its distance and the inertia."""
    found = vantage.described(*vantage.clustered(table(spark, folder, "embeddings")))
    return found.withColumnRenamed("id", "vec_id")


@query("op13_odd_sketch")
def op13_odd_sketch(spark, folder):
    """Near-duplicate component of every document (four words, 80 %)."""
    found = oddsketch.near_duplicates(table(spark, folder, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id",
                        F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
