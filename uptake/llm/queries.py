"""The registered queries of this subpackage, each next to its SQL where SQL can express it."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import functions as F

from uptake.llm import (
    centroids, chunks, divergence, interpolation, leaks, mixing, near_duplicates, quality, repeats, templates, token_counts,
    topk, url_filters, warc,
)

QUERIES = {}
ORACLES = {}


def query(sql: str | None = None):
    """Register a query under its function name, with the SQL that checks it."""
    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function
    return register


def _table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _fold(modulus: int):
    """crc32 of the doc_id as text, modulo ``modulus``; -1 for rows without one."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus, F.lit(-1))


@query(r"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
  win AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS seq
          FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20)),
  late AS (SELECT doc_id, i FROM win
           QUALIFY row_number() OVER (PARTITION BY seq ORDER BY doc_id, i) > 1),
  gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM late),
  word AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS j, unnest(ws) AS t FROM w),
  kept AS (SELECT doc_id, string_agg(t, ' ' ORDER BY j) AS s, count(*) AS k
           FROM word ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, len(ws)::BIGINT - coalesce(k, 0) AS n_removed,
  sha256(coalesce(s, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)""")
def op7_substring_dedup(spark, sf):
    """Words of each text that repeat a passage of 20 words from an earlier place."""
    out = repeats.remove_repeats(_table(spark, sf, "documents"), length=20)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query(r"""
WITH RECURSIVE w AS (
    SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
  sets AS (SELECT doc_id, CASE WHEN len(ws) > 1 THEN list_distinct(list_transform(range(1, len(ws)),
      lambda i: ws[i] || ' ' || ws[i + 1])) ELSE ws END AS s FROM w),
  item AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
  pair AS (SELECT l.doc_id AS a, r.doc_id AS b FROM item l JOIN item r ON l.x = r.x AND l.doc_id <> r.doc_id
             AND 100 * least(l.n, r.n) >= 80 * greatest(l.n, r.n)
           GROUP BY l.doc_id, r.doc_id, l.n, r.n HAVING 100 * count(*) >= 80 * (l.n + r.n - count(*))),
  reach AS (SELECT a, b FROM pair UNION SELECT reach.a, pair.b FROM reach JOIN pair ON reach.b = pair.a),
  low AS (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id,
  doc_id = least(doc_id, coalesce(m, doc_id)) AS kept
FROM sets LEFT JOIN low USING (doc_id)""")
def op10_near_duplicates(spark, sf):
    """Components of texts whose 2-word shingles are at least 0.8 similar."""
    return near_duplicates.near_duplicates(_table(spark, sf, "documents"), size=2, threshold=0.8)


def quality_labels(spark, sf):
    """Labels of the rows that may be learned from."""
    return _table(spark, sf, "labels").where(_fold(4) != 2).select("doc_id", F.col("quality").alias("label"))


@query()
def op3_quality_classifier(spark, sf):
    """Every text's quality score, learned from three quarters of the labels."""
    scored = quality.quality_scores(_table(spark, sf, "documents"), quality_labels(spark, sf))
    return scored.select(
        "doc_id", (_fold(4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query()
def op9_decontamination(spark, sf):
    """Benchmark items that texts hold, whole or edited."""
    return leaks.leaks(_table(spark, sf, "documents"), _table(spark, sf, "benchmark"))


LANGUAGES = {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}
WITH_JUNK = {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.19, "junk": 0.01}


def labelled_domains(spark, sf, docs):
    """The domain of labelled documents: junk where the label says so, their language elsewhere."""
    labels = _table(spark, sf, "labels").where("quality IS NOT NULL").select("doc_id", "quality")
    return labels.join(docs.select("doc_id", "lang"), "doc_id").select(
        "doc_id", F.when(F.col("quality") == 0, "junk").otherwise(F.col("lang")).alias("domain"))


@query()
def op2_mixing(spark, sf):
    """Rates of all documents that mix four languages and a little junk to fixed shares."""
    docs = _table(spark, sf, "documents")
    mixed = mixing.mix_to_targets(docs, labelled_domains(spark, sf, docs), WITH_JUNK)
    shares = [F.col("posterior")[k].alias(f"p_{name}") for k, name in enumerate(WITH_JUNK)]
    return mixed.select("doc_id", "n_tokens", "rate", "copies", *shares)


@query()
def op1_token_counts(spark, sf):
    """Bytes and tokens of every text."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    return token_counts.token_counts(_table(spark, sf, "documents"), path, limit=4096)


@query("""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
  s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
        FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 20""")
def op4_exact_topk(spark, sf):
    """The 20 best inner products of every twentieth vector with all others."""
    rows = _table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return topk.top_k(rows.where("vec_id % 20 = 0"), rows, k=20, scale=64)


URL_RULES = (
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"),
)
# Host labels whose urls are listed.
LISTED_LABELS = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")


@query(f"""
WITH p AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
           FROM pages),
  h AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw,
          regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM p),
  u AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM h),
  r AS (SELECT * FROM (VALUES {", ".join(f"('{v}', '{h}', '{q}')" for v, h, q in URL_RULES)}) AS t(says, dom, below)),
  f AS (SELECT page_id, dom || below AS rule, says FROM u JOIN r
        ON (host = dom OR ends_with(host, '.' || dom)) AND starts_with(path, below)
        QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(dom || below) DESC) = 1)
SELECT page_id, host, path, rule, coalesce(says, CASE WHEN list_has_any(string_split(host, '.'),
  [{", ".join(f"'{x}'" for x in LISTED_LABELS)}]) THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN f USING (page_id)""")
def op8_url_filters(spark, sf):
    """Every page's url under five rules and a table of keys."""
    pages = _table(spark, sf, "pages")
    host, path = url_filters.host_and_path(F.col("url"))
    labels = F.array(*map(F.lit, LISTED_LABELS))
    listed = pages.where(F.arrays_overlap(F.split(host, "[.]"), labels)).select(F.concat(host, path).alias("key"))
    return url_filters.judge_urls(pages, URL_RULES, listed)


@query()
def op5_language_model(spark, sf):
    """Every text's log10 probability, learned from four fifths of the documents."""
    docs = _table(spark, sf, "documents").withColumn("train", _fold(5) != 1)
    return interpolation.score_texts(docs).select(
        "doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query(r"""
WITH a AS (SELECT page_id, url, regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1),
             '[\x20\x09-\x0D]+', ' ', 'g') AS x FROM pages),
  b AS (SELECT page_id, url, regexp_replace(regexp_replace(x, '</?(p|h1)>', chr(10), 'g'), '<[^>]*>', '', 'g') AS x FROM a),
  c AS (SELECT page_id, url, replace(regexp_replace(replace(replace(replace(x, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'),
             '&amp;?', '&', 'g'), chr(160), ' ') AS x FROM b),
  d AS (SELECT page_id, url, array_to_string(list_filter(list_transform(string_split(x, chr(10)), lambda y: trim(y)),
             lambda y: y <> ''), chr(10)) AS text FROM c)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM d""")
def op6_html_extraction(spark, sf):
    """The main text of every page."""
    return templates.main_texts(_table(spark, sf, "pages"))


@query(r"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
  t AS (SELECT i, lang, source, unnest(ts) AS term FROM d),
  k AS (SELECT lang, term, count(*) AS total FROM t GROUP BY lang, term HAVING count(DISTINCT i) >= 3),
  c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
  s AS (SELECT lang, source, sum(n) AS size FROM c GROUP BY lang, source),
  l AS (SELECT lang, count(*) AS v, sum(total) AS lang_size FROM k GROUP BY lang),
  g AS (SELECT lang, source, coalesce(size, 0) AS size, coalesce(v, 0) AS v, coalesce(lang_size, 0) AS lang_size
        FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN s USING (lang, source) LEFT JOIN l USING (lang)),
  p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
          1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.size + g.v) AS p,
          1 + (1000000000::HUGEINT * (k.total + 1)) // (g.lang_size + g.v) AS q
        FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
  pairs AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
            FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
  rows AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
    FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
    UNION ALL
    SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value,
  row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
FROM rows QUALIFY part = 'pair' OR rank <= 200""")
def op11_divergence(spark, sf):
    """How far sources diverge from each other and from their language."""
    return divergence.source_divergence(_table(spark, sf, "documents"), least_texts=3, most=200)


@query("""
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
           FROM pages),
  f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first < page_id THEN first END AS refers_to FROM f""")
def op12_warc(spark, sf):
    """Every page's record, written to archives and read back."""
    folder = f"{chunks._own_folder(spark)}/archives-{uuid.uuid4().hex}"
    warc.write_archives(_table(spark, sf, "pages"), folder, least_bytes=100)
    records = warc.read_archives(spark, folder, with_payload=False).where("type IN ('response', 'revisit')")
    page = "try_cast(regexp_extract({}, '^<urn:page:(-?[0-9]*):', 1) AS bigint)"
    return records.select(
        F.expr(page.format("record_id")).alias("page_id"), "payload_bytes",
        F.regexp_replace("payload_digest", "^sha256:", "").alias("payload_digest"), F.col("type").alias("record_type"),
        F.expr(page.format("refers_to")).alias("refers_to"))


def _cluster_sql(rounds: int) -> str:
    """Rounds of assignment and replacement, one after the other."""
    def nearest(i):
        return f"""a{i} AS MATERIALIZED (SELECT vec_id, cluster, distance FROM (SELECT v.vec_id, c.cluster, list_sum(list_transform(
    list_zip(v.e, c.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS distance FROM v CROSS JOIN c{i} c)
    QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, cluster) = 1)"""
    parts = ["""v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
             """c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS cluster, e FROM v
    ORDER BY sha256('3:' || vec_id) LIMIT 8)"""]
    for i in range(rounds):
        parts.append(nearest(i))
        parts.append(f"""c{i + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.e, c.e) AS e FROM c{i} c LEFT JOIN (
    SELECT cluster, list(floored ORDER BY j) AS e FROM (SELECT cluster, j, (s - ((s % n) + n) % n) // n AS floored FROM (
      SELECT cluster, j, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT cluster, unnest(e) AS x, unnest(range(64)) AS j FROM a{i} JOIN v USING (vec_id))
      GROUP BY cluster, j)) GROUP BY cluster) m USING (cluster))""")
    parts.append(nearest(rounds))
    return f"""WITH {", ".join(parts)}
SELECT vec_id, cluster::INTEGER AS cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia,
  sum(distance) OVER ()::BIGINT AS inertia, sha256(array_to_string(e, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (cluster)"""


@query(_cluster_sql(10))
def op13_centroids(spark, sf):
    """Every vector's cluster after ten rounds around eight centroids."""
    rows = _table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    found = centroids.centroid_clusters(rows, dims=64, count=8, rounds=10, scale=1024, salt="3:")
    rows = chunks.written(found.rows)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.centroids]
    digest = F.element_at(F.array(*map(F.lit, digests)), F.col("cluster") + 1) if digests else F.lit("")
    total = F.sum(F.col("distance").cast("decimal(38,0)"))
    sums = chunks.written(rows.groupBy("cluster").agg(total.alias("s")))  # a row per centroid
    per_cluster = sums.withColumn("t", sums.agg(F.sum("s")).scalar())
    return rows.join(F.broadcast(per_cluster), "cluster").select(
        "vec_id", "cluster", "distance", F.expr("try_cast(s AS bigint)").alias("cluster_inertia"),
        F.expr("try_cast(t AS bigint)").alias("inertia"), digest.alias("centroid_sha256"))
