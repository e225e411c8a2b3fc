"""The registered queries of the llm operators, and their SQL where there is any."""

from pyspark.sql import functions as F

from stratalog.llm import embeddings, media, mixing, pieces, quality, sharding, simhash, substrings, url_filter, warc
from stratalog.llm.scratch import Scratch

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op5_sharding")
def op5_sharding(spark, sf_dir):
    return sharding.shard(_table(spark, sf_dir, "documents"), Scratch(spark))


MIX_SQL = r"""WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [1, 2, 3][1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3] AS w, 3 * source_size AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER a, 0))::DOUBLE / (sum(w) OVER () - coalesce(sum(w) OVER a, 0))::DOUBLE AS level FROM w WINDOW a AS (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(cap::DOUBLE, max(level) OVER () * w) AS target FROM l),
r AS (SELECT d.*, row_number() OVER (PARTITION BY source ORDER BY size, md5('7|' || coalesce(doc_id::VARCHAR, '')), doc_id) - 1 AS rank FROM d),
c AS (SELECT r.doc_id, r.size, t.source_size, t.target, r.rank, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate, ('0x' || substr(md5('7|' || coalesce(r.source, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS start FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (size * least(3, floor((rank + 1) * rate + start) - floor(rank * rate + start)))::BIGINT AS taken FROM c"""


@query("op7_mixing", MIX_SQL)
def op7_mixing(spark, sf_dir):
    out = mixing.mix(_table(spark, sf_dir, "documents"), Scratch(spark))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


URL_SQL = r"""WITH p AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
CASE WHEN url LIKE '%://%' THEN regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM pages),
r AS (SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) t(h, q, v))
SELECT page_id, host, path, (SELECT max_by(h || q, length(h || q)) FROM r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q)) AS rule,
coalesce((SELECT max_by(v, length(h || q)) FROM r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q)), 'allow') AS verdict FROM p"""


@query("op8_url_filter", URL_SQL)
def op8_url_filter(spark, sf_dir):
    rules = url_filter.rule_table(spark, url_filter.RULES)
    return url_filter.judge(_table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


@query("op3_simhash")
def op3_simhash(spark, sf_dir):
    out = simhash.near_duplicates(_table(spark, sf_dir, "documents"), Scratch(spark))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op9_quality")
def op9_quality(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.classify(docs, _table(spark, sf_dir, "labels").select("doc_id", "quality")).select("doc_id", "held_out", "score", "predicted")


WARC_SQL = """WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS sha FROM pages),
b AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i: lpad(bin(strpos('0123456789abcdef', substr(sha, i, 1)) - 1), 4, '0')), '') AS bits, min(page_id) OVER (PARTITION BY sha) AS head FROM p)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * substr(bits, i * 5 + 1, 1)::INT + 8 * substr(bits, i * 5 + 2, 1)::INT + 4 * substr(bits, i * 5 + 3, 1)::INT + 2 * substr(bits, i * 5 + 4, 1)::INT + substr(bits, i * 5 + 5, 1)::INT, 1)), '') AS payload_digest,
CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> head THEN head END AS refers_to FROM b"""


@query("op1_warc", WARC_SQL)
def op1_warc(spark, sf_dir):
    index, folder = warc.archive(_table(spark, sf_dir, "pages"), Scratch(spark))
    return warc.read(index, folder, "long").drop("payload")


@query("op4_pieces")
def op4_pieces(spark, sf_dir):
    return pieces.encode(_table(spark, sf_dir, "documents"))


EMBEDDING_SQL = """WITH RECURSIVE g AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
e AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.9),
reach(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a),
c AS (SELECT a, min(b) AS least FROM reach GROUP BY a), n AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(vec_id, coalesce(c.least, vec_id)) AS component_id, vec_id <= coalesce(c.least, vec_id) AS kept FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id"""


@query("op2_embeddings", EMBEDDING_SQL)
def op2_embeddings(spark, sf_dir):
    return embeddings.near_vectors(_table(spark, sf_dir, "embeddings"), Scratch(spark))


@query("op6_media")
def op6_media(spark, sf_dir):
    return media.media_features(_table(spark, sf_dir, "documents"), Scratch(spark))


@query("op10_substrings")
def op10_substrings(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return substrings.deduplicate(docs, Scratch(spark)).select("doc_id", "n_words", "n_removed", "kept_sha256")
