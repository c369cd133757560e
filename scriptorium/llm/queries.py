"""The queries of this package: one for each operator, over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, exact_dedup, packing, pii, secret_scan, sentence_pieces, simhash, topk_search, toxicity, url_filter, warc


#: Only the query's: real runs pass a key that is kept elsewhere.
SURROGATE_SECRET = "test tables"


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = common.table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return toxicity.scored(docs, labels).select("doc_id", "held_out", "score", "predicted")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    spans = secret_scan.scanned(docs).select("doc_id", "secret_spans")
    count = lambda kind: F.size(F.filter("secret_spans", lambda s: s["kind"] == secret_scan.KINDS.index(kind))).cast("long")
    base = F.filter("secret_spans", lambda s: s["kind"] != secret_scan.KINDS.index("markov"))
    return spans.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(secret_scan.spans_text(base), 256).alias("base_sha256"),
        secret_scan.spans_text(F.col("secret_spans")).alias("spans"),
    )


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.near_duplicates(docs).select("doc_id", "fingerprint", "component_id")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymised(docs, pii.key_of(SURROGATE_SECRET))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    return packing.packed(packing.pieces(docs)).select(*names)


def op6_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentence_pieces.encoded(docs, with_ids=True)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url", "html")
    root = common.scratch_path(spark, "warc")
    manifest = warc.write(pages, root)
    if manifest.isEmpty():
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    return warc.read(spark, root, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk_search.search(vectors, F.col("vec_id") % 50 == 0)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judged(pages).select("page_id", "host", "path", "rule", "verdict")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup.exact_duplicates(docs).drop("uid")


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
), w AS (
  SELECT doc_id, norm,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(text) DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM d
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
FROM w
"""

OP7_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h
  FROM pages
), d AS (
  SELECT page_id, payload_bytes, html, list_transform(range(8), lambda i: CAST('0x' || h[i * 5 + 1 : i * 5 + 5] AS INTEGER)) AS n,
         max(page_id) OVER (PARTITION BY html) AS last
  FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((n[i // 4 + 1] >> (15 - 5 * (i % 4))) & 31 AS INTEGER) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to
FROM d
"""

OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND q.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""

_SIGNS = "".join("\\" + c for c in url_filter.PUNCTUATION).replace("'", "''")


def _mixed(n: str, total: str, kinds: str, lower: str) -> str:
    return f"CASE WHEN coalesce({total}, 0) > 0 THEN (coalesce({n}, 0) + {kinds} * ({lower})) / ({total} + {kinds}) ELSE {lower} END"


def _level(k: int) -> str:
    key = "substr(ctx, 3 - %d, %d)" % (k, k) if k else "''"
    return f"""c{k} AS (SELECT {key} AS c, ch, CAST(sum(a) AS DOUBLE) AS a, CAST(sum(r) AS DOUBLE) AS r FROM m GROUP BY 1, 2),
t{k} AS (SELECT c, sum(a) AS ta, sum(r) AS tr, count(*) FILTER (a > 0) AS ka, count(*) FILTER (r > 0) AS kr FROM c{k} GROUP BY c)"""


def _estimate(side: str) -> str:
    out = f"1.0 / {url_filter.SYMBOLS}"
    for k in range(url_filter.ORDER + 1):
        out = _mixed(f"c{k}.{side}", f"t{k}.t{side}", f"t{k}.k{side}", out)
    return out


OP9_SQL = f"""
WITH u AS (
  SELECT page_id, url, translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
), h AS (
  SELECT page_id, path, regexp_extract(low, '(?s)^.*?://([^/?#]*)', 1) AS host,
         regexp_replace(regexp_replace(low, '[0-9]', '0', 'g'), '[^a-z0{_SIGNS}]', ' ', 'g') AS symbols FROM u
), p AS (
  SELECT *, CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
                 WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
                 WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
                 WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM h
), l AS (
  SELECT symbols, rule IN ('example.net/en/', 'org/fr/') AS accepted, count(*) AS n FROM p WHERE rule IS NOT NULL GROUP BY 1, 2
), m AS (
  SELECT substr('^^' || symbols, i, 2) AS ctx, substr(symbols, i, 1) AS ch,
         sum(CASE WHEN accepted THEN n ELSE 0 END) AS a, sum(CASE WHEN accepted THEN 0 ELSE n END) AS r
  FROM (SELECT *, unnest(range(1, length(symbols) + 1)) AS i FROM l) GROUP BY 1, 2
), {_level(0)}, {_level(1)}, {_level(2)},
x AS (
  SELECT symbols, substr('^^' || symbols, i, 2) AS ctx, substr(symbols, i, 1) AS ch
  FROM (SELECT symbols, unnest(range(1, length(symbols) + 1)) AS i FROM (SELECT DISTINCT symbols FROM p))
), e AS (
  SELECT symbols, avg(ln(({_estimate("a")}) / ({_estimate("r")}))) AS score FROM x
  LEFT JOIN c0 ON c0.ch = x.ch LEFT JOIN t0 ON true
  LEFT JOIN c1 ON c1.c = substr(ctx, 2, 1) AND c1.ch = x.ch LEFT JOIN t1 ON t1.c = substr(ctx, 2, 1)
  LEFT JOIN c2 ON c2.c = ctx AND c2.ch = x.ch LEFT JOIN t2 ON t2.c = ctx GROUP BY symbols
), s AS (
  SELECT accepted, sum(n * score) / sum(n) AS mean, sqrt(greatest(sum(n * score * score) / sum(n) - (sum(n * score) / sum(n)) ** 2, 0)) + 1e-9 AS dev
  FROM l JOIN e USING (symbols) GROUP BY accepted
), t AS (SELECT (y.mean * z.dev + z.mean * y.dev) / (y.dev + z.dev) AS least FROM s y, s z WHERE y.accepted AND NOT z.accepted)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN coalesce(score, 0) >= (SELECT least FROM t) THEN 'allow' ELSE 'block' END AS verdict FROM p LEFT JOIN e USING (symbols)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_secret_scan": op2_secret_scan,
    "op3_simhash": op3_simhash,
    "op4_pii": op4_pii,
    "op5_packing": op5_packing,
    "op6_sentence_pieces": op6_sentence_pieces,
    "op7_warc": op7_warc,
    "op8_topk_search": op8_topk_search,
    "op9_url_filter": op9_url_filter,
    "op10_exact_dedup": op10_exact_dedup,
}
ORACLES: dict[str, str] = {"op7_warc": OP7_SQL, "op8_topk_search": OP8_SQL, "op9_url_filter": OP9_SQL, "op10_exact_dedup": OP10_SQL}
