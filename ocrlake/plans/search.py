"""Registered queries of text functions, full-text, vector and hybrid search."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ocrlake.functions import text as tx
from ocrlake.functions import vectors as vx
from ocrlake.operators import catalog as cat
from ocrlake.operators import fts, hybrid
from ocrlake.operators import invindex as inv
from ocrlake.plans.common import INDEX_SQL, ITEMS_SQL, MODEL_VERSION, WS, VECTORS_SQL, bm25_sql, items, norm_sql, tokens_sql, vectors, wstrim_sql
from ocrlake.session import ensure_checkpoint_dir
from ocrlake.sources.tables import table

QUERY, FOLDER = "error report", 7
PHRASE_QUERY = "10.4 the"
PAGE_QUERY = "The menu"
HYBRID_QUERY = "Storage report"


INDEX_COLUMNS = ("folder_id", "filename", "path", "modified_at_fs", "ocr_status", "ocr_text")
_WRITTEN: dict[tuple[str, str], inv.StoredIndex] = {}


def _items(spark: SparkSession, base: str) -> DataFrame:
    return items(spark, base, *INDEX_COLUMNS)


def _index(spark: SparkSession, base: str) -> inv.StoredIndex:
    """The stored index of the items, written once per session into the shared folder and read by all searches."""
    key = spark.sparkContext.applicationId, base
    if key not in _WRITTEN:
        _WRITTEN[key] = inv.write_index(_items(spark, base), f"{ensure_checkpoint_dir(spark)}/index-{uuid.uuid4().hex}")
    return _WRITTEN[key]


def normalize_text(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "documents").filter("text is not null").select("doc_id", tx.normalize_search_text(F.col("text")).alias("norm"))


def normalize_ocr(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "documents").filter("text is not null").select("doc_id", tx.normalize_ocr_text(F.col("text")).alias("norm"))


def technical_tokens(spark: SparkSession, base: str) -> DataFrame:
    words = table(spark, base, "search_requests").select(F.explode(F.split(F.col("query_text"), " ")).alias("token")).filter("token <> ''").distinct()
    return words.select("token", tx.is_technical_token(F.col("token")).alias("technical"))


def exact_signals(spark: SparkSession, base: str) -> DataFrame:
    return items(spark, base, "filename", "ocr_text").select("id", tx.exact_signal(HYBRID_QUERY, F.col("filename"), F.col("ocr_text")).alias("exact"))


def semantic_document(spark: SparkSession, base: str) -> DataFrame:
    return items(spark, base, "filename", "ocr_text").select("id", tx.passage_input(tx.semantic_document(F.col("filename"), F.col("ocr_text"))).alias("input"))


def index_build(spark: SparkSession, base: str) -> DataFrame:
    return fts.build_index(_items(spark, base)).select("id", "body", "n_tokens", F.array_join("fn_tokens", " ").alias("fn_tokens"), F.array_join("body_tokens", " ").alias("body_tokens"))


def index_health(spark: SparkSession, base: str) -> DataFrame:
    return inv.index_health(items(spark, base, "ocr_status", "ocr_text"), _index(spark, base))


def index_store(spark: SparkSession, base: str) -> DataFrame:
    """The stored index: its statistics, and the places of its most frequent tokens."""
    index = _index(spark, base)
    n_docs, n_tokens = index.stats()
    top = index.postings().groupBy("token").agg(F.count("*").alias("places")).orderBy(F.desc("places"), "token").limit(50)
    return top.withColumns({"n_docs": F.lit(n_docs).cast("long"), "n_tokens": F.lit(n_tokens).cast("long")})


def index_refresh(spark: SparkSession, base: str) -> DataFrame:
    """Matches after a refresh: every seventh item has another text, every eleventh is gone; and after merging segments."""
    rows = _items(spark, base)
    first = inv.write_index(rows, f"{ensure_checkpoint_dir(spark)}/index-{uuid.uuid4().hex}")
    changed = rows.filter("id % 7 = 0").withColumn("ocr_text", F.lit("refreshed error text"))
    after = inv.refresh(first, changed, rows.filter("id % 11 = 0 and id % 7 <> 0").select("id"))
    found = lambda index: inv.keyword_matches(index, "refreshed").select("id", F.round("bm25", 6).alias("bm25"))
    return found(after).withColumn("merged", F.lit(False)).union(found(inv.merge(after)).withColumn("merged", F.lit(True)))


def fts_bm25(spark: SparkSession, base: str) -> DataFrame:
    return inv.keyword_matches(_index(spark, base), QUERY).select("id", F.round("bm25", 6).alias("bm25"))


def fts_phrase(spark: SparkSession, base: str) -> DataFrame:
    return inv.keyword_matches(_index(spark, base), PHRASE_QUERY).select("id", F.round("bm25", 6).alias("bm25"))


def fts_folder_page(spark: SparkSession, base: str) -> DataFrame:
    page = fts.search_page(_index(spark, base), _items(spark, base), PAGE_QUERY, folder_id=FOLDER, limit=20, offset=5)
    return page.items.select("id", F.round("score", 6).alias("score"), "match_type", F.lit(page.total).cast("long").alias("total"), F.lit(page.has_more).alias("has_more"))


def fts_filename(spark: SparkSession, base: str) -> DataFrame:
    return inv.keyword_matches(_index(spark, base), "scan_18").select("id", F.round("bm25", 6).alias("bm25"))


def fts_snippets(spark: SparkSession, base: str) -> DataFrame:
    return fts.search_page(_index(spark, base), _items(spark, base), QUERY, limit=100).items.select("id", "snippet")


def result_page(spark: SparkSession, base: str) -> DataFrame:
    """A page as it is shown, with hash and size of the images."""
    rows = items(spark, base, *INDEX_COLUMNS, "content_hash", "width", "height")
    page = fts.search_page(_index(spark, base), rows, QUERY, limit=30).items.drop("snippet")
    return cat.hydrated(page, rows).withColumn("score", F.round("score", 6))


def item_details(spark: SparkSession, base: str) -> DataFrame:
    """The detail of every item, its text by digest."""
    rows = items(spark, base).select(*cat.DETAIL_COLUMNS)
    return rows.withColumns({"ocr_text": F.sha2("ocr_text", 256), "indexed_at": F.unix_micros("indexed_at")})


def preview_search(spark: SparkSession, base: str) -> DataFrame:
    return fts.preview_search(items(spark, base, "filename", "ocr_text"), "  The Key ").select("id", "filename")


def recent_items(spark: SparkSession, base: str) -> DataFrame:
    rows = items(spark, base, "folder_id", "filename", "path", "modified_at_fs", "ocr_status")
    return fts.search_page(_index(spark, base), rows, "  ", limit=50, offset=10).items.select("id", "filename", "modified_at_fs", "score")


def search_batch(spark: SparkSession, base: str) -> DataFrame:
    """All matches of every hundredth request against all items."""
    wanted = table(spark, base, "search_requests").filter(F.col("request_id") % 100 == 0)
    return inv.batch_matches(_index(spark, base), wanted).select("request_id", "id", F.round("bm25", 6).alias("bm25"))


def vector_similarity(spark: SparkSession, base: str) -> DataFrame:
    """The hundred nearest of all vectors, at any positive similarity, for every hundredth one."""
    v = table(spark, base, "embeddings")
    asked = v.filter(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), "embedding")  # the stated query set
    return hybrid.vector_topk_many(v, asked, least=1e-9, id_col="vec_id").select("query_id", "id", F.round("similarity", 6).alias("similarity"))


def vector_codec(spark: SparkSession, base: str) -> DataFrame:
    """Vectors through the byte codec and back, with their self-similarity."""
    back = vx.decode_vector(vx.encode_vector(F.col("embedding")))
    return table(spark, base, "embeddings").select("vec_id", F.size(back).cast("long").alias("dims"), F.round(vx.cosine(F.col("embedding"), back), 6).alias("similarity"))


def mock_embeddings(spark: SparkSession, base: str) -> DataFrame:
    doc = tx.semantic_document(F.col("filename"), F.col("ocr_text"))
    dims = items(spark, base, "filename", "ocr_text").select("id", F.posexplode(vx.mock_embedding(tx.passage_input(doc))).alias("dim", "value"))
    # in twelfths of the item's least value, as single precision leaves no decimals to compare
    dims = dims.filter("value <> 0")
    least = dims.groupBy("id").agg(F.min("value").alias("least"))
    return dims.join(least, "id").select("id", F.col("dim").cast("long").alias("dim"), F.round(F.col("value") / F.col("least") * 12).cast("long").alias("twelfths"))


def hybrid_search(spark: SparkSession, base: str) -> DataFrame:
    rows = _items(spark, base)
    v = vectors(spark, base).filter(F.col("model_version") == MODEL_VERSION).select(F.col("screenshot_id").alias("id"), "embedding")
    query = list(v.filter("id = 100").first()["embedding"])
    found = hybrid.hybrid_candidates(_index(spark, base), rows, v, HYBRID_QUERY, query)
    return found.select("id", "match_type", *(F.round(c, 6).alias(c) for c in ("exact", "in_name", "fts", "sem", "score")))


def hybrid_folder(spark: SparkSession, base: str) -> DataFrame:
    """The hybrid search of one folder: keyword candidates are of the folder before their cut, vector candidates after it."""
    rows = _items(spark, base)
    v = vectors(spark, base).filter(F.col("model_version") == MODEL_VERSION).select(F.col("screenshot_id").alias("id"), "embedding")
    query = list(v.filter("id = 100").first()["embedding"])
    page = hybrid.hybrid_page(_index(spark, base), rows, v, HYBRID_QUERY, query, folder_id=FOLDER, limit=100)
    return page.items.select("id", "match_type", F.round("score", 6).alias("score"), F.lit(page.total).cast("long").alias("total"))


def semantic_snippets(spark: SparkSession, base: str) -> DataFrame:
    return items(spark, base, "ocr_text").select("id", tx.semantic_snippet("an report storage", F.col("ocr_text")).alias("snippet"))


QUERIES = {f.__name__: f for f in (normalize_text, normalize_ocr, technical_tokens, exact_signals, semantic_document, index_build, index_store, index_health, index_refresh, fts_bm25, fts_phrase, fts_folder_page, fts_filename, fts_snippets, result_page, item_details, preview_search, recent_items, search_batch, vector_similarity, vector_codec, mock_embeddings, hybrid_search, hybrid_folder, semantic_snippets)}

_NORM_OCR = f"regexp_replace(regexp_replace(regexp_replace(nfc_normalize(text), '\\r\\n?', chr(10), 'g'), '[\\x00-\\x08\\x0b-\\x1f\\x7f-\\x9f]', '', 'g'), '[\\x09\\x0b-\\x0d\\x20\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+(\\n|$)', '\\1', 'g')"
_HYBRID_WORDS = [[w] for w in ("storage", "report")]

SQL = {
    "normalize_text": f"SELECT doc_id, {norm_sql('text')} AS norm FROM documents WHERE text IS NOT NULL",
    "normalize_ocr": f"SELECT doc_id, {wstrim_sql(f'''regexp_replace({_NORM_OCR}, '\\n{{3,}}', chr(10) || chr(10), 'g')''')} AS norm FROM documents WHERE text IS NOT NULL",
    "technical_tokens": r"""
SELECT token, strlen(token) >= 2 AND (regexp_matches(token, '^[A-Z]+$') OR (regexp_matches(token, '\p{Lu}') AND regexp_matches(token, '\p{N}'))
  OR (contains(token, '_') AND regexp_matches(token, '[A-Za-z0-9]')) OR regexp_matches(token, '[.:/\\]') OR regexp_matches(token, '^[0-9]{3,4}$')) AS technical
FROM (SELECT DISTINCT unnest(string_split(query_text, ' ')) AS token FROM search_requests) WHERE token <> ''""",
    "exact_signals": f"""WITH {ITEMS_SQL}
SELECT id, CASE WHEN contains(h, 'storage report') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS exact
FROM (SELECT id, lower(coalesce(filename, '')) || chr(0) || lower(coalesce(ocr_text, '')) AS h FROM items)""",
    "semantic_document": f"""WITH {ITEMS_SQL}
SELECT id, 'passage: ' || {wstrim_sql("CASE WHEN t = '' THEN 'Filename: ' || " + wstrim_sql("filename") + " ELSE 'Filename: ' || " + wstrim_sql("filename") + " || chr(10) || 'Content:' || chr(10) || left(t, 2000) END")} AS input
FROM (SELECT id, filename, {wstrim_sql("coalesce(ocr_text, '')")} AS t FROM items)""",
    "index_build": f"WITH {INDEX_SQL} SELECT id, body, n_tokens, array_to_string(fn, ' ') AS fn_tokens, array_to_string(bt, ' ') AS body_tokens FROM idx",
    "index_health": f"""WITH {INDEX_SQL} SELECT (SELECT count(*) FROM items WHERE ocr_status = 'SUCCEEDED' AND ocr_text IS NOT NULL) AS expected,
  (SELECT count(*) FROM idx) AS indexed, (SELECT count(*) FROM items WHERE ocr_status = 'SUCCEEDED' AND ocr_text IS NOT NULL) = (SELECT count(*) FROM idx) AS healthy""",
    "index_store": f"""WITH {INDEX_SQL}, t AS (SELECT unnest(list_concat(fn, bt)) AS token FROM idx)
SELECT token, count(*) AS places, (SELECT count(*) FROM idx) AS n_docs, (SELECT sum(n_tokens)::BIGINT FROM idx) AS n_tokens FROM t GROUP BY token ORDER BY places DESC, token LIMIT 50""",
    "index_refresh": f"""WITH {INDEX_SQL}, now AS (SELECT id, n_tokens, false AS hit FROM idx WHERE id % 7 <> 0 AND id % 11 <> 0
  UNION ALL SELECT id, len({tokens_sql("filename")}) + 3, true FROM items WHERE id % 7 = 0 AND ocr_status = 'SUCCEEDED'),
s AS (SELECT count(*) AS n, sum(n_tokens) / count(*)::DOUBLE AS avgdl, count(*) FILTER (WHERE hit) AS c FROM now)
SELECT id, round(-(CASE WHEN ln((n - c + 0.5) / (c + 0.5)) > 0 THEN ln((n - c + 0.5) / (c + 0.5)) ELSE 1e-6 END) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * n_tokens / avgdl)), 6) AS bm25, unnest([false, true]) AS merged FROM now, s WHERE hit""",
    "fts_bm25": f"WITH {bm25_sql([['error'], ['report']])} SELECT id, round(bm25, 6) AS bm25 FROM ranked",
    "fts_phrase": f"WITH {bm25_sql([['10', '4'], ['the']])} SELECT id, round(bm25, 6) AS bm25 FROM ranked",
    "fts_filename": f"WITH {bm25_sql([['scan'], ['18']])} SELECT id, round(bm25, 6) AS bm25 FROM ranked",
    "fts_folder_page": f"""WITH {bm25_sql([['the'], ['menu']], "folder_id = 7")},
page AS (SELECT * FROM ranked ORDER BY bm25, modified_at_fs DESC, id DESC LIMIT 20 OFFSET 5), c AS (SELECT count(*) AS total FROM ranked)
SELECT id, round(-bm25, 6) AS score, 'keyword' AS match_type, total, 5 + least(20, greatest(total - 5, 0)) < total AS has_more FROM page, c""",
    "result_page": f"""WITH {bm25_sql([["error"], ["report"]])}, page AS (SELECT * FROM ranked ORDER BY bm25, modified_at_fs DESC, id DESC LIMIT 30)
SELECT p.id, p.folder_id, p.filename, p.path, p.modified_at_fs, round(-bm25, 6) AS score, 'keyword' AS match_type, content_hash, width, height FROM page p""",
    "item_details": f"""WITH {ITEMS_SQL} SELECT id, folder_id, path, filename, extension, file_size, modified_at_fs, content_hash, width, height, sha256(ocr_text) AS ocr_text, ocr_status,
  ocr_engine, ocr_engine_version, ocr_language, ocr_pipeline_version, epoch_us(indexed_at) AS indexed_at FROM items""",
    "preview_search": f"WITH {ITEMS_SQL} SELECT id, filename FROM items WHERE contains(lower(filename), 'the key') OR coalesce(contains(lower(ocr_text), 'the key'), false)",
    # each word adds to the dimension of its hash, and to fifteen dimensions for each group of words that it holds one of
    "mock_embeddings": f"""WITH {ITEMS_SQL}, doc AS (SELECT id, 'passage: ' || {wstrim_sql("CASE WHEN t = '' THEN 'Filename: ' || " + wstrim_sql("filename") + " ELSE 'Filename: ' || " + wstrim_sql("filename") + " || chr(10) || 'Content:' || chr(10) || left(t, 2000) END")} AS input
  FROM (SELECT id, filename, {wstrim_sql("coalesce(ocr_text, '')")} AS t FROM items)),
word AS (SELECT id, regexp_replace(unnest(regexp_split_to_array(lower(input), '{WS}+')), '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '', 'g') AS w FROM doc),
n AS (SELECT id, w, count(*) AS k FROM word WHERE w <> '' GROUP BY 1, 2), d AS (SELECT DISTINCT w, hex(encode(w)) AS x FROM n),
h AS (SELECT w, list_reduce(list_prepend(5381::HUGEINT, list_transform(range(1, length(x) // 2 + 1), lambda i: ((instr('0123456789ABCDEF', x[2 * i - 1]) - 1) * 16 + instr('0123456789ABCDEF', x[2 * i]) - 1)::HUGEINT)),
  lambda a, b: (a * 33 + b) % 18446744073709551616::HUGEINT) % 384 AS dim FROM d),
g AS (SELECT w, unnest(range(first, first + 15)) AS dim FROM (SELECT w, unnest(list_filter([{", ".join(f"CASE WHEN len(list_filter({list(words)!r}, lambda y: contains(w, y))) > 0 THEN {first} END" for first, words in vx.CONCEPTS)}], lambda z: z IS NOT NULL)) AS first FROM d)),
v AS (SELECT id, dim::BIGINT AS dim, sum(k * a) AS value FROM (SELECT w, dim, 0.5 AS a FROM h UNION ALL SELECT w, dim, 2.0 FROM g) JOIN n USING (w) GROUP BY 1, 2)
SELECT id, dim, round(value::DOUBLE / min(value::DOUBLE) OVER (PARTITION BY id) * 12)::BIGINT AS twelfths FROM v""",
    "recent_items": f"""WITH {ITEMS_SQL} SELECT id, filename, modified_at_fs, 0.0::DOUBLE AS score FROM items WHERE ocr_status = 'SUCCEEDED'
ORDER BY modified_at_fs DESC, id DESC LIMIT 50 OFFSET 10""",
    "search_batch": f"""WITH {INDEX_SQL},
asked AS (SELECT DISTINCT request_id, query_text FROM search_requests WHERE request_id % 100 = 0 AND query_text IS NOT NULL),
words AS (SELECT DISTINCT request_id, unnest(string_split({norm_sql("query_text")}, ' ')) AS word FROM asked),
phrases AS (SELECT DISTINCT request_id, {tokens_sql("word")} AS p FROM words WHERE len({tokens_sql("word")}) > 0),
distinct_p AS (SELECT DISTINCT p FROM phrases),
hit AS (SELECT p, id, n_tokens,
    len(list_filter(range(1, len(fn) - len(p) + 2), lambda i: fn[i:i + len(p) - 2] = p[:len(p) - 1] AND starts_with(fn[i + len(p) - 1], p[len(p)]))) AS f,
    len(list_filter(range(1, len(bt) - len(p) + 2), lambda i: bt[i:i + len(p) - 2] = p[:len(p) - 1] AND starts_with(bt[i + len(p) - 1], p[len(p)]))) AS b
  FROM idx, distinct_p),
found AS (SELECT * FROM hit WHERE f + b > 0),
counts AS (SELECT p, count(*) AS c FROM found GROUP BY p),
whole AS (SELECT count(*) AS n, sum(n_tokens) / count(*)::DOUBLE AS avgdl FROM idx),
need AS (SELECT request_id, count(*) AS needed FROM phrases GROUP BY request_id),
scored AS (SELECT request_id, id, count(*) AS got,
    sum((CASE WHEN ln((n - c + 0.5) / (c + 0.5)) > 0 THEN ln((n - c + 0.5) / (c + 0.5)) ELSE 1e-6 END) * (5.0 * f + b) * 2.2 / ((5.0 * f + b) + 1.2 * (0.25 + 0.75 * n_tokens / avgdl))) AS s
  FROM found JOIN counts USING (p) JOIN phrases USING (p), whole GROUP BY request_id, id)
SELECT request_id, id, round(-s, 6) AS bm25 FROM scored JOIN need USING (request_id) WHERE got = needed""",
    "vector_similarity": """
WITH pairs AS (SELECT q.vec_id AS query_id, v.vec_id AS id, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS s
  FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rn FROM pairs WHERE s >= 1e-9)
SELECT query_id, id, round(s, 6) AS similarity FROM ranked WHERE rn <= 100""",
    "vector_codec": "SELECT vec_id, len(embedding) AS dims, 1.0::DOUBLE AS similarity FROM embeddings",
    "hybrid_search": f"""WITH {bm25_sql(_HYBRID_WORDS)}, {VECTORS_SQL},
kw AS (SELECT id, -bm25 / (1 - bm25) AS fts FROM ranked ORDER BY bm25, modified_at_fs DESC, id DESC LIMIT 100),
sims AS (SELECT v.screenshot_id AS id, list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS s
  FROM vecs v, vecs q WHERE v.model_version = '{MODEL_VERSION}' AND q.screenshot_id = 100),
sem AS (SELECT id, greatest(least(s, 1.0), 0.0) AS sem FROM sims WHERE s >= 0.5 ORDER BY s DESC, id LIMIT 100),
both_sides AS (SELECT coalesce(kw.id, sem.id) AS id, coalesce(fts, 0.0) AS fts, coalesce(sem, 0.0) AS sem FROM kw FULL JOIN sem ON kw.id = sem.id),
sig AS (SELECT i.id, fts, sem, CASE WHEN contains(lower(filename), 'storage report') OR contains(lower(coalesce(ocr_text, '')), 'storage report') THEN 1.0 ELSE 0.0 END AS exact,
  CASE WHEN contains(lower(filename), 'storage report') THEN 1.0 ELSE 0.0 END AS in_name FROM items i JOIN both_sides b ON i.id = b.id)
SELECT id, CASE WHEN exact > 0 THEN 'exact' WHEN fts > 0 AND sem > 0.65 THEN 'hybrid' WHEN fts > 0 THEN 'keyword' ELSE 'semantic' END AS match_type,
  round(exact::DOUBLE, 6) AS exact, round(in_name::DOUBLE, 6) AS in_name, round(fts::DOUBLE, 6) AS fts, round(sem::DOUBLE, 6) AS sem,
  round((4.0 * exact + 2.0 * in_name + 1.5 * fts + 1.2 * sem)::DOUBLE, 6) AS score FROM sig""",
    "hybrid_folder": f"""WITH {bm25_sql(_HYBRID_WORDS, "folder_id = 7")}, {VECTORS_SQL},
kw AS (SELECT id, -bm25 / (1 - bm25) AS fts FROM ranked ORDER BY bm25, modified_at_fs DESC, id DESC LIMIT 100),
sims AS (SELECT v.screenshot_id AS id, list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS s
  FROM vecs v, vecs q WHERE v.model_version = '{MODEL_VERSION}' AND q.screenshot_id = 100),
sem AS (SELECT id, greatest(least(s, 1.0), 0.0) AS sem FROM sims WHERE s >= 0.5 ORDER BY s DESC, id LIMIT 100),
both_sides AS (SELECT coalesce(kw.id, sem.id) AS id, coalesce(fts, 0.0) AS fts, coalesce(sem, 0.0) AS sem FROM kw FULL JOIN sem ON kw.id = sem.id),
sig AS (SELECT i.id, fts, sem, CASE WHEN contains(lower(filename), 'storage report') OR contains(lower(coalesce(ocr_text, '')), 'storage report') THEN 1.0 ELSE 0.0 END AS exact,
  CASE WHEN contains(lower(filename), 'storage report') THEN 1.0 ELSE 0.0 END AS in_name FROM items i JOIN both_sides b ON i.id = b.id WHERE folder_id = 7)
SELECT id, CASE WHEN exact > 0 THEN 'exact' WHEN fts > 0 AND sem > 0.65 THEN 'hybrid' WHEN fts > 0 THEN 'keyword' ELSE 'semantic' END AS match_type,
  round((4.0 * exact + 2.0 * in_name + 1.5 * fts + 1.2 * sem)::DOUBLE, 6) AS score, count(*) OVER () AS total FROM sig""",
    "semantic_snippets": f"""WITH {ITEMS_SQL}, t AS (SELECT id, coalesce(ocr_text, '') AS t, instr(lower(coalesce(ocr_text, '')), 'report') AS a, instr(lower(coalesce(ocr_text, '')), 'storage') AS b FROM items)
SELECT id, CASE WHEN t = '' THEN NULL WHEN a > 0 THEN '...' || {wstrim_sql("substr(t, greatest(a - 40, 1), a + 66 - greatest(a - 40, 1))")} || '...' WHEN b > 0 THEN '...' || {wstrim_sql("substr(t, greatest(b - 40, 1), b + 67 - greatest(b - 40, 1))")} || '...'
  WHEN length(t) > 120 THEN {wstrim_sql("left(t, 120)")} || '...' ELSE {wstrim_sql("t")} END AS snippet FROM t""",
}
