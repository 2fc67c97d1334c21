"""Registered queries of the catalog, reconciliation and job queue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ocrlake.functions import paths as pt
from ocrlake.functions import text as tx
from ocrlake.operators import catalog as cat
from ocrlake.operators import jobs as jb
from ocrlake.operators import reconcile as rc
from ocrlake.plans.common import ITEMS_SQL, JOBS_SQL, MODEL, MODEL_VERSION, NOW, NOW_SQL, TARGET, VECTORS_SQL, items, jobs, vectors
from ocrlake.sources.tables import table


def normalize_path(spark: SparkSession, base: str) -> DataFrame:
    raw = table(spark, base, "index_jobs").select("path").filter("path is not null").distinct()
    p = F.col("path")
    return raw.select("path", pt.normalize_path(p).alias("plain"), pt.file_name(p).alias("name"), pt.extension(p).alias("ext"), pt.is_temporary(p).alias("temporary"), pt.is_supported_image(p).alias("supported"), pt.media_type(pt.extension(p)).alias("media_type"))


def data_url(spark: SparkSession, base: str) -> DataFrame:
    """The bytes of every text as a data address."""
    return items(spark, base, "extension", "ocr_text").select("id", pt.data_url(F.col("extension"), F.encode("ocr_text", "utf-8")).alias("data_url"), pt.item_id_of_uri(F.concat(F.lit("image://localhost/screenshot/"), F.col("id").cast("string"), F.lit(".png"))).alias("uri_id"))


def job_keys(spark: SparkSession, base: str) -> DataFrame:
    i, f, p, h = (F.col(c) for c in ("id", "folder_id", "path", "content_hash"))
    return items(spark, base, "folder_id", "path", "content_hash").select("id", tx.upsert_key(f, p, h).alias("upsert_key"), tx.delete_key(f, p).alias("delete_key"), tx.embed_key(i, h, MODEL_VERSION).alias("embed_key"), tx.re_ocr_key(i, h, F.lit(TARGET)).alias("re_ocr_key"))


def re_ocr_targets(spark: SparkSession, base: str) -> DataFrame:
    rows = jobs(spark, base, "dedupe_key").withColumn("target", tx.re_ocr_target_pipeline(F.col("dedupe_key")))
    return rows.groupBy("target").agg(F.count("*").alias("n"))


# ------------------------------------------------------------------------------------------------- catalog


def ocr_stats(spark: SparkSession, base: str) -> DataFrame:
    return cat.status_counts(items(spark, base, "ocr_status"))


def folder_stats(spark: SparkSession, base: str) -> DataFrame:
    return cat.folder_counts(table(spark, base, "folders"), items(spark, base, "folder_id", "ocr_status")).select("id", "path", "item_count", "indexed_count")


def folder_lookup(spark: SparkSession, base: str) -> DataFrame:
    path = table(spark, base, "folders").filter("id = 3").first()["path"]
    return cat.folder_by_path(table(spark, base, "folders"), path.upper()).select("id", "path")


def item_lookup(spark: SparkSession, base: str) -> DataFrame:
    rows = items(spark, base, "folder_id", "filename", "path")
    path = rows.filter("id = 42").first()["path"]
    return cat.item_by_path(rows, path).select("id", "folder_id", "filename").union(cat.item_by_id(cat.items_of_folder(rows, 7), 77).select("id", "folder_id", "filename"))


def job_stats(spark: SparkSession, base: str) -> DataFrame:
    return cat.job_counts(jobs(spark, base, "status"))


def embedding_stats(spark: SparkSession, base: str) -> DataFrame:
    return cat.embedding_coverage(items(spark, base, "ocr_status"), vectors(spark, base), MODEL, MODEL_VERSION)


def engine_stats(spark: SparkSession, base: str) -> DataFrame:
    return cat.engine_diagnostics(items(spark, base, "ocr_status", "ocr_engine", "ocr_pipeline_version"), TARGET)


def service_status(spark: SparkSession, base: str) -> DataFrame:
    return cat.service_status(items(spark, base, "ocr_status"), jobs(spark, base, "status"), vectors(spark, base), MODEL, MODEL_VERSION, 3)


def eligible_items(spark: SparkSession, base: str) -> DataFrame:
    return cat.re_process_eligible(items(spark, base, "ocr_status", "ocr_pipeline_version"), TARGET).select("id", "ocr_pipeline_version")


def _digests(spark: SparkSession, base: str) -> DataFrame:
    """Digests of texts before items are made single, so that no text is shuffled."""
    return cat.distinct_items(cat.text_digests(table(spark, base, "screenshots")))


def duplicate_texts(spark: SparkSession, base: str) -> DataFrame:
    return cat.duplicate_texts(_digests(spark, base))


def duplicate_members(spark: SparkSession, base: str) -> DataFrame:
    return cat.duplicate_members(_digests(spark, base))


def newest_by_hash(spark: SparkSession, base: str) -> DataFrame:
    return cat.newest_by_hash(items(spark, base, "folder_id", "content_hash", "path"))


def text_results_saved(spark: SparkSession, base: str) -> DataFrame:
    """State after results for every seventh item, failures of every eleventh, and new content of every thirteenth."""
    rows = items(spark, base)
    results = rows.filter("id % 7 = 0").select("id", F.concat(F.lit("text "), F.col("id").cast("string")).alias("ocr_text"), F.lit("mock").alias("ocr_engine"), F.lit("1.0").alias("ocr_engine_version"), F.lit("en").alias("ocr_language"), F.lit("mock:1.0").alias("ocr_pipeline_version"))
    after, _ = cat.replace_text(rows, vectors(spark, base), results, NOW)
    after = cat.mark_failed(after, rows.filter("id % 11 = 0").select("id"), NOW)
    changed = rows.filter("id % 13 = 0").select("id", (F.col("file_size") + 1).alias("file_size"), "modified_at_fs", F.lit("new").alias("content_hash"))
    after = cat.reset_changed(after, changed, NOW)
    return after.select("id", "ocr_status", "ocr_pipeline_version", "ocr_language", F.sha2("ocr_text", 256).alias("text_hash"), "file_size", "content_hash", F.unix_seconds("updated_at").alias("updated_s"))


def vectors_upserted(spark: SparkSession, base: str) -> DataFrame:
    """One vector per item after new ones for every third."""
    v = vectors(spark, base)
    after = cat.upsert_vectors(v, v.filter("screenshot_id % 3 = 0").withColumn("model_version", F.lit("new")))
    return after.select("screenshot_id", "model_version", F.size("embedding").cast("long").alias("dims"))


def folder_deleted(spark: SparkSession, base: str) -> DataFrame:
    """The rows left in each table after folder 7 and all that belongs to it."""
    left = cat.delete_folder(7, table(spark, base, "folders"), items(spark, base, "folder_id"), vectors(spark, base), jobs(spark, base, "folder_id"))
    out = None
    for name, df in zip(("folders", "items", "vectors", "jobs"), left):
        one = df.select(F.lit(name).alias("table_name"), F.col("screenshot_id" if name == "vectors" else "id").alias("id"))
        out = one if out is None else out.union(one)
    return out


# ---------------------------------------------------------------------------------------------- reconciliation


SCAN_COLUMNS = ("path", "folder_id", "content_hash", "file_size", "modified_at_fs")
JOB_COLUMNS = ("ocr_status", "folder_id", "path", "content_hash")


def _scan(spark: SparkSession, base: str) -> DataFrame:
    """A scan as of later: every 17th file is gone, every 13th grew, every 19th has another name."""
    rows = items(spark, base, *SCAN_COLUMNS).filter("id % 17 <> 0")
    path = F.when(F.col("id") % 19 == 0, F.concat("path", F.lit(".new.png"))).otherwise(F.col("path"))
    return rows.select(path.alias("path"), "folder_id", "content_hash", F.when(F.col("id") % 13 == 0, F.col("file_size") + 1).otherwise(F.col("file_size")).alias("file_size"), "modified_at_fs").dropDuplicates(["path"])


def _known(spark: SparkSession, base: str) -> DataFrame:
    return items(spark, base, *SCAN_COLUMNS).groupBy("path").agg(F.max_by(F.struct("id", "folder_id", "content_hash", "file_size", "modified_at_fs"), "id").alias("i")).select("path", "i.*")


def scan_diff(spark: SparkSession, base: str) -> DataFrame:
    return rc.scan_diff(_scan(spark, base), _known(spark, base)).select("path", "id", "action")


def scan_summary(spark: SparkSession, base: str) -> DataFrame:
    return rc.scan_summary(rc.scan_diff(_scan(spark, base), _known(spark, base)), 2)


def guarded_missing(spark: SparkSession, base: str) -> DataFrame:
    """Missing files that may be removed while two subtrees cannot be read."""
    diff = rc.scan_diff(_scan(spark, base), _known(spark, base))
    shut = spark.createDataFrame([("C:\\shots\\",), ("\\\\nas-kelvo\\builds7",)], "path string")
    return rc.guarded_missing(diff, shut).select("path", "id")


def rename_detect(spark: SparkSession, base: str) -> DataFrame:
    scan, known = _scan(spark, base), _known(spark, base)
    diff = rc.scan_diff(scan, known)
    added = scan.join(diff.filter("action = 'added'").select("path"), "path", "left_semi")
    missing = known.join(diff.filter("action = 'missing'").select("path"), "path", "left_semi")
    return rc.detect_renames(added, missing)


# ------------------------------------------------------------------------------------------------------- queue


def job_enqueue(spark: SparkSession, base: str) -> DataFrame:
    """The queue after a scan's jobs for all pending items."""
    after = jb.enqueue(jobs(spark, base), jb.scan_jobs(items(spark, base, *JOB_COLUMNS)), NOW)
    return after.select("id", "dedupe_key", "status", "attempts", "screenshot_id")


def job_claim(spark: SparkSession, base: str) -> DataFrame:
    after = jb.claim(jobs(spark, base), NOW, n=25)
    return after.filter("status = 'PROCESSING'").select("id", "attempts", F.unix_timestamp("lease_until").alias("lease_s"))


def job_retry(spark: SparkSession, base: str) -> DataFrame:
    """Processing jobs hit by an error: every third one permanent."""
    now = jobs(spark, base)
    errors = now.filter("status = 'PROCESSING'").select("id", F.when(F.col("id") % 3 == 0, "FileNotFound").otherwise("DatabaseError").alias("code"), F.lit("x").alias("message"))
    return jb.retry_or_fail(now, errors, NOW).filter("last_error_message = 'x'").select("id", "status", "last_error_code", F.unix_timestamp("available_at").alias("available_s"))


def job_complete(spark: SparkSession, base: str) -> DataFrame:
    now = jobs(spark, base)
    done = now.filter("status = 'PROCESSING'").select("id", F.when(F.col("id") % 2 == 0, F.col("id")).alias("screenshot_id"))
    after = jb.complete(now, done, NOW)
    return after.select("id", "status", "screenshot_id", F.unix_seconds("lease_until").alias("lease_s"), F.unix_seconds("completed_at").alias("completed_s"))


def job_recover(spark: SparkSession, base: str) -> DataFrame:
    return jb.recover_stale(jobs(spark, base, "status", "lease_until", "updated_at"), NOW).select("id", "status", F.unix_seconds("lease_until").alias("lease_s"))


def job_retention(spark: SparkSession, base: str) -> DataFrame:
    return jb.expire(jobs(spark, base, "status", "completed_at"), NOW).select("id", "status")


def job_retry_failed(spark: SparkSession, base: str) -> DataFrame:
    return jb.retry_all_failed(jobs(spark, base), NOW).select("id", "status", "attempts", "last_error_code", F.unix_seconds("available_at").alias("available_s"), F.unix_seconds("completed_at").alias("completed_s"))


def job_backoff(spark: SparkSession, base: str) -> DataFrame:
    return jobs(spark, base, "attempts", "last_error_code").select("id", jb.backoff_seconds(F.col("attempts")).alias("seconds"), F.coalesce(jb.is_permanent(F.col("last_error_code")), F.lit(False)).alias("permanent"))


def job_next_per_folder(spark: SparkSession, base: str) -> DataFrame:
    return jb.first_claimable_per_folder(jobs(spark, base, "folder_id", "status", "available_at"), NOW).select("folder_id", "id")


def pending_embeddings(spark: SparkSession, base: str) -> DataFrame:
    return jb.embedding_jobs(items(spark, base, *JOB_COLUMNS), vectors(spark, base), MODEL, MODEL_VERSION).select("screenshot_id", "dedupe_key")


def re_process_jobs(spark: SparkSession, base: str) -> DataFrame:
    return jb.re_process_jobs(items(spark, base, *JOB_COLUMNS, "ocr_pipeline_version"), TARGET).select("screenshot_id", "dedupe_key")


def pending_batch(spark: SparkSession, base: str) -> DataFrame:
    """Every item's status after the next batch is claimed, and after a recovery of what was claimed."""
    rows = items(spark, base, "ocr_status", "folder_id")
    claimed = jb.claim_items(rows, jb.pending_items(rows).select("id"))
    return jb.recover_items(claimed.withColumn("claimed", F.col("ocr_status"))).select("id", "claimed", F.col("ocr_status").alias("recovered"))


QUERIES = {
    f.__name__: f
    for f in (
        normalize_path, data_url, job_keys, re_ocr_targets, ocr_stats, folder_stats, folder_lookup, item_lookup, job_stats, embedding_stats, engine_stats,
        service_status, eligible_items, duplicate_texts, duplicate_members, newest_by_hash, text_results_saved, vectors_upserted, folder_deleted, scan_diff, scan_summary,
        guarded_missing, rename_detect, job_enqueue, job_claim, job_retry, job_complete, job_recover, job_retention, job_retry_failed, job_backoff,
        job_next_per_folder, pending_embeddings, re_process_jobs, pending_batch,
    )
}

_SCAN = f"""{ITEMS_SQL},
scan AS (SELECT DISTINCT ON (path) * FROM (SELECT CASE WHEN id % 19 = 0 THEN path || '.new.png' ELSE path END AS path, folder_id, content_hash,
   CASE WHEN id % 13 = 0 THEN file_size + 1 ELSE file_size END AS file_size, modified_at_fs FROM items WHERE id % 17 <> 0)),
known AS (SELECT * EXCLUDE (rn) FROM (SELECT path, id, folder_id, content_hash, file_size, modified_at_fs, row_number() OVER (PARTITION BY path ORDER BY id DESC) AS rn FROM items) WHERE rn = 1),
diff AS (SELECT coalesce(f.path, e.path) AS path, e.id, CASE WHEN e.id IS NULL THEN 'added' WHEN f.path IS NULL THEN 'missing'
   WHEN f.file_size IS NOT DISTINCT FROM e.file_size AND f.modified_at_fs IS NOT DISTINCT FROM e.modified_at_fs THEN 'unchanged' ELSE 'updated' END AS action
   FROM scan f FULL JOIN known e ON f.path = e.path)"""
_COUNTS = ", ".join(f"count(*) FILTER (WHERE {{c}} = '{s}') AS {s.lower()}" for s in ("PENDING", "PROCESSING", "SUCCEEDED", "FAILED"))
_COVER = f"SELECT s AS succeeded, e AS embedded, greatest(s - e, 0) AS pending FROM (SELECT (SELECT count(*) FROM items WHERE ocr_status = 'SUCCEEDED') AS s, (SELECT count(*) FROM vecs WHERE model_version = '{MODEL_VERSION}') AS e)"
_NAME = r"regexp_extract(path, '([^\\/]*)$', 1)"
_EXT = rf"lower(regexp_extract({_NAME}, '^.+\.([^.]*)$', 1))"
_TEMP = rf"({_NAME} = '' OR starts_with({_NAME}, '.') OR starts_with({_NAME}, '~$') OR regexp_matches(lower({_NAME}), '\.(tmp|crdownload|partial|part|swp|lock)$'))"
_MEDIA = "CASE {e} WHEN 'png' THEN 'image/png' WHEN 'jpg' THEN 'image/jpeg' WHEN 'jpeg' THEN 'image/jpeg' WHEN 'webp' THEN 'image/webp' ELSE 'application/octet-stream' END"

SQL = {
    "normalize_path": rf"""
WITH a AS (SELECT DISTINCT path, replace(path, '/', '\') AS s FROM index_jobs WHERE path IS NOT NULL),
b AS (SELECT *, CASE WHEN starts_with(s, '\\?\UNC\') THEN '\\' || s[9:] WHEN starts_with(s, '\\?\') THEN s[5:] ELSE s END AS t FROM a),
c AS (SELECT *, CASE WHEN regexp_matches(t, '^[A-Za-z]:') THEN upper(t[1:1]) || t[2:] ELSE t END AS u FROM b)
SELECT path, CASE WHEN len(u) <= 3 THEN u ELSE regexp_replace(u, '\\+$', '') END AS plain, {_NAME} AS name, {_EXT} AS ext, {_TEMP} AS temporary,
  NOT {_TEMP} AND {_EXT} IN ('png', 'jpg', 'jpeg', 'webp') AS supported, {_MEDIA.format(e=_EXT)} AS media_type FROM c""",
    "data_url": f"WITH {ITEMS_SQL} SELECT id, 'data:' || {_MEDIA.format(e='lower(extension)')} || ';base64,' || to_base64(encode(ocr_text)) AS data_url, id AS uri_id FROM items",
    "job_keys": f"""WITH {ITEMS_SQL} SELECT id, 'UPSERT:' || folder_id || ':' || path || ':' || coalesce(content_hash, '') AS upsert_key, 'DELETE:' || folder_id || ':' || path AS delete_key,
  'EMBED:' || id || ':' || coalesce(content_hash, 'unknown') || ':{MODEL_VERSION}' AS embed_key, 'RE_OCR:' || id || ':' || coalesce(content_hash, '') || ':{TARGET}' AS re_ocr_key FROM items""",
    "re_ocr_targets": f"WITH {JOBS_SQL} SELECT nullif(regexp_extract(dedupe_key, '^RE_OCR:[^:]*:[^:]*:(.+)$', 1), '') AS target, count(*) AS n FROM jobs GROUP BY 1",
    "ocr_stats": f"WITH {ITEMS_SQL} SELECT count(*) AS total, {_COUNTS.format(c='ocr_status')} FROM items",
    "folder_stats": f"""WITH {ITEMS_SQL} SELECT f.id, f.path, count(i.id) AS item_count, count(i.id) FILTER (WHERE i.ocr_status = 'SUCCEEDED') AS indexed_count
FROM folders f LEFT JOIN items i ON i.folder_id = f.id GROUP BY f.id, f.path""",
    "folder_lookup": "SELECT id, path FROM folders WHERE lower(path) = lower((SELECT path FROM folders WHERE id = 3))",
    "item_lookup": f"WITH {ITEMS_SQL} SELECT id, folder_id, filename FROM items WHERE path = (SELECT path FROM items WHERE id = 42) UNION ALL SELECT id, folder_id, filename FROM items WHERE folder_id = 7 AND id = 77",
    "job_stats": f"WITH {JOBS_SQL} SELECT count(*) AS total, {_COUNTS.format(c='status')} FROM jobs",
    "embedding_stats": f"WITH {ITEMS_SQL}, {VECTORS_SQL} {_COVER}",
    "engine_stats": f"""WITH {ITEMS_SQL} SELECT count(*) AS total, count(*) FILTER (WHERE ocr_engine ILIKE '%windows%') AS windows, count(*) FILTER (WHERE ocr_engine ILIKE '%multilingual%') AS multilingual,
  count(*) FILTER (WHERE ocr_pipeline_version IS NOT DISTINCT FROM '{TARGET}') AS "current", count(*) FILTER (WHERE ocr_pipeline_version IS DISTINCT FROM '{TARGET}') AS outdated
FROM items WHERE ocr_status = 'SUCCEEDED'""",
    "service_status": f"""WITH {ITEMS_SQL}, {JOBS_SQL}, {VECTORS_SQL}, st AS (SELECT 'items' AS area, ocr_status AS s FROM items UNION ALL SELECT 'jobs', status FROM jobs),
names AS (SELECT area, unnest(['pending', 'processing', 'succeeded', 'failed']) AS name FROM (SELECT unnest(['items', 'jobs']) AS area))
SELECT names.area, names.name, count(st.s) AS value FROM names LEFT JOIN st ON st.area = names.area AND lower(st.s) = names.name GROUP BY 1, 2
UNION ALL SELECT area, 'total', count(*) FROM st GROUP BY 1
UNION ALL SELECT 'vectors', unnest(['succeeded', 'embedded', 'pending']), unnest([succeeded, embedded, pending]) FROM ({_COVER})
UNION ALL SELECT 'watchers', 'folders', 3""",
    "eligible_items": f"WITH {ITEMS_SQL} SELECT id, ocr_pipeline_version FROM items WHERE ocr_status = 'SUCCEEDED' AND ocr_pipeline_version IS DISTINCT FROM '{TARGET}'",
    "duplicate_texts": f"WITH {ITEMS_SQL} SELECT sha256(ocr_text) AS text_hash, count(*) AS copies, min(id) AS first_id, max(id) AS last_id FROM items WHERE trim(ocr_text) <> '' GROUP BY ocr_text HAVING count(*) > 1",
    "newest_by_hash": f"WITH {ITEMS_SQL} SELECT folder_id, content_hash, max(id) AS id, arg_max(path, id) AS path FROM items WHERE content_hash IS NOT NULL GROUP BY 1, 2",
    "text_results_saved": f"""WITH {ITEMS_SQL}
SELECT id, CASE WHEN id % 13 = 0 THEN 'PENDING' WHEN id % 11 = 0 THEN 'FAILED' WHEN id % 7 = 0 THEN 'SUCCEEDED' ELSE ocr_status END AS ocr_status,
    CASE WHEN id % 7 = 0 THEN 'mock:1.0' ELSE ocr_pipeline_version END AS ocr_pipeline_version, CASE WHEN id % 7 = 0 THEN 'en' ELSE ocr_language END AS ocr_language,
    sha256(CASE WHEN id % 13 = 0 THEN NULL WHEN id % 7 = 0 THEN 'text ' || id ELSE ocr_text END) AS text_hash, CASE WHEN id % 13 = 0 THEN file_size + 1 ELSE file_size END AS file_size,
    CASE WHEN id % 13 = 0 THEN 'new' ELSE content_hash END AS content_hash,
    CASE WHEN id % 7 = 0 OR id % 11 = 0 OR id % 13 = 0 THEN epoch({NOW_SQL})::BIGINT ELSE floor(epoch(updated_at))::BIGINT END AS updated_s FROM items""",
    "vectors_upserted": f"WITH {VECTORS_SQL} SELECT screenshot_id, CASE WHEN screenshot_id % 3 = 0 THEN 'new' ELSE model_version END AS model_version, len(embedding) AS dims FROM vecs",
    "folder_deleted": f"""WITH {ITEMS_SQL}, {JOBS_SQL}, {VECTORS_SQL}
SELECT 'folders' AS table_name, id FROM folders WHERE id <> 7 UNION ALL SELECT 'items', id FROM items WHERE folder_id IS DISTINCT FROM 7
UNION ALL SELECT 'vectors', screenshot_id FROM vecs WHERE screenshot_id NOT IN (SELECT id FROM items WHERE folder_id = 7) UNION ALL SELECT 'jobs', id FROM jobs WHERE folder_id IS DISTINCT FROM 7""",
    "scan_diff": f"WITH {_SCAN} SELECT path, id, action FROM diff",
    "scan_summary": f"""WITH {_SCAN} SELECT count(*) FILTER (WHERE action <> 'missing') AS discovered, count(*) FILTER (WHERE action = 'added') AS added,
  count(*) FILTER (WHERE action = 'updated') AS updated, count(*) FILTER (WHERE action = 'unchanged') AS unchanged, count(*) FILTER (WHERE action = 'missing') AS removed, 2::BIGINT AS failed FROM diff""",
    "guarded_missing": rf"WITH {_SCAN} SELECT path, id FROM diff WHERE action = 'missing' AND NOT starts_with(path, 'C:\shots\') AND NOT starts_with(path, '\\nas-kelvo\builds7')",
    "rename_detect": f"""WITH {_SCAN},
old AS (SELECT k.folder_id, k.content_hash, max(k.id) AS id, arg_max(k.path, k.id) AS old_path FROM known k JOIN diff d ON d.path = k.path AND d.action = 'missing' WHERE k.content_hash IS NOT NULL GROUP BY 1, 2),
new AS (SELECT s.folder_id, s.content_hash, min(s.path) AS new_path FROM scan s JOIN diff d ON d.path = s.path AND d.action = 'added' WHERE s.content_hash IS NOT NULL GROUP BY 1, 2)
SELECT id, old_path, new_path FROM old JOIN new USING (folder_id, content_hash)""",
    "job_enqueue": f"""WITH {ITEMS_SQL}, {JOBS_SQL},
want AS (SELECT key, max(folder_id) AS folder_id, max(path) AS path, max(id) AS sid FROM (SELECT *, 'UPSERT:' || folder_id || ':' || path || ':' || coalesce(content_hash, '') AS key FROM items WHERE ocr_status = 'PENDING') GROUP BY key),
idle AS (SELECT * FROM want WHERE key NOT IN (SELECT dedupe_key FROM jobs WHERE status IN ('PENDING', 'PROCESSING'))),
one AS (SELECT folder_id, path, max(key) AS key, arg_max(sid, key) AS sid FROM idle GROUP BY 1, 2),
left_jobs AS (SELECT j.* FROM jobs j WHERE NOT (j.status = 'PENDING' AND EXISTS (SELECT 1 FROM one o WHERE o.folder_id = j.folder_id AND o.path = j.path AND o.key <> j.dedupe_key))),
old AS (SELECT j.id, j.dedupe_key, CASE WHEN o.key IS NULL THEN j.status ELSE 'PENDING' END AS status, CASE WHEN o.key IS NULL THEN j.attempts ELSE 0 END AS attempts,
   CASE WHEN o.key IS NULL THEN j.screenshot_id ELSE coalesce(o.sid, j.screenshot_id) END AS screenshot_id FROM left_jobs j LEFT JOIN one o ON o.key = j.dedupe_key),
fresh AS (SELECT (SELECT max(id) FROM left_jobs) + row_number() OVER (ORDER BY key) AS id, key, 'PENDING', 0, sid FROM one WHERE key NOT IN (SELECT dedupe_key FROM left_jobs))
SELECT * FROM old UNION ALL SELECT * FROM fresh""",
    "job_claim": f"""WITH {JOBS_SQL}, due AS (SELECT id FROM jobs WHERE status = 'PENDING' AND available_at <= {NOW_SQL} ORDER BY id LIMIT 25)
SELECT id, CASE WHEN id IN (FROM due) THEN attempts + 1 ELSE attempts END AS attempts,
  CASE WHEN id IN (FROM due) THEN epoch({NOW_SQL})::BIGINT + 60 ELSE floor(epoch(lease_until))::BIGINT END AS lease_s FROM jobs WHERE status = 'PROCESSING' OR id IN (FROM due)""",
    "job_retry": f"""WITH {JOBS_SQL} SELECT id, CASE WHEN id % 3 = 0 OR attempts >= max_attempts THEN 'FAILED' ELSE 'PENDING' END AS status,
  CASE WHEN id % 3 = 0 THEN 'FileNotFound' ELSE 'DatabaseError' END AS last_error_code,
  CASE WHEN id % 3 = 0 OR attempts >= max_attempts THEN floor(epoch(available_at))::BIGINT ELSE epoch({NOW_SQL})::BIGINT + least(pow(2, least(attempts, 5)), 60)::BIGINT END AS available_s
FROM jobs WHERE status = 'PROCESSING'""",
    "job_complete": f"""WITH {JOBS_SQL} SELECT id, CASE WHEN status = 'PROCESSING' THEN 'SUCCEEDED' ELSE status END AS status,
  CASE WHEN status = 'PROCESSING' AND id % 2 = 0 THEN id ELSE screenshot_id END AS screenshot_id, CASE WHEN status <> 'PROCESSING' THEN floor(epoch(lease_until))::BIGINT END AS lease_s,
  CASE WHEN status = 'PROCESSING' THEN epoch({NOW_SQL})::BIGINT ELSE floor(epoch(completed_at))::BIGINT END AS completed_s FROM jobs""",
    "job_recover": f"""WITH {JOBS_SQL}, s AS (SELECT *, status = 'PROCESSING' AND (lease_until IS NULL OR lease_until < {NOW_SQL}) AS stale FROM jobs)
SELECT id, CASE WHEN stale THEN 'PENDING' ELSE status END AS status, CASE WHEN NOT stale THEN floor(epoch(lease_until))::BIGINT END AS lease_s FROM s""",
    "job_retention": f"WITH {JOBS_SQL} SELECT id, status FROM jobs WHERE NOT coalesce(status = 'SUCCEEDED' AND completed_at < {NOW_SQL} - INTERVAL 24 HOUR, false)",
    "job_retry_failed": f"""WITH {JOBS_SQL} SELECT id, CASE WHEN status = 'FAILED' THEN 'PENDING' ELSE status END AS status, CASE WHEN status = 'FAILED' THEN 0 ELSE attempts END AS attempts,
  CASE WHEN status <> 'FAILED' THEN last_error_code END AS last_error_code, CASE WHEN status = 'FAILED' THEN epoch({NOW_SQL})::BIGINT ELSE floor(epoch(available_at))::BIGINT END AS available_s,
  floor(epoch(completed_at))::BIGINT AS completed_s FROM jobs""",
    "job_backoff": f"WITH {JOBS_SQL} SELECT id, least(pow(2, least(attempts, 5)), 60)::BIGINT AS seconds, coalesce(last_error_code = 'FileNotFound', false) AS permanent FROM jobs",
    "job_next_per_folder": f"WITH {JOBS_SQL} SELECT folder_id, min(id) AS id FROM jobs WHERE status = 'PENDING' AND available_at <= {NOW_SQL} GROUP BY 1",
    "pending_embeddings": f"""WITH {ITEMS_SQL}, {VECTORS_SQL} SELECT id AS screenshot_id, 'EMBED:' || id || ':' || coalesce(content_hash, 'unknown') || ':{MODEL_VERSION}' AS dedupe_key
FROM items WHERE ocr_status = 'SUCCEEDED' AND id NOT IN (SELECT screenshot_id FROM vecs WHERE model_version = '{MODEL_VERSION}')""",
    "re_process_jobs": f"""WITH {ITEMS_SQL} SELECT id AS screenshot_id, 'RE_OCR:' || id || ':' || coalesce(content_hash, '') || ':{TARGET}' AS dedupe_key FROM items
WHERE ocr_status = 'SUCCEEDED' AND ocr_pipeline_version IS DISTINCT FROM '{TARGET}' ORDER BY id LIMIT 10000""",
    "pending_batch": f"""WITH {ITEMS_SQL}, batch AS (SELECT id FROM items WHERE ocr_status = 'PENDING' ORDER BY id LIMIT 500)
SELECT id, CASE WHEN id IN (FROM batch) THEN 'PROCESSING' ELSE ocr_status END AS claimed, CASE WHEN ocr_status = 'PROCESSING' THEN 'PENDING' ELSE ocr_status END AS recovered FROM items""",
    "duplicate_members": f"""WITH {ITEMS_SQL}, h AS (SELECT id, sha256(ocr_text) AS text_hash FROM items WHERE trim(ocr_text) <> '')
SELECT text_hash, id FROM h WHERE text_hash IN (SELECT text_hash FROM h GROUP BY 1 HAVING count(*) > 1)""",
}
