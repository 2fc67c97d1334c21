"""Registered queries of the worker, discovery scans, line routing and crops."""

from __future__ import annotations

from datetime import timedelta
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ocrlake.functions import text as tx
from ocrlake.functions.vectors import mock_embedding
from ocrlake.operators import catalog as cat
from ocrlake.operators import extract as ex
from ocrlake.operators import jobs as jb
from ocrlake.operators import reconcile as rc
from ocrlake.operators import worker as wk
from ocrlake.plans.common import ITEMS_SQL, MODEL, MODEL_VERSION, NOW, NOW_SQL, items, jobs, vectors
from ocrlake.sources.tables import table

PIPELINE = "mock:2.0"


def _read(rows: DataFrame) -> DataFrame:
    """A stand-in engine: the path in capitals, failing by the length of the path."""

    def engine(path: str) -> ex.Recognised:
        if len(path) % 10 == 3:
            raise ex.EngineError("OCR_FAILED", path)
        return ex.Recognised(" " + path.upper() + "\r\n", "mock", "2.0", "en")

    return ex.recognise(rows, {"mock": engine}, ["mock"])


def _single(spark: SparkSession, base: str) -> DataFrame:
    """Items, the newest of each path."""
    rows = items(spark, base)
    return rows.join(rows.groupBy("path").agg(F.max("id").alias("id")).select("id"), "id", "left_semi")


@cache
def _batch(spark: SparkSession, base: str) -> wk.Handled:
    """One turn of the worker over jobs for every item, by id: upsert, delete, vector, new text (of the active pipeline or
    of another). On disk every fifth file has changed, every thirteenth is gone and every 29th cannot be read."""
    rows = _single(spark, base)
    hour = F.lit(NOW - timedelta(hours=1)).cast("timestamp")
    i, f, p, h = (F.col(c) for c in ("id", "folder_id", "path", "content_hash"))
    kind, k = F.col("id") % 4, F.col("id")
    key = F.when(kind == 0, tx.upsert_key(f, p, h)).when(kind == 1, tx.delete_key(f, p)).when(kind == 2, tx.embed_key(i, h, MODEL_VERSION)).otherwise(tx.re_ocr_key(i, h, F.when(k % 8 == 3, PIPELINE).otherwise("other:1")))
    names = F.when(kind == 0, "UPSERT_SCREENSHOT").when(kind == 1, "DELETE_SCREENSHOT").when(kind == 2, "GENERATE_TEXT_EMBEDDING").otherwise("RE_OCR_SCREENSHOT")
    empty = jobs(spark, base).limit(0)
    wanted = rows.select("id", "folder_id", F.when(kind >= 2, i).alias("screenshot_id"), "path", names.alias("job_type"), F.lit("PENDING").alias("status"), key.alias("dedupe_key"), F.lit(0).alias("attempts"), F.lit(5).alias("max_attempts"), hour.alias("available_at"), hour.alias("created_at"), hour.alias("updated_at"))
    queue = empty.unionByName(wanted, allowMissingColumns=True)
    seen = rows.filter("id % 13 <> 0")
    disk = seen.select("path", F.when(k % 5 == 0, F.col("file_size") + 1).otherwise(F.col("file_size")).alias("file_size"), "modified_at_fs", F.when(k % 5 == 0, F.lit("new")).otherwise(F.coalesce(h, F.lit("none"))).alias("content_hash"), F.when(k % 29 == 0, "FileReadFailed").alias("error_code"))
    model = wk.Embedding(MODEL, MODEL_VERSION, mock_embedding)
    # what it gives are written tables, so the queries on it share one run
    return wk.run_batch(wk.State(rows, vectors(spark, base), queue), disk, _read, PIPELINE, NOW, model, n=100_000_000)


def worker_jobs(spark: SparkSession, base: str) -> DataFrame:
    out = _batch(spark, base)
    asked = out.state.jobs
    first = asked.join(out.outcomes.select("id"), "id", "left_semi")
    later = asked.join(out.outcomes.select("id"), "id", "left_anti")
    cols = ["dedupe_key", "status", "last_error_code", "attempts", F.unix_seconds("available_at").alias("available_s")]
    return first.select(*cols, F.lit(False).alias("asked_later")).union(later.select(*cols, F.lit(True).alias("asked_later")))


def worker_items(spark: SparkSession, base: str) -> DataFrame:
    s = _batch(spark, base).state
    has = s.vectors.select(F.col("screenshot_id").alias("id"), F.col("model_version").alias("vector_version"))
    return s.items.join(has, "id", "left").select("id", "ocr_status", "ocr_pipeline_version", F.sha2("ocr_text", 256).alias("text_hash"), "file_size", "content_hash", "vector_version")


def worker_touched(spark: SparkSession, base: str) -> DataFrame:
    """Items whose rows in the search index a turn makes stale."""
    return _batch(spark, base).touched


SCAN_FOLDER = 7


@cache
def _discovery(spark: SparkSession, base: str) -> rc.Discovery:
    """A scan of folder 7: every third file is gone, every fourth grew, every fifth has a new name; every seventh new or
    grown file cannot be hashed, files that end in '1.png' are not confirmed as gone, one subtree is shut."""
    rows = _single(spark, base)
    own = rows.filter((F.col("folder_id") == SCAN_FOLDER) & (F.col("id") % 3 != 0))
    path = F.when(F.col("id") % 5 == 0, F.concat("path", F.lit(".new.png"))).otherwise(F.col("path"))
    size = F.when(F.col("id") % 4 == 0, F.col("file_size") + 1).otherwise(F.col("file_size"))
    found = own.select(path.alias("path"), F.concat(F.lit("f"), F.col("id").cast("string")).alias("filename"), F.lit("png").alias("extension"), size.alias("file_size"), "modified_at_fs")
    hashed = lambda p: p.select("path", F.when(F.length("path") % 7 != 0, F.sha2("path", 256)).alias("content_hash"), F.lit(None).cast("string").alias("error_code"))
    shut = spark.createDataFrame([("C:\\shots\\shut",)], "path string")
    return rc.discover(SCAN_FOLDER, found, rows, hashed, shut, NOW, lambda p: p.filter(~F.col("path").endswith("1.png")), failed=1)


def discovery_actions(spark: SparkSession, base: str) -> DataFrame:
    return _discovery(spark, base).actions


def discovery_items(spark: SparkSession, base: str) -> DataFrame:
    return _discovery(spark, base).items.select("path", "folder_id", "file_size", "content_hash", "ocr_status")


def discovery_summary(spark: SparkSession, base: str) -> DataFrame:
    return _discovery(spark, base).summary


def catalog_changes(spark: SparkSession, base: str) -> DataFrame:
    """Items and delete jobs after every 19th item was renamed, a folder was added and a model's vectors were cleared."""
    rows = _single(spark, base)
    moved = rows.filter("id % 19 = 0").select("folder_id", F.col("path").alias("old_path"), F.concat("path", F.lit(".Moved.JPG")).alias("new_path"))
    queue = jobs(spark, base)
    after, left = cat.rename_items(moved, rows, queue, NOW)
    more = cat.insert_folder(table(spark, base, "folders"), "Z:\\added", NOW)
    cleared = cat.delete_vectors(cat.clear_vectors(vectors(spark, base), "other"), rows.filter("id % 19 = 0").select("id"))
    a = after.select(F.lit("item").alias("kind"), "id", F.concat_ws("|", "path", "filename", "extension").alias("value"))
    b = left.select(F.lit("job").alias("kind"), "id", F.col("dedupe_key").alias("value"))
    c = more.select(F.lit("folder").alias("kind"), "id", "path")
    d = cleared.select(F.lit("vector").alias("kind"), F.col("screenshot_id").alias("id"), F.col("model_version").alias("value"))
    return a.union(b).union(c).union(d)


def vectors_rebuilt(spark: SparkSession, base: str) -> DataFrame:
    """Jobs for all processed items after the model's vectors were cleared."""
    rows = items(spark, base, "ocr_status", "folder_id", "path", "content_hash")
    return jb.embedding_jobs(rows, cat.clear_vectors(vectors(spark, base), MODEL), MODEL, MODEL_VERSION).select("screenshot_id", "dedupe_key")


def line_routes(spark: SparkSession, base: str) -> DataFrame:
    """Every line of the fixtures with three readings made of it, put together again."""
    b = table(spark, base, "benchmark_corpus").withColumn("id", F.xxhash64("fixture_name"))
    lines = b.select("id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    n = F.length("line")
    probe = F.when(n % 5 == 0, "").when(n % 5 == 1, F.concat(F.lit("ERR_"), "line")).otherwise(F.col("line"))
    second = F.when(n % 2 == 0, F.concat(F.lit("second_"), "line"))
    native = F.when(n % 3 == 0, F.concat("line", F.lit(" đọc"))).when(n % 3 == 1, " ")
    lines = lines.filter("id % 11 <> 0").select("id", "line_no", probe.alias("probe"), second.alias("second"), native.alias("native"))
    done = ex.routed_texts(lines, b.select("id", F.lit("whole").alias("text")))
    return b.select("id", "fixture_name").join(done, "id").select("fixture_name", "ocr_text", "by_lines")


def line_crops(spark: SparkSession, base: str) -> DataFrame:
    """Crops of boxes made from the items' ids, in pictures of all sizes."""
    rows = items(spark, base, "file_size").select("id", (F.col("id") * 37 % 3000 + 1).alias("width"), (F.col("file_size") * 53 % 2000 + 1).alias("height"))
    seen_w, seen_h = ex.detector_size(F.col("width"), F.col("height"))
    box = lambda k: F.struct((F.col("id") * (7 + k) % seen_w).alias("x0"), (F.col("id") * (3 + k) % seen_h).alias("y0"), F.least(F.col("id") * (7 + k) % seen_w + k % 40, seen_w - 1).alias("x1"), F.least(F.col("id") * (3 + k) % seen_h + k % 12, seen_h - 1).alias("y1"))
    images = rows.withColumn("boxes", F.transform(F.sequence(F.lit(0), F.lit(139)), box))
    return ex.line_crops(images).select("id", "line_no", "crop.x0", "crop.y0", "crop.x1", "crop.y1")


QUERIES = {f.__name__: f for f in (worker_jobs, worker_items, worker_touched, discovery_actions, discovery_items, discovery_summary, catalog_changes, vectors_rebuilt, line_routes, line_crops)}

# what becomes of each job: read is whether the engine is asked, code the error
_WORK = f"""{ITEMS_SQL}, single AS (SELECT * FROM items WHERE id IN (SELECT max(id) FROM items GROUP BY path)),
w AS (SELECT *, id % 4 AS kind, id % 13 = 0 AS gone, id % 13 <> 0 AND id % 29 = 0 AS unread, id % 5 = 0 OR content_hash IS NULL AS differs, length(path) % 10 = 3 AS fails, id % 8 = 7 AS other FROM single),
c AS (SELECT *, CASE WHEN kind IN (0, 3) AND gone THEN 'FileNotFound' WHEN kind IN (0, 1, 3) AND unread THEN 'FileReadFailed'
    WHEN kind = 0 AND (differs OR ocr_status <> 'SUCCEEDED') AND fails THEN 'OCR_FAILED' WHEN kind = 2 AND gone_item THEN 'FileNotFound'
    WHEN kind = 3 AND other THEN 'OCR_ENGINE_UNAVAILABLE' WHEN kind = 3 AND fails THEN 'OCR_FAILED' END AS code,
  kind = 0 AND NOT gone AND NOT unread AND (differs OR ocr_status <> 'SUCCEEDED') AS asked FROM (SELECT *, false AS gone_item FROM w)),
done AS (SELECT *, CASE kind WHEN 0 THEN 'UPSERT:' || folder_id || ':' || path || ':' || coalesce(content_hash, '') WHEN 1 THEN 'DELETE:' || folder_id || ':' || path
    WHEN 2 THEN 'EMBED:' || id || ':' || coalesce(content_hash, 'unknown') || ':{MODEL_VERSION}' ELSE 'RE_OCR:' || id || ':' || coalesce(content_hash, '') || ':' || CASE WHEN other THEN 'other:1' ELSE '{PIPELINE}' END END AS key,
  (asked OR kind = 3) AND code IS NULL AS fresh, CASE WHEN kind = 0 AND differs THEN CASE WHEN id % 5 = 0 THEN 'new' ELSE 'none' END ELSE content_hash END AS hash FROM c)"""
_TEXT = "CASE WHEN fresh THEN upper(path) WHEN asked AND differs THEN NULL ELSE ocr_text END"

_SCAN = rf"""{ITEMS_SQL}, single AS (SELECT * FROM items WHERE id IN (SELECT max(id) FROM items GROUP BY path)), own AS (SELECT * FROM single WHERE folder_id = {SCAN_FOLDER}),
found AS (SELECT id, CASE WHEN id % 5 = 0 THEN path || '.new.png' ELSE path END AS path, CASE WHEN id % 4 = 0 THEN file_size + 1 ELSE file_size END AS file_size FROM own WHERE id % 3 <> 0),
act AS (SELECT coalesce(f.path, o.path) AS path, o.id, coalesce(f.file_size, o.file_size) AS file_size, CASE WHEN o.id IS NULL THEN CASE WHEN length(f.path) % 7 = 0 THEN 'failed' ELSE 'added' END
  WHEN f.path IS NULL THEN CASE WHEN ends_with(o.path, '1.png') OR starts_with(o.path, 'C:\shots\shut') THEN 'kept' ELSE 'missing' END
  WHEN f.file_size = o.file_size THEN 'unchanged' WHEN length(f.path) % 7 = 0 THEN 'failed' ELSE 'updated' END AS action FROM found f FULL JOIN own o ON f.path = o.path)"""
_F = "count(*) FILTER (WHERE action = '{}')"

SQL = {
    "worker_jobs": f"""WITH {_WORK}
SELECT key AS dedupe_key, CASE WHEN code IS NULL THEN 'SUCCEEDED' WHEN code = 'FileNotFound' THEN 'FAILED' ELSE 'PENDING' END AS status, code AS last_error_code, 1 AS attempts,
  epoch({NOW_SQL})::BIGINT + CASE WHEN code IS NULL OR code = 'FileNotFound' THEN -3600 ELSE 2 END AS available_s, false AS asked_later FROM done
UNION ALL SELECT 'EMBED:' || id || ':' || coalesce(hash, CASE kind WHEN 0 THEN 'unknown' ELSE '' END) || ':{MODEL_VERSION}', 'PENDING', NULL, 0, epoch({NOW_SQL})::BIGINT, true FROM done WHERE fresh""",
    "worker_items": f"""WITH {_WORK}, v AS (SELECT vec_id AS id, CASE WHEN vec_id % 5 = 4 THEN 'old' ELSE '{MODEL_VERSION}' END AS version FROM embeddings)
SELECT d.id, CASE WHEN fresh THEN 'SUCCEEDED' WHEN asked THEN 'FAILED' ELSE ocr_status END AS ocr_status, CASE WHEN fresh THEN '{PIPELINE}' ELSE ocr_pipeline_version END AS ocr_pipeline_version,
  sha256({_TEXT}) AS text_hash, CASE WHEN asked AND id5 THEN file_size + 1 ELSE file_size END AS file_size, CASE WHEN asked THEN hash ELSE content_hash END AS content_hash,
  CASE WHEN kind = 2 AND ocr_status = 'SUCCEEDED' THEN '{MODEL_VERSION}' WHEN kind = 3 AND fresh THEN NULL WHEN asked AND differs THEN NULL ELSE version END AS vector_version
FROM (SELECT *, id % 5 = 0 AS id5 FROM done) d LEFT JOIN v ON v.id = d.id WHERE NOT (kind = 1 AND gone)""",
    "worker_touched": f"WITH {_WORK} SELECT id FROM done WHERE (kind = 0 AND NOT gone AND NOT unread) OR (kind = 1 AND gone) OR (kind = 3 AND fresh)",
    "discovery_actions": f"WITH {_SCAN} SELECT path, id, action FROM act",
    "discovery_items": f"""WITH {_SCAN} SELECT path, folder_id, file_size, content_hash, ocr_status FROM single WHERE folder_id IS DISTINCT FROM {SCAN_FOLDER}
UNION ALL SELECT a.path, {SCAN_FOLDER}, CASE WHEN action = 'failed' THEN s.file_size ELSE a.file_size END, CASE WHEN action IN ('added', 'updated') THEN sha256(a.path) ELSE s.content_hash END,
  CASE WHEN action IN ('added', 'updated') THEN 'PENDING' ELSE s.ocr_status END FROM act a LEFT JOIN own s ON s.id = a.id WHERE action <> 'missing' AND NOT (action = 'failed' AND a.id IS NULL)""",
    "discovery_summary": f"""WITH {_SCAN} SELECT count(*) FILTER (WHERE action NOT IN ('missing', 'kept')) AS discovered, {_F.format('added')} AS added, {_F.format('updated')} AS updated,
  {_F.format('unchanged')} AS unchanged, {_F.format('missing')} AS removed, {_F.format('failed')} + 1 AS failed FROM act""",
    "catalog_changes": rf"""WITH {ITEMS_SQL}, single AS (SELECT * FROM items WHERE id IN (SELECT max(id) FROM items GROUP BY path)),
queue AS (SELECT * FROM (SELECT id, dedupe_key, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, attempts DESC NULLS LAST, status DESC NULLS LAST, completed_at DESC NULLS LAST, lease_until DESC NULLS LAST) AS rn FROM index_jobs) WHERE rn = 1)
SELECT 'item' AS kind, id, CASE WHEN id % 19 = 0 THEN path || '.Moved.JPG|' || regexp_extract(path || '.Moved.JPG', '([^\\/]*)$', 1) || '|jpg' ELSE path || '|' || filename || '|' || extension END AS value FROM single
UNION ALL SELECT 'job', id, dedupe_key FROM queue WHERE dedupe_key IS NULL OR dedupe_key NOT IN (SELECT 'DELETE:' || folder_id || ':' || path FROM single WHERE id % 19 = 0)
UNION ALL SELECT 'folder', id, path FROM folders UNION ALL SELECT 'folder', (SELECT max(id) + 1 FROM folders), 'Z:\added'
UNION ALL SELECT 'vector', vec_id, CASE WHEN vec_id % 5 = 4 THEN 'old' ELSE '{MODEL_VERSION}' END FROM embeddings WHERE vec_id NOT IN (SELECT id FROM single WHERE id % 19 = 0)""",
    "vectors_rebuilt": f"WITH {ITEMS_SQL} SELECT id AS screenshot_id, 'EMBED:' || id || ':' || coalesce(content_hash, 'unknown') || ':{MODEL_VERSION}' AS dedupe_key FROM items WHERE ocr_status = 'SUCCEEDED'",
    "line_crops": f"""WITH {ITEMS_SQL}, p AS (SELECT id, id * 37 % 3000 + 1 AS w, file_size * 53 % 2000 + 1 AS h FROM items),
q AS (SELECT *, least(960::FLOAT / greatest(w, h)::FLOAT, 1::FLOAT) AS f FROM p),
s AS (SELECT *, greatest(ceil((w::FLOAT * f)::FLOAT / 32) * 32, 32)::BIGINT AS sw, greatest(ceil((h::FLOAT * f)::FLOAT / 32) * 32, 32)::BIGINT AS sh FROM q),
b AS (SELECT *, id * (7 + k) % sw AS x0, id * (3 + k) % sh AS y0, least(id * (7 + k) % sw + k % 40, sw - 1) AS x1, least(id * (3 + k) % sh + k % 12, sh - 1) AS y1 FROM (SELECT *, unnest(range(0, 140)) AS k FROM s)),
d AS (SELECT *, greatest(floor((x1 - x0 + 1)::FLOAT * 0.15::FLOAT), 4)::BIGINT AS px, greatest(floor((y1 - y0 + 1)::FLOAT * 0.55::FLOAT), 6)::BIGINT AS py FROM b),
e AS (SELECT id, k, least(floor((greatest(x0 - px, 0)::FLOAT * w::FLOAT)::FLOAT / sw::FLOAT)::BIGINT, w - 1) AS x0, least(floor((greatest(y0 - py, 0)::FLOAT * h::FLOAT)::FLOAT / sh::FLOAT)::BIGINT, h - 1) AS y0,
  least(floor(((least(x1 + px, sw - 1) + 1)::FLOAT * w::FLOAT)::FLOAT / sw::FLOAT)::BIGINT, w) AS x1, least(floor(((least(y1 + py, sh - 1) + 1)::FLOAT * h::FLOAT)::FLOAT / sh::FLOAT)::BIGINT, h) AS y1 FROM d)
SELECT id, k AS line_no, x0, y0, x1, y1 FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY k) AS n FROM e WHERE x1 - x0 >= 4 AND y1 - y0 >= 4) WHERE n <= 128""",
}
