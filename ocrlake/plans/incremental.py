"""Registered queries of the two general data-processing problems, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ocrlake.operators.changes import DELETE, REPLACE, UPSERT, apply_changes, current_files
from ocrlake.operators.incremental import Layout, commit_manifest, committed_state, new_batch_id, pending, read_output, run_incremental
from ocrlake.session import ensure_checkpoint_dir
from ocrlake.sources.tables import table


def p1_found(spark: SparkSession, base: str) -> DataFrame:
    manifest = committed_state(table(spark, base, "index_state"), table(spark, base, "index_runs"))
    return pending(table(spark, base, "screenshots"), manifest)


def p1_cycle(spark: SparkSession, base: str) -> DataFrame:
    """What a whole run processes: the committed state is taken over as manifest, the run writes the work list's keys as
    its output and commits, and a second run over the same listing must find nothing to do."""
    layout = Layout(f"{ensure_checkpoint_dir(spark)}/cycle-{uuid.uuid4().hex}", "id")
    manifest = committed_state(table(spark, base, "index_state"), table(spark, base, "index_runs"))
    commit_manifest(manifest.withColumnRenamed("screenshot_id", "id"), layout, new_batch_id(0))
    listing = table(spark, base, "screenshots")
    keys = lambda rows: rows.select(F.col("id").alias("screenshot_id")).distinct()
    run_incremental(spark, listing, layout, keys, new_batch_id(1))
    again = run_incremental(spark, listing, layout, keys, new_batch_id(2))
    found = read_output(spark, layout)
    return found.select("screenshot_id", F.lit(again).cast("long").alias("left_over"))


def p4_found(spark: SparkSession, base: str) -> DataFrame:
    return current_files(spark, table(spark, base, "index_jobs"))


def p4_fields(spark: SparkSession, base: str) -> DataFrame:
    """Current status, time and errors of every job key, field by field: each delivery sets the fields it has, a delivery
    that is pending starts the job anew (all fields), one with the error FileNotFound removes it."""
    jobs = table(spark, base, "index_jobs")
    op = F.when(F.col("last_error_code") == "FileNotFound", DELETE).when(F.col("status") == "PENDING", REPLACE).otherwise(UPSERT)
    feed = jobs.select("dedupe_key", F.unix_micros("updated_at").alias("seq"), op.alias("op"), "status", "last_error_code", F.unix_micros("completed_at").alias("completed_us"))
    return apply_changes(feed, ["dedupe_key"], "seq", "op", ["status", "last_error_code", "completed_us"])


QUERIES = {"p1_found": p1_found, "p1_cycle": p1_cycle, "p4_found": p4_found, "p4_fields": p4_fields}

SQL = {
    "p1_found": """
WITH done AS (
  SELECT * FROM (
    SELECT s.*, row_number() OVER (PARTITION BY s.screenshot_id ORDER BY s.run_id DESC, s.recorded_at DESC NULLS LAST,
      s.file_size DESC NULLS LAST, s.modified_at_fs DESC NULLS LAST, s.content_hash DESC NULLS LAST, s.ocr_pipeline_version DESC NULLS LAST) AS rn
    FROM index_state s JOIN index_runs r ON r.run_id = s.run_id AND r.status = 'SUCCEEDED')
  WHERE rn = 1)
SELECT DISTINCT n.id AS screenshot_id
FROM screenshots n LEFT JOIN done o ON o.screenshot_id = n.id
WHERE o.screenshot_id IS NULL
   OR (n.content_hash IS NOT NULL AND o.content_hash IS NOT NULL AND n.content_hash <> o.content_hash)
   OR ((n.content_hash IS NULL OR o.content_hash IS NULL)
       AND (n.file_size IS DISTINCT FROM o.file_size
            OR CAST(n.modified_at_fs AS TIMESTAMPTZ) IS DISTINCT FROM CAST(o.modified_at_fs AS TIMESTAMPTZ)))
   OR n.ocr_pipeline_version IS DISTINCT FROM o.ocr_pipeline_version
""",
    "p4_found": r"""
WITH jobs AS (
  SELECT id, folder_id, upper(trim(job_type)) AS kind, dedupe_key, path FROM index_jobs
  WHERE upper(trim(job_type)) IN ('UPSERT_SCREENSHOT', 'DELETE_SCREENSHOT')
), parsed AS (
  SELECT id, folder_id, kind,
    replace(CASE WHEN kind = 'UPSERT_SCREENSHOT' THEN regexp_extract(dedupe_key, '^[^:]*:[^:]*:(.*):[^:]*$', 1)
                 ELSE regexp_extract(dedupe_key, '^[^:]*:[^:]*:(.*)$', 1) END, '/', '\') AS s,
    CASE WHEN kind = 'UPSERT_SCREENSHOT' THEN regexp_extract(dedupe_key, ':([^:]*)$', 1) END AS content_hash
  FROM jobs
), plain AS (
  SELECT *, CASE WHEN starts_with(s, '\\?\UNC\') THEN '\\' || s[9:]
                 WHEN starts_with(s, '\\?\') THEN s[5:] ELSE s END AS q
  FROM parsed
), keyed AS (
  SELECT *, CASE WHEN regexp_matches(q, '^[A-Za-z]:') THEN upper(q[1:1]) || q[2:] ELSE q END AS path FROM plain
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY folder_id, path ORDER BY id DESC, content_hash DESC) AS rn FROM keyed
)
SELECT folder_id, path, content_hash FROM ranked WHERE rn = 1 AND kind = 'UPSERT_SCREENSHOT'
""",
}
SQL["p1_cycle"] = f"SELECT screenshot_id, 0::BIGINT AS left_over FROM ({SQL['p1_found']})"
# each field's value comes from the greatest change that set it, among those after the last delete or replacement
SQL["p4_fields"] = """
WITH feed AS (SELECT DISTINCT dedupe_key, epoch_us(updated_at) AS seq, status, last_error_code, epoch_us(completed_at) AS completed_us,
    CASE WHEN last_error_code = 'FileNotFound' THEN 0 WHEN status = 'PENDING' THEN 1 ELSE 2 END AS r FROM index_jobs WHERE updated_at IS NOT NULL),
ranked AS (SELECT *, seq * 3 + r AS pos FROM feed),
bottom AS (SELECT *, max(CASE WHEN r < 2 THEN pos END) OVER (PARTITION BY dedupe_key) AS low, max(CASE WHEN r = 0 THEN pos END) OVER (PARTITION BY dedupe_key) AS gone,
    max(CASE WHEN r > 0 THEN pos END) OVER (PARTITION BY dedupe_key) AS alive FROM ranked),
live AS (SELECT * FROM bottom WHERE alive IS NOT NULL AND (gone IS NULL OR alive > gone) AND r > 0 AND (low IS NULL OR pos >= low))
SELECT dedupe_key, max(CASE WHEN sr = 1 THEN status END) AS status, max(CASE WHEN er = 1 THEN last_error_code END) AS last_error_code, max(CASE WHEN cr = 1 THEN completed_us END) AS completed_us
FROM (SELECT *, row_number() OVER (PARTITION BY dedupe_key ORDER BY CASE WHEN r = 1 OR status IS NOT NULL THEN pos END DESC NULLS LAST, status DESC NULLS LAST) AS sr,
    row_number() OVER (PARTITION BY dedupe_key ORDER BY CASE WHEN r = 1 OR last_error_code IS NOT NULL THEN pos END DESC NULLS LAST, last_error_code DESC NULLS LAST) AS er,
    row_number() OVER (PARTITION BY dedupe_key ORDER BY CASE WHEN r = 1 OR completed_us IS NOT NULL THEN pos END DESC NULLS LAST, completed_us DESC NULLS LAST) AS cr FROM live)
GROUP BY dedupe_key
"""
