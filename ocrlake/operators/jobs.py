"""The job queue as a table: every transition takes the table and gives its next version.

Claiming is done by one writer at a time, in batches. ``now`` is always passed in.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ocrlake.functions.text import embed_key, re_ocr_key, upsert_key
from ocrlake.operators.catalog import next_ids, re_process_eligible, vectors_of_model
from ocrlake.schema import EMBED_JOB, FAILED, PENDING, PROCESSING, RE_OCR_JOB, SUCCEEDED, UPSERT_JOB

MAX_ATTEMPTS = 5
# Fixed value: errors that no retry can mend
PERMANENT_ERRORS = ("FileNotFound",)


def _at(now: datetime) -> Column:
    return F.lit(now).cast("timestamp")


def enqueue(jobs: DataFrame, wanted: DataFrame, now: datetime, supersede: bool = True) -> DataFrame:
    """``jobs`` after a batch of wanted jobs (folder_id, screenshot_id, path, job_type, dedupe_key).

    A key that is pending or processing is left alone. Otherwise, with ``supersede``, other pending jobs of the same
    folder and path go (of any type), and the key's failed or done row is opened again (keeping its folder, path, type
    and creation time) or a new row is added. Of one key wanted twice, and with ``supersede`` of one path wanted by
    several keys, the greatest counts.
    """
    w = wanted.filter("dedupe_key is not null").groupBy("dedupe_key").agg(F.max(F.struct("folder_id", "path", "job_type", "screenshot_id")).alias("w")).select("dedupe_key", "w.*")
    active = jobs.filter(F.col("status").isin(PENDING, PROCESSING)).select("dedupe_key").distinct()
    w = w.join(active, "dedupe_key", "left_anti")
    if supersede:
        w = w.groupBy("folder_id", "path").agg(F.max(F.struct("dedupe_key", "job_type", "screenshot_id")).alias("w")).select("folder_id", "path", "w.*")
        over = w.select("folder_id", "path", F.col("dedupe_key").alias("_new"))
        hit = (F.col("j.folder_id") == F.col("o.folder_id")) & F.col("j.path").eqNullSafe(F.col("o.path")) & (F.col("j.dedupe_key") != F.col("o._new")) & (F.col("j.status") == PENDING)
        jobs = jobs.alias("j").join(over.alias("o"), hit, "left_anti")
    stamp = _at(now)
    again = w.select("dedupe_key", F.lit(True).alias("_open"), F.col("screenshot_id").alias("_sid"))
    opened = F.coalesce("_open", F.lit(False))
    old = jobs.join(again, "dedupe_key", "left")
    old = old.withColumns(
        {
            "status": F.when(opened, PENDING).otherwise(F.col("status")),
            "attempts": F.when(opened, F.lit(0)).otherwise(F.col("attempts")).cast("int"),
            "available_at": F.when(opened, stamp).otherwise(F.col("available_at")),
            "updated_at": F.when(opened, stamp).otherwise(F.col("updated_at")),
            "screenshot_id": F.when(opened, F.coalesce("_sid", "screenshot_id")).otherwise(F.col("screenshot_id")),
            **{c: F.when(~opened, F.col(c)) for c in ("lease_until", "last_error_code", "last_error_message", "completed_at")},
        }
    ).select(jobs.columns)
    fresh = next_ids(jobs, w.join(jobs.select("dedupe_key"), "dedupe_key", "left_anti"), ["dedupe_key"])
    fresh = fresh.withColumns({"status": F.lit(PENDING), "attempts": F.lit(0), "max_attempts": F.lit(MAX_ATTEMPTS), "available_at": stamp, "created_at": stamp, "updated_at": stamp})
    return old.unionByName(fresh, allowMissingColumns=True).select(jobs.columns)


def claimable(jobs: DataFrame, now: datetime, n: int = 1) -> DataFrame:
    """The n first jobs (by id) that are pending and due."""
    return jobs.filter((F.col("status") == PENDING) & (F.col("available_at") <= _at(now))).orderBy("id").limit(n)


def claim(jobs: DataFrame, now: datetime, n: int = 1, lease_seconds: int = 60) -> DataFrame:
    """``jobs`` with the n first due jobs processing, leased and counted as one more attempt."""
    picked = claimable(jobs, now, n).select("id", F.lit(True).alias("_hit"))
    hit = F.coalesce("_hit", F.lit(False))
    out = jobs.join(F.broadcast(picked), "id", "left")  # n rows
    return out.withColumns(
        {
            "status": F.when(hit, PROCESSING).otherwise(F.col("status")),
            "lease_until": F.when(hit, _at(now + timedelta(seconds=lease_seconds))).otherwise(F.col("lease_until")),
            "attempts": F.when(hit, F.col("attempts") + 1).otherwise(F.col("attempts")).cast("int"),
            "updated_at": F.when(hit, _at(now)).otherwise(F.col("updated_at")),
        }
    ).select(jobs.columns)


def _changed(jobs: DataFrame, outcome: DataFrame, fields: list[str]) -> tuple[DataFrame, Column]:
    o = outcome.select(F.col("id").alias("_id"), *(F.col(f).alias(f"_{f}") for f in fields))
    return jobs.join(o, jobs["id"] == F.col("_id"), "left"), F.col("_id").isNotNull()


def complete(jobs: DataFrame, done: DataFrame, now: datetime) -> DataFrame:
    """Jobs of ``done`` (id, screenshot_id) succeeded; a null item keeps the one on record."""
    out, hit = _changed(jobs, done, ["screenshot_id"])
    return out.withColumns(
        {
            "status": F.when(hit, SUCCEEDED).otherwise(F.col("status")),
            "screenshot_id": F.when(hit, F.coalesce("_screenshot_id", "screenshot_id")).otherwise(F.col("screenshot_id")),
            "lease_until": F.when(~hit, F.col("lease_until")),
            "completed_at": F.when(hit, _at(now)).otherwise(F.col("completed_at")),
            "updated_at": F.when(hit, _at(now)).otherwise(F.col("updated_at")),
        }
    ).select(jobs.columns)


def backoff_seconds(attempts: Column) -> Column:
    """2, 4, 8, 16, 32 seconds by attempts made, 60 at most."""
    return F.least(F.pow(F.lit(2), F.least(attempts, F.lit(5))), F.lit(60)).cast("long")


def is_permanent(code: Column) -> Column:
    return code.isin(*PERMANENT_ERRORS)


def retry_or_fail(jobs: DataFrame, errors: DataFrame, now: datetime) -> DataFrame:
    """Jobs of ``errors`` (id, code, message): failed if the error is permanent or attempts are used up, else pending later."""
    out, hit = _changed(jobs, errors, ["code", "message"])
    dead = hit & (F.coalesce(is_permanent(F.col("_code")), F.lit(False)) | (F.col("attempts") >= F.col("max_attempts")))
    later = F.timestamp_seconds(F.unix_timestamp(_at(now)) + backoff_seconds(F.col("attempts")))
    return out.withColumns(
        {
            "status": F.when(dead, FAILED).when(hit, PENDING).otherwise(F.col("status")),
            "available_at": F.when(hit & ~dead, later).otherwise(F.col("available_at")),
            "lease_until": F.when(~hit, F.col("lease_until")),
            "last_error_code": F.when(hit, F.col("_code")).otherwise(F.col("last_error_code")),
            "last_error_message": F.when(hit, F.col("_message")).otherwise(F.col("last_error_message")),
            "updated_at": F.when(hit, _at(now)).otherwise(F.col("updated_at")),
        }
    ).select(jobs.columns)


def recover_stale(jobs: DataFrame, now: datetime) -> DataFrame:
    """Processing jobs without a lease, or with one that ran out, are pending again."""
    stale = (F.col("status") == PROCESSING) & (F.col("lease_until").isNull() | (F.col("lease_until") < _at(now)))
    stale = F.coalesce(stale, F.lit(False))
    return jobs.withColumns({"status": F.when(stale, PENDING).otherwise(F.col("status")), "lease_until": F.when(~stale, F.col("lease_until")), "updated_at": F.when(stale, _at(now)).otherwise(F.col("updated_at"))})


def expire(jobs: DataFrame, now: datetime, hours: int = 24) -> DataFrame:
    """``jobs`` without succeeded ones that ended more than ``hours`` ago; failed ones never expire."""
    old = (F.col("status") == SUCCEEDED) & (F.col("completed_at") < _at(now - timedelta(hours=hours)))
    return jobs.filter(~F.coalesce(old, F.lit(False)))


def retry_all_failed(jobs: DataFrame, now: datetime) -> DataFrame:
    failed = F.coalesce(F.col("status") == FAILED, F.lit(False))
    return jobs.withColumns(
        {
            "status": F.when(failed, PENDING).otherwise(F.col("status")),
            "attempts": F.when(failed, F.lit(0)).otherwise(F.col("attempts")).cast("int"),
            "available_at": F.when(failed, _at(now)).otherwise(F.col("available_at")),
            "lease_until": F.when(~failed, F.col("lease_until")),
            "last_error_code": F.when(~failed, F.col("last_error_code")),
            "last_error_message": F.when(~failed, F.col("last_error_message")),
            "updated_at": F.when(failed, _at(now)).otherwise(F.col("updated_at")),
        }
    )


# -------------------------------------------------------------------------------------- items as work to do


def pending_items(items: DataFrame, folder_id: int | None = None, limit: int = 500) -> DataFrame:
    rows = items.filter(F.col("ocr_status") == PENDING)
    rows = rows if folder_id is None else rows.filter(F.col("folder_id") == folder_id)
    return rows.orderBy("id").limit(limit)


def claim_items(items: DataFrame, ids: DataFrame) -> DataFrame:
    """Items of ``ids`` (id) that are pending become processing."""
    out = items.join(ids.select(F.col("id").alias("_id")).distinct(), items["id"] == F.col("_id"), "left")
    hit = F.col("_id").isNotNull() & (F.col("ocr_status") == PENDING)
    return out.withColumn("ocr_status", F.when(hit, PROCESSING).otherwise(F.col("ocr_status"))).select(items.columns)


def recover_items(items: DataFrame) -> DataFrame:
    return items.withColumn("ocr_status", F.when(F.col("ocr_status") == PROCESSING, PENDING).otherwise(F.col("ocr_status")))


# ------------------------------------------------------------------------------------------------ job makers


def missing_embeddings(items: DataFrame, vectors: DataFrame, model_id: str, model_version: str) -> DataFrame:
    """Processed items without a vector of this model and version."""
    have = vectors_of_model(vectors, model_id, model_version).select(F.col("screenshot_id").alias("id"))
    return items.filter(F.col("ocr_status") == SUCCEEDED).join(have, "id", "left_anti")


def embedding_jobs(items: DataFrame, vectors: DataFrame, model_id: str, model_version: str) -> DataFrame:
    rows = missing_embeddings(items, vectors, model_id, model_version)
    return rows.select("folder_id", F.col("id").alias("screenshot_id"), "path", F.lit(EMBED_JOB).alias("job_type"), embed_key(F.col("id"), F.col("content_hash"), model_version).alias("dedupe_key"))


def scan_jobs(items: DataFrame, folder_id: int | None = None) -> DataFrame:
    """Jobs for all pending items (of a folder), as after a scan; failed items are not asked for again."""
    rows = items.filter(F.col("ocr_status") == PENDING)
    rows = rows if folder_id is None else rows.filter(F.col("folder_id") == folder_id)
    return rows.select("folder_id", F.col("id").alias("screenshot_id"), "path", F.lit(UPSERT_JOB).alias("job_type"), upsert_key(F.col("folder_id"), F.col("path"), F.col("content_hash")).alias("dedupe_key"))


def re_process_jobs(items: DataFrame, target: str, limit: int = 10_000) -> DataFrame:
    rows = re_process_eligible(items, target).orderBy("id").limit(limit)
    return rows.select("folder_id", F.col("id").alias("screenshot_id"), "path", F.lit(RE_OCR_JOB).alias("job_type"), re_ocr_key(F.col("id"), F.col("content_hash"), F.lit(target)).alias("dedupe_key"))


JOB_ORDER = ("updated_at", "attempts", "status", "completed_at", "lease_until")


def current_jobs(jobs: DataFrame) -> DataFrame:
    """Jobs once per id, as delivered last (by update time, attempts, status)."""
    order = F.struct(*JOB_ORDER, F.xxhash64(*jobs.columns))
    return jobs.groupBy(F.col("id").alias("_key")).agg(F.max_by(F.struct(*jobs.columns), order).alias("r")).select("r.*")


def first_claimable_per_folder(jobs: DataFrame, now: datetime) -> DataFrame:
    """The next job of each folder."""
    due = jobs.filter((F.col("status") == PENDING) & (F.col("available_at") <= _at(now)))
    return due.groupBy(F.col("folder_id").alias("_f")).agg(F.min_by(F.struct(*due.columns), "id").alias("r")).select("r.*")
