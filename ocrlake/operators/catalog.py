"""Catalog of folders, items and vectors: look-ups, aggregates, and changes as new versions of the tables.

Every change takes state DataFrames and gives state DataFrames; writing them is the caller's business (one writer, new
version, then switch). ``now`` is always passed in.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ocrlake.functions.paths import extension, file_name
from ocrlake.functions.ranks import row_numbers
from ocrlake.functions.text import delete_key
from ocrlake.schema import FAILED, PENDING, PROCESSING, SUCCEEDED, EngineError

STATUSES = (PENDING, PROCESSING, SUCCEEDED, FAILED)


def latest_rows(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row per key: the last by ``order``. For tables whose rows are delivered more than once."""
    best = F.max_by(F.struct(*rows.columns), F.struct(*order))
    return rows.groupBy(F.col(key).alias("_key")).agg(best.alias("r")).select("r.*")


def distinct_items(rows: DataFrame) -> DataFrame:
    """Items once per id: the version updated last, then the greatest row."""
    return latest_rows(rows, "id", [F.col("updated_at"), F.xxhash64(*rows.columns)])


# ------------------------------------------------------------------------------------------------- look-ups


def items_of_folder(items: DataFrame, folder_id: int) -> DataFrame:
    return items.filter(F.col("folder_id") == folder_id)


def item_by_id(items: DataFrame, item_id: int) -> DataFrame:
    return items.filter(F.col("id") == item_id)


def item_by_path(items: DataFrame, path: str) -> DataFrame:
    return items.filter(F.col("path") == path)


# What the detail of an item, and an item waiting for its text, show
DETAIL_COLUMNS = (
    "id", "folder_id", "path", "filename", "extension", "file_size", "modified_at_fs", "content_hash", "width", "height", "ocr_text", "ocr_status",
    "ocr_engine", "ocr_engine_version", "ocr_language", "ocr_pipeline_version", "indexed_at",
)
PENDING_COLUMNS = ("id", "folder_id", "path", "filename", "extension")


def item_detail(items: DataFrame, item_id: int) -> DataFrame:
    return item_by_id(items, item_id).select(*DETAIL_COLUMNS)


def hydrated(page: DataFrame, items: DataFrame) -> DataFrame:
    """A page of search results with all that it shows of an item: the page's columns, hash, width and height too.

    A page has at most the greatest page size of rows, so it is broadcast.
    """
    facts = items.select("id", "content_hash", "width", "height")
    return facts.join(F.broadcast(page), "id").select(*page.columns, "content_hash", "width", "height")


def newest_by_hash(items: DataFrame) -> DataFrame:
    """(folder_id, content_hash, id, path): the newest item of each folder and known hash."""
    known = items.filter(F.col("content_hash").isNotNull())
    return known.groupBy("folder_id", "content_hash").agg(F.max(F.struct("id", "path")).alias("m")).select("folder_id", "content_hash", "m.id", "m.path")


def folder_by_path(folders: DataFrame, path: str) -> DataFrame:
    """Folders with this path in any (ASCII) case."""
    return folders.filter(F.lower("path") == path.lower())


def vectors_of_model(vectors: DataFrame, model_id: str, model_version: str) -> DataFrame:
    return vectors.filter((F.col("model_id") == model_id) & (F.col("model_version") == model_version))


# ------------------------------------------------------------------------------------------------ aggregates


def _count(condition: Column, name: str) -> Column:
    return F.count_if(condition).alias(name)


def status_counts(items: DataFrame) -> DataFrame:
    """One row: total, pending, processing, succeeded, failed."""
    return items.agg(F.count("*").alias("total"), *(_count(F.col("ocr_status") == s, s.lower()) for s in STATUSES))


def folder_counts(folders: DataFrame, items: DataFrame) -> DataFrame:
    """Folders with the number of their items and of processed ones; items are counted before the join."""
    n = items.groupBy("folder_id").agg(F.count("*").alias("item_count"), _count(F.col("ocr_status") == SUCCEEDED, "indexed_count"))
    joined = folders.join(n, folders["id"] == n["folder_id"], "left").drop("folder_id")
    return joined.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("item_count", "indexed_count")})


def job_counts(jobs: DataFrame) -> DataFrame:
    """One row: jobs by status; other statuses count in the total only."""
    return jobs.agg(F.count("*").alias("total"), *(_count(F.col("status") == s, s.lower()) for s in STATUSES))


def embedding_coverage(items: DataFrame, vectors: DataFrame, model_id: str, model_version: str) -> DataFrame:
    """One row: processed items, vectors of the model, and how many are missing (0 at least)."""
    a = items.agg(_count(F.col("ocr_status") == SUCCEEDED, "s"), F.lit(0).cast("long").alias("e"))
    b = vectors_of_model(vectors, model_id, model_version).agg(F.lit(0).cast("long").alias("s"), F.count("*").alias("e"))
    both = a.union(b).agg(F.sum("s").alias("succeeded"), F.sum("e").alias("embedded"))
    return both.withColumn("pending", F.greatest(F.col("succeeded") - F.col("embedded"), F.lit(0).cast("long")))


def re_process_eligible(items: DataFrame, target: str) -> DataFrame:
    """Processed items whose pipeline is not the target (null is not)."""
    return items.filter((F.col("ocr_status") == SUCCEEDED) & ~F.col("ocr_pipeline_version").eqNullSafe(F.lit(target)))


def engine_diagnostics(items: DataFrame, target: str) -> DataFrame:
    """One row over processed items: total, by engine name (any case), current and outdated pipeline."""
    done = items.filter(F.col("ocr_status") == SUCCEEDED)
    current = F.col("ocr_pipeline_version").eqNullSafe(F.lit(target))
    return done.agg(
        F.count("*").alias("total"),
        _count(F.col("ocr_engine").ilike("%windows%"), "windows"),
        _count(F.col("ocr_engine").ilike("%multilingual%"), "multilingual"),
        _count(current, "current"),
        _count(~current, "outdated"),
    )


def text_digests(rows: DataFrame) -> DataFrame:
    """(id, text_hash, updated_at) of item rows; null for blank texts. Texts go no further than this."""
    return rows.select("id", F.when(F.trim("ocr_text") != "", F.sha2("ocr_text", 256)).alias("text_hash"), "updated_at")


def duplicate_texts(digests: DataFrame) -> DataFrame:
    """(text_hash, copies, first_id, last_id) of texts that several items (id, text_hash) share, blank ones aside."""
    rows = digests.filter("text_hash is not null")
    return rows.groupBy("text_hash").agg(F.count("*").alias("copies"), F.min("id").alias("first_id"), F.max("id").alias("last_id")).filter("copies > 1")


def duplicate_members(digests: DataFrame) -> DataFrame:
    """(text_hash, id) of every item whose text another item has too."""
    return digests.join(duplicate_texts(digests).select("text_hash"), "text_hash", "left_semi").select("text_hash", "id")


def service_status(items: DataFrame, jobs: DataFrame, vectors: DataFrame, model_id: str, model_version: str, watched: int = 0) -> DataFrame:
    """One long table (area, name, value) of item, job and vector counts."""
    parts = []
    for area, df in (("items", status_counts(items)), ("jobs", job_counts(jobs)), ("vectors", embedding_coverage(items, vectors, model_id, model_version))):
        names = ", ".join(f"'{c}', {c}" for c in df.columns)
        parts.append(df.select(F.lit(area).alias("area"), F.expr(f"stack({len(df.columns)}, {names}) AS (name, value)")))
    watch = items.sparkSession.createDataFrame([("watchers", "folders", watched)], "area string, name string, value long")
    return parts[0].union(parts[1]).union(parts[2]).union(watch)


# --------------------------------------------------------------------------------------------------- changes


def insert_folder(folders: DataFrame, path: str, now: datetime, recursive: bool = True) -> DataFrame:
    """``folders`` with a new enabled folder; a path that is there in any (ASCII) case is an error."""
    if folder_by_path(folders, path).head(1):
        raise EngineError("FOLDER_ALREADY_EXISTS", path)
    stamp = F.lit(now).cast("timestamp")
    new = folders.sparkSession.createDataFrame([(path, 1, int(recursive))], "path string, enabled int, is_recursive int")
    new = next_ids(folders, new, ["path"]).withColumns({"created_at": stamp, "updated_at": stamp})
    return folders.unionByName(new, allowMissingColumns=True)


def rename_items(renames: DataFrame, items: DataFrame, jobs: DataFrame, now: datetime) -> tuple[DataFrame, DataFrame]:
    """Items of ``renames`` (folder_id, old_path, new_path) under their new path, name and extension, and the jobs without
    delete jobs for the old paths, in any status. Id, time, hash, text and vector of an item stay.

    A path renamed twice goes to the greatest new path.
    """
    r = renames.groupBy("folder_id", F.col("old_path").alias("path")).agg(F.max("new_path").alias("_new"))
    out = items.join(r, ["folder_id", "path"], "left")
    moved, new = F.col("_new").isNotNull(), F.col("_new")
    values = {"path": F.coalesce("_new", "path"), "filename": F.when(moved, file_name(new)).otherwise(F.col("filename")), "extension": F.when(moved, extension(new)).otherwise(F.col("extension"))}
    values |= {"updated_at": F.when(moved, F.lit(now).cast("timestamp")).otherwise(F.col("updated_at"))}
    gone = r.select(delete_key(F.col("folder_id"), F.col("path")).alias("dedupe_key"))
    return out.withColumns(values).select(items.columns), jobs.join(gone, "dedupe_key", "left_anti").select(jobs.columns)


def vector_of_item(vectors: DataFrame, item_id: int) -> DataFrame:
    return vectors.filter(F.col("screenshot_id") == item_id)


def delete_vectors(vectors: DataFrame, ids: DataFrame) -> DataFrame:
    """``vectors`` without those of ``ids`` (id)."""
    return vectors.join(ids.select(F.col("id").alias("screenshot_id")), "screenshot_id", "left_anti").select(vectors.columns)


def clear_vectors(vectors: DataFrame, model_id: str) -> DataFrame:
    """``vectors`` without those of a model, whatever its version."""
    return vectors.filter(~F.col("model_id").eqNullSafe(F.lit(model_id)))


def next_ids(state: DataFrame, rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ids after the greatest of ``state``, in the given order."""
    top = state.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first()["m"]
    return row_numbers(rows, order, "id").withColumn("id", F.col("id") + F.lit(top))


def insert_items(items: DataFrame, found: DataFrame, now: datetime) -> DataFrame:
    """``items`` with new pending items from ``found`` (folder_id, path, filename, extension, file_size, modified_at_fs, content_hash)."""
    new = next_ids(items, found, ["path"])
    stamp = F.lit(now).cast("timestamp")
    new = new.withColumns({"ocr_status": F.lit(PENDING), "created_at": stamp, "updated_at": stamp})
    return items.unionByName(new, allowMissingColumns=True)


def _replaced(state: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    return state.join(changed.select(key), key, "left_anti").unionByName(changed.select(state.columns))


def save_text(items: DataFrame, results: DataFrame, now: datetime) -> DataFrame:
    """``items`` with results (id, ocr_text, ocr_engine, ocr_engine_version, ocr_language, ocr_pipeline_version) written in."""
    fields = ["ocr_text", "ocr_engine", "ocr_engine_version", "ocr_language", "ocr_pipeline_version"]
    r = results.select(F.col("id").alias("_id"), *(F.col(f).alias(f"_{f}") for f in fields))
    hit = F.col("_id").isNotNull()
    stamp = F.lit(now).cast("timestamp")
    out = items.join(r, items["id"] == F.col("_id"), "left")
    values = {f: F.when(hit, F.col(f"_{f}")).otherwise(F.col(f)) for f in fields}
    values |= {"ocr_status": F.when(hit, SUCCEEDED).otherwise(F.col("ocr_status"))}
    values |= {c: F.when(hit, stamp).otherwise(F.col(c)) for c in ("indexed_at", "updated_at")}
    return out.withColumns(values).select(items.columns)


def replace_text(items: DataFrame, vectors: DataFrame, results: DataFrame, now: datetime) -> tuple[DataFrame, DataFrame]:
    """New text and, from the same results, vectors without those of the items concerned."""
    gone = results.select(F.col("id").alias("screenshot_id"))
    return save_text(items, results, now), vectors.join(gone, "screenshot_id", "left_anti")


def reset_changed(items: DataFrame, changed: DataFrame, now: datetime) -> DataFrame:
    """Items whose content changed (id, file_size, modified_at_fs, content_hash): new file facts, no text, pending."""
    c = changed.select(F.col("id").alias("_id"), *(F.col(f).alias(f"_{f}") for f in ("file_size", "modified_at_fs", "content_hash")))
    hit = F.col("_id").isNotNull()
    out = items.join(c, items["id"] == F.col("_id"), "left")
    values = {f: F.when(hit, F.col(f"_{f}")).otherwise(F.col(f)) for f in ("file_size", "modified_at_fs", "content_hash")}
    values |= {"ocr_text": F.when(~hit, F.col("ocr_text")), "ocr_status": F.when(hit, PENDING).otherwise(F.col("ocr_status"))}
    values |= {"updated_at": F.when(hit, F.lit(now).cast("timestamp")).otherwise(F.col("updated_at"))}
    return out.withColumns(values).select(items.columns)


def mark_failed(items: DataFrame, ids: DataFrame, now: datetime) -> DataFrame:
    """Items of ``ids`` (id) as failed; their old text stays, searches go by status."""
    hit = F.col("_id").isNotNull()
    out = items.join(ids.select(F.col("id").alias("_id")), items["id"] == F.col("_id"), "left")
    values = {"ocr_status": F.when(hit, FAILED).otherwise(F.col("ocr_status")), "updated_at": F.when(hit, F.lit(now).cast("timestamp")).otherwise(F.col("updated_at"))}
    return out.withColumns(values).select(items.columns)


def upsert_vectors(vectors: DataFrame, new: DataFrame) -> DataFrame:
    """One vector per item, whatever the model: new ones replace old ones."""
    return _replaced(vectors, new, "screenshot_id")


def delete_items(ids: DataFrame, items: DataFrame, vectors: DataFrame, jobs: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Items, vectors and jobs without those of ``ids`` (id); jobs without an item stay."""
    gone = ids.select(F.col("id").alias("screenshot_id"))
    left_jobs = None if jobs is None else jobs.join(gone, "screenshot_id", "left_anti").select(jobs.columns)
    return items.join(ids.select("id"), "id", "left_anti").select(items.columns), vectors.join(gone, "screenshot_id", "left_anti").select(vectors.columns), left_jobs


def delete_folder(folder_id: int, folders: DataFrame, items: DataFrame, vectors: DataFrame, jobs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """All four tables without the folder and what belongs to it, jobs in any status included."""
    own = items.filter(F.col("folder_id") == folder_id).select(F.col("id").alias("screenshot_id"))
    return (
        folders.filter(F.col("id") != folder_id),
        items.filter(~F.col("folder_id").eqNullSafe(F.lit(folder_id))),
        vectors.join(own, "screenshot_id", "left_anti").select(vectors.columns),
        jobs.filter(~F.col("folder_id").eqNullSafe(F.lit(folder_id))),
    )


def touch_scanned(folders: DataFrame, folder_id: int, now: datetime) -> DataFrame:
    return folders.withColumn("last_scanned_at", F.when(F.col("id") == folder_id, F.lit(now).cast("timestamp")).otherwise(F.col("last_scanned_at")))
