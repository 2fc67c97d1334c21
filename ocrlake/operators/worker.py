"""Index jobs carried out in batches: each handler takes the claimed jobs and gives new state and outcomes of its kind.

What is on disk comes in as a table ``disk`` (path, file_size, modified_at_fs, content_hash, error_code): one row for every
path that was looked at; a path without a row, or with the code FileNotFound, is not there, another code means that it
could not be read. An engine comes in as ``read``, from (id, path) to the rows of ``extract.recognise``; an embedding as a
column function. Handlers keep the order of the queue out of the result: a path is handled once per batch.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ocrlake.functions.paths import extension, file_name
from ocrlake.functions.text import embed_key, normalize_ocr_text, re_ocr_target_pipeline, semantic_document
from ocrlake.operators import catalog as cat
from ocrlake.operators import jobs as jb
from ocrlake.schema import DELETE_JOB, EMBED_JOB, PROCESSING, RE_OCR_JOB, SUCCEEDED, UPSERT_JOB
from ocrlake.session import cut

NOT_FOUND, NOT_READY = "FileNotFound", "OCR_ENGINE_UNAVAILABLE"
OUTCOME = "id long, screenshot_id long, code string, message string"


@dataclass(frozen=True)
class State:
    """The tables that jobs change."""

    items: DataFrame
    vectors: DataFrame
    jobs: DataFrame


@dataclass(frozen=True)
class Embedding:
    """A model for texts: names, and the vector of a column of documents."""

    model_id: str
    model_version: str
    of: Callable[[Column], Column]


@dataclass(frozen=True)
class Handled:
    """New state, what became of each job, and which items' index rows are no longer right (id)."""

    state: State
    outcomes: DataFrame
    touched: DataFrame


def _outcome(rows: DataFrame, screenshot: str | None = None, code: Column | None = None) -> DataFrame:
    code = F.lit(None).cast("string") if code is None else code
    item = F.lit(None).cast("long") if screenshot is None else F.col(screenshot).cast("long")
    return rows.select(F.col("job_id").alias("id"), item.alias("screenshot_id"), code.alias("code"), F.when(code.isNotNull(), F.concat_ws(" ", code, F.col("path"))).alias("message"))


def _claimed(mine: DataFrame, kind: str) -> DataFrame:
    """Claimed jobs of a kind."""
    own = mine.filter((F.upper(F.trim("job_type")) == kind) & (F.col("status") == PROCESSING))
    return own.select(F.col("id").alias("job_id"), "folder_id", F.col("screenshot_id").alias("job_item"), "path", "dedupe_key")


def _on_disk(disk: DataFrame) -> DataFrame:
    return disk.select(F.col("path").alias("_p"), *(F.col(c).alias(f"_{c}") for c in ("file_size", "modified_at_fs", "content_hash", "error_code")))


def _look(rows: DataFrame, disk: DataFrame) -> DataFrame:
    """``rows`` (path) with what is on disk and ``missing``: the error code of a path that is not there or unreadable."""
    seen = rows.join(_on_disk(disk), F.col("path") == F.col("_p"), "left")
    return seen.withColumn("missing", F.when(F.col("_p").isNull(), NOT_FOUND).otherwise(F.col("_error_code"))).drop("_p", "_error_code")


def _item_of_path(items: DataFrame) -> DataFrame:
    """One item per path: the newest."""
    fields = ("id", "file_size", "modified_at_fs", "content_hash", "ocr_status")
    best = items.groupBy("path").agg(F.max(F.struct(*fields)).alias("m"))
    return best.select(F.col("path").alias("_item_path"), *(F.col(f"m.{c}").alias(f"item_{c}") for c in fields))


def _save(state: State, read: DataFrame, now: datetime) -> tuple[State, DataFrame]:
    """State with recognised texts (cleaned up) written in and failures marked; and the rows that failed."""
    ok = read.filter("error_code is null")
    pipeline = F.concat_ws(":", "ocr_engine", "ocr_engine_version")
    results = ok.select("id", normalize_ocr_text(F.col("ocr_text")).alias("ocr_text"), "ocr_engine", "ocr_engine_version", "ocr_language", pipeline.alias("ocr_pipeline_version"))
    failed = read.filter("error_code is not null")
    return replace(state, items=cat.mark_failed(cat.save_text(state.items, results, now), failed.select("id"), now)), failed


def _embed_jobs(rows: DataFrame, embedding: Embedding | None) -> DataFrame:
    """Jobs for the vectors of items (id, folder_id, path, content_hash)."""
    if embedding is None:
        rows = rows.limit(0)
    version = embedding.model_version if embedding else ""
    return rows.select("folder_id", F.col("id").alias("screenshot_id"), "path", F.lit(EMBED_JOB).alias("job_type"), embed_key(F.col("id"), F.col("content_hash"), version).alias("dedupe_key"))


def handle_upserts(state: State, mine: DataFrame, disk: DataFrame, read: Callable[[DataFrame], DataFrame], now: datetime, embedding: Embedding | None = None) -> Handled:
    """UPSERT jobs: a file that is as recorded keeps its text (and is read if it has none); a changed one loses text and
    vector and is read again; an unknown one takes over the newest item of its folder with the same hash whose own file is
    gone (a rename), else becomes a new item. A file that is not there is a permanent error.
    """
    jobs = cut(_look(_claimed(mine, UPSERT_JOB), disk).join(_item_of_path(state.items), F.col("path") == F.col("_item_path"), "left"))
    absent = jobs.filter("missing is not null")
    # one job per path carries the work; the others share its outcome
    files = jobs.filter("missing is null").dropDuplicates(["path"])
    known = F.col("item_id").isNotNull()
    same = F.col("item_file_size").eqNullSafe(F.col("_file_size")) & F.col("item_modified_at_fs").eqNullSafe(F.col("_modified_at_fs")) & (F.col("item_content_hash") == F.col("_content_hash"))
    files = files.withColumn("same", F.coalesce(same, F.lit(False)))
    facts = [F.col(f"_{c}").alias(c) for c in ("file_size", "modified_at_fs", "content_hash")]

    changed = files.filter(known & ~F.col("same")).select(F.col("item_id").alias("id"), *facts)
    fresh = files.filter(~known)
    gone = _look(state.items.filter("content_hash is not null").select("id", "folder_id", "path", "content_hash"), disk).filter(F.col("missing") == NOT_FOUND)
    newest = gone.groupBy("folder_id", F.col("content_hash").alias("_content_hash")).agg(F.max(F.struct("id", "path")).alias("m"))
    # of several new files with one hash the least path takes the item over
    taker = fresh.groupBy("folder_id", "_content_hash").agg(F.min("path").alias("new_path"))
    renames = cut(newest.join(taker, ["folder_id", "_content_hash"]).select("folder_id", F.col("m.id").alias("id"), F.col("m.path").alias("old_path"), "new_path"))
    added = fresh.join(renames.select("folder_id", F.col("new_path").alias("path")), ["folder_id", "path"], "left_anti")
    added = added.select("folder_id", "path", file_name(F.col("path")).alias("filename"), extension(F.col("path")).alias("extension"), *facts)

    items = cat.reset_changed(state.items, changed, now)
    items, left_jobs = cat.rename_items(renames, items, state.jobs, now)
    items = cut(cat.insert_items(items, added, now))
    moved = State(items, cat.delete_vectors(state.vectors, changed), left_jobs)

    # whatever has no text now is read
    own = files.select("job_id", "path").join(items.select(F.col("path"), "id", "folder_id", "content_hash", "ocr_status"), "path").groupBy("path").agg(F.max(F.struct("id", "folder_id", "content_hash", "ocr_status")).alias("m"))
    own = cut(own.select("path", "m.*"))
    todo = own.filter(F.col("ocr_status") != SUCCEEDED)
    got = cut(read(todo.select("id", "path")))
    saved, failed = _save(moved, got, now)
    errors = failed.select("path", "error_code")
    done = jobs.filter("missing is null").select("job_id", "path").join(own.select("path", "id"), "path").join(errors, "path", "left")
    outcomes = _outcome(absent, None, F.col("missing")).union(_outcome(done, "id", F.col("error_code")))
    embed = _embed_jobs(todo.join(errors, "path", "left_anti"), embedding)
    saved = replace(saved, jobs=jb.enqueue(saved.jobs, embed, now, supersede=False))
    touched = own.select("id").union(changed.select("id"))
    return Handled(saved, outcomes, touched.distinct())


def handle_deletes(state: State, mine: DataFrame, disk: DataFrame) -> Handled:
    """DELETE jobs: a file that is surely gone takes its item and vector with it; one that is still there leaves them; one
    that cannot be looked at is an error to retry."""
    jobs = cut(_look(_claimed(mine, DELETE_JOB), disk))
    gone = jobs.filter(F.col("missing") == NOT_FOUND).select("path").distinct()
    ids = cut(state.items.join(gone, "path", "left_semi").select("id"))
    items, vectors, _ = cat.delete_items(ids, state.items, state.vectors)
    code = F.when(F.col("missing") != NOT_FOUND, F.col("missing"))
    return Handled(State(items, vectors, state.jobs), _outcome(jobs, None, code), ids)


def _job_items(state: State, mine: DataFrame, kind: str) -> DataFrame:
    """Claimed jobs with their item: the one they name, else the newest of their path; ``id`` is null where there is none."""
    jobs = _claimed(mine, kind).join(_item_of_path(state.items).select("_item_path", "item_id"), F.col("path") == F.col("_item_path"), "left")
    jobs = jobs.withColumn("_want", F.coalesce("job_item", "item_id")).drop("_item_path", "item_id", "folder_id")
    facts = state.items.select("id", "folder_id", "filename", "content_hash", "ocr_status", "ocr_text")
    return jobs.join(facts, F.col("_want") == F.col("id"), "left").drop("_want")


def handle_embeddings(state: State, mine: DataFrame, embedding: Embedding | None, now: datetime) -> Handled:
    """EMBED jobs: the vector of an item with text; one whose text is not ready is passed over, one that is not there is a
    permanent error; without a model every job is retried later."""
    rows = cut(_job_items(state, mine, EMBED_JOB))
    if embedding is None:
        return Handled(state, _outcome(rows, None, F.lit("MODEL_UNAVAILABLE")), rows.select("id").limit(0))
    ready = rows.filter(F.col("ocr_status") == SUCCEEDED).dropDuplicates(["id"])
    text = semantic_document(F.col("filename"), F.col("ocr_text"))
    new = ready.select(F.col("id").alias("screenshot_id"), F.lit(embedding.model_id).alias("model_id"), F.lit(embedding.model_version).alias("model_version"), embedding.of(text).alias("embedding"), F.lit(now).cast("timestamp").alias("created_at"))
    code = F.when(F.col("id").isNull(), NOT_FOUND)
    return Handled(replace(state, vectors=cat.upsert_vectors(state.vectors, new)), _outcome(rows, "id", code), rows.select("id").limit(0))


def handle_re_ocr(state: State, mine: DataFrame, disk: DataFrame, read: Callable[[DataFrame], DataFrame], pipeline: str, now: datetime, embedding: Embedding | None = None) -> Handled:
    """RE_OCR jobs: new text by the pipeline the job names, which must be the active one before and after; old text and
    vector stay until the new text is there, and whenever anything fails."""
    rows = cut(_look(_job_items(state, mine, RE_OCR_JOB).withColumn("target", re_ocr_target_pipeline(F.col("dedupe_key"))), disk))
    code = F.coalesce(F.col("missing"), F.when(F.col("id").isNull(), NOT_FOUND), F.when(F.col("target") != pipeline, NOT_READY))
    rows = rows.withColumn("code", code)
    got = cut(read(rows.filter("code is null").select("id", "path").dropDuplicates(["id"])))
    made = F.concat_ws(":", "ocr_engine", "ocr_engine_version")
    read_back = got.select(F.col("id").alias("_rid"), "error_code", made.alias("made"), "ocr_text", "ocr_engine", "ocr_engine_version", "ocr_language")
    rows = cut(rows.drop("ocr_text").join(read_back, F.col("id") == F.col("_rid"), "left"))
    late = F.when(F.col("target").isNotNull() & (F.col("target") != F.col("made")), NOT_READY)
    final = F.coalesce(F.col("code"), F.col("error_code"), late)
    good = rows.filter(final.isNull()).dropDuplicates(["id"])
    results = good.select("id", normalize_ocr_text(F.col("ocr_text")).alias("ocr_text"), "ocr_engine", "ocr_engine_version", "ocr_language", F.col("made").alias("ocr_pipeline_version"))
    items, vectors = cat.replace_text(state.items, state.vectors, results, now)
    embed = _embed_jobs(good.select("id", "folder_id", "path", F.coalesce("content_hash", F.lit("")).alias("content_hash")), embedding)
    return Handled(State(items, vectors, jb.enqueue(state.jobs, embed, now, supersede=False)), _outcome(rows, "id", final), good.select("id"))


def start(state: State, now: datetime) -> State:
    """What a worker does first: jobs whose lease ran out are pending again, old succeeded ones expire."""
    return replace(state, jobs=jb.expire(jb.recover_stale(state.jobs, now), now))


def run_batch(state: State, disk: DataFrame, read: Callable[[DataFrame], DataFrame], pipeline: str, now: datetime, embedding: Embedding | None = None, n: int = 100, lease_seconds: int = 60) -> Handled:
    """One turn of the worker: claim the n first due jobs, carry them out by kind, complete or retry them.

    Vector jobs that the texts of this batch ask for wait for the next turn. Jobs of unknown kind fail as any other error.
    """
    mine = cut(jb.claimable(state.jobs, now, n).select("id"))
    state = replace(state, jobs=cut(jb.claim(state.jobs, now, n, lease_seconds)))
    mine = cut(state.jobs.join(mine, "id", "left_semi"))
    outcomes, touched = [], []
    for handle in (
        lambda s: handle_upserts(s, mine, disk, read, now, embedding),
        lambda s: handle_deletes(s, mine, disk),
        lambda s: handle_re_ocr(s, mine, disk, read, pipeline, now, embedding),
        lambda s: handle_embeddings(s, mine, embedding, now),
    ):
        h = handle(state)
        outcomes.append(cut(h.outcomes))
        touched.append(cut(h.touched))
        state = State(cut(h.state.items), cut(h.state.vectors), cut(h.state.jobs))
    known = reduce(DataFrame.union, outcomes)
    other = mine.join(known.select("id"), "id", "left_anti").select("id", F.lit(None).cast("long").alias("screenshot_id"), F.lit("UNKNOWN_JOB").alias("code"), F.col("job_type").alias("message"))
    known = cut(known.union(other))
    after = jb.complete(state.jobs, known.filter("code is null").select("id", "screenshot_id"), now)
    after = jb.retry_or_fail(after, known.filter("code is not null").select("id", "code", "message"), now)
    return Handled(replace(state, jobs=cut(after)), known, reduce(DataFrame.union, touched).distinct())


def summary(outcomes: DataFrame) -> DataFrame:
    """One row: jobs done, retried or failed for good, by error class."""
    bad = F.col("code").isNotNull()
    return outcomes.agg(F.count("*").alias("handled"), F.count_if(~bad).alias("done"), F.count_if(bad & ~jb.is_permanent(F.col("code"))).alias("recoverable"), F.count_if(jb.is_permanent(F.col("code"))).alias("permanent"))
