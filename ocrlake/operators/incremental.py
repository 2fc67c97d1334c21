"""Processing only new or changed records, against a manifest of what earlier runs committed.

The *listing* holds one row per record as it is now: key, size, modification time, checksum, processing version. The
*manifest* holds the same of what successful runs committed. ``pending`` is the anti-join of both by the one predicate
``unchanged``; ``run_incremental`` is the whole cycle on it: anti-join, idempotent write under a batch identifier, then
the manifest commit. A run that dies before its manifest is committed leaves nothing that a reader would see, and the
next run rewrites the same batch; a run that dies after it is not repeated.

The manifest is one table per batch; every ``COMPACT_EVERY`` batches they are merged into a base, so that a run reads the
base and few batches, however many there ever were.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ocrlake.functions.times import rfc3339_instant

SUCCEEDED = "SUCCEEDED"
STATE_FIELDS = ("file_size", "modified_at_fs", "content_hash", "ocr_pipeline_version")
#: Runs are one row per run of the job. Up to this many rows the run list is broadcast; above it, it is shuffled.
MAX_BROADCAST_RUNS = 100_000


def committed_state(state: DataFrame, runs: DataFrame, max_broadcast_runs: int = MAX_BROADCAST_RUNS) -> DataFrame:
    """Per ``screenshot_id`` what the last successful run that handled it noted.

    Rows of runs without status SUCCEEDED, of unknown runs, and rows without key or run do not count. Within one run
    the latest ``recorded_at`` counts; a null ``recorded_at`` is the earliest. Rows that tie on both are ordered by
    their fields (nulls first), so the choice is the same on every run. One hash-partitioned aggregate with map-side
    combine: the number of rows of one key does not matter.
    """
    ok = runs.filter(F.col("status") == SUCCEEDED).select("run_id").filter("run_id is not null").distinct()
    if ok.limit(max_broadcast_runs + 1).count() <= max_broadcast_runs:
        ok = F.broadcast(ok)
    rows = state.select("screenshot_id", "run_id", "recorded_at", *STATE_FIELDS).filter("screenshot_id is not null")
    rows = rows.join(ok, "run_id", "left_semi")
    best = F.max(F.struct("run_id", "recorded_at", *STATE_FIELDS))
    return rows.groupBy("screenshot_id").agg(best.alias("s")).select("screenshot_id", *(F.col(f"s.{c}").alias(c) for c in STATE_FIELDS))


def unchanged(new: Callable[[str], Column], old: Callable[[str], Column]) -> Column:
    """Whether a record is as its committed state says.

    Equal known hashes settle the content. Where a hash is null on either side, size and the instant of the
    modification time decide (null equals only null; times that cannot be read compare as text). The processing
    version must be equal too, null only to null.
    """
    both = new("content_hash").isNotNull() & old("content_hash").isNotNull()
    n, o = rfc3339_instant(new("modified_at_fs")), rfc3339_instant(old("modified_at_fs"))
    same_time = F.when(n.isNotNull() & o.isNotNull(), n == o).otherwise(new("modified_at_fs").eqNullSafe(old("modified_at_fs")))
    same_content = F.when(both, new("content_hash") == old("content_hash")).otherwise(new("file_size").eqNullSafe(old("file_size")) & same_time)
    return same_content & new("ocr_pipeline_version").eqNullSafe(old("ocr_pipeline_version"))


def pending(listing: DataFrame, manifest: DataFrame, key: str = "id") -> DataFrame:
    """(screenshot_id) of the rows of ``listing`` whose record is new or differs from ``manifest`` (key ``screenshot_id``).

    Rows without key are dropped. A record listed twice comes out once; if its rows differ, it comes out when any of
    them differs from the manifest. Only the compared fields are read and shuffled.
    """
    new = listing.select(F.col(key).alias("screenshot_id"), *STATE_FIELDS).filter("screenshot_id is not null").alias("n")
    old = manifest.select("screenshot_id", *STATE_FIELDS).alias("o")
    same = unchanged(lambda c: F.col(f"n.{c}"), lambda c: F.col(f"o.{c}"))
    left = new.join(old, (F.col("n.screenshot_id") == F.col("o.screenshot_id")) & same, "left_anti")
    return left.select("screenshot_id").distinct()


# ---------------------------------------------------------------------------------------------- whole cycle

COMPACT_EVERY = 20  # batches between two bases


@dataclass(frozen=True)
class Layout:
    """Where a job keeps its tables: ``{root}/{data,manifest,plan,base}/batch_id=…``. ``key`` names the listing's key."""

    root: str
    key: str = "path"

    def part(self, name: str, batch_id: str) -> str:
        return f"{self.root}/{name}/batch_id={batch_id}"


def _path(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def _committed(spark: SparkSession, path: str) -> bool:
    fs, hadoop = _path(spark, f"{path}/_SUCCESS")
    return fs.exists(hadoop)


def _names(spark: SparkSession, layout: Layout, name: str) -> list[str]:
    """Batch identifiers that have a folder of this kind, ended or not; one call."""
    fs, hadoop = _path(spark, f"{layout.root}/{name}")
    if not fs.exists(hadoop):
        return []
    found = (status.getPath().getName() for status in fs.listStatus(hadoop))
    return sorted(n.split("=", 1)[1] for n in found if n.startswith("batch_id="))


def _latest_base(spark: SparkSession, layout: Layout) -> str | None:
    return next((b for b in reversed(_names(spark, layout, "base")) if _committed(spark, layout.part("base", b) + "/batches")), None)


def _after(spark: SparkSession, layout: Layout, base: str | None) -> list[str]:
    """Committed batches after the base: at most ``COMPACT_EVERY`` and those that died are looked at."""
    return [b for b in _names(spark, layout, "manifest") if (base is None or b > base) and _committed(spark, layout.part("manifest", b))]


def committed_batches(spark: SparkSession, layout: Layout) -> list[str]:
    """Identifiers of batches whose manifest write ended."""
    base = _latest_base(spark, layout)
    older = [] if base is None else [r["batch_id"] for r in spark.read.parquet(layout.part("base", base) + "/batches").collect()]  # one row per run ever
    return sorted([*older, *_after(spark, layout, base)])


def _manifest_schema(key_type: str) -> str:
    return f"screenshot_id {key_type}, file_size long, modified_at_fs string, content_hash string, ocr_pipeline_version string, batch string"


def _read_manifest(spark: SparkSession, layout: Layout, key_type: str) -> DataFrame:
    """All committed manifest rows; of one key those of the latest batch count."""
    base = _latest_base(spark, layout)
    parts = [layout.part("manifest", b) for b in _after(spark, layout, base)]
    if base is not None:
        parts.append(layout.part("base", base) + "/rows")
    if not parts:
        return spark.createDataFrame([], _manifest_schema(key_type))
    rows = spark.read.schema(_manifest_schema(key_type)).parquet(*parts)
    latest = rows.groupBy("screenshot_id").agg(F.max("batch").alias("batch"))
    return rows.join(latest, ["screenshot_id", "batch"])


def read_manifest(spark: SparkSession, layout: Layout, key_type: str = "string") -> DataFrame:
    """Key (``screenshot_id``) and fields of every committed record; a record committed with several states has several rows."""
    return _read_manifest(spark, layout, key_type).select("screenshot_id", *STATE_FIELDS, "batch")


def read_output(spark: SparkSession, layout: Layout) -> DataFrame | None:
    """Output of committed batches only; leftovers of runs that died are never read."""
    batches = committed_batches(spark, layout)
    if not batches:
        return None
    have = set(_names(spark, layout, "data"))  # a manifest that was taken over has no output
    return spark.read.option("basePath", f"{layout.root}/data").parquet(*(layout.part("data", b) for b in batches if b in have))


def commit_manifest(rows: DataFrame, layout: Layout, batch_id: str) -> None:
    """Commit the state of records (the layout's key and ``STATE_FIELDS``) as of this batch; also how a manifest kept
    elsewhere is taken over, with a batch identifier before all others."""
    rows.select(F.col(layout.key).alias("screenshot_id"), *STATE_FIELDS, F.lit(batch_id).alias("batch")).write.mode("overwrite").parquet(layout.part("manifest", batch_id))


def compact(spark: SparkSession, layout: Layout, key_type: str = "string") -> None:
    """Merge the manifest of all committed batches into a base named after the last one; the batch list is the commit."""
    batches = committed_batches(spark, layout)
    if batches:
        to = layout.part("base", batches[-1])
        _read_manifest(spark, layout, key_type).select("screenshot_id", *STATE_FIELDS, "batch").write.mode("overwrite").parquet(f"{to}/rows")
        spark.createDataFrame([(b,) for b in batches], "batch_id string").coalesce(1).write.mode("overwrite").parquet(f"{to}/batches")


def run_incremental(
    spark: SparkSession,
    listing: DataFrame,
    layout: Layout,
    process: Callable[[DataFrame], DataFrame],
    batch_id: str,
    on_step: Callable[[str], None] = lambda step: None,
) -> int:
    """One run: process what ``pending`` gives of ``listing`` (the layout's key and ``STATE_FIELDS``) and commit it.

    Returns the number of records processed. ``batch_id`` must sort after earlier ones. Running again with the identifier
    of a committed batch does nothing; with that of a batch that died, its output folder is overwritten. ``process``
    gets each pending record once for each state it is listed with. ``on_step`` is told each step (tests break there).
    """
    base = _latest_base(spark, layout)
    recent = _after(spark, layout, base)
    if batch_id in recent or base is not None and batch_id <= base and batch_id in committed_batches(spark, layout):
        return 0
    last = recent[-1] if recent else base
    if last is not None and batch_id <= last:
        raise ValueError(f"batch {batch_id!r} does not sort after {last!r}")
    key_type = listing.schema[layout.key].dataType.simpleString()
    ids = pending(listing, read_manifest(spark, layout, key_type), layout.key)
    rows = listing.select(layout.key, *STATE_FIELDS).distinct()
    todo = rows.join(ids.withColumnRenamed("screenshot_id", layout.key), layout.key, "left_semi")
    # The work list is written first: output and manifest are then made from the same rows even if the listing moves.
    plan = layout.part("plan", batch_id)
    todo.write.mode("overwrite").parquet(plan)
    on_step("planned")
    fixed = spark.read.schema(todo.schema).parquet(plan)
    n = fixed.select(layout.key).distinct().count()
    process(fixed).write.mode("overwrite").parquet(layout.part("data", batch_id))
    on_step("written")
    commit_manifest(fixed, layout, batch_id)
    on_step("committed")
    if len(recent) + 1 >= COMPACT_EVERY:
        compact(spark, layout, key_type)
    return n


def new_batch_id(number: int) -> str:
    """Batch identifiers that sort by number, with a letter in front so that they stay strings as partition values."""
    return f"b{number:012d}"


def local_listing(spark: SparkSession, root: str, version: str | None = None) -> DataFrame:
    """Listing (path and fields) of files under ``root`` with size, time and SHA-256 of the bytes, for this processing version."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(os.fspath(root))
    stamp = F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    return files.select("path", F.col("length").alias("file_size"), stamp.alias("modified_at_fs"), F.sha2("content", 256).alias("content_hash"), F.lit(version).cast("string").alias("ocr_pipeline_version"))
