"""Snapshot reconciliation: what a scan found against what the catalog holds."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ocrlake.operators import catalog as cat
from ocrlake.session import cut

ADDED, UPDATED, UNCHANGED, MISSING = "added", "updated", "unchanged", "missing"


def scan_diff(found: DataFrame, existing: DataFrame) -> DataFrame:
    """(path, id, file_size, modified_at_fs, action) of every path on either side.

    A file with the size and time on record is unchanged without being read again. ``found``: path, file_size,
    modified_at_fs; ``existing``: id, path, file_size, modified_at_fs; each path once. Null paths never match.
    """
    f, e = found.alias("f"), existing.alias("e")
    both = f.join(e, F.col("f.path") == F.col("e.path"), "full_outer")
    same = F.col("f.file_size").eqNullSafe(F.col("e.file_size")) & F.col("f.modified_at_fs").eqNullSafe(F.col("e.modified_at_fs"))
    action = F.when(F.col("e.id").isNull(), ADDED).when(F.col("f.path").isNull(), MISSING).when(same, UNCHANGED).otherwise(UPDATED)
    return both.select(F.coalesce("f.path", "e.path").alias("path"), F.col("e.id").alias("id"), F.coalesce("f.file_size", "e.file_size").alias("file_size"), F.coalesce("f.modified_at_fs", "e.modified_at_fs").alias("modified_at_fs"), action.alias("action"))


def guarded_missing(diff: DataFrame, inaccessible: DataFrame, gone: DataFrame | None = None) -> DataFrame:
    """Missing paths that may be removed: under no inaccessible prefix and, where ``gone`` (path) is given, surely gone.

    Prefixes are plain string beginnings, not path segments. They are the scan's error list; each path meets only the
    prefixes of its own lengths, by an equality join on the beginning.
    """
    missing = diff.filter(F.col("action") == MISSING)
    if gone is not None:
        missing = missing.join(gone.select("path"), "path", "left_semi")
    prefixes = inaccessible.select(F.col("path").alias("prefix")).filter("prefix is not null").distinct()
    # one row that holds all lengths: at most as many as the longest path has characters
    lengths = prefixes.agg(F.collect_set(F.length("prefix")).alias("lengths")).withColumn("_one", F.lit(1))
    tries = missing.select("path", F.lit(1).alias("_one")).join(F.broadcast(lengths), "_one").select("path", F.explode("lengths").alias("n")).filter(F.length("path") >= F.col("n"))
    covered = tries.select("path", F.expr("substring(path, 1, n)").alias("prefix")).join(prefixes, "prefix", "left_semi").select("path").distinct()
    return missing.join(covered, "path", "left_anti")


def detect_renames(added: DataFrame, missing: DataFrame) -> DataFrame:
    """(id, old_path, new_path): an added file (folder_id, content_hash, path) is a vanished item (id, folder_id, content_hash, path).

    The newest vanished item of the folder with the hash is taken; it goes to the least new path. Null hashes never match.
    """
    old = missing.filter("content_hash is not null").groupBy("folder_id", "content_hash").agg(F.max(F.struct("id", "path")).alias("m"))
    new = added.filter("content_hash is not null").groupBy("folder_id", "content_hash").agg(F.min("path").alias("new_path"))
    return old.join(new, ["folder_id", "content_hash"]).select(F.col("m.id").alias("id"), F.col("m.path").alias("old_path"), "new_path")


def scan_summary(diff: DataFrame, failed: int = 0) -> DataFrame:
    """One row: discovered, added, updated, unchanged, removed, failed."""
    n = lambda a: F.count_if(F.col("action") == a)
    return diff.agg(F.count_if(F.col("action") != MISSING).alias("discovered"), n(ADDED).alias("added"), n(UPDATED).alias("updated"), n(UNCHANGED).alias("unchanged"), n(MISSING).alias("removed"), F.lit(failed).cast("long").alias("failed"))


@dataclass(frozen=True)
class Discovery:
    """A folder's items after a scan, the actions by path, and the one-row summary."""

    items: DataFrame
    actions: DataFrame
    summary: DataFrame


def discover(
    folder_id: int,
    found: DataFrame,
    items: DataFrame,
    fingerprint: Callable[[DataFrame], DataFrame],
    inaccessible: DataFrame,
    now: datetime,
    surely_gone: Callable[[DataFrame], DataFrame] | None = None,
    failed: int = 0,
) -> Discovery:
    """One discovery scan of a folder, end to end.

    ``found``: path, filename, extension, file_size, modified_at_fs of the files the scan saw, each path once. Files with
    the size and time on record are not read; only added and changed ones go through ``fingerprint`` (path to path,
    content_hash, error_code). A file that cannot be hashed counts as failed and leaves the catalog as it is. Items whose
    file was not seen are removed unless they lie under an ``inaccessible`` path (path) or, where ``surely_gone`` (path to
    path) is given, are not confirmed as gone. ``failed`` is the number of failures of the scan itself. Other folders'
    items stay as they are.
    """
    own = items.filter(F.col("folder_id") == folder_id)
    known = own.groupBy("path").agg(F.max(F.struct("id", "file_size", "modified_at_fs")).alias("m")).select("path", "m.*")
    diff = cut(scan_diff(found.select("path", "file_size", "modified_at_fs"), known))
    hashes = cut(fingerprint(diff.filter(F.col("action").isin(ADDED, UPDATED)).select("path")))
    read = diff.join(hashes, "path", "left").withColumn("unread", F.col("action").isin(ADDED, UPDATED) & F.col("content_hash").isNull())
    missing = diff.filter(F.col("action") == MISSING)
    gone = None if surely_gone is None else surely_gone(missing.select("path"))
    removable = cut(guarded_missing(diff, inaccessible, gone).select("path", "id"))
    names = found.select("path", "filename", "extension")
    added = read.filter((F.col("action") == ADDED) & ~F.col("unread")).join(names, "path").select(F.lit(folder_id).cast("long").alias("folder_id"), "path", "filename", "extension", "file_size", "modified_at_fs", "content_hash")
    changed = read.filter((F.col("action") == UPDATED) & ~F.col("unread")).select("id", "file_size", "modified_at_fs", "content_hash")
    # all items of a removed path go, as they share the file
    dropped = own.join(removable.select("path"), "path", "left_semi").select("id")
    after = cat.reset_changed(items.join(dropped, "id", "left_anti").select(items.columns), changed, now)
    after = cut(cat.insert_items(after, added, now))
    kept = F.when(F.col("unread"), "failed").when((F.col("action") == MISSING) & F.col("removed").isNull(), "kept").otherwise(F.col("action"))
    actions = cut(read.join(removable.select("path", F.lit(True).alias("removed")), "path", "left").select("path", "id", kept.alias("action")))
    n = lambda a: F.count_if(F.col("action") == a)
    seen = F.count_if(~F.col("action").isin(MISSING, "kept")).alias("discovered")
    summary = actions.agg(seen, n(ADDED).alias("added"), n(UPDATED).alias("updated"), n(UNCHANGED).alias("unchanged"), n(MISSING).alias("removed"), (n("failed") + failed).alias("failed"))
    return Discovery(after, actions, summary)
