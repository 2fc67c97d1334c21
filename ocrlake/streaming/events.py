"""File events: normal form, per-path debounce, stability gate, hand-over to the job queue."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ocrlake.functions.paths import is_supported_image
from ocrlake.functions.text import delete_key, upsert_key
from ocrlake.operators.jobs import enqueue
from ocrlake.schema import DELETE_JOB, UPSERT_JOB

QUIET_MS = 500
UPSERT, REMOVE, RENAME = "upsert", "remove", "rename"


def normalize_events(events: DataFrame) -> DataFrame:
    """Raw events (kind, path, to_path, ts, any others) as upsert, remove and rename of supported image files.

    Kinds: create, modify, remove, rename_from, rename_to, rename_both. A rename between supported names is a rename; out
    of them it is a removal, into them an upsert. Events of other files and other kinds are dropped.
    """
    valid, to_valid = is_supported_image(F.col("path")), F.coalesce(is_supported_image(F.col("to_path")), F.lit(False))
    k = F.col("kind")
    both = k == "rename_both"
    kind = (
        F.when(k.isin("create", "modify", "rename_to") & valid, UPSERT)
        .when(k.isin("remove", "rename_from") & valid, REMOVE)
        .when(both & valid & to_valid, RENAME)
        .when(both & valid, REMOVE)
        .when(both & to_valid, UPSERT)
    )
    path = F.when(both & ~valid & to_valid, F.col("to_path")).otherwise(F.col("path"))
    to_path = F.when(kind == RENAME, F.col("to_path"))
    return events.withColumns({"kind": kind, "path": path, "to_path": to_path}).filter("kind is not null")


def per_path_events(normal: DataFrame) -> DataFrame:
    """Events as removals and upserts of single paths: a rename removes the one and upserts the other."""
    parts = F.when(
        F.col("kind") == RENAME,
        F.array(F.struct(F.lit(REMOVE).alias("kind"), F.col("path").alias("path")), F.struct(F.lit(UPSERT).alias("kind"), F.col("to_path").alias("path"))),
    ).otherwise(F.array(F.struct(F.col("kind").alias("kind"), F.col("path").alias("path"))))
    keep = [c for c in normal.columns if c not in ("kind", "path", "to_path")]
    return normal.select(*keep, F.explode(parts).alias("e")).select(*keep, "e.kind", "e.path")


def split_renames(normal: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Renames of items on record (folder_id, old_path, new_path), and all other events as ``per_path_events`` gives them.

    A rename of a file that is on record keeps the item, with its text and vector (see ``catalog.rename_items``); what was
    waiting for the old path is cancelled with it. A rename of an unknown file is an upsert of its new path. ``normal`` has
    folder_id; batch frames, as in foreachBatch.
    """
    known = items.select("folder_id", "path").distinct()
    moves = normal.filter(F.col("kind") == RENAME)
    own = moves.join(known, ["folder_id", "path"], "left_semi")
    last = F.max_by("to_path", F.struct("ts", "to_path"))
    renames = own.groupBy("folder_id", "path").agg(last.alias("new_path"), F.max("ts").alias("_at"))
    others = moves.join(known, ["folder_id", "path"], "left_anti").withColumns({"kind": F.lit(UPSERT), "path": F.col("to_path")})
    rest = normal.filter(F.col("kind") != RENAME).unionByName(others)
    waiting = renames.select("folder_id", "path", "_at")
    rest = rest.join(waiting, (rest["folder_id"] == waiting["folder_id"]) & (rest["path"] == waiting["path"]) & (rest["ts"] <= waiting["_at"]), "left_anti")
    keep = [c for c in normal.columns if c not in ("kind", "path", "to_path")]
    return renames.select("folder_id", F.col("path").alias("old_path"), "new_path"), rest.select(*keep, "kind", "path")


def debounce(events: DataFrame, quiet: str = "500 milliseconds", watermark: str = "10 seconds", keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """(keys, kind, started_at, last_at, n): bursts of events of one path, ended by a quiet time; the last event wins.

    For batch and streaming frames with ``ts`` as a timestamp. Of events at one instant the greatest event_id, then a
    removal before an upsert, counts as last. A stream gives a burst once the watermark has passed its end.
    """
    order = F.struct("ts", "event_id", "kind") if "event_id" in events.columns else F.struct("ts", "kind")
    rows = events.withWatermark("ts", watermark) if events.isStreaming else events
    session = F.session_window("ts", quiet).alias("w")
    return rows.groupBy(*keys, session).agg(F.max_by("kind", order).alias("kind"), F.min("ts").alias("started_at"), F.max("ts").alias("last_at"), F.count("*").alias("n")).drop("w")


class _Debounce(StatefulProcessor):
    """One path's last event and its deadline; every event moves the deadline on."""

    def __init__(self, quiet_ms: int) -> None:
        self.quiet_ms = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("last", StructType([StructField("kind", StringType()), StructField("at_ms", LongType()), StructField("n", LongType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        kind, at, n = self.state.get() if self.state.exists() else (None, -1, 0)
        for pdf in rows:
            n += len(pdf)
            ms = pdf["ts"].astype("datetime64[ms]").astype("int64")
            for k, t in zip(pdf["kind"], ms):
                if t >= at:
                    kind, at = k, int(t)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t if isinstance(t, int) else t[0])
        self.state.update((kind, at, n))
        self.handle.registerTimer(at + self.quiet_ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        kind, at, n = self.state.get()
        self.state.clear()
        yield pd.DataFrame({"path": [key[0]], "kind": [kind], "last_ms": [at], "n": [n]})

    def close(self) -> None:
        pass


def debounce_stateful(events: DataFrame, quiet_ms: int = QUIET_MS, watermark: str = "0 seconds") -> DataFrame:
    """(path, kind, last_ms, n): as ``debounce``, with a timer per path that every event resets (needs RocksDB state)."""
    out = StructType([StructField("path", StringType()), StructField("kind", StringType()), StructField("last_ms", LongType()), StructField("n", LongType())])
    return events.withWatermark("ts", watermark).groupBy("path").transformWithStateInPandas(_Debounce(quiet_ms), outputStructType=out, outputMode="append", timeMode="eventTime")


def stable_observations(observations: DataFrame) -> DataFrame:
    """(path, attempt, file_size, modified_at_fs): the first of a path's observations that equals the one before it.

    ``observations``: path, attempt (1 to 5), file_size, modified_at_fs, readable. A path whose observations never agree,
    or that cannot be read, does not come out.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("path").orderBy("attempt")
    same = F.col("file_size").eqNullSafe(F.lag("file_size").over(w)) & F.col("modified_at_fs").eqNullSafe(F.lag("modified_at_fs").over(w))
    seen = observations.filter(F.col("attempt") <= 5).withColumn("_ok", same & (F.col("attempt") > 1) & F.col("readable"))
    first = seen.filter("_ok").groupBy("path").agg(F.min(F.struct("attempt", "file_size", "modified_at_fs")).alias("m"))
    return first.select("path", "m.*")


def unstable_paths(observations: DataFrame, last_seen_ms: str = "seen_ms", again_ms: int = QUIET_MS) -> DataFrame:
    """(path, due_ms): paths that can be read but never agreed; they are looked at again after another quiet time."""
    stable = stable_observations(observations).select("path")
    there = observations.groupBy("path").agg(F.max_by("readable", "attempt").alias("r"), F.max(last_seen_ms).alias("m"))
    return there.filter("r").join(stable, "path", "left_anti").select("path", (F.col("m") + again_ms).alias("due_ms"))


class Progress(StreamingQueryListener):
    """Tells a callback what each micro-batch did: rows in, rows a second, batch number, and when the query ends."""

    def __init__(self, tell: Callable[[dict], None]) -> None:
        self.tell = tell

    def onQueryStarted(self, event) -> None:
        self.tell({"event": "started", "name": event.name})

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.tell({"event": "progress", "name": p.name, "batch": p.batchId, "rows": p.numInputRows, "rows_per_second": p.processedRowsPerSecond})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.tell({"event": "ended", "error": event.exception})


def event_jobs(bursts: DataFrame, hashes: DataFrame | None = None) -> DataFrame:
    """Wanted jobs of debounced events (folder_id, path, kind); ``hashes`` (path, content_hash) where they are known."""
    rows = bursts.join(hashes, "path", "left") if hashes is not None else bursts.withColumn("content_hash", F.lit(None).cast("string"))
    key = F.when(F.col("kind") == REMOVE, delete_key(F.col("folder_id"), F.col("path"))).otherwise(upsert_key(F.col("folder_id"), F.col("path"), F.col("content_hash")))
    kind = F.when(F.col("kind") == REMOVE, DELETE_JOB).otherwise(UPSERT_JOB)
    return rows.select("folder_id", F.lit(None).cast("long").alias("screenshot_id"), "path", kind.alias("job_type"), key.alias("dedupe_key"))


def queue_writer(read_jobs: Callable[[], DataFrame], write_jobs: Callable[[DataFrame, int], None], now: Callable[[], datetime]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: enqueue a batch of wanted jobs. ``write_jobs`` gets the batch number and must be idempotent by it."""

    def run(batch: DataFrame, number: int) -> None:
        write_jobs(enqueue(read_jobs(), batch, now()), number)

    return run


__all__ = ["Progress", "debounce", "debounce_stateful", "event_jobs", "normalize_events", "per_path_events", "queue_writer", "split_renames", "stable_observations", "unstable_paths"]
