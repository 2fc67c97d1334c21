"""The indexing service: state kept as table versions, a worker that can be paused, start-up catch-up, progress.

One process owns the state (a single writer); every step replaces it as a whole. Engines, embedding and what is on disk
are passed in, so the same service runs with real models or stand-ins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ocrlake.operators import catalog as cat
from ocrlake.operators import jobs as jb
from ocrlake.operators import worker as wk
from ocrlake.operators.reconcile import Discovery
from ocrlake.session import cut


@dataclass
class IndexingService:
    """``read`` and ``pipeline``: the active engine; ``look``: paths (path) to what is on disk (see ``worker``)."""

    state: wk.State
    folders: DataFrame
    look: Callable[[DataFrame], DataFrame]
    read: Callable[[DataFrame], DataFrame]
    pipeline: str
    embedding: wk.Embedding | None = None
    paused: bool = False
    on_batch: list[Callable[[dict], None]] = field(default_factory=list)

    def start(self, now: datetime, scan: Callable[[int, str, bool, DataFrame], Discovery]) -> int:
        """Recovery of what died, a catch-up scan of every enabled folder, jobs for what is pending and for missing vectors.

        ``scan`` takes folder id, path, whether it is recursive, and the items, and gives a discovery. A folder that
        cannot be scanned is left as it is. Returns the number of jobs added.
        """
        state = wk.start(replace(self.state, items=jb.recover_items(self.state.items)), now)
        before = state.jobs.count()
        for f in self.enabled_folders():
            try:
                found = scan(f["id"], f["path"], bool(f["is_recursive"]), state.items)
            except OSError:
                continue
            except cat.EngineError:
                continue
            state = replace(state, items=found.items, jobs=cut(jb.enqueue(state.jobs, jb.scan_jobs(found.items, f["id"]), now)))
            self.folders = cat.touch_scanned(self.folders, f["id"], now)
        self.state = replace(state, items=cut(state.items))
        self.reconcile_vectors(now)
        return self.state.jobs.count() - before

    def enabled_folders(self) -> Iterator:
        """Folders that are watched; their list is the user's own and short."""
        return self.folders.filter("enabled = 1").orderBy("id").toLocalIterator()

    def step(self, now: datetime, n: int = 100) -> int:
        """One turn of the worker; nothing is claimed while it is paused. Returns the number of jobs handled."""
        if self.paused:
            return 0
        paths = jb.claimable(self.state.jobs, now, n).select("path")
        known = self.state.items.select("path")
        h = wk.run_batch(self.state, cut(self.look(paths.union(known).distinct())), self.read, self.pipeline, now, self.embedding, n)
        self.state = h.state
        done = wk.summary(h.outcomes).first().asDict()
        for tell in self.on_batch:
            tell(done)
        return done["handled"]

    def pause(self) -> None:
        """The queue keeps taking jobs."""
        self.paused = True

    def resume(self) -> None:
        self.paused = False

    def retry_failed(self, now: datetime) -> int:
        """All failed jobs are pending again; returns how many."""
        n = self.state.jobs.filter("status = 'FAILED'").count()
        self.state = replace(self.state, jobs=cut(jb.retry_all_failed(self.state.jobs, now)))
        return n

    def _enqueued(self, wanted: DataFrame, now: datetime) -> int:
        """Jobs of these keys that became pending or new."""
        active = self.state.jobs.filter(F.col("status").isin("PENDING", "PROCESSING")).select("dedupe_key")
        new = wanted.select("dedupe_key").distinct().join(active, "dedupe_key", "left_anti").count()
        self.state = replace(self.state, jobs=cut(jb.enqueue(self.state.jobs, wanted, now, supersede=False)))
        return new

    def reconcile_vectors(self, now: datetime) -> int:
        """Jobs for processed items without a vector of the model; returns how many were added or opened again."""
        if self.embedding is None:
            return 0
        m = self.embedding
        return self._enqueued(cut(jb.embedding_jobs(self.state.items, self.state.vectors, m.model_id, m.model_version)), now)

    def rebuild_vectors(self, now: datetime) -> int:
        """The model's vectors go, and every processed item gets a job for a new one."""
        if self.embedding is None:
            return 0
        self.state = replace(self.state, vectors=cut(cat.clear_vectors(self.state.vectors, self.embedding.model_id)))
        return self.reconcile_vectors(now)

    def re_process(self, now: datetime, limit: int = 10_000) -> int:
        """Jobs for items whose text another pipeline made; returns how many were added or opened again."""
        return self._enqueued(cut(jb.re_process_jobs(self.state.items, self.pipeline, limit)), now)

    def status(self, watched: int = 0) -> DataFrame:
        m = self.embedding
        return cat.service_status(self.state.items, self.state.jobs, self.state.vectors, m.model_id if m else "", m.model_version if m else "", watched)
