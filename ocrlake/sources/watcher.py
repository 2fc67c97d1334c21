"""A streaming data source of folder changes, by comparing looks at a mounted folder."""

from __future__ import annotations

import os
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

Look = dict[str, list[int]]  # path to size, time and identity


def look_at(root: str, recursive: bool) -> Look:
    found: Look = {}
    for here, folders, names in os.walk(root):
        if not recursive:
            folders.clear()
        for name in names:
            path = os.path.join(here, name)
            try:
                st = os.stat(path)
            except OSError:  # it went while we looked
                continue
            found[path] = [st.st_size, st.st_mtime_ns, st.st_ino]
    return found


def changes(old: Look, new: Look) -> list[tuple[str, str, str | None]]:
    """(kind, path, to_path) between two looks. A path that went and one that came with its identity are one rename."""
    gone = {tuple(v[1:]): p for p, v in old.items() if p not in new}
    out: list[tuple[str, str, str | None]] = []
    moved = set()
    for path, facts in sorted(new.items()):
        if path not in old:
            source = gone.get(tuple(facts[1:]))
            if source is None or source in moved:
                out.append(("create", path, None))
            else:
                moved.add(source)
                out.append(("rename_both", source, path))
        elif old[path][:2] != facts[:2]:
            out.append(("modify", path, None))
    out += [("remove", p, None) for p in sorted(old) if p not in new and p not in moved]
    return out


class FolderChangesReader(SimpleDataSourceStreamReader):
    def __init__(self, root: str, recursive: bool) -> None:
        self.root, self.recursive = root, recursive

    def initialOffset(self) -> dict:
        return {"look": look_at(self.root, self.recursive)}

    def _rows(self, old: Look, new: Look) -> Iterator[tuple]:
        now = datetime.now(timezone.utc)
        for kind, path, to in changes(old, new):
            facts = new.get(to or path)
            yield kind, path, to, now if facts is None else datetime.fromtimestamp(facts[1] / 1e9, timezone.utc)

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        end = look_at(self.root, self.recursive)
        return iter(list(self._rows(start["look"], end))), {"look": end}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return self._rows(start["look"], end["look"])

    def commit(self, end: dict) -> None:
        pass


class FolderChanges(DataSource):
    """Options: root, recursive (true)."""

    @classmethod
    def name(cls) -> str:
        return "folder_changes"

    def schema(self) -> str:
        return "kind string, path string, to_path string, ts timestamp"

    def simpleStreamReader(self, schema) -> FolderChangesReader:
        return FolderChangesReader(self.options["root"], self.options.get("recursive", "true") == "true")
