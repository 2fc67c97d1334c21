"""Image files as a source: directory scans, fingerprints, data addresses, model files, and a streaming variant."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ocrlake.functions.paths import IMAGE_EXTENSIONS, data_url, extension, file_name, is_image
from ocrlake.schema import EngineError


def scan_directory(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """(path, filename, extension, file_size, modified_at_fs) of image files under ``root``; contents are not read."""
    local = root.removeprefix("file://")
    if "://" not in local:
        if not os.path.exists(local):
            raise EngineError("FOLDER_NOT_FOUND", root)
        if not os.path.isdir(local):
            raise EngineError("INVALID_PATH", root)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).filter(is_image(F.col("path")))
    if not recursive:
        plain = lambda c: F.regexp_replace(c, "^[a-z]+:/+", "/")
        files = files.filter(F.regexp_replace(plain(F.col("path")), "/[^/]*$", "") == plain(F.lit(root.rstrip("/"))))
    stamp = F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    return files.select("path", file_name(F.col("path")).alias("filename"), extension(F.col("path")).alias("extension"), F.col("length").alias("file_size"), stamp.alias("modified_at_fs"))


@dataclass(frozen=True)
class Walk:
    """A local directory scan: files (as ``scan_directory``), folders that could not be listed (path), and files whose
    facts could not be read (path, message)."""

    files: DataFrame
    inaccessible: DataFrame
    failures: DataFrame


def walk_directory(spark: SparkSession, root: str, recursive: bool = True) -> Walk:
    """Image files under a mounted ``root``, with what could not be seen.

    Only names and sizes are read, folder by folder; links to folders are not followed, links to files are. Without
    ``recursive`` no folder but the root is listed. Object stores have no folders that fail one by one: use
    ``scan_directory`` there.
    """
    if not os.path.exists(root):
        raise EngineError("FOLDER_NOT_FOUND", root)
    if not os.path.isdir(root):
        raise EngineError("INVALID_PATH", root)
    files, shut, failed = [], [], []
    todo = [root]
    while todo:
        here = todo.pop()
        try:
            entries = sorted(os.scandir(here), key=lambda e: e.name)
        except OSError:
            shut.append((here,))
            continue
        for e in entries:
            if e.is_dir(follow_symlinks=False):
                if recursive:
                    todo.append(e.path)
                continue
            ext = os.path.splitext(e.name)[1][1:].lower()
            if ext not in IMAGE_EXTENSIONS:
                continue
            try:
                if e.is_file():
                    st = e.stat()
                    files.append((e.path, e.name, ext, st.st_size, rfc3339(st.st_mtime)))
            except OSError as err:
                failed.append((e.path, str(err)))
    schema = "path string, filename string, extension string, file_size long, modified_at_fs string"
    return Walk(spark.createDataFrame(files, schema), spark.createDataFrame(shut, "path string"), spark.createDataFrame(failed, "path string, message string"))


def rfc3339(seconds: float) -> str:
    """An instant in seconds as the catalog writes it."""
    return datetime.fromtimestamp(seconds, timezone.utc).isoformat(timespec="microseconds")


def observe(paths: DataFrame) -> DataFrame:
    """What is on disk at ``paths`` (path), as the worker wants it: path, file_size, modified_at_fs, content_hash, error_code.

    Paths that are not there have the code FileNotFound, unreadable ones FileReadFailed.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path in pdf["path"]:
                try:
                    st = os.stat(path)
                    rows.append((path, st.st_size, rfc3339(st.st_mtime), _sha256(path), None))
                except FileNotFoundError:
                    rows.append((path, None, None, None, "FileNotFound"))
                except OSError:
                    rows.append((path, None, None, None, "FileReadFailed"))
            yield pd.DataFrame(rows, columns=["path", "file_size", "modified_at_fs", "content_hash", "error_code"]).astype({"file_size": "Int64"})

    return paths.select("path").filter("path is not null").distinct().mapInPandas(run, "path string, file_size long, modified_at_fs string, content_hash string, error_code string")


def surely_gone(paths: DataFrame) -> DataFrame:
    """Those of ``paths`` (path) of which the file system says that they don't exist; any other error keeps a path out."""
    return observe(paths).filter("error_code = 'FileNotFound'").select("path")


def _sha256(path: str) -> str:
    digest = hashlib.sha256()
    with open(path.removeprefix("file:"), "rb") as f:
        while chunk := f.read(1 << 16):
            digest.update(chunk)
    return digest.hexdigest()


def fingerprints(paths: DataFrame) -> DataFrame:
    """(path, content_hash, error_code) of the files named in ``paths`` (path), read in chunks where the rows are.

    Only these files are read, on storage that all executors mount. A file that cannot be read has a null hash and a code.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path in pdf["path"]:
                try:
                    rows.append((path, _sha256(path), None))
                except FileNotFoundError:
                    rows.append((path, None, "FileNotFound"))
                except OSError:
                    rows.append((path, None, "FileReadFailed"))
            yield pd.DataFrame(rows, columns=["path", "content_hash", "error_code"])

    return paths.select("path").filter("path is not null").distinct().mapInPandas(run, "path string, content_hash string, error_code string")


def image_data_urls(spark: SparkSession, paths: list[str]) -> DataFrame:
    files = spark.read.format("binaryFile").load(paths)
    return files.select("path", data_url(extension(F.col("path")), F.col("content")).alias("data_url"))


def image_data_url(spark: SparkSession, items: DataFrame, item_id: int) -> str:
    """The data address of one item's file; an error where the item or its file is not there."""
    row = items.filter(F.col("id") == item_id).select("path").head(1)
    if not row or not os.path.isfile(row[0]["path"].removeprefix("file:")):
        raise EngineError("FILE_NOT_FOUND", str(item_id))
    return image_data_urls(spark, [row[0]["path"]]).first()["data_url"]


def watch_directory(spark: SparkSession, root: str) -> DataFrame:
    """Streaming events (kind, path, to_path, ts) of image files that appear or change under ``root``."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    glob = "*.{" + ",".join([*IMAGE_EXTENSIONS, *(e.upper() for e in IMAGE_EXTENSIONS)]) + "}"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    return files.select(F.lit("create").alias("kind"), "path", F.lit(None).cast("string").alias("to_path"), F.col("modificationTime").alias("ts"))


def watch_folders(spark: SparkSession, folders: DataFrame) -> DataFrame | None:
    """One stream over all enabled folders (id, path, enabled) that exist, with ``folder_id``; None where there are none."""
    out = None
    for f in folders.filter("enabled = 1").select("id", "path").orderBy("id").toLocalIterator():  # the user's own short list
        if os.path.isdir(f["path"]):
            one = watch_changes(spark, f["path"]).withColumn("folder_id", F.lit(f["id"]))
            out = one if out is None else out.unionByName(one)
    return out


def watch_changes(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """Streaming events (kind, path, to_path, ts) under a mounted ``root``: create, modify, remove and rename_both.

    The folder is looked at once per trigger and compared with the last look, which is the stream's offset; a file that
    turns up elsewhere with the same identity was renamed. For folders of a watcher's size; object stores have
    ``watch_directory``.
    """
    from ocrlake.sources.watcher import FolderChanges

    spark.dataSource.register(FolderChanges)
    return spark.readStream.format("folder_changes").option("root", root).option("recursive", str(recursive).lower()).load()


def app_info(spark: SparkSession) -> dict[str, str]:
    from ocrlake.schema import SCHEMA_VERSION

    return {"name": "ocrlake", "schema_version": str(SCHEMA_VERSION), "spark": spark.version}


@dataclass(frozen=True)
class Asset:
    path: str
    sha256: str = ""


def verify_asset(asset: Asset) -> bool:
    """Whether a model file is there with its checksum (any case; an empty one is not asked for)."""
    if not os.path.isfile(asset.path):
        return False
    if not asset.sha256:
        return True
    digest = hashlib.sha256()
    with open(asset.path, "rb") as f:
        while chunk := f.read(1 << 20):
            digest.update(chunk)
    return digest.hexdigest() == asset.sha256.lower()


def install_asset(asset: Asset, content: bytes | Iterable[bytes]) -> None:
    """Write a model file (bytes, or chunks as they come) beside its place, check it, then move it there; nothing is left
    behind on failure."""
    tmp = asset.path + ".part"
    try:
        with open(tmp, "wb") as f:
            for chunk in (content,) if isinstance(content, bytes) else content:
                f.write(chunk)
        if not verify_asset(Asset(tmp, asset.sha256)):
            raise EngineError("CHECKSUM_MISMATCH", asset.path)
        os.replace(tmp, asset.path)
    finally:
        if os.path.exists(tmp):
            os.remove(tmp)


def ping(spark: SparkSession) -> bool:
    return spark.sql("SELECT 1 AS one").first()["one"] == 1
