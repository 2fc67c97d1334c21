"""The worker against files on disk, the service around it, and changes of folders as they happen."""

import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ocrlake.functions.vectors import mock_embedding
from ocrlake.operators import catalog as cat
from ocrlake.operators import extract as ex
from ocrlake.operators import jobs as jb
from ocrlake.operators import reconcile as rc
from ocrlake.operators import worker as wk
from ocrlake.schema import FOLDERS, ITEMS, JOBS, VECTORS, EngineError
from ocrlake.service import IndexingService
from ocrlake.sources import files as fl
from ocrlake.sources.watcher import changes, look_at
from ocrlake.streaming import events as ev

NOW = datetime(2026, 1, 1, 12)


def reader(failing=()):
    def engine(path):
        with open(path) as f:
            text = f.read()
        if os.path.basename(path) in failing:
            raise EngineError("OCR_FAILED", path)
        return ex.Recognised(text, "mock", "2.0", "en")

    return lambda rows: ex.recognise(rows, {"mock": engine}, ["mock"])


def service(spark, tmp_path, **kw):
    folders = spark.createDataFrame([(1, str(tmp_path), 1, 1, NOW, NOW, None), (2, str(tmp_path / "nowhere"), 1, 1, NOW, NOW, None), (3, "off", 0, 1, NOW, NOW, None)], FOLDERS)
    state = wk.State(spark.createDataFrame([], ITEMS), spark.createDataFrame([], VECTORS), spark.createDataFrame([], JOBS))
    model = wk.Embedding("m", "v1", mock_embedding)
    return IndexingService(state, folders, fl.observe, reader(kw.pop("failing", ())), "mock:2.0", model, **kw)


def scan(spark, now=NOW):
    def run(folder_id, path, recursive, items):
        w = fl.walk_directory(spark, path, recursive)
        return rc.discover(folder_id, w.files, items, fl.fingerprints, w.inaccessible, now, fl.surely_gone, w.failures.count())

    return run


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_from_files_to_texts_and_vectors(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, text in (("a.png", "alpha"), ("sub/b.PNG", "beta \r\n\r\n\r\n end"), ("c.png", "gamma"), ("d.txt", "no image")):
        (tmp_path / name).write_text(text)
    told = []
    s = service(spark, tmp_path, failing=("c.png",), on_batch=[told.append])
    assert s.start(NOW, scan(spark)) == 3
    s.pause()
    assert s.step(NOW) == 0
    s.resume()
    assert s.step(NOW) == 3
    assert told == [{"handled": 3, "done": 2, "recoverable": 1, "permanent": 0}]
    assert rows(s.state.items, "filename", "ocr_status", "ocr_text") == [("a.png", "SUCCEEDED", "alpha"), ("b.PNG", "SUCCEEDED", "beta\n\n end"), ("c.png", "FAILED", None)]
    assert s.step(NOW) == 2 and rows(s.state.vectors, F.size("embedding"), "model_version") == [(384, "v1")] * 2
    assert s.step(NOW) == 0  # the failed one waits
    s.read = reader()
    assert s.step(NOW + timedelta(seconds=3)) == 1
    assert rows(s.state.items.filter("filename = 'c.png'"), "ocr_status", "ocr_pipeline_version") == [("SUCCEEDED", "mock:2.0")]

    # a changed file, a renamed one, one that is gone
    (tmp_path / "a.png").write_text("alpha two")
    os.rename(tmp_path / "c.png", tmp_path / "moved.JPG")
    os.remove(tmp_path / "sub/b.PNG")
    old = {r["filename"]: r["id"] for r in s.state.items.collect()}
    key = lambda kind, path: (1, None, str(tmp_path / path), kind, f"{kind}:{path}")
    wanted = spark.createDataFrame([key("UPSERT_SCREENSHOT", "a.png"), key("UPSERT_SCREENSHOT", "moved.JPG"), key("DELETE_SCREENSHOT", "sub/b.PNG"), key("DELETE_SCREENSHOT", "a.png"), key("ODD", "x"), key("UPSERT_SCREENSHOT", "nothing.png")], "folder_id long, screenshot_id long, path string, job_type string, dedupe_key string")
    later = NOW + timedelta(seconds=9)
    s.state = wk.State(s.state.items, s.state.vectors, jb.enqueue(s.state.jobs, wanted, later, supersede=False))
    while s.step(later):
        pass
    assert rows(s.state.items, "id", "filename", "extension", "ocr_text") == sorted([(old["a.png"], "a.png", "png", "alpha two"), (old["c.png"], "moved.JPG", "jpg", "gamma")])
    assert rows(s.state.vectors, "screenshot_id") == sorted([(old["a.png"],), (old["c.png"],)])
    codes = dict(rows(s.state.jobs.filter("last_error_code is not null and status <> 'SUCCEEDED'"), "dedupe_key", "last_error_code"))
    assert codes == {"ODD:x": "UNKNOWN_JOB", "UPSERT_SCREENSHOT:nothing.png": "FileNotFound"}

    assert s.rebuild_vectors(later) == 2 and s.rebuild_vectors(later) == 0 and s.state.vectors.count() == 0
    assert s.step(later) == 2 and s.state.vectors.count() == 2
    s.pipeline = "mock:3.0"
    assert s.re_process(later) == 2 and s.step(later) == 2
    assert {r["ocr_text"] for r in s.state.items.collect()} == {"alpha two", "gamma"}  # the engine still is 2.0: nothing lost
    assert s.retry_failed(later) == 1 and {r["value"] for r in s.status(2).filter("name = 'folders'").collect()} == {2}
    assert s.folders.filter("last_scanned_at is not null").count() == 1


def test_scan_keeps_what_it_cannot_see(spark, tmp_path):
    for name in ("a.png", "b.png", "shut/c.png", "deep/d.png"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(name)
    first = scan(spark)(1, str(tmp_path), True, spark.createDataFrame([], ITEMS))
    assert tuple(first.summary.first()) == (4, 4, 0, 0, 0, 0)
    os.remove(tmp_path / "a.png")
    (tmp_path / "b.png").write_text("changed")
    w = fl.walk_directory(spark, str(tmp_path), False)
    assert rows(w.files, "filename") == [("b.png",)]
    shut = spark.createDataFrame([(str(tmp_path / "shut"),)], "path string")
    second = rc.discover(1, w.files, first.items, fl.fingerprints, shut, NOW, fl.surely_gone, 2)
    names = {(os.path.basename(p), a) for p, a in rows(second.actions, "path", "action")}
    assert names == {("a.png", "missing"), ("b.png", "updated"), ("c.png", "kept"), ("d.png", "kept")}
    assert tuple(second.summary.first()) == (1, 0, 1, 0, 1, 2) and second.items.count() == 3
    with pytest.raises(EngineError):
        fl.walk_directory(spark, str(tmp_path / "none"))


def test_catalog_errors_and_names(spark):
    folders = spark.createDataFrame([(4, "C:\\Shots", 1, 1, NOW, NOW, None)], FOLDERS)
    assert rows(cat.insert_folder(folders, "D:\\x", NOW, False), "id", "path", "is_recursive") == [(4, "C:\\Shots", 1), (5, "D:\\x", 0)]
    with pytest.raises(EngineError, match="FOLDER_ALREADY_EXISTS"):
        cat.insert_folder(folders, "c:\\sHOTS", NOW)


def test_changes_between_looks(tmp_path):
    for name in ("a", "b", "c"):
        (tmp_path / name).write_text(name)
    old = look_at(str(tmp_path), True)
    (tmp_path / "a").write_text("longer")
    os.remove(tmp_path / "b")
    os.rename(tmp_path / "c", tmp_path / "z")
    (tmp_path / "n").write_text("new")
    p = lambda name: str(tmp_path / name)
    assert changes(old, look_at(str(tmp_path), True)) == [("modify", p("a"), None), ("create", p("n"), None), ("rename_both", p("c"), p("z")), ("remove", p("b"), None)]
    assert changes(old, old) == [] and changes({}, old) == [("create", p(n), None) for n in "abc"]


def test_watched_folders_and_progress(spark, tmp_path):
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "a.png").write_text("a")
    folders = spark.createDataFrame([(1, str(tmp_path / "one"), 1, 1, NOW, NOW, None), (2, str(tmp_path / "gone"), 1, 1, NOW, NOW, None)], FOLDERS)
    told = []
    progress = ev.Progress(told.append)
    spark.streams.addListener(progress)
    stream = fl.watch_folders(spark, folders)
    query = stream.writeStream.format("memory").queryName("watched").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        query.processAllAvailable()
        (tmp_path / "one" / "b.png").write_text("b")
        os.rename(tmp_path / "one" / "a.png", tmp_path / "one" / "c.png")
        for _ in range(20):
            query.processAllAvailable()
            if spark.sql("SELECT * FROM watched").count() >= 2:
                break
    finally:
        query.stop()
        spark.streams.removeListener(progress)
    got = {(k, os.path.basename(p), os.path.basename(t) if t else None, f) for k, p, t, f in rows(spark.sql("SELECT * FROM watched"), "kind", "path", "to_path", "folder_id")}
    assert got >= {("create", "b.png", None, 1), ("rename_both", "a.png", "c.png", 1)}
    assert fl.watch_folders(spark, folders.filter("id = 2")) is None and fl.app_info(spark)["name"] == "ocrlake"


def test_asset_in_chunks(tmp_path):
    path = str(tmp_path / "m.onnx")
    fl.install_asset(fl.Asset(path, "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"), iter([b"a", b"bc"]))
    assert open(path, "rb").read() == b"abc"
