"""The life of jobs and items, by literal cases."""

from datetime import datetime, timedelta

import pytest

from ocrlake.operators import catalog as cat
from ocrlake.operators import jobs as jb
from ocrlake.operators import reconcile as rc
from ocrlake.schema import FOLDERS, ITEMS, JOBS, VECTORS

NOW = datetime(2026, 1, 10, 12)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], JOBS)


def want(spark, *rows):
    return spark.createDataFrame([(1, None, p, t, k) for p, t, k in rows], "folder_id long, screenshot_id long, path string, job_type string, dedupe_key string")


def by_id(df):
    return {r["id"]: r for r in df.collect()}


def test_life_of_a_job(spark, empty):
    q = jb.enqueue(empty, want(spark, ("a", "UPSERT_SCREENSHOT", "U:a:1"), ("a", "UPSERT_SCREENSHOT", "U:a:1")), NOW)
    assert [(r["id"], r["status"], r["max_attempts"]) for r in q.collect()] == [(1, "PENDING", 5)]
    assert jb.enqueue(q, want(spark, ("a", "UPSERT_SCREENSHOT", "U:a:1")), NOW).count() == 1
    q = jb.claim(q, NOW)
    r = by_id(q)[1]
    assert r["status"] == "PROCESSING" and r["attempts"] == 1 and r["lease_until"] == NOW + timedelta(seconds=60)
    assert jb.claimable(q, NOW).count() == 0
    done = jb.complete(q, spark.createDataFrame([(1, 77)], "id long, screenshot_id long"), NOW)
    r = by_id(done)[1]
    assert (r["status"], r["screenshot_id"], r["lease_until"], r["completed_at"]) == ("SUCCEEDED", 77, None, NOW)
    assert jb.expire(done, NOW + timedelta(hours=23)).count() == 1 and jb.expire(done, NOW + timedelta(hours=25)).count() == 0
    again = by_id(jb.enqueue(done, want(spark, ("b", "X", "U:a:1")), NOW + timedelta(hours=1)))
    assert (again[1]["status"], again[1]["path"], again[1]["attempts"], again[1]["completed_at"]) == ("PENDING", "a", 0, None)


def test_superseding(spark, empty):
    q = jb.enqueue(empty, want(spark, ("a", "UPSERT_SCREENSHOT", "U:a:1"), ("b", "UPSERT_SCREENSHOT", "U:b:1")), NOW)
    newer = jb.enqueue(q, want(spark, ("a", "DELETE_SCREENSHOT", "D:a")), NOW)
    assert sorted(r["dedupe_key"] for r in newer.collect()) == ["D:a", "U:b:1"]
    beside = jb.enqueue(q, want(spark, ("a", "GENERATE_TEXT_EMBEDDING", "E:a")), NOW, supersede=False)
    assert beside.count() == 3


def test_retries(spark, empty):
    q = jb.claim(jb.enqueue(empty, want(spark, ("a", "X", "k1"), ("b", "X", "k2")), NOW), NOW, n=2)
    errors = spark.createDataFrame([(1, "DatabaseError", "m"), (2, "FileNotFound", "m")], "id long, code string, message string")
    r = by_id(jb.retry_or_fail(q, errors, NOW))
    assert (r[1]["status"], r[1]["available_at"]) == ("PENDING", NOW + timedelta(seconds=2)) and r[2]["status"] == "FAILED"
    seen = []
    state = jb.enqueue(empty, want(spark, ("a", "X", "k1")), NOW)
    now = NOW
    for _ in range(5):
        state = spark.createDataFrame(jb.retry_or_fail(jb.claim(state, now), errors.filter("id = 1"), now).collect(), JOBS)
        r = by_id(state)[1]
        seen.append((r["status"], (r["available_at"] - now).total_seconds()))
        now = max(r["available_at"], now)
    assert [s for s, _ in seen] == ["PENDING"] * 4 + ["FAILED"] and [d for _, d in seen[:4]] == [2, 4, 8, 16]
    back = by_id(jb.retry_all_failed(state, now))[1]
    assert (back["status"], back["attempts"], back["last_error_code"]) == ("PENDING", 0, None)


def test_stale_leases(spark, empty):
    q = jb.claim(jb.enqueue(empty, want(spark, ("a", "X", "k1")), NOW), NOW)
    assert by_id(jb.recover_stale(q, NOW + timedelta(seconds=59)))[1]["status"] == "PROCESSING"
    assert by_id(jb.recover_stale(q, NOW + timedelta(seconds=61)))[1]["status"] == "PENDING"


def item(i, folder=1, path=None, status="SUCCEEDED", h="h", text="t", pipeline=None, engine=None):
    return (i, folder, path or f"p{i}", f"p{i}.png", "png", 10, "2026", h, None, None, text, status, engine, None, None, pipeline, None, NOW, NOW)


def test_catalog_changes(spark):
    its = spark.createDataFrame([item(1), item(2, 2), item(3, status="PENDING", text=None)], ITEMS)
    vec = spark.createDataFrame([(1, "m", "1", [1.0], NOW), (2, "m", "1", [1.0], NOW)], VECTORS)
    found = spark.createDataFrame([(1, "new", "new.png", "png", 5, "2026", None)], "folder_id long, path string, filename string, extension string, file_size long, modified_at_fs string, content_hash string")
    new = by_id(cat.insert_items(its, found, NOW))
    assert new[4]["ocr_status"] == "PENDING" and len(new) == 4
    results = spark.createDataFrame([(3, "txt", "e", "1", "en", "e:1")], "id long, ocr_text string, ocr_engine string, ocr_engine_version string, ocr_language string, ocr_pipeline_version string")
    assert by_id(cat.save_text(its, results, NOW))[3]["ocr_text"] == "txt"
    _, left = cat.replace_text(its, vec, results.withColumn("id", results["id"] - 2), NOW)
    assert [r["screenshot_id"] for r in left.collect()] == [2]
    changed = by_id(cat.reset_changed(its, spark.createDataFrame([(1, 11, "2027", "n")], "id long, file_size long, modified_at_fs string, content_hash string"), NOW))
    assert (changed[1]["ocr_text"], changed[1]["ocr_status"], changed[2]["ocr_text"]) == (None, "PENDING", "t")
    failed = by_id(cat.mark_failed(its, its.filter("id = 1").select("id"), NOW))
    assert (failed[1]["ocr_status"], failed[1]["ocr_text"]) == ("FAILED", "t")
    v2 = cat.upsert_vectors(vec, spark.createDataFrame([(1, "m", "2", [2.0], NOW), (9, "m", "2", [2.0], NOW)], VECTORS))
    assert {r["screenshot_id"]: r["model_version"] for r in v2.collect()} == {1: "2", 2: "1", 9: "2"}
    folders = spark.createDataFrame([(1, "C:\\A", 1, 1, NOW, NOW, None), (2, "C:\\b", 1, 1, NOW, NOW, None)], FOLDERS)
    jobs = spark.createDataFrame([], JOBS)
    f, i, v, j = cat.delete_folder(1, folders, its, vec, jobs)
    assert [r["id"] for r in f.collect()] == [2] and [r["id"] for r in i.collect()] == [2] and [r["screenshot_id"] for r in v.collect()] == [2] and j.count() == 0
    assert cat.folder_by_path(folders, "c:\\a").count() == 1
    assert [r["last_scanned_at"] for r in cat.touch_scanned(folders, 2, NOW).orderBy("id").collect()] == [None, NOW]
    i2, v3, _ = cat.delete_items(its.filter("id = 2").select("id"), its, vec)
    assert i2.count() == 2 and v3.count() == 1


def test_aggregates_of_empty_tables(spark):
    its, jobs, vec = spark.createDataFrame([], ITEMS), spark.createDataFrame([], JOBS), spark.createDataFrame([], VECTORS)
    assert tuple(cat.status_counts(its).first()) == (0,) * 5 and tuple(cat.job_counts(jobs).first()) == (0,) * 5
    assert tuple(cat.embedding_coverage(its, vec, "m", "1").first()) == (0, 0, 0)
    assert cat.duplicate_texts(cat.text_digests(its)).count() == 0 and cat.newest_by_hash(its).count() == 0
    assert cat.distinct_items(its).count() == 0 and jb.current_jobs(jobs).count() == 0


def test_reconciliation(spark):
    scan = spark.createDataFrame([("a", 1, "t"), ("b", 2, "t"), ("n", 1, "t")], "path string, file_size long, modified_at_fs string")
    known = spark.createDataFrame([(1, "a", 1, "t"), (2, "b", 1, "t"), (3, "gone", 1, "t"), (4, "shut\\x", 1, "t")], "id long, path string, file_size long, modified_at_fs string")
    diff = rc.scan_diff(scan, known)
    assert {r["path"]: r["action"] for r in diff.collect()} == {"a": "unchanged", "b": "updated", "n": "added", "gone": "missing", "shut\\x": "missing"}
    shut = spark.createDataFrame([("shut",), (None,), ("longer than any path here",)], "path string")
    assert [r["path"] for r in rc.guarded_missing(diff, shut).collect()] == ["gone"]
    assert rc.guarded_missing(diff, shut.filter("path is null")).count() == 2
    assert rc.guarded_missing(diff, shut, gone=spark.createDataFrame([], "path string")).count() == 0
    assert tuple(rc.scan_summary(diff, 2).first()) == (3, 1, 1, 1, 2, 2)
    old = spark.createDataFrame([(3, 1, "h", "gone"), (5, 1, "h", "gone2"), (6, 1, None, "x")], "id long, folder_id long, content_hash string, path string")
    new = spark.createDataFrame([(1, "h", "n"), (1, "h", "m"), (2, "h", "z"), (1, None, "y")], "folder_id long, content_hash string, path string")
    assert [tuple(r) for r in rc.detect_renames(new, old).collect()] == [(5, "gone2", "m")]
