from datetime import datetime, timezone

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from ocrlake.operators import incremental as inc
from ocrlake.operators.changes import apply_changes, current_files

STATE = "screenshot_id long, run_id long, file_size long, modified_at_fs string, content_hash string, ocr_pipeline_version string, recorded_at timestamp"
SHOTS = "id long, file_size long, modified_at_fs string, content_hash string, ocr_pipeline_version string"


def at(hour):
    return datetime(2026, 1, 1, hour, tzinfo=timezone.utc)


def found(spark, shots, state, runs):
    manifest = inc.committed_state(spark.createDataFrame(state, STATE), spark.createDataFrame(runs, "run_id long, status string"))
    return sorted(r[0] for r in inc.pending(spark.createDataFrame(shots, SHOTS), manifest).collect())


def test_cases_of_change(spark):
    t = "2026-01-01T00:00:00Z"
    shots = [
        (1, 5, t, "a", "v"),  # as committed
        (2, 5, t, "b", "v"),  # other hash
        (3, 6, "2027-01-01T00:00:00Z", "a", "v"),  # size and time only, hashes known and equal
        (4, 5, "2026-01-01T07:00:00.000000+07:00", None, "v"),  # no hash, same instant
        (5, 5, "2026-01-01T00:00:01Z", None, "v"),  # no hash, other instant
        (6, 5, t, "a", None),  # pipeline gone
        (7, 5, t, "a", None),  # pipeline null on both sides
        (8, 5, t, "a", "v"),  # never committed
        (9, 5, t, "a", "v"), (9, 5, t, "a", "v"),  # delivered twice, never committed
        (10, None, t, None, "v"),  # null size on both sides
        (None, 5, t, "a", "v"),
    ]
    state = [(i, 1, 5, t, "a", "v", at(1)) for i in (1, 2, 3, 6)]
    state += [(4, 1, 5, t, "a", "v", at(1)), (5, 1, 5, t, "a", "v", at(1)), (7, 1, 5, t, "a", None, at(1)), (8, 2, 5, t, "a", "v", at(1)), (10, 1, None, t, "a", "v", at(1))]
    assert found(spark, shots, state, [(1, "SUCCEEDED"), (2, "FAILED"), (3, "RUNNING")]) == [2, 5, 6, 8, 9]


def test_latest_success_counts(spark):
    t = "2026-01-01T00:00:00Z"
    shots = [(1, 5, t, "new", "v"), (2, 5, t, "new", "v")]
    state = [(1, 1, 5, t, "old", "v", at(9)), (1, 2, 5, t, "new", "v", at(1)), (1, 3, 5, t, "old", "v", at(9)), (2, 2, 5, t, "new", "v", at(1)), (2, 2, 5, t, "old", "v", at(2)), (2, 2, 5, t, "old", "v", at(2))]
    assert found(spark, shots, state, [(1, "SUCCEEDED"), (2, "SUCCEEDED"), (2, "SUCCEEDED"), (3, "FAILED")]) == [2]


def test_empty_tables(spark):
    t = "2026-01-01T00:00:00Z"
    assert found(spark, [], [], []) == []
    assert found(spark, [(1, 5, t, "a", "v")], [], []) == [1]


def test_shuffled_run_list_gives_the_same(spark):
    t = "2026-01-01T00:00:00Z"
    state = spark.createDataFrame([(1, 1, 5, t, "a", "v", at(1))], STATE)
    runs = spark.createDataFrame([(1, "SUCCEEDED")], "run_id long, status string")
    assert inc.committed_state(state, runs, max_broadcast_runs=0).collect() == inc.committed_state(state, runs).collect()


class Dies(Exception):
    pass


def _listing(spark, files):
    """files: (path, size, checksum) or (path, size, checksum, time, version)"""
    rows = [(p, n, (more or ["2026-01-01T00:00:00Z"])[0], h, (more or [None, "v"])[1]) for p, n, h, *more in files]
    return spark.createDataFrame(rows, "path string, file_size long, modified_at_fs string, content_hash string, ocr_pipeline_version string")


@pytest.mark.parametrize("step", ["planned", "written"])
def test_a_run_that_dies_is_neither_skipped_nor_repeated(spark, tmp_path, step):
    root = f"file://{tmp_path}/job"
    layout = inc.Layout(root)
    root = layout

    def die(at_step):
        if at_step == step:
            raise Dies

    first = _listing(spark, [("a", 1, "x"), ("b", 2, "y"), ("b", 2, "y"), (None, 1, "z")])
    assert inc.run_incremental(spark, first, root, lambda df: df.select("path"), inc.new_batch_id(1)) == 2
    second = _listing(spark, [("a", 1, "x"), ("b", 2, "changed"), ("c", 3, None)])
    with pytest.raises(Dies):
        inc.run_incremental(spark, second, root, lambda df: df.select("path"), inc.new_batch_id(2), on_step=die)
    assert inc.committed_batches(spark, layout) == [inc.new_batch_id(1)]
    assert inc.read_output(spark, layout).count() == 2
    assert inc.run_incremental(spark, second, root, lambda df: df.select("path"), inc.new_batch_id(2)) == 2
    assert inc.run_incremental(spark, second, root, lambda df: df.select("path"), inc.new_batch_id(2)) == 0
    assert inc.run_incremental(spark, second, root, lambda df: df.select("path"), inc.new_batch_id(3)) == 0
    out = sorted((r["batch_id"], r["path"]) for r in inc.read_output(spark, layout).select("batch_id", "path").collect())
    assert [p for _, p in out] == ["a", "b", "b", "c"]
    with pytest.raises(ValueError):
        inc.run_incremental(spark, second, root, lambda df: df, inc.new_batch_id(0))


def test_one_predicate_for_the_cycle(spark, tmp_path):
    """Unknown checksums, times and processing versions count in a run as they do in ``pending``."""
    layout = inc.Layout(f"file://{tmp_path}/job")
    done = []

    def run(number, files):
        return inc.run_incremental(spark, _listing(spark, files), layout, lambda df: df.select("path"), inc.new_batch_id(number))

    t, later = "2026-01-01T00:00:00Z", "2026-01-02T00:00:00Z"
    assert run(1, [("a", 1, None, t, "v"), ("b", 1, "x", t, "v"), ("c", 1, "x", t, "v"), ("d", 1, None, t, "v")]) == 4
    assert run(2, [("a", 1, None, later, "v"), ("b", 2, "x", later, "v"), ("c", 1, "x", t, "w"), ("d", 1, None, "2026-01-01T07:00:00+07:00", "v")]) == 2
    assert sorted(r["path"] for r in inc.read_output(spark, layout).filter("batch_id = 'b000000000002'").collect()) == ["a", "c"]
    assert done == []


def test_manifest_is_merged_now_and_then(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(inc, "COMPACT_EVERY", 2)
    layout = inc.Layout(f"file://{tmp_path}/job")
    for k in range(1, 6):
        rows = _listing(spark, [(f"f{i}", i, f"h{i}" if i else f"h{k}") for i in range(k)])
        assert inc.run_incremental(spark, rows, layout, lambda df: df.select("path"), inc.new_batch_id(k)) == (1 if k == 1 else 2)
    assert inc.committed_batches(spark, layout) == [inc.new_batch_id(k) for k in range(1, 6)]
    assert len(inc._names(spark, layout, "base")) == 2 and len(inc._after(spark, layout, inc._latest_base(spark, layout))) == 1
    assert inc.read_output(spark, layout).count() == 9
    assert inc.run_incremental(spark, _listing(spark, [("f0", 0, "h5")]), layout, lambda df: df.select("path"), inc.new_batch_id(2)) == 0
    assert {r["screenshot_id"]: r["content_hash"] for r in inc.read_manifest(spark, layout).collect()} == {"f0": "h5", **{f"f{i}": f"h{i}" for i in range(1, 5)}}


def brute_force(changes):
    rows = {}
    for seq, op, key, a, b in sorted((c for c in changes if c[0] is not None), key=lambda c: (c[0], {"DELETE": 0, "REPLACE": 1, "UPSERT": 2}[c[1]])):
        if op == "DELETE":
            rows.pop(key, None)
        elif op == "REPLACE":
            rows[key] = [a, b]
        else:
            row = rows.setdefault(key, [None, None])
            row[:] = [a if a is not None else row[0], b if b is not None else row[1]]
    return sorted((k, *v) for k, v in rows.items())


change = st.tuples(st.integers(1, 8), st.sampled_from(["UPSERT", "REPLACE", "DELETE"]), st.sampled_from(["k", "l"]), st.sampled_from([None, "x", "y"]), st.sampled_from([None, "u"]))


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(change, max_size=14), st.randoms())
def test_changes_against_brute_force(spark, changes, rnd):
    # one change per sequence number, delivered again and out of order
    once = list({c[0]: c for c in changes}.values())
    sent = once + [c for c in once if rnd.random() < 0.3]
    rnd.shuffle(sent)
    feed = spark.createDataFrame(sent, "seq long, op string, k string, a string, b string")
    got = apply_changes(feed, ["k"], "seq", "op", ["a", "b"]).collect()
    key = lambda row: [(x is not None, x or "") for x in row]
    assert sorted(map(tuple, got), key=key) == sorted(brute_force(once), key=key)


def test_changes_with_clashing_column_names(spark):
    feed = spark.createDataFrame([(1, "UPSERT", "k", "x", 9, 9)], "seq long, op string, at string, v string, gone int, w0 int")
    assert [tuple(r) for r in apply_changes(feed, ["at"], "seq", "op", ["v"]).collect()] == [("k", "x")]


JOBS = "id long, folder_id long, path string, job_type string, status string, dedupe_key string"


def test_current_files(spark):
    rows = [
        (1, 4, "C:\\a.png", "UPSERT_SCREENSHOT", "SUCCEEDED", "UPSERT:4:C:\\a.png:h1"),
        (2, 4, None, " upsert_screenshot", "FAILED", "UPSERT:4:c:/a.png:h2"),
        (2, 4, None, " upsert_screenshot", "PENDING", "UPSERT:4:c:/a.png:h2"),
        (3, 4, "x", "DELETE_SCREENSHOT", "PENDING", "DELETE:4:\\\\?\\C:\\b.png"),
        (4, 4, "x", "UPSERT_SCREENSHOT", "PENDING", "UPSERT:4:C:\\b.png:"),
        (5, 4, None, "Delete_screenshot ", "PENDING", "DELETE:4:\\\\?\\UNC\\s\\d\\c.png"),
        (1, 4, "\\\\s\\d\\c.png", "UPSERT_SCREENSHOT", "PENDING", "UPSERT:4:\\\\s\\d\\c.png:h"),
        (9, 4, "C:\\a.png", "RE_OCR_SCREENSHOT", "PENDING", "RE_OCR:1:h:p"),
        (7, 5, "C:\\a.png", "UPSERT_SCREENSHOT", "PENDING", "UPSERT:5:C:\\a.png:h7"),
        (8, 5, "D:\\only.png", "UPSERT_SCREENSHOT", "PENDING", None),
        (None, 5, "D:\\none.png", "UPSERT_SCREENSHOT", "PENDING", "UPSERT:5:D:\\none.png:h"),
    ]
    got = sorted(map(tuple, current_files(spark, spark.createDataFrame(rows, JOBS)).collect()))
    assert got == [(4, "C:\\a.png", "h2"), (4, "C:\\b.png", ""), (5, "C:\\a.png", "h7"), (5, "D:\\only.png", "")]
    assert current_files(spark, spark.createDataFrame([], JOBS)).count() == 0
