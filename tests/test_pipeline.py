"""Extraction pieces, evaluation figures, files and event streams, by literal cases."""

import hashlib
from datetime import datetime, timedelta

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ocrlake.operators import evaluate as ev
from ocrlake.operators import extract as ex
from ocrlake.schema import EngineError
from ocrlake.sources import files
from ocrlake.streaming import events as se


def one(spark, *columns):
    r = spark.range(1).select(*columns).first()
    return tuple(r) if len(columns) > 1 else r[0]


def test_downscale_and_tiles(spark):
    L = F.lit
    assert one(spark, *ex.downscaled(L(3840), L(2160), L(2600))) == (2600, 1463)
    assert one(spark, *ex.downscaled(L(100), L(50), L(2600))) == (100, 50)
    assert one(spark, *ex.downscaled(L(100000), L(1), L(100))) == (100, 1)
    wide = one(spark, ex.tiles(L(5120), L(1440), L(2600)))
    assert [(t.x, t.width) for t in wide] == [(0, 2000), (1850, 2000), (3700, 1420)]
    tall = one(spark, ex.tiles(L(1080), L(5200), L(2600)))
    assert [(t.y, t.height) for t in tall] == [(0, 2000), (1850, 2000), (3700, 1500)]
    assert len(one(spark, ex.tiles(L(1440), L(10000), L(2600)))) == 6
    assert one(spark, ex.processing_strategy(L(3840), L(2160), L(2600))) == "downscale"


def test_tile_merge():
    a = "Heading\nline two\n\nTransaction alread"
    b = "HEADING\nTransaction already closed\nlast"
    assert ex.merge_tile_lines([a, b, ""]) == "Heading\nline two\nTransaction already closed\nlast"
    assert ex.merge_tile_lines([]) == ""


LINES = {
    "Technical": ["https://x.y", "C:\\Users\\x", "a/b/c", "see /opt/bin here", "file main.rs open", "Error: none", "code P2028", "npm run dev", "pid=14092", "0x80004005", "ORA-12154", "$ ls", "SELECT a FROM b", "x->y", "@swc/helpers", "at foo.bar"],
    "Natural": ["Tìm kiếm ảnh chụp màn hình", "this is a plain sentence of words"],
    "Uncertain": ["", "   ", None],
}


def test_line_classes(spark):
    rows = [(line, label) for label, lines in LINES.items() for line in lines]
    got = spark.createDataFrame(rows, "line string, label string").select("line", "label", ex.classify_line(F.col("line")).alias("got")).collect()
    assert [(r["line"], r["got"]) for r in got if r["got"] != r["label"]] == []


def test_capitals_are_never_natural(spark):
    rows = [(s,) for s in ("BUILD FAILED", "CONNECTION RESET", "ACCESS DENIED", "OUT OF MEMORY")]
    assert all(r[0] != "Natural" for r in spark.createDataFrame(rows, "s string").select(ex.classify_line(F.col("s"))).collect())


def test_candidate_choice(spark):
    cases = [(" ", "b", "b"), ("a", " ", "a"), ("abc", "abc and more", "abc and more"), ("a b", "a=b", "a=b"), ("a b", "a_b", "a_b"), ("a = b", "a=b", "a=b"), ("keep", "kept", "keep")]
    rows = spark.createDataFrame(cases, "a string, b string, want string").select("want", ex.choose_candidate(F.col("a"), F.col("b")).alias("got")).collect()
    assert all(r["want"] == r["got"] for r in rows)
    seconds = spark.createDataFrame([("Migration", True), ("a =b", True), ("", True), ("plain", False)], "a string, want boolean").select("want", ex.needs_second_pass(F.col("a")).alias("got")).collect()
    assert all(r["want"] == r["got"] for r in seconds)


def flood(prob, least=0.35, min_area=16):
    on, seen, out = prob >= least, set(), []
    for y, x in zip(*np.nonzero(on)):
        if (y, x) in seen:
            continue
        stack, cells = [(y, x)], []
        seen.add((y, x))
        while stack:
            cy, cx = stack.pop()
            cells.append((cy, cx))
            for ny, nx in ((cy + 1, cx), (cy - 1, cx), (cy, cx + 1), (cy, cx - 1)):
                if 0 <= ny < on.shape[0] and 0 <= nx < on.shape[1] and on[ny, nx] and (ny, nx) not in seen:
                    seen.add((ny, nx))
                    stack.append((ny, nx))
        ys, xs = [c[0] for c in cells], [c[1] for c in cells]
        if len(cells) >= min_area and max(xs) - min(xs) >= 4 and max(ys) - min(ys) >= 4:
            out.append((min(xs), min(ys), max(xs), max(ys)))
    return sorted(out)


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10_000), st.floats(0.3, 0.8))
def test_boxes_against_flood_fill(seed, density):
    prob = (np.random.default_rng(seed).random((24, 30)) < density).astype(np.float32)
    assert sorted(ex.boxes_of_map(prob)) == flood(prob)


def test_box_lines():
    assert ex.merge_boxes([(50, 2, 60, 11), (0, 0, 10, 10), (0, 40, 9, 50), (12, 1, 40, 9)]) == [(0, 0, 60, 11), (0, 40, 9, 50)]
    assert ex.merge_boxes([]) == []


def test_decoding(spark):
    logits = np.eye(3)[[1, 1, 0, 1, 2]]
    assert ex.ctc_text(logits, ["", "A", "B"]) == "AAB" and ex.ctc_text(np.zeros((0, 3)), ["", "A"]) == ""
    df = spark.createDataFrame([([0.0, 1.0, 0.0] + [9.0],), (None,)], "v array<float>")
    assert [r[0] for r in df.select(ex.ctc_decoded(["", "A", "B"], 3)("v")).collect()] == ["A", None]
    script = iter([4, 5, 2])
    assert ex.greedy_decode(lambda tokens: np.eye(8)[next(script)], "xyz") == "xy"
    assert len(ex.greedy_decode(lambda tokens: np.eye(8)[4], "xyz")) == 128


def test_engines(spark):
    assert ex.route("auto", ex.EngineState(native_has_vietnamese=True, hybrid_ready=True)) == [ex.NATIVE]
    assert ex.route("auto", ex.EngineState(hybrid_ready=True)) == [ex.HYBRID, ex.NATIVE]
    assert ex.route("auto", ex.EngineState(hybrid_ready=True, hybrid_approved=False)) == [ex.NATIVE]
    assert ex.target_pipeline("hybrid_vietnamese", ex.EngineState(hybrid_ready=True)) == ex.HYBRID_PIPELINE
    with pytest.raises(EngineError):
        ex.route("hybrid_vietnamese", ex.EngineState())
    with pytest.raises(EngineError):
        ex.parse_mode("x")
    rows = spark.createDataFrame([(1, "ok"), (2, "bad"), (3, "blank")], "id long, path string")
    bad = ex.mock_engine(failing=frozenset(["bad"]), empty=frozenset(["blank"]))
    assert tuple(ex.batch_summary(ex.recognise(rows, {"a": bad}, ["a"])).first()) == (3, 2, 1, 1)
    both = ex.recognise(rows, {"a": bad, "b": ex.mock_engine("second")}, ["a", "b"]).collect()
    assert {r["id"]: r["ocr_text"] for r in both} == {1: "mock text", 2: "second", 3: ""}


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@given(st.text("abc", max_size=90), st.text("abc", max_size=90))
def test_edit_distance(a, b):
    assert ev.edit_distance(list(a), list(b)) == plain_distance(a, b)


def test_error_rates(spark):
    pairs = spark.createDataFrame([("Tìm kiếm ảnh", "Tim kiem anh"), ("same", "same"), ("", ""), ("", "x"), (None, "x")], "ref string, hyp string")
    got = [(r["cer"], r["wer"]) for r in ev.error_rates(pairs).collect()]
    assert got[0] == (3 / 12, 1.0) and got[1:4] == [(0.0, 0.0), (0.0, 0.0), (1.0, 1.0)]
    r = ev.overall_rates(ev.error_rates(pairs)).first()
    assert r["cer"] == pytest.approx(4 / 16) and r["median_cer"] == pytest.approx(0.25)


def test_latency_and_confusion(spark):
    t = spark.createDataFrame([("a", v) for v in range(1, 12)] + [("a", None)], "k string, v long")
    r = ev.latency_figures(t, "v", ["k"]).first()
    assert (r["n"], r["p50"], r["p90"], r["p95"], r["least"], r["greatest"]) == (11, 7, 11, 11, 1, 11)
    c = spark.createDataFrame([("T", "T"), ("T", "N"), ("N", "N"), ("N", "N")], "t string, g string")
    assert tuple(ev.confusion(c, "t", "g", "T", "N").first()) == (0.5, 1.0, 1.0, pytest.approx(2 / 3))
    assert tuple(ev.confusion(c.limit(0), "t", "g", "T", "N").first()) == (0.0,) * 4


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, body in (("a.PNG", b"one"), ("b.txt", b"two"), ("sub/c.webp", b"three")):
        (tmp_path / name).write_bytes(body)
    got = files.scan_directory(spark, str(tmp_path)).orderBy("filename").collect()
    assert [(r["filename"], r["extension"], r["file_size"]) for r in got] == [("a.PNG", "png", 3), ("c.webp", "webp", 5)]
    assert files.scan_directory(spark, str(tmp_path), recursive=False).count() == 1
    with pytest.raises(EngineError):
        files.scan_directory(spark, str(tmp_path / "none"))
    paths = spark.createDataFrame([(str(tmp_path / "a.PNG"),), (str(tmp_path / "gone.png"),)], "path string")
    prints = {r["path"].rsplit("/", 1)[1]: (r["content_hash"], r["error_code"]) for r in files.fingerprints(paths).collect()}
    assert prints == {"a.PNG": (hashlib.sha256(b"one").hexdigest(), None), "gone.png": (None, "FileNotFound")}
    assert files.image_data_urls(spark, [str(tmp_path / "a.PNG")]).first()["data_url"] == "data:image/png;base64,b25l"
    good = hashlib.sha256(b"model").hexdigest()
    asset = files.Asset(str(tmp_path / "m.onnx"), good.upper())
    with pytest.raises(EngineError):
        files.install_asset(asset, b"other")
    assert not (tmp_path / "m.onnx").exists() and not (tmp_path / "m.onnx.part").exists()
    files.install_asset(asset, b"model")
    assert files.verify_asset(asset) and files.ping(spark)


T0 = datetime(2026, 1, 1)
RAW = "event_id long, folder_id long, kind string, path string, to_path string, ts timestamp"


def raw(*rows):
    return [(i, 1, k, p, q, T0 + timedelta(milliseconds=ms)) for i, (k, p, q, ms) in enumerate(rows)]


def test_event_forms(spark):
    rows = raw(("create", "a.png", None, 0), ("create", "a.txt", None, 0), ("rename_both", "a.png", "b.png", 0), ("rename_both", "a.tmp", "b.png", 0), ("rename_both", "a.png", "b.tmp", 0), ("rename_from", "a.png", None, 0), ("rename_to", "b.png", None, 0), ("remove", "a.png", None, 0), ("other", "a.png", None, 0))
    got = se.normalize_events(spark.createDataFrame(rows, RAW)).select("kind", "path", "to_path").collect()
    assert [tuple(r) for r in got] == [("upsert", "a.png", None), ("rename", "a.png", "b.png"), ("upsert", "b.png", None), ("remove", "a.png", None), ("remove", "a.png", None), ("upsert", "b.png", None), ("remove", "a.png", None)]


def test_debounce_batch(spark):
    rows = raw(*[("modify", "a.png", None, 100 * k) for k in range(55)], ("remove", "a.png", None, 5600), ("create", "a.png", None, 7000), ("rename_both", "x.png", "y.png", 0))
    single = se.per_path_events(se.normalize_events(spark.createDataFrame(rows, RAW)))
    got = sorted((r["path"], r["kind"], r["n"]) for r in se.debounce(single).collect())
    assert got == [("a.png", "remove", 56), ("a.png", "upsert", 1), ("x.png", "remove", 1), ("y.png", "upsert", 1)]
    jobs = {r["dedupe_key"]: r["job_type"] for r in se.event_jobs(se.debounce(single, keys=("folder_id", "path"))).collect()}
    assert jobs["DELETE:1:x.png"] == "DELETE_SCREENSHOT" and jobs["UPSERT:1:y.png:"] == "UPSERT_SCREENSHOT"


def stream(spark, tmp_path, rows, make, name):
    src = str(tmp_path / name)
    for i, part in enumerate(rows):
        spark.createDataFrame(part, RAW).coalesce(1).write.mode("append").parquet(f"{src}/{i:03d}")
    events = spark.readStream.schema(RAW).option("maxFilesPerTrigger", "1").option("recursiveFileLookup", "true").parquet(src)
    out = make(se.per_path_events(se.normalize_events(events)))
    q = out.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"ck-{name}")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None
    return spark.sql(f"SELECT * FROM {name}").collect()


def test_debounce_stream_equals_batch(spark, tmp_path):
    rows = raw(*[("modify", f"p{k % 5}.png", None, 170 * k) for k in range(40)], ("remove", "p1.png", None, 9000), ("create", "late.png", None, 60_000))
    make = lambda df: se.debounce(df, watermark="0 seconds")
    got = stream(spark, tmp_path, [rows[:25], rows[25:41], rows[41:]], make, "sessions")
    batch = se.debounce(se.per_path_events(se.normalize_events(spark.createDataFrame(rows, RAW)))).filter("path <> 'late.png'").collect()
    key = lambda r: (r["path"], r["started_at"], r["kind"], r["n"])
    assert sorted(map(key, got)) == sorted(map(key, batch))


def test_debounce_with_timers(spark, tmp_path):
    first, second, third = raw(("create", "a.png", None, 0)), raw(("remove", "a.png", None, 300)), raw(("create", "z.png", None, 60_000))
    got = stream(spark, tmp_path, [first, second, third, raw(("create", "z.png", None, 61_000))], lambda df: se.debounce_stateful(df.select("path", "kind", "ts")), "timers")
    assert [(r["path"], r["kind"], r["n"]) for r in got if r["path"] == "a.png"] == [("a.png", "remove", 2)]


def test_stability(spark):
    rows = [("a", 1, 5, "t", True), ("a", 2, 6, "t", True), ("a", 3, 6, "t", True), ("b", 1, 5, "t", True), ("b", 2, 6, "t", True), ("c", 1, 5, "t", False), ("c", 2, 5, "t", False)]
    got = se.stable_observations(spark.createDataFrame(rows, "path string, attempt int, file_size long, modified_at_fs string, readable boolean")).collect()
    assert [tuple(r) for r in got] == [("a", 3, 6, "t")]
