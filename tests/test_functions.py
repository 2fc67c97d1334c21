import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from ocrlake.functions import paths as pt
from ocrlake.functions import text as tx
from ocrlake.functions import vectors as vx


def values(spark, rows, *columns, schema="s string"):
    return [tuple(r) if len(columns) > 1 else r[0] for r in spark.createDataFrame([(x,) if not isinstance(x, tuple) else x for x in rows], schema).select(*columns).collect()]


NORMAL = {
    "ERR_MODULE_NOT_FOUND": "err module not found",
    "localhost:3000": "localhost 3000",
    "v1.2.3": "v1.2.3",
    "192.168.1.1": "192.168.1.1",
    "invoice-september-2026.png": "invoice september 2026.png",
    "a. b .c ...d": "a b c d",
    "Lo\u0302\u0303i  \u00a0x": "l\u1ed7i x",
    "": "",
}


def test_search_normalisation(spark):
    assert values(spark, list(NORMAL), tx.normalize_search_text(F.col("s"))) == list(NORMAL.values())
    assert [tx.normalize_search_query(k) for k in NORMAL] == list(NORMAL.values())


def test_tokens_fold_marks_but_not_strokes(spark):
    assert values(spark, ["Lỗi đóng_X-1.2"], tx.fts_tokens(F.col("s"))) == [["loi", "đong", "x", "1", "2"]]


def test_query_phrases_and_safe_query():
    assert tx.query_phrases("192.168.1 lỗi") == [["192", "168", "1"], ["loi"]]
    for q in ['"', '""', "*", "(", ")", "::*^%$#@!", "  ", ""]:
        assert tx.query_phrases(q) is None and tx.safe_fts_query(q) is None
    assert tx.safe_fts_query('hello "world AND x.y') == '"hello"* AND "world"* AND "and"* AND "x.y"*'


def test_ocr_normalisation(spark):
    raw = ["a\r\nb\rc", "x \t\n\n\n\ny\x07", "\n\n  a\u3000\n", None]
    assert values(spark, raw, tx.normalize_ocr_text(F.col("s"))) == ["a\nb\nc", "x\n\ny", "a", None]


def test_technical_tokens(spark):
    yes, no = ["P2028", "ERR_MODULE_NOT_FOUND", "HTTP", "500", "3000", "package.json", "C:\\x"], ["lỗi", "database", "hôm", "A", "12"]
    assert values(spark, yes + no, tx.is_technical_token(F.col("s"))) == [True] * len(yes) + [False] * len(no)
    assert [tx.is_technical_word(w) for w in yes + no] == [True] * len(yes) + [False] * len(no)


def test_signals(spark):
    rows = [("shot.png", "Lỗi P2028 here"), ("p2028.png", None), ("x", "none")]
    assert values(spark, rows, tx.exact_signal("see P2028", F.col("f"), F.col("t")), schema="f string, t string") == [1.0, 1.0, 0.0]
    assert values(spark, rows, tx.exact_signal("  ", F.col("f"), F.col("t")), schema="f string, t string") == [0.0] * 3
    m = values(spark, [(1.0, 0.0, 0.0), (0.0, 0.5, 0.7), (0.0, 0.5, 0.6), (0.0, 0.0, 0.9)], tx.match_type(F.col("e"), F.col("f"), F.col("s")), schema="e double, f double, s double")
    assert m == ["exact", "hybrid", "keyword", "semantic"]
    assert values(spark, [(-3.0,), (2.0,)], tx.bm25_score_norm(F.col("b")), schema="b double") == [0.75, 0.0]
    assert values(spark, [(-3.0,), (0.4,), (2.0,)], tx.cosine_score_norm(F.col("b")), schema="b double") == [0.0, 0.4, 1.0]


def test_snippets_and_documents(spark):
    long = "x" * 130 + " lỗi tail"
    assert values(spark, ["", "short", long], tx.semantic_snippet("lỗi", F.col("s"))) == [None, "short", "..." + "x" * 39 + " lỗi tail..."]
    assert values(spark, [" body "], tx.semantic_document(F.lit(" f.png "), F.col("s"))) == ["Filename: f.png\nContent:\nbody"]
    assert values(spark, [" \n"], tx.semantic_document(F.lit("f.png"), F.col("s"))) == ["Filename: f.png"]
    assert values(spark, ["a [[match]]b[[/match]] c"], tx.match_markers(F.col("s")), tx.strip_markers(F.col("s"))) == [(["b"], "a b c")]
    assert values(spark, [(0, 0), (1, 3), (9, 3)], tx.progress_percent(F.col("a"), F.col("b")), schema="a int, b int") == [0, 33, 100]


def test_re_ocr_target(spark):
    keys = ["RE_OCR:42:abc123:hybrid_windows_vietocr:hybrid_v2", "re_ocr:1:2:3", "RE_OCR:1:2:", None]
    assert values(spark, keys, tx.re_ocr_target_pipeline(F.col("s"))) == ["hybrid_windows_vietocr:hybrid_v2", None, None, None]


PATHS = {
    "c:\\": "C:\\",
    "C:/Users/Pho/Screenshots/": "C:\\Users\\Pho\\Screenshots",
    "\\\\?\\UNC\\server\\share\\folder": "\\\\server\\share\\folder",
    "\\\\?\\d:\\x\\\\": "D:\\x",
    "": "",
}


def test_paths(spark):
    assert values(spark, list(PATHS), pt.normalize_path(F.col("s"))) == list(PATHS.values())
    assert [pt.normalize_path_of(p) for p in PATHS] == list(PATHS.values())
    names = {"C:\\a\\B.PNG": True, "C:\\a\\.hidden.png": False, "C:\\a\\~$b.png": False, "x.png.tmp": False, "x.crdownload": False, "dir\\": False, "x.gif": False, "y.webp": True}
    assert values(spark, list(names), pt.is_supported_image(F.col("s"))) == list(names.values())
    assert values(spark, ["png", "JPG", "webp", "gif", ""], pt.media_type(F.col("s"))) == ["image/png", "image/jpeg", "image/webp", "application/octet-stream", "application/octet-stream"]
    assert values(spark, ["/screenshot/12.png", "image://localhost/7", "/x/"], pt.item_id_of_uri(F.col("s"))) == [12, 7, None]
    long = "data:image/png;base64," + __import__("base64").b64encode(b"x" * 200).decode()
    assert values(spark, ["x" * 200], pt.data_url(F.lit("png"), F.encode("s", "utf-8"))) == [long]


def test_cosine_and_codec(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 2.0]), ([1.0, 0.0], [-3.0, 0.0]), ([1.0], [1.0, 2.0]), ([0.0], [0.0]), ([], [])], "a array<float>, b array<float>")
    assert [r[0] for r in df.select(vx.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, -1.0, 0.0, 0.0, 0.0]
    back = df.select("a", vx.decode_vector(vx.encode_vector("a")).alias("r")).collect()
    assert all(r["a"] == r["r"] for r in back)
    odd = spark.createDataFrame([(bytearray(b"\x00\x00\x80\x3fzz"),)], "b binary").select(vx.decode_vector("b")).first()[0]
    assert odd == [1.0]


def test_mock_embedding():
    a, b = vx.mock_embedding_of("payment success"), vx.mock_embedding_of("thanh toán thành công")
    assert len(a) == 384 and abs(np.linalg.norm(a) - 1) < 1e-5
    assert np.dot(a, b) >= 0.70 and vx.mock_embedding_of(" ... ")[0] == 1.0


@pytest.mark.parametrize("q", ["alpha", "beta gam", "x.y a", "192.168.1"])
def test_phrases_equal_sqlite_tokens(spark, q):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(x, tokenize='unicode61 remove_diacritics 2')")
    con.execute("INSERT INTO t VALUES (?)", ("alpha beta gamma x.y.z 192.168.1.1 a",))
    match = " AND ".join('"' + " ".join(p) + '"*' for p in tx.query_phrases(q))
    assert con.execute("SELECT count(*) FROM t WHERE t MATCH ?", (match,)).fetchone()[0] == 1


@pytest.mark.parametrize("word", ["май", "ガイド", "Άλφα", "đường", "naïve", "ﾊﾝｶｸ", "ΣΊΣΥΦΟΣ", "ǽon", "हिन्दी", "Ёлка", "école"])
def test_one_fold_for_index_and_query(spark, word):
    """Whole words, beginnings of them and their decomposed spelling are found as the independent engine finds them."""
    import unicodedata

    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(x, tokenize='unicode61 remove_diacritics 2')")
    con.execute("INSERT INTO t VALUES (?)", (tx.normalize_search_query(word + " end"),))
    index = spark.createDataFrame([(word + " end",)], "s string").select(tx.fts_tokens(tx.normalize_search_text(F.col("s"))).alias("t")).first()["t"]
    for asked in (word, word[: len(word) - 1], unicodedata.normalize("NFD", word), word.upper()):
        for phrase in tx.query_phrases(asked) or []:
            ours = any(index[i : i + len(phrase) - 1] == phrase[:-1] and index[i + len(phrase) - 1].startswith(phrase[-1]) for i in range(len(index) - len(phrase) + 1))
            theirs = con.execute("SELECT count(*) FROM t WHERE t MATCH ?", ('"' + " ".join(phrase) + '"*',)).fetchone()[0]
            assert ours == bool(theirs), (asked, phrase)
    assert tx.query_phrases(word)


def test_bytes_of_a_key_and_value_count(spark):
    from ocrlake.operators import extract as ex

    lines = {"đ=éa": True, "a=ba": False, "ab=ba": True, "x 0xé": True, "x 0xa": False, "SIGé": True, "SIGa": False, "a=b=c1": False}
    got = [r[0] for r in spark.createDataFrame([(k,) for k in lines], "s string").select(ex.strong_technical(F.col("s"))).collect()]
    assert got == list(lines.values())


def test_boxes_join_pass_by_pass():
    from ocrlake.operators import extract as ex

    # the first box reaches the second only after it has taken in the third: the next pass joins them
    boxes = [(85, 0, 95, 9), (0, 0, 10, 9), (40, 0, 60, 9), (400, 0, 410, 9)]
    assert ex._joined_once(boxes) == [(40, 0, 95, 9), (0, 0, 10, 9), (400, 0, 410, 9)]
    assert ex.merge_boxes(boxes) == [(0, 0, 95, 9), (400, 0, 410, 9)]
    assert ex.merge_boxes([(0, 0, 9, 9), (0, 40, 9, 49)]) == [(0, 0, 9, 9), (0, 40, 9, 49)] and ex.merge_boxes([]) == []
