"""Search against an independent full-text engine, and the literal cases of search behaviour."""

import random
import sqlite3

import pytest

from ocrlake.functions.text import normalize_search_query, query_phrases
from ocrlake.functions.vectors import mock_embedding_of
from ocrlake.operators import fts, hybrid
from ocrlake.operators import invindex as inv
from ocrlake.schema import ITEMS

WORDS = "alpha beta gamma delta err.x 10.4 alphabet bet zeta lỗi menu".split()


def items(spark, rows):
    """rows: (id, folder_id, filename, modified, text, status)"""
    full = [(i, f, "p" + str(i), fn, "png", 1, m, None, None, None, t, s, None, None, None, None, None, None, None) for i, f, fn, m, t, s in rows]
    return spark.createDataFrame(full, ITEMS)


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rnd = random.Random(3)
    rows = []
    for i in range(1, 121):
        text = " ".join(rnd.choice(WORDS) for _ in range(rnd.randint(0, 40)))
        rows.append((i, i % 3, f"{rnd.choice(WORDS)}-{i}.png", f"2026-01-{i % 9 + 1:02d}", text, "SUCCEEDED"))
    index = fts.build_index(items(spark, rows)).cache()
    global STORED
    STORED = inv.write_index(items(spark, rows), f"file://{tmp_path_factory.mktemp('index')}/i")
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(filename, body, tokenize='unicode61 remove_diacritics 2')")
    for r in rows:
        con.execute("INSERT INTO t(rowid, filename, body) VALUES (?, ?, ?)", (r[0], r[2], normalize_search_query(r[4])))
    return index, con


def match(q):
    return " AND ".join('"' + " ".join(p) + '"*' for p in query_phrases(q))


@pytest.mark.parametrize("q", ["alpha", "bet", "loi men", "10.4 beta", "err.x", "alpha beta gamma", "zeta 10.4"])
def test_rank_and_snippets_equal_sqlite(spark, corpus, q):
    index, con = corpus
    sql = "SELECT rowid, bm25(t, 5.0, 1.0), coalesce(nullif(snippet(t, 1, '[[match]]', '[[/match]]', '...', 20), ''), snippet(t, 0, '[[match]]', '[[/match]]', '...', 10)) FROM t WHERE t MATCH ?"
    theirs = {i: (b, s) for i, b, s in con.execute(sql, (match(q),))}
    ours = {r["id"]: (r["bm25"], r["snippet"]) for r in fts.snippets(fts.keyword_matches(index, q), q).select("id", "bm25", "snippet").collect()}
    assert ours.keys() == theirs.keys()
    assert ours
    stored = {r["id"]: r["bm25"] for r in inv.keyword_matches(STORED, q).collect()}
    assert stored == pytest.approx({i: b for i, (b, _) in ours.items()})
    for i in ours:
        assert ours[i][0] == pytest.approx(theirs[i][0], rel=1e-9)
        assert ours[i][1] == theirs[i][1]


def test_batch_equals_single_queries(spark, corpus):
    index, _ = corpus
    asked = ["alpha", "bet", "10.4 beta", "loi men", "", None, "***"]
    requests = spark.createDataFrame(list(enumerate(asked)) + [(0, "alpha")], "request_id long, query_text string")
    got = {(r["request_id"], r["id"]): r["bm25"] for r in inv.batch_matches(STORED, requests).collect()}
    want = {(k, r["id"]): r["bm25"] for k, q in enumerate(asked) if q for r in fts.keyword_matches(index, q).collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in got)
    assert inv.batch_matches(STORED, requests.filter("request_id = 4")).count() == 0


def test_scan_reads_the_tokens_of_the_query(spark, corpus, capsys):
    inv.keyword_matches(STORED, "alpha bet").explain("formatted")
    plan = capsys.readouterr().out
    assert "StringStartsWith(token,alpha)" in plan and "StringStartsWith(token,bet)" in plan and "ArrowEvalPython" not in plan


def test_refreshed_index_equals_a_new_one(spark, tmp_path):
    rows = [(i, 1, f"{i}.png", "2026", f"alpha w{i} beta", "SUCCEEDED") for i in range(12)]
    changed = [(2, 1, "2.png", "2026", "gamma alpha alpha", "SUCCEEDED"), (3, 1, "3.png", "2026", "alpha", "FAILED"), (20, 1, "20.png", "2026", "alpha new", "SUCCEEDED")]
    old = inv.write_index(items(spark, rows), f"file://{tmp_path}/i")
    new = inv.refresh(old, items(spark, changed), spark.createDataFrame([(5,), (77,)], "id long"))
    want_rows = [r for r in rows if r[0] not in (2, 3, 5)] + changed
    want = inv.write_index(items(spark, want_rows), f"file://{tmp_path}/j")
    read = lambda index, q: {r["id"]: r["bm25"] for r in inv.keyword_matches(index, q).collect()}
    merged = inv.merge(new)
    for q in ("alpha", "gamma", "w5", "alp bet", "alpha-w1"):
        assert read(new, q) == pytest.approx(read(want, q)) and read(merged, q) == pytest.approx(read(want, q))
    assert new.stats() == want.stats() and len(read(old, "alpha")) == 12
    assert tuple(inv.index_health(items(spark, want_rows), new).first()) == (11, 11, True)
    assert inv.open_index(spark, f"file://{tmp_path}/i").parts[-1] > 1 and inv.segments(spark, f"file://{tmp_path}/none") == []


def test_many_vectors_at_once(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    v = [(i, rng.normal(size=4).tolist()) for i in range(60)] + [(60, [0.0] * 4), (61, [1.0]), (62, None), (63, [])]
    df = spark.createDataFrame(v, "id long, embedding array<float>")
    asked = df.filter("id % 20 = 0 or id > 59").withColumnRenamed("id", "query_id")
    got = {(r["query_id"], r["id"]): r["similarity"] for r in hybrid.vector_topk_many(df, asked, k=5, least=0.1, block=2).collect()}
    want = {(q, r["id"]): r["similarity"] for q in (0, 20, 40) for r in hybrid.vector_topk(df.filter("id < 60"), v[q][1], 5, 0.1).collect()}
    assert got == pytest.approx({**want, (61, 61): 1.0}, abs=1e-6)
    assert hybrid.vector_topk_many(df, asked.limit(0)).count() == 0


def page(spark, rows, query, **kw):
    it = items(spark, rows)
    p = fts.search_page(fts.build_index(it), it, query, **kw)
    return p, p.items.collect()


def test_highlight_and_punctuation(spark):
    body = "Transaction failed (P2028)\nERR_MODULE_NOT_FOUND localhost : 3000"
    rows = [(1, 1, "a.png", "2026", body, "SUCCEEDED"), (2, 1, "b.png", "2026", body, "FAILED")]
    p, got = page(spark, rows, "P2028")
    assert p.total == 1 and "[[match]]p2028[[/match]]" in got[0]["snippet"] and got[0]["match_type"] == "keyword"
    for q in ("ERR_MODULE", "ERR-MODULE", "localhost:3000"):
        assert page(spark, rows, q)[0].total == 1


def test_filename_only_and_empty_text(spark):
    rows = [(1, 1, "invoice-september-2026.png", "2026", "", "SUCCEEDED"), (2, 1, "x.png", "2026", None, "SUCCEEDED")]
    p, got = page(spark, rows, "invoice")
    assert p.total == 1 and got[0]["snippet"] == "[[match]]invoice[[/match]]-september-2026.png"


def test_recency_pages(spark):
    rows = [(i, 1, f"{i}.png", f"2026-01-{i // 2:02d}", "t", "SUCCEEDED") for i in range(10)]
    for offset, n, more in ((0, 3, True), (3, 3, True), (9, 1, False), (50, 0, False)):
        p, got = page(spark, rows, " ", limit=3, offset=offset)
        assert (p.total, len(got), p.has_more) == (10, n, more)
    assert [r["id"] for r in page(spark, rows, "", limit=3)[1]] == [9, 8, 7]
    assert fts.clamp_page(0, -4) == (1, 0) and fts.clamp_page(900, None) == (100, 0) and fts.clamp_page(None, 2) == (50, 2)


@pytest.mark.parametrize("q", ['"', '""', "*", "(", ")", "AND", "OR NOT NEAR", 'hello "world', "::*^%$#@!", "'; DROP TABLE t; --", "\\Q \\E ["])
def test_malformed_queries(spark, q):
    assert page(spark, [(1, 1, "a.png", "2026", "hello world", "SUCCEEDED")], q)[0].total >= 0


def test_hybrid_ranks_exact_first_and_recalls_by_meaning(spark):
    rows = [
        (1, 1, "a.png", "2026-01-01", "Prisma P2028 happened", "SUCCEEDED"),
        (2, 2, "b.png", "2026-01-02", "lỗi cơ sở dữ liệu", "SUCCEEDED"),
        (3, 1, "c.png", "2026-01-03", "holiday pictures", "SUCCEEDED"),
    ]
    it = items(spark, rows)
    index = fts.build_index(it)
    vectors = spark.createDataFrame([(r[0], mock_embedding_of(r[4])) for r in rows], "id long, embedding array<float>")
    top = hybrid.search(index, it, vectors, "P2028", mock_embedding_of).items.collect()
    assert top[0]["id"] == 1 and top[0]["match_type"] == "exact"
    found = hybrid.search(index, it, vectors, "database error failure", mock_embedding_of)
    assert {r["id"]: r["match_type"] for r in found.items.collect()}[2] == "semantic"
    assert [r["id"] for r in hybrid.search(index, it, vectors, "database error failure", mock_embedding_of, folder_id=2).items.collect()] == [2]

    def broken(text):
        raise RuntimeError("no model")

    assert [r["id"] for r in hybrid.search(index, it, vectors, "P2028", broken).items.collect()] == [1]
    assert hybrid.search(index, it, vectors, "  ", mock_embedding_of).total == 3


def test_empty_index(spark):
    it = items(spark, [])
    index = fts.build_index(it)
    assert fts.search_page(index, it, "x").total == 0
    assert tuple(fts.index_health(it, index).first()) == (0, 0, True)
