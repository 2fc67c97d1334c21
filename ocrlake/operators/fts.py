"""Full-text search over items: index, phrase match, BM25 rank, snippets, recency listing, pages.

``build_index`` makes one row per item that has text: tokens of the file name and of the normalised text, and the number
of tokens. ``invindex`` writes them as a stored index, which all searches read by token. Searching the rows themselves
(``keyword_matches``) is for small sets and one-off queries: it reads them once for statistics and once for matches.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import reduce

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ocrlake.functions.text import fold_marks_of, fts_tokens, normalize_search_text, query_phrases
from ocrlake.session import cut

SUCCEEDED = "SUCCEEDED"
# Fixed values of the ranking function: term saturation, length weight, column weights, floor of the idf
K1, B, FILENAME_WEIGHT, BODY_WEIGHT, IDF_FLOOR = 1.2, 0.75, 5.0, 1.0, 1e-6
DEFAULT_LIMIT, MOST_LIMIT = 50, 100


def build_index(items: DataFrame) -> DataFrame:
    """One row for each item with status SUCCEEDED and non-null text ('' counts): tokens and what pages show.

    Building again gives the same rows. Items are expected once per id.
    """
    rows = items.filter((F.col("ocr_status") == SUCCEEDED) & F.col("ocr_text").isNotNull())
    rows = rows.withColumn("body", normalize_search_text(F.col("ocr_text")))
    fn, body = fts_tokens(F.col("filename")), fts_tokens(F.col("body"))
    rows = rows.select("id", "folder_id", "filename", "path", "modified_at_fs", "ocr_status", "body", F.coalesce(fn, F.array()).alias("fn_tokens"), F.coalesce(body, F.array()).alias("body_tokens"))
    return rows.withColumn("n_tokens", (F.size("fn_tokens") + F.size("body_tokens")).cast("long"))


def phrase_hits(tokens: Column, phrase: list[str]) -> Column:
    """How often a phrase stands in a token array; its last token may be the beginning of one.

    One regular expression over the joined tokens counts the places where the phrase starts, overlapping ones too.
    """
    first, *rest = [re.escape(t) for t in phrase]
    ahead = "(?= " + " ".join(rest) + ")" if rest else ""
    return F.regexp_count(F.array_join(tokens, " "), F.lit(f"(?<![^ ]){first}{ahead}")).cast("long")


@dataclass(frozen=True)
class CorpusStats:
    """Statistics over the whole index, whatever filters a query has."""

    rows: int
    average: float
    containing: tuple[int, ...]


def corpus_stats(index: DataFrame, phrases: list[list[str]]) -> CorpusStats:
    aggs = [F.count("*").alias("n"), F.sum("n_tokens").alias("t")]
    for i, ph in enumerate(phrases):
        aggs.append(F.count_if((phrase_hits(F.col("fn_tokens"), ph) + phrase_hits(F.col("body_tokens"), ph)) > 0).alias(f"p{i}"))
    r = index.agg(*aggs).first()
    return CorpusStats(r["n"], (r["t"] or 0) / r["n"] if r["n"] else 0.0, tuple(r[f"p{i}"] for i in range(len(phrases))))


def bm25(stats: CorpusStats, hits: list[tuple[Column, Column]]) -> Column:
    """Rank (the lower, the better) of a row with (file name hits, body hits) of each phrase."""
    total = F.lit(0.0)
    for n, (in_name, in_body) in zip(stats.containing, hits):
        idf = math.log((stats.rows - n + 0.5) / (n + 0.5))
        idf = idf if idf > 0 else IDF_FLOOR
        f = FILENAME_WEIGHT * in_name + BODY_WEIGHT * in_body
        length = F.col("n_tokens") / F.lit(stats.average or 1.0)
        total = total + F.lit(idf) * f * (K1 + 1) / (f + K1 * (1 - B + B * length))
    return -total


def keyword_matches(index: DataFrame, query: str, folder_id: int | None = None) -> DataFrame:
    """Rows of the index in which every phrase of the query stands in either column, with ``bm25``.

    A query without tokens matches nothing here. The folder filter does not change the statistics.
    """
    phrases = query_phrases(query) or []
    if not phrases:
        return index.filter(F.lit(False)).withColumn("bm25", F.lit(0.0))
    stats = corpus_stats(index, phrases)
    rows = index if folder_id is None else index.filter(F.col("folder_id") == folder_id)
    for i, ph in enumerate(phrases):
        rows = rows.withColumn(f"_f{i}", phrase_hits(F.col("fn_tokens"), ph)).withColumn(f"_b{i}", phrase_hits(F.col("body_tokens"), ph))
    found = reduce(lambda a, b: a & b, [(F.col(f"_f{i}") + F.col(f"_b{i}")) > 0 for i in range(len(phrases))])
    hits = [(F.col(f"_f{i}"), F.col(f"_b{i}")) for i in range(len(phrases))]
    return rows.filter(found).withColumn("bm25", bm25(stats, hits)).drop(*(f"_{c}{i}" for i in range(len(phrases)) for c in "fb"))


# ------------------------------------------------------------------------------------------------ snippets


def _spans(text: str) -> list[tuple[int, int, str]]:
    out = []
    for m in regex.finditer(r"[\p{L}\p{N}\p{Co}\u0300-\u036f]+", text):
        out.append((m.start(), m.end(), fold_marks_of(m.group().lower())))
    return out


def snippet_of(text: str, phrases: list[list[str]], size: int) -> str:
    """The ``size`` tokens of ``text`` that show most different phrases, with hits between markers.

    Every hit opens a window; a window counts 1000 for each phrase seen first in it and 1 for each repeat. It is centred
    on its hits, and the nearest sentence start before the hit is tried too, with a bonus of 120 at the very beginning
    and 100 elsewhere. The first window with the greatest value is shown.
    """
    spans = _spans(text)
    n = len(spans)
    hits = []
    for i in range(n):
        for k, ph in enumerate(phrases):
            if i + len(ph) <= n and all(spans[i + j][2] == w for j, w in enumerate(ph[:-1])) and spans[i + len(ph) - 1][2].startswith(ph[-1]):
                hits.append((i, k, len(ph)))
    starts = [i for i in range(n) if i == 0 or _sentence_break(text[spans[i - 1][1] : spans[i][0]])]

    def value(at: int) -> tuple[int, int, int]:
        seen: set[int] = set()
        worth, first, last = 0, -1, at
        for i, k, length in hits:
            if at <= i < at + size:
                worth += 1 if k in seen else 1000
                seen.add(k)
                first, last = (i if first < 0 else first), i + length
        return worth, first, last

    best, begin = -1, 0
    for i, *_ in hits:
        worth, first, last = value(i)
        room = size - (last - first)
        at = max(0, min(first - int(room / 2), n - size))
        if worth > best:
            best, begin = worth, at
        if n > size:
            j = max(s for s in starts if s <= i)
            if j < i:
                worth = value(j)[0] + (120 if j == 0 else 100)
                if worth > best:
                    best, begin = worth, j
    return _marked(text, spans, hits, begin, size)


def _sentence_break(between: str) -> bool:
    mark = between.lstrip("\"'”’)]")
    return bool(mark) and mark[0] in ".:" and mark[1:2].isspace()


def _marked(text: str, spans: list, hits: list, begin: int, size: int) -> str:
    end = min(begin + size, len(spans))
    if not spans:
        return text
    lit = [False] * len(spans)
    joined = [False] * len(spans)  # token continues the highlight of the one before
    for i, _, length in hits:
        if i >= begin:
            for j in range(i, min(i + length, end)):
                joined[j] = joined[j] or j > i and True
                lit[j] = True
    out = ["..." if begin > 0 else text[: spans[0][0]]]
    for j in range(begin, end):
        opens = lit[j] and not (j > begin and lit[j - 1] and joined[j])
        closes = lit[j] and not (j + 1 < end and lit[j + 1] and joined[j + 1])
        out.append("[[match]]" * opens + text[spans[j][0] : spans[j][1]] + "[[/match]]" * closes)
        if j + 1 < end:
            out.append(text[spans[j][1] : spans[j + 1][0]])
    out.append("..." if end < len(spans) else text[spans[-1][1] :])
    return "".join(out)


def snippets(page: DataFrame, query: str) -> DataFrame:
    """``page`` (at most one page of rows) with ``snippet``: of the body, of the file name where the body is empty."""
    phrases = query_phrases(query) or []

    @F.pandas_udf(T.StringType())
    def run(body: pd.Series, filename: pd.Series) -> pd.Series:
        return pd.Series([snippet_of(b, phrases, 20) or snippet_of(f or "", phrases, 10) for b, f in zip(body.fillna(""), filename)])

    return page.withColumn("snippet", run("body", "filename"))


# --------------------------------------------------------------------------------------------------- pages


def clamp_page(limit: int | None, offset: int | None) -> tuple[int, int]:
    return min(max(DEFAULT_LIMIT if limit is None else limit, 1), MOST_LIMIT), max(offset or 0, 0)


def recent_items(items: DataFrame, folder_id: int | None = None) -> DataFrame:
    """What a query without tokens lists: processed items, newest first (by the text of the time, then the id)."""
    rows = items.filter(F.col("ocr_status") == SUCCEEDED)
    rows = rows if folder_id is None else rows.filter(F.col("folder_id") == folder_id)
    return rows.orderBy(F.desc("modified_at_fs"), F.desc("id"))


def matches_of(index, query: str, folder_id: int | None = None) -> DataFrame:
    """Keyword matches in a stored index or in rows of ``build_index``."""
    if isinstance(index, DataFrame):
        return keyword_matches(index, query, folder_id)
    from ocrlake.operators import invindex

    return invindex.keyword_matches(index, query, folder_id)


def preview_search(items: DataFrame, query: str) -> DataFrame:
    """Items whose file name or text holds the trimmed query in any case; all of them for a blank one. Needs no index."""
    q = query.strip().lower()
    if not q:
        return items
    return items.filter(F.lower("filename").contains(q) | F.coalesce(F.lower("ocr_text").contains(q), F.lit(False)))


@dataclass
class Page:
    items: DataFrame
    total: int
    has_more: bool


def search_page(index, items: DataFrame, query: str, folder_id: int | None = None, limit: int | None = None, offset: int | None = None) -> Page:
    """One page of keyword results (or of the recency listing where the query has no tokens), total and whether more follow.

    ``index`` is a stored index, or rows of ``build_index``. Matches are found once: total and page are both read from
    their written ids and ranks.
    """
    limit, offset = clamp_page(limit, offset)
    if query_phrases(query) is None:
        listed = recent_items(items, folder_id)
        total = listed.count()
        page = listed.offset(offset).limit(limit).select("id", "folder_id", "filename", "path", "modified_at_fs", F.lit(0.0).alias("score"), F.lit(None).cast("string").alias("snippet"), F.lit(None).cast("string").alias("match_type"))
    else:
        found = cut(matches_of(index, query, folder_id).select("id", "folder_id", "filename", "path", "modified_at_fs", "bm25", "body"))
        total = found.count()
        top = found.orderBy("bm25", F.desc("modified_at_fs"), F.desc("id")).offset(offset).limit(limit)
        page = snippets(top, query).select("id", "folder_id", "filename", "path", "modified_at_fs", (-F.col("bm25")).alias("score"), "snippet", F.lit("keyword").alias("match_type"))
    return Page(page, total, offset + min(limit, max(total - offset, 0)) < total)


def index_health(items: DataFrame, index: DataFrame) -> DataFrame:
    """(expected, indexed, healthy): processed items with text, rows of the index, and whether they are as many."""
    a = items.agg(F.count_if((F.col("ocr_status") == SUCCEEDED) & F.col("ocr_text").isNotNull()).alias("n"), F.lit(0).cast("long").alias("m"))
    b = index.agg(F.lit(0).cast("long").alias("n"), F.count("*").alias("m"))
    both = a.union(b).agg(F.sum("n").alias("expected"), F.sum("m").alias("indexed"))
    return both.withColumn("healthy", F.col("expected") == F.col("indexed"))
