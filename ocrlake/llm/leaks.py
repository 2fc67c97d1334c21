"""Evaluation passages in training text: pigeonhole edit matching.

Every run of ``least_words`` consecutive words of a test item is a window. A window with at most ``budget`` word edits,
cut into budget + 1 pieces, has a piece that stands unchanged in the text. So all pieces of all windows are looked up at
every position of every document (one sorted array of hashes, shared with the tasks), and where a piece hits, Myers'
bit-parallel distance between the window and the text around it decides. Many windows are computed at once, a column
of each per step; words are compared by their 64-bit hashes.

Test items go through in blocks of ``block_items`` items or ``block_words`` words, so that what the tasks share is
bounded whatever their number: 8 + 20 * (budget + 1) bytes for each word of a block.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ocrlake.llm.neardup import _mix, _WordHashes

_WORD = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class LeakParams:
    least_words: int = 13
    budget: int = 1
    block_items: int = 20_000
    block_words: int = 5_000_000


def words_of(text: str) -> list[str]:
    """Runs of letters and digits, in lower case."""
    return _WORD.findall(text.lower())


def piece_bounds(p: LeakParams) -> list[tuple[int, int]]:
    """Start and end of the budget + 1 pieces of a window, as even as can be."""
    cuts = [p.least_words * k // (p.budget + 1) for k in range(p.budget + 2)]
    return list(zip(cuts, cuts[1:]))


def run_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """One hash for each run of k words."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - k + 1, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - k + 1 + j]
        return _mix(out)


def myers_distances(patterns: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Least edit distance of each row of ``patterns`` (rows x words, 63 words at most) to any part of the same row of ``texts``.

    Words are compared by value; the columns of all rows are computed together.
    """
    n, m = patterns.shape
    bit = np.uint64(1) << np.arange(m, dtype=np.uint64)
    one, full, top = np.uint64(1), np.uint64((1 << m) - 1), np.uint64(m - 1)
    pv, mv = np.full(n, full), np.zeros(n, np.uint64)
    score = np.full(n, m, np.int64)
    best = score.copy()
    for k in range(texts.shape[1]):
        eq = (patterns == texts[:, k][:, None]) @ bit
        xv = eq | mv
        xh = ((((eq & pv) + pv) & full) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & full, pv & xh
        score += ((ph >> top) & one).astype(np.int64) - ((mh >> top) & one).astype(np.int64)
        ph, mh = (ph << one) & full, (mh << one) & full
        pv, mv = mh | ~(xv | ph) & full, ph & xv
        best = np.minimum(best, score)
    return best


@dataclass
class PieceIndex:
    """For each length of piece: sorted hashes, and for each the item and the window start that piece belongs to."""

    by_length: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    ids: np.ndarray
    flat: np.ndarray  # hashes of all items' words
    first: np.ndarray  # position of each item's first word in ``flat``


def build_index(ids: list[int], passages: list[str], p: LeakParams) -> PieceIndex:
    hashes = _WordHashes()
    items = [words_of(t) for t in passages]
    parts: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]] = {}
    flat = hashes.of([x for w in items for x in w])
    first = np.concatenate(([0], np.cumsum([len(w) for w in items]))).astype(np.int64)
    for i, w in enumerate(items):
        if len(w) < p.least_words:
            continue
        h = flat[first[i] : first[i + 1]]
        windows = len(w) - p.least_words + 1
        for a, b in piece_bounds(p):
            runs = run_hashes(h, b - a)[a : a + windows]
            start = np.arange(windows, dtype=np.int32)
            parts.setdefault(b - a, []).append((runs, np.full(windows, i, np.int32), start, np.full(windows, a, np.int32)))
    by_length = []
    for k, rows in sorted(parts.items()):
        cols = [np.concatenate(c) for c in zip(*rows)]
        order = np.argsort(cols[0], kind="stable")
        by_length.append((k, *(c[order] for c in cols)))
    return PieceIndex(by_length, np.array(ids, np.int64), flat, first)


_HITS = 300_000  # piece hits looked at together


def match_texts(texts: list[str], index: PieceIndex, p: LeakParams, hashes: _WordHashes) -> list[tuple[int, int, int]]:
    """(position of the text, position of the item, distance of its best window) of all texts with a leak.

    A window can only be within the budget if all but ``budget`` of its words stand in the text at most ``budget`` places
    from where the piece puts them; hits that fail this are dropped before the distance is computed.
    """
    words = [words_of(t) for t in texts]
    lengths = np.array([len(w) for w in words], np.int64)
    flat = hashes.of([w for ws in words for w in ws])
    owner = np.repeat(np.arange(len(texts)), lengths)
    first = np.concatenate(([0], np.cumsum(lengths))).astype(np.int64)
    found: dict[tuple[int, int], int] = {}
    span = np.arange(p.least_words)
    around = np.arange(-p.budget, p.least_words + p.budget)
    for k, keys, item, start, offset in index.by_length:
        runs = run_hashes(flat, k)
        if not len(runs):
            continue
        lo = np.searchsorted(keys, runs)
        many = np.where(owner[: len(runs)] == owner[k - 1 :], np.searchsorted(keys, runs, side="right") - lo, 0)
        where = np.flatnonzero(many)
        ends = np.cumsum(many[where])
        done = 0
        while done < len(where):
            upto = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + _HITS, side="right")))
            here = where[done:upto]
            done = upto
            n = many[here]
            pos = np.repeat(here, n)
            entry = np.repeat(lo[here], n) + np.arange(len(pos)) - np.repeat(np.cumsum(n) - n, n)
            doc, it = owner[pos], item[entry]
            at = pos - offset[entry]  # where the window would begin
            pattern = index.flat[(index.first[it] + start[entry])[:, None] + span]
            # the text around the window; places outside of the text hold what no word of the window is
            place = at[:, None] + around
            inside = (place >= first[doc][:, None]) & (place < first[doc + 1][:, None])
            near = np.zeros(pattern.shape, bool)
            text = flat[np.clip(place, 0, len(flat) - 1)]
            for shift in range(2 * p.budget + 1):
                part = slice(shift, shift + p.least_words)
                near |= inside[:, part] & (text[:, part] == pattern)
            likely = np.flatnonzero(near.sum(axis=1) >= p.least_words - p.budget)
            if not len(likely):
                continue
            pattern, text, inside = pattern[likely], text[likely], inside[likely]
            absent = pattern.max(axis=1) + np.uint64(1)
            taken = (pattern == absent[:, None]).any(axis=1)  # the greatest hash there is
            absent[taken] = pattern[taken].min(axis=1) - np.uint64(1)
            distance = myers_distances(pattern, np.where(inside, text, absent[:, None]))
            for d, i, dist in zip(doc[likely].tolist(), it[likely].tolist(), distance.tolist()):
                if dist <= p.budget and dist < found.get((d, i), p.budget + 1):
                    found[d, i] = dist
    return [(doc, i, d) for (doc, i), d in found.items()]


def item_blocks(items: DataFrame, id_col: str, text_col: str, p: LeakParams) -> Iterator[tuple[list[int], list[str]]]:
    """Test items in blocks of bounded size; rows without id or passage are left out, repeated rows merged."""
    rows = items.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).filter("i is not null and t is not null").distinct()
    ids: list[int] = []
    texts: list[str] = []
    size = 0
    for r in rows.toLocalIterator():
        ids.append(r["i"])
        texts.append(r["t"])
        size += len(r["t"]) // 5
        if len(ids) >= p.block_items or size >= p.block_words:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def find_leaks(docs: DataFrame, doc_id: str, doc_text: str, items: DataFrame, item_id: str, item_text: str, p: LeakParams = LeakParams()) -> DataFrame:
    """(doc_id, item_id, distance) of documents with a window of an item at most ``budget`` word edits away.

    ``distance`` is that of the item's best window: 0 means ``least_words`` consecutive words as they are. Null ids and
    texts take no part; items with fewer words than a window cannot leak. A document row that comes twice, or an item
    with two passages, counts with its best window. No shuffle but for the last merge of repeated rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(doc_text).alias("text")).filter("id is not null and text is not null")
    out = None
    for ids, passages in item_blocks(items, item_id, item_text, p):
        shared = spark.sparkContext.broadcast(build_index(ids, passages, p))  # bounded by block_items and block_words

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            index, hashes = shared.value, _WordHashes()
            for batch in batches:
                for at in range(0, len(batch), 1000):
                    pdf = batch.iloc[at : at + 1000]
                    got = match_texts(pdf["text"].tolist(), index, p, hashes)
                    if got:
                        doc, item, d = map(np.array, zip(*got))
                        yield pd.DataFrame({"doc_id": pdf["id"].to_numpy()[doc], "item_id": index.ids[item], "distance": d.astype(np.int64)})

        part = rows.mapInPandas(run, "doc_id long, item_id long, distance long")
        out = part if out is None else out.union(part)
    if out is None:
        return spark.createDataFrame([], "doc_id long, item_id long, distance long")
    return out.groupBy("doc_id", "item_id").agg(F.min("distance").alias("distance"))
