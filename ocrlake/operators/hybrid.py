"""Vector search and hybrid search: keyword and vector candidates, united and ranked by four signals."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ocrlake.functions.text import bm25_score_norm, cosine_score_norm, exact_signal, match_type, semantic_snippet
from ocrlake.functions.vectors import cosine_to
from ocrlake.operators.fts import Page, clamp_page, matches_of, recent_items, search_page, snippets

# Candidates of each kind, least similarity, weights of exact, file name, keyword and vector signals
CANDIDATES, LEAST_SIMILARITY = 100, 0.50
W_EXACT, W_FILENAME, W_KEYWORD, W_VECTOR = 4.0, 2.0, 1.5, 1.2


def vector_topk(vectors: DataFrame, query: list[float], k: int = CANDIDATES, least: float = LEAST_SIMILARITY, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """(id, similarity) of the k vectors most similar to the query, at least ``least``; ties by id.

    An exact scan; vectors of another length have similarity 0. The top-k is taken in each task before the last merge.
    """
    scored = vectors.select(F.col(id_col).alias("id"), cosine_to(query)(F.col(vector_col)).alias("similarity"))
    return scored.filter(F.col("similarity") >= least).orderBy(F.desc("similarity"), "id").limit(k)


def vector_topk_many(vectors: DataFrame, queries: DataFrame, k: int = CANDIDATES, least: float = LEAST_SIMILARITY, id_col: str = "id", vector_col: str = "embedding", block: int = 4_096) -> DataFrame:
    """(query_id, id, similarity) of the k vectors most similar to each query (query_id, embedding), at least ``least``.

    Queries go to the tasks in blocks of ``block`` vectors; each block is one pass over the vectors, with one matrix
    product per batch of rows, and only the k best of a batch for each query leave it. Vectors whose length differs from
    the query's, and those of length zero, have similarity 0. Ties by id. Null ids and vectors take no part.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).filter("id is not null and v is not null")
    out, ids, asked = None, [], []

    def one_pass(ids: list[int], asked: list[list[float]]) -> DataFrame:
        groups: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in {len(q) for q in asked}:
            at = [i for i, q in enumerate(asked) if len(q) == n]
            m = np.array([asked[i] for i in at], np.float64).reshape(len(at), n)
            norm = np.linalg.norm(m, axis=1, keepdims=True)
            groups[n] = np.array([ids[i] for i in at], np.int64), np.divide(m, norm, out=np.zeros_like(m), where=norm >= 1e-12)
        shared = spark.sparkContext.broadcast(groups)  # at most ``block`` vectors

        def run(batches):
            for pdf in batches:
                size = pdf["v"].map(len).to_numpy()
                for n, (query_ids, q) in shared.value.items():
                    here = np.flatnonzero(size == n)
                    if not n or not len(here):
                        continue
                    m = np.array(pdf["v"].iloc[here].tolist(), np.float64)
                    norm = np.linalg.norm(m, axis=1, keepdims=True)
                    m = np.divide(m, norm, out=np.zeros_like(m), where=norm >= 1e-12)
                    own = pdf["id"].to_numpy(np.int64)[here]
                    s = np.clip(q @ m.T, -1, 1)
                    if s.shape[1] > k:
                        cut_at = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k][:, None]
                        a, b = np.nonzero((s >= least) & (s >= cut_at))  # ties at the k-th place stay
                    else:
                        a, b = np.nonzero(s >= least)
                    yield pd.DataFrame({"query_id": query_ids[a], "id": own[b], "similarity": s[a, b]})

        return rows.mapInPandas(run, "query_id long, id long, similarity double")

    for r in queries.select(F.col("query_id").cast("long"), "embedding").filter("query_id is not null and embedding is not null").toLocalIterator():
        ids.append(r["query_id"])
        asked.append(list(r["embedding"]))
        if len(ids) == block:
            part = one_pass(ids, asked)
            out, ids, asked = (part if out is None else out.union(part)), [], []
    if ids or out is None:
        part = one_pass(ids, asked)
        out = part if out is None else out.union(part)
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return out.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= k).drop("_n")


def hybrid_candidates(index: DataFrame, items: DataFrame, vectors: DataFrame, query: str, query_vector: list[float] | None, folder_id: int | None = None) -> DataFrame:
    """All candidates of a hybrid query with their signals and final score.

    Keyword candidates are filtered by folder before their cut, vector candidates after it (and by no status). Without a
    query vector only keyword candidates take part. ``index``, ``items`` and ``vectors`` have one row per id.
    """
    top = matches_of(index, query, folder_id).orderBy("bm25", F.desc("modified_at_fs"), F.desc("id")).limit(CANDIDATES)
    kw = snippets(top, query).select("id", bm25_score_norm(F.col("bm25")).alias("fts"), F.col("snippet").alias("kw_snippet"))
    if query_vector is None:
        both = kw.withColumn("sem", F.lit(0.0))
    else:
        sem = vector_topk(vectors, query_vector).select("id", cosine_score_norm(F.col("similarity")).alias("sem"))
        both = kw.join(sem, "id", "full_outer")
    both = both.select("id", F.coalesce("fts", F.lit(0.0)).alias("fts"), F.coalesce("sem", F.lit(0.0)).alias("sem"), "kw_snippet")
    # at most two times CANDIDATES rows
    rows = items.join(F.broadcast(both), "id")
    if folder_id is not None:
        rows = rows.filter(F.col("folder_id") == folder_id)
    exact = exact_signal(query, F.col("filename"), F.col("ocr_text"))
    in_name = F.when(F.lower("filename").contains(query.lower()), 1.0).otherwise(0.0)
    rows = rows.withColumn("exact", exact).withColumn("in_name", in_name)
    final = W_EXACT * F.col("exact") + W_FILENAME * F.col("in_name") + W_KEYWORD * F.col("fts") + W_VECTOR * F.col("sem")
    return rows.select(
        "id", "folder_id", "filename", "path", "modified_at_fs", "exact", "in_name", "fts", "sem", final.alias("score"),
        match_type(F.col("exact"), F.col("fts"), F.col("sem")).alias("match_type"),
        F.coalesce("kw_snippet", semantic_snippet(query, F.col("ocr_text"))).alias("snippet"),
    )


def hybrid_page(index: DataFrame, items: DataFrame, vectors: DataFrame, query: str, query_vector: list[float] | None, folder_id: int | None = None, limit: int | None = None, offset: int | None = None) -> Page:
    limit, offset = clamp_page(limit, offset)
    found = hybrid_candidates(index, items, vectors, query, query_vector, folder_id)
    total = found.count()
    page = found.orderBy(F.desc("score"), F.desc("modified_at_fs"), F.desc("id")).offset(offset).limit(limit)
    return Page(page, total, offset + min(limit, max(total - offset, 0)) < total)


def search(index: DataFrame, items: DataFrame, vectors: DataFrame | None, query: str, embed=None, folder_id: int | None = None, limit: int | None = None, offset: int | None = None) -> Page:
    """The entry of search: hybrid where the query is not blank and an embedding function is there, else keyword.

    A failing embedding leaves the keyword candidates.
    """
    if not query.strip() or embed is None or vectors is None:
        return search_page(index, items, query, folder_id, limit, offset)
    try:
        vector = embed(query)
    except Exception:  # any model failure means: keyword candidates only
        vector = None
    return hybrid_page(index, items, vectors, query, vector, folder_id, limit, offset)


__all__ = ["hybrid_candidates", "hybrid_page", "recent_items", "search", "vector_topk"]
