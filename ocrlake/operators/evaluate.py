"""Quality of recognised text: edit distances, error rates, hit rates, confusion and latency figures."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ocrlake.functions.ranks import ranked_values
from ocrlake.functions.text import normalize_search_text


def edit_distance(a: list, b: list) -> int:
    """Levenshtein distance of two sequences, by bit-parallel columns."""
    if not a:
        return len(b)
    at: dict = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    pv, mv, score = full, 0, len(a)
    for x in b:
        eq = at.get(x, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & full, pv & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = (ph << 1 | 1) & full, mh << 1 & full
        pv, mv = mh | ~(xv | ph) & full, ph & xv
    return score


def char_distance(ref: Column | str, hyp: Column | str) -> Column:
    """Edits between two texts, by code points; null if either is. Stays in the JVM."""
    return F.levenshtein(ref, hyp).cast("long")


@F.pandas_udf(T.LongType())
def word_distance(ref: pd.Series, hyp: pd.Series) -> pd.Series:
    """Edits between the words (parted by white space) of two texts; null if either is."""
    return pd.Series([None if r is None or h is None else edit_distance(r.split(), h.split()) for r, h in zip(ref, hyp)], dtype="Int64")


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"(?U)\s+"), lambda w: w != ""))


def error_rate(distance: Column, ref_size: Column, hyp_size: Column) -> Column:
    """Distance by reference size; an empty reference gives 0 for an empty reading, else 1."""
    return F.when(ref_size > 0, distance / ref_size).when(hyp_size > 0, 1.0).otherwise(0.0)


def readings_by_name(fixtures: DataFrame, readings: DataFrame) -> DataFrame:
    """(fixture_name, ref, hyp) of fixtures (fixture_name, text) and readings (fixture_name, text) of the same name.

    A fixture without a reading has the empty one; readings of unknown fixtures are left out. Of several readings of one
    name the greatest counts.
    """
    read = readings.groupBy("fixture_name").agg(F.max("text").alias("hyp"))
    return fixtures.select("fixture_name", F.col("text").alias("ref")).join(read, "fixture_name", "left").withColumn("hyp", F.coalesce("hyp", F.lit("")))


def error_rates(pairs: DataFrame) -> DataFrame:
    """``pairs`` (ref, hyp, any others) with char_dist, ref_chars, cer, word_dist, ref_words, wer."""
    out = pairs.withColumns({"char_dist": char_distance("ref", "hyp"), "word_dist": word_distance("ref", "hyp")})
    out = out.withColumns({"ref_chars": F.length("ref").cast("long"), "ref_words": word_count(F.col("ref")).cast("long")})
    return out.withColumns({"cer": error_rate(F.col("char_dist"), F.col("ref_chars"), F.length("hyp")), "wer": error_rate(F.col("word_dist"), F.col("ref_words"), word_count(F.col("hyp")))})


def _upper_middle(n: Column) -> Column:
    """Position of the median, of the upper one of two."""
    return F.floor(n / 2)


def overall_rates(rates: DataFrame) -> DataFrame:
    """One row: errors by all reference sizes together, and upper medians of the single rates."""
    ratio = lambda a, b: F.when(F.sum(b) > 0, F.sum(a) / F.sum(b)).otherwise(0.0)
    whole = rates.agg(F.count("*").alias("n"), ratio("char_dist", "ref_chars").alias("cer"), ratio("word_dist", "ref_words").alias("wer"))
    for c in ("cer", "wer"):
        median = ranked_values(rates, [], c, {f"median_{c}": _upper_middle}).drop("n")  # one row
        whole = whole.withColumn("_one", F.lit(1)).join(F.broadcast(median.withColumn("_one", F.lit(1))), "_one", "left").drop("_one")
    return whole


def latency_figures(times: DataFrame, col: str, by: list[str]) -> DataFrame:
    """Per group: n, mean, least and greatest time, and p50, p90, p95 as the element at round(n * p), n - 1 at most."""
    at = lambda q: lambda n: F.least(F.round(n * q), n - 1)
    known = times.filter(F.col(col).isNotNull())
    whole = known.groupBy(*by).agg(F.avg(col).alias("mean"), F.min(col).alias("least"), F.max(col).alias("greatest"))
    return ranked_values(known, by, col, {"p50": at(0.5), "p90": at(0.9), "p95": at(0.95)}).join(whole, by)


def confusion(labels: DataFrame, truth: str, guess: str, positive: str, negative: str) -> DataFrame:
    """One row: recall and precision of both classes (0 where nothing counts)."""
    t, g = F.col(truth), F.col(guess)
    share = lambda a, b: F.when(F.count_if(b) > 0, F.count_if(a & b) / F.count_if(b)).otherwise(0.0)
    return labels.agg(
        share(g == positive, t == positive).alias("positive_recall"),
        share(t == positive, g == positive).alias("positive_precision"),
        share(g == negative, t == negative).alias("negative_recall"),
        share(t == negative, g == negative).alias("negative_precision"),
    )


def token_hits(texts: DataFrame, tokens: list[str]) -> DataFrame:
    """(token, exact_hits, search_hits): in how many texts (text) a stated token stands, as it is and as searches see it.

    One pass over the texts with two counters per token; the token list is an evaluation set.
    """
    from ocrlake.functions.text import normalize_search_query

    rows = texts.select("text", normalize_search_text(F.col("text")).alias("norm"))
    aggs = []
    for k, t in enumerate(tokens):
        aggs += [F.count_if(F.col("text").contains(t)).alias(f"e{k}"), F.count_if(F.col("norm").contains(normalize_search_query(t))).alias(f"s{k}")]
    one = rows.agg(*aggs)
    stack = ", ".join(f"'{t.replace(chr(92), chr(92) * 2).replace(chr(39), chr(92) + chr(39))}', e{k}, s{k}" for k, t in enumerate(tokens))
    return one.select(F.expr(f"stack({len(tokens)}, {stack}) AS (token, exact_hits, search_hits)"))
