"""Registered queries of the text operators, with SQL where SQL can express them on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ocrlake.llm import langid, leaks, lookalike, mixing, neardup, reading, scannoise
from ocrlake.session import cut
from ocrlake.sources.tables import table


def p2_found(spark: SparkSession, base: str) -> DataFrame:
    return lookalike.same_reading(table(spark, base, "search_requests"), table(spark, base, "screenshots"))


def p3_found(spark: SparkSession, base: str) -> DataFrame:
    shots = table(spark, base, "screenshots")
    p = neardup.SCREENSHOT_PARAMS
    tags = shots.select("id", F.col("content_hash").alias("tag"))
    return neardup.expand_pairs(neardup.near_links(shots, "id", "ocr_text", p), p, tags).distinct()


def p3_groups(spark: SparkSession, base: str) -> DataFrame:
    """The group of every screenshot that has text or a hash: one row each, no pairs."""
    shots = table(spark, base, "screenshots")
    return neardup.near_groups(shots, "id", "ocr_text", neardup.SCREENSHOT_PARAMS, shots.select("id", F.col("content_hash").alias("tag")))


def _repaired(spark: SparkSession, base: str) -> DataFrame:
    return scannoise.repair_texts(scannoise.scanned_texts(table(spark, base, "screenshots"), table(spark, base, "benchmark_corpus")))


def p5_found(spark: SparkSession, base: str) -> DataFrame:
    return scannoise.noisy_lines(_repaired(spark, base))


def p5_texts(spark: SparkSession, base: str) -> DataFrame:
    """Every text in continuous paragraphs."""
    return _repaired(spark, base).select("origin", "record_key", "text")


def p6_segments(spark: SparkSession, base: str) -> DataFrame:
    """Language and confidence of every text (segment 0) and of each of its blocks."""
    found = langid.detect(table(spark, base, "screenshots"), "id", "ocr_text", "ocr_language")
    return found.select(F.col("id").alias("screenshot_id"), "segment_no", "lang", F.round("confidence", 4).alias("confidence"))


def p6_found(spark: SparkSession, base: str) -> DataFrame:
    return langid.wrong_segments(langid.detect(table(spark, base, "screenshots"), "id", "ocr_text", "ocr_language"))


def p7_near(spark: SparkSession, base: str) -> DataFrame:
    """Documents with a window of 13 words of an item that is at most one word away, and the least distance."""
    return leaks.find_leaks(table(spark, base, "documents"), "doc_id", "text", table(spark, base, "eval_items"), "item_id", "passage")


def p7_found(spark: SparkSession, base: str) -> DataFrame:
    return p7_near(spark, base).filter("distance = 0").select("doc_id", "item_id")


def p8_drawn(spark: SparkSession, base: str) -> DataFrame:
    return mixing.draw(table(spark, base, "documents"), table(spark, base, "mix_targets"))


def p8_shares(spark: SparkSession, base: str) -> DataFrame:
    return mixing.reached_shares(p8_drawn(spark, base), table(spark, base, "mix_targets"))


def p8_checks(spark: SparkSession, base: str) -> DataFrame:
    """Of every target source: whether its share of all tokens is what it should be (to half a per cent, or to one of its
    documents where that is more; a source of which nothing is drawn has none), and whether no document comes more often
    than it may."""
    targets = table(spark, base, "mix_targets")
    drawn = cut(p8_drawn(spark, base))
    shares = mixing.reached_shares(drawn, targets)
    longest = drawn.groupBy("source").agg(F.max("n_tokens").alias("longest"))
    cap = targets.select(mixing.source_name(F.col("source")).alias("source"), "max_repeats")
    one = Window.partitionBy(F.lit(0))  # one row per source
    live, total = F.sum(F.when(F.col("n_tokens") > 0, F.col("target_share"))).over(one), F.sum("n_tokens").over(one)
    off = F.abs(F.col("reached_share") - F.col("target_share") / live)
    near = (F.col("n_tokens") == 0) | (off <= F.greatest(F.lit(0.005), F.col("longest") / total))
    both = shares.join(longest, "source", "left").withColumn("near", near).join(cap, "source")
    return both.groupBy("source").agg(F.min("near").alias("near_target"), F.min(F.col("most_copies") <= F.col("max_repeats")).alias("within_cap"))


def p9_found(spark: SparkSession, base: str) -> DataFrame:
    return reading.reading_levels(table(spark, base, "documents"), table(spark, base, "reading_labels"))


QUERIES = {
    "p2_found": p2_found,
    "p3_found": p3_found,
    "p3_groups": p3_groups,
    "p5_found": p5_found,
    "p5_texts": p5_texts,
    "p6_found": p6_found,
    "p6_segments": p6_segments,
    "p7_found": p7_found,
    "p7_near": p7_near,
    "p8_drawn": p8_drawn,
    "p8_shares": p8_shares,
    "p8_checks": p8_checks,
    "p9_found": p9_found,
}

_WS = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _sql_chars(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _skeleton_sql(c: str) -> str:
    """A text as seen: composed, look-alikes and widths as one letter, invisible characters gone, blanks single.

    Other than the operator this asks no vocabulary: it compares what letters look like.
    """
    wide = "".join(chr(cp) for cp in range(0xFF01, 0xFF5F))
    plain = {ch: chr(ord(ch) - 0xFEE0) for ch in wide} | lookalike.TO_LATIN | dict.fromkeys(lookalike.HYPHENS, "-") | dict.fromkeys(lookalike.APOSTROPHES, "'") | dict.fromkeys("“”＂", '"') | {"Ð": "Đ", "Ɖ": "Đ"}
    s = f"regexp_replace(nfc_normalize({c}), '[\\p{{Cf}}\\x{{fe00}}-\\x{{fe0f}}\\x{{34f}}\\x{{115f}}\\x{{1160}}\\x{{17b4}}\\x{{17b5}}\\x{{3164}}\\x{{ffa0}}]', '', 'g')"
    s = f"regexp_replace({s}, '[\\x00-\\x08\\x0e-\\x1b\\x7f-\\x84\\x86-\\x9f]', '', 'g')"
    # accents are taken apart so that those on a look-alike of another script count too
    s = f"nfc_normalize(translate({s}, {_sql_chars(''.join(plain))}, {_sql_chars(''.join(plain.values()))}))"
    return f"trim(regexp_replace({s}, '(?:{_WS}|\\x{{2800}})+', ' ', 'g'))"


_SHINGLES = f"""w AS (SELECT id, list_filter(regexp_split_to_array(lower(ocr_text), '{_WS}+'), lambda x: x <> '') AS w FROM (SELECT DISTINCT id, ocr_text FROM screenshots WHERE ocr_text IS NOT NULL)),
s AS (SELECT DISTINCT id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM w WHERE len(w) >= 3),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
c AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.id < b.id GROUP BY 1, 2),
pairs AS (SELECT a AS id_a, b AS id_b FROM c JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE c >= 0.7 * (x.n + y.n - c) - 1e-9
  UNION SELECT DISTINCT x.id, y.id FROM screenshots x JOIN screenshots y ON x.content_hash = y.content_hash AND x.id < y.id)"""
_WINDOWS = "list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i + 12], ' '))"

SQL: dict[str, str] = {
    "p2_found": f"""WITH q AS (SELECT DISTINCT request_id, {_skeleton_sql("query_text")} AS s FROM search_requests WHERE query_text IS NOT NULL AND request_id IS NOT NULL),
t AS (SELECT DISTINCT id, {_skeleton_sql("split_part(ocr_text, chr(10), 1)")} AS s FROM screenshots WHERE ocr_text IS NOT NULL)
SELECT DISTINCT request_id, id AS screenshot_id FROM q JOIN t USING (s) WHERE s <> ''""",
    "p3_found": f"WITH {_SHINGLES} SELECT id_a, id_b FROM pairs",
    "p3_groups": f"""WITH RECURSIVE {_SHINGLES}, ids AS (SELECT DISTINCT id FROM (SELECT id FROM w WHERE len(w) > 0 UNION SELECT id FROM screenshots WHERE content_hash IS NOT NULL)),
short AS (SELECT list_sort(w) AS k, id, w FROM w WHERE len(w) IN (1, 2)),
edges AS (SELECT id_a AS a, id_b AS b FROM pairs UNION SELECT id_b, id_a FROM pairs UNION SELECT x.id, y.id FROM short x JOIN short y ON x.w = y.w AND x.id <> y.id),
reach AS (SELECT id, id AS r FROM ids UNION SELECT e.b, reach.r FROM reach JOIN edges e ON e.a = reach.id),
least AS (SELECT id, min(r) AS group_id FROM reach GROUP BY id)
SELECT id, group_id, count(*) OVER (PARTITION BY group_id) AS n_members FROM least""",
    "p7_found": f"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, regexp_extract_all(lower(passage), '[\\p{{L}}\\p{{N}}]+') AS w FROM eval_items WHERE passage IS NOT NULL),
dw AS (SELECT doc_id, unnest({_WINDOWS}) AS g FROM d WHERE len(w) >= 13), iw AS (SELECT DISTINCT item_id, unnest({_WINDOWS}) AS g FROM i WHERE len(w) >= 13)
SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (g)""",
    "p8_checks": """SELECT DISTINCT regexp_replace(trim(lower(source)), '[\\s_\\-]+', '-', 'g') AS source, true AS near_target, true AS within_cap FROM mix_targets WHERE source IS NOT NULL""",
}
