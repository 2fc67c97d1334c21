"""What the registered queries share: tables in the catalog's form, fixed arguments, SQL fragments."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ocrlake.operators import extract as ex
from ocrlake.operators.catalog import distinct_items
from ocrlake.operators.jobs import JOB_ORDER, current_jobs
from ocrlake.sources.tables import table

NOW = datetime(2026, 4, 15, 0, 0, 0)
NOW_SQL = "TIMESTAMPTZ '2026-04-15 00:00:00+00'"
TARGET = "hybrid_windows_vietocr:hybrid_v2"
MODEL, MODEL_VERSION = "multilingual-e5-small", "multi-small-v1"


def items(spark: SparkSession, base: str, *columns: str) -> DataFrame:
    """Items once per id, with ``id`` and the stated columns (all without any): no other column is read or shuffled.

    Deliveries of one id and update time are equal, so the columns of one item come from one delivery.
    """
    rows = table(spark, base, "screenshots")
    if not columns:
        return distinct_items(rows)
    named = list(dict.fromkeys(("id", *columns)))
    return distinct_items(rows.select(*dict.fromkeys((*named, "updated_at")))).select(named)


def jobs(spark: SparkSession, base: str, *columns: str) -> DataFrame:
    """Jobs once per id, as delivered last, with ``id`` and the stated columns (all without any)."""
    rows = table(spark, base, "index_jobs")
    if not columns:
        return current_jobs(rows)
    named = list(dict.fromkeys(("id", *columns)))
    return current_jobs(rows.select(*dict.fromkeys((*named, *JOB_ORDER)))).select(named)


def vectors(spark: SparkSession, base: str) -> DataFrame:
    """The embeddings table as vectors of items; every fifth is of an older model version."""
    version = F.when(F.col("vec_id") % 5 == 4, "old").otherwise(MODEL_VERSION)
    return table(spark, base, "embeddings").select(F.col("vec_id").alias("screenshot_id"), F.lit(MODEL).alias("model_id"), version.alias("model_version"), "embedding", F.lit(NOW).cast("timestamp").alias("created_at"))


ITEMS_SQL = "items AS (SELECT DISTINCT * FROM screenshots)"
# deliveries of one job, the last by update time; ties as in the operator are settled by attempts and status
JOBS_SQL = """jobs AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, attempts DESC NULLS LAST,
 status DESC NULLS LAST, completed_at DESC NULLS LAST, lease_until DESC NULLS LAST) AS rn FROM index_jobs) WHERE rn = 1)"""
VECTORS_SQL = f"vecs AS (SELECT vec_id AS screenshot_id, CASE WHEN vec_id % 5 = 4 THEN 'old' ELSE '{MODEL_VERSION}' END AS model_version, embedding FROM embeddings)"

WS = r"[\x09-\x0d\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def wstrim_sql(c: str) -> str:
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


def norm_sql(c: str) -> str:
    """Search normalisation; kept dots are held by a sign of their own while the rest is cut."""
    an = r"[\p{L}\p{N}]"
    s = f"lower(nfc_normalize({c}))"
    s = f"replace({s}, chr(1), ' ')"
    for _ in range(2):
        s = f"regexp_replace({s}, '({an})\\.({an})', '\\1' || chr(1) || '\\2', 'g')"
    return f"replace(trim(regexp_replace({s}, '[^\\p{{L}}\\p{{N}}\\x01]+', ' ', 'g')), chr(1), '.')"


def tokens_sql(c: str) -> str:
    return f"regexp_extract_all(strip_accents(lower({c})), '[\\p{{L}}\\p{{N}}]+')"


INDEX_SQL = f"""{ITEMS_SQL},
normed AS (SELECT *, {norm_sql("ocr_text")} AS body FROM items WHERE ocr_status = 'SUCCEEDED' AND ocr_text IS NOT NULL),
idx AS (SELECT *, {tokens_sql("filename")} AS fn, {tokens_sql("body")} AS bt, len({tokens_sql("filename")}) + len({tokens_sql("body")}) AS n_tokens FROM normed)"""


def hits_sql(tokens: str, phrase: list[str]) -> str:
    *head, last = phrase
    if not head:
        return f"len(list_filter({tokens}, lambda t: starts_with(t, '{last}')))"
    conditions = [f"{tokens}[i + {k}] = '{w}'" for k, w in enumerate(head)] + [f"starts_with({tokens}[i + {len(head)}], '{last}')"]
    return f"len(list_filter(range(1, len({tokens}) - {len(head)} + 1), lambda i: {' AND '.join(conditions)}))"


def bm25_sql(phrases: list[list[str]], where: str = "true") -> str:
    """CTEs up to ``ranked`` (idx columns and bm25) for stated phrases."""
    hits = ", ".join(f"{hits_sql('fn', p)} AS f{i}, {hits_sql('bt', p)} AS b{i}" for i, p in enumerate(phrases))
    counts = ", ".join(f"count(*) FILTER (WHERE f{i} + b{i} > 0) AS n{i}" for i in range(len(phrases)))
    parts = []
    for i in range(len(phrases)):
        raw = f"ln((n - n{i} + 0.5) / (n{i} + 0.5))"
        f = f"(5.0 * f{i} + b{i})"
        parts.append(f"(CASE WHEN {raw} > 0 THEN {raw} ELSE 1e-6 END) * {f} * 2.2 / ({f} + 1.2 * (0.25 + 0.75 * n_tokens / avgdl))")
    every = " AND ".join(f"f{i} + b{i} > 0" for i in range(len(phrases)))
    return f"""{INDEX_SQL},
hit AS (SELECT *, {hits} FROM idx),
stats AS (SELECT count(*) AS n, sum(n_tokens) / count(*)::DOUBLE AS avgdl, {counts} FROM hit),
ranked AS (SELECT hit.*, -({' + '.join(parts)}) AS bm25 FROM hit, stats WHERE {every} AND {where})"""


# ------------------------------------------------------------------------------------- line classes in SQL

_ANY = r"\p{L}\p{N}"


def _texts(parts) -> str:
    return "[" + ", ".join("'" + p.replace("'", "''") + "'" for p in parts) + "]"


def words_sql(c: str) -> str:
    return f"list_filter(regexp_split_to_array({c}, '{WS}+'), lambda w: w <> '')"


def _some_word(c: str, condition: str) -> str:
    return f"len(list_filter({words_sql(c)}, lambda w: {condition})) > 0"


def strong_sql(c: str) -> str:
    """Whether a line has a pattern that settles it as technical."""
    seps = f"(length({c}) - length(replace(replace({c}, '/', ''), '\\', '')))"
    rules = [
        f"len(list_filter({_texts(ex._LOWER_PARTS)}, lambda p: contains(lower({c}), p))) > 0",
        f"len(list_filter({_texts(ex._EXACT_PARTS)}, lambda p: contains({c}, p))) > 0",
        f"starts_with(lower({c}), 'at ')",
        f"(regexp_matches({c}, '^[A-Za-z]:') AND {seps} >= 1) OR {seps} >= 2",
        f"len(list_filter({_texts(ex._STARTS)}, lambda p: starts_with({c}, p))) > 0",
        _some_word(c, f"regexp_matches(w, '^[^{_ANY}]*[Pp][0-9]{{4}}[^{_ANY}]*$')"),
        _some_word(c, "starts_with(w, '@') AND contains(w, '/')"),
        _some_word(c, f"strlen(w) >= 5 AND regexp_matches(w, '^[^{_ANY}_\\-=]*[{_ANY}_\\-]+[^{_ANY}_\\-=]*=[^=]*[0-9A-Fa-f][^=]*$')"),
        _some_word(c, "starts_with(lower(w), '0x') AND strlen(w) >= 4"),
        _some_word(c, "(starts_with(w, 'ORA-') OR starts_with(w, 'SIG')) AND strlen(w) >= 5"),
        *(f"contains({c}, '{a}') AND contains({c}, '{b}')" for a, b in ex._PAIRS),
    ]
    return "(" + " OR ".join(f"({r})" for r in rules) + ")"


def classify_sql(c: str) -> str:
    """Technical, Natural or Uncertain, of a trimmed line."""
    count = lambda pattern: f"len(regexp_extract_all({c}, '{pattern}'))"
    ratio = lambda n: f"({n}::FLOAT / greatest(length({c}), 1)::FLOAT)::FLOAT"
    signs, digits, letters = ratio(count(f"[^\\p{{L}}0-9{WS[1:]}")), ratio(count("[0-9]")), ratio(count("\\p{L}"))
    clean = f"regexp_replace(w, '^[^{_ANY}_\\-]+|[^{_ANY}_\\-]+$', '', 'g')"
    turns = "len(regexp_extract_all(k, '\\p{Ll}\\p{Lu}'))"
    word = f"""(CASE WHEN contains(k, '_') AND strlen(k) > 3 THEN 25 ELSE 0 END + CASE WHEN strlen(k) >= 4 AND regexp_matches(k, '^[A-Z0-9_]*[A-Z][A-Z0-9_]*$') THEN 15 ELSE 0 END
      + CASE WHEN {turns} >= 2 THEN 30 WHEN {turns} = 1 AND strlen(k) >= 6 THEN 15 ELSE 0 END
      + CASE WHEN strlen(k) >= 7 AND regexp_matches(k, '^[0-9A-Fa-f]+$') AND regexp_matches(k, '[0-9]') AND regexp_matches(k, '[A-Fa-f]') THEN 25 ELSE 0 END
      + CASE WHEN strlen(k) >= 8 AND regexp_matches(k, '^[{_ANY}.]{{2,}}(?:-[{_ANY}.]{{2,}})+$') THEN 20 ELSE 0 END
      + CASE WHEN list_contains({_texts(ex._PORTS)}, k) THEN 15 ELSE 0 END + CASE WHEN regexp_matches(k, '[./\\\\]') THEN 10 ELSE 0 END)"""
    # the untrimmed word has an arrow or a double colon where the trimmed one has no such sign
    arrow = f"CASE WHEN (contains(w, '->') OR contains(w, '::')) AND NOT regexp_matches({clean}, '[./\\\\]') THEN 10 ELSE 0 END"
    tech = f"""(CASE WHEN {signs} > 0.15::FLOAT THEN 25 WHEN {signs} > 0.08::FLOAT THEN 10 ELSE 0 END + CASE WHEN {digits} > 0.30::FLOAT THEN 20 WHEN {digits} > 0.15::FLOAT THEN 10 ELSE 0 END
      + coalesce(list_sum(list_transform(list_transform({words_sql(c)}, lambda w: {clean}), lambda k: {word})), 0) + coalesce(list_sum(list_transform({words_sql(c)}, lambda w: {arrow})), 0))"""
    n = f"len({words_sql(c)})"
    natural = f"(CASE WHEN {letters} > 0.80::FLOAT THEN 15 ELSE 0 END + CASE WHEN {signs} > 0.08::FLOAT THEN 0 ELSE 10 END + CASE WHEN {n} >= 3 THEN 15 WHEN {n} = 2 THEN 5 ELSE 0 END)"
    marked = f"(regexp_matches({c}, '[{ex._foreign_letters()}]') AND regexp_matches({c}, '\\p{{Ll}}') AND {n} >= 2 AND {count(chr(92) + 'p{L}')} >= 6)"
    return f"""CASE WHEN {c} = '' THEN 'Uncertain' WHEN {strong_sql(c)} THEN 'Technical' WHEN {marked} THEN 'Natural' WHEN {tech} >= 30 THEN 'Technical' WHEN {tech} >= 15 THEN 'Uncertain'
      WHEN {natural} >= 20 AND {tech} < 10 THEN 'Natural' ELSE 'Uncertain' END"""


def choose_sql(b: str, u: str) -> str:
    """The better of two trimmed readings."""
    return f"""CASE WHEN {b} = '' THEN {u} WHEN {u} = '' OR {u} = {b} THEN {b}
    WHEN (strlen({u}) >= strlen({b}) + 8 AND starts_with({u}, {b})) OR (contains({u}, '=') AND NOT contains({b}, '=')) OR length({u}) - length(replace({u}, '_', '')) > length({b}) - length(replace({b}, '_', ''))
      OR (contains({b}, '=') AND contains({u}, '=') AND regexp_matches({b}, ' = |= | =') AND NOT regexp_matches({u}, ' = |= | =')) THEN {u} ELSE {b} END"""


def second_pass_sql(b: str) -> str:
    return f"""({b} = '' OR {b} = 'Migration' OR regexp_matches({b}, ' = |= | =|pid-|client new|OcrEngineMode "|node modules'))"""
