"""Registered queries of the event stream, the extraction pipeline and its evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ocrlake.operators import evaluate as ev
from ocrlake.operators import extract as ex
from ocrlake.plans.common import ITEMS_SQL, JOBS_SQL, WS, choose_sql, classify_sql, items, jobs, norm_sql, second_pass_sql, strong_sql, wstrim_sql
from ocrlake.sources.tables import table
from ocrlake.streaming import events as st

# --------------------------------------------------------------------------------------------------- events

_KINDS = "CASE event_type WHEN 'signup' THEN 'create' WHEN 'view' THEN 'modify' WHEN 'click' THEN 'modify' WHEN 'purchase' THEN 'rename_both' WHEN 'error' THEN 'remove' END"


def file_events(spark: SparkSession, base: str) -> DataFrame:
    """The events table as raw file events of six folders; some names are temporary or no images."""
    e = table(spark, base, "events")
    name = "CASE event_id % 11 WHEN 0 THEN '.tmp' WHEN 1 THEN '.txt' ELSE '.png' END"
    return e.select(
        "event_id",
        (F.col("user_id") % 6).alias("folder_id"),
        F.expr(_KINDS).alias("kind"),
        F.expr(f"concat('C:\\\\shots\\\\u', user_id % 40, {name})").alias("path"),
        F.expr("CASE WHEN event_type = 'purchase' THEN concat('C:\\\\shots\\\\u', user_id % 40, CASE WHEN event_id % 7 = 0 THEN '-r.part' ELSE '-r.jpg' END) END").alias("to_path"),
        F.col("ts").cast("timestamp").alias("ts"),
    )


def event_normalize(spark: SparkSession, base: str) -> DataFrame:
    return st.normalize_events(file_events(spark, base)).select("event_id", "kind", "path", "to_path")


def event_debounce(spark: SparkSession, base: str) -> DataFrame:
    """Bursts with an hour of quiet between them."""
    single = st.per_path_events(st.normalize_events(file_events(spark, base)))
    return st.debounce(single, "60 minutes").select("path", "kind", F.unix_micros("started_at").alias("started_us"), F.unix_micros("last_at").alias("last_us"), "n")


def event_jobs(spark: SparkSession, base: str) -> DataFrame:
    single = st.per_path_events(st.normalize_events(file_events(spark, base)))
    bursts = st.debounce(single, "60 minutes", keys=("folder_id", "path"))
    return st.event_jobs(bursts).groupBy("job_type", "dedupe_key").agg(F.count("*").alias("n"))


def stability_gate(spark: SparkSession, base: str) -> DataFrame:
    """Five looks at every item's file; the file grows until look id % 7."""
    return st.stable_observations(_looks(spark, base)).select("path", F.col("attempt").cast("long").alias("attempt"), "file_size")


def unstable_files(spark: SparkSession, base: str) -> DataFrame:
    """Files that never agreed in five looks, and when they are due again."""
    return st.unstable_paths(_looks(spark, base).withColumn("seen_ms", F.col("attempt").cast("long") * 150))


def event_renames(spark: SparkSession, base: str) -> DataFrame:
    """Renames of files on record (those of even users), and the number of other events by path and kind."""
    normal = st.normalize_events(file_events(spark, base))
    known = table(spark, base, "events").filter("user_id % 2 = 0").select((F.col("user_id") % 6).alias("folder_id"), F.expr("concat('C:\\\\shots\\\\u', user_id % 40, '.png')").alias("path"))
    renames, rest = st.split_renames(normal, known)
    counted = rest.groupBy("folder_id", "path", "kind").agg(F.count("*").alias("n"))
    return renames.select("folder_id", F.col("old_path").alias("path"), F.lit("rename").alias("kind"), F.col("new_path"), F.lit(1).cast("long").alias("n")).unionByName(counted.withColumn("new_path", F.lit(None).cast("string")))


def _looks(spark: SparkSession, base: str) -> DataFrame:
    rows = items(spark, base, "file_size", "modified_at_fs").select(F.col("id").cast("string").alias("path"), "id", "file_size", "modified_at_fs", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("attempt"))
    return rows.select("path", "attempt", (F.col("file_size") - F.greatest(F.col("id") % 7 - F.col("attempt"), F.lit(0))).alias("file_size"), "modified_at_fs", (F.col("id") % 23 != 0).alias("readable"))


# ------------------------------------------------------------------------------------------------- extraction


def _sizes(spark: SparkSession, base: str) -> DataFrame:
    """Image sizes of all shapes, from the items' ids and sizes (the tables hold none)."""
    return items(spark, base, "file_size").select("id", (F.col("id") * 37 % 6000 + 1).alias("w"), (F.col("file_size") * 53 % 9000 + 1).alias("h"))


def tile_plan(spark: SparkSession, base: str) -> DataFrame:
    w, h, most = F.col("w"), F.col("h"), F.lit(2600)
    plan = _sizes(spark, base).select("id", ex.processing_strategy(w, h, most).alias("strategy"), F.posexplode(ex.tiles(w, h, most)).alias("tile_no", "t"))
    return plan.select("id", "strategy", F.col("tile_no").cast("long").alias("tile_no"), "t.x", "t.y", "t.width", "t.height")


def _lines(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "documents").select(F.explode(F.split("text", "\r?\n")).alias("line")).filter(F.trim("line") != "").distinct()


def line_classify(spark: SparkSession, base: str) -> DataFrame:
    line = F.col("line")
    return _lines(spark, base).select("line", ex.classify_line(line).alias("label"), ex.strong_technical(line).alias("strong"))


def candidate_select(spark: SparkSession, base: str) -> DataFrame:
    """Every line against a changed reading of it."""
    second = F.when(F.length("line") % 3 == 0, F.concat("line", F.lit(" and more"))).when(F.length("line") % 3 == 1, F.regexp_replace("line", " ", "_")).otherwise(F.regexp_replace("line", "a", "="))
    return _lines(spark, base).select("line", ex.choose_candidate(F.col("line"), second).alias("chosen"), ex.needs_second_pass(F.col("line")).alias("second_pass"))


def tile_merge(spark: SparkSession, base: str) -> DataFrame:
    """Texts cut into two overlapping tiles of lines and put together again."""
    lines = F.split("ocr_text", "\n")
    n = F.size(lines)
    tiles = F.array(F.array_join(F.slice(lines, F.lit(1), F.ceil(n / 2) + 2), "\n"), F.array_join(F.slice(lines, F.greatest(F.ceil(n / 2) - 1, F.lit(1)), n), "\n"))
    return items(spark, base, "ocr_text").filter("ocr_text is not null").select("id", ex.merged_tiles(tiles).alias("merged"))


def box_merge(spark: SparkSession, base: str) -> DataFrame:
    """Line boxes of small maps drawn from the embeddings (8 x 8 values, each a block of 4 x 4 cells)."""
    cell = F.transform(F.sequence(F.lit(0), F.lit(1023)), lambda i: F.when(F.element_at("embedding", (F.floor(i / 128) * 8 + F.floor((i % 32) / 4) + 1).cast("int")) > 0.05, 1.0).otherwise(0.0).cast("float"))
    found = ex.detected_boxes(cell, F.lit(32), F.lit(32))
    return table(spark, base, "embeddings").select("vec_id", F.posexplode(found).alias("box_no", "b")).select("vec_id", F.col("box_no").cast("long").alias("box_no"), "b.x0", "b.y0", "b.x1", "b.y1")


def ctc_decode(spark: SparkSession, base: str) -> DataFrame:
    """The embeddings read as 16 steps of 4 classes."""
    return table(spark, base, "embeddings").select("vec_id", ex.ctc_decoded(["", "A", "B", "C"], 4)("embedding").alias("text"))


def mock_recognition(spark: SparkSession, base: str) -> DataFrame:
    """Pending items through a stand-in engine that fails on some paths and reads nothing on others, with a second engine
    for half of the failures."""

    def first(path: str) -> ex.Recognised:
        if len(path) % 10 == 3:
            raise ex.EngineError("OCR_FAILED", path)
        return ex.Recognised("" if len(path) % 10 == 4 else path.upper(), "mock", "1.0", "en", 1.0)

    def second(path: str) -> ex.Recognised:
        if path.endswith(".png"):
            raise ex.EngineError("OCR_EMPTY", path)
        return ex.Recognised("second", "mock2", "1.0")

    rows = items(spark, base, "ocr_status", "path").filter("ocr_status = 'PENDING'")
    done = ex.recognise(rows, {"mock": first, "other": second}, ["mock", "other"])
    return done.select("id", "ocr_text", "ocr_engine", "error_code")


def recognition_summary(spark: SparkSession, base: str) -> DataFrame:
    return ex.batch_summary(mock_recognition(spark, base))


# ------------------------------------------------------------------------------------------------- evaluation


def _pairs(spark: SparkSession, base: str) -> DataFrame:
    """Fixtures' texts joined by name with readings in which every 'a' is another letter and a word is added; every ninth
    fixture has no reading."""
    b = table(spark, base, "benchmark_corpus").select("fixture_name", "text")
    read = b.filter(F.length("fixture_name") % 9 != 0).select("fixture_name", F.concat(F.regexp_replace("text", "a", "Ω"), F.lit(" x")).alias("text"))
    return ev.readings_by_name(b, read)


def cer_wer(spark: SparkSession, base: str) -> DataFrame:
    return ev.error_rates(_pairs(spark, base)).select("fixture_name", "char_dist", "ref_chars", F.round("cer", 6).alias("cer"), "word_dist", "ref_words", F.round("wer", 6).alias("wer"))


def cer_wer_texts(spark: SparkSession, base: str) -> DataFrame:
    one = ev.overall_rates(ev.error_rates(_pairs(spark, base)))
    return one.select("n", *(F.round(c, 6).alias(c) for c in ("cer", "wer", "median_cer", "median_wer")))


def latency_percentiles(spark: SparkSession, base: str) -> DataFrame:
    took = jobs(spark, base, "completed_at", "created_at", "job_type").filter("completed_at is not null").select(F.upper(F.trim("job_type")).alias("job_type"), (F.unix_seconds("completed_at") - F.unix_seconds("created_at")).alias("s"))
    out = ev.latency_figures(took, "s", ["job_type"])
    return out.select("job_type", "n", F.round("mean", 4).alias("mean"), "least", "greatest", "p50", "p90", "p95")


def classifier_confusion(spark: SparkSession, base: str) -> DataFrame:
    """The line classes against a plain rule of thumb."""
    rows = _lines(spark, base).select(ex.classify_line(F.col("line")).alias("guess"), F.when(F.col("line").rlike(r"[0-9]\.[0-9]|\\|_"), "Technical").otherwise("Natural").alias("truth"))
    return ev.confusion(rows, "truth", "guess", "Technical", "Natural")


TOKENS = ["TK-12115", "ERR_", "P20", "v1.2", "0x1", "Storage report", "10.37"]


def token_hits(spark: SparkSession, base: str) -> DataFrame:
    texts = items(spark, base, "ocr_text").filter("ocr_text is not null").select(F.col("ocr_text").alias("text"))
    return ev.token_hits(texts, TOKENS)


QUERIES = {
    f.__name__: f
    for f in (
        event_normalize, event_debounce, event_jobs, event_renames, stability_gate, unstable_files, tile_plan, line_classify, candidate_select, tile_merge, box_merge, ctc_decode,
        mock_recognition, recognition_summary, cer_wer, cer_wer_texts, latency_percentiles, classifier_confusion, token_hits,
    )
}

_IMG = "regexp_matches(lower({p}), '\\.(png|jpg|jpeg|webp)$')"
_EVENTS = rf"""raw AS (SELECT event_id, user_id % 6 AS folder_id, {_KINDS} AS kind, ts,
  'C:\shots\u' || (user_id % 40) || CASE event_id % 11 WHEN 0 THEN '.tmp' WHEN 1 THEN '.txt' ELSE '.png' END AS path,
  CASE WHEN event_type = 'purchase' THEN 'C:\shots\u' || (user_id % 40) || CASE WHEN event_id % 7 = 0 THEN '-r.part' ELSE '-r.jpg' END END AS to_path FROM events),
ok AS (SELECT *, {_IMG.format(p='path')} AS v, coalesce({_IMG.format(p='to_path')}, false) AS tv FROM raw),
norm AS (SELECT * FROM (SELECT event_id, folder_id, ts, CASE WHEN kind IN ('create', 'modify', 'rename_to') AND v THEN 'upsert' WHEN kind IN ('remove', 'rename_from') AND v THEN 'remove'
   WHEN kind = 'rename_both' AND v AND tv THEN 'rename' WHEN kind = 'rename_both' AND v THEN 'remove' WHEN kind = 'rename_both' AND tv THEN 'upsert' END AS kind,
   CASE WHEN kind = 'rename_both' AND NOT v AND tv THEN to_path ELSE path END AS path, CASE WHEN kind = 'rename_both' AND v AND tv THEN to_path END AS to_path FROM ok) WHERE kind IS NOT NULL),
single AS (SELECT event_id, folder_id, ts, CASE WHEN kind = 'rename' THEN 'remove' ELSE kind END AS kind, path FROM norm
   UNION ALL SELECT event_id, folder_id, ts, 'upsert', to_path FROM norm WHERE kind = 'rename')"""


def _bursts(keys: str) -> str:
    return f"""gaps AS (SELECT *, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 60 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM single WINDOW w AS (PARTITION BY {keys} ORDER BY ts)),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY {keys} ORDER BY ts) AS burst FROM gaps),
bursts AS (SELECT {keys}, burst, arg_max(kind, (ts, event_id, kind)) AS kind, min(ts) AS started, max(ts) AS last, count(*) AS n FROM numbered GROUP BY {keys}, burst)"""


# a changed letter or word is like none of the text, so the distances are counts
_RATES = f"""t AS (SELECT fixture_name, text, length(fixture_name) % 9 = 0 AS unread, length(text) AS ref_chars, list_filter(regexp_split_to_array(text, '{WS}+'), lambda w: w <> '') AS words FROM benchmark_corpus),
dist AS (SELECT fixture_name, unread, ref_chars, len(words) AS ref_words, CASE WHEN unread THEN ref_chars ELSE ref_chars - length(replace(text, 'a', '')) + 2 END AS char_dist,
  CASE WHEN unread THEN len(words) ELSE len(list_filter(words, lambda w: contains(w, 'a'))) + 1 END AS word_dist FROM t),
rates AS (SELECT *, CASE WHEN ref_chars > 0 THEN char_dist / ref_chars WHEN NOT unread THEN 1.0 ELSE 0.0 END AS cer, CASE WHEN ref_words > 0 THEN word_dist / ref_words WHEN NOT unread THEN 1.0 ELSE 0.0 END AS wer FROM dist)"""
_RECOGNISED = f"""{ITEMS_SQL}, done AS (SELECT id, CASE WHEN length(path) % 10 = 3 THEN CASE WHEN NOT ends_with(path, '.png') THEN 'second' END WHEN length(path) % 10 = 4 THEN '' ELSE upper(path) END AS ocr_text,
  CASE WHEN length(path) % 10 <> 3 THEN 'mock' WHEN NOT ends_with(path, '.png') THEN 'mock2' END AS ocr_engine,
  CASE WHEN length(path) % 10 = 3 AND ends_with(path, '.png') THEN 'OCR_EMPTY' END AS error_code FROM items WHERE ocr_status = 'PENDING')"""
_LINES = "l AS (SELECT DISTINCT line FROM (SELECT unnest(string_split_regex(text, '\\r?\\n')) AS line FROM documents) WHERE trim(line) <> '')"
_ASCII = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_W = "w::DOUBLE * 2600 / greatest(w, h)"
_H = "h::DOUBLE * 2600 / greatest(w, h)"

SQL = {
    "event_normalize": f"WITH {_EVENTS} SELECT event_id, kind, path, to_path FROM norm",
    "event_debounce": f"WITH {_EVENTS}, {_bursts('path')} SELECT path, kind, epoch_us(started) AS started_us, epoch_us(last) AS last_us, n FROM bursts",
    "event_jobs": f"""WITH {_EVENTS}, {_bursts('folder_id, path')} SELECT CASE kind WHEN 'remove' THEN 'DELETE_SCREENSHOT' ELSE 'UPSERT_SCREENSHOT' END AS job_type,
  CASE kind WHEN 'remove' THEN 'DELETE:' || folder_id || ':' || path ELSE 'UPSERT:' || folder_id || ':' || path || ':' END AS dedupe_key, count(*) AS n FROM bursts GROUP BY 1, 2""",
    "stability_gate": f"""WITH {ITEMS_SQL}, looks AS (SELECT id, unnest(range(1, 6)) AS attempt FROM items),
sized AS (SELECT id, attempt, greatest(id % 7 - attempt, 0) AS short FROM looks)
SELECT a.id::VARCHAR AS path, min(b.attempt) AS attempt, (any_value(i.file_size) - min(b.short))::BIGINT AS file_size
FROM sized a JOIN sized b ON a.id = b.id AND b.attempt = a.attempt + 1 AND a.short = b.short JOIN items i ON i.id = a.id WHERE a.id % 23 <> 0 GROUP BY a.id""",
    "unstable_files": f"WITH {ITEMS_SQL} SELECT id::VARCHAR AS path, 1250::BIGINT AS due_ms FROM items WHERE id % 23 <> 0 AND id % 7 > 4",
    "event_renames": rf"""WITH {_EVENTS}, known AS (SELECT DISTINCT user_id % 6 AS folder_id, 'C:\shots\u' || (user_id % 40) || '.png' AS path FROM events WHERE user_id % 2 = 0),
moves AS (SELECT n.*, k.path IS NOT NULL AS own FROM norm n LEFT JOIN known k ON k.folder_id = n.folder_id AND k.path = n.path WHERE kind = 'rename'),
ren AS (SELECT folder_id, path, arg_max(to_path, (ts, to_path)) AS new_path, max(ts) AS at_ts FROM moves WHERE own GROUP BY 1, 2),
rest AS (SELECT folder_id, path, kind, ts FROM norm WHERE kind <> 'rename' UNION ALL SELECT folder_id, to_path, 'upsert', ts FROM moves WHERE NOT own)
SELECT folder_id, path, 'rename' AS kind, new_path, 1::BIGINT AS n FROM ren
UNION ALL SELECT r.folder_id, r.path, r.kind, NULL, count(*) FROM rest r LEFT JOIN ren n ON n.folder_id = r.folder_id AND n.path = r.path WHERE n.path IS NULL OR r.ts > n.at_ts GROUP BY 1, 2, 3""",
    "tile_plan": f"""WITH {ITEMS_SQL}, s AS (SELECT id, id * 37 % 6000 + 1 AS w, file_size * 53 % 9000 + 1 AS h FROM items),
k AS (SELECT *, CASE WHEN h > w * 2 AND h > 2000 THEN 'vertical_tiling' WHEN w > h * 2 AND w > 2000 THEN 'horizontal_tiling' WHEN w <= 2600 AND h <= 2600 THEN 'direct' ELSE 'downscale' END AS strategy FROM s),
n AS (SELECT *, CASE strategy WHEN 'vertical_tiling' THEN greatest(ceil((h - 2000) / 1850.0), 0) WHEN 'horizontal_tiling' THEN greatest(ceil((w - 2000) / 1850.0), 0) ELSE 0 END::BIGINT AS last FROM k),
t AS (SELECT *, unnest(range(0, last + 1)) AS tile_no FROM n)
SELECT id, strategy, tile_no, CASE strategy WHEN 'horizontal_tiling' THEN tile_no * 1850 ELSE 0 END AS x, CASE strategy WHEN 'vertical_tiling' THEN tile_no * 1850 ELSE 0 END AS y,
  CASE strategy WHEN 'horizontal_tiling' THEN least(w - tile_no * 1850, 2000) WHEN 'downscale' THEN greatest(round({_W}), 1)::BIGINT ELSE w END AS width,
  CASE strategy WHEN 'vertical_tiling' THEN least(h - tile_no * 1850, 2000) WHEN 'downscale' THEN greatest(round({_H}), 1)::BIGINT ELSE h END AS height FROM t""",
    "cer_wer": f"WITH {_RATES} SELECT fixture_name, char_dist, ref_chars, round(cer, 6) AS cer, word_dist, ref_words, round(wer, 6) AS wer FROM rates",
    "cer_wer_texts": f"""WITH {_RATES}, c AS (SELECT cer, row_number() OVER (ORDER BY cer) - 1 AS k, count(*) OVER () AS n FROM rates), w AS (SELECT wer, row_number() OVER (ORDER BY wer) - 1 AS k, count(*) OVER () AS n FROM rates)
SELECT count(*) AS n, round(sum(char_dist) / sum(ref_chars), 6) AS cer, round(sum(word_dist) / sum(ref_words), 6) AS wer,
  (SELECT round(max(cer), 6) FROM c WHERE k = n // 2) AS median_cer, (SELECT round(max(wer), 6) FROM w WHERE k = n // 2) AS median_wer FROM rates""",
    "latency_percentiles": f"""WITH {JOBS_SQL}, t AS (SELECT upper(trim(job_type)) AS job_type, floor(epoch(completed_at))::BIGINT - floor(epoch(created_at))::BIGINT AS s FROM jobs WHERE completed_at IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY job_type ORDER BY s) - 1 AS k, count(*) OVER (PARTITION BY job_type) AS n FROM t)
SELECT job_type, count(*) AS n, round(avg(s), 4) AS mean, min(s) AS least, max(s) AS greatest, max(s) FILTER (WHERE k = least(round(n * 0.5), n - 1)) AS p50,
  max(s) FILTER (WHERE k = least(round(n * 0.9), n - 1)) AS p90, max(s) FILTER (WHERE k = least(round(n * 0.95), n - 1)) AS p95 FROM r GROUP BY 1""",
    "token_hits": "WITH " + ITEMS_SQL + f", t AS (SELECT ocr_text, {norm_sql('ocr_text')} AS norm FROM items WHERE ocr_text IS NOT NULL), w(token, search) AS (VALUES ('TK-12115', 'tk 12115'), ('ERR_', 'err'), ('P20', 'p20'), ('v1.2', 'v1.2'), ('0x1', '0x1'), ('Storage report', 'storage report'), ('10.37', '10.37')) SELECT token, count(*) FILTER (WHERE contains(ocr_text, token)) AS exact_hits, count(*) FILTER (WHERE contains(norm, search)) AS search_hits FROM w, t GROUP BY token",
    "candidate_select": f"""WITH {_LINES},
r AS (SELECT line, {wstrim_sql("line")} AS b, {wstrim_sql("CASE length(line) % 3 WHEN 0 THEN line || ' and more' WHEN 1 THEN replace(line, ' ', '_') ELSE replace(line, 'a', '=') END")} AS u FROM l)
SELECT line, {choose_sql("b", "u")} AS chosen, {second_pass_sql("b")} AS second_pass FROM r""",
    "line_classify": f"WITH {_LINES}, t AS (SELECT line, {wstrim_sql('line')} AS s FROM l) SELECT line, {classify_sql('s')} AS label, {strong_sql('line')} AS strong FROM t",
    "classifier_confusion": f"""WITH {_LINES}, t AS (SELECT line, {wstrim_sql('line')} AS s FROM l),
c AS (SELECT {classify_sql('s')} AS guess, CASE WHEN regexp_matches(line, '[0-9]\\.[0-9]|\\\\|_') THEN 'Technical' ELSE 'Natural' END AS truth FROM t)
SELECT count(*) FILTER (WHERE truth = 'Technical' AND guess = 'Technical') / count(*) FILTER (WHERE truth = 'Technical') AS positive_recall,
  count(*) FILTER (WHERE truth = 'Technical' AND guess = 'Technical') / count(*) FILTER (WHERE guess = 'Technical') AS positive_precision,
  count(*) FILTER (WHERE truth = 'Natural' AND guess = 'Natural') / count(*) FILTER (WHERE truth = 'Natural') AS negative_recall,
  count(*) FILTER (WHERE truth = 'Natural' AND guess = 'Natural') / count(*) FILTER (WHERE guess = 'Natural') AS negative_precision FROM c""",
    # kept lines so far, and the next line as a list of one
    "tile_merge": f"""WITH {ITEMS_SQL}, a AS (SELECT id, string_split(ocr_text, chr(10)) AS ls FROM items WHERE ocr_text IS NOT NULL),
b AS (SELECT id, list_concat(ls[1:ceil(len(ls) / 2)::INT + 2], ls[greatest(ceil(len(ls) / 2)::INT - 1, 1):]) AS ls FROM a),
c AS (SELECT id, list_filter(list_transform(ls, lambda x: {wstrim_sql("x")}), lambda x: x <> '') AS ls FROM b),
d AS (SELECT id, list_reduce(list_prepend([]::VARCHAR[], list_transform(ls, lambda x: [x])), lambda k, x: CASE
    WHEN len(list_filter(k[-6:], lambda y: {_ASCII.format('y')} = {_ASCII.format('x[1]')} OR starts_with(x[1], y))) = 0 THEN list_concat(k, x)
    WHEN {_ASCII.format('list_filter(k[-6:], lambda y: ' + _ASCII.format('y') + ' = ' + _ASCII.format('x[1]') + ' OR starts_with(x[1], y))[1]')} = {_ASCII.format('x[1]')} THEN k
    ELSE list_concat(list_concat(k[1:greatest(len(k) - 6, 0) + list_position(list_transform(k[-6:], lambda y: {_ASCII.format('y')} = {_ASCII.format('x[1]')} OR starts_with(x[1], y)), true) - 1], x),
      k[greatest(len(k) - 6, 0) + list_position(list_transform(k[-6:], lambda y: {_ASCII.format('y')} = {_ASCII.format('x[1]')} OR starts_with(x[1], y)), true) + 1:]) END) AS kept FROM c)
SELECT id, array_to_string(kept, chr(10)) AS merged FROM d""",
    "ctc_decode": """WITH s AS (SELECT vec_id, list_transform(range(0, 16), lambda t: list_position(embedding[t * 4 + 1:t * 4 + 4], list_max(embedding[t * 4 + 1:t * 4 + 4])) - 1) AS c FROM embeddings)
SELECT vec_id, array_to_string(list_transform(list_filter(range(1, 17), lambda i: c[i] <> 0 AND (i = 1 OR c[i] <> c[i - 1])), lambda i: ['A', 'B', 'C'][c[i]]), '') AS text FROM s""",
    "mock_recognition": f"WITH {_RECOGNISED} SELECT * FROM done",
    "recognition_summary": f"""WITH {_RECOGNISED} SELECT count(*) AS processed, count(*) FILTER (WHERE error_code IS NULL) AS succeeded, count(*) FILTER (WHERE error_code IS NOT NULL) AS failed,
  count(*) FILTER (WHERE error_code IS NULL AND ocr_text = '') AS empty FROM done""",
}
