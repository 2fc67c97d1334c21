"""The full-text index as stored tables: written once, refreshed by segments, read by the tokens of a query.

A segment holds, for the items it was written from: ``docs`` (what pages show, and the number of tokens), ``postings``
(one row for each place of a token: token, field, id, pos, n_tokens), ``terms`` (its distinct tokens) and ``gone`` (items
whose rows in earlier segments no longer count). Postings are range-partitioned and sorted by token and id, so a query
reads the row groups of its tokens only (equality and prefix filters reach the scan), and a token of very many items is
spread over several files. ``stats`` is written last: a segment without it was never committed.

Everything stays in the JVM; a query shuffles only the places where its tokens stand.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ocrlake.functions.text import query_phrases
from ocrlake.operators.fts import B, BODY_WEIGHT, FILENAME_WEIGHT, IDF_FLOOR, K1, build_index
from ocrlake.session import cut, release

DOC_COLUMNS = ("id", "folder_id", "filename", "path", "modified_at_fs", "ocr_status", "body", "n_tokens")
PUSHED_TOKENS = 100  # up to so many distinct tokens of the requests are pushed to the scan as filters
MOST_REQUESTS = 100_000


def _hadoop(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def _numbers(spark: SparkSession, root: str) -> list[int]:
    fs, hadoop = _hadoop(spark, root)
    if not fs.exists(hadoop):
        return []
    names = (s.getPath().getName() for s in fs.listStatus(hadoop))
    return sorted(int(n.split("=")[1]) for n in names if n.startswith("segment="))


def _next(spark: SparkSession, root: str) -> int:
    return max(_numbers(spark, root), default=-1) + 1


def segments(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the committed segments that count: the last whole one and those after it."""
    fs, _ = _hadoop(spark, root)
    numbers = _numbers(spark, root)
    ended = [n for n in numbers if fs.exists(_hadoop(spark, f"{root}/segment={n}/stats/_SUCCESS")[1])]
    merged = [n for n in ended if fs.exists(_hadoop(spark, f"{root}/segment={n}/whole")[1])]
    return [n for n in ended if not merged or n >= merged[-1]]


@dataclass(frozen=True)
class StoredIndex:
    """A committed state of the index; later refreshes don't change what it reads."""

    spark: SparkSession
    root: str
    parts: tuple[int, ...]

    def _read(self, name: str) -> DataFrame:
        """Rows of all segments that no later one has taken back."""
        read = lambda k, n: self.spark.read.parquet(f"{self.root}/segment={k}/{n}").withColumn("_segment", F.lit(k))
        rows = reduce(DataFrame.unionByName, (read(k, name) for k in self.parts))
        if len(self.parts) == 1:
            return rows.drop("_segment")
        gone = reduce(DataFrame.unionByName, (read(k, "gone") for k in self.parts[1:])).groupBy("id").agg(F.max("_segment").alias("_gone"))
        return rows.join(gone, (rows["id"] == gone["id"]) & (F.col("_segment") < F.col("_gone")), "left_anti").drop("_segment")

    def docs(self) -> DataFrame:
        return self._read("docs")

    def postings(self) -> DataFrame:
        return self._read("postings")

    def terms(self) -> DataFrame:
        """Tokens of all segments; some may have no live place any more."""
        return reduce(DataFrame.union, (self.spark.read.parquet(f"{self.root}/segment={k}/terms") for k in self.parts)).distinct()

    def stats(self) -> tuple[int, int]:
        """Number of items and of tokens."""
        r = self.spark.read.parquet(f"{self.root}/segment={self.parts[-1]}/stats").first()
        return r["n_docs"], r["n_tokens"]


def open_index(spark: SparkSession, root: str) -> StoredIndex:
    found = segments(spark, root)
    if not found:
        raise FileNotFoundError(f"no index at {root}")
    return StoredIndex(spark, root, tuple(found))


def _write(tokens: DataFrame, gone: DataFrame | None, path: str, totals: tuple[int, int]) -> None:
    """One segment from rows of ``build_index``; ``totals`` are items and tokens of what stays of earlier segments."""
    spark = tokens.sparkSession
    tokens = cut(tokens)  # texts are tokenised once, though sorting by range reads the tokens twice
    tokens.select(*DOC_COLUMNS).write.mode("overwrite").parquet(f"{path}/docs")
    field = lambda k, c: tokens.select("id", "n_tokens", F.lit(k).alias("field"), F.posexplode(c).alias("pos", "token"))
    places = field(0, "fn_tokens").union(field(1, "body_tokens")).select("token", "id", "field", "pos", "n_tokens")
    places = places.repartitionByRange("token", "id").sortWithinPartitions("token", "id", "field", "pos")
    places.write.mode("overwrite").option("parquet.block.size", 8 << 20).parquet(f"{path}/postings")
    spark.read.parquet(f"{path}/postings").select("token").distinct().write.mode("overwrite").parquet(f"{path}/terms")
    if gone is not None:
        gone.select("id").distinct().write.mode("overwrite").parquet(f"{path}/gone")
    new = spark.read.parquet(f"{path}/docs").agg(F.count("*").alias("n"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("t")).first()
    total = [(totals[0] + new["n"], totals[1] + new["t"])]
    spark.createDataFrame(total, "n_docs long, n_tokens long").coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")
    release(tokens)


def write_index(items: DataFrame, root: str) -> StoredIndex:
    """A new index of all items (once per id) as one segment that replaces what was there."""
    spark = items.sparkSession
    path = f"{root}/segment={_next(spark, root)}"
    fs, mark = _hadoop(spark, f"{path}/whole")
    fs.mkdirs(mark)
    _write(build_index(items), None, path, (0, 0))
    return open_index(spark, root)


def refresh(index: StoredIndex, changed: DataFrame, removed: DataFrame | None = None) -> StoredIndex:
    """The index after items changed or came (full rows, once per id) and others went (id): one more segment.

    Items that no longer have text leave the index like removed ones.
    """
    spark = index.spark
    gone = changed.select("id") if removed is None else changed.select("id").union(removed.select("id"))
    left = index.docs().select("id", "n_tokens").join(gone.distinct(), "id", "left_anti")
    r = left.agg(F.count("*").alias("n"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("t")).first()
    _write(build_index(changed), gone, f"{index.root}/segment={_next(spark, index.root)}", (r["n"], r["t"]))
    return open_index(spark, index.root)


def merge(index: StoredIndex) -> StoredIndex:
    """All segments rewritten as one; the old ones stay until they are removed."""
    spark = index.spark
    path = f"{index.root}/segment={_next(spark, index.root)}"
    fs, mark = _hadoop(spark, f"{path}/whole")
    fs.mkdirs(mark)
    index.docs().select(*DOC_COLUMNS).write.mode("overwrite").parquet(f"{path}/docs")
    places = index.postings().repartitionByRange("token", "id").sortWithinPartitions("token", "id", "field", "pos")
    places.write.mode("overwrite").option("parquet.block.size", 8 << 20).parquet(f"{path}/postings")
    spark.read.parquet(f"{path}/postings").select("token").distinct().write.mode("overwrite").parquet(f"{path}/terms")
    spark.createDataFrame([index.stats()], "n_docs long, n_tokens long").coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")
    return open_index(spark, index.root)


# ------------------------------------------------------------------------------------------------- queries


def _pushed(exact: set[str], prefixes: set[str]) -> Column:
    """What a place's token must be for a request to want it, as filters that the scan understands."""
    parts = [F.col("token").isin(sorted(exact))] if exact else []
    return reduce(lambda a, b: a | b, parts + [F.col("token").startswith(p) for p in sorted(prefixes)])


def phrase_places(index: StoredIndex, phrases: list[tuple[str, ...]]) -> DataFrame:
    """(phrase, id, n_tokens, in_name, in_body): how often each phrase (by its number) stands in each item that has it.

    The last token of a phrase may be the beginning of one. Prefixes are looked up among the distinct tokens.
    """
    spark = index.spark
    wanted = [(k, i, t) for k, p in enumerate(phrases) for i, t in enumerate(p[:-1])]
    begins = [(k, len(p) - 1, p[-1], len(p[-1])) for k, p in enumerate(phrases)]
    exact, prefixes = {t for *_, t in wanted}, {b[2] for b in begins}
    terms, postings = index.terms(), index.postings()
    if len(exact) + len(prefixes) <= PUSHED_TOKENS:
        terms, postings = terms.filter(_pushed(exact, prefixes)), postings.filter(_pushed(exact, prefixes))
    lengths = F.array(*(F.lit(n) for n in sorted({b[3] for b in begins})))
    tried = terms.select("token", F.explode(lengths).alias("n")).filter(F.length("token") >= F.col("n"))
    # both tables of wanted tokens are bounded by the requests
    ends = tried.select("token", F.expr("substring(token, 1, n)").alias("prefix")).join(F.broadcast(spark.createDataFrame(begins, "phrase long, k int, prefix string, n int").drop("n")), "prefix")
    links = ends.select("token", "phrase", "k")
    if wanted:
        links = links.union(spark.createDataFrame(wanted, "phrase long, k int, token string").select("token", "phrase", "k"))
    places = postings.join(links, "token").select("phrase", "id", "field", (F.col("pos") - F.col("k")).alias("start"), "n_tokens")
    sizes = F.broadcast(spark.createDataFrame([(k, len(p)) for k, p in enumerate(phrases)], "phrase long, size long"))
    whole = places.groupBy("phrase", "id", "field", "start", "n_tokens").agg(F.count("*").alias("size")).join(sizes, ["phrase", "size"])
    count = lambda f: F.count_if(F.col("field") == f)
    return whole.groupBy("phrase", "id", "n_tokens").agg(count(0).alias("in_name"), count(1).alias("in_body"))


def _scored(index: StoredIndex, asked: list[tuple[int, str | None]]) -> DataFrame:
    """(request_id, id, bm25) of all matches of the requests; every phrase of a request must stand in the item."""
    phrase_of: dict[tuple[str, ...], int] = {}
    wanted: list[tuple[int, int]] = []
    sizes: list[tuple[int, int]] = []
    for number, query in dict.fromkeys(asked):
        own = dict.fromkeys(tuple(p) for p in query_phrases(query or "") or [])
        wanted += [(number, phrase_of.setdefault(p, len(phrase_of))) for p in own]
        if own:
            sizes.append((number, len(own)))
    spark = index.spark
    if not wanted:
        return spark.createDataFrame([], "request_id long, id long, bm25 double")
    n_docs, n_tokens = index.stats()
    hits = phrase_places(index, list(phrase_of))
    containing = hits.groupBy("phrase").agg(F.count("*").alias("n"))
    idf = F.log((F.lit(n_docs) - F.col("n") + 0.5) / (F.col("n") + 0.5))
    weight = FILENAME_WEIGHT * F.col("in_name") + BODY_WEIGHT * F.col("in_body")
    length = F.col("n_tokens") / F.lit(n_tokens / n_docs if n_tokens else 1.0)
    part = F.when(idf > 0, idf).otherwise(IDF_FLOOR) * weight * (K1 + 1) / (weight + K1 * (1 - B + B * length))
    # one row per phrase, one per request and phrase, one per request: bounded by the requests
    links, need = spark.createDataFrame(wanted, "request_id long, phrase long"), spark.createDataFrame(sizes, "request_id long, needed long")
    scored = hits.join(F.broadcast(containing), "phrase").join(F.broadcast(links), "phrase").select("request_id", "id", part.alias("part"))
    both = scored.groupBy("request_id", "id").agg(F.count("*").alias("got"), F.sum("part").alias("score"))
    return both.join(F.broadcast(need), "request_id").filter("got = needed").select("request_id", "id", (-F.col("score")).alias("bm25"))


def keyword_matches(index: StoredIndex, query: str, folder_id: int | None = None) -> DataFrame:
    """Docs in which every phrase of the query stands in either column, with ``bm25``.

    A query without tokens matches nothing here. The folder filter does not change the statistics.
    """
    docs = index.docs()
    docs = docs if folder_id is None else docs.filter(F.col("folder_id") == folder_id)
    return docs.join(_scored(index, [(0, query)]).select("id", "bm25"), "id")


def batch_matches(index: StoredIndex, requests: DataFrame, most_requests: int = MOST_REQUESTS) -> DataFrame:
    """(request_id, id, bm25) of all matches of many requests (request_id, query_text) at once.

    The stated requests (at most ``most_requests``) are planned on the driver; items are only looked up by token. Requests
    without tokens match nothing; null requests take no part.
    """
    rows = requests.select("request_id", "query_text").filter("request_id is not null and query_text is not null").distinct().limit(most_requests + 1).collect()
    if len(rows) > most_requests:
        raise ValueError(f"more than {most_requests} requests: run them in blocks")
    return _scored(index, [(r["request_id"], r["query_text"]) for r in rows])


def index_health(items: DataFrame, index: StoredIndex) -> DataFrame:
    """(expected, indexed, healthy): processed items with text, rows of the index, and whether they are as many."""
    expected = items.agg(F.count_if((F.col("ocr_status") == "SUCCEEDED") & F.col("ocr_text").isNotNull()).alias("expected"))
    out = expected.withColumn("indexed", F.lit(index.stats()[0]).cast("long"))
    return out.withColumn("healthy", F.col("expected") == F.col("indexed"))
