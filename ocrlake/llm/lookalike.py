"""One form for texts that look the same but differ in characters.

1. Signs with one meaning and several code points are folded: composed accents (NFC), full-width forms, kinds of
   hyphens and apostrophes, ligatures; invisible characters go; runs of blanks become one blank.
2. Script-aware repair: for each token the dominant script of its letters is found. A token of mixed scripts has its
   look-alike letters replaced by those of the dominant script when the result occurs in the corpus vocabulary.

The vocabulary is all tokens of all texts that are compared, whole texts and not only their titles. Two kinds of tokens
need more than this method, as they must meet what they look like too:

- A token made of look-alikes only is of one script, but the line around it is not: the line's script decides.
- A spelling that occurs nowhere untouched counts as vocabulary when two different raw spellings lead to it.

A token that nothing else in the corpus looks like stays as it is; it cannot meet anything either way.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ocrlake.llm.blocks import spread_join
from ocrlake.session import cut

# Letters of other scripts (left) that look like a Latin letter (right)
CYRILLIC_LATIN = dict(zip("АВЕЅІЈКМНОРСТУХаеѕіјорсухһԁԛԝ", "ABESIJKMHOPCTYXaesijopcyxhdqw"))
GREEK_LATIN = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοιν", "ABEZHIKMNOPTYXoiv"))
# Signs that look the same
HYPHENS = "‐‑﹣－⁃"
APOSTROPHES = "’‘ʼ＇′"
_SAME_SIGN = {**dict.fromkeys(HYPHENS, "-"), **dict.fromkeys(APOSTROPHES, "'"), **dict.fromkeys("“”＂", '"')}
_LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "Ð": "Đ", "Ɖ": "Đ"}

# Letters and marks without a shape of their own
_INVISIBLE = "\u034f\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u3164\uffa0"

TO_LATIN = {**CYRILLIC_LATIN, **GREEK_LATIN}
FROM_LATIN = {
    "CYRILLIC": {v: k for k, v in CYRILLIC_LATIN.items()},
    "GREEK": {v: k for k, v in GREEK_LATIN.items()},
}
_CROSS = {c: GREEK_LATIN.get(c) or CYRILLIC_LATIN.get(c) for c in TO_LATIN}
_BLANKS = re.compile("[\\s\u2800]+")


@lru_cache(maxsize=65536)
def _plain(ch: str) -> str:
    """One character without its kind of width; '' for invisible ones."""
    same = _SAME_SIGN.get(ch) or _LIGATURES.get(ch)
    if same:
        return same
    category = unicodedata.category(ch)
    if category == "Cf" or category == "Cc" and not ch.isspace() or 0xFE00 <= ord(ch) <= 0xFE0F or ch in _INVISIBLE:
        return ""
    if 0xFF01 <= ord(ch) <= 0xFF5E:
        ch = chr(ord(ch) - 0xFEE0)
        return _SAME_SIGN.get(ch, ch)
    if unicodedata.decomposition(ch).startswith(("<wide>", "<narrow>", "<font>")):
        return unicodedata.normalize("NFKC", ch)
    return ch


def fold(text: str) -> str:
    """Step 1 for one text. Idempotent; case, accents and digits stay."""
    if text.isascii():
        return " ".join(text.split())
    # composing after width folding and again at the end, as folded letters may take a following accent
    s = unicodedata.normalize("NFC", "".join(map(_plain, _BLANKS.sub(" ", text))))
    return _BLANKS.sub(" ", s).strip()


@lru_cache(maxsize=65536)
def script_of(ch: str) -> str | None:
    """LATIN, GREEK, CYRILLIC or another script's name for letters, None for other characters."""
    if ch.isascii():
        return "LATIN" if ch.isalpha() else None
    if not ch.isalpha():
        return None
    return unicodedata.name(ch, "OTHER").split(" ", 1)[0].split("-")[0]


def dominant_script(token: str, around: str | None = None) -> str | None:
    """The script most letters of ``token`` are sure to belong to; look-alikes of other scripts are not sure.

    Letters that no other script has count first. Without any, the script of the surrounding text, else the plain
    majority, decides; Latin wins ties.
    """
    sure: dict[str, int] = {}
    plain: dict[str, int] = {}
    for ch in token:
        base = unicodedata.normalize("NFD", ch)[0]
        s = script_of(base)
        if s is None:
            continue
        plain[s] = plain.get(s, 0) + 1
        if not (base in TO_LATIN or s == "LATIN" and (base in FROM_LATIN["CYRILLIC"] or base in FROM_LATIN["GREEK"])):
            sure[s] = sure.get(s, 0) + 1
    if sure:
        return max(sure, key=lambda s: (sure[s], s == "LATIN"))
    if around is not None and plain:
        return around
    return max(plain, key=lambda s: (plain[s], s == "LATIN")) if plain else None


def candidate(token: str, around: str | None) -> str:
    """The token with its look-alikes in the dominant script; the token itself if nothing changes."""
    if token.isascii():
        return token
    script = dominant_script(token, around)
    table = TO_LATIN if script == "LATIN" else FROM_LATIN.get(script or "")
    if not table:
        return token
    out = []
    for ch in unicodedata.normalize("NFD", token):
        other = table.get(ch)
        if other is None and script in FROM_LATIN and ch in _CROSS and script_of(ch) != script:
            other = FROM_LATIN[script].get(TO_LATIN[ch])
        out.append(other or ch)
    return unicodedata.normalize("NFC", "".join(out))


def around_script(folded: str, default: str = "LATIN") -> str:
    """The script of a whole text, by its sure letters."""
    return dominant_script(folded) or default


def folded_texts(rows: DataFrame) -> DataFrame:
    """(key, text) to (key, text, folded, repaired): ``repaired`` has every token's candidate, vocabulary not yet asked."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            folded = [fold(t) for t in pdf["text"]]
            repaired = [f if f.isascii() else _repair_all(f) for f in folded]
            yield pd.DataFrame({"key": pdf["key"], "kind": pdf["kind"], "folded": folded, "repaired": repaired})

    return rows.select("key", "kind", "text").mapInPandas(run, "key long, kind string, folded string, repaired string")


def _repair_all(folded: str) -> str:
    script = around_script(folded)
    return " ".join(candidate(t, script) for t in folded.split(" "))


def vocabulary_of(corpus: DataFrame, wanted: DataFrame) -> DataFrame:
    """The spellings of ``wanted`` (fixed) that are tokens of ``corpus`` (text): one pass, distinct in each task first."""
    tokens = corpus.filter("text is not null").select(F.explode(F.array_distinct(F.split("text", r"\s+"))).alias("fixed")).distinct()
    return tokens.join(wanted.select("fixed").distinct(), "fixed", "left_semi")


def canonical_texts(rows: DataFrame, corpus: DataFrame) -> DataFrame:
    """(key, kind, canonical) of texts (key, kind, text); null texts are left out, blank ones have canonical ''.

    ``corpus`` (text) gives the vocabulary. A key that comes with several texts of one form has that form once. Only
    tokens that the repair would change are looked up; texts without such tokens are not shuffled for it.
    """
    forms = cut(folded_texts(rows.filter("text is not null")).distinct())
    changed = forms.filter("folded <> repaired")
    # both lists keep their order, token by token
    pairs = changed.select("key", "kind", "folded", F.posexplode(F.arrays_zip(F.split("folded", " ").alias("raw"), F.split("repaired", " ").alias("fixed"))).alias("pos", "t")).select("key", "kind", "folded", "pos", "t.raw", "t.fixed")
    wanted = pairs.filter("raw <> fixed").select("fixed", "raw").distinct()
    titles = forms.select(F.col("folded").alias("text"))
    twice = wanted.groupBy("fixed").agg(F.count("*").alias("n")).filter("n >= 2").select("fixed")
    vocabulary = vocabulary_of(corpus.select("text").union(titles), wanted).union(twice).distinct().withColumn("known", F.lit(True))
    mended = pairs.join(vocabulary, "fixed", "left").withColumn("token", F.when((F.col("raw") != F.col("fixed")) & F.col("known").isNull(), F.col("raw")).otherwise(F.col("fixed")))
    texts = mended.groupBy("kind", "key", "folded").agg(F.sort_array(F.collect_list(F.struct("pos", "token"))).alias("ts"))
    texts = texts.select("key", "kind", F.array_join(F.transform("ts", lambda x: x["token"]), " ").alias("canonical"))
    return forms.filter("folded = repaired").select("key", "kind", F.col("folded").alias("canonical")).union(texts)


def first_line(c):
    return F.split(c, "\n", 2).getItem(0)


def same_reading(requests: DataFrame, screenshots: DataFrame) -> DataFrame:
    """(request_id, screenshot_id): the query reads the same as the whole first line of the screenshot's text.

    Blank queries and null ids take no part; a row that comes twice, or an id with several texts, counts once for each
    form. Forms that very many requests or screenshots share are joined in blocks.
    """
    q = requests.select(F.col("request_id").cast("long").alias("key"), F.lit("q").alias("kind"), F.col("query_text").alias("text"))
    s = screenshots.select(F.col("id").cast("long").alias("key"), F.lit("s").alias("kind"), first_line(F.col("ocr_text")).alias("text"))
    rows = q.union(s).filter("key is not null and text is not null").distinct()
    corpus = screenshots.select(F.col("ocr_text").alias("text")).union(q.select("text"))
    canonical = cut(canonical_texts(rows, corpus).filter("canonical <> ''").distinct())
    left = canonical.filter("kind = 'q'").select("canonical", F.col("key").alias("request_id"))
    right = canonical.filter("kind = 's'").select("canonical", F.col("key").alias("screenshot_id"))
    return spread_join(left, right, "canonical").select("request_id", "screenshot_id").distinct()
