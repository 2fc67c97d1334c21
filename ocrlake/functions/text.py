"""Text functions: search normalisation, tokens, clean-up of extracted text, exact-token signals."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ALNUM = r"\p{IsAlphabetic}\p{N}"
_PY_ALNUM = r"\p{Alphabetic}\p{N}"  # the same for the regex module


def wstrim(c: Column) -> Column:
    """Without Unicode white space at both ends (the built-in trim knows the blank only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Canonical composition. There is no built-in; strings of ASCII are passed through."""
    return s.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


def normalize_search_text(c: Column) -> Column:
    """Composed, lower case; letters and digits stay, a dot stays between two of them, all else parts words."""
    s = F.lower(nfc(c))
    s = F.regexp_replace(s, rf"(?<![{_ALNUM}])\.|\.(?![{_ALNUM}])", " ")
    return F.trim(F.regexp_replace(s, rf"[^{_ALNUM}.]+", " "))


def normalize_search_query(raw: str) -> str:
    """``normalize_search_text`` for one string on the driver."""
    s = unicodedata.normalize("NFC", raw).lower()
    s = regex.sub(rf"(?<![{_PY_ALNUM}])\.|\.(?![{_PY_ALNUM}])", " ", s)
    return regex.sub(rf"[^{_PY_ALNUM}.]+", " ", s).strip(" ")


@lru_cache(maxsize=1)
def _fold_table() -> tuple[str, str]:
    """What one fold does on both sides, index and query: letters with marks over a letter of a to z become that letter,
    the two special forms of s and sigma their plain ones, and combining marks (which translate() drops) go. Marks over
    any other letter, as in й, ά or ガ, are part of it."""
    marked, base = ["ς", "ſ"], ["σ", "s"]
    for cp in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        ch = chr(cp)
        parts = unicodedata.normalize("NFD", ch)
        if len(parts) > 1 and ch.islower() and parts[0].isascii() and all(unicodedata.combining(x) for x in parts[1:]):
            marked.append(ch)
            base.append(parts[0])
    return "".join(marked) + "".join(map(chr, range(0x300, 0x370))), "".join(base)


def fold_marks(c: Column) -> Column:
    """Lower-case composed text without diacritics on Latin letters; letters with strokes (đ, ø, ł) stay."""
    return F.translate(c, *_fold_table())


@lru_cache(maxsize=1)
def _fold_map() -> dict[int, str | None]:
    marked, base = _fold_table()
    return {ord(ch): base[i] if i < len(base) else None for i, ch in enumerate(marked)}


def fold_marks_of(text: str) -> str:
    """``fold_marks`` for one string."""
    return text.translate(_fold_map())


def fts_tokens(c: Column) -> Column:
    """Index tokens: runs of letters, digits and private-use characters, lower case, without diacritics."""
    return F.regexp_extract_all(fold_marks(F.lower(c)), F.lit(r"([\p{L}\p{N}\p{Co}]+)"), F.lit(1))


_TOKEN = regex.compile(r"[\p{L}\p{N}\p{Co}]+")


def fts_tokens_of(text: str) -> list[str]:
    return _TOKEN.findall(fold_marks_of(unicodedata.normalize("NFC", text).lower()))


def query_phrases(raw: str) -> list[list[str]] | None:
    """Phrases of a query: one for each word, its tokens in order, the last one a prefix. None if there is no token."""
    phrases = []
    for word in normalize_search_query(raw).split():
        tokens = fts_tokens_of(word)
        if tokens:
            phrases.append(tokens)
    return phrases or None


def safe_fts_query(raw: str) -> str | None:
    """The query as a safe match expression: quoted prefix words joined by AND, or None."""
    words = normalize_search_query(raw).split()
    return " AND ".join(f'"{w}"*' for w in words) if words else None


def normalize_ocr_text(c: Column) -> Column:
    """Extracted text cleaned up: composed, LF line ends, no control characters but tabs, no blanks at line ends, at most
    one blank line in a row, nothing blank at both ends."""
    s = F.regexp_replace(nfc(c), r"\r\n?", "\n")
    s = F.regexp_replace(s, r"[\p{Cc}&&[^\t\n]]", "")
    s = F.regexp_replace(s, r"(?U)[^\S\n]+(?=\n|$)", "")
    return wstrim(F.regexp_replace(s, r"\n{3,}", "\n\n"))


def is_technical_token(tok: Column) -> Column:
    """Whether a token looks exact: two bytes or more, and capitals only, capitals with digits, an underscore beside
    ASCII letters or digits, one of ``. : / \\``, or three to four digits."""
    any_rule = (
        tok.rlike(r"^[A-Z]+$")
        | (tok.rlike(r"(?U)\p{Lu}") & tok.rlike(r"\p{N}"))
        | (tok.contains("_") & tok.rlike("[A-Za-z0-9]"))
        | tok.rlike(r"[.:/\\]")
        | tok.rlike(r"^[0-9]{3,4}$")
    )
    return (F.octet_length(tok) >= 2) & any_rule


def is_technical_word(tok: str) -> bool:
    if len(tok.encode()) < 2:
        return False
    upper, digit = any(ch.isupper() for ch in tok), any(ch.isnumeric() for ch in tok)
    return (
        bool(re.fullmatch("[A-Z]+", tok))
        or upper and digit
        or "_" in tok and bool(re.search("[A-Za-z0-9]", tok))
        or bool(re.search(r"[.:/\\]", tok))
        or bool(re.fullmatch("[0-9]{3,4}", tok))
    )


def exact_signal(query: str, filename: Column, text: Column) -> Column:
    """1.0 if the query, or any exact-looking token of it, stands in the file name or text in any case; else 0.0."""
    q = query.strip().lower()
    if not q:
        return F.lit(0.0)
    fn, body = F.lower(F.coalesce(filename, F.lit(""))), F.lower(F.coalesce(text, F.lit("")))
    hit = F.lit(False)
    for needle in dict.fromkeys([q, *(t.lower() for t in query.split() if is_technical_word(t))]):
        hit = hit | fn.contains(needle) | body.contains(needle)
    return F.when(hit, 1.0).otherwise(0.0)


def bm25_score_norm(bm25: Column) -> Column:
    p = F.greatest(-bm25, F.lit(0.0))
    return p / (1 + p)


def cosine_score_norm(c: Column) -> Column:
    return F.greatest(F.least(c, F.lit(1.0)), F.lit(0.0))


def match_type(exact: Column, fts: Column, sem: Column) -> Column:
    return F.when(exact > 0, "exact").when((fts > 0) & (sem > 0.65), "hybrid").when(fts > 0, "keyword").otherwise("semantic")


def semantic_snippet(query: str, text: Column) -> Column:
    """Text around the first query word of three bytes or more that occurs in it, else its beginning; by characters."""
    t = F.coalesce(text, F.lit(""))
    low = F.lower(t)
    out = F.when(F.length(t) > 120, F.concat(wstrim(F.substring(t, 1, 120)), F.lit("..."))).otherwise(wstrim(t))
    for w in reversed([w.lower() for w in query.split() if len(w.encode()) >= 3]):
        pos = F.instr(low, w)
        start = F.greatest(pos - 40, F.lit(1))
        around = F.substring(t, start, pos + len(w) + 60 - start)
        out = F.when(pos > 0, F.concat(F.lit("..."), wstrim(around), F.lit("..."))).otherwise(out)
    return F.when(t != "", out)


def semantic_document(filename: Column, text: Column, most: int = 2000) -> Column:
    """What is embedded for an item: the file name, and the first characters of its text if there is any."""
    body = F.substring(wstrim(F.coalesce(text, F.lit(""))), 1, most)
    head = F.concat(F.lit("Filename: "), wstrim(filename))
    return F.when(body == "", head).otherwise(F.concat(head, F.lit("\nContent:\n"), body))


def passage_input(c: Column) -> Column:
    return F.concat(F.lit("passage: "), wstrim(c))


def query_input(c: Column) -> Column:
    return F.concat(F.lit("query: "), wstrim(c))


def match_markers(c: Column) -> Column:
    """Highlighted parts of a snippet."""
    return F.regexp_extract_all(c, F.lit(r"(?s)\[\[match\]\](.*?)\[\[/match\]\]"), F.lit(1))


def strip_markers(c: Column) -> Column:
    return F.regexp_replace(c, r"\[\[/?match\]\]", "")


def progress_percent(done: Column, total: Column) -> Column:
    return F.when(total > 0, F.least(F.round(done / total * 100), F.lit(100.0))).otherwise(0.0).cast("long")


# ------------------------------------------------------------------------------------------------- job keys


def upsert_key(folder: Column, path: Column, content_hash: Column) -> Column:
    return F.concat_ws(":", F.lit("UPSERT"), folder.cast("string"), path, F.coalesce(content_hash, F.lit("")))


def delete_key(folder: Column, path: Column) -> Column:
    return F.concat_ws(":", F.lit("DELETE"), folder.cast("string"), path)


def embed_key(item: Column, content_hash: Column, model: str, missing: str = "unknown") -> Column:
    return F.concat_ws(":", F.lit("EMBED"), item.cast("string"), F.coalesce(content_hash, F.lit(missing)), F.lit(model))


def re_ocr_key(item: Column, content_hash: Column, pipeline: Column) -> Column:
    return F.concat_ws(":", F.lit("RE_OCR"), item.cast("string"), F.coalesce(content_hash, F.lit("")), pipeline)


def re_ocr_target_pipeline(key: Column) -> Column:
    """The pipeline a re-processing key asks for (it may hold colons); null for other keys."""
    found = F.regexp_extract(key, r"(?s)^RE_OCR:[^:]*:[^:]*:(.+)$", 1)
    return F.when(found != "", found)
