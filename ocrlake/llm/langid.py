"""Language of texts and of their blocks by cross-parsing entropy.

For each language a suffix automaton of labelled text is built. A text is parsed greedily into phrases, each the
longest piece that occurs in the labelled text. A phrase costs the logarithm of the labelled text's length, the bits it
takes to name its place there (Ziv and Merhav 1993), so that languages with less labelled text are not at a
disadvantage; the language in which a text costs least wins. The automata are dense tables, and many texts are parsed at
once, one character of each per step.

Labelled text is a bounded sample: whole texts of at most ``row_chars`` characters, ``sample_rows`` of each language
chosen by a hash over all labelled rows, of which whole blocks are used until ``sample_chars`` characters are full.
Labels may be wrong: automata of a first round, each blind to the text it judges, throw out blocks that another language
reads as well, and the automata are built again from the rest. What is judged afterwards is every text, as a whole.

A block of a few letters takes part of its evidence from the whole text: ``prior_letters`` letters at the whole text's
phrases per letter are added to its own counts.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Two-letter codes and their other ISO 639 spellings
LANGUAGE_CODES = {
    "vi": ("vi", "vie"),
    "en": ("en", "eng"),
    "fr": ("fr", "fra", "fre"),
    "de": ("de", "deu", "ger"),
    "es": ("es", "spa"),
}


@dataclass(frozen=True)
class LangParams:
    sample_rows: int = 200
    sample_chars: int = 24_000
    row_chars: int = 4_000
    rounds: int = 2
    least_letters: int = 30
    least_margin: float = 0.15
    prior_letters: float = 8.0
    unsure: float = 0.35
    seed: int = 11


def label_language(c: Column, codes: dict[str, tuple[str, ...]] = LANGUAGE_CODES) -> Column:
    """The language a label names: any case, region or script suffix, and any of the codes' spellings; null if none."""
    head = F.split(F.lower(F.trim(F.regexp_replace(c, r"(?U)\s+", " "))), "[-_ ]").getItem(0)
    out = F.lit(None).cast("string")
    for code, spelt in codes.items():
        out = F.when(head.isin(*spelt), F.lit(code)).otherwise(out)
    return out


# ----------------------------------------------------------------------------------------------- automata


class SuffixAutomaton:
    """Suffix automaton of one string over small integer symbols, as a dense transition table (-1: none).

    Building takes one pass; the table has at most two states for each symbol."""

    def __init__(self, symbols: np.ndarray, alphabet: int) -> None:
        table = np.full((2 * len(symbols) + 2, alphabet), -1, np.int32)
        link, length, last, size = [-1], [0], 0, 1
        for c in symbols.tolist():
            cur = size
            size += 1
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and table[p, c] < 0:
                table[p, c] = cur
                p = link[p]
            if p >= 0:
                q = int(table[p, c])
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = size
                    size += 1
                    length.append(length[p] + 1)
                    link.append(link[q])
                    table[clone] = table[q]
                    while p >= 0 and table[p, c] == q:
                        table[p, c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur
        self.table = np.ascontiguousarray(table[:size])


@dataclass
class LanguageModel:
    """Code points known to the labelled text (sorted), and for each language an automaton and the cost of a phrase."""

    languages: tuple[str, ...]
    points: np.ndarray
    tables: list[np.ndarray]
    cost: np.ndarray

    def __getstate__(self) -> tuple:
        """Only the transitions that exist are sent to tasks; there are at most three for each character."""
        sparse = []
        for t in self.tables:
            at = np.flatnonzero(t.ravel() >= 0).astype(np.int32)
            sparse.append((t.shape, at, t.ravel()[at]))
        return self.languages, self.points, sparse, self.cost

    def __setstate__(self, state: tuple) -> None:
        self.languages, self.points, sparse, self.cost = state
        self.tables = []
        for shape, at, to in sparse:
            table = np.full(shape, -1, np.int32)
            table.ravel()[at] = to
            self.tables.append(table)


_SPACE = re.compile(r"[\W\d_]+")
_DIGIT = re.compile(r"\d")
_MARKS = re.compile("[\u0300-\u036f]")


def letters_form(text: str) -> str:
    """What is compared: lower-case letters, everything between words one blank. Codes and numbers fall away."""
    words = [w for w in text.split() if not _DIGIT.search(w)]
    joined = " ".join(words).lower()
    if not joined.isascii():
        joined = unicodedata.normalize("NFC", joined)
    return _SPACE.sub(" ", joined).strip()


def without_marks(form: str) -> str:
    """Letters without accents, as texts typed or recognised without them have."""
    if form.isascii():
        return form
    return unicodedata.normalize("NFC", _MARKS.sub("", unicodedata.normalize("NFD", form))).replace("đ", "d")


def encode(text: str, points: np.ndarray) -> np.ndarray:
    """Symbols of ``text``: position in ``points`` plus 1; 0 for characters that no labelled text has."""
    cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    at = np.searchsorted(points, cp)
    at[at == len(points)] = 0
    return np.where(points[at] == cp, at + 1, 0).astype(np.uint8 if len(points) < 255 else np.int32)


def phrase_counts(texts: list[str], model: LanguageModel) -> np.ndarray:
    """Phrases that each text needs in each language (texts x languages)."""
    coded = [encode(t, model.points) for t in texts]
    order = np.argsort([-len(c) for c in coded], kind="stable")
    lengths = np.array([len(coded[i]) for i in order], np.int64)
    counts = np.zeros((len(texts), len(model.tables)), np.int64)
    if not len(order) or lengths[0] == 0:
        return counts
    # one row per position, the texts that reach it first: a step reads one contiguous row
    grid = np.zeros((int(lengths[0]), len(texts)), coded[order[0]].dtype)
    for col, i in enumerate(order):
        grid[: len(coded[i]), col] = coded[i]
    alive = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), side="right")
    for k, table in enumerate(model.tables):
        flat, width = table.ravel(), table.shape[1]
        state = np.zeros(len(texts), np.int32)
        n = np.zeros(len(texts), np.int64)
        for row in range(int(lengths[0])):
            m = alive[row]
            c = grid[row, :m]
            nxt = flat[state[:m] * width + c]
            ended = np.flatnonzero(nxt < 0)
            if len(ended):
                # a phrase ends here, the next one starts with this character; one that nothing holds is a phrase itself
                again = flat[c[ended]]
                n[ended] += (state[ended] != 0).astype(np.int64) + (again < 0)
                nxt[ended] = np.maximum(again, 0)
            state[:m] = nxt
        n += state != 0
        counts[order, k] = n
    return counts


def phrase_costs(texts: list[str], model: LanguageModel) -> np.ndarray:
    """What each text costs in each language: its phrases, by the cost of one."""
    return phrase_counts(texts, model) * model.cost


def whole_blocks(blocks: list[str], most: int) -> list[str]:
    """The blocks that fit, one after the other, into ``most`` characters; those that no longer fit are left out."""
    out, left = [], most
    for b in blocks:
        if len(b) < left:
            out.append(b)
            left -= len(b) + 1
    return out


def build_model(samples: dict[str, list[str]], most_chars: int) -> LanguageModel:
    """Automata of the samples' letters, each of at most ``most_chars`` characters."""
    joined = {x: " ".join(whole_blocks(rows, most_chars)) for x, rows in samples.items()}
    joined = {x: t for x, t in joined.items() if t}
    points = np.array(sorted({ord(ch) for t in joined.values() for ch in t}), np.uint32)
    tables = [SuffixAutomaton(encode(t, points).astype(np.int64), len(points) + 1).table for t in joined.values()]
    bits = np.array([np.log2(len(t) + 1) for t in joined.values()])
    return LanguageModel(tuple(joined), points, tables, bits / bits.max() if len(bits) else bits)


def _plain(samples: dict[str, list[str]]) -> dict[str, list[str]]:
    return {x: [without_marks(t) for t in rows] for x, rows in samples.items()}


@dataclass
class LanguageReader:
    """Automata of the labelled text without accents, and as it is.

    Every text is read without accents, so that texts that lost them are read like others. Where that leaves it open
    (confidence below ``unsure``) the reading as it is counts as well.
    """

    plain: LanguageModel
    marked: LanguageModel
    unsure: float

    @property
    def languages(self) -> tuple[str, ...]:
        return self.plain.languages

    def counts(self, forms: list[str]) -> np.ndarray:
        n = phrase_costs([without_marks(f) for f in forms], self.plain)
        open_ = np.flatnonzero(confidence(n) < self.unsure) if n.shape[1] > 1 else np.zeros(0, np.int64)
        if len(open_):
            n[open_] += phrase_costs([forms[i] for i in open_], self.marked)
        return n


def fit(samples: dict[str, list[str]], p: LangParams) -> LanguageReader:
    """Build, throw out blocks that another language reads as well or better, build again, ``rounds`` times.

    Labels name the language of a whole record, so its blocks are judged one by one; a block is judged by automata
    of the other half of the sample, never by its own text.
    """
    clean: dict[str, list[str]] = {}
    for x, rows in samples.items():
        forms = [letters_form(b) for text in rows for b in blocks(text)]
        clean[x] = list(dict.fromkeys(f for f in forms if len(f) >= p.least_letters))
    if sum(map(bool, clean.values())) < 2:
        return _reader(clean, p)
    kept = clean
    for _ in range(p.rounds):
        judged: dict[str, list[str]] = {x: [] for x in clean}
        for half in (0, 1):
            model = build_model(_plain({x: rows[1 - half :: 2] or rows for x, rows in kept.items()}), p.sample_chars // 2)
            for x, rows in kept.items():
                own = rows[half::2]
                if own:
                    counts = phrase_costs([without_marks(t) for t in own], model)
                    sure = (counts.argmin(axis=1) == model.languages.index(x)) & (confidence(counts) >= p.least_margin)
                    judged[x] += [t for t, ok in zip(own, sure) if ok]
        kept = {x: judged[x] or kept[x] for x in clean}
    return _reader(kept, p)


def _reader(samples: dict[str, list[str]], p: LangParams) -> LanguageReader:
    return LanguageReader(build_model(_plain(samples), p.sample_chars), build_model(samples, p.sample_chars), p.unsure)


def labelled_sample(rows: DataFrame, key: str, text: str, label: Column, p: LangParams) -> dict[str, list[str]]:
    """At most ``sample_rows`` texts of each language, chosen by a hash of the key over all labelled rows.

    Only texts of at most ``row_chars`` characters are sampled, and they are taken whole. The window keeps
    ``sample_rows`` rows of each language on every mapper before anything is shuffled.
    """
    w = Window.partitionBy("lang").orderBy("h", "key")
    named = rows.select(F.col(key).alias("key"), F.xxhash64(F.col(key), F.lit(p.seed)).alias("h"), F.col(text).alias("text"), label.alias("lang"))
    top = named.filter(F.col("lang").isNotNull() & (F.length("text") <= p.row_chars)).withColumn("n", F.row_number().over(w)).filter(F.col("n") <= p.sample_rows)
    out: dict[str, list[str]] = {}
    for r in sorted(top.select("lang", "n", "text").collect(), key=lambda r: (r["lang"], r["n"])):
        out.setdefault(r["lang"], []).append(r["text"])
    return out


# ----------------------------------------------------------------------------------------------- operator

_BLANK_LINES = re.compile(r"(?:\r\n?|\n)(?:[^\S\r\n]*(?:\r\n?|\n))+")


def blocks(text: str) -> list[str]:
    """Blocks of a text, parted by one or more lines without visible characters."""
    return [b for b in _BLANK_LINES.split(text.strip("\r\n")) if b.strip()]


def confidence(counts: np.ndarray) -> np.ndarray:
    """Between 0 and 1: how much further the second language is than the best, by phrases needed."""
    if counts.shape[1] < 2:
        return np.ones(len(counts))
    part = np.sort(counts, axis=1)
    return 1.0 - part[:, 0] / np.maximum(part[:, 1], 1e-9)


def detect(docs: DataFrame, id_col: str, text_col: str, label_col: str, p: LangParams = LangParams()) -> DataFrame:
    """Language and confidence of every text (segment_no 0) and of each of its blocks (from 1).

    Columns: id, label (language the label names or null), segment_no, n_letters, lang, confidence. Null ids and texts
    are left out; a text without letters has lang null and confidence 0. Blocks without letters take no language.
    Repeated rows give repeated results. Without labelled rows nothing can be learnt and every lang is null.
    """
    spark = docs.sparkSession
    label = label_language(F.col(label_col))
    rows = docs.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    model = fit(labelled_sample(rows, id_col, text_col, label, p), p)
    shared = spark.sparkContext.broadcast(model)  # bounded by sample_chars

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for batch in batches:
            for at in range(0, len(batch), 4000):
                pdf = batch.iloc[at : at + 4000]
                owner, number, forms = [], [], []
                for i, text in enumerate(pdf["text"]):
                    for k, b in enumerate(blocks(text), 1):
                        owner.append(i)
                        number.append(k)
                        forms.append(letters_form(b))
                owner_a = np.array(owner, np.int64)
                size = np.array([len(f) for f in forms], np.int64)
                uniq: dict[str, int] = {}
                where = np.array([uniq.setdefault(f, len(uniq)) for f in forms], np.int64)
                counts = m.counts(list(uniq))[where] if m.languages and forms else np.zeros((len(forms), 1))
                whole = np.zeros((len(pdf), counts.shape[1]))
                whole_size = np.zeros(len(pdf), np.int64)
                if len(forms):
                    np.add.at(whole, owner_a, counts)
                    np.add.at(whole_size, owner_a, size)
                # a few letters at the whole text's rate: they settle blocks that say nothing themselves
                prior = p.prior_letters * whole / np.maximum(whole_size, 1)[:, None]
                scored = counts + prior[owner_a] if len(forms) else counts
                allc, alls = np.vstack([whole, scored]), np.concatenate([whole_size, size])
                names = np.array([*m.languages, None], object)
                known = (alls > 0) & bool(m.languages)
                best = np.where(known, allc.argmin(axis=1), len(m.languages))
                of = np.concatenate([np.arange(len(pdf)), owner_a]).astype(np.int64)
                yield pd.DataFrame(
                    {
                        "id": pdf["id"].to_numpy()[of],
                        "label": pdf["label"].to_numpy()[of],
                        "segment_no": np.concatenate([np.zeros(len(pdf), np.int64), np.array(number, np.int64)]),
                        "n_letters": alls,
                        "lang": names[best],
                        "confidence": np.where(known, confidence(allc), 0.0),
                    }
                )

    src = rows.select(F.col(id_col).cast("long").alias("id"), label.alias("label"), F.col(text_col).alias("text"))
    return src.mapInPandas(run, "id long, label string, segment_no long, n_letters long, lang string, confidence double")


def wrong_segments(detected: DataFrame) -> DataFrame:
    """(screenshot_id, segment_no, lang) of blocks whose language the record's label does not name."""
    bad = detected.filter((F.col("segment_no") > 0) & F.col("lang").isNotNull() & ~F.col("lang").eqNullSafe(F.col("label")))
    return bad.select(F.col("id").alias("screenshot_id"), "segment_no", "lang").distinct()
