"""Reading level of documents by regularised ordinal regression.

Features of a text: lexical diversity, rarity of its words in the corpus, connectives (joining and subordinating ones
apart, by the lists of the text's own language), a clause-depth proxy (subordinators and commas in a sentence), and
lengths of words and sentences. They are taken of the whole text and, as means and quantiles, of its sentences, so that
one passage does not decide. The language is a feature too, as words of one are longer than those of another. The weights
and cuts are calibrated to graded texts.

Word counts are exact and cover all documents. A word that makes up less than ``least_share`` of all words counts as
that rare, so what tasks share is bounded by 1 / ``least_share`` words whatever the collection. The regression is fitted
on at most ``graded_rows`` graded documents, chosen by a hash. Texts are read as a whole; all features of many texts are
computed together.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ocrlake.session import cut, release


@dataclass(frozen=True)
class ReadingParams:
    least_share: float = 2e-6
    graded_rows: int = 20_000
    penalty: float = 0.0005
    rounds: int = 600
    seed: int = 5


# Fixed values, by language: words that join like parts, words that put one part under another, and other common words
# that tell the language
FUNCTION_WORDS = {
    "en": (
        "and or but so then",
        "because although though whereas while if unless since that which who whose despite notwithstanding insofar provided until whether",
        "the a of to in is an for on with",
    ),
    "vi": ("và hoặc nhưng nên rồi", "vì mặc dù khi nếu rằng mà bởi tuy trong chỉ bất", "của một các những này cho đã với"),
    "fr": (
        "et ou mais donc puis",
        "parce bien que tandis lorsque quand si dont qui malgré condition puisque quoique afin",
        "le la les des du une un est",
    ),
    "de": (
        "und oder aber also dann",
        "weil obwohl während wenn dass falls indem damit sofern ungeachtet vorausgesetzt deren dessen",
        "der die das den ein eine des dem",
    ),
    "es": (
        "y e o pero así luego entonces",
        "porque aunque que mientras cuando si cuyo cuya pese siempre salvo",
        "el la los las una un del de",
    ),
}

_TOKEN = re.compile(r"[^\W\d_]+|,|[.!?;:…]+(?=\s|$)|\n+")
_WORD = re.compile(r"[^\W\d_]+")
_HAS_WORD = re.compile(r"[^\W_]+")
_COMMA, _END = 0, 1  # numbers of signs; words are numbered from 2


@dataclass
class WordModel:
    """Rarity of the frequent words; all others have ``rarest``."""

    rarity: dict[str, float]
    rarest: float


class _Words(dict):
    """Numbers of words as they come, with what is known of each; forgotten when there are very many."""

    def __init__(self, model: WordModel) -> None:
        super().__init__()
        self.model = model
        self.lists = [[frozenset(x.split()) for x in kinds] for kinds in FUNCTION_WORDS.values()]
        self.reset()

    def reset(self) -> None:
        self.clear()
        # letters and rarity; bit k of the rest: the word is of that kind in language k
        self.size, self.rare = array("f", [0, 0]), array("f", [0, 0])
        self.joins, self.subs, self.common = array("B", [0, 0]), array("B", [0, 0]), array("B", [0, 0])
        self[","] = _COMMA

    def __missing__(self, token: str) -> int:
        if token[0] in ".!?;:…\n":
            self[token] = _END
            return _END
        n = self[token] = len(self.size)
        self.size.append(len(token))
        self.rare.append(self.model.rarity.get(token, self.model.rarest))
        for bits, kinds in ((self.joins, (0,)), (self.subs, (1,)), (self.common, (0, 1, 2))):
            bits.append(sum(1 << k for k, x in enumerate(self.lists) if any(token in x[i] for i in kinds)))
        return n


class Groups:
    """Runs of equal numbers in a sorted array, for figures of each run."""

    def __init__(self, of: np.ndarray) -> None:
        self.first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1]))) if len(of) else np.zeros(0, np.int64)
        self.label = of[self.first]
        self.size = np.diff(np.append(self.first, len(of)))
        self.index = np.repeat(np.arange(len(self.first)), self.size)

    def sum(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values.astype(np.float64), self.first)

    def mean(self, values: np.ndarray) -> np.ndarray:
        return self.sum(values) / self.size

    def quantiles(self, values: np.ndarray, at: tuple[float, ...]) -> np.ndarray:
        """Linear quantiles (runs x at). Run and value are sorted as one number, the value as 32 bits of its range."""
        low, high = float(values.min()), float(values.max())
        scale = (2**32 - 1) / (high - low) if high > low else 0.0
        key = np.sort((self.index.astype(np.int64) << 32) | ((values.astype(np.float64) - low) * scale).astype(np.int64))
        ordered = (key & 0xFFFFFFFF) / scale + low if scale else np.full(len(values), low)
        out = []
        for q in at:
            k = q * (self.size - 1)
            i = k.astype(np.int64)
            a, b = ordered[self.first + i], ordered[self.first + np.minimum(i + 1, self.size - 1)]
            out.append(a + (b - a) * (k - i))
        return np.column_stack(out)


@dataclass
class Parsed:
    """Words of the texts that have any: number, and text and sentence that each is in; commas of each sentence."""

    words: np.ndarray
    texts: Groups
    sentences: Groups
    of_sentences: Groups  # texts of the sentences
    commas: np.ndarray


def parse(texts: list[str], words: _Words) -> Parsed:
    """``texts.label`` says which of the texts have words. A sentence ends with a sign before a blank, or with the line."""
    numbers: list[int] = []
    counts = []
    for t in texts:
        found = _TOKEN.findall(t.lower())
        numbers += map(words.__getitem__, found)
        counts.append(len(found))
    ids = np.array(numbers, np.int64)
    text = np.repeat(np.arange(len(texts)), counts)
    sentence = np.cumsum(ids == _END) + text
    word = ids > _END
    sentences = Groups(sentence[word])
    of_text = text[word]
    comma = sentence[ids == _COMMA]
    at = np.searchsorted(sentences.label, comma)
    ok = at < len(sentences.label)
    ok[ok] = sentences.label[at[ok]] == comma[ok]
    commas = np.bincount(at[ok], minlength=len(sentences.label)).astype(np.float64)
    return Parsed(ids[word], Groups(of_text), sentences, Groups(of_text[sentences.first]), commas)


def features(t: Parsed, words: _Words) -> np.ndarray:
    """One row for each text with words."""
    size, rare = np.frombuffer(words.size, np.float32)[t.words], np.frombuffer(words.rare, np.float32)[t.words]
    common = np.frombuffer(words.common, np.uint8)[t.words]
    # the language whose function words are most frequent
    speech = np.argmax([t.texts.sum((common >> k) & 1) for k in range(len(FUNCTION_WORDS))], axis=0).astype(np.uint8)
    of_word = speech[t.texts.index]
    joins = (np.frombuffer(words.joins, np.uint8)[t.words] >> of_word) & 1
    subs = (np.frombuffer(words.subs, np.uint8)[t.words] >> of_word) & 1
    text, part, sentence = t.texts, t.of_sentences, t.sentences
    n = text.size.astype(np.float64)
    distinct = np.bincount(np.unique((text.index.astype(np.int64) << 32) | t.words) >> 32, minlength=len(n)).astype(np.float64)
    # of each sentence: words, subordinators, joining words, mean length and rarity of words, share of long ones, extremes
    sizes, deep, joined = sentence.size.astype(np.float64), sentence.sum(subs), sentence.sum(joins)
    length, rarity, long = sentence.mean(size), sentence.mean(rare), sentence.mean(size >= 8)
    longest, rarest = np.maximum.reduceat(size, sentence.first), np.maximum.reduceat(rare, sentence.first)
    low, five = (0.1, 0.25, 0.5, 0.75, 0.9), (0.25, 0.5, 0.75, 0.9)
    columns = [
        # diversity
        np.log(n), distinct / np.sqrt(2 * n), np.log(distinct) / np.log(n + 1),
        # lengths
        text.mean(size), text.quantiles(size, (0.9,)), text.mean(size >= 8), text.mean(size >= 12),
        np.log(part.mean(sizes)), np.log(np.maximum.reduceat(sizes, part.first)), np.log(part.quantiles(sizes, low)),
        part.quantiles(length, low), part.mean(long), part.quantiles(long, (0.25, 0.5, 0.75)), part.mean(longest),
        # connectives
        part.mean(joined), part.mean(joined > 0), part.mean(deep), text.mean(subs),
        # clause depth
        part.mean(deep > 0), part.mean(deep > 1), part.quantiles(deep, five), part.mean(t.commas), part.mean(t.commas > 0),
        part.quantiles(t.commas, five), part.quantiles(deep + t.commas, five), part.mean((deep == 0) & (sizes < 10)),
        # rarity
        text.mean(rare), text.quantiles(rare, low), part.quantiles(rarity, low), part.mean(rarest),
        np.eye(len(FUNCTION_WORDS))[speech],
    ]
    return np.column_stack(columns)


@dataclass
class OrdinalModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cuts: np.ndarray
    levels: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        score = np.clip((x - self.mean) / self.scale, -6, 6) @ self.weights
        return self.levels[(score[:, None] > self.cuts[None, :]).sum(axis=1)]


def fit_ordinal(x: np.ndarray, y: np.ndarray, penalty: float, rounds: int) -> OrdinalModel:
    """Proportional-odds regression with ridge penalty, by Adam on the full batch."""
    levels = np.unique(y)
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale < 1e-9, 1.0, scale)
    z = np.clip((x - mean) / scale, -6, 6)
    k = np.searchsorted(levels, y)
    m = len(levels) - 1
    if m == 0:
        return OrdinalModel(mean, scale, np.zeros(x.shape[1]), np.zeros(0), levels)
    above = (k[:, None] > np.arange(m)[None, :]).astype(np.float64)
    share = np.clip(above.mean(axis=0), 1e-3, 1 - 1e-3)
    theta = np.concatenate([np.zeros(x.shape[1]), -np.log(share / (1 - share))])
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    d = x.shape[1]
    for t in range(1, rounds + 1):
        score = z @ theta[:d]
        p = 1 / (1 + np.exp(-(score[:, None] - theta[None, d:])))
        e = (p - above) / len(y)
        grad = np.concatenate([z.T @ e.sum(axis=1) + penalty * theta[:d], -e.sum(axis=0)])
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad**2
        theta -= 0.05 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return OrdinalModel(mean, scale, theta[:d], np.sort(theta[d:]), levels)


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) over all documents; counts are added up in each task before they are shuffled."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter[str] = Counter()
        for pdf in batches:
            for t in pdf["text"]:
                total.update(_WORD.findall(t.lower()))
            if len(total) > 500_000:
                yield pd.DataFrame({"word": list(total.keys()), "n": list(total.values())})
                total = Counter()
        yield pd.DataFrame({"word": list(total.keys()), "n": list(total.values())}).astype({"n": "int64", "word": "str"})

    return docs.select("text").mapInPandas(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def word_rarity(docs: DataFrame, p: ReadingParams) -> WordModel:
    """Minus the logarithm of the share of each word that makes up ``least_share`` of all words or more."""
    counted = cut(count_words(docs))
    total = counted.agg(F.sum("n")).first()[0] or 0
    kept = counted.filter(F.col("n") >= p.least_share * total)  # at most 1 / least_share words
    got = kept.toPandas()
    release(counted)
    rare = -np.log(got["n"].to_numpy(np.float64) / max(total, 1))
    return WordModel(dict(zip(got["word"], rare.tolist())), -float(np.log(p.least_share)))


def _parts(pdf: pd.DataFrame, most: int = 4_000_000) -> Iterator[pd.DataFrame]:
    """Rows in runs of at most ``most`` characters (or of one text)."""
    size = np.cumsum(pdf["text"].str.len().to_numpy(np.int64)) // most
    for _, part in pdf.groupby(size, sort=True):
        yield part


def graded_features(docs: DataFrame, labels: DataFrame, model: WordModel, p: ReadingParams) -> tuple[np.ndarray, np.ndarray]:
    """Features and levels of at most ``graded_rows`` graded documents; one graded twice comes twice."""
    graded = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("reading_level").cast("double").alias("level")).filter("doc_id is not null and level is not null")
    graded = graded.orderBy(F.xxhash64("doc_id", F.lit(p.seed)), "doc_id", "level").limit(p.graded_rows)
    rows = docs.join(F.broadcast(graded), "doc_id")  # at most graded_rows rows
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = _Words(shared.value)
        for batch in batches:
            for pdf in _parts(batch):
                q = parse(pdf["text"].tolist(), words)
                if len(q.words):
                    own = pdf.iloc[q.texts.label]
                    yield pd.DataFrame({"doc_id": own["doc_id"].to_numpy(), "x": list(features(q, words)), "level": own["level"].to_numpy()})

    got = rows.select("doc_id", "text", "level").mapInPandas(run, "doc_id long, x array<double>, level double").toPandas()
    got = got.sort_values(["doc_id", "level"], ignore_index=True)
    return np.array(got["x"].tolist(), np.float64), got["level"].to_numpy(np.float64)


def reading_levels(docs: DataFrame, labels: DataFrame, p: ReadingParams = ReadingParams()) -> DataFrame:
    """(doc_id, reading_level) of every document with words (runs of letters or digits) in its text.

    Null ids and texts and texts without words are left out; a document row that comes twice gives one row, with the
    greater level if its texts differ. A text with digits only has the least level. Without grades there is no result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null and text is not null")
    words_of = word_rarity(rows, p)
    x, levels = graded_features(rows, labels, words_of, p)
    if not len(levels):
        return spark.createDataFrame([], "doc_id long, reading_level long")
    model = fit_ordinal(x, levels, p.penalty, p.rounds)
    shared = spark.sparkContext.broadcast((words_of, model))  # bounded by least_share and graded_rows

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, m = shared.value
        words = _Words(known)
        for batch in batches:
            for pdf in _parts(batch):
                if len(words) > 500_000:
                    words.reset()
                texts, ids = pdf["text"].tolist(), pdf["doc_id"].to_numpy(np.int64)
                q = parse(texts, words)
                level = np.full(len(texts), int(m.levels[0]), np.int64)
                if len(q.words):
                    level[q.texts.label] = m.predict(features(q, words)).astype(np.int64)
                some = np.zeros(len(texts), bool)
                some[q.texts.label] = True
                for i in np.flatnonzero(~some).tolist():
                    some[i] = bool(_HAS_WORD.search(texts[i]))
                yield pd.DataFrame({"doc_id": ids[some], "reading_level": level[some]})

    found = rows.mapInPandas(run, "doc_id long, reading_level long")
    return found.groupBy("doc_id").agg(F.max("reading_level").alias("reading_level"))
