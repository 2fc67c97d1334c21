"""Repair of text from scanned pages.

1. Words of all texts are counted. A word is frequent if it makes up ``least_share`` of all words (so there are at most
   1 / ``least_share`` of them, whatever the collection). Pairs of frequent words at most ``window`` apart are counted
   over all texts, and skip-gram vectors with negative sampling are trained on the counts: in each round every task
   trains on its part of the pairs, starting from the same vectors, and the results are averaged by the amount of
   training behind them. Pair counts never leave the executors.
2. In records that look scanned, lines with nothing but a page number and running titles are set apart, and words
   hyphenated across lines are joined.
3. A rare word is linked to frequent words that a plausible glyph edit leads to; the link counts when the frequent word
   is much more frequent and, by the vectors, fits the words around it.
4. What remains is reflowed into paragraphs.

A record looks scanned when many of its lines go on in lower case on the next line, or when it has page numbers between
such lines.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ocrlake.session import cut, release


@dataclass(frozen=True)
class ScanParams:
    least_count: int = 10  # words below this count are rare in any case
    least_share: float = 2e-6  # ... or below this share of all words: bounds the frequent words by 500 000
    ratio: float = 20.0  # a frequent word must be so many times as frequent as the rare one
    accent_ratio: float = 40.0  # ... where only an accent differs
    sure_ratio: float = 100.0  # from here on the rare word's own contexts count less
    window: int = 3
    dims: int = 24
    rounds: int = 4  # of training, each with a sample per pair on average
    negatives: int = 5
    rate: float = 0.3
    flatten: float = 0.75  # power of a pair's count, as very frequent words say less
    seed: int = 3
    least_fit: float = -0.15  # least mean cosine of a candidate with its neighbours
    least_wraps: int = 2
    wrap_share: float = 0.3
    similar_titles: float = 0.78


# What a recogniser reads (left) for what is printed (right)
GLYPH_EDITS = (
    ("rn", "m"), ("ri", "n"), ("ii", "u"), ("cl", "d"), ("cl", "đ"), ("vv", "w"), ("u'", "ư"), ("o'", "ơ"), ("h", "li"),
    ("(", "c"), ("0", "o"), ("1", "l"), ("1", "i"), ("|", "l"), ("|", "i"), ("5", "s"), ("6", "b"), ("6", "é"), ("6", "ó"), ("8", "b"),
    ("9", "g"), ("f", "t"), ("t", "f"), ("b", "h"), ("h", "b"), ("c", "e"), ("e", "c"), ("l", "i"), ("i", "l"), ("l", "t"),
    ("d", "cl"), ("m", "rn"), ("n", "ri"), ("u", "ii"), ("!", "l"), ("!", "i"), ("$", "s"), ("3", "e"), ("q", "g"), ("v", "y"),
)
HYPHENS = "-‐‑¬=\u00ad"
DASHES = "–—"

# ------------------------------------------------------------------------------------------------ words

_EDGES = " \t.,;:!?\"“”„«»[]{}<>…*"


def words_of(line: str) -> list[str]:
    """Words of a line as compared: lower case, without punctuation at the ends; brackets go in pairs."""
    out = []
    for raw in line.split():
        w = raw.strip(_EDGES).rstrip(")").lower()
        if w.startswith("("):
            w = w[1:] if raw.rstrip(_EDGES).endswith(")") else w
        w = w.strip(_EDGES)
        if w:
            out.append(w)
    return out


def count_words(texts: DataFrame) -> DataFrame:
    """(word, n) over all texts; counts are added up in each task before they are shuffled."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter[str] = Counter()
        raw: Counter[str] = Counter()
        for pdf in batches:
            for t in pdf["text"]:
                raw.update(t.split())
            if len(raw) > 300_000:
                _fold(raw, total)
                if len(total) > 600_000:
                    yield pd.DataFrame({"word": list(total.keys()), "n": list(total.values())})
                    total = Counter()
        _fold(raw, total)
        yield pd.DataFrame({"word": list(total.keys()), "n": list(total.values())}).astype({"n": "int64", "word": "str"})

    return texts.select("text").mapInPandas(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _fold(raw: Counter, total: Counter) -> None:
    for token, n in raw.items():
        for w in words_of(token):
            total[w] += n
    raw.clear()


# ---------------------------------------------------------------------------------------------- vectors


def pair_counts(texts: DataFrame, vocabulary: list[str], window: int) -> DataFrame:
    """(pair, n): how often frequent words i and j stand at most ``window`` words apart; pair = i * size + j, i <= j."""
    spark = texts.sparkSession
    size = len(vocabulary)
    shared = spark.sparkContext.broadcast({w: i for i, w in enumerate(vocabulary)})  # at most 1 / least_share words

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = shared.value
        token_id: dict[str, int] = {}
        keys = np.zeros(0, np.int64)
        counts = np.zeros(0, np.int64)

        def ids(text: str) -> list[int]:
            out = []
            for token in text.split():
                i = token_id.get(token)
                if i is None:
                    w = words_of(token)
                    i = token_id[token] = index.get(w[0], -1) if w else -1
                out.append(i)
            return out

        for batch in batches:
            if len(token_id) > 400_000:
                token_id.clear()
            flat: list[int] = []
            for t in batch["text"]:
                flat += ids(t)
                flat += [-1] * window
            a = np.array(flat, np.int64)
            new = []
            for d in range(1, window + 1):
                x, y = a[:-d], a[d:]
                ok = (x >= 0) & (y >= 0)
                new.append(np.minimum(x, y)[ok] * size + np.maximum(x, y)[ok])
            k, n = np.unique(np.concatenate(new), return_counts=True)
            keys, inverse = np.unique(np.concatenate([keys, k]), return_inverse=True)
            counts = np.bincount(inverse, np.concatenate([counts, n]), len(keys)).astype(np.int64)
            if len(keys) > 2_000_000:
                yield pd.DataFrame({"pair": keys, "n": counts})
                keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        yield pd.DataFrame({"pair": keys, "n": counts})

    return texts.select("text").mapInPandas(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


_MINI = 8192  # samples of one step


class SkipGram:
    """Word and context vectors, trained by steps of negative sampling with a step size of each row's own."""

    def __init__(self, words: np.ndarray, contexts: np.ndarray, noise: np.ndarray, p: ScanParams) -> None:
        self.words, self.contexts, self.p = words.copy(), contexts.copy(), p
        self.noise = noise  # cumulative distribution of negatives
        self.word_sq, self.context_sq = np.full(len(words), 1e-3, np.float32), np.full(len(words), 1e-3, np.float32)
        self.samples = np.zeros(len(words))

    def step(self, i: np.ndarray, j: np.ndarray, rng: np.random.Generator) -> None:
        """One step on samples (word i, context j) against negatives that all samples share."""
        other = np.searchsorted(self.noise, rng.random(64), side="right")
        w, c, o = self.words[i], self.contexts[j], self.contexts[other]
        pull = 1 - _sigmoid(np.einsum("ij,ij->i", w, c))[:, None]
        push = _sigmoid(w @ o.T) * (self.p.negatives / len(other))
        self._add(self.words, self.word_sq, i, pull * c - push @ o)
        self._add(self.contexts, self.context_sq, np.concatenate([j, other]), np.concatenate([pull * w, -push.T @ w]))
        self.samples += np.bincount(i, minlength=len(self.words)) + np.bincount(j, minlength=len(self.words))

    def _add(self, rows: np.ndarray, squares: np.ndarray, at: np.ndarray, grad: np.ndarray) -> None:
        order = np.argsort(at, kind="stable")
        at = at[order]
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        total, row = np.add.reduceat(grad[order], first, axis=0), at[first]
        squares[row] += np.square(total).mean(axis=1)
        rows[row] += self.p.rate * total / np.sqrt(squares[row])[:, None]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def skipgram_vectors(pairs: DataFrame, counts: np.ndarray, p: ScanParams) -> np.ndarray:
    """Unit vectors (words x dims) trained on pair counts (pair, n) as ``pair_counts`` gives them.

    ``counts`` are the words' own counts. Each round sends the vectors to the tasks and brings back one averaged row per
    word; both are bounded by the number of frequent words.
    """
    size = len(counts)
    rng = np.random.default_rng(p.seed)
    words = ((rng.random((size, p.dims)) - 0.5) / p.dims).astype(np.float32)
    contexts = np.zeros((size, p.dims), np.float32)
    if not size:
        return words
    noise = np.cumsum(counts.astype(np.float64) ** 0.75)
    noise = (noise / noise[-1]).astype(np.float64)
    # a fixed order that mixes words, so that a task retried trains alike
    table = cut(pairs.withColumn("mix", F.xxhash64("pair")).repartition("pair").sortWithinPartitions("mix").select("pair", "n"))
    whole = table.agg(F.count("*").alias("k"), F.sum(F.pow("n", F.lit(p.flatten))).alias("w")).first()
    each = whole["w"] / whole["k"] if whole["k"] else 1.0  # weight of one sample
    spark = table.sparkSession
    for number in range(p.rounds if whole["k"] else 0):
        shared = spark.sparkContext.broadcast((words, contexts))

        def run(batches: Iterator[pd.DataFrame], number=number, shared=shared) -> Iterator[pd.DataFrame]:
            from pyspark import TaskContext

            model = SkipGram(*shared.value, noise, p)
            rng = np.random.default_rng([p.seed, number, TaskContext.get().partitionId()])
            for pdf in batches:
                pair, weight = pdf["pair"].to_numpy(), np.cumsum(pdf["n"].to_numpy(np.float64) ** p.flatten)
                if not len(pair):
                    continue
                todo = int(np.ceil(weight[-1] / each))
                for at in range(0, todo, _MINI):
                    k = np.searchsorted(weight, rng.random(min(_MINI, todo - at)) * weight[-1], side="right").clip(0, len(pair) - 1)
                    i, j = pair[k] // size, pair[k] % size
                    turn = rng.random(len(k)) < 0.5
                    model.step(np.where(turn, j, i), np.where(turn, i, j), rng)
            row = np.flatnonzero(model.samples)
            yield pd.DataFrame({"row": row, "weight": model.samples[row], "v": list(np.hstack([model.words[row], model.contexts[row]]))})

        got = table.mapInPandas(run, "row long, weight double, v array<float>").groupBy("row")
        mean = [(F.sum(F.col("v")[d] * F.col("weight")) / F.sum("weight")).cast("float") for d in range(2 * p.dims)]
        back = got.agg(F.array(*mean).alias("v")).toPandas()
        if len(back):
            v = np.array(back["v"].tolist(), np.float32)
            words[back["row"]], contexts[back["row"]] = v[:, : p.dims], v[:, p.dims :]
        shared.unpersist()
    release(table)
    return words / np.maximum(np.linalg.norm(words, axis=1, keepdims=True), 1e-9)


@dataclass
class ScanModel:
    counts: dict[str, int]  # frequent words
    index: dict[str, int]
    vectors: np.ndarray


def learn(texts: DataFrame, p: ScanParams) -> ScanModel:
    """Counts and vectors of all frequent words, from all texts."""
    counted = cut(count_words(texts))
    total = counted.agg(F.sum("n")).first()[0] or 0
    kept = counted.filter(F.col("n") >= max(p.least_count, p.least_share * total)).orderBy(F.desc("n"), "word")
    top = [(r["word"], r["n"]) for r in kept.collect()]  # at most 1 / least_share words
    release(counted)
    names = [w for w, _ in top]
    vec = skipgram_vectors(pair_counts(texts, names, p.window), np.array([n for _, n in top], np.int64), p)
    return ScanModel(dict(top), {w: i for i, w in enumerate(names)}, vec)


# ---------------------------------------------------------------------------------------------- furniture

_LABEL = r"(?:page|seite|trang|p[áa]gina|pag|pg|p|s|t|n)"
_NUM = r"(?:[\dlIOoSBZ|]{1,4})"
_ROMAN = r"x{0,3}(?:ix|iv|v?i{0,3})"
_PAGE = re.compile(
    rf"^\W*(?:{_LABEL}\b\W*)?(?P<n>{_NUM})(?:\s*(?:/|of|sur|von|de|trên|out of)\s*{_NUM})?\W*$",
    re.I,
)
_ROMAN_LINE = re.compile(rf"^\W*(?:{_LABEL}\b\W*)?(?P<n>{_ROMAN})\W*$", re.I)
_AMOUNT = re.compile(r"\d[\d\s.]*[,.]\d\d\W*$|\d:\d|%|#|\d\s+\d")
_LEAD = re.compile(rf"^\s*({_NUM})\s{{2,}}(?=\S)")
_TAIL = re.compile(rf"(?<=\S)\s{{2,}}({_NUM})\s*$")


def is_page_number(line: str) -> bool:
    """Whether a line holds a page number and nothing else; amounts, times and percentages are none."""
    s = line.strip()
    if not s:
        return False
    m = _PAGE.match(s)
    if m and not _AMOUNT.search(re.sub(r"\s*/\s*", "/", s)):
        if any(ch.isdigit() for ch in s) or re.fullmatch(r"[lOI]{1,3}", m.group("n")):
            return True
    m = _ROMAN_LINE.match(s)
    return bool(m and m.group("n"))


def _skeleton(s: str) -> str:
    s = unicodedata.normalize("NFD", s.casefold())
    return "".join(ch for ch in s if ch.isalnum())


class _Forms:
    """Distinct title forms of a record, with their letter counts: only forms that may be similar are compared in full.

    An edit changes the letter counts of a form by two at most, so forms whose counts differ by more are out.
    """

    def __init__(self, forms: list[str]) -> None:
        self.many = Counter(forms)
        self.distinct = list(self.many)
        self.sizes = np.array([len(a) for a in self.distinct], np.int64)
        self.letters = np.array([self._count(a) for a in self.distinct], np.int32).reshape(len(self.distinct), 64)
        self.at: dict[str, list[int]] | None = None

    @staticmethod
    def _count(a: str) -> np.ndarray:
        return np.bincount(np.fromiter((ord(ch) & 63 for ch in a), np.int64, len(a)), minlength=64)

    def like(self, a: str, least: float, same: bool = False) -> list[str]:
        """Forms similar to ``a``, without ``a`` itself unless ``same``."""
        if not self.distinct:
            return []
        n = np.maximum(self.sizes, len(a))
        allowed = ((1 - least) * n).astype(np.int64)
        likely = np.flatnonzero((np.minimum(self.sizes, len(a)) >= least * n) & (np.abs(self.letters - self._count(a)).sum(axis=1) <= 2 * allowed))
        return [b for b in (self.distinct[k] for k in likely.tolist()) if (same or a != b) and _similar(a, b, least)]

    def lines(self, fits: list[tuple[int, str]], form: str) -> list[int]:
        if self.at is None:
            self.at = {}
            for i, a in fits:
                self.at.setdefault(a, []).append(i)
        return self.at[form]


def _similar(a: str, b: str, least: float) -> bool:
    n = max(len(a), len(b))
    if not n or min(len(a), len(b)) < least * n:
        return False
    allowed = int((1 - least) * n)
    return _distance(a, b, allowed) <= allowed


def _distance(a: str, b: str, most: int) -> int:
    """Edit distance, by bit-parallel columns; ``most`` only says what counts as far."""
    if a == b:
        return 0
    at: dict[str, int] = {}
    for i, ch in enumerate(a):
        at[ch] = at.get(ch, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << len(a) - 1 if a else 0
    pv, mv, score = full, 0, len(a)
    for ch in b:
        eq = at.get(ch, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & full, pv & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = (ph << 1 | 1) & full, mh << 1 & full
        pv, mv = mh | ~(xv | ph) & full, ph & xv
    return score


def _full(line: str, following: str, width: int) -> bool:
    """Whether the first word of the next line had no room at the end of this one."""
    word = following.split(None, 1)[0] if following.strip() else ""
    return len(line.rstrip()) + 1 + len(word) > width


def page_width(lines: list[str]) -> int:
    """Width that lines are wrapped at: the greatest length, without outliers."""
    lengths = sorted(len(x.rstrip()) for x in lines if x.strip())
    return lengths[int(0.95 * (len(lengths) - 1))] if lengths else 0


def looks_scanned(lines: list[str], p: ScanParams) -> bool:
    """Whether enough lines are wrapped: they go on in lower case, or as a full line without an end sign."""
    body = [x.strip() for x in lines]
    body = [x for x in body if len(x) >= 12]
    width = page_width(body)
    open_ends = [(a, b) for a, b in zip(body, body[1:]) if a[-1] not in ".!?:;)"]
    low = sum(1 for a, b in open_ends if b[0].islower())
    wraps = sum(1 for a, b in open_ends if b[0].islower() or _full(a, b, width - 1))
    return low >= p.least_wraps and wraps >= p.wrap_share * len(body)


TEXT, BLANK, NUMBER, HEADER = "text", "blank", "page_number", "header"


def line_roles(lines: list[str], known: dict[str, int], p: ScanParams) -> list[str]:
    """Role of every line of a scanned record."""
    roles = [BLANK if not x.strip() else NUMBER if is_page_number(x) else TEXT for x in lines]
    filled = [i for i, r in enumerate(roles) if r != BLANK]
    place = {i: k for k, i in enumerate(filled)}
    titles: list[tuple[int, str, bool]] = []
    width = page_width(lines)
    for i in filled:
        if roles[i] != TEXT:
            continue
        s = lines[i].strip()
        bare = _TAIL.sub("", _LEAD.sub("", lines[i])).strip()
        numbered = bare != s
        letters = [ch for ch in bare if ch.isalpha()]
        if len(letters) < 4 or len(bare) > width or bare[-1] in ".,;:!?)" + HYPHENS + DASHES or "," in bare or bare[0].islower():
            continue
        last = [w for w in bare.split() if w[0].isalpha()]
        if not last or last[-1][0].islower():
            continue
        k = place[i]
        beside = any(0 <= q < len(filled) and roles[filled[q]] == NUMBER for q in (k - 1, k + 1))
        odd = any(w not in known for w in words_of(bare) if any(ch.isalpha() for ch in w))
        short = k + 1 < len(filled) and not _full(lines[i], lines[filled[k + 1]], width - 2)
        titles.append((i, _skeleton(bare), numbered or beside or odd or short or k in (0, len(filled) - 1)))
    fits = [(i, a) for i, a, fit in titles if fit]
    forms = _Forms([a for _, a in fits])
    for x, (i, a) in enumerate(fits):
        if forms.many[a] > 1 or forms.like(a, p.similar_titles):
            roles[i] = HEADER
    if fits:
        # a page's title may be misread beyond recognition as a title: it still is like another page's
        for i in filled:
            if roles[i] == TEXT:
                a = _skeleton(_TAIL.sub("", _LEAD.sub("", lines[i])))
                if len(a) >= 8:
                    near = [b for b in forms.like(a, p.similar_titles, same=True) if any(j != i for j in forms.lines(fits, b))]
                    if near:
                        roles[i] = HEADER
                        for b in near:
                            for j in forms.lines(fits, b):
                                roles[j] = HEADER
    for i in filled:
        # a title that carries its page number needs no second page
        if roles[i] == TEXT and (_LEAD.match(lines[i]) or _TAIL.search(lines[i])):
            bare = _TAIL.sub("", _LEAD.sub("", lines[i])).strip()
            if bare and bare[0].isupper() and bare[-1].isalpha() and place[i] in (0, len(filled) - 1):
                roles[i] = HEADER
    return roles


# ---------------------------------------------------------------------------------------------- misread words


def _strip_marks(w: str) -> str:
    return "".join(ch for ch in unicodedata.normalize("NFD", w.replace("đ", "d")) if not unicodedata.combining(ch))


class Corrector:
    """Links words to frequent ones by glyph edits, and chooses among them by the words around."""

    def __init__(self, model: ScanModel, p: ScanParams) -> None:
        self.model, self.p = model, p
        self.known: dict[str, list[str]] = {}
        self.longest = max(map(len, model.counts), default=0)
        self.by_base: dict[str, list[str]] = {}
        for w in model.counts:
            base = _strip_marks(w)
            if base != w:
                self.by_base.setdefault(base, []).append(w)

    @staticmethod
    def _edits(w: str) -> set[str]:
        out = set()
        for read, printed in GLYPH_EDITS:
            k = w.find(read)
            while k >= 0:
                out.add(w[:k] + printed + w[k + len(read) :])
                k = w.find(read, k + 1)
        return out

    def links(self, w: str) -> list[str]:
        """Frequent words that glyph edits lead to: one edit, else an accent, else two edits."""
        if w in self.known:
            return self.known[w]
        counts, p = self.model.counts, self.p
        own = counts.get(w, p.least_count / 4)
        enough = lambda c, r: counts.get(c, 0) >= r * own
        found = []
        # an edit makes a word shorter by one letter at most: longer words than these lead nowhere
        if 1 < len(w) and len(w) - w.count(".") <= self.longest + 2 and any(ch.isalpha() for ch in w) and not self._code(w):
            one = self._edits(w)
            found = [c for c in one if c != w and c in counts and enough(c, p.ratio)]
            if not w.isascii() or "." in w or w not in counts:
                dotted = w.replace(".", "") if "." in w.strip(".") else w
                found += [c for c in self.by_base.get(_strip_marks(dotted), ()) if c != w and enough(c, p.accent_ratio) and self._accent(dotted, c)]
            if not found and w not in counts and len(w) >= 4:
                found = [c for x in one for c in self._edits(x) if c != w and len(c) > 3 and c in counts and enough(c, p.ratio)]
        if len(self.known) > 200_000:
            self.known.clear()
        self.known[w] = found = sorted(set(found), key=lambda c: (-counts[c], c))
        return found

    @staticmethod
    def _code(w: str) -> bool:
        """Codes, numbers, versions, times: digits make up half, or signs part the word."""
        digits = sum(ch.isdigit() for ch in w)
        return digits * 2 > len(w) or any(ch in w for ch in "@#\\/:_%")

    @staticmethod
    def _accent(a: str, b: str) -> bool:
        """Same letters, exactly one of them with other marks."""
        a, b = unicodedata.normalize("NFC", a), unicodedata.normalize("NFC", b)
        return len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1

    def fit(self, w: str, around: list[int]) -> float:
        """Mean cosine with the words around; 0 where nothing is known."""
        i = self.model.index.get(w)
        if i is None or not around:
            return 0.0
        return float((self.model.vectors[around] @ self.model.vectors[i]).mean())

    def correct(self, words: list[str], k: int) -> str | None:
        """What word k of ``words`` should be, or None if it stays."""
        w = words[k]
        cands = self.links(w)
        if not cands:
            return None
        index = self.model.index
        around = [index[x] for x in words[max(0, k - self.p.window) : k] + words[k + 1 : k + 1 + self.p.window] if x in index]
        scored = [(self.fit(c, around), self.model.counts[c], c) for c in cands]
        best = max(scored, key=lambda x: (round(x[0], 2), x[1]))
        if best[0] < self.p.least_fit:
            return None
        if w in self.model.counts:
            # a word of its own: it stays if it fits as well, or, where it is very rare beside the other, clearly better
            far = self.model.counts[best[2]] >= self.p.sure_ratio * self.model.counts[w]
            if best[0] < self.fit(w, around) + (-0.2 if far else 0.05):
                return None
        return best[2]


# ---------------------------------------------------------------------------------------------- records


def _hyphen_end(line: str) -> str | None:
    """The line without its closing hyphen, if it ends within a word."""
    s = line.rstrip()
    if len(s) >= 2 and s[-1] in HYPHENS and s[-2].isalnum():
        return s[:-1]
    return None


def repair(text: str, model: ScanModel, corrector: Corrector, p: ScanParams) -> tuple[list[tuple[int, str]], str]:
    """Noisy lines (number from 1, kind) of a record, and its text in continuous paragraphs."""
    lines = [x.rstrip("\r") for x in text.split("\n")]
    if not looks_scanned(lines, p):
        return [], text
    roles = line_roles(lines, model.counts, p)
    noise = [(i + 1, r) for i, r in enumerate(roles) if r in (NUMBER, HEADER)]
    body = [i for i, r in enumerate(roles) if r == TEXT]
    # tokens: (word as compared, as written, [(line, end of its part in the joined word)])
    paragraphs: list[list[tuple[str, list[tuple[int, int]]]]] = [[]]
    carry: tuple[str, int] | None = None
    for at, i in enumerate(body):
        line = lines[i]
        before = body[at - 1] if at else None
        if carry is None and before is not None:
            gap = [roles[q] for q in range(before + 1, i)]
            fresh = line[:1].isspace() and not lines[before][:1].isspace() or (BLANK in gap and NUMBER not in gap and HEADER not in gap)
            if fresh and paragraphs[-1] and lines[before].rstrip()[-1:] in ".!?:;)\"”»":
                paragraphs.append([])
        stem = _hyphen_end(line)
        following = body[at + 1] if at + 1 < len(body) else None
        broken = stem is not None and following is not None and lines[following].strip()[:1].isalnum()
        s = (stem if broken else line).strip()
        if not broken and len(s) > 1 and s[-1] in HYPHENS + DASHES and s[-2].isspace():
            s = s[:-1].rstrip()
        parts = s.split()
        for k, raw in enumerate(parts):
            where = [(i, len(raw))]
            if k == 0 and carry is not None:
                left, from_line = carry
                joined, whole = left + raw, left + "-" + raw
                if words_of(joined)[:1] and words_of(joined)[0] not in model.counts and words_of(whole)[:1] and words_of(whole)[0] in model.counts:
                    where = [(from_line, len(left) + 1), (i, len(whole))]
                    raw = whole
                else:
                    where = [(from_line, len(left)), (i, len(joined))]
                    raw = joined
                carry = None
            if broken and k == len(parts) - 1:
                if len(where) > 1:  # a word over three lines keeps its first line
                    carry = (raw, where[0][0])
                else:
                    carry = (raw, i)
                noise.append((i + 1, "hyphen"))
                break
            paragraphs[-1].append((raw, where))
    if carry is not None:
        paragraphs[-1].append((carry[0], [(carry[1], len(carry[0]))]))
    misread: set[int] = set()
    out = []
    flat = [t for par in paragraphs for t in par]
    words = [(words_of(raw) or [""])[0] for raw, _ in flat]
    fixed: list[str] = []
    for k, (raw, where) in enumerate(flat):
        new = corrector.correct(words, k) if words[k] else None
        if new is None:
            fixed.append(raw)
            continue
        misread.update(_wrong_lines(words[k], new, raw, where))
        low = raw.lower()
        pos = low.find(words[k])
        shaped = new.capitalize() if raw[pos : pos + 1].isupper() else new
        fixed.append(raw[:pos] + shaped + raw[pos + len(words[k]) :] if pos >= 0 else shaped)
    noise += [(i + 1, "misread") for i in misread]
    k = 0
    for par in paragraphs:
        if par:
            out.append(" ".join(fixed[k : k + len(par)]))
            k += len(par)
    return sorted(noise), "\n\n".join(out)


def _wrong_lines(word: str, new: str, raw: str, where: list[tuple[int, int]]) -> list[int]:
    """Lines that hold the wrong part of a word; a word broken over two lines is wrong where it differs."""
    if len(where) == 1:
        return [where[0][0]]
    start = max(raw.lower().find(word), 0)
    cut = where[0][1] - start
    same = 0
    while same < min(len(word), len(new)) and word[same] == new[same]:
        same += 1
    tail = 0
    while tail < min(len(word), len(new)) - same and word[-1 - tail] == new[-1 - tail]:
        tail += 1
    out = []
    if same < cut:
        out.append(where[0][0])
    if len(word) - tail > cut:
        out.append(where[1][0])
    return out or [where[-1][0]]


def repair_texts(texts: DataFrame, p: ScanParams = ScanParams()) -> DataFrame:
    """(origin, record_key, text, noise) of texts (origin, record_key, text): repaired text and its noisy lines.

    Null texts are left out; texts that don't look scanned come back as they are, without noise. Repeated rows give
    repeated results. An empty table gives no rows.
    """
    texts = texts.filter(F.col("text").isNotNull())
    model = learn(texts, p)
    shared = texts.sparkSession.sparkContext.broadcast(model)  # at most 1 / least_share words

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        corrector = Corrector(m, p)
        for pdf in batches:
            done = [repair(t, m, corrector, p) for t in pdf["text"]]
            yield pd.DataFrame(
                {
                    "origin": pdf["origin"],
                    "record_key": pdf["record_key"],
                    "text": [t for _, t in done],
                    "noise": [[{"line_no": n, "noise": kind} for n, kind in noise] for noise, _ in done],
                }
            )

    return texts.select("origin", "record_key", "text").mapInPandas(run, "origin string, record_key string, text string, noise array<struct<line_no: long, noise: string>>")


def scanned_texts(screenshots: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Both tables' texts as (origin, record_key, text)."""
    a = screenshots.select(F.lit("screenshots").alias("origin"), F.col("id").cast("string").alias("record_key"), F.col("ocr_text").alias("text"))
    b = benchmark.select(F.lit("benchmark_corpus").alias("origin"), F.col("fixture_name").alias("record_key"), F.col("text"))
    return a.union(b).filter("record_key is not null and text is not null")


def noisy_lines(repaired: DataFrame) -> DataFrame:
    return repaired.select("origin", "record_key", F.inline("noise")).select("origin", "record_key", "line_no", "noise").distinct()
