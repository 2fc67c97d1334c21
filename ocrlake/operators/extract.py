"""Pieces of the text-extraction pipeline: tiling, line classes, candidate choice, boxes, decoding, engine routing."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ocrlake.functions.text import normalize_ocr_text, wstrim
from ocrlake.schema import EngineError

# Side and overlap of tiles
TILE_SIZE, TILE_OVERLAP = 2000, 150

# --------------------------------------------------------------------------------------------------- tiling


def downscaled(width: Column, height: Column, most: Column) -> tuple[Column, Column]:
    """Width and height that fit into ``most``, in proportion, rounded half away from zero, 1 at least."""
    fits = (width <= most) & (height <= most)
    scale = most / F.greatest(width, height)
    side = lambda v: F.when(fits, v).otherwise(F.greatest(F.round(v * scale), F.lit(1))).cast("long")
    return side(width), side(height)


def processing_strategy(width: Column, height: Column, most: Column) -> Column:
    tall = (height > width * 2) & (height > TILE_SIZE)
    wide = (width > height * 2) & (width > TILE_SIZE)
    return F.when(tall, "vertical_tiling").when(wide, "horizontal_tiling").when((width <= most) & (height <= most), "direct").otherwise("downscale")


def tiles(width: Column, height: Column, most: Column) -> Column:
    """Array of tiles (x, y, width, height) for images that are tiled, else one tile of the (scaled) image."""
    step = TILE_SIZE - TILE_OVERLAP

    def starts(side: Column) -> Column:
        # the last start is the first whose tile reaches the end
        n = F.greatest(F.ceil((side - TILE_SIZE) / F.lit(step)), F.lit(0)).cast("long")
        return F.transform(F.sequence(F.lit(0).cast("long"), n), lambda k: k * step)

    tile = lambda x, y, w, h: F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), w.cast("long").alias("width"), h.cast("long").alias("height"))
    zero = F.lit(0)
    kind = processing_strategy(width, height, most)
    dw, dh = downscaled(width, height, most)
    vertical = F.transform(starts(height), lambda y: tile(zero, y, width, F.least(height - y, F.lit(TILE_SIZE))))
    horizontal = F.transform(starts(width), lambda x: tile(x, zero, F.least(width - x, F.lit(TILE_SIZE)), height))
    return F.when(kind == "vertical_tiling", vertical).when(kind == "horizontal_tiling", horizontal).otherwise(F.array(tile(zero, zero, dw, dh)))


_RECENT = 6  # kept lines that a new one is compared with


def _ascii_fold(s: str) -> str:
    return s.translate({cp: cp + 32 for cp in range(65, 91)})


def merge_tile_lines(texts: list[str]) -> str:
    """Lines of overlapping tiles in order, without those that one of the last six kept lines already has.

    ASCII case does not matter. Of the recent lines the first that settles the new one counts: an equal line drops it, a
    line that is its beginning is replaced by it.
    """
    kept: list[str] = []
    for text in texts:
        for line in filter(None, map(str.strip, text.splitlines())):
            form = _ascii_fold(line)
            for at in range(max(0, len(kept) - _RECENT), len(kept)):
                if _ascii_fold(kept[at]) == form:
                    break
                if line.startswith(kept[at]):
                    kept[at] = line
                    break
            else:
                kept.append(line)
    return "\n".join(kept)


@F.pandas_udf(T.StringType())
def merged_tiles(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: None if x is None else merge_tile_lines([t or "" for t in x]))


# --------------------------------------------------------------------------------------------- line classes

TECHNICAL, NATURAL, UNCERTAIN = "Technical", "Natural", "Uncertain"

# Parts of a line, in lower case, that make it technical
_LOWER_PARTS = (
    "http://", "https://", "www.", "://", "localhost:", "127.0.0.1", "192.168.",
    ".json", ".toml", ".rs", ".ts", ".tsx", ".js", ".py", ".prisma", ".dll", ".exe", ".onnx", ".png", ".jpg", ".jpeg", ".lock",
    ".node", ".css", ".html", ".md", ".sh", ".ps1", ".yml", ".yaml", ".sqlite", ".db", ".so", ".sql", ".rlib", ".log",
    "err_", "econnrefused", "eacces", "eperm", "eaddrinuse", "prismaclientknownrequesterror", "nullpointerexception", "exception",
    "panic", "error:", "fatal:", "stacktrace", "internal server error", "transaction already closed", "http 500", "http 404",
    "http 502", "http 503", "npm run", "npx ", "cargo ", "git commit", "git push", "git status", "git checkout", "git tag",
    "commit ", "sha256:", "container_id=", "container id:",
)
# Parts that count as written
_EXACT_PARTS = (
    "/usr/", "/home/", "/etc/", "/var/", "/node_modules/", "/api/", "\\Users\\", "\\Project\\", "\\AppData\\", "\\Program Files\\",
    "::", "->", "=>", "&&", "||", "==", "!=", "/*", "*/", "//", "fn ", "pub fn", "let mut", "const ",
)
# Beginnings, pairs of key words and port numbers that make a line technical
_STARTS = ("./", "../", "GET /", "POST /", "PUT /", "DELETE /", "PS ", "$ ", "> ")
_PAIRS = (("SELECT ", "FROM "), ("INSERT INTO ", "VALUES"), ("UPDATE ", "SET "), ("DELETE FROM ", "WHERE "))
_PORTS = ("8080", "3000", "6379", "5432", "8000", "8443")

_AN = r"\p{IsAlphabetic}\p{N}"


def _any_of(parts: tuple[str, ...]) -> str:
    return "|".join(re.escape(p).replace("/", "/") for p in parts)


def strong_technical(line: Column) -> Column:
    """Whether a line has a pattern that settles it as technical."""
    low = F.lower(line)
    separators = F.length(line) - F.length(F.translate(line, "\\/", ""))
    rules = [
        low.rlike(_any_of(_LOWER_PARTS)),
        line.rlike(_any_of(_EXACT_PARTS)),
        low.startswith("at "),
        (line.rlike("^[A-Za-z]:") & (separators >= 1)) | (separators >= 2),
        line.rlike("^(?:" + _any_of(_STARTS) + ")"),
        # a path of two segments, whatever signs stand around it
        line.rlike(rf"(?U)(?:^|\s)[^{_AN}/._\-\s]*/(?=[^\s]{{4,}})[^/\s]*/"),
        # P and four digits as a word of its own
        line.rlike(rf"(?U)(?:^|\s)[^{_AN}\s]*[Pp][0-9]{{4}}[^{_AN}\s]*(?=\s|$)"),
        line.rlike(r"(?U)(?:^|\s)@[^\s]*/"),
        # key=value with one equals sign, a plain key, and a hexadecimal digit in the value; five bytes or more
        line.contains("=") & F.exists(F.split(line, r"(?U)\s+"), lambda w: (F.octet_length(w) >= 5) & w.rlike(rf"^[^{_AN}_\-=]*[{_AN}_\-]+[^{_AN}_\-=]*=[^=]*[0-9A-Fa-f][^=]*$")),
        # prefixes with two bytes or more (0x, SIG) or one byte or more (ORA-) after them
        line.rlike(r"(?U)(?:^|\s)0[xX](?:[^\s]{2}|[^\s\x00-\x7f])"),
        line.rlike(r"(?U)(?:^|\s)(?:ORA-[^\s]|SIG(?:[^\s]{2}|[^\s\x00-\x7f]))"),
    ]
    for a, b in _PAIRS:
        rules.append(line.contains(a) & line.contains(b))
    out = rules[0]
    for r in rules[1:]:
        out = out | r
    return F.coalesce(out, F.lit(False))


def _word_score(word: Column) -> Column:
    clean = F.regexp_replace(word, rf"^[^{_AN}_\-]+|[^{_AN}_\-]+$", "")
    size = F.octet_length(clean)
    turns = F.regexp_count(clean, F.lit(r"(?<=\p{Ll})\p{Lu}"))
    n = lambda cond, points: F.when(cond, points).otherwise(0)
    return (
        n(clean.contains("_") & (size > 3), 25)
        + n((size >= 4) & clean.rlike("^[A-Z0-9_]*[A-Z][A-Z0-9_]*$"), 15)
        + F.when(turns >= 2, 30).when((turns == 1) & (size >= 6), 15).otherwise(0)
        + n((size >= 7) & clean.rlike("^[0-9A-Fa-f]+$") & clean.rlike("[0-9]") & clean.rlike("[A-Fa-f]"), 25)
        + n((size >= 8) & clean.rlike(rf"^[{_AN}.]{{2,}}(?:-[{_AN}.]{{2,}})+$"), 20)
        + n(clean.isin(*_PORTS), 15)
        + n(word.contains("->") | word.contains("::") | clean.rlike(r"[./\\]"), 10)
    )


def line_scores(line: Column) -> tuple[Column, Column]:
    """Technical and natural score of a line from its characters and words."""
    size = F.greatest(F.length(line), F.lit(1)).cast("float")
    ratio = lambda n: (n.cast("float") / size).cast("float")
    letters = F.regexp_count(line, F.lit(r"\p{IsAlphabetic}"))
    digits = F.regexp_count(line, F.lit("[0-9]"))
    signs = F.regexp_count(line, F.lit(r"(?U)[^\p{IsAlphabetic}0-9\s]"))
    f = lambda v: F.lit(v).cast("float")
    words = F.filter(F.split(line, r"(?U)\s+"), lambda w: w != "")
    n = F.size(words)
    tech = F.when(ratio(signs) > f(0.15), 25).when(ratio(signs) > f(0.08), 10).otherwise(0)
    tech = tech + F.when(ratio(digits) > f(0.30), 20).when(ratio(digits) > f(0.15), 10).otherwise(0)
    tech = tech + F.aggregate(F.transform(words, _word_score), F.lit(0), lambda a, b: a + b)
    natural = F.when(ratio(letters) > f(0.80), 15).otherwise(0) + F.when(ratio(signs) > f(0.08), 0).otherwise(10)
    natural = natural + F.when(n >= 3, 15).when(n == 2, 5).otherwise(0)
    return tech, natural


# Marks that letters of the language may carry
_OWN_MARKS = frozenset("̛̣̀́̂̃̆̉")


def _foreign_letters() -> str:
    out = []
    for cp in range(0xC0, 0x1F00):
        ch = chr(cp)
        parts = unicodedata.normalize("NFD", ch)
        if len(parts) > 1 and parts[0].isascii() and parts[0].isalpha() and ch.isalpha() and not set(parts[1:]) <= _OWN_MARKS:
            out.append(ch)
    return "".join(out)


def corrupted_marks(line: Column) -> Column:
    """Whether a line of two words and six letters, not all capitals, has a Latin letter with a mark that Vietnamese lacks."""
    words = F.size(F.filter(F.split(line, r"(?U)\s+"), lambda w: w != ""))
    letters = F.regexp_count(line, F.lit(r"\p{IsAlphabetic}"))
    foreign = F.length(F.translate(line, _foreign_letters(), "")) < F.length(line)
    return foreign & line.rlike(r"\p{Ll}") & (words >= 2) & (letters >= 6)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is named."""
    return F.element_at(F.transform(F.array(value), use), 1)


def classify_line(line: Column) -> Column:
    """Technical, Natural or Uncertain; a blank or null line is Uncertain."""

    def by_score(r: Column) -> Column:
        return F.when(r["tech"] >= 30, TECHNICAL).when(r["tech"] >= 15, UNCERTAIN).when((r["natural"] >= 20) & (r["tech"] < 10), NATURAL).otherwise(UNCERTAIN)

    def of(s: Column) -> Column:
        tech, natural = line_scores(s)
        scored = _once(F.struct(tech.alias("tech"), natural.alias("natural")), by_score)
        return F.when(s == "", UNCERTAIN).when(strong_technical(s), TECHNICAL).when(corrupted_marks(s), NATURAL).otherwise(scored)

    return _once(wstrim(F.coalesce(line, F.lit(""))), of)


# ----------------------------------------------------------------------------------- technical re-recognition


def choose_candidate(base: Column, second: Column) -> Column:
    """The better of two readings of a technical line: the first unless the second clearly has more of it."""
    b, u = wstrim(base), wstrim(second)
    count = lambda c, ch: F.length(c) - F.length(F.translate(c, ch, ""))
    padded = lambda c: c.rlike(" = |= | =")
    better = (
        ((F.octet_length(u) >= F.octet_length(b) + 8) & u.startswith(b))
        | (u.contains("=") & ~b.contains("="))
        | (count(u, "_") > count(b, "_"))
        | (b.contains("=") & u.contains("=") & padded(b) & ~padded(u))
    )
    return F.when(b == "", u).when((u == "") | (u == b), b).when(better, u).otherwise(b)


# What makes a second reading of a line worth while
_SECOND_PASS = (" = ", "= ", " =", "pid-", "client new", 'OcrEngineMode "', "node modules")


def needs_second_pass(text: Column) -> Column:
    s = wstrim(text)
    hit = (s == "") | (s == "Migration")
    for p in _SECOND_PASS:
        hit = hit | s.contains(p)
    return hit


def routed_line(probe: Column, second: Column, native: Column) -> Column:
    """What is kept of one text line from its readings; null where nothing is.

    ``probe`` is the first engine's reading, ``second`` its reading of the enlarged line, ``native`` the language engine's
    (null where an engine has none). A natural line takes the language engine's reading if it is not blank. A technical or
    uncertain one takes the better of probe and second reading where the probe looks broken, and falls back to the
    language engine's.
    """
    filled = lambda c: F.when(wstrim(F.coalesce(c, F.lit(""))) != "", c)
    base = F.coalesce(probe, F.lit(""))
    chosen = F.when(needs_second_pass(base), choose_candidate(base, F.coalesce(second, F.lit("")))).otherwise(base)
    return F.when(classify_line(base) == NATURAL, F.coalesce(filled(native), filled(probe))).otherwise(F.coalesce(filled(chosen), filled(native)))


def routed_texts(lines: DataFrame, whole: DataFrame) -> DataFrame:
    """(id, ocr_text, by_lines) from lines (id, line_no, probe, second, native): the kept lines of each image in order.

    An image without lines, or of which nothing is kept, has the text that ``whole`` (id, text) gives it. Lines are cleaned
    up as one text.
    """
    kept = lines.select("id", "line_no", routed_line(F.col("probe"), F.col("second"), F.col("native")).alias("text")).filter("text is not null")
    texts = kept.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("line_no", "text"))).alias("ls"))
    texts = texts.select("id", normalize_ocr_text(F.array_join(F.transform("ls", lambda x: x["text"]), "\n")).alias("lines_text"))
    both = whole.join(texts, "id", "left")
    return both.select("id", F.coalesce("lines_text", "text").alias("ocr_text"), F.col("lines_text").isNotNull().alias("by_lines"))


# ----------------------------------------------------------------------------------------------------- boxes

# Fixed values of the line detector: greatest side it sees, step of its sides, padding of boxes and its least values, lines kept
DETECTOR_SIDE, DETECTOR_STEP, MOST_LINES = 960, 32, 128
PAD_X, PAD_Y, LEAST_PAD_X, LEAST_PAD_Y, LEAST_CROP = 0.15, 0.55, 4, 6, 4


def detector_size(width: Column, height: Column) -> tuple[Column, Column]:
    """Width and height of the picture the detector sees: scaled down to its greatest side, rounded up to its step."""
    # all in single precision, as the detector's own arithmetic
    scale = F.least((F.lit(float(DETECTOR_SIDE)).cast("float") / F.greatest(width, height).cast("float")).cast("float"), F.lit(1.0).cast("float"))
    side = lambda v: F.greatest(F.ceil((v.cast("float") * scale).cast("float") / DETECTOR_STEP) * DETECTOR_STEP, F.lit(DETECTOR_STEP)).cast("long")
    return side(width), side(height)


def padded_crop(box: Column, width: Column, height: Column) -> Column:
    """A detected box (x0, y0, x1, y1 in the detector's picture) as a crop of the image, with room around it.

    The crop's far sides are outside of it. Null where the crop is too small to read.
    """
    seen_w, seen_h = detector_size(width, height)

    def side(low: str, high: str, share: float, least: int, seen: Column, whole: Column) -> tuple[Column, Column]:
        pad = F.greatest(F.floor((box[high] - box[low] + 1).cast("float") * F.lit(share).cast("float")), F.lit(least))
        a, b = F.greatest(box[low] - pad, F.lit(0)), F.least(box[high] + pad, seen - 1)
        at = lambda v: F.floor(((v.cast("float") * whole.cast("float")).cast("float") / seen.cast("float")).cast("float")).cast("long")
        return F.least(at(a), whole - 1), F.least(at(b + 1), whole)

    x0, x1 = side("x0", "x1", PAD_X, LEAST_PAD_X, seen_w, width)
    y0, y1 = side("y0", "y1", PAD_Y, LEAST_PAD_Y, seen_h, height)
    crop = F.struct(x0.cast("long").alias("x0"), y0.cast("long").alias("y0"), x1.cast("long").alias("x1"), y1.cast("long").alias("y1"))
    return F.when((x1 - x0 >= LEAST_CROP) & (y1 - y0 >= LEAST_CROP), crop)


def line_crops(images: DataFrame) -> DataFrame:
    """(id, line_no, crop) of images (id, width, height, boxes): the first lines' crops in reading order.

    Lines are kept until ``MOST_LINES`` have a crop large enough; ``line_no`` is the place among all boxes.
    """
    numbered = F.transform("boxes", lambda b, i: F.struct(i.cast("long").alias("line_no"), padded_crop(b, F.col("width"), F.col("height")).alias("crop")))
    return images.select("id", F.inline(F.slice(F.filter(numbered, lambda x: x["crop"].isNotNull()), 1, MOST_LINES)))


Box = tuple[int, int, int, int]


def boxes_of_map(prob: np.ndarray, least: float = 0.35, min_area: int = 16) -> list[Box]:
    """Bounding boxes of 4-connected regions of a probability map with at least ``min_area`` cells and 5 cells a side.

    Rows are cut into runs; runs that touch the row above are joined in a union-find over runs.
    """
    runs: list[tuple[int, int, int]] = []
    parent: list[int] = []

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    above: list[int] = []
    for y, row in enumerate(prob >= least):
        edges = np.flatnonzero(np.diff(np.concatenate(([0], row.astype(np.int8), [0]))))
        here = []
        for x0, x1 in zip(edges[::2].tolist(), edges[1::2].tolist()):
            k = len(runs)
            runs.append((y, x0, x1))
            parent.append(k)
            here.append(k)
            for a in above:
                if runs[a][1] < x1 and x0 < runs[a][2]:
                    ra, rk = find(a), find(k)
                    parent[max(ra, rk)] = min(ra, rk)
        above = here
    groups: dict[int, list[int]] = {}
    for k in range(len(runs)):
        groups.setdefault(find(k), []).append(k)
    out = []
    for ks in groups.values():
        ys, x0 = [runs[k][0] for k in ks], min(runs[k][1] for k in ks)
        x1 = max(runs[k][2] for k in ks) - 1
        area = sum(runs[k][2] - runs[k][1] for k in ks)
        if area >= min_area and x1 - x0 >= 4 and max(ys) - min(ys) >= 4:
            out.append((x0, min(ys), x1, max(ys)))
    return out


def _same_line(a: Box, b: Box) -> bool:
    ha, hb = a[3] - a[1] + 1, b[3] - b[1] + 1
    shared = max(0, min(a[3], b[3]) - max(a[1], b[1]) + 1)
    gap = max(b[0] - a[2], a[0] - b[2], 0)
    return shared >= 0.35 * min(ha, hb) and gap <= max(3 * max(ha, hb), 20)


def _joined_once(boxes: list[Box]) -> list[Box]:
    """One pass: each box in order takes in the boxes after it that are of its line, growing as it goes."""
    out, taken = [], [False] * len(boxes)
    for i, box in enumerate(boxes):
        if taken[i]:
            continue
        for j in range(i + 1, len(boxes)):
            if not taken[j] and _same_line(box, boxes[j]):
                other = boxes[j]
                box = (min(box[0], other[0]), min(box[1], other[1]), max(box[2], other[2]), max(box[3], other[3]))
                taken[j] = True
        out.append(box)
    return out


def merge_boxes(boxes: list[Box]) -> list[Box]:
    """Boxes of one text line joined, pass by pass until none joins, in reading order (by lines, then from the left).

    A pass goes forward from each box, so what a grown box overlaps depends on the order, and the next pass sees it.
    """
    done = list(boxes)
    if len(done) <= 1:
        return done
    while len(joined := _joined_once(done)) < len(done):
        done = joined
    from functools import cmp_to_key

    def order(a: Box, b: Box) -> int:
        near = max(min(a[3] - a[1] + 1, b[3] - b[1] + 1) // 2, 6)
        same = abs((a[1] + a[3]) // 2 - (b[1] + b[3]) // 2) < near
        return (a[0] > b[0]) - (a[0] < b[0]) if same else (a[1] > b[1]) - (a[1] < b[1])

    return sorted(done, key=cmp_to_key(order))


BOX_SCHEMA = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("x0", "y0", "x1", "y1")]))


@F.pandas_udf(BOX_SCHEMA)
def detected_boxes(prob: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
    """Line boxes of flat probability maps; a map that is too short for its size has none."""

    def one(p, w, h):
        if p is None or len(p) < w * h:
            return []
        found = merge_boxes(boxes_of_map(np.asarray(p[: w * h], np.float32).reshape(h, w)))
        return [dict(zip(("x0", "y0", "x1", "y1"), b)) for b in found]

    return pd.Series([one(p, int(w), int(h)) for p, w, h in zip(prob, width, height)])


# -------------------------------------------------------------------------------------------------- decoding


def ctc_text(logits: np.ndarray, keys: list[str]) -> str:
    """Greedy CTC: best class per step, repeats collapsed, class 0 (blank) dropped. ``logits``: steps x classes."""
    if logits.size == 0 or not keys:
        return ""
    best = logits.argmax(axis=1)
    changed = np.concatenate(([best[0] != 0], (best[1:] != best[:-1]) & (best[1:] != 0)))
    return "".join(keys[c] for c in best[changed].tolist() if c < len(keys))


def ctc_decoded(keys: list[str], classes: int):
    """Pandas UDF from flat logits to text; a last step that is cut off is dropped."""

    @F.pandas_udf(T.StringType())
    def run(flat: pd.Series) -> pd.Series:
        return flat.map(lambda v: None if v is None else ctc_text(np.asarray(v[: len(v) // classes * classes], np.float32).reshape(-1, classes), keys))

    return run


def greedy_decode(step: Callable[[list[int]], np.ndarray], vocabulary: str, most: int = 128, start: int = 1, end: int = 2, first: int = 4) -> str:
    """Autoregressive greedy decoding: ``step`` gives the scores of the next token from the tokens so far."""
    tokens = [start]
    while len(tokens) <= most:
        nxt = int(np.argmax(step(tokens)))
        if nxt == end:
            break
        tokens.append(nxt)
    return "".join(vocabulary[t - first] for t in tokens[1:] if first <= t < first + len(vocabulary))


# --------------------------------------------------------------------------------------------------- engines


@dataclass(frozen=True)
class Recognised:
    text: str
    engine: str
    version: str
    language: str | None = None
    confidence: float | None = None


#: A recogniser takes a path (and bytes, if it wants them) and gives ``Recognised`` or raises.
Engine = Callable[[str], Recognised]

# Wire names of the modes, and names of the pipelines
AUTO, NATIVE, HYBRID = "auto", "windows_native", "hybrid_vietnamese"
MODES = (AUTO, NATIVE, HYBRID)
NATIVE_PIPELINE, HYBRID_PIPELINE = "windows_media_ocr:10.0", "hybrid_windows_vietocr:hybrid_v2"


@dataclass(frozen=True)
class EngineState:
    """What is known of the engines when a route is chosen."""

    native_ready: bool = True
    native_has_vietnamese: bool = False
    hybrid_ready: bool = False
    hybrid_approved: bool = True


def parse_mode(text: str) -> str:
    if text not in MODES:
        raise EngineError("INVALID_MODE", text)
    return text


def route(mode: str, s: EngineState) -> list[str]:
    """Engines to try, in order. A forced hybrid engine that is missing is an error; Auto falls back to the native one."""
    if mode == HYBRID:
        if not s.hybrid_ready:
            raise EngineError("OCR_ENGINE_UNAVAILABLE", "the hybrid engine is not installed")
        return [HYBRID]
    if mode == NATIVE or s.native_has_vietnamese or not (s.hybrid_ready and s.hybrid_approved):
        return [NATIVE]
    return [HYBRID, NATIVE]


def target_pipeline(mode: str, s: EngineState) -> str:
    return HYBRID_PIPELINE if route(mode, s)[0] == HYBRID else NATIVE_PIPELINE


def mock_engine(default: str = "mock text", failing: frozenset[str] = frozenset(), empty: frozenset[str] = frozenset()) -> Engine:
    """A recogniser for tests: fixed text, paths that fail, paths without text."""

    def run(path: str) -> Recognised:
        if path in failing:
            raise EngineError("OCR_FAILED", path)
        return Recognised("" if path in empty else default, "mock", "1.0", "en", 1.0)

    return run


RESULT_SCHEMA = "id long, path string, ocr_text string, ocr_engine string, ocr_engine_version string, ocr_language string, confidence double, error_code string"


def recognise(pending: DataFrame, engines: dict[str, Engine], order: list[str]) -> DataFrame:
    """Results of running the engines over pending items (id, path), one row each; an error is a row with its code.

    The next engine of ``order`` is tried when one fails. Work is spread by partitions of ``pending``.
    """
    tried = [engines[name] for name in order]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, path in zip(pdf["id"], pdf["path"]):
                code = "OCR_ENGINE_UNAVAILABLE"
                for engine in tried:
                    try:
                        r = engine(path)
                    except EngineError as e:
                        code = e.code
                        continue
                    except OSError:
                        code = "FileNotFound"
                        continue
                    rows.append((i, path, r.text, r.engine, r.version, r.language, r.confidence, None))
                    break
                else:
                    rows.append((i, path, None, None, None, None, None, code))
            yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in RESULT_SCHEMA.split(", ")])

    return pending.select("id", "path").mapInPandas(run, RESULT_SCHEMA)


def batch_summary(results: DataFrame) -> DataFrame:
    """One row: processed, succeeded, failed, empty."""
    ok = F.col("error_code").isNull()
    return results.agg(F.count("*").alias("processed"), F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"), F.count_if(ok & (F.coalesce("ocr_text", F.lit("")) == "")).alias("empty"))
