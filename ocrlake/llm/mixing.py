"""Mixing sources to target shares of tokens, by pivotal dependent rounding.

Each source's amount is fixed first: its target share (of the sources that have text), as large a total as every source
can supply with its cap on repeats, or a total that is asked for. A document of a source at rate r is taken floor(r)
times and once more with probability r - floor(r). These fractions are rounded in pairs: tokens move at random from one
document to the other until one of the two is whole, so the source's tokens stay the same at every step. Pairs meet
inside groups of bounded size; the one fraction each group leaves goes up a reduction tree to the next level.

The last fraction of a tree is one document, whose rounding moves the source's amount by up to its length. So a source's
documents are rounded in layers of like length, the longest first: the last document of a layer is rounded at random, by
its own fraction, and what that gained or lost is spread evenly over the rates of the layers after it. Gains and losses
are zero on average, so every document keeps its probability, and only the last document of the shortest layer is
rounded to the nearer side. (Where the shorter documents could not make up for a gain or loss, as with a document longer
than all its source may give, the last document of a layer goes the way they can make up for.)
"""

from __future__ import annotations

import base64
from collections.abc import Generator, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ocrlake.session import cut


@dataclass(frozen=True)
class MixParams:
    total_tokens: int | None = None
    vocabulary: str | None = None  # file of ranks; None: byte_bpe_50k of the installed public tokenizers
    group_rows: int = 4_000
    fan_in: int = 256
    layer: int = 16  # lengths within a layer differ by this factor at most
    seed: int = 17


def source_name(c: Column) -> Column:
    """One spelling of a source: lower case, outer blanks off, blanks and underscores as hyphens; '' gives null."""
    plain = F.regexp_replace(F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", "")), r"(?U)[\s_\-]+", "-")
    return F.when(plain != "", plain)


def _encoding(path: str | None):
    import tiktoken

    if path is None:
        import public_tokenizers

        path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    else:
        from public_tokenizers import PATTERN as pattern
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("mix", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_sizes(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, source, n_tokens) of documents with text and source; repeated rows merged."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _encoding(vocabulary)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "source": pdf["source"], "n_tokens": [len(enc.encode_ordinary(t)) for t in pdf["text"]]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), source_name(F.col("source")).alias("source"), "text")
    rows = rows.filter("doc_id is not null and source is not null and text is not null")
    return rows.mapInPandas(run, "doc_id long, source string, n_tokens long").filter("n_tokens > 0").groupBy("doc_id").agg(F.min(F.struct("source", "n_tokens")).alias("s")).select("doc_id", "s.source", "s.n_tokens")


def source_amounts(supply: dict[str, int], share: dict[str, float], repeats: dict[str, int], total: int | None) -> dict[str, float]:
    """Tokens to draw from each source.

    Sources without tokens or repeats get nothing and the others' shares are scaled to 1. Without a total, the largest
    one at which every source reaches its share. With a total beyond that, sources that run out give all they have and
    the rest is shared out among the others in proportion.
    """
    live = {s: w for s, w in share.items() if w > 0 and supply.get(s, 0) > 0 and repeats.get(s, 0) > 0}
    weight = sum(live.values())
    if not live:
        return {}
    most = {s: supply[s] * repeats[s] for s in live}
    if total is None:
        total = min(most[s] * weight / w for s, w in live.items())
    amounts: dict[str, float] = {}
    left, rest = float(min(total, sum(most.values()))), dict(live)
    while rest:
        weight = sum(rest.values())
        full = [s for s, w in rest.items() if left * w / weight >= most[s] - 1e-9]
        if not full:
            amounts |= {s: left * w / weight for s, w in rest.items()}
            break
        for s in full:
            amounts[s] = float(most[s])
            left -= most[s]
            del rest[s]
        left = max(left, 0.0)
    return amounts


_GROUP_SCHEMA = "doc_id long, source string, n_tokens long, copies long, part double, slot long"
_EPS = 1e-9


def round_pairs(tokens: np.ndarray, part: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Fractions after pivotal rounding: all 0 or 1 but for one at most; the sum of tokens * fraction is kept."""
    x = part.copy()
    open_at = -1
    for i in np.flatnonzero((x > _EPS) & (x < 1 - _EPS)).tolist():
        if open_at < 0:
            open_at = i
            continue
        a, b = open_at, i
        ta, tb = float(tokens[a]), float(tokens[b])
        up = min((1 - x[a]) * ta, x[b] * tb)  # tokens that can go from b to a
        down = min(x[a] * ta, (1 - x[b]) * tb)
        if rng.random() < down / (up + down):
            x[a] += up / ta
            x[b] -= up / tb
        else:
            x[a] -= down / ta
            x[b] += down / tb
        loose = [k for k in (a, b) if _EPS < x[k] < 1 - _EPS]
        open_at = loose[0] if loose else -1
    return x


def _round_group(seed: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id", ignore_index=True)
        rng = np.random.default_rng([seed, int(key[1]), len(pdf), int(pdf["doc_id"].iloc[0]) & 0x7FFFFFFF])
        order = rng.permutation(len(pdf))
        x = np.empty(len(pdf))
        x[order] = round_pairs(pdf["n_tokens"].to_numpy()[order], pdf["part"].to_numpy()[order], rng)
        whole = x > 1 - _EPS
        pdf["copies"] = pdf["copies"] + whole
        pdf["part"] = np.where((x > _EPS) & ~whole, x, 0.0)
        return pdf[["doc_id", "source", "n_tokens", "copies", "part", "slot"]]

    return run


def round_tree(rows: DataFrame, groups: int, slack: DataFrame, p: MixParams) -> DataFrame:
    """``rows`` (doc_id, source, n_tokens, copies, part, slot) with whole ``copies``, the last fraction of each source too.

    ``slot`` numbers a source's groups, ``groups`` at most. The last fraction is rounded up with its own probability,
    unless the tokens gained or lost exceed the ``slack`` (source, up, down); with neither way open it goes to the nearer.
    """
    level = cut(rows.groupBy("source", "slot").applyInPandas(_round_group(p.seed), _GROUP_SCHEMA))
    settled = [level.filter("part = 0")]
    while groups > 1:
        groups = -(-groups // p.fan_in)
        loose = level.filter("part > 0").withColumn("slot", F.floor(F.col("slot") / p.fan_in).cast("long"))
        level = cut(loose.groupBy("source", "slot").applyInPandas(_round_group(p.seed), _GROUP_SCHEMA))
        settled.append(level.filter("part = 0"))
    chance = F.pmod(F.xxhash64("doc_id", F.lit(p.seed + 1)), F.lit(1 << 53)) / float(1 << 53)
    last = level.filter("part > 0").join(F.broadcast(slack), "source")  # one row per target source
    up, down = F.col("n_tokens") * (1 - F.col("part")) <= F.col("up"), F.col("n_tokens") * F.col("part") <= F.col("down")
    goes = F.when(up & down, chance < F.col("part")).when(up, True).when(down, False).otherwise(F.col("part") >= 0.5)
    out = last.withColumn("copies", F.col("copies") + goes.cast("long")).drop("up", "down")
    for part in settled:
        out = out.unionByName(part)
    return out.select("doc_id", "source", "n_tokens", "copies")


def layer_rates(amount: float, layers: list[int], cap: int) -> Generator[tuple[float, float, float], int, None]:
    """Rate of each of a source's layers (tokens of each, the longest documents first), and how many tokens more and less
    than that the shorter layers can make up for; told what each layer drew by ``send``.

    What a layer drew too much or too little is spread over the layers after it, within rates of 0 and ``cap``.
    """
    left, rest = float(amount), sum(layers)
    for tokens in layers:
        rate = min(max(left / rest, 0.0), float(cap)) if rest else 0.0
        rest -= tokens
        drawn = yield rate, left - rate * tokens, rate * tokens - (left - rest * cap)
        left -= drawn


def draw(docs: DataFrame, targets: DataFrame, p: MixParams = MixParams()) -> DataFrame:
    """(doc_id, source, n_tokens, copies) of the documents drawn, each with the number of times it is taken.

    Documents with null id, text or source, without tokens, or of a source without target are never drawn. Targets that
    name one source twice are added up, the greater repeat cap counts; a null cap is 1. The result depends on the seed
    only. The driver sees one row per source and layer: sources with a target, times the logarithm of the longest text.
    """
    spark = docs.sparkSession
    layer = F.floor(F.log(float(p.layer), F.col("n_tokens") + F.lit(0.5))).cast("int")
    sized = cut(token_sizes(docs, p.vocabulary).withColumn("layer", layer))
    wanted = targets.select(source_name(F.col("source")).alias("source"), "target_share", F.coalesce("max_repeats", F.lit(1)).alias("max_repeats"))
    wanted = wanted.filter("source is not null").groupBy("source").agg(F.sum("target_share").alias("w"), F.max("max_repeats").alias("r"))
    plan: dict[str, Row] = {}
    layers: dict[str, dict[int, Row]] = {}
    for r in sized.groupBy("source", "layer").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n")).join(wanted, "source").collect():
        plan[r["source"]] = r
        layers.setdefault(r["source"], {})[r["layer"]] = r
    supply = {s: sum(r["t"] for r in rows.values()) for s, rows in layers.items()}
    amounts = source_amounts(supply, {s: r["w"] or 0.0 for s, r in plan.items()}, {s: r["r"] for s, r in plan.items()}, p.total_tokens)
    if not amounts:
        return spark.createDataFrame([], "doc_id long, source string, n_tokens long, copies long")
    order = sorted({k for s in amounts for k in layers[s]}, reverse=True)
    guides = {s: layer_rates(amounts[s], [layers[s][k]["t"] for k in order if k in layers[s]], plan[s]["r"]) for s in amounts}
    rate = {s: next(g) for s, g in guides.items()}
    parts = []
    for k in order:
        here = [(s, rate[s][0], -(-layers[s][k]["n"] // p.group_rows)) for s in amounts if k in layers[s]]
        rates = F.broadcast(spark.createDataFrame(here, "source string, rate double, groups long"))  # one row per target source
        slack = spark.createDataFrame([(s, *rate[s][1:]) for s, *_ in here], "source string, up double, down double")
        rows = sized.filter(F.col("layer") == k).join(rates, "source").withColumn("copies", F.floor(F.col("rate") + _EPS).cast("long"))
        rows = rows.withColumn("part", F.greatest(F.col("rate") - F.col("copies"), F.lit(0.0))).withColumn("slot", F.pmod(F.xxhash64("doc_id", F.lit(p.seed)), F.col("groups")))
        parts.append(cut(round_tree(rows, max(g for *_, g in here), slack, p)))
        if k != order[-1]:
            drawn = {r["source"]: r["t"] for r in parts[-1].groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("t")).collect()}
            for s, *_ in here:
                try:
                    rate[s] = guides[s].send(drawn.get(s, 0))
                except StopIteration:  # the source has no shorter documents
                    pass
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.filter("copies > 0").select("doc_id", "source", "n_tokens", "copies")


def reached_shares(drawn: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, reached_share, n_tokens, n_docs, most_copies) of every source with a target."""
    got = drawn.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("n_tokens"), F.count("*").alias("n_docs"), F.max("copies").alias("most_copies"))
    wanted = targets.select(source_name(F.col("source")).alias("source"), "target_share").filter("source is not null").groupBy("source").agg(F.sum("target_share").alias("target_share"))
    # one row per target source: small enough for one window
    both = wanted.join(got, "source", "left").withColumn("total", F.sum("n_tokens").over(Window.partitionBy(F.lit(0))))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    share = F.coalesce(F.col("n_tokens") / F.col("total"), F.lit(0.0)).alias("reached_share")
    return both.select("source", "target_share", share, zero("n_tokens"), zero("n_docs"), zero("most_copies"))

