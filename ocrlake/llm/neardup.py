"""Near-duplicate texts: banded MinHash candidates, sequential Bayesian pruning, exact verification.

1. Texts are brought to words parted by one blank; equal ones are one class, whatever their number. One Python pass over
   the texts gives digest, bands and signature; all later steps but the shingle sets stay in the JVM.
2. Each class has ``bands`` band values of ``rows`` MinHash values over its runs of ``shingle`` words. Band values that
   only one class has are dropped by an aggregate. Classes that share a band value are candidates.
3. Candidates carry a compact signature: ``sig`` values of 8 bits from hash functions of their own, packed into longs. It
   is compared in batches by the bits that differ (none where two values agree, binomially many where they don't); a pair
   is dropped as soon as the posterior probability that its similarity reaches the threshold is below ``miss``.
4. The survivors' similarity is computed on their sets of runs (64-bit hashes, so that unequal runs count as equal with a
   probability of 2**-64 each); each text's set is made once, however many pairs it is in.

``near_links`` gives all links between classes. A band value that n classes share is split into blocks of at most
``block`` classes, and each pair of blocks is a join key of its own, so one hot value is spread over the cluster.
``near_groups`` gives groups without listing the links inside them: every class is compared with the first class of each
of its band values only (a star, linear in the number of classes), stars that are linked make components, and only pairs
that share a band value across components are compared after that. Its groups are those of ``near_links``.

Misses: a pair of similarity s is no candidate with probability (1 - s**rows)**bands (0.0005 at s = 0.7, 0.0000004 at
0.8 for 28 bands of 4), and pruned wrongly with probability ``miss`` at most per batch at the threshold itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ocrlake.llm.blocks import block_pairs
from ocrlake.session import cut, release


@dataclass(frozen=True)
class NearDupParams:
    threshold: float = 0.8
    shingle: int = 5
    bands: int = 28
    rows: int = 4
    sig: int = 64  # a multiple of 8, as eight values are one long
    batch: int = 16
    miss: float = 0.0005
    block: int = 2_000  # classes of one band value, or copies of one text, that are paired in one piece
    seed: int = 20240229

    @property
    def signature(self) -> list[str]:
        """Names of the columns that hold the signature."""
        return [f"s{i}" for i in range(self.sig // 8)]


#: Parameters of the test tables' own definition: runs of three words, similarity 0.7.
SCREENSHOT_PARAMS = NearDupParams(threshold=0.7, shingle=3)


@lru_cache(maxsize=4)
def _hash_family(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    mul = rng.integers(0, 2**32, n, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
    xor = rng.integers(0, 2**32, n, dtype=np.uint64).astype(np.uint32)
    return mul, xor


def _mix(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(32)
    return h


class _WordHashes(dict):
    """64-bit hashes of words, kept for the words of recent batches."""

    def __init__(self, limit: int = 500_000) -> None:
        import xxhash

        super().__init__()
        self.limit, self.digest = limit, xxhash.xxh3_64_intdigest

    def __missing__(self, word: str) -> int:
        h = self[word] = self.digest(word)
        return h

    def of(self, words: list[str]) -> np.ndarray:
        if len(self) > self.limit:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def shingle_batch(split: list[list[str]], k: int, words: _WordHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of all runs of k words of texts in one array, where each text begins in it, and the positions of the
    texts that have a run."""
    keep = np.array([i for i, w in enumerate(split) if len(w) >= k], dtype=np.int64)
    if not len(keep):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), keep
    flat = words.of([w for i in keep for w in split[i]])
    lengths = np.array([len(split[i]) for i in keep])
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    h = np.zeros(len(flat) - k + 1, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            h = h * np.uint64(0x9E3779B97F4A7C15) + flat[j : len(flat) - k + 1 + j]
        h = _mix(h)
    # positions whose run crosses into the next text are taken out
    inside = np.ones(len(flat), bool)
    for j in range(1, k):
        inside[starts + lengths - j] = False
    return h[inside[: len(h)]], np.concatenate(([0], np.cumsum(lengths - k + 1)[:-1])), keep


def minhash_values(h: np.ndarray, first: np.ndarray, n: int, seed: int) -> np.ndarray:
    """MinHash values (texts x n functions) of texts' shingle hashes."""
    mul, xor = _hash_family(n, seed)
    x = (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    out = np.empty((len(first), n), np.uint32)
    for i in range(n):
        v = x ^ xor[i]
        v *= mul[i]
        v ^= v >> np.uint32(15)
        out[:, i] = np.minimum.reduceat(v, first)
    return out


def _band_values(m: np.ndarray, p: NearDupParams) -> np.ndarray:
    """For each text and band 32 bits of the hash of the band's values; the band's number is the position."""
    v = m.reshape(len(m), p.bands, p.rows).astype(np.uint64)
    with np.errstate(over="ignore"):
        h = np.zeros(v.shape[:2], np.uint64)
        for r in range(p.rows):
            h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + v[:, :, r] + np.uint64(1))
    return (h >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _chunks(batches: Iterator[pd.DataFrame], rows: int = 2000) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for at in range(0, len(pdf), rows):
            yield pdf.iloc[at : at + rows]


def _digest(words: list[str]) -> bytes:
    return hashlib.md5(" ".join(words).encode("utf-8", "surrogatepass"), usedforsecurity=False).digest()


def prints(texts: DataFrame, p: NearDupParams) -> DataFrame:
    """(id, key, n_words, bands, s0, s1, …) of ``texts`` (id, text) that have words.

    ``key`` is the digest of the words; ``bands`` is null (and the signature 0) for texts of fewer words than a run.
    """
    names = p.signature

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = _WordHashes()
        for pdf in _chunks(batches):
            split = [t.lower().split() for t in pdf["text"]]
            h, first, keep = shingle_batch(split, p.shingle, words)
            bands: list = [None] * len(split)
            sig = np.zeros((len(split), len(names)), np.int64)
            if len(keep):
                low = (minhash_values(h, first, p.sig, p.seed + 1) & np.uint32(0xFF)).astype(np.uint8)
                sig[keep] = low.view(np.int64)
                for i, b in zip(keep.tolist(), _band_values(minhash_values(h, first, p.bands * p.rows, p.seed), p)):
                    bands[i] = b
            out = pd.DataFrame({"id": pdf["id"].to_numpy(), "key": [_digest(w) for w in split], "n_words": [len(w) for w in split], "bands": bands, **{c: sig[:, i] for i, c in enumerate(names)}})
            yield out[[bool(w) for w in split]]

    return texts.select("id", "text").mapInPandas(run, "id long, key binary, n_words long, bands array<int>, " + ", ".join(f"{c} long" for c in names))


def run_sets(texts: DataFrame, k: int) -> DataFrame:
    """(node, runs) of ``texts`` (text, key, node): the distinct hashes of its runs of k words.

    A text whose digest is not ``key`` is another text of the same id and left out.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = _WordHashes()
        for pdf in _chunks(batches):
            split = [t.lower().split() for t in pdf["text"]]
            own = np.array([_digest(w) == bytes(key) for w, key in zip(split, pdf["key"])], bool)
            split = [w for w, ok in zip(split, own) if ok]
            h, first, keep = shingle_batch(split, k, words)
            parts = np.split(h.view(np.int64), first[1:]) if len(keep) else []
            yield pd.DataFrame({"node": pdf["node"].to_numpy(np.int64)[own][keep], "runs": [np.unique(x) for x in parts]})

    return texts.select("text", "key", "node").mapInPandas(run, "node long, runs array<long>")


@lru_cache(maxsize=16)
def prune_table(threshold: float, sig: int, batch: int, miss: float) -> tuple[tuple[int, int], ...]:
    """(values compared, most differing bits to stay) after each batch.

    Prior: similarity uniform on [0, 1]. Two 8-bit values differ in no bit with probability s + (1 - s) / 256, and in k
    bits with (1 - s) * C(8, k) / 256; the bits of n values are the n-fold convolution of that. A pair stays while
    P(s >= threshold | bits) >= miss.
    """
    s = (np.arange(1000) + 0.5) / 1000
    one = np.outer(1 - s, [comb(8, k) / 256 for k in range(9)])
    one[:, 0] += s
    spectrum = np.fft.rfft(one, 1024, axis=1)
    out = []
    for n in range(batch, sig + 1, batch):
        p = np.clip(np.fft.irfft(spectrum**n, 1024, axis=1)[:, : 8 * n + 1], 1e-300, None)
        stays = p[s >= threshold].sum(axis=0) / p.sum(axis=0) >= miss
        # beyond the expected bits at similarity 0 nothing stays
        stays[4 * n + 1 :] = False
        out.append((n, int(np.flatnonzero(stays).max(initial=-1))))
    return tuple(out)


def may_be_similar(p: NearDupParams, a: str = "_a", b: str = "_b") -> Column:
    """Whether no batch of signature values rules a pair out, from signature columns with these endings; later batches
    are only looked at if the earlier ones pass."""
    differ = [F.bit_count(F.col(c + a).bitwiseXOR(F.col(c + b))) for c in p.signature]
    return reduce(lambda x, y: x & y, (reduce(lambda x, y: x + y, differ[: n // 8]) <= most for n, most in prune_table(p.threshold, p.sig, p.batch, p.miss)))


@dataclass
class Fingerprints:
    """What links and groups are made from.

    ``members``: (id, node, n_words), one row for each id and different text; ``nodes``: (node, key, rep, signature), one
    row for each different text; ``shared``: (band, node, first, n, signature), the band values that several nodes have.
    """

    texts: DataFrame
    members: DataFrame
    nodes: DataFrame
    shared: DataFrame


def fingerprints(docs: DataFrame, id_col: str, text_col: str, p: NearDupParams) -> Fingerprints:
    """Null ids and texts without words are left out; an id with several texts is a member of each text's class."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("id is not null and text is not null")
    found = cut(prints(rows, p))
    nodes = found.select("key", F.col("id").alias("rep"), "bands", *p.signature).dropDuplicates(["key"])
    # numbers are given once: the checkpoint is what all later steps read
    nodes = cut(nodes.withColumn("node", F.monotonically_increasing_id()))
    members = cut(found.select("id", "key", "n_words").distinct().join(nodes.select("key", "node"), "key").select("id", "node", "n_words"))
    release(found)
    bands = nodes.select("node", F.posexplode("bands").alias("no", "value"))
    code = F.shiftleft(F.col("no").cast("long"), 32).bitwiseOR(F.col("value").cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))
    bands = bands.select(code.alias("band"), "node")
    several = bands.groupBy("band").agg(F.min("node").alias("first"), F.count("*").alias("n")).filter("n > 1")
    shared = cut(bands.join(several, "band").join(nodes.select("node", *p.signature), "node").select("band", "node", "first", "n", *p.signature))
    return Fingerprints(rows, members, nodes.select("node", "key", "rep", *p.signature), shared)


def verified(fp: Fingerprints, pairs: DataFrame, p: NearDupParams) -> DataFrame:
    """(a, b, similarity) of the pairs (a, b) of nodes that reach the threshold. Only texts that a pair needs are read again."""
    needed = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = fp.nodes.select("node", "key", "rep").join(needed, "node", "left_semi")
    texts = fp.texts.join(wanted.select(F.col("rep").alias("id"), "key", "node"), "id")
    sets = cut(run_sets(texts, p.shingle))
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("runs").alias("ra")), "a").join(sets.select(F.col("node").alias("b"), F.col("runs").alias("rb")), "b")
    common = F.size(F.array_intersect("ra", "rb"))
    similarity = both.select("a", "b", common.alias("c"), (F.size("ra") + F.size("rb")).alias("s")).select("a", "b", (F.col("c") / (F.col("s") - F.col("c"))).alias("similarity"))
    # a text that was delivered twice has its set twice
    return similarity.filter(F.col("similarity") >= p.threshold - 1e-12).groupBy("a", "b").agg(F.max("similarity").alias("similarity"))


@dataclass
class NearDups:
    """``members``: (id, node, n_words) of every text; ``links``: (a, b, similarity) between nodes, the classes of equal texts."""

    members: DataFrame
    links: DataFrame


def near_links(docs: DataFrame, id_col: str, text_col: str, p: NearDupParams = NearDupParams()) -> NearDups:
    """All links between different texts whose similarity reaches ``p.threshold``, and the classes of equal texts.

    Null ids and texts without words are left out; an id that comes with several texts is in several classes. Texts with
    fewer words than a run have no similarity to others (their equal copies still form a class). An empty table gives
    empty tables. Extra columns are ignored.
    """
    fp = fingerprints(docs, id_col, text_col, p)
    pairs = block_pairs(fp.shared, ["band"], "node", "n", p.signature, p.block, may_be_similar(p))
    pairs = cut(pairs.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct())
    release(fp.shared)
    return NearDups(fp.members, cut(verified(fp, pairs, p)))


def near_groups(docs: DataFrame, id_col: str, text_col: str, p: NearDupParams = NearDupParams(), also: DataFrame | None = None) -> DataFrame:
    """(id, group_id, n_members): the group of every id with a text that has words; the least id names a group.

    Groups are the components of the links of ``near_links``, of equal texts, and of ``also`` (id, tag): ids with the same
    non-null tag. Cost is linear in the size of a group: links inside a group are not listed.
    """
    fp = fingerprints(docs, id_col, text_col, p)
    stars = fp.shared.filter("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"), *(F.col(c).alias(f"{c}_b") for c in p.signature)).distinct()
    stars = stars.join(fp.nodes.select(F.col("node").alias("a"), *(F.col(c).alias(f"{c}_a") for c in p.signature)), "a").filter(may_be_similar(p))
    near = cut(verified(fp, cut(stars.select("a", "b")), p).select("a", "b"))
    parts = cut(connected_groups(fp.nodes.select(F.col("node").alias("id")), near))
    # what is left are band values that several components have
    shared = fp.shared.select("band", "node", *p.signature).join(parts.select(F.col("id").alias("node"), F.col("group_id").alias("part")), "node")
    torn = shared.groupBy("band").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.count("*").alias("n")).filter("lo < hi").select("band", "n")
    apart = (F.col("part_a") != F.col("part_b")) & may_be_similar(p)
    across = block_pairs(shared.join(torn, "band"), ["band"], "node", "n", ["part", *p.signature], p.block, apart)
    across = cut(across.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct())
    more = verified(fp, across, p).select("a", "b")
    release(fp.shared)
    # ids hang on their nodes, and ids of one tag on its first: negative numbers stand for nodes
    ids = fp.members.select("id", (-F.col("node") - 1).alias("node"))
    edges = near.union(more).select((-F.col("a") - 1).alias("a"), (-F.col("b") - 1).alias("b")).union(ids.select(F.col("node").alias("a"), F.col("id").alias("b")))
    every = ids.select("id")
    if also is not None:
        tagged = also.select(F.col("id").cast("long").alias("id"), "tag").filter("id is not null and tag is not null").distinct()
        first = tagged.groupBy("tag").agg(F.min("id").alias("a"), F.count("*").alias("n")).filter("n > 1").select("tag", "a")
        edges = edges.union(tagged.join(first, "tag").select("a", F.col("id").alias("b")))
        every = every.union(tagged.select("id"))
    found = cut(connected_groups(every, edges).select("id", F.col("group_id").alias("part")))
    names = found.groupBy("part").agg(F.min("id").alias("group_id"), F.count("*").alias("n_members"))
    return found.join(names, "part").select("id", "group_id", "n_members")


def _hot(rows: DataFrame, key: str, block: int, name: str) -> DataFrame:
    """(key, name): into how many blocks the rows of a key go, for keys with more than one block (rows / block at most)."""
    return rows.groupBy(key).agg(F.count("*").alias("_k")).filter(F.col("_k") > block).select(key, F.ceil(F.col("_k") / block).cast("int").alias(name))


def linked_ids(found: NearDups, block: int) -> DataFrame:
    """(id_a, id_b), id_a < id_b: the ids of linked classes. The copies of a hot class are taken in blocks."""
    hot = _hot(found.members, "node", block, "c")
    own = lambda c: F.coalesce(c, F.lit(1))
    links = found.links.select("a", "b")
    for side, part in (("a", "i"), ("b", "j")):
        links = links.join(hot.select(F.col("node").alias(side), F.col("c").alias("_c")), side, "left").withColumn(part, F.explode(F.sequence(F.lit(0), own("_c") - 1))).drop("_c")
    placed = found.members.join(hot, "node", "left").select("node", "id", F.pmod(F.xxhash64("id"), own("c")).cast("int").alias("k"))
    across = links.join(placed.select(F.col("node").alias("a"), F.col("k").alias("i"), F.col("id").alias("id1")), ["a", "i"])
    across = across.join(placed.select(F.col("node").alias("b"), F.col("k").alias("j"), F.col("id").alias("id2")), ["b", "j"])
    return across.select(F.least("id1", "id2").alias("id_a"), F.greatest("id1", "id2").alias("id_b")).filter("id_a < id_b")


def same_key_pairs(rows: DataFrame, block: int = NearDupParams.block) -> DataFrame:
    """(id_a, id_b), id_a < id_b, of different ids (id) with the same non-null ``key``."""
    rows = rows.filter("id is not null and key is not null").distinct()
    repeated = rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    pairs = block_pairs(cut(rows.join(repeated, "key")), ["key"], "id", "n", [], block)
    return pairs.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))


def expand_pairs(found: NearDups, p: NearDupParams, also: DataFrame | None = None) -> DataFrame:
    """All pairs of ids (id_a < id_b): links between texts, equal texts that have at least one run of words, and the ids of
    ``also`` (id, tag) with the same non-null tag; a pair may come more than once."""
    copies = found.members.filter(F.col("n_words") >= p.shingle).select("id", F.concat(F.lit("n"), F.col("node").cast("string")).alias("key"))
    if also is not None:
        copies = copies.union(also.select(F.col("id").cast("long").alias("id"), F.concat(F.lit("t"), F.col("tag").cast("string")).alias("key")))
    return linked_ids(found, p.block).union(same_key_pairs(copies, p.block))


def connected_groups(nodes: DataFrame, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, group_id) of every node: the least id that its edges (a, b) lead to.

    Alternating large-star and small-star steps on edge tables; each round is one aggregate and one join, its result is
    cut into the shared checkpoint folder. The number of rounds grows with the logarithm of the longest path. Nodes
    without edges are groups of their own; loops and repeated edges have no effect.
    """
    pairs = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    last = None
    for _ in range(max_rounds):
        # large star: every neighbour above the node goes to the node's least neighbour
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small star: every neighbour below the node, and the node, go to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct()
        last_pairs, pairs = pairs, cut(small)
        release(last_pairs)
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last:
            break
        last = state
    else:
        raise RuntimeError(f"groups did not settle within {max_rounds} rounds")
    roots = pairs.groupBy("u").agg(F.min("v").alias("group_id")).withColumnRenamed("u", "id")
    return nodes.select("id").distinct().join(roots, "id", "left").select("id", F.coalesce("group_id", "id").alias("group_id"))

