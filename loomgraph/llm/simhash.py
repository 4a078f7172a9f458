"""SimHash fingerprints and an exact Hamming join by vantage-point trees.

Fingerprints: 64 bits over word shingles. Join: two fingerprints at ``max_bits`` differing bits
or fewer agree, on one of ``halves`` equal slices of their bits, up to ``max_bits // halves``
bits (pigeonhole). Each slice has its own vantage-point tree. A node splits its points by
their Hamming distance to a vantage point at a radius ``mu``: those at ``d <= mu`` go inside,
those at ``d > mu - r`` outside. By the triangle inequality two points within ``r`` of each other
are then together on one side at least, so that a shard (a leaf of the tree's upper part)
together with the points that overlap its boundary holds every pair exactly.

The upper part is fitted on a bounded sample; it decides only which shard a fingerprint goes
to, never whether a link is found. Shards give back a spanning forest of their links, not pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.components import connected_components
from loomgraph.sources.shared import cut, drop, ship

BITS = 64
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: value of a byte -> its 8 bits, most significant first
BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(7, -1, -1)) & 1).astype(np.int64)


def shingle_hashes(text: str | None, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every shingle of ``words`` words of the text, repeats included."""
    parts = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not parts:
        return np.empty(0, np.uint64)
    joined = b" ".join(parts)
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(parts) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)
    return np.fromiter((digest(joined[a:b], seed) for a, b in spans), np.uint64, len(parts) - words + 1)


def fingerprint(text: str | None, words: int = 3) -> int:
    """Bit i is 1 when over half the shingle hashes have it; no words: 0."""
    return majority(shingle_hashes(text, words))


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of shingle hashes."""
    if not len(hashes):
        return 0
    rows = hashes.byteswap().view(np.uint8).reshape(-1, 8)
    if len(hashes) < 512:
        ones = np.unpackbits(rows, axis=1).sum(axis=0, dtype=np.int64)
    else:
        ones = np.concatenate([np.bincount(rows[:, k], minlength=256) @ BYTE_BITS for k in range(8)])
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """``id_col, fp``: one row for each input row; fp is the fingerprint as a signed long.

    A null, empty or blank text has fingerprint 0. Ids may be null or repeat; they are passed on.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), words) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], [id_col, "fp"])

    picked = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    return picked.mapInArrow(run, f"`{id_col}` {picked.schema[0].dataType.simpleString()}, fp bigint")


def _slice(fps: np.ndarray, part: int, parts: int) -> np.ndarray:
    width = BITS // parts
    return (fps >> np.uint64(width * part)) & np.uint64((1 << width) - 1 if width < 64 else 0xFFFFFFFFFFFFFFFF)


def _choose(keys: np.ndarray, r: int, tries: int = 5) -> tuple[np.uint64, int] | None:
    """A vantage point and radius that split the points best; None when none makes both sides smaller."""
    best, found = len(keys), None
    for vp in keys[np.linspace(0, len(keys) - 1, min(tries, len(keys))).astype(int)]:
        d = np.bitwise_count(keys ^ vp).astype(np.int64)
        counts = np.bincount(d, minlength=BITS + 1).cumsum()
        for mu in range(int(d.min()), int(d.max())):
            outside = len(keys) - (counts[mu - r] if mu >= r else 0)
            if max(counts[mu], outside) < best:
                best, found = max(counts[mu], outside), (vp, mu)
    return found if best < 0.9 * len(keys) else None


def build_tree(sample: np.ndarray, r: int, leaf: int) -> list:
    """Upper part of a vantage-point tree as nested ``[vp, mu, inside, outside]``; leaves are ``None``."""
    if len(sample) <= leaf or (split := _choose(sample, r)) is None:
        return None
    d = np.bitwise_count(sample ^ split[0]).astype(np.int64)
    return [*split, build_tree(sample[d <= split[1]], r, leaf), build_tree(sample[d > split[1] - r], r, leaf)]


def route(tree: list | None, keys: np.ndarray, r: int) -> Iterator[tuple[int, np.ndarray]]:
    """(leaf number, indices of the points that belong to the leaf or overlap its boundary)."""
    leaf = 0
    todo = [(tree, np.arange(len(keys)))]
    while todo:
        node, at = todo.pop()
        if node is None:
            if len(at):
                yield leaf, at
            leaf += 1
            continue
        d = np.bitwise_count(keys[at] ^ node[0]).astype(np.int64)
        todo += [(node[3], at[d > node[1] - r]), (node[2], at[d <= node[1]])]


class Forest:
    """Union-find over row numbers that keeps the smallest number of a set as its root."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return int(x)

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def link_shard(fps: np.ndarray, keys: np.ndarray, r: int, max_bits: int, leaf: int = 256) -> Forest:
    """All links among the points of a shard, as a forest; local vantage-point recursion, then whole distances.

    A set that no vantage point splits is compared row by row against the whole set, in memory
    proportional to the set, so dense groups never make a matrix or a list of pairs.
    """
    forest, todo = Forest(len(fps)), [np.arange(len(fps))]
    while todo:
        at = todo.pop()
        if len(at) > leaf and (split := _choose(keys[at], r)) is not None:
            d = np.bitwise_count(keys[at] ^ split[0]).astype(np.int64)
            todo += [at[d <= split[1]], at[d > split[1] - r]]
            continue
        own = fps[at]
        if len(at) <= leaf:
            near = np.bitwise_count(own[:, None] ^ own[None, :]) <= max_bits
            a, b = np.nonzero(np.triu(near, 1))
            for x, y in zip(at[a].tolist(), at[b].tolist(), strict=True):
                forest.join(x, y)
            continue
        label = np.array([forest.root(x) for x in at.tolist()])
        for k in range(len(at)):
            met = np.unique(label[np.bitwise_count(own ^ own[k]) <= max_bits])
            if len(met) > 1:
                label[np.isin(label, met)] = met[0]
        for x, y in zip(at.tolist(), label.tolist(), strict=True):
            forest.join(x, y)
    return forest


def hamming_components(points: DataFrame, max_bits: int = 3, halves: int = 2, sample: int = 200_000, shard: int = 20_000) -> DataFrame:
    """``fp, component``: for distinct fingerprints ``fp, rep``, the smallest ``rep`` reachable by links.

    points: distinct non-null ``fp`` (long) with a ``rep`` (long) each; equal reps are one node. sample: at most about
    so many fingerprints, and a quarter of all, fit the upper trees; shard: points a leaf is meant to hold. A leaf has 32 points of the sample at
    least, so from 32 / sample of the points on it is that share of all: 1.6 million of 10**10, still a few hundred MB in a task, which
    splits them by trees of its own.
    """
    spark = points.sparkSession
    ship(spark)
    n = points.count()
    r = max_bits // halves
    trees: list = [None] * halves
    if n > shard:
        size = min(sample, n // 4)
        drawn = points.where(F.pmod(F.xxhash64(F.lit(7), "fp"), F.lit(n)) < size).select("fp").collect()
        known = np.sort(np.array([x.fp for x in drawn], np.int64)).view(np.uint64)
        leaf = max(32, int(len(known) * shard / n))
        trees = [build_tree(np.unique(_slice(known, k, halves)), r, leaf) for k in range(halves)]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            for k, tree in enumerate(trees):
                for number, at in route(tree, _slice(fps.view(np.uint64), k, halves), r):
                    take = pa.array(at)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), number * halves + k)), batch.column(0).take(take), batch.column(1).take(take)], ["shard", "fp", "rep"])

    def solve(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("rep")
        fps = table.column("fp").to_numpy().view(np.uint64)
        forest = link_shard(fps, _slice(fps, key[0].as_py() % halves, halves), r, max_bits)
        reps = table.column("rep").to_numpy()
        roots = np.array([forest.root(x) for x in range(len(reps))], np.int64)
        own = roots != np.arange(len(reps))
        return pa.table({"src": reps[own], "dst": reps[roots[own]]})

    dealt = points.select("fp", "rep").mapInArrow(deal, "shard bigint, fp bigint, rep bigint")
    edges = cut(dealt.groupBy("shard").applyInArrow(solve, "src bigint, dst bigint"), "simhash-links")
    found = connected_components(edges)
    whole = points.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("component"))
    out = cut(whole, "simhash-components")
    drop(edges)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, max_bits: int = 3) -> DataFrame:
    """Every row with its fingerprint and the smallest id reachable by links of at most ``max_bits`` bits.

    Returns ``id_col, fingerprint`` (16 lower-case hex digits), ``component_id``. Copies share a
    fingerprint and are joined through it, never expanded into pairs. Rows without an id keep a null id and
    take the component of their fingerprint; a fingerprint that only such rows have gets a null component.
    Repeated rows stay repeated; an empty table gives an empty result; other columns are ignored.
    """
    fps = cut(fingerprints(docs, id_col, text_col, words), "fingerprints")
    points = cut(fps.where(F.col(id_col).isNotNull()).groupBy("fp").agg(F.min(F.col(id_col).cast("long")).alias("rep")), "points")
    labels = hamming_components(points, max_bits)
    return fps.join(labels, "fp", "left").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
