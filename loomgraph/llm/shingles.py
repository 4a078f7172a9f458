"""Near copies by exact Jaccard similarity of word shingles: SimHash, prefix filter, verification, components.

First SimHash: documents whose fingerprints over the same shingles are linked by the vantage-point trees of :mod:`simhash` are compared with their
group's smallest set, exactly. A fingerprint of 64 bits tells a similarity of 0.8 from others only at radii where trees
prune nothing, so what it misses is found by a prefix filter:

Two sets at a similarity of ``least`` or more share a shingle among the first n - ceil(least n) + 1 of each, whatever the one
order is in which all sets are sorted. The order puts shingles that are frequent in a bounded sample last; it decides
only how many candidates there are, never whether a pair is found. Equal sets are one node. Each group of sets
that share such a shingle is first compared with its smallest set alone; what that leaves in different components is
then compared pair by pair, so that groups of near copies don't make all their pairs.

Nearly all candidates are false, and a set is larger than its text. So sets are never stored: a sketch of a bit for each shingle rules out pairs first, and only the
texts of what is left are fetched and compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.simhash import hamming_components, majority, shingle_hashes
from loomgraph.operators.components import connected_components
from loomgraph.sources.shared import cut, drop, ship


#: Bits of a sketch of a small set.
SKETCH = 1024


def sketch_size(n: int) -> int:
    """Bits of the sketch of a set of n: a power of two, as many as hashes at least, since a smaller sketch of a large set looks like any other."""
    return max(SKETCH, 1 << (n - 1).bit_length() if n else 0)


def sketch_of(hashes: np.ndarray, bits: int = SKETCH) -> np.ndarray:
    """Parities of the number of a set's hashes in each of so many bins, as longs.

    A hash that only one of two sets has changes one bit, so sketches differ in no more bits than the sets in hashes. Bins go by the last bits of a number, so the
    halves of a sketch together (exclusive or) are that of half its size.
    """
    odd = np.bincount((hashes >> np.uint64(20)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def bits_apart(x: Column, y: Column) -> Column:
    """In how many bits two sketches differ; the larger one is folded to the other's size, or to half of it at most, which is all that sets of alike sizes need."""
    folded = lambda v: F.zip_with(F.slice(v, F.lit(1), (F.size(v) / 2).cast("int")), F.slice(v, (F.size(v) / 2).cast("int") + 1, (F.size(v) / 2).cast("int")), lambda p, q: p.bitwiseXOR(q))
    to = lambda v, w: F.when(F.size(v) > F.size(w), folded(v)).otherwise(v)
    return F.aggregate(F.zip_with(to(x, y), to(y, x), lambda p, q: F.bit_count(F.coalesce(p, F.lit(0)).bitwiseXOR(F.coalesce(q, F.lit(0))))), F.lit(0), lambda s, v: s + v)


def prefix_size(n: int, least: float) -> int:
    """How many shingles of a set of n have to be looked up."""
    return n - math.ceil(least * n - 1e-9) + 1 if n else 0


def shingle_sets(docs: DataFrame, id_col: str, text_col: str, words: int, least: float, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """``id, key, n, fp, prefix, sketch, t1, t2``: a row for each row; ``key`` is the 128-bit identity of the set, ``fp`` the text's fingerprint, ``t1`` and ``t2`` are that of the text.

    frequent: sorted hashes and their counts, which give the order of prefixes. Texts of fewer words are one shingle; texts without words are the empty set.
    """
    known, counts = frequent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                keys, sizes, fps, firsts, sketches = [], [], [], [], []
                for text in part.column(1):
                    h = shingle_hashes(text.as_py(), words)
                    fps.append(majority(h))
                    h = np.unique(h)
                    keys.append(xxhash.xxh3_128_digest(h.astype("<u8").tobytes()))
                    sketches.append(sketch_of(h, sketch_size(len(h))))
                    if len(known) and len(h):
                        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                        h = h[np.argsort(np.where(known[at] == h, counts[at], 0), kind="stable")]
                    sizes.append(len(h))
                    firsts.append(h[: prefix_size(len(h), least)].view(np.int64))
                lists = [pa.ListArray.from_arrays(np.cumsum([0, *map(len, x)]).astype(np.int32), np.concatenate(x)) for x in (firsts, sketches)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.array(np.array(fps, np.uint64).view(np.int64)), *lists, part.column(2), part.column(3)], ["id", "key", "n", "fp", "prefix", "sketch", "t1", "t2"])

    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).select("id", "text", *_text_identity("text"))
    return picked.mapInArrow(run, f"id {picked.schema[0].dataType.simpleString()}, key binary, n int, fp bigint, prefix array<bigint>, sketch array<bigint>, t1 bigint, t2 bigint")


def _text_identity(text: str) -> list[Column]:
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")]


def frequent_shingles(docs: DataFrame, text_col: str, words: int, sample: int, most: int = 100_000) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts) of at most ``most`` shingles that several of about ``sample`` documents have, by hash."""
    n = docs.count()
    drawn = docs.where(F.pmod(F.xxhash64(F.lit(5), text_col), F.lit(max(n, 1))) < sample).select(F.lit(0).alias("i"), text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(shingle_hashes(t.as_py(), words)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.uint64), *found]).view(np.int64))], ["h"])

    top = drawn.mapInArrow(run, "h bigint").groupBy("h").count().where("count > 2").orderBy(F.desc("count"), "h").limit(most).collect()
    hashes = np.array([r[0] for r in top], np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], np.array([r[1] for r in top], np.int64)[order]


def _groups(sets: DataFrame) -> DataFrame:
    """``gid, members``: the sets (n, key) that share a shingle of their prefixes, by size; groups of one are left out."""
    rows = sets.select(F.explode("prefix").alias("h"), "n", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, seen, told = None, {}, set()

        def group() -> tuple | None:
            if len(seen) < 2:
                return None
            members = sorted((n, k) for k, n in seen.items())
            gid = xxhash.xxh3_128_digest(b"".join(k for _, k in members))
            if gid in told:
                return None
            if len(told) < 100_000:
                told.add(gid)
            return gid, [{"n": n, "key": k} for n, k in members]

        def table(out: list) -> pa.RecordBatch:
            kind = pa.list_(pa.struct([("n", pa.int32()), ("key", pa.binary())]))
            return pa.RecordBatch.from_arrays([pa.array([g for g, _ in out], pa.binary()), pa.array([m for _, m in out], kind)], ["gid", "members"])

        for batch in batches:
            h = batch.column(0).to_numpy(zero_copy_only=False)
            heads = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.empty(0, np.int64)
            ends = np.append(heads[1:], len(h))
            # a group of one row in the middle of a batch has nothing to say
            use = (ends - heads > 1) | (heads == 0) | (ends == len(h))
            out = []
            for a, b in zip(heads[use].tolist(), ends[use].tolist(), strict=True):
                if h[a] != at:
                    if got := group():
                        out.append(got)
                    at, seen = h[a], {}
                seen.update(zip(batch.column(2).slice(a, b - a).to_pylist(), batch.column(1).slice(a, b - a).to_pylist(), strict=True))
            if out:
                yield table(out)
        if got := group():
            yield table([got])

    dealt = rows.repartition("h").sortWithinPartitions("h")
    return dealt.mapInArrow(run, "gid binary, members array<struct<n:int,key:binary>>").dropDuplicates(["gid"])


def _possible(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs ``a, b`` of keys that their sketches don't rule out.

    Sets of n and m hashes with a similarity of ``least`` differ in (n + m)(1 - least) / (1 + least) hashes at most, and their sketches in no more bits.
    """
    sketch = sets.select("key", "n", "sketch").dropDuplicates(["key"])
    x = sketch.select(F.col("key").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("x"))
    y = sketch.select(F.col("key").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("y"))
    # sets of sizes that are too far apart can't be as similar, and their sketches may differ by more than one halving
    near = F.least("na", "nb") >= least * F.greatest("na", "nb") - 1e-9
    fits = near & (bits_apart(F.col("x"), F.col("y")) <= (F.col("na") + F.col("nb")) * ((1 - least) / (1 + least)) + 1e-6)
    return cut(pairs.join(x, "a").join(y, "b").where(fits).select("a", "b"), "shingle-possible", dictionary=False)


def _verified(pairs: DataFrame, sets: DataFrame, texts: DataFrame, words: int, least: float, report: list[int] | None = None) -> DataFrame:
    """``src, dst`` of the pairs ``a, b`` of keys whose sets are as similar as that; texts: ``t1, t2, text`` of all rows. report: gets the number of pairs that are compared."""
    possible = _possible(pairs, sets, least)
    if report is not None:
        report.append(possible.count())
    ends = possible.select(F.col("a").alias("key")).union(possible.select("b")).distinct()
    # of each set one text
    named = sets.select("key", "t1", "t2").join(ends, "key", "left_semi").groupBy("key").agg(F.min(F.struct("t1", "t2")).alias("t")).select("key", "t.*")
    whole = cut(texts.join(named, ["t1", "t2"]).select("key", "text").dropDuplicates(["key"]), "shingle-ends")
    x = whole.select(F.col("key").alias("a"), F.col("text").alias("x"))
    y = whole.select(F.col("key").alias("b"), F.col("text").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, q = None, np.empty(0, np.uint64)
        for batch in batches:
            keep = []
            for b, x, y in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                p = np.unique(shingle_hashes(x.as_py(), words))
                # pairs come from the join by b
                last, q = b, q if b == last else np.unique(shingle_hashes(y.as_py(), words))
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(both / (len(p) + len(q) - both) >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["src", "dst"]).filter(pa.array(keep, pa.bool_()))

    links = cut(possible.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, "src binary, dst binary"), "shingle-links")
    drop(whole)
    drop(possible)
    return links


def _by_fingerprint(sets: DataFrame, least: float, max_bits: int) -> DataFrame:
    """``a, b``: pairs of each group of linked fingerprints' smallest set with its others, to be verified."""
    points = cut(sets.groupBy("fp").agg(F.min("fp").alias("rep")), "points")
    groups = hamming_components(points, max_bits)
    members = sets.select("fp", "key", "n").dropDuplicates(["key"]).join(groups, "fp")
    first = members.groupBy("component").agg(F.min(F.struct("n", "key")).alias("f")).select("component", F.col("f.key").alias("a"), F.col("f.n").alias("na"))
    return members.join(first, "component").where((F.col("key") != F.col("a")) & (F.col("na") >= least * F.col("n") - 1e-9)).select("a", F.col("key").alias("b"))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, least: float = 0.8, sample: int = 20_000, max_bits: int = 3, report: list[int] | None = None) -> DataFrame:
    """``id_col, component_id`` of every row: the smallest id reachable by links of Jaccard similarity ``least`` or more.

    Rows without an id take the component of their text; a component that only such rows have is null. Rows that repeat an id stay repeated. Null and blank texts are copies of each
    other; texts of any length are taken whole; an empty table gives no rows; other columns are ignored. sample: documents from which frequent
    shingles are learned, which only orders the work.
    """
    ship(docs.sparkSession)
    sets = cut(shingle_sets(docs, id_col, text_col, words, least, frequent_shingles(docs, text_col, words, sample)), "shingle-sets")
    alike = cut(_by_fingerprint(sets, least, max_bits), "shingle-pairs")
    texts = docs.select(F.col(text_col).cast("string").alias("text")).select("text", *_text_identity("text"))
    verified = lambda pairs: _verified(pairs, sets, texts, words, least, report)
    early = verified(alike)
    groups = cut(_groups(sets), "shingle-groups")
    fits = F.col("na") >= least * F.col("nb") - 1e-9
    first = F.col("members")[0]
    star = groups.select(first["key"].alias("a"), first["n"].alias("na"), F.explode(F.slice("members", 2, F.size("members") - 1)).alias("m"))
    star = cut(star.select("a", "na", F.col("m.key").alias("b"), F.col("m.n").alias("nb")).where(fits).select("a", "b").distinct(), "shingle-pairs")
    links = early.union(verified(star.join(alike, ["a", "b"], "left_anti")))
    known = connected_components(links)
    labelled = groups.select("gid", F.explode("members").alias("m")).select("gid", F.col("m.n").alias("n"), F.col("m.key").alias("key"))
    labelled = labelled.join(known, F.col("key") == F.col("node"), "left").select("gid", "n", "key", F.coalesce("component", "key").alias("c"))
    mixed = labelled.groupBy("gid").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low != high").select("gid")
    open_ = cut(labelled.join(mixed, "gid", "left_semi"), "shingle-open")
    a = open_.select("gid", F.col("n").alias("na"), F.col("key").alias("a"), F.col("c").alias("ca"))
    b = open_.select("gid", F.col("n").alias("nb"), F.col("key").alias("b"), F.col("c").alias("cb"))
    ahead = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    rest = a.join(b, "gid").where(ahead & fits & (F.col("ca") != F.col("cb"))).select("a", "b").distinct()
    rest = cut(rest.join(star, ["a", "b"], "left_anti"), "shingle-pairs")
    more = verified(rest)
    labels = connected_components(links.union(more))
    rows = sets.select(F.col("id").alias(id_col), "key").join(labels, F.col("key") == F.col("node"), "left").select(id_col, F.coalesce("component", "key").alias("c"))
    rows = cut(rows, "shingle-rows")
    for t in (sets, alike, groups, star, open_, rest, links, more):
        drop(t)
    return rows.join(rows.groupBy("c").agg(F.min(id_col).alias("component_id")), "c").select(id_col, "component_id")
