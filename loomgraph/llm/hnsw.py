"""Embedding near-dedup with one navigable small-world graph for each shard.

Vectors are dealt to shards by a hash of their id; each shard's graph is built once and written as a table. The vectors of each
shard then query the graph of their own shard and of every later one, so each pair of shards meets once, and a pair of vectors is found by one search
and counts for both. Beams are used at the least width at which an audit of the pair of shards against
brute force proves that they find ``audit_recall`` of the links; where too few audited queries have links to prove it, or the beams
would be wider than a 128th of the shard, the shard is scanned, which misses nothing. A beam that is full of links is widened for its query.
Equal vectors are one node. Cosines are verified in double precision. A task gives back numbers of links and a spanning forest
of what it linked, never pairs.

All searches advance many queries in step: one numpy operation handles a beam step of a whole block.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.names import unused
from loomgraph.llm.simhash import Forest
from loomgraph.operators.components import connected_components
from loomgraph.sources.shared import cut, ship


def _select(base: np.ndarray, x: np.ndarray, found: np.ndarray, sims: np.ndarray, m: int) -> np.ndarray:
    """Up to m neighbours a row of candidates (ids by falling similarity, -1: none): first those that are closer
    to the row than to any chosen one, then the nearest of the rest."""
    rows, width = found.shape
    v = x[np.maximum(found, 0)]
    among = np.einsum("rad,rbd->rab", v, v)
    chosen = np.zeros((rows, width), bool)
    for c in range(width):
        rival = np.where(chosen, among[:, c, :], -np.inf).max(1, initial=-np.inf)
        chosen[:, c] = (found[:, c] >= 0) & (sims[:, c] > rival) & (chosen.sum(1) < m)
    order = np.argsort(np.where(found < 0, 2, np.where(chosen, 0, 1)) * width + np.arange(width), axis=1)[:, :m]
    out = np.take_along_axis(found, order, 1)
    return np.pad(out, ((0, 0), (0, max(0, m - width))), constant_values=-1)


class SmallWorld:
    """A hierarchical graph over unit vectors (float32 for walking); ``links[l]`` is layer l's (n, m) neighbours, -1: none."""

    def __init__(self, x: np.ndarray, links: list[np.ndarray], entry: int):
        self.x, self.links, self.entry = x, links, entry

    @classmethod
    def build(cls, x: np.ndarray, m: int = 16, width: int = 32, seed: int = 3) -> SmallWorld:
        x = np.ascontiguousarray(x, np.float32)
        n = len(x)
        level = np.minimum((-np.log(1 - np.random.default_rng(seed).random(n)) / np.log(m)).astype(int), 4) if n else np.zeros(0, int)
        order = np.argsort(-level, kind="stable")  # nodes of upper layers first: each layer grows from a prefix
        graph = cls(x, [np.full((n, m), -1, np.int32) for _ in range(int(level.max(initial=0)) + 1)], int(order[0]) if n else -1)
        done, size = 1, 1
        while done < n:
            batch = order[done : done + size]
            graph._insert(batch, order[:done], level, m, width)
            done += len(batch)
            size = min(512, max(1, done // 2))
        return graph

    def _insert(self, batch: np.ndarray, old: np.ndarray, level: np.ndarray, m: int, width: int) -> None:
        q = self.x[batch]
        start = np.full(len(batch), self.entry)
        for layer in reversed(range(len(self.links))):
            own = level[batch] >= layer
            found, sims = self._beam(q, start, layer, width)
            start = found[:, 0]
            if not own.any():
                continue
            # the batch's members may be each other's nearest
            mates = np.flatnonzero(own)
            s = q[mates] @ q[mates].T
            np.fill_diagonal(s, -np.inf)
            near = np.argsort(-s, axis=1)[:, : min(width, len(mates) - 1)] if len(mates) > 1 else np.zeros((1, 0), int)
            ids = np.concatenate((found[mates], batch[mates][near]), 1)
            val = np.concatenate((sims[mates], np.take_along_axis(s, near, 1)), 1)
            best = np.argsort(-val, axis=1)[:, :width]
            to = _select(batch[mates], self.x, np.take_along_axis(ids, best, 1), np.take_along_axis(val, best, 1), m)
            self.links[layer][batch[mates]] = to
            self._link_back(batch[mates], to, layer, m)

    def _link_back(self, nodes: np.ndarray, to: np.ndarray, layer: int, m: int) -> None:
        src, dst = np.repeat(nodes, to.shape[1]), to.ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        if not len(dst):
            return
        sims = np.einsum("nd,nd->n", self.x[src], self.x[dst])
        order = np.lexsort((-sims, dst))
        src, dst = src[order], dst[order]
        heads, first = np.unique(dst, return_index=True)
        place = np.arange(len(dst)) - np.repeat(first, np.diff(np.append(first, len(dst))))
        fresh = np.full((len(heads), m), -1, np.int64)
        ok = place < m
        fresh[np.searchsorted(heads, dst[ok]), place[ok]] = src[ok]
        both = np.concatenate((self.links[layer][heads], fresh), 1)
        both.sort(axis=1)
        both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
        val = np.where(both >= 0, np.einsum("nmd,nd->nm", self.x[np.maximum(both, 0)], self.x[heads]), -np.inf)
        best = np.argsort(-val, axis=1)
        self.links[layer][heads] = _select(heads, self.x, np.take_along_axis(both, best, 1), np.take_along_axis(val, best, 1), m)

    def _beam(self, q: np.ndarray, start: np.ndarray, layer: int, width: int, grow: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """(ids, similarities) of each query's beam by falling similarity; -1 and -inf where it isn't full."""
        n, rows = len(self.x), len(q)
        links = self.links[layer]
        ids = np.full((rows, width), -1, np.int64)
        sims = np.full((rows, width), -np.inf, np.float32)
        open_ = np.zeros((rows, width), bool)
        seen = np.zeros((rows, n + 1), bool)
        ids[:, 0], sims[:, 0], open_[:, 0] = start, np.einsum("qd,qd->q", q, self.x[start]), True
        seen[np.arange(rows), start] = True
        seen[:, n] = True
        live = np.arange(rows)
        while len(live):
            k = min(grow, width)
            pick = np.argsort(np.where(open_[live], -sims[live], np.inf), axis=1, kind="stable")[:, :k]
            use = np.take_along_axis(open_[live], pick, 1)
            open_[live[:, None], pick] &= ~use
            near = np.where(use[:, :, None], links[ids[live[:, None], pick]], -1).reshape(len(live), -1)
            near = np.sort(np.where(near < 0, n, near), axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = n
            near[seen[live[:, None], near]] = n
            seen[live[:, None], near] = True
            fresh = near < n
            val = np.full(near.shape, -np.inf, np.float32)
            r, c = np.nonzero(fresh)
            val[r, c] = np.einsum("nd,nd->n", self.x[near[r, c]], q[live[r]])
            all_sims = np.concatenate((sims[live], val), 1)
            best = np.argsort(-all_sims, axis=1, kind="stable")[:, :width]
            sims[live] = np.take_along_axis(all_sims, best, 1)
            ids[live] = np.take_along_axis(np.concatenate((ids[live], np.where(fresh, near, -1)), 1), best, 1)
            open_[live] = np.take_along_axis(np.concatenate((open_[live], fresh), 1), best, 1)
            live = live[open_[live].any(1)]
        return ids, sims

    def search(self, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Beams over the bottom layer after descending from the top."""
        start = np.full(len(q), self.entry)
        for layer in range(len(self.links) - 1, 0, -1):
            start = self._beam(q, start, layer, 4)[0][:, 0]
        return self._beam(q, start, 0, width)

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, entry=self.entry, **{f"l{k}": v for k, v in enumerate(self.links)})
        return out.getvalue()

    @classmethod
    def from_bytes(cls, raw: bytes, x: np.ndarray) -> SmallWorld:
        z = np.load(io.BytesIO(raw))
        return cls(np.ascontiguousarray(x, np.float32), [z[f"l{k}"] for k in range(len(z.files) - 1)], int(z["entry"]))


def _candidates(graph: SmallWorld, x32: np.ndarray, q32: np.ndarray, least: float, wide: int) -> tuple[np.ndarray, np.ndarray]:
    """(query row, data row) of what beams of that width find; full beams are widened, at last to a scan; width 0: a scan."""
    n, first, todo, left, right = len(x32), wide, np.arange(len(q32)), [], []
    while len(todo):
        if not wide or wide * 128 >= n and wide > first:
            for b in range(0, len(todo), 64):
                r, c = np.nonzero(q32[todo[b : b + 64]] @ x32.T >= least)
                left.append(todo[b : b + 64][r])
                right.append(c)
            break
        found, sims = graph.search(q32[todo], wide)
        near = (found >= 0) & (sims >= least)
        full = near[:, -1]
        r, c = np.nonzero(near & ~full[:, None])
        left.append(todo[r])
        right.append(found[r, c])
        todo, wide = todo[full], wide * 2
    none = np.empty(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right]).astype(np.int64)


def _proven(graph: SmallWorld, x: np.ndarray, x32: np.ndarray, ids: np.ndarray, q: np.ndarray, q_ids: np.ndarray, least: float, wide: int, audit: int, audit_recall: float, margin: float, rows_with_links: int = 64) -> int:
    """The least beam width, from ``wide`` on, that an audit over all queries proves; 0 when none below a 128th of the shard is.

    Every ``512 // audit``-th query is compared with the whole shard. A width is proven when at least ``rows_with_links`` audited queries have links and
    the beams find ``audit_recall`` of the links, both of all and on average over those queries, so that a large group can't hide small ones.
    """
    n = len(x)
    checked = np.arange(0, len(q), max(1, 512 // audit))
    truth = [np.flatnonzero((q[k] @ x.T >= least) & (ids != q_ids[k])) for k in checked]
    linked = [k for k in range(len(checked)) if len(truth[k])]
    if len(linked) < rows_with_links:
        return 0
    rows = checked[linked]
    while wide * 128 < n:
        shares, hit, total = [], 0, 0
        for b in range(0, len(rows), 512):
            i, j = _candidates(graph, x32, q[rows[b : b + 512]].astype(np.float32), least - margin, wide)
            for k, t in enumerate(linked[b : b + 512]):
                got = np.count_nonzero(np.isin(truth[t], j[i == k]))
                shares.append(got / len(truth[t]))
                hit, total = hit + got, total + len(truth[t])
        if hit >= audit_recall * total and np.mean(shares) >= audit_recall:
            return wide
        wide *= 2
    return 0


def range_links(graph: SmallWorld, x: np.ndarray, ids: np.ndarray, q: np.ndarray, q_ids: np.ndarray, least: float, width: int = 32, audit: int = 48, audit_recall: float = 0.99, margin: float = 1e-4) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query row, data row) arrays of links with cosine >= least in double precision; unit vectors x and q.

    Beams are used only at a width that :func:`_proven` accepts for these queries; otherwise the shard is scanned, which misses nothing.
    """
    x32 = np.ascontiguousarray(x, np.float32)
    proven = _proven(graph, x, x32, ids, q, q_ids, least, width, audit, audit_recall, margin) if len(q) else 0
    for a in range(0, len(q), 512):
        left, right = _candidates(graph, x32, q[a : a + 512].astype(np.float32), least - margin, proven)
        left += a
        for b in range(0, len(left), 65536):
            i, j = left[b : b + 65536], right[b : b + 65536]
            good = (np.einsum("nd,nd->n", q[i], x[j]) >= least) & (q_ids[i] != ids[j])
            yield i[good], j[good]


def _unit(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    x = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.9, shard: int = 16_384) -> DataFrame:
    """Every row with ``n_links, component_id, kept``.

    n_links: other vectors found at a cosine of ``least`` or more, a pair that is found counting for both; component_id: smallest id reachable by links. Vectors that are
    null, empty, zero or hold null or non-finite components link with nothing, nor do vectors of different lengths or rows
    without an id (null component, kept). Rows that repeat an id count as one vector, the smallest; equal vectors all link. An empty table gives
    no rows; columns named like the results are replaced. shard: vectors a graph is meant to hold, which bounds a task's memory.
    """
    spark = vectors.sparkSession
    ship(spark)
    v = F.col(vector_col)
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(fine & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), v.alias("x"))
    single = cut(rows.groupBy("id").agg(F.min("x").alias("x")), "vectors")
    # equal vectors are one node, by their smallest id: in a graph, copies would shut each other out of the neighbour lists
    rows = cut(single.groupBy("x").agg(F.min("id").alias("id"), F.count("*").alias("copies")).withColumn("dim", F.size("x")), "vectors")
    shards = max(1, -(-rows.count() // shard))
    home = rows.withColumn("shard", F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(shards)).cast("int"))

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        x, first = _unit(table.column("x")), table.slice(0, 1)
        return pa.table({"dim": first.column("dim"), "shard": first.column("shard"), "ids": [table.column("id").to_numpy().astype("<i8").tobytes()], "copies": [table.column("copies").to_numpy().astype("<i8").tobytes()], "vecs": [x.astype("<f8").tobytes()], "graph": [SmallWorld.build(x).to_bytes()]})

    graphs = cut(home.groupBy("dim", "shard").applyInArrow(build, "dim int, shard int, ids binary, copies binary, vecs binary, graph binary"), "small-worlds")
    asked = graphs.withColumn("asking", F.explode(F.sequence(F.lit(0), F.col("shard"))))
    asking = home.withColumnRenamed("shard", "asking").withColumn("shard", F.explode(F.sequence(F.col("asking"), F.lit(shards - 1))))

    def search(stored: pa.Table, queries: pa.Table) -> pa.Table:
        empty = pa.array([], pa.int64())
        if not len(stored) or not len(queries):
            return pa.table({"src": empty, "dst": empty, "n": empty})
        one = stored.to_pylist()[0]
        ids, copies = np.frombuffer(one["ids"], "<i8"), np.frombuffer(one["copies"], "<i8")
        x = np.frombuffer(one["vecs"], "<f8").reshape(len(ids), -1)
        q_ids, q_copies = queries.column("id").to_numpy(), queries.column("copies").to_numpy()
        number, row = np.unique(np.concatenate((ids, q_ids)), return_inverse=True)
        forest, links = Forest(len(number)), np.zeros(len(number), np.int64)
        for i, j in range_links(SmallWorld.from_bytes(one["graph"], x), x, ids, _unit(queries.column("x")), q_ids, least):
            if one["shard"] == one["asking"]:  # both ends ask here: the pair belongs to the larger id
                ahead = q_ids[i] > ids[j]
                i, j = i[ahead], j[ahead]
            left, right = row[len(ids) + i], row[j]
            np.add.at(links, left, copies[j])
            np.add.at(links, right, q_copies[i])
            for a, b in zip(left.tolist(), right.tolist(), strict=True):
                forest.join(a, b)
        roots = np.array([forest.root(k) for k in range(len(number))])
        own = np.flatnonzero(roots != np.arange(len(number)))
        counted = np.flatnonzero(links)
        src = np.concatenate((number[own], number[counted]))
        dst = pa.array(np.concatenate((number[roots[own]], np.zeros(len(counted), np.int64))), mask=np.arange(len(src)) >= len(own))
        return pa.table({"src": src, "dst": dst, "n": np.concatenate((np.zeros(len(own), np.int64), links[counted]))})

    keys = ["dim", "shard", "asking"]
    found = cut(asked.groupBy(*keys).cogroup(asking.groupBy(*keys)).applyInArrow(search, "src bigint, dst bigint, n bigint"), "vector-links")
    counts = found.where("dst is null").groupBy("src").agg(F.sum("n").alias("n_links"))
    labels = connected_components(found.where("dst is not null"))
    kept = vectors.drop("n_links", "component_id", "kept")
    of, number, group = unused(kept, "id", "n", "c")
    known = rows.join(counts, F.col("id") == F.col("src"), "left").join(labels, F.col("id") == F.col("node"), "left")
    known = known.select("x", (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias(number), F.coalesce("component", "id").alias(group))
    known = cut(single.join(known, "x").select(F.col("id").alias(of), number, group), "vector-labels")
    own = F.col(id_col).cast("long")
    out = kept.join(known, own == F.col(of), "left").withColumns({"n_links": F.coalesce(number, F.lit(0)), "component_id": F.coalesce(group, own)})
    return out.withColumn("kept", F.coalesce(F.col("component_id") == own, F.lit(True))).select(*kept.columns, "n_links", "component_id", "kept")
