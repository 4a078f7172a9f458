"""Connected components by alternating large-star and small-star contractions.

Rounds work on edges (u, v) of long numbers with u > v. Whole numbers stand for themselves; other nodes get numbers once, by their hashes (:func:`named_components`) or in the order
of their names. Large-star joins the larger neighbours of each node to its least neighbour, small-star the smaller ones and the node itself; both keep components as they are, and together they
shrink every component to a star around its least node in about log n rounds, a path too. An operation is one aggregation with map-side
combine and one join on plain exchanges, so AQE can split a hub's rows over many tasks. A round writes one table, so a lost executor costs
one round at most; edges never grow beyond the first round's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from loomgraph.operators.numbering import number_nodes
from loomgraph.sources.shared import cut, drop, ship

#: Edges that a task of :func:`forests` holds at once.
HELD = 1 << 21


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
    return moved.where("u != v").distinct()


def _is_stars(edges: DataFrame) -> bool:
    """Whether each node has one parent at most, and no parent has one itself."""
    roles = edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("e")).select("e.*")
    return roles.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up > 0 and down > 0").isEmpty()


def _stars(pairs: DataFrame, report: list[int] | None = None) -> DataFrame:
    """``u, v``: every node of ``a, b`` but the least of its component, with that one. In the shared folder."""
    links = cut(pairs.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links", dictionary=False)
    while True:
        if report is not None:
            report.append(links.count())
        if _is_stars(links):
            return links
        after = cut(_small_star(_large_star(links)), "links", dictionary=False)
        drop(links)
        links = after


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the edges but the least of its component, with that one: roots of larger numbers are hung below smaller ones until no edge joins two roots."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while len(x):
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(above := root[root], root):
            root = above
        x, y = root[x], root[y]
        x, y = x[x != y], y[x != y]
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges that connect what a partition's edges do, no more than it has nodes; a forest that outgrows half of what is held is given at once and a new one begun."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    give = lambda: pa.RecordBatch.from_arrays([pa.array(z) for z in held[0]], names=["a", "b"])
    n = 0
    for batch in batches:
        held.append((batch.column("a").to_numpy(zero_copy_only=False), batch.column("b").to_numpy(zero_copy_only=False)))
        n += len(batch)
        if n >= HELD:
            held = [_forest(*map(np.concatenate, zip(*held, strict=True)))]
            n = len(held[0][0])
            if n > HELD // 2:
                yield give()
                held, n = [], 0
    if held:
        held = [_forest(*map(np.concatenate, zip(*held, strict=True)))]
        yield give()


def hashed_stars(edges: DataFrame, src: str, dst: str, hashed: Callable[[Column], Column] = F.xxhash64) -> tuple[DataFrame, DataFrame] | None:
    """(``id, node``: nodes that are names by 64-bit hash, ``u, v``: the stars of :func:`_stars` by hash), in the shared folder; None should two nodes have one hash.

    Each task first keeps a forest of its own edges, so what is shuffled is at most its nodes.
    """
    ship(edges.sparkSession)
    ends = edges.select(F.col(src).alias("x"), F.col(dst).alias("y")).where("x is not null and y is not null")
    nodes = cut(ends.select(F.explode(F.array("x", "y")).alias("node")).select(hashed(F.col("node")).alias("id"), "node").distinct(), "nodes")
    if nodes.select("id").distinct().count() < nodes.count():
        drop(nodes)
        return None
    return nodes, _stars(ends.select(hashed(F.col("x")).alias("a"), hashed(F.col("y")).alias("b")).mapInArrow(_forests, "a long, b long"))


def named_components(edges: DataFrame, src: str, dst: str, hashed: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """:func:`connected_components` of nodes that are names; edges are 64-bit hashes of their ends (:func:`hashed_stars`).

    Should two nodes have one hash, which is checked, nodes are numbered in their order instead.
    """
    stars = hashed_stars(edges, src, dst, hashed)
    if stars is None:
        return connected_components(edges, src, dst)
    nodes, links = stars
    rooted = nodes.join(links.withColumnRenamed("u", "id"), "id", "left").select("node", F.coalesce("v", "id").alias("root"))
    found = cut(rooted.join(rooted.groupBy("root").agg(F.min("node").alias("component")), "root").select("node", "component"), "components")
    drop(links)
    drop(nodes)
    return found


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", report: list[int] | None = None) -> DataFrame:
    """Label every node of an undirected edge list with the smallest node of its component.

    Rows with a null end are ignored; repeated edges and self-loops are harmless (a self-loop
    makes its node a component). Returns ``node, component``; an empty edge list gives no rows. report: gets the number of edges of each round.
    """
    kind = edges.schema[src].dataType
    if isinstance(kind, IntegralType) and kind == edges.schema[dst].dataType:
        # whole numbers are their own numbers, in the order of the nodes
        pairs = cut(edges.select(F.col(src).cast("long").alias("a"), F.col(dst).cast("long").alias("b")).where("a is not null and b is not null"), "pairs", dictionary=False)
        links = _stars(pairs, report)
        nodes = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        labelled = nodes.join(links.withColumnRenamed("u", "id"), "id", "left")
        found = cut(labelled.select(F.col("id").cast(kind).alias("node"), F.coalesce("v", "id").cast(kind).alias("component")), "components")
        drop(pairs)
        drop(links)
        return found
    pairs, nodes = number_nodes(edges, src, dst)
    links = _stars(pairs, report)
    drop(pairs)
    # a star's edges are its labels; a node without any is its own
    labelled = nodes.join(links.withColumnRenamed("u", "id"), "id", "left").select("node", F.coalesce("v", "id").alias("id"))
    found = cut(labelled.join(nodes.withColumnRenamed("node", "component"), "id").select("node", "component"), "components")
    drop(links)
    drop(nodes)
    return found
