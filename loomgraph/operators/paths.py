"""Bounded simple paths over edge tables of many graphs at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.text import strip
from loomgraph.sources.shared import cut

#: Graphs of so many edges or fewer, repeats counted, are walked where their edges are put together.
SMALL = 32


def bounded_paths(triples: DataFrame, key: str, depth: int = 4, inner: int = 3, small: int = SMALL) -> DataFrame:
    """``key, path`` for simple paths of each key's graph, rendered ``a->b->c``.

    Paths start at nodes without edges in, or at all heads when a graph has none. A path of one edge
    or more is given when its end has no edge out, or when it has at least ``inner`` edges; none is longer than ``depth``
    edges. Names are stripped, and edges with a blank or null end count for nothing; so does a null key. A graph of ``small`` edges at most is an array of one row, whose
    paths are walked in place; of larger ones each step is one equi-join of the frontier with the distinct edges.
    """
    edges = triples.select(key, strip(F.col("head")).alias("head"), strip(F.col("tail")).alias("tail")).where(F.col(key).isNotNull() & (F.col("head") != "") & (F.col("tail") != ""))
    edges = cut(edges, "path-edges")
    large = cut(edges.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > small).select(key), "path-graphs")
    if large.isEmpty():
        return _walked(edges, key, depth, inner)
    return _walked(edges.join(large, key, "left_anti"), key, depth, inner).unionByName(_joined(edges.join(large, key, "left_semi").distinct(), key, depth, inner))


def _walked(edges: DataFrame, key: str, depth: int, inner: int) -> DataFrame:
    """Paths of graphs that are small enough to be a row."""
    end = lambda path: F.element_at(path, -1)
    graphs = edges.groupBy(key).agg(F.collect_set(F.struct("head", "tail")).alias("e")).withColumns({"h": F.array_distinct(F.col("e.head")), "t": F.array_distinct(F.col("e.tail"))})
    sources = F.array_except("h", "t")
    graphs = graphs.select(key, "e", F.array_except("t", "h").alias("ends"), F.transform(F.when(F.size(sources) > 0, sources).otherwise(F.col("h")), lambda s: F.array(s)).alias("p0"))

    def longer(path: Column) -> Column:
        onward = F.filter("e", lambda x: (x["head"] == end(path)) & ~F.array_contains(path, x["tail"]))
        return F.transform(onward, lambda x: F.concat(path, F.array(x["tail"])))

    for n in range(1, depth + 1):
        graphs = graphs.withColumn(f"p{n}", F.flatten(F.transform(f"p{n - 1}", longer)))
    given = [F.col(f"p{n}") if n >= inner else F.filter(f"p{n}", lambda p: F.array_contains("ends", end(p))) for n in range(1, depth + 1)]
    return graphs.select(key, F.explode(F.array_distinct(F.transform(F.concat(*given), lambda p: F.array_join(p, "->")))).alias("path"))


def _joined(edges: DataFrame, key: str, depth: int, inner: int) -> DataFrame:
    """Paths of graphs of any size, by a join a step."""
    heads = edges.select(key, F.col("head").alias("node")).distinct()
    tails = edges.select(key, F.col("tail").alias("node")).distinct()
    sources = heads.join(tails, [key, "node"], "left_anti")
    starts = sources.unionByName(heads.join(sources.select(key).distinct(), key, "left_anti"))
    ends = tails.join(heads, [key, "node"], "left_anti").withColumn("is_end", F.lit(True))
    frontier, parts = starts.select(key, "node", F.array("node").alias("path")), []
    for n in range(1, depth + 1):
        frontier = frontier.join(edges.withColumnRenamed("head", "node"), [key, "node"]).where(~F.array_contains("path", F.col("tail"))).select(key, F.col("tail").alias("node"), F.concat("path", F.array("tail")).alias("path"))
        given = frontier if n >= inner else frontier.join(ends, [key, "node"], "left_semi")
        parts.append(given.select(key, F.array_join("path", "->").alias("path")))
    return reduce(DataFrame.unionByName, parts).distinct()
