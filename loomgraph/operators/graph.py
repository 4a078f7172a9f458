"""Graph operators over triple tables: ISA split, components, connectivity, degrees, entities."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.text import strip
from loomgraph.operators.components import connected_components, hashed_stars, named_components

#: Relations (lower case) that say "is a".
ISA_RELATIONS = ["isa", "is a", "is-a", "是", "属于"]


def is_isa(relation: Column) -> Column:
    """Whether a relation is one of the ISA relations in any case; not trimmed, null is none."""
    return F.coalesce(F.lower(relation).isin(ISA_RELATIONS), F.lit(False))


def split_isa(triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ISA triples, all others)."""
    return triples.where(is_isa(F.col("relation"))), triples.where(~is_isa(F.col("relation")))


def simple_digraph(triples: DataFrame, *keys: str) -> DataFrame:
    """``keys, src, dst, relation``: one edge for each (head, tail); the relation at the last position counts."""
    return triples.groupBy(*keys, F.col("head").alias("src"), F.col("tail").alias("dst")).agg(F.max_by("relation", "pos").alias("relation"))


def size_bucket(nodes: Column, labelled: bool = False) -> Column:
    """large, medium, small or tiny, by number of nodes."""
    large, medium, small, tiny = ("large (>=1000)", "medium (100-999)", "small (10-99)", "tiny (<10)") if labelled else ("large", "medium", "small", "tiny")
    return F.when(nodes >= 1000, large).when(nodes >= 100, medium).when(nodes >= 10, small).otherwise(tiny)


def _keyed(triples: DataFrame, key: str) -> DataFrame:
    """``src, dst``: ends as structs (k, n), so that each value of the key is a graph of its own."""
    pair = lambda c: F.struct(F.col(key).alias("k"), F.col(c).alias("n"))
    return triples.where(F.col("head").isNotNull() & F.col("tail").isNotNull()).select(pair("head").alias("src"), pair("tail").alias("dst"))


def components(triples: DataFrame, key: str | None = None) -> DataFrame:
    """``[key,] node, component``: weakly connected components; the component is named by its smallest node.

    With a key, each of its values is a graph of its own; all are labelled in the same rounds.
    """
    if key is None:
        return named_components(triples, "head", "tail")
    found = named_components(_keyed(triples, key), "src", "dst")
    return found.select(F.col("node.k").alias(key), F.col("node.n").alias("node"), F.col("component.n").alias("component"))


def component_index(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """``component, node_count, edge_count, size_group, sample_nodes``: of a simple digraph; the first five nodes by name.

    The sample is kept by an aggregate of five slots' worth of rows for each component, not by collecting all nodes.
    """
    from pyspark.sql.window import Window

    rank = F.row_number().over(Window.partitionBy("component").orderBy("node"))
    first = labels.withColumn("rank", rank).where("rank <= 5").groupBy("component").agg(F.array_join(F.array_sort(F.collect_list("node")), "|").alias("sample_nodes"))
    nodes = labels.groupBy("component").agg(F.count("*").alias("node_count"))
    # edges are counted by node first, so a node's edges are one row of the join
    out_edges = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n"))
    size = labels.join(out_edges, "node").groupBy("component").agg(F.sum("n").alias("edge_count"))
    out = nodes.join(size, "component", "left").join(first, "component")
    return out.select("component", "node_count", F.coalesce("edge_count", F.lit(0)).alias("edge_count"), size_bucket(F.col("node_count")).alias("size_group"), "sample_nodes")


def component_counts(triples: DataFrame, key: str, hashed: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """``key, components, nodes, largest_component, large, medium, small, tiny`` of the components of each value of ``key``.

    Only sizes are asked for, so names stay behind: a star's size meets its root's hash, and nodes that no star holds are components of one.
    """
    ends = _keyed(triples, key)
    stars = hashed_stars(ends, "src", "dst", hashed)
    if stars is None:
        sizes = connected_components(ends, "src", "dst").groupBy(F.col("component.k").alias("k"), "component").agg(F.count("*").alias("n")).select("k", "n", F.col("n").alias("held"))
    else:
        nodes, links = stars
        roots = links.groupBy("v").agg((F.count("*") + 1).alias("n"))
        sizes = nodes.select("id", F.col("node.k").alias("k")).join(roots, F.col("id") == F.col("v"), "left").select("k", "n", F.lit(1).alias("held"))
    bucket, alone = F.when(F.col("n").isNotNull(), size_bucket(F.col("n"))), F.col("nodes") - F.col("starred")
    counted = sizes.groupBy("k").agg(
        F.sum("held").alias("nodes"), F.coalesce(F.sum("n"), F.lit(0)).alias("starred"), F.count("n").alias("stars"), F.max("n").alias("most"),
        *[F.count_if(bucket == b).alias(b) for b in ("large", "medium", "small", "tiny")])
    return counted.select(
        F.col("k").alias(key), (F.col("stars") + alone).alias("components"), "nodes", F.coalesce("most", F.lit(1).cast("long")).alias("largest_component"),
        "large", "medium", "small", (F.col("tiny") + alone).alias("tiny"))


def connectivity(triples: DataFrame, key: str) -> DataFrame:
    """A row for each value of ``key``: triples, nodes, distinct undirected edges, components, rate, largest, buckets.

    triples counts repeats; rate is (triples - components) / triples, 0 without triples. Triples with a null part are left out; a value that has no others keeps its row, of zeros.
    """
    whole = triples.dropna(subset=["head", "relation", "tail"])
    counted = component_counts(whole, key)
    edges = whole.select(key, F.least("head", "tail").alias("a"), F.greatest("head", "tail").alias("b")).distinct().groupBy(key).agg(F.count("*").alias("edges"))
    total = whole.groupBy(key).agg(F.count("*").alias("triples"))
    rate = F.coalesce(F.try_divide((F.col("triples") - F.col("components")).cast("double"), F.col("triples").cast("double")), F.lit(0.0))
    found = triples.select(key).distinct().join(total, key, "left").join(counted, key, "left").join(edges, key, "left")
    return found.fillna(0, [c for c in found.columns if c != key]).withColumn("connectivity_rate", rate)


def connectivity_summary(per_domain: DataFrame) -> DataFrame:
    """Sums of triples and components, and the unweighted mean of the rates."""
    return per_domain.agg(F.sum("triples").alias("triples"), F.sum("components").alias("components"), F.avg("connectivity_rate").alias("mean_rate"))


def degrees(triples: DataFrame, *keys: str) -> DataFrame:
    """``keys, node, in_degree, out_degree`` over distinct (head, tail); one explode and one aggregation."""
    pairs = triples.select(*keys, "head", "tail").dropna(subset=["head", "tail"]).distinct()
    ends = pairs.select(*keys, F.explode(F.array(F.struct(F.col("head").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("tail").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e"))
    return ends.groupBy(*keys, F.col("e.node").alias("node")).agg(F.sum("e.i").alias("in_degree"), F.sum("e.o").alias("out_degree"))


def entities(triples: DataFrame, key: str) -> DataFrame:
    """``key, entity``: distinct heads and tails; nulls, blanks and ``nan`` (before stripping, in any case) are none."""
    ends = triples.select(key, F.explode(F.array("head", "tail")).alias("raw"))
    return ends.where(F.col("raw").isNotNull() & (F.lower("raw") != "nan")).select(key, strip(F.col("raw")).alias("entity")).where("entity != ''").distinct()


def representative_edges(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """``component, head, relation, tail``: the edge at the first position of each component, by one aggregation."""
    inside = edges.join(labels, F.col("head") == F.col("node"))
    return inside.groupBy("component").agg(F.min_by(F.struct("head", "relation", "tail"), "pos").alias("e")).select("component", "e.*")
