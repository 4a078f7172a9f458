"""Dense-enough long numbers for nodes, so that graph rounds shuffle eight bytes a node instead of names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.sources.shared import cut


def number_nodes(edges: DataFrame, src: str = "src", dst: str = "dst") -> tuple[DataFrame, DataFrame]:
    """(``a, b``: edges by number, ``id, node``): numbers follow the order of the nodes, so the least number is the least node.

    Nodes are range-partitioned and numbered in their partitions; edges find their ends' numbers by two joins. Null ends are left out with their edges. Both
    tables are in the shared folder, as numbers must not be given twice.
    """
    ends = edges.select(F.col(src).alias("x"), F.col(dst).alias("y")).where("x is not null and y is not null").distinct()
    nodes = ends.select(F.explode(F.array("x", "y")).alias("node")).distinct()
    numbered = cut(nodes.repartitionByRange("node").sortWithinPartitions("node").select(F.monotonically_increasing_id().alias("id"), "node"), "nodes")
    first = ends.join(numbered.select(F.col("id").alias("a"), F.col("node").alias("x")), "x").drop("x")
    pairs = first.join(numbered.select(F.col("id").alias("b"), F.col("node").alias("y")), "y").select("a", "b")
    return cut(pairs, "pairs", dictionary=False), numbered
