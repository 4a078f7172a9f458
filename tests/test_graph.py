"""Graph operators against plain Python over random small graphs."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomgraph.operators import components, graph, inference, paths
from loomgraph.operators.components import connected_components, named_components


def brute(edges):
    label = {x: x for e in edges for x in e}
    moved = True
    while moved:
        moved = False
        for a, b in edges:
            low = min(label[a], label[b])
            moved |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 130)]
    rng.shuffle(edges)
    df = spark.createDataFrame([*edges, (None, 3)], "src long, dst long")
    assert {r.node: r.component for r in connected_components(df).collect()} == brute(edges)


def test_a_long_path_takes_few_rounds(spark):
    """The order of names is not that of the path; edges don't grow."""
    n, rounds = 100_000, []
    name = lambda i: F.xxhash64(i)
    path = spark.range(n - 1).select(name(F.col("id")).alias("src"), name(F.col("id") + 1).alias("dst"))
    found = connected_components(path, report=rounds)
    assert found.agg(F.count("*"), F.count_distinct("component"), F.min("node") == F.min("component")).first()[:] == (n, 1, True)
    assert len(rounds) <= 2 * 17 and max(rounds) == rounds[0] == n - 1


@pytest.mark.parametrize("buckets", [None, 7])
def test_components_of_names(spark, buckets):
    """Also with a hash that many names share, and names that are the same in two graphs."""
    rng = random.Random(5)
    edges = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(45)]
    df = spark.createDataFrame([*edges, (None, "n3")], "src string, dst string")
    hashed = F.xxhash64 if buckets is None else lambda c: F.pmod(F.xxhash64(c), F.lit(buckets))
    assert {r.node: r.component for r in named_components(df, "src", "dst", hashed).collect()} == brute(edges)
    keyed = graph.components(df.selectExpr("src as head", "dst as tail", "explode(array('x', null)) as g"), "g")
    assert {(r.g, r.node): r.component for r in keyed.collect()} == {(g, n): c for g in ("x", None) for n, c in brute(edges).items()}


@pytest.mark.parametrize("buckets", [None, 7])
def test_sizes_of_components_take_no_names(spark, buckets, monkeypatch):
    """Stars, components of a single node that is linked with itself, also with a hash that many nodes share; names are not labelled where hashes differ."""
    edges = [("a", "p", "q"), ("a", "q", "r"), ("a", "s", "s"), ("b", "p", "p"), ("c", "x", "y"), ("c", "z", "w"), ("c", "y", "x"), (None, "x", "y"), ("d", None, "y")] + [("e", "hub", f"n{i}") for i in range(120)]
    df = spark.createDataFrame(edges, "g string, head string, tail string")
    hashed = F.xxhash64 if buckets is None else lambda c: F.pmod(F.xxhash64(c), F.lit(buckets))
    found = {r[0]: r[1:] for r in graph.component_counts(df, "g", hashed).select("g", "components", "nodes", "largest_component", "large", "medium", "small", "tiny").collect()}
    assert found == {"a": (2, 4, 3, 0, 0, 0, 2), "b": (1, 1, 1, 0, 0, 0, 1), "c": (2, 4, 2, 0, 0, 0, 2), None: (1, 2, 2, 0, 0, 0, 1), "e": (1, 121, 121, 0, 1, 0, 0)}
    monkeypatch.setattr(graph, "named_components", None)
    assert graph.connectivity(df.withColumn("relation", F.lit("r")), "g").count() == 6


def test_tasks_keep_forests_of_their_edges(monkeypatch):
    """A dense graph leaves an edge for each node but one; what is held is bounded, and given in parts if it must be."""
    rng = random.Random(6)
    edges = [(rng.randrange(-40, 40), rng.randrange(-40, 40)) for _ in range(2000)]
    batches = [pa.RecordBatch.from_arrays([pa.array([e[i] for e in edges[k : k + 90]]) for i in (0, 1)], names=["a", "b"]) for k in range(0, 2000, 90)]
    whole = [tuple(e.values()) for b in components._forests(iter(batches)) for e in b.to_pylist()]
    assert len(whole) == len(set(brute(edges))) - len(set(brute(edges).values())) and brute([*whole, *((x, x) for x in brute(edges))]) == brute(edges)
    monkeypatch.setattr(components, "HELD", 100)
    parts = list(components._forests(iter(batches)))
    assert len(parts) > 1 and brute([tuple(e.values()) for b in parts for e in b.to_pylist()] + [(x, x) for x in brute(edges)]) == brute(edges)
    n = 100_000
    path = np.random.default_rng(1).permutation(n)
    assert [len(z) for z in components._forest(path[:-1], path[1:])] == [n - 1, n - 1] and set(components._forest(path[:-1], path[1:])[1]) == {0}


def closure(edges):
    """Pairs of a transitive relation, those of a node with itself left out."""
    found = {(a, b) for a, b in edges if a != b}
    while more := {(a, d) for a, b in found for c, d in found if b == c and a != d} - found:
        found |= more
    return found


@pytest.mark.parametrize("seed", [3, 4])
def test_closure_of_random_graphs(spark, seed):
    """Cycles, self-loops, repeats and nulls; two graphs by key, a null key among them."""
    rng = random.Random(seed)
    edges = {k: [(f"n{rng.randrange(14)}", f"n{rng.randrange(14)}") for _ in range(18)] for k in ("x", None)}
    rows = [(k, a, "is a", b) for k, e in edges.items() for a, b in [*e, e[0]]] + [("x", None, "is a", "n1"), ("x", "n1", None, "n2"), ("x", "n1", "likes", "n2")]
    df = spark.createDataFrame(rows, "g string, head string, relation string, tail string")
    got = {(r.g, r.head, r.relation, r.tail) for r in inference.infer(df, key="g").collect()}
    assert got == {(k, a, "Hypernym_isA", b) for k, e in edges.items() for a, b in closure(e)}


def test_symmetry_composition_and_rounds(spark):
    df = spark.createDataFrame([("a", "near", "b"), ("b", "in", "c"), ("c", "near", "b")], "head string, relation string, tail string")
    rules = inference.Rules(hierarchy={}, inverse={"near": "near"}, compose=(("near", "in", "close to"),))
    got = {(r.head, r.relation, r.tail, r["round"]) for r in inference.infer(df, rules).collect()}
    assert got == {("b", "near", "a", 0), ("b", "near", "c", 0), ("a", "close to", "c", 1)}
    assert inference.infer(df.where("false"), rules).count() == 0 and inference.infer(df, inference.Rules(hierarchy={}, compose=())).count() == 0


def test_chains_double(spark):
    n, rounds = 1500, []
    chain = spark.range(n).select(F.col("id").cast("string").alias("head"), F.lit("partOf").alias("relation"), (F.col("id") + 1).cast("string").alias("tail"))
    got = inference.infer(chain, report=rounds)
    assert got.agg(F.count("*"), F.max("round")).first()[:] == (n * (n + 1) // 2, 11) and sum(rounds) == n * (n - 1) // 2
    with pytest.raises(RuntimeError, match="no fixpoint"):
        inference.infer(chain, most_rounds=3)


def test_facts_that_no_rule_puts_together_do_not_meet(spark):
    """A hub with n edges in and n out whose rules need other partners: pairs would be n * n."""
    n, began = 20_000, time.time()
    name = lambda c: F.concat(F.lit(c), F.col("id").cast("string"))
    into = spark.range(n).select(name("a").alias("head"), F.lit("p").alias("relation"), F.lit("hub").alias("tail"))
    out = spark.range(n).select(F.lit("hub").alias("head"), F.lit("q").alias("relation"), name("b").alias("tail"))
    last = spark.createDataFrame([("hub", "x", "end")], into.schema)
    got = inference.infer(into.union(out).union(last), inference.Rules(hierarchy={}, compose=(("p", "x", "z"), ("y", "q", "z"))))
    assert got.groupBy("relation", "tail").count().collect() == [("z", "end", n)] and time.time() - began < 60


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


@pytest.fixture(scope="module")
def triples(spark):
    rows = [("d", "a", "Is-A", "b", 1), ("d", "a", "isa", "b", 2), ("d", "b", " isa", "c", 3), ("d", "x", "是", "x", 4), ("e", "a", None, "z", 5), ("e", "q", "属于", None, 6), ("e", "nan", "r", " NaN", 7)]
    return spark.createDataFrame(rows, "domain string, head string, relation string, tail string, pos long")


def test_isa_split_keeps_every_row(triples):
    isa, other = graph.split_isa(triples)
    assert (isa.count(), other.count()) == (4, 3)


def test_last_relation_counts(triples):
    edges = {(r.src, r.dst): r.relation for r in graph.simple_digraph(triples).where("src = 'a' and dst = 'b'").collect()}
    assert edges == {("a", "b"): "isa"}


def test_connectivity(triples):
    row = graph.connectivity(triples.where("domain = 'd'"), "domain").first()
    assert (row.triples, row.components, row.nodes, row.edges, row.tiny, row.largest_component) == (4, 2, 4, 3, 2, 3)
    assert row.connectivity_rate == 0.5


def test_entities(triples):
    assert {(r.domain, r.entity) for r in graph.entities(triples, "domain").collect()} == {("d", x) for x in "abcx"} | {("e", "a"), ("e", "z"), ("e", "q"), ("e", "NaN")}


def test_buckets(spark):
    got = [r[0] for r in spark.createDataFrame([(n,) for n in (9, 10, 99, 100, 999, 1000)], "n int").select(graph.size_bucket(F.col("n"))).collect()]
    assert got == ["tiny", "small", "small", "medium", "medium", "large"]


def test_paths_of_small_and_large_graphs(spark):
    """Graphs that are one row and graphs that are walked by joins have the same paths; small ones meet nothing."""
    rng = random.Random(8)
    rows = [(k, f" n{rng.randrange(7)}", f"n{rng.randrange(9)}\t") for k in range(30) for _ in range(rng.randrange(1, 16))] + [(1, " ", "n1"), (2, None, "n1"), (None, "n1", "n2")]
    df = spark.createDataFrame(rows, "g int, head string, tail string")
    whole = {small: sorted(map(tuple, paths.bounded_paths(df, "g", small=small).collect())) for small in (0, 8, 32)}
    assert whole[0] == whole[8] == whole[32] and len(whole[0]) == len(set(whole[0])) > 100
    assert "Join" not in paths.bounded_paths(df, "g")._jdf.queryExecution().optimizedPlan().toString()


def test_classification_shuffles_no_vectors(spark):
    from loomgraph.plans.classification import classify_triples

    rows = [("a", "isa", "b", 2, [1.0, 0.0]), ("b", "isa", "c", 1, [0.0, 1.0]), ("x", "likes", "y", 3, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "head string, relation string, tail string, pos long, vec array<double>")
    classes = spark.createDataFrame([("p", 0, [1.0, 0.0]), ("q", 1, [0.0, 1.0])], "name string, ord int, prototype array<double>")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = classify_triples(df, classes).select("pos", "component_id", "label")
        plan = found._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        assert {r[:] for r in found.collect()} == {(1, "a", "q"), (2, "a", "q"), (3, None, "p")}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    moved = [part for part in plan.split("\n\n") if "Exchange" in part.split("\n")[0]]
    assert moved and not any("vec#" in part for part in moved)


def test_index_counts_edges_by_node_before_labels(spark):
    """A hub's edges are one row of the join with the labels."""
    edges = spark.createDataFrame([("hub", f"n{i}", "r") for i in range(500)], "src string, dst string, relation string")
    labels = graph.components(edges.selectExpr("src as head", "dst as tail"))
    index = graph.component_index(edges, labels)
    assert [r[:4] for r in index.collect()] == [("hub", 501, 500, "medium")]
    assert "Aggregate [src" in index._jdf.queryExecution().optimizedPlan().toString()
