"""The stages that sort triples into classes: label a sample, average prototypes, classify, classify within a class, merge."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.taxonomy import DEFAULT_FIELD
from loomgraph.functions.text import PROMPTS, bracket_labels, prompt, textualize
from loomgraph.operators import graph, stats, vectors
from loomgraph.plans.providers import Policy, Provider, call_provider, spread
from loomgraph.sources import readers
from loomgraph.sources.shared import cut

TRIPLE = ["head", "relation", "tail"]


def text_of(triples: DataFrame, name: str = "text") -> DataFrame:
    """With the text that classification embeds; a null part reads ``nan``."""
    return triples.withColumn(name, textualize(F.col("head"), F.col("relation"), F.col("tail"), " -> "))


def label_triples(triples: DataFrame, model: Provider, classes: list[str], default: str | None = DEFAULT_FIELD, policy: Policy | None = None) -> DataFrame:
    """Rows with ``label``: one for each class that the model's answer names in brackets, a class named twice giving two.

    An answer without a known class gives ``default``, or no row when that is None. Take a sample first (:func:`stats.sample_exact`).
    """
    asked = text_of(spread(triples), "__text").withColumn("prompt", prompt(PROMPTS["judge"], labels=F.lit(", ".join(classes)), triple=F.col("__text")))
    answered = cut(call_provider(asked, model, policy=policy).drop("prompt", "__text", "status", "attempts"), "labelled")
    return answered.withColumn("label", F.explode(bracket_labels(F.col("response"), classes, default))).drop("response")


def classify_triples(triples: DataFrame, classes: DataFrame, threshold: float = 0.0, vector: str = "vec") -> DataFrame:
    """All rows with ``component_id, type, label``.

    triples: ``head, relation, tail, pos`` and a vector of the text; classes: ``name, ord, prototype``. ISA triples are classified by component: the edge at the first position
    speaks for all of a component's edges; other triples each for themselves, with a null component. Triples with a null end and ISA relation are left out.
    """
    # every row is scored where it stands, so labels are shuffled instead of vectors
    isa, other = graph.split_isa(vectors.classify(triples, vector, classes, name="name", threshold=threshold).drop("best_sim"))
    labels = graph.components(isa)
    inside = isa.join(labels, F.col("head") == F.col("node")).drop("node")
    chosen = inside.groupBy("component").agg(F.min_by("label", "pos").alias("__label"))
    by_component = inside.drop("label").join(chosen, "component").withColumnsRenamed({"component": "component_id", "__label": "label"}).withColumn("type", F.lit("ISA_Component"))
    alone = other.withColumns({"component_id": F.lit(None).cast("string"), "type": F.lit("Non_ISA")})
    return by_component.unionByName(alone)


def sub_classify(rows: DataFrame, classes: DataFrame, key: str, threshold: float = 0.0, vector: str = "vec", default: str = "other") -> DataFrame:
    """Rows of those values of ``key`` that have prototypes, with ``best_sim, label``: the most similar class of the row's own value.

    classes: ``key, name, ord, prototype``, a fixed taxonomy, whose vectors every task gets; rows are neither multiplied nor moved.
    """
    return vectors.classify_within(rows, vector, key, classes, "name", threshold, default)


def merge_folder(spark: SparkSession, base: str) -> DataFrame:
    """``head, relation, tail, source_file`` of all CSV files below a folder but the merged ones, so nothing counts twice."""
    files = [f for f in readers.listing(spark, base, ".csv", recursive=True) if not f.endswith("_all.csv")]
    return readers.read_triples(spark, files)


def merge_counts(classified: DataFrame) -> DataFrame:
    """``label, isa, non_isa, total`` of classified triples and their distinct heads, relations and tails."""
    return stats.class_counts(classified, "label", "type").join(stats.distinct_counts(classified, "label"), "label")
