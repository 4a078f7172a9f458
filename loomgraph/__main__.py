"""Command line: ``python -m loomgraph <stage> ...``; each stage is a plan over folders that Spark can read and write."""

from __future__ import annotations

import argparse
import importlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.render import FORMATS
from loomgraph.functions.taxonomy import DEFAULT_FIELD, TAXONOMY
from loomgraph.operators import evaluate, graph, stats, vectors
from loomgraph.plans import classification, embeddings, workflow
from loomgraph.plans.providers import HashingEncoder, Policy, encode
from loomgraph.sources import readers, writers
from loomgraph.sources.shared import cut, new_dir


def provider(name: str):
    """``package.module:factory`` gives a provider by calling the factory; services and keys are the caller's own."""
    module, _, factory = name.partition(":")
    return getattr(importlib.import_module(module), factory)()


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="loomgraph", description=__doc__)
    sub = top.add_subparsers(dest="stage", required=True)

    def stage(name: str, *names: str, **defaults) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        for n in names:
            p.add_argument(f"--{n}", required=True)
        for n, d in defaults.items():
            p.add_argument(f"--{n.replace('_', '-')}", default=d, type=type(d) if d is not None else str)
        return p

    stage("retrieve", "questions", "triples", "output", "provider", other=None, encoder=None, embeddings=None, top_k=100, attempts=3, concurrency=10)
    stage("enrich", "input", "output", "provider", template=None, delay=0.1, attempts=3, concurrency=2)
    stage("reason", "input", "output", "provider", formats="", max_triples=10, attempts=3, concurrency=10, batch=10_000)
    stage("progress", "input", "output")
    stage("evaluate", "input", "output")
    stage("build", "triples", "output")
    stage("label", "triples", "output", "provider", domain=None, rows=10, seed=0, attempts=3, concurrency=10)
    stage("classify", "triples", "prototypes", "output", encoder=None, threshold=0.0)
    stage("subclassify", "classified", "prototypes", "output", encoder=None, threshold=0.0)
    stage("merge", "folder", "output")
    stage("connectivity", "triples", "output")
    stage("entities", "triples", "output")
    stage("sample", "csv", "output", rows=10, seed=0)
    stage("count", "folder")
    return top


def _domains(spark: SparkSession, base: str) -> DataFrame:
    """All triples of a folder of domain folders; merged ``*_all.csv`` copies are left out, so nothing counts twice."""
    files = [f for f in readers.listing(spark, base, ".csv", recursive=True) if not f.endswith("_all.csv")]
    parts: dict[str, list[str]] = {}
    for f in files:
        parts.setdefault(f.rsplit("/", 2)[-2], []).append(f)
    out = spark.createDataFrame([], "head string, relation string, tail string, source_file string, domain string")
    for domain, paths in parts.items():
        out = out.unionByName(readers.read_triples(spark, paths).withColumn("domain", F.lit(domain)))
    return out


def _embedded(triples: DataFrame, encoder: str | None) -> DataFrame:
    """With ``vec``, of the text that classification embeds."""
    return encode(classification.text_of(triples, "__text"), provider(encoder) if encoder else HashingEncoder(), "__text").drop("__text")


def _prototypes(spark: SparkSession, path: str, encoder: str | None, key: str | None = None) -> DataFrame:
    """``[key,] name, ord, prototype`` of labelled triples in class folders, or in key folders of class folders."""
    rows = spark.read.options(**readers.CSV_OPTIONS).option("recursiveFileLookup", "true").csv(path)
    keys = [key] if key else []
    means = vectors.prototypes(_embedded(rows, encoder), [*keys, "label"], "vec")
    order = F.coalesce(F.array_position(F.array(*[F.lit(x) for f, subs in TAXONOMY.items() for x in (f, *subs)]), F.col("label")), F.lit(0))
    return means.select(*keys, F.col("label").alias("name"), order.alias("ord"), "prototype")


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName(f"loomgraph {a.stage}").getOrCreate()
    if a.stage == "retrieve":
        triples = cut(readers.load_subfield_triples(spark, a.triples, a.other).withColumn("triple_id", F.monotonically_increasing_id()), "triples")
        encoder, name = (provider(a.encoder), a.encoder) if a.encoder else (HashingEncoder(), "hashing")
        questions = readers.read_questions(spark, a.questions)
        store = a.embeddings or new_dir(spark, "embeddings")
        known = embeddings.store(triples, store, encoder, name, group="subfield")
        print(f"{known} texts of triples were encoded")
        with_vectors = embeddings.embedded(triples, store, name, group="subfield")
        out = workflow.retrieve(encode(questions, encoder, "question"), with_vectors, provider(a.provider), a.top_k, Policy(attempts=a.attempts, at_once=a.concurrency))
        writers.write_subjects(out, a.output)
    elif a.stage == "enrich":
        template = readers.read_template(spark, a.template, workflow.PROMPTS["enrich"])
        writers.write_subjects(workflow.enrich(spark.read.parquet(a.input), provider(a.provider), Policy(attempts=a.attempts, at_once=a.concurrency, delay=a.delay), template), a.output)
    elif a.stage == "reason":
        formats = [f for f in a.formats.split(",") if f] or [workflow.DIRECT, *FORMATS]
        n = workflow.reason_into(spark.read.parquet(a.input), a.output, provider(a.provider), formats, a.batch, n=a.max_triples, policy=Policy(attempts=a.attempts, at_once=a.concurrency))
        print(f"{n} samples were left to do")
    elif a.stage == "progress":
        workflow.progress(spark, a.output, spark.read.parquet(a.input).groupBy("subject").agg(F.count("*").alias("total"))).show(100, False)
        workflow.progress_log(spark, a.output).show(100, False)
    elif a.stage == "evaluate":
        cells = evaluate.accuracy(evaluate.long_predictions(spark.read.parquet(a.input).withColumnRenamed("subject", "dataset"))).cache()
        reports = {"detailed": cells, "overall": evaluate.overall(cells), "datasets": evaluate.dataset_summary(cells), "matrix": evaluate.accuracy_matrix(cells), "coverage": evaluate.format_coverage(cells)}
        for name, report in reports.items():
            writers.write_report(report, f"{a.output}/{name}")
    elif a.stage == "build":
        triples = _domains(spark, a.triples).withColumn("pos", F.monotonically_increasing_id())
        isa, other = graph.split_isa(triples)
        edges, labels = graph.simple_digraph(isa), graph.components(isa)
        writers.write_components(edges, labels, graph.component_index(edges, labels), a.output)
        writers.write_batches(other, f"{a.output}/non_isa")
    elif a.stage == "label":
        sample = stats.sample_rows(_domains(spark, a.triples).drop("source_file", "domain"), a.rows, a.seed, readers.TRIPLE)
        names = TAXONOMY[a.domain] if a.domain else [f for f in TAXONOMY]
        labelled = classification.label_triples(sample, provider(a.provider), names, None if a.domain else DEFAULT_FIELD, Policy(attempts=a.attempts, at_once=a.concurrency))
        writers.write_classes(labelled, a.output, "label")
    elif a.stage == "classify":
        triples = cut(_domains(spark, a.triples).withColumn("pos", F.monotonically_increasing_id()), "triples")
        done = classification.classify_triples(_embedded(triples, a.encoder), _prototypes(spark, a.prototypes, a.encoder), a.threshold).drop("vec", "pos", "domain")
        done = cut(done, "classified")
        writers.write_classes(done, a.output, "label")
        stats.class_counts(done, "label", "type").show(100, False)
    elif a.stage == "subclassify":
        rows = spark.read.option("header", True).csv(a.classified).withColumnRenamed("label", "field").drop("label_dir")
        done = cut(classification.sub_classify(_embedded(rows, a.encoder), _prototypes(spark, a.prototypes, a.encoder, "field"), "field", a.threshold).drop("vec", "best_sim"), "subclassified")
        writers.write_classes(done, a.output, "field", "label")
        done.groupBy("field", "label").count().show(1000, False)
    elif a.stage == "merge":
        merged = cut(classification.merge_folder(spark, a.folder), "merged")
        writers.write_report(merged, a.output)
        stats.distinct_counts(merged).show()
    elif a.stage == "connectivity":
        writers.write_report(graph.connectivity(_domains(spark, a.triples), "domain"), a.output)
    elif a.stage == "entities":
        writers.write_entities(graph.entities(_domains(spark, a.triples), "domain"), "domain", a.output)
    elif a.stage == "sample":
        writers.write_sample(stats.sample_exact(readers.read_triples(spark, [a.csv]).drop("source_file"), a.rows, a.seed), a.output)
    elif a.stage == "count":
        facts = readers.file_facts(spark, a.folder)
        facts.drop("header").show(1000, False)
        stats.folder_summary(facts).show()


if __name__ == "__main__":
    main()
