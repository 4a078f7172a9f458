"""The stages from questions to predictions: retrieve, enrich, reason; each resumes where it stopped."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.render import FORMATS, cap_triples, json_triples, render
from loomgraph.functions.taxonomy import SUBFIELDS
from loomgraph.functions.text import OPTIONS, PROMPTS, format_triples, parse_answer, parse_enrichment, parse_router, prompt, question_with_options
from loomgraph.operators.vectors import routed_top_k
from loomgraph.plans.providers import Policy, Provider, call_lists, call_provider, spread
from loomgraph.sources.readers import exists
from loomgraph.sources.shared import cut, drop, new_dir, remove

DIRECT = "origin"
LOG = "batch long, processed long, total long, percentage double, at timestamp"
ENRICHED = "array<struct<head:string,relation:string,tail:string,source:string>>"


def check_formats(formats: list[str]) -> None:
    """Unknown formats end the run before any call is made."""
    if unknown := [f for f in formats if f not in [*FORMATS, DIRECT]]:
        raise ValueError(f"unknown formats: {', '.join(unknown)}")


def pending(rows: DataFrame, path: str, keys: tuple[str, ...] = ("subject", "id")) -> DataFrame:
    """Rows whose keys aren't in the output yet, null ones included; all when there is none."""
    spark = rows.sparkSession
    if not exists(spark, path):
        return rows
    seen = spark.read.parquet(path).select(*[F.col(k).alias(f"__seen_{k}") for k in keys])
    return rows.join(seen, [F.col(k).eqNullSafe(F.col(f"__seen_{k}")) for k in keys], "left_anti")


def progress(spark: SparkSession, path: str, totals: DataFrame) -> DataFrame:
    """``subject, processed, total, percentage``, from what the output holds."""
    seen = spark.read.parquet(path).select("subject") if exists(spark, path) else spark.createDataFrame([], "subject string")
    done = seen.groupBy("subject").agg(F.count("*").alias("processed"))
    out = totals.join(done, "subject", "left").withColumn("processed", F.coalesce("processed", F.lit(0)))
    return out.withColumn("percentage", F.coalesce(F.try_divide(100.0 * F.col("processed"), F.col("total")), F.lit(0.0))).select("subject", "processed", "total", "percentage")


def log_progress(spark: SparkSession, path: str, batch: int, processed: int, total: int | None) -> None:
    """Append a row with the time to the progress table beside an output; a table of its own, so that reading the output is not disturbed."""
    row = (batch, processed, total, None if total is None else 100.0 * processed / total if total else 0.0, datetime.now(timezone.utc))
    fields = [f.split() for f in LOG.split(", ")]
    spark.range(1).coalesce(1).select(*[F.lit(v).cast(kind).alias(name) for v, (name, kind) in zip(row, fields, strict=True)]).write.mode("append").parquet(f"{path.rstrip('/')}_progress")


def progress_log(spark: SparkSession, path: str) -> DataFrame:
    """``batch, processed, total, percentage, at`` of an output, by time; none when nothing has been logged."""
    log = f"{path.rstrip('/')}_progress"
    return (spark.read.schema(LOG).parquet(log) if exists(spark, log) else spark.createDataFrame([], LOG)).orderBy("at", "batch")


def retrieve(questions: DataFrame, triples: DataFrame, router: Provider, k: int = 100, policy: Policy | None = None, strict: bool = True) -> DataFrame:
    """Questions with ``subdomains`` and ``relatedTriples``.

    questions: ``subject, id, question, vec, ...``; triples: ``triple_id, subfield, head, relation, tail, text, vec``. A question
    whose routing fails goes to ``other``; one without triples gets an empty list.
    """
    asked = questions.withColumn("prompt", prompt(PROMPTS["route"], labels=F.lit(", ".join(SUBFIELDS)), question=F.col("question")))
    routed = cut(call_provider(asked, router, policy=policy).withColumn("subdomains", parse_router(F.col("response"), strict)).drop("prompt", "response", "status", "attempts"), "routed")
    key = F.struct("subject", "id")
    best = routed_top_k(routed.select(key.alias("question_id"), F.col("vec").alias("q"), F.col("subdomains").alias("subfields")), triples.select("triple_id", "subfield", F.col("vec").alias("x")), k)
    named = best.join(triples.select("triple_id", "head", "relation", "tail", "text"), "triple_id")
    listed = named.groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.struct("head", "relation", "tail", "text", "similarity").alias("t")))), lambda x: x["t"]).alias("relatedTriples"))
    out = routed.join(listed.select("question_id.*", "relatedTriples"), ["subject", "id"], "left").drop("vec")
    return out.withColumn("relatedTriples", F.coalesce("relatedTriples", F.array().cast("array<struct<head:string,relation:string,tail:string,text:string,similarity:double>>")))


def enrich(retrieved: DataFrame, model: Provider, policy: Policy | None = None, template: str = PROMPTS["enrich"]) -> DataFrame:
    """With ``enrich_triples, hierarchical_enhancements, enrichment_raw_response``; empty where the call failed."""
    if missing := {"question", "relatedTriples"} - set(retrieved.columns):
        raise ValueError(f"missing columns: {', '.join(sorted(missing))}")
    asked = retrieved.withColumn("prompt", prompt(template, question=F.col("question"), triples=format_triples(F.col("relatedTriples"))))
    called = cut(call_provider(asked, model, policy=policy).withColumnRenamed("response", "enrichment_raw_response").drop("prompt", "status", "attempts").withColumn("__key", F.struct("subject", "id")), "enriched")
    parsed = parse_enrichment(called, "__key", "enrichment_raw_response")
    empty = F.array().cast(ENRICHED)
    return called.join(parsed, "__key", "left").drop("__key").withColumns({c: F.coalesce(F.col(c), empty) for c in ("enrich_triples", "hierarchical_enhancements")})


def triple_columns(samples: DataFrame) -> list[Column]:
    """The three sources of triples as lists of structs, whether they are stored so or as JSON text."""
    text = {f.name for f in samples.schema if f.dataType.simpleString() == "string"}
    return [json_triples(F.col(c)) if c in text else F.col(c) for c in ("relatedTriples", "hierarchical_enhancements", "enrich_triples")]


def reason(samples: DataFrame, model: Provider, formats: list[str] | None = None, n: int = 10, policy: Policy | None = None) -> DataFrame:
    """A row for each sample with ``<format>_knowledge, _prompt, _prediction, _response``, ``origin_prediction, _response`` and ``triple_count``.

    Samples are dealt over all tasks and carry their prompts as a list, so nothing is shuffled or joined again and equal keys are rows of their own; a blank knowledge text is not asked about.
    """
    formats = formats or [DIRECT, *FORMATS]
    check_formats(formats)
    options = {k: F.col(k) for k in OPTIONS if k in samples.columns}
    base = spread(samples).withColumn("__q", question_with_options(F.col("question"), options)).withColumn("__t", cap_triples(*triple_columns(samples), n))
    base = base.withColumn("triple_count", F.size("__t")).withColumns({f"{f}_knowledge": render(f, F.col("__t")) for f in formats if f != DIRECT})
    known = lambda f: F.when(F.col(f"{f}_knowledge") != "", prompt(PROMPTS["qa_knowledge"], question=F.col("__q"), knowledge=F.col(f"{f}_knowledge"))).otherwise("")
    asked = base.withColumn("__p", F.array(*[prompt(PROMPTS["qa"], question=F.col("__q")) if f == DIRECT else known(f) for f in formats]))
    answered = call_lists(asked.drop("__q", "__t", "relatedTriples", "hierarchical_enhancements", "enrich_triples"), model, "__p", "__r", policy)
    made = {f"{f}_{c}" for f in formats for c in ("knowledge", "prompt", "prediction", "response")}
    own = [c for c in answered.columns if c not in made and c not in ("__p", "__r", "subject", "id")]
    wide = []
    for i, f in enumerate(formats):
        wide += [] if f == DIRECT else [F.col(f"{f}_knowledge")]
        wide += [F.col("__p")[i].alias(f"{f}_prompt"), parse_answer(F.col("__r")[i]).alias(f"{f}_prediction"), F.col("__r")[i].alias(f"{f}_response")]
    return answered.select("subject", "id", *own, *wide)


def reason_into(samples: DataFrame, path: str, model: Provider, formats: list[str] | None = None, batch: int = 10_000, **options) -> int:
    """Reason about what the output lacks and append it batch by batch; the number of samples that were left to do.

    A batch of about ``batch`` samples, dealt by a hash of their keys, is in the output as soon as it ends, so that a run that
    breaks off loses the calls of one batch at most; the next run takes what is missing. Each batch leaves a row in the progress table.
    """
    check_formats(formats or FORMATS)
    spark, key = samples.sparkSession, [F.col("subject"), F.col("id")]
    left = cut(pending(samples, path), "pending")
    n = left.count()
    if not n:
        drop(left)
        return n
    # a folder for each batch, so that a batch reads its own rows and not all that is left
    batches, seen, dealt = -(-n // batch), 0, new_dir(spark, "batches")
    salts = max(1, 3 * spark.sparkContext.defaultParallelism // batches)
    numbered = left.withColumn("__batch", F.pmod(F.xxhash64(*key), F.lit(batches)))
    numbered.repartition("__batch", F.pmod(F.xxhash64(F.lit(1), *key), F.lit(salts))).write.partitionBy("__batch").parquet(dealt)
    drop(left)
    sizes = {r[0]: r[1] for r in spark.read.parquet(dealt).groupBy("__batch").count().collect()}
    ready = lambda k: reason(spark.read.schema(left.schema).parquet(f"{dealt}/__batch={k}"), model, formats, **options) if k in sizes else None
    # planning a batch and logging the last one take as long as a small batch itself, so they go on beside it; calls are made for one batch at a time
    with ThreadPoolExecutor(1) as beside:
        planned, logged = beside.submit(ready, 0), []
        for k in range(batches):
            part, planned = planned.result(), beside.submit(ready, k + 1)
            if part is not None:
                part.write.mode("append").partitionBy("subject").parquet(path)
                seen += sizes[k]
            logged.append(beside.submit(log_progress, spark, path, k, seen, n))
        for row in logged:
            row.result()
    remove(spark, dealt)
    return n
