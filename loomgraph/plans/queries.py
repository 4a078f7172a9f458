"""Queries for the operators, over the derived tables; names match those of the SQL in ``oracles``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import render, sqlnames, text
from loomgraph.functions.taxonomy import SUBFIELDS, directory_name, field_of, taxonomy
from loomgraph.operators import evaluate, graph, inference, paths, stats, vectors
from loomgraph.plans import views, workflow
from loomgraph.sources.readers import json_list
from loomgraph.sources.shared import new_dir

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _cells(spark: SparkSession, sf_dir: str, strict: bool = False) -> DataFrame:
    return evaluate.accuracy(evaluate.long_predictions(views.qa_wide(spark, sf_dir)).where(views.qa_filter()), strict)


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


@query
def eval_accuracy_by_dataset_format(spark, sf_dir):
    return _rounded(_cells(spark, sf_dir), "accuracy")


@query
def eval_overall_by_format(spark, sf_dir):
    return _rounded(evaluate.overall(_cells(spark, sf_dir)), "overall_accuracy")


@query
def eval_dataset_summary(spark, sf_dir):
    return _rounded(evaluate.dataset_summary(_cells(spark, sf_dir)), "average_accuracy")


@query
def eval_accuracy_matrix(spark, sf_dir):
    return _rounded(evaluate.accuracy_matrix(_cells(spark, sf_dir)), *evaluate.FORMATS)


@query
def eval_format_coverage(spark, sf_dir):
    return _rounded(evaluate.format_coverage(_cells(spark, sf_dir)), "coverage_percentage")


@query
def eval_dataset_type(spark, sf_dir):
    return evaluate.dataset_type(_cells(spark, sf_dir))


@query
def eval_strict_substring(spark, sf_dir):
    return _rounded(_cells(spark, sf_dir, strict=True), "accuracy")


@query
def eval_origin_bands(spark, sf_dir):
    cells = _cells(spark, sf_dir).select(F.concat_ws("/", "dataset", "prediction_format").alias("dataset"), "accuracy")
    return evaluate.accuracy_bands(cells)


@query
def eval_best_worst(spark, sf_dir):
    cells = _cells(spark, sf_dir).select(F.concat_ws("/", "dataset", "prediction_format").alias("dataset"), F.round("accuracy", 6).alias("accuracy"))
    return evaluate.best_and_worst(cells, 5)


@query
def eval_prediction_coverage(spark, sf_dir):
    return _rounded(evaluate.coverage(_cells(spark, sf_dir)), "coverage").select("dataset", "prediction_format", "coverage")


@query
def matrix_row_mean_rank_group(spark, sf_dir):
    rounded = _rounded(evaluate.accuracy_matrix(_cells(spark, sf_dir)), *evaluate.FORMATS)
    return _rounded(evaluate.matrix_ranking(rounded, evaluate.FORMATS, 2), "row_mean").select("dataset", "row_mean", "rank", "page")


@query
def kg_isa_split(spark, sf_dir):
    triples = views.kg(spark, sf_dir)
    return triples.groupBy("domain").agg(F.count_if(graph.is_isa(F.col("relation"))).alias("isa"), F.count_if(~graph.is_isa(F.col("relation"))).alias("other"))


@query
def kg_isa_dedup(spark, sf_dir):
    isa = graph.split_isa(views.kg(spark, sf_dir))[0]
    twice = isa.unionByName(isa.where("pos % 3 = 0").withColumns({"relation": F.lit("ISA"), "pos": F.col("pos") + 10**9}))
    return graph.simple_digraph(twice)


@query
def kg_components(spark, sf_dir):
    return graph.components(views.kg(spark, sf_dir), "domain")


@query
def kg_component_index(spark, sf_dir):
    """Domains are graphs of their own, so nodes carry their domain's name."""
    own = lambda c: F.concat_ws(":", "domain", c)
    triples = views.kg(spark, sf_dir).withColumns({"head": own("head"), "tail": own("tail")})
    edges = graph.simple_digraph(triples)
    return graph.component_index(edges, graph.components(triples))


@query
def kg_size_histogram(spark, sf_dir):
    sizes = graph.components(views.kg(spark, sf_dir), "domain").groupBy("domain", "component").agg(F.count("*").alias("n"))
    return sizes.groupBy("domain", graph.size_bucket(F.col("n"), labelled=True).alias("bucket")).agg(F.count("*").alias("components"), F.sum("n").alias("nodes"))


def _with_void(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph and a domain that has no complete triple."""
    void = views.table(spark, sf_dir, "region").select(F.lit("void").alias("domain"), F.col("r_name").alias("head"), F.lit("isA").alias("relation"), F.lit(None).cast("string").alias("tail"), F.col("r_regionkey").cast("long").alias("pos"))
    return views.kg(spark, sf_dir).unionByName(void)


@query
def kg_connectivity_by_domain(spark, sf_dir):
    return _rounded(graph.connectivity(_with_void(spark, sf_dir), "domain"), "connectivity_rate")


@query
def kg_connectivity_summary(spark, sf_dir):
    return _rounded(graph.connectivity_summary(graph.connectivity(_with_void(spark, sf_dir), "domain")), "mean_rate")


#: Located in a nation is located in its region; who supplies a part supplies its type; whom an order was placed by is where the order is located.
KG_RULES = inference.Rules(
    inverse={"placedBy": "places", "places": "placedBy", "tradesWith": "tradesWith"},
    hierarchy=inference.DEFAULT_HIERARCHY | {"supplies": "tradesWith"},
    compose=(*inference.Rules().compose, ("Hypernym_locateAt", "Hypernym_isA", "Hypernym_locateAt"), ("placedBy", "Hypernym_locateAt", "Hypernym_locateAt"), ("supplies", "Hypernym_isA", "supplies")),
)


@query
def kg_inferred(spark, sf_dir):
    """All triples that follow over the whole graph, its domains taken together."""
    return inference.infer(views.kg(spark, sf_dir), KG_RULES).drop("round")


@query
def kg_entities(spark, sf_dir):
    return graph.entities(views.kg(spark, sf_dir), "domain")


@query
def kg_entity_totals(spark, sf_dir):
    per = graph.entities(views.kg(spark, sf_dir), "domain").groupBy("domain").agg(F.count("*").alias("entities"))
    return per.unionByName(per.agg(F.lit("(sum)").alias("domain"), F.sum("entities").alias("entities")))


@query
def kg_distinct_counts(spark, sf_dir):
    return stats.distinct_counts(views.kg(spark, sf_dir), "domain")


@query
def kg_sample_stats(spark, sf_dir):
    return stats.sample_stats(views.kg(spark, sf_dir))


@query
def kg_degrees(spark, sf_dir):
    return graph.degrees(views.kg(spark, sf_dir), "domain")


@query
def kg_merge_union(spark, sf_dir):
    parts = {d: views.kg(spark, sf_dir, d).drop("domain") for d in ("geo", "parttype", "brand", "orders", "supply")} | {"customer": views.kg(spark, sf_dir, "customer").drop("domain", "pos").toDF("Head", "Relation", "Tail")}
    return stats.union_all(parts)


@query
def kg_class_counts(spark, sf_dir):
    kind = F.when(graph.is_isa(F.col("relation")), "ISA_Component").otherwise("Non_ISA")
    labelled = views.kg(spark, sf_dir).select(views.subfield_at(F.col("pos")).alias("label"), kind.alias("type"))
    return stats.class_counts(labelled, "label", "type")


@query
def kg_component_classify(spark, sf_dir):
    """The first edge of a component is classified; the class holds for all its edges. Domains are graphs of their own."""
    own = lambda c: F.concat_ws(":", "domain", c)
    triples = views.kg(spark, sf_dir).withColumns({"head": own("head"), "tail": own("tail")}).drop("domain")
    labels = graph.components(triples)
    first = graph.representative_edges(triples, labels)
    embedded = views.vec(spark, sf_dir)
    classes = vectors.prototypes(embedded, ["label"], "vec").select(F.concat(F.lit("class"), F.col("label")).alias("name"), F.col("label").alias("ord"), "prototype")
    number = (F.length("head") * 31 + F.length("tail") * 7) % embedded.count()
    placed = first.withColumn("vec_id", number).join(embedded.select("vec_id", "vec"), "vec_id")
    chosen = vectors.classify(placed, "vec", classes, "name").select("component", F.col("label"))
    # edges are counted before classes are looked up, so a large component is one row of that join
    counted = triples.join(labels, F.col("head") == F.col("node")).groupBy("component").agg(F.count("*").alias("edges"))
    return counted.join(chosen, "component").select("component", "label", "edges")


@query
def kg_paths_bounded(spark, sf_dir):
    """Some names stand between blanks, and each graph has an edge without a head."""
    flat = views.samples(spark, sf_dir).select("id", F.posexplode(F.concat("related", "hierarchical", "enriched")).alias("i", "t")).select("id", "i", "t.*")
    padded = flat.withColumns({"head": F.when(F.col("i") % 2 == 0, F.concat(F.lit(" "), "head", F.lit("\t"))).otherwise(F.col("head")), "tail": F.when(F.col("i") % 3 == 0, F.concat("tail", F.lit("\u3000"))).otherwise(F.col("tail"))})
    blank = flat.where("i = 0").withColumn("head", F.lit("  "))
    return paths.bounded_paths(padded.unionByName(blank), "id")


@query
def triples_cap(spark, sf_dir):
    s = views.samples(spark, sf_dir)
    capped = render.cap_triples(F.col("related"), F.col("hierarchical"), F.col("enriched"), 1)
    return s.select("id", F.array_join(F.transform(capped, lambda x: F.concat_ws("|", x["h"], x["r"], x["t"])), ";").alias("triples"))


def _rendered(name):
    def run(spark, sf_dir):
        s = views.samples(spark, sf_dir)
        short = F.transform(F.concat("related", "hierarchical", "enriched"), lambda x: F.struct(x["head"].alias("h"), x["relation"].alias("r"), x["tail"].alias("t")))
        return s.select("id", short.alias("__t")).select("id", render.render(name, F.col("__t")).alias("text"))

    return run


QUERIES |= {f"render_{'graphml' if f == 'code' else f}": _rendered(f) for f in render.FORMATS}


@query
def vec_prototypes(spark, sf_dir):
    return vectors.prototypes(views.vec(spark, sf_dir), ["label"], "vec").select("label", F.posexplode("prototype").alias("i", "v")).select("label", "i", F.round("v", 6).alias("v"))


@query
def vec_classify(spark, sf_dir):
    v = views.vec(spark, sf_dir)
    classes = vectors.prototypes(v, ["label"], "vec").select(F.concat(F.lit("class"), F.col("label")).alias("name"), F.col("label").alias("ord"), "prototype")
    return _rounded(vectors.classify(v.select("vec_id", "vec"), "vec", classes, "name", 0.3), "best_sim").select("vec_id", "best_sim", "label")


@query
def vec_topk(spark, sf_dir):
    v = views.vec(spark, sf_dir)
    asked = v.where("is_query").select(F.col("vec_id").alias("question_id"), F.col("vec").alias("q"), F.array(F.lit("all")).alias("subfields"))
    rest = v.select(F.col("vec_id").alias("triple_id"), F.lit("all").alias("subfield"), F.col("vec").alias("x"))
    return _rounded(vectors.routed_top_k(asked, rest, 10, own=False), "similarity")


@query
def retrieve_routed_topk(spark, sf_dir):
    v = views.vec(spark, sf_dir)
    sub = F.concat(F.lit("s"), F.col("label"))
    routes = F.array(sub, F.concat(F.lit("s"), (F.col("label") + 3) % 12))
    asked = v.where("is_query").select(F.col("vec_id").alias("question_id"), F.col("vec").alias("q"), routes.alias("subfields"))
    rest = v.select(F.col("vec_id").alias("triple_id"), sub.alias("subfield"), F.col("vec").alias("x"))
    return _rounded(vectors.routed_top_k(asked, rest, 7, own=False), "similarity")


@query
def parse_router_strict(spark, sf_dir):
    return views.responses(spark, sf_dir).select("id", F.array_join(text.parse_router(F.col("response")), "|").alias("subfields"))


@query
def parse_router_lenient(spark, sf_dir):
    return views.responses(spark, sf_dir).select("id", F.array_join(text.parse_router(F.col("response"), strict=False), "|").alias("subfields"))


@query
def parse_labels(spark, sf_dir):
    r = views.responses(spark, sf_dir)
    return r.select("id", F.array_join(text.bracket_labels(F.col("response"), SUBFIELDS), "|").alias("labels"), F.array_join(text.bracket_labels(F.col("response"), SUBFIELDS, None), "|").alias("labels_or_none"))


@query
def parse_answer(spark, sf_dir):
    k = F.col("id")
    wide = views.qa_wide(spark, sf_dir)
    said = F.concat(F.coalesce("edgetable_prediction", F.lit("")), F.when(k % 5 == 0, F.lit(" so B or D.")).otherwise(F.lit(" no letter: ABBA")))
    return wide.select("id", text.parse_answer(F.when(k % 11 != 0, said)).alias("answer"))


@query
def parse_enrichment(spark, sf_dir):
    parsed = text.parse_enrichment(views.enrichment_responses(spark, sf_dir), "id", "response")
    flat = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws("|", x["head"], x["relation"], x["tail"])), ";")
    return parsed.select("id", flat("enrich_triples").alias("enriched"), flat("hierarchical_enhancements").alias("hierarchical"))


@query
def format_question_options(spark, sf_dir):
    k = F.col("p_partkey")
    options = {"A": F.col("p_brand"), "B": F.when(k % 3 != 0, F.col("p_type")), "C": F.when(k % 4 == 0, F.lit("  ")).otherwise(F.lit("c")), "D": F.lit("")}
    return views.table(spark, sf_dir, "part").select(k.alias("id"), text.question_with_options(F.col("p_name"), options).alias("question"))


@query
def format_prompt_triples(spark, sf_dir):
    s = views.samples(spark, sf_dir)
    scored = F.transform("related", lambda x, i: F.struct(x["head"].alias("head"), x["relation"].alias("relation"), x["tail"].alias("tail"), F.when(i % 2 == 0, (F.col("id") % 9 + i) / 8.1).alias("similarity")))
    return s.select("id", text.format_triples(F.when(F.col("id") % 5 != 0, scored)).alias("triples"))


@query
def row_counts(spark, sf_dir):
    names = ("region", "nation", "customer", "orders", "documents")
    files = {n: stats.row_counts(views.table(spark, sf_dir, n)) for n in names}
    return stats.union_all(files, "table_name").groupBy("table_name").agg(F.sum("rows").alias("rows"))


@query
def latency_percentiles(spark, sf_dir):
    return _rounded(stats.latency(views.table(spark, sf_dir, "events"), "value", "event_type"), "mean")


@query
def call_success_stats(spark, sf_dir):
    e = views.table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 7 == 0, "timeout").otherwise("ok").alias("status"), (F.col("event_id") % 3 + 1).cast("int").alias("attempts"))
    return _rounded(stats.call_stats(e), "success_rate")


@query
def call_throughput(spark, sf_dir):
    """Calls that begin ten a second and take as long as their value."""
    e = views.table(spark, sf_dir, "events").select("event_type", F.when(F.col("event_id") % 7 == 0, "timeout").otherwise("ok").alias("status"), (F.col("event_id") / 10.0).alias("began"), F.abs("value").alias("seconds"))
    return _rounded(stats.throughput(e, "began", "seconds", "event_type"), "elapsed", "qps")


@query
def sample_exact_n(spark, sf_dir):
    return stats.sample_exact(views.kg(spark, sf_dir), 50, seed=7)


@query
def sample_half(spark, sf_dir):
    """Half of the rows, taken where they are."""
    whole = views.kg(spark, sf_dir)
    return stats.sample_exact(whole, whole.count() // 2, seed=11)


@query
def sample_remainder(spark, sf_dir):
    """The rows whose keys a sample doesn't hold."""
    whole = views.kg(spark, sf_dir)
    taken = stats.sample_exact(whole, 50, seed=7)
    return stats.remainder(whole, taken, ["domain", "pos"]).agg(F.count("*").alias("rest")).crossJoin(taken.agg(F.count("*").alias("taken")))


@query
def taxonomy_lookup(spark, sf_dir):
    """The subfield of every part with its field and folders, by the table of the taxonomy and by its function."""
    parts = views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), views.subfield_at(F.col("p_partkey")).alias("subfield"))
    found = parts.join(taxonomy(spark), "subfield")
    return found.withColumn("looked_up", field_of(F.col("subfield"))).withColumn("unknown", field_of(F.concat(F.col("subfield"), F.lit("?"))))


@query
def field_directories(spark, sf_dir):
    p = views.table(spark, sf_dir, "part").select("p_partkey", "p_type")
    return p.select(F.col("p_partkey").alias("id"), directory_name(F.concat(F.col("p_type"), F.lit(" & Co"))).alias("dir"))


@query
def textualized_triples(spark, sf_dir):
    k = views.kg(spark, sf_dir).withColumn("relation", F.when(F.col("pos") % 4 != 0, F.col("relation")))
    h, r, t = (F.col(c) for c in ("head", "relation", "tail"))
    return k.select("domain", "pos", text.textualize(h, r, t).alias("retrieval"), text.textualize(h, r, t, " -> ").alias("classification"))


@query
def json_triple_lists(spark, sf_dir):
    raw = F.when(F.col("p_partkey") % 3 == 0, F.lit("not json")).otherwise(F.concat(F.lit('[{"h":"'), F.col("p_brand"), F.lit('","r":"is","t":"x"}]')))
    p = views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), json_list(raw, "array<struct<h:string,r:string,t:string>>").alias("x"))
    return p.select("id", F.size("x").alias("n"), F.try_element_at("x", F.lit(1))["h"].alias("first_head"))


@query
def resume_equivalence(spark, sf_dir):
    """Half the samples done before, the rest found by their keys: together each sample once."""
    wide = views.qa_wide(spark, sf_dir).select("dataset", "id", F.coalesce("origin_prediction", F.lit("")).alias("prediction"))
    path = new_dir(spark, "done")
    wide.where("id % 2 = 0").write.parquet(path)
    done, rest = spark.read.parquet(path), workflow.pending(wide, path, ("dataset", "id"))
    whole = done.withColumn("part", F.lit("done")).unionByName(rest.withColumn("part", F.lit("rest")))
    return whole.groupBy("dataset", "part").agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"))


@query
def workflow_progress(spark, sf_dir):
    """A third of the samples done; subjects without any count too."""
    subjects = views.qa_wide(spark, sf_dir).select(F.col("dataset").alias("subject"), "id")
    path = new_dir(spark, "progress")
    subjects.where("id % 3 = 0").write.partitionBy("subject").parquet(path)
    totals = subjects.groupBy("subject").agg(F.count("*").alias("total"))
    return _rounded(workflow.progress(spark, path, totals), "percentage")


@query
def reason_caps(spark, sf_dir):
    """Caps over the columns as the stages store them: structs of five and four fields, and JSON text with capitalised keys."""
    s = views.samples(spark, sf_dir)
    wider = lambda c, *more: F.transform(c, lambda x: F.struct(x["head"].alias("head"), x["relation"].alias("relation"), x["tail"].alias("tail"), *[F.lit(0.5).alias(m) for m in more]))
    capital = F.to_json(F.transform("enriched", lambda x: F.struct(x["head"].alias("Head"), x["relation"].alias("Relation"), x["tail"].alias("Tail"))))
    stored = s.select("id", wider("related", "text", "similarity").alias("relatedTriples"), wider("hierarchical", "source").alias("hierarchical_enhancements"), capital.alias("enrich_triples"))
    capped = render.cap_triples(*workflow.triple_columns(stored), 2)
    return stored.select("id", F.array_join(F.transform(capped, lambda x: F.concat_ws("|", x["h"], x["r"], x["t"])), ";").alias("triples"))


@query
def scalar_accessors(spark, sf_dir):
    k = F.col("p_partkey")
    one, many = F.when(k % 3 != 0, F.col("p_brand")), F.when(k % 4 != 0, F.array("p_name", "p_type")).otherwise(F.array().cast("array<string>"))
    return views.table(spark, sf_dir, "part").select(k.alias("id"), text.scalar(one).alias("scalar_text"), text.scalar(many, "array<string>").alias("scalar_list"), text.present(one).alias("present_text"), text.present(many, "array<string>").alias("present_list"))


@query
def sql_router(spark, sf_dir):
    """The router's parser called from SQL text."""
    sqlnames.register(spark)
    return spark.sql("SELECT id, array_join(loom_parse_router(response), '|') AS subfields FROM {r}", r=views.responses(spark, sf_dir))


@query
def sql_answers(spark, sf_dir):
    """Accuracy of each dataset and format by SQL text."""
    sqlnames.register(spark)
    long = evaluate.long_predictions(views.qa_wide(spark, sf_dir)).where(views.qa_filter())
    return spark.sql("""
        WITH judged AS (SELECT dataset, prediction_format, loom_valid_prediction(prediction) AS valid, loom_answer_matches(answer, prediction) AS right FROM {p})
        SELECT dataset, prediction_format, count_if(valid AND right) AS correct_count, count_if(valid) AS valid_total, count(*) AS total_samples, round(coalesce(try_divide(double(count_if(valid AND right)), double(count_if(valid))), 0.0D), 6) AS accuracy
        FROM judged GROUP BY dataset, prediction_format""", p=long)


def _sql_rendered(name):
    def run(spark, sf_dir):
        sqlnames.register(spark)
        s = views.samples(spark, sf_dir)
        short = F.transform(F.concat("related", "hierarchical", "enriched"), lambda x: F.struct(x["head"].alias("h"), x["relation"].alias("r"), x["tail"].alias("t")))
        return spark.sql(f"SELECT id, loom_render_{name}(t) AS text FROM {{s}}", s=s.select("id", short.alias("t")))

    return run


QUERIES |= {f"sql_render_{'graphml' if f == 'code' else f}": _sql_rendered(f) for f in render.FORMATS}
