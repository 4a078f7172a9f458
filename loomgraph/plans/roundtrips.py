"""Queries for sources, sinks, providers and stages: tables are written by a sink, read back by a source, and compared with SQL over the tables."""

from __future__ import annotations

import time

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.render import FORMATS
from loomgraph.functions.taxonomy import SUBFIELDS
from loomgraph.functions import text as text_functions
from loomgraph.functions.text import PROMPTS, prompt
from loomgraph.operators import graph, stats, vectors
from loomgraph.plans import classification, embeddings, views, workflow
from loomgraph.plans.oracles import BUCKET, CC, ISA, KG, PROTO, SAMPLE_LINES, VEC
from loomgraph.plans.providers import KeyedClient, Policy, Reply, RuleProvider, call_provider
from loomgraph.sources import readers, writers
from loomgraph.sources.shared import new_dir

QUERIES = {}
ORACLE_SQL = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _csv(df: DataFrame, path: str) -> list[str]:
    df.write.option("header", True).csv(path)
    return readers.listing(df.sparkSession, path, ".csv")


@query(f"WITH {KG} SELECT head, relation, tail FROM kg")
def scan_triples_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV files with capitalised and lower-case headers, some without the columns, read as triples."""
    base, kg = new_dir(spark, "csv"), views.kg(spark, sf_dir)
    files = _csv(kg.where("domain in ('geo', 'customer')").select(F.col("head").alias("Head"), F.col("relation").alias("Relation"), F.col("tail").alias("Tail")), f"{base}/a")
    files += _csv(kg.where("domain not in ('geo', 'customer')").select("tail", "head", "relation", "pos"), f"{base}/b")
    files += _csv(views.table(spark, sf_dir, "region").select("r_regionkey", "r_name"), f"{base}/c")
    return readers.read_triples(spark, files).select("head", "relation", "tail")


@query("SELECT c_custkey::VARCHAR AS id, c_name AS title FROM customer")
def scan_positional(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_dir(spark, "csv")
    _csv(views.table(spark, sf_dir, "customer").select("c_custkey", "c_name"), path)
    return readers.read_positional(spark, path, ["id", "title"])


@query("""SELECT p_partkey::VARCHAR AS id, CASE WHEN p_partkey % 5 <> 0 THEN 'line one' || chr(10) || '"' || p_name || '", two' END AS said FROM part""")
def scan_csv_quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes, commas and line breaks inside fields, and tokens that mean a missing value."""
    k, path = F.col("p_partkey"), new_dir(spark, "csv")
    said = F.when(k % 5 != 0, F.concat(F.lit('line one\n"'), F.col("p_name"), F.lit('", two'))).otherwise(F.lit("NaN"))
    views.table(spark, sf_dir, "part").select(k.alias("id"), said.alias("said")).write.option("header", True).option("escape", '"').csv(path)
    return readers.read_csv(spark, path)


@query(f"WITH {KG} SELECT CASE domain WHEN 'geo' THEN 'law' WHEN 'brand' THEN 'economics' ELSE 'other' END AS subfield, head, relation, tail, head || ' ' || relation || ' ' || tail AS text FROM kg WHERE domain IN ('geo', 'brand', 'customer')")
def scan_subfields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders of subfields: one with a merged file beside its parts, one with parts only, and the file of the rest."""
    base, kg = new_dir(spark, "subfields"), views.kg(spark, sf_dir).select("domain", "head", "relation", "tail")
    place = {"law": None, "economics": None}
    for field, subs in readers.TAXONOMY.items():
        for sub in subs:
            if sub in place:
                place[sub] = f"{base}/{field.replace(' & ', '_').replace(' ', '_').lower()}/{sub}"
    _csv(kg.where("domain = 'geo'").drop("domain").coalesce(1), f"{place["law"]}/law_all.csv")
    _csv(kg.where("domain = 'orders'").drop("domain").coalesce(1), f"{place["law"]}/part_1.csv")
    _csv(kg.where("domain = 'brand'").drop("domain").coalesce(1), place["economics"])
    rest = _csv(kg.where("domain = 'customer'").select(F.col("head").alias("Head"), F.col("relation").alias("Relation"), F.col("tail").alias("Tail")).coalesce(1), f"{base}/rest")
    return readers.load_subfield_triples(spark, base, rest[0])


@query("SELECT o_orderpriority || ' 50%+x' AS subject, o_orderkey AS id, 'q' || o_orderkey AS question, CASE WHEN o_orderkey % 2 = 0 THEN 'x' END AS \"A\", NULL::VARCHAR AS \"H\" FROM orders")
def scan_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders of subjects, their names with blanks and signs, in one scan; options that no file has are null."""
    path, k = new_dir(spark, "subjects"), F.col("o_orderkey")
    writers.write_subjects(views.table(spark, sf_dir, "orders").select(F.concat("o_orderpriority", F.lit(" 50%+x")).alias("subject"), k.alias("id"), F.concat(F.lit("q"), k.cast("string")).alias("question"), F.when(k % 2 == 0, "x").alias("A")), path)
    return readers.read_questions(spark, path, "*.parquet").select("subject", "id", "question", "A", "H")


@query("SELECT o_orderkey AS id, o_orderpriority AS dataset FROM orders UNION ALL SELECT n_nationkey, n_name FROM nation")
def scan_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One object a line, and a whole file that is a list of objects."""
    path, schema = new_dir(spark, "json"), "id bigint, dataset string"
    writers.as_json(views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("dataset")), "value").write.text(f"{path}/lines")
    nations = views.table(spark, sf_dir, "nation").select(F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("dataset")).alias("x"))
    nations.agg(F.to_json(F.collect_list("x")).alias("value")).write.text(f"{path}/list")
    return readers.read_json(spark, f"{path}/lines", schema, lines=True).unionByName(readers.read_json(spark, f"{path}/list", schema))


STORE_SQL = f"""{CC}, whole AS (SELECT domain || ':' || component AS component, domain || ':' || node AS node FROM cc), n AS (SELECT component, count(*) AS node_count FROM whole GROUP BY 1),
    ed AS (SELECT domain || ':' || head AS src, domain || ':' || tail AS dst, arg_max(relation, pos) AS relation FROM kg GROUP BY ALL),
    s AS (SELECT src, dst, relation, component, {BUCKET.format(n='node_count', a='', b='', c='', d='')} AS size_group FROM ed JOIN whole ON node = src JOIN n USING (component))"""


def _store(spark: SparkSession, sf_dir: str) -> str:
    own = lambda c: F.concat_ws(":", "domain", c)
    triples = views.kg(spark, sf_dir).withColumns({"head": own("head"), "tail": own("tail")})
    edges, labels, path = graph.simple_digraph(triples), graph.components(triples), new_dir(spark, "store")
    writers.write_components(edges, labels, graph.component_index(edges, labels), path)
    return path


@query(f"WITH RECURSIVE {STORE_SQL} SELECT * FROM s")
def component_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges written by size group and read again, each group by its partition."""
    path = _store(spark, sf_dir)
    parts = [readers.read_components(spark, path, g) for g in ("large", "medium", "small", "tiny")]
    return stats.union_all(dict(zip("lmst", parts, strict=True))).drop("source_file").select("src", "dst", "relation", "component", "size_group")


@query(f"WITH RECURSIVE {STORE_SQL} SELECT src, dst, relation FROM s WHERE component = (SELECT min(component) FROM s)")
def component_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One component, rebuilt from the partition and files that the index names."""
    path = _store(spark, sf_dir)
    name = spark.read.parquet(f"{path}/index").agg(F.min("component")).first()[0]
    return readers.read_component(spark, path, name).select("src", "dst", "relation")


@query("SELECT lower(replace(replace(p_type, ' & ', '_'), ' ', '_')) AS type_dir, lower(replace(replace(p_brand, ' & ', '_'), ' ', '_')) AS brand_dir, count(*) AS n, min(p_partkey) AS first FROM part GROUP BY ALL")
def class_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV files by class and subclass folder, counted by folder."""
    path = new_dir(spark, "classes")
    writers.write_classes(views.table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("type"), F.col("p_brand").alias("brand")).repartition(2, "type"), path, "type", "brand")
    read = spark.read.option("header", True).csv(path)
    return read.groupBy("type_dir", "brand_dir").agg(F.count("*").alias("n"), F.min(F.col("p_partkey").cast("long")).alias("first"))


@query("SELECT lower(replace(l, ' ', '_')) AS label, count(*) AS n FROM (SELECT unnest([p_brand, p_type, p_brand]) AS l FROM part) GROUP BY 1")
def label_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each label, also for one that is given twice."""
    path = new_dir(spark, "labels")
    writers.write_labels(views.table(spark, sf_dir, "part").select("p_partkey", F.array("p_brand", "p_type", "p_brand").alias("labels")).coalesce(2), path, "labels")
    return spark.read.option("header", True).csv(path).groupBy("label").agg(F.count("*").alias("n"))


@query(f"WITH {KG}, ent AS (SELECT DISTINCT domain, trim(x) AS entity FROM (SELECT domain, unnest([head, tail]) AS x FROM kg)) SELECT domain, entity AS value FROM ent")
def entity_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_dir(spark, "entities")
    writers.write_entities(graph.entities(views.kg(spark, sf_dir), "domain"), "domain", path)
    return spark.read.text(path).select("domain", "value")


def _folder(spark: SparkSession, sf_dir: str) -> str:
    """CSV files with a header, one without, one that has no rows and one that is no text."""
    base = new_dir(spark, "folder")
    for t in ("region", "nation", "customer"):
        writers.write_report(views.table(spark, sf_dir, t), f"{base}/{t}")
    views.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").coalesce(1).write.csv(f"{base}/bare")
    writers.write_report(views.table(spark, sf_dir, "region").where("false"), f"{base}/none")
    views.table(spark, sf_dir, "region").select(F.decode(F.encode(F.lit("a,b"), "utf-8"), "utf-8").alias("value")).limit(1).coalesce(1).write.option("encoding", "UTF-16").option("header", True).csv(f"{base}/broken")
    return base


@query("SELECT 6::BIGINT AS files, 4::BIGINT AS ok, 2::BIGINT AS failed, sum(n)::BIGINT AS rows, true AS size_agrees FROM (SELECT count(*) AS n FROM region UNION ALL SELECT count(*) FROM nation UNION ALL SELECT count(*) FROM customer UNION ALL SELECT count(*) - 1 FROM orders)")
def folder_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files, rows, failures and MB of a folder, of which one file is no text; the size is the one that the file system gives."""
    base = _folder(spark, sf_dir)
    size = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").load(base).agg(F.sum("length")).first()[0]
    return stats.folder_summary(readers.file_facts(spark, base)).withColumn("size_agrees", F.abs(F.col("mb") * (1 << 20) - size) < 1).drop("mb")


@query("""SELECT status, has_header, count(*) AS files, sum(n)::BIGINT AS rows, max(columns) AS columns FROM (SELECT 'ok' AS status, true AS has_header, count(*) AS n, 5 AS columns FROM customer UNION ALL SELECT 'ok', true, count(*), 3 FROM region UNION ALL SELECT 'ok', true, count(*), 3 FROM nation UNION ALL SELECT 'ok', false, count(*) - 1, NULL FROM orders) GROUP BY ALL""")
def header_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readable files by whether their first row is a header."""
    facts = readers.file_facts(spark, _folder(spark, sf_dir)).where("status = 'ok'")
    return facts.groupBy("status", "has_header").agg(F.count("*").alias("files"), F.sum("rows").alias("rows"), F.max(F.size("header")).alias("columns"))


@query("""SELECT 'part' AS file, count(*) AS rows, count(*) + 1 AS records, count(*) + 1 + count(*) FILTER (p_partkey % 5 <> 0) AS lines, count(*) + 1 + count(*) FILTER (p_partkey % 5 <> 0) AS line_breaks FROM part
    UNION ALL SELECT 'nation', count(*), count(*) + 1, count(*) + 1, count(*) + 1 FROM nation""")
def counting_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four ways to count two files, of which one has line breaks inside fields."""
    base, k = new_dir(spark, "lines"), F.col("p_partkey")
    said = F.when(k % 5 != 0, F.concat(F.lit('one\n"'), F.col("p_name"), F.lit('", two'))).otherwise(F.lit("x"))
    views.table(spark, sf_dir, "part").select(k.alias("id"), said.alias("said")).coalesce(1).write.option("header", True).option("escape", '"').csv(f"{base}/part")
    writers.write_report(views.table(spark, sf_dir, "nation").select("n_nationkey"), f"{base}/nation")
    found = readers.count_methods(spark, readers.listing(spark, base, ".csv", recursive=True))
    return found.withColumn("file", F.element_at(F.split("file", "/"), -2))


@query(f"WITH {KG}, r AS (SELECT head, CASE WHEN pos % 2 = 0 THEN relation END AS relation, tail, pos FROM kg), s AS (SELECT * FROM r ORDER BY md5(concat_ws(chr(1), '3', head, relation, tail, pos)), head, pos LIMIT 40) SELECT head, relation, tail FROM s WHERE relation IS NOT NULL")
def sample_then_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample whose incomplete rows go afterwards, written as one file and read again."""
    path = new_dir(spark, "sample")
    rows = views.kg(spark, sf_dir).select("head", F.when(F.col("pos") % 2 == 0, F.col("relation")).alias("relation"), "tail", "pos")
    writers.write_sample(stats.sample_rows(rows, 40, 3, ["relation"]).drop("pos"), path)
    return readers.read_csv(spark, path)


@query(f"""SELECT p_partkey AS id, replace(replace('{PROMPTS["qa_knowledge"].replace("'", "''")}', '{{question}}', p_name), '{{knowledge}}', p_type) AS prompt FROM part""")
def prompt_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), prompt(PROMPTS["qa_knowledge"], question=F.col("p_name"), knowledge=F.col("p_type")).alias("prompt"))


def _serve(text: str, key: str) -> Reply:
    """A service that refuses one of its keys; some texts hang, some are unknown, some break it, some get no answer, and each is put off once."""
    if text.startswith("~"):
        time.sleep(2)
    if text.startswith(("!", "?", "-")):
        return Reply({"!": 404, "?": 500, "-": 200}[text[0]])
    if key == "revoked":
        return Reply(401)
    if text not in _asked:
        _asked.add(text)
        return Reply(429, retry_after=0.001)
    return Reply(200, text.upper()[::-1])


#: What a worker's service has been asked before.
_asked: set[str] = set()


@query("""WITH p AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 29 = 5 THEN '~' WHEN p_partkey % 11 = 1 THEN '!' WHEN p_partkey % 11 = 2 THEN '?' WHEN p_partkey % 11 = 3 THEN '-' ELSE '' END AS mark, CASE WHEN p_partkey % 6 <> 0 THEN p_name ELSE ' ' END AS name FROM part),
    s AS (SELECT id, name, CASE WHEN trim(mark || name) = '' THEN 'empty' WHEN mark = '~' THEN 'timeout' WHEN mark = '!' THEN 'http_404' WHEN mark = '?' THEN 'http_500' WHEN mark = '-' THEN 'blank' ELSE 'ok' END AS status FROM p)
    SELECT id, CASE WHEN status = 'ok' THEN reverse(upper(name)) ELSE '' END AS response, status, CASE status WHEN 'empty' THEN 0 WHEN 'ok' THEN 1 ELSE 2 END AS attempts FROM s""")
def provider_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of a service of which one key fails and whose answers hang, come late, break or are blank; every row ends with a status, and blank prompts are never sent."""
    k, name = F.col("p_partkey"), F.when(F.col("p_partkey") % 6 != 0, F.col("p_name")).otherwise(F.lit(" "))
    mark = F.when(k % 29 == 5, "~").when(k % 11 == 1, "!").when(k % 11 == 2, "?").when(k % 11 == 3, "-").otherwise("")
    p = views.table(spark, sf_dir, "part").select(k.alias("id"), F.concat(mark, name).alias("prompt"), mark.isin("~", "?").alias("bad"))
    policy = Policy(attempts=2, pause=0, timeout_pause=0, at_once=32, width=8)
    answered = call_provider(p.where("not bad"), KeyedClient(_serve, ["revoked", "good"], attempts=5), policy=policy)
    failed = call_provider(p.where("bad"), KeyedClient(_serve, ["a", "b"], attempts=2, deadline=0.05), policy=policy)
    return answered.unionByName(failed).drop("prompt", "bad")


def _fails_for_brands(texts: list[str]) -> np.ndarray:
    if any("属于" in t for t in texts):
        raise MemoryError
    return np.array([[len(t), t.count("#"), 1.0] for t in texts])


@query(f"""WITH {KG}, t AS (SELECT DISTINCT domain, head || ' ' || relation || ' ' || tail AS text FROM kg), n AS (SELECT count(*) AS first FROM t)
    SELECT domain, 'first' AS run, CASE WHEN domain = 'brand' THEN 'MemoryError' ELSE 'ok' END AS status, count(*) AS texts, CASE WHEN domain = 'brand' THEN 0 ELSE sum(length(text)) END::DOUBLE AS total, (SELECT first FROM n) AS encoded, 0::BIGINT AS encoded_again FROM t GROUP BY domain""")
def embedding_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of a domain once, by an encoder that fails for one domain; a second run encodes nothing, and the broken domain has no rows in what stages read."""
    path, kg = f"{new_dir(spark, 'vectors')}/store", views.kg(spark, sf_dir)
    texts = kg.select("domain", text_functions.textualize(F.col("head"), F.col("relation"), F.col("tail")).alias("text"))
    first = embeddings.store(texts, path, _fails_for_brands, "lengths", group="domain")
    again = embeddings.store(texts, path, _fails_for_brands, "lengths", group="domain")
    total = embeddings.embedded(texts.distinct(), path, "lengths", group="domain").groupBy("domain").agg(F.sum(F.col("vec")[0]).alias("total"))
    found = embeddings.statuses(spark, path, "lengths").withColumnRenamed("group", "domain").join(total, "domain", "left")
    return found.select("domain", F.lit("first").alias("run"), "status", "texts", F.coalesce("total", F.lit(0.0)).alias("total"), F.lit(first).cast("long").alias("encoded"), F.lit(again).cast("long").alias("encoded_again"))


def _letter(text: str) -> str:
    return "I say B." if "Knowledge" in text else "A"


@query(f"""WITH {SAMPLE_LINES}, k AS (SELECT *, row_number() OVER (PARTITION BY id, m ORDER BY i) AS r FROM good), c AS (SELECT id, count(*) AS n FROM k WHERE r <= 2 GROUP BY 1)
    SELECT ids.id, 'A' AS origin_prediction, CASE WHEN coalesce(n, 0) > 0 THEN 'B' ELSE '' END AS edgetable_prediction, least(coalesce(n, 0), 4)::INT AS triple_count FROM ids LEFT JOIN c USING (id)""")
def reason_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run over a third of the samples, then one over all of them in three batches, which takes what the output lacks."""
    path, s = new_dir(spark, "reasoned"), views.samples(spark, sf_dir)
    asked = s.select(F.lit("s").alias("subject"), "id", F.concat(F.lit("q"), F.col("id").cast("string")).alias("question"), F.col("related").alias("relatedTriples"), F.col("hierarchical").alias("hierarchical_enhancements"), F.col("enriched").alias("enrich_triples"))
    workflow.reason_into(asked.where("id % 3 = 0"), path, RuleProvider(_letter), ["origin", FORMATS[0]], n=2)
    batch = -(-asked.count() * 2 // 9)
    workflow.reason_into(asked, path, RuleProvider(_letter), ["origin", FORMATS[0]], batch, n=2)
    return spark.read.parquet(path).select("id", "origin_prediction", "edgetable_prediction", "triple_count")


@query("SELECT 3::BIGINT AS batches, count(*) AS processed, count(*) AS total, 100.0::DOUBLE AS percentage, true AS in_order FROM part WHERE p_partkey % 2 = 0")
def progress_by_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What three batches of a run leave in the progress table: counts grow with the time."""
    path = new_dir(spark, "logged")
    asked = views.table(spark, sf_dir, "part").where("p_partkey % 2 = 0").select(F.lit("s").alias("subject"), F.col("p_partkey").alias("id"), F.col("p_name").alias("question"), *[F.lit(None).cast(workflow.ENRICHED).alias(c) for c in ("relatedTriples", "hierarchical_enhancements", "enrich_triples")])
    workflow.reason_into(asked, path, RuleProvider(_letter), ["origin"], -(-asked.count() // 3))
    log = workflow.progress_log(spark, path)
    grows = F.sort_array(F.collect_list(F.struct("at", "processed")))
    ordered = F.forall(F.sequence(F.lit(1), F.size("g") - 1), lambda i: F.element_at("g", i)["processed"] <= F.element_at("g", i + 1)["processed"])
    return log.agg(F.count("*").alias("batches"), F.max("processed").alias("processed"), F.max("total").alias("total"), F.max("percentage").alias("percentage"), grows.alias("g")).withColumn("in_order", ordered).drop("g")


def _judge(text: str) -> str:
    return f"Perhaps [{SUBFIELDS[len(text) % len(SUBFIELDS)]}] or [{SUBFIELDS[len(text) * 7 % len(SUBFIELDS)]}] [nothing]" if len(text) % 4 else "none"


_JUDGED = len(PROMPTS["judge"].replace("{labels}", ", ".join(SUBFIELDS)).replace("{triple}", ""))
_NAMES = "[" + ", ".join(f"'{s}'" for s in SUBFIELDS) + "]"


@query(f"""WITH {KG}, t AS (SELECT domain, pos, head, {_JUDGED} + length(head || ' -> ' || relation || ' -> ' || tail) AS n FROM kg),
    l AS (SELECT domain, pos, head, unnest(CASE WHEN n % 4 = 0 THEN ['Other'] ELSE [{_NAMES}[n % {len(SUBFIELDS)} + 1], {_NAMES}[n * 7 % {len(SUBFIELDS)} + 1]] END) AS label FROM t) SELECT * FROM l""")
def label_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes that a model names in brackets, a row each."""
    return classification.label_triples(views.kg(spark, sf_dir), RuleProvider(_judge), SUBFIELDS).select("domain", "pos", "head", "label")


def _embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, own = views.vec(spark, sf_dir), lambda c: F.concat_ws(":", "domain", c)
    kg = views.kg(spark, sf_dir).withColumns({"head": own("head"), "tail": own("tail"), "vec_id": F.col("pos") % v.count()})
    return kg.join(v.select("vec_id", "vec"), "vec_id").drop("vec_id")


def _classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.prototypes(views.vec(spark, sf_dir), ["label"], "vec").select(F.concat(F.lit("class"), F.col("label")).alias("name"), F.col("label").alias("ord"), "prototype")


CLASSIFIED = f"""{CC}, {VEC}, {PROTO}, b AS (SELECT vec_id, label, sim, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, label) AS rn FROM (SELECT vec_id, cl.label, list_cosine_similarity(vec, p) AS sim FROM v, cl)),
    best AS (SELECT vec_id, CASE WHEN sim >= 0.1 THEN 'class' || label ELSE 'Other' END AS label FROM b WHERE rn = 1),
    k AS (SELECT *, pos % (SELECT count(*) FROM embeddings) AS vec_id, {ISA} AS isa FROM kg),
    c AS (SELECT k.domain, cc.component, arg_min(vec_id, pos) AS vec_id FROM k JOIN cc ON cc.domain = k.domain AND cc.node = k.head WHERE isa GROUP BY ALL),
    done AS (SELECT k.domain, pos, head, relation, tail, k.domain || ':' || c.component AS component_id, 'ISA_Component' AS type, label FROM k JOIN cc ON cc.domain = k.domain AND cc.node = k.head JOIN c ON c.domain = k.domain AND c.component = cc.component JOIN best ON best.vec_id = c.vec_id WHERE isa
        UNION ALL SELECT domain, pos, head, relation, tail, NULL, 'Non_ISA', label FROM k JOIN best USING (vec_id) WHERE NOT isa)"""


@query(f"WITH RECURSIVE {CLASSIFIED} SELECT domain, pos, component_id, type, label FROM done")
def classify_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ISA components by their first edge, all other triples each for itself."""
    return classification.classify_triples(_embedded(spark, sf_dir), _classes(spark, sf_dir), 0.1).select("domain", "pos", "component_id", "type", "label")


@query(f"WITH RECURSIVE {CLASSIFIED} SELECT label, count(*) FILTER (type = 'ISA_Component') AS isa, count(*) FILTER (type = 'Non_ISA') AS non_isa, count(*) AS total, count(DISTINCT domain || head) AS heads, count(DISTINCT relation) AS relations, count(DISTINCT domain || tail) AS tails FROM done GROUP BY label")
def merge_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the classification gives, counted by class."""
    return classification.merge_counts(classification.classify_triples(_embedded(spark, sf_dir), _classes(spark, sf_dir), 0.1))


@query(f"WITH {KG} SELECT head, relation, tail FROM kg WHERE domain <> 'orders'")
def merge_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domain folders with merged copies among their files, which don't count again."""
    base, kg = new_dir(spark, "merge"), views.kg(spark, sf_dir)
    writers.write_classes(kg.where("domain != 'orders'").select("head", "relation", "tail", "domain"), base, "domain")
    _csv(kg.where("domain = 'orders'").select("head", "relation", "tail"), f"{base}/domain_dir=orders/orders_all.csv")
    files = [f for f in readers.listing(spark, base, folders=True) if "orders" not in f]
    return stats.union_all({f: classification.merge_folder(spark, f) for f in files}).select("head", "relation", "tail")


@query(f"""WITH {VEC}, {PROTO}, r AS (SELECT vec_id, label % 3 AS domain, vec FROM v), s AS (SELECT vec_id, r.domain, cl.label, list_cosine_similarity(vec, p) AS sim FROM r JOIN cl ON cl.label % 3 = r.domain AND r.domain < 2),
    b AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, label) AS rn FROM s) SELECT vec_id, domain, round(sim, 6) AS best_sim, CASE WHEN sim >= 0.2 THEN 'sub' || label ELSE 'other' END AS label FROM b WHERE rn = 1""")
def sub_classify_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Within each domain by the prototypes of its subdomains; a domain without any is left out."""
    v = views.vec(spark, sf_dir)
    domain = (F.col("label") % 3).alias("domain")
    classes = vectors.prototypes(v, ["label"], "vec").where("label % 3 < 2").select(domain, F.concat(F.lit("sub"), F.col("label")).alias("name"), F.col("label").alias("ord"), "prototype")
    return classification.sub_classify(v.select("vec_id", domain, "vec"), classes, "domain", 0.2).select("vec_id", "domain", F.round("best_sim", 6).alias("best_sim"), "label")
