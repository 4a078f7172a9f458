"""Derived tables that the queries run on: a knowledge graph, predictions, vectors and responses, by plain arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.taxonomy import SUBFIELDS
from loomgraph.operators.evaluate import FORMATS
from loomgraph.operators.vectors import as_doubles


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _node(kind: str, key: Column | str) -> Column:
    return F.concat(F.lit(f"{kind}#"), (F.col(key) if isinstance(key, str) else key).cast("string"))


def kg(spark: SparkSession, sf_dir: str, *domains: str) -> DataFrame:
    """``domain, head, relation, tail, pos`` of six domains (or those asked for); pos orders the rows of a domain."""
    made = {
        "geo": ("nation", _node("nation", "n_nationkey"), F.lit("isA"), _node("region", "n_regionkey"), F.col("n_nationkey")),
        "parttype": ("part", _node("part", "p_partkey"), F.lit("Is A"), F.col("p_type"), F.col("p_partkey")),
        "brand": ("part", _node("part", "p_partkey"), F.lit("属于"), F.col("p_brand"), F.col("p_partkey")),
        "customer": ("customer", _node("cust", "c_custkey"), F.lit("locateAt"), _node("nation", "c_nationkey"), F.col("c_custkey")),
        "orders": ("orders", _node("order", "o_orderkey"), F.lit("placedBy"), _node("cust", "o_custkey"), F.col("o_orderkey")),
        "supply": ("lineitem", _node("supp", "l_suppkey"), F.lit("supplies"), _node("part", "l_partkey"), F.col("l_orderkey") * 10 + F.col("l_linenumber")),
    }
    out = None
    for domain in domains or made:
        source, h, r, t, pos = made[domain]
        part = table(spark, sf_dir, source).select(F.lit(domain).alias("domain"), h.alias("head"), r.alias("relation"), t.alias("tail"), pos.cast("long").alias("pos"))
        out = part if out is None else out.unionByName(part)
    return out


def qa_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``dataset, id, answer, <format>_prediction``: predictions of nine kinds, right and wrong, blank and missing."""
    k = F.col("o_orderkey")
    letter = lambda x: F.substring(F.lit("ABCD"), (x % 4 + 1).cast("int"), F.lit(1))
    answer = F.when(k % 97 == 0, None).when(k % 89 == 0, "").otherwise(letter(k))

    def prediction(f: int) -> Column:
        kind = (k * 7 + f * 3 + F.floor(k / 9)) % 9
        texts = [letter(k), F.lower(letter(k)), F.concat(F.lit("The answer is "), letter(k), F.lit(".")), F.lit(""), F.lit(" NaN "), F.lit(None).cast("string"), letter(k + 1), F.lit("BECAUSE"), F.concat(F.lit(" ("), letter(k), F.lit(") "))]
        return F.element_at(F.array(*texts), (kind + 1).cast("int"))

    return table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("dataset"), k.alias("id"), answer.alias("answer"), *[prediction(i).alias(f"{f}_prediction") for i, f in enumerate(FORMATS)])


def qa_filter() -> Column:
    """Formats that some datasets lack: one has direct answers only, one has none, one lacks a rendering."""
    d, f = F.col("dataset"), F.col("prediction_format")
    return ~(((d == "1-URGENT") & (f == "code")) | ((d == "5-LOW") & (f != "origin")) | ((d == "3-MEDIUM") & (f == "origin")))


def vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``vec_id, label, vec, is_query``."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", as_doubles(F.col("embedding")).alias("vec"), (F.col("vec_id") % 50 == 0).alias("is_query"))


def subfield_at(k: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in SUBFIELDS]), (k % len(SUBFIELDS) + 1).cast("int"))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, response``: router-like answers in ASCII, by part."""
    k = F.col("p_partkey")
    a, b = subfield_at(k), subfield_at(k * 5 + 3)
    texts = [
        F.concat(F.lit("Answer: ["), a, F.lit("][ "), b, F.lit("]")),
        F.concat(F.lit("answer:  "), a, F.lit(", "), b, F.lit(" ; ab\nnext")),
        F.concat(F.lit("I would say "), b, F.lit(" or "), F.upper(a)),
        F.concat(F.lit("It needs programming"), F.lit("")),
        F.concat(F.lit("Answer: explanation of "), a),
        F.lit("zzz"),
        F.concat(F.lit("[ "), a, F.lit(" ] then [history] and [History"), F.lit("] [law")),
        F.lit(None).cast("string"),
    ]
    return table(spark, sf_dir, "part").select(k.alias("id"), F.element_at(F.array(*texts), (k % 8 + 1).cast("int")).alias("response"))


def enrichment_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, response``: two-section answers of a model, with lines that must be passed over."""
    k = F.col("c_custkey")
    n = k.cast("string")
    body = F.concat(F.lit("[x"), n, F.lit(", r, lost]\n  Enhanced Triples:\n[a"), n, F.lit(", is , b]\n[a, b, c, d]\nnote\n"), F.when(k % 3 == 0, F.lit("Hierarchical Enhancements:\n[h, broader, ")).otherwise(F.lit("[p, q, ")), n, F.lit("]\n[ ,, ]"))
    return table(spark, sf_dir, "customer").select(k.alias("id"), F.when(k % 7 != 0, body).alias("response"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, related, hierarchical, enriched``: triples of each order, by line."""
    li = table(spark, sf_dir, "lineitem")
    n, o = F.col("l_linenumber"), F.col("l_orderkey")
    head = F.concat(F.lit("e"), ((o + n * 3) % 7).cast("string"))
    tail = F.concat(F.lit("e"), ((o * 2 + n) % 7).cast("string"), F.when(n % 4 == 0, F.lit(" (x,y)")).otherwise(F.lit("")))
    relation = F.when((o + n) % 6 == 0, F.lit("")).otherwise(F.concat(F.lit("r<"), (n % 3).cast("string"), F.lit(">")))
    triple = F.struct(n.alias("n"), F.struct(head.alias("head"), relation.alias("relation"), tail.alias("tail")).alias("t"))
    pick = lambda m: F.transform(F.array_sort(F.collect_list(F.when(n % 3 == m, triple))), lambda x: x["t"])
    return li.groupBy(o.alias("id")).agg(pick(1).alias("related"), pick(2).alias("hierarchical"), pick(0).alias("enriched"))
