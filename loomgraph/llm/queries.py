"""One thin query for each operator, over its whole table, and the SQL that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import bpe, conversations, hnsw, importance, langid, linededup, mixing, oracles, simhash, suffixtree, tokencount, topk, urlfilter, warc
from loomgraph.sources.shared import cut

WORD_BPE = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to."""
    read = warc.archive_pages(table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(~langid.held_out()))
    return langid.predict(docs.select("doc_id", "text", langid.held_out().alias("held_out")), model).drop("text")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, line_no, n_chars, n_copies, class_doc_id, class_line_no of each line of each document."""
    return linededup.line_members(table(spark, sf_dir, "documents"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept."""
    return hnsw.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")).select("vec_id", "n_links", "component_id", "kept")


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score."""
    data = topk.scaled(table(spark, sf_dir, "embeddings"))
    return topk.exact_top_k(data, data.where("id % 100 = 0")).withColumnRenamed("id", "vec_id")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict."""
    model = urlfilter.UrlModel().fit(urlfilter.labelled_urls())
    return urlfilter.judge(table(spark, sf_dir, "pages"), URL_RULES, model).select("page_id", "host", "path", "rule", "verdict")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit."""
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, n_contexts, train_tokens, base_score, score."""
    return suffixtree.score(table(spark, sf_dir, "documents"))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_features, weight, score, rank."""
    weighed = importance.weigh(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return importance.draw(cut(weighed, "weighed")).select("doc_id", "n_features", "weight", "score", "rank")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    rows = table(spark, sf_dir, "conversations")
    fixed = conversations.repair(conversations.damage(rows), "conv")
    found = fixed.summary.join(conversations.digests(fixed.turns, "conv").withColumnRenamed("conv", "c"), F.col("conv").eqNullSafe(F.col("c")), "left").drop("c")
    out = rows.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("conv")), "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


#: The rules of the URL query: (host, path, allow).
URL_RULES = [
    urlfilter.Rule("org", "/", True),
    urlfilter.Rule("example.org", "/es/", False),
    urlfilter.Rule("example.org", "/en/1", False),
    urlfilter.Rule("com", "/fr/", True),
    urlfilter.Rule("com", "/de/", False),
]

QUERIES = {
    f.__name__: f
    for f in (op1_warc, op2_bpe, op3_language_id, op4_simhash, op5_line_dedup, op6_embedding_dedup, op7_top_k, op8_url_filter, op9_token_counts, op10_mixing, op11_suffix_tree, op12_importance, op13_conversation_repair)
}

ORACLE_SQL = {
    "op1_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
        d AS (SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS payload_digest FROM p),
        g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS leader FROM d)
        SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id <> leader THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id <> leader THEN leader END AS refers_to
        FROM g""",
    "op6_embedding_dedup": """
        WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
        l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
        r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
        c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
        n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
        SELECT c.a AS vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, c.a = component_id AS kept FROM c LEFT JOIN n USING (a)""",
    "op7_top_k": """
        WITH v AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: floor(1024 * x)) AS e FROM embeddings),
        s AS (SELECT q.vec_id AS query_id, d.vec_id AS vec_id, list_inner_product(q.e, d.e)::BIGINT AS score
              FROM v q JOIN v d ON q.vec_id % 100 = 0 AND q.vec_id <> d.vec_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10""",
    "op12_importance": oracles.IMPORTANCE,
    "op13_conversation_repair": oracles.CONVERSATION_REPAIR,
}
