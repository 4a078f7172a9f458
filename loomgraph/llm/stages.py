"""The stages of the corpus pipeline; each takes (spark, docs, sf_dir) and decides with one operator."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import bpe, langid, linededup, mixing, shingles
from loomgraph.llm.names import unused
from loomgraph.sources.shared import cut

#: A document goes when no language has this share of the corrected hits: with four languages, less than chance plus a little.
LEAST_SCORE = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter or without a language that stands out; ``lang`` becomes the prediction.

    So null, empty and letterless texts go. Null and repeated ids and equal rows are rows like others; texts of any length are judged whole; further columns stay as
    they are. Of an empty table nothing is learned, and nothing stays.
    """
    model = langid.train(docs.where(~langid.held_out()))
    said, score = unused(docs, "said", "score")
    found = langid.predict(docs, model, pred_col=said, score_col=score)
    kept = found.where((F.col(said) != langid.UNDETERMINED) & (F.col(score) >= LEAST_SCORE))
    return kept.withColumn("lang", F.col(said)).select(docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines that repeat an earlier line of the corpus but for a few edits, and documents that have nothing left.

    Null and empty texts stay; rows without an id come last; rows that repeat an id are told apart by their texts, and of equal rows one keeps its lines. See
    :func:`linededup.dedup_lines`.
    """
    return linededup.dedup_lines(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) keep the document with the smallest id; of rows that repeat an id one; rows without an id stay.

    SimHash links what its fingerprints show, a prefix filter the rest (:func:`shingles.near_copies`). Null and blank texts are copies of each other.
    """
    groups = cut(shingles.near_copies(docs).where("doc_id is not null"), "copies")
    kept = docs.join(groups.where("doc_id != component_id").select("doc_id"), "doc_id", "left_anti").select(docs.columns)
    twice = groups.groupBy("doc_id").count().where("count > 1").select("doc_id")
    if twice.isEmpty():
        return kept
    return kept.join(twice, "doc_id", "left_anti").unionByName(kept.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id"])).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix to target weights takes it; documents without words (null, empty) go. See :func:`mixing.repeat`."""
    return mixing.repeat(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document; null and empty texts have no tokens. See :func:`bpe.encode_documents`."""
    return bpe.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
