"""Embeddings as a table: each text is encoded once for an encoder, failures are kept apart, stages read what is there."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from loomgraph.sources.readers import exists
from loomgraph.sources.shared import cut, ship

Encoder = Callable[[list[str]], np.ndarray]
STORED = "h binary, encoder string, group string, vec array<double>, status string"


def key_of(text: str = "text") -> str:
    """SHA-256 of a text; a null text reads as empty."""
    return f"unhex(sha2(coalesce({text}, ''), 256))"


def _identity(h: str) -> Column:
    """A text in its group as one key to join by, null groups being equal: the first half of the hash, 128 bits, and the group."""
    return F.struct(F.substring(F.expr(h), 1, 16).alias("h"), "group")


def _encode(encoder: Encoder, batch: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of one group at a time; one that fails gives its rows a status and no vectors, and the others go on."""

    def vectors_of(texts: list[str]) -> tuple[list, str]:
        try:
            out = np.asarray(encoder(texts), np.float64)
            if out.ndim != 2 or len(out) != len(texts):
                raise ValueError("not a vector a text")
            return out.tolist(), "ok"
        except Exception as error:  # an encoder may raise anything; the rows carry what it was
            return [None] * len(texts), type(error).__name__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            h, group, text = (part.column(c).to_pylist() for c in ("h", "group", "text"))
            by_group: dict = {}
            for i, g in enumerate(group):
                by_group.setdefault(g, []).append(i)
            for g, rows in by_group.items():
                for a in range(0, len(rows), batch):
                    own = rows[a : a + batch]
                    vectors, status = vectors_of([text[i] for i in own])
                    yield pa.RecordBatch.from_arrays([pa.array([h[i] for i in own], pa.binary()), pa.array([g] * len(own), pa.string()), pa.array(vectors, pa.list_(pa.float64())), pa.array([status] * len(own), pa.string())], names=["h", "group", "vec", "status"])

    return run


def store(texts: DataFrame, path: str, encoder: Encoder, name: str, text: str = "text", group: str | None = None, batch: int = 1000, again: bool = False) -> int:
    """Encode what the store at ``path`` lacks for the encoder called ``name`` and append it; the number of texts that were encoded.

    A text is kept once a group, by its hash; a null one reads as empty, a null group is one like others. Failed batches are kept with the error's name and are tried again only with ``again``. Appending is
    Spark's own commit, so a run that breaks off adds nothing or all of it; no vector is computed for a text that occurs twice.
    """
    spark = texts.sparkSession
    ship(spark)
    named = texts.select((F.col(group).cast("string") if group else F.lit("")).alias("group"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    if exists(spark, path):
        # hashes alone find what is missing; texts travel only for that
        done = read(spark, path, name, failed=not again).select(_identity("h").alias("k"))
        keyed = named.withColumn("k", _identity(key_of()))
        both = keyed.select("k", F.lit(0).alias("had")).unionByName(done.withColumn("had", F.lit(1)))
        lacking = cut(both.groupBy("k").agg(F.max("had").alias("had")).where("had = 0").select("k"), "lacking")
        if lacking.isEmpty():
            return 0
        named = keyed.join(lacking, "k").drop("k")
    missing = named.distinct().withColumn("h", F.expr(key_of()))
    made, seen = missing.mapInArrow(_encode(encoder, batch), "h binary, group string, vec array<double>, status string"), Observation()
    made.observe(seen, F.count(F.lit(1)).alias("n")).withColumn("encoder", F.lit(name)).write.mode("append").partitionBy("encoder").parquet(path)
    return seen.get["n"]


def read(spark, path: str, name: str, failed: bool = False) -> DataFrame:
    """``h, group, vec, status`` of one encoder, by its partition; failed: also rows without a vector. Of a text that failed and succeeded later, both."""
    rows = spark.read.schema(STORED).parquet(path).where(F.col("encoder") == name).drop("encoder")
    return rows if failed else rows.where("status = 'ok'")


def embedded(rows: DataFrame, path: str, name: str, text: str = "text", group: str | None = None, vector: str = "vec", whole_groups: bool = True) -> DataFrame:
    """``rows`` with their stored vectors; rows whose text has none are left out.

    whole_groups: a group with a text that never succeeded is left out whole, as its ranking would pass over what is missing.
    """
    spark = rows.sparkSession
    found = read(spark, path, name, failed=True).groupBy(_identity("h").alias("__k")).agg(F.max_by("vec", F.col("vec").isNotNull()).alias(vector))
    own = F.struct(F.substring(F.expr(key_of(text)), 1, 16).alias("h"), (F.col(group).cast("string") if group else F.lit("")).alias("group"))
    keyed = rows.withColumn("__k", own)
    if whole_groups:
        broken = found.where(F.col(vector).isNull()).select(F.struct("__k.group").alias("__g")).distinct()
        keyed = keyed.withColumn("__g", F.struct(F.col("__k.group").alias("group"))).join(broken, "__g", "left_anti").drop("__g")
    return keyed.join(found.where(F.col(vector).isNotNull()), "__k").drop("__k")


def statuses(spark, path: str, name: str) -> DataFrame:
    """``group, status, texts`` of one encoder."""
    return read(spark, path, name, failed=True).groupBy("group", "status").agg(F.count("*").alias("texts"))
