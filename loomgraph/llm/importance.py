"""Importance resampling towards a target by hashed n-grams, through a dictionary of distinct features.

Blocks of documents list their distinct n-grams once as strings with counts; each shard of the dictionary adds up the counts of its strings over all
blocks, hashes each distinct string once and answers every block with the buckets of its strings. The dictionary's
totals are aggregated by bucket, for the corpus and for the target; a bucket's gain is its log ratio. The gains, a table of fixed
size, are joined to each document's feature counts by bucket, and documents are drawn without replacement by the largest
sums of weight and Gumbel noise, which a hash of the id gives. Ranks come from a range-partitioned sort: a row's place in its
partition and the partitions' sizes before it.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.llm.blocks import ALPHANUMERIC, ASKED, Words, answers, asked, blocks, hashes, mix, pack, pack_words, shard_of, shards_for, total_words, words_in
from loomgraph.sources.shared import cut, ship


class Features:
    """Distinct n-grams (1 and 2 words) of a block and where they stand: ``of``, the feature of each occurrence, ``doc``, its document."""

    def __init__(self, words: Words):
        codes, n = words.codes.astype(np.int64), len(words.distinct)
        follows = np.ones(len(codes), bool)
        follows[words.ends[words.sizes > 0] - 1] = False
        at = np.flatnonzero(follows)
        self.pairs, which, counts = np.unique(codes[at] * n + codes[np.minimum(at + 1, len(codes) - 1)], return_inverse=True, return_counts=True)
        doc = np.repeat(np.arange(len(words.sizes)), words.sizes)
        self.words, self.n = words, n + len(self.pairs)
        self.of, self.doc = np.concatenate((codes, which + n)), np.concatenate((doc, doc[at]))
        self.counts = np.concatenate((np.bincount(codes, minlength=n), counts))

    def dealt(self, shards: int) -> tuple[np.ndarray, np.ndarray]:
        """(shards, features) in the order in which the block asks: by shard, then words before pairs, pairs by their first word."""
        own, n = hashes(self.words.distinct), len(self.words.distinct)
        shard = shard_of(np.concatenate((own, mix(own[self.pairs // n], own[self.pairs % n]) if n else own)), shards)
        order = np.argsort(shard, kind="stable")
        return shard[order], order

    def strings(self, some: np.ndarray) -> pa.Array:
        distinct, n = self.words.distinct, len(self.words.distinct)
        single, double = some[some < n], self.pairs[some[some >= n] - n]
        joined = pc.binary_join_element_wise(distinct.take(pa.array(double // max(n, 1))), distinct.take(pa.array(double % max(n, 1))), pa.scalar(" ", pa.large_string()))
        return pa.concat_arrays([distinct.take(pa.array(single)), joined])


def _dictionary(table: DataFrame, buckets: int, shards: int, answer: bool) -> DataFrame:
    """``block, kind, shard, data`` (the buckets of a block's features) and, with a null block, ``sums``: totals of a shard by bucket."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("kind", pa.int32()), ("shard", pa.int64()), ("block", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
        for batch in batches:
            for row in batch.to_pylist():
                found = Features(Words(row))
                shard, order = found.dealt(shards)
                yield pa.RecordBatch.from_pylist(list(asked(1, row["block"], shard, lambda a, b, f=found, o=order: pack_words(f.strings(o[a:b])), found.counts[order])), schema)

    def add_up(rows: pa.Table) -> pa.Table:
        distinct, totals, places = total_words(rows)
        bucket = np.fromiter((zlib.crc32(x) for x in distinct.cast(pa.large_binary()).to_pylist()), np.int64, len(distinct)) % buckets
        shard, sums = rows.column("shard")[0].as_py(), np.zeros(buckets, np.int64)
        np.add.at(sums, bucket, totals)
        some = np.flatnonzero(sums)
        out = [{"block": None, "kind": 0, "shard": shard, "data": None, "sums": [{"bucket": int(b), "n": int(sums[b])} for b in some]}]
        if answer:
            out += [{"block": block, "kind": 1, "shard": shard, "data": pack(bucket[p].astype(np.uint32)), "sums": None} for block, p in places]
        return pa.Table.from_pylist(out, pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("shard", pa.int64()), ("data", pa.binary()), ("sums", pa.list_(pa.struct([("bucket", pa.int64()), ("n", pa.int64())])))]))

    rows = table.select("block", "docs", "sizes", "codes", "words").mapInArrow(ask, ASKED)
    return rows.groupBy("shard").applyInArrow(add_up, "block long, kind int, shard long, data binary, sums array<struct<bucket:long,n:long>>")


def _by_bucket(dictionary: DataFrame) -> DataFrame:
    return dictionary.where("block is null").select(F.explode("sums").alias("x")).groupBy("x.bucket").agg(F.sum("x.n").alias("n"))


def gains(corpus: dict[int, int], target: dict[int, int], buckets: int) -> np.ndarray:
    """floor(1000 ln of the smoothed ratio of shares) of each bucket; corpus and target: occurrences by bucket."""
    all_corpus, all_target = sum(corpus.values()) + buckets, sum(target.values()) + buckets
    ratio = ((target.get(b, 0) + 1.0) * float(all_corpus) / ((corpus.get(b, 0) + 1.0) * float(all_target)) for b in range(buckets))
    return np.fromiter((math.floor(1000 * math.log(x)) for x in ratio), np.int64, buckets)


def noise(key: str) -> int:
    """floor(1000 x) of a standard Gumbel draw that a hash of the key gives."""
    h = int(hashlib.sha256(key.encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = 10_000, seed: int = 7, size: int = 8 << 20, per_shard: int = 1 << 20) -> DataFrame:
    """``id_col, n_words, n_features, weight, score`` of each row of ``docs``.

    Words are runs of ASCII digits and letters (lower-cased) and of anything beyond ASCII; features are words and pairs of neighbours, repeats counted. weight is the floored mean
    gain (0 without features), score adds the noise of ``seed:id`` (a null id reads as empty). target: a table with ``text_col``. Null and empty texts have no
    features; repeated ids are rows like others with the same noise; an empty target leaves the gains to the corpus's own counts; other columns are ignored. size is in bytes of text a block, per_shard in
    distinct features: both bound a task's memory, but a longer text is a block of its own.
    """
    ship(docs.sparkSession)
    kind = docs.select(F.col(id_col).alias("id")).schema["id"].dataType.simpleString()
    corpus = cut(blocks(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", ALPHANUMERIC, size), "blocks")
    wanted = cut(blocks(target.select(F.col(text_col).alias("text"), F.lit(0).alias("id")), "text", ALPHANUMERIC, size), "target")
    found = cut(_dictionary(corpus, buckets, shards_for(corpus, 2 * words_in(corpus), per_shard), True), "dictionary")
    own = {r["bucket"]: r["n"] for r in _by_bucket(found).collect()}  # a row a bucket
    theirs = {r["bucket"]: r["n"] for r in _by_bucket(_dictionary(wanted, buckets, shards_for(wanted, 2 * words_in(wanted), per_shard), False)).collect()}
    gain, shards = gains(own, theirs, buckets), shards_for(corpus, 2 * words_in(corpus), per_shard)

    def score(block: pa.Table, told: pa.Table) -> pa.Table:
        ids, rows = [], {"n_words": [], "n_features": [], "weight": [], "score": []}
        for row in block.to_pylist():
            words = Words(row)
            features = Features(words)
            _, order = features.dealt(shards)
            bucket = np.zeros(features.n, np.int64)
            bucket[order] = answers(told, {1: np.uint32})[1]
            sums = np.bincount(features.doc, gain[bucket][features.of], len(words.sizes)).astype(np.int64)
            n = words.sizes + np.maximum(words.sizes - 1, 0)
            weight = np.where(n > 0, np.floor_divide(sums, np.maximum(n, 1)), 0)
            ids += [d["id"] for d in words.docs]
            rows["n_words"].append(words.sizes)
            rows["n_features"].append(n)
            rows["weight"].append(weight)
            rows["score"].append(weight + np.array([noise(f"{seed}:{'' if d['id'] is None else d['id']}") for d in words.docs], np.int64))
        id_type = block.schema.field("docs").type.value_type.field("id").type
        return pa.table({"id": pa.array(ids, id_type)} | {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in rows.items()})

    asked_for = corpus.groupBy("block").cogroup(found.where("block is not null").select("block", "kind", "shard", "data").groupBy("block"))
    return asked_for.applyInArrow(score, f"id {kind}, n_words long, n_features long, weight long, score long").withColumnRenamed("id", id_col)


def draw(weighed: DataFrame, share: float = 0.25, least_words: int = 20, id_col: str = "doc_id") -> DataFrame:
    """``weighed`` with ``rank``: 1, 2, 3 ... over the floor(share * N) highest scores among its N rows of ``least_words`` words or more, ties to smaller ids; else null.

    Rows that repeat an id have equal scores and are interchangeable; null ids come first among ties. An empty table gives no rows.
    """
    sort = [F.desc("score"), F.asc(id_col)]
    fit = weighed.where(F.col("n_words") >= least_words)
    place = F.monotonically_increasing_id()
    placed = cut(fit.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("__at", place), "ranked")
    part, at = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))  # a row a partition
    upto = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = sizes.withColumn("__before", F.sum("__n").over(upto) - F.col("__n")).select("__part", "__before")
    drawn = math.floor(share * placed.count())
    ranked = placed.withColumn("__part", part).join(before, "__part").withColumn("rank", F.col("__before") + at + 1)
    ranked = ranked.select(*weighed.columns, F.when(F.col("rank") <= drawn, F.col("rank")).cast("long").alias("rank"))
    return ranked.unionByName(weighed.where(~(F.col("n_words") >= least_words)).withColumn("rank", F.lit(None).cast("long")))
