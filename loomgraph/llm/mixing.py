"""Mixing sources to target weights by pivotal dependent rounding.

A document of a source is taken ``target / source_size`` times on average: once for each whole part, and
for the fractional part p it is taken once more with probability p. Dependent rounding pairs two fractional
copies i, j of sizes s_i, s_j and moves mass between them so that s_i p_i + s_j p_j stays as
it is, both keep their expectations and one of them becomes 0 or 1. In a block all fractions are equal, and the largest document is paired
with the pool of all smaller ones, which takes up the mass evenly and so keeps one fraction; then the next. What is left is one fractional document,
a small one unless the pool ran full or empty. The blocks' residuals are paired with each other, up a tree of fan-in
``fan_in``, until one document of the source is left, which is rounded by its probability.

Draws are hashes of the seed and the documents, and blocks depend on ids and texts alone, so reruns agree
whatever the partitioning. A source's rows are dealt over as many blocks as its count asks for.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.llm.names import unused
from loomgraph.sources.shared import cut, ship

WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), total_share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``source, source_size, n_docs, weight, target`` from ``source, source_size, n_docs``, one row a source.

    Weights repeat over the sources in code-point order, null last. Targets share ``total_share`` of all sizes by
    weight, none above ``most`` times its source: the fixed point of resharing the excess. With sources in order
    of cap/weight, the first ones that are capped are those whose cap is at most the level that the rest would get.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    whole = Window.partitionBy()
    by_cap = Window.orderBy("ratio", F.col("source").isNull(), "source")
    base = sizes.withColumn("weight", weight).withColumn("cap", most * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    base = base.withColumn("all", total_share * F.sum("source_size").over(whole)).withColumn("weights", F.sum("weight").over(whole))
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    ranked = base.withColumn("level", (F.col("all") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    ranked = ranked.withColumn("place", F.row_number().over(by_cap))
    fair = ranked.withColumn("fair", F.min_by("level", F.when(F.col("ratio") >= F.col("level"), F.col("place"))).over(whole))
    return fair.select("source", "source_size", "n_docs", "weight", F.coalesce(F.least("cap", F.col("weight") * F.col("fair")), "cap").alias("target"))


def _draw(*of: object) -> float:
    return int.from_bytes(hashlib.blake2b("|".join(map(str, of)).encode(), digest_size=8).digest(), "big") / 2**64


def pivot(rows: list[tuple[str, int, float]], seed: int) -> list[float]:
    """New fractions of (key, size, fraction) rows: all 0 or 1 but at most one, with the same sum of size times fraction."""
    out = [p for _, _, p in rows]
    held = None
    for k, (key, size, p) in enumerate(rows):
        if size == 0 or not 1e-12 < p < 1 - 1e-12:
            out[k] = float(round(p)) if size else 0.0
            continue
        if held is None:
            held = k
            continue
        i, j, a, b = held, k, rows[held][1], size
        p_i, p_j = out[i], p
        up = min(1 - p_i, p_j * b / a)  # mass to i, from j
        down = min(p_i, (1 - p_j) * b / a)  # mass from i, to j
        shift = up if _draw(seed, rows[i][0], key) * (up + down) < down else -down
        out[i], out[j] = p_i + shift, p_j - shift * a / b
        for x in (i, j):
            out[x] = 0.0 if out[x] < 1e-9 else 1.0 if out[x] > 1 - 1e-9 else out[x]
        held = next((x for x in (i, j) if 0 < out[x] < 1), None)
    return out


def settle(rows: list[tuple[str, int, float]], seed: int) -> list[float]:
    """The same for rows of one fraction, largest first, each paired with the pool of all smaller ones.

    Mass moves to the row, from the pool, as far as the row's 1 or the pool's 0 allows, or the other way round; the two are drawn so that
    no expectation changes. Usually the row becomes 0 or 1 and the pool goes on at a new fraction; else the pool is rounded as a whole and the
    row is what is left.
    """
    rest = sum(size for _, size, _ in rows)
    p = rows[0][2] if rows else 0.0
    out: list[float] = []
    for k, (key, size, _) in enumerate(rows):
        rest -= size
        if not size or p in (0.0, 1.0):
            out.append(p if size else 0.0)
            continue
        if not rest:
            out.append(p)
            continue
        up, down = min(1 - p, p * rest / size), min(p, (1 - p) * rest / size)
        shift = up if _draw(seed, key, k) * (up + down) < down else -down
        own, pool = p + shift, p - shift * size / rest
        own, pool = (0.0 if x < 1e-12 else 1.0 if x > 1 - 1e-12 else x for x in (own, pool))
        out.append(own)
        p = pool
    return out


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (3, 1, 2), total_share: float = 1.5, most: float = 2.0, seed: int = 17, block: int = 4096, fan_in: int = 32) -> DataFrame:
    """``id_col, source, size, source_size, target, copies, taken`` for each row.

    size: words of the text (null: 0); copies: how often the mix takes the whole document (0 to ``most``, rounded up);
    taken: size * copies. Null and empty texts have size 0 and are taken 0 times. Null and repeated ids are rows like others, told apart by their texts (equal rows
    are interchangeable, so that the result is the same whichever of them is taken); an empty table gives no rows. Other columns are
    ignored. ``text_hash`` is a hash of the text. Weights repeat over the sources, which are ranked in one task: a row a source.
    """
    spark = docs.sparkSession
    ship(spark)
    words = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    thin = cut(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), words.alias("size"), F.xxhash64(F.col(text_col)).alias("text_hash")), "mix-sizes")
    sources = cut(targets(thin.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")), weights, total_share, most), "mix-targets")
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = (
        thin.join(sources.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s", "weight")
        .withColumn("whole", F.floor(share).cast("long")).withColumn("p", F.when(F.col("size") > 0, share - F.floor(share)).otherwise(0.0))
        .withColumn("blocks", F.ceil(F.col("n_docs") / block))
        .withColumn("block", F.pmod(F.xxhash64(F.lit(seed), F.col("id").cast("string"), "text_hash"), F.col("blocks"))).drop("n_docs")
    )
    schema = whole.schema
    # documents without words or with a whole number of copies have nothing to round
    start = whole.where("p > 0")

    def round_block(table: pa.Table) -> pa.Table:
        sizes = table.column("size").to_pylist()
        keys = [f"{i}|{h}" for i, h in zip(table.column("id").to_pylist(), table.column("text_hash").to_pylist(), strict=True)]
        order = sorted(range(len(keys)), key=lambda k: (-sizes[k], keys[k]))  # largest first: what is left in the end is small
        table = table.take(pa.array(order, pa.int64()))
        rows = list(zip([keys[k] for k in order], table.column("size").to_pylist(), table.column("p").to_pylist(), strict=True))
        return table.set_column(table.schema.get_field_index("p"), "p", pa.array((settle if len({p for _, _, p in rows}) == 1 else pivot)(rows, seed), pa.float64()))

    done, rest = [whole.where("p = 0")], start
    while True:
        level = cut(rest.groupBy("source", "block").applyInArrow(round_block, schema), "mix-level")
        done.append(level.where("p = 0 or p = 1"))
        rest = level.where("p > 0 and p < 1").withColumn("blocks", F.ceil(F.col("blocks") / fan_in)).withColumn("block", F.floor(F.col("block") / fan_in)).select([F.col(f.name).cast(f.dataType) for f in schema])
        if level.where("blocks > 1").isEmpty():
            break
    last = F.xxhash64(F.lit(seed), F.lit("last"), F.col("source"), F.col("id").cast("string"), "text_hash")
    done.append(rest.withColumn("p", (F.pmod(last, F.lit(1_000_000)) / 1_000_000 < F.col("p")).cast("double")))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    copies = F.when(F.col("size") > 0, F.col("whole") + F.col("p").cast("long")).otherwise(0)
    return out.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), "text_hash")


def repeat(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: each row as often as it is taken, with the columns of ``docs``.

    Rows that share id, source and text are numbered, so that each gets one of their decisions; other columns of such rows may be told
    apart by nothing, so which of them is taken is open.
    """
    key = lambda i, source, h: F.to_json(F.struct(i.cast("string").alias("i"), source.alias("s"), h.alias("h")))
    name, list_, number, each = unused(docs, "key", "copies", "number", "each")
    mixed = mix(docs, id_col, text_col, source_col, **options).where("copies > 0")
    plan = mixed.groupBy(key(F.col(id_col), F.col("source"), F.col("text_hash")).alias(name)).agg(F.sort_array(F.collect_list("copies"), asc=False).alias(list_))
    rows = docs.withColumn(name, key(F.col(id_col), F.col(source_col), F.xxhash64(F.col(text_col)))).join(plan, name)
    # the rare keys of several rows are numbered, so that no other row passes a window
    twice = F.size(list_) > 1
    several = rows.where(twice).withColumn(number, F.row_number().over(Window.partitionBy(name).orderBy(F.lit(0))))
    rows = rows.where(~twice).withColumn(number, F.lit(1)).unionByName(several)
    times = F.coalesce(F.get(F.col(list_), F.col(number) - 1), F.lit(0)).cast("int")
    return rows.withColumn(each, F.explode(F.array_repeat(F.lit(1), times))).select(docs.columns)
