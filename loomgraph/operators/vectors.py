"""Vector operators: cosine, prototypes, nearest class, top-k by similarity. Arithmetic is in doubles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.functions.render import bind
from loomgraph.functions.taxonomy import DEFAULT_FIELD
from loomgraph.sources.shared import ship


def as_doubles(x: Column) -> Column:
    return F.transform(x, lambda v: v.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def unit(x: Column) -> Column:
    """A vector of length 1; a zero vector stays as it is, so that its cosine with anything is 0. Normalise once, before a join.

    The length is bound to a lambda's variable: the optimiser would otherwise compute it anew for each component.
    """
    return bind(F.named_struct(F.lit("x"), x, F.lit("n"), F.sqrt(dot(x, x))), lambda s: F.when(s["n"] > 0, F.transform(s["x"], lambda v: v / s["n"])).otherwise(s["x"]))


def prototypes(vectors: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """``keys, prototype``: element-wise means. Partial sums are taken before the shuffle, so a large class is no hot task."""
    means = vectors.select(*keys, F.posexplode(vector).alias("i", "v")).groupBy(*keys, "i").agg(F.avg(F.col("v").cast("double")).alias("m"))
    return means.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("prototype"))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as the rows of a matrix of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


class Prototypes:
    """Classes of a fixed taxonomy by key: names in order and their vectors as a matrix; of equal vectors the first counts, as ties go to it."""

    def __init__(self, rows: list[tuple], most: int = 10_000):
        if len(rows) > most:
            raise ValueError(f"{len(rows)} classes: more than a taxonomy of {most}")
        self.names: dict = {}
        self.units: dict = {}
        for key, _, name, vector in sorted(rows, key=lambda r: (str(r[0]), r[1], str(r[2]))):
            if vector is not None:
                names, seen = self.names.setdefault(key, []), self.units.setdefault(key, [])
                x = np.asarray(vector, np.float64)
                length = np.sqrt(x @ x)
                x = x / length if length > 0 else x
                if not any(np.array_equal(x, y) for y in seen):
                    names.append(name)
                    seen.append(x)

    def nearest(self, key: object, vectors: pa.Array) -> tuple[np.ndarray, list[str | None]]:
        """(similarity, class) of each vector; NaN and None for one that is null or has another length than the classes."""
        sims, labels = np.full(len(vectors), np.nan), [None] * len(vectors)
        names = self.names.get(key)
        if names:
            classes = np.stack(self.units[key])
            fit = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(vectors), classes.shape[1]), False).to_numpy(zero_copy_only=False))
            if len(fit):
                x = matrix(vectors.take(pa.array(fit)))
                length = np.sqrt(np.einsum("ij,ij->i", x, x))
                scores = (x / np.where(length > 0, length, 1.0)[:, None]) @ classes.T
                best = np.argmax(scores, axis=1)
                sims[fit] = scores[np.arange(len(fit)), best]
                for i, b in zip(fit, best, strict=True):
                    labels[i] = names[b]
        return sims, labels


def _nearest(rows: DataFrame, vector: str, key: Column, table: Prototypes, threshold: float, default: str) -> DataFrame:
    ship(rows.sparkSession)

    @F.arrow_udf("struct<sim:double,c:string>")
    def best(vectors: pa.Array, keys: pa.Array) -> pa.Array:
        sims, labels = np.full(len(vectors), np.nan), np.full(len(vectors), None, object)
        listed = np.array(keys.to_pylist(), object)
        for k in set(listed.tolist()):
            at = np.flatnonzero(listed == k)
            sims[at], labels[at] = table.nearest(k, vectors.take(pa.array(at)))
        return pa.StructArray.from_arrays([pa.array(sims, from_pandas=True), pa.array(labels.tolist(), pa.string())], names=["sim", "c"])

    scored = rows.withColumn("__best", best(as_doubles(F.col(vector)), key))
    label = F.when(F.col("__best.sim") >= threshold, F.col("__best.c")).otherwise(F.lit(default))
    return scored.select(*rows.columns, F.col("__best.sim").alias("best_sim"), label.alias("label"))


def classify(rows: DataFrame, vector: str, classes: DataFrame, name: str, threshold: float = 0.0, default: str = DEFAULT_FIELD) -> DataFrame:
    """Rows with ``best_sim`` and ``label``: the class of the most similar prototype, ties to the smaller ``ord``.

    Below the threshold, and for a null vector or one of another length, the label is ``default``. classes: ``name, ord, prototype`` with one row for each class of a fixed
    taxonomy (at most 10,000, checked); a batch of rows is scored by one matrix product, and no row of ``rows`` is multiplied or moved.
    """
    table = Prototypes([("", r[0], r[1], r[2]) for r in classes.select("ord", F.col(name).cast("string"), as_doubles(F.col("prototype"))).collect()])
    return _nearest(rows, vector, F.lit(""), table, threshold, default)


def classify_within(rows: DataFrame, vector: str, key: str, classes: DataFrame, name: str, threshold: float = 0.0, default: str = "other") -> DataFrame:
    """The same by the classes ``key, name, ord, prototype`` of each row's own key; rows whose key has no class are left out."""
    listed = classes.select(F.col(key).cast("string"), "ord", F.col(name).cast("string"), as_doubles(F.col("prototype"))).collect()
    table = Prototypes([tuple(r) for r in listed if r[0] is not None])
    return _nearest(rows.where(F.col(key).cast("string").isin(list(table.names))), vector, F.col(key).cast("string"), table, threshold, default)


def routed_top_k(questions: DataFrame, triples: DataFrame, k: int = 100, own: bool = True, block: int = 20_000, question_block: int = 20_000) -> DataFrame:
    """``question_id, rank, triple_id, similarity``: each question's k most similar triples of its subfields.

    questions: ``question_id, q, subfields``; triples: ``triple_id, subfield, x``, all vectors of one length; rows without a vector are left out. A subfield without triples is skipped.
    own: whether a triple with the question's own id counts. Ties go to later subfields of the list, then to larger triple ids. The triples of a
    subfield are dealt into blocks of about ``block``, its questions into blocks of about ``question_block``; each pair of blocks meets in one task, where matrix products give the scores and only the k best
    of a question go on to the shuffle by question. So the two parameters bound a task's memory.
    """
    ship(questions.sparkSession)
    asked = questions.select("question_id", unit(as_doubles(F.col("q"))).alias("q"), F.posexplode("subfields").alias("at", "subfield")).where("q is not null")
    stored = triples.select("triple_id", "subfield", unit(as_doubles(F.col("x"))).alias("x")).where("x is not null")
    blocks = triples.groupBy("subfield").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = lambda df, c, n: df.withColumn(n, F.pmod(F.xxhash64(c), F.col(f"{n}s")).cast("int"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(f"{n}s") - 1)).alias(n)
    sizes = asked.groupBy("subfield").agg(F.ceil(F.count("*") / question_block).cast("int").alias("parts")).join(blocks, "subfield")
    stored = dealt(stored.join(sizes, "subfield"), "triple_id", "block").select("triple_id", "x", "subfield", "block", every("part"))
    asked = dealt(asked.join(sizes, "subfield"), "question_id", "part").select("question_id", "q", "at", "subfield", "part", every("block"))
    kinds = {c: df.schema[c].dataType.simpleString() for c, df in (("question_id", questions), ("triple_id", triples))}

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if len(left) and len(right):
            right = right.take(pc.sort_indices(right, sort_keys=[("triple_id", "descending")]))
            x = matrix(right.column("x"))
            rows_at_once = max(1, 1_000_000 // len(right))  # scores, their negatives and their order stand in memory together
            for a in range(0, len(left), rows_at_once):
                part = left.slice(a, rows_at_once)
                sims = matrix(part.column("q")) @ x.T
                if not own:
                    same = {v: j for j, v in enumerate(right.column("triple_id").to_pylist())}
                    for i, v in enumerate(part.column("question_id").to_pylist()):
                        if v in same:
                            sims[i, same[v]] = -np.inf
                top = np.argsort(-sims, axis=1, kind="stable")[:, :k]
                rows, cols = np.repeat(np.arange(len(part)), top.shape[1]), top.ravel()
                found = sims[rows, cols]
                keep = found > -np.inf
                out.append(pa.table({"question_id": part.column("question_id").take(pa.array(rows[keep])), "at": part.column("at").take(pa.array(rows[keep])), "triple_id": right.column("triple_id").take(pa.array(cols[keep])), "similarity": found[keep]}))
        if out:
            return pa.concat_tables(out)
        return pa.table({"question_id": left.column("question_id").slice(0, 0), "at": left.column("at").slice(0, 0), "triple_id": right.column("triple_id").slice(0, 0), "similarity": pa.array([], pa.float64())})

    scored = asked.groupBy("subfield", "block", "part").cogroup(stored.groupBy("subfield", "block", "part")).applyInArrow(best, f"question_id {kinds['question_id']}, at int, triple_id {kinds['triple_id']}, similarity double")
    rank = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("similarity"), F.desc("at"), F.desc("triple_id")))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("question_id", "rank", "triple_id", "similarity")
