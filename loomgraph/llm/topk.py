"""Exact top-k by inner product as a Voronoi kNN join.

Rows are assigned to the nearest of a bounded set of pivots. A summary of each cell (size, radius about
its pivot, greatest length) bounds every score in it: q.x = q.p + q.(x - p) <= q.p + |q| r, and q.x <= |q| |x|. A first pass solves each
query in one block of the cell that its bound ranks first, which gives a k-th best score to beat; a query is then
sent only to cells whose bound reaches that score, and solved there. Cells are cut into blocks of bounded
size, so a cell that holds a third of all rows spreads over many tasks. As queries are few and data is
not, it is the queries that are replicated to the data that may hold an answer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.sources.shared import cut, ship


def scaled(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """``id, x``: components floor(scale * component) as longs; vectors that are null or empty, or hold null or non-finite components, are left out."""
    v = F.col(vector_col)
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(fine & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("x"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.int64).reshape(-1, dim)


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products; in doubles where no sum can pass 2**53. Sums that don't fit into 64 bits raise."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    if most >= 2**62 and np.abs(q.astype(np.float64) @ x.T.astype(np.float64)).max(initial=0) >= 2**62:
        raise OverflowError("a score doesn't fit into 64 bits")
    return (q.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64) if most < 2**53 else q @ x.T


def best(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of each query's k highest scores, ties to smaller ids; never the query itself."""
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    out = []
    for a in range(0, len(q), 256):
        s = _scores(q[a : a + 256], x)
        own = q_ids[a : a + 256, None] == ids[None, :]
        top = np.argsort(np.where(own, np.iinfo(np.int64).max, -s), axis=1, kind="stable")[:, : k + 1]
        keep = ~np.take_along_axis(own, top, 1)
        keep &= np.cumsum(keep, axis=1) <= k
        rows, cols = np.nonzero(keep)
        at = top[rows, cols]
        out.append((q_ids[a : a + 256][rows], ids[at], s[rows, at]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def exact_top_k(data: DataFrame, queries: DataFrame, k: int = 10, pivots: int = 64, block: int = 8192, query_block: int = 65_536) -> DataFrame:
    """``query_id, rank, id, score``: each query's k best rows of ``data`` (both ``id, x`` with equal lengths of x).

    All rows if there are fewer; ties go to smaller ids; a query's own id is no candidate. Repeated rows of data count as they
    come; of queries that share an id the one with the smallest vector counts. Vectors of another length than the smallest id's are left out. Empty data or queries give no rows.
    A task holds at most about ``block`` rows of data and ``query_block`` queries.
    """
    spark = data.sparkSession
    ship(spark)
    schema = "query_id bigint, rank int, id bigint, score bigint"
    head = data.orderBy("id").limit(1).collect()
    if not head:
        return spark.createDataFrame([], schema)
    dim = len(head[0].x)
    data, queries = data.where(F.size("x") == dim), queries.where(F.size("x") == dim)
    queries = queries.groupBy("id").agg(F.min("x").alias("x"))
    drawn = data.select("x").orderBy(F.xxhash64(F.lit(5), "x"), "id").limit(pivots).collect()
    p = np.unique(np.array([r.x for r in drawn], np.float64), axis=0)
    norms = (p * p).sum(1)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(1), dim).astype(np.float64)
                d = (x * x).sum(1)[:, None] + norms[None, :] - 2 * (x @ p.T)
                cell = d.argmin(1)
                far = np.sqrt(np.maximum(0, ((x - p[cell]) ** 2).sum(1)))
                long = np.sqrt((x * x).sum(1))
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(cell, pa.int32()), pa.array(far), pa.array(long)], ["id", "x", "cell", "far", "long"])

    placed = cut(data.select("id", "x").mapInArrow(assign, "id bigint, x array<bigint>, cell int, far double, long double"), "voronoi")
    summary = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("r"), F.max("long").alias("l")).collect()  # one row a pivot at most
    radius, longest, blocks = np.full(len(p), -1.0), np.zeros(len(p)), np.zeros(len(p), np.int64)
    for s in summary:
        radius[s.cell], longest[s.cell], blocks[s.cell] = s.r, s.l, -(-s.n // block)
    groups = max(1, -(-queries.count() // query_block))
    held = np.flatnonzero(blocks)

    def bounds(q: np.ndarray) -> np.ndarray:
        """Above every score of q in each cell; a little is added for rounding."""
        q = q.astype(np.float64)
        length = np.sqrt((q * q).sum(1))
        about = np.minimum(q @ p[held].T + length[:, None] * radius[held][None, :], length[:, None] * longest[held][None, :])
        return about + 1e-9 * (1 + length[:, None] * (radius[held] + np.sqrt(norms[held]))[None, :])

    base = np.cumsum(blocks) - blocks  # a cell's first task
    slot = F.create_map(*[F.lit(int(v)) for c in held for v in (c, base[c])])
    wide = F.create_map(*[F.lit(int(v)) for c in held for v in (c, blocks[c])])
    dealt = placed.select("id", "x", (slot[F.col("cell")] + F.pmod(F.xxhash64(F.lit(3), "id"), wide[F.col("cell")])).alias("task"))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                to = held[bounds(_matrix(batch.column(1), dim)).argmax(1)]
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(base[to] + ids % blocks[to])], ["id", "x", "task"])

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            q, ids = _matrix(batch.column(1), dim), batch.column(0).to_numpy(zero_copy_only=False)
            above, to = bounds(q), bounds(q).argmax(1)
            beat = np.array([-np.inf if v is None else v for v in batch.column(2).to_pylist()], np.float64)
            for j, c in enumerate(held):
                for b in range(blocks[c]):
                    done = (held[to] == c) & (ids % blocks[c] == b)
                    at = pa.array(np.flatnonzero((above[:, j] >= beat) & ~done))
                    if len(at):
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(np.full(len(at), base[c] + b))], ["id", "x", "task"])

    def solve(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        q = left.sort_by("id").combine_chunks()
        x = right.combine_chunks()
        if not len(q) or not len(x):
            return pa.table({c: pa.array([], pa.int64()) for c in ("query_id", "id", "score")})
        part = lambda t: (t.column("id").to_numpy(), _matrix(t.column("x").combine_chunks(), dim))
        return pa.table(dict(zip(("query_id", "id", "score"), best(*part(q), *part(x), k), strict=True)))

    def join(sent: DataFrame) -> DataFrame:
        asked = sent.withColumn("group", F.pmod(F.xxhash64(F.lit(4), "id"), F.lit(groups)))
        stored = dealt.withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
        return asked.groupBy("task", "group").cogroup(stored.groupBy("task", "group")).applyInArrow(solve, "query_id bigint, id bigint, score bigint")

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    one = cut(join(queries.select("id", "x").mapInArrow(first, "id bigint, x array<bigint>, task bigint")), "topk-first")
    worst = one.withColumn("rank", rank).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("beat"))
    rest = queries.select("id", "x").join(worst, "id", "left").mapInArrow(others, "id bigint, x array<bigint>, task bigint")
    return one.unionByName(join(rest)).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "id", "score")
