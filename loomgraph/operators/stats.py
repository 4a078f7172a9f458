"""Counts, samples, unions and latency figures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distinct_counts(triples: DataFrame, *keys: str) -> DataFrame:
    """Distinct heads, relations and tails; nulls don't count."""
    return triples.groupBy(*keys).agg(F.count_distinct("head").alias("heads"), F.count_distinct("relation").alias("relations"), F.count_distinct("tail").alias("tails"))


def sample_stats(triples: DataFrame) -> DataFrame:
    """Distinct heads, relations, tails, and distinct members of heads and tails together."""
    ends = triples.select(F.explode(F.array("head", "tail")).alias("e")).agg(F.count_distinct("e").alias("entities"))
    return distinct_counts(triples).join(ends)


def row_counts(files: DataFrame) -> DataFrame:
    """``file, rows`` of a scan that carries ``_metadata``; no column is read."""
    return files.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("rows"))


def folder_summary(facts: DataFrame) -> DataFrame:
    """Files, how many have rows and how many don't or can't be read, rows and MB of ``file, bytes, rows, status``."""
    good = F.count_if(F.col("status") == "ok")
    return facts.agg(F.count("*").alias("files"), good.alias("ok"), (F.count("*") - good).alias("failed"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), (F.coalesce(F.sum("bytes"), F.lit(0)) / (1 << 20)).alias("mb"))


def class_counts(classified: DataFrame, label: str, kind: str) -> DataFrame:
    """``label, <kind values>, total``: how many of each kind a class has."""
    return classified.groupBy(label).agg(F.count_if(F.col(kind) == "ISA_Component").alias("isa"), F.count_if(F.col(kind) == "Non_ISA").alias("non_isa"), F.count("*").alias("total"))


def latency(df: DataFrame, value: str, *keys: str, quantiles: tuple[float, ...] = (0.5, 0.9, 0.95, 0.99), bins: int = 4096) -> DataFrame:
    """n, min, max, mean and the values at index ``int(n * q)`` of the sorted list, without interpolation; nulls don't count.

    Two passes: equal bins between a key's least and greatest value are counted, and only the values of bins that hold a wanted
    index are sorted, a bin a task, so a key with many rows is no hot task.
    """
    from pyspark.sql.window import Window

    # structs are equal where their nulls stand in the same places, so null keys are keys like others
    rows = df.where(F.col(value).isNotNull()).select(F.struct(*keys, F.lit(0).alias("__none")).alias("k"), F.col(value).alias("v"))
    whole = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("v").alias("min"), F.max("v").alias("max"), (F.sum("v") / F.count("*")).alias("mean"))
    share = F.try_divide((F.col("v") - F.col("min")).cast("double"), (F.col("max") - F.col("min")).cast("double"))
    place = F.coalesce(F.least(F.floor(share * bins), F.lit(bins - 1)), F.lit(0)).cast("int")
    binned = rows.join(whole.select("k", "n", "min", "max"), "k").select("k", "v", "n", place.alias("bin"))
    counted = binned.groupBy("k", "n", "bin").agg(F.count("*").alias("c"))
    before = F.sum("c").over(Window.partitionBy("k").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)) - F.col("c")
    wanted = F.array(*[F.struct(F.lit(f"p{round(q * 100)}").alias("q"), F.least(F.floor(F.col("n") * q), F.col("n") - 1).alias("at")) for q in quantiles])
    held = counted.withColumn("before", before).withColumn("q", F.filter(wanted, lambda x: (x["at"] >= F.col("before")) & (x["at"] < F.col("before") + F.col("c"))))
    values = binned.join(held.where(F.size("q") > 0).select("k", "bin", "before", "q"), ["k", "bin"]).groupBy("k", "bin", "before", "q", "v").agg(F.count("*").alias("c"))
    upto = F.col("before") + F.sum("c").over(Window.partitionBy("k", "bin").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    reached = values.withColumn("upto", upto).select("k", "v", "upto", F.explode("q").alias("q")).where(F.col("upto") > F.col("q.at"))
    picks = reached.groupBy("k").agg(*[F.min(F.when(F.col("q.q") == f"p{round(q * 100)}", F.col("v"))).alias(f"p{round(q * 100)}") for q in quantiles])
    return whole.join(picks, "k").select(*[F.col(f"k.{k}").alias(k) for k in keys], "n", "min", "max", "mean", *[f"p{round(q * 100)}" for q in quantiles])


def call_stats(results: DataFrame) -> DataFrame:
    """Calls, successes, failures, attempts and success rate of provider results (``status``, ``attempts``)."""
    good = F.count_if(F.col("status") == "ok")
    return results.agg(F.count("*").alias("calls"), good.alias("successes"), (F.count("*") - good).alias("failures"), F.sum("attempts").alias("attempts"), F.coalesce(F.try_divide(good.cast("double"), F.count("*").cast("double")), F.lit(0.0)).alias("success_rate"))


def throughput(results: DataFrame, began: str, seconds: str, *keys: str) -> DataFrame:
    """``keys, successes, elapsed, qps``: successes a second from the first call's beginning to the last one's end; 0 where no time passes.

    results: ``status`` and each call's beginning and length in seconds; calls without either count for nothing.
    """
    timed = results.where(F.col(began).isNotNull() & F.col(seconds).isNotNull())
    summed = timed.groupBy(*keys).agg(F.count_if(F.col("status") == "ok").alias("successes"), (F.max(F.col(began) + F.col(seconds)) - F.min(began)).cast("double").alias("elapsed"))
    return summed.withColumn("qps", F.coalesce(F.try_divide(F.col("successes").cast("double"), "elapsed"), F.lit(0.0)))


def sample_exact(df: DataFrame, n: int, seed: int = 0, key: list[str | Column] | None = None, most_sorted: int = 10_000) -> DataFrame:
    """n rows without replacement (all if fewer), the same for the same seed: those of the n smallest hashes.

    The hash is MD5 of the seed and the columns as text, which other engines have too; equal rows are interchangeable. Rows are counted by leading digits of their hashes (at most 65,536
    counts a pass) until the n-th stands among ``most_sorted`` rows at most, or among equal hashes; only those are sorted, and all before them are taken where they
    are, so no task gets the sample. ``df`` is read once a pass and must give the same rows.
    """
    columns = [F.col(c) if isinstance(c, str) else c for c in key or df.columns]
    hashed = df.withColumn("__h", F.md5(F.concat_ws("\x01", F.lit(str(seed)), *[c.cast("string") for c in columns])))
    known, left = "", max(n, 0)
    while True:
        digits = F.substring("__h", len(known) + 1, 4)
        counts = {r.d: r.c for r in hashed.where(F.col("__h").startswith(known)).groupBy(digits.alias("d")).agg(F.count("*").alias("c")).collect()}
        edge = None
        for d in sorted(counts):
            if counts[d] > left:
                edge = d
                break
            left -= counts[d]
        if edge is None:  # all rows of the whole table
            return df
        known += edge
        if left == 0 or counts[edge] <= max(most_sorted, 1) or len(known) == 32:
            break
    before = hashed.where(F.col("__h") < known).drop("__h")
    if not left:
        return before
    among = hashed.where(F.col("__h").startswith(known))
    if len(known) == 32 and key is None:  # copies of one row
        return before.unionByName(df.sparkSession.range(left).select(F.lit(1).alias("__n")).join(F.broadcast(among.drop("__h").limit(1))).select(*df.columns))
    return before.unionByName(among.orderBy("__h", *columns).limit(left).drop("__h"))


def sample_rows(df: DataFrame, n: int, seed: int = 0, subset: list[str] | None = None) -> DataFrame:
    """A sample whose rows with a null part are dropped afterwards, so it may have fewer than n rows."""
    return sample_exact(df, n, seed).dropna(subset=subset)


def remainder(df: DataFrame, taken: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that weren't taken."""
    return df.join(taken.select(*keys), keys, "left_anti")


def union_all(parts: dict[str, DataFrame], source: str = "source_file") -> DataFrame:
    """All rows, each with its source; headers are matched in lower case, missing columns are null."""
    named = [df.toDF(*[c.lower() for c in df.columns]).withColumn(source, F.lit(name)) for name, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)
