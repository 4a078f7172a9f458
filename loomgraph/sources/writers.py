"""Sinks. Partitioning and appending are Spark's; nothing that was written is rewritten."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.taxonomy import directory_name
from loomgraph.sources.shared import cut

#: Size groups of components with so many edges go to every task, at most one for as many edges.
LARGE = 50_000


def write_subjects(df: DataFrame, path: str, append: bool = False) -> None:
    """Parquet with a folder for each subject; append adds files and leaves those there alone."""
    df.write.mode("append" if append else "overwrite").partitionBy("subject").parquet(path)


def write_classes(df: DataFrame, path: str, label: str, sublabel: str | None = None, rows_per_file: int = 1_000_000) -> None:
    """CSV by class folder; each task writes its own part of a class, so a large class is spread as the rows are."""
    keys = {f"{c}_dir": directory_name(F.col(c)) for c in (label, sublabel) if c}
    df.withColumns(keys).write.mode("append").option("header", True).option("maxRecordsPerFile", rows_per_file).partitionBy(*keys).csv(path)


def write_labels(df: DataFrame, path: str, labels: str) -> None:
    """Each row once for each of its labels (a label given twice is written twice), by label folder."""
    df.withColumn("label", F.explode(labels)).drop(labels).withColumn("label", directory_name(F.col("label"))).write.mode("append").option("header", True).partitionBy("label").csv(path)


def write_components(edges: DataFrame, labels: DataFrame, index: DataFrame, path: str, large_edges: int = LARGE) -> None:
    """The component store: edges by size group, sorted by component with Bloom filters; the index beside it names each component's files.

    Edges are range-partitioned by component and node, so a file holds a range of components and a large component several files. Edges of large
    components get their size group where they are; only those of others are shuffled by component, so none of these is a hot task.
    """
    index = cut(index, "component-index")
    inside = edges.join(labels, F.col("src") == F.col("node")).drop("node")
    large = F.broadcast(index.where(F.col("edge_count") >= large_edges).select("component", F.col("size_group").alias("__large")))
    small = index.where(F.col("edge_count") < large_edges).select(F.col("component").alias("__k"), "size_group")
    # edges of large components are dealt by their ends, which match no small component, as their mark differs
    key = F.when(F.col("__large").isNull(), F.struct(F.lit(0).alias("large"), F.col("component").alias("name"))).otherwise(F.struct(F.lit(1).alias("large"), F.col("src").alias("name")))
    dealt = inside.join(large, "component", "left").withColumn("__e", key).join(small.withColumn("__k", F.struct(F.lit(0).alias("large"), F.col("__k").alias("name"))), F.col("__e") == F.col("__k"), "left")
    sized = dealt.withColumn("size_group", F.coalesce("__large", "size_group")).drop("__large", "__e", "__k").where("size_group is not null")
    order = ["size_group", "component", "src", "dst"]
    ranged = sized.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged.write.mode("overwrite").option("parquet.bloom.filter.enabled#component", "true").partitionBy("size_group").parquet(f"{path}/components")
    held = edges.sparkSession.read.parquet(f"{path}/components").groupBy("component").agg(F.array_sort(F.collect_set("_metadata.file_name")).alias("files"))
    listed = index.join(held, "component", "left").repartitionByRange("component").sortWithinPartitions("component")
    listed.write.mode("overwrite").option("parquet.bloom.filter.enabled#component", "true").parquet(f"{path}/index")


def write_batches(df: DataFrame, path: str, rows: int = 1_000_000) -> None:
    df.write.mode("overwrite").option("maxRecordsPerFile", rows).parquet(path)


def write_entities(entities: DataFrame, key: str, path: str) -> None:
    """One sorted entity a line, by folder of the key; a range partitioning sorts without a single task."""
    entities.repartitionByRange(key, "entity").sortWithinPartitions(key, "entity").write.mode("overwrite").partitionBy(key).text(path)


def write_report(df: DataFrame, path: str) -> None:
    """A small report table as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_sample(df: DataFrame, path: str) -> bool:
    """A sample as one CSV file; nothing is written when it is empty. The rows are drawn by many tasks, and only what is drawn goes to one."""
    if df.isEmpty():
        return False
    write_report(df.repartition(1), path)
    return True


def as_json(df: DataFrame, name: str = "json") -> DataFrame:
    """Each row as a JSON text."""
    return df.select(F.to_json(F.struct("*")).alias(name))
