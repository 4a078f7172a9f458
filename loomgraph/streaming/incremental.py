"""Incremental stages as Structured Streaming: new question files are worked on once, progress lives in a checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomgraph.operators.stats import sample_exact
from loomgraph.plans.workflow import log_progress
from loomgraph.sources.readers import listing


def _stream(spark: SparkSession, source: str, schema: str, checkpoint: str, glob: str, files_per_batch: int | None, write: Callable[[DataFrame, int], None]) -> int:
    """Run ``write(batch, number)`` over all files that the checkpoint doesn't know; the number of batches."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
    stream = (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(source)
    done = []

    def each(batch: DataFrame, number: int) -> None:
        write(batch, number)
        done.append(number)

    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return len(done)


def process_new_files(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, stage: Callable[[DataFrame], DataFrame], glob: str = "test*.parquet", files_per_batch: int | None = None) -> int:
    """Run ``stage`` over files that the checkpoint doesn't know yet and append Parquet to the target.

    A batch that was cut off runs again and replaces its own folder, so no row appears twice. Returns the number of batches done; each leaves a row in the progress table
    (:func:`loomgraph.plans.workflow.progress_log`).
    """

    def write(batch: DataFrame, number: int) -> None:
        stage(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")
        log_progress(spark, target, number, spark.read.parquet(f"{target}/batch={number}").count(), None)

    return _stream(spark, source, schema, checkpoint, glob, files_per_batch, write)


def sample_new_files(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, n: int, seed: int = 0, glob: str = "*.parquet", files_per_batch: int | None = None) -> DataFrame:
    """A sample of n rows of all that has come so far, kept as files come: the n smallest hashes of the last sample and the new rows.

    The state merges, so the sample is the one that :func:`sample_exact` takes of all rows at once, whatever the batches. Each batch writes a version of its own from the one before, so one that runs again
    gives the same.
    """

    def write(batch: DataFrame, number: int) -> None:
        before = [int(f.rsplit("=", 1)[1]) for f in listing(spark, target, folders=True)]
        kept = batch
        if before := [v for v in before if v < number]:
            kept = kept.unionByName(spark.read.schema(batch.schema).parquet(f"{target}/version={max(before)}"))
        sample_exact(kept, n, seed).write.mode("overwrite").parquet(f"{target}/version={number}")

    _stream(spark, source, schema, checkpoint, glob, files_per_batch, write)
    versions = [int(f.rsplit("=", 1)[1]) for f in listing(spark, target, folders=True)]
    if not versions:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{target}/version={max(versions)}")
