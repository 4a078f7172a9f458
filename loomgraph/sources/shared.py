"""Tables written to the folder that the cluster shares, to cut lineage in a way that survives lost executors."""

from __future__ import annotations

import atexit
import os
import sys
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parents[2]
_written: list[tuple[SparkSession, str]] = []
_shipped: set[str] = set()


def one_machine(spark: SparkSession) -> bool:
    """Whether tasks run inside the driver's process: master ``local`` or ``local[...]``."""
    return spark.sparkContext.master.partition("[")[0] == "local"


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; one of our own only where that is unset (tests, notebooks)."""
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base.rstrip("/")
    if base := spark.sparkContext.getCheckpointDir():
        return base.rstrip("/")
    if not one_machine(spark):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    base = f"file://{tempfile.mkdtemp(prefix='loomgraph-')}"
    spark.sparkContext.setCheckpointDir(base)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def new_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; it is deleted when the driver ends."""
    path = f"{shared_dir(spark)}/loomgraph-{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through the Hadoop file system that owns it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def cut(df: DataFrame, name: str, dictionary: bool = True) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back; without dictionaries where values hardly repeat.

    Later stages start from files that every executor can read, and Spark knows the
    table's size, so a join against it is broadcast only when it is small.
    """
    spark = df.sparkSession
    path = new_dir(spark, name)
    df.write.option("parquet.enable.dictionary", dictionary).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete the files behind a table made by :func:`cut` once nothing reads it any more."""
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/loomgraph-" in file:
            remove(df.sparkSession, file)


def ship(spark: SparkSession) -> None:
    """Let executors import this package; only a local master's workers may already see the repository."""
    app = spark.sparkContext.applicationId
    seen = [os.path.realpath(p) for p in [*os.environ.get("PYTHONPATH", "").split(":"), os.getcwd()] if p]
    if app in _shipped or one_machine(spark) and str(ROOT) in seen:
        return
    target = Path(tempfile.mkdtemp(prefix="loomgraph-")) / "loomgraph.zip"
    with zipfile.ZipFile(target, "w") as out:
        for path in sorted((ROOT / "loomgraph").rglob("*.py")):
            out.write(path, path.relative_to(ROOT))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            remove(spark, path)
        except Exception as gone:  # the session may have ended before the interpreter
            print(f"left {path}: {type(gone).__name__}", file=sys.stderr) if os.environ.get("LOOMGRAPH_VERBOSE") else None
