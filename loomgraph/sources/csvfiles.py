"""Quoted CSV files that are read by many tasks, line breaks inside fields included.

Spark deals a text file out by lines, and whether a line starts inside quotes depends on all lines before it. A line is a function
on two states (outside, inside quotes), and so is a run of lines; functions compose. So the first pass gives each split of a file as the
function of its lines with quotes, and composing those tells in which state each split begins. The second pass joins lines to
records from there; what a split holds of a record that began in an earlier one, and of one that ends in a later one, is put together by
a small table of fragments. Records are then parsed by the built-in CSV expression. Headers are the first bytes of the files.

The rules are the CSV reader's: a quote opens only at the start of a field, a doubled quote is a quote, what follows a closing quote up to the separator
belongs to the field. Line ends are ``\\n`` or ``\\r\\n``.
"""

from __future__ import annotations

import csv
from bisect import bisect_left
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.sources.shared import cut, ship

SEPARATOR = ","
#: Byte order mark.
MARK = "\ufeff"
PARSE = {"escape": '"'}


def inside_after(line: str, inside: bool, separator: str = SEPARATOR) -> bool:
    """Whether a line that starts inside (or outside) quotes ends inside."""
    at, end = 0, len(line)
    while True:
        if not inside:
            if not line.startswith('"', at):
                found = line.find(f'{separator}"', at)
                if found < 0:
                    return False
                at = found + len(separator)
            at, inside = at + 1, True
        while True:
            at = line.find('"', at)
            if at < 0:
                return True
            if line.startswith('"', at + 1):
                at += 2
                continue
            break
        at = line.find(separator, at + 1)
        if at < 0:
            return False
        at, inside = at + len(separator), False
        if at >= end:
            return False


def head(spark: SparkSession, path: str, size: int = 1 << 16) -> bytes:
    """The first bytes of a file, through the file system that owns it; a file that can't be read raises OSError."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = None
    try:
        stream = target.getFileSystem(spark._jsc.hadoopConfiguration()).open(target)
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(spark._jvm.org.apache.commons.io.input.BoundedInputStream(stream, size)))
    except Exception as error:  # whatever the file system's driver raises; a file without a header would be left out like an empty one
        raise OSError(f"can't read {path}: {error}") from error
    finally:
        if stream is not None:
            stream.close()


def first_record(spark: SparkSession, path: str) -> str:
    """The text of a file's first record, without its line end; more is read until a line ends outside quotes or the file ends."""
    size = 1 << 16
    while True:
        data = head(spark, path, size)
        text = data.decode("utf-8", "replace").removeprefix(MARK)
        inside, begin = False, 0
        while (end := text.find("\n", begin)) >= 0:
            inside = inside_after(text[begin:end], inside)
            if not inside and (record := text[:end].removesuffix("\r").lstrip("\r\n")):
                return record.replace("\r\n", "\n")
            begin = end + 1
        if len(data) < size:
            return text.removesuffix("\r").lstrip("\r\n")
        size *= 8


def column_names(record: str) -> list[str]:
    """Names of a header as the CSV reader gives them: empty ones by place, repeated ones (in any case) with their place."""
    names = next(csv.reader([record]), []) if record else []
    low = [n.lower() for n in names]
    return [f"_c{i}" if not n else f"{n}{i}" if low.count(low[i]) > 1 else n for i, n in enumerate(names)]


def headers(spark: SparkSession, paths: list[str], at_once: int = 16) -> dict[str, list[str]]:
    """Column names of every file, read by the driver side by side: some KB a file and no job."""
    with ThreadPoolExecutor(at_once) as pool:
        return dict(zip(paths, pool.map(lambda p: column_names(first_record(spark, p)), paths), strict=True))


@contextmanager
def _same_splits(spark: SparkSession) -> Iterator[None]:
    """Both passes must see the same splits, also if executors come or go in between, which would change the default parallelism."""
    key = "spark.sql.files.minPartitionNum"
    before = spark.conf.get(key, None)
    spark.conf.set(key, before or str(spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)


def _lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def _functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The function of each split: whether it ends inside, begun outside and begun inside."""
    found: dict[tuple[str, int], list[bool]] = {}
    for batch in batches:
        for file, start, line in zip(*(batch.column(c).to_pylist() for c in ("file", "start", "value")), strict=True):
            ends = found.setdefault((file, start), [False, True])
            line = line if start else line.removeprefix(MARK)
            ends[0], ends[1] = inside_after(line, ends[0]), inside_after(line, ends[1])
    rows = [{"file": f, "start": s, "from_outside": a, "from_inside": b} for (f, s), (a, b) in found.items()]
    if rows:
        yield pa.RecordBatch.from_pylist(rows)


def _states(table: pa.Table) -> pa.Table:
    """Of one file: whether each split with quotes begins inside, and in a last row what stands after them; nothing where none does."""
    inside, out = False, []
    for r in sorted(table.to_pylist(), key=lambda r: r["start"]):
        out.append({"file": r["file"], "start": r["start"], "inside": inside})
        inside = r["from_inside"] if inside else r["from_outside"]
    out.append({"file": table.column("file")[0].as_py(), "start": (1 << 63) - 1, "inside": inside})
    return pa.Table.from_pylist(out if any(r["inside"] for r in out) else [], pa.schema([("file", pa.string()), ("start", pa.int64()), ("inside", pa.bool_())]))


class Splits:
    """Whether a split begins inside quotes. Splits without a quote pass their state on, so theirs is that of the next one that has some."""

    def __init__(self, rows: list[tuple[str, int, bool]]):
        self.of: dict[str, tuple[list[int], list[bool]]] = {}
        for file, start, inside in sorted(rows):
            starts, states = self.of.setdefault(file, ([], []))
            starts.append(start)
            states.append(inside)

    def begins_inside(self, file: str, start: int) -> bool:
        starts, states = self.of.get(file, ([], []))
        return bool(starts) and states[bisect_left(starts, start)]


class Joiner:
    """Joins one split's lines, which come in batches, to records.

    kind: 0 the end of a record that began in an earlier split (or, where the split has no record's end, its middle), 1 the beginning of one that goes on
    in a later split, 2 a whole record.
    """

    def __init__(self, file: str, start: int, inside: bool):
        self.file, self.start, self.inside = file, start, inside
        self.open: list[str] = []
        self.head_done, self.first = not inside, start == 0

    def take(self, lines: pa.Array, quotes: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Only lines with quotes are looked at one by one, and those inside; all others are records."""
        n = len(lines)
        before, after, at = np.zeros(n, bool), np.zeros(n, bool), 0
        for q in np.flatnonzero(quotes).tolist():
            before[at : q + 1] = after[at:q] = self.inside
            self.inside = after[q] = inside_after(lines[q].as_py(), self.inside)
            at = q + 1
        before[at:] = after[at:] = self.inside
        parts = np.flatnonzero(before | after)
        rows: list[tuple[int, int, str]] = []  # (line, kind, text)
        for i in parts.tolist():
            self.open.append(lines[i].as_py())
            if not after[i]:
                rows.append((i, 2 if self.head_done else 0, "\n".join(self.open)))
                self.head_done, self.open = True, []
        own = np.flatnonzero(~(before | after) & (pc.utf8_length(lines).to_numpy(zero_copy_only=False) > 0))
        texts = pa.concat_arrays([lines.take(pa.array(own)), pa.array([r[2] for r in rows], pa.string())])
        yield self._rows(np.concatenate((own, np.array([r[0] for r in rows], np.int64))), np.concatenate((np.full(len(own), 2), np.array([r[1] for r in rows], np.int64))), texts)

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.open:
            yield self._rows(np.zeros(1, np.int64), np.array([1 if self.head_done else 0]), pa.array(["\n".join(self.open)], pa.string()))

    def _rows(self, lines: np.ndarray, kinds: np.ndarray, texts: pa.Array) -> pa.RecordBatch:
        first = np.zeros(len(lines), bool)
        if self.first and len(lines):
            first[np.argmin(lines)], self.first = True, False
        same = lambda x, kind: pa.array([x], kind).take(pa.array(np.zeros(len(lines), np.int64)))
        return pa.RecordBatch.from_arrays([same(self.file, pa.string()), same(self.start, pa.int64()), pa.array(kinds, pa.int32()), pa.array(first), texts], names=["file", "start", "kind", "first", "record"])


def records(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``file, first, record``: the text of every record that isn't empty; first: whether it is its file's first. Stored in the shared folder."""
    ship(spark)
    with _same_splits(spark):
        quoted = _lines(spark, paths).where(F.contains("value", F.lit('"'))).mapInArrow(_functions, "file string, start long, from_outside boolean, from_inside boolean")
        # rows for the splits of files where a record goes beyond a split: fewer than Spark's own list of splits
        splits = Splits([tuple(r) for r in quoted.groupBy("file").applyInArrow(_states, "file string, start long, inside boolean").collect()])

        def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            joiner: Joiner | None = None
            for batch in batches:
                files, starts, values = batch.column("file"), batch.column("start").to_numpy(zero_copy_only=False), batch.column("value")
                change = np.ones(len(batch), bool)
                change[1:] = (starts[1:] != starts[:-1]) | pc.not_equal(files.slice(1), files.slice(0, max(0, len(batch) - 1))).to_numpy(zero_copy_only=False)
                marks = np.flatnonzero(change).tolist()
                for a, b in zip(marks, [*marks[1:], len(batch)], strict=True):
                    file, start, lines = files[a].as_py(), int(starts[a]), values.slice(a, b - a)
                    if joiner is None or (file, start) != (joiner.file, joiner.start):
                        if joiner:
                            yield from joiner.end()
                        joiner = Joiner(file, start, splits.begins_inside(file, start))
                        if not start and lines[0].as_py().startswith(MARK):
                            lines = pa.concat_arrays([pa.array([lines[0].as_py().removeprefix(MARK)], pa.string()), lines.slice(1)])
                    yield from joiner.take(lines, pc.match_substring(lines, '"').to_numpy(zero_copy_only=False))
            if joiner:
                yield from joiner.end()

        parts = cut(_lines(spark, paths).mapInArrow(join, "file string, start long, kind int, first boolean, record string"), "records")
    order = Window.partitionBy("file").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    pieces = parts.where("kind < 2").withColumn("number", F.sum("kind").over(order))  # two rows a split at most
    in_order = F.array_sort(F.collect_list(F.struct("start", "kind", "record")))
    joined = pieces.groupBy("file", "number").agg(F.bool_or("first").alias("first"), F.array_join(F.transform(in_order, lambda x: x["record"]), "\n").alias("record"))
    whole = parts.where("kind = 2").select("file", "first", "record").unionByName(joined.select("file", "first", "record"))
    return whole.withColumn("record", F.replace(F.regexp_replace("record", "\r$", ""), F.lit("\r\n"), F.lit("\n"))).where("record != ''")


def file_name(url: Column) -> Column:
    """The decoded name of a file from its URL."""
    return F.url_decode(F.replace(F.element_at(F.split(url, "/"), -1), F.lit("+"), F.lit("%2B")))


def read(spark: SparkSession, paths: list[str], names: list[str], wanted: list[str] | None = None, source: str | None = None) -> DataFrame:
    """Files that share a header as strings; wanted: those columns only; source: a column with the file's name.

    Fields that a record lacks are null, empty fields too, as with the built-in reader.
    """
    schema = ", ".join(f"`c{i}` string" for i in range(len(names)))
    parsed = records(spark, paths).where(~F.col("first")).select("file", F.from_csv("record", schema, PARSE).alias("x"))
    picked = [F.col(f"x.c{i}").alias(n) for i, n in enumerate(names) if wanted is None or n in wanted]
    return parsed.select(*picked, *([file_name(F.col("file")).alias(source)] if source else []))
