"""Scans: triple and question files into canonical columns. Schemas are explicit; nothing is inferred."""

from __future__ import annotations

import csv
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from loomgraph.functions.taxonomy import TAXONOMY
from loomgraph.functions.text import na_to_null, textualize
from loomgraph.sources import csvfiles

TRIPLE = ["head", "relation", "tail"]
CSV_OPTIONS = {"header": "true", "multiLine": "true", "escape": '"', "encoding": "UTF-8"}


def _fs(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _fs(spark, path)
    return fs.exists(target)


def listing(spark: SparkSession, path: str, suffix: str = "", recursive: bool = False, folders: bool = False) -> list[str]:
    """Sorted full names of files (or folders) below a path, through the file system that owns it; none when it is missing."""
    fs, target = _fs(spark, path)
    if not fs.exists(target):
        return []
    out = []
    for status in fs.listStatus(target):  # of a file: itself
        name = status.getPath().toString()
        if status.isDirectory():
            out += [name] if folders else listing(spark, name, suffix, True) if recursive else []
        elif not folders and name.endswith(suffix):
            out.append(name)
    return sorted(out)


def subjects(spark: SparkSession, path: str) -> list[str]:
    """Names of the sub-folders, sorted; each is a subject or a domain. A folder ``subject=name``, as a sink writes it, is named by its value."""
    return sorted(_subject(f.rsplit("/", 1)[1]) for f in listing(spark, path, folders=True))


def _subject(folder: str) -> str:
    return unquote(folder.removeprefix("subject=")) if folder.startswith("subject=") else folder


def domains_with_prototypes(spark: SparkSession, data: str, prototypes: str) -> list[str]:
    """Domains whose prototype folder holds a CSV file."""
    return [d for d in subjects(spark, data) if listing(spark, f"{prototypes}/{d}", ".csv")]


def csv_files(spark: SparkSession, paths: list[str] | str) -> list[str]:
    """The files that paths name: of a folder all below it but hidden ones."""
    found = [f for path in ([paths] if isinstance(paths, str) else paths) for f in listing(spark, path, recursive=True)]
    return [f for f in found if not f.rsplit("/", 1)[1].startswith(("_", "."))]


def read_csv(spark: SparkSession, paths: list[str] | str, na: bool = True) -> DataFrame:
    """CSV rows as strings, with missing-value tokens as null; several files must share a header. Large files are read by many tasks."""
    files = csv_files(spark, paths)
    names = csvfiles.headers(spark, files)
    if len(kinds := {tuple(n) for n in names.values() if n}) > 1:
        raise ValueError(f"{len(kinds)} different headers")
    df = csvfiles.read(spark, files, list(*kinds)) if kinds else spark.createDataFrame([], "value string")
    return df.select([na_to_null(F.col(f"`{c}`")).alias(c) for c in df.columns]) if na else df


def read_positional(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """The first columns of a CSV by position, under new names; rows with fewer fields are left out."""
    df = read_csv(spark, path, na=False)
    first = df.columns[: len(names)]
    return df.select([F.col(f"`{c}`").alias(n) for c, n in zip(first, names, strict=False)]).dropna(subset=names[-1:] if len(first) == len(names) else None)


def triple_columns(columns: list[str], capitalised_only: bool = False) -> list[str] | None:
    """The names that head, relation and tail have in a header (capitalised first), or None when one is missing."""
    found = [next((c for c in ([n.capitalize()] if capitalised_only else [n.capitalize(), n]) if c in columns), None) for n in TRIPLE]
    return found if all(found) else None


def read_triples(spark: SparkSession, paths: list[str], drop_null: bool = True, capitalised_only: bool = False) -> DataFrame:
    """``head, relation, tail, source_file`` of CSV files; files without the three columns are skipped.

    drop_null: leave out triples with a missing part. The headers of all files are read side by side without a job; files that share one
    are read by one scan, large ones by many tasks.
    """
    groups: dict[tuple[str, ...], list[str]] = {}
    for path, columns in csvfiles.headers(spark, csv_files(spark, paths)).items():
        if triple_columns(columns, capitalised_only):
            groups.setdefault(tuple(columns), []).append(path)
    out = spark.createDataFrame([], "head string, relation string, tail string, source_file string")
    for columns, files in groups.items():
        own = triple_columns(list(columns), capitalised_only)
        part = csvfiles.read(spark, files, list(columns), own, "source_file")
        out = out.unionByName(part.select(*[na_to_null(F.col(f"`{c}`")).alias(n) for c, n in zip(own, TRIPLE, strict=True)], "source_file"))
    return out.dropna(subset=TRIPLE) if drop_null else out


def subfield_paths(spark: SparkSession, base: str, field_path: str, subfield_path: str) -> list[str]:
    """A subfield's merged file if there is one, else all its CSV files."""
    folder = f"{base}/{field_path}/{subfield_path}"
    whole = f"{folder}/{subfield_path}_all.csv"
    return [whole] if exists(spark, whole) else listing(spark, folder, ".csv")


def load_subfield_triples(spark: SparkSession, base: str, other: str | None = None) -> DataFrame:
    """``subfield, head, relation, tail, text`` of every subfield; null parts read ``nan``, as in the embedded texts."""
    out = spark.createDataFrame([], "subfield string, head string, relation string, tail string, text string")
    name = lambda s: s.replace(" & ", "_").replace(" ", "_").lower()
    for field, subs in TAXONOMY.items():
        for sub in subs:
            if sub == "other":
                paths, caps = ([other] if other and exists(spark, other) else []), True
            else:
                paths, caps = subfield_paths(spark, base, name(field), name(sub)), False
            if paths:
                df = read_triples(spark, paths, drop_null=False, capitalised_only=caps)
                part = df.select(F.lit(sub).alias("subfield"), *[F.coalesce(c, F.lit("nan")).alias(c) for c in TRIPLE])
                out = out.unionByName(part.withColumn("text", textualize(F.col("head"), F.col("relation"), F.col("tail"))))
    return out


def read_questions(spark: SparkSession, base: str, glob: str = "test*.parquet", names: list[str] | None = None) -> DataFrame:
    """Parquet files of all subject folders (or those named) in one scan, with ``subject``; unreadable files are skipped, missing columns null.

    Options A to H are always there, as nullable strings.
    """
    folders = [f for f in listing(spark, base, folders=True) if names is None or _subject(f.rsplit("/", 1)[1]) in names]
    df = spark.read.options(mergeSchema="true", ignoreCorruptFiles="true", pathGlobFilter=glob).parquet(*folders)
    decoded = lambda x: F.url_decode(F.replace(x, F.lit("+"), F.lit("%2B")))
    folder = decoded(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))  # paths are URLs
    df = df.withColumn("subject", F.when(folder.startswith("subject="), decoded(F.substring(folder, len("subject=") + 1, 1 << 30))).otherwise(folder))
    return df.withColumns({c: F.lit(None).cast("string") for c in "ABCDEFGH" if c not in df.columns})


def read_components(spark: SparkSession, path: str, size_group: str | None = None) -> DataFrame:
    """The edges of a component store; a size group prunes partitions."""
    df = spark.read.parquet(f"{path}/components")
    return df.where(F.col("size_group") == size_group) if size_group else df


def read_component(spark: SparkSession, path: str, component: str) -> DataFrame:
    """The edges of one component: the index tells its partition and files, in which row groups are passed over by their bounds; none for a name that isn't there."""
    found = spark.read.parquet(f"{path}/index").where(F.col("component") == component).select("size_group", "files").first()
    reader = spark.read.option("basePath", f"{path}/components")
    if found is None or not found.files:
        return reader.parquet(f"{path}/components").where("false")
    return reader.parquet(*[f"{path}/components/size_group={found.size_group}/{f}" for f in found.files]).where(F.col("component") == component)


def read_json(spark: SparkSession, path: str, schema: str | None = None, lines: bool = False) -> DataFrame:
    """Objects of JSON files: a file is one object or list of objects, or (lines) has an object a line and can be split."""
    reader = spark.read.option("multiLine", not lines)
    return (reader.schema(schema) if schema else reader).json(path)


def read_template(spark: SparkSession, path: str | None, default: str) -> str:
    """A prompt template from a text file; the default when there is none or it can't be read."""
    try:
        return spark.read.text(path, wholetext=True).first()[0] if path else default
    except (AnalysisException, TypeError):
        return default


def json_list(x: Column, schema: str) -> Column:
    """A list column that arrives as JSON text; bad JSON gives an empty list."""
    return F.coalesce(F.from_json(x, schema), F.array().cast(schema))


def count_methods(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``file, rows, records, lines, line_breaks`` of CSV files: ways to count that differ.

    rows: records but the header; records: what quotes hold together counts once, empty lines don't count; lines: without a look at quotes; line_breaks: one less than lines where the last line doesn't end.
    One scan counts lines, and bytes that are no line breaks.
    """
    text = spark.read.option("lineSep", "\n").text(paths)
    lines = text.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("lines"), (F.max("_metadata.file_size") - F.sum(F.octet_length("value"))).alias("line_breaks"))
    records = csvfiles.records(spark, paths).groupBy("file").agg(F.count("*").alias("records"))
    counted = lines.join(records, "file", "left").withColumn("records", F.coalesce("records", F.lit(0)))
    return counted.select("file", F.greatest(F.col("records") - 1, F.lit(0)).alias("rows"), "records", "lines", "line_breaks")


def file_facts(spark: SparkSession, folder: str, suffix: str = ".csv") -> DataFrame:
    """``file, bytes, rows, status, has_header, header`` of every file below a folder.

    rows: records less the first one; status: ok, empty (no row), unreadable (can't be opened, or isn't UTF-8); has_header: as the csv module's sniffer says of the first 1024
    characters, null where it can't tell. Sizes and heads are read by the driver, some KB a file; lines and records are counted by all tasks.
    """
    fs, _ = _fs(spark, folder)
    files = [(f, fs.getFileStatus(spark._jvm.org.apache.hadoop.fs.Path(f)).getLen()) for f in listing(spark, folder, suffix, recursive=True)]
    if not files:
        return spark.createDataFrame([], "file string, bytes long, rows long, status string, has_header boolean, header array<string>")
    with ThreadPoolExecutor(16) as pool:
        sniffed = list(pool.map(lambda f: _sniff(spark, f[0]), files))
    known = spark.createDataFrame([(f, n, h, c) for (f, n), (h, c) in zip(files, sniffed, strict=True)], "file string, bytes long, has_header boolean, header array<string>")
    # paths are URLs in metadata
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    lines = spark.read.options(lineSep="\n", ignoreCorruptFiles="true").text([f for f, _ in files]).groupBy(plain(path).alias("at")).agg(F.bool_and(F.is_valid_utf8("value")).alias("valid"))
    checked = known.withColumn("at", plain("file")).join(lines, "at", "left").withColumn("readable", F.when(F.col("bytes") == 0, True).otherwise(F.coalesce("valid", F.lit(False))))
    good = [r.file for r in checked.where("readable and bytes > 0").select("file").collect()]  # names the driver has listed
    if good:
        url = F.url_decode(F.replace(F.col("file"), F.lit("+"), F.lit("%2B")))
        counted = csvfiles.records(spark, good).groupBy(plain(url).alias("at")).agg(F.count("*").alias("n"))
        checked = checked.join(counted, "at", "left")
    else:
        checked = checked.withColumn("n", F.lit(0).cast("long"))
    rows = F.when(F.col("readable"), F.greatest(F.coalesce("n", F.lit(0)) - 1, F.lit(0)))
    status = F.when(~F.col("readable"), "unreadable").when(rows > 0, "ok").otherwise("empty")
    return checked.select("file", "bytes", rows.cast("long").alias("rows"), status.alias("status"), "has_header", "header")


def _sniff(spark: SparkSession, file: str) -> tuple[bool | None, list[str] | None]:
    """(whether a file's first row is a header, that row), by its first 1024 characters; nulls also for a file that can't be read, which its status tells."""
    try:
        text = csvfiles.head(spark, file, 4096).decode("utf-8", "ignore")[:1024]
        if csv.Sniffer().has_header(text):
            return True, next(csv.reader(text.splitlines()))
        return False, None
    except (csv.Error, StopIteration, OSError):
        return None, None
