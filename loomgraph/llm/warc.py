"""WARC archives: writing, normalising monolithic gzip files, and reading by offset.

A file that was compressed as one gzip stream can't be entered in the middle. The normaliser inflates such a
stream once, front to back, and rewrites each record as a gzip member of its own, with a sidecar index (one JSON
line a record: offset, length, id, type) next to the new file. Readers then seek to any record.

Files are written through ``pyarrow.fs`` to the shared folder, under a name that no other attempt of the
task has; only names in a committed table count, so a task that runs again leaves no half-read file behind.
All streams are read and written in pieces: memory holds one record at most.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.sources.shared import cut, new_dir, ship
from loomgraph.sources.shared import remove as delete

PIECE = 1 << 20
GZIP = 16 + zlib.MAX_WBITS
#: Least payload, in bytes, for which an equal payload is recorded as a revisit.
LEAST_REVISIT = 1000


def _open(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(uri)


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response record, or a revisit of the record of page ``refers_to``, which holds no payload."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}", "Content-Type: application/http;msgtype=response",
    ]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-Id: {refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_head(raw: bytes) -> dict[str, str]:
    """Header fields by lower-case name; the version line under ``version``."""
    lines = raw.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {"version": lines[0]} | {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def inflate(file: BinaryIO) -> Iterator[bytes]:
    """The contents of a gzip file of one or many members, in pieces."""
    z = zlib.decompressobj(GZIP)
    while raw := file.read(PIECE):
        while raw:
            if piece := z.decompress(raw, PIECE):
                yield piece
            raw = z.unconsumed_tail
            if z.eof:
                raw, z = z.unused_data, zlib.decompressobj(GZIP)
    if not z.eof and (piece := z.flush()):
        yield piece


def split_records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header, whole record) of an inflated stream; ends early in a clear error when the stream is cut off."""
    buffer = bytearray()

    def fill(least: int) -> bool:
        while len(buffer) < least:
            if (more := next(pieces, None)) is None:
                return False
            buffer.extend(more)
        return True

    while fill(1):
        seen = 0
        while (at := buffer.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(buffer)
            if not fill(seen + 1):
                raise ValueError("the stream ends within a record's header")
        head = parse_head(bytes(buffer[:at]))
        size = at + 4 + int(head["content-length"]) + 4
        if not fill(size):
            raise ValueError("the stream ends within a record's block")
        yield head, bytes(buffer[:size])
        del buffer[:size]


def write_monolithic(rows: DataFrame, folder: str, level: int = 1) -> DataFrame:
    """Write ``page_id, url, payload, refers_to`` as WARC files of one gzip stream each; ``file, records`` as a table."""
    spark = rows.sparkSession
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, n = f"{folder}/whole-{uuid.uuid4().hex}.warc.gz", 0
        fs, path = _open(name)
        out = z = None
        for batch in batches:
            for page, url, payload, to in zip(*batch.columns, strict=True):
                if out is None:
                    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
                    out, z = fs.open_output_stream(path, compression=None), zlib.compressobj(level, zlib.DEFLATED, GZIP)
                out.write(z.compress(make_record(page.as_py(), url.as_py(), payload.as_py() or b"", to.as_py())))
                n += 1
        if out is not None:
            out.write(z.flush())
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], ["file", "records"])

    return cut(rows.select("page_id", "url", "payload", "refers_to").mapInArrow(run, "file string, records bigint"), "warc-files")


def normalise(files: DataFrame, folder: str, level: int = 6, remove: bool = False, run_length: int = 4096) -> DataFrame:
    """Rewrite each of ``file`` (gzip, monolithic or not) with a member for each record, and a sidecar index.

    Returns ``file, index, records, runs`` as a table: the new files, their sidecars, counts, and where in the sidecar each run of ``run_length``
    records begins, with the sidecar's end as last entry. A stream that is cut off or no WARC raises; an empty one has no records. remove: delete a source file once its copy is complete; sources are not read again.
    """
    spark = files.sparkSession
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source in batch.column(0).to_pylist():
                fs, path = _open(source)
                name = f"{folder}/records-{uuid.uuid4().hex}.warc.gz"
                to, target = _open(name)
                to.create_dir(target.rsplit("/", 1)[0], recursive=True)
                at = n = place = 0
                runs = []
                with fs.open_input_stream(path, compression=None) as file, to.open_output_stream(target, compression=None) as out, to.open_output_stream(f"{target}.idx", compression=None) as index:
                    for head, record in split_records(inflate(file)):
                        z = zlib.compressobj(level, zlib.DEFLATED, GZIP)
                        member = z.compress(record) + z.flush()
                        out.write(member)
                        entry = json.dumps({"offset": at, "length": len(member), "id": head.get("warc-record-id"), "type": head.get("warc-type")}).encode() + b"\n"
                        if n % run_length == 0:
                            runs.append(place)
                        index.write(entry)
                        at, place, n = at + len(member), place + len(entry), n + 1
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([f"{name}.idx"]), pa.array([n], pa.int64()), pa.array([[*runs, place]], pa.list_(pa.int64()))], ["file", "index", "records", "runs"])

    spread = files.select("file").repartition(max(1, files.count()), "file")  # a file is a task's work at least; count of files, not of records
    done = cut(spread.mapInArrow(run, "file string, index string, records bigint, runs array<bigint>"), "warc-normal")
    if remove:
        for folder_of in {r.d for r in files.select(F.regexp_extract("file", "^(.*)/[^/]*$", 1).alias("d")).distinct().collect()}:
            delete(spark, folder_of)
    return done


def read_archives(normal: DataFrame) -> DataFrame:
    """Read normalised archives through their sidecars: a row for each record.

    ``page_id, url, record_type, refers_to, payload_bytes, payload_digest, file, offset, length``; a revisit's payload figures are
    those its header states, a response's are taken from its payload. A run of records is a row of work, which reads its part of
    the sidecar and of the archive alone.
    """
    ship(normal.sparkSession)
    steps = F.arrays_zip(F.slice("runs", 1, F.size("runs") - 1).alias("first"), F.slice("runs", 2, F.size("runs") - 1).alias("end"))
    runs = normal.where("records > 0").select("file", "index", F.explode(steps).alias("r")).select("file", "index", "r.first", "r.end")
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "file", "offset", "length"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, sidecar, first, end in zip(*(c.to_pylist() for c in batch.columns[:4]), strict=True):
                fs, path = _open(name)
                with fs.open_input_file(_open(sidecar)[1]) as file:
                    file.seek(first)
                    entries = [json.loads(x) for x in file.read(end - first).splitlines()]
                rows = []
                with fs.open_input_file(path) as file:
                    file.seek(entries[0]["offset"])
                    for e in entries:  # neighbours in the file: one seek for the run
                        raw = zlib.decompress(file.read(e["length"]), GZIP)
                        cut_at = raw.index(b"\r\n\r\n")
                        head = parse_head(raw[:cut_at])
                        block = raw[cut_at + 4 : cut_at + 4 + int(head["content-length"])]
                        if head["warc-type"] == "revisit":
                            size, digest = int(head["x-payload-length"]), base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
                        else:
                            payload = block[block.index(b"\r\n\r\n") + 4 :]
                            size, digest = len(payload), hashlib.sha1(payload).hexdigest()
                        number = lambda k, h=head: int(h[k]) if k in h else None
                        rows.append((number("x-page-id"), head.get("warc-target-uri"), head["warc-type"], number("x-refers-to-page-id"), size, digest, name, e["offset"], e["length"]))
                kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    schema = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, file string, offset bigint, length bigint"
    # an explicit number of partitions: rows of this table are tiny, and AQE would put all the reading into one task
    return runs.repartition(max(1, min(runs.count(), 10_000)), "file", "first").mapInArrow(run, schema)


def plan_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST_REVISIT) -> DataFrame:
    """``page_id, url, payload, refers_to``: refers_to is the largest id with an equal payload of ``least`` bytes or more, null for that one itself.

    Null html is an empty payload. Rows without an id are always responses; equal rows decide alike.
    The join on digests is salted: only digests that occur more than once are on its other side, each as often as there are salts.
    """
    salts = 64
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8").alias("payload"))
    thin = cut(rows.where((F.octet_length("payload") >= least) & F.col("page_id").isNotNull()).select("page_id", F.sha2("payload", 256).alias("digest")), "warc-digests")
    leaders = thin.groupBy("digest").agg(F.max("page_id").alias("leader"), F.count("*").alias("n")).where("n > 1")
    leaders = leaders.select("digest", "leader", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    revisits = thin.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(salts)).cast("int")).join(leaders, ["digest", "salt"]).where("page_id != leader")
    decided = cut(revisits.select("page_id", "digest", F.col("leader").alias("refers_to")).distinct(), "warc-revisits")
    return rows.withColumn("digest", F.when(F.octet_length("payload") >= least, F.sha2("payload", 256))).join(decided, ["page_id", "digest"], "left").select("page_id", "url", "payload", "refers_to")


def archive_pages(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write pages to monolithic archives, normalise these, and read the result back; see :func:`read_archives`.

    A row for each row of pages, also for null ids, urls and html (an empty payload) and for equal rows, which decide alike; other columns are ignored. An empty
    table gives no rows. A record is held in memory as a whole, so the longest page is the bound.
    """
    spark: SparkSession = pages.sparkSession
    base = folder or new_dir(spark, "warc")
    files = write_monolithic(plan_revisits(pages), f"{base}/whole")
    normal = normalise(files, f"{base}/records", remove=True)
    return read_archives(normal)
