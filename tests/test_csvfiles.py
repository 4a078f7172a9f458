"""Quoted CSV over many splits against the built-in reader and Python's."""

import csv
import io
import random

import pytest

from loomgraph.sources import csvfiles, readers

PIECES = ["a", "", "x y", 'say ""hi""', "line\nbreak", "many\n\n\nbreaks, and commas", ",", '""', "ünï", "long " * 40, "\n", 'end\n""']


def built_in(spark, path):
    return sorted(map(repr, spark.read.options(**readers.CSV_OPTIONS).csv(path).collect()))


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "10"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("seed", range(4))
def test_rows_equal_the_built_in_reader(spark, small_splits, tmp_path, seed):
    rng = random.Random(seed)
    rows = ['id,"he""ad",said', *(",".join([str(k), *(f'"{rng.choice(PIECES)}"' if rng.random() < 0.7 else rng.choice(["plain", "", '5" disk', 'q"uo"te']) for _ in range(2))]) for k in range(200))]
    rows += ['1,"""",x', '"2"x,"a"b"c,d', "3", "4,e,f,g,h"]
    (tmp_path / "x.csv").write_text("\n".join(rows) + ("\n" if seed % 2 else ""))
    path = f"file://{tmp_path}/x.csv"
    got = readers.read_csv(spark, path, na=False)
    assert got.columns == spark.read.options(**readers.CSV_OPTIONS).csv(path).columns == ["id", 'he"ad', "said"]
    assert sorted(map(repr, got.collect())) == built_in(spark, path)
    assert spark.read.option("lineSep", "\n").text(path).rdd.getNumPartitions() > 20


def test_one_record_over_many_splits(spark, small_splits, tmp_path):
    long = "\n".join(f"line {k}, with 'signs'" for k in range(300))
    out = io.StringIO()
    csv.writer(out, quoting=csv.QUOTE_ALL, lineterminator="\r\n").writerows([("a", "b"), ("1", long), ("2", "short"), ("3", f'{long}"'), ("4", "x")])
    (tmp_path / "long.csv").write_bytes(b"\xef\xbb\xbf" + out.getvalue().encode())
    rows = {r.a: r.b for r in readers.read_csv(spark, f"file://{tmp_path}/long.csv", na=False).collect()}
    assert rows == {"1": long, "2": "short", "3": f'{long}"', "4": "x"}


def test_many_files_headers_without_jobs(spark, tmp_path):
    for k in range(30):
        (tmp_path / f"f {k}%20+.csv").write_text(f"head,relation,tail\nh{k},r,\"t\n{k}\"\n" if k % 3 else f"Tail,x,Head,Relation\nt,\"1,2\",h{k},r\n")
    (tmp_path / "none.csv").write_text("a,b\n1,2\n")
    (tmp_path / "empty.csv").write_text("")
    files = readers.listing(spark, str(tmp_path), ".csv")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("headers", "headers")
    names = csvfiles.headers(spark, files)
    assert not tracker.getJobIdsForGroup("headers")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sorted(map(len, names.values())) == [0, 2, *[3] * 20, *[4] * 10]
    rows = {(r.head, r.tail, r.source_file) for r in readers.read_triples(spark, files).collect()}
    assert rows == {(f"h{k}", f"t\n{k}" if k % 3 else "t", f"f {k}%20+.csv") for k in range(30)}


def test_a_file_that_cannot_be_read_is_no_empty_file(spark, tmp_path):
    """Its rows would be missing without a word: reading fails, facts say so, and an empty file beside it is none."""
    for name in ("good", "gone"):
        (tmp_path / f"{name}.csv").write_text("head,relation,tail\n" + f"{name},r,t\n" * 200)
    (tmp_path / "empty.csv").write_text("")
    files = readers.listing(spark, f"file://{tmp_path}", ".csv")
    assert len(files) == 3 and readers.read_triples(spark, files).count() == 400
    sums = tmp_path / ".gone.csv.crc"  # a checksum that doesn't fit: the file system raises on reading, whoever reads
    sums.write_bytes(b"crc\0\0\0\x02\0" + b"\0" * 64)
    for read in (readers.read_triples, readers.read_csv):
        with pytest.raises(OSError, match="gone.csv"):
            read(spark, files)
    facts = {r.file.rsplit("/", 1)[1]: (r.status, r.header) for r in readers.file_facts(spark, f"file://{tmp_path}").collect()}
    assert facts["gone.csv"] == ("unreadable", None) and facts["good.csv"][0] == "ok" and facts["empty.csv"][0] == "empty"


@pytest.mark.parametrize(("line", "from_outside", "from_inside"), [("a,b", False, True), ('a,"b', True, False), ('"', True, False), ('""', False, True), ('a",b', False, False), ('x","y', True, True), ('a,"b""', True, False), ('"a"b"c,"d', True, True)])
def test_lines_as_functions(line, from_outside, from_inside):
    assert (csvfiles.inside_after(line, False), csvfiles.inside_after(line, True)) == (from_outside, from_inside)
