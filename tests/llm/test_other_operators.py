"""WARC, vectors, URLs, the pipeline and the queries' SQL."""

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomgraph.llm import hnsw, queries, topk, urlfilter, warc

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(name, same):
    same(queries.QUERIES[name], queries.ORACLE_SQL[name])


def test_archives(spark, tmp_path):
    big, other = "x" * 1500, "é" * 700
    rows = [(1, "http://a/1", big), (2, "http://a/2", big), (3, None, big), (4, "u", other), (4, "u", other), (5, "u", "x"), (6, "u", "x"), (7, "u", None), (None, "u", big), (8, "a\r\nb", "")]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, digest string")
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archive_pages(pages).collect()), key=repr)
    sha = lambda s: hashlib.sha1((s or "").encode()).hexdigest()
    want = [(i, len((h or "").encode()), sha(h), "revisit" if i in (1, 2) else "response", 3 if i in (1, 2) else None) for i, _, h in rows]
    assert got == sorted(want, key=repr)
    assert warc.archive_pages(pages.where("false")).count() == 0


def test_normaliser_makes_members_and_an_index(spark, tmp_path):
    records = [warc.make_record(i, "http://h/", b"p" * n, None) for i, n in enumerate((0, 10, 3_000_000))]
    z = zlib.compressobj(6, zlib.DEFLATED, warc.GZIP)
    source = tmp_path / "in" / "a.warc.gz"
    source.parent.mkdir()
    source.write_bytes(z.compress(b"".join(records)) + z.flush())
    files = spark.createDataFrame([(f"file://{source}",)], "file string")
    out = warc.normalise(files, f"file://{tmp_path}/out").first()
    assert out.records == 3 and source.exists()
    import json

    raw = open(out.file.removeprefix("file://"), "rb").read()
    index = [json.loads(x) for x in open(out["index"].removeprefix("file://"))]
    assert [zlib.decompress(raw[e["offset"] : e["offset"] + e["length"]], warc.GZIP) for e in index] == records
    assert b"".join(warc.inflate(pa.BufferReader(raw))) == b"".join(records)
    with pytest.raises(ValueError, match="the stream ends"):
        list(warc.split_records(iter([b"".join(records)[:-100]])))


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, kept string")


def brute_links(x, least=0.9):
    n = np.array([v / np.linalg.norm(v) for v in x])
    near = n @ n.T >= least
    np.fill_diagonal(near, False)
    return near


def test_embedding_groups(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(700, 16))
    x[100:250] = x[0] + 0.05 * rng.normal(size=(150, 16))  # one dense group, in shards of fewer vectors
    x[300:320] = x[280:300] + 0.1 * rng.normal(size=(20, 16))
    x = x.astype(np.float32).astype(float)
    near = brute_links(x)
    label = np.arange(len(x))
    while not np.array_equal(label, new := np.minimum(label, np.where(near, label[None, :], len(x)).min(1))):
        label = new
    odd = [(1000, None, ""), (1001, [], ""), (1002, [0.0] * 16, ""), (1003, [float("nan")] * 16, ""), (1004, [None] * 16, ""), (1005, [1.0, 2.0], ""), (None, [1.0] * 16, "")]
    df = vectors(spark, [(i, v.tolist(), "") for i, v in enumerate(x)] + odd)
    got = {r.vec_id: r for r in hnsw.near_duplicates(df, shard=200).collect()}
    assert len(got) == len(x) + len(odd)
    found, true = sum(got[i].n_links for i in range(len(x))), near.sum()
    assert 0.98 * true <= found <= true and all(got[i].n_links <= near[i].sum() for i in range(len(x)))
    assert found % 2 == 0 and all((got[i].n_links == 0) == (near[i].sum() == 0) for i in range(len(x)))
    assert np.mean([got[i].component_id == label[i] for i in range(len(x))]) >= 0.99
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in range(1000, 1006)) and got[None].kept
    assert hnsw.near_duplicates(df.where("false")).count() == 0


def test_sparse_links_are_not_missed(spark):
    """Few groups, some of equal vectors, among many vectors without links."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(6000, 64))
    at = rng.permutation(6000)[:310].tolist()
    for size in (20, 30, 45, 60):
        for noise in (0, 0.03):
            group, at = at[:size], at[size:]
            x[group] = x[group[0]] + noise * rng.normal(size=(size, 64))
    x = x.astype(np.float32).astype(float)
    near = brute_links(x)
    got = {r.vec_id: r for r in hnsw.near_duplicates(vectors(spark, [(i, v.tolist(), "") for i, v in enumerate(x)])).collect()}
    assert [got[i].n_links for i in range(len(x))] == near.sum(1).tolist()
    for i in np.flatnonzero(near.any(1)).tolist():
        assert got[i].component_id == min(i, int(np.flatnonzero(near[i])[0]))


def test_recall_over_shards(spark):
    """Queries with an id divisible by 50 against all rows, in four shards that beams search: groups of 2 to 40 near vectors."""
    rng = np.random.default_rng(12)
    x = []
    while len(x) < 12_000:
        base = rng.normal(size=32)
        x += [base + 0.12 * rng.normal(size=32) for _ in range(int(rng.integers(2, 41)))]
    x = np.array(x)[rng.permutation(len(x))].astype(np.float32).astype(float)
    near = brute_links(x)
    got = {r.vec_id: r.n_links for r in hnsw.near_duplicates(vectors(spark, [(i, v.tolist(), "") for i, v in enumerate(x)]), shard=8192).collect()}
    ask = range(0, len(x), 50)
    true, found = sum(near[i].sum() for i in ask), sum(got[i] for i in ask)
    assert true > 2000 and 0.99 * true <= found <= true, found / true


def test_small_world_recall():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = hnsw.SmallWorld.build(x)
    q = x[:200] + 0.02 * rng.normal(size=(200, 24))
    found = hnsw.SmallWorld.from_bytes(graph.to_bytes(), x).search(q.astype(np.float32), 32)[0]
    assert np.mean(found[:, 0] == np.argmax(q @ x.T, axis=1)) >= 0.9


def test_archives_of_many_pages(spark, tmp_path):
    """Brute force over mixed pages: payloads around the limit, many copies, nulls; in runs of a few records."""
    rng = np.random.default_rng(4)
    bodies = [None, "", *[c * n for c in "aé日" for n in (1, 333, 334, 499, 500, 999, 1000, 5000)]]
    rows = [(i, f"http://h/{i}", bodies[int(k)]) for i, k in enumerate(rng.integers(0, len(bodies), 400))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    raw = {i: (h or "").encode() for i, _, h in rows}
    last = {}
    for i, h in raw.items():
        last[h] = max(i, last.get(h, i))
    want = {(i, len(h), hashlib.sha1(h).hexdigest(), "revisit" if len(h) >= 1000 and last[h] != i else "response", last[h] if len(h) >= 1000 and last[h] != i else None) for i, h in raw.items()}
    assert sum(w[3] == "revisit" for w in want) > 100
    files = warc.write_monolithic(warc.plan_revisits(pages), f"file://{tmp_path}/whole")
    for length in (4096, 7, 1):
        normal = warc.normalise(files, f"file://{tmp_path}/records{length}", run_length=length)
        got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archives(normal).collect()]
        assert len(got) == len(want) and set(got) == want


def test_top_k(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 8))
    x[200:300] = x[7]  # ties over many rows
    rows = [(i, v.astype(np.float32).tolist(), "") for i, v in enumerate(x)] + [(900, None, ""), (901, [float("inf")] * 8, ""), (902, [None] * 8, ""), (903, [1.0], "")]
    data = topk.scaled(vectors(spark, rows))
    got = topk.exact_top_k(data, data.where("id % 50 = 0"), k=10, pivots=7, block=30).collect()
    m = np.floor(1024 * x.astype(np.float32).astype(float)).astype(int)
    want = []
    for q in range(0, 400, 50):
        s = m @ m[q]
        best = sorted((i for i in range(400) if i != q), key=lambda i: (-s[i], i))[:10]
        want += [(q, r + 1, i, int(s[i])) for r, i in enumerate(best)]
    assert sorted(map(tuple, got)) == sorted(want)
    again = topk.exact_top_k(data, data.where("id % 50 = 0"), k=10, pivots=7, block=30, query_block=3).collect()
    assert sorted(map(tuple, again)) == sorted(want)
    few = data.where("id < 4")
    assert topk.exact_top_k(few, few.where("id = 0")).count() == 3
    assert topk.exact_top_k(data.where("false"), data).count() == 0 and topk.exact_top_k(data, data.where("false")).count() == 0


def test_huge_components_stay_exact():
    a, b = np.array([[2**40, 3]]), np.array([[2**20, 1], [1, 2**20]])
    assert topk._scores(a, b).tolist() == [[2**60 + 3, 2**40 + 3 * 2**20]]
    with pytest.raises(OverflowError):
        topk._scores(np.array([[2**40]]), np.array([[2**30]]))


@pytest.mark.parametrize(("url", "host", "path", "rule"), [
    ("http://A.Example.ORG/es/1?q#f", "a.example.org", "/es/1", "example.org/es/"), ("https://example.org/en/12", "example.org", "/en/12", "example.org/en/1"),
    ("https://example.org/en/2", "example.org", "/en/2", "org/"), ("x://badexample.org?/es/", "badexample.org", "", None), ("http://myexample.org/es/1", "myexample.org", "/es/1", "org/"),
    ("http://a.com/fr/x", "a.com", "/fr/x", "com/fr/"), ("http://com/de/", "com", "/de/", "com/de/"), ("no scheme", "", "", None), (None, "", "", None), ("", "", "", None), ("http://b.net/de/", "b.net", "/de/", None),
])
def test_rules(url, host, path, rule):
    assert urlfilter.split_url(url) == (host, path)
    found = urlfilter.match(host, path, queries.URL_RULES)
    assert (found.text if found else None) == rule


RULES_SQL = """
    WITH p AS (SELECT page_id, coalesce(url, '') AS url, strpos(coalesce(url, ''), '://') AS mark FROM pages),
    r AS (SELECT page_id, CASE WHEN mark > 0 THEN substr(url, mark + 3) ELSE '' END AS rest FROM p),
    h AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM r),
    u AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
    k(rh, rp, allow) AS (VALUES ('org', '/', true), ('example.org', '/es/', false), ('example.org', '/en/1', false), ('com', '/fr/', true), ('com', '/de/', false)),
    m AS (SELECT page_id, rh || rp AS rule, allow, row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC) AS n FROM u JOIN k ON (host = rh OR suffix(host, '.' || rh)) AND starts_with(path, rp))
    SELECT u.page_id, host, path, rule, CASE WHEN allow THEN 'allow' WHEN NOT allow THEN 'block' END AS ruled FROM u LEFT JOIN m ON m.page_id = u.page_id AND n = 1"""


def test_rules_over_the_whole_table(spark, duck):
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in queries.op8_url_filter(spark, SF).collect()}
    want = {r[0]: r[1:] for r in duck.sql(RULES_SQL).fetchall()}
    assert {i: x[:3] for i, x in got.items()} == {i: x[:3] for i, x in want.items()}
    assert all(got[i][3] == x[3] for i, x in want.items() if x[3])
    assert {x[2] for x in got.values()} == {None, "org/", "example.org/es/", "example.org/en/1", "com/fr/", "com/de/"}


def brute_score(model, url):
    """The model's probability, n-gram by n-gram."""
    host, path = urlfilter.split_url(url)
    z, found = 0.0, 0
    for kind, part in ((1, host), (2, path)):
        raw = b"^" + part.encode() + b"$" if part else b""
        for n in model.sizes:
            for k in range(len(raw) - n + 1):
                h = kind
                for c in raw[k : k + n]:
                    h = (h ^ c) * 0x100000001B3 % 2**64
                h = (h ^ h >> 29) * 0x9E3779B97F4A7C15 % 2**64
                z, found = z + model.weights[h >> (64 - model.bits)], found + 1
    return 1 / (1 + np.exp(-(model.bias + z / max(1, found) ** 0.5)))


def test_url_model(spark):
    rows = urlfilter.labelled_rows()
    out = [{urlfilter.held_out_word(w) for w in r.words} for r in rows]
    train, rest = [(r.url, r.blocked) for r, o in zip(rows, out, strict=True) if True not in o], [r for r, o in zip(rows, out, strict=True) if False not in o]
    model = urlfilter.UrlModel().fit(train)

    def measured(model, rows):
        """Recall of unwanted and share of blocked harmless rows."""
        said = model.scores([urlfilter.split_url(r.url) for r in rows]) >= 0.5
        true = np.array([r.blocked for r in rows])
        return (said & true).sum() / max(1, true.sum()), (said & ~true).sum() / max(1, (~true).sum())

    by_word = measured(model, rest)
    by_kind = [measured(urlfilter.UrlModel().fit([(r.url, r.blocked) for r in rows if r.kind != k]), [r for r in rows if r.kind == k])[0] for k in urlfilter.UNWANTED]
    known = measured(urlfilter.UrlModel().fit(urlfilter.labelled_urls()), rows)
    print(f"unseen words: recall {by_word[0]:.2f}, harmless blocked {by_word[1]:.3f} of {len(rest)}; unseen kinds: recall {np.mean(by_kind):.2f}; known words: recall {known[0]:.2f}, harmless blocked {known[1]:.3f}")
    assert known[0] >= 0.95 and known[1] <= 0.01 and by_word[1] <= 0.05, "what it never saw is allowed; README states the recall"
    assert np.array_equal(model.weights, urlfilter.UrlModel().fit(train).weights)
    odd = ["", "x", "no scheme", "http://", "http://a", "http://é.com/ü", "http://porn-casino.net/" + "a/" * 5000]
    assert np.allclose(model.scores([urlfilter.split_url(u) for u in odd]), [brute_score(model, u) for u in odd])
    pages = spark.createDataFrame([(1, "http://poker-slots.example.net/de/", "x"), (1, None, "y"), (None, "http://x.com/fr/casino", "z"), (2, "http://casino.com/" + "q" * 100_000, "")], "page_id long, url string, host string")
    got = [tuple(r)[:5] for r in urlfilter.judge(pages, queries.URL_RULES, model).collect()]
    assert got[0] == (1, "poker-slots.example.net", "/de/", None, "block") and got[1] == (1, "", "", None, "allow") and got[2][3:] == ("com/fr/", "allow") and len(got[3][2]) == 100_001
    assert urlfilter.judge(pages.where("false"), [], model).count() == 0


def test_no_word_of_the_given_pages_is_in_the_table():
    """The table is general knowledge; words of the test's own hosts would only be learned by heart."""
    import duckdb

    hosts = [r[0] for r in duckdb.sql("SELECT DISTINCT split_part(split_part(url, '://', 2), '/', 1) FROM '/root/testdata/sf0.1/pages.parquet'").fetchall()]
    words = {w for h in hosts if h for w in re.findall("[a-z]{3,}", h.lower())} - set(urlfilter.ENDS) - {"www", "example"}
    assert not words & {w for r in urlfilter.labelled_rows() if r.blocked for w in r.words}


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        docs = spark.createDataFrame(docs.toPandas(), docs.schema)
        seen[name] = docs
    before = spark.read.parquet(f"{SF}/documents.parquet")
    assert all(seen[n].columns == before.columns for n, _ in corpus_pipeline.STAGES[:-1])
    assert seen["language_id"].count() == before.count()  # all tables' texts are in a known language
    ids = lambda n: {r.doc_id for r in seen[n].select("doc_id").collect()}
    assert ids("bpe") <= ids("mix_sources") <= ids("simhash_near_dedup") <= ids("line_dedup") <= ids("language_id")
    lines = seen["line_dedup"].select(F.explode(F.split("text", "\n")).alias("l")).where(F.trim("l") != "")
    assert lines.count() == lines.distinct().count()
    run = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, run.collect())) == sorted(map(tuple, seen["bpe"].collect()))
    few = before.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, few, SF).count() == 0
