"""Sources, providers and the stages end to end, with recorded answers and injected faults."""

import hashlib
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.operators import evaluate, graph, stats, vectors
from loomgraph.plans import embeddings, roundtrips, workflow
from loomgraph.plans.queries import QUERIES
from loomgraph.plans.providers import HashingEncoder, KeyedClient, KeyRotation, Policy, RecordedProvider, Reply, RuleProvider, ServiceError, call_provider, encode
from loomgraph.sources import readers, writers
from loomgraph.sources.shared import cut
from loomgraph.streaming.incremental import process_new_files, sample_new_files

QUIET = Policy(attempts=2, pause=0, timeout_pause=0, at_once=2)


@pytest.fixture
def csvs(tmp_path):
    base = tmp_path / "kg"
    for name, body in {
        "social_sciences/law/law_all.csv": "Head,Relation,Tail\ncourt,is,place\n\"a, b\",r,NA\n",
        "social_sciences/law/law_1.csv": "head,relation,tail\nnot,read,here\n",
        "humanities/arts/x.csv": "head,relation,tail\npainting,isa,art\n",
        "humanities/arts/short.csv": "head,tail\np,q\n",
        "humanities/arts/empty.csv": "head,relation,tail\n",
    }.items():
        (base / name).parent.mkdir(parents=True, exist_ok=True)
        (base / name).write_text(body)
    return str(base)


def test_subfield_triples(spark, csvs):
    rows = {tuple(r) for r in readers.load_subfield_triples(spark, csvs).collect()}
    assert rows == {("law", "court", "is", "place", "court is place"), ("law", "a, b", "r", "nan", "a, b r nan"), ("arts", "painting", "isa", "art", "painting isa art")}


def test_discovery(spark, csvs):
    assert readers.subjects(spark, csvs) == ["humanities", "social_sciences"]
    assert len(readers.listing(spark, csvs, ".csv", recursive=True)) == 5 and readers.listing(spark, f"{csvs}/none") == []
    assert readers.domains_with_prototypes(spark, f"{csvs}/humanities", f"{csvs}/humanities") == ["arts"]
    assert readers.read_template(spark, f"{csvs}/none", "own") == "own"
    assert readers.read_triples(spark, [f"{csvs}/humanities/arts/short.csv"]).count() == 0
    assert readers.read_positional(spark, f"{csvs}/humanities/arts/x.csv", ["a", "b"]).first().asDict() == {"a": "painting", "b": "isa"}


def test_provider_never_raises(spark):
    df = spark.createDataFrame([("a",), ("b",), (" ",), (None,)], "prompt string")
    got = {r.prompt: (r.response, r.status, r.attempts) for r in call_provider(df, RecordedProvider({"a": "A"}), policy=QUIET).collect()}
    assert got == {"a": ("A", "ok", 1), "b": ("", "KeyError", 2), " ": ("", "empty", 0), None: ("", "empty", 0)}


def test_policy_retries_and_keys():
    calls, naps = [], []

    def flaky(prompt):
        calls.append(prompt)
        if len(calls) < 3:
            raise TimeoutError
        return "x"

    assert Policy(attempts=3, sleep=naps.append).call(flaky, "p") == ("x", "ok", 3) and naps == [0.5, 1.0]
    keys = KeyRotation(["k", "l"])
    assert keys.after(429) == 5.0 and keys.key() == "k" and keys.after(503) == 0.0 and keys.key() == "l" and keys.after(404) is None


def test_a_client_goes_on_after_every_kind_of_failure():
    naps, seen = [], []

    def send(prompt, key):
        seen.append(key)
        return {"k0": lambda: Reply(401), "k1": lambda: time.sleep(5), "k2": lambda: Reply(429, retry_after=7.0) if seen.count("k2") < 3 else Reply(500), "k3": lambda: 1 / 0, "k4": lambda: Reply(200, prompt)}[key]()

    began = time.time()
    assert KeyedClient(send, [f"k{i}" for i in range(5)], attempts=9, deadline=0.05, sleep=naps.append)("hello") == "hello"
    assert seen == ["k0", "k1", "k2", "k2", "k2", "k3", "k4"] and naps == [7.0, 7.0] and time.time() - began < 2
    seen.clear()
    assert KeyedClient(send, [f"k{i}" for i in range(5)], attempts=1)("next") == "next" and seen == ["k4"], "a worker's clients share the state of their keys"
    with pytest.raises(ServiceError, match="404"):
        KeyedClient(lambda p, k: Reply(404), ["x"], sleep=naps.append)("p")
    with pytest.raises(ServiceError, match="503"):
        KeyedClient(lambda p, k: Reply(503), ["y", "z"], attempts=3)("p")
    with pytest.raises(ValueError, match="no key"):
        KeyedClient(lambda p, k: Reply(200), [])("p")


def test_a_hanging_call_gives_its_place_back():
    from concurrent.futures import ThreadPoolExecutor

    policy = Policy(attempts=1, deadline=0.05, timeout_pause=0)
    began = time.time()
    with ThreadPoolExecutor(1) as pool:
        got = list(pool.map(lambda p: policy.call(lambda q: time.sleep(3) if q == "hang" else q, p), ["hang", "a", "hang", "b", "quiet"]))
    assert [g[1] for g in got] == ["timeout", "ok", "timeout", "ok", "ok"] and time.time() - began < 2
    assert Policy(attempts=2, pause=0).call(lambda p: "", "p") == ("", "blank", 2)


def test_a_busy_worker_makes_no_timeouts(monkeypatch):
    """Calls that answer at once keep their status however long their threads stand in line, or wait for a thread; one that hangs still ends."""
    import threading

    from loomgraph.plans import providers

    over = threading.Event()

    def spin():
        while not over.is_set():
            sum(range(200))

    busy = [threading.Thread(target=spin, daemon=True) for _ in range(24)]
    [t.start() for t in busy]
    try:
        once, client = Policy(attempts=1, pause=0, timeout_pause=0, deadline=0.05), KeyedClient(lambda p, key: time.sleep(5) if p == "hang" else Reply(500), ["busy", "worker"], attempts=1, deadline=0.05)
        assert [once.attempt(client, "p")[1] for _ in range(6)] == ["http_500"] * 6
        assert providers.Calls(once, str.upper, ["a"] * 30).run() == [("A", "ok", 1)] * 30
        assert once.attempt(client, "hang")[1] == "timeout"
    finally:
        over.set()
        [t.join() for t in busy]
    real, refused = threading.Thread, []

    def refuse():
        raise RuntimeError("can't start new thread")

    def none_left(*args, **kwargs):
        thread = real(*args, **kwargs)
        if len(refused) < 3:
            refused.append(1)
            thread.start = refuse
        return thread

    monkeypatch.setattr(providers.threading, "Thread", none_left)
    assert once.attempt(client, "p")[1] == "http_500" and len(refused) == 3


def test_a_rate_over_the_cluster(spark):
    df = spark.range(40).select(F.col("id").cast("string").alias("prompt")).repartition(7)
    began = time.time()
    got = call_provider(df, RuleProvider(lambda p: f"{time.time()}"), policy=Policy(width=2, rate=20.0, at_once=8)).collect()
    times = sorted(float(r.response) for r in got)
    assert len(got) == 40 and times[-1] - times[0] >= 0.8 * 40 / 20 - 0.2 and time.time() - began < 60
    assert max(sum(a <= t < a + 0.5 for t in times) for a in times) <= 14, "no half second holds more than its share of calls"
    with pytest.raises(ValueError, match="width"):
        Policy(rate=1.0)


def questions(spark):
    rows = [("s", i, f"question {i} about court", "one", "two", None, "", "A") for i in range(4)]
    return spark.createDataFrame(rows, "subject string, id long, question string, A string, B string, C string, D string, answer string")


def test_stages_and_resume(spark, csvs, tmp_path):
    triples = readers.load_subfield_triples(spark, csvs).withColumn("triple_id", F.xxhash64("text"))
    vec = lambda df, c: encode(df, HashingEncoder(256), c)
    got = workflow.retrieve(vec(questions(spark), "question"), vec(triples, "text"), RuleProvider(lambda p: "Answer: [law][arts]" if "question 3" not in p else "[none]"), k=2, policy=QUIET)
    rows = {r.id: r for r in got.collect()}
    assert len(rows[0].relatedTriples) == 2 and rows[0].relatedTriples[0].text == "court is place"
    assert rows[3].subdomains == ["other"] and rows[3].relatedTriples == []
    more = workflow.enrich(got, RuleProvider(lambda p: "Enhanced Triples:\n[n, r, m]"), QUIET)
    assert [t.head for t in more.where("id = 0").first().enrich_triples] == ["n"]
    out, model = str(tmp_path / "out"), RuleProvider(lambda p: "So it is B." if "Knowledge" in p else "A")
    assert workflow.reason_into(more.where("id < 2"), out, model, policy=QUIET) == 2
    assert workflow.reason_into(more, out, model, policy=QUIET) == 2 and workflow.reason_into(more, out, model, policy=QUIET) == 0
    done = spark.read.parquet(out)
    assert done.count() == 4 and done.select("id").distinct().count() == 4
    row = done.where("id = 0").first()
    assert row.origin_prediction == "A" and row.edgetable_prediction == "B" and "(court,is,place)" in row.edgetable_prompt and row.triple_count == 3
    seen = workflow.progress(spark, out, questions(spark).groupBy("subject").agg(F.count("*").alias("total"))).first()
    assert (seen.processed, seen.percentage) == (4, 100.0)
    cells = {r.prediction_format: r.accuracy for r in evaluate.accuracy(evaluate.long_predictions(done.withColumnRenamed("subject", "dataset"))).collect()}
    assert cells["origin"] == 1.0 and cells["edgetable"] == 0.0
    with pytest.raises(ValueError, match="unknown formats"):
        workflow.reason_into(more, out, model, ["tables"])


def test_embeddings_are_made_once_and_failures_stay_apart(spark, tmp_path):
    path, calls = f"file://{tmp_path}/store", spark.sparkContext.accumulator(0)

    def encoder(texts):
        calls.add(len(texts))
        if "bad" in texts:
            raise OSError
        return [[len(t), 1.0] for t in texts]

    rows = [("law", "one"), ("law", "one"), ("law", None), ("law", ""), ("arts", "bad"), ("arts", "good"), (None, "one"), ("arts2", "good")]
    df = spark.createDataFrame(rows, "sub string, text string").repartition(3)
    assert embeddings.store(df, path, encoder, "e", group="sub", batch=2) == 6 == calls.value, "a null text reads as empty, a repeated one is encoded once"
    assert embeddings.store(df, path, encoder, "e", group="sub") == 0 and calls.value == 6
    found = {(r.sub, r.text, r.vec[0]) for r in embeddings.embedded(df, path, "e", group="sub").collect()}
    assert found == {("law", "one", 3.0), ("law", None, 0.0), ("law", "", 0.0), (None, "one", 3.0), ("arts2", "good", 4.0)}, "a subfield with a failure has no vectors"
    assert embeddings.store(df, path, lambda t: np.ones((len(t), 2)), "e", group="sub", again=True) >= 1
    assert embeddings.embedded(df, path, "e", group="sub").count() == len(rows)
    assert embeddings.store(df, path, lambda t: np.ones((len(t), 3)), "other", group="sub") == 6
    assert embeddings.store(df.where("false"), f"file://{tmp_path}/none", encoder, "e") == 0
    assert embeddings.store(df, f"file://{tmp_path}/odd", lambda t: np.ones(3), "odd") == 4 and {r.status for r in embeddings.statuses(spark, f"file://{tmp_path}/odd", "odd").collect()} == {"ValueError"}


def test_a_run_writes_vectors_once(spark, tmp_path, monkeypatch):
    """Vectors go to the store only, and a run that lacks nothing writes none; half a store is filled up, by group, null ones too."""
    written = []
    monkeypatch.setattr(embeddings, "cut", lambda df, name, **more: (written.append(df.columns), cut(df, name, **more))[1])
    df, path = spark.range(40).selectExpr("concat('t', id) as text", "if(id % 4 = 0, null, string(id % 4)) as sub"), f"file://{tmp_path}/store"
    encoder = lambda texts: np.array([[len(t), 1.0] for t in texts])
    assert embeddings.store(df.where("text < 't2'"), path, encoder, "e", group="sub") == 12
    assert embeddings.store(df.unionByName(df), path, encoder, "e", group="sub") == 28 and embeddings.store(df, path, encoder, "e", group="sub") == 0
    assert all("vec" not in c for c in written)
    assert embeddings.embedded(df, path, "e", group="sub").count() == 40 and sorted(r[:] for r in embeddings.statuses(spark, path, "e").select(F.coalesce("group", F.lit("-")), "status", "texts").collect()) == [(g, "ok", 10) for g in "-123"]


def test_top_k_is_sorted_and_within_candidates(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0], ["a", "b"]), (2, [0.0, 0.0], ["a"]), (3, [1.0, 1.0], ["none"])], "question_id int, q array<double>, subfields array<string>")
    t = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "a", [2.0, 0.0]), (3, "b", [0.0, 1.0]), (4, "c", [1.0, 0.0])], "triple_id int, subfield string, x array<double>")
    got = [tuple(r)[:3] for r in vectors.routed_top_k(q, t, 2).orderBy("question_id", "rank").collect()]
    assert got == [(1, 1, 2), (1, 2, 1), (2, 1, 2), (2, 2, 1)]


def test_blocks_on_both_sides_change_nothing(spark):
    rng = np.random.default_rng(1)
    q = spark.createDataFrame([(i, rng.normal(size=4).tolist(), ["a", "b"]) for i in range(40)], "question_id int, q array<double>, subfields array<string>")
    t = spark.createDataFrame([(i, "ab"[i % 2], rng.normal(size=4).tolist()) for i in range(90)], "triple_id int, subfield string, x array<double>")
    found = [sorted((r.question_id, r["rank"], r.triple_id, round(r.similarity, 9)) for r in vectors.routed_top_k(q, t, 5, **blocks).collect()) for blocks in ({}, {"block": 7, "question_block": 9})]
    assert found[0] == found[1] and len(found[0]) == 200


def test_long_vectors_take_seconds(spark):
    """The length of a vector is computed once, not for each component."""
    v = spark.range(4000).select("id", F.transform(F.sequence(F.lit(1), F.lit(512)), lambda i: F.sin(i * F.col("id"))).alias("v")).cache()
    v.count()
    classes = spark.createDataFrame([("x", 0, [1.0] * 512), ("y", 1, [-1.0] * 512)], "name string, ord int, prototype array<double>")
    began = time.time()
    lengths = v.select(vectors.unit(F.col("v")).alias("u")).select(F.sqrt(vectors.dot(F.col("u"), F.col("u"))).alias("n"))
    assert lengths.where("abs(n - 1) > 1e-9").count() == 1, "the zero vector"
    assert vectors.classify(v, "v", classes, "name").groupBy("label").count().count() == 2
    assert time.time() - began < 30


def test_odd_vectors_and_classes(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0], "k"), (2, None, "k"), (3, [1.0], "k"), (4, [0.0, 0.0], "k"), (5, [1.0, 1.0], None), (6, [1.0, 1.0], "other")], "id int, v array<double>, g string")
    classes = spark.createDataFrame([("k", "x", 0, [1.0, 0.0]), ("k", "n", 1, None)], "g string, name string, ord int, prototype array<double>")
    got = {r.id: (r.best_sim, r.label) for r in vectors.classify_within(rows, "v", "g", classes, "name", 0.5).collect()}
    assert got == {1: (1.0, "x"), 2: (None, "other"), 3: (None, "other"), 4: (0.0, "other")}
    assert {r.label for r in vectors.classify(rows, "v", classes.where("false"), "name").collect()} == {"Other"}
    with pytest.raises(ValueError, match="more than a taxonomy"):
        vectors.Prototypes([("", i, "c", [1.0]) for i in range(11)], most=10)


def test_threshold_and_ties(spark):
    classes = spark.createDataFrame([("x", 0, [1.0, 0.0]), ("y", 1, [1.0, 0.0])], "name string, ord int, prototype array<double>")
    rows = spark.createDataFrame([(1, [2.0, 0.0]), (2, [-1.0, 0.0])], "id int, v array<double>")
    assert [r.label for r in vectors.classify(rows, "v", classes, "name").orderBy("id").collect()] == ["x", "Other"]


def test_overall_is_the_sum_of_cells(spark):
    cells = spark.createDataFrame([("d", "f", 1, 2, 3, 0.5), ("e", "f", 3, 3, 3, 1.0)], "dataset string, prediction_format string, correct_count long, valid_total long, total_samples long, accuracy double")
    row = evaluate.overall(cells).first()
    assert (row.total_correct, row.total_valid, row.overall_accuracy) == (4, 5, 0.8)
    bands = {r.accuracy_range: r.dataset_count for r in evaluate.accuracy_bands(cells).collect()}
    assert bands["Excellent (90-100%)"] == 1 and sum(bands.values()) == 2


def test_a_matrix_from_figures_is_ranked(spark):
    matrix = evaluate.matrix_of(spark, {"a": {"x": 0.5, "y": 0.7}, "b": {"y": 0.9}, "c": {"x": 0.1, "y": None}})
    assert matrix.columns == ["dataset", "x", "y"]
    assert [(r.dataset, round(r.row_mean, 9), r["rank"]) for r in evaluate.matrix_ranking(matrix, ["x", "y"], 2).orderBy("rank").collect()] == [("b", 0.9, 1), ("a", 0.6, 2), ("c", 0.1, 3)]


def test_throughput(spark):
    calls = spark.createDataFrame([("ok", 0.0, 2.0), ("ok", 1.0, 3.0), ("timeout", 3.5, 0.5), ("ok", None, 1.0)], "status string, began double, seconds double")
    assert stats.throughput(calls, "began", "seconds").first()[:] == (2, 4.0, 0.5) and stats.throughput(calls.limit(1).withColumn("seconds", F.lit(0.0)), "began", "seconds").first().qps == 0.0


def test_union_and_samples(spark):
    a, b = spark.createDataFrame([("x", "y")], "Head string, Tail string"), spark.createDataFrame([("z",)], "HEAD string")
    assert {(r.head, r.tail, r.source_file) for r in stats.union_all({"a": a, "b": b}).collect()} == {("x", "y", "a"), ("z", None, "b")}
    assert stats.sample_exact(a, 5).count() == 1


def test_samples_of_any_size(spark):
    """Against sorting: few, half, all; copies of one row make up most of a table."""
    df = spark.range(300).select(F.col("id"), F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.lit("x")).alias("s")).unionByName(spark.createDataFrame([(-1, "copy")], "id long, s string").withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(500)))).drop("n")).cache()
    in_order = [tuple(r)[1:] for r in sorted((hashlib.md5("\x01".join(["5", str(r.id), *([r.s] if r.s else [])]).encode()).hexdigest(), r.id, r.s) for r in df.collect())]
    for n in (0, 1, 40, 399, 799, 800, 5000):
        got = stats.sample_exact(df, n, seed=5, most_sorted=20)
        assert Counter(map(tuple, got.collect())) == Counter(in_order[:n]), n
    assert stats.sample_exact(df.where("false"), 3).count() == 0


def test_sampling_half_sorts_no_half(spark):
    df = spark.range(20_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("s"))
    plan = stats.sample_exact(df, 10_000, most_sorted=100)._jdf.queryExecution().executedPlan().toString()
    limits = [int(x) for x in re.findall(r"limit=(\d+)", plan)]
    assert max(limits, default=0) <= 100 and "Exchange SinglePartition" not in plan


def test_latency_of_odd_values(spark):
    values = {"one": [5.0], "ties": [1.0] * 7 + [2.0] * 3, None: [float(x) for x in range(1000)], "far": [*map(float, range(100)), 1e12]}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs] + [("one", None)], "k string, v double")
    for bins in (1, 3, 4096):
        got = {r.k: r for r in stats.latency(df, "v", "k", bins=bins).collect()}
        for k, vs in values.items():
            want = [sorted(vs)[min(int(len(vs) * q), len(vs) - 1)] for q in (0.5, 0.9, 0.95, 0.99)]
            assert [got[k].p50, got[k].p90, got[k].p95, got[k].p99] == want and (got[k].n, got[k].min, got[k].max) == (len(vs), min(vs), max(vs))
    assert stats.latency(df.where("false"), "v", "k").count() == 0 and stats.latency(df.drop("k"), "v").first().n == sum(map(len, values.values()))


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("Natural Sciences", "a", ["x & y", "x & y"]), ("Other", "b", ["z"])], "field string, v string, labels array<string>")
    writers.write_classes(df.drop("labels"), str(tmp_path / "c"), "field")
    assert {p.name for p in (tmp_path / "c").iterdir() if p.is_dir()} == {"field_dir=natural_sciences", "field_dir=other"}
    writers.write_labels(df, str(tmp_path / "l"), "labels")
    assert spark.read.option("header", True).csv(str(tmp_path / "l")).where("label = 'x_y'").count() == 2
    writers.write_entities(spark.createDataFrame([("d", "b"), ("d", "a")], "domain string, entity string"), "domain", str(tmp_path / "e"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "e/domain=d")).collect()] == ["a", "b"]
    assert not writers.write_sample(df.where("false").drop("labels"), str(tmp_path / "s"))


def test_facts_of_files(spark, tmp_path):
    files = {"a b%+.csv": b"id,name\n1,\"x\ny\"\n2,z\n", "sub/bare.csv": b"1,2\n3,4\n5,6\n", "empty.csv": b"", "head.csv": b"id,name\n", "binary.csv": b"a,b\n\xff\xfe\x00,1\n", "x.txt": b"no"}
    for name, data in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = {r.file.rsplit("/", 1)[1]: (r.bytes, r.rows, r.status, r.has_header) for r in readers.file_facts(spark, f"file://{tmp_path}").collect()}
    assert {k: v[:3] for k, v in got.items()} == {"a b%+.csv": (20, 2, "ok"), "bare.csv": (12, 2, "ok"), "empty.csv": (0, 0, "empty"), "head.csv": (8, 0, "empty"), "binary.csv": (10, None, "unreadable")}
    assert (got["a b%+.csv"][3], got["bare.csv"][3], got["empty.csv"][3]) == (True, False, None)
    summary = stats.folder_summary(readers.file_facts(spark, str(tmp_path))).first()
    assert (summary.files, summary.ok, summary.failed, summary.rows, round(summary.mb * (1 << 20))) == (5, 2, 3, 4, 50)
    assert readers.file_facts(spark, f"{tmp_path}/none").count() == 0


def test_one_component_is_read_from_its_files(spark, tmp_path):
    edges = spark.range(4000).select(F.concat(F.lit("n"), F.col("id") - F.col("id") % 8).alias("src"), F.concat(F.lit("n"), F.col("id")).alias("dst"), F.lit("isa").alias("relation"))
    triples = edges.toDF("head", "tail", "relation")
    labels, path = graph.components(triples), str(tmp_path / "store")
    writers.write_components(edges, labels, graph.component_index(edges, labels), path)
    one = readers.read_component(spark, path, "n10")
    assert one.count() == 8 and len(one.inputFiles()) == 1 and "size_group=tiny" in one.inputFiles()[0]
    assert readers.read_components(spark, path).where("component = 'n10'").exceptAll(one).count() == 0 and readers.read_component(spark, path, "none").count() == 0


def test_progress_and_samples_over_many_batches(spark, tmp_path):
    """Each batch leaves its time; a sample over batches is that of all rows at once."""
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(2000).repartition(200).write.parquet(source)
    batches = process_new_files(spark, source, "id long", target, str(tmp_path / "mark"), lambda df: df, "*.parquet", files_per_batch=20)
    log = workflow.progress_log(spark, target).collect()
    assert [r.batch for r in log] == list(range(batches)) and batches >= 9 and sum(r.processed for r in log) == 2000 and all(a.at <= b.at for a, b in zip(log, log[1:], strict=False))
    sample = sample_new_files(spark, source, "id long", str(tmp_path / "kept"), str(tmp_path / "mark2"), 70, seed=3, files_per_batch=50)
    assert {r.id for r in sample.collect()} == {r.id for r in stats.sample_exact(spark.read.parquet(source), 70, seed=3).collect()}


def test_streaming_takes_new_files_once(spark, tmp_path):
    source, target, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    run = lambda: process_new_files(spark, source, "id long", target, mark, lambda df: df.withColumn("twice", F.col("id") * 2), "*.parquet")
    spark.range(3).coalesce(1).write.parquet(f"{source}/s1")
    run()
    spark.range(3, 5).coalesce(1).write.parquet(f"{source}/s2")
    run()
    assert sorted(r.twice for r in spark.read.parquet(target).collect()) == [0, 2, 4, 6, 8]


def test_calls_share_threads_and_rows_are_spread(spark, monkeypatch):
    """A thousand calls take ten threads, a hanging one loses its own, and rows of one file are asked about by all tasks."""
    import threading
    import time

    from loomgraph.plans import classification, providers

    begun, real = [], threading.Thread
    monkeypatch.setattr(providers.threading, "Thread", lambda *a, **k: begun.append(1) or real(*a, **k))
    hung = lambda p: time.sleep(1.5) if p == "hang" else p.upper()
    policy = providers.Policy(attempts=2, pause=0, timeout_pause=0, deadline=0.2)
    prompts = ["a"] * 1000 + ["hang", " ", None] + ["b"] * 100
    found = providers.Calls(policy, hung, prompts).run()
    assert found == [("A", "ok", 1)] * 1000 + [("", "timeout", 2), ("", "empty", 0), ("", "empty", 0)] + [("B", "ok", 1)] * 100
    assert len(begun) <= 12
    monkeypatch.undo()
    triples = spark.range(1000).coalesce(1).selectExpr("cast(id as string) head", "'r' relation", "'t' tail", "id pos")
    assert providers.spread(triples).rdd.getNumPartitions() == 3 * spark.sparkContext.defaultParallelism
    labelled = classification.label_triples(triples, providers.RuleProvider(str.lower), ["x"])
    assert labelled.count() == 1000 and len(labelled.select("pos").inputFiles()) == 3 * spark.sparkContext.defaultParallelism


def test_a_batch_reads_its_own_rows(spark, tmp_path, monkeypatch):
    """Each of eight batches scans the files of its own samples, not all that is left."""
    read, whole = [], workflow.reason
    monkeypatch.setattr(workflow, "reason", lambda part, *a, **k: read.append((part.count(), sum(map(size_of, part.inputFiles())))) or whole(part, *a, **k))
    size_of = lambda f: spark.read.parquet(f).count()
    empty = [f"cast(null as {workflow.ENRICHED}) as {c}" for c in ("relatedTriples", "hierarchical_enhancements", "enrich_triples")]
    samples = spark.range(80).selectExpr("'s' subject", "id", "concat('q', id) question", *empty)
    assert workflow.reason_into(samples, f"{tmp_path}/out", RuleProvider(lambda p: "A"), ["origin"], 10) == 80
    assert len(read) == 8 and sum(n for n, _ in read) == 80 and all(n == seen for n, seen in read)
    assert spark.read.parquet(f"{tmp_path}/out").select("id").distinct().count() == 80
    assert workflow.reason_into(samples, f"{tmp_path}/out", RuleProvider(lambda p: "A"), ["origin"], 10) == 0
    log = workflow.progress_log(spark, f"{tmp_path}/out").collect()
    assert len(log) == 8 and log[-1].processed == log[-1].total == 80


def test_a_batch_is_one_job(spark, tmp_path):
    """Reasoning writes its answers in one pass, with one shuffle and no join; equal keys are rows of their own, and each prompt is asked once."""
    listed = "array(named_struct('head', concat('h', id), 'relation', 'r', 'tail', 't', 'source', 's'))"
    none = [f"cast(null as {workflow.ENRICHED}) as {c}" for c in ("hierarchical_enhancements", "enrich_triples")]
    asked = spark.range(40).selectExpr("'s' subject", "id div 2 as id", "concat('q', id) question", f"if(id % 4 = 0, {listed}, cast(null as {workflow.ENRICHED})) as relatedTriples", *none, "named_struct('x', id) as extra")
    log = str(tmp_path / "asked")

    def model(text):
        with open(log, "a") as out:
            out.write(f"{text!r}\n")
        return f"{text.count('Knowledge')} {'B' if 'Knowledge' in text else 'A'}"

    found = workflow.reason(cut(asked, "asked"), RuleProvider(model), ["origin", "edgetable"], policy=QUIET)
    spark.sparkContext.setJobGroup("reason", "reason")
    found.write.parquet(f"{tmp_path}/out")
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("reason")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) <= 2, "with a stage of its own for the shuffle"
    assert found.columns == ["subject", "id", "question", "extra", "triple_count", "origin_prompt", "origin_prediction", "origin_response", "edgetable_knowledge", "edgetable_prompt", "edgetable_prediction", "edgetable_response"]
    rows = sorted((r.extra.x, r.id, r.question, r.triple_count, r.origin_prediction, r.edgetable_prediction, r.edgetable_knowledge) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert rows == [(i, i // 2, f"q{i}", int(i % 4 == 0), "A", "B" if i % 4 == 0 else "", f"(h{i},r,t)" if i % 4 == 0 else "") for i in range(40)]
    assert len(open(log).read().splitlines()) == 50
    odd = asked.withColumn("id", F.when(F.col("id") != 3, F.col("id"))).drop("extra")
    assert [workflow.reason_into(odd, f"{tmp_path}/odd", RuleProvider(lambda p: "A"), ["origin"], policy=QUIET) for _ in range(2)] == [40, 0], "a row without an id is kept and not asked about again"
    assert spark.read.parquet(f"{tmp_path}/odd").where("id is null").count() == 2


def test_a_sample_is_drawn_by_many_tasks(spark, tmp_path):
    """One file is written, but the rows in it come from all partitions of the scan."""
    rows = spark.range(0, 80, 1, 8).withColumn("p", F.spark_partition_id())
    assert writers.write_sample(rows, f"{tmp_path}/s")
    read = spark.read.option("header", True).csv(f"{tmp_path}/s")
    assert read.select("p").distinct().count() == 8 and len(read.inputFiles()) == 1


def test_a_large_component_is_stored_like_others(spark, tmp_path):
    """Size groups reach the edges of large components without a shuffle by component; the store is the same whatever counts as large."""
    edges = spark.range(300).select(F.concat(F.lit("n"), F.when(F.col("id") < 200, 0).otherwise(F.col("id") - F.col("id") % 8)).alias("src"), F.concat(F.lit("n"), F.col("id")).alias("dst"), F.lit("isa").alias("relation"))
    labels = graph.components(edges.toDF("head", "tail", "relation"))
    index, found = graph.component_index(edges, labels), []
    for large in (1, 50, 10**9):
        writers.write_components(edges, labels, index, f"{tmp_path}/{large}", large_edges=large)
        found.append(sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/{large}/components").select("src", "dst", "relation", "component", "size_group").collect()))
    assert found[0] == found[1] == found[2] and len(found[0]) == 300


def test_edges_are_counted_before_classes_are_joined(spark):
    plan = QUERIES["kg_component_classify"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().split("\n")
    at = next(i for i, line in enumerate(plan) if "Join Inner" in line)
    assert "Aggregate [component" in plan[at + 1]


def test_files_are_written_by_as_many_tasks_as_read(spark, tmp_path, monkeypatch):
    """Tables in four files give more CSV files than one or two tasks write."""
    for t in ("nation", "region", "customer", "part", "orders", "lineitem"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").repartition(4).write.parquet(f"{tmp_path}/{t}.parquet")
    seen, read = [], readers.read_triples
    monkeypatch.setattr(readers, "read_triples", lambda s, files, *a, **k: (seen.extend(files), read(s, files, *a, **k))[1])
    roundtrips.merge_files(spark, str(tmp_path))
    assert len([f for f in seen if "supply" in f]) > 1
    seen.clear()
    roundtrips.scan_triples_csv(spark, str(tmp_path))
    assert len(seen) > 9


def test_top_k_over_several_slabs(spark):
    """A block's scores are made for so many questions at once as a million scores allow; the rows are those of plain Python."""
    rng = np.random.default_rng(5)
    asked, stored = rng.normal(size=(30, 2)), rng.normal(size=(60_000, 2))
    q = spark.createDataFrame([(i, x.tolist(), ["a"]) for i, x in enumerate(asked)], "question_id int, q array<double>, subfields array<string>")
    t = spark.createDataFrame([(i, "a", x.tolist()) for i, x in enumerate(stored)], "triple_id int, subfield string, x array<double>")
    sims = (asked / np.linalg.norm(asked, axis=1)[:, None]) @ (stored / np.linalg.norm(stored, axis=1)[:, None]).T
    want = {(i, int(j)) for i in range(30) for j in np.argsort(-sims[i])[:3]}
    assert {(r.question_id, r.triple_id) for r in vectors.routed_top_k(q, t, 3, block=60_000).collect()} == want
