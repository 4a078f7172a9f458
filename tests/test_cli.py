"""The command line over small folders; it shares the test session."""

import pytest

from loomgraph.__main__ import main
from loomgraph.plans.providers import RuleProvider


@pytest.fixture
def triples(tmp_path):
    for name, body in {"law/a.csv": "Head,Relation,Tail\na,isa,b\nb,r,c\n", "law/law_all.csv": "Head,Relation,Tail\na,isa,b\nb,r,c\n", "arts/x.csv": "head,relation,tail\nq,isa,q\n"}.items():
        (tmp_path / "kg" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "kg" / name).write_text(body)
    return str(tmp_path / "kg")


def test_connectivity_leaves_merged_copies_out(spark, triples, tmp_path):
    main(["connectivity", "--triples", triples, "--output", str(tmp_path / "out")])
    rows = {r.domain: (int(r.triples), int(r.components)) for r in spark.read.option("header", True).csv(str(tmp_path / "out")).collect()}
    assert rows == {"law": (2, 1), "arts": (1, 1)}


def test_build_and_entities(spark, triples, tmp_path):
    main(["build", "--triples", triples, "--output", str(tmp_path / "out")])
    index = {r.component: (r.node_count, r.edge_count, r.size_group) for r in spark.read.parquet(str(tmp_path / "out/index")).collect()}
    assert index == {"a": (2, 1, "tiny"), "q": (1, 1, "tiny")}
    assert spark.read.parquet(str(tmp_path / "out/non_isa")).count() == 1
    main(["entities", "--triples", triples, "--output", str(tmp_path / "ents")])
    assert [r[0] for r in spark.read.text(str(tmp_path / "ents/domain=law")).collect()] == ["a", "b", "c"]


def judge():
    return RuleProvider(lambda p: "[Humanities]" if "q -> " in p else "[Social Sciences] and [unknown]")


def test_label_classify_subclassify_merge(spark, triples, tmp_path, capsys):
    main(["label", "--triples", triples, "--output", str(tmp_path / "protos"), "--provider", "test_cli:judge", "--rows", "9"])
    labelled = spark.read.option("header", True).csv(str(tmp_path / "protos"))
    assert {(r.head, r.label) for r in labelled.collect()} == {("a", "Social Sciences"), ("b", "Social Sciences"), ("q", "Humanities")}
    main(["classify", "--triples", triples, "--prototypes", str(tmp_path / "protos"), "--output", str(tmp_path / "classified")])
    done = spark.read.option("header", True).csv(str(tmp_path / "classified"))
    assert {(r.head, r.type, r.component_id, r.label) for r in done.collect()} == {("a", "ISA_Component", "a", "Social Sciences"), ("b", "Non_ISA", None, "Social Sciences"), ("q", "ISA_Component", "q", "Humanities")}
    protos = [("a", "isa", "b", "Social Sciences", "law"), ("b", "r", "c", "Social Sciences", "sociology")]
    spark.createDataFrame(protos, "head string, relation string, tail string, field string, label string").write.option("header", True).csv(str(tmp_path / "subs"))
    main(["subclassify", "--classified", str(tmp_path / "classified"), "--prototypes", str(tmp_path / "subs"), "--output", str(tmp_path / "out")])
    subs = spark.read.option("header", True).csv(str(tmp_path / "out"))
    assert {(r.head, r.field, r.label) for r in subs.collect()} == {("a", "Social Sciences", "law"), ("b", "Social Sciences", "sociology")}
    main(["merge", "--folder", triples, "--output", str(tmp_path / "merged")])
    merged = spark.read.option("header", True).csv(str(tmp_path / "merged"))
    assert sorted((r.head, r.source_file) for r in merged.collect()) == [("a", "a.csv"), ("b", "a.csv"), ("q", "x.csv")]


def router():
    return RuleProvider(lambda p: "Answer: [law]")


def test_retrieve_keeps_subjects_and_embeddings(spark, tmp_path, capsys):
    """A subject with a blank and signs in its name, an unreadable file among its files, a store that a second run only reads."""
    folder = tmp_path / "q/high school 5%+"
    spark.createDataFrame([(1, "which court?", "x")], "id long, question string, A string").coalesce(1).write.parquet(str(folder))
    next(folder.glob("part*.parquet")).rename(folder / "test-0.parquet")
    (folder / "test-broken.parquet").write_bytes(b"no parquet")
    (tmp_path / "kg/social_sciences/law").mkdir(parents=True)
    (tmp_path / "kg/social_sciences/law/a.csv").write_text("head,relation,tail\ncourt,is,place\n\"a\nb\",r,c\n")
    run = lambda out: main(["retrieve", "--questions", str(tmp_path / "q"), "--triples", str(tmp_path / "kg"), "--output", str(tmp_path / out), "--provider", "test_cli:router", "--embeddings", str(tmp_path / "store")])
    run("one")
    assert "2 texts of triples were encoded" in capsys.readouterr().out
    row = spark.read.parquet(str(tmp_path / "one")).first()
    assert row.subject == "high school 5%+" and row.subdomains == ["law"] and {t.head for t in row.relatedTriples} == {"court", "a\nb"}
    run("two")
    assert "0 texts of triples were encoded" in capsys.readouterr().out


def test_evaluate(spark, tmp_path):
    rows = [("s", 1, "A", "A"), ("s", 2, "B", "x")]
    spark.createDataFrame(rows, "subject string, id long, answer string, origin_prediction string").write.parquet(str(tmp_path / "in"))
    main(["evaluate", "--input", str(tmp_path / "in"), "--output", str(tmp_path / "out")])
    row = spark.read.option("header", True).csv(str(tmp_path / "out/overall")).first()
    assert (row.total_correct, row.total_valid, row.overall_accuracy) == ("1", "2", "0.5")


def test_sample_and_count(spark, triples, tmp_path, capsys):
    main(["sample", "--csv", f"{triples}/law/a.csv", "--output", str(tmp_path / "s"), "--rows", "1"])
    assert spark.read.option("header", True).csv(str(tmp_path / "s")).count() == 1
    main(["count", "--folder", triples])
    assert "a.csv" in capsys.readouterr().out
