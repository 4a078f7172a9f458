"""Hand-derived cases for parsers, matchers and renderings."""

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import render, text


def one(spark, make, *values, schema="x string, y string"):
    row = [*values, *[None] * (2 - len(values))] if "y" in schema else list(values)
    return spark.createDataFrame([tuple(row)], schema).select(make(F.col("x"), F.col("y")) if "y" in schema else make(F.col("x"))).first()[0]


@pytest.mark.parametrize(("said", "answer"), [("A company picks B", "B"), ("选B。", "选B。"), ("是：B。", "B"), ("", ""), (None, ""), ("x" * 150, "x" * 100)])
def test_answer(spark, said, answer):
    assert one(spark, text.parse_answer, said, schema="x string") == answer


@pytest.mark.parametrize(("answer", "prediction", "match"), [("A", "BECAUSE", True), ("", "C", True), (None, "C", False), ("b", "(B)", True), ("A", None, False), ("A", "D", False), ("A", "The answer is A.", True), ("a,b", "A B", True)])
def test_match(spark, answer, prediction, match):
    assert one(spark, text.answer_matches, answer, prediction) is match


@pytest.mark.parametrize(("x", "valid"), [(" NaN ", False), ("　", False), (None, False), ("A", True)])
def test_valid_prediction(spark, x, valid):
    assert one(spark, text.valid_prediction, x, schema="x string") is valid


@pytest.mark.parametrize(("said", "strict", "lenient"), [
    ("Answer: [physics][law]", ["physics", "law"], ["physics", "law"]),
    ("Answer: [computer science & technology]", ["other"], ["computer science & technology"]),
    ("[law]", ["law"], ["law"]),
    ("It needs programming", ["computer science & technology"], ["computer science & technology"]),
    ("nothing relevant", ["other"], ["other"]),
    ("ANSWER: LAW, physics, Law", ["law", "physics"], ["law", "physics"]),
    (None, ["other"], ["other"]),
])
def test_router(spark, said, strict, lenient):
    assert one(spark, text.parse_router, said, schema="x string") == strict
    assert one(spark, lambda x: text.parse_router(x, False), said, schema="x string") == lenient


@pytest.mark.parametrize(("said", "field", "sub"), [("[History]", ["Other"], []), ("[law] … [law]", ["law", "law"], ["law", "law"]), ("[ law ] [x", ["law"], ["law"]), (None, ["Other"], [])])
def test_labels(spark, said, field, sub):
    assert one(spark, lambda x: text.bracket_labels(x, ["law", "history"]), said, schema="x string") == field
    assert one(spark, lambda x: text.bracket_labels(x, ["law", "history"], None), said, schema="x string") == sub


def test_strip_takes_all_white_space(spark):
    assert one(spark, text.strip, "　 a b\t\n", schema="x string") == "a b"


def test_enrichment(spark):
    said = "[a, r, b]\nEnhanced Triples:\n[a, r, b]\n[a, b, r, c]\n  [c,s,d] \nHierarchical Enhancements:\n[e, is, f]"
    row = text.parse_enrichment(spark.createDataFrame([(1, said), (2, None)], "id int, r string"), "id", "r").orderBy("id").collect()
    assert [(t.head, t.relation, t.tail) for t in row[0].enrich_triples] == [("a", "r", "b"), ("c", "s", "d")]
    assert [t.tail for t in row[0].hierarchical_enhancements] == ["f"] and row[1].enrich_triples == []


def test_prompts(spark):
    df = spark.createDataFrame([("q?", "a", " ", None)], "q string, A string, B string, C string")
    asked = text.question_with_options(F.col("q"), {k: F.col(k) for k in "ABC"})
    assert df.select(asked).first()[0] == "q?\nA. a"
    assert df.select(text.prompt(text.PROMPTS["qa_knowledge"], question=F.lit("{knowledge}"), knowledge=F.lit("k"))).first()[0].count("{knowledge}") == 1
    none = F.lit(None).cast("array<struct<head:string,relation:string,tail:string,similarity:double>>")
    assert df.select(text.format_triples(none)).first()[0] == text.NO_TRIPLES


def rendered(spark, name, triples):
    df = spark.createDataFrame([(triples,)], f"t {render.TRIPLE_LIST}")
    return df.select(render.render(name, F.col("t"))).first()[0]


def test_renderings(spark):
    assert rendered(spark, "edgetable", [(" x ", " r ", " (y,z)"), ("a", "", "b")]) == "(x,r,yz)"
    loop = rendered(spark, "syntaxtree", [("a", "r", "a")])
    assert "Frequency: 2" in loop and "-> a (via r)" in loop and "<- a (via r)" in loop
    assert rendered(spark, "naturallanguage", [("a", "r", "b"), ("b", "s", "c")]) == "a r b. b s c."
    xml = rendered(spark, "code", [("<a&", "r", "b"), ("b", "r", "<a&")])
    assert xml.count("<node") == 2 and xml.count("<edge") == 2 and "&lt;a&amp;" in xml
    assert all(rendered(spark, f, None) == "" for f in render.FORMATS) and rendered(spark, "x", [("a", "r", "b")]) == ""


@pytest.mark.parametrize(("edges", "paths"), [
    ([("a", "b"), ("b", "c")], ["a->b->c"]),
    ([("a", "b"), ("b", "a")], []),
    ([("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "f")], ["a->b->c->d", "a->b->c->d->e"]),
])
def test_paths(spark, edges, paths):
    from loomgraph.operators.paths import bounded_paths

    triples = [(a, "r", b) for a, b in edges]
    assert [p for p in rendered(spark, "nodesequence", triples).split("\n") if p] == paths
    flat = spark.createDataFrame([(1, *t) for t in triples], "id int, head string, relation string, tail string")
    assert sorted(r.path for r in bounded_paths(flat, "id").collect()) == paths


def test_cap(spark):
    t = [("a", "r", "b"), ("c", "r", "d")]
    kind = "array<struct<head:string,relation:string,tail:string>>"
    df = spark.createDataFrame([(t, t, t)], f"a {kind}, b {kind}, c {kind}")
    assert [x.h for x in df.select(render.cap_triples(F.col("a"), F.col("b"), F.col("c"), 1)).first()[0]] == ["a", "a"]
