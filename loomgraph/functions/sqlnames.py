"""The text functions by name in SQL text: SQL-defined functions whose bodies are written from the Column builders, so there is one definition and no Python.

``register(spark)`` creates temporary functions; ``spark.sql("SELECT loom_parse_answer(response) FROM t")`` then plans the same expressions as the DataFrame API.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import render, text
from loomgraph.functions.taxonomy import SUBFIELDS, directory_name

PREFIX = "loom_"
TRIPLES = "ARRAY<STRUCT<h: STRING, r: STRING, t: STRING>>"
_LITERAL = re.compile(r"('(?:[^'\\]|\\.|'')*')", re.DOTALL)
#: Operators that a column's text writes as calls; in SQL a call by such a name needs quotes.
_OPERATOR = re.compile(r"(?<![\w`<>=!])(<=>|<=|>=|==|=|<|>|!|\+|-|\*|/|%|and|or|not|in)\(")


def sql_text(column: Column) -> str:
    """The SQL text of a column that is built from functions, literals and names."""
    parts = _LITERAL.split(column._jc.node().sql())
    return "".join(p if i % 2 else _OPERATOR.sub(r"`\1`(", p) for i, p in enumerate(parts))


def _definitions() -> dict[str, tuple[str, str, Column]]:
    """name: (arguments, type, body) of every function."""
    response, triples = F.col("response"), F.col("triples")
    answer, prediction = F.col("answer"), F.col("prediction")
    found = {
        "parse_router": ("response STRING", "ARRAY<STRING>", text.parse_router(response)),
        "parse_router_lenient": ("response STRING", "ARRAY<STRING>", text.parse_router(response, strict=False)),
        "bracket_labels": ("response STRING", "ARRAY<STRING>", text.bracket_labels(response, SUBFIELDS)),
        "parse_answer": ("response STRING", "STRING", text.parse_answer(response)),
        "answer_matches": ("answer STRING, prediction STRING", "BOOLEAN", text.answer_matches(answer, prediction)),
        "answer_contained": ("answer STRING, prediction STRING", "BOOLEAN", text.answer_contained(answer, prediction)),
        "valid_prediction": ("prediction STRING", "BOOLEAN", text.valid_prediction(prediction)),
        "textualize": ("head STRING, relation STRING, tail STRING", "STRING", text.textualize(F.col("head"), F.col("relation"), F.col("tail"))),
        "directory_name": ("name STRING", "STRING", directory_name(F.col("name"))),
    }
    return found | {f"render_{f}": (f"triples {TRIPLES}", "STRING", render.render(f, triples)) for f in render.FORMATS}


def register(spark: SparkSession) -> list[str]:
    """Create (or replace) the functions for this session; their names."""
    names = []
    for name, (arguments, kind, body) in _definitions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {PREFIX}{name}({arguments}) RETURNS {kind} RETURN {sql_text(body)}")
        names.append(f"{PREFIX}{name}")
    return names
