"""Text operators as Column builders: normalising, prompts, response parsers and answer matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.functions.taxonomy import DEFAULT_FIELD, DEFAULT_SUBFIELD, KEYWORDS, SUBFIELDS

#: Texts that a CSV reader of the data's origin takes as missing.
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
OPTIONS = "ABCDEFGH"
NO_TRIPLES = "No triples available."


def strip(x: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(x, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def na_to_null(x: Column) -> Column:
    return F.when(~x.isin(NA_TOKENS), x)


def scalar(x: Column, kind: str = "string", default: str = "") -> Column:
    """One text from a cell: null or NaN gives the default; of a list the first element; anything else as text."""
    if kind.startswith("array"):
        return F.coalesce(F.try_element_at(x, F.lit(1)).cast("string"), F.lit(default))
    if kind in ("double", "float"):
        return F.when(x.isNull() | F.isnan(x), F.lit(default)).otherwise(x.cast("string"))
    return F.coalesce(x.cast("string"), F.lit(default))


def present(x: Column, kind: str = "string") -> Column:
    """Whether a cell holds something: null, NaN and empty lists don't, an empty text does."""
    if kind.startswith("array"):
        return F.coalesce(F.size(x) > 0, F.lit(False))
    return x.isNotNull() & ~F.isnan(x) if kind in ("double", "float") else x.isNotNull()


def textualize(h: Column, r: Column, t: Column, joiner: str = " ") -> Column:
    """A triple as text: joined by a blank for retrieval, by `` -> `` for classification; nulls read ``nan``."""
    return F.concat_ws(joiner, *[F.coalesce(c, F.lit("nan")) for c in (h, r, t)])


def format_triples(triples: Column) -> Column:
    """Triples (head, relation, tail, similarity) as prompt lines; a fixed sentence when there are none.

    Ties of the third decimal follow the JVM's half-up rounding of the decimal value.
    """
    line = lambda x: F.concat(F.lit("["), x["head"], F.lit(", "), x["relation"], F.lit(", "), x["tail"], F.format_string("] (similarity: %.3f)", F.coalesce(x["similarity"], F.lit(0.0))))
    lines = F.array_join(F.filter(F.transform(triples, line), lambda x: x.isNotNull()), "\n")
    return F.when(F.coalesce(F.size(triples), F.lit(0)) <= 0, F.lit(NO_TRIPLES)).otherwise(lines)


def question_with_options(question: Column, options: dict[str, Column]) -> Column:
    """The question and a line ``X. text`` for each option that isn't blank."""
    lines = [F.when(strip(c) != "", F.concat(F.lit(f"{k}. "), c)) for k, c in options.items()]
    return F.concat_ws("\n", F.coalesce(question, F.lit("")), *lines)


#: Prompt templates; the wording is this repository's own.
PROMPTS = {
    "route": "Name the subfields that the question belongs to, each in brackets after 'Answer:'.\nSubfields: {labels}\nQuestion: {question}\n",
    "enrich": "Question: {question}\nKnown triples:\n{triples}\nDerive further triples [head, relation, tail]. List them under 'Enhanced Triples:' and broader or narrower terms under 'Hierarchical Enhancements:'.\n",
    "qa_knowledge": "Answer with the letter of one option.\nQuestion: {question}\nKnowledge: {knowledge}\nAnswer:",
    "qa": "Answer with the letter of one option.\nQuestion: {question}\nAnswer:",
    "judge": "Which of these classes does the triple belong to? Answer with class names in brackets.\nClasses: {labels}\nTriple: {triple}\n",
}


def prompt(template: str, **slots: Column) -> Column:
    """A template with its ``{slots}`` filled; text of a slot that looks like a slot stays as it is."""
    parts: list[Column] = []
    rest = template
    while True:
        found = [(rest.find("{" + k + "}"), k) for k in slots if "{" + k + "}" in rest]
        if not found:
            return F.concat(*parts, F.lit(rest))
        at, key = min(found)
        parts += [F.lit(rest[:at]), F.coalesce(slots[key], F.lit(""))]
        rest = rest[at + len(key) + 2 :]


def parse_router(response: Column, strict: bool = True) -> Column:
    """Subfields named in a router's response, in canonical spelling, without repeats; ``[other]`` when there is none.

    What follows ``answer:`` is cut at separators; strict: ``&`` is one, so names that hold it are only found by the
    search over the whole text, which is tried when ``answer:`` gives no piece; then come keywords. Not strict: text
    in brackets counts first and ``&`` separates nothing.
    """
    text = F.coalesce(response, F.lit(""))
    low = F.lower(text)
    told = F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"(?iU)answer:\s*([^.\n]+)"), 1), strip), lambda m: ~F.lower(m).contains("explanation") & ~F.lower(m).contains("reasoning"))
    cutter = r"[,;|&]+|\]\s*\[" if strict else r"[,;|]+|\]\s*\["
    trimmed = lambda p: F.regexp_replace(strip(p), r"^[\[\]]+|[\[\]]+$", "")
    pieces = lambda ms: F.filter(F.flatten(F.transform(ms, lambda m: F.transform(F.split(m, cutter), trimmed))), lambda p: F.length(p) > 2)
    answers = pieces(told)
    if not strict:
        bracketed = pieces(F.regexp_extract_all(text, F.lit(r"\[([^\[\]]+)\]"), 1))
        answers = F.when(F.size(bracketed) > 0, bracketed).otherwise(answers)
    named = F.filter(F.array(*[F.when(low.rlike(rf"(?U)\b\Q{s.lower()}\E\b"), F.lit(s)) for s in SUBFIELDS]), lambda s: s.isNotNull())
    key = F.coalesce(*[F.when(low.contains(k), F.lit(v)) for k, v in KEYWORDS.items()])
    found = F.when(F.size(answers) > 0, answers).when(F.size(named) > 0, named).otherwise(F.array_compact(F.array(key)))
    spelling = F.create_map(*[F.lit(x) for s in SUBFIELDS for x in (s.lower(), s)])
    valid = F.array_distinct(F.array_compact(F.transform(found, lambda s: F.try_element_at(spelling, F.lower(s)))))
    return F.when(F.size(valid) > 0, valid).otherwise(F.array(F.lit(DEFAULT_SUBFIELD)))


def bracket_labels(response: Column, labels: list[str], default: str | None = DEFAULT_FIELD) -> Column:
    """Labels in brackets, exact and case-sensitive, repeats kept; ``[default]`` or (None) an empty list when there is none."""
    split = F.split(F.coalesce(response, F.lit("")), r"\[")
    inner = F.transform(F.slice(split, 2, F.size(split)), lambda p: F.when(p.contains("]"), strip(F.substring_index(p, "]", 1))))
    found = F.filter(inner, lambda p: F.coalesce(p.isin(labels), F.lit(False)))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(default)) if default is not None else F.array().cast("array<string>"))


def parse_answer(response: Column) -> Column:
    """The last stand-alone letter A to D; else the first 100 characters of the stripped text."""
    text = F.coalesce(response, F.lit(""))
    return F.coalesce(F.try_element_at(F.regexp_extract_all(text, F.lit(r"(?U)\b([ABCD])\b"), 1), F.lit(-1)), F.substring(strip(text), 1, 100))


def answer_matches(answer: Column, prediction: Column) -> Column:
    """Five ways to agree, in upper case: equal, either in the other, first stand-alone letter, equal without punctuation.

    An empty answer is in every prediction; a null on either side never agrees.
    """
    a, p = F.upper(strip(answer)), F.upper(strip(prediction))
    letter = lambda x: F.regexp_extract(x, r"(?U)\b([A-Z])\b", 1)
    bare = lambda x: F.translate(x, PUNCTUATION + " ", "")
    first = (letter(a) != "") & (letter(a) == letter(p))
    return F.coalesce((a == p) | p.contains(a) | a.contains(p) | first | (bare(a) == bare(p)), F.lit(False))


def answer_contained(answer: Column, prediction: Column) -> Column:
    """The strict variant: the answer as it is occurs in the prediction."""
    return F.coalesce(prediction.contains(answer), F.lit(False))


def valid_prediction(x: Column, any_case: bool = True) -> Column:
    """Not null, not blank, not ``nan`` (in any case, or as written)."""
    s = strip(x)
    return F.coalesce((s != "") & ((F.lower(s) if any_case else s) != "nan"), F.lit(False))


def parse_enrichment(rows: DataFrame, key: str, response: str) -> DataFrame:
    """``key, enrich_triples, hierarchical_enhancements`` from responses in two headed sections of ``[h, r, t]`` lines.

    Lines before the first header, and lines that don't have exactly three parts, count for nothing.
    """
    lines = rows.select(key, F.posexplode(F.split(F.coalesce(F.col(response), F.lit("")), "\n")).alias("pos", "line")).withColumn("line", strip(F.col("line")))
    section = F.when(F.col("line").contains("Enhanced Triples:"), F.lit("e")).when(F.col("line").contains("Hierarchical Enhancements:"), F.lit("h"))
    within = Window.partitionBy(key).orderBy("pos")
    marked = lines.withColumn("mark", section).withColumn("section", F.last("mark", ignorenulls=True).over(within))
    parts = F.transform(F.split(F.expr("substring(line, 2, char_length(line) - 2)"), ","), strip)
    good = F.col("mark").isNull() & F.col("line").startswith("[") & F.col("line").endswith("]") & (F.size(parts) == 3)
    triple = F.struct(parts[0].alias("head"), parts[1].alias("relation"), parts[2].alias("tail"), F.lit("enriched").alias("source"))
    listed = lambda s: F.transform(F.array_sort(F.collect_list(F.when(good & (F.col("section") == s), F.struct("pos", triple.alias("t"))))), lambda x: x["t"])
    return marked.groupBy(key).agg(listed("e").alias("enrich_triples"), listed("h").alias("hierarchical_enhancements"))
