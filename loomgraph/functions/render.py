"""Renderings of a sample's triples (``array<struct<h,r,t>>``) as text, all inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomgraph.functions.text import strip

FORMATS = ["edgetable", "nodesequence", "code", "syntaxtree", "naturallanguage"]
TRIPLE_LIST = "array<struct<h:string,r:string,t:string>>"


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once for each row: a lambda's variable is not inlined where it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def stripped(triples: Column) -> Column:
    text = lambda x: strip(F.coalesce(x, F.lit("")))
    return F.transform(F.coalesce(triples, F.array().cast(TRIPLE_LIST)), lambda x: F.struct(text(x["h"]).alias("h"), text(x["r"]).alias("r"), text(x["t"]).alias("t")))


def complete(triples: Column) -> Column:
    """Stripped triples that have all three parts."""
    return F.filter(stripped(triples), lambda x: (x["h"] != "") & (x["r"] != "") & (x["t"] != ""))


def json_triples(text: Column) -> Column:
    """A JSON list of objects, their keys capitalised or not, as head/relation/tail structs; null when it is no such list."""
    part = lambda x, k: F.coalesce(x[k], x[k.capitalize()]).alias(k)
    return F.transform(F.from_json(text, "array<map<string,string>>"), lambda x: F.struct(part(x, "head"), part(x, "relation"), part(x, "tail")))


def short_triples(triples: Column) -> Column:
    """head/relation/tail structs (of any further fields) as h/r/t, those with an empty part left out; null gives none."""
    short = F.transform(triples, lambda x: F.struct(x["head"].cast("string").alias("h"), x["relation"].cast("string").alias("r"), x["tail"].cast("string").alias("t")))
    full = F.filter(short, lambda x: (F.coalesce(x["h"], F.lit("")) != "") & (F.coalesce(x["r"], F.lit("")) != "") & (F.coalesce(x["t"], F.lit("")) != ""))
    return F.coalesce(full, F.array().cast(TRIPLE_LIST))


def cap_triples(related: Column, hierarchical: Column, enriched: Column, n: int = 10) -> Column:
    """The first n of each source, then the first 2n of all, in this order."""
    return F.slice(F.concat(*[F.slice(short_triples(x), 1, n) for x in (related, hierarchical, enriched)]), 1, 2 * n)


def edge_table(triples: Column) -> Column:
    bare = lambda x: F.translate(x, "(),", "")
    return strip(F.array_join(F.transform(complete(triples), lambda x: F.concat(F.lit("("), bare(x["h"]), F.lit(","), bare(x["r"]), F.lit(","), bare(x["t"]), F.lit(")"))), "\n"))


def natural_language(triples: Column) -> Column:
    return strip(F.array_join(F.transform(complete(triples), lambda x: F.concat(F.concat_ws(" ", x["h"], x["r"], x["t"]), F.lit("."))), " "))


def syntax_tree(triples: Column, top: int | None = None) -> Column:
    """A tree for each entity, the most frequent first (ties by first appearance), with its edges out and in."""

    def build(all_: Column, edges: Column, names: Column) -> Column:
        ranked = F.array_sort(F.transform(F.array_distinct(names), lambda e, i: F.struct((-F.size(F.filter(names, lambda x: x == e))).alias("f"), i.alias("i"), e.alias("e"))))
        ranked = ranked if top is None else F.slice(ranked, 1, top)

        def tree(x: Column, i: Column) -> Column:
            out = F.transform(F.filter(edges, lambda y: y["h"] == x["e"]), lambda y: F.concat(F.lit("    -> "), y["t"], F.lit(" (via "), y["r"], F.lit(")\n")))
            into = F.transform(F.filter(edges, lambda y: y["t"] == x["e"]), lambda y: F.concat(F.lit("    <- "), y["h"], F.lit(" (via "), y["r"], F.lit(")\n")))
            head = F.concat(F.lit("Tree "), (i + 1).cast("string"), F.lit(" (Center: "), x["e"], F.lit(", Frequency: "), (-x["f"]).cast("string"), F.lit("):\n  Root: "), x["e"], F.lit("\n"))
            return F.concat(head, F.array_join(out, ""), F.array_join(into, ""), F.lit("\n"))

        return strip(F.array_join(F.transform(ranked, tree), ""))

    names = lambda x: F.filter(F.flatten(F.transform(x, lambda y: F.array(y["h"], y["t"]))), lambda y: y != "")
    return bind(stripped(triples), lambda x: bind(complete(triples), lambda e: bind(names(x), lambda n: build(x, e, n))))


def graphml(triples: Column) -> Column:
    """GraphML with nodes numbered by first appearance; labels of at most 100 (nodes) and 50 (edges) characters."""
    escape = lambda x: F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    head = "<?xml version='1.0' encoding='UTF-8'?>\n<graphml xmlns=\"http://graphml.graphdrawing.org/xmlns\">\n"
    graph = '  <graph id="G" edgedefault="directed"'
    data = lambda x, most: F.concat(F.lit('      <data key="label">'), escape(F.substring(x, 1, most)), F.lit("</data>\n"))

    def build(edges: Column, nodes: Column) -> Column:
        number = lambda e: F.concat(F.lit("n"), (F.array_position(nodes, e) - 1).cast("string"))
        node = lambda e: F.concat(F.lit('    <node id="'), number(e), F.lit('">\n'), data(e, 100), F.lit("    </node>\n"))
        edge = lambda x: F.concat(F.lit('    <edge source="'), number(x["h"]), F.lit('" target="'), number(x["t"]), F.lit('">\n'), data(x["r"], 50), F.lit("    </edge>\n"))
        body = F.concat(F.lit(graph + ">\n"), F.array_join(F.transform(nodes, node), ""), F.array_join(F.transform(edges, edge), ""), F.lit("  </graph>\n"))
        return F.concat(F.lit(head), F.when(F.size(nodes) > 0, body).otherwise(F.lit(graph + "/>\n")), F.lit("</graphml>\n"))

    ends = lambda e: F.array_distinct(F.flatten(F.transform(e, lambda x: F.array(x["h"], x["t"]))))
    filled = bind(complete(triples), lambda e: bind(ends(e), lambda n: build(e, n)))
    return F.when(F.coalesce(F.size(triples), F.lit(0)) > 0, filled).otherwise(F.lit(""))


def node_sequence(triples: Column) -> Column:
    """Simple paths of the sample's graph, one a line, sorted; see :func:`loomgraph.operators.paths.bounded_paths` for the rule.

    A sample holds a bounded number of triples, so the walk is four unrolled steps over its own array.
    """
    pairs = F.array_distinct(F.transform(F.filter(stripped(triples), lambda x: (x["h"] != "") & (x["t"] != "")), lambda x: F.struct(x["h"].alias("h"), x["t"].alias("t"))))

    def build(edges: Column, heads: Column) -> Column:
        def grow(path: Column) -> Column:
            on = F.filter(edges, lambda x: (x["h"] == F.element_at(path, -1)) & ~F.array_contains(path, x["t"]))
            return F.transform(on, lambda x: F.concat(path, F.array(x["t"])))

        def given(level: Column, depth: int) -> Column:
            keep = level if depth >= 3 else F.filter(level, lambda p: ~F.array_contains(heads, F.element_at(p, -1)))
            texts = F.transform(keep, lambda p: F.array_join(p, "->"))
            return texts if depth == 4 else F.concat(texts, bind(F.flatten(F.transform(level, grow)), lambda x: given(x, depth + 1)))

        sources = F.filter(heads, lambda h: ~F.exists(edges, lambda x: x["t"] == h))
        start = bind(sources, lambda s: F.transform(F.when(F.size(s) > 0, s).otherwise(heads), lambda h: F.array(h)))
        return bind(F.flatten(F.transform(start, grow)), lambda x: given(x, 1))

    found = bind(pairs, lambda e: bind(F.array_distinct(F.transform(e, lambda x: x["h"])), lambda h: build(e, h)))
    return F.array_join(F.array_sort(F.array_distinct(found)), "\n")


def render(name: str, triples: Column) -> Column:
    """The rendering of a format; an unknown format gives an empty text."""
    known = {"edgetable": edge_table, "nodesequence": node_sequence, "code": graphml, "syntaxtree": syntax_tree, "naturallanguage": natural_language}
    return known[name](triples) if name in known else F.lit("")
