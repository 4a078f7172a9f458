"""DuckDB SQL with the same results as the queries of ``queries``; built from the same derived tables, written in SQL."""

from __future__ import annotations

from loomgraph.functions.taxonomy import KEYWORDS, SUBFIELDS, TAXONOMY

FORMATS = ["origin", "edgetable", "nodesequence", "code", "syntaxtree", "naturallanguage"]


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _list(xs: list[str]) -> str:
    return "[" + ", ".join(map(_text, xs)) + "]"


KG = """kg AS (
    SELECT 'geo' AS domain, 'nation#' || n_nationkey AS head, 'isA' AS relation, 'region#' || n_regionkey AS tail, n_nationkey::BIGINT AS pos FROM nation
    UNION ALL SELECT 'parttype', 'part#' || p_partkey, 'Is A', p_type, p_partkey FROM part
    UNION ALL SELECT 'brand', 'part#' || p_partkey, '属于', p_brand, p_partkey FROM part
    UNION ALL SELECT 'customer', 'cust#' || c_custkey, 'locateAt', 'nation#' || c_nationkey, c_custkey FROM customer
    UNION ALL SELECT 'orders', 'order#' || o_orderkey, 'placedBy', 'cust#' || o_custkey, o_orderkey FROM orders
    UNION ALL SELECT 'supply', 'supp#' || l_suppkey, 'supplies', 'part#' || l_partkey, l_orderkey * 10 + l_linenumber FROM lineitem)"""
ISA = "lower(relation) IN ('isa', 'is a', 'is-a', '是', '属于')"


def _letter(x: str) -> str:
    return f"substr('ABCD', (({x}) % 4 + 1)::INT, 1)"


def _prediction(f: int) -> str:
    k = "o_orderkey"
    kinds = [_letter(k), f"lower({_letter(k)})", f"'The answer is ' || {_letter(k)} || '.'", "''", "' NaN '", "NULL", _letter(f"{k} + 1"), "'BECAUSE'", f"' (' || {_letter(k)} || ') '"]
    cases = " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(kinds))
    return f"CASE ({k} * 7 + {f * 3} + {k} // 9) % 9 {cases} END"


QA = "qa AS (SELECT o_orderpriority AS dataset, o_orderkey AS id, CASE WHEN o_orderkey % 97 = 0 THEN NULL WHEN o_orderkey % 89 = 0 THEN '' ELSE " + _letter("o_orderkey") + " END AS answer, " + ", ".join(f"{_prediction(i)} AS {f}_prediction" for i, f in enumerate(FORMATS)) + " FROM orders)"
LONG = "long AS (" + " UNION ALL ".join(f"SELECT dataset, id, answer, '{f}' AS prediction_format, {f}_prediction AS prediction FROM qa" for f in FORMATS) + ")"
PUNCT = "regexp_replace({}, '[!-/:-@\\[-`{{-~ ]', '', 'g')"
MATCH = f"""(a = p OR contains(p, a) OR contains(a, p)
    OR (regexp_extract(a, '\\b([A-Z])\\b', 1) <> '' AND regexp_extract(a, '\\b([A-Z])\\b', 1) = regexp_extract(p, '\\b([A-Z])\\b', 1))
    OR {PUNCT.format('a')} = {PUNCT.format('p')})"""


def _cells(strict: bool = False) -> str:
    valid = f"coalesce(trim(prediction) <> '' AND {'trim(prediction)' if strict else 'lower(trim(prediction))'} <> 'nan', false)"
    right = "coalesce(contains(prediction, answer), false)" if strict else f"coalesce({MATCH}, false)"
    return f"""{QA}, {LONG},
    marked AS (SELECT *, upper(trim(answer)) AS a, upper(trim(prediction)) AS p FROM long
        WHERE NOT ((dataset = '1-URGENT' AND prediction_format = 'code') OR (dataset = '5-LOW' AND prediction_format <> 'origin') OR (dataset = '3-MEDIUM' AND prediction_format = 'origin'))),
    cells AS (SELECT dataset, prediction_format, count(*) FILTER ({valid} AND {right}) AS correct_count, count(*) FILTER ({valid}) AS valid_total, count(*) AS total_samples,
        coalesce(count(*) FILTER ({valid} AND {right}) / nullif(count(*) FILTER ({valid}), 0)::DOUBLE, 0.0) AS accuracy FROM marked GROUP BY ALL)"""


CELLS, STRICT = _cells(), _cells(True)
FORMAT_LIST = _list(FORMATS)
MATRIX = "SELECT dataset, " + ", ".join(f"round(max(accuracy) FILTER (prediction_format = '{f}'), 6) AS {f}" for f in FORMATS) + " FROM cells GROUP BY dataset"
BAND = "CASE WHEN accuracy >= 0.9 THEN 1 WHEN accuracy >= 0.8 THEN 2 WHEN accuracy >= 0.7 THEN 3 WHEN accuracy >= 0.6 THEN 4 ELSE 5 END"
NAMED = "named AS (SELECT dataset || '/' || prediction_format AS dataset, accuracy FROM cells)"


def _components(domains: str = "") -> str:
    where = f"WHERE domain IN ({domains})" if domains else ""
    return f"""{KG}, e AS (SELECT DISTINCT domain, head AS a, tail AS b FROM kg {where} UNION SELECT DISTINCT domain, tail, head FROM kg {where}),
    cc(domain, node, component) USING KEY (domain, node) AS (
        SELECT domain, a, least(a, min(b)) FROM e GROUP BY domain, a
        UNION
        SELECT e.domain, e.b, min(c.component) FROM cc c JOIN e ON e.domain = c.domain AND e.a = c.node
        JOIN recurring.cc o ON o.domain = e.domain AND o.node = e.b WHERE c.component < o.component GROUP BY e.domain, e.b)"""


CC = _components()
BUCKET = "CASE WHEN {n} >= 1000 THEN 'large{a}' WHEN {n} >= 100 THEN 'medium{b}' WHEN {n} >= 10 THEN 'small{c}' ELSE 'tiny{d}' END"
CONNECT = f"""{CC}, sizes AS (SELECT domain, component, count(*) AS n FROM cc GROUP BY ALL),
    counted AS (SELECT domain, count(*) AS components, sum(n)::BIGINT AS nodes, max(n) AS largest_component, count(*) FILTER (n >= 1000) AS large,
        count(*) FILTER (n BETWEEN 100 AND 999) AS medium, count(*) FILTER (n BETWEEN 10 AND 99) AS small, count(*) FILTER (n < 10) AS tiny FROM sizes GROUP BY domain),
    edges AS (SELECT domain, count(*) AS edges FROM (SELECT DISTINCT domain, least(head, tail), greatest(head, tail) FROM kg) GROUP BY domain),
    total AS (SELECT domain, count(*) AS triples FROM kg GROUP BY domain),
    joined AS (SELECT *, (triples - components) / triples::DOUBLE AS connectivity_rate FROM total JOIN counted USING (domain) JOIN edges USING (domain)
        UNION ALL BY NAME SELECT 'void' AS domain, 0 AS triples, 0 AS components, 0 AS nodes, 0 AS largest_component, 0 AS large, 0 AS medium, 0 AS small, 0 AS tiny, 0 AS edges, 0.0 AS connectivity_rate)"""

SAMPLE_LINES = """li AS (SELECT l_orderkey AS id, l_linenumber AS n, l_linenumber % 3 AS m,
        'e' || ((l_orderkey + l_linenumber * 3) % 7) AS head,
        CASE WHEN (l_orderkey + l_linenumber) % 6 = 0 THEN '' ELSE 'r<' || (l_linenumber % 3) || '>' END AS relation,
        'e' || ((l_orderkey * 2 + l_linenumber) % 7) || CASE WHEN l_linenumber % 4 = 0 THEN ' (x,y)' ELSE '' END AS tail
        FROM lineitem),
    t AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY (m + 2) % 3, n, head, relation, tail) AS i FROM li),
    ids AS (SELECT DISTINCT id FROM li), good AS (SELECT * FROM t WHERE relation <> '')"""
PATHS = f"""{SAMPLE_LINES}, ed AS (SELECT DISTINCT id, head, tail FROM t),
    src AS (SELECT DISTINCT id, head FROM ed a WHERE NOT EXISTS (SELECT 1 FROM ed b WHERE b.id = a.id AND b.tail = a.head)),
    st AS (SELECT * FROM src UNION SELECT DISTINCT id, head FROM ed WHERE id NOT IN (SELECT id FROM src)),
    w(id, node, path, depth) AS (SELECT id, head, [head], 0 FROM st
        UNION ALL SELECT w.id, ed.tail, list_append(path, ed.tail), depth + 1 FROM w JOIN ed ON ed.id = w.id AND ed.head = w.node WHERE depth < 4 AND NOT list_contains(path, ed.tail)),
    out AS (SELECT DISTINCT id, array_to_string(path, '->') AS path FROM w WHERE depth >= 3 OR (depth >= 1 AND NOT EXISTS (SELECT 1 FROM ed WHERE ed.id = w.id AND ed.head = w.node)))"""

VEC = "v AS (SELECT vec_id, label, embedding::DOUBLE[] AS vec, vec_id % 50 = 0 AS is_query FROM embeddings)"
PROTO = "pr AS (SELECT label, i, avg(vec[i + 1]) AS v FROM v, range(64) r(i) GROUP BY ALL), cl AS (SELECT label, list(v ORDER BY i) AS p FROM pr GROUP BY label)"


def _sub(x: str) -> str:
    return f"{_list(SUBFIELDS)}[(({x}) % {len(SUBFIELDS)} + 1)::INT]"


RESPONSES = f"""rs AS (SELECT p_partkey AS id, {_sub('p_partkey')} AS a, {_sub('p_partkey * 5 + 3')} AS b FROM part),
    r AS (SELECT id, CASE id % 8 WHEN 0 THEN 'Answer: [' || a || '][ ' || b || ']' WHEN 1 THEN 'answer:  ' || a || ', ' || b || ' ; ab' || chr(10) || 'next'
        WHEN 2 THEN 'I would say ' || b || ' or ' || upper(a) WHEN 3 THEN 'It needs programming' WHEN 4 THEN 'Answer: explanation of ' || a WHEN 5 THEN 'zzz'
        WHEN 6 THEN '[ ' || a || ' ] then [history] and [History] [law' END AS response FROM rs)"""


def _router(strict: bool) -> str:
    cutter = r"[,;|&]+|\]\s*\[" if strict else r"[,;|]+|\]\s*\["
    names = "[" + ", ".join(f"CASE WHEN regexp_matches(low, '\\b' || regexp_escape({_text(s.lower())}) || '\\b') THEN {_text(s)} END" for s in SUBFIELDS) + "]"
    keyed = "coalesce(" + ", ".join(f"CASE WHEN contains(low, {_text(k)}) THEN {_text(v)} END" for k, v in KEYWORDS.items()) + ")"
    piece = f"list_filter(list_transform(flatten(list_transform({{}}, lambda m: regexp_split_to_array(m, '{cutter}'))), lambda x: trim(trim(x), '[]')), lambda x: len(x) > 2)"
    told = "list_filter(list_transform(regexp_extract_all(txt, '(?i)answer:\\s*([^.\\n]+)', 1), lambda m: trim(m)), lambda m: NOT contains(lower(m), 'explanation') AND NOT contains(lower(m), 'reasoning'))"
    first = "[]" if strict else piece.format(r"regexp_extract_all(txt, '\[([^\[\]]+)\]', 1)")
    return f"""WITH {RESPONSES}, lowered AS (SELECT id, coalesce(response, '') AS txt, lower(coalesce(response, '')) AS low FROM r),
    parts AS (SELECT id, low, {first}::VARCHAR[] AS br, {piece.format(told)} AS an FROM lowered),
    f AS (SELECT id, CASE WHEN len(br) > 0 THEN br WHEN len(an) > 0 THEN an WHEN len(list_filter({names}, lambda x: x IS NOT NULL)) > 0 THEN list_filter({names}, lambda x: x IS NOT NULL)
        WHEN {keyed} IS NOT NULL THEN [{keyed}] ELSE [] END AS found FROM parts),
    u AS (SELECT id, i, list_filter({_list(SUBFIELDS)}, lambda s: lower(s) = lower(found[i]))[1] AS s FROM f, range(1, 12) g(i) WHERE i <= len(found)),
    d AS (SELECT id, s, min(i) AS i FROM u WHERE s IS NOT NULL GROUP BY ALL)
    SELECT f.id, coalesce(string_agg(s, '|' ORDER BY d.i), 'other') AS subfields FROM f LEFT JOIN d ON d.id = f.id GROUP BY f.id"""


LABELS = f"list_filter(list_transform(list_filter(string_split(coalesce(response, ''), '[')[2:], lambda p: contains(p, ']')), lambda p: trim(string_split(p, ']')[1])), lambda p: list_contains({_list(SUBFIELDS)}, p))"
FIELD = "CASE " + " ".join(f"WHEN subfield IN ({', '.join(map(_text, s))}) THEN {_text(f)}" for f, s in TAXONOMY.items()) + " END"
TAX_ROWS = ", ".join(f"({_text(s)}, {i})" for i, s in enumerate(SUBFIELDS))
RANKED = "(PARTITION BY question_id ORDER BY similarity DESC, place DESC, triple_id DESC)"
ENT = "ent AS (SELECT DISTINCT domain, trim(x) AS entity FROM (SELECT domain, unnest([head, tail]) AS x FROM kg) WHERE x IS NOT NULL AND lower(x) <> 'nan' AND trim(x) <> '')"
EN_BODY = "'[x' || c_custkey || ', r, lost]' || chr(10) || '  Enhanced Triples:' || chr(10) || '[a' || c_custkey || ', is , b]' || chr(10) || '[a, b, c, d]' || chr(10) || 'note' || chr(10) || CASE WHEN c_custkey % 3 = 0 THEN 'Hierarchical Enhancements:' || chr(10) || '[h, broader, ' ELSE '[p, q, ' END || c_custkey || ']' || chr(10) || '[ ,, ]'"

ORACLE_SQL = {
    "eval_accuracy_by_dataset_format": f"WITH {CELLS} SELECT * REPLACE (round(accuracy, 6) AS accuracy) FROM cells",
    "eval_strict_substring": f"WITH {STRICT} SELECT * REPLACE (round(accuracy, 6) AS accuracy) FROM cells",
    "eval_overall_by_format": f"""WITH {CELLS}, o AS (SELECT prediction_format, sum(correct_count)::BIGINT AS total_correct, sum(valid_total)::BIGINT AS total_valid, sum(total_samples)::BIGINT AS total_samples FROM cells GROUP BY 1)
        SELECT *, round(total_correct / total_valid::DOUBLE, 6) AS overall_accuracy, row_number() OVER (ORDER BY total_correct / total_valid::DOUBLE DESC, prediction_format)::INT AS rank FROM o""",
    "eval_dataset_summary": f"WITH {CELLS} SELECT dataset, round(avg(accuracy), 6) AS average_accuracy, max(total_samples) AS total_samples, string_agg(prediction_format, ', ' ORDER BY list_position({FORMAT_LIST}, prediction_format)) AS available_formats FROM cells GROUP BY dataset",
    "eval_accuracy_matrix": f"WITH {CELLS} {MATRIX}",
    "eval_format_coverage": f"""WITH {CELLS}, n AS (SELECT unnest({FORMAT_LIST}) AS prediction_format), d AS (SELECT count(DISTINCT dataset) AS total_datasets FROM cells),
        h AS (SELECT prediction_format, count(DISTINCT dataset) AS c FROM cells GROUP BY 1)
        SELECT prediction_format, coalesce(c, 0) AS datasets_with_format, total_datasets, round(coalesce(c, 0) / total_datasets::DOUBLE * 100, 6) AS coverage_percentage FROM n LEFT JOIN h USING (prediction_format), d""",
    "eval_dataset_type": f"WITH {CELLS} SELECT dataset, CASE WHEN bool_or(prediction_format = 'origin') AND bool_or(prediction_format <> 'origin') THEN 'mixed' WHEN bool_or(prediction_format = 'origin') THEN 'qa_only' ELSE 'knowledge_only' END AS dataset_type FROM cells GROUP BY dataset",
    "eval_origin_bands": f"""WITH {CELLS}, {NAMED}, dim AS (SELECT * FROM (VALUES ('Excellent (90-100%)', 1), ('Good (80-90%)', 2), ('Fair (70-80%)', 3), ('Poor (60-70%)', 4), ('Very Poor (0-60%)', 5)) x(accuracy_range, ord)),
        b AS (SELECT {BAND} AS ord, dataset, row_number() OVER (PARTITION BY {BAND} ORDER BY dataset) AS rn FROM named)
        SELECT accuracy_range, count(dataset) AS dataset_count, coalesce(string_agg(dataset, ', ' ORDER BY dataset) FILTER (rn <= 10), '') AS datasets, dim.ord FROM dim LEFT JOIN b ON b.ord = dim.ord GROUP BY accuracy_range, dim.ord""",
    "eval_best_worst": f"""WITH {CELLS}, {NAMED}, r AS (SELECT dataset, round(accuracy, 6) AS accuracy FROM named),
        b AS (SELECT *, row_number() OVER (ORDER BY accuracy DESC, dataset)::INT AS rank, 'best' AS side FROM r), w AS (SELECT *, row_number() OVER (ORDER BY accuracy, dataset)::INT AS rank, 'worst' AS side FROM r)
        SELECT * FROM b WHERE rank <= 5 UNION ALL SELECT * FROM w WHERE rank <= 5""",
    "eval_prediction_coverage": f"WITH {CELLS} SELECT dataset, prediction_format, round(valid_total / total_samples::DOUBLE, 6) AS coverage FROM cells",
    "matrix_row_mean_rank_group": f"""WITH {CELLS}, m AS ({MATRIX}), x AS (SELECT dataset, list_avg(list_filter([{', '.join(FORMATS)}], lambda x: x IS NOT NULL)) AS row_mean FROM m),
        r AS (SELECT dataset, row_mean, row_number() OVER (ORDER BY row_mean DESC, dataset)::INT AS rank FROM x) SELECT dataset, round(row_mean, 6) AS row_mean, rank, ((rank - 1) // 2)::INT AS page FROM r""",
    "kg_isa_split": f"WITH {KG} SELECT domain, count(*) FILTER ({ISA}) AS isa, count(*) FILTER (NOT {ISA}) AS other FROM kg GROUP BY domain",
    "kg_isa_dedup": f"""WITH {KG}, i AS (SELECT * FROM kg WHERE {ISA}), t AS (SELECT head, relation, tail, pos FROM i UNION ALL SELECT head, 'ISA', tail, pos + 1000000000 FROM i WHERE pos % 3 = 0)
        SELECT head AS src, tail AS dst, arg_max(relation, pos) AS relation FROM t GROUP BY ALL""",
    "kg_components": f"WITH RECURSIVE {CC} SELECT * FROM cc",
    "kg_component_index": f"""WITH RECURSIVE {CC}, whole AS (SELECT domain || ':' || component AS component, domain || ':' || node AS node FROM cc), ed AS (SELECT DISTINCT domain || ':' || head AS head, tail FROM kg),
        n AS (SELECT component, count(*) AS node_count, array_to_string(list(node ORDER BY node)[:5], '|') AS sample_nodes FROM whole GROUP BY 1), s AS (SELECT component, count(*) AS edge_count FROM ed JOIN whole ON whole.node = ed.head GROUP BY 1)
        SELECT component, node_count, edge_count, {BUCKET.format(n='node_count', a='', b='', c='', d='')} AS size_group, sample_nodes FROM n JOIN s USING (component)""",
    "kg_size_histogram": f"""WITH RECURSIVE {CC}, s AS (SELECT domain, component, count(*) AS n FROM cc GROUP BY ALL)
        SELECT domain, {BUCKET.format(n='n', a=' (>=1000)', b=' (100-999)', c=' (10-99)', d=' (<10)')} AS bucket, count(*) AS components, sum(n)::BIGINT AS nodes FROM s GROUP BY ALL""",
    "kg_connectivity_by_domain": f"WITH RECURSIVE {CONNECT} SELECT domain, triples, components, nodes, largest_component, large, medium, small, tiny, edges, round(connectivity_rate, 6) AS connectivity_rate FROM joined",
    "kg_connectivity_summary": f"WITH RECURSIVE {CONNECT} SELECT sum(triples)::BIGINT AS triples, sum(components)::BIGINT AS components, round(avg(connectivity_rate), 6) AS mean_rate FROM joined",
    "kg_inferred": f"""WITH RECURSIVE {KG}, said AS (SELECT head AS h, relation AS r, tail AS t FROM kg
            UNION SELECT head, CASE WHEN lower(replace(relation, ' ', '')) = 'isa' THEN 'Hypernym_isA' WHEN relation = '属于' THEN 'Induction_belongTo' WHEN relation = 'locateAt' THEN 'Hypernym_locateAt' WHEN relation = 'supplies' THEN 'tradesWith' END AS r, tail FROM kg WHERE relation <> 'placedBy'),
        base AS (SELECT * FROM said UNION SELECT t, 'places', h FROM said WHERE r = 'placedBy' UNION SELECT t, 'tradesWith', h FROM said WHERE r = 'tradesWith'),
        rules(x, y, z) AS (VALUES ('Hypernym_isA', 'Hypernym_isA', 'Hypernym_isA'), ('Hypernym_locateAt', 'Hypernym_locateAt', 'Hypernym_locateAt'), ('Induction_belongTo', 'Induction_belongTo', 'Induction_belongTo'),
            ('Hypernym_locateAt', 'Hypernym_isA', 'Hypernym_locateAt'), ('placedBy', 'Hypernym_locateAt', 'Hypernym_locateAt'), ('supplies', 'Hypernym_isA', 'supplies')),
        k(h, r, t, n) USING KEY (h, r, t) AS (SELECT h, r, t, 0 FROM base UNION
            (SELECT DISTINCT h, r, t, 1 FROM (SELECT a.h, z AS r, b.t FROM k a JOIN rules ON x = a.r JOIN recurring.k b ON b.h = a.t AND b.r = y UNION SELECT a.h, z, b.t FROM recurring.k a JOIN rules ON x = a.r JOIN k b ON b.h = a.t AND b.r = y) f
             WHERE h <> t AND NOT EXISTS (SELECT 1 FROM recurring.k o WHERE o.h = f.h AND o.r = f.r AND o.t = f.t)))
        SELECT h AS head, r AS relation, t AS tail FROM k WHERE (h, r, t) NOT IN (SELECT head, relation, tail FROM kg)""",
    "kg_entities": f"WITH {KG}, {ENT} SELECT * FROM ent",
    "kg_entity_totals": f"WITH {KG}, {ENT}, p AS (SELECT domain, count(*) AS entities FROM ent GROUP BY 1) SELECT * FROM p UNION ALL SELECT '(sum)', sum(entities)::BIGINT FROM p",
    "kg_distinct_counts": f"WITH {KG} SELECT domain, count(DISTINCT head) AS heads, count(DISTINCT relation) AS relations, count(DISTINCT tail) AS tails FROM kg GROUP BY domain",
    "kg_sample_stats": f"WITH {KG} SELECT count(DISTINCT head) AS heads, count(DISTINCT relation) AS relations, count(DISTINCT tail) AS tails, (SELECT count(*) FROM (SELECT head FROM kg UNION SELECT tail FROM kg)) AS entities FROM kg",
    "kg_degrees": f"""WITH {KG}, p AS (SELECT DISTINCT domain, head, tail FROM kg), u AS (SELECT domain, head AS node, 0 AS i, 1 AS o FROM p UNION ALL SELECT domain, tail, 1, 0 FROM p)
        SELECT domain, node, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree FROM u GROUP BY ALL""",
    "kg_merge_union": f"WITH {KG} SELECT head, relation, tail, CASE WHEN domain <> 'customer' THEN pos END AS pos, domain AS source_file FROM kg",
    "kg_class_counts": f"WITH {KG} SELECT {_sub('pos')} AS label, count(*) FILTER ({ISA}) AS isa, count(*) FILTER (NOT {ISA}) AS non_isa, count(*) AS total FROM kg GROUP BY 1",
    "kg_component_classify": f"""WITH RECURSIVE {CC}, {VEC}, {PROTO}, i AS (SELECT k.domain, component, head, tail, pos FROM kg k JOIN cc ON cc.domain = k.domain AND cc.node = k.head),
        c AS (SELECT domain || ':' || component AS component, arg_min(length(domain || head) * 31 + length(domain || tail) * 7 + 38, pos) % (SELECT count(*) FROM embeddings) AS vec_id, count(*) AS edges FROM i GROUP BY ALL),
        s AS (SELECT component, edges, cl.label, list_cosine_similarity(v.vec, cl.p) AS sim, row_number() OVER (PARTITION BY component ORDER BY list_cosine_similarity(v.vec, cl.p) DESC, cl.label) AS rn FROM c JOIN v USING (vec_id), cl)
        SELECT component, CASE WHEN sim >= 0 THEN 'class' || label ELSE 'Other' END AS label, edges FROM s WHERE rn = 1""",
    "kg_paths_bounded": f"WITH RECURSIVE {PATHS} SELECT * FROM out",
    "render_nodesequence": f"WITH RECURSIVE {PATHS} SELECT ids.id, coalesce(string_agg(path, chr(10) ORDER BY path), '') AS text FROM ids LEFT JOIN out USING (id) GROUP BY ids.id",
    "triples_cap": f"""WITH {SAMPLE_LINES}, k AS (SELECT *, row_number() OVER (PARTITION BY id, m ORDER BY i) AS r FROM good), s AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY i) AS q FROM k WHERE r = 1)
        SELECT ids.id, coalesce(string_agg(head || '|' || relation || '|' || tail, ';' ORDER BY i), '') AS triples FROM ids LEFT JOIN (SELECT * FROM s WHERE q <= 2) s USING (id) GROUP BY ids.id""",
    "render_edgetable": f"WITH {SAMPLE_LINES} SELECT ids.id, coalesce(string_agg('(' || translate(head, '(),', '') || ',' || translate(relation, '(),', '') || ',' || translate(tail, '(),', '') || ')', chr(10) ORDER BY i), '') AS text FROM ids LEFT JOIN good USING (id) GROUP BY ids.id",
    "render_naturallanguage": f"WITH {SAMPLE_LINES} SELECT ids.id, coalesce(string_agg(head || ' ' || relation || ' ' || tail || '.', ' ' ORDER BY i), '') AS text FROM ids LEFT JOIN good USING (id) GROUP BY ids.id",
    "render_syntaxtree": f"""WITH {SAMPLE_LINES}, en AS (SELECT id, head AS e, i * 2 AS p FROM t UNION ALL SELECT id, tail, i * 2 + 1 FROM t), f AS (SELECT id, e, count(*) AS c, min(p) AS p FROM en GROUP BY ALL),
        k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY c DESC, p) AS r FROM f),
        lines AS (SELECT id, r, 0 AS side, 0 AS i, 'Tree ' || r || ' (Center: ' || e || ', Frequency: ' || c || '):' || chr(10) || '  Root: ' || e || chr(10) AS x FROM k
            UNION ALL SELECT k.id, r, 1, g.i, '    -> ' || g.tail || ' (via ' || g.relation || ')' || chr(10) FROM k JOIN good g ON g.id = k.id AND g.head = k.e
            UNION ALL SELECT k.id, r, 2, g.i, '    <- ' || g.head || ' (via ' || g.relation || ')' || chr(10) FROM k JOIN good g ON g.id = k.id AND g.tail = k.e
            UNION ALL SELECT id, r, 3, 0, chr(10) FROM k)
        SELECT id, rtrim(string_agg(x, '' ORDER BY r, side, i), chr(10)) AS text FROM lines GROUP BY id""",
    "render_graphml": f"""WITH {SAMPLE_LINES}, en AS (SELECT id, head AS e, i * 2 AS p FROM good UNION ALL SELECT id, tail, i * 2 + 1 FROM good), f AS (SELECT id, e, min(p) AS p FROM en GROUP BY ALL),
        k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p) - 1 AS r FROM f),
        esc AS (SELECT id, 0 AS side, r AS i, '    <node id="n' || r || '">' || chr(10) || '      <data key="label">' || e || '</data>' || chr(10) || '    </node>' || chr(10) AS x FROM k
            UNION ALL SELECT g.id, 1, g.i, '    <edge source="n' || a.r || '" target="n' || b.r || '">' || chr(10) || '      <data key="label">' || replace(replace(g.relation, '<', '&lt;'), '>', '&gt;') || '</data>' || chr(10) || '    </edge>' || chr(10)
            FROM good g JOIN k a ON a.id = g.id AND a.e = g.head JOIN k b ON b.id = g.id AND b.e = g.tail),
        body AS (SELECT id, string_agg(x, '' ORDER BY side, i) AS x FROM esc GROUP BY id)
        SELECT ids.id, '<?xml version=''1.0'' encoding=''UTF-8''?>' || chr(10) || '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">' || chr(10) || '  <graph id="G" edgedefault="directed"' ||
            CASE WHEN x IS NULL THEN '/>' || chr(10) ELSE '>' || chr(10) || x || '  </graph>' || chr(10) END || '</graphml>' || chr(10) AS text FROM ids LEFT JOIN body USING (id)""",
    "vec_prototypes": f"WITH {VEC}, {PROTO} SELECT label, i::INT AS i, round(v, 6) AS v FROM pr",
    "vec_classify": f"""WITH {VEC}, {PROTO}, s AS (SELECT vec_id, cl.label, list_cosine_similarity(vec, p) AS sim FROM v, cl), b AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, label) AS rn FROM s)
        SELECT vec_id, round(sim, 6) AS best_sim, CASE WHEN sim >= 0.3 THEN 'class' || label ELSE 'Other' END AS label FROM b WHERE rn = 1""",
    "vec_topk": f"""WITH {VEC}, s AS (SELECT q.vec_id AS question_id, d.vec_id AS triple_id, list_cosine_similarity(q.vec, d.vec) AS similarity, 0 AS place FROM v q JOIN v d ON q.is_query AND d.vec_id <> q.vec_id),
        r AS (SELECT *, row_number() OVER {RANKED} AS rank FROM s) SELECT question_id, rank::INT AS rank, triple_id, round(similarity, 6) AS similarity FROM r WHERE rank <= 10""",
    "retrieve_routed_topk": f"""WITH {VEC}, q AS (SELECT vec_id, vec, 0 AS place, 's' || label AS sub FROM v WHERE is_query UNION ALL SELECT vec_id, vec, 1, 's' || ((label + 3) % 12) FROM v WHERE is_query),
        s AS (SELECT q.vec_id AS question_id, d.vec_id AS triple_id, list_cosine_similarity(q.vec, d.vec) AS similarity, place FROM q JOIN v d ON d.vec_id <> q.vec_id AND q.sub = 's' || d.label),
        r AS (SELECT *, row_number() OVER {RANKED} AS rank FROM s) SELECT question_id, rank::INT AS rank, triple_id, round(similarity, 6) AS similarity FROM r WHERE rank <= 7""",
    "parse_router_strict": _router(True),
    "parse_router_lenient": _router(False),
    "parse_labels": f"WITH {RESPONSES}, x AS (SELECT id, {LABELS} AS l FROM r) SELECT id, CASE WHEN len(l) > 0 THEN array_to_string(l, '|') ELSE 'Other' END AS labels, array_to_string(l, '|') AS labels_or_none FROM x",
    "parse_answer": f"""WITH {QA}, x AS (SELECT id, CASE WHEN id % 11 <> 0 THEN coalesce(edgetable_prediction, '') || CASE WHEN id % 5 = 0 THEN ' so B or D.' ELSE ' no letter: ABBA' END ELSE '' END AS s FROM qa)
        SELECT id, coalesce(regexp_extract_all(s, '\\b([ABCD])\\b', 1)[-1], substr(trim(s), 1, 100)) AS answer FROM x""",
    "parse_enrichment": f"""WITH r AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 7 <> 0 THEN {EN_BODY} END AS response FROM customer),
        l AS (SELECT id, unnest(string_split(coalesce(response, ''), chr(10))) AS x, generate_subscripts(string_split(coalesce(response, ''), chr(10)), 1) AS pos FROM r),
        m AS (SELECT id, pos, trim(x) AS x, CASE WHEN contains(x, 'Enhanced Triples:') THEN 'e' WHEN contains(x, 'Hierarchical Enhancements:') THEN 'h' END AS mark FROM l),
        s AS (SELECT *, last_value(mark IGNORE NULLS) OVER (PARTITION BY id ORDER BY pos) AS section FROM m),
        p AS (SELECT id, pos, section, list_transform(string_split(x[2:-2], ','), lambda y: trim(y)) AS y FROM s WHERE mark IS NULL AND x LIKE '[%' AND x LIKE '%]')
        SELECT r.id, coalesce(string_agg(array_to_string(y, '|'), ';' ORDER BY pos) FILTER (section = 'e'), '') AS enriched, coalesce(string_agg(array_to_string(y, '|'), ';' ORDER BY pos) FILTER (section = 'h'), '') AS hierarchical
        FROM r LEFT JOIN (SELECT * FROM p WHERE len(y) = 3) p ON p.id = r.id GROUP BY r.id""",
    "format_question_options": """SELECT p_partkey AS id, p_name || CASE WHEN trim(p_brand) <> '' THEN chr(10) || 'A. ' || p_brand ELSE '' END || CASE WHEN p_partkey % 3 <> 0 THEN chr(10) || 'B. ' || p_type ELSE '' END
        || CASE WHEN p_partkey % 4 <> 0 THEN chr(10) || 'C. c' ELSE '' END AS question FROM part""",
    "format_prompt_triples": f"""WITH {SAMPLE_LINES}, k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n, head, relation, tail) - 1 AS j FROM t WHERE m = 1)
        SELECT ids.id, CASE WHEN ids.id % 5 = 0 THEN 'No triples available.' ELSE coalesce(string_agg('[' || head || ', ' || relation || ', ' || tail || '] (similarity: ' || printf('%.3f', CASE WHEN j % 2 = 0 THEN (ids.id % 9 + j) / 8.1 ELSE 0.0 END) || ')', chr(10) ORDER BY j), 'No triples available.') END AS triples FROM ids LEFT JOIN k USING (id) GROUP BY ids.id""",
    "row_counts": " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS rows FROM {t}" for t in ("region", "nation", "customer", "orders", "documents")),
    "latency_percentiles": """WITH l AS (SELECT event_type, list(value ORDER BY value) AS v FROM events WHERE value IS NOT NULL GROUP BY 1)
        SELECT event_type, len(v)::BIGINT AS n, v[1] AS min, v[-1] AS max, round(list_avg(v), 6) AS mean, """ + ", ".join(f"v[least(floor(len(v) * {q})::BIGINT, len(v) - 1) + 1] AS p{round(q * 100)}" for q in (0.5, 0.9, 0.95, 0.99)) + " FROM l",
    "call_success_stats": """SELECT count(*) AS calls, count(*) FILTER (event_id % 7 <> 0) AS successes, count(*) FILTER (event_id % 7 = 0) AS failures, sum(event_id % 3 + 1)::BIGINT AS attempts,
        round(count(*) FILTER (event_id % 7 <> 0) / count(*)::DOUBLE, 6) AS success_rate FROM events""",
    "call_throughput": """WITH t AS (SELECT event_type, count(*) FILTER (event_id % 7 <> 0) AS successes, max(event_id / 10.0::DOUBLE + abs(value)) - min(event_id / 10.0::DOUBLE) AS elapsed FROM events WHERE value IS NOT NULL GROUP BY 1)
        SELECT event_type, successes, round(elapsed, 6) AS elapsed, round(successes / elapsed, 6) AS qps FROM t""",
    "sample_exact_n": f"WITH {KG} SELECT domain, head, relation, tail, pos FROM kg ORDER BY md5(concat_ws(chr(1), '7', domain, head, relation, tail, pos)), domain, pos LIMIT 50",
    "sample_half": f"WITH {KG} SELECT domain, head, relation, tail, pos FROM kg ORDER BY md5(concat_ws(chr(1), '11', domain, head, relation, tail, pos)), domain, pos LIMIT (SELECT count(*) // 2 FROM kg)",
    "sample_remainder": f"""WITH {KG}, taken AS (SELECT domain, pos FROM kg ORDER BY md5(concat_ws(chr(1), '7', domain, head, relation, tail, pos)), domain, pos LIMIT 50)
        SELECT count(*) AS rest, 50::BIGINT AS taken FROM kg WHERE (domain, pos) NOT IN (SELECT domain, pos FROM taken)""",
    "reason_caps": f"""WITH {SAMPLE_LINES}, k AS (SELECT *, row_number() OVER (PARTITION BY id, m ORDER BY i) AS r FROM good), s AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY i) AS q FROM k WHERE r <= 2)
        SELECT ids.id, coalesce(string_agg(head || '|' || relation || '|' || tail, ';' ORDER BY i), '') AS triples FROM ids LEFT JOIN (SELECT * FROM s WHERE q <= 4) s USING (id) GROUP BY ids.id""",
    "workflow_progress": "SELECT o_orderpriority AS subject, count(*) FILTER (o_orderkey % 3 = 0) AS processed, count(*) AS total, round(100.0 * count(*) FILTER (o_orderkey % 3 = 0) / count(*), 6) AS percentage FROM orders GROUP BY 1",
    "taxonomy_lookup": f"""WITH x(subfield, ord) AS (VALUES {TAX_ROWS}), f AS (SELECT *, {FIELD} AS field FROM x), p AS (SELECT p_partkey AS id, {_sub('p_partkey')} AS subfield FROM part)
        SELECT id, field, lower(replace(replace(field, ' & ', '_'), ' ', '_')) AS field_path, subfield, lower(replace(replace(subfield, ' & ', '_'), ' ', '_')) AS subfield_path, ord::INT AS ord, field AS looked_up, 'Other' AS unknown FROM p JOIN f USING (subfield)""",
    "field_directories": "SELECT p_partkey AS id, lower(replace(replace(p_type || ' & Co', ' & ', '_'), ' ', '_')) AS dir FROM part",
    "textualized_triples": f"""WITH {KG}, k AS (SELECT domain, pos, head AS h, coalesce(CASE WHEN pos % 4 <> 0 THEN relation END, 'nan') AS r, tail AS t FROM kg)
        SELECT domain, pos, h || ' ' || r || ' ' || t AS retrieval, h || ' -> ' || r || ' -> ' || t AS classification FROM k""",
    "json_triple_lists": "SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE 1 END::INT AS n, CASE WHEN p_partkey % 3 <> 0 THEN p_brand END AS first_head FROM part",
    "resume_equivalence": "SELECT o_orderpriority AS dataset, CASE WHEN o_orderkey % 2 = 0 THEN 'done' ELSE 'rest' END AS part, count(*) AS n, count(DISTINCT o_orderkey) AS ids FROM orders GROUP BY ALL",
    "scalar_accessors": """SELECT p_partkey AS id, coalesce(CASE WHEN p_partkey % 3 <> 0 THEN p_brand END, '') AS scalar_text, CASE WHEN p_partkey % 4 <> 0 THEN p_name ELSE '' END AS scalar_list,
        p_partkey % 3 <> 0 AS present_text, p_partkey % 4 <> 0 AS present_list FROM part""",
}

ORACLE_SQL |= {"sql_router": ORACLE_SQL["parse_router_strict"], "sql_answers": ORACLE_SQL["eval_accuracy_by_dataset_format"]}
ORACLE_SQL |= {f"sql_{name}": sql for name, sql in ORACLE_SQL.items() if name.startswith("render_")}
