"""DuckDB SQL for the operators that were added last; pieces that several of them share."""

from __future__ import annotations


def _crc_table() -> list[int]:
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        out.append(n)
    return out


def crc32(x: str) -> str:
    """The CRC-32 of a text's UTF-8 bytes."""
    octets = f"list_transform(range(strlen({x})), lambda i: ('0x' || substr(hex(encode({x})), 2 * i + 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda c, b: xor(c >> 8, {_crc_table()}[xor(c, b) % 256 + 1]::BIGINT)), 4294967295)"


def _step(state: str, cost: str, letter: str, piece: str = "''") -> str:
    return f"CASE WHEN {state} IS NOT NULL THEN struct_pack(c := {state}.c + {cost}, a := {state}.a || '{letter}', t := {state}.t || {piece}) END"


def _least(*states: str) -> str:
    return f"least({', '.join(states)})"


NEW = {"user": "chr(10) || 'user:'", "assistant": "chr(10) || 'assistant:'"}
STATE = "STRUCT(c BIGINT, a VARCHAR, t VARCHAR)"
#: After any insertions: from nothing yet (s0), after system (s1), user (s2), assistant (s3).
WITH_USER = _least("s2", *[_step(s, "2", "I", NEW["user"]) for s in ("s0", "s1", "s3")])
BOTH = f"{NEW['user']} || {NEW['assistant']}"
WITH_ASSISTANT = _least("s3", _step("s2", "2", "I", NEW["assistant"]), *[_step(s, "4", "II", BOTH) for s in ("s0", "s1")])
KEPT, SAID, MORE = "chr(10) || role || ':' || text", "chr(10) || '{}:' || text", "(CASE WHEN truncated THEN 1 ELSE 0 END)"


def _to(initial: str, role: str, states: tuple[str, ...], stay: str) -> str:
    """A turn that is deleted, kept or re-roled, from the least of some states."""
    start = f"({_least(*states)})"
    keep = f"CASE WHEN NOT gone AND initial = '{initial}' THEN {_step(start, MORE, 'K', KEPT)} END"
    move = f"CASE WHEN NOT gone THEN {_step(start, '2 + ' + MORE, 'R', SAID.format(role))} END"
    return _least(_step(stay, "3", "D"), keep, move)


CONVERSATION_REPAIR = f"""
    WITH RECURSIVE d AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
    g AS (SELECT *, {crc32('k')} % 20 AS fault FROM d),
    e AS (SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role, CASE WHEN fault = 1 THEN '' WHEN fault = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
        unnest(range(CASE WHEN fault = 3 THEN 2 ELSE 1 END)) AS copy FROM g WHERE fault <> 0),
    o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS pos, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS again,
        rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare, left(role, 1) AS initial FROM e),
    f AS (SELECT conv_id, turn, role, text, pos, initial, bare = '' AS blank, bare <> '' AND again > 1 AS duplicate, bare <> '' AND again = 1 AND right(bare, 1) NOT IN ('.', '!', '?') AS truncated, bare = '' OR again > 1 AS gone,
        lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) AS before FROM o),
    n AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
        count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
    w(conv_id, pos, s0, s1, s2, s3) AS (
        SELECT conv_id, 0::BIGINT, struct_pack(c := 0::BIGINT, a := '', t := '')::{STATE}, NULL::{STATE}, NULL::{STATE}, NULL::{STATE} FROM (SELECT DISTINCT conv_id FROM conversations)
        UNION ALL SELECT conv_id, pos, {_step('s0', '3', 'D')}, {_least(_step('s1', '3', 'D'), f"CASE WHEN NOT gone AND initial = 's' THEN {_step('s0', MORE, 'K', KEPT)} END")},
            {_to('u', 'user', ('s0', 's1', 'ca'), 'cu')}, {_to('a', 'assistant', ('cu',), 'ca')}
        FROM (SELECT f.*, s0, s1, {WITH_USER} AS cu, {WITH_ASSISTANT} AS ca FROM w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.pos = w.pos + 1)),
    z AS (SELECT conv_id, least(s0, {WITH_ASSISTANT}) AS best FROM w QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY pos DESC) = 1)
    SELECT z.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, best.c AS cost, best.a AS audit, sha256(best.t[2:]) AS repaired_sha256
    FROM z LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM z.conv_id"""


_FEATURES = r"""{name}_w AS (SELECT {key} AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM {name}),
    {name}_f AS (SELECT id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM {name}_w)"""
IMPORTANCE = f"""
    WITH {_FEATURES.format(name='documents', key='doc_id')}, {_FEATURES.format(name='benchmark', key='item_id')},
    names AS (SELECT f, {crc32('f')} % 10000 AS bucket FROM (SELECT f FROM documents_f UNION SELECT f FROM benchmark_f)),
    c AS (SELECT bucket, count(*) AS s FROM documents_f JOIN names USING (f) GROUP BY bucket), b AS (SELECT bucket, count(*) AS t FROM benchmark_f JOIN names USING (f) GROUP BY bucket),
    g AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT sum(s) FROM c) + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM b) + 10000)::DOUBLE)))::BIGINT AS gain FROM c LEFT JOIN b USING (bucket)),
    m AS (SELECT id, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM documents_f JOIN names USING (f) JOIN g USING (bucket) GROUP BY id),
    d AS (SELECT id AS doc_id, len(w) + greatest(len(w) - 1, 0) AS n_features, len(w) >= 20 AS fit, coalesce(weight, 0) AS weight, ('0x' || sha256('7:' || id)[1:8])::BIGINT AS h FROM documents_w LEFT JOIN m USING (id)),
    x AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM d),
    r AS (SELECT *, row_number() OVER (PARTITION BY fit ORDER BY score DESC, doc_id) AS place FROM x)
    SELECT doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN fit AND place <= (SELECT 25 * count(*) // 100 FROM d WHERE fit) THEN place END AS rank FROM r"""
