"""Suffix tree, importance resampling and conversation repair against plain Python, and on odd rows."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomgraph.llm import blocks, conversations, importance, queries, suffixtree

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [
    (1, "The cat. The  CAT sat\x0bon the mat"), (2, None), (3, ""), (4, " \t\n"), (None, "the cat sat"), (5, "Ünïcode ÜNÏCODE 世界 x-y_z 12"), (5, "Ünïcode ÜNÏCODE 世界 x-y_z 12"),
    (16, "the cat " * 3000), (7, "a" * 50_000 + " end"), (8, "the cat sat on the mat " * 2), (9, "?!"), (10, "the"),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "x", "y", "z") for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, id string, block string, words string").repartition(3)


def plain_tree(rows, held, mass=8.0, least=2.0):
    """(n_tokens, n_known, n_contexts, N, base, score) of each row, by counters."""
    texts = [[*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW)), None] for _, t in rows]
    count, heads = [Counter() for _ in range(3)], [Counter() for _ in range(3)]
    for words, out in zip(texts, held, strict=True):
        for k, n in itertools.product(range(len(words)), range(3)):
            if not out and k >= n:
                count[n][tuple(words[k - n : k + 1])] += 1
                heads[n][tuple(words[k - n : k])] += 1
    total, distinct = sum(count[0].values()), len(count[0])

    def p(context, x, left_out=0):
        if not context:
            return (count[0][(x,)] + 0.1) / (total + 0.1 * (distinct + 1))
        n = len(context)
        return (count[n][(*context, x)] - left_out + mass * p(context[1:], x)) / (heads[n][context] - left_out + mass)

    gain = Counter()
    for gram, c in [*count[1].items(), *count[2].items()]:
        gain[gram[:-1]] += c * round(10_000 * math.log10(p(gram[:-1], gram[-1], 1) / p(gram[1:-1], gram[-1])))
    kept = {c for c, g in gain.items() if g >= least * 10_000}
    out = []
    for words in texts:
        contexts = [next((c for n in (2, 1) if k >= n and (c := tuple(words[k - n : k])) in kept), ()) for k in range(len(words))]
        scores = [(math.log10(p((), x)), math.log10(p(c, x))) for c, x in zip(contexts, words, strict=True)]
        out.append((len(words), sum((x,) in count[0] for x in words), sum(map(bool, contexts)), total, sum(s[0] for s in scores), sum(s[1] for s in scores)))
    return out


def left_out(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 10 == 0


@pytest.mark.parametrize("size", [200, 1 << 20])
def test_tree_equals_counters(spark, odd, size):
    want = Counter()
    for (i, _), r in zip(ODD, plain_tree(ODD, [left_out(i) for i, _ in ODD]), strict=True):
        want[(i, left_out(i), *r[:4], round(r[4], 6), round(r[5], 6))] += 1
    got = suffixtree.score(odd, size=size, per_shard=1000).collect()
    assert Counter((*r[:6], round(r.base_score, 6), round(r.score, 6)) for r in got) == want
    assert sum(r.n_contexts for r in got) > 1000


def test_tree_over_the_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in queries.table(spark, folder, "documents").select("doc_id", "text").collect()]
    want = dict(zip([i for i, _ in rows], plain_tree(rows, [left_out(i) for i, _ in rows]), strict=True))
    got = queries.op11_suffix_tree(spark, folder).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_tokens, r.n_known, r.n_contexts, r.train_tokens) == want[r.doc_id][:4]
        assert math.isclose(r.base_score, want[r.doc_id][4], abs_tol=1e-6) and math.isclose(r.score, want[r.doc_id][5], abs_tol=1e-6)
    unseen = [r for r in got if r.held_out]
    assert sum(r.score for r in unseen) > 0.97 * sum(r.base_score for r in unseen), "the tree must predict texts that it hasn't seen"


def test_tree_of_nothing(spark, odd):
    assert suffixtree.score(odd.where("false")).count() == 0
    assert {(r.n_known, r.base_score, r.score) for r in suffixtree.score(odd, held=F.lit(True)).collect()} == {(0, 0.0, 0.0)}


def test_blocks_hold_every_text(spark, odd):
    found = blocks.blocks(odd.select("doc_id", "text"), "text", blocks.NOT_SPACE, size=100).collect()
    back = Counter()
    for row in found:
        words = blocks.Words(row.asDict(recursive=True))
        texts = words.distinct.to_pylist()
        for d, a, b in zip(words.docs, words.ends - words.sizes, words.ends, strict=True):
            back[(d["doc_id"], " ".join(texts[c] for c in words.codes[a:b]))] += 1
    assert back == Counter((i, " ".join(re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW)))) for i, t in ODD)


def features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
    return words, words + [" ".join(p) for p in itertools.pairwise(words)]


def plain_weights(rows, target, buckets):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for text in texts for f in features(text)[1]) for texts in ([x for _, x in rows], target))
    n_s, n_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * n_s / ((s[b] + 1.0) * n_t))) for b in range(buckets)]
    out = []
    for i, text in rows:
        words, f = features(text)
        weight = sum(gain[bucket(x)] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(words), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    return out


@pytest.mark.parametrize("size", [200, 1 << 20])
def test_weights_of_odd_rows(spark, odd, size):
    target = ["the cat sat", None, "12 世界"]
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    weighed = importance.weigh(odd, wanted, buckets=100, size=size, per_shard=1000)
    assert Counter(map(tuple, weighed.collect())) == Counter(plain_weights(ODD, target, 100))
    ranked = importance.draw(weighed, share=0.5, least_words=2).collect()
    fit = sorted((r for r in plain_weights(ODD, target, 100) if r[1] >= 2), key=lambda r: (-r[4], r[0] is not None, r[0]))
    assert Counter((r.doc_id, r.score, r["rank"]) for r in ranked if r["rank"]) == Counter((r[0], r[4], k) for k, r in enumerate(fit[: len(fit) // 2], 1))
    assert len(ranked) == len(ODD)


def test_weights_of_nothing(spark, odd):
    none = spark.createDataFrame([], "text string")
    assert importance.draw(importance.weigh(odd.where("false"), none)).count() == 0
    assert importance.weigh(odd, none, buckets=10).count() == len(ODD)


@pytest.mark.parametrize("name", ["op12_importance", "op13_conversation_repair"])
def test_query_equals_sql(name, same):
    same(queries.QUERIES[name], queries.ORACLE_SQL[name])


def plain_repair(rows):
    """(cost, audit, repaired) by trying all edits of rows (initial, must go, truncated): insertions of up to two turns before each and at the end."""
    best = None
    inserts = ["", "u", "a", "ua", "au"]
    for gaps in itertools.product(inserts, repeat=len(rows) + 1):
        for edits in itertools.product(*[["D"] if gone else ["D", "K", "Ru", "Ra"] for _, gone, _ in rows]):
            cost, audit, roles = 0, "", ""
            for gap, edit, (initial, _, truncated) in zip(gaps, [*edits, ""], [*rows, ("", 0, 0)], strict=True):
                cost += 2 * len(gap) + {"": 0, "D": 3, "K": truncated, "Ru": 2 + truncated, "Ra": 2 + truncated}[edit]
                audit += "I" * len(gap) + edit[:1]
                roles += gap + {"": "", "D": "", "K": initial}.get(edit, edit[1:])
            if re.fullmatch("(s?(ua)+)?", roles) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, roles)
    return best


def test_matrices_find_the_cheapest_edits():
    rng = random.Random(5)
    for _ in range(60):
        rows = [(rng.choice("suaxt"), rng.random() < 0.25, int(rng.random() < 0.3)) for _ in range(rng.randrange(4))]
        kinds = "".join("D" if gone else (i if i in "sua" else "x").upper() if cut else i if i in "sua" else "x" for i, gone, cut in rows)
        assert conversations.cheapest(conversations.product(kinds)) == plain_repair(rows)[:2], rows


def test_products_are_associative():
    rng = random.Random(7)
    for _ in range(40):
        kinds = "".join(rng.choice("suaxSUAXD") for _ in range(rng.randrange(1, 40)))
        at = rng.randrange(len(kinds))
        left = conversations.ONE
        for k in kinds:
            left = conversations.times(left, conversations.turn_matrix(k))
        assert left == conversations.product(kinds) == conversations.times(conversations.product(kinds[:at]), conversations.product(kinds[at:]))


def plain_conversation(rows):
    """Summary and repaired turns of one conversation, by a table of the cheapest (cost, audit, turns) of each state."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
    seen, tally, best = set(), Counter(), {"": (0, "", [])}
    step = {"": "u", "s": "u", "a": "u", "u": "a"}

    def inserted(states):
        for _ in range(3):
            for s, (cost, audit, said) in list(states.items()):
                new = (cost + 2, audit + "I", [*said, ({"u": "user", "a": "assistant"}[step[s]], "")])
                states[step[s]] = min(states.get(step[s], new), new, key=lambda x: x[:2])
        return states

    for _, role, text in rows:
        blank, again = not re.search(r"[^\x20\x09-\x0D]", text), (role, text) in seen
        cut = not blank and not again and not re.search(r"[.!?][\x20\x09-\x0D]*$", text)
        tally["blank"] += blank
        tally["duplicate"] += not blank and again
        tally["truncated"] += cut
        seen.add((role, text))
        new = {}
        for s, (cost, audit, said) in inserted(best).items():
            ways = [(s, (cost + 3, audit + "D", said))]
            if not blank and not again:
                ways.append((step[s], (cost + 2 + cut, audit + "R", [*said, ({"u": "user", "a": "assistant"}[step[s]], text)])))
                if role[:1] == step[s] or (role[:1], s) == ("s", ""):
                    ways.append((role[:1], (cost + cut, audit + "K", [*said, (role, text)])))
            for to, way in ways:
                new[to] = min(new.get(to, way), way, key=lambda x: x[:2])
        best = new
    cost, audit, said = min((v for s, v in inserted(best).items() if s in ("", "a")), key=lambda x: x[:2])
    numbers = {r[0] for r in rows} - {None}
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    return (max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0, tally["blank"], tally["duplicate"], tally["truncated"], illegal, cost, audit), said


def test_long_odd_conversations(spark):
    """One conversation holds most rows and spans all partitions; nulls, repeated turns and copies."""
    rng = random.Random(3)
    roles, texts = ["user", "assistant", "system", "tool", None, ""], ["Yes.", "Yes.", "no", "", " \n", None, "What?\t", "x" * 20_000 + "!"]
    rows = [("hot", rng.choice([None, rng.randrange(500), rng.randrange(500)]), rng.choice(roles), rng.choice([*texts, f"t{k}.", f"t{k}"])) for k in range(1500)]
    rows += [(rng.choice([None, "a", "b", "", "c"]), rng.choice([None, 1, 2, 3]), rng.choice(roles), rng.choice(texts)) for _ in range(60)]
    rows += [("copies", 1, "user", "Again.")] * 700 + [("first", k, "user", "Hello.") for k in range(3)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id string, turn long, role string, text string, c string, part int").repartition(5)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        fixed = conversations.repair(df, fan_in=2)
        summary = {r[0]: tuple(r)[1:] for r in fixed.summary.collect()}
        said = {}
        for r in sorted(fixed.turns.collect(), key=lambda r: r.position):
            said.setdefault(r.conv_id, []).append((r.role, r.text))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    held = {}
    for conv, turn, role, text in rows:
        held.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    assert set(summary) == set(held)
    for conv, own in held.items():
        want, turns = plain_conversation(own)
        assert summary[conv] == want, conv
        assert said.get(conv, []) == turns, conv
    assert {r[0]: r[1] for r in conversations.digests(fixed.turns).collect()} == {c: hashlib.sha256("\n".join(f"{a}:{b}" for a, b in x).encode()).hexdigest() for c, x in said.items()}


def test_no_conversations(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    fixed = conversations.repair(conversations.damage(empty), "conv")
    assert fixed.summary.count() == fixed.turns.count() == 0
