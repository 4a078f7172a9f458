"""The stages of the pipeline on rows that are out of the ordinary, and the whole against plain Python."""

import hashlib
import random
from collections import Counter, defaultdict
from itertools import combinations

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from loomgraph.llm import langid, mixing, stages
from test_text_operators import edits, linked

SF = "/root/testdata/sf0.001"
LIBRARY = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def odd(spark):
    """Real texts among null, empty and letterless ones, null and repeated ids, equal rows, and columns with names that the stages use."""
    real = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(40).collect()]
    rows = real + [(None, real[0][1], "en", None), (None, None, None, None), (3, real[5][1], "fr", "s"), (3, real[5][1], "fr", "s"), (900, "", "en", "s"), (901, "12 34 !?", "en", "s"), (902, None, "en", "s"), (903, "x " * 60_000, "en", "s")]
    return spark.createDataFrame([(*r, "c", 1, "k") for r in rows], "doc_id long, text string, lang string, source string, line string, component long, `__key` string")


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_a_stage_takes_odd_rows(spark, odd, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    got = stage(spark, odd, SF)
    rows = got.collect()
    if name != "bpe":
        assert got.columns == odd.columns and all(r.line == "c" and r["__key"] == "k" for r in rows)
    texts = Counter((r.doc_id, r.text) for r in rows) if name != "bpe" else None
    if name == "language_id":
        assert not {900, 901, 902} & {r.doc_id for r in rows} and sum(r.doc_id == 3 for r in rows) == 3
    if name == "simhash_near_dedup":
        assert sum(r.doc_id == 3 for r in rows) == 1 and {r.doc_id for r in rows} >= {None, 901, 903} and not {901, 902} <= {r.doc_id for r in rows} - {901}
    if name == "mix_sources":
        assert all((t or "").split() for _, t in texts)
    if name == "bpe":
        assert len(rows) == odd.count() and all(r.n_tokens == len(LIBRARY.encode(t or "", add_special_tokens=False).ids) for r in rows for t in [{900: "", 901: "12 34 !?", 902: ""}.get(r.doc_id)] if t is not None)
    assert stage(spark, odd.limit(0), SF).count() == 0


def test_language_stage_drops_what_no_language_claims(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    strange = spark.createDataFrame([(10**6, "\u3042\u3044\u3046\u3048\u304a " * 30, None, "s", 1), (10**6 + 1, "qqxz zzqx xqzj " * 30, None, "s", 1)], docs.schema)
    kept = {r.doc_id for r in stages.identify_language(spark, docs.unionByName(strange), SF).collect()}
    assert 10**6 not in kept and len(kept & {r.doc_id for r in docs.collect()}) == docs.count()


def words_of(text):
    return [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split(" ") for w in w.split("\n") if w]


def shingle_set(text, n=5):
    w = words_of(text)
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) > n else frozenset([tuple(w)] if w else [])


def classes(nodes, near):
    label = {n: n for n in nodes}
    links = defaultdict(list)
    for a, b in combinations(nodes, 2):
        if near(a, b):
            links[a].append(b)
            links[b].append(a)
    moved = True
    while moved:
        moved = False
        for a in nodes:
            low = min([label[a], *(label[b] for b in links[a])])
            moved, label[a] = moved or low < label[a], low
    return label


def test_pipeline_equals_plain_python(spark):
    """Line dedup, near-dedup and encoding again in plain Python; language and mix as the operators decide them."""
    rng = random.Random(21)
    real = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(14).collect()]
    sentence = lambda: " ".join(rng.choice(real[k % 14].split()) for k in range(rng.randrange(6, 40)))
    texts = ["\n".join(sentence() for _ in range(rng.randrange(1, 5))) for _ in range(25)]
    for _ in range(20):
        w = rng.choice(texts).split(" ")
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = rng.choice(["on", "neu", "la"])
        texts.append(" ".join(w))
    # the same words in other lines: no line repeats, the documents do
    body = [rng.choice(real[k % 14].split()) for k in range(120)]
    texts += [" ".join(body), " ".join(body[:47]) + "\n" + " ".join(body[47:]), " ".join(body[:73]) + "\n" + " ".join([*body[73:], "end"])]
    texts += [texts[0], texts[1] + "\n" + texts[2], "12", ""]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(map(tuple, corpus_pipeline.STAGES and run(spark, docs)))
    model = langid.train(docs.where(~langid.held_out()))
    spoken = {r.doc_id for r in langid.predict(docs, model).where(f"lang_pred != 'und' and score >= {stages.LEAST_SCORE}").collect()}
    kept = {i: t for i, t in enumerate(texts) if i in spoken}
    first = {}
    for i, t in kept.items():
        for k, line in enumerate(t.split("\n")):
            if line.strip(" "):
                first.setdefault(line, (i, k))
    label = classes(sorted(first, key=first.get), linked) if first else {}
    lead = defaultdict(list)
    for line, head in label.items():
        lead[head].append(first[line])
    head_of = {line: min(lead[h]) for line, h in label.items()}
    clean = {}
    for i, t in kept.items():
        lines = t.split("\n")
        left = [x for k, x in enumerate(lines) if not x.strip(" ") or head_of[x] == (i, k)]
        if left == lines or any(c.isalnum() for x in left for c in x):
            clean[i] = "\n".join(left)
    sets = {i: shingle_set(t) for i, t in clean.items()}
    near = lambda a, b: sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    alone = classes(sorted(clean), near)
    unique = {i: t for i, t in clean.items() if alone[i] == i}
    mix = {r.doc_id: r.copies for r in mixing.mix(spark.createDataFrame([(i, t, f"s{i % 3}") for i, t in unique.items()], "doc_id long, text string, source string")).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t in unique.items():
        ids = LIBRARY.encode(t, add_special_tokens=False).ids
        want += [(i, len(ids), sha(" ".join(map(str, ids))), sha(LIBRARY.decode(ids, skip_special_tokens=False)))] * mix[i]
    assert len(unique) < len(clean) and got == sorted(want)


def run(spark, docs):
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    return docs.collect()
