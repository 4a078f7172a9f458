"""Tokenizers, language ID, fingerprints, lines and mixing against brute force, libraries and hand-made cases."""

import hashlib
import random
import re
import time
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomgraph.llm import bpe, langid, linededup, mixing, queries, shingles, simhash, stages, tokencount

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
SF = "/root/testdata/sf0.001"
ODD = ["", " ", None, "a", "the the", "<|endoftext|>x<|ENDOFTEXT|>", "a\x1cb\x85c", "Σας ΣΑΣ İx", "é é ﬁ ́", "日本語 text", "\n\n!!!", "ab" * 30_000, "word " * 9_000]


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, t, "en", "s") for i, t in enumerate(ODD)] + [(None, "no id", "x", "en", None), (1, "again", "x", None, "s")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, lang string, source string")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def coder():
    return bpe.WordBPE(PATH)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "in", "the", "é", "É", "Σ", "日", "\x1c", " ", "\u2003", "'s", "1", "½", "!!", "<|endoftext|>", "<|", "\u0301", "İ", "aaaa", "\u200b", "\x00", "_"]), max_size=12).map("".join))
def test_encoding_equals_the_library(text):
    coder = bpe.encoder(PATH)
    assert coder.encode(text) == ids(text)
    assert coder.decode(ids(text)) == LIBRARY.decode(ids(text), skip_special_tokens=False)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=20))
def test_encoding_of_any_text(text):
    assert bpe.encoder(PATH).encode(text) == ids(text)


def test_pairs_equal_merging(coder):
    rng = np.random.default_rng(1)
    usable = np.array(sorted(coder.middle.values()))
    ends = np.array(sorted(coder.end.values()))
    a, b = rng.choice(usable, 4000), np.concatenate((rng.choice(usable, 2000), rng.choice(ends, 2000)))
    fine = coder.compatible(a, b)
    for x, y, ok in zip(a.tolist(), b.tolist(), fine.tolist(), strict=True):
        left, right = coder.names[x], coder.names[y]
        closed = right.endswith("</w>")
        word = left + (right[:-4] if closed else right)
        assert (coder._merge(coder._symbols(word, closed))[0] == [x, y]) == ok
    assert 0 < fine.sum() < len(fine)


def test_a_small_cache_gives_the_same(docs):
    texts = [r.text for r in docs.limit(40).collect()]
    small, large = bpe.WordBPE(PATH, cache=50), bpe.encoder(PATH)
    assert list(small.rows(texts)) == list(large.rows(texts))


def test_documents(docs, odd):
    for df in (docs, odd):
        text = Counter((r.doc_id, r.text) for r in df.collect())
        got = bpe.encode_documents(df.select("doc_id", "text"), PATH)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want = Counter((i, len(ids(t)), sha(" ".join(map(str, ids(t)))), sha(LIBRARY.decode(ids(t), skip_special_tokens=False))) for i, t in text.elements())
        assert Counter(map(tuple, got.collect())) == want
        for chunk, overlap in ((32_768, 512), (200, 8)):
            n = tokencount.count_tokens(df, PATH, chunk=chunk, overlap=overlap, max_tokens=100)
            assert Counter(map(tuple, n.collect())) == Counter((i, len((t or "").encode()), len(ids(t)), len(ids(t)) > 100) for i, t in text.elements())
    assert bpe.encode_documents(docs.where("false"), PATH).count() == tokencount.count_tokens(docs.where("false"), PATH).count() == 0


def test_overlaps_are_widened():
    counter = tokencount.TokenCounter(PATH, chunk=64, overlap=4)
    text = "some words " * 5 + "x" * 300 + " more words" * 30
    assert counter.count_long(text) == len(ids(text)) and counter.widened


@pytest.mark.parametrize("text", ["a" * 300_000, "ab1" * 70_000, "x!y?" * 60_000, ("q" * 900 + "7") * 200, "日本" * 40_000, "no" * 20_000 + " " + "yes " * 9_000 + "z" * 50_000])
def test_counts_without_white_space(text):
    counter = tokencount.TokenCounter(PATH, chunk=4096, overlap=64)
    assert counter.count_long(text) == len(ids(text))


def test_long_words_take_time_in_proportion(coder):
    """A MB of letters without a blank: far less than a quadratic algorithm would take."""
    rng = random.Random(9)
    letters = "".join(rng.choices("etaoinshrdlu", k=1_000_000))
    began = time.process_time()
    got = coder.encode(letters)
    spent = time.process_time() - began
    mixed = "".join(rng.choices("etaoin1!", k=1_000_000))
    began = time.process_time()
    counted = tokencount.TokenCounter(PATH).count_long(mixed), tokencount.TokenCounter(PATH).count_long(letters)
    assert spent < 30 and time.process_time() - began < 60
    assert counted == (len(ids(mixed)), len(ids(letters))) and got == ids(letters)


def test_language_of_held_out_documents(spark, docs, odd):
    model = langid.train(docs.where(~langid.held_out()))
    got = langid.predict(docs, model).where(langid.held_out()).toPandas()
    assert len(got) > 30 and (got.lang == got.lang_pred).mean() >= 0.98 and got.score.between(0, 1).all()
    strange = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(odd.where("doc_id is not null and doc_id != 1"), model).collect()}
    assert strange[0] == strange[2] == strange[10] == ("und", 0.0) and strange[4][0] == "en"
    none = langid.train(docs.where("false"))
    assert {r.lang_pred for r in langid.predict(docs, none).collect()} == {"und"}


def test_filters_contain_what_was_put_in():
    rng = np.random.default_rng(2)
    words = {f"l{k:02}": {int(g): 5 for g in rng.integers(0, 2**62, 400)} for k in range(70)}
    model = langid.build_filters(words, bits=14)
    for k, lang in enumerate(model.languages):
        hit = model.masks(np.array(list(words[lang]), np.uint64))[k // 64] & np.uint64(1 << (k % 64))
        assert hit.all()
    other = model.masks(rng.integers(2**62, 2**63, 5000).astype(np.uint64))[0] & np.uint64(1)
    assert abs(np.count_nonzero(other) / 5000 - model.false_rate[0]) < 0.01


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_and_components(docs, odd):
    for df in (docs, odd.where("doc_id is not null").dropDuplicates(["doc_id"])):
        rows = {r.doc_id: plain_fingerprint(r.text) for r in df.collect()}
        label = {i: i for i in rows}
        moved = True
        while moved:
            moved = False
            for i in rows:
                low = min(label[j] for j in rows if (rows[i] ^ rows[j]).bit_count() <= 3)
                moved, label[i] = moved or low < label[i], low
        got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()}
        assert got == {i: (f"{rows[i]:016x}", label[i]) for i in rows}
    assert simhash.near_duplicates(docs.where("false")).count() == 0
    assert simhash.near_duplicates(odd).count() == odd.count()


@pytest.mark.parametrize("seed", [1, 2])
def test_trees_lose_no_link(spark, seed):
    """Few prototypes with many bits flipped: dense groups, in tiny shards."""
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, 12).astype(np.uint64)
    fps = set()
    for _ in range(1500):
        x = int(rng.choice(base))
        for b in rng.integers(0, 64, rng.integers(0, 8)):
            x ^= 1 << int(b)
        fps.add(x)
    arr = np.array(sorted(fps), np.uint64)
    reps = np.arange(len(arr))
    near = np.bitwise_count(arr[:, None] ^ arr[None, :]) <= 3
    label = reps.copy()
    while not np.array_equal(label, new := np.where(near, label[None, :], len(arr)).min(1)):
        label = new
    df = spark.createDataFrame([(int(f), int(r)) for f, r in zip(arr.view(np.int64), reps, strict=True)], "fp long, rep long")
    got = {r.fp: r.component for r in simhash.hamming_components(df, shard=100).collect()}
    assert [got[int(f)] for f in arr.view(np.int64)] == label.tolist()
    forest = simhash.link_shard(arr, simhash._slice(arr, 0, 1), 3, 3, leaf=16)
    assert [forest.root(i) for i in range(len(arr))] == label.tolist()


def test_near_copies_of_the_pipeline(spark):
    """All pairs by brute force: few words changed, boilerplate, short texts, chains of copies."""
    rng = random.Random(6)
    word = lambda: f"w{rng.randrange(3000)}"
    texts = [" ".join(word() for _ in range(rng.choice((2, 6, 30, 200, 400)))) for _ in range(40)]
    for _ in range(160):
        w = rng.choice(texts).split()
        for _ in range(rng.randrange(6)):
            w[rng.randrange(len(w))] = word()
        texts.append(" ".join(w))
    common = " ".join(word() for _ in range(60))
    texts += [common + " " + " ".join(word() for _ in range(8 * i)) for i in range(12)] + ["", None, " \n"]
    own = [set(simhash.shingle_hashes(t, 5).tolist()) for t in texts]
    near = [[j for j in range(len(texts)) if own[i] == own[j] or len(own[i] & own[j]) >= 0.8 * len(own[i] | own[j]) > 0] for i in range(len(texts))]
    label = list(range(len(texts)))
    while (new := [min(label[j] for j in js) for js in near]) != label:
        label = new
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    far = sum((plain_fingerprint(texts[i]) ^ plain_fingerprint(texts[j])).bit_count() > 3 for i in range(len(texts)) for j in near[i])
    assert far > 100
    close = shingles._by_fingerprint(shingles.shingle_sets(docs, "doc_id", "text", 5, 0.8, (np.empty(0, np.uint64), np.empty(0))), 0.8, 3)
    assert 0 < close.count() < len(texts)
    for sample in (20_000, 0):
        got = {r.doc_id: r.component_id for r in shingles.near_copies(docs, sample=sample).collect()}
        assert [got[i] for i in range(len(texts))] == label
    kept = {r.doc_id for r in stages.drop_near_copies(spark, docs, SF).collect()}
    assert kept == set(label)
    none = docs.withColumn("doc_id", F.when(F.col("doc_id") >= 0, None).otherwise(F.col("doc_id")))
    assert shingles.near_copies(none).where("component_id is null").count() == len(texts)
    assert shingles.near_copies(docs.where("false")).count() == 0


def test_near_copies_fetch_texts_of_possible_pairs_only(spark):
    """Documents that share a phrase are candidates; sketches rule them out before any text moves, and never a pair that links."""
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(10**6)}"
    phrase = " ".join(word() for _ in range(20))
    texts = [phrase + " " + " ".join(word() for _ in range(300)) for _ in range(60)]
    texts += [texts[0].rsplit(" ", 30)[0]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    none = (np.empty(0, np.uint64), np.empty(0))
    candidates = shingles._groups(shingles.shingle_sets(docs, "doc_id", "text", 5, 0.8, none)).selectExpr("max(size(members))").first()[0]
    report = []
    got = {r.doc_id: r.component_id for r in shingles.near_copies(docs, sample=0, report=report).collect()}
    assert candidates > 30 and sum(report) == 1
    assert got == {i: i for i in range(60)} | {60: 0}
    for n, m in ((5, 1), (40, 8), (900, 180), (9000, 900)):
        a = np.unique(np.array([rng.getrandbits(64) for _ in range(n)], np.uint64))
        b = np.unique(np.concatenate([a[m // 2 :], np.array([rng.getrandbits(64) for _ in range(m - m // 2)], np.uint64)]))
        x, y = (shingles.sketch_of(h).view(np.uint64) for h in (a, b))
        assert len(x) == shingles.SKETCH // 64 and np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


def test_sketches_grow_with_sets(spark):
    """Long texts that share a phrase are ruled out too, and sketches of two sizes are compared at the smaller one."""
    rng = np.random.default_rng(5)
    text = lambda n: " ".join(rng.choice(30_000, n).astype(str))
    long = [f"the one and only phrase {text(4000)}" for _ in range(6)]
    docs = spark.createDataFrame([*enumerate(long), (6, f"{long[0]} {text(300)}")], "doc_id long, text string")  # 4001 and 4301 shingles: 4096 and 8192 bits
    report = []
    got = {r.doc_id: r.component_id for r in shingles.near_copies(docs, sample=0, report=report).collect()}
    assert got == {i: i if i < 6 else 0 for i in range(7)} and sum(report) == 1
    for n, more in ((900, 200), (2000, 400), (5000, 1), (4000, 900)):
        a = np.unique(rng.integers(0, 1 << 63, n, np.uint64))
        b = np.union1d(a[more // 4 :], rng.integers(0, 1 << 63, more, np.uint64))
        df = spark.createDataFrame([tuple(shingles.sketch_of(h, shingles.sketch_size(len(h))).tolist() for h in (a, b))], "x array<long>, y array<long>")
        there, back = df.select(shingles.bits_apart(F.col("x"), F.col("y")), shingles.bits_apart(F.col("y"), F.col("x"))).first()
        assert 0 < there == back <= len(np.setxor1d(a, b))


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def change(rng, text, n):
    out = list(text)
    for _ in range(n):
        at = rng.randrange(len(out) + 1)
        out[at : at + rng.randrange(2)] = rng.choice(["", "x", "t", "é", "日"])
    return "".join(out)


def test_edit_distance_automaton(spark):
    rng = random.Random(3)
    rows = [(a := "".join(rng.choice("abé日") for _ in range(rng.randrange(25))), change(rng, a, rng.randrange(5))) for _ in range(800)] + [("", ""), ("", "a"), ("abc", "")]
    df = spark.createDataFrame(rows, "a string, b string")
    for tau in (1, 2, 3):
        got = df.select("a", "b", linededup.within(linededup.chars(F.col("a")), linededup.chars(F.col("b")), tau).alias("w")).collect()
        assert all(r.w == (edits(r.a, r.b) <= tau) for r in got)


def linked(a, b):
    """By the definition, in plain Python."""
    x, y = a.split(" "), b.split(" ")
    bands = linededup.WORD_EDITS if min(len(x), len(y)) >= linededup.LONG else linededup.CHAR_EDITS
    x, y = (x, y) if bands is linededup.WORD_EDITS else (a, b)
    tau = max([t for least, t in bands if min(len(x), len(y)) >= least], default=0)
    return tau and abs(len(x) - len(y)) <= tau and edits(x, y) <= tau


def test_lines_of_the_same_words_in_another_order_are_no_candidates(spark):
    """An edit changes four pairs of neighbours at most; an anagram has the parity of its units but not of their pairs."""
    rng = random.Random(12)
    base = [f"w{i}" for i in range(30)]
    rows = [(base, rng.sample(base, 30), 30)] + [(base, base[:k] + new + base[k + cut :], 1) for k in range(30) for new, cut in ((["n"], 1), (["n"], 0), ([], 1))] + [([], ["a"], 1), (["a"], ["b"], 1)]
    made = spark.createDataFrame(rows, "a array<string>, b array<string>, edits int")
    for c in "ab":
        made = made.withColumn(c, F.struct(F.size(c).alias("n"), F.lit(1).alias("tau"), linededup._parity(F.col(c)).alias("parity"), linededup._bigrams(F.col(c)).alias("pairs")))
    assert {r[:] for r in made.select("edits", linededup._alike("a", "b")).distinct().collect()} == {(30, False), (1, True)}


def test_line_classes(spark):
    rng = random.Random(4)
    lines = ["".join(rng.choice("ea ") for _ in range(rng.randrange(18, 40))) for _ in range(40)] + ["".join(rng.choice("ab") for _ in range(rng.randrange(3, 13))) for _ in range(20)]
    lines += [change(rng, rng.choice(lines), rng.randrange(4)) for _ in range(200)]
    for n in (14, 15, 16, 17, 18, 30, 47, 48, 49, 50, 95, 97, 100, 191, 193, 196, 210):
        base = [rng.choice(["on", "a", "the", "it", "is", f"w{rng.randrange(400)}"]) for _ in range(n)]
        for k in range(8):
            w = list(base)
            for _ in range(rng.randrange(1, 10) if k else 0):
                at = rng.randrange(len(w))
                w[at : at + rng.randrange(2)] = [f"n{rng.randrange(9)}"] * rng.randrange(2)
            lines.append(" ".join(w))
    rng.shuffle(lines)
    rows = [(i, "\n".join(lines[i * 5 : i * 5 + 5])) for i in range(-(-len(lines) // 5))] + [(190, None), (191, ""), (192, " \n\r\n"), (193, lines[0] + "\r\n" + lines[0])]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, line string, h1 long")
    first, copies = {}, Counter()
    for i, text in rows:
        for k, line in enumerate((text or "").split("\n")):
            line = line.rstrip("\r")
            if line.strip(" "):
                first.setdefault(line, (i, k))
                copies[line] += 1
    near = defaultdict(list)
    for a, b in combinations(first, 2):
        if linked(a, b):
            near[a].append(b)
            near[b].append(a)
    long = [len(a.split(" ")) for a in near if len(a.split(" ")) >= linededup.LONG]
    assert {max(t for least, t in linededup.WORD_EDITS if n >= least) for n in long} == {2, 3, 4}
    label = dict(first)
    moved = True
    while moved:
        moved = False
        for a in first:
            low = min([label[a], *(label[b] for b in near[a])])
            moved, label[a] = moved or low < label[a], low
    want = {first[a]: (len(a), copies[a], *label[a]) for a in first}
    got = {(r.doc_id, r.line_no): (r.n_chars, r.n_copies, r.class_doc_id, r.class_line_no) for r in linededup.near_duplicate_lines(docs).collect()}
    assert got == want
    kept = {r.doc_id: r.text for r in linededup.dedup_lines(docs).collect()}
    for i, text in rows:
        left = [x for k, x in enumerate(text.split("\n")) if not ((s := x.rstrip("\r")).strip(" ") and label[s] != (i, k))] if text else []
        if text is None or left == text.split("\n") or text == "":
            assert kept[i] == text
        elif any(c.isalnum() for x in left for c in x):
            assert kept[i] == "\n".join(left)
        else:
            assert i not in kept
    assert linededup.near_duplicate_lines(docs.where("false")).count() == 0 and linededup.dedup_lines(docs.where("false")).count() == 0


def test_variants_meet_the_line_that_they_were_made_from(spark, monkeypatch):
    """Variants of a line are within its edits, but hardly within those of each other; the first trials link them all, so none is left to be paired."""
    rng = random.Random(13)
    letter = lambda: rng.choice("abcdefghijklmnopqrstuvwxyz")
    base = "".join(letter() for _ in range(60))
    variants = {base[:k] + letter().upper() + base[k + 1 : 59 - k] + letter().upper() + base[60 - k :] for k in range(29) for _ in range(4)}
    docs = spark.createDataFrame([(0, "\n".join([base] * 9)), *enumerate(variants, 1)], "doc_id long, text string")
    first, write = [], linededup.cut

    def watched(df, name, **more):
        out = write(df, name, **more)
        first.extend([out.where(F.xxhash64(F.lit(base)).isin(F.col("a"), F.col("b"))).count()] if name == "line-links" and not first else [])
        return out

    monkeypatch.setattr(linededup, "cut", watched)
    got = linededup.near_duplicate_lines(docs).collect()
    assert len(got) == len(variants) + 1 and {(r.class_doc_id, r.class_line_no) for r in got} == {(0, 0)}
    assert first == [len(variants)]


def test_every_occurrence_of_a_line_is_a_member(docs, spark):
    """Against the classes of distinct lines: no occurrence and no document is left out."""
    at = {(r.doc_id, k): s for r in docs.collect() for k, x in enumerate((r.text or "").split("\n")) if (s := x.rstrip("\r")).strip(" ")}
    first = {at[r.doc_id, r.line_no]: tuple(r)[2:] for r in linededup.near_duplicate_lines(docs).collect()}
    got = queries.op5_line_dedup(spark, SF).collect()
    assert len(at) > len(first) and Counter(tuple(r) for r in got) == Counter((*key, *first[s]) for key, s in at.items())


def test_lines_of_rows_that_share_an_id(spark):
    """Null and repeated ids: each row loses its own lines only, and equal rows all but one."""
    line = lambda k: f"line {k} " + hashlib.sha256(str(k).encode()).hexdigest()
    lists = [(1, [0, 1]), (None, [2, 1, 3]), (None, [4, 5, 6]), (2, [1, 7, 8]), (2, [9, 10, 11]), (None, [12]), (None, [12]), (2, [5, 13, 14]), (3, [15, 16])]
    docs = spark.createDataFrame([(i, "\n".join(map(line, ks))) for i, ks in lists], "doc_id long, text string")
    got = linededup.dedup_lines(docs)
    assert got.columns == docs.columns
    lines = Counter(x for r in got.collect() for x in r.text.split("\n"))
    assert lines == Counter(map(line, range(17)))
    texts = {(r.doc_id, r.text) for r in got.collect()}
    assert (1, f"{line(0)}\n{line(1)}") in texts and (None, f"{line(2)}\n{line(3)}") in texts and (None, f"{line(4)}\n{line(6)}") in texts
    assert (2, f"{line(7)}\n{line(8)}") in texts and (2, f"{line(9)}\n{line(10)}\n{line(11)}") in texts and len(texts) == got.count() == 8


def water_fill(sizes, weights, total, most):
    """Reshare what is over the caps until nothing is."""
    target, fixed = dict.fromkeys(sizes, 0.0), set()
    while True:
        free = [s for s in sizes if s not in fixed]
        rest = total - sum(target[s] for s in fixed)
        for s in free:
            target[s] = rest * weights[s] / sum(weights[x] for x in free)
        over = [s for s in free if target[s] > most * sizes[s]]
        if not over:
            return target
        for s in over:
            target[s] = most * sizes[s]
        fixed |= set(over)


def test_many_equal_rows_of_one_id(spark):
    """Their order is that of the ids, however many there are, and the first of them keeps its line."""
    same, own = "The very same line stands in all of these rows.", "Only the second document holds this other line."
    many = spark.range(100_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit(same).alias("text"))
    few = spark.createDataFrame([(2, f"{same}\n{own}"), (3, same), (None, same)], "doc_id long, text string")
    began = time.time()
    got = linededup.dedup_lines(few.unionByName(many)).collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(1, same), (2, own)] and time.time() - began < 120


def test_mixing(spark, docs):
    extra = spark.createDataFrame([(10**6, None, "src1"), (10**6 + 1, "a b c", None), (10**6 + 1, "a b c", None), (None, "d", "src1"), (10**6 + 2, "", "empty")], "doc_id long, text string, source string")
    rows = docs.select("doc_id", "text", "source").unionByName(extra)
    got = mixing.mix(rows, block=16, fan_in=4).toPandas()
    again = mixing.mix(rows.repartition(7), block=16, fan_in=4).toPandas()
    key = ["doc_id", "size", "source", "taken"]
    order = lambda d: d[key].fillna({"source": "~", "doc_id": -1}).sort_values(key).values.tolist()
    assert order(got) == order(again) and len(got) == rows.count()
    sizes = {r.source: sum(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in r.t) for r in rows.groupBy("source").agg(F.collect_list(F.coalesce("text", F.lit(""))).alias("t")).collect()}
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    want = water_fill(sizes, weights, 1.5 * sum(sizes.values()), 2.0)
    for source in names:
        mine = got[got.source == source] if source is not None else got[got.source.isna()]
        assert np.allclose(mine.target, want[source]) and (mine.taken <= 2 * mine["size"]).all()
        # sources of ten documents here, one of which may be half of the words: expectations are kept, so a document's size is the bound
        assert abs(mine.taken.sum() - want[source]) <= max(8, mine["size"].max())
    larger = mixing.mix(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).toPandas().groupby("source").agg({"taken": "sum", "target": "first"})
    assert (abs(larger.taken - larger.target) <= 0.05 * larger.target).all()
    assert mixing.mix(rows.where("false")).count() == 0
    out = mixing.repeat(rows, block=16, fan_in=4)
    assert out.columns == rows.columns and out.count() == got.copies.sum()


def test_pairwise_rounding_keeps_the_sum():
    rng = random.Random(5)
    for _ in range(200):
        rows = [(str(i), rng.randrange(0, 50), rng.random()) for i in range(rng.randrange(0, 12))]
        for step in (mixing.pivot, mixing.settle):
            same = [(k, s, 0.4) for k, s, _ in rows] if step is mixing.settle else rows
            same = sorted(same, key=lambda r: -r[1])
            out = step(same, 1)
            assert sum(0 < p < 1 for p in out) <= 1 and all(0 <= p <= 1 for p in out)
            assert abs(sum(s * p for (_, s, _), p in zip(same, out, strict=True)) - sum(s * p for _, s, p in same)) < 1e-4


@pytest.mark.parametrize(("sizes", "p"), [([60] + [1] * 60, 0.1), ([60] + [1] * 60, 0.9), ([500, 40, 30, 30, 7, 1], 0.35), ([9, 9, 9, 9], 0.5), ([5], 0.2)])
def test_rounding_keeps_expectations(sizes, p):
    """Over many seeds each document is taken as often as its fraction says, the largest one too."""
    n = 4000
    rows = [(f"d{i}", s, p) for i, s in enumerate(sizes)]
    for step in (mixing.pivot, mixing.settle):
        mean = np.mean([step(rows, seed) for seed in range(n)], axis=0)
        assert np.abs(mean - p).max() < 5 * (p * (1 - p) / n) ** 0.5


def test_equal_rows_and_a_wide_tree(spark):
    """A third of all rows equal and without an id, blocks of a few rows: the words taken stay near the target, reruns agree."""
    rng = random.Random(8)
    rows = [(None, "one two three", "a", "x") for _ in range(150)] + [(i, "w " * rng.randrange(1, 60), "a" if i % 2 else None, "x") for i in range(300)] + [(None, None, "a", "x")] * 40 + [(7, "", None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    got = mixing.mix(docs, weights=(1, 2), total_share=0.7, block=8, fan_in=2).toPandas()
    assert len(got) == len(rows) and (got.taken <= 2 * got["size"]).all() and (got[got["size"] == 0].taken == 0).all()
    for _, mine in got.groupby("source", dropna=False):
        assert abs(mine.taken.sum() - mine.target.iloc[0]) <= 60
    again = mixing.mix(docs.repartition(5), weights=(1, 2), total_share=0.7, block=8, fan_in=2).toPandas()
    order = lambda d: sorted(map(repr, d[["size", "taken", "target"]].itertuples(index=False)))
    assert order(got) == order(again)
    out = mixing.repeat(docs, weights=(1, 2), total_share=0.7, block=8, fan_in=2)
    assert out.columns == docs.columns and out.count() == got.copies.sum()
