"""A probabilistic suffix tree over words, learned from a whole corpus, for scoring texts.

States are contexts of the last 0, 1 or 2 words of a document. A state's next-symbol distribution is its counts, smoothed with ``mass`` occurrences of that of the
context one word shorter; the empty context has add-0.1 counts. A context is retained by a divergence test: the sum over its
occurrences of log10 p(next | context) / p(next | shorter context), each occurrence left out of its own context's counts, must reach ``least_gain``. So a context seen once is
never retained, and chance doesn't add states. A word is scored by the longest retained context that is a suffix of what stands before it.

The corpus is counted in blocks (:mod:`loomgraph.llm.blocks`) in three rounds: words and pairs; triples and the divergence sums of single words; divergence sums
of pairs. In each round a block asks for the totals of its own distinct contexts and continuations and gets them in the order in which it
asked, so every text is scored where its words are, and nothing of the model is sent to the driver or to all tasks but two numbers.
Divergences are sums of whole numbers (units of 0.0001), so reruns agree whatever the partitioning. Words are told apart by their
strings, contexts of two or three words by 64 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.blocks import ASKED, NOT_SPACE, Words, answers, asked, asked_numbers, blocks, distinct_keys, hashes, mix, pack, pack_words, shard_of, shards_for, total_numbers, total_words, words_in
from loomgraph.sources.shared import cut

WORDS, PAIRS, TRIPLES, GAIN_1, GAIN_2 = range(1, 6)
#: What answers hold: totals, and whether a context is retained.
KINDS = dict.fromkeys((WORDS, PAIRS, TRIPLES), np.int64) | dict.fromkeys((GAIN_1, GAIN_2), np.uint8)
#: Stands for the end of a text.
END = np.uint64(0xA5A3564E27F8865B)
UNIT = 10_000


def held_out(doc_id: Column, part: int = 10) -> Column:
    """Whether crc32 of the id as text is 0 modulo ``part``; a null id reads as empty."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(part)) == 0


class Tokens:
    """The tokens of a block in order, each text's end included: ``code``, where texts ``begin``, and whether each is ``learned`` from."""

    def __init__(self, row: dict):
        self.words = words = Words(row)
        n = len(words.distinct)
        self.code = np.insert(words.codes, words.ends, n)
        lengths = words.sizes + 1
        self.begins = np.cumsum(lengths) - lengths
        self.learned = np.repeat(np.array([not x["held"] for x in words.docs], bool), lengths)
        self.hash = np.append(hashes(words.distinct), END)
        first = np.zeros(len(self.code) + 1, bool)
        first[self.begins] = True
        self.second = np.flatnonzero(~first[:-1])  # tokens with a word before them
        self.after_first = first[self.second - 1]  # those with one word only
        self.before, self.now, self.learned_2 = self.code[self.second - 1], self.code[self.second], self.learned[self.second]
        self.pair_key = mix(self.hash[self.before], self.hash[self.now])
        self.pairs, self.pair = distinct_keys(self.pair_key)

    def by_shard(self, shards: int) -> tuple[np.ndarray, np.ndarray]:
        """(shards, words) in the order in which words are asked for."""
        shard = shard_of(self.hash[:-1], shards)
        order = np.argsort(shard, kind="stable")
        return shard[order], order

    def know(self, told: dict[int, np.ndarray], shards: int, model: Model) -> None:
        """Counts and probabilities from the answers of the first round."""
        _, order = self.by_shard(shards)
        self.seen = np.zeros(len(order) + 1, np.int64)
        self.seen[order] = told[WORDS]
        self.seen[-1] = model.texts
        self.share = (self.seen + 0.1) / (model.tokens + 0.1 * (model.distinct + 1))
        total = told[PAIRS]
        self.context_1, self.count_1, self.p_0 = self.seen[self.before], total[self.pair], self.share[self.now]
        self.p_1 = (self.count_1 + model.mass * self.p_0) / (self.context_1 + model.mass)
        # tokens with two words before them whose context was seen twice, as places in ``second``: no other can be retained
        context = np.where(self.after_first, 0, np.concatenate((np.zeros(1, np.int64), self.count_1[:-1]))) if len(self.pair) else self.pair
        self.third = np.flatnonzero(context >= 2)
        self.context_2 = context[self.third]
        self.triples, self.triple = distinct_keys(mix(self.pair_key[self.third - 1], self.hash[self.now[self.third]]))
        # contexts of one word in the order of their hashes, those of two words in that of their pairs
        self.heads = np.argsort(self.hash[:-1])
        used = np.zeros(len(self.pairs), bool)
        used[self.pair[self.third - 1]] = True
        self.couples = self.pairs[used]
        self.couple = (np.cumsum(used) - 1)[self.pair[self.third - 1]]

    def gains(self, count: np.ndarray, context: np.ndarray, shorter: np.ndarray, learned: np.ndarray, mass: float) -> np.ndarray:
        """Of each occurrence, left out of its own counts, in units; 0 where it isn't learned from."""
        out = np.zeros(len(count), np.int64)
        c, n, p = count[learned] - 1, context[learned] - 1, shorter[learned]
        out[learned] = np.rint(UNIT * np.log10((c + mass * p) / ((n + mass) * p))).astype(np.int64)
        return out

    def know_triples(self, told: dict[int, np.ndarray], mass: float) -> None:
        self.count_2 = told[TRIPLES][self.triple]
        self.p_2 = (self.count_2 + mass * self.p_1[self.third]) / (self.context_2 + mass)


class Model:
    """What holds for all blocks: tokens, texts and distinct tokens learned from, and the smoothing mass."""

    def __init__(self, tokens: int, texts: int, distinct: int, mass: float):
        self.tokens, self.texts, self.distinct, self.mass = tokens, texts, distinct, mass


def _sums(places: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    np.add.at(out, places, values)
    return out


def _first(block: int, t: Tokens, told: dict, shards: int) -> Iterator[dict]:
    shard, order = t.by_shard(shards)
    count, words = np.bincount(t.code[t.learned], minlength=len(t.hash)), t.words.distinct.take(pa.array(order))
    yield from asked(WORDS, block, shard, lambda a, b: pack_words(words[a:b]), count[order])
    yield from asked_numbers(PAIRS, block, t.pairs, np.bincount(t.pair[t.learned_2], minlength=len(t.pairs)), shards)


def _second(model: Model) -> Callable:
    def ask(block: int, t: Tokens, told: dict, shards: int) -> Iterator[dict]:
        t.know(told, shards, model)
        yield from asked_numbers(TRIPLES, block, t.triples, np.bincount(t.triple[t.learned_2[t.third]], minlength=len(t.triples)), shards)
        gain = _sums(t.before, t.gains(t.count_1, t.context_1, t.p_0, t.learned_2, model.mass), len(t.heads))
        yield from asked_numbers(GAIN_1, block, t.hash[t.heads], gain[t.heads], shards)

    return ask


def _third(model: Model) -> Callable:
    def ask(block: int, t: Tokens, told: dict, shards: int) -> Iterator[dict]:
        t.know(told, shards, model)
        t.know_triples(told, model.mass)
        gain = _sums(t.couple, t.gains(t.count_2, t.context_2, t.p_1[t.third], t.learned_2[t.third], model.mass), len(t.couples))
        yield from asked_numbers(GAIN_2, block, t.couples, gain, shards)

    return ask


_ASKED = pa.schema([("kind", pa.int32()), ("shard", pa.int64()), ("block", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
_TOLD = "block long, kind int, shard long, data binary, tokens long, distinct long"


def _round(table: DataFrame, told: DataFrame | None, ask: Callable, shards: int, least: float = 0.0) -> DataFrame:
    """Ask all blocks, add up by shard, answer: ``block, kind, shard, data``; for words also a row with their number and how many are distinct."""

    def of(rows: list[dict], answers_: dict[int, np.ndarray]) -> pa.Table:
        return pa.Table.from_pylist([x for r in rows for x in ask(r["block"], Tokens(r), answers_, shards)], _ASKED)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from of([row], {}).to_batches()

    def later(block: pa.Table, known: pa.Table) -> pa.Table:
        return of(block.to_pylist(), answers(known, KINDS))

    def add_up(rows: pa.Table) -> pa.Table:
        kind, shard = rows.column("kind")[0].as_py(), rows.column("shard")[0].as_py()
        out = []
        if kind == WORDS:
            _, totals, places = total_words(rows)
            found = [(block, totals[p]) for block, p in places]
            out.append({"kind": kind, "shard": shard, "tokens": int(totals.sum()), "distinct": int(np.count_nonzero(totals))})
        else:
            found = total_numbers(rows)
        if kind in (GAIN_1, GAIN_2):
            found = [(block, (x >= least * UNIT).astype(np.uint8)) for block, x in found]
        out += [{"block": block, "kind": kind, "shard": shard, "data": pack(x)} for block, x in found]
        return pa.Table.from_pylist(out, pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("shard", pa.int64()), ("data", pa.binary()), ("tokens", pa.int64()), ("distinct", pa.int64())]))

    rows = table.mapInArrow(first, ASKED) if told is None else table.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(later, ASKED)
    return cut(rows.groupBy("kind", "shard").applyInArrow(add_up, _TOLD), "told")


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held: Column | None = None, mass: float = 8.0, least_gain: float = 2.0, size: int = 8 << 20, per_shard: int = 1 << 20) -> DataFrame:
    """``id_col, held_out, n_tokens, n_known, n_contexts, train_tokens, base_score, score`` of every row, learning from rows that aren't held out.

    Tokens are runs without ASCII white space (A-Z lower-cased) and one end a text; base_score sums log10 of add-0.1 shares of single tokens, score log10 by the tree; n_known counts
    tokens that were learned, n_contexts those scored by a retained context of a word or more. Null and empty texts are one end. Null ids read as empty, repeated ids and equal rows are rows like others; of an
    empty table, or one that is held out whole, nothing is learned and any token has probability 1. Texts of any length are scored whole, one above ``size`` bytes being a block of its
    own. Other columns are ignored. held: a condition on the columns of ``docs``.
    """
    out = held_out(F.col(id_col)) if held is None else held
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(out, F.lit(False)).alias("held"))
    kind = named.schema["id"].dataType.simpleString()
    table = cut(blocks(named, "text", NOT_SPACE, size), "blocks")
    texts = table.select(F.explode("docs").alias("d")).agg(F.count_if(~F.col("d.held"))).first()[0]
    shards = shards_for(table, words_in(table), per_shard)
    counted = _round(table, None, _first, shards)
    words, distinct = counted.agg(F.sum("tokens"), F.sum("distinct")).first()
    model = Model((words or 0) + texts, texts, (distinct or 0) + (texts > 0), mass)
    known = counted.where("block is not null").select("block", "kind", "shard", "data")
    told = [known]
    for ask in (_second(model), _third(model)):
        told.append(_round(table, known, ask, shards, least_gain).select("block", "kind", "shard", "data"))
        known = known.unionByName(told[-1])

    def judge(block: pa.Table, answered: pa.Table) -> pa.Table:
        cols: dict[str, list] = {"id": [], "held_out": [], "n_tokens": [], "n_known": [], "n_contexts": [], "base_score": [], "score": []}
        for row in block.to_pylist():
            t, all_told = Tokens(row), answers(answered, KINDS)
            t.know(all_told, shards, model)
            t.know_triples(all_told, mass)
            base = np.log10(t.share)[t.code]
            best, long = base.copy(), np.zeros(len(base), np.int64)
            retained = np.zeros(len(t.heads), bool)
            retained[t.heads] = all_told[GAIN_1]
            kept = retained[t.before]
            best[t.second[kept]], long[t.second[kept]] = np.log10(t.p_1[kept]), 1
            kept = all_told[GAIN_2][t.couple].astype(bool)
            at = t.second[t.third[kept]]
            best[at], long[at] = np.log10(t.p_2[kept]), 1
            by_text = lambda x, t=t: np.add.reduceat(x, t.begins) if len(t.begins) else x
            cols["id"] += [d["id"] for d in t.words.docs]
            cols["held_out"] += [d["held"] for d in t.words.docs]
            for name, x in (("n_tokens", np.ones(len(base), np.int64)), ("n_known", (t.seen[t.code] > 0).astype(np.int64)), ("n_contexts", long), ("base_score", base), ("score", best)):
                cols[name] += by_text(x).tolist()
        id_type = block.schema.field("docs").type.value_type.field("id").type
        kinds = {"id": id_type, "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "n_contexts": pa.int64(), "base_score": pa.float64(), "score": pa.float64()}
        return pa.table({k: pa.array(v, kinds[k]) for k, v in cols.items()})

    scored = table.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(judge, f"id {kind}, held_out boolean, n_tokens long, n_known long, n_contexts long, base_score double, score double")
    return scored.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", "n_contexts", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
