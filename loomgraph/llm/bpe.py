"""BPE encoding by speculation: greedy longest match proposes, vectorised pair checks verify.

A sequence of tokens is what merging by rank yields exactly when every adjacent pair is: the first merge
across a boundary of a sequence would happen in the pair alone too, as each side evolves by itself until
then. So a word's greedy proposal is right if all its adjacent pairs are compatible; words with
a pair that isn't undergo exact merging. Compatibility of all pairs of a batch is decided at once by undoing
both tokens' merges, latest first, and looking for a rule across the boundary that comes earlier.

Normalisation and pre-tokenisation of text outside printable ASCII are the library's own components.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.sources.shared import ship

#: The word pattern of a vocabulary file, what it comes to for printable ASCII in lower case, and what counts as white space in it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")
SPACE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
NOT_SPACE = re.compile(f"[^{SPACE}]+")
SEPARATORS = re.compile("[\x1c-\x1f]")
NEVER = np.int64(2**40)
NO_RULE = (2**40, -1)


class WordBPE:
    """Encoder and decoder for a ``tokenizers`` BPE file whose words end in a suffix and never hold white space.

    cache: entries kept of words' and of chunks' results; a full cache is emptied, so memory is bounded (some 250 MB, which a worker keeps between tasks).
    """

    def __init__(self, path: str, cache: int = 400_000):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = [""] * (max([*self.ids.values(), *self.special.values()]) + 1)
        for text, number in [*self.ids.items(), *self.special.items()]:
            self.names[number] = text
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        library = Tokenizer.from_file(path)
        # the short cut for ASCII holds for one pattern only; other files go through the library's components
        split = (spec["pre_tokenizer"].get("pretokenizers") or [{}])[0]
        self.ascii_words = split.get("pattern", {}).get("Regex") == PATTERN and any(n["type"] == "Lowercase" for n in (spec["normalizer"] or {}).get("normalizers", []))
        self.normalize, self.pre_tokenize = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.rules = {(self.ids[a], self.ids[b]): (rank, self.ids[a + b]) for rank, (a, b) in enumerate(pairs)}
        self._tables()
        self.limit, self.words, self.chunks = cache, {}, {}
        self.speculated = self.merged = 0

    def _tables(self) -> None:
        size = len(self.names)
        left, right, made = (np.full(size, x, np.int64) for x in (-1, -1, -1))
        self.middle: dict[str, int] = {}
        self.end: dict[str, int] = {}
        self.longest: dict[str, int] = {}
        for text, number in self.ids.items():
            closed = bool(self.suffix) and text.endswith(self.suffix) and text != self.suffix
            body = text[: -len(self.suffix)] if closed else text
            tokens, last = self._merge(self._symbols(body, closed))
            if tokens != [number]:
                continue  # no text is encoded to it
            if last:
                left[number], right[number], made[number] = last[1], last[2], last[0]
            if closed:
                self.end[body] = number
            else:
                self.middle[body] = number
                for head in {body[:1], body[:2]}:
                    self.longest[head] = max(self.longest.get(head, 0), len(body))
        self.left, self.right, self.made = left, right, made
        self.longest_end = max(map(len, self.end), default=0)
        keys = np.array([a * size + b for a, b in self.rules], np.int64)
        order = np.argsort(keys)
        #: whether a rule always comes after those that make its parts, so that rank order is time order; else all is merged exactly
        self.ordered = all(made[a] < rank and made[b] < rank for (a, b), (rank, _) in self.rules.items())
        self.rule_keys, self.rule_ranks = keys[order], np.array([r for r, _ in self.rules.values()], np.int64)[order]

    def _symbols(self, word: str, closed: bool = True) -> list[int]:
        found = map(self.ids.get, [*word[:-1], word[-1] + self.suffix if closed else word[-1]])
        return [x for x in found if x is not None]

    def _merge(self, symbols: list[int]) -> tuple[list[int], tuple[int, int, int] | None]:
        """Merging by rank, leftmost first; the tokens and the last merge as (rank, left, right)."""
        if len(symbols) > 48:
            return self._merge_long(symbols)
        look, last = self.rules.get, None
        tokens = list(symbols)
        found = [look(pair, NO_RULE) for pair in zip(tokens, tokens[1:])]
        while found:
            rule = min(found)
            if rule is NO_RULE:
                break
            i = found.index(rule)
            last = (rule[0], tokens[i], tokens[i + 1])
            tokens[i : i + 2] = (rule[1],)
            del found[i]
            if i:
                found[i - 1] = look((tokens[i - 1], rule[1]), NO_RULE)
            if i < len(found):
                found[i] = look((rule[1], tokens[i + 1]), NO_RULE)
        return tokens, last

    def _merge_long(self, symbols: list[int]) -> tuple[list[int], tuple[int, int, int] | None]:
        """The same with a heap, for words of any length."""
        n, last = len(symbols), None
        after, before, alive = [*range(1, n), -1], list(range(-1, n - 1)), list(symbols)
        heap = [(rule[0], i, rule[1], symbols[i], symbols[i + 1]) for i in range(n - 1) if (rule := self.rules.get((symbols[i], symbols[i + 1])))]
        heapq.heapify(heap)
        while heap:
            rank, i, made, a, b = heapq.heappop(heap)
            j = after[i]
            if alive[i] != a or j < 0 or alive[j] != b:
                continue
            last = (rank, a, b)
            alive[i], alive[j], after[i] = made, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (rule := self.rules.get((alive[x], alive[y]))):
                    heapq.heappush(heap, (rule[0], x, rule[1], alive[x], alive[y]))
        return [t for t in alive if t >= 0], last

    def propose(self, word: str) -> list[int] | None:
        """Greedy longest match; None where no token fits."""
        out, at, n = [], 0, len(word)
        end, middle, longest, longest_end = self.end, self.middle, self.longest, self.longest_end
        while True:
            if n - at <= longest_end and (token := end.get(word[at:] if at else word)) is not None:
                out.append(token)
                return out
            for size in range(min(longest.get(word[at : at + 2]) or longest.get(word[at : at + 1], 0), n - at - 1), 0, -1):
                if (token := middle.get(word[at : at + size])) is not None:
                    break
            else:
                return None
            out.append(token)
            at += size

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For token pairs (a, b): does encoding their joined text give just the two?

        Backwards in time: (a, b) are neighbours until the merge undone last, of rank ``until``. A rule
        for them of lower rank would have come first; of equal rank, leftmost first, only where the
        undone merge was on the right.
        """
        good, size = np.ones(len(a), bool), len(self.names)
        at, a, b = np.arange(len(a)), a.astype(np.int64), b.astype(np.int64)
        until, on_right = np.full(len(a), NEVER), np.zeros(len(a), bool)
        if not self.ordered:
            return np.zeros(len(a), bool)
        while len(at):
            keys = a * size + b
            spot = np.minimum(np.searchsorted(self.rule_keys, keys), len(self.rule_keys) - 1)
            rank = np.where(self.rule_keys[spot] == keys, self.rule_ranks[spot], NEVER)
            crossed = (rank < until) | ((rank == until) & on_right & (rank < NEVER))
            good[at[crossed]] = False
            made_a, made_b = self.made[a], self.made[b]
            go = ~crossed & (np.maximum(made_a, made_b) >= 0)
            undo_a = made_a > made_b
            a, b = np.where(undo_a, self.right[a], a)[go], np.where(undo_a, b, self.left[b])[go]
            until, on_right, at = np.maximum(made_a, made_b)[go], ~undo_a[go], at[go]
        return good

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Tokens of words in the vocabulary's alphabet: propose all, check all pairs at once, merge what fails."""
        out = [self.propose(w) for w in words]
        counts = np.array([len(t) if t else 0 for t in out], np.int64)
        flat = np.array([t for tokens in out if tokens for t in tokens], np.int64)
        wrong = {i for i, t in enumerate(out) if t is None}
        if len(flat) > 1:
            owner = np.repeat(np.arange(len(out)), counts)
            inner = np.flatnonzero(owner[1:] == owner[:-1])
            pairs, back = np.unique(flat[inner] * len(self.names) + flat[inner + 1], return_inverse=True)
            fine = self.compatible(pairs // len(self.names), pairs % len(self.names))[back]
            wrong.update(owner[inner[~fine]].tolist())
        for i in wrong:
            out[i] = self._merge(self._symbols(words[i]))[0]
        self.speculated += len(words)
        self.merged += len(wrong)
        return out

    def _pieces(self, chunk: str) -> list[str | int]:
        """A chunk without white space as words in the vocabulary's alphabet, or ids of special strings."""
        if self.ascii_words and chunk.isascii() and chunk.isprintable() and "<|" not in chunk:
            return ASCII_WORDS.findall(chunk.lower())
        out: list[str | int] = []
        for part in self.split_special.split(chunk) if self.split_special else [chunk]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                out += [w for w, _ in self.pre_tokenize(self.normalize(part)) if w]
        return out

    def learn(self, chunks: set[str]) -> None:
        """Put what the chunks give into the cache: (tokens, their ids as text, their names as text)."""
        if len(self.chunks) + len(chunks) > self.limit:
            self.chunks.clear()
        if len(self.words) > self.limit:
            self.words.clear()
        gc.disable()  # nothing here is cyclic, and collections would walk the whole cache again and again
        pieces = {c: self._pieces(c) for c in chunks}
        new = list({w for parts in pieces.values() for w in parts if isinstance(w, str) and w not in self.words})
        self.words.update(zip(new, self.encode_words(new), strict=True))
        for chunk, parts in pieces.items():
            tokens = [t for w in parts for t in ((w,) if isinstance(w, int) else self.words[w])]
            self.chunks[chunk] = len(tokens), " ".join(map(str, tokens)), " ".join([self.names[t] for t in tokens])
        gc.enable()

    def rows(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """(number of tokens, ids as text, decoded text) of each text."""
        split = [t.split() if not SEPARATORS.search(t) else NOT_SPACE.findall(t) for t in texts]
        unknown = set().union(*split).difference(self.chunks)
        if len(unknown) + len(self.chunks) > self.limit:
            unknown = set().union(*split)
        self.learn(unknown)
        for chunks in split:
            found = list(map(self.chunks.__getitem__, chunks))
            yield sum([x[0] for x in found]), " ".join([x[1] for x in found]), " ".join([x[2] for x in found])

    def encode(self, text: str) -> list[int]:
        return [int(x) for x in next(self.rows([text]))[1].split()]

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.names[i] for i in ids)


@lru_cache(maxsize=2)
def encoder(path: str) -> WordBPE:
    """One encoder for each Python worker and file."""
    return WordBPE(path)


def slices(column: pa.Array, chars: int = 1_000_000) -> Iterator[list[str]]:
    """The texts (null: empty) in runs of about so many characters, so that a batch of long texts stays small in Python."""
    out, size = [], 0
    for value in column:
        out.append(value.as_py() or "")
        size += len(out[-1])
        if size >= chars:
            yield out
            out, size = [], 0
    if out:
        yield out


def encode_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """``id_col, n_tokens, ids_sha256, decoded_sha256`` for each row, whole texts; ``ids`` (array) with keep_ids.

    Null and empty texts have no tokens (digests of the empty string). Ids may be null or repeat;
    rows stay as they are; other columns are ignored, whatever their names; an empty table gives no rows. Very long texts and words are
    taken whole, in time that grows with their length (a word that fails verification: with its logarithm too). Ids become a
    list only where asked for.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(tokenizer)
        for batch in batches:
            at = 0
            for texts in slices(batch.column(1)):
                rows = list(bpe.rows(texts))
                digest = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
                columns = [batch.column(0).slice(at, len(texts)), pa.array([r[0] for r in rows], pa.int64()), pa.array([digest(r[1]) for r in rows]), pa.array([digest(r[2]) for r in rows])]
                if keep_ids:
                    columns.append(pa.array([np.array(r[1].split(), np.int32) for r in rows], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, [id_col, "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(columns)])
                at += len(texts)

    picked = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    kind = picked.schema[0].dataType.simpleString()
    return picked.mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids)
