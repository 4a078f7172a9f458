"""Token counts with overlap resynchronisation for huge documents.

A document of over ``chunk`` characters is encoded as overlapping chunks with character offsets. Neighbouring
chunks are spliced at a common stable boundary: a place where both start a token and which follows white
space or, if the file's pre-tokenizer takes each digit alone, stands beside an ASCII digit. No token or rule reaches over such a place, so what
stands left of it doesn't depend on what follows and the other way round. Where the overlap
has none, the chunk is widened to twice its size each time, up to the whole rest of the document, so that
the work stays in proportion to the text.

Smaller documents are cut at all their stable boundaries at once; each distinct piece is encoded once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.bpe import NOT_SPACE, SEPARATORS, slices
from loomgraph.sources.shared import ship

DIGITS = frozenset("0123456789")
WHITE = frozenset(chr(c) for c in [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])


class TokenCounter:
    """Counts a ``tokenizers`` file's tokens; chunk and overlap are in characters, cache in pieces."""

    def __init__(self, path: str, chunk: int = 32_768, overlap: int = 512, cache: int = 1_000_000):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.chunk, self.overlap, self.limit = chunk, min(overlap, chunk // 2), cache
        self.known: dict[str, int] = {}
        self.widened = 0
        cutter = self.library.pre_tokenizer
        self.digits_alone = [x for x, _ in cutter.pre_tokenize_str("a1b23!4'5s")] == [*"a1b23!4'5s"] if cutter else False

    def _starts(self, text: str, begin: int, end: int) -> list[int]:
        """Where tokens of text[begin:end] start, in the whole text's offsets."""
        return [begin + a for a, _ in self.library.encode(text[begin:end], add_special_tokens=False).offsets]

    def _stable(self, text: str, p: int) -> bool:
        if text[p - 1] in WHITE:
            return text[p] not in WHITE
        return self.digits_alone and (text[p] in DIGITS or text[p - 1] in DIGITS) and text[p] not in WHITE

    def _common(self, text: str, left: list[int], right: list[int], begin: int, end: int) -> int | None:
        """The first stable boundary in [begin, end) that both encodings have."""
        seen = {p for p in left if begin < p < end and self._stable(text, p)}
        return min((p for p in right if p in seen), default=None)

    def count_long(self, text: str) -> int:
        """Tokens of a text of any length, spliced from overlapping chunks."""
        n, step = len(text), self.chunk - self.overlap
        total, begin, first = 0, 0, 0
        last = min(self.chunk, n)
        own = self._starts(text, first, last)
        while last < n:
            a = last - self.overlap
            end = min(a + self.chunk, n)
            other = self._starts(text, a, end)
            cut = self._common(text, own, other, a, last)
            while cut is None and last < n:
                # what is known so far is widened; the next chunk starts before its new end, where a boundary may be
                last = min(n, last + max(last - first, step))
                own = self._starts(text, first, last)
                self.widened += 1
                a = max(a, last - self.chunk)
                end = min(a + self.chunk + self.overlap, n)
                if last < n:
                    other = self._starts(text, a, end)
                    cut = self._common(text, own, other, a, last)
            if cut is None:
                break  # the chunk at hand reaches to the end of the text
            total += sum(begin <= p < cut for p in own)
            begin, first, last, own = cut, a, end, other
        return total + sum(p >= begin for p in own)

    def counts(self, texts: list[str]) -> list[int]:
        split = [None if len(t) > self.chunk else t.split() if not SEPARATORS.search(t) else NOT_SPACE.findall(t) for t in texts]
        pieces = set().union(*(p for p in split if p is not None))
        if len(self.known) + len(pieces) > self.limit:
            self.known.clear()
        new = list(pieces.difference(self.known))
        found = self.library.encode_batch_fast(new, add_special_tokens=False)
        self.known.update(zip(new, [len(e) for e in found], strict=True))
        return [self.count_long(t) if p is None else sum(map(self.known.__getitem__, p)) for t, p in zip(texts, split, strict=True)]


@lru_cache(maxsize=2)
def counter(path: str, chunk: int, overlap: int) -> TokenCounter:
    """One counter for each Python worker and setting."""
    return TokenCounter(path, chunk, overlap)


def count_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = 2048, chunk: int = 32_768, overlap: int = 512) -> DataFrame:
    """``id_col, n_bytes, n_tokens, over_limit`` for each row, whole texts.

    Null and empty texts have 0 bytes and 0 tokens. Ids may be null or repeat; rows stay as they are; other
    columns are ignored, whatever their names; an empty table gives no rows. Very long texts are counted whole, in time and memory that grow with
    their length, also without white space. tokenizer: a ``.json`` file of the tokenizers library whose words end at white space.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(tokenizer, chunk, overlap)
        for batch in batches:
            at = 0
            for texts in slices(batch.column(1)):
                n = tokens.counts(texts)
                size = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > max_tokens for x in n])], [id_col, "n_bytes", "n_tokens", "over_limit"])
                at += len(texts)

    picked = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    return picked.mapInArrow(run, f"`{id_col}` {picked.schema[0].dataType.simpleString()}, n_bytes bigint, n_tokens bigint, over_limit boolean")
