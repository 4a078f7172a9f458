"""Documents in blocks of words, and totals over all blocks: the shape in which statistics of a corpus are counted.

A block is one row that holds some MB of whole texts: its distinct words once, the texts as codes in order of frequency, packed. Every block
lists each of its distinct keys (words, n-grams) once, dealt over shards by a hash; a shard adds up the keys of
all blocks and answers each block in the order in which it asked, so answers need no keys. A frequent key costs a row a block
at most, and both the size of a block and the number of keys of a shard are parameters.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from loomgraph.sources.shared import ship

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _bytes(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


#: Which bytes of lower-cased UTF-8 belong to a word: all but white space; digits, letters and everything beyond ASCII.
NOT_SPACE = _bytes((0, 8), (14, 31), (33, 255))
ALPHANUMERIC = _bytes((48, 57), (97, 122), (128, 255))
KIND = "block long, docs array<struct<{}>>, sizes binary, codes binary, words binary"


def pack(values: np.ndarray) -> bytes:
    """Numbers as bytes: their count, then the planes of their bytes, compressed."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize).T
    return len(values).to_bytes(8, "big") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def unpack(data: bytes, kind: type) -> np.ndarray:
    n, width = int.from_bytes(data[:8], "big"), np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data[8:], n * width, "zstd", asbytes=True), np.uint8).reshape(width, n)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def pack_keys(keys: np.ndarray) -> bytes:
    """Ascending unsigned numbers by their differences."""
    return pack(np.diff(keys, prepend=np.zeros(1, np.uint64)))


def unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


def pack_words(words: pa.Array) -> bytes:
    lengths = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int32)
    head = pack(lengths)
    chars = np.frombuffer(words.buffers()[2] or b"", np.uint8)[_offsets(words)[0] : _offsets(words)[-1]]
    return len(head).to_bytes(8, "little") + head + pa.compress(chars.tobytes(), "zstd", asbytes=True)


def unpack_words(data: bytes) -> pa.Array:
    end = 8 + int.from_bytes(data[:8], "little")
    lengths = unpack(data[8:end], np.int32)
    offsets = np.concatenate((np.zeros(1, np.int64), np.cumsum(lengths, dtype=np.int64)))
    chars = pa.decompress(data[end:], int(offsets[-1]), "zstd", asbytes=True)
    return pa.Array.from_buffers(pa.large_string(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(chars)])


def _offsets(words: pa.Array) -> np.ndarray:
    return np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int64)


def split(texts: pa.Array, inside: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(all words of lower-cased texts, how many each text has); a null text has none."""
    whole = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = _offsets(whole)
    data = _LOWER[np.frombuffer(whole.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]]
    offsets = offsets - offsets[0]
    held = inside[data]
    first, last = held.copy(), held.copy()
    first[1:] &= ~held[:-1]
    last[:-1] &= ~held[1:]
    begins = offsets[:-1][offsets[:-1] < len(data)]  # words end with their text
    first[begins] = held[begins]
    ends = offsets[1:][offsets[1:] > 0] - 1
    last[ends] = held[ends]
    starts = np.flatnonzero(first)
    lengths = np.flatnonzero(last) + 1 - starts
    chars, at = data[held], np.concatenate((np.zeros(1, np.int64), np.cumsum(lengths, dtype=np.int64)))
    words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(chars)])
    return words, np.diff(np.searchsorted(starts, offsets))


def coded(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(codes, distinct words), the most frequent word first, equally frequent ones by name."""
    found = words.dictionary_encode()
    codes, distinct = found.indices.to_numpy(zero_copy_only=False), found.dictionary
    by_name = pc.array_sort_indices(distinct).to_numpy(zero_copy_only=False)
    order = by_name[np.argsort(-np.bincount(codes, minlength=len(distinct))[by_name], kind="stable")]
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    return rank[codes], distinct.take(pa.array(order))


def hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word (none is empty): the exclusive or of a mixed number for each byte at its place."""
    offsets = _offsets(words)
    if not len(words):
        return np.zeros(0, np.uint64)
    chars = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    starts = offsets[:-1] - offsets[0]
    place = np.arange(len(chars)) - np.repeat(starts, np.diff(offsets))
    x = ((place.astype(np.uint64) << np.uint64(8)) | chars) + np.uint64(1)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x * np.uint64(0x9E3779B97F4A7C15)) if shift == 30 else x
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return np.bitwise_xor.reduceat(x ^ (x >> np.uint64(31)), starts)


def distinct_keys(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ascending distinct keys, place of each among them), as np.unique gives them.

    Keys are hashes, so they are sorted by their leading bits with their places in the trailing ones, which needs no indirect sort; only where distinct keys
    agree in all leading bits the general way is taken.
    """
    bits = max(1, int(len(keys)).bit_length())
    low = np.uint64((1 << bits) - 1)
    order = (np.sort((keys & ~low) | np.arange(len(keys), dtype=np.uint64)) & low).astype(np.int64)
    ordered = keys[order]
    if len(keys) and (ordered[1:] < ordered[:-1]).any():
        return np.unique(keys, return_inverse=True)
    new = np.ones(len(keys), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    which = np.empty(len(keys), np.int64)
    which[order] = np.cumsum(new) - 1
    return ordered[new], which


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of a sequence from the hash of its beginning and that of its last word."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shards in the order of the keys."""
    return (((keys >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)


def blocks(docs: DataFrame, text: str, inside: np.ndarray, size: int = 8 << 20) -> DataFrame:
    """A row for each block: ``docs``, the other columns of its rows; ``sizes, codes, words``: words of each text, and which.

    A block ends with the text that brings it to ``size`` bytes, so a longer text ends its block alone; texts are never cut. Null and empty texts have
    no words. Blocks hold rows as tasks read them, so store the table before using it twice.
    """
    ship(docs.sparkSession)
    others = [f for f in docs.schema if f.name != text]
    schema = KIND.format(", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in others))
    names = [f.name for f in others]
    row = pa.struct(list(to_arrow_schema(docs.select(names).schema)))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, pending = TaskContext.get().partitionId(), 0, 0, []

        def close() -> pa.RecordBatch:
            nonlocal number, held
            whole = pa.Table.from_batches(pending).combine_chunks()
            words, sizes = split(whole.column(text).combine_chunks(), inside)
            codes, distinct = coded(words)
            columns = pa.StructArray.from_arrays([whole.column(n).combine_chunks().cast(row.field(n).type) for n in names], fields=list(row))
            out = [pa.array([(part << 32) + number], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(whole)], pa.int32()), columns)]
            out += [pa.array([x], pa.binary()) for x in (pack(sizes.astype(np.int32)), pack(codes), pack_words(distinct))]
            number, held = number + 1, 0
            pending.clear()
            return pa.RecordBatch.from_arrays(out, names=["block", "docs", "sizes", "codes", "words"])

        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            begin = 0
            while begin < len(batch):
                total = held + np.cumsum(lengths[begin:])
                end = begin + int(np.searchsorted(total, size)) + 1
                pending.append(batch.slice(begin, end - begin))
                held = int(total[-1])
                if end <= len(batch):
                    yield close()
                begin = end
        if pending:
            yield close()

    return docs.mapInArrow(make, schema)


class Words:
    """The arrays of a block: codes of all words, where each document's begin, and the distinct words."""

    def __init__(self, row: dict):
        self.docs: list[dict] = row["docs"]
        self.sizes = unpack(row["sizes"], np.int32).astype(np.int64)
        self.codes = unpack(row["codes"], np.int32)
        self.distinct = unpack_words(row["words"])
        self.ends = np.cumsum(self.sizes)


ASKED = "kind int, shard long, block long, keys binary, counts binary"


def asked(kind: int, block: int, shards: np.ndarray, keys: Callable[[int, int], bytes], counts: np.ndarray) -> Iterator[dict]:
    """A row for each shard that some of a block's keys belong to; shards: of each key, ascending."""
    marks = np.flatnonzero(np.diff(shards, prepend=-1, append=-1)) if len(shards) else []
    for a, b in itertools.pairwise(marks):
        yield {"kind": kind, "shard": int(shards[a]), "block": block, "keys": keys(int(a), int(b)), "counts": pack(counts[a:b].astype(np.int64))}


def asked_numbers(kind: int, block: int, keys: np.ndarray, counts: np.ndarray, shards: int) -> Iterator[dict]:
    """The same for distinct ascending numbers."""
    return asked(kind, block, shard_of(keys, shards), lambda a, b: pack_keys(keys[a:b]), counts)


def total_numbers(table: pa.Table) -> list[tuple[int, np.ndarray]]:
    """(block, totals in the order asked) of a shard's rows."""
    lists = [unpack_keys(x) for x in table.column("keys").to_pylist()]
    counts = [unpack(x, np.int64) for x in table.column("counts").to_pylist()]
    found, inverse = distinct_keys(np.concatenate(lists))
    totals = np.zeros(len(found), np.int64)
    np.add.at(totals, inverse, np.concatenate(counts))
    ends = np.cumsum([len(x) for x in lists])
    return list(zip(table.column("block").to_pylist(), np.split(totals[inverse], ends[:-1]), strict=True))


def total_words(table: pa.Table) -> tuple[pa.Array, np.ndarray, list[tuple[int, np.ndarray]]]:
    """(distinct words of a shard, their totals, (block, places of its words among them) in the order asked)."""
    lists = [unpack_words(x) for x in table.column("keys").to_pylist()]
    found = pa.concat_arrays(lists).dictionary_encode()
    inverse = found.indices.to_numpy(zero_copy_only=False)
    totals = np.zeros(len(found.dictionary), np.int64)
    np.add.at(totals, inverse, np.concatenate([unpack(x, np.int64) for x in table.column("counts").to_pylist()]))
    ends = np.cumsum([len(x) for x in lists])
    return found.dictionary, totals, list(zip(table.column("block").to_pylist(), np.split(inverse, ends[:-1]), strict=True))


def answers(table: pa.Table, kinds: dict[int, type]) -> dict[int, np.ndarray]:
    """By kind, what the shards answered a block, in the order asked; columns ``kind, shard, data``."""
    out: dict[int, list[np.ndarray]] = {k: [] for k in kinds}
    for r in sorted(table.select(["kind", "shard", "data"]).to_pylist(), key=lambda r: (r["kind"], r["shard"])):
        out[r["kind"]].append(unpack(r["data"], kinds[r["kind"]]))
    return {k: np.concatenate(v) if v else np.zeros(0, kinds[k]) for k, v in out.items()}


def shards_for(table: DataFrame, keys: int, per_shard: int) -> int:
    """So many shards that each has ``per_shard`` keys at most on average, and every task of a shuffle one."""
    return max(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-keys // per_shard))


def words_in(table: DataFrame) -> int:
    """Words of all blocks; the count stands in the first bytes of their codes."""
    counted = F.conv(F.hex(F.substring("codes", 1, 8)), 16, 10).cast("long")
    return table.agg(F.sum(counted)).first()[0] or 0
