"""Language identification by n-gram filters that hold a bitmask of languages in each slot.

Training keeps, for each language, the character n-grams that are frequent in it and not much more so in another.
All languages' filters share hash positions and are stored bit-sliced: a slot is a word whose bit l belongs to
language l, so the AND of an n-gram's slots gives every language whose filter contains it. A
text's hits of a language are the popcount of its bit over all n-grams of the text, corrected for the
filter's false-positive rate; the language with the largest corrected share wins.

Training reads a bounded number of labelled documents (``per_language``, whole texts, chosen by a hash
of the id); prediction reads every text whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.llm.names import unused
from loomgraph.sources.shared import ship

UNDETERMINED = "und"
#: Odd multipliers that give the positions of an n-gram in the filters.
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For every code point, whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(text: str, n: int = 3) -> np.ndarray:
    """Codes of the character n-grams of the lower-cased text; each run of other characters is one space."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    if not letter.any():
        return np.empty(0, np.uint64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[0] |= letter[1]
    points = np.where(letter, points, 32)[keep].astype(np.uint64)
    if points[0] != 32:
        points = np.concatenate((np.array([32], np.uint64), points))
    codes = points[: len(points) - n + 1].copy() if len(points) >= n else points[:1].copy()
    for k in range(1, min(n, len(points))):
        codes = codes * np.uint64(0x200003) + points[k : k + len(codes)]
    return codes


@dataclass
class LanguageFilters:
    """languages in code-point order; slots: (words, 2**bits) masks; false_rate: each language's."""

    languages: list[str]
    slots: np.ndarray
    false_rate: np.ndarray
    n: int

    def masks(self, codes: np.ndarray) -> np.ndarray:
        """(words, len(codes)): bits of the languages that contain each n-gram, false positives included."""
        shift = np.uint64(65 - self.slots.shape[1].bit_length())
        out = self.slots[:, (codes * MIX[0]) >> shift]
        for m in MIX[1:]:
            out &= self.slots[:, (codes * m) >> shift]
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, share of the corrected hits); ``und`` and 0 without a letter or without languages."""
        codes = grams(text or "", self.n)
        if not len(codes) or not self.languages:
            return UNDETERMINED, 0.0
        masks = self.masks(codes)
        hits = np.array([np.count_nonzero(masks[k // 64] & np.uint64(1 << (k % 64))) for k in range(len(self.languages))])
        share = np.clip((hits / len(codes) - self.false_rate) / (1 - self.false_rate), 0, 1)
        best = int(np.argmax(share))  # ties: the first in code-point order
        return self.languages[best], float(share[best] / share.sum()) if share.sum() else 0.0


def build_filters(counts: dict[str, dict[int, int]], n: int = 3, bits: int = 18, rival: float = 0.5) -> LanguageFilters:
    """Filters from n-gram counts; an n-gram enters a language's when its rate there is at least ``rival`` times its best."""
    languages = sorted(counts)
    slots = np.zeros((max(1, -(-len(languages) // 64)), 1 << bits), np.uint64)
    rates = {lang: {g: c / max(1, sum(of.values())) for g, c in of.items()} for lang, of in counts.items()}
    best: dict[int, float] = {}
    for of in rates.values():
        for g, r in of.items():
            best[g] = max(best.get(g, 0), r)
    for k, lang in enumerate(languages):
        codes = np.array([g for g, r in rates[lang].items() if r >= rival * best[g]], np.uint64)
        for m in MIX:
            slots[k // 64, (codes * m) >> np.uint64(64 - bits)] |= np.uint64(1 << (k % 64))
    filled = np.array([np.count_nonzero(slots[k // 64] & np.uint64(1 << (k % 64))) / (1 << bits) for k in range(len(languages))])
    return LanguageFilters(languages, slots, np.minimum(filled ** len(MIX), 0.99), n)


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 3_000, per_filter: int = 20_000, least: int = 3, n: int = 3) -> LanguageFilters:
    """Filters from the rows with a language and a text; about ``per_language`` documents of each.

    per_filter: most frequent n-grams kept for a language; least: documents' occurrences that an n-gram needs.
    Empty input gives filters without languages.
    """
    ship(labelled.sparkSession)
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return build_filters({}, n)
    share = F.create_map(*[F.lit(x) for lang, size in sizes.items() for x in (lang, min(1.0, per_language / size))])
    draw = F.pmod(F.xxhash64(F.lit(11), F.col("id").cast("string")), F.lit(1_000_000)) / 1_000_000
    picked = rows.where(draw < share[F.col("lang")]).select("lang", "text")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1), strict=True):
                codes, times = np.unique(grams(text.as_py(), n), return_counts=True)
                own = found.setdefault(lang.as_py(), Counter())
                for code, c in zip(codes.tolist(), times.tolist(), strict=True):
                    own[code] += c
        for lang, own in found.items():
            codes = np.fromiter(own.keys(), np.uint64, len(own)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own)), pa.array(codes), pa.array(list(own.values()), pa.int64())], ["lang", "gram", "n"])

    total = picked.mapInArrow(tally, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    top = total.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= per_filter)
    counts: dict[str, dict[int, int]] = {lang: {} for lang in sizes}
    for r in top.collect():
        counts[r.lang][r.gram & 0xFFFFFFFFFFFFFFFF] = r.n
    return build_filters(counts, n)


def predict(docs: DataFrame, model: LanguageFilters, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """All rows and columns plus the language and a score between 0 and 1.

    A null text or one without a letter gets ``und`` and 0. Columns named as the results are replaced. Texts of any length are judged whole; null ids
    and repeated rows are rows like others; languages that tie go to the first by code point; an empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)  # filters of a size set by the parameters
    kept = docs.drop(pred_col, score_col)

    @F.arrow_udf("struct<lang:string,score:double>")
    def guess(texts: pa.Array) -> pa.Array:
        out = [shared.value.predict(t.as_py()) for t in texts]
        return pa.StructArray.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())], names=["lang", "score"])

    # only the text travels to Python, and once: a filter on what comes back must not judge again
    (found,) = unused(kept, "guess")
    judged = kept.withColumn(found, guess.asNondeterministic()(F.col(text_col).cast("string")))
    return judged.select(*kept.columns, F.col(f"{found}.lang").alias(pred_col), F.col(f"{found}.score").alias(score_col))


def held_out(id_col: str = "doc_id"):
    """The rows kept away from training: crc32 of the id as text leaves 2 when divided by 4. A null id is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(True))
