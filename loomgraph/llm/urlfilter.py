"""URL filtering: rules on host and path prefixes first, then a logistic regression on hashed character n-grams.

Features of a URL are the n-grams of its host and of its path, told apart by a mark, hashed into ``2**bits`` buckets and
scaled to unit length; those of a whole batch are found by array operations. The regression is trained on the driver from a small
labelled table, by full-batch gradient steps, so that the same table always gives the same weights. Rows of the table are not weighted
by class: it holds more harmless than unwanted URLs, so one that says nothing known is allowed.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.sources.shared import ship

#: Words that hosts of unwanted kinds are made of, by kind; general knowledge of what URL block lists hold.
UNWANTED = {
    "adult": "porn sex xxx nude erotic escort camgirls hentai",
    "gambling": "poker roulette blackjack lottery jackpot slots sportsbook wager",
    "medicine": "viagra cialis steroids pharma weightloss tramadol xanax botox",
    "piracy": "torrent warez crack keygen cracked serials nulled bootleg",
    "lures": "bonus prize discount giveaway replica coupon voucher sweepstake",
    "spam": "seo backlinks linkwheel clickbait doorway autoblog phish scraper",
    "advertising": "banner popup clicks popunder telemetry beacon affiliate sponsor",
    "money": "loan loans payday forex credit quickcash mortgage bitcoin",
}
HARMLESS = (
    "news docs library school wiki garden music travel recipes science history weather forum city museum health maps books cinema sports "
    "university hospital research theatre radio journal gallery kitchen nature physics chemistry biology poetry language village council "
    "archive station bakery bicycle mountain river forest harbour market bridge castle orchestra painting philosophy mathematics geology"
).split()
PATHS = "articles archive about posts items topics en fr de es".split()
ENDS = "com org net info eu".split()


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    allow: bool

    @property
    def text(self) -> str:
        return self.host + self.path


def _name(k: int) -> str:
    """A pronounceable host name that means nothing, by rule: two or three syllables of onset, vowel and coda."""
    onsets, codas = "b d f g k l m n p r s t v z th sh ch st tr pl".split(), ["", "n", "r", "s", "", "nt", "nd", "st", "l"]
    return "".join(onsets[(k * a + 3) % 20] + "aeiou"[(k * b + k // 7) % 5] + codas[(k * c + k // 5) % 9] for a, b, c in ((7, 2, 1), (3, 3, 2), (9, 4, 5))[: 2 + k % 2])


def _url(host: str, k: int) -> str:
    lead, tail = ("", "www.", "blog.", "m.")[k % 4], ("", "/", ".html", "?page=2")[k // 3 % 4]
    return f"http{'s' * (k % 2)}://{lead}{host}.{('', 'example.')[k // 2 % 2]}{ENDS[k % 5]}/{PATHS[k % 10]}/{(37 * k) % 997}{tail}"


@dataclass(frozen=True)
class Labelled:
    """A row of the table: its words (none of a harmless name) and its kind (empty for harmless rows) are for measuring only."""

    url: str
    blocked: bool
    words: tuple[str, ...]
    kind: str


def labelled_rows() -> list[Labelled]:
    """A small table of URLs by rule: hosts of one or two words of a kind, against hosts of harmless words and of names that mean nothing."""
    hosts: list[tuple[str, tuple[str, ...], str]] = []
    for kind, text in UNWANTED.items():
        words = text.split()
        for j, w in enumerate(words):
            then, third = words[(j + 1) % len(words)], words[(j + 3) % len(words)]
            hosts += [(w, (w,), kind), (f"{w}-{then}", (w, then), kind), (f"{w}{third}", (w, third), kind), (f"my{w}", (w,), kind), (f"best{w}", (w,), kind)]
    for j, w in enumerate(HARMLESS):
        then, third = HARMLESS[(j + 1) % len(HARMLESS)], HARMLESS[(j + 7) % len(HARMLESS)]
        hosts += [(w, (w,), ""), (f"{w}-{then}", (w, then), ""), (f"{w}{third}", (w, third), ""), (f"best{w}", (w,), "")]
    hosts += [(f"{_name(k)}{('', '-' + _name(k + 40))[k % 3 == 0]}", (_name(k),), "") for k in range(20 * len(HARMLESS))]
    return [Labelled(_url(h, 7 * k), bool(kind), words, kind) for k, (h, words, kind) in enumerate(hosts)]


def labelled_urls() -> list[tuple[str, bool]]:
    """(url, blocked) of the whole table."""
    return [(r.url, r.blocked) for r in labelled_rows()]


def held_out_word(word: str) -> bool:
    """A quarter of all words, by their hash. A row whose words are all held out is measured, one without any is learned from, others are neither."""
    return zlib.crc32(word.encode()) % 4 == 2


URL = re.compile(r"[^/?#]*")
LOWER = {c: c + 32 for c in range(65, 91)}


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): host after the first ``://``, A-Z lower-cased; both empty without one."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    host = URL.match(rest).group()
    return host.translate(LOWER), re.match(r"[^?#]*", rest[len(host):]).group()


class UrlModel:
    """Weights over hashed n-grams; ``fit`` is deterministic."""

    def __init__(self, bits: int = 16, sizes: tuple[int, ...] = (3, 4, 5)):
        self.bits, self.sizes = bits, sizes
        self.weights, self.bias = np.zeros(1 << bits), 0.0

    def features(self, urls: list[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray]:
        """(number of a URL, bucket) of every n-gram of (host, path) pairs, repeats included; an empty URL has none."""
        parts = [b"^" + x.encode("utf-8", "surrogatepass") + b"$" if x else b"" for pair in urls for x in pair]
        length = np.array([len(x) for x in parts], np.int64)
        codes = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint64)
        part = np.repeat(np.arange(len(parts)), length)
        left = np.repeat(np.cumsum(length), length) - np.arange(len(codes))  # bytes of the part from here on
        owners, buckets = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for n in self.sizes:
            at = np.flatnonzero(left >= n)
            hashed = (part[at] % 2 + 1).astype(np.uint64)
            for j in range(n):
                hashed = (hashed ^ codes[at + j]) * np.uint64(0x100000001B3)
            hashed = (hashed ^ hashed >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15)
            owners.append(part[at] // 2)
            buckets.append((hashed >> np.uint64(64 - self.bits)).astype(np.int64))
        return np.concatenate(owners), np.concatenate(buckets)

    def _sums(self, owner: np.ndarray, bucket: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        scale = 1 / np.sqrt(np.maximum(1, np.bincount(owner, minlength=n)))
        return self.bias + np.bincount(owner, self.weights[bucket], n) * scale, scale

    def scores(self, urls: list[tuple[str, str]]) -> np.ndarray:
        """Probabilities that (host, path) pairs are to be blocked."""
        z = self._sums(*self.features(urls), len(urls))[0]
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))

    def fit(self, urls: list[tuple[str, bool]], steps: int = 600, rate: float = 40.0, shrink: float = 1e-5) -> UrlModel:
        y = np.array([b for _, b in urls], float)
        owner, bucket = self.features([split_url(u) for u, _ in urls])
        for _ in range(steps if len(urls) else 0):
            z, scale = self._sums(owner, bucket, len(urls))
            g = (1 / (1 + np.exp(-z)) - y) / len(urls)
            self.weights -= rate * (np.bincount(bucket, (g * scale)[owner], 1 << self.bits) + shrink * self.weights)
            self.bias -= rate / 10 * g.sum()
        return self


def match(host: str, path: str, rules: list[Rule]) -> Rule | None:
    """The longest rule that fits the host or a domain it belongs to and the start of the path; of equal length the first by text."""
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return min(fits, key=lambda r: (-len(r.text), r.text, r.allow), default=None)


def judge(pages: DataFrame, rules: list[Rule], model: UrlModel, id_col: str = "page_id", url_col: str = "url", threshold: float = 0.5) -> DataFrame:
    """``id_col, host, path, rule, verdict, score`` for each row; other columns are ignored.

    A null url or one without ``://`` has an empty host and path; no rule fits it, and the model judges it by its
    bias alone. score: the model's probability of block (given also where a rule decides). Ids may be null or repeat, urls be of any
    length; an empty table gives no rows.
    """
    spark = pages.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast((rules, model))  # 2**bits weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, trained = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                urls = [split_url(url) for url in part.column(1).to_pylist()]
                scores = trained.scores(urls)
                rules = [match(*url, known) for url in urls]
                verdicts = ["allow" if (rule.allow if rule else p < threshold) else "block" for rule, p in zip(rules, scores.tolist(), strict=True)]
                texts = [pa.array(x, pa.string()) for x in ([u[0] for u in urls], [u[1] for u in urls], [rule.text if rule else None for rule in rules], verdicts)]
                yield pa.RecordBatch.from_arrays([part.column(0), *texts, pa.array(scores)], [id_col, "host", "path", "rule", "verdict", "score"])

    picked = pages.select(F.col(id_col), F.col(url_col).cast("string"))
    return picked.mapInArrow(run, f"`{id_col}` {picked.schema[0].dataType.simpleString()}, host string, path string, rule string, verdict string, score double")
