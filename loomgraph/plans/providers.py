"""External services behind a contract: text to text (language models) and text to vector (encoders).

A provider is a plain picklable object. It runs inside ``mapInPandas`` with a bounded number of calls at once and a deadline for each; a call that
fails or hangs is retried, and a row whose calls all fail gets an empty text and a status, never an exception. A service with keys is a
:class:`KeyedClient`, whose transport is the caller's own.
"""

from __future__ import annotations

import hashlib
import queue
import threading
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import accumulate
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from loomgraph.sources.shared import ship


class Provider(Protocol):
    def __call__(self, prompt: str) -> str: ...


@dataclass
class RecordedProvider:
    """Answers from a table of prompts; anything else gets the default, or fails without one."""

    answers: dict[str, str]
    default: str | None = None

    def __call__(self, prompt: str) -> str:
        answer = self.answers.get(prompt, self.default)
        if answer is None:
            raise KeyError("no recorded answer")
        return answer


@dataclass
class RuleProvider:
    """Answers by a function of the prompt; deterministic, for tests and dry runs."""

    rule: Callable[[str], str]

    def __call__(self, prompt: str) -> str:
        return self.rule(prompt)


@dataclass
class KeyRotation:
    """Keys of a service: rotate on errors that a key may cause, wait without rotating when told to slow down."""

    keys: list[str]
    at: int = 0
    rotate_on: frozenset[int] = frozenset({400, 401, 403, 413, *range(500, 600)})

    def key(self) -> str:
        if not self.keys:
            raise ValueError("no key")
        return self.keys[self.at % len(self.keys)]

    def next(self, used: str) -> None:
        """Go on to the next key, unless another call has done so since ``used`` was taken."""
        if self.key() == used:
            self.at += 1

    def after(self, status: int, retry_after: float | None = None, used: str | None = None) -> float | None:
        """Seconds to wait before the next attempt; None: don't try again."""
        if status == 429:
            return retry_after if retry_after is not None else 5.0
        if status in self.rotate_on:
            self.next(self.key() if used is None else used)
            return 0.0
        return None


@dataclass
class Reply:
    """What a service answered: an HTTP status, the text, and the seconds after which it may be asked again."""

    status: int
    text: str = ""
    retry_after: float | None = None


class ServiceError(Exception):
    """A status that no other attempt would change, or the last one when all attempts are used up."""

    def __init__(self, status: int):
        super().__init__(f"HTTP {status}")
        self.status = status


#: Key states by their keys: all calls of a worker share one, whichever copy of a client they use.
_rotations: dict[tuple[str, ...], KeyRotation] = {}
_lock = threading.Lock()


@dataclass
class KeyedClient:
    """A provider on top of a transport: ``send(prompt, key)`` gives a :class:`Reply` or raises.

    An attempt that is refused for its key (400, 401, 403, 413), fails on the server's side (5xx), doesn't end within ``deadline`` seconds or raises goes on with the next key; a
    429 waits as long as it says (else 5 s) and keeps the key; any other status ends the call. What the last attempt met is raised: TimeoutError
    or :class:`ServiceError`.
    """

    send: Callable[[str, str], Reply]
    keys: list[str]
    attempts: int = 5
    deadline: float = 60.0
    sleep: Callable[[float], None] = field(default=time.sleep)

    def rotation(self) -> KeyRotation:
        with _lock:
            return _rotations.setdefault(tuple(self.keys), KeyRotation(self.keys))

    def __call__(self, prompt: str) -> str:
        keys, last = self.rotation(), RuntimeError("no attempt")
        for _ in range(self.attempts):
            key = keys.key()
            try:
                reply = within(self.deadline, self.send, prompt, key)
            except Exception as error:  # whatever a transport raises, another key may do
                last = error
                with _lock:
                    keys.next(key)
                continue
            if 200 <= reply.status < 300:
                return reply.text
            last = ServiceError(reply.status)
            with _lock:
                wait = keys.after(reply.status, reply.retry_after, key)
            if wait is None:
                break
            if wait:
                self.sleep(wait)
        raise last


#: A deadline is waited for in so many turns. A worker that gets no processor, or whose threads wait for each other, takes its turns later, so a call that only stood in line isn't one that hangs.
TURNS = 20


def start_thread(target: Callable, *args: object, patience: float = 60.0) -> None:
    """Start a thread; where the system has none left (calls that hang keep theirs until they end) wait for one up to ``patience`` seconds, as that says nothing about the call."""
    last = time.monotonic() + patience
    while True:
        try:
            return threading.Thread(target=target, args=args, daemon=True).start()
        except RuntimeError:
            if time.monotonic() > last:
                raise
            time.sleep(0.02)


def within(seconds: float | None, f: Callable, *args: object) -> object:
    """f's result, or TimeoutError after so many seconds, in :data:`TURNS`.

    The call runs on a thread of its own that is left behind when it hangs, so it holds neither the caller's place among the calls at once nor the process's end.
    """
    if seconds is None:
        return f(*args)
    answer: queue.Queue = queue.Queue(1)

    def run() -> None:
        try:
            answer.put((f(*args), None))
        except BaseException as error:  # handed to the caller below
            answer.put((None, error))

    start_thread(run)
    for _ in range(TURNS):
        try:
            result, error = answer.get(timeout=seconds / TURNS)
            break
        except queue.Empty:
            continue
    else:
        raise TimeoutError(f"no answer within {seconds} s")
    if error is not None:
        raise error
    return result


class Pace:
    """At most ``rate`` calls a second begin, over all threads of a worker."""

    def __init__(self, rate: float | None):
        self.gap, self.free, self.lock = 1 / rate if rate else 0.0, 0.0, threading.Lock()

    def wait(self) -> None:
        if self.gap:
            with self.lock:
                begin = max(time.monotonic(), self.free)
                self.free = begin + self.gap
            time.sleep(max(0.0, begin - time.monotonic()))


@dataclass
class Policy:
    """attempts for a prompt, pauses in seconds, calls at once in a task, pause after each call, and limits.

    deadline: seconds for a call, as :func:`within` counts them. width: calls run in so many tasks, whatever the input's partitions; rate: calls a second over the whole
    cluster, which needs a width as each task takes its share.
    """

    attempts: int = 3
    pause: float = 0.2
    timeout_pause: float = 0.5
    at_once: int = 10
    delay: float = 0.0
    sleep: Callable[[float], None] = field(default=time.sleep)
    deadline: float | None = 120.0
    width: int | None = None
    rate: float | None = None

    def __post_init__(self) -> None:
        if self.rate and not self.width:
            raise ValueError("a rate over all tasks needs the number of tasks: width")

    def call(self, provider: Provider, prompt: str, pace: Pace | None = None) -> tuple[str, str, int]:
        """(text, status, attempts): status is ok, empty (no prompt), blank (no answer), timeout, http_<status> or the error's name."""
        return self.attempt(lambda p: within(self.deadline, provider, p), prompt, pace)

    def attempt(self, ask: Callable[[str], str], prompt: str, pace: Pace | None = None, begin: int = 0, status: str = "error") -> tuple[str, str, int]:
        """What :meth:`call` gives, from attempt ``begin`` on; ``ask`` keeps the deadline."""
        if not (prompt or "").strip():
            return "", "empty", 0
        for n in range(begin, self.attempts):
            try:
                if pace:
                    pace.wait()
                text = ask(prompt)
                if self.delay:
                    self.sleep(self.delay)
                if text:
                    return text, "ok", n + 1
                status = "blank"
                self.sleep(self.pause)
            except TimeoutError:
                status = "timeout"
                self.sleep(self.timeout_pause * (n + 1))
            except Exception as error:  # a provider may raise anything; the row carries what it was
                status = f"http_{error.status}" if isinstance(error, ServiceError) else type(error).__name__
                self.sleep(self.pause)
        return "", status, self.attempts


class Calls:
    """The calls of a batch, by ``at_once`` threads that take prompt after prompt; a call beyond the deadline loses its thread to a new one, which goes on with the prompt's next attempt.

    So a call costs no thread of its own, and a hanging one still holds neither a place among the calls at once nor the process's end.
    """

    def __init__(self, policy: Policy, provider: Provider, prompts: list[str], pace: Pace | None = None):
        self.policy, self.provider, self.prompts, self.pace = policy, provider, prompts, pace
        self.out: list = [None] * len(prompts)
        self.next, self.left, self.lock, self.ended = 0, len(prompts), threading.Lock(), threading.Event()
        #: seconds that the watcher's turns took, each counted as twice its length at most
        self.clock = 0.0
        #: [prompt's number, attempts begun, the clock when the call began or None] of each thread that counts
        self.places: list[list] = []

    def work(self, place: list, begin: int) -> None:
        """Take prompts until none is left; the first is the place's own, from attempt ``begin`` on."""

        def ask(prompt: str) -> str:
            place[1] += 1
            place[2] = self.clock
            try:
                return self.provider(prompt)
            finally:
                place[2] = None

        while True:
            i = place[0]
            try:
                place[1] = begin
                if begin:
                    self.policy.sleep(self.policy.timeout_pause * begin)
                done = self.policy.attempt(ask, self.prompts[i], self.pace, begin, "timeout" if begin else "error")
            except BaseException as error:  # a place must not be lost
                done = "", type(error).__name__, place[1]
            with self.lock:
                if not any(p is place for p in self.places):
                    return  # given up: another thread has the prompt
                self.out[i], begin = done, 0
                self.left -= 1
                if not self.left:
                    self.ended.set()
                if self.next >= len(self.prompts):
                    self.places = [p for p in self.places if p is not place]
                    return
                place[0], self.next = self.next, self.next + 1

    def start(self, i: int, begin: int = 0) -> None:
        place = [i, begin, None]
        self.places.append(place)
        start_thread(self.work, place, begin)

    def run(self) -> list[tuple[str, str, int]]:
        with self.lock:
            while self.next < min(self.policy.at_once, len(self.prompts)):
                self.next += 1
                self.start(self.next - 1)
        limit = self.policy.deadline
        turn, last = None if limit is None else min(1.0, limit / TURNS), time.monotonic()
        while self.left and not self.ended.wait(turn):
            with self.lock:
                now = time.monotonic()
                self.clock, last = self.clock + min(now - last, 2 * turn), now
                for place in list(self.places):
                    since = place[2]
                    if since is not None and self.clock - since > limit + turn:  # it may have begun at any moment of its turn
                        self.places = [p for p in self.places if p is not place]
                        self.start(place[0], place[1])
        return self.out


def call_provider(df: DataFrame, provider: Provider, prompt: str = "prompt", policy: Policy | None = None) -> DataFrame:
    """``df`` with ``response, status, attempts``. Store the result before using it twice: calls cost money."""
    ship(df.sparkSession)
    policy = policy or Policy()
    kept = df.drop("response", "status", "attempts")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)

    if policy.width:
        kept = kept.repartition(policy.width)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pace = Pace(policy.rate / policy.width if policy.rate else None)
        for batch in batches:
            done = Calls(policy, provider, batch[prompt].tolist(), pace).run()
            yield batch.assign(response=[d[0] for d in done], status=[d[1] for d in done], attempts=[d[2] for d in done])

    return kept.mapInPandas(run, f"{schema}, response string, status string, attempts int")


def call_lists(df: DataFrame, provider: Provider, prompts: str = "prompts", name: str = "responses", policy: Policy | None = None) -> DataFrame:
    """``df`` with the answers to each row's list of prompts as a list; what isn't answered is empty. All prompts of a batch of rows share its calls at once, and other columns pass as they are."""
    ship(df.sparkSession)
    policy = policy or Policy()
    schema = StructType([*df.schema.fields, StructField(name, ArrayType(StringType()))])

    if policy.width:
        df = df.repartition(policy.width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pace = Pace(policy.rate / policy.width if policy.rate else None)
        for batch in batches:
            asked = batch.column(prompts).to_pylist()
            done = Calls(policy, provider, [p for row in asked for p in row], pace).run()
            ends = pa.array([0, *accumulate(map(len, asked))], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(ends, pa.array([d[0] for d in done], pa.string()))], names=[*batch.schema.names, name])

    return df.mapInArrow(run, schema)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt evenly over three times the cluster's cores: calls take their time by the row, whatever files the rows lie in. Do it before prompts are made, which are larger than rows."""
    return df.repartition(3 * df.sparkSession.sparkContext.defaultParallelism)


@dataclass
class HashingEncoder:
    """Stand-in for a sentence encoder: signed hashed words, unit length, deterministic."""

    size: int = 64

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.size))
        for i, text in enumerate(texts):
            for word in (text or "").lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
                out[i, h % self.size] += 1 if h >> 63 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def encode(df: DataFrame, encoder: Callable[[list[str]], np.ndarray], text: str = "text", name: str = "vec", batch: int = 1000) -> DataFrame:
    """``df`` with a vector of each text, by Arrow batches; the encoder is loaded once for a task."""
    ship(df.sparkSession)

    @F.pandas_udf("array<double>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([v for a in range(0, len(part), batch) for v in encoder(part.iloc[a : a + batch].tolist()).tolist()])

    return df.withColumn(name, run(F.col(text)))
