"""Conversation structure repair by a min-plus matrix scan.

A well-formed conversation's roles begin with ``s?(ua)+`` or there are none: system at most once and first, then user and
assistant by turns. The automaton has four states (nothing yet, after system, after user, after assistant), and a turn is
a 4x4 matrix whose element (i, j) is the cheapest (cost, audit) that leads from state i to j over this turn: insertions
before it (the closure of the insert matrix), then keep, re-role or delete. Matrices multiply by adding costs and joining audits and take
the least pair. Two audits over the same turns that cost the same never begin one with the other (they would differ in
insertions at the end alone, which cost), so the least of joined pairs is the join of least ones and the product is associative.

Turns are range-partitioned by conversation and turn, so a conversation of any length may spread over many tasks. Each task
multiplies the runs it holds, by halves; the few runs at the edges of partitions are multiplied on by a tree over the partitions. Then the
audit of a conversation that spans several partitions is cut at the runs' letters, and every kept turn finds its letter by place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from loomgraph.sources.shared import cut, ship

SPACE = " \t\n\x0b\x0c\r"
RE_ROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
START, SYSTEM, USER, ASSISTANT = range(4)
LEGAL = frozenset(["su", "ua", "au"])
ROLES = frozenset("sua")

Element = tuple[int, str] | None
Matrix = tuple[Element, ...]


def times(a: Matrix, b: Matrix) -> Matrix:
    """The min-plus product: costs add, audits join, the least (cost, audit) counts; None is unreachable."""
    out: list[Element] = []
    for i in range(0, 16, 4):
        for j in range(4):
            best: Element = None
            for k in range(4):
                x, y = a[i + k], b[4 * k + j]
                if x is not None and y is not None and (best is None or x[0] + y[0] <= best[0]):
                    new = (x[0] + y[0], x[1] + y[1])
                    best = new if best is None else min(best, new)
            out.append(best)
    return tuple(out)


def plus(a: Matrix, b: Matrix) -> Matrix:
    return tuple(x if y is None else y if x is None else min(x, y) for x, y in zip(a, b, strict=True))


def _matrix(**cells: Element) -> Matrix:
    """A matrix of the cells named ``fromto`` by initials of states (``n`` for nothing yet)."""
    return tuple(cells.get(i + j) for i in "nsua" for j in "nsua")


ONE = _matrix(nn=(0, ""), ss=(0, ""), uu=(0, ""), aa=(0, ""))
_INSERT = _matrix(nu=(INSERT, "I"), su=(INSERT, "I"), ua=(INSERT, "I"), au=(INSERT, "I"))
#: Any number of insertions; two lead from any state to any that insertions reach, more only cost.
CLOSURE = plus(ONE, plus(_INSERT, times(_INSERT, _INSERT)))


@lru_cache(maxsize=16)
def turn_matrix(kind: str) -> Matrix:
    """kind: D for a turn that must go, else the initial of its role (x for any other), a capital where it is truncated."""
    gone = _matrix(**{c + c: (DELETE, "D") for c in "nsua"})
    if kind == "D":
        return times(CLOSURE, gone)
    more = TRUNCATED if kind.isupper() else 0
    keep, other = (more, "K"), (RE_ROLE + more, "R")
    kept = {"s": _matrix(ns=keep), "u": _matrix(nu=keep, su=keep, au=keep), "a": _matrix(ua=keep)}.get(kind.lower())
    moved = _matrix(nu=other, su=other, au=other, ua=other)
    return times(CLOSURE, plus(gone, plus(moved, kept) if kept else moved))


@lru_cache(maxsize=65_536)
def _short(kinds: str) -> Matrix:
    return turn_matrix(kinds) if len(kinds) == 1 else times(_short(kinds[:-1]), turn_matrix(kinds[-1]))


def product(kinds: str) -> Matrix:
    """The matrix of a run of turns, by halves; short runs recur and are remembered."""
    if not kinds:
        return ONE
    if len(kinds) <= 8:
        return _short(kinds)
    half = len(kinds) // 2
    return times(product(kinds[:half]), product(kinds[half:]))


def cheapest(run: Matrix) -> tuple[int, str]:
    """(cost, audit) of a whole conversation: from nothing to nothing or to an assistant's turn, insertions at the end included."""
    whole = times(run, CLOSURE)
    return min(x for x in (whole[4 * START + START], whole[4 * START + ASSISTANT]) if x is not None)


class Run(NamedTuple):
    """What a run of turns of one conversation says; ``+`` joins neighbouring runs."""

    rows: int
    blank: int
    duplicate: int
    truncated: int
    illegal: int
    least_turn: int | None
    most_turn: int | None
    turns: int
    first: str
    last: str
    matrix: Matrix

    def __add__(self, then: Run) -> Run:  # type: ignore[override]
        twice = self.most_turn is not None and self.most_turn == then.least_turn
        return Run(
            self.rows + then.rows, self.blank + then.blank, self.duplicate + then.duplicate, self.truncated + then.truncated,
            self.illegal + then.illegal + (self.last + then.first not in LEGAL), self.least_turn if self.least_turn is not None else then.least_turn,
            then.most_turn if then.most_turn is not None else self.most_turn, self.turns + then.turns - twice, self.first, then.last, times(self.matrix, then.matrix))

    def whole(self) -> dict:
        cost, audit = cheapest(self.matrix)
        gaps = self.most_turn - self.least_turn + 1 - self.turns if self.turns else 0
        return {"gaps": gaps, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal, "cost": cost, "audit": audit}

    def stored(self) -> dict:
        return self._asdict() | {"matrix": [{"cost": -1, "audit": ""} if e is None else {"cost": e[0], "audit": e[1]} for e in self.matrix]}

    @staticmethod
    def read(row: dict) -> Run:
        return Run(**{f: row[f] for f in Run._fields} | {"matrix": tuple(None if e["cost"] < 0 else (e["cost"], e["audit"]) for e in row["matrix"])})


WHOLE = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
RUN = "rows long, blank long, duplicate long, truncated long, illegal long, least_turn long, most_turn long, turns long, first string, last string, matrix array<struct<cost:long,audit:string>>"


class Repaired(NamedTuple):
    """summary: a row for each conversation; turns: conversation, position, role, text, edit of the repaired turns."""

    summary: DataFrame
    turns: DataFrame


def damage(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv, turn, role, text`` with repeatable faults, by crc32 of ``conv:turn`` modulo 20.

    0: the row goes; 1: its text becomes empty; 2: its text loses ``.!?``; 3: it stands twice; 4: its role becomes user. Nulls but those of
    conversation and turn, which keep them, become one space. Equal rows are damaged alike; an empty table gives no rows; other columns are left out.
    """
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(spaced(conv_col), F.lit(":"), spaced(turn_col)).cast("binary")), F.lit(20))
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), spaced(role_col).alias("role"), spaced(text_col).alias("text"), kind.alias("kind")).where("kind != 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def _thin(rows: DataFrame) -> DataFrame:
    """``c, turn, role, h, n, blank, cut, first``: distinct turns without their texts, and whether each is the first with its role and text."""
    bare = F.rtrim("text", F.lit(SPACE))
    thin = rows.select("c", "turn", "role", "h", (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("cut"))
    thin = thin.groupBy("c", "turn", "role", "h").agg(F.count("*").alias("n"), F.first("blank").alias("blank"), F.first("cut").alias("cut"))
    key = F.struct("c", "role", "h")
    # a struct of a null sorts before all others, as turns without a number come first
    several = thin.groupBy(key.alias("key")).agg(F.min(F.struct("turn")).alias("earliest"), F.count("*").alias("m")).where("m > 1").drop("m")
    return thin.withColumn("key", key).join(several, "key", "left").withColumn("first", F.coalesce(F.struct("turn") == F.col("earliest"), F.lit(True))).drop("key", "earliest")


def _scan(conv: pa.DataType):
    """Over sorted partitions: a row for each turn that may stay, with its place in its run, and a row for each run.

    A run at an edge of the partition may go on in the next one and gives its matrix; any other is a whole conversation and gives its result.
    """
    fields = lambda ddl: to_arrow_type(StructType.fromDDL(ddl))
    out = pa.schema([("conv", conv), ("turn", pa.int64()), ("role", pa.string()), ("h", pa.binary()), ("part", pa.int64()), ("place", pa.int64()), ("run", fields(RUN)), ("whole", fields(WHOLE))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ready, at_start = TaskContext.get().partitionId(), [], True
        rows: list[dict] = []

        def close() -> dict:
            letters, place, tally = [], 0, [0, 0, 0, 0]
            before, turns, least, most = None, 0, None, None
            for r in rows:
                initial, n = r["role"][:1], r["n"]
                stays = r["first"] and not r["blank"]
                kind = (initial if initial in ROLES else "x") if stays else "D"
                kind = kind.upper() if r["cut"] else kind
                letters.append(kind + "D" * (n - 1))
                tally[0] += n * r["blank"]
                tally[1] += 0 if r["blank"] else n - r["first"]
                tally[2] += stays and r["cut"]
                tally[3] += n - 1 + (before is not None and before + initial not in LEGAL)
                before = initial
                if r["turn"] is not None and r["turn"] != most:
                    turns, most, least = turns + 1, r["turn"], r["turn"] if least is None else least
                if stays:
                    ready.append({"conv": r["conv"], "turn": r["turn"], "role": r["role"], "h": r["h"], "part": part, "place": place})
                place += n
            run = Run(place, *tally, least, most, turns, rows[0]["role"][:1], before, product("".join(letters)))
            return {"conv": rows[0]["conv"], "part": part, "made": run}

        def give(last: bool) -> None:
            nonlocal at_start
            if rows:
                x = close()
                made = x.pop("made")
                ready.append(x | ({"run": made.stored()} if at_start or last else {"whole": made.whole()}))
                at_start = False
                rows.clear()

        for batch in batches:
            for r in batch.to_pylist():
                if rows and r["conv"] != rows[0]["conv"]:
                    give(False)
                rows.append(r)
            if len(ready) >= 4096:
                yield pa.RecordBatch.from_pylist(ready, out)
                ready.clear()
        give(True)
        if ready:
            yield pa.RecordBatch.from_pylist(ready, out)

    return scan


def _joined(table: pa.Table) -> Run:
    rows = sorted(table.select(["part", "run"]).to_pylist(), key=lambda r: r["part"])
    run = Run.read(rows[0]["run"])
    for r in rows[1:]:
        run = run + Run.read(r["run"])
    return run


def letters_of(audit: str, sizes: list[int]) -> list[str]:
    """The audit cut at runs of so many turns: a run has the insertions before its turns, the last one also those at the end."""
    out, at = [], 0
    for k, size in enumerate(sizes):
        begin = at
        if k == len(sizes) - 1:
            at = len(audit)
        while size and at < len(audit):
            size -= audit[at] != "I"
            at += 1
        out.append(audit[begin:at])
    return out


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of audits to a row for each turn of the result: its place in the run (null where it is inserted), its position, its role (null where kept)."""
    for batch in batches:
        for x in batch.to_pylist():
            place, position = 0, x["before"]
            found: dict[str, list] = {"place": [], "position": [], "role": [], "edit": []}
            for letter in x["letters"]:
                if letter != "D":
                    found["place"].append(None if letter == "I" else place)
                    found["position"].append(position)
                    found["role"].append(None if letter == "K" else "assistant" if (position - x["system"]) % 2 else "user")
                    found["edit"].append(letter)
                    position += 1
                place += letter != "I"
            n = len(found["edit"])
            for a in range(0, n, 65_536):
                cols = {k: v[a : a + 65_536] for k, v in found.items()}
                m = len(cols["edit"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x["conv"]] * m, batch.schema.field("conv").type), pa.array([x["part"]] * m, pa.int64()), pa.array(cols["place"], pa.int64()), pa.array(cols["position"], pa.int64()), pa.array(cols["role"], pa.string()), pa.array(cols["edit"], pa.string())],
                    names=["conv", "part", "place", "position", "role", "edit"])


def repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", fan_in: int = 64) -> Repaired:
    """The cheapest repair of every conversation of a table of turns.

    Turns are taken by number, those without one first, ties by role and a hash of the text. A null role or text is read as one space, a null conversation is one like others. Faults
    of a turn: blank (nothing but white space), duplicate (its role and text stand earlier), truncated (last character not ``.!?``); the first counts.
    Keeping costs 0, another role 2, deleting 3 (a must for blank and duplicate turns), inserting an empty turn 2; a truncated turn that stays adds 1. The audit has
    a letter for each edit (K, R, D, I), the least of equally cheap ones. illegal counts neighbours whose initials aren't su, ua or au; gaps are missing numbers.

    summary: ``conv, gaps, blank, duplicate, truncated, illegal, cost, audit``; turns: ``conv, position, role, text, edit`` of what stays and what is inserted. Equal rows are
    copies; texts of any length are hashed once and travel once; an empty table gives no rows; other columns are left out.
    """
    spark = turns.sparkSession
    ship(spark)
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    named = turns.select(F.struct(F.col(conv_col).alias("conv")).alias("c"), F.col(turn_col).cast("long").alias("turn"), spaced(role_col).alias("role"), spaced(text_col).alias("text"))
    rows = named.withColumn("h", F.unhex(F.sha2("text", 256)))
    kind = turns.select(F.col(conv_col).alias("conv")).schema["conv"].dataType
    order = ["conv", "turn", "role", "h"]
    dealt = _thin(rows).select("c.conv", "turn", "role", "h", "n", "blank", "cut", "first").repartitionByRange(*order).sortWithinPartitions(*order)
    conv = f"conv {kind.simpleString()}"
    scanned = cut(dealt.mapInArrow(_scan(to_arrow_type(kind)), f"{conv}, turn long, role string, h binary, part long, place long, run struct<{_struct(RUN)}>, whole struct<{_struct(WHOLE)}>"), "runs")

    edges = scanned.where("run is not null").select("conv", "part", "run")
    parts = (scanned.agg(F.max("part")).first()[0] or 0) + 1
    level, width = edges, 1
    while width < parts:
        width *= fan_in

        def combine(table: pa.Table) -> pa.Table:
            run = _joined(table)
            return pa.Table.from_pylist([{"conv": table.column("conv")[0].as_py(), "part": min(table.column("part").to_pylist()), "run": run.stored()}], table.schema)

        level = cut(level.groupBy("conv", F.floor(F.col("part") / width).alias("g")).applyInArrow(combine, level.schema), "joined")

    def end(table: pa.Table) -> pa.Table:
        return pa.Table.from_pylist([{"conv": table.column("conv")[0].as_py()} | _joined(table).whole()], schema_of(table))

    def schema_of(table: pa.Table) -> pa.Schema:
        return pa.schema([table.schema.field("conv"), *[pa.field(f.split()[0], pa.string() if f.endswith("string") else pa.int64()) for f in WHOLE.split(", ")]])

    ended = cut(level.groupBy("conv").applyInArrow(end, f"{conv}, {WHOLE}"), "ended")
    within = scanned.where("whole is not null").select("conv", "part", "whole.*")
    summary = within.drop("part").unionByName(ended)

    def slices(runs: pa.Table, whole: pa.Table) -> pa.Table:
        held, audit = sorted((r["part"], r["run"]["rows"]) for r in runs.to_pylist()), whole.column("audit")[0].as_py()
        out, before = [], 0
        for (part, _), letters in zip(held, letters_of(audit, [n for _, n in held]), strict=True):
            out.append({"conv": whole.column("conv")[0].as_py(), "part": part, "letters": letters, "before": before, "system": _system(audit)})
            before += len(letters) - letters.count("D")
        return pa.Table.from_pylist(out, pa.schema([whole.schema.field("conv"), ("part", pa.int64()), ("letters", pa.string()), ("before", pa.int64()), ("system", pa.int64())]))

    spread = edges.groupBy("conv").cogroup(ended.groupBy("conv")).applyInArrow(slices, f"{conv}, part long, letters string, before long, system long")
    system = (F.length(F.translate("audit", "D", "")) % 2).cast("long")  # as _system
    alone = within.select("conv", "part", F.col("audit").alias("letters"), F.lit(0).cast("long").alias("before"), system.alias("system"))
    edits = spread.unionByName(alone).mapInArrow(_edits, f"{conv}, part long, place long, position long, role string, edit string")
    edits = cut(edits, "edits")

    inserted = edits.where("edit = 'I'").select("conv", "position", "role", F.lit("").alias("text"), "edit")
    c = F.struct("conv").alias("c")
    stays = scanned.where("h is not null").select(c, "part", "place", "turn", F.col("role").alias("old"), "h")
    placed = edits.where("edit != 'I'").select(c, "part", "place", "position", "role", "edit").join(stays, ["c", "part", "place"])
    key = F.struct("c", "turn", F.col("old"), "h").alias("key")
    texts = rows.select(F.struct("c", "turn", F.col("role").alias("old"), "h").alias("key"), "text")
    found = placed.select(key, "position", "role", "edit").join(texts, "key").groupBy("key").agg(F.first("position").alias("position"), F.first("role").alias("role"), F.first("edit").alias("edit"), F.first("text").alias("text"))
    said = found.select("key.c.conv", "position", F.coalesce("role", "key.old").alias("role"), "text", "edit")
    name = lambda df: df.withColumnRenamed("conv", conv_col)
    return Repaired(name(summary), name(said.unionByName(inserted)))


def _struct(ddl: str) -> str:
    """Field list of a struct type from that of a table."""
    return ", ".join(f"{f.split(' ', 1)[0]}: {f.split(' ', 1)[1]}" for f in ddl.split(", "))


def _system(audit: str) -> int:
    """1 where a system turn stays: users and assistants come in pairs, so then the number of turns is odd."""
    return (len(audit) - audit.count("D")) % 2


def digests(turns: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """``conv, repaired_sha256`` of the repaired turns' ``role:text``, joined by newlines, in a stream over sorted turns: a digest takes a conversation's texts in order."""
    ship(turns.sparkSession)
    kind = turns.schema[conv_col].dataType.simpleString()

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, digest = None, None
        for batch in batches:
            convs, sums = [], []
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "role", "text")), strict=True):
                if digest is None or conv != held:
                    if digest is not None:
                        convs.append(held)
                        sums.append(digest.hexdigest())
                    held, digest = conv, hashlib.sha256(f"{role}:{text}".encode())
                else:
                    digest.update(f"\n{role}:{text}".encode())
            kind_ = batch.schema.field("conv").type
            if convs:
                yield pa.RecordBatch.from_arrays([pa.array(convs, kind_), pa.array(sums, pa.string())], names=["conv", "repaired_sha256"])
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([held], kind_), pa.array([digest.hexdigest()], pa.string())], names=["conv", "repaired_sha256"])

    in_order = turns.select(F.col(conv_col).alias("conv"), "position", "role", "text").repartition("conv").sortWithinPartitions("conv", "position")
    return in_order.mapInArrow(stream, f"conv {kind}, repaired_sha256 string").withColumnRenamed("conv", conv_col)
