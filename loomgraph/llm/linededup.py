"""Line dedup by a segment-partition edit join, in DataFrame operations only.

Lines are sequences of units: characters, or words from :data:`LONG` words on. How many edits tau two lines may be apart grows with the
shorter one's length n (:func:`edits_of`). Of a line tau + 1 segments are taken, the first half counted from its start, the
others from its end, all of a size L that is the same for all lengths between two points of a grid (:func:`grid`). If two lines
are within tau edits, take the first segment i of one such that segments 0 to i hold at most i edits: it holds none, exactly i edits stand left of it, and at
most tau - i right of it. So it occurs in the other line, counted from the same end, within min(i, tau - i) units of its own place. A line is
indexed under (length class, segment number, segment) and probes the few places near by; a line just above a point of the grid
does so for the class below too. Candidates have lengths within tau and parities of their units (by hash) that tau edits can reach; they are
verified by edit distance: for e = 0..tau a word of 2 tau + 1 bits holds the diagonals that e edits can reach, and one step
takes a unit on all diagonals at once. Links between distinct lines give classes; equal lines are one node.

Variants of one line share their segments, so the lines under a key are first tried against the one that occurs most often, as that is
likely what the others were made from; what is left against the next such one and against the likeliest one of those that have found each other; only lines that are not connected by then are
compared in pairs. A class so takes about as many verifications as it has lines, and no link between classes is lost.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.names import unused
from loomgraph.operators.components import connected_components
from loomgraph.sources.shared import cut, drop

#: Lines of so many words (parts between blanks) or more are compared by words, others by characters.
LONG = 16
#: (least length, edits) in characters and in words; shorter lines link with nothing. Least lengths must be points of the grid.
CHAR_EDITS = ((8, 1), (24, 2))
WORD_EDITS = ((16, 2), (48, 3), (96, 4))


def explode_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, line_no, line`` (from 0) of every line that isn't blank; carriage returns at its end aren't part of it."""
    lines = docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(F.col(text_col).cast("string"), "\n")).alias("line_no", "line"))
    return lines.withColumn("line", F.expr("rtrim('\\r', line)")).where(F.trim("line") != "")


def lines_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, line_no, h1, h2, n_chars, n_words, line`` of every line, written once: texts are split and hashed a single time."""
    lines = explode_lines(docs, id_col, text_col)
    words = F.char_length("line") - F.char_length(F.replace(F.col("line"), F.lit(" "), F.lit(""))) + 1
    # h1 and h2 are a 128-bit identity of the line's text
    return cut(lines.withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(1), "line"), "n_chars": F.char_length("line"), "n_words": words}), "lines-of-docs", dictionary=False)


class Positions:
    """Places of lines in the corpus as one number: by id (null last), then line number. A long if ids and numbers fit into it, else a decimal."""

    def __init__(self, at: DataFrame):
        low, high, lines = at.agg(F.min("id"), F.max("id"), F.max("line_no")).first()
        self.low, self.null, self.bits = int(low or 0), int(high or 0) - int(low or 0) + 1, max(1, int(lines or 0)).bit_length()
        self.fits = (self.null + 1) << self.bits < 1 << 63

    def of(self, id_: Column, line_no: Column) -> Column:
        if self.fits:
            return F.coalesce(id_.cast("long") - self.low, F.lit(self.null)) * (1 << self.bits) + line_no.cast("long")
        none = F.lit("9223372036854775808").cast("decimal(28,0)")
        return (F.coalesce(id_.cast("decimal(28,0)"), none) * F.lit(2**31).cast("decimal(11,0)") + line_no.cast("decimal(11,0)")).cast("decimal(38,0)")

    def doc(self, c: str) -> Column:
        """The document of a position; null where the line's row has no id."""
        if self.fits:
            above = F.shiftright(c, self.bits)
            return F.when(above < self.null, above + self.low)
        return F.expr(f"try_cast(floor({c} / cast({2**31} as decimal(11,0))) as bigint)")

    def line(self, c: str) -> Column:
        """The line number of a position."""
        if self.fits:
            return F.col(c).bitwiseAND(F.lit((1 << self.bits) - 1).cast("long"))
        return F.pmod(F.col(c), F.lit(2**31).cast("decimal(11,0)")).cast("bigint")


def distinct_lines(at: DataFrame, places: Positions) -> DataFrame:
    """``h1, h2, position, n_chars, n_copies``: one row for each distinct line of :func:`lines_table`, at its first occurrence."""
    return at.select("h1", "h2", places.of(F.col("id"), F.col("line_no")).alias("position"), "n_chars").groupBy("h1", "h2").agg(
        F.min("position").alias("position"), F.min("n_chars").alias("n_chars"), F.count("*").alias("n_copies"))


def grid(n: Column) -> Column:
    """The largest number 2**k or 3 * 2**k up to n, for n from 2 on."""
    power = F.call_function("shiftleft", F.lit(1), F.length(F.bin(n.cast("long"))) - 1)
    return F.when(n >= power + F.shiftright(power, 1), power + F.shiftright(power, 1)).otherwise(power)


def edits_of(n: Column, bands: tuple[tuple[int, int], ...]) -> Column:
    """The edits that lines of n units may be apart; 0 below all bands."""
    out = F.lit(0)
    for least, tau in bands:
        out = F.when(n >= least, F.lit(tau)).otherwise(out)
    return out


def places_of(tau: int) -> list[tuple[int, int]]:
    """(segment, move) of all that a line looks up; those with move 0 are what it is indexed under too."""
    return [(i, move) for i in range(tau + 1) for move in range(-min(i, tau - i), min(i, tau - i) + 1)]


def signatures(lines: DataFrame) -> DataFrame:
    """``key, h1, role`` of ``h1, line, n_chars, n_words``: what each line is indexed under (bit 0 of role) and looks up; bit 1: compared by words.

    Two character edits change the number of words by two at most, so lines of up to LONG + 1 words look for characters too.
    """

    def classes(n: str, unit: int, bands: tuple[tuple[int, int], ...], fits: Column) -> list[Column]:
        """The length class of a line, and the one below where a line there may link with it."""
        below = grid(F.col(n)) - 1
        entry = lambda top: F.struct(F.lit(unit).alias("unit"), F.col(n).alias("n"), top.alias("top"))
        own = F.when(fits & (F.col(n) >= bands[0][0]), entry(grid(F.col(n))))
        return [own, F.when(fits & (F.col(n) > bands[0][0]) & (F.col(n) - below <= edits_of(below, bands)), entry(grid(below)))]

    found = classes("n_chars", 0, CHAR_EDITS, F.col("n_words") < LONG + CHAR_EDITS[-1][1]) + classes("n_words", 1, WORD_EDITS, F.col("n_words") >= LONG)
    rows = lines.select("h1", "line", F.explode(F.array_compact(F.array(*found))).alias("c")).select("h1", "line", "c.*")
    edits = F.when(F.col("unit") == 1, edits_of(F.col("top"), WORD_EDITS)).otherwise(edits_of(F.col("top"), CHAR_EDITS))
    rows = rows.withColumn("tau", edits).withColumn("size", F.floor(F.col("top") / (F.col("tau") + 1)).cast("int"))
    n, size, line, cut_words = F.col("n"), F.col("size"), F.col("line"), lambda x, k: F.call_function("substring_index", x, F.lit(" "), k)

    def segment(unit: int, tau: int, i: int, move: int) -> Column:
        if not unit:
            return F.substring(line, (i * size if i <= tau // 2 else n - (tau - i + 1) * size) + (move + 1), size)
        if i <= tau // 2:
            left = cut_words(line, i * size + (move + F.col("size")))
            return cut_words(left, -size) if i else left
        right = cut_words(line, -((tau - i) * size - move + size))
        return cut_words(right, size) if i < tau else right

    keys = lambda unit, tau: F.array(*[F.struct(F.xxhash64(F.lit(unit * 100 + i), F.col("top"), segment(unit, tau, i, move)).alias("key"), F.lit((move == 0) + 2 * unit).cast("byte").alias("role")) for i, move in places_of(tau)])
    all_ = F.coalesce(*[F.when((F.col("unit") == unit) & (F.col("tau") == tau), keys(unit, tau)) for unit, bands in ((0, CHAR_EDITS), (1, WORD_EDITS)) for _, tau in bands])
    return rows.select("h1", F.explode(all_).alias("x")).select("x.key", "h1", "x.role")


def _parity(units: Column) -> Column:
    """64 bits: whether an odd number of units has each hash; an edit changes two of them at most."""
    return F.aggregate(units, F.lit(0).cast("long"), lambda s, x: s.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.xxhash64(x).bitwiseAND(F.lit(63)).cast("int"))))


def _bigrams(units: Column) -> Column:
    """The same of pairs of neighbours, which an edit changes four of at most; it knows the units' order."""
    return _parity(F.zip_with(F.slice(units, 1, F.greatest(F.size(units) - 1, F.lit(0))), F.slice(units, 2, F.size(units)), lambda p, q: F.xxhash64(p, q)))


def chars(line: Column) -> Column:
    """The characters of a line as an array."""
    return F.when(line == "", F.array().cast("array<string>")).otherwise(F.split(line, ""))


def words(line: Column) -> Column:
    return F.split(line, " ")


def _members(keys: DataFrame, bits: int = 22) -> Callable[[Column], Column]:
    """A test for hashes that may be among ``keys`` (one long column): a bitmap of fixed size, the same for any input.

    It only spares rows a shuffle; what passes is compared exactly, so a full bitmap costs time and changes nothing.
    """
    name = keys.columns[0]
    word = lambda h: F.pmod(h, F.lit(1 << (bits - 6))).cast("int")
    bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, 40).bitwiseAND(F.lit(63)).cast("int"))
    h = F.col(name)
    words = keys.groupBy(word(h).alias("w")).agg(F.bit_or(bit(h)).alias("b"))
    dense = keys.sparkSession.range(1 << (bits - 6)).withColumnRenamed("id", "w").join(words, "w", "left")
    row = dense.agg(F.transform(F.array_sort(F.collect_list(F.struct("w", F.coalesce("b", F.lit(0).cast("long")).alias("b")))), lambda x: x["b"]).alias("words"))
    table = cut(row, "line-bitmap").scalar()
    return lambda x: F.get(table, word(x)).bitwiseAND(bit(x)) != 0


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once: an expression bound to a lambda's variable is never inlined."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _banded(x: Column, y: Column, most: int, tau: Column) -> Column:
    """Whether two arrays of units are within tau edits, tau being ``most`` at most: an automaton whose bit d of word e says that the units
    of y so far match as many of x plus d - most with at most e edits. Both arrays must be variables."""
    full = (1 << (2 * most + 1)) - 1
    first = [1 << most]
    for _ in range(most):
        first.append((first[-1] | first[-1] << 1) & full)

    def step(at: Column, j: Column) -> Column:
        def words_of(same: Column) -> Column:
            made: list[Column] = []
            for e in range(most + 1):
                old = F.get(at, F.lit(e))
                word = old.bitwiseAND(same)
                if e:
                    less = F.get(at, F.lit(e - 1))
                    word = word.bitwiseOR(less).bitwiseOR(F.shiftright(less, 1)).bitwiseOR(F.shiftleft(made[-1], 1)).bitwiseAND(F.lit(full))
                made.append(word)
            return F.array(*made)

        same = sum((F.when(F.get(x, j + (d - most)) == F.get(y, j), F.lit(1 << d)).otherwise(F.lit(0)) for d in range(2 * most + 1)), F.lit(0))
        return _let(same, words_of)

    start = F.array(*[F.lit(w) for w in first])
    run = F.when(F.size(y) == 0, start).otherwise(F.aggregate(F.sequence(F.lit(0), F.size(y) - 1), start, step))
    apart = F.size(x) - F.size(y)
    bit = F.get(F.array(*[F.lit(1 << k) for k in range(2 * most + 1)]), apart + most)
    return F.coalesce((F.abs(apart) <= tau) & (F.get(run, tau).bitwiseAND(bit) != 0), F.lit(False))


def _middle(x: Column, y: Column, use: Callable[[Column, Column], Column]) -> Column:
    """use(x, y) without the units that both start with."""
    first = F.array_position(F.zip_with(x, y, lambda p, q: p.eqNullSafe(q)), False)
    same = lambda k: F.when(k > 0, k - 1).otherwise(F.least(F.size(x), F.size(y))).cast("int")
    rest = lambda z, k: F.slice(z, k + 1, F.size(z))
    return _let(_let(first, same), lambda k: _let(rest(x, k), lambda u: _let(rest(y, k), lambda v: use(u, v))))


def within(x: Column, y: Column, most: int, tau: Column | None = None) -> Column:
    """Whether two arrays of units are within tau edits (``most`` at most): common ends are cut off, the rest goes through :func:`_banded`."""
    tau = F.lit(most) if tau is None else tau
    turned = lambda u, v: _let(F.reverse(u), lambda p: _let(F.reverse(v), lambda q: _middle(p, q, lambda m, n: _banded(m, n, most, tau))))
    return _let(x, lambda p: _let(y, lambda q: _middle(p, q, turned)))


def near(a: Column, b: Column) -> Column:
    """Whether two lines link: by words if both are long, else by characters, within the edits of the shorter one."""

    def by(units: Callable[[Column], Column], bands: tuple[tuple[int, int], ...]) -> Column:
        check = lambda x, y: _let(edits_of(F.least(F.size(x), F.size(y)), bands), lambda tau: (tau > 0) & within(x, y, bands[-1][1], tau))
        return _let(units(a), lambda x: _let(units(b), lambda y: check(x, y)))

    long = lambda x: F.size(words(x)) >= LONG
    return F.when(long(a) & long(b), by(words, WORD_EDITS)).otherwise(by(chars, CHAR_EDITS))


def _alike(a: str, b: str) -> Column:
    """Whether structs a and b (n, tau, parity, pairs) may link by what their lengths and parities say; a pair has the shorter one's edits, which are the fewer."""
    most = F.least(F.col(f"{a}.tau"), F.col(f"{b}.tau"))
    return (F.abs(F.col(f"{a}.n") - F.col(f"{b}.n")) <= most) & (_apart(a, b) <= 2 * most) & (_apart(a, b, "pairs") <= 4 * most)


def _apart(a: str, b: str, of: str = "parity") -> Column:
    return F.bit_count(F.col(f"{a}.{of}").bitwiseXOR(F.col(f"{b}.{of}")))


def shared_keys(lines: DataFrame, hot_share: int = 1000, sample: int = 64) -> DataFrame:
    """``key, h1, role``: of ``h1, line, n_chars, n_words``, a row for each line and key that another line has too, one of them as its own.

    A key that one in ``hot_share`` of a sample's lines or more has (a ``sample``-th, by hash) is hot: its rows are dealt by line too and all kept. The
    sample decides only where rows go, and hot keys are at most ``hot_share`` times a line's number of keys.
    """
    drawn = cut(lines.where(F.pmod(F.xxhash64(F.lit(3), "h1"), F.lit(sample)) == 0), "line-sample")
    counts = cut(signatures(drawn).groupBy("key").agg(F.count_distinct("h1").alias("c")), "line-hot-keys")
    hot = counts.where(F.col("c") > max(64, drawn.select("h1").count() // hot_share)).select("key", F.lit(True).alias("hot"))
    rows = signatures(lines).join(F.broadcast(hot), "key", "left")
    deal = Window.partitionBy("key", F.when(F.col("hot"), F.pmod(F.xxhash64("h1"), F.lit(1024)) + 1).otherwise(F.lit(0)))
    own = F.max(F.col("role").bitwiseAND(F.lit(1).cast("byte"))).over(deal) == 1
    alive = F.coalesce("hot", (F.min("h1").over(deal) < F.max("h1").over(deal)) & own)
    found = cut(rows.withColumn("alive", alive).where("alive").groupBy("key", "h1").agg(F.max("role").alias("role")), "line-keys")
    drop(counts)
    drop(drawn)
    return found


def edit_links(at: DataFrame, lines: DataFrame) -> DataFrame:
    """``src, dst``: h1 of lines, so many pairs as it takes to connect all that are reachable by links.

    at: of :func:`lines_table`; lines: of :func:`distinct_lines`. A line that occurs once goes to the join as it is; those that may
    occur more often are reduced to one first, so copies never meet. Lines are told apart here by one hash of 64 bits each.
    """
    often = _members(lines.where(F.col("n_copies") > 1).select("h1"))
    fields = ["h1", "line", "n_chars", "n_words"]
    once = at.where(~often(F.col("h1"))).select(fields)
    copied = at.where(often(F.col("h1"))).groupBy("h1", "h2").agg(*[F.min(c).alias(c) for c in fields[1:]]).select(fields)
    found = shared_keys(once.unionByName(copied))
    ends = cut(found.select("h1").distinct(), "line-ends")
    texts = cut(at.where(_members(ends)(F.col("h1"))).join(ends, "h1", "left_semi").groupBy("h1").agg(F.min("line").alias("line"), F.count("*").alias("copies")), "line-texts")
    sketch = lambda units, bands: _let(units, lambda u: F.struct(F.size(u).alias("n"), edits_of(F.size(u), bands).alias("tau"), _parity(u).alias("parity"), _bigrams(u).alias("pairs")))
    # a line has sketches of the units that it is compared by, as in signatures
    n_words = F.size(words(F.col("line")))
    c, w = F.when(n_words < LONG + CHAR_EDITS[-1][1], sketch(chars(F.col("line")), CHAR_EDITS)), F.when(n_words >= LONG, sketch(words(F.col("line")), WORD_EDITS))
    sketches = texts.select("h1", "copies", c.alias("c"), w.alias("w"))
    x = F.when(F.col("role").bitwiseAND(F.lit(2).cast("byte")) == 0, F.col("c")).otherwise(F.col("w"))
    x = F.struct(x["n"].alias("n"), x["tau"].alias("tau"), x["parity"].alias("parity"), x["pairs"].alias("pairs"), (F.col("role").bitwiseAND(F.lit(1).cast("byte")) == 1).alias("own"), F.col("copies").alias("copies"))
    keys = cut(found.join(sketches, "h1").select("key", "h1", x.alias("x")), "line-keys")
    drop(found)
    a, b = (texts.select(F.col("h1").alias(c), F.col("line").alias(f"l{c}")) for c in "ab")
    pair = lambda x, y: [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]
    linked = near(F.col("la"), F.col("lb"))
    verified = lambda pairs: cut(pairs.join(a, "a").join(b, "b").where(linked).select("a", "b"), "line-links")

    state, links = keys.withColumn("group", F.lit(None).cast("long")), []
    for _ in range(2):
        open_, closed = state.where("group is null"), state.where("group is not null")
        first = open_.where("x.own").groupBy("key").agg(F.min(F.struct((-F.col("x.copies")).alias("d"), "h1", "x")).alias("r")).select("key", F.col("r.h1").alias("to"), F.col("r.x").alias("y"))
        trials = open_.join(first, "key").where((F.col("h1") != F.col("to")) & _alike("x", "y")).select("key", "h1", "to", F.col("to").alias("group"))
        if links:
            mine = closed.select("key", F.col("h1").alias("to"), F.col("x").alias("y"), F.col("group").alias("g"))
            met = open_.join(mine, "key").where((F.col("x.own") | F.col("y.own")) & _alike("x", "y"))
            best = met.groupBy("key", "h1").agg(F.min(F.struct(_apart("x", "y").alias("d"), "to", "g")).alias("m"))
            trials = trials.unionByName(best.select("key", "h1", F.col("m.to").alias("to"), F.col("m.g").alias("group")))
        trials = cut(trials, "line-trials")
        links.append(verified(trials.select(*pair("h1", "to")).distinct()))
        good = trials.withColumns({"a": F.least("h1", "to"), "b": F.greatest("h1", "to")}).join(links[-1], ["a", "b"], "left_semi").select("key", "h1", "group")
        won = good.unionByName(first.select("key", F.col("to").alias("h1"), F.col("to").alias("group"))).groupBy("key", "h1").agg(F.min("group").alias("won"))
        before, state = state, cut(state.join(won, ["key", "h1"], "left").withColumn("group", F.coalesce("group", "won")).drop("won"), "line-state")
        drop(trials)
        if before is not keys and len(links) > 1:
            drop(before)
    # what is connected by now, through whatever key, needs no further pair
    known = connected_components(reduce(DataFrame.unionByName, links), "a", "b")
    state = cut(state.join(known, F.col("h1") == F.col("node"), "left").select("key", "h1", "x", F.coalesce("component", "h1").alias("group")), "line-state")
    left = state.select("key", F.col("h1").alias("p"), "x", F.col("group").alias("gp"))
    right = state.select("key", F.col("h1").alias("q"), F.col("x").alias("y"), F.col("group").alias("gq"))
    pairs = left.join(right, "key").where((F.col("p") < F.col("q")) & (F.col("x.own") | F.col("y.own")) & (F.col("gp") != F.col("gq")) & _alike("x", "y"))
    links.append(verified(pairs.select(F.col("p").alias("a"), F.col("q").alias("b")).distinct()))
    out = links[-1].select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(known.select(F.col("node").alias("src"), F.col("component").alias("dst")))
    out = cut(out, "line-links")
    for t in (keys, ends, texts, state, *links):
        drop(t)
    return out


def line_classes(at: DataFrame, places: Positions) -> DataFrame:
    """``h1, h2, position, n_chars, n_copies, class``: each distinct line with its class's first position."""
    lines = cut(distinct_lines(at, places), "lines")
    links = edit_links(at, lines)
    labels = cut(connected_components(links), "line-labels")
    drop(links)
    known = lines.join(labels, F.col("h1") == F.col("node")).select("h1", "h2", "component", "position")
    classes = known.groupBy("component").agg(F.min("position").alias("class"))
    of = cut(known.join(classes, "component").select("h1", "h2", "class"), "line-classes")
    drop(labels)
    return lines.join(of, ["h1", "h2"], "left").withColumn("class", F.coalesce("class", "position"))


def _ids_of_rows(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    """(docs, name of a column that tells all rows apart): the id itself where no id is null or repeats, else a number in the order of
    the ids (null last), then of a hash of the text, then of the rows as they were read. Rows are numbered in range partitions, so rows without an id, or equal ones, however many, are no hot task."""
    row, number, other = unused(docs, "row", "number", "other")
    if docs.groupBy(id_col).count().where(F.col(id_col).isNull() | (F.col("count") > 1)).isEmpty():
        return docs, id_col
    rows = cut(docs.withColumn(row, F.monotonically_increasing_id()), "line-docs")
    order = [F.asc_nulls_last("i"), F.asc("h"), F.asc("r")]
    thin = rows.select(F.col(id_col).alias("i"), F.xxhash64(text_col).alias("h"), F.col(row).alias("r"))
    numbered = cut(thin.repartitionByRange(*order).sortWithinPartitions(*order).select(F.col("r").alias(other), F.monotonically_increasing_id().alias(number)), "line-ids")
    return cut(rows.join(numbered, F.col(row) == F.col(other)).drop(row, other), "line-docs"), number


def near_duplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each distinct line: ``doc_id, line_no`` of its first occurrence, ``n_chars, n_copies, class_doc_id, class_line_no``.

    Lines link as :func:`near` says; class: the first line reachable by links, itself included. Lines of
    fewer than 8 characters link with nothing. Blank lines, null and empty texts give no rows; an empty table gives none; other columns
    are ignored, whatever their names. Rows without an id come last and show a null id; rows that repeat an id share positions, so that
    of equal positions the texts are told apart by identity alone. Ids must be integers. Texts of any length are taken whole.
    """
    at = lines_table(docs, id_col, text_col)
    places = Positions(at)
    classes = line_classes(at, places)
    return classes.select(places.doc("position").alias("doc_id"), places.line("position").alias("line_no"), F.col("n_chars").cast("bigint").alias("n_chars"), "n_copies", places.doc("class").alias("class_doc_id"), places.line("class").alias("class_line_no"))


def line_members(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each line of each document that isn't blank: ``doc_id, line_no, n_chars, n_copies, class_doc_id, class_line_no``.

    The columns after line_no are those of the line's text in :func:`near_duplicate_lines`.
    """
    at = lines_table(docs, id_col, text_col)
    places = Positions(at)
    classes = line_classes(at, places)
    known = classes.select("h1", "h2", F.col("n_chars").cast("bigint").alias("n_chars"), "n_copies", places.doc("class").alias("class_doc_id"), places.line("class").alias("class_line_no"))
    return at.select(F.col("id").alias("doc_id"), F.col("line_no").cast("bigint").alias("line_no"), "h1", "h2").join(known, ["h1", "h2"]).drop("h1", "h2")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the lines that repeat, exactly or nearly, a line before them in the corpus; same columns.

    Blank lines stay where they are. A document that loses lines and has no letter or digit left goes too; others stay, also null and
    empty ones. Rows without an id or that repeat one are rows of their own. An empty table gives an empty one.
    """
    columns = docs.columns
    gone_lines, of = unused(docs, "gone", "of")
    docs, id_col = _ids_of_rows(docs, id_col, text_col)
    at = lines_table(docs, id_col, text_col)
    places = Positions(at)
    classes = line_classes(at, places)
    firsts = cut(classes.where((F.col("n_copies") > 1) | (F.col("position") != F.col("class"))).select("h1", "h2", F.col("class")), "line-firsts")
    gone = at.select("id", "line_no", "h1", "h2", places.of(F.col("id"), F.col("line_no")).alias("position")).join(firsts, ["h1", "h2"]).where(F.col("position") != F.col("class"))
    marks = cut(gone.groupBy("id").agg(F.sort_array(F.collect_set("line_no")).alias(gone_lines)), "line-gone")
    drop(at)
    # lists of line numbers are far larger in memory than as files, which is what Spark's size check sees: no broadcast
    joined = docs.join(marks.withColumnRenamed("id", of).hint("merge"), F.col(id_col).eqNullSafe(F.col(of)), "left")
    body = F.split(F.col(text_col), "\n")
    keep = F.array_except(F.sequence(F.lit(0), F.size(body) - 1), F.col(gone_lines))
    left = F.array_join(F.transform(keep, lambda k: F.get(body, k)), "\n")
    text = F.when(F.col(gone_lines).isNull(), F.col(text_col)).otherwise(left)
    return joined.withColumn(text_col, text).where(F.col(gone_lines).isNull() | F.col(text_col).rlike(r"[\p{L}\p{N}]")).select(columns)
