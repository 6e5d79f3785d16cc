"""Repair of conversation structure by rank-convergence parallel Viterbi.

A conversation is legal if the initials of its roles are ``(s?(ua)+)?``. Turns
may be kept, given another role, deleted, or put in empty; the cheapest way is
a shortest path through rows of four states. Rows are dealt in chunks, so a
conversation of any length is worked on by many tasks. Costs to the end are
found backwards: every chunk starts from a speculative vector of costs, the one
of a conversation's end. Where the vector that the next chunk has found differs
from it by more than a constant, a fix-up pass runs the chunk again, until its
vectors differ from those of the run before by a constant only; from there on
the earlier run holds. The passes end when no chunk has changed. A sum of the
constants stitches the vectors to costs, and a walk forward along them takes the
edit with the smallest letter that the cheapest repair allows.

Vectors are kept with their least entry at zero, so that equal vectors are
those that differed by a constant. There are few of them, and the step from one
to the next by the kind of a row is worked out once for each process.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.session import written

# States: nothing yet, behind a system, a user and an assistant turn.
STATES = 4
FAR = 1 << 40
# What follows each state if the role is free to choose: user, user, assistant, user.
FREE = (2, 2, 3, 2)
# What follows each state by the initial of a kept role: s, u, a, any other, none.
KEEP = ((1, None, None, None), (2, 2, None, 2), (None, None, 3, None), (None,) * 4, (0, 1, 2, 3))
INITIALS = "sua"
FINE, TRUNCATED, BLANK, DUPLICATE = range(4)
DELETE_COST, RENAME_COST, INSERT_COST, TRUNCATED_COST = 2, 1, 5, 5
NAMES = {"u": "user", "a": "assistant"}
# White space of the rules: \x20 and \x09 to \x0D.
SPACE = " \t\n\x0b\x0c\r"
# Rows of a chunk, as a power of two; rows of a task of the ordering.
CHUNK_BITS = 16
TASK_ROWS, MOST_TASKS = 1 << 17, 20_000


def normal(costs: list[int]) -> tuple[tuple[int, ...], int]:
    least = min(costs)
    return tuple(c - least for c in costs), least


def with_inserts(costs: list[int]) -> list[int]:
    """Least costs if empty turns may be put in first."""
    for _ in range(STATES):
        costs = [min(c, INSERT_COST + costs[FREE[q]]) for q, c in enumerate(costs)]
    return costs


# Costs to the end behind the last row.
END = tuple(with_inserts([0, FAR, FAR, 0]))


def row_options(symbol: int, state: int) -> list[tuple[str, str, int, int]]:
    """``letter, mark, cost, state after`` of what may become of a row, in the order of letters.

    The mark is the initial of the role given to a turn, ``=`` for its own, ``-`` for none.
    """
    fault, initial = divmod(symbol, 5)
    options = [("D", "-", DELETE_COST, state)]
    if fault in (FINE, TRUNCATED):
        more = TRUNCATED_COST if fault == TRUNCATED else 0
        if (after := KEEP[initial][state]) is not None:
            options.append(("K", "=", more, after))
        options.append(("R", "-ua"[FREE[state] - 1], RENAME_COST + more, FREE[state]))
    return options


@functools.lru_cache(maxsize=1 << 16)
def step(vector: tuple[int, ...], symbol: int) -> tuple[tuple[int, ...], int]:
    """The vector before a row, from the one behind it, and the constant taken out."""
    own = [min(cost + vector[after] for _, _, cost, after in row_options(symbol, q)) for q in range(STATES)]
    return normal(with_inserts(own))


@functools.lru_cache(maxsize=1 << 18)
def edit(vector: tuple[int, ...], symbol: int, state: int) -> tuple[str, str, int]:
    """Letters and marks of the edits at a row, and the state behind it; ``vector`` is the one behind the row."""
    before, constant = step(vector, symbol)
    letters = marks = ""
    while True:
        left = before[state] + constant
        own = {o[0]: o for o in row_options(symbol, state) if o[2] + vector[o[3]] == left}
        insert = INSERT_COST + before[FREE[state]] + constant == left
        letter = min([*own, *("I" if insert else "")])
        if letter != "I":
            return letters + letter, marks + own[letter][1], own[letter][3]
        letters, marks, state = letters + "I", marks + "-ua"[FREE[state] - 1], FREE[state]


def closing(state: int) -> tuple[str, str]:
    """Letters and marks of the empty turns behind the last row."""
    marks = ""
    while END[state]:
        marks, state = marks + "-ua"[FREE[state] - 1], FREE[state]
    return "I" * len(marks), marks


def backward(symbols: bytes, end: tuple[int, ...]) -> tuple[tuple[int, ...], int]:
    """The vector before the first row, and the sum of constants."""
    vector, total = end, 0
    for symbol in reversed(symbols):
        vector, constant = step(vector, symbol)
        total += constant
    return vector, total


def fix_up(
    symbols: bytes, old_end: tuple[int, ...], old_start: tuple[int, ...], old_total: int, end: tuple[int, ...]
) -> tuple[tuple[int, ...], int]:
    """What ``backward`` gives for ``end``, from its result for ``old_end``.

    Both runs go side by side until their vectors are the same; the rest of the
    earlier run then holds.
    """
    new, old, total, passed = end, old_end, 0, 0
    for symbol in reversed(symbols):
        if new == old:
            return old_start, total + old_total - passed
        new, constant = step(new, symbol)
        old, earlier = step(old, symbol)
        total, passed = total + constant, passed + earlier
    return new, total


def trace(symbols: bytes, end: tuple[int, ...], state: int) -> tuple[list[str], list[str], int]:
    """Letters and marks of every row from a state on, and the state behind the rows."""
    vectors = [end]
    for symbol in reversed(symbols):
        vectors.append(step(vectors[-1], symbol)[0])
    letters, marks = [], []
    for symbol, vector in zip(symbols, vectors[-2::-1], strict=True):
        a, b, state = edit(vector, symbol, state)
        letters.append(a)
        marks.append(b)
    return letters, marks, state


def damaged(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Turns with made faults, by the checksum of ``conversation:turn`` modulo 20.

    0 drops a turn, 1 empties its text, 2 takes out its full stops, exclamation
    and question marks, 3 repeats it, 4 makes it a user's. Nulls count as one
    space. Returns the four columns.
    """

    def filled(name: str) -> Column:
        return F.coalesce(turns[f"`{name}`"].cast("string"), F.lit(" "))

    part = F.crc32(F.concat(filled(conversation), F.lit(":"), filled(turn)).cast("binary")) % 20
    rows = turns.select(
        turns[f"`{conversation}`"].alias("c"), turns[f"`{turn}`"].alias("t"),
        filled(role).alias("r"), filled(text).alias("x"), part.alias("part"),
    ).filter("part <> 0")
    times = F.explode(F.array_repeat(F.lit(0), F.when(F.col("part") == 3, 2).otherwise(1)))
    marks = F.translate("x", ".!?", "")
    new = F.when(F.col("part") == 1, "").when(F.col("part") == 2, marks).otherwise(F.col("x"))
    named = F.when(F.col("part") == 4, "user").otherwise(F.col("r"))
    made = rows.select("c", "t", named.alias("r"), new.alias("x"), times.alias("copy"))
    return made.select(F.col("c").alias(conversation), F.col("t").alias(turn), F.col("r").alias(role), F.col("x").alias(text))


def ordered(turns: DataFrame, conversation: str, turn: str, role: str, text: str) -> DataFrame:
    """``conv, turn, role, text, place``: places rise by conversation and turn, nulls first.

    Turns of one number go by role and a hash of the text, so equal ones are
    neighbours. The rows of any one key may lie in several tasks.
    """
    rows = turns.select(
        turns[f"`{conversation}`"].alias("conv"), turns[f"`{turn}`"].alias("turn"),
        F.coalesce(turns[f"`{role}`"].cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(turns[f"`{text}`"].cast("string"), F.lit(" ")).alias("text"),
    )
    tasks = max(1, min(MOST_TASKS, -(-rows.count() // TASK_ROWS)))
    keyed = rows.withColumn("hash", F.xxhash64("text")).withColumn("tie", F.monotonically_increasing_id())
    keys = [F.asc_nulls_first(c) for c in ("conv", "turn", "role", "hash", "tie")]
    dealt = keyed.repartitionByRange(tasks, *keys).sortWithinPartitions(*keys)
    return written(dealt.select("conv", "turn", "role", "text", F.monotonically_increasing_id().alias("place")), "turns")


def chunked(turns: DataFrame, bits: int) -> DataFrame:
    """``conv, first, chunk, symbols, edge``: the rows of a conversation in a chunk, one byte each.

    ``first`` is the place of the first row. Only the first and the last
    conversation of a chunk, its ``edge``, can go on in another one.
    """
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    initial = F.substring("role", 1, 1)
    number = F.when(initial == "", 4)
    for i, letter in enumerate(INITIALS):
        number = number.when(initial == letter, i)
    cut = ~F.right(bare, F.lit(1)).isin(".", "!", "?")
    fault = F.when(bare == "", BLANK).when(cut, TRUNCATED).otherwise(FINE)
    chunk = F.shiftright("place", bits)
    compact = turns.select("conv", "place", "role", chunk.alias("chunk"), (fault * 5 + number.otherwise(3)).cast("int").alias("symbol"),
                           F.unhex(F.sha2("text", 256)).alias("digest"))
    seen = compact.groupBy("conv", "role", "digest").agg(F.min("place").alias("place"))
    firsts = seen.select(chunk.alias("chunk"), "place")

    def join(rows: pa.Table, own: pa.Table) -> pa.Table:
        rows = rows.sort_by("place")
        place, symbols = rows["place"].to_numpy(), rows["symbol"].to_numpy().copy()
        repeat = ~np.isin(place, own["place"].to_numpy()) & (symbols < BLANK * 5)
        symbols[repeat] = symbols[repeat] % 5 + DUPLICATE * 5
        data = symbols.astype(np.uint8).tobytes()
        conv = rows["conv"].to_pylist()
        cuts = [0, *(i for i in range(1, len(conv)) if conv[i] != conv[i - 1]), len(conv)]
        heads, n = cuts[:-1], len(cuts) - 1
        return pa.table(
            {"conv": rows["conv"].take(pa.array(heads, pa.int64())), "first": place[heads], "chunk": rows["chunk"].take(pa.array(heads, pa.int64())),
             "symbols": pa.array([data[a:b] for a, b in zip(heads, cuts[1:], strict=True)], pa.binary()),
             "edge": [i in (0, n - 1) for i in range(n)]}
        )

    kind = turns.schema["conv"].dataType.simpleString()
    made = compact.select("conv", "place", "chunk", "symbol").groupBy("chunk").cogroup(firsts.groupBy("chunk"))
    return written(
        made.applyInArrow(join, f"conv {kind}, first bigint, chunk bigint, symbols binary, edge boolean"), "chunks"
    )


def vectors_of(batch: pa.RecordBatch, name: str) -> list[tuple[int, ...] | None]:
    return [None if v is None else tuple(v) for v in batch.column(name).to_pylist()]


def lists(values: list) -> pa.Array:
    return pa.array([None if v is None else list(v) for v in values], pa.list_(pa.int64()))


def converged(edges: DataFrame, conv_kind: str) -> tuple[DataFrame, int]:
    """``conv, first, symbols, end, start, total, last``: true vectors of every edge, and how many passes it took."""
    kind = f"conv {conv_kind}, first bigint, symbols binary, end array<bigint>, start array<bigint>, total bigint"

    def row(batch: pa.RecordBatch, ends: list, runs: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("conv", "first", "symbols")), lists(ends), lists([s for s, _ in runs]), pa.array([t for _, t in runs], pa.int64())],
            names=["conv", "first", "symbols", "end", "start", "total"],
        )

    def speculate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield row(batch, [END] * batch.num_rows, [backward(s, END) for s in batch.column("symbols").to_pylist()])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, runs = [], []
            columns = batch.column("symbols").to_pylist(), *(vectors_of(batch, c) for c in ("end", "start", "next"))
            for symbols, end, start, after, total in zip(*columns, batch.column("total").to_pylist(), strict=True):
                changed = after is not None and after != end
                ends.append(after if changed else end)
                runs.append(fix_up(symbols, end, start, total, after) if changed else (start, total))
            yield row(batch, ends, runs)

    following = Window.partitionBy("conv").orderBy("first")
    now, passes = written(edges.select("conv", "first", "symbols").mapInArrow(speculate, kind), "vectors"), 1
    while True:
        linked = now.select("first", "end", F.lead("start").over(following).alias("next"))
        if linked.filter("next is not null and next <> end").isEmpty():
            return now.join(linked.select("first", F.col("next").isNull().alias("last")), "first"), passes
        now = written(now.join(linked.drop("end"), "first").mapInArrow(again, kind), "vectors")
        passes += 1


def entered(edges: DataFrame) -> DataFrame:
    """``first, entry``: the state in which the walk comes to every edge.

    Each edge is walked from every state; the walks of a conversation are then
    put together in their order, a few numbers for each of its chunks.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = [
                [trace(symbols, end, q)[2] for q in range(STATES)]
                for symbols, end in zip(batch.column("symbols").to_pylist(), vectors_of(batch, "end"), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv"), batch.column("first"), pa.array(ends, pa.list_(pa.int32()))], names=["conv", "first", "exits"]
            )

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state = (), 0
        for batch in batches:
            entries = []
            for name, exits in zip(batch.column("conv").to_pylist(), batch.column("exits").to_pylist(), strict=True):
                if (name,) != conv:
                    conv, state = (name,), 0
                entries.append(state)
                state = exits[state]
            yield pa.RecordBatch.from_arrays([batch.column("first"), pa.array(entries, pa.int32())], names=["first", "entry"])

    kind = edges.schema["conv"].dataType.simpleString()
    walks = written(edges.select("conv", "first", "symbols", "end").mapInArrow(walk, f"conv {kind}, first bigint, exits array<int>"), "walks")
    in_order = walks.repartition("conv").sortWithinPartitions(F.asc_nulls_first("conv"), "first")
    return in_order.mapInArrow(chain, "first bigint, entry int")


@dataclass(frozen=True)
class Repaired:
    """``turns`` (``conv, turn, role, text, place``) and the ``edits`` of each (``conv, place, fault, letters, marks``).

    ``fault`` is 0 for none, 1 truncated, 2 blank, 3 duplicate. ``letters`` are
    the edits at a turn: ``I`` puts in an empty turn, before it or behind the
    conversation's last one, ``K`` keeps it, ``R`` gives it another role, ``D``
    deletes it; ``marks`` hold for each the initial of the role given.
    ``costs`` (``conv, cost``) are the stitched costs, ``passes`` the number of
    passes until all vectors were true.
    """

    turns: DataFrame
    edits: DataFrame
    costs: DataFrame
    passes: int

    def rows(self) -> DataFrame:
        """Every turn with its edits."""
        return self.turns.join(self.edits.drop("conv"), "place")

    def summary(self) -> DataFrame:
        """One row a conversation: ``conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.

        The text of a conversation is hashed as it streams by, in order; its
        letters are all that is held of it.
        """
        numbered = self.turns.schema["turn"].dataType.simpleString()
        kind = self.turns.schema["conv"].dataType.simpleString()
        shape = ["conv", "place", "turn", "role", "text", "fault", "letters", "marks"]
        own = self.turns.select(*(F.col(c) if c in self.turns.columns else F.lit(None).alias(c) for c in shape))
        typed = {"turn": numbered, "role": "string", "text": "string"}
        added = self.edits.select(*(F.lit(None).cast(typed[c]).alias(c) if c in typed else F.col(c) for c in shape))
        both = own.withColumn("letters", F.lit(None).cast("string")).withColumn("marks", F.lit(None).cast("string"))
        both = both.withColumn("fault", F.lit(None).cast("int")).unionByName(added)
        in_order = both.repartition("conv").sortWithinPartitions(
            F.asc_nulls_first("conv"), "place", F.desc_nulls_last("letters")
        )
        names = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            digest, done = None, []
            for batch in batches:
                convs = batch.column("conv")
                columns = [batch.column(c).to_pylist() for c in ("conv", *shape[2:])]
                for conv, turn, role, text, fault, letters, marks in zip(*columns, strict=True):
                    if digest is None or digest.conv != conv:
                        if digest is not None:
                            done.append(digest.result())
                        digest = Digest(conv)
                    if letters is not None:
                        digest.edits = fault, letters, marks
                    else:
                        digest.turn(turn, role, text)
                if done:
                    yield made(done, convs.type)
                    done = []
                last = convs.type
            if digest is not None:
                yield made([digest.result()], last)

        def made(rows: list[tuple], conv: pa.DataType) -> pa.RecordBatch:
            kinds = [conv, *[pa.int64()] * 6, pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        counts = ", ".join(f"{c} bigint" for c in names[1:7])
        return in_order.mapInArrow(run, f"conv {kind}, {counts}, audit string, repaired_sha256 string")


class Digest:
    """What ``Repaired.summary`` says of one conversation, turn by turn in order."""

    def __init__(self, conv: object) -> None:
        self.conv, self.edits = conv, (FINE, "", "")
        self.counts, self.illegal, self.cost = [0] * 4, 0, 0
        self.low = self.high = self.before = None
        self.turns, self.audit, self.sha, self.any = 0, [], hashlib.sha256(), False

    def put(self, role: str, text: str) -> None:
        self.sha.update(f"{chr(10) if self.any else ''}{role}:{text}".encode())
        self.any = True

    def turn(self, number: int | None, role: str, text: str) -> None:
        if number is not None and number != self.high:
            self.low, self.high = number if self.low is None else self.low, number
            self.turns += 1
        initial = role[:1]
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = initial
        fault, letters, marks = self.edits
        self.counts[fault] += 1
        self.audit.append(letters)
        for letter, mark in zip(letters, marks, strict=True):
            if letter == "I":
                self.put(NAMES[mark], "")
                self.cost += INSERT_COST
            elif letter == "D":
                self.cost += DELETE_COST
            else:
                self.put(role if letter == "K" else NAMES[mark], text)
                self.cost += (RENAME_COST if letter == "R" else 0) + (TRUNCATED_COST if fault == TRUNCATED else 0)

    def result(self) -> tuple:
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return (self.conv, gaps, self.counts[BLANK], self.counts[DUPLICATE], self.counts[TRUNCATED], self.illegal,
                self.cost, "".join(self.audit), self.sha.hexdigest())


def repair(
    turns: DataFrame, bits: int = CHUNK_BITS, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> Repaired:
    """Repair every conversation at least cost, of equal costs by the audit least in ASCII.

    Faults: blank (no character but white space), duplicate (role and text seen
    earlier in the conversation), truncated (the last such character is none of
    ``.!?``); the first that applies counts. Keeping a turn is free, another
    role (user or assistant) costs 1, deleting 2, an empty turn of a user or an
    assistant 5; blank and duplicate turns must go, a truncated one that stays
    costs 5 more.

    A null role or text is one space; a role counts by its first character, and
    an empty one by none, so it may be kept anywhere. Turns go by number, null
    first, equal numbers by role and a hash of the text; repeated rows are turns of their own.
    Null conversations are one conversation. Texts of any length are read
    whole. Other columns are not read. An empty table gives empty tables. All
    that is read twice is written to the shared folder first.
    """
    rows = ordered(turns, conversation, turn, role, text)
    kind = rows.schema["conv"].dataType.simpleString()
    chunks = chunked(rows, bits)
    edges, passes = converged(chunks.filter("edge"), kind)
    edges = written(edges, "edges")
    starts = edges.join(entered(edges), "first")
    whole = chunks.filter("not edge").select(
        "first", "conv", "symbols", F.array(*(F.lit(c).cast("bigint") for c in END)).alias("end"), F.lit(True).alias("last"), F.lit(0).alias("entry")
    )

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, places, faults, letters, marks, totals = [], [], [], [], [], []
            columns = (batch.column(c).to_pylist() for c in ("first", "symbols", "last", "entry"))
            for i, (first, symbols, last, entry, end) in enumerate(zip(*columns, vectors_of(batch, "end"), strict=True)):
                a, b, state = trace(symbols, end, entry)
                if last:
                    more = closing(state)
                    a[-1], b[-1] = a[-1] + more[0], b[-1] + more[1]
                at += [i] * len(symbols)
                places += range(first, first + len(symbols))
                faults += [s // 5 for s in symbols]
                letters += a
                marks += b
            if at:
                yield pa.RecordBatch.from_arrays(
                    [batch.column("conv").take(pa.array(at, pa.int64())), pa.array(places, pa.int64()), pa.array(faults, pa.int32()),
                     pa.array(letters, pa.string()), pa.array(marks, pa.string())],
                    names=["conv", "place", "fault", "letters", "marks"],
                )

    cols = ["first", "conv", "symbols", "end", "last", "entry"]
    walked = whole.select(cols).unionByName(starts.select(cols))
    edits = written(walked.mapInArrow(walk, f"conv {kind}, place bigint, fault int, letters string, marks string"), "edits")

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = [backward(s, END) for s in batch.column("symbols").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("conv"), pa.array([v[0] + t for v, t in runs], pa.int64())], names=["conv", "cost"])

    # The first chunk of a conversation adds what its vector says of the start.
    stitched = edges.groupBy("conv").agg((F.sum("total") + F.min_by(F.col("start")[0], "first")).alias("cost"))
    costs = whole.select("conv", "symbols").mapInArrow(alone, f"conv {kind}, cost bigint").unionByName(stitched)
    return Repaired(rows, edits, costs, passes)
