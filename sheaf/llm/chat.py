"""Chat formatting with minimum-cost role repair.

A legal conversation is a walk through an automaton of roles. Each raw turn
either opens a turn (under its own role or another), is merged into the turn
before it, or opens one after empty turns that are put in. What a turn may do
depends on its role alone, so a stretch of turns is a matrix of least costs
from state to state, and stretches can be worked out apart from each other.

Turns are dealt by ranges of (conversation, turn). A conversation that lies in
one range is repaired there. Only the first and the last conversation of a
range can go on in another one; for these each turn carries its choice for
every pair of end states, and the pairs are picked afterwards from the
matrices, two at most for each range. So a conversation that holds a third of
all turns is worked on by a third of the tasks.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.session import written

ROLES = ("system", "user", "assistant")
FAR = 1 << 40


@dataclass(frozen=True)
class Option:
    before: int
    after: int
    action: str
    cost: int
    inserted: tuple[int, ...]


@dataclass(frozen=True)
class Rules:
    """The automaton, as state numbers (0 is the start), and the costs of repairs."""

    follows: tuple[tuple[int, ...], ...] = ((1, 2), (2,), (3,), (2,))
    ends: tuple[int, ...] = (2, 3)
    merge: int = 1
    relabel: int = 2
    relabel_unknown: int = 1
    insert: int = 3
    opening: str = "<|im_start|>{role}\n"
    closing: str = "<|im_end|>\n"
    between: str = "\n\n"

    def path(self, a: int, b: int) -> tuple[int, ...] | None:
        """The fewest empty turns that lead from state ``a`` to one that ``b`` may follow."""
        ways, seen = [((), a)], {a}
        while ways:
            done, at = ways.pop(0)
            if b in self.follows[at]:
                return done
            for s in self.follows[at]:
                if s not in seen:
                    seen.add(s)
                    ways.append((done + (s,), s))
        return None

    def ending(self, a: int) -> tuple[int, ...]:
        """The fewest empty turns after which a conversation may end."""
        if a in self.ends:
            return ()
        ways = [((s,), s) for s in self.follows[a]]
        while ways:
            done, at = ways.pop(0)
            if at in self.ends:
                return done
            ways += [(done + (s,), s) for s in self.follows[at]]
        raise ValueError("no legal end")


@functools.lru_cache(maxsize=8)
def options(rules: Rules) -> tuple[tuple[Option, ...], list[list[list[int]]]]:
    """All options, and their numbers by raw role (0: none of the roles) and state after."""
    every, by = [], [[[] for _ in rules.follows] for _ in rules.follows]
    for raw in range(len(rules.follows)):
        for a in range(len(rules.follows)):
            for b in range(1, len(rules.follows)):
                change = 0 if raw == b else rules.relabel if raw else rules.relabel_unknown
                found = []
                if a == b:
                    found.append(Option(a, b, "merge" if raw == b else "relabel+merge", rules.merge + change, ()))
                if (path := rules.path(a, b)) is not None:
                    name = ("insert+" if path else "") + ("keep" if raw == b else "relabel")
                    found.append(Option(a, b, name, rules.insert * len(path) + change, path))
                for o in found:
                    by[raw][b].append(len(every))
                    every.append(o)
    return tuple(every), by


def walks(raw: list[int], rules: Rules, starts: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Least costs from each start to each state, and the options chosen.

    ``choice[start, end, turn]`` numbers an option; 255 where no walk leads.
    Of equal costs the option listed first wins.
    """
    every, by = options(rules)
    states = len(rules.follows)
    cost = np.full((len(starts), states), FAR, np.int64)
    choice = np.full((len(starts), states, len(raw)), 255, np.uint8)
    for k, start in enumerate(starts):
        now = [FAR] * states
        now[start] = 0
        back = []
        for r in raw:
            new, took = [FAR] * states, [255] * states
            for b in range(1, states):
                for o in by[r][b]:
                    c = now[every[o].before] + every[o].cost
                    if c < new[b]:
                        new[b], took[b] = c, o
            now = new
            back.append(took)
        cost[k] = now
        for end in range(states):
            at = end
            if now[end] >= FAR:
                continue
            for i in range(len(raw) - 1, -1, -1):
                choice[k, end, i] = back[i][at]
                at = every[back[i][at]].before
    return cost, choice


def best_end(cost: np.ndarray, rules: Rules) -> int:
    return int(np.argmin([c + rules.insert * len(rules.ending(s)) for s, c in enumerate(cost)]))


def settle(segments: list[tuple[int, object, list[int]]], rules: Rules) -> list[tuple[int, object, int, int, bool]]:
    """``part, conversation, entry, exit, last`` of the open segments, in the order of parts."""
    states, out = len(rules.follows), []
    for key, run in groupby(segments, key=lambda s: s[1]):
        run = [(part, np.array(m).reshape(states, states)) for part, _, m in run]
        reach = [np.array([0] + [FAR] * (states - 1))]
        for _, m in run:
            reach.append((reach[-1][:, None] + m).min(axis=0))
        exit_ = best_end(reach[-1], rules)
        placed = []
        for (part, m), costs in zip(reversed(run), reversed(reach[:-1]), strict=True):
            entry = int(np.argmin(costs + m[:, exit_]))
            placed.append((part, key, entry, exit_, not placed))
            exit_ = entry
        out += reversed(placed)
    return out


def repair(
    turns: DataFrame,
    rules: Rules = Rules(),  # noqa: B008
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """Repair the roles of every conversation at least cost and render it.

    Returns one row per raw turn: ``<conversation>, <turn>, <role>``, the
    ``new_role`` it counts under, the ``action``, its ``cost``, the
    ``fragment`` of the rendered conversation that it contributes and its
    ``place`` among all turns. Fragments put together in the order of places
    are the rendered conversation; turns merged and empty turns put in are
    part of them. ``render`` does that.

    Turns go by number, null first, then by role and text, so repeated rows
    are turns of their own. A null text is empty. A null or other role is
    relabelled. Null conversations are one conversation. Template marks inside
    a text are broken up by a space. Other columns are not read.
    """
    spark, states = turns.sparkSession, len(rules.follows)
    every, _ = options(rules)
    rows = turns.select(
        turns[conversation].alias("conv"), turns[turn].alias("turn"), turns[role].cast("string").alias("role"),
        F.coalesce(turns[text].cast("string"), F.lit("")).alias("text"),
    )
    dealt = rows.repartitionByRange("conv", "turn", F.xxhash64("role", "text")).sortWithinPartitions(
        F.asc_nulls_first("conv"), F.asc_nulls_first("turn"), F.asc_nulls_first("role"), "text"
    )
    numbers = {name: i + 1 for i, name in enumerate(ROLES)}

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, held, serial = TaskContext.get().partitionId(), True, None, 0

        def finished(table: pa.Table, last: bool) -> pa.RecordBatch:
            nonlocal serial
            n = table.num_rows
            places = (part << 40) + serial + np.arange(n)
            serial += n
            raw = [numbers.get(r, 0) for r in table["role"].to_pylist()]
            open_ = first or last
            cost, choice = walks(raw, rules, list(range(states)) if open_ else [0])
            matrix = [None] * n
            if open_:
                codes = [choice[:, :, i].tobytes() for i in range(n)]
                matrix[-1] = cost.ravel().tolist()
            else:
                end = best_end(cost[0], rules)
                codes = [choice[0, end, i : i + 1].tobytes() for i in range(n)]
            tail = [i == n - 1 for i in range(n)]
            return pa.RecordBatch.from_arrays(
                [*(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in table.columns),
                 pa.array(codes, pa.binary()), pa.array([part if open_ else None] * n, pa.int32()),
                 pa.array(tail), pa.array(matrix, pa.list_(pa.int64())), pa.array(places)],
                names=["conv", "turn", "role", "text", "codes", "part", "tail", "matrix", "place"],
            )

        for batch in batches:
            table = pa.Table.from_batches([batch])
            if held is not None:
                table = pa.concat_tables([held, table])
            conv = table["conv"].to_pylist()
            cuts = [i for i in range(1, len(conv)) if conv[i] != conv[i - 1]]
            start = 0
            for cut in cuts:
                yield finished(table.slice(start, cut - start), False)
                start, first = cut, False
            held = table.slice(start) if conv else None
        if held is not None:
            yield finished(held, True)

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    walked = written(
        dealt.mapInArrow(
            walk,
            f"conv {kinds['conv']}, turn {kinds['turn']}, role string, text string, codes binary, part int, tail boolean,"
            " matrix array<bigint>, place bigint",
        ),
        "turns",
    )
    # Two rows at most for each range of turns.
    open_rows = walked.filter("matrix is not null").select("part", "conv", "matrix").collect()
    order = sorted(open_rows, key=lambda r: (r["part"], r["conv"] is not None, r["conv"] if r["conv"] is not None else 0))
    settled = settle([(r["part"], r["conv"], r["matrix"]) for r in order], rules)
    picks = spark.createDataFrame(settled, f"p int, c {kinds['conv']}, entry int, exit int, last boolean")
    picked = walked.join(
        F.broadcast(picks), (walked.part == picks.p) & walked.conv.eqNullSafe(picks.c), "left"
    ).withColumn(
        "code",
        F.when(F.col("part").isNull(), F.conv(F.hex("codes"), 16, 10)).otherwise(
            F.conv(F.hex(F.substring("codes", F.col("entry") * states + F.col("exit") + 1, F.lit(1))), 16, 10)
        ).cast("int"),
    )

    def of(values: list) -> F.Column:
        return F.element_at(F.array(*(F.lit(v) for v in values)), F.col("code") + 1)

    def opened(s: int) -> str:
        return rules.opening.format(role=ROLES[s - 1])

    heads, tails = [], []
    for o in every:
        empty = "".join(opened(s) + rules.closing for s in o.inserted)
        joined = rules.between if "merge" in o.action else (rules.closing if o.before else "") + empty + opened(o.after)
        heads.append(joined)
        tails.append(rules.closing + "".join(opened(s) + rules.closing for s in rules.ending(o.after)))
    marks = [m for m in (rules.opening.split("{role}")[0].strip(), rules.closing.strip()) if m]
    body = F.col("text")
    for mark in marks:
        body = F.replace(body, F.lit(mark), F.lit(f"{mark[:1]} {mark[1:]}"))
    ends = F.col("tail") & F.coalesce("last", F.lit(True))
    return picked.select(
        F.col("conv").alias(conversation),
        F.col("turn").alias(turn),
        F.col("role").alias(role),
        of([ROLES[o.after - 1] for o in every]).alias("new_role"),
        of([o.action for o in every]).alias("action"),
        (of([o.cost for o in every]) + F.when(ends, of([rules.insert * len(rules.ending(o.after)) for o in every])).otherwise(0)).alias("cost"),
        F.concat(of(heads), body, F.when(ends, of(tails)).otherwise("")).alias("fragment"),
        "place",
    )


def render(repaired: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """Whole conversations, for those that fit a row: ``<conversation>, cost, rendered``."""
    parts = F.sort_array(F.collect_list(F.struct("place", "fragment")))
    return repaired.groupBy(conversation).agg(
        F.sum("cost").alias("cost"), F.array_join(F.transform(parts, lambda p: p["fragment"]), "").alias("rendered")
    )
