import hashlib
import itertools
import random
import re
import zlib

import pytest

from sheaf.llm import turnrepair

KIND = "conv_id long, turn long, role string, text string"
SPACES = " \t\n\x0b\x0c\r"


def faults(rows):
    """Fault of every ``(role, text)``."""
    out, seen = [], set()
    for role, text in rows:
        bare = text.rstrip(SPACES)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def every_repair(rows, inserts):
    """``cost, audit, turns`` of every way to edit a short conversation."""
    gap = [c for n in range(inserts + 1) for c in itertools.product(("user", "assistant"), repeat=n)]
    own = []
    for (role, text), fault in zip(rows, faults(rows), strict=True):
        more = 5 if fault == "truncated" else 0
        ways = [(2, "D", [])]
        if fault not in ("blank", "duplicate"):
            ways += [(more, "K", [(role, text)])] + [(1 + more, "R", [(r, text)]) for r in ("user", "assistant")]
        own.append(ways)
    for puts in itertools.product(gap, repeat=len(rows) + 1):
        for ways in itertools.product(*own):
            cost, audit, turns = 0, "", []
            for put, (c, letter, made) in itertools.zip_longest(puts, ways, fillvalue=(0, "", [])):
                cost += 5 * len(put) + c
                audit += "I" * len(put) + letter
                turns += [(r, "") for r in put] + made
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in turns)):
                yield cost, audit, turns


def forwards(rows):
    """The least ``cost, audit`` and its turns, by going forward over all prefixes of legal initials."""
    after = {"": "su", "s": "u", "u": "a", "a": "u"}

    def with_inserts(best):
        for _ in range(4):
            for state, (cost, audit, turns) in list(best.items()):
                for r in ("user", "assistant"):
                    if r[0] in after[state]:
                        new = (cost + 5, audit + "I", [*turns, (r, "")])
                        best[r[0]] = min(best.get(r[0], new), new)
        return best

    best = {"": (0, "", [])}
    for (role, text), fault in zip(rows, faults(rows), strict=True):
        best, new = with_inserts(best), {}
        for state, (cost, audit, turns) in best.items():
            ways = [(state, (cost + 2, audit + "D", turns))]
            if fault not in ("blank", "duplicate"):
                more = cost + (5 if fault == "truncated" else 0)
                if role[:1] in after[state] or not role:
                    ways.append((role[:1] or state, (more, audit + "K", [*turns, (role, text)])))
                ways += [(r[0], (more + 1, audit + "R", [*turns, (r, text)])) for r in ("user", "assistant") if r[0] in after[state]]
            for to, way in ways:
                new[to] = min(new.get(to, way), way)
        best = new
    best = with_inserts(best)
    return min(best[s] for s in ("", "a") if s in best)


def summary(rows):
    """The contract's columns of turns ``(turn, role, text)`` in order."""
    numbers = {t for t, _, _ in rows if t is not None}
    pairs = [(r, x) for _, r, x in rows]
    marks = faults(pairs)
    cost, audit, turns = forwards(pairs)
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(pairs))
    text = "\n".join(f"{r}:{x}" for r, x in turns)
    return (max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0, *(marks.count(f) for f in ("blank", "duplicate", "truncated")),
            illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


def conversation(pick, n, roles=("system", "user", "assistant", "user", "assistant", "tool", "", "Sys")):
    texts = ["Yes.", "No", "Why?", "", " \t", "Go on!", "a\x85", "So. ", "…", "Yes. "]
    return [(pick.choice(roles), pick.choice([*texts, f"{pick.random()}."])) for _ in range(n)]


def test_forward_walk_is_the_least_of_all():
    pick = random.Random(1)
    for n in (0, 1, 2, 2, 3, 3, 3, 3):
        for _ in range(12):
            rows = conversation(pick, n)
            assert forwards(rows) == min(every_repair(rows, 2 if n < 3 else 1))


def test_fix_up_equals_a_run_of_its_own():
    pick = random.Random(2)
    vectors = {turnrepair.END}
    for _ in range(300):
        symbols = bytes(pick.choices(range(20), k=pick.randrange(1, 30)))
        start, total = turnrepair.backward(symbols, turnrepair.END)
        for end in sorted(vectors):
            assert turnrepair.fix_up(symbols, turnrepair.END, start, total, end) == turnrepair.backward(symbols, end)
        vectors.add(start)
    assert 5 < len(vectors) < 1_000


def made(seed):
    pick = random.Random(seed)
    rows = [(i, t, *r) for i in range(40) for t, r in enumerate(conversation(pick, pick.randrange(1, 9)))]
    rows += [(100, t, *r) for t, r in enumerate(conversation(pick, 150, ("user", "assistant", "user", "system")))]
    rows += [(None, 3 * t, *r) for t, r in enumerate(conversation(pick, 30))]
    rows += [(101, None, "user", "Only."), (102, 5, "assistant", "Alone"), (102, None, "user", "First."), (103, 1, "user", "  ")]
    return rows


@pytest.mark.parametrize("bits", [1, 3, 16])
def test_same_as_brute_force(spark, bits):
    rows = made(bits)
    table = spark.createDataFrame(rows, KIND).repartition(6)
    found = turnrepair.repair(table, bits)
    got = {r[0]: tuple(r)[1:] for r in found.summary().collect()}
    want = {}
    for conv, group in itertools.groupby(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)), key=lambda r: r[0]):
        want[conv] = summary([r[1:] for r in sorted(group, key=lambda r: (r[1] is not None, r[1] or 0))])
    assert got == want
    assert {r["conv"]: r["cost"] for r in found.costs.collect()} == {c: v[5] for c, v in want.items()}
    assert found.passes > 1 if bits < 16 else found.passes <= 2


def test_rows_carry_their_edits(spark):
    rows = [(1, 0, "assistant", "Hi."), (1, 1, "user", "Well."), (1, 2, "user", "Well."), (1, 3, "user", "Cut")]
    got = turnrepair.repair(spark.createDataFrame(rows, KIND)).rows().orderBy("place").collect()
    assert [(r["fault"], r["role"]) for r in got] == [(0, "assistant"), (0, "user"), (3, "user"), (1, "user")]
    _, audit, _ = min(every_repair([r[2:] for r in rows], 1))
    assert "".join(r["letters"] for r in got) == audit


def test_repeated_rows_ties_and_very_long_texts(spark):
    long = "word " * 400_000 + "end."
    rows = [(1, 0, "user", "Same."), (1, 0, "user", "Same.")] * 20 + [(1, 1, "assistant", long), (1, 2, "user", long), (1, 3, "assistant", long)]
    got = turnrepair.repair(spark.createDataFrame(rows, KIND).repartition(3), 2).summary().collect()
    assert [tuple(r)[1:] for r in got] == [summary([r[1:] for r in rows])]
    assert got[0]["duplicate"] == 40


def test_damage(spark):
    rows = [(c, t, "assistant", "A. b! c?") for c in range(30) for t in range(4)] + [(None, None, None, None), (None, 1, "user", None)]
    want = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        part, role, text = zlib.crc32(key.encode()) % 20, " " if role is None else role, " " if text is None else text
        text = "" if part == 1 else re.sub("[.!?]", "", text) if part == 2 else text
        want += [(conv, turn, "user" if part == 4 else role, text)] * (0 if part == 0 else 2 if part == 3 else 1)
    got = turnrepair.damaged(spark.createDataFrame(rows, KIND)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_empty_table_and_clashing_names(spark):
    none = turnrepair.repair(spark.createDataFrame([], KIND))
    assert none.summary().collect() == none.costs.collect() == none.rows().collect() == []
    table = spark.createDataFrame([("b", 1, None, "x.", 1, 2)], "conv_id string, turn int, role string, text string, conv int, place int")
    got = turnrepair.repair(table).summary().collect()
    assert [(r["conv"], r["cost"], r["audit"]) for r in got] == [("b", 2, "D")]
