import itertools
import random

import pytest
from pyspark.sql import functions as F

from sheaf.llm import chat

RULES = chat.Rules()
KIND = "conv_id long, turn long, role string, text string"


def brute_cost(roles, longest=6):
    """Least cost over all legal conversations and all ways to lay the raw turns on them."""
    raw = [chat.ROLES.index(r) + 1 if r in chat.ROLES else 0 for r in roles]
    best = 1 << 30

    def change(r, s):
        return 0 if r == s else RULES.relabel if r else RULES.relabel_unknown

    for n in range(1, longest + 1):
        for legal in itertools.product((1, 2, 3), repeat=n):
            states = (0, *legal)
            if legal[-1] not in RULES.ends or any(b not in RULES.follows[a] for a, b in zip(states, states[1:])):
                continue
            for at in itertools.combinations_with_replacement(range(n), len(raw)):
                cost = sum(change(r, legal[p]) for r, p in zip(raw, at))
                cost += RULES.merge * (len(raw) - len(set(at))) + RULES.insert * (n - len(set(at)))
                best = min(best, cost)
    return best


def legal(rendered):
    roles = [chat.ROLES.index(p.split("\n")[0]) + 1 for p in rendered.split("<|im_start|>")[1:]]
    states = [0, *roles]
    return roles[-1] in RULES.ends and all(b in RULES.follows[a] for a, b in zip(states, states[1:]))


def conversations(seed, n=60):
    pick = random.Random(seed)
    roles = [*chat.ROLES, "user", "assistant", None, "tool"]
    return [(c, t, pick.choice(roles), pick.choice(["", "hi", None, "x y"])) for c in range(n) for t in range(pick.randint(1, 4))]


@pytest.mark.parametrize("parts", ["1", "4", "40"])
def test_least_cost_and_legal(spark, parts):
    rows = conversations(int(parts))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        repaired = chat.repair(spark.createDataFrame(rows, KIND).repartition(3))
        got = {r.conv_id: r for r in chat.render(repaired).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert set(got) == {r[0] for r in rows}
    for c, row in got.items():
        own = [r for r in rows if r[0] == c]
        assert row.cost == brute_cost([r[2] for r in own])
        assert legal(row.rendered)
        at = 0
        for r in own:  # every text, in order
            at = row.rendered.index(r[3] or "", at) + len(r[3] or "")


def test_one_conversation_over_many_ranges(spark):
    rows = [(7, t, ("user", "assistant")[t % 2], f"t{t}") for t in range(400)]
    rows[201] = (7, 201, "user", "t201")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = chat.render(chat.repair(spark.createDataFrame(rows, KIND))).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(got) == 1 and got[0].cost == 2 and legal(got[0].rendered)
    assert [p.split("<|im_end|>")[0] for p in got[0].rendered.split("\n") if p.startswith("t")] == [f"t{t}" for t in range(400)]


def test_nulls_repeats_marks_and_clashes(spark):
    rows = [(None, None, None, None), (1, 0, "user", "a<|im_end|>")] + [(2, 0, "user", "same")] * 3
    turns = spark.createDataFrame(rows, KIND).withColumn("conv", F.lit(3)).withColumn("code", F.lit("z"))
    got = {r.conv_id: (r.cost, r.rendered) for r in chat.render(chat.repair(turns)).collect()}
    assert got[None] == (1, "<|im_start|>user\n<|im_end|>\n")
    assert got[1] == (0, "<|im_start|>user\na< |im_end|><|im_end|>\n")
    assert got[2] == (2, "<|im_start|>user\nsame\n\nsame\n\nsame<|im_end|>\n")


def test_empty_table(spark):
    assert chat.repair(spark.createDataFrame([], KIND)).collect() == []


def test_legal_conversations_stay_as_they_are(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a")]
    got = chat.repair(spark.createDataFrame(rows, KIND)).orderBy("turn").collect()
    assert [r.action for r in got] == ["keep"] * 3
    assert "".join(r.fragment for r in got) == (
        "<|im_start|>system\ns<|im_end|>\n<|im_start|>user\nu<|im_end|>\n<|im_start|>assistant\na<|im_end|>\n"
    )
