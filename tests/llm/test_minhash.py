import random

import numpy as np
import pytest

from sheaf.llm import graph, minhash


def brute(rows, size=5, percent=75):
    sets = {}
    for i, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        w = low.encode().split()
        sets[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    component = {i: i for i in sets}

    def root(i):
        while component[i] != i:
            i = component[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            a, b = sets[x], sets[y]
            if x < y and a and b and 100 * len(a & b) >= percent * len(a | b):
                p, q = sorted((root(x), root(y)))
                component[q] = p
    return sorted((i, len(sets[i]), root(i), root(i) == i) for i in ids)


def corpus(seed):
    pick = random.Random(seed)

    def some(k):
        return [f"w{pick.randrange(3000)}" for _ in range(k)]

    texts, line = [], some(25)
    for _ in range(12):
        base = some(pick.choice([6, 30, 80, 200]))
        for _ in range(pick.choice([1, 4, 12])):
            copy = list(base)
            for _ in range(pick.randrange(0, 1 + len(base) // 25)):
                copy[pick.randrange(len(copy))] = "edit%d" % pick.randrange(10**6)
            texts.append(" ".join(copy))
    texts += [" ".join(line + some(pick.randint(1, 40))) for _ in range(20)]
    texts += [texts[0], texts[0].upper(), None, "", " \n", None, "one two", "one two", "One\ttwo", "one", "É é"]
    pick.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("seed,block,hot", [(1, 1024, 1 << 18), (2, 7, 4), (3, 3, 1)])
def test_same_as_brute_force(spark, seed, block, hot):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = minhash.near_duplicates(docs, block_docs=block, hot=hot).collect()
    assert sorted(tuple(r) for r in got) == brute(rows)


def test_a_family_sends_about_one_edge_for_each_member(spark):
    base = [f"w{i}" for i in range(120)]
    texts = [" ".join([*base[:i], "edit", *base[i + 1 :]]) for i in range(0, 120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc long, text string").selectExpr("doc", "text", "unhex(md5(text)) tkey")
    classes = minhash.described(docs, 5, 16, 3).withColumnRenamed("doc", "num")
    for hot in (1 << 18, 10):
        edges = minhash.proposals(classes, 16, 3, 50, hot).collect()
        assert len(edges) <= 4 * len(texts)
        assert {r["component"] for r in graph.components(spark.createDataFrame(edges)).collect()} == {0}


def test_stars_join_the_same_nodes():
    pick = random.Random(5)
    for _ in range(50):
        edges = np.array([[pick.randrange(40), pick.randrange(40)] for _ in range(pick.randrange(0, 45))], np.int64).reshape(-1, 2)
        component = list(range(40))
        for a, b in edges.tolist() * 40:
            component[a] = component[b] = min(component[a], component[b])
        want = sorted([i, c] for i, c in enumerate(component) if c != i)
        assert sorted(minhash.stars(edges).tolist()) == want


def test_very_long_texts(spark):
    words = [f"w{i % 9973}x{i}" for i in range(300_000)]
    rows = [(3, " ".join(words)), (1, " ".join([*words[:-200], "other"])), (2, "x" * 2_000_000), (4, "word " * 200_000)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r["n_shingles"], r["component_id"]) for r in got] == [(299_797, 1), (1, 2), (299_996, 1), (1, 4)]


def test_one_row_of_each_component_stays(spark):
    rows = [(5, "a b c d e f", "p", 1), (5, "a b c d e f", "q", 2), (5, "A B c d e f", "r", 3), (6, "a b c d e f", "s", 4),
            (None, "a b c d e f", "t", 5), (None, "x y", "u", 6), (7, None, "v", 7), (7, None, "v", 7), (5, "something else", "w", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string, tkey int")
    got = minhash.one_of_each(docs)
    assert got.columns == docs.columns
    kept = sorted((r["doc_id"] or 0, r["text"] or "") for r in got.collect())
    assert kept[0] == (0, "x y") and kept[-2:] == [(7, ""), (7, "")] and len(kept) == 5
    assert (5, "something else") in kept and sum(t.lower() == "a b c d e f" for _, t in kept) == 1


def test_the_last_query_only_joins_the_rows_with_the_chosen_ones(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "A b c d e f"), (3, None)], "doc_id long, text string")
    got = minhash.one_of_each(docs)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1
    assert sorted(r["doc_id"] for r in got.collect()) == [1, 3]


def test_nulls_repeats_clashes_and_hot_copies(spark):
    rows = [(5, "a b c d e f", 1, 1)] * 30 + [(None, "a b c d e f", 1, 1), (None, "x y", 1, 1), (4, None, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, cid int, n int")
    got = [tuple(r) for r in minhash.near_duplicates(docs).collect()]
    assert got.count((5, 2, 5, True)) == 30
    assert sorted(map(str, set(got))) == sorted(
        map(str, [(5, 2, 5, True), (None, 2, 5, False), (None, 1, None, True), (4, 0, 4, True)])
    )


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(docs).collect() == []


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1100)] + [(7, 7), (5000, 4000)]
    random.Random(1).shuffle(edges)
    got = dict(tuple(r) for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {**{i: 0 for i in range(301)}, **{i: 1000 for i in range(1000, 1100)}, 4000: 4000, 5000: 4000}


def test_exact_threshold():
    sets = [np.arange(a, b, dtype=np.uint64) for a, b in ((0, 7), (1, 8), (0, 6), (100, 101))]
    at = np.arange(4)
    got = minhash.linked_pairs(sets, at, at, 75)
    assert got[0, 1] and got[0, 2] and not got[1, 2] and not got[0, 3]
