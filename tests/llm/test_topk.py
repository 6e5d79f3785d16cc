import math
import random

import pytest

from sheaf.llm import topk


def brute(rows, k, is_query):
    rows = {i: v for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    rows = {i: [math.floor(1024 * x) for x in v] for i, v in rows.items()}
    out = []
    for q, a in rows.items():
        if is_query(q):
            found = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in rows.items() if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return sorted(out)


def vectors(n):
    pick = random.Random(n)
    rows = [(i, [pick.choice([0.0, 0.25, -0.5, pick.gauss(0, 1)]) for _ in range(6)]) for i in range(n)]
    rows += [(n + i, list(rows[0][1])) for i in range(15)]
    return rows + [(n + 20, None), (n + 21, [1.0, None]), (n + 22, [float("nan")] * 6), (n + 23, [float("inf")] * 6),
                   (None, [1.0] * 6), (n + 24, []), (n + 25, [0.0] * 6)]


@pytest.mark.parametrize("blocks", [(16_384, 16_384), (16, 3)])
def test_same_as_brute_force(spark, blocks):
    rows = vectors(90)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    own = topk.quantized(table, "vec_id", "embedding", 1024)
    got = topk.search(own.filter("id % 10 = 0"), own, 7, *blocks).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, 7, lambda i: i % 10 == 0)


def test_few_candidates_repeats_and_clashes(spark):
    rows = [(0, [1.0], 5)] * 3 + [(1, [1.0], 5), (2, [0.5], 5)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, id int")
    own = topk.quantized(table, "vec_id", "embedding", 1024)
    got = topk.search(own.filter("id = 0"), own, 10).orderBy("rank").collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 1 << 20), (0, 2, 2, 1 << 19)]


def test_empty_table(spark):
    own = topk.quantized(spark.createDataFrame([], "vec_id long, embedding array<float>"), "vec_id", "embedding", 1024)
    assert topk.search(own, own, 10).collect() == []


def test_sparse_rows(spark):
    kind = "id long, entries array<struct<term:bigint,weight:bigint>>"
    queries = spark.createDataFrame([(1, [(7, 2), (9, 1)])], kind)
    candidates = spark.createDataFrame([(2, [(9, 5)]), (3, [(8, 100)]), (4, [(7, -1)])], kind)
    got = topk.search(queries, candidates, 3).orderBy("rank").collect()
    assert [(r.id, r.score) for r in got] == [(2, 5), (3, 0), (4, -2)]


@pytest.mark.parametrize("blocks", [(16_384, 16_384), (3, 1)])
def test_repeated_candidates_are_all_found(spark, blocks):
    rows = [(0, [1.0]), (1, [0.5]), (1, [3.0]), (1, [3.0]), (2, [2.0])]
    own = topk.quantized(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "vec_id", "embedding", 1024)
    got = topk.search(own.filter("id = 0"), own, 3, *blocks).orderBy("rank").collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 3 << 20), (0, 2, 1, 3 << 20), (0, 3, 2, 2 << 20)]


@pytest.mark.parametrize("blocks", [(16_384, 16_384), (2, 1)])
def test_by_row_only_the_own_row_is_left_out(spark, blocks):
    rows = [(0, [1.0]), (0, [1.0]), (0, [4.0]), (1, [0.5]), (None, [3.0]), (None, None), (2, [-1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    own = topk.quantized(table, "vec_id", "embedding", 1024)
    got = topk.search(own.filter("id = 0"), own, 3, *blocks, by_row=True).collect()
    small = [(0, 1, 0, 4 << 20), (0, 2, None, 3 << 20), (0, 3, 0, 1 << 20)]
    large = [(0, 1, None, 12 << 20), (0, 2, 0, 4 << 20), (0, 3, 0, 4 << 20)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, small * 2 + large))


def test_query_takes_every_row(spark, tmp_path):
    from sheaf.llm.queries import QUERIES

    rows = [(100, [1.0]), (100, [1.0]), (None, [3.0]), (7, [2.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = QUERIES["op8_exact_topk"](spark, str(tmp_path)).collect()
    one = [(100, 1, None, 3 << 20), (100, 2, 7, 2 << 20), (100, 3, 100, 1 << 20)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, one * 2))
