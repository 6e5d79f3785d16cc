import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheaf.operators import order_stats as o
from sheaf.operators.relevance import balance_classes, train_test


@pytest.mark.parametrize("wanted", [0, 1, 37, 199, 200, 250])
def test_hash_cut_is_exact(spark, wanted):
    rows = spark.range(200).withColumnRenamed("id", "k")
    chosen = o.hash_cut(rows, "k", 42, F.lit(wanted)).where("chosen")
    got = {r.k for r in chosen.collect()}
    order = sorted(range(200), key=lambda k: (hashlib.md5(f"{k}-42".encode()).hexdigest(), k))
    assert got == set(order[:wanted])


def test_hash_rank_numbers_all_rows(spark):
    ranks = [r["rank"] for r in o.hash_rank(spark.range(500), "id", 7).collect()]
    assert sorted(ranks) == list(range(1, 501))


def test_split_is_stable_under_partitioning(spark):
    rows = spark.range(300).withColumnRenamed("id", "k")
    few = {r.k for r in train_test(rows.coalesce(1), "k").where("is_test").collect()}
    many = {r.k for r in train_test(rows.repartition(8), "k").where("is_test").collect()}
    assert few == many and len(few) == 60


def test_balance_raises_when_short(spark):
    rows = spark.createDataFrame([(i, int(i < 5)) for i in range(12)], "k int, y int")
    with pytest.raises(Exception, match="too few"):
        balance_classes(rows, "k", "y").collect()


def test_running_last_with_hot_group(spark):
    rng = random.Random(3)
    rows = []
    for group, size in (("hot", 400), ("a", 30), ("b", 1)):
        for pos in range(size):
            rows.append((group, pos * 3, rng.choice([None, None, f"v{pos}"])))
    df = spark.createDataFrame(rows, "g string, p long, v string").repartition(7)
    out = o.running_last(df, ["g"], "p", F.col("v"), "upto", before="before", block=16)
    got = {(r.g, r.p): (r.upto, r.before) for r in out.collect()}
    for group in ("hot", "a", "b"):
        last = None
        for g, p, v in sorted(x for x in rows if x[0] == group):
            before, last = last, v if v is not None else last
            assert got[g, p] == (last, before)


def test_running_last_spans_empty_blocks(spark):
    rows = [("g", 0, "x"), ("g", 50, None), ("g", 1000, None), ("g", 1001, "y")]
    df = spark.createDataFrame(rows, "g string, p long, v string")
    out = o.running_last(df, ["g"], "p", F.col("v"), "last", block=10)
    assert [r["last"] for r in out.orderBy("p").collect()] == ["x", "x", "x", "y"]


@pytest.mark.parametrize("partitions", [1, 8])
def test_quantiles_match_numpy(spark, partitions):
    rng = np.random.default_rng(5)
    # A third of the values are one value, some differ in their last digits, a few are far out.
    near = 1.0 + np.arange(500) * 2.0**-52
    values = np.concatenate([rng.normal(size=3000), near, np.full(1500, 0.25), [1e300, -1e300, 5e-324, -5e-324, 0.0, -0.0, np.inf]])
    df = spark.createDataFrame([(float(v),) for v in values], "x double").repartition(partitions)
    probs = [0.0, 0.1, 0.5, 0.7, 0.85, 0.999, 0.9995]
    got = {r.prob: r.quantile for r in o.exact_quantiles(df, "x", probs).collect()}
    for p in probs:
        assert got[p] == pytest.approx(np.quantile(values, p), rel=1e-15, abs=0)
    plan = o.exact_quantiles(df, "x", probs)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_numbers_in_the_order_of_doubles(spark):
    values = sorted([0.0, -0.0, 1.0, -1.0, 1e-320, -1e-320, 1e308, -1e308, np.inf, -np.inf, np.pi])
    rows = spark.createDataFrame([(float(v),) for v in values], "x double").coalesce(1)
    got = [r[0] & ((1 << 64) - 1) for r in rows.select(o._ordered("x")).collect()]
    assert got == sorted(got) and len(set(got)) == len(values) - 1


def test_grouped_quantiles(spark):
    rows = [("a", float(i)) for i in range(10)] + [("b", 5.0)] + [("c", None), (None, 1.0), (None, 2.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {(r.g, r.prob): r.quantile for r in o.exact_quantiles(df, "x", [0.7], ["g"]).collect()}
    assert got == {("a", 0.7): pytest.approx(6.3), ("b", 0.7): 5.0, (None, 0.7): pytest.approx(1.7)}
    assert o.exact_quantiles(df.where("false"), "x", [0.5]).collect() == []


def test_first_and_last_values_skip_nulls(spark):
    rows = [("k", 1, None, "x"), ("k", 2, "b", None), ("k", 3, "c", None), (None, 4, "d", "z")]
    df = spark.createDataFrame(rows, "k string, i int, a string, b string")
    assert o.first_values(df, "k", "i", ["a", "b"]).collect() == [("k", "b", "x")]
    assert o.last_values(df, "k", "i", ["a", "b"]).collect() == [("k", "c", "x")]
