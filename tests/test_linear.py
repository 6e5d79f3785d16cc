import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from sheaf.functions.hashes import md5_heads
from sheaf.operators import linear
from sheaf.operators.relevance import train_test


def table(spark, n=400, seed=1):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.normal(1000, 1, n), rng.normal(size=n), rng.integers(0, 2, n), np.zeros(n)])
    x = np.column_stack([x, 1 - x[:, 2]])  # two marks that add up to one
    y = 3 * x[:, 0] - 2 * x[:, 1] + 5 * x[:, 2] + rng.normal(size=n)
    rows = [(i, Vectors.dense(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, ["id", "features", "label"]).repartition(5), x, y


def test_marks_are_those_of_single_splits(spark):
    df = spark.range(503)
    seeds = [42, 7, 900]
    marked = {r.id: r.is_test for r in linear.split_marks(df, "id", seeds).collect()}
    for k, seed in enumerate(seeds):
        own = {r.id: r.is_test for r in train_test(df, "id", seed=seed).collect()}
        assert {i: m[k] for i, m in marked.items()} == own and sum(own.values()) == 101
    assert linear.split_marks(spark.range(0), "id", seeds).collect() == []


def test_fits_and_metrics_are_those_of_plain_numpy(spark):
    df, x, y = table(spark)
    seeds = list(range(12))
    metrics, fits = linear.repeated_fits(df, "id", seeds)
    got = {(r.Model, r.Seed): (r.R2, r.MAE, r.MSE) for r in metrics.collect()}
    assert len(got) == 36
    for seed in seeds:
        held = np.zeros(len(y), bool)
        held[[r.id for r in train_test(df.select("id"), "id", seed=seed).where("is_test").collect()]] = True
        a, b = x[~held], y[~held]
        centred, target = a - a.mean(axis=0), b - b.mean()
        best = np.linalg.lstsq(centred, target, rcond=1e-10)[0]
        steep = np.linalg.solve(centred.T @ centred + np.eye(5), centred.T @ target)
        for name, w in (("Linear Regression", best), ("Ridge", steep), ("Lasso", fits["Lasso", seed][1])):
            intercept, own = fits[name, seed]
            assert centred @ own == pytest.approx(centred @ w, abs=1e-6)
            missed = y[held] - (x[held] @ own + intercept)
            wanted = 1 - (missed**2).sum() / ((y[held] - y[held].mean()) ** 2).sum(), np.abs(missed).mean(), (missed**2).mean()
            assert got[name, seed] == pytest.approx(wanted, rel=1e-6)
        # The optimum of the lasso, by its conditions.
        w = fits["Lasso", seed][1]
        slope = centred.T @ (target - centred @ w) / len(b)
        assert (np.abs(slope) <= 1 + 1e-6).all() and slope[w != 0] == pytest.approx(np.sign(w[w != 0]), abs=1e-6)
        assert w[3] == 0


def test_a_category_that_the_train_side_lacks_has_no_weight(spark):
    rows = [(i, Vectors.dense([float(i % 7), 1.0 if i == 3 else 0.0]), float(2 * (i % 7))) for i in range(50)]
    df = spark.createDataFrame(rows, ["id", "features", "label"])
    marks = [r.id for r in train_test(df.select("id"), "id", seed=5).where("is_test").collect()]
    odd = next(s for s in range(200) if 3 in [r.id for r in linear.split_marks(df.select("id"), "id", [s]).where(F.col("is_test")[0]).collect()])
    _, fits = linear.repeated_fits(df, "id", [odd])
    assert len(marks) == 10 and fits["Linear Regression", odd][1] == pytest.approx([2.0, 0.0])


def test_empty_table_and_null_labels(spark):
    df, _, _ = table(spark, 30)
    none, fits = linear.repeated_fits(df.where("false"), "id", [1, 2])
    assert none.collect() == [] and fits == {}
    some = df.withColumn("label", F.when(F.col("id") > 3, F.col("label")))
    metrics, _ = linear.repeated_fits(some, "id", [1])
    assert metrics.count() == 3


def test_even_hashes_need_no_second_count(spark, monkeypatch):
    seeds, df = [3, 42, 77], spark.range(20_000)
    want = {s: {r.id for r in train_test(df, "id", seed=s).where("is_test").collect()} for s in seeds}
    monkeypatch.setattr(linear, "_ranked_cuts", None)
    marked = linear.split_marks(df, "id", seeds).collect()
    assert {s: {r.id for r in marked if r.is_test[k]} for k, s in enumerate(seeds)} == want


def test_cuts_outside_the_stretch_are_found_by_rank(spark):
    # One id holds a third of the rows, so its side moves the cut far away.
    seeds = list(range(12))
    df = spark.range(900).unionByName(spark.range(450).select(F.lit(5).cast("long").alias("id"))).repartition(5)
    marked = linear.split_marks(df, "id", seeds).groupBy("id").agg(F.first("is_test").alias("is_test"), F.count("*").alias("n")).collect()
    for k, s in enumerate(seeds):
        rows = sorted((hashlib.md5(f"{r.id}-{s}".encode()).hexdigest(), r.id, r.n, r.is_test[k]) for r in marked)
        before = 0
        for _, _, n, is_test in rows:
            assert is_test == (before < 270)
            before += n


def test_rows_without_an_id_have_no_mark(spark):
    seeds, n = [1, 2, 3], 40
    df = spark.range(n).select(F.when(F.col("id") > 2, F.col("id")).alias("id")).repartition(3)
    rows = linear.split_marks(df, "id", seeds).collect()
    assert [r.is_test for r in rows if r.id is None] == [[None] * 3] * 3
    # Nulls come first among the eight that a cut takes.
    assert [sum(r.is_test[k] for r in rows if r.id is not None) for k in range(3)] == [5] * 3


def test_heads_are_those_of_md5():
    names = ["", "7", "x" * 51, "x" * 52, "é" * 40, *map(str, range(0, 900, 7))]
    tails = ["-1", "-42", "-100000"]
    got = md5_heads(pa.array(names), tails)
    assert got.tolist() == [[int(hashlib.md5((n + t).encode()).hexdigest()[:8], 16) for t in tails] for n in names]


def test_packed_marks_are_the_marks(spark):
    ids = [*range(400), *[10**k for k in range(3, 12)], 7, 7, None]
    df = spark.createDataFrame([(i,) for i in ids], "id long").repartition(3).localCheckpoint()
    seeds = list(range(30))
    plain = sorted((str(r.id), r.is_test) for r in linear.split_marks(df, "id", seeds).collect())
    packed = sorted((str(r.id), [{0: False, 1: True, 255: None}[b] for b in r.is_test]) for r in linear.split_marks(df, "id", seeds, packed=True).collect())
    assert packed == plain and len(plain) == len(ids)
    assert sum(m is None for _, marks in plain for m in marks) == len(seeds)


def test_names_of_many_lengths_are_hashed_alike():
    names = [str(10**k + i) for i in range(9) for k in range(1, 60, 3)] + ["", "ä€"]
    tails = ["-1", "-22", "-" + "9" * 20, ""]
    want = [[int(hashlib.md5((n + t).encode()).hexdigest()[:8], 16) for t in tails] for n in names]
    assert md5_heads(pa.array(names), tails).tolist() == want
    assert md5_heads(pa.array(names).slice(5, 40), tails).tolist() == want[5:45]
