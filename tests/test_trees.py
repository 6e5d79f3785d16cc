import numpy as np
import pytest
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.ml.regression import GBTRegressor

from sheaf.operators import modelling as M
from sheaf.operators import trees as TR


def rows(spark, n, parts=3, seed=3):
    """Two numbers, one with zeros, and the marks of three categories."""
    rng = np.random.default_rng(seed)
    a, b, c = rng.normal(size=n), rng.integers(0, 40, n) / 4, rng.integers(0, 3, n)
    y = np.sin(a) + b * (c == 1) + rng.normal(size=n)
    data = spark.createDataFrame(
        [tuple(map(float, r)) for r in zip(a, b, c, y)], "a double, b double, c double, label double"
    ).repartition(parts)
    hot = OneHotEncoder(inputCol="c", outputCol="h", dropLast=False).fit(data).transform(data)
    out = VectorAssembler(inputCols=["a", "b", "h"], outputCol="features").transform(hot).select("features", "label")
    return out.localCheckpoint()


@pytest.mark.parametrize("n", [300, 12_000, 40_000])
def test_boosting_on_cells_is_boosting_of_all_rows(spark, monkeypatch, n):
    data = rows(spark, n)
    params = {"labelCol": "label", "maxIter": 6, "maxDepth": 3, "stepSize": 0.1, "seed": 42}
    whole = GBTRegressor(**params).fit(data)
    monkeypatch.setattr(GBTRegressor, "_fit_java", lambda *_: pytest.fail("fitted on rows"))
    model = M.regressors()["Gradient Boosting"].copy()
    own = model.copy({model.maxIter: 6}).fit(data)
    assert own.featureImportances.toArray() == pytest.approx(whole.featureImportances.toArray(), abs=1e-9)
    some = data.limit(500)
    got, want = ([r.prediction for r in m.transform(some).select("prediction").collect()] for m in (own, whole))
    assert got == pytest.approx(want, abs=1e-9)


def test_rows_that_no_cell_stands_for_go_to_the_plain_trees(spark, monkeypatch):
    data = rows(spark, 200)
    monkeypatch.setattr(TR, "MAX_CELLS", 10)
    model = TR.BoostedTrees(maxIter=2, maxDepth=2, seed=1).fit(data)
    assert isinstance(model, type(GBTRegressor(maxIter=2, maxDepth=2, seed=1).fit(data)))


def test_importances_of_the_query_come_from_cells(spark, monkeypatch, tmp_path):
    from sheaf.plans.registry import QUERIES

    n = 6000
    rng = np.random.default_rng(5)
    lines = [
        (i, 1, float(rng.integers(1, 51)), float(rng.integers(0, 11)) / 100, float(rng.integers(0, 9)) / 100, "ANR"[i % 3], float(rng.normal()) * 1000)
        for i in range(n)
    ]
    kind = "l_orderkey long, l_linenumber int, l_quantity double, l_discount double, l_tax double, l_returnflag string, l_extendedprice double"
    spark.createDataFrame(lines, kind).write.parquet(f"{tmp_path}/lineitem.parquet")
    want = sorted(map(tuple, _whole(spark, tmp_path).collect()))
    monkeypatch.setattr(GBTRegressor, "_fit_java", lambda *_: pytest.fail("fitted on rows"))
    got = sorted(map(tuple, QUERIES["m15_feature_importance"](spark, str(tmp_path)).collect()))
    assert [r[0] for r in got] == [r[0] for r in want] and len(got) == 6
    assert [r[1] for r in got] == pytest.approx([r[1] for r in want], abs=1e-9)


def _whole(spark, folder):
    from sheaf.plans import modelling as P
    from sheaf.plans.registry import Tables

    rows = M.assembled(Tables(spark, str(folder)).derive(P.MODEL_ROWS), P.NUMERIC, ("l_returnflag",))
    model = GBTRegressor(labelCol="label", maxIter=100, maxDepth=3, stepSize=0.1, seed=42).fit(rows)
    return M.importances(model, rows, derived=("l_tax",), names={"l_quantity": "Quantity"})


@pytest.mark.parametrize("n", [500, 15_000])
def test_weighted_rounds_on_cells_are_those_of_rows(spark, monkeypatch, n):
    from sheaf.session import intermediates

    data = rows(spark, n, parts=1)
    boost = M.AdaBoostR2(rounds=6)
    whole = boost._on_rows(data)
    before = set(intermediates(spark))
    monkeypatch.setattr(M.AdaBoostR2, "_on_rows", lambda *_: pytest.fail("fitted on rows"))
    model = boost.fit(data)
    assert model.strengths == pytest.approx(whole.strengths, rel=1e-9) and len(model.strengths) == 6
    # Blocks of earlier rounds are gone.
    assert len(set(intermediates(spark)) - before) == 1
    some = data.limit(300)
    got, want = ([r.prediction for r in m.transform(some).select("prediction").collect()] for m in (model, whole))
    assert got == pytest.approx(want, abs=1e-9)


def test_weighted_rounds_end_with_a_tree_that_misses_nothing(spark):
    from pyspark.ml.linalg import Vectors

    data = spark.createDataFrame([(Vectors.dense([float(i % 2)]), float(i % 2)) for i in range(8)], ["features", "label"])
    model = M.AdaBoostR2(rounds=3).fit(data)
    assert model.strengths == [1.0]
    assert [r.prediction for r in model.transform(data).collect()] == [0.0, 1.0] * 4
