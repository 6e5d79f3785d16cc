import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from sheaf.operators import modelling as M
from sheaf.operators import neighbours as N
from sheaf.operators import relevance as T


def vectors(spark, x, start=0):
    return spark.createDataFrame(
        [(start + i, [float(a) for a in v], float(i % 7)) for i, v in enumerate(x)],
        "id long, v array<double>, y double",
    )


@pytest.mark.parametrize("p", [1, 2])
def test_neighbours_match_brute_force(spark, p):
    rng = np.random.default_rng(1)
    # Half of the train rows sit in one dense spot; blocks are tiny.
    x = np.concatenate([rng.normal(size=(60, 3)) * 10, rng.normal(size=(60, 3)) * 0.1])
    q = np.concatenate([rng.normal(size=(15, 3)) * 10, x[:5]])
    out = N.nearest(
        vectors(spark, x), vectors(spark, q, 1000), "id", "id", "v", k=4, p=p, pivots=6, block_rows=16, query_rows=8
    )
    got = {}
    for r in out.collect():
        got.setdefault(r["id"], set()).add(r["neighbour"])
    for i, v in enumerate(q):
        gaps = np.abs(x - v).sum(axis=1) if p == 1 else np.sqrt(((x - v) ** 2).sum(axis=1))
        assert got[1000 + i] == set(np.lexsort((np.arange(len(x)), gaps))[:4])


def test_neighbours_with_fewer_rows_than_k(spark):
    out = N.nearest(vectors(spark, [[0, 0], [1, 1]]), vectors(spark, [[0, 0]], 9), "id", "id", "v", k=5)
    assert sorted(r["neighbour"] for r in out.collect()) == [0, 1]


def test_exact_match_decides_distance_weighting(spark):
    train = spark.createDataFrame([(0, [0.0], 3.0), (1, [1.0], 9.0)], "id long, v array<double>, y double")
    test = spark.createDataFrame([(5, [0.0])], "id long, v array<double>")
    out = N.knn_regression(train, test, "id", "id", "v", "y", k=2, weights="distance")
    assert out.first().prediction == 3.0


def test_tfidf_matches_the_smoothed_formula(spark):
    docs = spark.createDataFrame([(1, "aa bb aa"), (2, "bb cc x")], "id long, text string")
    got = {(r.id, r.term): r.tfidf for r in T.tfidf(docs, "id", "text").collect()}
    rare, common = np.log(3 / 2) + 1, 1.0
    norm = np.hypot(2 * rare, common)
    assert got[1, "aa"] == pytest.approx(2 * rare / norm)
    assert got[2, "bb"] == pytest.approx(common / np.hypot(rare, common))
    assert (2, "x") not in got


def test_ml_features_agree_with_the_long_form(spark):
    docs = spark.createDataFrame([(1, "aa bb aa"), (2, "bb cc cc dd"), (3, "aa dd")], "id long, text string")
    model = T.TfidfFeatures("text").fit(docs)
    words = model.stages[1].vocabulary
    dense = {
        (r.id, words[i]): v for r in model.transform(docs).collect() for i, v in enumerate(r.features.toArray()) if v
    }
    long = {(r.id, r.term): r.tfidf for r in T.tfidf(docs, "id", "text").collect()}
    assert dense == pytest.approx(long)


def test_adaboost_beats_the_mean(spark):
    rng = np.random.default_rng(2)
    rows = [(Vectors.dense([a, b]), float(a * 3 + np.sign(b))) for a, b in rng.normal(size=(300, 2))]
    data = spark.createDataFrame(rows, ["features", "label"])
    model = M.AdaBoostR2(rounds=4).fit(data)
    assert 1 <= len(model.trees) <= 4
    score = M.regression_metrics(model.transform(data)).first()
    assert score.R2 > 0.7


def test_weighted_median(spark):
    class Tree:
        def __init__(self, value):
            self.value = value

        def copy(self):
            return Tree(self.value)

        def setPredictionCol(self, name):
            self.name = name
            return self

        def transform(self, df):
            return df.withColumn(self.name, F.lit(self.value))

    model = M.AdaBoostR2Model("features", [Tree(1.0), Tree(5.0), Tree(9.0)], [1.0, 1.0, 3.0])
    assert model.transform(spark.range(1)).first().prediction == 9.0


def test_one_hot_ignores_unknown_values(spark):
    train = spark.createDataFrame([("b",), ("a",), (None,)], "c string")
    test = spark.createDataFrame([("b",), ("z",), (None,)], "c string")
    _, out, names = M.one_hot(train, test, "c")
    assert names == ["a", "b"]
    assert sorted(tuple(r.c_hot.toArray()) for r in out.collect()) == [(0, 0), (0, 0), (0, 1)]
    wide = spark.range(1500).select(F.col("id").cast("string").alias("c"))
    assert len(M.one_hot(wide, wide, "c")[2]) == 1500


def test_ridge_is_the_closed_form(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 2)) * [1, 30]
    y = x @ [3, 0.1] + 5 + rng.normal(size=200)
    rows = spark.createDataFrame([(Vectors.dense(a), float(b)) for a, b in zip(x, y)], ["features", "label"])
    xc, yc = x - x.mean(axis=0), y - y.mean()
    for alpha in (1.0, 100.0):
        want = np.linalg.solve(xc.T @ xc + alpha * np.eye(2), xc.T @ yc)
        ridge = M.regressors(scale=alpha * M.ridge_scale(rows))["Ridge"].fit(rows)
        assert ridge.coefficients.toArray() == pytest.approx(want, rel=1e-6)


def test_categories_and_weights_come_from_the_train_side(spark):
    rows = spark.createDataFrame([(1.0, "a", True), (2.0, "b", True), (3.0, "z", False)], "x double, c string, train boolean")
    vectors = M.assembled(rows, ["x"], ["c"], train=F.col("train")).collect()
    assert {len(r.features) for r in vectors} == {4}
    labels = spark.createDataFrame([(1, True), (0, True), (0, True), (0, True), (1, False)], "y int, train boolean")
    weights = T.class_weights(labels, "y", train=F.col("train")).where("y = 1").first().weight
    assert weights == 2.0


def test_confusion_with_an_empty_class(spark):
    rows = spark.createDataFrame([(1, 1), (1, 0)], "y int, p int")
    row = T.confusion(rows, "y", "p").first()
    assert (row.tp, row.fn, row.ber) == (1, 1, 0.75)


def test_seeds_are_distinct(spark):
    seeds = M.seeds(spark, 100)
    assert len(set(seeds)) == 100 and all(0 <= s < 1000 for s in seeds)


def test_clusters_are_shared(spark):
    train = spark.createDataFrame([(0, 0), (1, 1), (0, 1), (1, 0)] * 5, "a int, b int")
    left, right = M.flag_clusters(train, train.limit(8), ("a", "b"), k=4)
    ids = {(r.a, r.b): r.cluster for r in left.collect()}
    assert all(ids[r.a, r.b] == r.cluster for r in right.collect())


def test_knn_search_prefers_the_shape_of_the_data(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(120, 2))
    rows = spark.createDataFrame(
        [(i, [float(a), float(b)], float(a + b)) for i, (a, b) in enumerate(x)], "id long, v array<double>, y double"
    )
    scores = N.knn_search(rows, "id", "v", "y", ks=(1, 5), ps=(2,), folds=2).collect()
    assert len(scores) == 4
    by = {(r.k, r.weights): r.R2 for r in scores}
    assert by[1, "uniform"] == pytest.approx(by[1, "distance"])
    assert all(0.5 < v <= 1 for v in by.values())


def test_knn_model_has_the_shared_interface(spark):
    data = spark.createDataFrame([(i, Vectors.dense([float(i)]), float(i)) for i in range(10)], ["id", "features", "label"])
    scored = N.KnnRegressor(k=1).fit(data).transform(data)
    assert M.regression_metrics(scored).first().R2 == 1.0


def test_grids_hold_the_reference_values():
    from sheaf.operators import modelling, relevance

    def sizes(grids):
        return {name: len(grid) for name, (_, grid) in grids.items()}

    def values(grids, model, param):
        estimator, grid = grids[model]
        return sorted({g[getattr(estimator, param)] for g in grid})

    c, r = relevance.classifier_grids(1), modelling.regressor_grids()
    assert sizes(c) == {"Logistic Regression": 15, "Naive Bayes": 5, "SVM": 30, "Random Forest": 27, "Gradient Boosting": 27}
    assert sizes(r) == {"Random Forest": 54, "Gradient Boosting": 27, "Ridge": 4, "Lasso": 8}
    assert values(c, "SVM", "regParam") == pytest.approx([0.01, 0.1, 1, 10, 100])
    assert values(c, "Gradient Boosting", "maxIter") == [50, 100, 200]
    assert values(r, "Ridge", "regParam") == [0.1, 1, 10, 100]


def test_importances_are_those_of_the_whole_model(spark, monkeypatch):
    from sheaf.plans import modelling

    class Whole:
        def fit(self, rows):
            return self

    whole = Whole()
    monkeypatch.setattr(modelling.M, "assembled", lambda *_: None)
    monkeypatch.setattr(modelling.M, "regressors", lambda: {"Gradient Boosting": whole})
    monkeypatch.setattr(modelling.M, "importances", lambda model, *_, **__: model)
    from sheaf.plans.registry import QUERIES

    assert QUERIES["m15_feature_importance"](spark, "/root/testdata/sf0.001") is whole


def test_weighted_centres_of_distinct_points():
    points = np.array([[0.0, 0], [0, 1], [1, 0], [1, 1], [10, 10], [10, 11]])
    weights = np.array([5.0, 1, 1, 1, 2, 2])
    assert M.weighted_centres(points, weights, 6).tolist() == sorted(points.tolist())
    assert M.weighted_centres(points, weights, 2) == pytest.approx(np.array([[0.25, 0.25], [10, 10.5]]))


def test_flags_cluster_alike_on_both_sides(spark):
    train = spark.createDataFrame([(0, 1), (1, 1), (0, 1), (1, 0)], "a int, b int")
    test = spark.createDataFrame([(0, 0), (1, 1), (None, 1)], "a int, b int")
    own, other = M.flag_clusters(train, test, ("a", "b"))
    assert [r.cluster for r in own.collect()] == [0, 2, 0, 1]
    assert [r.cluster for r in other.collect()] == [0, 2, 0]
    assert [r.cluster for r in M.flag_clusters(train.where("false"), test, ("a", "b"))[1].collect()] == [None] * 3


def test_grids_fit_once_what_has_converged(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 2))
    rows = [(Vectors.dense(a), float(a[0] + a[1] / 2 > 0.1), 1.0) for a in x]
    df = spark.createDataFrame(rows, ["features", "label", "weight"]).coalesce(1)
    for name in ("Logistic Regression", "SVM"):
        estimator, grid = T.classifier_grids(60)[name]
        steps = [10, 100, 500]
        grid = [{estimator.regParam: 0.5, estimator.maxIter: n} for n in steps]
        fits, plain = [], type(estimator)._fit
        monkeypatch.setattr(type(estimator), "_fit", lambda self, d, plain=plain, fits=fits: fits.append(1) or plain(self, d))
        models = dict(estimator.fitMultiple(df, grid))
        assert sorted(models) == [0, 1, 2] and len(fits) < 3
        assert models[2].coefficients == plain(estimator.copy(grid[2]), df).coefficients


def test_visits_are_sent_on_in_parts(spark, monkeypatch):
    rng = np.random.default_rng(3)
    train, test = vectors(spark, rng.normal(size=(80, 3)).tolist()), vectors(spark, rng.normal(size=(30, 3)).tolist(), 1000)
    want = sorted(map(tuple, N.nearest(train, test, "id", "id", "v", k=4, block_rows=2).collect()))
    monkeypatch.setattr(N, "VISIT_ROWS", 7)
    assert sorted(map(tuple, N.nearest(train, test, "id", "id", "v", k=4, block_rows=2).collect())) == want


def test_a_query_is_sent_once_to_cells_that_share_a_block(spark, monkeypatch):
    tables, real = {}, N.written

    def kept(df, name):
        tables[name] = real(df, name)
        return tables[name]

    monkeypatch.setattr(N, "written", kept)
    x = np.random.default_rng(6).normal(size=(200, 8))
    out = N.nearest(vectors(spark, x[:160]), vectors(spark, x[160:], 1000), "id", "id", "v", k=4, pivots=16)
    assert out.count() == 160
    assert tables["knn-visits"].count() == 40


@pytest.mark.parametrize("scale", [1.0, 1e-9, 1e35, 1e100])
def test_neighbours_are_exact_whatever_rough_distances_lose(spark, scale):
    x = (np.random.default_rng(7).normal(size=(90, 5)) * 1e-4 + 1000) * scale
    train, test = vectors(spark, x[:80]), vectors(spark, x[80:], 1000)
    for p in (1, 2):
        near = N.nearest(train, test, "id", "id", "v", k=3, p=p, pivots=4, block_rows=30).collect()
        got = {(r["id"], r["place"]): r["neighbour"] for r in near}
        for i, v in enumerate(x[80:]):
            gaps = np.abs(x[:80] - v).sum(axis=1) if p == 1 else np.sqrt(((x[:80] - v) ** 2).sum(axis=1))
            assert [got[1000 + i, place] for place in (1, 2, 3)] == np.lexsort((np.arange(80), gaps))[:3].tolist()


def test_a_fold_leaves_nothing_on_disk(spark):
    from sheaf.session import intermediates

    x = np.random.default_rng(8).normal(size=(60, 2))
    rows = spark.createDataFrame([(i, [float(a), float(b)], float(a)) for i, (a, b) in enumerate(x)], "id long, v array<double>, y double")
    before = set(intermediates(spark))
    assert len(N.knn_search(rows, "id", "v", "y", ks=(1, 3), folds=3).collect()) == 8
    assert [p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in intermediates(spark) if p not in before] == ["knn-folds"]


def test_folds_at_once_are_those_of_the_plain_search(spark):
    from pyspark.ml.tuning import CrossValidator

    rng = np.random.default_rng(9)
    rows = [(Vectors.dense(a), float(a[0] - a[1] + rng.normal() > 0), 1.0) for a in rng.normal(size=(200, 2))]
    df = spark.createDataFrame(rows, ["features", "label", "weight"]).repartition(3).localCheckpoint()
    estimator, grid = T.classifier_grids(200)["Logistic Regression"]
    found = T.grid_search(df, estimator, grid[::4], folds=3)
    judge = T.MulticlassClassificationEvaluator(labelCol="label", metricName="accuracy")
    plain = CrossValidator(estimator=estimator, estimatorParamMaps=grid[::4], evaluator=judge, numFolds=3, seed=42, parallelism=2).fit(df)
    assert found.avgMetrics == pytest.approx(plain.avgMetrics) and found.stdMetrics == pytest.approx(plain.stdMetrics)
    assert found.bestModel.coefficients == plain.bestModel.coefficients
