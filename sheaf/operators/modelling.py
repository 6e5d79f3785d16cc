"""Regression on the merged table: features, models, repeated splits."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import (
    DecisionTreeRegressor,
    LinearRegression,
    RandomForestRegressor,
)
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.functions import chemistry
from sheaf.operators.neighbours import KnnRegressor
from sheaf.operators.order_stats import hash_key
from sheaf.operators.relevance import train_test
from sheaf.operators.trees import MAX_CELLS, BoostedTrees, CellRows, Round, Tree, WeightedRows, grow, matrix
from sheaf.session import written

def one_hot(
    train: DataFrame, test: DataFrame, column: str
) -> tuple[DataFrame, DataFrame, list[str]]:
    """Indicator vector ``<column>_hot`` of the train categories on both sides.

    The categories come third, in the order of the vector, which is sparse: a
    column of many values costs no more columns. A category the train side
    lacks, and null, is 0 everywhere.
    """
    index = StringIndexer(
        inputCol=column, outputCol="_index", handleInvalid="keep", stringOrderType="alphabetAsc"
    ).fit(train.where(F.col(column).isNotNull()))
    # The last index, that of unknown values, is the one left out of the vector.
    every = train.sparkSession.range(len(index.labels) + 1).select(F.col("id").cast("double").alias("_index"))
    hot = OneHotEncoder(inputCol="_index", outputCol=f"{column}_hot", dropLast=True).fit(every)
    sides = (hot.transform(index.transform(side)).drop("_index", column) for side in (train, test))
    return (*sides, index.labels)


def structure_flags(df: DataFrame, smiles: str) -> DataFrame:
    s = F.col(smiles)
    return df.withColumns(
        {
            "organic": chemistry.is_organic(s),
            "functional_group_rich": chemistry.is_functional_rich(s),
        }
    )


def weighted_centres(points: np.ndarray, weights: np.ndarray, k: int, rounds: int = 100) -> np.ndarray:
    """Centres of weighted k-means over distinct points, in ascending order.

    At most ``k`` points are their own centres. Otherwise the heaviest point
    starts, each next one is the point that costs most, and means are taken
    until nothing moves.
    """
    order = np.lexsort(points.T[::-1])
    points, weights = points[order], weights[order]
    if len(points) <= k:
        return points
    centres = points[[int(np.argmax(weights))]]
    while len(centres) < k:
        far = ((points[:, None] - centres) ** 2).sum(axis=2).min(axis=1)
        centres = np.vstack([centres, points[int(np.argmax(far * weights))]])
    for _ in range(rounds):
        own = ((points[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)
        moved = np.array([
            np.average(points[own == c], axis=0, weights=weights[own == c]) if (own == c).any() else centres[c] for c in range(k)
        ])
        if np.array_equal(moved, centres):
            break
        centres = moved
    return centres[np.lexsort(centres.T[::-1])]


def flag_clusters(
    train: DataFrame, test: DataFrame, columns: Sequence[str], k: int = 4
) -> tuple[DataFrame, DataFrame]:
    """k-means fitted on train; both sides get ids of the same clusters.

    ``columns`` are flags, so there are few distinct points: they are counted,
    and the fit works on the points and their counts. A row belongs to the
    nearest centre, of equally near ones to the first. A null flag counts as 0.
    """
    flags = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns]
    counted = train.groupBy(*[f.alias(c) for f, c in zip(flags, columns, strict=True)]).count().collect()
    points = np.array([r[:-1] for r in counted], np.float64).reshape(len(counted), len(columns))
    centres = weighted_centres(points, np.array([r["count"] for r in counted], np.float64), k)
    far = [
        F.struct(sum(((f - float(v)) * (f - float(v)) for f, v in zip(flags, c, strict=True)), F.lit(0.0)).alias("far"), F.lit(i).alias("i"))
        for i, c in enumerate(centres)
    ]
    cluster = F.array_min(F.array(*far))["i"] if far else F.lit(None).cast("int")
    return tuple(side.withColumn("cluster", cluster) for side in (train, test))


def molecule_features(df: DataFrame, smiles: str) -> DataFrame:
    """Counts read from the line notation, computed once per distinct text.

    Rows without a notation get nulls.
    """
    s = F.col(smiles)
    features = (
        df.select(smiles)
        .where(s.isNotNull() & (s != ""))
        .distinct()
        .withColumns(
            {
                "heavy_atoms": chemistry.heavy_atoms(s),
                "hetero_atoms": chemistry.hetero_atoms(s),
                "rings": chemistry.rings(s),
            }
        )
    )
    return df.join(features, smiles, "left")


def assembled(
    df: DataFrame,
    numeric: Sequence[str],
    categorical: Sequence[str] = (),
    out: str = "features",
    train: Column | None = None,
) -> DataFrame:
    """Feature vector; rows with a null feature are dropped.

    Categories are learnt from the rows where ``train`` holds (all by default);
    others share one place.
    """
    whole = df.dropna(subset=[*numeric, *categorical])
    stages = []
    for c in categorical:
        stages.append(StringIndexer(inputCol=c, outputCol=f"_{c}_i", handleInvalid="keep"))
        stages.append(OneHotEncoder(inputCol=f"_{c}_i", outputCol=f"_{c}_v", dropLast=False))
    inputs = [*numeric, *[f"_{c}_v" for c in categorical]]
    stages.append(VectorAssembler(inputCols=inputs, outputCol=out))
    model = Pipeline(stages=stages).fit(whole if train is None else whole.where(train))
    extra = [x for c in categorical for x in (f"_{c}_i", f"_{c}_v")]
    return model.transform(whole).drop(*extra)


def sample_ids(df: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` distinct ids without replacement (a top-k by hash)."""
    ids = df.select(id_col).distinct()
    return ids.orderBy(hash_key(id_col, seed), id_col).limit(n)


def seeds(spark: SparkSession, n: int = 100, upto: int = 1_000, seed: int = 42) -> list[int]:
    """``n`` distinct split seeds below ``upto``."""
    chosen = sample_ids(spark.range(upto), "id", n, seed)
    return [row[0] for row in chosen.collect()]


def ridge_scale(train: DataFrame, label: str = "label") -> float:
    """What a ridge penalty on the sum of squares is multiplied by for Spark.

    Spark's loss is a mean, and its penalty is taken on the label in units of
    its standard deviation.
    """
    n, spread = train.agg(F.count(label), F.stddev_pop(label)).first()
    return (spread or 1.0) / max(n, 1)


def regressors(label: str = "label", seed: int = 42, scale: float = 1.0) -> dict[str, object]:
    """The estimators; ``scale`` is ``ridge_scale`` of the rows they will be fitted on."""
    plain = {"labelCol": label, "standardization": False}
    return {
        "Random Forest": RandomForestRegressor(labelCol=label, numTrees=100, seed=seed),
        "Linear Regression": LinearRegression(**plain),
        "Ridge": LinearRegression(**plain, regParam=scale, elasticNetParam=0.0),
        "Lasso": LinearRegression(**plain, regParam=1.0, elasticNetParam=1.0),
        "Gradient Boosting": BoostedTrees(labelCol=label, maxIter=100, maxDepth=3, stepSize=0.1, seed=seed),
        "AdaBoost": AdaBoostR2(label=label, seed=seed),
        "K-Nearest Neighbors": KnnRegressor(label=label),
    }


def regressor_grids(label: str = "label", scale: float = 1.0) -> dict[str, tuple[object, list]]:
    """Estimator and parameter grid by model name; a depth without limit is 30, the most a tree can have here."""
    models = regressors(label, scale=scale)
    rf, gbt = models["Random Forest"], models["Gradient Boosting"]
    ridge, lasso = models["Ridge"], models["Lasso"]
    penalties, trees = [0.1, 1.0, 10.0, 100.0], [100, 200, 500]
    return {
        "Random Forest": (
            rf,
            ParamGridBuilder()
            .addGrid(rf.numTrees, trees)
            .addGrid(rf.maxDepth, [10, 20, 30])
            .addGrid(rf.minInstancesPerNode, [1, 2, 4])
            .addGrid(rf.bootstrap, [True, False])
            .build(),
        ),
        "Gradient Boosting": (
            gbt,
            ParamGridBuilder()
            .addGrid(gbt.maxIter, trees)
            .addGrid(gbt.maxDepth, [3, 5, 10])
            .addGrid(gbt.stepSize, [0.01, 0.1, 0.2])
            .build(),
        ),
        "Ridge": (ridge, ParamGridBuilder().addGrid(ridge.regParam, [p * scale for p in penalties]).build()),
        "Lasso": (
            lasso,
            ParamGridBuilder().addGrid(lasso.regParam, penalties).addGrid(lasso.maxIter, [1000, 5000]).build(),
        ),
    }


def search(train: DataFrame, estimator, grid: list, folds: int = 5, label: str = "label"):
    """Cross-validated search by R², refit on all of ``train``."""
    judge = RegressionEvaluator(labelCol=label, metricName="r2")
    return CrossValidator(
        estimator=estimator,
        estimatorParamMaps=grid,
        evaluator=judge,
        numFolds=folds,
        seed=42,
        parallelism=4,
    ).fit(train)


class AdaBoostR2:
    """Boosted trees whose row weights follow the relative error.

    Trees are grown on sums by cell, weights made from the rounds so far. Rows
    that cells cannot stand for are left to Spark's trees: weights are a column
    then and every round is written out, so the plan stays one round deep and a
    lost executor costs one round at most.
    """

    def __init__(
        self, label: str = "label", features: str = "features", rounds: int = 50, depth: int = 3, seed: int = 42
    ) -> None:
        self.label, self.features = label, features
        self.rounds, self.depth, self.seed = rounds, depth, seed

    def fit(self, train: DataFrame) -> AdaBoostR2Model:
        rows = CellRows(train, self.features, self.label)
        return rows.usable and self._on_cells(rows) or self._on_rows(train)

    def _on_cells(self, rows: CellRows) -> AdaBoostR2Model | None:
        """The model, or none where a round's cells are too many."""
        weighted = WeightedRows(rows)
        trees, strengths = [], []
        for i in range(self.rounds):
            grid = rows.grid(*weighted.draw(self.seed + i))
            if grid.size > MAX_CELLS:
                return None
            cells, n, weight, total = weighted.sums(grid)
            tree, _ = grow(grid, grid.bins(cells), n, weight, total, self.depth)
            worst, missed = weighted.errors(tree)
            if not worst:
                return AdaBoostR2Model(self.features, [*trees, tree], [*strengths, 1.0])
            loss = missed / worst
            if loss >= 0.5:
                if not trees:
                    trees, strengths = [tree], [1.0]
                break
            beta = loss / (1.0 - loss)
            trees.append(tree)
            strengths.append(math.log(1.0 / beta))
            weighted.add(Round(tree, beta, worst))
        return AdaBoostR2Model(self.features, trees, strengths)

    def _on_rows(self, train: DataFrame) -> AdaBoostR2Model:
        weighted = written(
            train.select(self.features, self.label).withColumn("_w", F.lit(1.0)), "boost-round"
        )
        trees, strengths = [], []
        for i in range(self.rounds):
            tree = DecisionTreeRegressor(
                featuresCol=self.features,
                labelCol=self.label,
                weightCol="_w",
                maxDepth=self.depth,
                seed=self.seed + i,
                predictionCol="_p",
            ).fit(weighted)
            missed = tree.transform(weighted).withColumn("_e", F.abs(F.col("_p") - F.col(self.label)))
            worst = missed.agg(F.max("_e")).first()[0]
            if not worst:
                return AdaBoostR2Model(self.features, [*trees, tree], [*strengths, 1.0])
            share = F.col("_e") / F.lit(worst)
            loss = missed.agg(F.sum(F.col("_w") * share) / F.sum("_w")).first()[0]
            if loss >= 0.5:
                if not trees:
                    trees, strengths = [tree], [1.0]
                break
            beta = loss / (1.0 - loss)
            trees.append(tree)
            strengths.append(math.log(1.0 / beta))
            raised = F.col("_w") * F.pow(F.lit(beta), 1 - share)
            # Rescaled to mean 1 by the round's own totals in the next loss.
            weighted = written(
                missed.select(self.features, self.label, raised.alias("_w")), "boost-round"
            )
        return AdaBoostR2Model(self.features, trees, strengths)


class AdaBoostR2Model:
    def __init__(self, features: str, trees: list, strengths: list[float]) -> None:
        self.features, self.trees, self.strengths = features, trees, strengths

    def transform(self, df: DataFrame) -> DataFrame:
        """Weighted median of the trees, inside the row."""
        half = sum(self.strengths) / 2.0
        if all(isinstance(tree, Tree) for tree in self.trees):
            return df.withColumn("prediction", self._median(half)(vector_to_array(self.features)))
        out = df
        names = [f"_tree{i}" for i in range(len(self.trees))]
        for name, tree in zip(names, self.trees):
            out = tree.copy().setPredictionCol(name).transform(out)
        votes = F.array_sort(
            F.array(*[F.struct(F.col(n).alias("p"), F.lit(s).alias("s")) for n, s in zip(names, self.strengths)])
        )
        reached = F.aggregate(
            votes,
            F.struct(F.lit(0.0).alias("c"), F.lit(None).cast("double").alias("p")),
            lambda acc, v: F.struct(
                (acc["c"] + v["s"]).alias("c"), F.when(acc["c"] < half, v["p"]).otherwise(acc["p"]).alias("p")
            ),
        )
        return out.withColumn("prediction", reached["p"]).drop(*names)

    def _median(self, half: float):
        trees, strengths = self.trees, np.array(self.strengths)

        @F.arrow_udf("double")
        def median(values: pa.Array) -> pa.Array:
            if not len(values):
                return pa.array([], pa.float64())
            x = matrix(values)
            votes = np.stack([tree.predict(x) for tree in trees])
            order = votes.argsort(axis=0, kind="stable")
            reached = (strengths[order].cumsum(axis=0) < half).sum(axis=0)
            place = np.arange(x.shape[1])
            return pa.array(votes[order[np.minimum(reached, len(trees) - 1), place], place])

        return median


def regression_metrics(
    df: DataFrame, label: str = "label", predicted: str = "prediction", by: Sequence[str] = ()
) -> DataFrame:
    """R², MAE and MSE in one aggregation."""
    y, p = F.col(label), F.col(predicted)
    return df.groupBy(*by).agg(
        (1 - F.try_divide(F.sum((y - p) * (y - p)), F.var_pop(y) * F.count(y))).alias("R2"),
        F.avg(F.abs(y - p)).alias("MAE"),
        F.avg((y - p) * (y - p)).alias("MSE"),
    )


def repeated_splits(
    df: DataFrame, id_col: str, models: Mapping[str, object], split_seeds: Sequence[int], label: str = "label"
) -> DataFrame:
    """Fit every model on every 80/20 split: ``Model, Seed, R2, MAE, MSE``.

    The loop runs over fits; rows stay in Spark. Each split is written once
    and read by all models.
    """
    results = None
    for seed in split_seeds:
        split = written(train_test(df, id_col, seed=seed), "seed-split")
        train, test = split.where("not is_test"), split.where("is_test")
        for name, estimator in models.items():
            scored = estimator.fit(train).transform(test)
            row = regression_metrics(scored, label).select(
                F.lit(name).alias("Model"), F.lit(seed).alias("Seed"), "R2", "MAE", "MSE"
            )
            results = row if results is None else results.unionByName(row)
    return written(results, "seed-metrics")


def mean_metrics(metrics: DataFrame) -> DataFrame:
    """Mean per model; ordered by R² where it is shown."""
    return (
        metrics.groupBy("Model")
        .agg(*[F.avg(c).alias(c) for c in ("R2", "MAE", "MSE")])
        .orderBy(F.desc("R2"))
    )


def importances(model, df: DataFrame, derived: Sequence[str] = (), names: Mapping[str, str] = {}) -> DataFrame:
    """Feature importances without the strongest, sorted: one row per feature.

    Feature names come from the vector's metadata; there are as many rows as
    features, never as many as data rows.
    """
    attrs = df.schema["features"].metadata.get("ml_attr", {}).get("attrs", {})
    by_place = {a["idx"]: a["name"] for group in attrs.values() for a in group}
    weights = model.featureImportances.toArray()
    ranked = sorted(enumerate(weights), key=lambda x: -x[1])[1:]
    rows = [
        (names.get(by_place.get(i, str(i)), by_place.get(i, str(i))), float(w), by_place.get(i) in derived)
        for i, w in ranked
    ]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double, is_derived boolean")


def residuals(df: DataFrame, label: str = "label", predicted: str = "prediction") -> DataFrame:
    return df.withColumn("residual", F.col(predicted) - F.col(label))


def approach_table(scores: DataFrame, approaches: Sequence, digits: int = 2) -> DataFrame:
    """(model, metric) × approach, rounded."""
    return scores.groupBy("model", "metric").agg(
        *[
            F.round(F.max(F.when(F.col("approach") == a, F.col("score"))), digits).alias(f"approach_{a}")
            for a in approaches
        ]
    )


def vector_of(columns: Sequence[str]) -> Column:
    return F.array(*[F.col(c).cast("double") for c in columns])
