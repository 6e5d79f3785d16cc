"""Relevance classification: features, balancing, models, scores."""

from __future__ import annotations

import itertools
import math
import threading
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    NaiveBayes,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import (
    CountVectorizer,
    ElementwiseProduct,
    IDF,
    Normalizer,
    RegexTokenizer,
)
from pyspark.ml.linalg import Vectors
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W
from pyspark.util import inheritable_thread_target

from sheaf.functions.terms import find_terms
from sheaf.functions.text import keyword_rule
from sheaf.operators.order_stats import hash_cut
from sheaf.session import written

MAX_FEATURES = 4_000
# Different terms a task counts before it sends its counts on.
COUNTED_TERMS = 500_000
# Rows of a fold's side that one task goes through at each step of a fit.
FOLD_ROWS = 16_384


def keyword_filter(df: DataFrame, text: str, names, phrases, more_than: int = 2) -> DataFrame:
    return df.withColumn(
        "is_relevant", keyword_rule(F.col(text), names, phrases, more_than)
    ).where("is_relevant")


def balance_classes(
    df: DataFrame, id_col: str, label: str, ratio: float = 0.5, seed: int = 42
) -> DataFrame:
    """All positives and ``int(n1 / ratio)`` sampled negatives; error if short."""
    positive = df.where(F.col(label) == 1)
    negative = df.where(F.col(label) == 0)
    wanted = positive.agg(F.floor(F.count("*") / F.lit(ratio)).alias("k"))
    available = negative.agg(F.count("*").alias("n"))
    size = F.when(
        available.scalar() < wanted.scalar(), F.raise_error(F.lit("too few negative rows"))
    ).otherwise(wanted.scalar())
    kept = hash_cut(negative, id_col, seed, size).where("chosen").drop("chosen")
    return positive.unionByName(kept)


def train_test(
    df: DataFrame, id_col: str, test_share: float = 0.2, seed: int = 42
) -> DataFrame:
    """Add ``is_test``: exactly ``ceil(share * n)`` rows, stable by id hash."""
    n = df.agg(F.count("*").alias("n")).scalar()
    marked = hash_cut(df, id_col, seed, F.ceil(n * F.lit(test_share)))
    return marked.withColumnRenamed("chosen", "is_test")


def vocabulary(df: DataFrame, text: str, max_features: int = MAX_FEATURES) -> DataFrame:
    """The ``max_features`` most frequent terms with total and document frequency.

    Terms are counted in the tasks that hold their texts; only counts cross
    the network.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = Counter(), Counter()
        for batch in batches:
            for value in batch.column(0).to_pylist():
                found = find_terms((value or "").lower())
                total.update(found)
                seen.update(set(found))
            if len(total) > COUNTED_TERMS:
                yield counted(total, seen)
                total, seen = Counter(), Counter()
        yield counted(total, seen)

    def counted(total: Counter, seen: Counter) -> pa.RecordBatch:
        columns = [pa.array(total, pa.string()), pa.array(total.values(), pa.int64()), pa.array([seen[t] for t in total], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["term", "tf", "df"])

    counts = df.select(F.col(text).cast("string")).mapInArrow(count, "term string, tf bigint, df bigint")
    return (
        counts.groupBy("term")
        .agg(F.sum("tf").alias("total"), F.sum("df").alias("df"))
        .orderBy(F.desc("total"), "term")
        .limit(max_features)
    )


@dataclass(frozen=True)
class TermWeights:
    """A vocabulary with the smoothed idf of each term; ``rows`` weighs any texts by it."""

    terms: tuple[str, ...]
    idf: tuple[float, ...]

    @classmethod
    def fit(cls, df: DataFrame, text: str, max_features: int = MAX_FEATURES) -> TermWeights:
        n = df.count()
        found = vocabulary(df, text, max_features).collect()
        return cls(tuple(r["term"] for r in found), tuple(math.log((1 + n) / (1 + r["df"])) + 1 for r in found))

    def rows(self, df: DataFrame, key: str, text: str) -> DataFrame:
        """L2-normalised ``key, term, tfidf`` of every text, in its own task."""
        places, idf = {t: i for i, t in enumerate(self.terms)}, np.array(self.idf)

        def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, place = pa.array(places, pa.string()), places.get
            for batch in batches:
                found = [[i for i in map(place, find_terms((v or "").lower())) if i is not None] for v in batch.column(1).to_pylist()]
                owner = np.repeat(np.arange(len(found)), [len(x) for x in found])
                flat = np.fromiter(itertools.chain.from_iterable(found), np.int64, len(owner))
                both, tf = np.unique(owner * max(1, len(places)) + flat, return_counts=True)
                owner, term = np.divmod(both, max(1, len(places)))
                weight = tf * idf[term]
                norm = np.sqrt(np.bincount(owner, weight * weight, len(found)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(owner)), names.take(pa.array(term)), pa.array(weight / norm[owner])],
                    names=["key", "term", "tfidf"],
                )

        kind = df.schema[key].dataType.simpleString()
        texts = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
        return texts.mapInArrow(weigh, f"key {kind}, term string, tfidf double").withColumnRenamed("key", key)


def tfidf(
    df: DataFrame, key: str, text: str, max_features: int = MAX_FEATURES
) -> DataFrame:
    """Long L2-normalised TF-IDF: rows ``key, term, tfidf``.

    Each text is counted and weighed in its own row against the vocabulary,
    which holds ``max_features`` terms at most; no text is shuffled.
    """
    return TermWeights.fit(df, text, max_features).rows(df, key, text)


class TermBayes:
    """Multinomial naive Bayes over TF-IDF, as two small tables.

    ``terms`` holds ``label, term, log_probability`` for every label and term of
    the vocabulary, ``priors`` holds ``label, log_prior``. They come from sums
    by label and term, which combine before the shuffle, and are broadcast: the
    vocabulary bounds the one, the number of labels the other.
    """

    def __init__(self, weights: TermWeights, terms: DataFrame, priors: DataFrame) -> None:
        self.weights, self.terms, self.priors = weights, terms, priors

    @classmethod
    def fit(
        cls, train: DataFrame, key: str, text: str, label: str, alpha: float = 1.0, max_features: int = MAX_FEATURES
    ) -> TermBayes:
        """``key`` tells the rows of ``train`` apart; rows without a label do not count."""
        train = train.where(F.col(label).isNotNull())
        weights = TermWeights.fit(train, text, max_features)
        named = train.select(key, text, F.col(label).alias("label"))
        counts = written(named.groupBy("label").count(), "labels")
        n = counts.agg(F.sum("count")).scalar()
        priors = counts.select("label", F.log(F.col("count") / n).alias("log_prior"))
        sums = weights.rows(named, key, text).join(named.select(key, "label"), key).groupBy("label", "term").agg(F.sum("tfidf").alias("s"))
        every = counts.select("label", F.explode(F.array(*[F.lit(t) for t in weights.terms]).cast("array<string>")).alias("term"))
        filled = every.join(sums, ["label", "term"], "left").select("label", "term", F.coalesce("s", F.lit(0.0)).alias("s"))
        whole = F.sum("s").over(W.partitionBy("label")) + F.lit(alpha * len(weights.terms))
        terms = filled.select("label", "term", F.log((F.col("s") + alpha) / whole).alias("log_probability"))
        return cls(weights, written(terms, "term-table"), written(priors, "priors"))

    def transform(self, df: DataFrame, key: str, text: str) -> DataFrame:
        """``key, label, score, probability`` of every row and label.

        A text without a known term has the scores of the priors.
        """
        found = self.weights.rows(df, key, text).join(F.broadcast(self.terms), "term")
        sums = found.groupBy(key, "label").agg(F.sum(F.col("tfidf") * F.col("log_probability")).alias("s"))
        labels = self.priors.agg(F.collect_list(F.struct("label", "log_prior"))).scalar()
        every = df.select(key, F.explode(labels).alias("p")).select(key, "p.*")
        scored = every.join(sums, [key, "label"], "left").select(
            key, "label", (F.col("log_prior") + F.coalesce("s", F.lit(0.0))).alias("score")
        )
        # As many rows as labels for each key.
        mine = W.partitionBy(key)
        share = F.exp(F.col("score") - F.max("score").over(mine))
        return scored.withColumn("_share", share).select(key, "label", "score", (F.col("_share") / F.sum("_share").over(mine)).alias("probability"))

    def predict(self, df: DataFrame, key: str, text: str) -> DataFrame:
        """``key, prediction``: the label of highest score, the smaller one on ties."""
        scored = self.transform(df, key, text)
        return scored.groupBy(key).agg(F.max_by("label", F.struct("score", -F.col("label"))).alias("prediction"))

    def save(self, path: str) -> None:
        places = self.terms.sparkSession.createDataFrame(
            list(zip(range(len(self.weights.terms)), self.weights.terms, self.weights.idf, strict=True)), "place int, term string, idf double"
        )
        for name, table in (("weights", places), ("terms", self.terms), ("priors", self.priors)):
            table.write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TermBayes:
        weights, terms, priors = (spark.read.parquet(f"{path}/{name}") for name in ("weights", "terms", "priors"))
        held = weights.orderBy("place").collect()
        return cls(TermWeights(tuple(r["term"] for r in held), tuple(r["idf"] for r in held)), terms, priors)


class TfidfFeatures:
    """Spark ML form of :func:`tfidf`: fit on train, transform anything.

    ``IDF`` weighs by ln((1+n)/(1+df)); the smoothed form adds 1 to every
    weight, which one bounded scaling vector does.
    """

    def __init__(self, text: str = "text", max_features: int = MAX_FEATURES) -> None:
        self.text = text
        self.max_features = max_features

    def fit(self, train: DataFrame) -> PipelineModel:
        split = RegexTokenizer(
            inputCol=self.text, outputCol="_tokens", pattern=r"[\p{L}\p{N}_]{2,}", gaps=False
        )
        count = CountVectorizer(inputCol="_tokens", outputCol="_tf", vocabSize=self.max_features)
        weigh = IDF(inputCol="_tf", outputCol="_idf")
        base = Pipeline(stages=[split, count, weigh]).fit(train)
        smoothed = Vectors.dense([w + 1.0 for w in base.stages[2].idf])
        scale = ElementwiseProduct(scalingVec=smoothed, inputCol="_tf", outputCol="_scaled")
        unit = Normalizer(inputCol="_scaled", outputCol="features", p=2.0)
        return PipelineModel(stages=[base.stages[0], base.stages[1], scale, unit])


def class_weights(
    df: DataFrame, label: str, name: str = "weight", train: Column | None = None
) -> DataFrame:
    """Balanced weights n / (2 * n_class), counted where ``train`` holds (everywhere by default)."""
    counted = df if train is None else df.where(train)
    sizes = counted.agg(
        F.struct(
            F.count("*").alias("n"), F.count_if(F.col(label) == 1).alias("n1")
        ).alias("s")
    ).scalar()
    own = F.when(F.col(label) == 1, sizes["n1"]).otherwise(sizes["n"] - sizes["n1"])
    return df.withColumn(name, F.try_divide(sizes["n"], 2 * own))


def classifiers(n_train: int, label: str = "label") -> dict[str, object]:
    """The five estimators; C becomes 1/(C n) in Spark's regularisation."""
    ridge = 1.0 / max(n_train, 1)
    return {
        "Logistic Regression": RisingLogistic(
            labelCol=label, regParam=ridge, maxIter=100, standardization=False
        ),
        "Naive Bayes": NaiveBayes(labelCol=label, modelType="multinomial", smoothing=1.0),
        "SVM": RisingSVC(
            labelCol=label, weightCol="weight", regParam=ridge, maxIter=20, tol=1e-4, standardization=False
        ),
        # Trees without a depth limit: 30 is the most a tree can have here.
        "Random Forest": RandomForestClassifier(labelCol=label, numTrees=100, maxDepth=30, seed=42),
        "Gradient Boosting": GBTClassifier(labelCol=label, maxIter=100, maxDepth=6, stepSize=0.3, seed=42),
    }


def classifier_grids(n_train: int, label: str = "label") -> dict[str, tuple[object, list]]:
    """Estimator and parameter grid by model name, fixed values that must match; a depth without limit is 30, the most a tree can have here."""
    models = classifiers(n_train, label)
    lr, nb, svm, rf, gbt = models.values()
    ridges = [1.0 / (c * max(n_train, 1)) for c in (0.01, 0.1, 1.0, 10.0, 100.0)]
    grids = (
        ParamGridBuilder().addGrid(lr.regParam, ridges).addGrid(lr.maxIter, [50, 100, 200]).build(),
        ParamGridBuilder().addGrid(nb.smoothing, [0.001, 0.01, 0.1, 0.5, 1.0]).build(),
        ParamGridBuilder().addGrid(svm.regParam, ridges).addGrid(svm.maxIter, [1, 10, 50, 100, 250, 500]).build(),
        ParamGridBuilder()
        .addGrid(rf.numTrees, [100, 200, 250])
        .addGrid(rf.maxDepth, [10, 20, 30])
        .addGrid(rf.minInstancesPerNode, [1, 2, 4])
        .build(),
        ParamGridBuilder()
        .addGrid(gbt.maxIter, [50, 100, 200])
        .addGrid(gbt.maxDepth, [2, 3, 6])
        .addGrid(gbt.stepSize, [0.01, 0.1, 0.2])
        .build(),
    )
    return {name: (model, grid) for (name, model), grid in zip(models.items(), grids)}


class _Rising:
    """Fits a grid without fitting again what has converged.

    A fit that stops before ``maxIter`` is also the fit of every larger
    ``maxIter`` with the other parameters alike: the steps are the same.
    """

    def fitMultiple(self, dataset: DataFrame, paramMaps: Sequence[dict]) -> Iterator[tuple[int, object]]:
        def others(params: dict) -> tuple:
            return tuple(sorted((p.name, str(v)) for p, v in params.items() if p != self.maxIter))

        upto = [params.get(self.maxIter, self.getMaxIter()) for params in paramMaps]
        return _RisingFits(self.copy(), dataset, paramMaps, upto, [others(params) for params in paramMaps])


class _RisingFits:
    """``index, model`` of every map, the fewest steps first; threads may share it."""

    def __init__(self, estimator, dataset: DataFrame, maps: Sequence[dict], upto: Sequence[int], groups: Sequence[tuple]) -> None:
        self.estimator, self.dataset, self.maps, self.upto, self.groups = estimator, dataset, maps, upto, groups
        self.left = iter(sorted(range(len(maps)), key=lambda i: (sorted({u for u, g in zip(upto, groups) if g == groups[i]}).index(upto[i]), i)))
        self.taking = threading.Lock()
        self.fitting = {g: threading.Lock() for g in groups}
        self.converged: dict[tuple, tuple[int, object]] = {}

    def __iter__(self) -> _RisingFits:
        return self

    def __next__(self) -> tuple[int, object]:
        with self.taking:
            index = next(self.left)
        group = self.groups[index]
        with self.fitting[group]:
            steps, model = self.converged.get(group, (0, None))
            if model is None or steps >= self.upto[index]:
                model = self.estimator.fit(self.dataset, self.maps[index])
                summary = model.summary() if callable(model.summary) else model.summary
                steps = summary.totalIterations
                if steps < self.upto[index]:
                    self.converged[group] = steps, model
        return index, model


class RisingLogistic(_Rising, LogisticRegression):
    pass


class RisingSVC(_Rising, LinearSVC):
    pass


class FoldsAtOnce(CrossValidator):
    """Cross validation that fits several folds at once where one leaves cores idle.

    Folds and scores are those of ``CrossValidator``. A fit makes a job at every
    step, so small train sides go to as few tasks as their rows need; the rows of
    a fold stay as they are and are held as long as it is worked on.
    """

    def _fit(self, dataset: DataFrame) -> CrossValidatorModel:
        estimator, maps, judge = self.getEstimator(), self.getEstimatorParamMaps(), self.getEvaluator()
        sides, context = self._kFold(dataset), dataset.sparkSession.sparkContext
        tasks = max(1, -(-dataset.count() // FOLD_ROWS))
        at_once = max(1, min(len(sides), context.defaultParallelism // (2 * tasks)))

        def scored(side: tuple[DataFrame, DataFrame]) -> list[float]:
            train, validation = (part.coalesce(tasks).cache() for part in side)
            models, scores = estimator.fitMultiple(train, maps), [0.0] * len(maps)

            def one(_: int) -> None:
                index, model = next(models)
                scores[index] = judge.evaluate(model.transform(validation, maps[index]))

            with ThreadPool(min(self.getParallelism(), len(maps))) as pool:
                pool.map(inheritable_thread_target(dataset.sparkSession)(one), range(len(maps)), chunksize=1)
            train.unpersist()
            validation.unpersist()
            return scores

        with ThreadPool(at_once) as pool:
            every = np.array(pool.map(inheritable_thread_target(dataset.sparkSession)(scored), sides, chunksize=1))
        metrics = every.mean(axis=0)
        best = int(metrics.argmax() if judge.isLargerBetter() else metrics.argmin())
        model = estimator.fit(dataset, maps[best])
        return self._copyValues(CrossValidatorModel(model, metrics.tolist(), stdMetrics=every.std(axis=0).tolist()))


def grid_search(train: DataFrame, estimator, grid: list, folds: int = 5, label: str = "label"):
    """Cross-validated search by accuracy, refit on all of ``train``."""
    judge = MulticlassClassificationEvaluator(labelCol=label, metricName="accuracy")
    search = FoldsAtOnce(
        estimator=estimator,
        estimatorParamMaps=grid,
        evaluator=judge,
        numFolds=folds,
        seed=42,
        parallelism=4,
    )
    return search.fit(train)


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def confusion(df: DataFrame, label: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """One row of counts and the balanced error rate per group."""
    y, p = F.col(label), F.col(predicted)
    counts = df.groupBy(*by).agg(
        F.count_if((y == 1) & (p == 1)).alias("tp"),
        F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"),
        F.count_if((y == 0) & (p == 0)).alias("tn"),
    )
    sensitivity = F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), F.lit(0.0))
    specificity = F.coalesce(F.try_divide("tn", F.col("tn") + F.col("fp")), F.lit(0.0))
    return counts.withColumn("ber", 1 - (sensitivity + specificity) / 2)


def classification_report(
    df: DataFrame, label: str, predicted: str, by: Sequence[str] = ()
) -> DataFrame:
    """Precision, recall, F1 and support per class, accuracy per group."""
    y, p = F.col(label), F.col(predicted)
    tags = F.array(
        F.struct(y.alias("class"), F.lit(1).alias("sup"), (y == p).cast("int").alias("hit"), F.lit(0).alias("pred")),
        F.struct(p.alias("class"), F.lit(0).alias("sup"), F.lit(0).alias("hit"), F.lit(1).alias("pred")),
    )
    totals = (
        df.select(*by, F.explode(tags).alias("t"))
        .groupBy(*by, F.col("t.class").alias("class"))
        .agg(
            F.sum("t.sup").alias("support"),
            F.sum("t.hit").alias("hits"),
            F.sum("t.pred").alias("predicted"),
        )
    )
    precision = F.coalesce(F.try_divide("hits", "predicted"), F.lit(0.0))
    recall = F.coalesce(F.try_divide("hits", "support"), F.lit(0.0))
    return (
        totals.withColumn("precision", precision)
        .withColumn("recall", recall)
        .withColumn(
            "f1",
            F.coalesce(
                F.try_divide(
                    2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")
                ),
                F.lit(0.0),
            ),
        )
        .drop("hits", "predicted")
    )


def accuracy(df: DataFrame, label: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    hit = (F.col(label) == F.col(predicted)).cast("double")
    return df.groupBy(*by).agg(F.avg(hit).alias("accuracy"))


def compare_stages(metrics: DataFrame, stages: Sequence[str], values: Sequence[str]) -> DataFrame:
    """One row per model, one column per metric and stage."""
    picked = [
        F.max(F.when(F.col("stage") == s, F.col(v))).alias(f"{v}_{s}")
        for s in stages
        for v in values
    ]
    return metrics.groupBy("model").agg(*picked)


