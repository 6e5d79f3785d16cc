"""Exact k nearest neighbours as a blocked join.

Train rows are cut into cells around a few pivots. By the triangle
inequality a query only visits cells that can hold one of its neighbours,
so far cells are skipped without losing a result. Cells and queries are
split into blocks of bounded size, so a dense cell is many tasks; each block
returns at most k rows per query, never its pairs.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from sheaf.operators.order_stats import hash_key
from sheaf.session import collect_garbage, intermediates, release, written

PIVOTS = 64
BLOCK_ROWS = 32_768
QUERY_ROWS = 8_192
# Visits of queries to blocks that a task sends on at once.
VISIT_ROWS = 16_384
# Pairs measured exactly at once, and rough distances summed up at once.
MEASURED_ROWS = 65_536
CACHED_VALUES = 32_768


def nearest(
    train: DataFrame,
    test: DataFrame,
    train_id: str,
    test_id: str,
    vector: str,
    k: int = 5,
    p: int = 2,
    pivots: int = PIVOTS,
    block_rows: int = BLOCK_ROWS,
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """Rows ``test_id, neighbour, distance, place`` of the k nearest, ties by id."""
    centres = [
        r[0] for r in train.orderBy(hash_key(train_id, 0), train_id).select(vector).limit(pivots).collect()
    ]
    centres = np.asarray(centres, dtype="float64")

    def _gap(x, y, p):  # local, so that it travels to the workers by value
        if p == 1:
            return np.abs(x - y).sum(axis=1)
        return np.sqrt(((x - y) ** 2).sum(axis=1))

    def assign(batches):
        for batch in batches:
            if not len(batch):
                continue
            x = np.stack([np.asarray(v, dtype="float64") for v in batch["v"]])
            gaps = np.stack([_gap(x, c, p) for c in centres], axis=1)
            cell = gaps.argmin(axis=1)
            yield pd.DataFrame(
                {"id": batch["id"], "v": [row.tobytes() for row in x], "cell": cell, "radius": gaps.min(axis=1)}
            )

    rows = train.select(F.col(train_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    located = written(
        rows.mapInPandas(assign, "id long, v binary, cell int, radius double"), "knn-cells"
    )
    # One row per pivot.
    cells = {
        r["cell"]: (r["n"], r["radius"])
        for r in located.groupBy("cell").agg(F.count("*").alias("n"), F.max("radius").alias("radius")).collect()
    }
    n_test = test.count()
    query_blocks = max(1, -(-n_test // query_rows))
    order, sizes, radii = sorted(cells), np.zeros(len(centres)), np.full(len(centres), np.nan)
    for c in order:
        sizes[c], radii[c] = cells[c]
    # Small cells next to each other share a block, a large one is dealt in parts.
    groups, filled = [], 0
    left_over = list(order)
    while left_over:
        near_last = _gap(centres[left_over], centres[groups[-1][-1]], p) if groups else np.zeros(1)
        c = left_over.pop(int(near_last.argmin()))
        if not groups or filled + sizes[c] > block_rows:
            groups.append([])
            filled = 0
        groups[-1].append(c)
        filled += sizes[c]
    parts = [max(1, -(-int(sizes[g].sum()) // block_rows)) for g in groups]

    def reached(gaps, radius, limit):
        # A hair of slack: rounding must not cost a neighbour.
        return gaps - radius <= limit * (1 + 1e-9) + 1e-12

    def visit(batches):
        for batch in batches:
            known = batch["v"].notna().to_numpy()
            if not order or not known.any():
                continue
            ids, x = batch["id"].to_numpy()[known], np.stack([np.asarray(v, dtype="float64") for v in batch["v"][known]])
            gaps = np.stack([_gap(x, centres[c], p) for c in order], axis=1)
            reach = gaps + radii[order]
            by_reach = np.argsort(reach, axis=1)
            enough = (np.cumsum(sizes[order][by_reach], axis=1) < k).sum(axis=1)
            limit = reach[np.arange(len(x)), by_reach[np.arange(len(x)), np.minimum(enough, len(order) - 1)]]
            visited = np.zeros((len(x), len(centres)), bool)
            visited[:, order] = reached(gaps, radii[order], limit[:, None])
            packed = np.array([row.tobytes() for row in x], object)
            for block, group in enumerate(groups):
                every = np.flatnonzero(visited[:, group].any(axis=1))
                # Parts grow with the table; what a task holds does not.
                for part, first in itertools.product(range(parts[block]), range(0, len(every), VISIT_ROWS)):
                    of = every[first : first + VISIT_ROWS]
                    yield pd.DataFrame({"id": ids[of], "v": packed[of], "reach": limit[of], "block": block, "part": part})

    def unpacked(vectors):
        return np.frombuffer(b"".join(vectors), "float64").reshape(len(vectors), -1)

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"q": [], "t": [], "distance": []}).astype({"q": "int64", "t": "int64", "distance": "float64"})
        if not len(left) or not len(right):
            return none
        asked, names, limit = unpacked(left["v"]), left["id"].to_numpy(), left["reach"].to_numpy()
        right = right.sort_values(["cell", "id"], kind="stable")
        present, sizes = np.unique(right["cell"].to_numpy(), return_counts=True)
        visits = np.stack([reached(_gap(asked, centres[c], p), radii[c], limit) for c in present], axis=1)
        wanted = visits.any(axis=0)
        if not wanted.any():
            return none
        right, sizes, visits = right[np.repeat(wanted, sizes)], sizes[wanted], visits[:, wanted]
        ends = np.cumsum(sizes)
        base, ids = unpacked(right["v"]), right["id"].to_numpy()
        most = min(k, len(ids))
        rough, room = (rough_sums if p == 1 else rough_squares)(base, asked)
        out = []
        # Some queries at a time, so that a block of distances stays small.
        step = max(1, 4_000_000 // len(ids))
        for first in range(0, len(asked), step):
            some = np.arange(first, min(first + step, len(asked)))
            if visits[some].all():
                near = rough(some, 0, len(ids))
            else:
                near = np.full((len(some), len(ids)), np.inf)
                for cell, end in enumerate(ends):
                    at = np.flatnonzero(visits[some, cell])
                    near[at, end - sizes[cell] : end] = rough(some[at], end - sizes[cell], end)
            bound = least(near, most)
            # Rough distances round: whatever may belong to the nearest is measured again.
            may = near <= (bound + room(some, bound))[:, None]
            if np.isinf(bound).any():
                may &= np.repeat(visits[some], sizes, axis=1)
            upto = np.cumsum(may.sum(axis=1))
            cuts = np.unique(np.searchsorted(upto, np.arange(0, upto[-1], MEASURED_ROWS), side="right"))
            for lo, hi in zip(cuts, [*cuts[1:], len(may)]):
                q, t = np.nonzero(may[lo:hi])
                q += first + lo
                gaps = _gap(base[t], asked[q], p)
                order = np.lexsort((ids[t], gaps, q))
                place = np.arange(len(q)) - np.searchsorted(q, q)
                best = order[place < most]
                out.append((names[q[best]], ids[t[best]], gaps[best]))
        q, t, distance = (np.concatenate(c) for c in zip(*out))
        return pd.DataFrame({"q": q, "t": t, "distance": distance})

    def least(near, most):
        """No less than the ``most``-th smallest of each row, from minima over lots of columns."""
        lots = 16 * most
        width = near.shape[1] // lots
        if width > 1:
            near = near[:, : width * lots].reshape(len(near), width, lots).min(axis=1)
        return np.partition(near, most - 1, axis=1)[:, most - 1]

    def rough_squares(base, asked):
        """Squared distances by matrix products, and by how much a bound on them is widened."""
        norms, own = (base * base).sum(axis=1), (asked * asked).sum(axis=1)

        def rough(part, start, end):
            near = asked[part] @ base[start:end].T
            near *= -2
            near += norms[start:end]
            near += own[part, None]
            return np.maximum(near, 0, out=near)

        return rough, lambda part, bound: 1e-9 * (bound + norms.max() + 1)

    def rough_sums(base, asked):
        """Sums of absolute differences in single precision where the values allow it, by dimension."""
        largest = max(np.abs(base).max(initial=0), np.abs(asked).max(initial=0))
        kind = np.float32 if largest < 1e30 else np.float64
        sides = np.ascontiguousarray(base.T, kind), np.ascontiguousarray(asked.T, kind)
        top, own = np.abs(base).sum(axis=1).max(), np.abs(asked).sum(axis=1)
        off = 4 * np.finfo(kind).eps * (base.shape[1] + 2)

        def rough(part, start, end):
            columns, rows = sides[0][:, start:end], sides[1][:, part, None]
            near = np.zeros((len(part), end - start), kind)
            # What is worked on together stays in the processor's cache.
            step = max(1, CACHED_VALUES // (end - start))
            for first in range(0, len(near), step):
                some, x = near[first : first + step], rows[:, first : first + step]
                gap = np.empty_like(some)
                for column, value in zip(columns, x):
                    np.subtract(column, value, out=gap)
                    np.abs(gap, out=gap)
                    some += gap
            return near

        return rough, lambda part, bound: off * (bound + top + own[part])

    queries = test.select(F.col(test_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    visits = queries.mapInPandas(visit, "id long, v binary, reach double, block int, part int").withColumn(
        "qpart", F.pmod(F.xxhash64("id"), F.lit(query_blocks)).cast("int")
    )
    # A train row goes to the query blocks that visit its block, and to no others.
    visits = written(visits, "knn-visits")
    wanted = visits.select(F.col("block").alias("wblock"), F.col("qpart").alias("wpart")).distinct()
    own_block, own_parts = ({c: n for g, n in zip(groups, of) for c in g} for of in (range(len(groups)), parts))
    by_cell = [F.array(*[F.lit(m.get(c, 0)) for c in range(len(centres))]).cast("array<int>") for m in (own_block, own_parts)]
    base = located.withColumn("block", F.get(by_cell[0], F.col("cell"))).join(wanted, F.col("block") == F.col("wblock"))
    base = base.withColumn("part", F.pmod(F.xxhash64("id"), F.get(by_cell[1], F.col("cell"))).cast("int"))
    partial = (
        visits.groupBy("block", "part", "qpart")
        .cogroup(base.select("id", "v", "cell", "block", "part", "wpart").groupBy("block", "part", "wpart"))
        .applyInPandas(search, "q long, t long, distance double")
    )
    rank = F.row_number().over(W.partitionBy("q").orderBy("distance", "t"))
    return (
        partial.withColumn("place", rank)
        .where(F.col("place") <= k)
        .select(F.col("q").alias(test_id), F.col("t").alias("neighbour"), "distance", "place")
    )


def knn_regression(
    train: DataFrame,
    test: DataFrame,
    train_id: str,
    test_id: str,
    vector: str,
    target: str,
    k: int = 5,
    p: int = 2,
    weights: str = "uniform",
) -> DataFrame:
    """Mean target of the k nearest train rows: ``test_id, prediction``.

    ``weights="distance"`` weighs by inverse distance; exact matches, when
    there are any, decide alone.
    """
    pairs = nearest(train, test, train_id, test_id, vector, k, p)
    known = train.select(
        F.col(train_id).cast("long").alias("neighbour"), F.col(target).cast("double").alias("_y")
    )
    joined = pairs.join(known, "neighbour")
    return joined.groupBy(test_id).agg(_vote(k, weights).alias("prediction"))


def _vote(k: int, weights: str) -> Column:
    """Aggregate of ``_y`` over the ``k`` nearest of a query."""
    y = F.when(F.col("place") <= k, F.col("_y"))
    if weights == "uniform":
        return F.avg(y)
    weight = F.when(F.col("place") <= k, F.try_divide(F.lit(1.0), F.col("distance")))
    exact = F.avg(F.when(F.col("distance") == 0, y))
    return F.coalesce(exact, F.sum(y * weight) / F.sum(weight))


class KnnRegressor:
    """The neighbours with the interface of the other regressors."""

    def __init__(
        self,
        id_col: str = "id",
        label: str = "label",
        features: str = "features",
        k: int = 5,
        p: int = 2,
        weights: str = "uniform",
    ) -> None:
        self.id_col, self.label, self.features = id_col, label, features
        self.k, self.p, self.weights = k, p, weights

    def fit(self, train: DataFrame) -> KnnRegressorModel:
        return KnnRegressorModel(self, train)


class KnnRegressorModel:
    def __init__(self, spec: KnnRegressor, train: DataFrame) -> None:
        self.spec, self.train = spec, train

    def transform(self, df: DataFrame) -> DataFrame:
        s = self.spec
        sides = [d.withColumn("_vec", vector_to_array(s.features)) for d in (self.train, df)]
        predicted = knn_regression(
            *sides, s.id_col, s.id_col, "_vec", s.label, s.k, s.p, s.weights
        )
        return df.join(predicted, s.id_col)


def knn_search(
    rows: DataFrame,
    id_col: str,
    vector: str,
    target: str,
    ks: Sequence[int] = (3, 5, 7),
    ps: Sequence[int] = (1, 2),
    weightings: Sequence[str] = ("uniform", "distance"),
    folds: int = 5,
    seed: int = 42,
) -> DataFrame:
    """Cross-validated R² of every setting: ``p, k, weights, R2``.

    The neighbours of a fold are found once per metric, for the largest k;
    all other settings are aggregates over them. What a fold has written is
    deleted behind it, so that the disk holds one fold at a time.
    """
    fold = F.pmod(F.conv(F.substring(hash_key(id_col, seed), 1, 7), 16, 10).cast("long"), F.lit(folds))
    cut = written(rows.withColumn("_fold", fold), "knn-folds")
    known = cut.select(
        F.col(id_col).cast("long").alias("neighbour"), F.col(target).cast("double").alias("_y")
    )
    actual = cut.select(id_col, F.col(target).cast("double").alias("label"))
    y, yhat = F.col("label"), F.col("prediction")
    r2 = 1 - F.try_divide(F.sum((y - yhat) * (y - yhat)), F.var_pop(y) * F.count(y))
    spark, scores = rows.sparkSession, []
    for p in ps:
        for f in range(folds):
            held = set(intermediates(spark))
            train, test = cut.where(F.col("_fold") != f), cut.where(F.col("_fold") == f)
            near = nearest(train, test, id_col, id_col, vector, max(ks), p).join(known, "neighbour")
            votes = [
                _vote(k, w).alias(f"{k}|{w}") for k in ks for w in weightings
            ]
            voted = near.groupBy(id_col).agg(*votes).join(actual, id_col)
            long = voted.unpivot(
                [id_col, "label"], [f"{k}|{w}" for k in ks for w in weightings], "setting", "prediction"
            )
            scores += [(p, *r) for r in long.groupBy("setting").agg(r2.alias("r2")).collect()]
            # A fold's cells and visits are as large as the rows; the next one needs none of them.
            release(spark, [path for path in intermediates(spark) if path not in held])
            collect_garbage(spark)
    per_fold = spark.createDataFrame(scores, "p int, setting string, r2 double")
    return per_fold.groupBy("p", "setting").agg(F.avg("r2").alias("R2")).select(
        "p",
        F.substring_index("setting", "|", 1).cast("int").alias("k"),
        F.substring_index("setting", "|", -1).alias("weights"),
        "R2",
    )
