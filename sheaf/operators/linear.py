"""Linear models on many train/test splits, from sums made in one pass.

A split takes part in a fit only through the counts, sums and products of its
train rows. These add up, so one pass makes them for all splits, as products of
matrices in the tasks; a second one measures the errors of all fits. What comes
to the driver depends on the numbers of splits, models and features alone.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from sheaf.functions.hashes import md5_heads
from sheaf.operators.order_stats import HASH_DIGITS
from sheaf.session import written

# A direction with less than this share of the variance holds none.
NO_VARIANCE = 1e-12


@dataclass(frozen=True)
class Moments:
    """Rows, means and centred products of the features and, last, the label."""

    n: float
    means: np.ndarray
    products: np.ndarray

    @property
    def gram(self) -> np.ndarray:
        return self.products[:-1, :-1]

    @property
    def cross(self) -> np.ndarray:
        return self.products[:-1, -1]


Solver = Callable[[Moments], np.ndarray]


def least_squares(m: Moments) -> np.ndarray:
    """Coefficients of least squares, the shortest ones where several fit."""
    scale = np.sqrt(np.diag(m.gram))
    scale = np.where(scale > 0, scale, 1.0)
    unit = m.gram / np.outer(scale, scale)
    return np.linalg.pinv(unit, rcond=NO_VARIANCE, hermitian=True) @ (m.cross / scale) / scale


def ridge(alpha: float = 1.0) -> Solver:
    """Penalty ``alpha`` on the squared coefficients, next to the sum of squared errors."""
    return lambda m: np.linalg.solve(m.gram + alpha * np.eye(len(m.cross)), m.cross)


def lasso(alpha: float = 1.0, rounds: int = 10_000, tolerance: float = 1e-12) -> Solver:
    """Penalty ``alpha`` on the sizes of the coefficients, next to half the mean squared error, by coordinate descent."""

    def solve(m: Moments) -> np.ndarray:
        w, own = np.zeros(len(m.cross)), np.diag(m.gram)
        for _ in range(rounds):
            before = w.copy()
            for j in np.flatnonzero(own > 0):
                rho = m.cross[j] - m.gram[j] @ w + own[j] * w[j]
                w[j] = np.sign(rho) * max(abs(rho) - m.n * alpha, 0.0) / own[j]
            if (np.abs(w - before) <= tolerance * np.abs(w).max()).all():
                break
        return w

    return solve


SOLVERS: dict[str, Solver] = {"Linear Regression": least_squares, "Ridge": ridge(), "Lasso": lasso()}


# Half the width, in standard deviations of the hashes below a cut, of the stretch of hashes that is ranked.
CUT_SPREAD = 6.0


def split_marks(df: DataFrame, id_col: str, seeds: Sequence[int], test_share: float = 0.2, packed: bool = False) -> DataFrame:
    """Add ``is_test``, an array with a mark for each seed: the splits of ``train_test``, exact for each.

    ``packed`` gives a byte for each mark instead, 255 where there is none.

    Hashes are even, so a cut falls into a narrow stretch of them. One pass hashes
    every row for every seed and tells whether it lies below, inside or above the
    stretch; the few rows inside are ranked. Where many rows share an id a cut
    may lie elsewhere: such seeds are ranked again over all their rows, by bucket.
    Rows of one id stay on one side.
    """
    seeds = list(seeds)
    if not seeds:
        return df.withColumn("is_test", F.lit(b"") if packed else F.array().cast("array<boolean>"))
    n = df.count()
    wanted = math.ceil(n * test_share)
    half = CUT_SPREAD * math.sqrt(test_share * (1 - test_share) / max(n, 1)) + 1 / max(n, 1)
    low, high = (min(max(int(x * 2**32), 0), 2**32) for x in (test_share - half, test_share + half))
    tails = [f"-{s}" for s in seeds]

    @F.arrow_udf("binary")
    def placed(ids: pa.Array) -> pa.Array:
        heads = md5_heads(ids.drop_null(), tails)
        places = (heads >= low).astype(np.int8) + (heads >= high) - 1
        return _packed(places.astype(np.int8), ids.is_valid().to_numpy(zero_copy_only=False))

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            row, k = np.nonzero(_unpacked(batch.column(1), len(seeds)) == 0)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.flatnonzero(known)[row])), pa.array(k, pa.int32())], names=["_id", "_k"])

    held = written(df.withColumn("_place", placed(F.col(id_col).cast("string"))), "split-places")
    kind = df.schema[id_col].dataType.simpleString()
    inside = held.select(id_col, "_place").mapInArrow(within, f"_id {kind}, _k int")
    below = _below(held, len(seeds))
    names = F.array(*[F.lit(s) for s in seeds])
    left = [wanted - x for x in below]
    inside = inside.withColumn("_s", F.get(names, F.col("_k"))).withColumn(
        "_h", F.md5(F.concat(F.col("_id").cast("string"), F.lit("-"), F.col("_s")))
    )
    inside = inside.withColumn("_r", F.row_number().over(W.partitionBy("_k").orderBy("_h", "_id")))
    last = inside.where(F.col("_r") == F.get(F.array(*[F.lit(x) for x in left]), F.col("_k")))
    cuts = {r["_s"]: (r["_h"], r["_id"]) for r in last.select("_s", "_h", "_id").collect()}
    # A cut outside its stretch: fewer rows below and inside than wanted, or enough below.
    rest = [s for s in seeds if s not in cuts] if wanted else []
    cuts |= _ranked_cuts(df, id_col, rest, test_share) if rest else {}

    # The few rows inside a stretch are hashed again, and all rows for the seeds in ``rest``.
    bounds = [cuts[s][0] if s in cuts else "" for s in seeds]
    again = [k for k, s in enumerate(seeds) if s in rest and s in cuts]
    without = [k for k, s in enumerate(seeds) if s not in cuts]

    @F.arrow_udf("binary" if packed else "array<boolean>")
    def marked(ids: pa.Array, places: pa.Array) -> pa.Array:
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        names = ids.drop_null().to_pylist()
        place = _unpacked(places, len(seeds))
        marks = place < 0
        for i, k in {*zip(*(x.tolist() for x in np.nonzero(place == 0)), strict=True), *((i, k) for k in again for i in range(len(names)))}:
            marks[i, k] = hashlib.md5(f"{names[i]}{tails[k]}".encode()).hexdigest() <= bounds[k]
        whole, missing = np.zeros((len(ids), len(seeds)), bool), np.repeat(~known[:, None], len(seeds), axis=1)
        whole[known] = marks
        for k in without:
            whole[:, k] = missing[:, k] = False
        if packed:
            return _packed(np.where(missing, 255, whole).astype(np.uint8), np.ones(len(ids), bool))
        ends = np.arange(len(ids) + 1, dtype=np.int32) * len(seeds)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(whole.ravel(), mask=missing.ravel()))

    return held.withColumn("is_test", marked(F.col(id_col).cast("string"), "_place")).drop("_place")


def _packed(values: np.ndarray, known: np.ndarray) -> pa.Array:
    """Rows of bytes as one value each, null where none is known; ``values`` holds the known ones."""
    ends = np.append(0, np.cumsum(known * values.shape[1])).astype(np.int32)
    valid = None if known.all() else pa.py_buffer(np.packbits(known, bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.binary(), len(known), [valid, pa.py_buffer(ends.tobytes()), pa.py_buffer(values.tobytes())])


def _unpacked(column: pa.Array, width: int, kind: type = np.int8) -> np.ndarray:
    """The known rows of ``_packed``."""
    return np.frombuffer(b"".join(column.drop_null().to_pylist()), kind).reshape(-1, width)


def _below(held: DataFrame, seeds: int) -> list[int]:
    """How many rows lie below the stretch of each seed."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(seeds, np.int64)
        for batch in batches:
            # Rows without an id come first, as nulls do.
            total += (_unpacked(batch.column(0), seeds) < 0).sum(axis=0) + batch.column(0).null_count
        yield pa.RecordBatch.from_pydict({"k": pa.array(range(seeds), pa.int32()), "n": total})

    found = held.select("_place").mapInArrow(add, "k int, n bigint").groupBy("k").agg(F.sum("n")).collect()
    counts = [0] * seeds
    for k, n in found:
        counts[k] = n
    return counts


def _ranked_cuts(df: DataFrame, id_col: str, seeds: Sequence[int], test_share: float) -> dict[int, tuple[str, object]]:
    """Hash and id of the last test row of each seed, wherever it is.

    One pass counts hashes by their leading digits for all seeds, the next ranks
    the rows of the digits in which a cut falls.
    """
    ids = df.select(F.col(id_col).alias("_id"), F.explode(F.array(*[F.lit(s) for s in seeds])).alias("_s"))
    hashed = ids.withColumn("_h", F.md5(F.concat(F.col("_id").cast("string"), F.lit("-"), "_s")))
    hashed = hashed.withColumn("_b", F.substring("_h", 1, HASH_DIGITS))
    upto = W.partitionBy("_s").orderBy("_b").rowsBetween(W.unboundedPreceding, W.currentRow)
    ends = hashed.groupBy("_s", "_b").agg(F.count("*").alias("_n")).withColumn("_end", F.sum("_n").over(upto))
    wanted = F.ceil(F.max("_end").over(W.partitionBy("_s")) * F.lit(test_share))
    place = ends.withColumn("_wanted", wanted).where("_end >= _wanted and _end - _n < _wanted")
    # One row for each seed.
    place = written(place.select("_s", "_b", (F.col("_wanted") - F.col("_end") + F.col("_n")).alias("_left")), "cuts")
    ranked = hashed.join(F.broadcast(place), ["_s", "_b"]).withColumn(
        "_r", F.row_number().over(W.partitionBy("_s").orderBy("_h", "_id"))
    )
    return {r["_s"]: (r["_h"], r["_id"]) for r in ranked.where("_r = _left").select("_s", "_h", "_id").collect()}


def _table(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Features with the label behind them, and the packed marks as 0 and 1, NaN where there is none."""
    n = batch.num_rows
    x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
    tests = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(n, -1)
    marks = np.where(tests == 255, np.nan, tests) if (tests == 255).any() else tests.astype(np.float64)
    return np.column_stack([x, batch.column(1).to_numpy(zero_copy_only=False)]), marks


def moments(marked: DataFrame, seeds: int) -> tuple[list[Moments], list[Moments]]:
    """Moments of the train and the test rows of every split of ``x, y, is_test``."""
    first = marked.select(F.size("x")).first()
    if first is None:
        return [], []
    width = first[0] + 1
    column = [F.col("x")[i] for i in range(width - 1)] + [F.col("y")]
    scales = marked.agg(*(F.avg(c) for c in column), *(F.stddev_pop(c) for c in column)).first()
    shift = np.array(scales[:width])
    scale = np.array([s if s > 0 else 1.0 for s in scales[width:]])
    i, j = np.triu_indices(width + 1)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((seeds + 1, len(i)))
        for batch in batches:
            if batch.num_rows:
                values, tests = _table(batch)
                z = np.column_stack([np.ones(len(values)), (values - shift) / scale])
                products = z[:, i] * z[:, j]
                total[:-1] += tests.T @ products
                total[-1] += products.sum(axis=0)
        split, place = np.indices(total.shape)
        yield pa.RecordBatch.from_pydict(
            {"split": pa.array(split.ravel(), pa.int32()), "place": pa.array(place.ravel(), pa.int32()), "value": total.ravel()}
        )

    parts = marked.select("x", "y", "is_test").mapInArrow(add, "split int, place int, value double")
    sums = np.zeros((seeds + 1, len(i)))
    for split, place, value in parts.groupBy("split", "place").agg(F.sum("value")).collect():
        sums[split, place] = value

    def side(flat: np.ndarray) -> Moments:
        whole = np.zeros((width + 1, width + 1))
        whole[i, j] = whole[j, i] = flat
        n = max(whole[0, 0], 1.0)
        centred = whole[1:, 1:] - np.outer(whole[0, 1:], whole[0, 1:]) / n
        own = np.diag(centred)
        # What rounding leaves of a constant column.
        flat_columns = own <= NO_VARIANCE * np.maximum(np.diag(whole)[1:], 1e-300)
        centred[flat_columns, :] = centred[:, flat_columns] = 0.0
        return Moments(whole[0, 0], shift + scale * whole[0, 1:] / n, centred * np.outer(scale, scale))

    return [side(sums[-1] - s) for s in sums[:-1]], [side(s) for s in sums[:-1]]


def repeated_fits(
    df: DataFrame,
    id_col: str,
    split_seeds: Sequence[int],
    solvers: Mapping[str, Solver] = SOLVERS,
    features: str = "features",
    label: str = "label",
) -> tuple[DataFrame, dict[tuple[str, int], tuple[float, np.ndarray]]]:
    """Fit every model on every 80/20 split: rows ``Model, Seed, R2, MAE, MSE``, and intercept and coefficients.

    ``features`` is a vector. A feature without variance among the train rows,
    such as the mark of a category they lack, has coefficient 0. Rows with a
    null label do not take part. Metrics of a split without test rows are null;
    an empty table gives no fit.
    """
    spark, split_seeds = df.sparkSession, list(split_seeds)
    rows = df.where(F.col(label).isNotNull()).select(
        F.col(id_col), vector_to_array(features).alias("x"), F.col(label).cast("double").alias("y")
    )
    marked = written(split_marks(rows, id_col, split_seeds, packed=True).drop(id_col), "split-rows")
    train, test = moments(marked, len(split_seeds))
    kind = "Model string, Seed int, R2 double, MAE double, MSE double"
    if not train:
        return spark.createDataFrame([], kind), {}
    fits = {}
    for name, solve in solvers.items():
        for seed, m in zip(split_seeds, train, strict=True):
            w = solve(m)
            fits[name, seed] = float(m.means[-1] - m.means[:-1] @ w), w
    order = [(name, seed) for name in solvers for seed in split_seeds]
    intercepts = np.array([fits[k][0] for k in order])
    weights = np.array([fits[k][1] for k in order]).T

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, len(order)))
        for batch in batches:
            if batch.num_rows:
                values, tests = _table(batch)
                missed = values[:, -1:] - values[:, :-1] @ weights - intercepts
                own = np.tile(tests, (1, len(solvers)))
                total += [(np.abs(missed) * own).sum(axis=0), (missed * missed * own).sum(axis=0)]
        yield pa.RecordBatch.from_pydict({"fit": pa.array(range(len(order)), pa.int32()), "absolute": total[0], "squared": total[1]})

    parts = marked.select("x", "y", "is_test").mapInArrow(measure, "fit int, absolute double, squared double")
    errors = {r[0]: r[1:] for r in parts.groupBy("fit").agg(F.sum("absolute"), F.sum("squared")).collect()}
    out = []
    for k, (name, seed) in enumerate(order):
        held = test[split_seeds.index(seed)]
        spread = float(held.products[-1, -1])
        if held.n:
            r2 = 1 - errors[k][1] / spread if spread > 0 else None
            out.append((name, seed, r2, errors[k][0] / float(held.n), errors[k][1] / float(held.n)))
        else:
            out.append((name, seed, None, None, None))
    return spark.createDataFrame(out, kind), fits
