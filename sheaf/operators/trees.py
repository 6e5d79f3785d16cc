"""Regression trees from sums over cells of binned features.

A tree only sees the bin of a value, so rows that share the bins of all features
count through their number, weight and weighted label alone. One pass adds these
up by cell; the tree is then grown on the cells. Bins are limited, so the number
of cells is, whatever the values and the number of rows. Thresholds come from the
rows Spark's trees would draw, and the trees are theirs up to rounding.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml import Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.session import intermediates, release, written

# Rows that thresholds are drawn from, as in Spark's trees.
DRAWN_ROWS = 10_000
# Cells a driver grows trees on; a finer grid is left to Spark's trees.
MAX_CELLS = 1 << 20
# Bytes of stored blocks that are read at once, roughly.
GROUP_BYTES = 16 << 20
# Rounds whose weights are made again from their trees, before they are stored.
PENDING_ROUNDS = 4
_MASK = (1 << 64) - 1


def _hashed(data: bytes, seed: int) -> int:
    """MurmurHash3 of whole words, 32 bits."""
    h = seed
    for i in range(0, len(data), 4):
        k = int.from_bytes(data[i : i + 4], "little") * 0xCC9E2D51 & 0xFFFFFFFF
        h ^= (k << 15 | k >> 17) * 0x1B873593 & 0xFFFFFFFF
        h = ((h << 13 | h >> 19) * 5 + 0xE6546B64) & 0xFFFFFFFF
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & 0xFFFFFFFF
    h = (h ^ h >> 13) * 0xC2B2AE35 & 0xFFFFFFFF
    return h ^ h >> 16


class _Stream:
    """The numbers Spark samples with."""

    def __init__(self, seed: int) -> None:
        data = (seed & _MASK).to_bytes(8, "big")
        low = _hashed(data, 0x3C074A61)
        self.state = _hashed(data, low) << 32 | low

    def bits(self, n: int) -> int:
        s = self.state
        s ^= s << 21 & _MASK
        s ^= s >> 35
        s ^= s << 4 & _MASK
        self.state = s
        return s & (1 << n) - 1

    def uniform(self) -> float:
        high = self.bits(26) << 27
        return (high + self.bits(27)) * 2.0**-53


def drawn_rows(rows: Mapping[int, int], share: float, seed: int) -> dict[int, np.ndarray]:
    """Places drawn from each part, by the number of its rows: those ``RDD.sample`` draws in a tree of this seed."""
    if share >= 1:
        return {part: np.arange(n) for part, n in rows.items()}
    first = _Stream(seed).bits(32)
    state = ((first - (1 << 32) if first >> 31 else first) ^ 0x5DEECE66D) & (1 << 48) - 1
    out = {}
    for part in range(max(rows, default=-1) + 1):
        words = []
        for _ in range(2):
            state = (state * 0x5DEECE66D + 0xB) & (1 << 48) - 1
            word = state >> 16
            words.append(word - (1 << 32) if word >> 31 else word)
        stream, n, places = _Stream((words[0] << 32) + words[1]), rows.get(part, 0), []
        if share > 0.4:
            places = [i for i in range(n) if stream.uniform() <= share]
        else:
            step, at = math.log1p(-share), 0
            while (at := at + int(math.log(max(stream.uniform(), 5e-11)) / step)) < n:
                places.append(at)
                at += 1
        out[part] = np.array(places, np.int64)
    return out


def thresholds(values: np.ndarray, weights: np.ndarray, expected: float, most: int) -> np.ndarray:
    """At most ``most`` thresholds between drawn values, of even weight where there are more values.

    ``expected`` is the weight the draw stands for; what it lacks counts as zeros.
    """
    known = values != 0
    distinct, place = np.unique(values[known], return_inverse=True)
    if not len(distinct):
        return np.zeros(0)
    counts = np.bincount(place, weights[known], len(distinct))
    zeros = expected - counts.sum()
    if zeros > 2.0**-52 * expected * 100:
        at = int(np.searchsorted(distinct, 0.0))
        distinct, counts = np.insert(distinct, at, 0.0), np.insert(counts, at, zeros)
    between = (distinct[:-1] + distinct[1:]) / 2
    if len(between) <= most:
        return between
    stride = expected / (most + 1)
    chosen, upto, target = [], counts[0], stride
    for i in range(1, len(distinct)):
        before, upto = upto, upto + counts[i]
        if abs(before - target) < abs(upto - target):
            chosen.append(between[i - 1])
            target += stride
    return np.array(chosen)


@dataclass(frozen=True)
class Grid:
    """Cells of rows: ``cuts`` of each feature, and the combinations of the ``flags`` among the rows."""

    cuts: tuple[np.ndarray, ...]
    flags: tuple[int, ...]
    patterns: np.ndarray

    @property
    def shape(self) -> tuple[int, ...]:
        return (*(len(c) + 1 for j, c in enumerate(self.cuts) if j not in self.flags), max(1, len(self.patterns)))

    @property
    def size(self) -> int:
        return math.prod(self.shape)

    def cells(self, x: np.ndarray) -> np.ndarray:
        """The cell of each column of ``x``, which has a row for each feature."""
        bins = [np.searchsorted(c, x[j]) for j, c in enumerate(self.cuts) if j not in self.flags]
        bins.append(np.searchsorted(self.patterns, pattern(x, self.flags)))
        return np.ravel_multi_index(bins, self.shape)

    def bins(self, cells: np.ndarray) -> list[np.ndarray]:
        """The bin of each feature of given cells."""
        *own, marks = np.unravel_index(cells, self.shape)
        left = iter(own)
        held = self.patterns[marks] if len(self.patterns) else np.zeros(len(cells), np.int64)
        return [held >> self.flags.index(j) & 1 if j in self.flags else next(left) for j in range(len(self.cuts))]


def pattern(x: np.ndarray, flags: Sequence[int]) -> np.ndarray:
    """The flags of each column of ``x`` as bits of one number."""
    out = np.zeros(x.shape[1], np.int64)
    for bit, j in enumerate(flags):
        out |= (x[j] != 0).astype(np.int64) << bit
    return out


@dataclass(frozen=True)
class Tree:
    """Nodes by number, the root first: ``feature`` is -1 at a leaf; values up to ``cut`` go to ``left``, others to the next node."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        """The prediction of each column of ``x``."""
        leaf = np.zeros(x.shape[1], np.int8 if len(self.feature) < 128 else np.int32)
        for node in np.flatnonzero(self.feature >= 0):
            # Nodes come after their parents.
            own = leaf == node
            leaf += own * leaf.dtype.type(self.left[node] - node)
            leaf += own & (x[self.feature[node]] > self.cut[node])
        return self.value[leaf]


def grow(
    grid: Grid,
    bins: Sequence[np.ndarray],
    rows: np.ndarray,
    weight: np.ndarray,
    total: np.ndarray,
    depth: int,
    least_rows: int = 1,
    least_gain: float = 0.0,
) -> tuple[Tree, np.ndarray]:
    """A tree of least squares over cells, and its prediction for each of them.

    ``rows``, ``weight`` and ``total`` hold the number of rows, their weight and
    weighted label of each cell. Of equal gains the first feature and threshold win.
    """
    feature, cut, left, value, gains = [-1], [np.nan], [-1], [total.sum() / weight.sum()], [0.0]
    node, open_nodes = np.zeros(len(rows), np.int64), [0]
    for _ in range(depth):
        if not open_nodes:
            break
        place = np.full(len(feature), -1)
        place[open_nodes] = np.arange(len(open_nodes))
        some = np.flatnonzero(place[node] >= 0)
        own = place[node[some]]
        best = [(least_gain, -1, 0)] * len(open_nodes)
        for j, cuts in enumerate(grid.cuts):
            if not len(cuts):
                continue
            width = len(cuts) + 1
            at = own * width + bins[j][some]
            n, w, s = (np.bincount(at, v[some], len(open_nodes) * width).reshape(-1, width) for v in (rows, weight, total))
            mean = (s.sum(axis=1) / w.sum(axis=1))[:, None]
            n_left, w_left, s_left = (v.cumsum(axis=1)[:, :-1] for v in (n, w, s))
            w_right = w.sum(axis=1, keepdims=True) - w_left
            allowed = (n_left >= least_rows) & (n.sum(axis=1, keepdims=True) - n_left >= least_rows)
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = (s_left - w_left * mean) ** 2 * (1 / w_left + 1 / w_right) / w.sum(axis=1, keepdims=True)
            # What rounding leaves of equal labels is no gain.
            gain = np.where(allowed & (gain > (1e-13 * mean) ** 2), gain, -1.0)
            for k, c in enumerate(gain.argmax(axis=1)):
                if gain[k, c] > max(best[k][0], 0.0) or (best[k][1] < 0 and gain[k, c] >= max(least_gain, 1e-300)):
                    best[k] = (gain[k, c], j, int(c))
        after = []
        for k, (gain, j, c) in enumerate(best):
            if j < 0:
                continue
            parent, mine = open_nodes[k], some[own == k]
            feature[parent], cut[parent], left[parent] = j, float(grid.cuts[j][c]), len(feature)
            gains[parent] = gain * weight[mine].sum()
            right = bins[j][mine] > c
            node[mine] = len(feature) + right
            for side in (mine[~right], mine[right]):
                after.append(len(feature))
                feature.append(-1), cut.append(np.nan), left.append(-1), gains.append(0.0)
                value.append(total[side].sum() / weight[side].sum())
        open_nodes = after
    tree = Tree(*(np.array(v) for v in (feature, cut, left, value, gains)))
    return tree, tree.value[node]


def matrix(column: pa.Array) -> np.ndarray:
    """A row for each feature, from lists of equal length."""
    return np.ascontiguousarray(column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).T)


class CellRows:
    """Feature vectors and labels, as often as a fit reads them.

    ``flags`` are the features marked as binary, all others are numbers. ``usable``
    tells whether cells can stand for the rows; if not, Spark's trees are asked.
    """

    def __init__(self, df: DataFrame, features: str, label: str) -> None:
        attrs = df.schema[features].metadata.get("ml_attr", {}).get("attrs", {})
        self.flags = tuple(a["idx"] for a in attrs.get("binary", []))
        self.usable = not attrs.get("nominal") and len(self.flags) < 63
        self.df = df.select(vector_to_array(features).alias("x"), F.col(label).cast("double").alias("y"))
        flags = list(self.flags)

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, wide, fine, found = 0, -1, True, set()
            for batch in batches:
                if batch.num_rows:
                    fine &= not (batch.column(0).null_count or batch.column(1).null_count)
                    widths = {wide, *batch.column(0).value_lengths().unique().to_pylist()} - {-1}
                    fine &= len(widths) == 1
                    if fine:
                        wide = widths.pop()
                        x, y = matrix(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False)
                        fine &= bool(wide and np.isfinite(x).all() and np.isfinite(y).all())
                        fine &= bool(np.isin(x[flags], (0.0, 1.0)).all())
                        found.update(np.unique(pattern(x, flags)).tolist())
                        fine &= len(found) <= MAX_CELLS
                    n += batch.num_rows
            part = TaskContext.get().partitionId()
            marks = pa.array([sorted(found) if fine else []], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([n], pa.int64()), pa.array([wide], pa.int32()), pa.array([fine]), marks],
                names=["part", "n", "wide", "fine", "marks"],
            )

        if self.usable:
            held = self.df.mapInArrow(measure, "part int, n bigint, wide int, fine boolean, marks array<bigint>").collect()
            self.rows = {r["part"]: r["n"] for r in held}
            self.n = sum(self.rows.values())
            self.patterns = np.array(sorted({m for r in held for m in r["marks"]}), np.int64)
            wide = {r["wide"] for r in held if r["n"]}
            self.usable = self.n > 0 and len(wide) == 1 and all(r["fine"] for r in held)
            self.width = max(wide, default=0)

    def bins(self, max_bins: int) -> int:
        return min(max_bins, self.n)

    def draw(self, seed: int, max_bins: int = 32) -> tuple[dict[int, np.ndarray], float]:
        """The rows a fit takes its thresholds from, by part and place, and their share of all."""
        wanted = max(self.bins(max_bins) ** 2, DRAWN_ROWS)
        share = wanted / self.n if wanted < self.n else 1.0
        return drawn_rows(self.rows, share, seed), share

    def grid(self, x: np.ndarray, weights: np.ndarray, expected: float, max_bins: int = 32) -> Grid:
        """The grid of drawn rows, ``x`` having a row for each feature."""
        half, most = np.array([0.5]), self.bins(max_bins) - 1
        cuts = (half if j in self.flags else thresholds(x[j], weights, expected, most) for j in range(self.width))
        return Grid(tuple(cuts), self.flags, self.patterns)

    def fetch(self, places: Mapping[int, np.ndarray]) -> np.ndarray:
        """The feature vectors at given places."""

        def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            wanted, start = places.get(TaskContext.get().partitionId(), np.zeros(0, np.int64)), 0
            for batch in batches:
                lo, hi = np.searchsorted(wanted, (start, start + batch.num_rows))
                start += batch.num_rows
                if hi > lo:
                    first = start - batch.num_rows
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(wanted[lo:hi] - first))], names=["x"])

        found = [r[0] for r in self.df.select("x").mapInArrow(pick, "x array<double>").collect()]
        return np.array(found, np.float64).reshape(len(found), -1).T

    def sums(self, grid: Grid) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cells with rows, their number and the sum of their labels."""
        size = grid.size

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, s = np.zeros(size), np.zeros(size)
            for batch in batches:
                if batch.num_rows:
                    at = grid.cells(matrix(batch.column(0)))
                    n += np.bincount(at, minlength=size)
                    s += np.bincount(at, batch.column(1).to_numpy(zero_copy_only=False), size)
            own = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"cell": own, "n": n[own], "s": s[own]})

        return _summed(self.df.mapInArrow(add, "cell bigint, n double, s double"), ("n", "s"))


def _summed(parts: DataFrame, names: Sequence[str]) -> tuple[np.ndarray, ...]:
    """Sums by cell in the order of the cells, of which there are MAX_CELLS at most."""
    found = parts.groupBy("cell").agg(*[F.sum(c).alias(c) for c in names]).toArrow()
    order = np.argsort(found.column("cell").to_numpy())
    return tuple(found.column(c).to_numpy()[order] for c in ("cell", *names))


class BoostedTrees(GBTRegressor):
    """Spark's boosted regression trees, grown on cells where these can stand for the rows.

    All rounds share the thresholds of the first, so rows of one cell have one
    prediction throughout: their number and the sum of their labels give the
    residuals of every round. Two passes over the rows make the cells.
    """

    def _fit(self, dataset: DataFrame) -> Model:
        plain = (
            self.getLossType() == "squared"
            and self.getSubsamplingRate() == 1.0
            and self.getFeatureSubsetStrategy() in ("auto", "all")
            and self.getMinWeightFractionPerNode() == 0.0
            and not any(self.isDefined(p) and self.getOrDefault(p) for p in (self.weightCol, self.validationIndicatorCol, self.leafCol))
        )
        if plain:
            rows = CellRows(dataset, self.getFeaturesCol(), self.getLabelCol())
            if rows.usable:
                places, share = rows.draw(self.getSeed(), self.getMaxBins())
                x = rows.fetch(places)
                grid = rows.grid(x, np.ones(x.shape[1]), share * rows.n, self.getMaxBins())
                if grid.size <= MAX_CELLS:
                    return self._boosted(rows, grid)
        return super()._fit(dataset)

    def _boosted(self, rows: CellRows, grid: Grid) -> BoostedTreesModel:
        cells, n, s = rows.sums(grid)
        bins, upto, trees = grid.bins(cells), np.zeros(len(cells)), []
        for i in range(self.getMaxIter()):
            left = 2 * (s - n * upto) if i else s
            tree, own = grow(
                grid, bins, n, n, left, self.getMaxDepth(), self.getMinInstancesPerNode(), self.getMinInfoGain()
            )
            trees.append(tree)
            upto = upto + own * (self.getStepSize() if i else 1.0)
        weights = [1.0] + [self.getStepSize()] * (len(trees) - 1)
        return BoostedTreesModel(self.getFeaturesCol(), self.getPredictionCol(), trees, weights, rows.width)


class BoostedTreesModel(Model):
    """Weighted sum of trees."""

    def __init__(self, features: str, predicted: str, trees: Sequence[Tree], weights: Sequence[float], width: int) -> None:
        super().__init__()
        self.features, self.predicted = features, predicted
        self.trees, self.treeWeights, self.numFeatures = list(trees), list(weights), width

    @property
    def featureImportances(self) -> DenseVector:
        """Gain by feature, summed over nodes and the trees' rows, of which all make 1."""
        total = np.zeros(self.numFeatures)
        for tree in self.trees:
            inner = tree.feature >= 0
            np.add.at(total, tree.feature[inner], tree.gain[inner])
        return DenseVector(total / total.sum() if total.sum() else total)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        trees, weights = self.trees, self.treeWeights

        @F.arrow_udf("double")
        def predicted(values: pa.Array) -> pa.Array:
            if not len(values):
                return pa.array([], pa.float64())
            x = matrix(values)
            return pa.array(sum(w * tree.predict(x) for w, tree in zip(weights, trees, strict=True)))

        return dataset.withColumn(self.predicted, predicted(vector_to_array(self.features)))


@dataclass(frozen=True)
class Round:
    """A tree and how its errors change the weights: by ``beta`` to the power of 1 less the error's share of the ``worst``."""

    tree: Tree
    beta: float
    worst: float


class WeightedRows:
    """Rows in blocks with weights that follow rounds of boosting.

    A block holds its features, labels and weights as bytes. Weights of the last
    rounds are made from their trees wherever they are needed and stored after
    every few rounds; the blocks before are then deleted.
    """

    def __init__(self, rows: CellRows) -> None:
        self.rows, self.pending = rows, []
        spark, self.paths = rows.df.sparkSession, []

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            start, part = 0, TaskContext.get().partitionId()
            for batch in batches:
                if batch.num_rows:
                    y = batch.column(1).to_numpy(zero_copy_only=False)
                    yield _block(part, start, matrix(batch.column(0)), y, np.ones(len(y)))
                start += batch.num_rows

        self.spark = spark
        self._store(rows.df.mapInArrow(pack, _BLOCK))

    def _store(self, blocks: DataFrame) -> None:
        known = set(intermediates(self.spark))
        self.blocks = written(blocks, "boost-blocks", **{"parquet.block.size": GROUP_BYTES})
        before, self.paths = self.paths, [p for p in intermediates(self.spark) if p not in known]
        release(self.spark, before)

    def add(self, one: Round) -> None:
        self.pending.append(one)
        if len(self.pending) >= PENDING_ROUNDS:
            held = self._blocks()

            def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for part, start, x, y, w in held(batches):
                    yield _block(part, start, x, y, w)

            self._store(self.blocks.mapInArrow(store, _BLOCK))
            self.pending = []

    def _blocks(self):
        """What reads blocks in a task: part, first place, features, labels and weights of now."""
        pending, width = list(self.pending), self.rows.width

        def held(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
            for batch in batches:
                for part, start, *flat in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                    x, y, w = (np.frombuffer(f, np.float64) for f in flat)
                    x = x.reshape(width, -1)
                    for r in pending:
                        w = w * r.beta ** (1 - np.abs(r.tree.predict(x) - y) / r.worst)
                    yield part, start, x, y, w

        return held

    def draw(self, seed: int) -> tuple[np.ndarray, np.ndarray, float]:
        """Features and weights of the rows thresholds are taken from, and the weight they stand for."""
        places, share = self.rows.draw(seed)
        held = self._blocks()

        def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            whole, found, own = 0.0, [], []
            for part, start, x, _, w in held(batches):
                whole += w.sum()
                wanted = places.get(part, np.zeros(0, np.int64))
                lo, hi = np.searchsorted(wanted, (start, start + len(w)))
                if hi > lo:
                    found.append(x[:, wanted[lo:hi] - start].T)
                    own.append(w[wanted[lo:hi] - start])
            x, w = (np.concatenate(f).tobytes() if f else b"" for f in (found, own))
            yield pa.RecordBatch.from_pydict({"whole": [whole], "x": pa.array([x], pa.binary()), "w": pa.array([w], pa.binary())})

        got = self.blocks.mapInArrow(pick, "whole double, x binary, w binary").collect()
        x, w = (np.frombuffer(b"".join(r[c] for r in got), np.float64) for c in ("x", "w"))
        return x.reshape(len(w), -1).T, w, share * sum(r["whole"] for r in got)

    def sums(self, grid: Grid) -> tuple[np.ndarray, ...]:
        """Cells with rows, their number, weight and weighted label."""
        size, held = grid.size, self._blocks()

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((3, size))
            for _, _, x, y, w in held(batches):
                at = grid.cells(x)
                for out, v in zip(total, (None, w, w * y), strict=True):
                    out += np.bincount(at, v, size)
            own = np.flatnonzero(total[0])
            yield pa.RecordBatch.from_pydict({"cell": own} | dict(zip("nws", total[:, own], strict=True)))

        return _summed(self.blocks.mapInArrow(add, "cell bigint, n double, w double, s double"), ("n", "w", "s"))

    def errors(self, tree: Tree) -> tuple[float, float]:
        """The largest error of a tree, and the mean one by weight."""
        held = self._blocks()

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            worst, missed, whole = 0.0, 0.0, 0.0
            for _, _, x, y, w in held(batches):
                e = np.abs(tree.predict(x) - y)
                worst, missed, whole = max(worst, float(e.max())), missed + float(w @ e), whole + float(w.sum())
            yield pa.RecordBatch.from_pydict({"worst": [worst], "missed": [missed], "whole": [whole]})

        got = self.blocks.mapInArrow(measure, "worst double, missed double, whole double").collect()
        return max(r["worst"] for r in got), sum(r["missed"] for r in got) / sum(r["whole"] for r in got)


_BLOCK = "part int, start bigint, x binary, y binary, w binary"


def _block(part: int, start: int, *values: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array([part], pa.int32()), pa.array([start], pa.int64()), *(pa.array([v.tobytes()], pa.binary()) for v in values)]
    return pa.RecordBatch.from_arrays(columns, names=["part", "start", "x", "y", "w"])
