"""Whitening of embeddings by the covariance of their distinct vectors.

Vectors are turned into integers, and equal ones into one group with its number
of copies. The fit gives every group a weight, its count or one, so the sums run
over distinct vectors however often each occurs. Tasks centre their vectors on
the exact mean and multiply them as matrices; the products, whose size depends
on the dimensions alone, are added up by Spark. Each distinct vector is whitened
once and the result joined back to the rows that hold it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf.session import written

# Groups above one in so many of all rows meet their rows through a broadcast;
# there are fewer of them than this number.
HOT_SHARE = 1_000
# An eigenvalue counts as zero below this share of the largest, for each dimension.
ZERO_SHARE = 2.0**-50
LONG = 1 << 63


def usable(vector: Column) -> Column:
    """Neither null nor with a null, NaN or infinite entry."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False))


def quantized(rows: DataFrame, vector: str, scale: int) -> DataFrame:
    """The rows with usable vectors, as ``row`` and ``x``: ``floor(scale * c)`` of every entry as double.

    Beyond the range of a long an entry takes the nearest long.
    """
    made = rows.filter(usable(rows[f"`{vector}`"]))
    x = F.transform(made[f"`{vector}`"], lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("bigint"))
    return made.select(F.struct(*(made[f"`{c}`"] for c in made.columns)).alias("row"), x.alias("x"))


def grouped(x: DataFrame, weights: str = "one") -> DataFrame:
    """``x, copies, weight``: each distinct vector with its number of rows and its weight in the fit."""
    counts = x.groupBy("x").agg(F.count(F.lit(1)).alias("copies"))
    return counts.withColumn("weight", F.col("copies") if weights == "count" else F.lit(1).cast("bigint"))


def matrix(column: pa.Array, width: int, kind: type) -> np.ndarray:
    """Rows of a list column; shorter ones end in zeros."""
    values, lengths = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    if (lengths == width).all():
        return values.reshape(len(lengths), width).astype(kind, copy=False)
    out = np.zeros((len(lengths), width), kind)
    out[np.arange(width) < lengths[:, None]] = values
    return out


def exact_sums(x: np.ndarray, weight: np.ndarray) -> list[int]:
    """Weighted sums of each column, in whole numbers of any size."""
    if not x.size:
        return [0] * x.shape[1]
    most = max(abs(int(x.max())), abs(int(x.min()))) * int(weight.max()) * len(x)
    if most < LONG:
        return (x * weight[:, None]).sum(axis=0).tolist()
    return (x.astype(object) * weight.astype(object)[:, None]).sum(axis=0).tolist()


def totals(groups: DataFrame) -> tuple[int, list[int]]:
    """Sum of weights, and exact weighted sums of every dimension."""
    width = groups.agg(F.max(F.size("x"))).first()[0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = [0] * width, 0
        for batch in batches:
            weight = batch.column(1).to_numpy()
            own = exact_sums(matrix(batch.column(0), width, np.int64), weight)
            sums, n = [a + b for a, b in zip(sums, own, strict=True)], n + int(weight.sum())
        if n:
            yield pa.RecordBatch.from_pydict(
                {"dim": pa.array(range(-1, width), pa.int32()),
                 "sum": pa.array([Decimal(v) for v in (n, *sums)], pa.decimal128(38, 0))}
            )

    parts = groups.select("x", "weight").mapInArrow(run, "dim int, sum decimal(38,0)")
    # One row for each dimension.
    found = {r["dim"]: int(r["sum"]) for r in parts.groupBy("dim").agg(F.sum("sum").cast("decimal(38,0)").alias("sum")).collect()}
    return found.get(-1, 0), [found.get(i, 0) for i in range(width)]


def covariance(vectors: DataFrame, column: str, mean: np.ndarray, n: int) -> np.ndarray:
    """Weighted covariance with divisor ``n``: rows are centred, then multiplied."""
    width = len(mean)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            centred = matrix(batch.column(0), width, np.float64) - mean
            total += (centred * batch.column(1).to_numpy()[:, None]).T @ centred
        i, j = np.triu_indices(width)
        keep = total[i, j] != 0
        if keep.any():
            yield pa.RecordBatch.from_pydict(
                {"i": pa.array(i[keep], pa.int32()), "j": pa.array(j[keep], pa.int32()), "value": total[i, j][keep]}
            )

    parts = vectors.select(column, "weight").mapInArrow(run, "i int, j int, value double")
    out = np.zeros((width, width))
    # Half the square of the dimensions.
    for i, j, value in parts.groupBy("i", "j").agg(F.sum("value")).collect():
        out[i, j] = out[j, i] = value / n
    return out


@dataclass(frozen=True)
class Whitening:
    """``components`` has one unit eigenvector a row, by falling eigenvalue."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def fit(groups: DataFrame, components: int) -> Whitening:
    """The leading components of the weighted covariance of ``groups`` (``x, weight``).

    Components without variance cannot be scaled to one and are left out.
    """
    n, sums = totals(groups)
    if not n or not sums:
        return Whitening(n, tuple(sums), np.zeros((0, len(sums))), np.zeros(0), 0.0)
    v = covariance(groups, "x", np.array([s / n for s in sums]), n)
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")[:components]
    order = order[values[order] > ZERO_SHARE * len(sums) * max(values.max(), 0.0)]
    units = vectors[:, order].T
    # The entry of largest size is positive, so that a repeated fit has the same signs.
    units = units * np.sign(units[np.arange(len(units)), np.abs(units).argmax(axis=1)])[:, None]
    return Whitening(n, tuple(sums), units, values[order], float(np.trace(v)))


def deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int | None]:
    """Exact sums of ``(n * x - sums) ** 2`` over each row; None beyond a long."""
    if not x.size:
        return [0] * len(x)
    most = n * max(abs(int(x.max())), abs(int(x.min()))) + max(map(abs, sums))
    if most * most * len(sums) < LONG:
        return ((n * x - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
    exact = ((n * x.astype(object) - np.array(sums, object)) ** 2).sum(axis=1).tolist()
    return [v if v < LONG else None for v in exact]


def transformed(groups: DataFrame, model: Whitening) -> DataFrame:
    """``x, copies, weight, deviation, z``: every distinct vector, whitened."""
    width, mean = len(model.sums), model.mean
    scaled = (model.components / np.sqrt(model.eigenvalues)[:, None]).T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(0), width, np.int64)
            z = (x.astype(np.float64) - mean) @ scaled
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1) * z.shape[1], pa.int32()), pa.array(z.ravel()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(deviations(x, model.n, model.sums), pa.int64()), lists],
                names=["x", "copies", "weight", "deviation", "z"],
            )

    made = groups.select("x", "copies", "weight")
    return made.mapInArrow(run, "x array<bigint>, copies bigint, weight bigint, deviation bigint, z array<double>")


def identity_error(white: DataFrame, model: Whitening) -> float:
    """Largest entry of the whitened vectors' covariance minus the identity."""
    k = len(model.eigenvalues)
    means = white.agg(*(F.sum(F.col("z")[i] * F.col("weight")) for i in range(k))).first()
    v = covariance(white, "z", np.array(means, np.float64) / model.n, model.n)
    return float(np.abs(v - np.eye(k)).max())


def joined_back(rows: DataFrame, white: DataFrame, hot_share: int = HOT_SHARE) -> DataFrame:
    """Every row with what ``white`` holds for its ``x``.

    A group of more than one in ``hot_share`` rows is among fewer than
    ``hot_share`` groups: these go to where their rows are, and no key of the
    shuffled join holds a larger share of the rows.
    """
    most = (white.agg(F.sum("copies")).first()[0] or 0) / hot_share
    keys = white.select("x", "deviation", "z", "copies")
    hot = keys.filter(F.col("copies") > most).drop("copies")
    cold = keys.filter(F.col("copies") <= most).drop("copies")
    marked = rows.join(F.broadcast(hot.withColumnRenamed("x", "hot")), F.col("x") == F.col("hot"), "left")
    direct = marked.filter("hot is not null").select("row", "x", "deviation", "z")
    others = marked.filter("hot is null").select("row", "x").join(cold, "x").select("row", "x", "deviation", "z")
    return direct.unionByName(others)


def whiten(
    rows: DataFrame, vector: str = "embedding", components: int = 4, scale: int = 256, weights: str = "one"
) -> DataFrame:
    """Project every vector on the leading components, each scaled to variance one.

    The fit takes each distinct quantized vector with weight 1 (``weights``
    ``"one"``) or with its number of rows (``"count"``).

    Returns for each row with a usable vector and each component: ``row`` (all
    its columns), ``component`` from 1, ``n`` (sum of weights), ``deviation``
    (exact; null beyond a long), ``whitened``, ``explained`` and
    ``identity_error``.

    Rows whose vector is null or holds a null, NaN or infinite entry are left
    out; repeated rows and ids are rows of their own; a shorter vector goes on
    in zeros. There are as many components as have variance: fewer than asked
    for if the vectors span less, and none, so no rows, if all vectors are equal
    or the table is empty. Distinct and whitened vectors are written to the
    shared folder, each once.
    """
    quant = quantized(rows, vector, scale)
    groups = written(grouped(quant.select("x"), weights), "distinct")
    model = fit(groups, components)
    if not len(model.eigenvalues):
        shape = T.StructType([T.StructField("row", rows.schema, False)])
        for name, kind in (("component", T.IntegerType()), ("n", T.LongType()), ("deviation", T.LongType())):
            shape = shape.add(name, kind)
        for name in ("whitened", "explained", "identity_error"):
            shape = shape.add(name, T.DoubleType())
        return rows.sparkSession.createDataFrame([], shape)
    white = written(transformed(groups, model), "whitened")
    error = identity_error(white, model)
    shares = F.array(*(F.lit(float(e) / model.trace) for e in model.eigenvalues))
    each = joined_back(quant, white).select("row", "deviation", F.posexplode("z").alias("at", "whitened"))
    return each.select(
        "row",
        (F.col("at") + 1).alias("component"),
        F.lit(model.n).cast("bigint").alias("n"),
        "deviation",
        "whitened",
        F.element_at(shares, F.col("at") + 1).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
