import math
import random

import numpy as np
import pytest

from sheaf.llm import whitening

KIND = "vec_id long, embedding array<double>"


def vectors(n, width=5):
    pick = random.Random(n)
    rows = [(i, [pick.gauss(0.1, 1 + j) for j in range(width)]) for i in range(n)]
    rows += [(n + i, list(rows[0][1])) for i in range(n)]  # one vector on half of all rows
    return rows + [(3 * n, None), (3 * n + 1, [1.0, None] + [0.0] * (width - 2)), (3 * n + 2, [math.nan] * width),
                   (3 * n + 3, [math.inf] * width), (None, rows[1][1]), (7, rows[2][1])]


def brute(rows, k, weighted=False, scale=256):
    """``(id, component) -> n, deviation, |whitened|, explained`` by plain numpy, and whether e is apart from its neighbours."""
    kept = [(i, tuple(math.floor(scale * c) for c in v)) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = [x for _, x in kept] if weighted else sorted({x for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array(fit, float) - np.array(sums) / n
    v = centred.T @ centred / n
    values, units = np.linalg.eigh(v)
    out = []
    for i, x in kept:
        deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))
        for c in range(1, min(k, len(sums)) + 1):
            if values[-c] > 1e-9:
                z = (np.array(x) - np.array(sums) / n) @ units[:, -c] / math.sqrt(values[-c])
                out.append((i, c, n, deviation, z, values[-c] / values.sum()))
    return out


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[3], abs(r[4])))


def same(got, want):
    got, want = ordered(tuple(r) for r in got), ordered(want)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    for component in {r[1] for r in want}:
        a = np.array([r[4] for r in got if r[1] == component])
        b = np.array([r[4] for r in want if r[1] == component])
        assert np.allclose(a, b * np.sign(a @ b), atol=1e-9)
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-9)


def whitened(df, **options):
    found = whitening.whiten(df, **options)
    return found.select("row.vec_id", *found.columns[1:])


@pytest.mark.parametrize("weights", ["one", "count"])
def test_same_as_plain_numpy(spark, weights):
    rows = vectors(60)
    got = whitened(spark.createDataFrame(rows, KIND).repartition(5), weights=weights).collect()
    same(got, brute(rows, 4, weights == "count"))
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9


def test_whitened_has_unit_covariance(spark):
    rows = vectors(80)
    got = whitened(spark.createDataFrame(rows, KIND), components=5).collect()
    one = {(r["deviation"], r["component"], round(r["whitened"], 9)) for r in got}
    z = np.array([[w for _, w in sorted((c, w) for d, c, w in one if d == key)] for key in {d for d, _, _ in one}])
    assert np.allclose(np.cov(z.T, bias=True), np.eye(5), atol=1e-6)


def test_hot_groups_meet_their_rows_like_others(spark):
    rows = spark.createDataFrame(vectors(50), KIND)
    quant = whitening.quantized(rows, "embedding", 256)
    white = whitening.transformed(groups := whitening.grouped(quant.select("x")), whitening.fit(groups, 3))
    pairs = [whitening.joined_back(quant, white, share).select("row.vec_id", "deviation").collect() for share in (1, 3, 10_000)]
    assert len(pairs[0]) == 102
    assert len({tuple(sorted((str(a), b) for a, b in p)) for p in pairs}) == 1


def test_large_entries_stay_exact(spark):
    rows = [(0, [1e6, 500.0]), (1, [-1e6, 0.25]), (2, [3e5, 0.125]), (3, [1e300, -1e300])]
    got = whitened(spark.createDataFrame(rows[:3], KIND)).collect()
    same(got, brute(rows[:3], 4))
    # Beyond a long: entries take the nearest long, the sum of squares has no long.
    got = whitened(spark.createDataFrame(rows, KIND)).collect()
    assert {r["vec_id"] for r in got} == {0, 1, 2, 3} and all(r["deviation"] is None for r in got if r["vec_id"] == 3)


def test_other_lengths_few_dimensions_and_clashing_names(spark):
    rows = [(0, [1.0, 2.0], 5), (1, [1.0], 6), (2, [], 7), (3, [0.5, 1.5], 8), (4, [1.0, 2.0], 9)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, x int").withColumnRenamed("x", "copies")
    got = whitened(table).collect()
    padded = [(i, [*v, 0.0, 0.0][:2]) for i, v, _ in rows]
    same(got, brute(padded, 4))


@pytest.mark.parametrize("rows", [[], [(0, None)], [(0, [])], [(0, [1.0, 2.0])] * 3])
def test_nothing_to_scale(spark, rows):
    assert whitened(spark.createDataFrame(rows, KIND)).collect() == []
