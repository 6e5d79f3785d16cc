import numpy as np
import pytest
from pyspark.sql import functions as F

from sheaf.llm import neargraph

KIND = "vec_id long, embedding array<float>"


def brute(rows, limit=0.95):
    ids = [i for i, _ in rows]
    units = []
    for _, v in rows:
        a = np.array(v if v is not None and None not in v else [0.0], float)
        ok = len(a) and np.isfinite(a).all() and a.any()
        units.append(np.resize(a, 12) / np.linalg.norm(a) if ok else np.zeros(12))
    u = np.array(units)
    links = u @ u.T >= limit
    np.fill_diagonal(links, False)
    component = np.arange(len(rows))
    for _ in rows:
        new = np.minimum(component, np.where(links, component[None, :], len(rows)).min(axis=1))
        if (new == component).all():
            break
        component = new
    return [(i, int(n), ids[c], ids[c] == i) for i, n, c in zip(ids, links.sum(axis=1), component)]


def vectors(seed):
    pick = np.random.default_rng(seed)
    rows = list(pick.normal(size=(250, 12)))
    for base, copies in ((0, 120), (1, 20), (2, 5), (3, 1)):
        rows += [rows[base] + pick.normal(size=12) * 0.12 for _ in range(copies)]
    rows += [rows[5] * 3.0, rows[6].copy(), rows[6].copy()]
    rows = [[float(np.float32(x)) for x in v] for v in rows]
    rows += [None, [0.0] * 12, [float("nan")] + [1.0] * 11, [1.0, None], []]
    return list(enumerate(rows))


@pytest.mark.parametrize("shard,cap", [(2000, 4096), (60, 4096), (100, 16)])
def test_recall_and_precision(spark, shard, cap):
    rows = vectors(shard + cap)
    got = {r.vec_id: tuple(r) for r in neargraph.near_duplicates(spark.createDataFrame(rows, KIND).repartition(3), shard=shard, cap=cap).collect()}
    want = {r[0]: r for r in brute(rows)}
    assert set(got) == set(want)
    assert all(got[i][1] <= want[i][1] for i in want)
    assert sum(r[1] for r in got.values()) >= 0.98 * sum(r[1] for r in want.values())
    if cap > 16:
        assert np.mean([got[i][2] == want[i][2] for i in want]) > 0.99


def test_hot_vector_nulls_repeats_and_clashes(spark):
    rows = [(i, [1.0, 2.0]) for i in range(50)] + [(7, [1.0, 2.0]), (None, [2.0, 4.0]), (None, None), (99, [1.0, 2.0, 0.0])]
    table = spark.createDataFrame(rows, KIND).withColumn("key", F.lit(1)).withColumn("node", F.lit(1))
    got = [tuple(r) for r in neargraph.near_duplicates(table).collect()]
    assert sorted(map(str, set(got))) == sorted(
        map(str, [(i, 52, 0, i == 0) for i in [*range(50), 99]] + [(None, 52, 0, False), (None, 0, None, True)])
    )


def test_empty_table(spark):
    assert neargraph.near_duplicates(spark.createDataFrame([], KIND)).collect() == []


def test_pruning_keeps_the_nearest_and_drops_what_it_covers():
    line = np.array([[np.cos(a), np.sin(a)] for a in (0, 0.1, 0.2, 0.3, 3.0)])
    lists = neargraph.pruned_lists(line, degree=2, pool=4, alpha=1.2)
    assert 1 in lists[0] and 2 not in lists[0]
    assert all(len(x) for x in lists)


def test_audit_sees_lost_pairs_beside_a_large_group(spark):
    pick = np.random.default_rng(4)
    units = [u / np.linalg.norm(u) for u in pick.normal(size=(60, 30))]
    units += [u + pick.normal(size=30) * 1e-4 for u in units[:40]] + [units[59] + pick.normal(size=30) * 1e-4 for _ in range(200)]
    rows = [(i, 1, (u / np.linalg.norm(u)).tobytes()) for i, u in enumerate(units)]
    nodes = spark.createDataFrame(rows, "node long, n long, unit binary")
    # The links of the group are found, those of the 40 pairs are not.
    counts = spark.createDataFrame([(i, 200, 200) for i in (59, *range(100, 300))], "node long, links long, near long")
    assert neargraph.audit(nodes, counts, 30, 0.95) < 0.98


@pytest.mark.parametrize("block", [4096, 40])
def test_what_no_overlap_finds_is_compared_exactly(spark, monkeypatch, block):
    none = (spark.createDataFrame([], "node long, links long, near long"), spark.createDataFrame([], "u long, v long"))
    exact = neargraph.compared
    monkeypatch.setattr(neargraph, "linked", lambda *_: none)
    monkeypatch.setattr(neargraph, "compared", lambda *a: exact(*a, block=block))
    rows = vectors(7)
    got = {tuple(r) for r in neargraph.near_duplicates(spark.createDataFrame(rows, KIND).repartition(3)).collect()}
    assert got == set(brute(rows))
