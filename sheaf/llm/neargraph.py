"""Embedding near-dedup on a robust-pruned flat graph.

Centroids fitted on a bounded sample cut the vectors into overlapping shards:
every vector lies in the shards of its nearest centroids. Each shard builds a
graph of its own, in which a node keeps a pruned list of neighbours (a
candidate goes if a kept neighbour is clearly nearer to it). A node's lists
from all its shards are united. A search starts from the shard's medoids and
from the query's own node, walks greedily with a beam, and then widens through
every node within range until none is left. What it finds is verified in double
precision. Recall is audited against brute force, and the overlap grows until
the audit passes; if it never does, all nodes are compared with all, in blocks.

Equal vectors are one node. A shard of more than ``cap`` nodes is dealt into
several parts, each searched by all nodes of the shard; so nothing is capped.
Pairs never leave a task: it returns counts, and links enough to join what
belongs together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm.graph import components
from sheaf.session import written

LIMIT = 0.95
# Vectors that the centroids are fitted on, in the order of their hashes.
SAMPLE, CENTROIDS, SHARD, CAP = 16_384, 1024, 2000, 4096
OVERLAP, MOST_OVERLAP = 2, 5
DEGREE, POOL, ALPHA, BEAM, MEDOIDS = 16, 48, 1.2, 16, 32
# The widening goes on through nodes a little out of range.
SLACK = 0.05
AUDITED, RECALL = 2048, 0.98
# Nodes with so many links at most are audited by themselves too.
FEW = 8
# Nodes on either side of a cell of the exact comparison.
BLOCK = 4096


def matrix(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    """Unit vectors from a column of float64 bytes, with zeros behind short ones."""
    out = np.zeros((len(column), dims))
    for i, v in enumerate(column.to_pylist()):
        own = np.frombuffer(v, np.float64)
        out[i, : len(own)] = own
    return out


def keyed(vectors: DataFrame) -> DataFrame:
    """``id, key, unit``: identity and unit length of each usable vector, null for others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, units = [], []
            for v in batch.column(1).to_pylist():
                own = np.array(v if v is not None and None not in v else [], np.float64)
                top = np.abs(own).max() if len(own) else 0.0
                if np.isfinite(top) and top > 0:
                    own = np.trim_zeros(own, "b") + 0.0
                    keys.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                    own = own / top
                    units.append((own / np.sqrt(own @ own)).tobytes())
                else:
                    keys.append(None)
                    units.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(keys, pa.binary()), pa.array(units, pa.binary())], names=["id", "key", "unit"]
            )

    return vectors.select("id", "vector").mapInArrow(run, "id bigint, key binary, unit binary")


def spherical_means(sample: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Unit centroids; an empty cluster takes the sample worst served."""
    centers = sample[np.linspace(0, len(sample) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = sample @ centers.T
        own, best = near.argmax(axis=1), near.max(axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, own, sample)
        for c in np.flatnonzero(np.bincount(own, minlength=k) == 0):
            worst = int(best.argmin())
            sums[c], best[worst] = sample[worst], 1.0
        centers = sums / np.maximum(1e-12, np.sqrt((sums**2).sum(axis=1, keepdims=True)))
    return centers


def assigned(nodes: DataFrame, centers: np.ndarray, overlap: int) -> DataFrame:
    """Add ``shards``, the numbers of the nearest centroids, in ascending order."""
    shared = nodes.sparkSession.sparkContext.broadcast(centers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            near = matrix(batch.column(2), own.shape[1]) @ own.T
            take = min(overlap, len(own))
            shards = np.sort(np.argpartition(-near, take - 1, axis=1)[:, :take], axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(list(shards), pa.list_(pa.int32()))], names=["node", "n", "unit", "shards"]
            )

    return nodes.select("node", "n", "unit").mapInArrow(
        run, "node bigint, n bigint, unit binary, shards array<int>"
    )


def pruned_lists(units: np.ndarray, degree: int, pool: int, alpha: float) -> list[np.ndarray]:
    """Neighbour lists of all nodes of one part, pruned robustly for all nodes at a time."""
    n = len(units)
    if n < 2:
        return [np.zeros(0, np.int64)] * n
    near = (units @ units.T).astype(np.float32)
    np.fill_diagonal(near, -2)
    pool = min(pool, n - 1)
    candidates = np.concatenate(
        [np.argpartition(-near[r : r + 256], pool - 1, axis=1)[:, :pool] for r in range(0, n, 256)]
    )
    rows = np.arange(n)
    order = np.argsort(-near[rows[:, None], candidates], axis=1, kind="stable")
    candidates = candidates[rows[:, None], order]
    away = np.sqrt(np.maximum(0, 2 - 2 * near[rows[:, None], candidates]))
    alive = np.ones((n, pool), bool)
    kept = np.full((n, degree), -1)
    for d in range(degree):
        some = alive.any(axis=1)
        if not some.any():
            break
        first = alive.argmax(axis=1)
        chosen = candidates[rows, first]
        kept[some, d] = chosen[some]
        between = np.sqrt(np.maximum(0, 2 - 2 * near[chosen[:, None], candidates]))
        alive &= alpha * between > away
        alive[rows, first] = False
    # Links back, so that every node can be reached.
    target, source = kept[kept >= 0], np.repeat(rows, (kept >= 0).sum(axis=1))
    back = [[] for _ in range(n)]
    for t, s in zip(target.tolist(), source.tolist(), strict=True):
        if len(back[t]) < degree:
            back[t].append(s)
    return [np.unique(np.concatenate([kept[i][kept[i] >= 0], np.array(back[i], np.int64)])) for i in range(n)]


def medoids(units: np.ndarray, count: int) -> np.ndarray:
    """Nodes nearest to the centroids of the part's clusters."""
    centers = spherical_means(units, min(count, len(units)), 3)
    return np.unique((units @ centers.T).argmax(axis=0))


def search(
    units: np.ndarray, lists: np.ndarray, entries: np.ndarray, queries: np.ndarray, own: np.ndarray, limit: float, beam: int
) -> list[np.ndarray]:
    """Nodes in range of each query; ``lists`` are padded with -1, ``own`` is the query's node or -1."""
    low, reach = limit - 1e-6, limit - SLACK
    single = units.astype(np.float32)
    out = []
    for q in range(0, len(queries), 256):
        block, mine = queries[q : q + 256].astype(np.float32), own[q : q + 256]
        rows = np.arange(len(block))
        seen = np.zeros((len(block), len(units) + 1), bool)  # the last place stands for -1
        seen[:, -1] = True
        starts = np.concatenate([np.tile(entries, (len(block), 1)), mine[:, None]], axis=1)
        ids, score, done = (np.full((len(block), 0), v) for v in (0, 0.0, False))
        done = done.astype(bool)
        fresh = starts
        while True:
            new = ~seen[rows[:, None], fresh]
            seen[rows[:, None], fresh] = True
            # The same node twice in one list counts once.
            order = np.argsort(fresh, axis=1, kind="stable")
            again = np.zeros_like(new)
            ordered = np.take_along_axis(fresh, order, axis=1)
            np.put_along_axis(again, order[:, 1:], ordered[:, 1:] == ordered[:, :-1], axis=1)
            new &= ~again
            found = np.where(new, np.einsum("brd,bd->br", single[fresh], block), -3.0)
            ids = np.concatenate([ids, fresh], axis=1).astype(np.int64)
            score = np.concatenate([score, found], axis=1)
            done = np.concatenate([done, ~new], axis=1)
            best = np.argsort(-score, axis=1, kind="stable")[:, :beam]
            ids, score, done = (np.take_along_axis(x, best, axis=1) for x in (ids, score, done))
            open_ = ~done & (score > -2)
            if not open_.any():
                break
            at = open_.argmax(axis=1)
            done[rows, at] = True
            fresh = np.where(open_.any(axis=1)[:, None], lists[ids[rows, at]], -1)
        for b in rows:
            start = ids[b][(score[b] >= reach)]
            inside, front = [start], start
            visited = np.zeros(len(units) + 1, bool)
            visited[-1] = True
            visited[start] = True
            while len(front):
                around = np.unique(lists[front])
                around = around[~visited[around]]
                visited[around] = True
                front = around[single[around] @ block[b] >= reach]
                inside.append(front)
            near = np.concatenate(inside)
            near = near[single[near] @ block[b] >= low - 1e-5]
            out.append(near[units[near] @ queries[q + b] >= limit])
    return out


def linked(placed: DataFrame, dims: int, limit: float, cap: int) -> tuple[DataFrame, DataFrame]:
    """``node, links, near`` counts (of vectors and of nodes), and ``u, v`` links that join what is linked."""
    members = placed.select("*", F.explode("shards").alias("shard"))
    sizes = members.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / cap).alias("parts"))
    members = written(
        members.join(sizes, "shard").withColumn("part", F.pmod(F.xxhash64("node"), "parts")).drop("parts"), "members"
    )

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        node = table["node"].to_numpy()
        lists = pruned_lists(matrix(table["unit"], dims), DEGREE, POOL, ALPHA)
        return pa.table({"node": node, "near": pa.array([node[x] for x in lists], pa.list_(pa.int64()))})

    lists = members.select("shard", "part", "node", "unit").groupBy("shard", "part").applyInArrow(
        build, "node bigint, near array<bigint>"
    )
    # A node lies in a few shards, so its united list is short.
    united = lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    graph = members.join(united, "node")
    queries = members.join(sizes, "shard").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

    def walk(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("node")
        none = pa.table({c: pa.array([], pa.int64()) for c in ("u", "v", "links", "near")})
        if not left.num_rows or not right.num_rows:
            return none
        node, weight = left["node"].to_numpy(), left["n"].to_numpy()
        place = {int(v): i for i, v in enumerate(node)}
        near = [[place[v] for v in own if v in place] for own in left["near"].to_pylist()]
        lists = np.full((len(node) + 1, max(1, max(map(len, near)))), -1)
        for i, own in enumerate(near):
            lists[i, : len(own)] = own
        units = matrix(left["unit"], dims)
        shard = right["q_shard"][0].as_py()
        theirs = left["shards"].to_pylist()
        asked, asking = right["q_node"].to_numpy(), right["q_shards"].to_pylist()
        own = np.array([place.get(int(v), -1) for v in asked])
        found = search(units, lists, medoids(units, MEDOIDS), matrix(right["q_unit"], dims), own, limit, BEAM)
        counts, nodes, root, joined = np.zeros(len(asked), np.int64), np.zeros(len(asked), np.int64), {}, []

        def top(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for i, hits in enumerate(found):
            u = int(asked[i])
            mine = set(asking[i])
            for h in hits.tolist():
                v = int(node[h])
                if v == u:
                    continue
                # A pair that meets in several shards counts in the first of them.
                if shard == min(mine.intersection(theirs[h])):
                    counts[i] += weight[h]
                    nodes[i] += 1
                a, b = top(u), top(v)
                if a != b:
                    root[a] = b
                    joined.append((u, v))
        edges = np.array(joined, np.int64).reshape(-1, 2)
        some = np.flatnonzero(counts)
        return pa.table(
            {
                "u": np.concatenate([asked[some], edges[:, 0]]),
                "v": np.concatenate([asked[some], edges[:, 1]]),
                "links": np.concatenate([counts[some], np.zeros(len(edges), np.int64)]),
                "near": np.concatenate([nodes[some], np.zeros(len(edges), np.int64)]),
            }
        )

    index = graph.select("shard", "part", "node", "n", "unit", "shards", "near").groupBy("shard", "part")
    asked = queries.select(*(F.col(c).alias(f"q_{c}") for c in ("shard", "part", "node", "unit", "shards")))
    asked = asked.groupBy("q_shard", "q_part")
    return _counted(index.cogroup(asked).applyInArrow(walk, FOUND))


FOUND = "u bigint, v bigint, links bigint, near bigint"


def _counted(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Counts are the rows where ``u`` is ``v``, links the others."""
    found = written(found, "found")
    counts = found.filter("u = v").groupBy(F.col("u").alias("node")).agg(F.sum("links").alias("links"), F.sum("near").alias("near"))
    return counts, found.filter("u <> v").select("u", "v")


def spanning(hits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links that join each component of a table of hits: a row to columns, and a row to rows."""
    rows, columns = hits.any(axis=1), hits.any(axis=0)
    to_column, to_row = [], []
    for r in np.flatnonzero(rows):
        if not rows[r]:
            continue
        rows[r] = False
        front = np.array([r])
        while len(front):
            near = np.flatnonzero(hits[front].any(axis=0) & columns)
            columns[near] = False
            to_column.append((np.full(len(near), r), near))
            front = np.flatnonzero(hits[:, near].any(axis=1) & rows)
            rows[front] = False
            to_row.append((np.full(len(front), r), front))
    none = [(np.zeros(0, np.int64),) * 2]
    return tuple(np.concatenate(x) for pairs in (to_column or none, to_row or none) for x in zip(*pairs, strict=True))


def compared(nodes: DataFrame, size: int, dims: int, limit: float, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """What ``linked`` returns, exactly: all nodes meet all nodes, in cells of two blocks."""
    blocks = max(1, -(-size // block))
    dealt = nodes.select("node", "n", "unit", F.pmod(F.xxhash64("node"), F.lit(blocks)).alias("own"))
    left = dealt.withColumn("i", F.col("own")).withColumn("j", F.explode(F.sequence("own", F.lit(blocks - 1).cast("bigint"))))
    right = dealt.withColumn("j", F.col("own")).withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), "own")))

    def cell(a: pa.Table, b: pa.Table) -> pa.Table:
        u, v = a["node"].to_numpy(), b["node"].to_numpy()
        here, there = a["n"].to_numpy(), b["n"].to_numpy()
        hits = np.zeros((len(u), len(v)), bool)
        if len(u) and len(v):
            mine, theirs = matrix(a["unit"], dims), matrix(b["unit"], dims)
            for r in range(0, len(u), 512):
                hits[r : r + 512] = mine[r : r + 512] @ theirs.T >= limit
                hits[r : r + 512] &= u[r : r + 512, None] != v
        same = len(u) and len(v) and a["own"][0].as_py() == b["own"][0].as_py()
        counts = [(u, np.array([there[x].sum() for x in hits], np.int64), hits.sum(axis=1))]
        if not same:
            counts.append((v, np.array([here[x].sum() for x in hits.T], np.int64), hits.sum(axis=0)))
        node, links, near = (np.concatenate(x).astype(np.int64) for x in zip(*counts, strict=True))
        some = near > 0
        r, c, p, q = spanning(hits)
        ends = [(node[some], node[some]), (u[r], v[c]), (u[p], u[q])]
        zeros = np.zeros(len(r) + len(p), np.int64)
        return pa.table(
            {
                "u": np.concatenate([e[0] for e in ends]).astype(np.int64),
                "v": np.concatenate([e[1] for e in ends]).astype(np.int64),
                "links": np.concatenate([links[some], zeros]),
                "near": np.concatenate([near[some], zeros]),
            }
        )

    return _counted(left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(cell, FOUND))


def audit(nodes: DataFrame, counts: DataFrame, dims: int, limit: float, size: int = AUDITED, few: int = FEW) -> float:
    """Recall by node of a bounded sample of nodes, by brute force over all nodes.

    A node's recall is the share of its linked nodes that were found. Returned
    is the mean over the nodes that have links, or that over the ones with
    ``few`` links at most, whichever is lower; so a large group cannot hide
    what is missing among small ones. Copies count once.
    """
    sample = nodes.orderBy(F.xxhash64("node"), "node").limit(size)
    rows = sample.join(counts, "node", "left").select("node", "unit", F.coalesce("near", F.lit(0)).alias("near")).collect()
    if not rows:
        return 1.0
    asked = np.array([r["node"] for r in rows])
    units = matrix(pa.array([bytes(r["unit"]) for r in rows]), dims)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(asked), np.int64)
        for batch in batches:
            hit = matrix(batch.column(1), dims) @ units.T >= limit
            hit &= batch.column(0).to_numpy()[:, None] != asked[None, :]
            total += hit.sum(axis=0)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(asked[some]), pa.array(total[some])], names=["node", "near"])

    true = nodes.select("node", "unit").mapInArrow(count, "node bigint, near bigint").groupBy("node").agg(F.sum("near"))
    true = dict(map(tuple, true.collect()))
    recalls = [(true[r["node"]], min(1.0, r["near"] / true[r["node"]])) for r in rows if r["node"] in true]
    kinds = [[x for _, x in recalls], [x for n, x in recalls if n <= few]]
    return min((float(np.mean(x)) for x in kinds if x), default=1.0)


def near_duplicates(
    vectors: DataFrame,
    id_column: str = "vec_id",
    vector: str = "embedding",
    limit: float = LIMIT,
    shard: int = SHARD,
    cap: int = CAP,
    sample: int = SAMPLE,
    recall: float = RECALL,
) -> DataFrame:
    """Links between vectors of a cosine of at least ``limit``, and their components.

    Returns one row per vector: ``<id>, n_links`` (other vectors linked
    directly), ``component_id`` (the smallest id reachable) and ``kept`` (the
    id is the component's). Vectors that are null, zero, empty or hold null or
    non-finite components link with nothing. Zeros behind a vector do not
    count, so lengths may differ. Equal vectors are linked. A null id counts
    only where a component has no other. Other columns are not read.

    No pair below the limit is linked. Links may be missed; the audit compares
    a bounded sample of nodes with all others and the overlap of shards grows
    until ``recall`` of a node's links is found on average. If that fails at
    the largest overlap, all nodes are compared with all and none is missed.
    """
    rows = vectors.select(vectors[id_column].cast("bigint").alias("id"), vectors[vector].alias("vector"))
    base = written(keyed(rows), "vectors")
    usable = base.filter("key is not null")
    nodes = usable.groupBy("key").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"), F.first("unit").alias("unit"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    size, dims = nodes.agg(F.count(F.lit(1)), F.max(F.octet_length("unit"))).first()
    lone = base.filter("key is null").select(
        "id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id")
    )
    if not size:
        return _named(lone, id_column)
    dims //= 8
    taken = nodes.orderBy(F.xxhash64("key"), "key").limit(sample).select("unit").collect()
    units = matrix(pa.array([bytes(r["unit"]) for r in taken]), dims)
    for overlap in range(OVERLAP, MOST_OVERLAP + 1):
        k = max(1, min(CENTROIDS, len(units), -(-size * overlap // shard)))
        placed = assigned(nodes, spherical_means(units, k), overlap)
        counts, edges = linked(placed, dims, limit, cap)
        passed = audit(nodes, counts, dims, limit) >= recall
        if passed or overlap >= k:
            break
    if not passed:
        counts, edges = compared(nodes, size, dims, limit)
    groups = components(edges, "groups")
    known = nodes.join(counts, "node", "left").join(groups, "node", "left").select(
        "key", "least", "n", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "node").alias("component")
    )
    least = known.groupBy("component").agg(F.min("least").alias("component_id"))
    known = known.join(least, "component").select("key", (F.col("links") + F.col("n") - 1).alias("n_links"), "component_id")
    return _named(usable.join(known, "key").select("id", "n_links", "component_id").unionByName(lone), id_column)


def _named(rows: DataFrame, id_column: str) -> DataFrame:
    return rows.select(
        F.col("id").alias(id_column), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    )
