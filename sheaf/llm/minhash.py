"""Near-duplicate documents by MinHash with tensored banding.

Two collections of ``tables`` sub-hashes each are computed, every sub-hash from
``rows`` minhashes. A table key is a pair (one sub-hash of either collection),
so ``tables ** 2`` tables need minhashes for ``2 * tables`` keys only. A row is
shuffled once for each sub-hash of the first collection and carries the second
one along; the pairs are formed where rows with the first half in common meet.

A table proposes: members of a bucket hang on its pivot and on their neighbour
if their signatures agree roughly. Of these links a batch sends on a star for
each set of members that they join: every member and the smallest. A first half
that very many rows have in common is dealt in parts, each of which gets the
pivots of the buckets it shares. What is proposed in this way is a cluster,
never a result: inside the clusters every pair of full shingle sets is compared
by matrix products in blocks, so no link between candidates is missed and none
below the threshold is kept. Blocks that turn out to be one component already
are not compared again, so a cluster of any size costs about as many block
products as it has blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.llm.batches import U64, chunks, lowered, mix, random_table, utf8, window_hashes
from sheaf.llm.graph import components
from sheaf.llm.substring import TextWords
from sheaf.session import collect_garbage, written

SHINGLE, PERCENT = 5, 75
TABLES, ROWS = 16, 3
# Of the signature's positions so many hundredths must agree for a proposal; a
# pair at the threshold fails this once in some ten thousand times.
AGREE = 50
# A block of a cluster: documents, and shingles in all.
BLOCK_DOCS, BLOCK_SHINGLES = 1024, 2_000_000
COLUMNS = 2048
# Rows that may share a first half before they are dealt in parts: so many, or
# this share of all, so that there are fewer such halves than ``HOT_SHARE``.
HOT_ROWS, HOT_SHARE = 1 << 18, 10_000


def shingle_sets(text: TextWords, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, one after another, and their bounds."""
    hashes = text.hashes(1)
    rolling, inside = window_hashes(hashes, size, 1), text.inside(size)
    rows, values = [text.row[: len(inside)][inside]], [rolling[inside]]
    for r in np.flatnonzero((text.count > 0) & (text.count < size)):
        n = text.count[r]
        rows.append(np.array([r]))
        values.append(window_hashes(hashes[text.bounds[r] : text.bounds[r + 1]], int(n), 10 + int(n)))
    row, value = np.concatenate(rows), np.concatenate(values)
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    row, value = row[new], value[new]
    return value, np.searchsorted(row, np.arange(len(text.count) + 1))


def minhashes(values: np.ndarray, bounds: np.ndarray, count: int) -> np.ndarray:
    """``count`` minhashes of 32 bits of every non-empty set, a row each."""
    short = (values >> U64(32)).astype(np.uint32)
    factors = random_table(7, count, 2).astype(np.uint32)
    out = np.empty((count, len(bounds) - 1), np.uint32)
    for i, (a, b) in enumerate(factors):
        out[i] = np.minimum.reduceat(short * (a | np.uint32(1)) + b, bounds[:-1])
    return out.T


def _signed(minimum: np.ndarray, tables: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """First collection: one 64-bit sub-hash per table. Second: a byte per minhash."""
    first, second = minimum[:, : tables * rows].astype(U64), minimum[:, tables * rows :]
    keys = np.zeros((len(minimum), tables), U64)
    for r in range(rows):
        keys = mix(keys * U64(3) + first[:, r::rows] + U64(r + 1))
    return keys, ((second * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)


def described(docs: DataFrame, size: int, tables: int, rows: int) -> DataFrame:
    """``doc, tkey, cid, n, keys, sig``: set identity, size and sub-hashes of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            for a, b in chunks(offsets):
                part = lowered(data[offsets[a] : offsets[b]])
                values, bounds = shingle_sets(TextWords(part, offsets[a : b + 1] - offsets[a]), size)
                n = np.diff(bounds)
                full = np.flatnonzero(n)
                cid = [
                    hashlib.blake2b(values[bounds[r] : bounds[r + 1]].tobytes(), digest_size=16).digest() if n[r] else None
                    for r in range(b - a)
                ]
                keys, sig = [None] * (b - a), [None] * (b - a)
                if len(full):
                    minimum = minhashes(values, np.append(bounds[full], bounds[-1]), 2 * tables * rows)
                    for r, k, s in zip(full, *_signed(minimum, tables, rows), strict=True):
                        keys[r], sig[r] = k.view(np.int64), s.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(cid, pa.binary()),
                     pa.array(n, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(sig, pa.binary())],
                    names=["doc", "tkey", "cid", "n", "keys", "sig"],
                )

    kind = docs.schema["doc"].dataType.simpleString()
    return docs.select("doc", "tkey", "text").mapInArrow(
        run, f"doc {kind}, tkey binary, cid binary, n bigint, keys array<bigint>, sig binary"
    )


def _agree(sig: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * (sig[a] == sig[b]).sum(axis=1) >= percent * sig.shape[1]


def stars(edges: np.ndarray) -> np.ndarray:
    """What joins the same nodes as ``edges``, with one edge for each node but the smallest of each set."""
    nodes, at = np.unique(edges, return_inverse=True)
    a, b = at.reshape(-1, 2).T
    root = np.arange(len(nodes))
    while (root[a] != root[b]).any():
        least = np.minimum(root[a], root[b])
        for side in (a, b):
            np.minimum.at(root, root[side], least)
        while (root != root[root]).any():
            root = root[root]
    rest = np.flatnonzero(root != np.arange(len(nodes)))
    return np.stack([nodes[rest], nodes[root[rest]]], axis=1)


def parted(halves: DataFrame, tables: int, rows: int, hot: int) -> DataFrame:
    """``half, num, sig`` with the halves of more than ``hot`` rows dealt in parts.

    The smallest member of a bucket, its pivot, is added to every part that has
    a member of the bucket, so all of them meet the pivot as they would undealt.
    """
    counts = _cut(halves.groupBy("half").count(), "halves")
    most = max(hot, (counts.agg(F.sum("count")).first()[0] or 0) // HOT_SHARE)
    large = counts.filter(F.col("count") > most).select(F.col("half").alias("of"), F.ceil(F.col("count") / most).alias("parts"))
    if large.isEmpty():
        return halves
    marked = halves.join(F.broadcast(large), halves.half == F.col("of"), "left").drop("of")
    part = F.pmod(F.xxhash64("num", F.lit(2)), F.col("parts"))
    dealt = marked.filter("parts is not null").select("half", part.alias("part"), "num", "sig")
    keys = F.transform(F.sequence(F.lit(0), F.lit(tables - 1)), lambda j: F.struct(j.alias("j"), F.substring("sig", j * rows + 1, F.lit(rows)).alias("key")))
    buckets = dealt.select("half", "part", F.explode(keys).alias("t"), F.struct("num", "sig").alias("row"))
    own = buckets.groupBy("half", "part", "t").agg(F.min("row").alias("own"))
    over = own.withColumn("pivot", F.min("own").over(Window.partitionBy("half", "t")))
    pivots = over.filter("own.num <> pivot.num").select("half", "part", "pivot.num", "pivot.sig").distinct()
    named = F.xxhash64("half", "part").alias("half")
    return (
        marked.filter("parts is null").select("half", "num", "sig")
        .unionByName(dealt.unionByName(pivots).select(named, "num", "sig"))
    )


def proposals(classes: DataFrame, tables: int, rows: int, percent: int, hot: int = HOT_ROWS) -> DataFrame:
    """``u, v``: stars of classes that share a table key and whose signatures agree."""

    def link(run: np.ndarray, num: np.ndarray, sig: np.ndarray) -> np.ndarray:
        """Edges within runs of equal first halves, as rows of two class numbers."""
        out = [np.zeros((0, 2), np.int64)]
        for j in range(tables):
            own = sig[:, j * rows : (j + 1) * rows].astype(np.int64)
            key = run.copy()
            for r in range(rows):
                key = (key << 8) | own[:, r]
            order = np.lexsort((num, key))
            key = key[order]
            head = np.ones(len(key), bool)
            head[1:] = key[1:] != key[:-1]
            pivot = order[np.flatnonzero(head)[np.cumsum(head) - 1]]
            rest = np.flatnonzero(~head)
            for other in (pivot[rest], order[rest - 1]):
                ok = _agree(sig, order[rest], other, percent)
                out.append(np.stack([num[order[rest]][ok], num[other][ok]], axis=1))
        return stars(np.concatenate(out))

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come sorted; the pivots of a run that goes on in the next batch go with it.
        kept = None
        for batch in batches:
            if not batch.num_rows:
                continue
            half, num = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            sig = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(len(num), -1)
            if kept is not None and kept[0][0] == half[0]:
                half, num, sig = (np.concatenate(x) for x in zip(kept, (half, num, sig), strict=True))
            run = np.cumsum(np.concatenate([[0], half[1:] != half[:-1]])).astype(np.int64)
            use = np.bincount(run)[run] > 1
            last = np.flatnonzero(run == run[-1])
            kept = tuple(x[last[_heads(sig[last], tables, rows)]] for x in (half, num, sig))
            edges = link(run[use], num[use], sig[use])
            yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], names=["u", "v"])

    halves = classes.select("num", "sig", F.posexplode("keys").alias("i", "key")).select(
        F.xxhash64("i", "key").alias("half"), "num", "sig"
    )
    dealt = parted(halves, tables, rows, hot).repartition("half").sortWithinPartitions("half", "num")
    return dealt.mapInArrow(propose, "u bigint, v bigint").distinct()


def _heads(sig: np.ndarray, tables: int, rows: int) -> np.ndarray:
    """Rows that come first or last in any table of their run."""
    use = {0, len(sig) - 1}
    for j in range(tables):
        own = np.ascontiguousarray(sig[:, j * rows : (j + 1) * rows])
        use.update(np.unique(own, axis=0, return_index=True)[1].tolist())
    return np.array(sorted(use))


def linked_pairs(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    """Which of the sets at ``left`` and ``right`` are similar enough, as a matrix.

    Exact: counts of common elements are sums of ones below 2 ** 24.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    values = np.concatenate([*sets, np.zeros(0, U64)])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    head = np.ones(len(values) + 1, bool)
    head[1:-1] = values[1:] != values[:-1]
    alone = head[:-1] & head[1:]
    column = np.cumsum(head[:-1] & ~alone) - 1
    owner, column = owner[~alone], column[~alone]
    common = np.zeros((len(left), len(right)), np.int64)
    cuts = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else -1) + 1 + COLUMNS, COLUMNS))
    block = np.zeros((len(sets), COLUMNS), np.float32)
    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        block[:] = 0
        block[owner[a:b], column[a:b] - k * COLUMNS] = 1
        common += np.rint(block[left] @ block[right].T).astype(np.int64)
    union = sizes[left][:, None] + sizes[right][None, :] - common
    return (100 * common >= percent * union) & (common > 0)


def _forest(links: np.ndarray, left: np.ndarray, right: np.ndarray, group: np.ndarray) -> list[tuple[int, int]]:
    """Linked pairs that join different groups, as few as needed."""
    group, out = group.copy(), []
    for i in range(len(left)):
        for j in np.flatnonzero(links[i] & (group[right] != group[left[i]])):
            a, b = int(left[i]), int(right[j])
            if group[a] != group[b]:
                out.append((a, b))
                group[group == group[b]] = group[a]
    return out


def _cells(members: DataFrame, percent: int) -> DataFrame:
    """Verified links ``u, v`` in each cell: ``mine`` against each other and against all ``others``."""

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by("num")
        num = table["num"].to_numpy()
        sets = [np.frombuffer(s, U64) for s in table["shingles"].to_pylist()]
        mine = np.array(table["mine"].to_pylist(), bool)
        group = np.unique(table["group"].to_numpy(), return_inverse=True)[1]
        left, right = np.flatnonzero(mine), np.arange(len(num))
        links = linked_pairs(sets, left, right, percent) if len(left) else np.zeros((0, len(num)), bool)
        edges = _forest(links, left, right, group)
        u, v = (num[[e[i] for e in edges]] if edges else np.zeros(0, np.int64) for i in (0, 1))
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return members.groupBy("cluster", "cell", "part").applyInArrow(compare, "u bigint, v bigint")


def verified(members: DataFrame, texts: DataFrame, size: int, percent: int, docs: int, shingles: int) -> DataFrame:
    """Links ``u, v`` that hold every component of the similarity graph inside the clusters.

    ``members``: ``num, cluster, tkey, n``. Every block is compared with itself
    and with its cluster's first block. A member outside its cluster's largest
    component is then compared with all blocks; two members of that component
    need no further link.
    """
    sizes = members.groupBy("cluster").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / docs), F.ceil(F.sum("n") / shingles)).alias("blocks")
    )
    dealt = members.join(sizes, "cluster").withColumn(
        "block", F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("num"), "blocks")).otherwise(0)
    )

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(4))
            for a, b in chunks(offsets):
                part = lowered(data[offsets[a] : offsets[b]])
                values, bounds = shingle_sets(TextWords(part, offsets[a : b + 1] - offsets[a]), size)
                blobs = [values[bounds[r] : bounds[r + 1]].tobytes() for r in range(b - a)]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(a, b - a) for i in range(4)), pa.array(blobs, pa.binary())],
                    names=["num", "cluster", "blocks", "block", "shingles"],
                )

    held = texts.join(dealt, "tkey").select("num", "cluster", "blocks", "block", "text").mapInArrow(
        sets, "num bigint, cluster bigint, blocks bigint, block bigint, shingles binary"
    )
    held = _cut(held, "shingles")
    own = held.select("*", F.col("block").alias("cell"), F.lit(True).alias("mine"))
    hub = held.filter("blocks > 1 and block = 0").select(
        "*", F.explode(F.sequence(F.lit(1), F.col("blocks") - 1)).alias("cell"), F.lit(False).alias("mine")
    )
    columns = ["cluster", "cell", F.lit(0).cast("bigint").alias("part"), "num", F.col("num").alias("group"), "mine", "shingles"]
    first = _cut(_cells(own.unionByName(hub).select(*columns), percent), "links")

    wide = held.filter("blocks > 1").drop("shingles")
    if wide.isEmpty():
        return first
    groups = components(first)
    placed = wide.join(groups, wide.num == groups.node, "left").select(
        "num", "cluster", "blocks", F.coalesce("component", "num").alias("group")
    )
    counts = placed.groupBy("cluster", "group").count()
    main = counts.groupBy("cluster").agg(F.max_by("group", F.struct("count", -F.col("group"))).alias("main"))
    rest = placed.join(main, "cluster").filter("group <> main")
    lots = rest.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / docs).alias("parts"))
    rest = rest.join(lots, "cluster").select(
        F.col("num").alias("rest_num"), F.pmod(F.xxhash64("num", F.lit(1)), "parts").alias("part")
    )
    # A member meets every lot of its cluster's rest in the cell of its own block ...
    grouped = placed.select("num", "group")
    all_members = held.join(lots, "cluster").join(grouped, "num")
    others = all_members.select(
        "cluster", F.col("block").alias("cell"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
        "num", "group", F.lit(False).alias("mine"), "shingles",
    )
    # ... and the rest itself goes to all cells.
    mine = all_members.join(rest, all_members.num == rest.rest_num).select(
        "cluster", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("cell"), "part",
        "num", "group", F.lit(True).alias("mine"), "shingles",
    )
    second = _cells(mine.unionByName(others), percent)
    return first.unionByName(second)


def classified(
    docs: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    size: int = SHINGLE,
    percent: int = PERCENT,
    tables: int = TABLES,
    rows: int = ROWS,
    block_docs: int = BLOCK_DOCS,
    block_shingles: int = BLOCK_SHINGLES,
    hot: int = HOT_ROWS,
) -> DataFrame:
    """``doc, tkey, n, component, component_id`` of every row of ``docs``.

    ``tkey`` is the MD5 of the text (null: of the empty one), ``component`` a
    number that rows share if links lead from one to the other; a row without
    words has none.
    """
    source = docs.select(docs[id_column].alias("doc"), whole(docs[text]).alias("text")).withColumn("tkey", text_key("text"))
    base = _cut(described(source, size, tables, rows), "described")
    full = base.filter("n > 0")
    classes = full.groupBy("cid").agg(
        F.min("doc").alias("least"), F.min("tkey").alias("tkey"), F.first("n").alias("n"),
        F.first("keys").alias("keys"), F.first("sig").alias("sig"),
    )
    classes = _cut(classes.withColumn("num", F.monotonically_increasing_id()), "classes")
    clusters = components(proposals(classes, tables, rows, AGREE, hot), "clusters")
    members = classes.join(clusters, classes.num == clusters.node).select(
        "num", F.col("component").alias("cluster"), "tkey", "n"
    )
    texts = source.groupBy("tkey").agg(F.first("text").alias("text"))
    links = verified(members, texts, size, percent, block_docs, block_shingles)
    found = components(links, "linked")
    placed = classes.join(found, classes.num == found.node, "left").select(
        "cid", "least", F.coalesce("component", "num").alias("component")
    )
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    named = _cut(placed.join(least, "component").select("cid", "component", "component_id"), "named")
    lone = base.filter("n = 0").select("doc", "tkey", "n", F.lit(None).cast("bigint").alias("component"), F.col("doc").alias("component_id"))
    linked = full.join(named, "cid").select("doc", "tkey", "n", "component", "component_id")
    return linked.unionByName(lone)


def _cut(df: DataFrame, name: str) -> DataFrame:
    """``written``; the driver's garbage is collected with it.

    Joins with small tables are broadcast from the driver's heap; in one query
    those of all its joins add up.
    """
    out = written(df, name)
    collect_garbage(out.sparkSession)
    return out


def whole(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def text_key(text: str | Column) -> Column:
    return F.unhex(F.md5(text))


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Components of documents whose shingle sets are similar.

    A-Z count as a-z; words are ``[^\\x20\\x09-\\x0D]+``; the set holds the
    distinct runs of ``size`` words, or the whole sequence of a shorter text.
    Two documents are linked if 100 * |intersection| >= percent * |union|.
    ``options`` are those of ``classified``.

    Returns one row per document: ``<id>, n_shingles, component_id`` (the
    smallest id reachable) and ``kept`` (the id is the component's). Texts
    without words or null are linked with nothing. Rows with the same set are
    one class from the start, however many they are. A null id counts only
    where a component has no other; it is kept then. Other columns are not read.
    """
    return classified(docs, id_column, text, **options).select(
        F.col("doc").alias(id_column), F.col("n").alias("n_shingles"), "component_id",
        F.col("doc").eqNullSafe(F.col("component_id")).alias("kept"),
    )


def one_of_each(docs: DataFrame, id_column: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without near duplicates: one of each component, all columns.

    The row with the smallest id stays, a null id only where there is no other;
    of one id with several texts the one whose MD5 is least, of equal texts
    under one id any one. Rows without words all stay.
    """
    keys = classified(docs, id_column, text, **options).filter("component is not null")
    order = F.struct(F.col("doc").isNull().alias("missing"), "doc", "tkey")
    chosen = keys.groupBy("component").agg(F.min(order).alias("chosen")).select("chosen.doc", "chosen.tkey")
    chosen = _cut(chosen, "chosen")
    marked = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"), docs[id_column].alias("own"), whole(docs[text]).alias("text"))
    marked = marked.withColumn("key", text_key("text"))
    match = (F.col("key") == F.col("tkey")) & F.col("own").eqNullSafe(F.col("doc"))
    one = marked.join(chosen, match, "left_semi").dropDuplicates(["own", "key"])
    lone = marked.filter(~F.col("text").rlike("[^ \\t-\\r]"))
    return one.unionByName(lone).select("row.*")
