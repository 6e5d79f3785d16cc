"""Exact top-k search by exhaustive term-at-a-time accumulation.

Rows are sparse vectors of integers: (term, weight) pairs. A cell holds one
block of candidates and one block of queries. It turns the candidates into
postings, one list per term, and for every query scatters the weighted postings
of its terms into a dense array of scores, one place per candidate. A partition
selection keeps the best k of each cell; the cells of a query are then merged.
All candidates are scored, whatever they share with the query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CANDIDATES, QUERIES = 16_384, 16_384


def postings(rows: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Candidate places and weights of each term."""
    order = np.argsort(terms, kind="stable")
    rows, terms, weights = rows[order], terms[order], weights[order]
    names, first = np.unique(terms, return_index=True)
    ends = np.append(first[1:], len(terms))
    return {int(t): (rows[a:b], weights[a:b]) for t, a, b in zip(names, first, ends, strict=True)}


def flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and value of every entry of a column of (term, weight) lists."""
    lists = column.combine_chunks()
    lists = lists if isinstance(lists, pa.Array) else pa.concat_arrays(lists.chunks)
    entries = lists.flatten()
    count = np.diff(lists.offsets.to_numpy())
    return np.repeat(np.arange(len(lists)), count), entries.field(0).to_numpy(), entries.field(1).to_numpy()


def select(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id; ``ids`` ascend."""
    if len(scores) > k:
        bound = np.partition(scores, len(scores) - k)[len(scores) - k]
        above = np.flatnonzero(scores > bound)
        place = np.concatenate([above, np.flatnonzero(scores == bound)[: k - len(above)]])
    else:
        place = np.arange(len(scores))
    return place[np.lexsort((ids[place], -scores[place]))]


def copies(rows: np.ndarray, terms: np.ndarray, weights: np.ndarray, count: int) -> list[bytes]:
    """Entries of each row as bytes, equal for equal lists only."""
    pairs = np.ascontiguousarray(np.column_stack([terms, weights]).astype(np.int64))
    bounds = np.searchsorted(rows, np.arange(count + 1))
    return [pairs[a:b].tobytes() for a, b in zip(bounds, bounds[1:], strict=False)]


def search(
    queries: DataFrame, candidates: DataFrame, k: int, n_candidates: int = CANDIDATES, n_queries: int = QUERIES,
    by_row: bool = False,
) -> DataFrame:
    """The k best candidates of every query by integer inner product.

    Both tables hold ``id`` (long) and ``entries`` (array of term and weight,
    two longs, a term at most once a row). A candidate with the query's id is
    left out. Returns ``query_id, rank, id, score``; ties go to the smaller id,
    and a query with fewer than k candidates gets them all. Rows without
    entries score 0. A row with a null id or null entries takes no part. Every
    other row is a candidate, so repeated ids are found once per row; of queries
    with one id, the one with the smallest entries counts.

    ``by_row`` tells rows apart instead of ids: every row of ``queries`` is a
    query of its own, only its own row among the candidates is left out, not
    others with its id, and a candidate's id may be null, which is found under
    a null id and goes behind all others on ties.

    The number of blocks follows from the counts of rows; a cell's memory is
    bounded by the block sizes times the entries of a row.
    """

    def clean(rows: DataFrame) -> DataFrame:
        kept = rows.select(F.col("id").cast("bigint").alias("id"), "entries")
        return kept.dropna(subset=["entries"]) if by_row else kept.dropna()

    queries, candidates = clean(queries).dropna(), clean(candidates)
    if by_row:
        # Rows alike in id and entries are one query, answered as often as they come.
        queries = queries.groupBy("id", "entries").agg(F.count(F.lit(1)).alias("times"))
    else:
        queries = queries.groupBy("id").agg(F.min("entries").alias("entries"), F.lit(1).cast("bigint").alias("times"))
    queries = queries.withColumn("query", F.md5(F.to_json("entries")))
    lots = max(1, -(-queries.count() // n_queries))
    blocks = max(1, -(-candidates.count() // n_candidates))

    def dealt(rows: DataFrame, own: str, n: int, other: str, times: int) -> DataFrame:
        return rows.withColumn(own, F.pmod(F.xxhash64("id"), F.lit(n))).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.lit(times - 1)))
        )

    mine = dealt(queries, "lot", lots, "block", blocks).groupBy("lot", "block")
    theirs = dealt(candidates, "block", blocks, "lot", lots).groupBy("lot", "block")

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("id")
        missing = right["id"].is_null().to_numpy()
        # A null id is larger than all others.
        ids = right["id"].fill_null(np.iinfo(np.int64).max).to_numpy()
        entries = flat(right["entries"])
        own = postings(*entries) if len(ids) else {}
        whole = copies(*entries, len(ids)) if by_row else []
        row, terms, weights = flat(left["entries"]) if left.num_rows else (np.zeros(0, int),) * 3
        mine = copies(row, terms, weights, left.num_rows) if by_row else []
        bounds = np.searchsorted(row, np.arange(left.num_rows + 1))
        out, place = [], []
        for q, name in enumerate(left["id"].to_numpy()):
            scores = np.zeros(len(ids), np.int64)
            for e in range(bounds[q], bounds[q + 1]):
                found = own.get(int(terms[e]))
                if found is not None:
                    scores[found[0]] += weights[e] * found[1]
            same = np.flatnonzero((ids == name) & ~missing)
            if by_row:
                same = [c for c in same if whole[c] == mine[q]][:1]
            others = np.delete(np.arange(len(ids)), same)
            best = others[select(scores[others], ids[others], k)]
            out.append((np.full(len(best), q), best, scores[best]))
        q, best, scores = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3
        found = {c: left[c].combine_chunks().take(pa.array(q)) for c in ("id", "query", "times")}
        return pa.table(
            {"query_id": found["id"], "query": found["query"], "times": found["times"],
             "id": pa.array(ids[best], pa.int64(), mask=missing[best]), "score": scores}
        )

    found = mine.cogroup(theirs).applyInArrow(score, "query_id bigint, query string, times bigint, id bigint, score bigint")
    order = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    if by_row:
        best = best.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "times")))
    return best.select("query_id", "rank", "id", "score")


def quantized(vectors: DataFrame, id_column: str, vector: str, scale: int) -> DataFrame:
    """``id, entries`` of dense vectors: floor(scale * x) of each component that is not 0.

    Vectors that are null or hold null or non-finite components give no row.
    """
    whole = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    rows = vectors.select(
        vectors[id_column].alias("id"), F.transform(vectors[vector], lambda e: e.cast("double")).alias("v")
    )
    entry = F.transform(
        "v",
        lambda e, i: F.struct(i.cast("bigint").alias("term"), F.floor(e * F.lit(float(scale))).cast("bigint").alias("weight")),
    )
    return rows.filter(F.col("v").isNotNull() & whole).select(
        "id", F.filter(entry, lambda e: e["weight"] != 0).alias("entries")
    )
