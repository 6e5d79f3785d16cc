"""Keep the chunks of a document that are close to a query."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.functions.similarity import combined_score, cosine, euclidean
from sheaf.functions.terms import ChunkTerms, bucket_of, find_terms
from sheaf.functions.text import TERM_BUCKETS, is_chunk, lines
from sheaf.operators.order_stats import exact_quantiles

# Scores are compared after rounding: equal chunks must equal their mean.
SCORE_DIGITS = 9


# Terms are hashed, so that no term is left out and weights have a fixed size.
BUCKETS = TERM_BUCKETS


def numbered_chunks(text: Column) -> Column:
    """Structs ``pos, chunk`` of every line worth scoring; none for a null text."""
    numbered = F.transform(lines(text), lambda line, i: F.struct(i.alias("pos"), line.alias("chunk")))
    return F.coalesce(F.filter(numbered, lambda c: is_chunk(c["chunk"], c["pos"])), F.filter(F.array(
        F.struct(F.lit(0).alias("pos"), F.lit("").alias("chunk"))), lambda c: F.lit(False)))


def chunk_rows(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Rows ``key, pos, chunk`` for every line worth scoring; nothing is exchanged."""
    return df.select(key, F.explode(numbered_chunks(F.col(text))).alias("c")).select(key, "c.pos", "c.chunk")


def query_buckets(query: str) -> dict[int, int]:
    """How many terms of the query fall into each bucket."""
    return dict(Counter(map(bucket_of.__getitem__, find_terms(query.lower()))))


def bucket_weights(df: DataFrame, text: str = "text") -> np.ndarray:
    """The smoothed idf of every bucket over all chunks.

    Tasks count the buckets of their own texts, so a task sends one number for
    each bucket at most, and as many come back.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The last place counts the chunks themselves.
        seen = np.zeros(BUCKETS + 1, np.int64)
        for batch in batches:
            found = ChunkTerms(batch.column(0).to_pylist())
            seen[:-1] += np.bincount(found.bucket, minlength=BUCKETS)
            seen[-1] += len(found.pos)
        held = np.flatnonzero(seen)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(held, pa.int32()), "df": pa.array(seen[held])})

    counts = df.select(F.col(text).cast("string")).mapInArrow(count, "bucket int, df bigint")
    seen = np.zeros(BUCKETS + 1)
    for bucket, n in counts.groupBy("bucket").agg(F.sum("df")).collect():
        seen[bucket] = n
    return np.log((1 + seen[-1]) / (1 + seen[:-1])) + 1


def chunk_cosines(found: ChunkTerms, idf: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Cosine of every chunk to the weighted query in TF-IDF space; 0 without terms."""
    weight, n = found.tf * idf[found.bucket], len(found.pos)
    own = np.sqrt(np.bincount(found.chunk, weight * weight, n))
    dot = np.bincount(found.chunk, weight * asked[found.bucket], n)
    length = own * np.sqrt(asked @ asked)
    return np.divide(dot, length, out=np.zeros(n), where=length > 0)


def scored_chunks(df: DataFrame, query: str, text: str = "text", name: str = "scored") -> DataFrame:
    """Add ``name``: structs ``pos, cos`` of every chunk of the row's text.

    Each row is scored by itself against weights whose number is fixed; texts
    and keys move nowhere, so null and repeated keys do not matter.
    """
    idf = bucket_weights(df, text)
    asked = np.zeros(BUCKETS)
    for bucket, n in query_buckets(query).items():
        asked[bucket] = n * idf[bucket]

    @F.arrow_udf("array<struct<pos:int,cos:double>>")
    def score(texts: pa.Array) -> pa.Array:
        found = ChunkTerms(texts.to_pylist())
        cos = chunk_cosines(found, idf, asked)
        chunks = pa.StructArray.from_arrays([pa.array(found.pos), pa.array(cos)], ["pos", "cos"])
        ends = np.concatenate([[0], np.cumsum(found.rows)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), chunks)

    rounded = F.transform(
        score(F.col(text).cast("string")),
        lambda c: F.struct(c["pos"].alias("pos"), F.round(c["cos"], SCORE_DIGITS).alias("cos")),
    )
    return df.withColumn(name, rounded)


def vector_scores(df: DataFrame, vector: str, query: Column) -> DataFrame:
    """Cosine, distance and combined score for any vector column."""
    return (
        df.withColumn("_q", query)
        .withColumn("cos", cosine(F.col(vector), F.col("_q")))
        .withColumn("dist", euclidean(F.col(vector), F.col("_q")))
        .withColumn("score", combined_score(F.col("cos"), F.col("dist")))
        .drop("_q")
    )


def above_group_mean(df: DataFrame, group: str, score: str) -> DataFrame:
    """Rows at or above the mean score of their group.

    Means combine before the shuffle and come back by a join, so a group of
    any size is never sorted or buffered as a whole.
    """
    means = df.groupBy(group).agg(F.round(F.avg(score), SCORE_DIGITS).alias("_mean"))
    return (
        df.join(means, group)
        .where(F.round(score, SCORE_DIGITS) >= F.col("_mean"))
        .drop("_mean")
    )


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once for the row, not for each element."""
    return F.get(F.transform(F.array(value), use), 0)


def mean_filter(scored: Column) -> Column:
    """Positions of the chunks at or above the mean score of their row."""
    mean = F.try_divide(F.aggregate(scored, F.lit(0.0), lambda a, c: a + c["cos"]), F.size(scored))
    kept = _with(F.round(mean, SCORE_DIGITS), lambda m: F.filter(scored, lambda c: c["cos"] >= m))
    return F.transform(kept, lambda c: c["pos"])


def assemble(text: Column, kept: Column) -> Column:
    """Kept lines in order; none gives ``""``."""
    picked = _with(lines(text), lambda every: F.transform(kept, lambda p: F.get(every, p)))
    return F.coalesce(F.array_join(picked, "\n"), F.lit(""))


def filter_documents(df: DataFrame, text: str, query: str) -> DataFrame:
    """Chunk, score, keep by the row's mean and re-assemble, row by row.

    Adds ``kept`` (positions), ``n_chunks`` and ``filtered_text`` and drops the
    text. Only the counts of terms cross the network.
    """
    scored = scored_chunks(df, query, text, "_scored")
    kept = scored.withColumn("kept", mean_filter(F.col("_scored")))
    return (
        kept.withColumn("n_chunks", F.size("_scored"))
        .withColumn("filtered_text", assemble(F.col(text), F.col("kept")))
        .drop("_scored", text)
    )


def above_percentile(df: DataFrame, score: str, share: float = 0.7) -> DataFrame:
    """Rows at or above the exact percentile of all scores."""
    bound = exact_quantiles(df, score, [share]).select(F.round("quantile", SCORE_DIGITS))
    return df.where(F.round(score, SCORE_DIGITS) >= bound.scalar())
