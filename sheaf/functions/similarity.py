"""Vector and text similarity."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 when either side has no length."""
    scale = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.coalesce(F.try_divide(dot(a, b), scale), F.lit(0.0))


def euclidean(a: Column, b: Column) -> Column:
    squares = F.zip_with(
        a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))
    )
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x))


def combined_score(cos: Column, distance: Column) -> Column:
    return cos * 0.7 - distance * 0.3


def matching_ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


def _ratio_udfs():
    """The two Arrow UDFs. Local functions travel to the workers by value, so
    executors need no copy of this package."""

    def scorer():
        # Texts repeat within a batch: every distinct pair is matched once.
        known: dict[tuple[str, str], float] = {}

        def score(x, y):
            if x is None or y is None:
                return None
            if (x, y) not in known:
                known[x, y] = SequenceMatcher(None, x, y).ratio()
            return known[x, y]

        return score

    def pairwise(a: pd.Series, b: pd.Series) -> pd.Series:
        score = scorer()
        return pd.Series([score(x, y) for x, y in zip(a, b)], dtype="float64")

    def to_each(a: pd.Series, others: pd.Series) -> pd.Series:
        score = scorer()
        return pd.Series([[score(x, y) for y in ys] for x, ys in zip(a, others)])

    return (
        F.pandas_udf(pairwise, T.DoubleType()),
        F.pandas_udf(to_each, T.ArrayType(T.DoubleType())),
    )


def ratio(a: Column, b: Column) -> Column:
    """Matching-block ratio of two texts (twice the matches over the lengths)."""
    return _ratio_udfs()[0](a, b)


def ratios(a: Column, others: Column) -> Column:
    """Ratio of ``a`` to each element of the array ``others``, in its order."""
    return _ratio_udfs()[1](a, others)


def with_text_similarity(
    df: DataFrame, a: str, b: str, name: str = "similarity", fold: bool = True
) -> DataFrame:
    """Add the ratio of two columns, computed once per distinct pair.

    A missing right side scores 0, as does a missing left side.
    """
    left, right = (F.lower(a), F.lower(b)) if fold else (F.col(a), F.col(b))
    keyed = df.withColumn("_a", left).withColumn("_b", right)
    scored = keyed.select("_a", "_b").where("_a is not null and _b is not null").distinct()
    scored = scored.withColumn(name, ratio(F.col("_a"), F.col("_b")))
    return (
        keyed.join(scored, ["_a", "_b"], "left")
        .withColumn(name, F.coalesce(F.col(name), F.lit(0.0)))
        .drop("_a", "_b")
    )
