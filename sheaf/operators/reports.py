"""Tables behind the charts: melts, completeness, funnels, distributions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.operators.order_stats import exact_quantiles

BOX = (0.0, 0.25, 0.5, 0.75, 1.0)


def melt(
    df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str, value: str
) -> DataFrame:
    return df.unpivot(list(ids), list(values), name, value)


def _one_row_per_column(df: DataFrame, columns: Sequence[str], stats: Mapping[str, callable]) -> DataFrame:
    """Statistics of many columns in a single aggregation, one row each."""
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("column"), *[make(F.col(c)).alias(n) for n, make in stats.items()])
            for c in columns
        ]
    )
    return df.agg(F.explode(cells).alias("c")).select("c.*")


def completeness(df: DataFrame, columns: Sequence[str], table: str) -> DataFrame:
    """Filled and missing percentage per column."""
    filled = lambda c: F.coalesce(F.try_divide(100.0 * F.count(c), F.count("*")), F.lit(0.0))
    rows = _one_row_per_column(df, columns, {"filled_pct": filled})
    return rows.select(
        F.lit(table).alias("table"),
        "column",
        "filled_pct",
        (100.0 - F.col("filled_pct")).alias("missing_pct"),
    )


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return _one_row_per_column(
        df, columns or df.columns, {"n_null": lambda c: F.count_if(c.isNull())}
    )


def funnel(df: DataFrame, stages: Mapping[str, Column]) -> DataFrame:
    """Rows per stage with the percentage of the first stage.

    Stages are conditions over one table; all are counted in one pass.
    """
    first = next(iter(stages.values()))
    cells = F.array(
        *[
            F.struct(
                F.lit(i).alias("place"),
                F.lit(name).alias("stage"),
                F.count_if(hit).alias("n"),
                F.coalesce(F.try_divide(100.0 * F.count_if(hit), F.count_if(first)), F.lit(0.0)).alias("pct"),
            )
            for i, (name, hit) in enumerate(stages.items())
        ]
    )
    return df.agg(F.explode(cells).alias("c")).select("c.*")


def box_statistics(df: DataFrame, group: str, value: str) -> DataFrame:
    """Exact minimum, quartiles and maximum per group."""
    long = exact_quantiles(df, value, BOX, [group])
    names = ("minimum", "q1", "median", "q3", "maximum")
    return long.groupBy(group).agg(
        *[
            F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(n)
            for p, n in zip(BOX, names)
        ]
    )


def shapes(frames: Mapping[str, DataFrame]) -> DataFrame:
    """Row and column count of every prepared data set."""
    out = None
    for name, df in frames.items():
        row = df.agg(F.count("*").alias("n_rows")).select(
            F.lit(name).alias("data_set"), "n_rows", F.lit(len(df.columns)).alias("n_columns")
        )
        out = row if out is None else out.unionByName(row)
    return out


def epoch_label(name: Column, epochs: Column) -> Column:
    return F.concat(name, F.lit("\n("), epochs.cast("string"), F.lit(" epochs)"))
