"""Document assembly: files to papers, one row per identifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.operators.order_stats import first_values

MAX_FILES = 6
KEPT_FILES = 3


def file_parts(stem: Column) -> Column:
    """``"{row}_{i}"`` to a struct of row and i."""
    return F.struct(
        F.substring_index(stem, "_", 1).try_cast("long").alias("row"),
        F.substring_index(stem, "_", -1).try_cast("int").alias("i"),
    )


def attach_files(
    papers: DataFrame,
    files: DataFrame,
    row: str,
    place: str = "i",
    text: str = "text",
    max_files: int = MAX_FILES,
    keep: int = KEPT_FILES,
) -> DataFrame:
    """Left join of the first ``keep`` existing files among the candidates.

    One aggregate per place instead of a gathered list: a paper's state has
    ``max_files`` texts whatever its number of rows, and combines before the
    shuffle. A file that parsed to ``""`` still counts.
    """
    body = F.coalesce(text, F.lit(""))
    places = F.array(
        *[
            F.struct(F.lit(i).alias("i"), F.max(F.when(F.col(place) == i, body)).alias("t"))
            for i in range(1, max_files + 1)
        ]
    )
    gathered = (
        files.where(F.col(place).between(1, max_files))
        .groupBy(row)
        .agg(places.alias("files"))
        .withColumn("files", F.slice(F.filter("files", lambda f: f["t"].isNotNull()), 1, keep))
    )
    return papers.join(gathered, row, "left")


def concat_texts(files: Column) -> Column:
    """Texts in file order, nothing between them; no file gives ``""``."""
    return F.coalesce(F.array_join(F.transform(files, lambda f: f["t"]), ""), F.lit(""))


def non_empty(df: DataFrame, text: str = "text") -> DataFrame:
    return df.where(F.length(text) > 0)


def one_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """First non-null value per column and key, in ``order``."""
    rest = [c for c in df.columns if c not in (key, order)]
    return first_values(df, key, order, rest)


def append_batch(previous: DataFrame, new: DataFrame) -> DataFrame:
    """Union by name; columns missing on a side become null, keys stay."""
    return previous.unionByName(new, allowMissingColumns=True)


def last_token(text: Column) -> Column:
    return F.try_element_at(F.split(F.trim(text), r"\s+"), F.lit(-1))
