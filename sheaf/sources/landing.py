"""Bibliographic pages landed as JSON, and incremental file ingest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE = "struct<message: struct<items: array<struct<DOI: string, URL: string, title: string>>>>"


def land_works(
    pages: DataFrame,
    body: str = "body",
    year: str = "year",
    offset: str = "offset",
    most_recent_year: int = 2024,
    years: int = 5,
    max_offset: int = 10_000,
    schema: str = PAGE,
) -> DataFrame:
    """Works with a DOI from pages ``(year, offset, body)``.

    A harvest walks each of the last ``years`` years by offset, stops at the
    first empty page and never passes ``max_offset``. Both limits are page
    properties, so no row is ranked: the stop is one small minimum per year.
    """
    wanted = pages.where(
        F.col(year).between(most_recent_year - years + 1, most_recent_year)
        & (F.col(offset) < max_offset)
    ).select(year, offset, F.from_json(body, schema)["message"]["items"].alias("items"))
    stops = (
        wanted.where(F.coalesce(F.size("items"), F.lit(0)) <= 0)
        .groupBy(year)
        .agg(F.min(offset).alias("stop"))
    )
    # At most ``years`` rows: safe to broadcast whatever the page count.
    return (
        wanted.join(F.broadcast(stops), year, "left")
        .where(F.col("stop").isNull() | (F.col(offset) < F.col("stop")))
        .select(year, offset, F.explode("items").alias("item"))
        .select(year, offset, "item.*")
        .where("DOI is not null")
    )


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")


def unprocessed(inputs: DataFrame, done: DataFrame, path: str = "path") -> DataFrame:
    """Input files whose stem has no output file yet."""
    finished = done.select(file_stem(F.col(path)).alias("_stem")).distinct()
    return (
        inputs.withColumn("_stem", file_stem(F.col(path)))
        .join(finished, "_stem", "left_anti")
        .drop("_stem")
    )
