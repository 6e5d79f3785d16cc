"""Bounded, repeatable samples of labelled rows for fitting."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from sheaf.session import written


def remainder(column, divisor: int):
    """crc32 of the id as text, modulo ``divisor``; null for a null id."""
    return F.crc32(column.cast("string").cast("binary")) % divisor


def bounded(labelled: DataFrame, per_label: int) -> DataFrame:
    """``id, label`` of ``per_label`` rows of each label at most, in the order of their hashes.

    Ranks are cut before the shuffle, so a hot label moves ``per_label`` rows
    of each task. Only ids and labels are read here.
    """
    order = Window.partitionBy("label").orderBy(F.xxhash64("id"), "id")
    ranked = labelled.select("id", "label").distinct().withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= per_label).select("id", "label")


def weighted(labelled: DataFrame, per_label: int) -> DataFrame:
    """``bounded`` with ``weight``, how many ids of its label each row stands for."""
    sizes = labelled.select("id", "label").distinct().groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    stands = F.greatest(F.lit(1.0), F.col("n") / per_label)
    return bounded(labelled, per_label).join(F.broadcast(sizes), "label").select("id", "label", stands.alias("weight"))


def fetched(sample: DataFrame) -> list[Row]:
    """The rows of a bounded sample, part by part, so that the driver's JVM never holds them all."""
    return list(written(sample, "sample").toLocalIterator())
