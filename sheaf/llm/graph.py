"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.session import collect_garbage, written


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """``node, component`` of every node of ``u, v`` (longs); the smallest node names it.

    Each round hangs the larger neighbours of a node on its smallest one, then
    the smaller ones, so long chains fold up in a logarithmic number of rounds.
    Minima combine before the shuffle and the joins are plain equi-joins, which
    adaptive execution splits at a hub. Every round is a table in the shared
    folder, so lineage stays short and lost executors cost one round. What the
    driver held for a round is collected with it.
    """
    edges = links.filter("u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    ).distinct()
    edges = written(edges, name)
    before = None
    while (now := _mark(edges)) != before:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.filter("u <> v").unionByName(low.withColumnRenamed("m", "v")).distinct()
        edges, before = written(small, name), now
        collect_garbage(edges.sparkSession)
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _mark(edges: DataFrame) -> tuple:
    """A fingerprint of the edges, two numbers."""
    mixed = F.xxhash64("u", "v").cast("decimal(38,0)")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(mixed)).first())
