"""CSV, text and JSON scans and sinks with declared schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from sheaf.session import written


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV with header and quoted line breaks; the schema is never inferred."""
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("multiLine", True)
        .option("escape", '"')
        .option("mode", "PERMISSIVE")
        .csv(path)
    )


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    (
        df.write.mode(mode)
        .option("header", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def write_table(
    df: DataFrame, path: str, partition_by: tuple[str, ...] = (), mode: str = "errorifexists"
) -> None:
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: ``path, text`` (prompts, sample documents)."""
    return (
        spark.read.text(path, wholetext=True)
        .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    )


def read_keyed_json(
    spark: SparkSession, path: str, one_per_line: bool = True
) -> DataFrame:
    """Files of objects of objects: rows ``id, raw``.

    The value stays text because it may be a record, a text or null. Each line
    is an object, as ``write_keyed_json`` writes them, so a file of any size is
    split among tasks. An object over many lines, such as a hand-written file,
    needs ``one_per_line=False``; it is cut between its members.
    """
    if one_per_line:
        return keyed_rows(spark.read.text(path), F.col("value"))
    return keyed_rows(member_groups(spark, path), F.col("value"))


def _count(text: Column, character: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(character), F.lit("")))


def _depth_change(text: Column, inside: int) -> Column:
    """Brackets opened less those closed outside strings, if the text starts inside one (1) or not (0)."""
    outside = F.array_join(F.filter(F.split(text, '"', -1), lambda _, i: i % 2 == inside), "")
    return _count(outside, "{") + _count(outside, "[") - _count(outside, "]")


def member_groups(spark: SparkSession, path: str) -> DataFrame:
    """Objects over many lines, cut into small objects of a few members each: rows ``value``.

    Files are read in byte ranges, in pieces that end at a closing brace.
    Quotes and brackets before a piece tell whether it starts in a string and
    how deep; they are added up inside each range and then over the ranges of a
    file. A piece that ends at the depth of the members closes a group, so a row
    holds one record and the texts, numbers and nulls in front of it. Files are
    UTF-8 and may hold several objects, one after the other.
    """
    pieces = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("seq"), "value",
    )
    # Escaped characters are neither quotes nor brackets.
    plain = pieces.withColumn("_t", F.regexp_replace("value", r"(?s)\\.", ""))
    counted = plain.select(
        *pieces.columns, _count(F.col("_t"), '"').alias("quotes"), _depth_change(F.col("_t"), 0).alias("d0"), _depth_change(F.col("_t"), 1).alias("d1")
    )
    counted = written(counted, "pieces")
    mine = W.partitionBy("path", "start").orderBy("seq")
    upto, before = (mine.rowsBetween(W.unboundedPreceding, end) for end in (W.currentRow, -1))
    earlier = W.partitionBy("path").orderBy("start").rowsBetween(W.unboundedPreceding, -1)

    def closed(quotes: Column) -> Column:
        """1 for the brace behind a piece, unless it is in a string."""
        return F.when(quotes % 2 == 0, 1).otherwise(0)

    def changes(inside: Column, other: Column) -> Column:
        # After an even number of quotes the piece is where the range started.
        even = F.col("seen") % 2 == 0
        return F.when(even, inside).otherwise(other)

    seen = counted.withColumn("seen", F.coalesce(F.sum("quotes").over(before), F.lit(0)))
    ends = F.col("seen") + F.col("quotes")
    ranges = seen.groupBy("path", "start").agg(
        F.sum("quotes").alias("quotes"),
        F.sum(changes(F.col("d0"), F.col("d1")) - closed(ends)).alias("d0"),
        F.sum(changes(F.col("d1"), F.col("d0")) - closed(ends + 1)).alias("d1"),
    )
    ranges = ranges.withColumn("odd", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2)
    ranges = ranges.withColumn("depth", F.coalesce(F.sum(F.when(F.col("odd") == 0, F.col("d0")).otherwise(F.col("d1"))).over(earlier), F.lit(0)))
    placed = seen.join(ranges.select("path", "start", "odd", "depth"), ["path", "start"]).withColumn("seen", F.col("seen") + F.col("odd"))
    ends = F.col("seen") + F.col("quotes")
    deep = placed.withColumn("depth", F.col("depth") + F.sum(changes(F.col("d0"), F.col("d1")) - closed(ends)).over(upto))
    deep = deep.withColumn("closes", F.when((ends % 2 == 0) & (F.col("depth") <= 1), 1).otherwise(0))
    deep = deep.withColumn("_own", F.coalesce(F.sum("closes").over(before), F.lit(0)))
    groups = deep.groupBy("path", "start").agg(F.sum("closes").alias("closes"))
    groups = groups.select("path", "start", F.coalesce(F.sum("closes").over(earlier), F.lit(0)).alias("_first"))
    numbered = deep.join(groups, ["path", "start"]).withColumn("group", F.col("_first") + F.col("_own"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "seq", "value"))), lambda p: p["value"]), "}")
    whole = numbered.groupBy("path", "group").agg(text.alias("text"), F.min("depth").alias("depth"))
    # The brace behind the last piece ends a member, or else the object itself.
    members = F.concat(F.regexp_replace("text", r"^[\s,{]+", ""), F.when(F.col("depth") == 1, "}").otherwise(""))
    return whole.select(F.concat(F.lit("{"), members, F.lit("}")).alias("value"))


def keyed_rows(df: DataFrame, body: Column) -> DataFrame:
    entries = F.from_json(body, "map<string,string>")
    return df.select(F.explode(entries).alias("id", "raw"))


def records(df: DataFrame, schema: T.StructType | str, raw: str = "raw") -> DataFrame:
    """Typed record columns from keyed rows, next to the id."""
    return df.select("id", F.from_json(raw, schema).alias("r")).select("id", "r.*")


def keyed_lines(df: DataFrame, key: str, value: Column) -> DataFrame:
    """One JSON line ``{"<id>": record}`` per row: the distributed export."""
    pair = F.create_map(F.col(key).cast("string"), value)
    return df.select(F.to_json(pair, {"ignoreNullFields": "false"}).alias("value"))


def write_keyed_json(df: DataFrame, key: str, value: Column, path: str) -> None:
    keyed_lines(df, key, value).write.text(path)
