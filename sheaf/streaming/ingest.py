"""Incremental file ingest as a stream that runs until it has caught up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def new_files(
    spark: SparkSession,
    folder: str,
    schema: T.StructType,
    pattern: str | None = None,
    fmt: str = "parquet",
    files_per_batch: int | None = None,
) -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(folder)


def append_new_files(
    spark: SparkSession,
    folder: str,
    schema: T.StructType,
    target: str,
    pattern: str | None = None,
    fmt: str = "parquet",
    transform=None,
    files_per_batch: int | None = None,
) -> None:
    """Append every file not seen before to ``target``, then stop.

    The checkpoint next to the target remembers the files, and the file
    sink's log makes a rerun after a lost driver write nothing twice.
    """
    stream = new_files(spark, folder, schema, pattern, fmt, files_per_batch)
    if transform is not None:
        stream = transform(stream)
    (
        stream.writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", target + "-progress")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
