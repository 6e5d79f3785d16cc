"""Session building, the shared folder and durable intermediate results."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Intermediates by application, for release().
_paths: dict[str, list[str]] = {}


def build_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benches, with a folder of its own; clusters bring their own."""
    folder = tempfile.mkdtemp(prefix="sheaf-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("sheaf")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.checkpoint.dir", folder)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


# Runtime settings every plan here counts on. A paper, source or class may hold
# a third of all rows: joins on such keys are split by adaptive execution, also
# where that costs one more exchange behind the join.
SKEW_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    for key, value in SKEW_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


# Applications whose executors have this package.
_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, so that functions run there need no copy of it."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return spark
    _shipped.add(context.applicationId)
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="sheaf-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(f"{folder}/sheaf.zip", "w") as archive:
        for file in sorted(root.rglob("*.py")):
            archive.write(file, file.relative_to(root.parent))
    context.addPyFile(f"{folder}/sheaf.zip")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    A session that names none has the warehouse, which all executors share too.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    return (base or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_intermediate").rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/sheaf/{name}-{uuid.uuid4().hex}"
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.master.startswith("local["):
        # Nobody else clears the folder of a session that runs in this process alone.
        atexit.register(shutil.rmtree, re.sub("^file:/+", "/", path), ignore_errors=True)
    _paths.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def written(df: DataFrame, name: str, compression: str = "snappy", **options) -> DataFrame:
    """Cut the lineage of ``df`` by writing it to the shared folder, with further ``options`` of the writer.

    Parquet instead of a block-manager checkpoint: it outlives lost
    executors, and later readers still prune columns and push filters. The
    files stay until ``release``, since any result may still read them.
    """
    path = new_path(df.sparkSession, name)
    df.write.option("compression", compression).options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def collect_garbage(spark: SparkSession) -> None:
    """Have the driver's JVM collect its garbage now; files of dead shuffles go with it.

    For loops and chains of jobs: left to itself, the driver's heap grows to its
    limit though little of it is in use.
    """
    spark.sparkContext._jvm.System.gc()


def _delete(spark: SparkSession, paths: Iterable[str]) -> None:
    for path in paths:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def intermediates(spark: SparkSession) -> list[str]:
    """Where the intermediates lie that this session has written, in the order of writing."""
    return list(_paths.get(spark.sparkContext.applicationId, []))


def release(spark: SparkSession, paths: Sequence[str] | None = None) -> int:
    """Delete given intermediates, by default every one this session has written; how many there were.

    Call it when no result that was built so far will read them again.
    """
    app = spark.sparkContext.applicationId
    if paths is None:
        paths = _paths.pop(app, [])
    elif paths:
        _paths[app] = [p for p in _paths.get(app, []) if p not in set(paths)]
    _delete(spark, paths)
    return len(paths)
