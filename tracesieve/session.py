"""Session helpers: a local session for tests, the shared work folder, shipping the package."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_fallback: dict[str, str] = {}


def local_session(cpus: int | str = "*", app: str = "tracesieve", **conf) -> SparkSession:
    """A single-machine session for tests and benches."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, named by ``spark.checkpoint.dir``.

    A folder of our own is made only on a local master with the setting unset;
    on a cluster a machine-local folder would be lost with its machine, so that
    is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root
    app = spark.sparkContext.applicationId
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    if app not in _fallback:
        _fallback[app] = tempfile.mkdtemp(prefix="tracesieve-")
        spark.sparkContext.setCheckpointDir(_fallback[app])
    return _fallback[app]


def work_path(spark: SparkSession, name: str) -> str:
    """A new, unused path for one written table."""
    return f"{shared_folder(spark).rstrip('/')}/tracesieve/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives executor loss."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Make the package importable in Python workers, whatever folder they start in.

    The archive is made on the driver and handed out by Spark; no executor reads that folder.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="tracesieve-ship-"), "tracesieve.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(package)))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate: no job is run for it."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def is_small(df: DataFrame, bytes_per_task: int = 32 << 20) -> bool:
    """Whether the estimated size is below one modest partition per core."""
    return estimated_bytes(df) < df.sparkSession.sparkContext.defaultParallelism * bytes_per_task


def spread(df: DataFrame) -> DataFrame:
    """Use every core on an input too small to be split by the scan.

    Vector work costs far more than its bytes suggest, so a small file read as
    one partition is spread out.  Inputs that already fill the cluster are left
    alone: no extra shuffle at scale.
    """
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if is_small(df) else df


def compact(df: DataFrame, rows: int, row_bytes: int, bytes_per_task: int = 64 << 20) -> DataFrame:
    """Fewer tasks for a cached table that every step of an iterative fit visits, if it is small."""
    tasks = max(1, -(-rows * row_bytes // bytes_per_task))
    return df.coalesce(tasks) if tasks < df.sparkSession.sparkContext.defaultParallelism else df
