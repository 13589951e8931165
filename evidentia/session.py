"""Session for local runs; a cluster brings its own."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "12g") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("evidentia")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@cache
def _local_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: the one of ``spark.checkpoint.dir``.

    Only where that is unset and everything runs in one local JVM, as in tests,
    a temporary folder takes its place; a cluster has to name one.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _local_folder()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Plans stay small, and a lost executor costs its tasks only; zstd keeps the
    copy small.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def evenly(df: DataFrame) -> DataFrame:
    """Rows dealt over the session's shuffle partitions.

    For narrow rows with much work to do: a table of few bytes is read by few
    tasks, however many rows it has, and all of the work would be theirs.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame, name: str) -> DataFrame:
    """``evenly``, as a written table: else filters of the work to come would move below the shuffle."""
    return materialize(evenly(df), name)
