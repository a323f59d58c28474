"""Session helpers: a tuned local session, and the shared folder that jobs write to."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

#: A frame of at most so many rows may be broadcast; one of more rows is shuffled.
BROADCAST_ROWS = 100_000
#: A configuration table has at most so many rows.
CONFIG_ROWS = 2_000


def local_session(cores: int = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session as tests and the benchmark use it."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("voxelweave")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .getOrCreate()
    )


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or, where that is unset on a local master, a folder of our own.

    On a cluster a folder of the driver's own would be missing on the executors, so there it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-voxelweave-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root


def work_uri(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared root, never used before."""
    return f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Compute once, keep on the shared folder, and forget the lineage. Spark deletes the files with the frame."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


def small_side(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A join side: broadcast if it has been counted to be small, else sorted and merged."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df.hint("merge")


def config_rows(df: DataFrame, most: int = CONFIG_ROWS) -> list[Row]:
    """The rows of a configuration table; ValueError if it is too large to be one."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows of configuration")
    return rows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table as a DataFrame."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
