"""Session settings and lineage cutting shared by all operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and the bench; on a cluster the caller's session is used as it is."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("loomframe")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder the session names in ``spark.checkpoint.dir``; where none is named, one of this machine, in local mode only."""
    named = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.partition("[")[0] == "local":
        raise RuntimeError("on a cluster spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return spark.sparkContext.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back, so that a lost executor costs no recomputation."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def scratch_database(spark: SparkSession, name: str | None = None) -> Iterator[str]:
    """A database whose tables lie in the shared checkpoint folder, dropped with them at the end; ``name``: one that somebody else drops."""
    if name is not None:
        yield name
        return
    name = f"scratch_{uuid.uuid4().hex[:12]}"
    spark.sql(f"CREATE DATABASE {name} LOCATION '{checkpoint_folder(spark).rstrip('/')}/{name}'")
    try:
        yield name
    finally:
        spark.sql(f"DROP DATABASE IF EXISTS {name} CASCADE")


def write_bucketed(df: DataFrame, database: str, key: str, buckets: int) -> tuple[DataFrame, str]:
    """``df`` as a written table bucketed by ``key``, and its name: later joins on the key need no shuffle of it.

    Row groups are small, since Spark reads up to 4,096 rows of one at a time and rows here may be large.
    """
    spark, name = df.sparkSession, f"{database}.t{uuid.uuid4().hex[:12]}"
    df.write.bucketBy(buckets, key).format("parquet").option("parquet.block.size", 1 << 24).saveAsTable(name)
    return spark.table(name), name
