"""The change feed: crawl rows arrive as files and are folded into the current pages."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomframe.session import checkpoint_folder


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for ``name`` in the shared checkpoint folder of the session."""
    return f"{checkpoint_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def latest_rows(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per key, the greatest in ``order``; the rest of the columns comes with it."""
    others = [c for c in rows.columns if c != key and c not in order]
    best = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(*order, *others)).alias("_r"))
    return best.select(key, *[F.col(f"_r.{c}").alias(c) for c in rows.columns if c != key])


def stream_files(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 2) -> DataFrame:
    """A stream over the Parquet files at ``path``, which may be one file or a folder of files."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    local = path.removeprefix("file://")
    if os.path.isfile(local):
        return reader.option("pathGlobFilter", os.path.basename(local)).parquet(os.path.dirname(local))
    return reader.parquet(path)


def fold_stream(feed: DataFrame, folder: str, key: str = "page_id", order: tuple[str, ...] = ("indexed_at", "crawl_op")) -> str | None:
    """Fold all that has arrived into versions below ``folder`` and return the path of the last one.

    Every micro-batch is reduced to its latest row per key, merged with the version
    before it and written as a new version under its batch number, so a batch that is
    run again after a failure overwrites its own result only.  A row older than the
    state it meets is ignored, whenever it arrives.
    """
    done: list[str] = []

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = latest_rows(batch, key, list(order))
        if number > 0:
            rows = latest_rows(rows.unionByName(spark.read.parquet(f"{folder}/v{number - 1}")), key, list(order))
        rows.write.mode("overwrite").parquet(f"{folder}/v{number}")
        done.append(f"{folder}/v{number}")

    started = feed.writeStream.foreachBatch(merge).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    started.awaitTermination()
    return done[-1] if done else None


def seen_once(feed: DataFrame, key: str, time: str, delay: str = "30 days") -> DataFrame:
    """The stream with repeated deliveries of one key within ``delay`` dropped; the state is bounded by the watermark."""
    return feed.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def settled(states: DataFrame, key: str, tick: str, digest: str) -> DataFrame:
    """Ticks at which a state equals the one before it: a change is acted on only once it has stopped changing."""
    from pyspark.sql.window import Window

    order = Window.partitionBy(key).orderBy(tick)
    return states.withColumn("_before", F.lag(digest).over(order)).filter(F.col("_before") == F.col(digest)).drop("_before")
