"""Streaming queries, run to the end of what has arrived."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomframe.plans.joins import LK, PG
from loomframe.plans.registry import query
from loomframe.streaming.change_feed import fold_stream, seen_once, settled, shared_folder, stream_files
from loomframe.tables import table


@query("t3_change_feed", f"WITH {PG} SELECT page_id, slug, content_hash, indexed_at FROM pg")
def t3_change_feed(spark, d):
    """The crawl record arrives in six files, two a micro-batch, each batch merged with the version before it."""
    pages, folder = table(spark, d, "pages"), shared_folder(spark, "pages")
    pages.repartition(6).write.parquet(f"{folder}/arrivals")
    last = fold_stream(stream_files(spark, f"{folder}/arrivals", pages.schema), folder)
    rows = spark.read.parquet(last) if last else pages.limit(0)
    return rows.filter(F.coalesce("crawl_op", F.lit("")) != "delete").select("page_id", "slug", "content_hash", "indexed_at")


@query("t5_seen_once", f"WITH {LK} SELECT link_type, count(*) AS n FROM lk WHERE seen_at IS NOT NULL GROUP BY 1")
def t5_seen_once(spark, d):
    """Links delivered twice, counted once: the stream drops repeats within 60 days of the watermark, is written, then counted."""
    schema = table(spark, d, "links").schema
    folder = shared_folder(spark, "links")
    feed = stream_files(spark, f"{d}/links.parquet", schema, 1000).filter(F.col("seen_at").isNotNull())
    once = seen_once(feed, "link_id", "seen_at", "60 days").select("link_id", "link_type")
    once.writeStream.format("parquet").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start(f"{folder}/rows").awaitTermination()
    return spark.read.parquet(f"{folder}/rows").groupBy("link_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "t2_settled_states",
    "SELECT user_id, ts, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts) AS b FROM (SELECT user_id, ts, max(event_type) AS event_type FROM events GROUP BY ALL)) WHERE b = event_type",
)
def t2_settled_states(spark, d):
    """Events at which a user's state equals the one before it."""
    rows = table(spark, d, "events").groupBy("user_id", "ts").agg(F.max("event_type").alias("event_type"))
    return settled(rows, "user_id", "ts", "event_type")
