from __future__ import annotations

from datetime import datetime, timedelta

from loomframe.streaming.change_feed import fold_stream, latest_rows, seen_once, settled, shared_folder, stream_files

SCHEMA = "page_id long, slug string, crawl_op string, indexed_at timestamp"
T0 = datetime(2026, 1, 1)


def rows(n):
    return [(i % 7, f"s{i % 7}", "delete" if i % 11 == 0 else "update", T0 + timedelta(hours=(i * 37) % 100)) for i in range(n)]


def test_incremental_equals_full(spark, tmp_path):
    feed = tmp_path / "feed"
    for part in range(5):
        spark.createDataFrame(rows(60)[part::5], SCHEMA).coalesce(1).write.mode("append").parquet(str(feed))
    stream = stream_files(spark, str(feed), spark.read.parquet(str(feed)).schema, 1)
    last = fold_stream(stream, shared_folder(spark, "test"))
    full = latest_rows(spark.read.parquet(str(feed)), "page_id", ["indexed_at", "crawl_op"])
    assert last.endswith("/v4") and set(map(tuple, spark.read.parquet(last).collect())) == set(map(tuple, full.select("page_id", "indexed_at", "crawl_op", "slug").select(*spark.read.parquet(last).columns).collect()))


def test_repeats_are_dropped(spark, tmp_path):
    feed = tmp_path / "feed"
    spark.createDataFrame(rows(10) + rows(10), SCHEMA).coalesce(2).write.parquet(str(feed))
    once = seen_once(stream_files(spark, str(feed), spark.read.parquet(str(feed)).schema), "slug", "indexed_at")
    once.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "o")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "o")).count() == 7


def test_settled(spark):
    states = spark.createDataFrame([("a", 1, "x"), ("a", 2, "x"), ("a", 3, "y")], "k string, tick int, digest string")
    assert [(r.k, r.tick) for r in settled(states, "k", "tick", "digest").collect()] == [("a", 2)]
