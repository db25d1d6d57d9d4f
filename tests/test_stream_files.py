from pyspark.sql import functions as F

from pollgauge.plans import streams


def test_the_compacted_archive_has_a_file_per_feed_and_not_per_day(spark, tmp_path, monkeypatch):
    start = F.lit(1_704_067_200) + F.col("id") * 3600  # twenty days of hours, three feeds
    events = spark.range(480).select(
        F.col("id").alias("event_id"), start.cast("timestamp").alias("ts"), (F.col("id") % 3 * 60).alias("user_id"),
        F.lit("view").alias("event_type"), F.lit(7.0).alias("value"), F.lit("").alias("props"),
    )
    events.write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(streams, "work_path", lambda spark, name: str(tmp_path / name))
    streams.doc_stream(spark, str(tmp_path))
    files = list((tmp_path / "docs").rglob("part-*"))
    assert {f.parent.name for f in files} == {"feed_id=0", "feed_id=1", "feed_id=2"}
    assert len(files) <= 3 + 4  # feeds and shuffle partitions; sixty for feeds and days
    assert sum(len(f.read_text().splitlines()) for f in files) == 480
