from pyspark.sql import functions as F

from dialecta import sources, streaming
from dialecta.tables import read_table
from tests.conftest import DATA


def test_tumbling_stream_equals_batch(spark, tmp_path):
    events = read_table(spark, DATA, "events")
    folder = str(tmp_path / "events")
    events.repartition(3).write.parquet(folder)
    stream = streaming.tumbling(streaming.event_stream(spark, folder, events.schema), "ts", "event_type", "value", "1 hour", "60 days")
    got = streaming.drain(stream, "tumbling_out", "complete").select("start", "event_type", "n")
    want = streaming.tumbling(events, "ts", "event_type", "value", "1 hour", "60 days").select(F.col("start").cast("timestamp").alias("start"), "event_type", "n")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_deduplicated_stream(spark, tmp_path):
    events = read_table(spark, DATA, "events")
    folder = str(tmp_path / "twice")
    events.unionAll(events).repartition(2).write.parquet(folder)
    out = streaming.drain(streaming.deduplicated(streaming.event_stream(spark, folder, events.schema), "event_id", "ts", "60 days"), "dedup_out")
    assert out.count() == events.count()


def test_upsert_sink_keeps_newest(spark, tmp_path):
    write = streaming.upsert_sink(str(tmp_path / "t"), "k", "o")
    write(spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "k int, o int, v string"), 0)
    write(spark.createDataFrame([(1, 2, "c"), (2, 0, "old")], "k int, o int, v string"), 1)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "t")).collect())) == [(1, 2, "c"), (2, 1, "b")]


def test_sources_round_trip(spark, tmp_path):
    df = spark.range(10).select("id", (F.col("id") % 2).cast("string").alias("p"))
    for kind in ("parquet", "orc", "json", "csv"):
        path = str(tmp_path / kind)
        sources.write_data(df, path, kind, partition_by=["p"], sort_by=["id"])
        assert sources.read_data(spark, path, kind, "id long, p string").count() == 10
    sources.write_scripts(spark.createDataFrame([("view", "create view a as select 1")], "k string, s string"), str(tmp_path / "sql"), "k", "s")
    assert sources.read_scripts(spark, str(tmp_path / "sql")).first().sql.strip() == "create view a as select 1"
