"""A stream over files gives what the same operator gives over the table."""

import pytest
from pyspark.sql import functions as F

from juristream.streaming import events as stream


@pytest.fixture(scope="module")
def batches(spark, sf_dir, tmp_path_factory):
    df = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    path = str(tmp_path_factory.mktemp("events"))
    for k in range(3):
        df.where(f"event_id >= {k * 334} AND event_id < {(k + 1) * 334}").coalesce(1).write.mode("append").parquet(path)
    return df, spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def drained(out, name):
    q = out.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return out.sparkSession.table(name)


def test_tumbling(batches):
    table, flow = batches
    want = {tuple(r[:3]) for r in stream.tumbling(table, "1 hour").collect()}
    got = {tuple(r[:3]) for r in drained(stream.tumbling(flow, "1 hour"), "tumbling").collect()}
    assert got <= want and len(got) > 0.9 * len(want)  # the last windows are still open


def test_cooldown(batches):
    table, flow = batches
    want = {tuple(r) for r in stream.cooldown(table, ["event_type"], hours=12).collect()}
    got = {tuple(r) for r in drained(stream.cooldown(flow, ["event_type"], hours=12), "cooldown").collect()}
    assert got == want


def test_first_seen(batches):
    table, flow = batches
    assert drained(stream.first_seen(flow, ["event_id"]), "first_seen").count() == table.count()


def test_snapshots_of_batches(batches, tmp_path):
    table, flow = batches
    stream.into_snapshots(flow, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    assert table.sparkSession.read.parquet(str(tmp_path / "out")).count() == table.count()
