"""Change feeds: order across batches, batches that run again, and what runs tell of themselves."""

import time

import pytest
from pyspark.sql import functions as F

from tidemark.operators.store import Store
from tidemark.streaming import feeds

COLUMNS = "id string, locale string, title string, indexed_at long, op string, ts long"


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store")


def batch(spark, *rows):
    return spark.createDataFrame([(i, "de", title, ts, op, ts) for i, title, op, ts in rows], COLUMNS)


def titles(store):
    return {r.id: r.title for r in store.read().collect()}


def test_older_changes_of_later_batches_count_for_nothing(spark, store):
    feeds.apply_changes(batch(spark, ("a", "a20", "upsert", 20), ("a", "a15", "upsert", 15), ("b", "b1", "upsert", 1), ("c", "", "delete", 30)), store, "1")
    feeds.apply_changes(batch(spark, ("a", "a10", "upsert", 10), ("b", "b2", "upsert", 2), ("c", "c29", "upsert", 29), ("d", "d1", "upsert", 1)), store, "2")
    assert titles(store) == {"a": "a20", "b": "b2", "d": "d1"}
    feeds.apply_changes(batch(spark, ("a", "", "delete", 19), ("b", "again", "upsert", 2), ("c", "c31", "upsert", 31), ("d", "", "delete", 2)), store, "3")
    assert titles(store) == {"a": "a20", "b": "again", "c": "c31"}


def test_a_batch_that_runs_again_decides_as_before(spark, store):
    feeds.apply_changes(batch(spark, ("a", "one", "upsert", 5)), store, "x")
    again = batch(spark, ("a", "two", "upsert", 7), ("b", "", "delete", 7))
    for _ in range(3):
        feeds.apply_changes(again, store, "y")
    assert titles(store) == {"a": "two"} and store._names("versions") == ["batch-x", "batch-y"]


def test_versions_are_kept_when_folders_become_one(spark, store, monkeypatch):
    monkeypatch.setattr(feeds.Ledger, "MOST", 3)
    for n in range(7):
        feeds.apply_changes(batch(spark, ("a", f"a{n}", "upsert", 100 - n), (f"b{n}", "b", "upsert", n), ("c", "", "delete", 50)), store, str(n))
    assert len(store._names("versions")) < 3
    feeds.apply_changes(batch(spark, ("c", "late", "upsert", 49), ("b1", "late", "upsert", 0)), store, "late")
    assert titles(store) == {"a": "a0", **{f"b{n}": "b" for n in range(7)}}


def test_runs_tell_of_themselves(spark, tmp_path):
    source, told = f"{tmp_path}/in", f"file://{tmp_path}/told"
    for n in range(3):
        spark.range(10 * n + 5).coalesce(1).write.mode("append").parquet(source)
    listener = feeds.Progress(spark, told)
    spark.streams.addListener(listener)
    try:
        rows = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(source)
        good = rows.writeStream.foreachBatch(lambda df, _: df.count()).option("checkpointLocation", f"{tmp_path}/c1").trigger(availableNow=True).start()
        good.awaitTermination()
        bad = rows.withColumn("x", F.raise_error(F.lit("no"))).writeStream.foreachBatch(lambda df, _: df.collect()).option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start()
        with pytest.raises(Exception):  # noqa: B017
            bad.awaitTermination()
        for _ in range(100):
            got = {r.run: r for r in feeds.run_progress(spark.read.schema(feeds.PROGRESS).parquet(told)).collect()}
            if {r.state for r in got.values()} == {"ended", "failed"}:
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    done = got[str(good.runId)]
    assert (done.state, done.batches, done.rows, done.last_batch) == ("ended", 3, 45, 2)
    assert got[str(bad.runId)].state == "failed" and got[str(bad.runId)].batches == 0
