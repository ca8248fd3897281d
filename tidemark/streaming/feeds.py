"""Structured Streaming: change feeds into the store, and windowed search analytics."""

from __future__ import annotations

import hashlib
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.types import LongType, StructField, StructType

from tidemark.operators.scratch import scratch, written
from tidemark.operators.site import valid_events
from tidemark.operators.store import Store, routed


def windowed_analytics(events: DataFrame, late: str = "1 hour", size: str = "1 day") -> DataFrame:
    """q, locale, day, n, zero, results of a stream (or table) of events with ts; later rows than `late` are dropped. Days are UTC's."""
    seen = valid_events(events)
    seen = seen.withWatermark("ts", late) if events.isStreaming else seen
    out = seen.groupBy(F.window("ts", size).alias("w"), "q", "locale").agg(F.count("*").alias("n"), F.count_if(F.col("results") == 0).alias("zero"), F.sum("results").alias("results"))
    return out.select(F.to_date(F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.col("w.start").cast("timestamp_ntz"))).alias("day"), "q", "locale", "n", "zero", "results")


def last_of_batch(batch: DataFrame) -> DataFrame:
    """One change an id: that with the largest ts, of those a deletion last."""
    w = Window.partitionBy("id").orderBy(F.desc("ts"), F.desc("op"))
    return batch.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


class Ledger:
    """Which version (ts) of an id a store has seen last, deletions too: Parquet beside the store, a folder for each batch.

    A batch writes its ids before the store takes them and leaves its own folder out when it reads, so one that runs
    again decides as before. Once there are MOST of them, folders become one with a row an id.
    """

    MOST = 16

    def __init__(self, store: Store):
        self.store, self.path = store, f"{store.path}/versions"

    def _folders(self) -> list[str]:
        return self.store._names("versions")

    def _read(self, names: list[str]) -> DataFrame | None:
        return self.store.spark.read.schema("id string, ts long").parquet(*(f"{self.path}/{n}" for n in names)) if names else None

    def newer(self, changes: DataFrame, batch: str) -> DataFrame:
        """The changes that are not older than what was seen of their id; what is left is noted under the batch's name."""
        known = self._read([n for n in self._folders() if n != f"batch-{batch}"])
        if known is not None:
            seen = known.join(changes.select("id"), "id", "left_semi").groupBy("id").agg(F.max("ts").alias("__seen"))
            changes = changes.join(seen, "id", "left").where("__seen IS NULL OR ts >= __seen").drop("__seen")
        changes = written(changes, "changes")
        changes.select("id", F.col("ts").cast("long").alias("ts")).write.mode("overwrite").parquet(f"{self.path}/batch-{batch}")
        return changes

    def compact(self) -> None:
        """Many folders into one. The new one is written before the old ones go; seeing both for a while changes nothing."""
        names = self._folders()
        if len(names) >= self.MOST:
            one = self._read(names).groupBy("id").agg(F.max("ts").alias("ts"))
            one.write.parquet(f"{self.path}/all-{uuid.uuid4().hex}")
            for n in names:
                self.store._fs.delete(self.store._at(f"versions/{n}"), True)


def apply_changes(batch: DataFrame, store: Store, name: str | None = None) -> None:
    """One micro-batch of documents with op (upsert or delete) and ts: the last change of an id counts.

    An older change that comes in a later batch counts for nothing, also where the newer one was a deletion; of equal ts the
    later batch counts. name is the batch's own: running it again gives the same store, so a restart is safe.
    """
    ledger = Ledger(store)
    last = ledger.newer(last_of_batch(batch), name or uuid.uuid4().hex)
    store.apply(routed(last).withColumn("__gone", F.col("op") == "delete").drop("op", "ts"))
    ledger.compact()


def follow(changes: DataFrame, store: Store, checkpoint: str):
    """A streaming query that keeps the store up to date with a stream of changes."""
    feed = hashlib.md5(checkpoint.encode()).hexdigest()[:8]
    return changes.writeStream.foreachBatch(lambda batch, n: apply_changes(batch, store, f"{feed}-{n}")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Progress(StreamingQueryListener):
    """Writes what streams say of themselves to a folder as it happens: a row at the start, for each batch, and at the end.

    Events of several streams may come at a time, and a folder takes one writer: they wait for each other.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self._one = spark, folder, threading.Lock()

    def _keep(self, run, state: str, batch: int = -1, rows: int = 0, rate: float = 0.0, error: str | None = None) -> None:
        values = (str(run), state, batch, rows, float(rate or 0.0), error)
        with self._one:
            self.spark.createDataFrame([values], "run string, state string, batch long, rows long, rate double, error string").withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(self.folder)

    def onQueryStarted(self, event) -> None:
        self._keep(event.runId, "started")

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self._keep(p.runId, "running", p.batchId, p.numInputRows, p.processedRowsPerSecond)

    def onQueryIdle(self, event) -> None:
        self._keep(event.runId, "idle")

    def onQueryTerminated(self, event) -> None:
        self._keep(event.runId, "failed" if event.exception else "ended", error=event.exception)


PROGRESS = "run string, state string, batch long, rows long, rate double, error string, at timestamp"


def run_progress(rows: DataFrame) -> DataFrame:
    """run, state, batches, rows, last_batch, seen of every run, from rows of Progress: what a reader of a running one sees.

    A state is the last that was told: started, running, idle, then ended or failed. A batch that ran again counts once.
    """
    rank = F.when(F.col("state").isin("ended", "failed"), 2).when(F.col("state") == "started", 0).otherwise(1)
    each = rows.groupBy("run", "batch").agg(F.max("rows").alias("rows"), F.max(F.struct(rank.alias("rank"), "at", "state")).alias("last"))
    out = each.groupBy("run").agg(F.max("last").alias("last"), F.count_if(F.col("batch") >= 0).alias("batches"), F.sum("rows").alias("rows"), F.max("batch").alias("last_batch"))
    return out.select("run", "last.state", "batches", "rows", "last_batch", F.col("last.at").alias("seen"))


def scratch_store(spark: SparkSession) -> Store:
    return Store(spark, f"{scratch(spark)}/store-{uuid.uuid4().hex}")


def run_windowed(events: DataFrame, size: str = "1 day") -> DataFrame:
    """Drains a stream of events and returns its windowed analytics, all windows included.

    Each micro-batch writes the groups that changed under its own number, so one that runs again writes the same; of a group
    the last batch counts. The state holds only windows that the watermark has not passed.
    """
    out, spark = f"{scratch(events.sparkSession)}/windows-{uuid.uuid4().hex}", events.sparkSession
    windows = windowed_analytics(events, size=size)
    schema = windows.schema
    spark.createDataFrame([], schema).write.parquet(f"{out}/batch=-1")

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={n}")

    windows.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{out}-progress").trigger(availableNow=True).start().awaitTermination()
    found = spark.read.schema(StructType([*schema.fields, StructField("batch", LongType())])).parquet(out)
    last = found.groupBy("day", "q", "locale").agg(F.max_by(F.struct("n", "zero", "results"), "batch").alias("last"))
    return last.select("day", "q", "locale", "last.*")


def record_events(events: DataFrame, folder: str) -> None:
    """Appends search events (q, locale, results, ts) that are valid to a sink, a folder a day; nothing is read back."""
    valid_events(events).withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").parquet(folder)


def recorded(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder)
