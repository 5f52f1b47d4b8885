"""Incremental data: session progress, retention, and re-running rules for changed reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def session_progress(events: DataFrame) -> DataFrame:
    """Latest progress (clamped to 0..99) and last non-empty stage per session; works on a batch or a stream."""
    order = "struct(ts, event_id)"
    return events.groupBy("user_id").agg(
        F.expr(f"max_by(greatest(0.0D, least(99.0D, value)), if(value IS NULL, NULL, {order})) AS progress"),
        F.expr(f"max_by(trim(stage), if(trim(coalesce(stage, '')) = '', NULL, {order})) AS stage"),
        F.expr("max(ts) AS updated_at"))


def expired_sessions(events: DataFrame, seconds: int) -> DataFrame:
    """Sessions idle for longer than the retention, measured at the newest event of the corpus."""
    last = events.groupBy("user_id").agg(F.max("ts").alias("updated_at"))
    newest = last.agg(F.max("updated_at").alias("now"))
    return last.join(F.broadcast(newest)).where(
        F.expr(f"now - updated_at > make_dt_interval(0, 0, 0, {seconds})")).select("user_id", "updated_at")


def idle_windows(events: DataFrame, gap: str, lateness: str) -> DataFrame:
    """Streaming twin of retention: a session closes once the watermark passes its idle gap."""
    return events.withWatermark("ts", lateness).groupBy(F.session_window("ts", gap), "user_id").agg(
        F.count("*").alias("n_events"), F.max("ts").alias("updated_at"))


def newest_by_key(rows: DataFrame, key: list[str], version: str) -> DataFrame:
    return rows.groupBy(*key).agg(F.expr(f"max_by(struct(*), {version}) AS r")).select("r.*")


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def newest_arrivals(arrivals: DataFrame, key: list[str], version: str) -> DataFrame:
    """A stream's newest row per key (r) and the batch that last brought the key (touched), as a keyed aggregate.

    Rows of a batch carry its time. Of equal versions the earliest arrival stays. In update mode a batch gives the
    keys it touched, and a key has changed exactly when its newest row came in that batch.
    """
    marked = arrivals.withColumn("_arrived", F.current_timestamp())
    order = f"struct({version}, -unix_micros(_arrived))"
    return marked.groupBy(*key).agg(F.expr(f"max_by(struct(*), {order}) AS r"), F.max("_arrived").alias("touched"))


def run_changed(arrivals: DataFrame, run: Callable[[DataFrame, int], None], key: list[str], version: str, checkpoint_path: str,
                name: str | None = None) -> StreamingQuery:
    """For every micro-batch run a job for the keys whose newest row changed, and for those only.

    The newest row of each key is streaming state in RocksDB, so a batch reads and writes the state of its own
    keys, however many batches and keys came before. A version no newer than the state is ignored. A replayed
    batch has the time and state it had, so it gives the same keys again. Rows should be narrow (a key, a
    version and where the payload is): the state holds one for every key.
    """
    arrivals.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)

    def handle(batch: DataFrame, batch_id: int) -> None:
        run(batch.where("r._arrived = touched").select("r.*").drop("_arrived"), batch_id)

    stream = newest_arrivals(arrivals, key, version).writeStream.outputMode("update").foreachBatch(handle).option("checkpointLocation", checkpoint_path)
    return (stream.queryName(name) if name else stream).trigger(availableNow=True).start()
