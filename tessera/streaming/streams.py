"""Structured Streaming jobs: embedding, index upkeep, deduplicated writes and alerts.

Event-time columns are zone-free in the tables and become zoned for watermarks.
Rows behind the watermark are dropped; a window or session comes out once, when
the watermark has passed its end.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tessera.functions.scalars import ratio
from tessera.operators.ivf import IvfIndex
from tessera.operators.metrics import FINISHED
from tessera.session import work_path
from tessera.sources.paths import is_folder, path_exists
from tessera.sources.tables import VERSION, latest_version, merge_into
from tessera.streaming.silence import SILENCE, SilenceTimer
from tessera.streaming.trail import TRAIL, TaskTrail

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
WATERMARK = "10 minutes"


# --- sources and runs --------------------------------------------------------------

def stream_files(spark: SparkSession, directory: str, schema: T.StructType, name_glob: str = "*.parquet",
                 max_files: int = 1000) -> DataFrame:
    """Parquet files of a directory as a stream; ``max_files`` bounds one micro-batch."""
    return (spark.readStream.schema(schema).option("pathGlobFilter", name_glob)
            .option("maxFilesPerTrigger", max_files).parquet(directory))


def stream_table(spark: SparkSession, path: str, schema: T.StructType, max_files: int = 1000) -> DataFrame:
    """A Parquet table as a stream, be it a folder of part files or one file."""
    if is_folder(spark, path):
        return stream_files(spark, path, schema, max_files=max_files)
    folder, _, name = path.rpartition("/")
    return stream_files(spark, folder, schema, name, max_files)


def run_to_table(stream: DataFrame, path: str, partition_by: str | None = None) -> DataFrame:
    """Process everything available, append it to a Parquet table, and read that back."""
    writer = (stream.writeStream.format("parquet").outputMode("append")
              .option("checkpointLocation", f"{path}/_checkpoint").trigger(availableNow=True))
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.start(f"{path}/rows").awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")


def run_batches(stream: DataFrame, path: str, each: Callable[[DataFrame, int], None]) -> None:
    """Process everything available through ``each(batch, batch_id)``."""
    (stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{path}/_checkpoint")
     .trigger(availableNow=True).start().awaitTermination())


@contextmanager
def session_conf(spark: SparkSession, **settings: str) -> Iterator[None]:
    """Session settings for the time of one query start, put back afterwards."""
    names = {k.replace("__", "."): v for k, v in settings.items()}
    before = {n: spark.conf.get(n, None) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    try:
        yield
    finally:
        for n, v in before.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def with_event_time(stream: DataFrame, column: str, delay: str = WATERMARK) -> DataFrame:
    return stream.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, delay)


def zone_free(c: str) -> Column:
    return F.col(c).cast("timestamp_ntz")


# --- new rows ------------------------------------------------------------------------

def embed_on_insert(stream: DataFrame, text: Column, target: str, encode: Callable[[Column], Column]) -> DataFrame:
    """New rows get their vector; stateless, so it scales with the input alone."""
    return stream.withColumn(target, encode(text))


def index_appends(stream: DataFrame, table_path: str, index: IvfIndex, checkpoint: str) -> None:
    """Append each micro-batch as one version and index it as one delta.

    A batch reserves the version above all that the table has, below ``checkpoint``,
    before it writes; versions that others appended stay as they are and are indexed
    along. A replayed batch finds its reservation: rows already written stay, half-written
    ones are replaced, and the index takes only files it does not cover.
    """
    spark = index.spark

    def noted(name: str) -> int | None:
        if not path_exists(spark, name):
            return None
        row = spark.read.schema("version long").parquet(name).first()  # none if the note itself was cut short
        return None if row is None else row[0]

    def note(name: str, version: int) -> None:
        spark.createDataFrame([(version,)], "version long").coalesce(1).write.mode("overwrite").parquet(name)

    def each(batch: DataFrame, batch_id: int) -> None:
        notes = f"{checkpoint}/versions/{batch_id}"
        version = noted(f"{notes}/reserved")
        again = version is not None
        if not again:
            latest = latest_version(spark, table_path)
            version = max(index.meta().covered_version, -1 if latest is None else latest) + 1
            note(f"{notes}/reserved", version)
        if noted(f"{notes}/written") is None:
            batch.write.mode("overwrite" if again else "error").parquet(f"{table_path}/{VERSION}={version}")
            note(f"{notes}/written", version)
        index.optimize(spark.read.parquet(table_path))

    run_batches(stream, checkpoint, each)


def upsert_batches(stream: DataFrame, path: str, *, key: str, checksum: str, order_by: str, partition_col: str,
                   event_time: str, delay: str = WATERMARK) -> None:
    """Drop batches sent twice by their checksum, then upsert by ``key``, newest row first."""
    once = with_event_time(stream, event_time, delay).dropDuplicatesWithinWatermark([checksum])

    def each(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn(event_time, zone_free(event_time))
        merge_into(batch.sparkSession, f"{path}/rows", rows, key, partition_col, order_by)

    run_batches(once, path, each)


# --- windows ------------------------------------------------------------------------------

def task_rate(events: DataFrame, width: str = "5 minutes", step: str = "30 seconds",
              delay: str = WATERMARK) -> DataFrame:
    """Finished tasks per worker and result in sliding windows."""
    done = with_event_time(events, "created_at", delay).where(F.col("to_status").isin(*FINISHED))
    return done.groupBy(F.window("created_at", width, step), "worker_id", F.col("to_status").alias("result")).agg(
        F.count(F.lit(1)).alias("finished")).select(
        F.col("window.start").cast("timestamp_ntz").alias("window_start"), "worker_id", "result", "finished")


def failure_alerts(events: DataFrame, above: float = 0.5, width: str = "10 minutes", step: str = "30 seconds",
                   delay: str = WATERMARK) -> DataFrame:
    """Windows in which more than ``above`` of a worker's finished tasks failed."""
    done = with_event_time(events, "created_at", delay).where(F.col("to_status").isin(*FINISHED))
    share = ratio(F.count_if(F.col("to_status") == "FAILED"), F.count(F.lit(1)))
    return done.groupBy(F.window("created_at", width, step), "worker_id").agg(share.alias("failure_ratio")).where(
        F.col("failure_ratio") > above).select(
        F.col("window.start").cast("timestamp_ntz").alias("window_start"), "worker_id", "failure_ratio")


def progress_per_minute(events: DataFrame, delay: str = WATERMARK) -> DataFrame:
    """Finished tasks per minute and result."""
    done = with_event_time(events, "created_at", delay).where(F.col("to_status").isin(*FINISHED))
    return done.groupBy(F.window("created_at", "1 minute"), F.col("to_status").alias("result")).agg(
        F.count(F.lit(1)).alias("finished"), F.sum("duration_s").alias("duration_s")).select(
        F.col("window.start").cast("timestamp_ntz").alias("minute"), "result", "finished", "duration_s")


def worker_sessions(events: DataFrame, gap: str = "30 seconds", delay: str = WATERMARK) -> DataFrame:
    """Spans in which a worker was alive; it counts as dead ``gap`` after its last event."""
    timed = with_event_time(events, "created_at", delay) if events.isStreaming else events.withColumn(
        "created_at", F.col("created_at").cast("timestamp"))
    return timed.groupBy(F.session_window("created_at", gap), "worker_id").agg(
        F.count(F.lit(1)).alias("events")).select(
        "worker_id", F.col("session_window.start").cast("timestamp_ntz").alias("alive_from"),
        F.col("session_window.end").cast("timestamp_ntz").alias("dead_at"), "events")


def stall_alerts(events: DataFrame, gap: str = "5 minutes", delay: str = WATERMARK) -> DataFrame:
    """A worker without a pass for ``gap``: the end of a session is the moment of the alert.

    Session state holds two stamps per open session, and sessions are merged on the
    map side first, so a worker with a third of all events is no hot spot.
    """
    return worker_sessions(events, gap, delay).select(
        "worker_id", (F.col("dead_at") - F.expr(f"INTERVAL {gap}")).alias("last_seen"),
        F.col("dead_at").alias("alert_at"))


# --- silence ---------------------------------------------------------------------------------

def _newest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The newest stamp of each worker in each Arrow batch."""
    for batch in batches:
        if batch.num_rows:
            found = pa.Table.from_batches([batch]).group_by("worker_id").aggregate([("last_seen", "max")])
            found = found.select(["worker_id", "last_seen_max"]).rename_columns(["worker_id", "last_seen"])
            yield from found.combine_chunks().to_batches()


def silence_alerts(events: DataFrame, gap_seconds: float) -> DataFrame:
    """A worker that nothing was heard of for ``gap_seconds`` of wall-clock time: ``worker_id``, ``last_seen`` (its newest
    event), ``alert_at`` (zoned).

    The timer runs on processing time, so the alert comes although no further event of anyone arrives: every trigger
    looks at the timers, with or without input. A worker gives one alert per silence and is then forgotten until it is
    heard of again, so state holds two stamps per live worker. Late events count as a sign of life, their stamps don't
    move ``last_seen`` back. To watch all events as one, replace ``worker_id`` by a literal.

    Before the shuffle each Arrow batch is cut down to one row a worker, so a worker with a third of all events costs
    its task a row per batch. A NULL worker is a worker; a NULL stamp is a sign of life without a time. A replayed
    batch has the time that its first run logged, so it sets the same timers.
    """
    if gap_seconds <= 0:
        raise ValueError(f"gap_seconds must be above 0, got {gap_seconds}")
    signs = events.select(F.col("worker_id").cast("string").alias("worker_id"), F.col("created_at").cast("timestamp").alias("last_seen"))
    return signs.mapInArrow(_newest, signs.schema).groupBy("worker_id").transformWithStateInPandas(
        statefulProcessor=SilenceTimer(int(gap_seconds * 1000)), outputStructType=SILENCE, outputMode="append",
        timeMode="ProcessingTime")


def start_silence_alerts(events: DataFrame, path: str, gap_seconds: float, every: str = "1 second"):
    """Start :func:`silence_alerts` into ``path``/rows with the state store it needs; the query runs until it is stopped.

    With ``availableNow`` a query would end before its timers do, hence a steady trigger.
    """
    with session_conf(events.sparkSession, spark__sql__streaming__stateStore__providerClass=ROCKSDB):
        return (silence_alerts(events, gap_seconds).writeStream.format("parquet").outputMode("append")
                .option("checkpointLocation", f"{path}/_checkpoint").trigger(processingTime=every).start(f"{path}/rows"))


def read_silence_alerts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SILENCE).parquet(f"{path}/rows")


def wait_for_silence(running, limit_seconds: float = 600.0) -> None:
    """Return once all input is read and no worker is waited for any more; an error if that takes too long."""
    end = time.monotonic() + limit_seconds
    while time.monotonic() < end:
        if running.exception() is not None:
            raise running.exception()
        last = running.lastProgress
        if last and last["batchId"] > 0 and not last["numInputRows"] and last["stateOperators"] and not sum(
                s["numRowsTotal"] for s in last["stateOperators"]):
            return
        time.sleep(0.2)
    raise TimeoutError(f"workers are still waited for after {limit_seconds} s")


# --- task state ------------------------------------------------------------------------------

def task_trail(events: DataFrame) -> DataFrame:
    """Every event with the state before it and whether that move is allowed.

    Only the four columns used are shuffled, and a micro-batch bounds what one task
    key can bring at a time.
    """
    return events.select("task_uuid", "event_id", "created_at", "to_status").groupBy("task_uuid").transformWithStateInPandas(
        statefulProcessor=TaskTrail(), outputStructType=TRAIL, outputMode="append", timeMode="None")


def run_task_trail(events: DataFrame, path: str) -> DataFrame:
    """Run :func:`task_trail` with the state store it needs."""
    spark = events.sparkSession
    with session_conf(spark, spark__sql__streaming__stateStore__providerClass=ROCKSDB):
        return run_to_table(task_trail(events), path)


def run_sessions(stream: DataFrame, path: str) -> DataFrame:
    """Run a session query with sessions merged before the shuffle."""
    spark = stream.sparkSession
    with session_conf(spark, spark__sql__streaming__sessionWindow__merge__sessions__in__local__partition="true"):
        return run_to_table(stream, path)


def stream_path(spark: SparkSession, name: str) -> str:
    return work_path(spark, f"stream-{name}")
