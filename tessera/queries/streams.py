"""Streaming jobs over the given tables, run until everything available is processed.

A window or session comes out once the watermark (newest event minus ten
minutes) has passed its end; the SQL leaves the open tail out in the same way.
"""

from pyspark.sql import functions as F

from tessera.operators import embedding as em, ivf
from tessera.queries import given, query
from tessera.queries.embedding import HALF, picked, picked_sql
from tessera.queries.indexes import ASSIGNED, rule_centroids
from tessera.session import work_path
from tessera.sources import tables as tb
from tessera.sources.control import CONTROL_SQL, control_cte
from tessera.streaming import streams as st

DONE = "to_status IN ('SUCCEEDED', 'FAILED')"
CLOSED = "<= (SELECT max(created_at) FROM {frame}) - INTERVAL 10 MINUTE"


def stream_of(spark, sf, table):
    return st.stream_table(spark, f"{sf}/{table}.parquet", given(spark, sf, table).schema)


def event_stream(spark, sf):
    return spark.sql(CONTROL_SQL["task_event_ctl"], events=stream_of(spark, sf, "events"))


def sliding(minutes: int) -> str:
    """SQL giving every window of ``minutes`` (step 30 seconds) that an event falls in."""
    return f"""
  SELECT *, time_bucket(INTERVAL 30 SECOND, created_at) - i * INTERVAL 30 SECOND AS window_start
  FROM (SELECT *, unnest(range({minutes * 2})) AS i FROM task_event_ctl WHERE {DONE})"""


def done_by_watermark(minutes: int) -> str:
    newest = f"(SELECT max(created_at) FROM task_event_ctl WHERE {DONE})"
    return f"window_start + INTERVAL {minutes} MINUTE <= {newest} - INTERVAL 10 MINUTE"


@query("stream_embed_on_insert", f"SELECT doc_id, {picked_sql('text', HALF)} FROM documents")
def stream_embed_on_insert(spark, sf):
    rows = stream_of(spark, sf, "documents").select("doc_id", "text")
    vectors = st.embed_on_insert(rows, F.col("text"), "vec", em.hash_encoder(16)).drop("text")
    return st.run_to_table(vectors, st.stream_path(spark, "embed")).select("doc_id", *picked("vec", **HALF))


@query("stream_index_append", f"""WITH {ASSIGNED}
SELECT CAST(v AS INT) AS row_version, part_id, count(*) AS row_count
FROM assigned, (VALUES (0), (1)) x(v) GROUP BY ALL""")
def stream_index_append(spark, sf):
    """The table holds all embeddings as version 0; all of them arrive again under new ids."""
    table, vectors = work_path(spark, "live"), given(spark, sf, "embeddings")
    tb.write_append(vectors, table, version=0)
    index = ivf.IvfIndex.build(spark.read.parquet(table), work_path(spark, "live-ivf"), key="vec_id",
                               column="embedding", index_name="idx_live", centroids=rule_centroids(spark, sf))
    arriving = stream_of(spark, sf, "embeddings").withColumn("vec_id", F.col("vec_id") + 1_000_000_000)
    st.index_appends(arriving, table, index, st.stream_path(spark, "append"))
    return index.postings().groupBy(F.col("row_version").cast("int").alias("row_version"), "part_id").agg(
        F.count(F.lit(1)).alias("row_count"))


@query("stream_write_batches", """
SELECT user_id, arg_max(event_id, ts) AS event_id, arg_max(value, ts) AS value, CAST(user_id % 4 AS BIGINT) AS bucket
FROM events GROUP BY user_id""")
def stream_write_batches(spark, sf):
    """Every event is sent twice; the checksum drops the copy, the upsert keeps the newest per user."""
    columns = ["event_id", "ts", "user_id", "value"]
    sent = stream_of(spark, sf, "events").select(*columns)
    again = stream_of(spark, sf, "events").select(*columns)
    rows = sent.unionByName(again).withColumn("batch_checksum", F.sha2(F.concat_ws("|", *columns), 256)).withColumn(
        "bucket", F.col("user_id") % 4)
    path = st.stream_path(spark, "writes")
    st.upsert_batches(rows, path, key="user_id", checksum="batch_checksum", order_by="ts", partition_col="bucket",
                      event_time="ts")
    return spark.read.parquet(f"{path}/rows").select("user_id", "event_id", "value", F.col("bucket").cast("long").alias("bucket"))


@query("stream_task_rate", control_cte("task_event_ctl", w=sliding(5)) + f"""
SELECT window_start, worker_id, to_status AS result, count(*) AS finished FROM w
WHERE {done_by_watermark(5)} GROUP BY ALL""")
def stream_task_rate(spark, sf):
    return st.run_to_table(st.task_rate(event_stream(spark, sf)), st.stream_path(spark, "rate"))


@query("stream_failure_alert", control_cte("task_event_ctl", w=sliding(10), r=f"""
  SELECT window_start, worker_id, count(*) FILTER (to_status = 'FAILED') / greatest(count(*)::DOUBLE, 0.001) AS failure_ratio
  FROM w WHERE {done_by_watermark(10)} GROUP BY ALL""") + """
SELECT window_start, worker_id, round(failure_ratio, 6) AS failure_ratio FROM r WHERE failure_ratio > 0.5""")
def stream_failure_alert(spark, sf):
    alerts = st.run_to_table(st.failure_alerts(event_stream(spark, sf)), st.stream_path(spark, "alerts"))
    return alerts.withColumn("failure_ratio", F.round("failure_ratio", 6))


@query("stream_tumbling_progress", control_cte("task_event_ctl") + f"""
SELECT date_trunc('minute', created_at) AS minute, to_status AS result, count(*) AS finished,
  round(sum(duration_s), 4) AS duration_s FROM task_event_ctl WHERE {DONE}
  AND date_trunc('minute', created_at) + INTERVAL 1 MINUTE
    <= (SELECT max(created_at) FROM task_event_ctl WHERE {DONE}) - INTERVAL 10 MINUTE GROUP BY 1, 2""")
def stream_tumbling_progress(spark, sf):
    rows = st.run_to_table(st.progress_per_minute(event_stream(spark, sf)), st.stream_path(spark, "progress"))
    return rows.withColumn("duration_s", F.round("duration_s", 4))


def sessions_sql(gap: str) -> dict[str, str]:
    return {
        "marked": f"""SELECT worker_id, created_at, CASE WHEN created_at >= lag(created_at) OVER o + INTERVAL {gap} THEN 1 ELSE 0 END AS fresh
  FROM task_event_ctl WINDOW o AS (PARTITION BY worker_id ORDER BY created_at, event_id)""",
        "numbered": """SELECT *, sum(fresh) OVER (PARTITION BY worker_id ORDER BY created_at ROWS UNBOUNDED PRECEDING) AS n
  FROM marked""",
        "sessions": f"""SELECT worker_id, min(created_at) AS alive_from, max(created_at) + INTERVAL {gap} AS dead_at, count(*) AS events
  FROM numbered GROUP BY worker_id, n""",
    }


@query("stream_worker_sessions", control_cte("task_event_ctl", **sessions_sql("30 SECOND")) + f"""
SELECT * FROM sessions WHERE dead_at {CLOSED.format(frame="task_event_ctl")}""")
def stream_worker_sessions(spark, sf):
    return st.run_sessions(st.worker_sessions(event_stream(spark, sf)), st.stream_path(spark, "sessions"))


@query("stream_stall_alert", control_cte("task_event_ctl", **sessions_sql("5 MINUTE")) + f"""
SELECT worker_id, dead_at - INTERVAL 5 MINUTE AS last_seen, dead_at AS alert_at FROM sessions
WHERE dead_at {CLOSED.format(frame="task_event_ctl")}""")
def stream_stall_alert(spark, sf):
    return st.run_sessions(st.stall_alerts(event_stream(spark, sf)), st.stream_path(spark, "stalls"))


@query("stream_silence_alert", control_cte("task_event_ctl") + """
SELECT worker_id, max(created_at) AS last_seen FROM task_event_ctl GROUP BY worker_id""")
def stream_silence_alert(spark, sf):
    """After the table no event follows, so every worker's timer runs out; the last alert of each has its newest event."""
    path = st.stream_path(spark, "silence")
    running = st.start_silence_alerts(event_stream(spark, sf), path, gap_seconds=3)
    try:
        st.wait_for_silence(running)
    finally:
        running.stop()
    return st.read_silence_alerts(spark, path).groupBy("worker_id").agg(
        F.max("last_seen").cast("timestamp_ntz").alias("last_seen"))


@query("stream_task_state", control_cte("task_event_ctl", w="""
  SELECT *, lag(to_status) OVER (PARTITION BY task_uuid ORDER BY created_at, event_id) AS from_status FROM task_event_ctl""") + """
SELECT task_uuid, event_id, from_status, to_status,
  from_status IS NULL OR (from_status = 'PENDING' AND to_status IN ('QUEUED', 'RUNNING', 'CANCELLED'))
  OR (from_status = 'QUEUED' AND to_status IN ('RUNNING', 'CANCELLED'))
  OR (from_status = 'RUNNING' AND to_status IN ('SUCCEEDED', 'FAILED', 'CANCELLED', 'PENDING'))
  OR (from_status = 'FAILED' AND to_status = 'PENDING') AS legal FROM w""")
def stream_task_state(spark, sf):
    return st.run_task_trail(event_stream(spark, sf), st.stream_path(spark, "trail"))
