"""Summaries, histograms, ratios and event-trail windows."""

from pyspark.sql import functions as F

from tessera.functions.scalars import ts
from tessera.operators import joins as jn, metrics as mt
from tessera.plans import lifecycle as lc, reconcile as rc
from tessera.queries import given, query
from tessera.sources.control import CLOCK, control_cte, control_frame

BOUNDS = ", ".join(f"({b})" for b in mt.LATENCY_BUCKETS) + ", ('inf'::DOUBLE)"
HIST = f"""SELECT task_type, le, count(*) FILTER (duration_s <= le) AS bucket_count
  FROM task_ctl, (VALUES {BOUNDS}) b(le) GROUP BY task_type, le"""


@query("planner_tick_summary", control_cte("policy_ctl", "dataset_ctl", "task_ctl", live="""
  SELECT p.*, d.tenant_id FROM policy_ctl p JOIN dataset_ctl d ON p.dataset_uuid = d.dataset_uuid WHERE enabled""",
    candidates="""
  SELECT concat(tenant_id, ':lifecycle:', policy_id, ':TTL_DELETE:20240131') AS k FROM live WHERE ttl_days IS NOT NULL
  UNION ALL SELECT concat(tenant_id, ':lifecycle:', policy_id, ':COMPACTION:20240131') FROM live WHERE min_small_fragments IS NOT NULL
  UNION ALL SELECT concat(tenant_id, ':lifecycle:', policy_id, ':INDEX_OPTIMIZE:2024013100') FROM live WHERE index_optimize_cron IS NOT NULL""",
    existing="""
  SELECT concat(tenant_id, ':lifecycle:', o.o_orderkey, ':COMPACTION:20240131') AS k
  FROM orders o JOIN live ON live.policy_id = o.o_orderkey WHERE o.o_orderstatus = 'F'""") + """
SELECT (SELECT count(*) FROM policy_ctl WHERE enabled) AS scanned_policies,
  (SELECT count(*) FROM candidates WHERE k NOT IN (SELECT k FROM existing)) AS emitted_tasks,
  (SELECT count(*) FROM candidates WHERE k IN (SELECT k FROM existing)) AS skipped_duplicates""")
def planner_tick_summary(spark, sf):
    policies, datasets = control_frame(spark, sf, "policy_ctl"), control_frame(spark, sf, "dataset_ctl")
    live = jn.with_dataset(policies.where("enabled"), datasets)
    done = given(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("policy_id"))
    existing = live.join(done, "policy_id").select(F.concat(
        "dataset_tenant", F.lit(":lifecycle:"), "policy_id", F.lit(":COMPACTION:20240131")).alias("idempotency_key"))
    return lc.plan_summary(policies, lc.policy_tasks(policies, datasets, ts(CLOCK)), existing)


DECIDED = control_cte("index_ctl", "dataset_ctl", "policy_ctl", first_policy="""
  SELECT dataset_uuid, min(policy_id) AS policy_id FROM policy_ctl
  WHERE enabled AND index_watch_enabled GROUP BY dataset_uuid""", decided=f"""
  SELECT i.*, d.tenant_id, greatest(0, latest_version - coalesce(last_seen_version, 0)) AS version_drift,
    CASE WHEN last_optimized_at IS NULL THEN 0.0
      ELSE epoch(timestamp '{CLOCK}' - last_optimized_at) / 60.0 END AS stale_for_minutes,
    CASE WHEN unindexed_rows >= p.min_unindexed_rows THEN 'unindexed_rows'
      WHEN greatest(0, latest_version - coalesce(last_seen_version, 0)) >= p.min_version_drift THEN 'version_drift'
      WHEN last_optimized_at IS NOT NULL AND epoch(timestamp '{CLOCK}' - last_optimized_at) / 60.0 >= p.stale_minutes THEN 'stale'
    END AS reason
  FROM index_ctl i JOIN dataset_ctl d ON d.dataset_uuid = i.dataset_uuid
  JOIN first_policy f ON f.dataset_uuid = i.dataset_uuid JOIN policy_ctl p ON p.policy_id = f.policy_id
  WHERE i.status = 'READY'""")

SEEN_KEYS = """SELECT concat('watcher:', p_partkey, ':INDEX_OPTIMIZE:v', p_partkey % 7, ':unindexed_rows') AS idempotency_key
  FROM part WHERE p_type = 'ECONOMY'"""


def decided(spark, sf):
    frames = (control_frame(spark, sf, n) for n in ("index_ctl", "dataset_ctl", "policy_ctl"))
    return lc.watch_decision(jn.watch_candidates(*frames), ts(CLOCK))


def seen_keys(spark, sf):
    return given(spark, sf, "part").where("p_type = 'ECONOMY'").select(F.concat(
        F.lit("watcher:"), "p_partkey", F.lit(":INDEX_OPTIMIZE:v"), F.col("p_partkey") % 7,
        F.lit(":unindexed_rows")).alias("idempotency_key"))


@query("watch_pass_summary", DECIDED + f"""
SELECT CASE WHEN latest_version IS NULL THEN 'skipped_no_stats' WHEN reason IS NULL THEN 'skipped_below_threshold'
  WHEN concat('watcher:', index_id, ':INDEX_OPTIMIZE:v', latest_version, ':', reason) IN ({SEEN_KEYS}) THEN 'skipped_idempotent'
  ELSE 'enqueued' END AS outcome, count(*) AS indexes FROM decided GROUP BY 1""")
def watch_pass_summary(spark, sf):
    return lc.watch_summary(decided(spark, sf), seen_keys(spark, sf))


@query("sync_summary", control_cte("catalog_ctl", "dataset_ctl", m="""
  SELECT coalesce(c.db_schema, d.db_schema) AS db_schema, c.name IS NOT NULL AS in_catalog,
    CASE WHEN d.table_name IS NULL THEN 'created' WHEN c.name IS NULL THEN 'missing'
      WHEN (coalesce(c.storage_location, '') <> '' AND c.storage_location IS DISTINCT FROM d.storage_uri)
        OR (coalesce(c.comment, '') <> '' AND c.comment IS DISTINCT FROM d.description) THEN 'updated'
      ELSE 'unchanged' END AS action
  FROM catalog_ctl c FULL OUTER JOIN dataset_ctl d
    ON c.catalog = d.catalog AND c.db_schema = d.db_schema AND c.name = d.table_name AND c.tenant_id = d.tenant_id""") + """
SELECT db_schema, count(*) FILTER (in_catalog) AS filesets_discovered,
  count(*) FILTER (action = 'created') AS datasets_created, count(*) FILTER (action = 'updated') AS datasets_updated,
  count(*) FILTER (action = 'unchanged') AS datasets_unchanged, count(*) FILTER (action = 'missing') AS datasets_missing
FROM m GROUP BY ROLLUP (db_schema)""")
def sync_summary(spark, sf):
    return rc.sync_summary(rc.reconcile(control_frame(spark, sf, "catalog_ctl"), control_frame(spark, sf, "dataset_ctl")))


@query("task_status_counts", control_cte("task_ctl", t="""
  SELECT CASE WHEN priority = 5 THEN NULL ELSE task_type END AS task_type, status FROM task_ctl""") + """
SELECT coalesce(task_type, 'UNKNOWN') AS type, status AS result, count(*) AS finished
FROM t WHERE status IN ('SUCCEEDED', 'FAILED') GROUP BY 1, 2""")
def task_status_counts(spark, sf):
    tasks = control_frame(spark, sf, "task_ctl").withColumn(
        "task_type", F.when(F.col("priority") != 5, F.col("task_type")))
    return mt.task_status_counts(tasks)


@query("histogram_buckets", control_cte("task_ctl") + HIST)
def histogram_buckets(spark, sf):
    return mt.histogram(control_frame(spark, sf, "task_ctl"), "task_type", "duration_s")


@query("histogram_quantile", control_cte("task_ctl", hist=HIST, r="""
  SELECT *, coalesce(lag(le) OVER w, 0) AS low, coalesce(lag(bucket_count) OVER w, 0) AS below,
    max(bucket_count) OVER (PARTITION BY task_type) * 0.95::DOUBLE AS rank
  FROM hist WINDOW w AS (PARTITION BY task_type ORDER BY le)""") + """
SELECT task_type, round(arg_min(CASE WHEN le = 'inf'::DOUBLE THEN low
  ELSE low + (le - low) * (rank - below) / (bucket_count - below) END, le), 6) AS p95
FROM r WHERE bucket_count >= rank AND bucket_count > below GROUP BY task_type""")
def histogram_quantile(spark, sf):
    hist = mt.histogram(control_frame(spark, sf, "task_ctl"), "task_type", "duration_s")
    return mt.histogram_quantile(hist, "task_type", 0.95).select("task_type", F.round("quantile", 6).alias("p95"))


DONE = "status IN ('SUCCEEDED', 'FAILED')"


@query("success_ratio", control_cte("task_ctl") + f"""
SELECT task_type, round(count(*) FILTER (status = 'SUCCEEDED') / greatest(count(*)::DOUBLE, 0.001), 6) AS success_ratio
FROM task_ctl WHERE {DONE} GROUP BY task_type""")
def success_ratio(spark, sf):
    return mt.success_ratio(control_frame(spark, sf, "task_ctl"), "task_type").withColumn(
        "success_ratio", F.round("success_ratio", 6))


@query("failure_ratio", control_cte("task_event_ctl", f="""
  SELECT task_uuid, count(*) FILTER (to_status = 'FAILED') / greatest(count(*)::DOUBLE, 0.001) AS failure_ratio
  FROM task_event_ctl WHERE to_status IN ('SUCCEEDED', 'FAILED') GROUP BY task_uuid""") + """
SELECT task_uuid, round(failure_ratio, 6) AS failure_ratio FROM f WHERE failure_ratio > 0.5""")
def failure_ratio(spark, sf):
    events = control_frame(spark, sf, "task_event_ctl")
    return mt.failure_ratio(events, "task_uuid", "to_status", above=0.5).withColumn(
        "failure_ratio", F.round("failure_ratio", 6))


@query("worker_load", control_cte("worker_ctl", "task_ctl", load="""
  SELECT worker_id, count(*) AS in_flight FROM task_ctl WHERE status = 'RUNNING' GROUP BY worker_id""") + """
SELECT w.worker_id, capacity, coalesce(in_flight, 0) AS in_flight,
  greatest(0, capacity - coalesce(in_flight, 0)) AS free_slots
FROM worker_ctl w LEFT JOIN load l ON l.worker_id = w.worker_id""")
def worker_load(spark, sf):
    return mt.worker_load(control_frame(spark, sf, "worker_ctl"), control_frame(spark, sf, "task_ctl"))


@query("stale_leases", control_cte("worker_ctl", "task_ctl", clock="SELECT max(ts) AS now FROM events") + """
SELECT w.worker_id, w.last_heartbeat_at, t.task_uuid
FROM worker_ctl w JOIN task_ctl t ON t.worker_id = w.worker_id AND t.status = 'RUNNING', clock
WHERE w.status <> 'DEAD' AND w.last_heartbeat_at < now - INTERVAL 30 SECOND""")
def stale_leases(spark, sf):
    now = given(spark, sf, "events").agg(F.max("ts")).first()[0]
    return mt.stale_leases(control_frame(spark, sf, "worker_ctl"), control_frame(spark, sf, "task_ctl"),
                           F.lit(now).cast("timestamp_ntz"))


@query("latest_event_per_task", control_cte("task_event_ctl") + """
SELECT task_uuid, event_id, to_status FROM (
  SELECT *, row_number() OVER (PARTITION BY task_uuid ORDER BY created_at DESC, event_id DESC) AS rn FROM task_event_ctl)
WHERE rn = 1""")
def latest_event_per_task(spark, sf):
    return mt.latest_event(control_frame(spark, sf, "task_event_ctl")).select("task_uuid", "event_id", "to_status")


@query("task_state_durations", control_cte("task_event_ctl", w="""
  SELECT *, lag(to_status) OVER o AS from_status, lag(created_at) OVER o AS before FROM task_event_ctl
  WINDOW o AS (PARTITION BY task_uuid ORDER BY created_at, event_id)""") + """
SELECT task_uuid, event_id, from_status, to_status, round(epoch_us(created_at - before) / 1000000.0, 6) AS seconds
FROM w WHERE before IS NOT NULL""")
def task_state_durations(spark, sf):
    return mt.state_durations(control_frame(spark, sf, "task_event_ctl")).withColumn("seconds", F.round("seconds", 6))


@query("worker_stalls", control_cte("task_event_ctl", w="""
  SELECT *, lag(created_at) OVER (PARTITION BY worker_id ORDER BY created_at, event_id) AS last_seen
  FROM task_event_ctl""") + """
SELECT worker_id, last_seen, created_at, round(epoch_us(created_at - last_seen) / 1000000.0, 6) AS gap_seconds
FROM w WHERE epoch_us(created_at - last_seen) > 300000000""")
def worker_stalls(spark, sf):
    return mt.stalls(control_frame(spark, sf, "task_event_ctl"), "worker_id").withColumn(
        "gap_seconds", F.round("gap_seconds", 6))
