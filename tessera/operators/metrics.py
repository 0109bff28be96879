"""Operational metrics from event and task rows: counts, ratios, histograms, alerts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.functions.scalars import ratio, seconds_between
from tessera.operators.windows import HOT_ROWS, hour_of, with_previous

# Upper bounds of the latency buckets, in seconds
LATENCY_BUCKETS = (0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0, 120.0, 300.0, 600.0)
FINISHED = ("SUCCEEDED", "FAILED")
HEARTBEAT_TIMEOUT_S = 30
STALL_MINUTES = 5


def task_status_counts(tasks: DataFrame) -> DataFrame:
    """Finished tasks by type and result; a missing type counts as UNKNOWN."""
    return tasks.where(F.col("status").isin(*FINISHED)).groupBy(
        F.coalesce("task_type", F.lit("UNKNOWN")).alias("type"), F.col("status").alias("result"),
    ).agg(F.count(F.lit(1)).alias("finished"))


def success_ratio(tasks: DataFrame, group: str, status: str = "status") -> DataFrame:
    return _share(tasks, group, status, "SUCCEEDED", "success_ratio")


def failure_ratio(tasks: DataFrame, group: str, status: str = "status", above: float | None = None) -> DataFrame:
    shares = _share(tasks, group, status, "FAILED", "failure_ratio")
    return shares if above is None else shares.where(F.col("failure_ratio") > above)


def _share(tasks: DataFrame, group: str, status: str, wanted: str, name: str) -> DataFrame:
    done = tasks.where(F.col(status).isin(*FINISHED))
    return done.groupBy(group).agg(
        ratio(F.count_if(F.col(status) == wanted), F.count(F.lit(1))).alias(name))


# --- histograms ------------------------------------------------------------------------

def bucket_bound(value: Column, bounds: Sequence[float] = LATENCY_BUCKETS) -> Column:
    """Smallest bound at or above the value; infinity beyond the last."""
    out = F.when(value <= bounds[0], F.lit(bounds[0]))
    for b in bounds[1:]:
        out = out.when(value <= b, F.lit(b))
    return out.otherwise(F.lit(float("inf")))


def histogram(df: DataFrame, group: str, value: str, bounds: Sequence[float] = LATENCY_BUCKETS) -> DataFrame:
    """Cumulative ``(group, le, bucket_count)`` with every bound present.

    Rows are counted once per bucket they fall in; the running total then goes
    over at most ``len(bounds) + 1`` rows per group.
    """
    le = [*bounds, float("inf")]
    per_group = df.where(F.col(value).isNotNull()).groupBy(group, bucket_bound(F.col(value), bounds).alias("le")).agg(
        F.count(F.lit(1)).alias("n"))
    counted = per_group.groupBy(group).agg(F.map_from_entries(F.collect_list(F.struct("le", "n"))).alias("by_le"))
    filled = counted.select(group, "by_le", F.explode(F.array(*[F.lit(b) for b in le])).alias("le"))
    running = F.sum(F.coalesce(F.try_element_at("by_le", F.col("le")), F.lit(0))).over(
        Window.partitionBy(group).orderBy("le"))
    return filled.select(group, "le", running.alias("bucket_count"))


def histogram_quantile(hist: DataFrame, group: str, q: float) -> DataFrame:
    """Quantile by linear interpolation inside the bucket that holds the rank.

    The first bucket starts at 0; a rank in the infinite bucket gives the last
    finite bound.
    """
    by_bound = Window.partitionBy(group).orderBy("le")
    rows = hist.select(
        group, "le", "bucket_count",
        F.coalesce(F.lag("le").over(by_bound), F.lit(0.0)).alias("low"),
        F.coalesce(F.lag("bucket_count").over(by_bound), F.lit(0)).alias("below"),
        (F.max("bucket_count").over(Window.partitionBy(group)) * F.lit(q)).alias("rank"),
    )
    inside = rows.where((F.col("bucket_count") >= F.col("rank")) & (F.col("bucket_count") > F.col("below")))
    value = F.when(F.col("le") == float("inf"), F.col("low")).otherwise(
        F.col("low") + (F.col("le") - F.col("low"))
        * (F.col("rank") - F.col("below")) / (F.col("bucket_count") - F.col("below")))
    return inside.groupBy(group).agg(F.min_by(value, "le").alias("quantile"))


# --- workers -----------------------------------------------------------------------------

def worker_load(workers: DataFrame, tasks: DataFrame) -> DataFrame:
    """Running tasks against capacity; free slots never go below 0."""
    running = tasks.where(F.col("status") == "RUNNING").groupBy("worker_id").agg(F.count(F.lit(1)).alias("in_flight"))
    joined = workers.join(running, "worker_id", "left")
    in_flight = F.coalesce("in_flight", F.lit(0))
    return joined.select("worker_id", "capacity", in_flight.alias("in_flight"),
                         F.greatest(F.lit(0), F.col("capacity") - in_flight).alias("free_slots"))


def stale_workers(workers: DataFrame, now: Column, timeout_s: float = HEARTBEAT_TIMEOUT_S) -> DataFrame:
    """Workers not yet DEAD whose heartbeat is older than the timeout."""
    age = seconds_between("last_heartbeat_at", now)
    return workers.where((F.col("status") != "DEAD") & (age > timeout_s))


def stale_leases(workers: DataFrame, tasks: DataFrame, now: Column, timeout_s: float = HEARTBEAT_TIMEOUT_S) -> DataFrame:
    """RUNNING tasks held by stale workers: what a reaper would queue again."""
    held = tasks.where(F.col("status") == "RUNNING").select("task_uuid", "worker_id")
    return stale_workers(workers, now, timeout_s).select("worker_id", "last_heartbeat_at").join(held, "worker_id")


def claim_order(tasks: DataFrame, capacity: int, group: str = "task_type") -> DataFrame:
    """Next tasks per group: lowest priority number first, then oldest, at most ``capacity``.

    The rank filter becomes a group limit before the shuffle, so each task of the
    job sends at most ``capacity`` rows per group.
    """
    order = Window.partitionBy(group).orderBy("priority", "created_at", "task_uuid")
    return tasks.withColumn("claim_rank", F.row_number().over(order)).where(F.col("claim_rank") <= capacity)


# --- the event trail -----------------------------------------------------------------------

def latest_event(events: DataFrame, key: str = "task_uuid") -> DataFrame:
    """Current state per task: the newest event, by an aggregate with a map-side combine."""
    newest = F.max_by(F.struct(*events.columns), F.struct("created_at", "event_id"))
    return events.groupBy(key).agg(newest.alias("_row")).select("_row.*")


def state_durations(events: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Seconds between successive events of a task, with the state it left."""
    rows = with_previous(events, ["task_uuid"], ["created_at", "event_id"], hour_of("created_at"),
                         ["created_at", "to_status"], at_least=hot_rows)
    return rows.where(F.col("previous").isNotNull()).select(
        "task_uuid", "event_id", F.col("previous.to_status").alias("from_status"), "to_status",
        seconds_between("previous.created_at", "created_at").alias("seconds"))


def stalls(events: DataFrame, key: str, minutes: float = STALL_MINUTES, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Gaps longer than ``minutes`` between successive passes of a worker."""
    rows = with_previous(events, [key], ["created_at", "event_id"], hour_of("created_at"), ["created_at"],
                         at_least=hot_rows)
    gap = seconds_between("previous.created_at", "created_at")
    return rows.select(key, F.col("previous.created_at").alias("last_seen"), "created_at",
                       gap.alias("gap_seconds")).where(F.col("gap_seconds") > 60 * minutes)
