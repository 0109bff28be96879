"""Control frames derived from the given tables by SQL.

Each text runs unchanged in Spark and, as a CTE, in any ANSI SQL engine; table
names stand in braces so that Spark can bind DataFrames to them.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import TimestampType

CLOCK = "2024-01-31 00:00:00"

CONTROL_SQL = {
    "dataset_ctl": """
SELECT concat('ds-', c_custkey) AS dataset_uuid, 'main' AS catalog, concat('s', c_nationkey % 5) AS db_schema,
  c_name AS table_name, concat('s3://b/', c_custkey) AS storage_uri, concat('t', c_custkey % 4) AS tenant_id,
  c_mktsegment AS description,
  CASE WHEN c_custkey % 10 = 0 THEN 'DELETED' WHEN c_custkey % 10 = 1 THEN 'ARCHIVED' ELSE 'ACTIVE' END AS status
FROM {customer}""",
    "task_ctl": """
SELECT concat('task-', o_orderkey) AS task_uuid, concat('ds-', o_custkey) AS dataset_uuid, concat('t', o_custkey % 4) AS tenant_id,
  CASE o_orderkey % 5 WHEN 0 THEN 'TTL_DELETE' WHEN 1 THEN 'COMPACTION' WHEN 2 THEN 'INDEX_BUILD' WHEN 3 THEN 'INDEX_OPTIMIZE' ELSE 'VECTORIZE' END AS task_type,
  CASE WHEN o_orderstatus = 'O' THEN 'PENDING' WHEN o_orderstatus = 'P' THEN 'RUNNING' WHEN o_orderkey % 7 = 0 THEN 'FAILED' ELSE 'SUCCEEDED' END AS status,
  CAST(substring(o_orderpriority, 1, 1) AS INT) AS priority, CAST(o_orderkey % 4 AS INT) AS attempt, 3 AS max_attempts,
  concat('w', o_custkey % 20) AS worker_id,
  o_orderdate AS created_at, o_totalprice / 1000.0 AS duration_s
FROM {orders}""",
    "index_ctl": """
SELECT s_suppkey AS index_id, concat('ds-', s_suppkey) AS dataset_uuid, concat('idx_', s_suppkey) AS index_name, 'embedding' AS column_name,
  CASE s_suppkey % 6 WHEN 5 THEN 'BUILDING' WHEN 4 THEN 'OPTIMIZING' ELSE 'READY' END AS status,
  CAST(s_suppkey % 7 AS BIGINT) AS latest_version, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE CAST(s_suppkey % 5 AS BIGINT) END AS last_seen_version,
  CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE CAST(floor(abs(s_acctbal)) AS BIGINT) END AS unindexed_rows,
  CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE timestamp '2024-01-31 00:00:00' - s_suppkey * INTERVAL '1' MINUTE END AS last_optimized_at,
  CAST(s_suppkey % 15 AS INT) AS delta_count
FROM {supplier}""",
    "policy_ctl": """
SELECT p_partkey AS policy_id, concat('ds-', p_partkey % 120) AS dataset_uuid, concat('p-', p_partkey) AS policy_name,
  p_partkey % 6 <> 0 AS enabled, p_partkey % 2 = 0 AS index_watch_enabled,
  CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_size + 1 END AS ttl_days,
  CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE 100 END AS min_small_fragments,
  CASE WHEN p_partkey % 5 = 0 THEN '0 2 * * *' END AS index_optimize_cron,
  CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE 1000 END AS min_unindexed_rows,
  CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE 3 END AS min_version_drift,
  CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE 30 END AS stale_minutes
FROM {part}""",
    "rule_ctl": """
SELECT p_partkey AS rule_id, concat('ds-', p_partkey % 150) AS dataset_uuid, concat('vec_', p_size % 7) AS target_column,
  CASE WHEN p_size % 9 = 0 THEN ' ' ELSE p_name END AS source_column, p_brand AS model_name,
  CASE p_size % 3 WHEN 0 THEN 'SCHEDULED' WHEN 1 THEN 'ON_INSERT' ELSE 'MANUAL' END AS trigger_type,
  CASE WHEN p_partkey % 5 = 0 THEN '0 2 * * *' END AS cron_expr, p_partkey % 4 <> 0 AS enabled,
  CASE p_partkey % 6 WHEN 0 THEN NULL
    WHEN 1 THEN '{{"index_config":{{"auto_build":false}}}}'
    WHEN 2 THEN '{{"index_config":{{"auto_build":true,"index_name":"idx_custom","index_type":"IVF_FLAT"}}}}'
    ELSE '{{"index_config":{{"auto_build":true}}}}' END AS extra
FROM {part}""",
    "catalog_ctl": """
SELECT 'main' AS catalog, concat('s', c_nationkey % 5) AS db_schema, c_name AS name, concat('t', c_custkey % 4) AS tenant_id,
  CASE WHEN c_custkey % 8 = 0 THEN concat('s3://moved/', c_custkey) WHEN c_custkey % 17 = 0 THEN '' ELSE concat('s3://b/', c_custkey) END AS storage_location,
  CASE WHEN c_custkey % 9 = 0 THEN NULL WHEN c_custkey % 12 = 5 THEN 'fresh' ELSE c_mktsegment END AS comment,
  c_custkey % 7 <> 0 AS comment_present
FROM {customer} WHERE c_acctbal >= 0
UNION ALL SELECT 'main', 's0', s_name, 't0', concat('s3://new/', s_suppkey), s_name, true FROM {supplier}""",
    "task_event_ctl": """
SELECT event_id, concat('task-', user_id) AS task_uuid, concat('w', user_id % 20) AS worker_id, ts AS created_at,
  CASE event_type WHEN 'signup' THEN 'PENDING' WHEN 'view' THEN 'QUEUED' WHEN 'click' THEN 'RUNNING' WHEN 'purchase' THEN 'SUCCEEDED' ELSE 'FAILED' END AS to_status,
  value AS duration_s, concat('c', event_id % 900) AS batch_checksum
FROM {events}""",
    "worker_ctl": """
SELECT concat('w', user_id % 20) AS worker_id, max(ts) AS last_heartbeat_at,
  CAST(max(user_id) % 3 * 400 AS INT) AS capacity,
  CASE WHEN max(user_id) % 7 = 0 THEN 'DEAD' WHEN max(user_id) % 7 = 1 THEN 'DRAINING' ELSE 'ALIVE' END AS status
FROM {events} GROUP BY user_id % 20""",
}


def source_tables(name: str) -> list[str]:
    """Given tables that a control frame reads."""
    return sorted(set(re.findall(r"(?<!{){(\w+)}(?!})", CONTROL_SQL[name])))


def control_frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in source_tables(name)}
    frame = spark.sql(CONTROL_SQL[name], **tables)
    zoned = [f.name for f in frame.schema if isinstance(f.dataType, TimestampType)]
    return frame.withColumns({c: F.col(c).cast("timestamp_ntz") for c in zoned})


def control_cte(*names: str, **more: str) -> str:
    """``WITH`` clause defining the named frames over plain table names, then ``more``."""
    parts = []
    for name in names:
        tables = {t: t for t in source_tables(name)}
        parts.append(f"{name} AS ({CONTROL_SQL[name].format(**tables)})")
    parts += [f"{name} AS ({text})" for name, text in more.items()]
    return "WITH " + ",\n".join(parts) + "\n"
