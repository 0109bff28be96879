"""Catalog reconciliation and string properties."""

from pyspark.sql import functions as F

from tessera.functions.scalars import map_text, ts
from tessera.plans import reconcile as rc
from tessera.queries import query
from tessera.sources.control import CLOCK, control_cte, control_frame

PREFIX = "ops."
ON = "c.catalog = d.catalog AND c.db_schema = d.db_schema AND c.name = d.table_name AND c.tenant_id = d.tenant_id"
MATCHED = f"""
  SELECT c.db_schema AS c_schema, d.db_schema AS d_schema, coalesce(c.db_schema, d.db_schema) AS db_schema, coalesce(c.name, d.table_name) AS name,
    coalesce(c.tenant_id, d.tenant_id) AS tenant_id, d.dataset_uuid, d.storage_uri, d.description, d.status,
    c.storage_location, c.comment, c.comment_present, c.name IS NOT NULL AS in_catalog, d.table_name IS NOT NULL AS in_registry
  FROM catalog_ctl c FULL OUTER JOIN dataset_ctl d ON {ON}"""
ACTION = """CASE WHEN NOT in_registry THEN 'created' WHEN NOT in_catalog THEN 'missing'
  WHEN (coalesce(storage_location, '') <> '' AND storage_location IS DISTINCT FROM storage_uri)
    OR (coalesce(comment, '') <> '' AND comment IS DISTINCT FROM description) THEN 'updated' ELSE 'unchanged' END"""


def frames(spark, sf):
    return control_frame(spark, sf, "catalog_ctl"), control_frame(spark, sf, "dataset_ctl")


@query("catalog_reconcile", control_cte("catalog_ctl", "dataset_ctl", m=MATCHED) + f"""
SELECT db_schema, name, tenant_id, dataset_uuid, {ACTION} AS action FROM m""")
def catalog_reconcile(spark, sf):
    return rc.reconcile(*frames(spark, sf)).select("db_schema", "name", "tenant_id", "dataset_uuid", "action")


@query("catalog_patch", control_cte("catalog_ctl", "dataset_ctl", m=MATCHED) + """
SELECT dataset_uuid, 'storage_uri' AS "column", storage_uri AS old_value, storage_location AS new_value FROM m
WHERE in_catalog AND in_registry AND storage_uri IS DISTINCT FROM storage_location
UNION ALL SELECT dataset_uuid, 'description', description, comment FROM m
WHERE in_catalog AND in_registry AND comment_present AND description IS DISTINCT FROM comment""")
def catalog_patch(spark, sf):
    return rc.catalog_patch(*frames(spark, sf))


@query("catalog_apply", control_cte("catalog_ctl", "dataset_ctl", m=MATCHED) + """
SELECT CASE WHEN in_registry THEN dataset_uuid
    ELSE concat('new-', substr(sha256(concat_ws('/', 'main', db_schema, name, tenant_id)), 1, 16)) END AS dataset_uuid,
  db_schema, name AS table_name, tenant_id,
  CASE WHEN coalesce(storage_location, '') <> '' THEN storage_location ELSE storage_uri END AS storage_uri,
  CASE WHEN coalesce(comment, '') <> '' THEN comment ELSE description END AS description,
  CASE WHEN in_registry THEN status ELSE 'ACTIVE' END AS status FROM m""")
def catalog_apply(spark, sf):
    return rc.catalog_apply(*frames(spark, sf)).drop("catalog")


@query("reconcile_scope", control_cte("catalog_ctl", "dataset_ctl", m=MATCHED) + f"""
SELECT db_schema, {ACTION} AS action, count(*) AS entries FROM m WHERE db_schema = 's2' GROUP BY 1, 2""")
def reconcile_scope(spark, sf):
    catalog, datasets = (rc.in_scope(f, "SCHEMA", catalog="main", schema="s2") for f in frames(spark, sf))
    return rc.reconcile(catalog, datasets).groupBy("db_schema", "action").agg(F.count(F.lit(1)).alias("entries"))


STATS = """
  SELECT dataset_uuid, count(*) AS row_count, count(DISTINCT task_type) AS fragment_count,
    CAST(count(*) FILTER (status = 'SUCCEEDED') / CAST(count(*) AS DOUBLE) AS DECIMAL(5,4)) AS index_coverage,
    CAST(max(attempt) AS BIGINT) AS latest_version FROM task_ctl GROUP BY dataset_uuid"""


def with_stats(spark, sf):
    """Datasets with counts; tasks of a dataset stand in for its rows."""
    stats = control_frame(spark, sf, "task_ctl").groupBy("dataset_uuid").agg(
        F.count(F.lit(1)).alias("row_count"), F.countDistinct("task_type").alias("fragment_count"),
        (F.count_if(F.col("status") == "SUCCEEDED") / F.count(F.lit(1))).cast("decimal(5,4)").alias("index_coverage"),
        F.max("attempt").cast("long").alias("latest_version"))
    return control_frame(spark, sf, "dataset_ctl").join(stats, "dataset_uuid")


@query("stats_writeback", control_cte("dataset_ctl", "task_ctl", stats=STATS) + f"""
SELECT d.dataset_uuid, concat_ws(';', '{PREFIX}dataset_uuid=' || d.dataset_uuid, '{PREFIX}fragment_count=' || fragment_count,
  '{PREFIX}index_coverage=' || index_coverage, '{PREFIX}latest_version=' || latest_version, '{PREFIX}row_count=' || row_count,
  '{PREFIX}status=' || status, '{PREFIX}synced_at=2024-01-31T00:00:00+00:00', '{PREFIX}tenant_id=' || tenant_id) AS properties
FROM dataset_ctl d JOIN stats s ON s.dataset_uuid = d.dataset_uuid""")
def stats_writeback(spark, sf):
    rows = with_stats(spark, sf)
    return rows.select("dataset_uuid", map_text(rc.dataset_properties(PREFIX, ts(CLOCK))).alias("properties"))


@query("index_properties", control_cte("index_ctl") + f"""
SELECT dataset_uuid, string_agg(concat('{PREFIX}index.', index_name, '.column=', column_name, ';{PREFIX}index.', index_name,
  '.last_optimized_at=', coalesce(strftime(last_optimized_at, '%Y-%m-%dT%H:%M:%S+00:00'), ''), ';{PREFIX}index.', index_name,
  '.state=', status), ';' ORDER BY index_name) AS properties FROM index_ctl GROUP BY dataset_uuid""")
def index_properties(spark, sf):
    return rc.index_properties(control_frame(spark, sf, "index_ctl"), PREFIX).select(
        "dataset_uuid", map_text("properties").alias("properties"))


@query("properties_pivot", control_cte("dataset_ctl", "task_ctl", stats=STATS) + """
SELECT d.dataset_uuid, CAST(row_count AS VARCHAR) AS row_count, CAST(index_coverage AS VARCHAR) AS index_coverage, status
FROM dataset_ctl d JOIN stats s ON s.dataset_uuid = d.dataset_uuid""")
def properties_pivot(spark, sf):
    rows = with_stats(spark, sf).select("dataset_uuid", rc.dataset_properties(PREFIX, ts(CLOCK)).alias("properties"))
    return rc.properties_to_columns(rows, "properties", PREFIX, ["row_count", "index_coverage", "status"], "dataset_uuid")
