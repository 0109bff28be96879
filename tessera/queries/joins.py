"""Joins over control frames."""

from pyspark.sql import functions as F

from tessera.operators import joins as jn
from tessera.plans import reconcile as rc
from tessera.queries import given, query
from tessera.sources.control import control_cte, control_frame


@query("watch_candidates", control_cte("index_ctl", "dataset_ctl", "policy_ctl", first_policy="""
  SELECT dataset_uuid, min(policy_id) AS policy_id FROM policy_ctl
  WHERE enabled AND index_watch_enabled GROUP BY dataset_uuid""") + """
SELECT i.index_id, i.dataset_uuid, d.tenant_id, p.policy_id
FROM index_ctl i JOIN dataset_ctl d ON d.dataset_uuid = i.dataset_uuid
JOIN first_policy p ON p.dataset_uuid = i.dataset_uuid WHERE i.status = 'READY'""")
def watch_candidates(spark, sf):
    frames = (control_frame(spark, sf, n) for n in ("index_ctl", "dataset_ctl", "policy_ctl"))
    return jn.watch_candidates(*frames).select("index_id", "dataset_uuid", "tenant_id", "policy_id")


@query("policy_dataset_join", control_cte("policy_ctl", "dataset_ctl") + """
SELECT p.policy_id, p.dataset_uuid, d.tenant_id AS dataset_tenant
FROM policy_ctl p JOIN dataset_ctl d ON p.dataset_uuid = d.dataset_uuid""")
def policy_dataset_join(spark, sf):
    joined = jn.with_dataset(control_frame(spark, sf, "policy_ctl"), control_frame(spark, sf, "dataset_ctl"))
    return joined.select("policy_id", "dataset_uuid", "dataset_tenant")


@query("orphan_rows", control_cte("task_ctl", "dataset_ctl") + """
SELECT task_uuid, dataset_uuid FROM task_ctl
WHERE dataset_uuid NOT IN (SELECT dataset_uuid FROM dataset_ctl WHERE status <> 'DELETED')""")
def orphan_rows(spark, sf):
    parents = control_frame(spark, sf, "dataset_ctl").where("status <> 'DELETED'")
    return jn.orphans(control_frame(spark, sf, "task_ctl"), parents).select("task_uuid", "dataset_uuid")


@query("catalog_match", control_cte("catalog_ctl", "dataset_ctl") + """
SELECT coalesce(c.db_schema, d.db_schema) AS db_schema, coalesce(c.name, d.table_name) AS name, d.dataset_uuid,
  c.name IS NOT NULL AS in_catalog, d.table_name IS NOT NULL AS in_registry
FROM catalog_ctl c FULL OUTER JOIN dataset_ctl d
  ON c.catalog = d.catalog AND c.db_schema = d.db_schema AND c.name = d.table_name AND c.tenant_id = d.tenant_id""")
def catalog_match(spark, sf):
    matched = rc.catalog_match(control_frame(spark, sf, "catalog_ctl"), control_frame(spark, sf, "dataset_ctl"))
    return matched.select("db_schema", "name", "dataset_uuid", "in_catalog", "in_registry")


@query("unknown_filesets", control_cte("catalog_ctl", "dataset_ctl") + """
SELECT c.db_schema, c.name, c.storage_location FROM catalog_ctl c ANTI JOIN dataset_ctl d
  ON c.catalog = d.catalog AND c.db_schema = d.db_schema AND c.name = d.table_name AND c.tenant_id = d.tenant_id""")
def unknown_filesets(spark, sf):
    found = rc.unknown_entries(control_frame(spark, sf, "catalog_ctl"), control_frame(spark, sf, "dataset_ctl"))
    return found.select("db_schema", "name", "storage_location")


@query("missing_in_catalog", control_cte("catalog_ctl", "dataset_ctl") + """
SELECT d.dataset_uuid, d.table_name AS name FROM dataset_ctl d ANTI JOIN catalog_ctl c
  ON c.catalog = d.catalog AND c.db_schema = d.db_schema AND c.name = d.table_name AND c.tenant_id = d.tenant_id""")
def missing_in_catalog(spark, sf):
    gone = rc.missing_entries(control_frame(spark, sf, "catalog_ctl"), control_frame(spark, sf, "dataset_ctl"))
    return gone.select("dataset_uuid", "name")


@query("idempotency_anti_join", """
WITH candidates AS (SELECT concat('ds-', o_custkey, ':', o_orderstatus) AS idempotency_key FROM orders),
existing AS (SELECT concat('ds-', c_custkey, ':F') AS idempotency_key FROM customer WHERE c_acctbal > 0)
SELECT DISTINCT idempotency_key FROM candidates
WHERE idempotency_key NOT IN (SELECT idempotency_key FROM existing)""")
def idempotency_anti_join(spark, sf):
    candidates = given(spark, sf, "orders").select(
        F.concat(F.lit("ds-"), "o_custkey", F.lit(":"), "o_orderstatus").alias("idempotency_key"))
    existing = given(spark, sf, "customer").where("c_acctbal > 0").select(
        F.concat(F.lit("ds-"), "c_custkey", F.lit(":F")).alias("idempotency_key"))
    return jn.new_keys(candidates, existing)


@query("first_policy_per_dataset", control_cte("policy_ctl") + """
SELECT dataset_uuid, policy_id, policy_name FROM (
  SELECT *, row_number() OVER (PARTITION BY dataset_uuid ORDER BY policy_id) AS rn FROM policy_ctl WHERE enabled)
WHERE rn = 1""")
def first_policy_per_dataset(spark, sf):
    return jn.first_policy(control_frame(spark, sf, "policy_ctl").where("enabled")).select(
        "dataset_uuid", "policy_id", "policy_name")
