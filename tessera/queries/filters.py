"""Row filters, tenants, states and paging over control frames."""

from pyspark.sql import functions as F

from tessera.operators import filters as fl, joins as jn, metrics as mt
from tessera.queries import given, query
from tessera.sources.control import control_cte, control_frame
from tessera.operators.embedding import null_target


@query("null_target_filter", """
WITH t AS (SELECT d.doc_id, d.lang, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
SELECT doc_id, lang FROM t WHERE quality IS NULL""")
def null_target_filter(spark, sf):
    docs = given(spark, sf, "documents").select("doc_id", "lang")
    joined = docs.join(given(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    return null_target(joined, "quality").select("doc_id", "lang")


@query("tenant_filter", control_cte("dataset_ctl", "task_ctl") + """
SELECT t.task_uuid, t.dataset_uuid, d.db_schema, t.status
FROM task_ctl t JOIN dataset_ctl d ON t.dataset_uuid = d.dataset_uuid
WHERE t.tenant_id = 't1' AND d.tenant_id = 't1'""")
def tenant_filter(spark, sf):
    tasks = control_frame(spark, sf, "task_ctl").select("task_uuid", "dataset_uuid", "status", "tenant_id")
    datasets = control_frame(spark, sf, "dataset_ctl").select("dataset_uuid", "db_schema", "tenant_id")
    return fl.TenantScope("t1").join(tasks, datasets, "dataset_uuid").select(
        "task_uuid", "dataset_uuid", "db_schema", "status")


@query("tenant_fail_closed", control_cte("dataset_ctl") + "SELECT dataset_uuid FROM dataset_ctl WHERE false")
def tenant_fail_closed(spark, sf):
    return fl.TenantScope(None, strict=False).table(control_frame(spark, sf, "dataset_ctl")).select("dataset_uuid")


@query("tenant_system_bypass", control_cte("dataset_ctl") + """
SELECT tenant_id, count(*) AS datasets FROM dataset_ctl GROUP BY tenant_id""")
def tenant_system_bypass(spark, sf):
    everything = fl.TenantScope(all_tenants=True).table(control_frame(spark, sf, "dataset_ctl"))
    return everything.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("datasets"))


@query("tenant_child_scope", control_cte("dataset_ctl", "index_ctl") + """
SELECT index_id, index_name, status FROM index_ctl
WHERE dataset_uuid IN (SELECT dataset_uuid FROM dataset_ctl WHERE tenant_id = 't2')""")
def tenant_child_scope(spark, sf):
    scope = fl.TenantScope("t2")
    return scope.child(control_frame(spark, sf, "index_ctl"), control_frame(spark, sf, "dataset_ctl")).select(
        "index_id", "index_name", "status")


@query("live_datasets", control_cte("dataset_ctl") + """
SELECT dataset_uuid, status FROM dataset_ctl WHERE status <> 'DELETED'""")
def live_datasets(spark, sf):
    return fl.live(control_frame(spark, sf, "dataset_ctl")).select("dataset_uuid", "status")


@query("facet_filter", control_cte("task_ctl") + """
SELECT task_uuid, dataset_uuid FROM task_ctl WHERE task_type = 'COMPACTION' AND status = 'SUCCEEDED'""")
def facet_filter(spark, sf):
    wanted = {"dataset_uuid": None, "task_type": "COMPACTION", "status": "SUCCEEDED"}
    return fl.facets(control_frame(spark, sf, "task_ctl"), wanted).select("task_uuid", "dataset_uuid")


@query("watchable_index_filter", control_cte("index_ctl", "policy_ctl") + """
SELECT i.index_id, p.policy_id FROM index_ctl i JOIN policy_ctl p ON i.dataset_uuid = p.dataset_uuid
WHERE i.status = 'READY' AND p.enabled AND p.index_watch_enabled""")
def watchable_index_filter(spark, sf):
    indexes = jn.watchable(control_frame(spark, sf, "index_ctl"))
    policies = jn.watch_policies(control_frame(spark, sf, "policy_ctl"))
    return indexes.join(policies.select("dataset_uuid", "policy_id"), "dataset_uuid").select("index_id", "policy_id")


@query("dispatchable_filter", control_cte("task_ctl") + """
SELECT task_uuid, status, attempt FROM task_ctl WHERE status IN ('PENDING', 'QUEUED') AND attempt < max_attempts""")
def dispatchable_filter(spark, sf):
    return fl.dispatchable(control_frame(spark, sf, "task_ctl")).select("task_uuid", "status", "attempt")


@query("retry_exhausted", control_cte("task_ctl") + """
SELECT task_uuid, attempt, max_attempts FROM task_ctl WHERE status = 'FAILED' AND attempt >= max_attempts""")
def retry_exhausted(spark, sf):
    return fl.retry_exhausted(control_frame(spark, sf, "task_ctl")).select("task_uuid", "attempt", "max_attempts")


@query("soft_delete", control_cte("dataset_ctl") + """
SELECT dataset_uuid, CASE WHEN description = 'MACHINERY' THEN 'DELETED' ELSE status END AS status FROM dataset_ctl""")
def soft_delete(spark, sf):
    datasets = control_frame(spark, sf, "dataset_ctl")
    return fl.soft_delete(datasets, F.col("description") == "MACHINERY").select("dataset_uuid", "status")


@query("page_datasets", control_cte("dataset_ctl") + """
SELECT d.dataset_uuid, d.table_name, x.newest FROM dataset_ctl d
JOIN (SELECT concat('ds-', o_custkey) AS dataset_uuid, max(o_orderdate) AS newest FROM orders GROUP BY 1) x
  ON x.dataset_uuid = d.dataset_uuid
WHERE d.status <> 'DELETED' ORDER BY x.newest DESC, d.dataset_uuid LIMIT 20 OFFSET 20""")
def page_datasets(spark, sf):
    touched = control_frame(spark, sf, "task_ctl").groupBy("dataset_uuid").agg(F.max("created_at").alias("newest"))
    listed = fl.live(control_frame(spark, sf, "dataset_ctl")).join(touched, "dataset_uuid")
    return fl.page(listed, "newest", "dataset_uuid", page=2).select("dataset_uuid", "table_name", "newest")


@query("page_tasks", control_cte("task_ctl") + """
SELECT task_uuid, task_type, created_at FROM task_ctl WHERE status = 'FAILED'
ORDER BY created_at DESC, task_uuid LIMIT 200 OFFSET 0""")
def page_tasks(spark, sf):
    failed = fl.facets(control_frame(spark, sf, "task_ctl"), {"status": "FAILED"})
    return fl.page(failed, "created_at", "task_uuid", page=0, page_size=5000).select(
        "task_uuid", "task_type", "created_at")


@query("list_sorted", control_cte("index_ctl") + """
SELECT dataset_uuid, index_name, last_optimized_at FROM index_ctl ORDER BY last_optimized_at DESC, index_name""")
def list_sorted(spark, sf):
    return fl.newest_first(control_frame(spark, sf, "index_ctl"), "last_optimized_at", "index_name").select(
        "dataset_uuid", "index_name", "last_optimized_at")


@query("list_total", control_cte("task_ctl") + "SELECT count(*) AS total FROM task_ctl WHERE status = 'FAILED'")
def list_total(spark, sf):
    return fl.list_total(fl.facets(control_frame(spark, sf, "task_ctl"), {"status": "FAILED"}))


@query("claim_order", control_cte("task_ctl") + """
SELECT task_type, task_uuid, priority, CAST(claim_rank AS INT) AS claim_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY task_type ORDER BY priority, created_at, task_uuid) AS claim_rank
  FROM task_ctl WHERE status IN ('PENDING', 'QUEUED') AND attempt < max_attempts) WHERE claim_rank <= 50""")
def claim_order(spark, sf):
    ready = fl.dispatchable(control_frame(spark, sf, "task_ctl"))
    return mt.claim_order(ready, capacity=50).select("task_type", "task_uuid", "priority", "claim_rank")
