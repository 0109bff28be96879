from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessera.functions.scalars import map_text, ts
from tessera.operators import filters as fl, joins as jn
from tessera.plans import lifecycle as lc, reconcile as rc

NOW = datetime(2024, 5, 6, 7, 30)
POLICY = ("policy_id long, dataset_uuid string, policy_name string, enabled boolean, ttl_days int, "
          "min_small_fragments int, index_optimize_cron string")


def clock(when=NOW):
    return ts(when.isoformat(sep=" "))


# --- watch ------------------------------------------------------------------

@pytest.mark.parametrize("unindexed, latest, seen, minutes, rows, drift, stale, reason", [
    (500, 9, 1, 99, 100, 3, 30, "unindexed_rows"),   # rows beat the others
    (100, 9, 9, 1, 100, 3, 30, "unindexed_rows"),    # at the threshold
    (500, 9, 1, 99, None, 3, 30, "version_drift"),   # rows off
    (None, 9, 1, 1, 100, 3, 30, "version_drift"),    # no count
    (5, 3, None, None, 100, 3, 30, "version_drift"),  # drift from zero
    (5, 2, 1, 45, 100, 3, 30, "stale"),
    (5, 2, 1, None, 100, 3, 30, None),               # never optimised: no baseline
    (5, 2, 1, 45, 100, 3, None, None),
    (5, 1, 8, 1, 100, 3, 30, None),                  # seen ahead of latest
    (500, 9, 1, 99, None, None, None, None),
])
def test_watch_decision(spark, unindexed, latest, seen, minutes, rows, drift, stale, reason):
    at = None if minutes is None else NOW - timedelta(minutes=minutes)
    df = spark.createDataFrame([(unindexed, latest, seen, at, rows, drift, stale)], """unindexed_rows long,
        latest_version long, last_seen_version long, last_optimized_at timestamp_ntz, min_unindexed_rows int,
        min_version_drift int, stale_minutes int""")
    row = lc.watch_decision(df, clock()).first()
    assert row["reason"] == reason
    assert row["version_drift"] == max(0, latest - (seen or 0))
    assert row["stale_for_minutes"] == (minutes or 0.0)


def watch_frames(spark, version=4):
    indexes = spark.createDataFrame([
        (1, "d1", "i1", "READY", version, 1, 5000), (2, "d1", "i2", "OPTIMIZING", version, 1, 5000),
        (3, "d2", "i3", "READY", version, 1, 5000), (4, "gone", "i4", "READY", version, 1, 5000),
    ], """index_id long, dataset_uuid string, index_name string, status string, latest_version long,
          last_seen_version long, unindexed_rows long""").withColumn("last_optimized_at", F.lit(None).cast("timestamp_ntz"))
    datasets = spark.createDataFrame([("d1", "t", "u"), ("d2", "t", "u")], "dataset_uuid string, tenant_id string, storage_uri string")
    policies = spark.createDataFrame([
        (7, "d1", True, True, 100, 1, None), (5, "d1", True, True, 9999999, 1, None), (6, "d2", False, True, 100, 1, None),
    ], """policy_id long, dataset_uuid string, enabled boolean, index_watch_enabled boolean, min_unindexed_rows int,
          min_version_drift int, stale_minutes int""")
    return indexes, datasets, policies


def test_watch_takes_ready_indexes_and_the_first_policy(spark):
    got = jn.watch_candidates(*watch_frames(spark)).collect()
    assert [(r["index_id"], r["policy_id"]) for r in got] == [(1, 5)]


def test_watch_emits_once_per_version(spark):
    none = spark.createDataFrame([], "idempotency_key string")
    first = lc.watch_emit(*watch_frames(spark), none, clock()).collect()
    assert [r["idempotency_key"] for r in first] == ["watcher:1:INDEX_OPTIMIZE:v4:version_drift"]
    assert '"trigger_reason":"version_drift"' in first[0]["params"]
    seen = spark.createDataFrame([(first[0]["idempotency_key"],)], "idempotency_key string")
    assert lc.watch_emit(*watch_frames(spark), seen, clock()).count() == 0
    assert lc.watch_emit(*watch_frames(spark, version=5), seen, clock()).count() == 1


# --- plan -----------------------------------------------------------------------

def plan(spark, policies, existing=None, when=NOW, indexes=(), rules=()):
    policies = spark.createDataFrame(policies, POLICY)
    datasets = spark.createDataFrame([("d1", "t1")], "dataset_uuid string, tenant_id string")
    indexes = spark.createDataFrame(list(indexes), "dataset_uuid string, index_name string, status string, delta_count int")
    rules = spark.createDataFrame(list(rules), "rule_id long, dataset_uuid string, enabled boolean")
    if existing is not None:
        existing = spark.createDataFrame([(k,) for k in existing], "idempotency_key string")
    rows = lc.lifecycle_plan(policies, datasets, indexes, rules, clock(when), existing).collect()
    return sorted((r["task_type"], r["idempotency_key"]) for r in rows)


TTL = (1, "d1", "p", True, 7, None, None)
FULL = (1, "d1", "p", True, 7, 100, "0 2 * * *")


def test_plan_cases(spark):
    assert plan(spark, [TTL]) == [("TTL_DELETE", "t1:lifecycle:1:TTL_DELETE:20240506")]
    assert [t for t, _ in plan(spark, [FULL])] == ["COMPACTION", "INDEX_OPTIMIZE", "TTL_DELETE"]
    assert plan(spark, [(1, "d1", "p", False, 7, 100, "x")]) == []
    assert plan(spark, [(1, "orphan", "p", True, 7, 100, "x")]) == []


def test_plan_is_idempotent_within_its_bucket(spark):
    keys = [k for _, k in plan(spark, [FULL])]
    assert plan(spark, [FULL], existing=keys) == []
    later = NOW + timedelta(hours=1)
    assert [t for t, _ in plan(spark, [FULL], existing=keys, when=later)] == ["INDEX_OPTIMIZE"]
    assert len(plan(spark, [FULL], existing=keys, when=NOW + timedelta(days=1))) == 3


def test_vectorize_tasks_meet_existing_keys_of_their_kind_only(spark):
    rules, vectorize = [(8, "d1", True), (9, "d1", True)], "t1:lifecycle:1:{}:VECTORIZE:2024050607".format
    both = [("VECTORIZE", vectorize(8)), ("VECTORIZE", vectorize(9))]
    ttl = "t1:lifecycle:1:TTL_DELETE:20240506"
    assert plan(spark, [TTL], existing=[ttl, None, vectorize(8).replace("07", "06")], rules=rules) == both
    assert plan(spark, [TTL], existing=[ttl, vectorize(8)], rules=rules) == both[1:]
    assert plan(spark, [TTL], existing=[*(k for _, k in both)], rules=rules) == [("TTL_DELETE", ttl)]


def test_the_product_of_policies_and_rules_is_not_shuffled(spark):
    policies = spark.createDataFrame([TTL], POLICY)
    datasets = spark.createDataFrame([("d1", "t1")], "dataset_uuid string, tenant_id string")
    indexes = spark.createDataFrame([], "dataset_uuid string, index_name string, status string, delta_count int")
    rules = spark.createDataFrame([(8, "d1", True)], "rule_id long, dataset_uuid string, enabled boolean")
    earlier = lc.policy_tasks(policies, datasets, clock()).select("idempotency_key")
    tasks = lc.lifecycle_plan(policies, datasets, indexes, rules, clock(), earlier)
    text = tasks._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("LeftAnti") == 2  # one for policy tasks, one for hot indexes: none for the product
    assert "RepartitionByExpression [policy_id" in text


def test_hot_indexes_are_optimised_without_a_schedule(spark):
    indexes = [("d1", "hot", "READY", 10), ("d1", "cool", "READY", 9), ("d1", "busy", "OPTIMIZING", 50)]
    two = [TTL, (2, "d1", "q", True, None, None, None)]
    assert [k for t, k in plan(spark, two, indexes=indexes) if t == "INDEX_OPTIMIZE"] == [
        "t1:auto-optimize:d1/hot:2024050607"]
    assert [k for t, k in plan(spark, [FULL], indexes=indexes) if t == "INDEX_OPTIMIZE"] == [
        "t1:lifecycle:1:INDEX_OPTIMIZE:2024050607"]


def test_every_enabled_rule_gets_its_own_key(spark):
    rules = [(8, "d1", True), (9, "d1", True), (10, "d1", False)]
    got = [k for t, k in plan(spark, [TTL], rules=rules) if t == "VECTORIZE"]
    assert got == ["t1:lifecycle:1:8:VECTORIZE:2024050607", "t1:lifecycle:1:9:VECTORIZE:2024050607"]


def test_index_moves(spark):
    pairs = [("BUILDING", "READY"), ("READY", "OPTIMIZING"), ("MERGING", "READY"), ("READY", "FAILED"),
             ("BUILDING", "DROPPED"), ("BUILDING", "OPTIMIZING"), ("DROPPED", "READY"), ("OPTIMIZING", "MERGING")]
    got = lc.illegal_index_moves(spark.createDataFrame(pairs, "from_status string, to_status string")).collect()
    assert sorted(tuple(r)[:2] for r in got) == [("BUILDING", "OPTIMIZING"), ("DROPPED", "READY"), ("OPTIMIZING", "MERGING")]


# --- reconcile -----------------------------------------------------------------------

def catalog_frames(spark):
    catalog = spark.createDataFrame([
        ("c", "s", "same", "t", "u1", "x", True), ("c", "s", "moved", "t", "u2b", None, True),
        ("c", "s", "new", "t", "u3", None, False), ("c", "s", "empty", "t", "", "", True),
        ("c", "s", "quiet", "t", "u6", None, False),
    ], "catalog string, db_schema string, name string, tenant_id string, storage_location string, comment string, comment_present boolean")
    datasets = spark.createDataFrame([
        ("1", "c", "s", "same", "t", "u1", "x", "ACTIVE"), ("2", "c", "s", "moved", "t", "u2", "keep", "PAUSED"),
        ("4", "c", "s", "gone", "t", "u4", None, "ACTIVE"), ("5", "c", "s", "empty", "t", "u5", "d", "ACTIVE"),
        ("6", "c", "s", "quiet", "t", "u6", "kept", "ACTIVE"),
    ], "dataset_uuid string, catalog string, db_schema string, table_name string, tenant_id string, storage_uri string, description string, status string")
    return catalog, datasets


def test_reconcile_actions_and_a_second_pass(spark):
    catalog, datasets = catalog_frames(spark)
    actions = {r["name"]: r["action"] for r in rc.reconcile(catalog, datasets).collect()}
    assert actions == {"same": "unchanged", "moved": "updated", "new": "created", "gone": "missing",
                       "empty": "unchanged", "quiet": "unchanged"}
    after = rc.catalog_apply(catalog, datasets)
    row = after.where("table_name = 'moved'").first()
    assert (row["storage_uri"], row["description"], row["status"]) == ("u2b", "keep", "PAUSED")
    again = {r["action"] for r in rc.reconcile(catalog, after).collect()}
    assert again == {"unchanged", "missing"}
    assert [r["name"] for r in rc.unknown_entries(catalog, datasets).collect()] == ["new"]
    assert [r["name"] for r in rc.missing_entries(catalog, datasets).collect()] == ["gone"]


def test_patch_clears_a_comment_given_as_null(spark):
    got = sorted(tuple(r) for r in rc.catalog_patch(*catalog_frames(spark)).collect())
    assert got == [("2", "description", "keep", None), ("2", "storage_uri", "u2", "u2b"),
                   ("5", "description", "d", ""), ("5", "storage_uri", "u5", "")]


def test_scope(spark):
    catalog, _ = catalog_frames(spark)
    assert rc.in_scope(catalog, "DATASET", "c", "s", "new").count() == 1
    assert rc.in_scope(catalog, "ALL").count() == 5
    with pytest.raises(ValueError, match="scope"):
        rc.in_scope(catalog, "GALAXY")


def test_properties_are_plain_strings(spark):
    df = spark.createDataFrame([("d", "t", "ACTIVE", 12, 3, None, 4), ("e", "t", "ACTIVE", 10 ** 15, 3, "0.0000", 4)],
                               "dataset_uuid string, tenant_id string, status string, row_count long, fragment_count long, c string, latest_version long")
    df = df.withColumn("index_coverage", F.col("c").cast("decimal(5,4)"))
    got = {r[0]: r[1] for r in df.select("dataset_uuid", rc.dataset_properties("x.", clock())).collect()}
    assert got["d"]["x.index_coverage"] == "0" and got["e"]["x.index_coverage"] == "0.0000"
    assert got["e"]["x.row_count"] == "1000000000000000"
    assert got["d"]["x.synced_at"] == "2024-05-06T07:30:00+00:00"


def test_index_properties_keep_dots_and_show_no_time_as_empty(spark):
    df = spark.createDataFrame([("d", "my.idx.v2", "v", "ready", None), ("d", "b", "w", "BUILDING", NOW)],
                               "dataset_uuid string, index_name string, column_name string, status string, last_optimized_at timestamp_ntz")
    row = rc.index_properties(df, "x.").select(map_text("properties")).first()[0]
    assert row == ("x.index.b.column=w;x.index.b.last_optimized_at=2024-05-06T07:30:00+00:00;x.index.b.state=BUILDING;"
                   "x.index.my.idx.v2.column=v;x.index.my.idx.v2.last_optimized_at=;x.index.my.idx.v2.state=READY")


# --- tenants, pages --------------------------------------------------------------------

def tenant_frames(spark):
    a = spark.createDataFrame([("d1", "t1", 1), ("d2", "t2", 2)], "dataset_uuid string, tenant_id string, a int")
    b = spark.createDataFrame([("d1", "t1", 3), ("d1", "t2", 4), ("d2", "t2", 5)], "dataset_uuid string, tenant_id string, b int")
    return a, b


def test_both_sides_of_a_join_are_cut_to_the_tenant(spark):
    a, b = tenant_frames(spark)
    assert [r["b"] for r in fl.TenantScope("t1").join(a, b, "dataset_uuid").collect()] == [3]
    assert [r["b"] for r in fl.TenantScope("t1").child(b.drop("tenant_id"), a).collect()] == [3, 4]


def test_no_tenant_fails_closed_and_system_sees_all(spark):
    a, b = tenant_frames(spark)
    with pytest.raises(fl.TenantContextError):
        fl.TenantScope().table(a)
    assert fl.TenantScope(strict=False).table(a).count() == 0
    assert fl.TenantScope(all_tenants=True).table(b).count() == 3


def test_page_bounds():
    assert fl.page_bounds(0, 0) == (1, 20)
    assert fl.page_bounds(-3, 999) == (1, 200)
    assert fl.page_bounds(4, 50) == (4, 50)


def test_facets(spark):
    a, _ = tenant_frames(spark)
    assert fl.facets(a, {"tenant_id": None, "a": 2}).count() == 1
    with pytest.raises(ValueError, match="zone"):
        fl.facets(a, {"zone": 1})
