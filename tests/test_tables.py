from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessera.functions.scalars import ts
from tessera.operators import upkeep as up
from tessera.plans.tasks import run_task
from tessera.sources import tables as tb
from tessera.sources.paths import partition_values

NOW = "2024-03-10 12:00:00"


def numbers(spark, n, part=None):
    df = spark.range(n)
    return df.withColumn("p", F.lit(part) if part is not None else (F.col("id") % 4).cast("int"))


def test_versions_come_from_directory_names(spark, path):
    assert tb.latest_version(spark, path) is None
    for version in (1, 2, 10):
        tb.write_append(spark.range(5), path, version=version)
    assert tb.latest_version(spark, path) == 10
    assert sorted(tuple(r) for r in tb.version_summary(spark.read.parquet(path)).collect()) == [(1, 5), (2, 5), (10, 5)]
    tb.write_overwrite(spark.range(3), path, version=11)
    assert tb.latest_version(spark, path) == 11 and spark.read.parquet(path).count() == 3


def test_scan_checks_names_and_pushes_the_filter(spark, path):
    numbers(spark, 20).write.parquet(path)
    df = tb.scan(spark, path, ["id"], "id > 10")
    assert df.columns == ["id"] and df.count() == 9
    assert "PushedFilters: [IsNotNull(id), GreaterThan(id,10)]" in df._jdf.queryExecution().toString()
    with pytest.raises(ValueError, match=r"\['x'\].*\['id', 'p'\]"):
        tb.scan(spark, path, ["x"])


def test_merge_rewrites_touched_partitions_only(spark, path):
    tb.write_overwrite(numbers(spark, 40).withColumn("v", F.lit("old")), path, partition_by=("p",))
    files = {r[0] for r in spark.read.parquet(path).where("p <> 1").select("_metadata.file_path").collect()}
    new = spark.createDataFrame([(1, 1, "new"), (101, 1, "new")], "id long, p int, v string")
    assert tb.merge_into(spark, path, new, "id", "p") == 11
    after = spark.read.parquet(path)
    assert after.count() == 41 and after.where("v = 'new'").count() == 2
    assert {r[0] for r in after.where("p <> 1").select("_metadata.file_path").collect()} == files


def test_merge_moves_a_key_to_its_new_partition(spark, path):
    tb.write_overwrite(spark.createDataFrame([(1, 0), (2, 1)], "id long, p int"), path, partition_by=("p",))
    tb.merge_into(spark, path, spark.createDataFrame([(1, 1)], "id long, p int"), "id", "p")
    assert sorted(tuple(r) for r in spark.read.parquet(path).select("id", "p").collect()) == [(1, 1), (2, 1)]
    assert partition_values(spark, path, "p") == ["1"]


def test_merge_keeps_the_newest_copy_of_a_key(spark):
    old = spark.createDataFrame([(1, 1, "a")], "id long, at long, v string")
    new = spark.createDataFrame([(1, 3, "c"), (1, 2, "b"), (2, 1, "d")], "id long, at long, v string")
    got = sorted(tuple(r) for r in tb.merge_rows(old, new, "id", "at").collect())
    assert got == [(1, 3, "c"), (2, 1, "d")]


def test_first_batch_per_checksum_with_one_hot_checksum(spark):
    rows = [(i, "hot" if i % 3 else f"c{i}") for i in range(3000)]
    batches = spark.createDataFrame(rows, "id long, checksum string")
    log = spark.createDataFrame([("c0",), ("c3",)], "checksum string")
    kept = tb.drop_seen_batches(batches, "checksum", ["id"], log).collect()
    assert len(kept) == 1 + 998
    assert [r["id"] for r in kept if r["checksum"] == "hot"] == [1]


def test_delete_keeps_rows_with_a_null_predicate(spark, path):
    rows = [(0, 1), (1, None), (2, 2), (3, 1)]
    tb.write_overwrite(spark.createDataFrame(rows, "p int, v int"), path, partition_by=("p",))
    untouched = [r[0] for r in spark.read.parquet(path).where("p = 2").select("_metadata.file_path").collect()]
    assert up.delete_from_table(spark, path, "p", "v = 1") == 2
    assert sorted(r["p"] for r in spark.read.parquet(path).collect()) == [1, 2]
    assert partition_values(spark, path, "p") == ["1", "2"]
    assert [r[0] for r in spark.read.parquet(path).where("p = 2").select("_metadata.file_path").collect()] == untouched


def test_ttl_leaves_the_young_and_the_boundary(spark, path):
    now = datetime.fromisoformat(NOW)
    rows = [(1, "old_a", now - timedelta(days=6)), (2, "old_b", now - timedelta(days=6)),
            (3, "young_c", now - timedelta(hours=1)), (4, "young_d", now - timedelta(hours=1)),
            (5, "edge", now - timedelta(days=1)), (6, "past_edge", now - timedelta(days=1, microseconds=1))]
    df = spark.createDataFrame(rows, "id long, label string, created_at timestamp_ntz").withColumn(
        "day", F.date_format("created_at", "yyyyMMdd"))
    left = up.ttl_delete(df, "created_at", ts(NOW + ".999"), 1)
    assert sorted(r["label"] for r in left.collect()) == ["edge", "young_c", "young_d"]
    tb.write_overwrite(df, path, partition_by=("day",))
    report = run_task(spark, "TTL_DELETE", {"path": path, "partition_col": "day", "column": "created_at",
                                            "now": NOW, "ttl_days": 1})
    assert report["rows_after"] == 3
    assert sorted(r["label"] for r in spark.read.parquet(path).collect()) == ["edge", "young_c", "young_d"]


@pytest.mark.parametrize("days", [None, 0, -1])
def test_ttl_needs_days(days):
    with pytest.raises(ValueError, match="ttl_days"):
        up.expired("created_at", None, days)


def test_compaction_merges_small_files_and_names_unknown_keys(spark, path):
    df = spark.range(4000).withColumn("p", F.when(F.col("id") % 3 == 0, 0).otherwise(1))  # one large partition
    df.repartition(16, "id").write.partitionBy("p").parquet(path)
    report = run_task(spark, "COMPACTION", {"path": path, "partition_col": "p", "key": "id", "threshold": {
        "target_rows_per_fragment": 1000, "window": "1h", "min_small_fragments": 2}})
    assert report["files_removed"] == 32 and report["files_added"] == 5 and report["rows"] == 4000
    assert report["ignored_keys"] == ("min_small_fragments", "window")
    after = spark.read.parquet(path)
    assert after.count() == 4000 and after.select("id").distinct().count() == 4000
    assert run_task(spark, "COMPACTION", {"path": path, "partition_col": "p", "key": "id", "threshold": {
        "target_rows_per_fragment": 1000}})["files_removed"] == 0


def test_compaction_can_materialise_deletions(spark, path):
    numbers(spark, 100).repartition(8, "id").write.partitionBy("p").parquet(path)
    up.compact(spark, path, "p", "id", {"materialize_deletions": True}, deleted="id < 50")
    assert spark.read.parquet(path).count() == 50


def test_recycle_drops_versions_beyond_the_newest(spark, path):
    for version in range(1, 6):
        tb.write_append(spark.range(version), path, version=version)
    assert run_task(spark, "LIFECYCLE_RECYCLE", {"path": path, "keep": 2})["versions_dropped"] == [1, 2, 3]
    assert partition_values(spark, path, tb.VERSION) == ["4", "5"]


def test_tasks_name_what_is_missing(spark):
    with pytest.raises(ValueError, match="source_columns"):
        run_task(spark, "VECTORIZE", {"path": "x", "partition_col": "p", "target_column": "v"})
    with pytest.raises(ValueError, match="known"):
        run_task(spark, "DANCE", {})


def test_json_rows(spark):
    rows = spark.createDataFrame([('{"id":1,"name":"a"}', {"v": [1.0]}), ('{"id":2}', {})],
                                 "js string, vs map<string,array<float>>")
    got = tb.json_rows_to_columns(rows, "js", "id long, name string", "vs", ["v"]).collect()
    assert [tuple(r) for r in got] == [(1, "a", [1.0]), (2, None, None)]
