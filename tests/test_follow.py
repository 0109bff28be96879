"""An index that follows its table, and writes that lose nothing."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import embedding as em, ivf, search as se, upkeep as up
from tessera.sources import tables as tb
from tessera.sources.paths import partition_values
from tessera.streaming import streams as st

VECTORS = np.random.default_rng(3).standard_normal((200, 8)).astype("float32")


def rows_of(spark, ids, empty=()):
    rows = [(i, None if i in empty else VECTORS[i].tolist()) for i in ids]
    return spark.createDataFrame(rows, "id long, vec array<float>")


def built(spark, path, tmp_path):
    return ivf.IvfIndex.build(spark.read.parquet(path), str(tmp_path / "index"), key="id", column="vec",
                              index_name="idx", num_partitions=4)


def same_as_exact(spark, index, path, k=40):
    table = spark.read.parquet(path)
    q = VECTORS[7].tolist()
    want = [r["id"] for r in se.vector_search(table, q, "vec", "id", k, select=["id"]).collect()]
    return [r["id"] for r in index.search(q, k, nprobes=4, table=table).collect()] == want


def test_vectors_filled_in_place_are_found(spark, path, tmp_path):
    tb.write_append(rows_of(spark, range(60), empty=range(0, 60, 2)), path, version=1)
    index = built(spark, path, tmp_path)
    filled = rows_of(spark, range(0, 60, 2)).withColumn(tb.VERSION, F.lit(1))
    tb.merge_into(spark, path, filled, "id", tb.VERSION)
    stats = index.live_stats(spark.read.parquet(path)).first()
    assert (stats["num_indexed_rows"], stats["num_unindexed_rows"]) == (0, 60)
    assert same_as_exact(spark, index, path)
    assert index.optimize(spark.read.parquet(path)) == 60
    assert index.unindexed_rows(spark.read.parquet(path)).count() == 0
    assert same_as_exact(spark, index, path)
    assert index.merge(spark.read.parquet(path)) == 1
    assert index.postings().count() == 60 and same_as_exact(spark, index, path)


def test_deleted_rows_are_not_found(spark, path, tmp_path):
    tb.write_append(rows_of(spark, range(60)), path, version=1)
    tb.write_append(rows_of(spark, range(60, 90)), path, version=2)
    index = built(spark, path, tmp_path)
    assert same_as_exact(spark, index, path)
    up.delete_from_table(spark, path, tb.VERSION, "id = 7 OR ingest_version = 2")
    assert same_as_exact(spark, index, path)
    found = index.search(VECTORS[7].tolist(), 90, nprobes=4, table=spark.read.parquet(path))
    assert sorted(r["id"] for r in found.collect()) == [i for i in range(60) if i != 7]


def test_an_uncommitted_delta_is_not_read(spark, path, tmp_path):
    tb.write_append(rows_of(spark, range(40)), path, version=1)
    index = built(spark, path, tmp_path)
    tb.write_append(rows_of(spark, range(40, 50)), path, version=2)
    table = spark.read.parquet(path)
    index._write_delta(index.unindexed_rows(table), index.meta(), 1)  # the driver dies here
    assert index.postings().count() == 40 and same_as_exact(spark, index, path)
    assert index.optimize(table) == 10
    assert index.postings().count() == 50 and same_as_exact(spark, index, path)


def test_a_second_commit_of_one_state_fails(spark, path, tmp_path):
    tb.write_append(rows_of(spark, range(40)), path, version=1)
    index = built(spark, path, tmp_path)
    with pytest.raises(RuntimeError, match="another run"):
        index._commit(index.meta())


@pytest.mark.parametrize("values", [["01", "02", None], ["a:b", "c", None], ["true", "false", None]])
def test_delete_spells_partitions_as_their_directories(spark, path, values):
    rows = [(i, v) for v in values for i in range(10)]
    tb.write_overwrite(spark.createDataFrame(rows, "id long, p string"), path, partition_by=("p",))
    assert up.delete_from_table(spark, path, "p", "id < 4") == 18
    left = tb.stored(spark, path, "p")
    assert left.count() == 18 and left.where("id < 4").count() == 0
    assert {r[0] for r in left.select("p").distinct().collect()} == set(values)
    first = F.col("p").cast("string").isNull()
    assert up.delete_from_table(spark, path, "p", first) == 12
    assert up.delete_from_table(spark, path, "p", "id >= 0") == 0
    assert partition_values(spark, path, "p") == []


def test_a_value_without_a_directory_is_refused(spark, path):
    tb.write_overwrite(spark.createDataFrame([(1, "01")], "id long, p string"), path, partition_by=("p",))
    with pytest.raises(ValueError, match="stored"):
        tb.replace_partitions(spark.read.parquet(path), path, "p", ["1"])
    assert tb.stored(spark, path, "p").first()["p"] == "01"


def test_compact_with_null_and_hot_keys(spark, path):
    rows = spark.createDataFrame([(1, "01" if i % 3 else None) for i in range(60)], "k long, p string")
    rows.repartition(6).write.partitionBy("p").parquet(path)
    report = up.compact(spark, path, "p", "k", {"target_rows_per_fragment": 20})
    assert report.rows == 60 and report.files_added < report.files_removed
    assert tb.stored(spark, path, "p").where("p IS NULL").count() == 20
    assert tb.stored(spark, path, "p").where("p = '01'").count() == 40


def test_an_older_late_row_does_not_replace_a_newer_one(spark):
    old = spark.createDataFrame([(1, 10, "new"), (2, 1, "old"), (3, None, "none")], "id long, at long, v string")
    new = spark.createDataFrame([(1, 5, "late"), (2, 3, "next"), (3, 1, "some")], "id long, at long, v string")
    got = sorted(r["v"] for r in tb.merge_rows(old, new, "id", "at").collect())
    assert got == ["new", "next", "some"]
    twice = tb.merge_rows(old, new.unionByName(new), "id")
    assert sorted(r["v"] for r in twice.collect()) == ["late", "next", "some"]


def test_appends_keep_the_versions_of_others_and_survive_a_replay(spark, path, tmp_path, monkeypatch):
    tb.write_append(rows_of(spark, range(20)), path, version=1)
    index = built(spark, path, tmp_path)
    tb.write_append(rows_of(spark, range(20, 40)), path, version=2)  # nobody has indexed these
    for _ in range(2):
        monkeypatch.setattr(st, "run_batches", lambda stream, folder, each: each(stream, 0))
        st.index_appends(rows_of(spark, range(40, 60)), path, index, str(tmp_path / "checkpoint"))
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == list(range(60))
    assert index.postings().count() == 60 and same_as_exact(spark, index, path)


def test_a_filter_does_not_call_the_endpoint_twice(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, t string")
    done = em.with_endpoint(df, F.col("t"), "r", lambda p, h: {"data": [{"embedding": [1.0]} for _ in p["input"]]}, "m")
    kept = done.where("r.error IS NULL")
    assert kept.count() == 2
    assert kept._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
