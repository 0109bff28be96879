"""Integrity of stored indexes: sound ones pass through every change, damage of each sort is found."""

import glob
import os
import re
import shutil

import pytest
from pyspark.sql import functions as F

from tessera.operators import index_catalog as ic, index_check as ix, upkeep as up
from tessera.plans.lifecycle import rebuild_action
from tessera.plans.tasks import run_task
from tessera.sources import tables as tb

SHAPE = "id long, body string, kind string, vec array<float>"
KINDS = {"IVF_FLAT": ("vec", {"num_partitions": 3}), "IVF_PQ": ("vec", {"num_partitions": 2, "num_sub_vectors": 2, "codes": 4}),
         "FTS": ("body", {"buckets": 4}), "BITMAP": ("kind", {})}


def rows_of(spark, ids, word="red"):
    return spark.createDataFrame([(i, None if i % 9 == 0 else f"{word} w{i % 5}", None if i % 7 == 0 else word + "abc"[i % 3],
                                   None if i % 8 == 0 else [float(i), float(i % 5), 1.0, 0.5]) for i in ids], SHAPE)


@pytest.fixture(params=sorted(KINDS))
def built(request, spark, path, tmp_path):
    """A table of two files and its index of one type."""
    tb.write_append(rows_of(spark, range(60)).repartitionByRange(2, "id"), path, version=1)
    column, params = KINDS[request.param]
    return ic.build_index(spark.read.parquet(path), str(tmp_path / "idx" / "one"), index_type=request.param, key="id",
                          column=column, index_name="one", **params)


def problems(spark, index, path):
    return sorted(r["problem"] for r in ix.file_problems(index, spark.read.parquet(path)).collect())


def action(spark, index, path, wanted=None):
    found = ix.health_all(spark.read.parquet(path), os.path.dirname(index.path), {"one": wanted or {}})
    return rebuild_action(found).first().asDict()


def posting_files(index):
    return sorted(glob.glob(f"{index.path}/postings/**/*.parquet", recursive=True), key=os.path.getsize)


def test_a_sound_index_stays_sound(spark, built, path):
    assert problems(spark, built, path) == [] and action(spark, built, path)["action"] == "NONE"
    tb.write_append(rows_of(spark, range(60, 100), "blue"), path, version=2)
    state = action(spark, built, path)
    assert (state["coverage"], state["bad_files"], state["action"]) == (0.6, 0, "OPTIMIZE")
    built.optimize(spark.read.parquet(path))
    assert problems(spark, built, path) == [] and action(spark, built, path)["action"] == "NONE"
    up.delete_from_table(spark, path, tb.VERSION, "id < 10")  # rewrites the first two files: to be read again, not damage
    assert problems(spark, built, path) == [] and action(spark, built, path)["action"] == "OPTIMIZE"
    built.optimize(spark.read.parquet(path))
    built.merge(spark.read.parquet(path))
    assert problems(spark, built, path) == [] and action(spark, built, path)["coverage"] == 1.0


def test_a_lost_posting_file_asks_for_a_rebuild(spark, built, path):
    os.remove(posting_files(built)[-1])
    assert set(problems(spark, built, path)) == {"missing"}
    state = run_task(spark, "INDEX_CHECK", {"path": path, "index_root": os.path.dirname(built.path)})["indexes"]
    assert [(r["index_name"], r["coverage"], r["action"]) for r in state] == [("one", 1.0, "REBUILD")]
    for left in posting_files(built):
        os.remove(left)
    assert problems(spark, built, path) == ["missing", "missing"]


def test_postings_written_twice_and_lost_coverage(spark, built, path):
    one = posting_files(built)[-1]
    shutil.copy(one, os.path.join(os.path.dirname(one), "part-again.parquet"))
    assert set(problems(spark, built, path)) == {"extra"}
    os.remove(os.path.join(os.path.dirname(one), "part-again.parquet"))
    assert problems(spark, built, path) == []
    shutil.rmtree(f"{built.path}/covered")
    assert problems(spark, built, path) == ["extra", "extra"] and action(spark, built, path)["coverage"] == 0.0


def test_other_rows_in_as_many_entries(spark, built, path, tmp_path):
    """A data file that was replaced in place: as many entries, other contents."""
    first = spark.read.parquet(path).where("id = 1").selectExpr("_metadata.file_path AS f").first()[0]
    first = re.sub("^file:/+", "/", first)
    ids = [r["id"] for r in spark.read.parquet(first).select("id").orderBy("id").collect()]
    other = rows_of(spark, ids, "pink").withColumn("vec", F.transform("vec", lambda x: (x + 1).cast("float")))
    other.coalesce(1).write.parquet(str(tmp_path / "other"))
    shutil.copy(glob.glob(str(tmp_path / "other" / "*.parquet"))[0], first)
    check = os.path.join(os.path.dirname(first), f".{os.path.basename(first)}.crc")
    if os.path.exists(check):
        os.remove(check)
    spark.catalog.refreshByPath(path)
    assert problems(spark, built, path) == ["changed"]


def test_changed_settings_ask_for_a_rebuild(spark, built, path):
    same = {"column": built.meta().column_name, **ix.settings_of(built.meta())}
    assert action(spark, built, path, same)["action"] == "NONE"
    state = action(spark, built, path, {"num_partitions": 99})
    assert (state["damaged"], state["action"]) == (False, "REBUILD") and state["params_hash"] != state["built_params_hash"]


def test_an_empty_table_has_no_problems(spark, path, tmp_path):
    rows_of(spark, range(1)).where("id < 0").coalesce(1).write.parquet(path)
    index = ic.build_index(spark.read.parquet(path), str(tmp_path / "idx" / "one"), index_type="FTS", key="id", column="body",
                           index_name="one")
    assert problems(spark, index, path) == [] and action(spark, index, path)["action"] in ("NONE", "OPTIMIZE")
