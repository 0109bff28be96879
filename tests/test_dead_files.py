"""Rows of files that a table no longer has are passed over where they lie."""

import pytest

from tessera.operators import text_index as tx, upkeep as up
from tessera.sources import tables as tb


def indexed(spark, path, tmp_path):
    """Two appends, a segment for each; files of the table."""
    rows = spark.createDataFrame([(i, f"w{i % 3} w{i % 7}") for i in range(60)], "id long, text string")
    tb.write_append(rows.where("id < 40").repartition(2, "id"), path, version=1)
    index = tx.TextIndex.build(spark.read.parquet(path), str(tmp_path / "index"), key="id", column="text", buckets=4)
    tb.write_append(rows.where("id >= 40").repartition(2, "id"), path, version=2)
    index.optimize(spark.read.parquet(path))
    return index


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_delta_without_live_files_is_not_opened(spark, path, tmp_path):
    index = indexed(spark, path, tmp_path)
    up.delete_from_table(spark, path, tb.VERSION, "id = 5")  # rewrites the first append
    table = spark.read.parquet(path)
    state = index.file_state(table)
    assert (state.gone, state.mixed, len(state.dead)) == ([0], [], 2)
    live = index._alive(index.postings(), state)
    assert "Exchange" not in plan_of(live) and "Join" not in plan_of(live)
    assert {r.id for r in live.select("id").collect()} == set(range(40, 60))
    assert {r.id for r in index.search(["w1"], k=60, table=table).collect()} == {
        i for i in range(60) if (i % 3 == 1 or i % 7 == 1) and i != 5}
    index.optimize(table)
    index.merge(table)
    assert {r.id for r in index.postings().select("id").collect()} == set(range(60)) - {5}


@pytest.mark.parametrize("folded", [False, True])
def test_a_dead_file_beside_a_live_one_brings_no_shuffle(spark, path, tmp_path, folded):
    index = indexed(spark, path, tmp_path)
    if folded:
        index.merge()  # one delta has the files of both appends
    up.delete_from_table(spark, path, tb.VERSION, "id < 40")
    table = spark.read.parquet(path)
    state = index.file_state(table)
    assert (state.gone, len(state.mixed), len(state.dead)) == (([], 2, 2) if folded else ([0], 0, 2))
    live = index._alive(index.postings(), state)
    assert "hashpartitioning" not in plan_of(live)
    assert {r.id for r in live.select("id").collect()} == set(range(40, 60))
    kept = index._alive(index.covered_files(index.meta()), state)
    assert kept.count() == 2 and "hashpartitioning" not in plan_of(kept)
