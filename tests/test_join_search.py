"""Searches for many queries over a table that changes, in blocks of bounded size."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import block_join as bj, ivf, search as se, upkeep as up
from tessera.sources import tables as tb

VECTORS = np.random.default_rng(5).standard_normal((400, 8)).astype("float32")
VECTORS[100:200] = VECTORS[100] + 0.01 * VECTORS[100:200]  # a crowded partition


def rows_of(spark, ids, empty=()):
    rows = [(i, None if i in empty else VECTORS[i].tolist()) for i in ids]
    return spark.createDataFrame(rows, "id long, vec array<float>")


def asked(table):
    return table.select(F.col("id").alias("q"), F.col("vec").alias("qv"))


def found(df):
    return sorted((r["q"], r["rank"], r["id"], round(r["_distance"], 9)) for r in df.collect())


def followed(spark, path, index_path, **options):
    """An index after an append, a delete that rewrote the first file, and vectors that are missing."""
    tb.write_append(rows_of(spark, range(300), empty=(3, 4)).repartition(3, "id"), path, version=1)
    index = ivf.IvfIndex.build(spark.read.parquet(path), index_path, key="id", column="vec", index_name="i",
                               num_partitions=4, **options)
    tb.write_append(rows_of(spark, range(300, 340)), path, version=2)
    tb.write_append(rows_of(spark, range(340, 360)), path, version=3)
    up.delete_from_table(spark, path, tb.VERSION, "id = 301")
    return index, spark.read.parquet(path)


@pytest.mark.parametrize("cell", [32 << 20, 3000])
def test_join_search_answers_for_the_live_table(spark, path, tmp_path, monkeypatch, cell):
    monkeypatch.setattr(bj, "CELL_BYTES", cell)
    index, table = followed(spark, path, str(tmp_path / "i"))
    queries = asked(rows_of(spark, range(360), empty=(3, 4)))
    want = found(se.knn_join(queries, "q", "qv", table, "id", "vec", 6))
    assert found(index.search_join(queries, "q", "qv", 6, nprobes=4, table=table)) == want
    index.optimize(table)
    assert found(index.search_join(queries, "q", "qv", 6, nprobes=4, table=table)) == want
    up.delete_from_table(spark, path, tb.VERSION, "id % 3 = 0")
    table = spark.read.parquet(path)
    want = found(se.knn_join(queries.where("q < 50"), "q", "qv", table, "id", "vec", 6))
    assert found(index.search_join(queries.where("q < 50"), "q", "qv", 6, nprobes=4, table=table)) == want
    assert not {r[2] % 3 for r in want} & {0}


def test_cells_are_spread_over_tasks_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(bj, "CELL_BYTES", 3000)
    rows = rows_of(spark, range(200))
    parts = bj.flat_join(asked(rows), "q", "qv", rows, "id", "vec", 3, "l2", 8)
    cells = -(-200 // (3000 // 64)) * -(-200 // (3000 // (8 * (8 + 6))))
    assert parts.rdd.getNumPartitions() == bj.CELL_TASKS * cells  # few bytes don't become few tasks
    assert found(bj.best_of(parts, "q", "id", 3)) == found(se.knn_join(asked(rows), "q", "qv", rows, "id", "vec", 3))


def test_refined_join_is_exact_where_all_are_candidates(spark, path, tmp_path):
    index, table = followed(spark, path, str(tmp_path / "i"), index_type="IVF_PQ", num_sub_vectors=2, codes=4)
    queries = asked(table).where("q % 5 = 0")
    want = found(se.knn_join(queries, "q", "qv", table, "id", "vec", 4))
    assert found(index.search_join(queries, "q", "qv", 4, nprobes=4, refine_factor=90, table=table)) == want
    rough = found(index.search_join(queries, "q", "qv", 4, nprobes=4, table=table))
    one = index.search(VECTORS[10].tolist(), 4, nprobes=4, table=table).collect()
    assert [r[2] for r in rough if r[0] == 10] == [r["id"] for r in one]
    with pytest.raises(ValueError, match="refine_factor"):
        index.search_join(queries, "q", "qv", 4, refine_factor=0)


def test_no_queries_and_no_rows(spark, path, tmp_path):
    index, table = followed(spark, path, str(tmp_path / "i"))
    assert index.search_join(asked(table).where("q < 0"), "q", "qv", 4, table=table).count() == 0
    assert index.search_join(asked(table).where("q = 3"), "q", "qv", 4, table=table).count() == 0  # it has no vector
    assert bj.flat_join(asked(table), "q", "qv", table.where("id < 0"), "id", "vec", 4, "l2", 8).count() == 0


def test_exact_join_in_blocks(spark, monkeypatch):
    table = rows_of(spark, range(400))
    queries = asked(table)
    for metric in ("l2", "cosine", "dot"):
        monkeypatch.setattr(se, "QUERY_BLOCK_BYTES", 64 << 20)
        want = found(se.knn_join(queries, "q", "qv", table, "id", "vec", 5, metric))
        monkeypatch.setattr(se, "QUERY_BLOCK_BYTES", 100)
        monkeypatch.setattr(bj, "CELL_BYTES", 5000)
        assert found(se.knn_join(queries, "q", "qv", table, "id", "vec", 5, metric)) == want
