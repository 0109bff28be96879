"""Merges that split overfull partitions and give up starved ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import index_catalog as ic, ivf, refit as rf, search as se, upkeep as up
from tessera.plans.tasks import run_task
from tessera.sources import tables as tb
from tests.test_ivf import build, exact, rows_of


def clusters_of(spark, n, dim=8, first=0, spots=12, seed=3):
    dice = np.random.default_rng(seed)
    middle = 6 + 2 * dice.standard_normal((spots, dim))
    data = middle[dice.integers(0, spots, n)] + 0.1 * dice.standard_normal((n, dim))
    return spark.createDataFrame([(first + i, v.tolist()) for i, v in enumerate(data.astype("float32"))], "id long, vec array<float>")


def drifted(spark, tmp_path, **options):
    """Half of 300 rows deleted, and 1,500 rows far away that the centroids never saw."""
    path = str(tmp_path / "rows")
    tb.write_append(rows_of(spark, 300), path, version=1)
    index = build(spark.read.parquet(path), str(tmp_path / "root" / "index"), num_partitions=8, **options)
    tb.write_append(clusters_of(spark, 1500, first=300), path, version=2)
    up.delete_from_table(spark, path, tb.VERSION, "id < 150")
    table = spark.read.parquet(path)
    index.optimize(table)
    return path, index, table


def share(index):
    sizes = [r["count"] for r in index.postings().groupBy("part_id").count().collect()]
    return max(sizes) / sum(sizes)


def recall(index, table, nprobes):
    queries = table.where("id % 10 = 0").select(F.col("id").alias("q"), F.col("vec").alias("v"))
    truth = se.knn_join(queries, "q", "v", table, "id", "vec", 10)
    return se.recall(index.search_join(queries, "q", "v", 10, nprobes=nprobes), truth, "q", "id").first()["recall"]


def test_a_drifted_index_is_evened_out(spark, tmp_path):
    path, index, table = drifted(spark, tmp_path)
    other = ivf.IvfIndex(spark, index.path)
    other.model()  # holds the old model
    assert share(index) > 0.5
    before = recall(index, table, 2)
    assert run_task(spark, "INDEX_MERGE", {"path": path, "index_root": str(tmp_path / "root"), "refit": True})["indexes"][0]["rows"] >= 1
    assert share(index) <= 2 / 8
    ids, matrix = index.model()
    assert len(ids) == len(set(ids)) == len(matrix) == index.centroids().count()
    rows = index.postings().collect()
    for r in rows:  # every row is with its closest centroid
        away = ((matrix - np.asarray(r["vec"])) ** 2).sum(axis=1)
        assert away[ids.index(r["part_id"])] == pytest.approx(away.min())
    assert sorted(r["id"] for r in rows) == sorted(r["id"] for r in table.select("id").collect())
    after = recall(index, table, 3)
    print("recall", before, after, len(ids), share(index))
    assert after >= 0.9
    q = se.query_vector(table, "id", 700, "vec")
    for reader in (index, other):
        assert [r["id"] for r in reader.search(q, 20, nprobes=len(ids), table=table).collect()] == exact(table, q, 20)
    tb.write_append(rows_of(spark, 50, first=5000, seed=9), path, version=3)  # later deltas use the new model
    table = spark.read.parquet(path)
    assert other.optimize(table) == 50 and index.merge(table) == 1
    assert [r["id"] for r in other.search(q, 20, nprobes=len(ids)).collect()] == exact(table, q, 20)
    assert index.drop_old_generations() >= 1 and other.search(q, 5, nprobes=len(ids)).count() == 5


def test_codes_follow_their_new_centroids(spark, tmp_path):
    _, index, table = drifted(spark, tmp_path, index_type="IVF_PQ", num_sub_vectors=4, codes=16)
    books = index.books()
    rf.merge_refitted(index, table)
    ids, centroids = index.model()
    assert all((a == b).all() for a, b in zip(books, index.books()))
    q = np.asarray(se.query_vector(table, "id", 400, "vec"))
    queries = spark.createDataFrame([(0, q.tolist())], "q int, v array<double>")
    got = {r["id"]: r["_distance"] for r in index.search_join(queries, "q", "v", 1000, len(ids)).collect()}
    rows = index.postings().collect()
    assert len(got) == 1000 and len(rows) == table.count()
    for r in [r for r in rows if r["id"] in got][::7]:
        decoded = centroids[ids.index(r["part_id"])] + np.concatenate([b[c] for b, c in zip(books, r["code"])])
        assert got[r["id"]] == pytest.approx(((q - decoded) ** 2).sum())
        left = np.asarray(r["vec"]) - centroids[ids.index(r["part_id"])]
        assert [int(((b - left[2 * m:2 * m + 2]) ** 2).sum(axis=1).argmin()) for m, b in enumerate(books)] == r["code"]


def test_what_cannot_be_split_stays(spark, path):
    same = spark.createDataFrame([(i, [1.0, 2.0] if i < 90 else [float(i), -4.0]) for i in range(100)], "id long, vec array<float>")
    centroids = spark.createDataFrame([(0, [1.0, 2.0]), (1, [92.0, -4.0]), (2, [97.0, -4.0]), (3, [-50.0, 0.0])],
                                      "part_id int, centroid array<double>")
    index = build(same, path, centroids=centroids)
    assert rf.merge_refitted(index, overfull=2.0, starved=0.1) == 0
    assert sorted(index.model()[0]) == [0, 1, 2] and index.postings().count() == 100  # 3 had no rows
    meta = index.meta()
    assert rf.merge_refitted(index, overfull=2.8, starved=0.0) == 0 and index.meta() == meta
    assert ic.merge_index(index, refit=True) == 0


def test_uneven_partitions():
    found = rf.uneven({1: 100, 2: 10, 3: 9, 4: 1}, [1, 2, 3, 4, 5], 2.0, 0.1)
    assert found.pieces == {1: 5} and found.starved == [4, 5]
    assert rf.uneven({}, [1, 2], 2.0, 0.1) == rf.Uneven({}, [])
    for bad in ((1.0, 0.1), (2.0, 1.0), (2.0, -1.0)):
        with pytest.raises(ValueError, match="overfull"):
            rf.uneven({1: 2}, [1], *bad)
