import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.functions.vectors import DimensionMismatch
from tessera.operators import ivf, search as se
from tessera.sources import tables as tb


def rows_of(spark, n, dim=8, first=0, seed=1, hot=False):
    data = np.random.default_rng(seed).standard_normal((n, dim)).astype("float32")
    if hot:  # a third of all rows sits in one spot
        data[: n // 3] = 0.01 * data[: n // 3] + 5
    return spark.createDataFrame([(first + i, v.tolist()) for i, v in enumerate(data)], "id long, vec array<float>")


def build(df, path, **options):
    options = {"num_partitions": 4, "key": "id", "column": "vec", "index_name": "idx", **options}
    return ivf.IvfIndex.build(df, path, **options)


def exact(df, q, k):
    return [r["id"] for r in se.vector_search(df, q, "vec", "id", k, select=["id"]).collect()]


@pytest.fixture
def versioned(spark, tmp_path):
    """800 rows indexed, then 400 appended."""
    path = str(tmp_path / "rows")
    tb.write_append(rows_of(spark, 800), path, version=1)
    index = build(spark.read.parquet(path), str(tmp_path / "index"))
    tb.write_append(rows_of(spark, 400, first=800, seed=2), path, version=2)
    return path, index


def test_probing_every_partition_is_exact(spark, path):
    df = rows_of(spark, 256, 32, hot=True)
    index = build(df, path)
    q = se.query_vector(df, "id", 100, "vec")
    assert [r["id"] for r in index.search(q, 20, nprobes=4).collect()] == exact(df, q, 20)
    assert index.postings().count() == 256
    assert index.search(q, 1, nprobes=1).first()["_distance"] == 0


def test_search_reads_probed_partitions_only(spark, path):
    df = rows_of(spark, 256)
    index = build(df, path)
    q = se.query_vector(df, "id", 3, "vec")
    queries = spark.createDataFrame([(0, q)], "q int, v array<double>")
    plan = index.search_join(queries, "q", "v", 5, 1)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(part_id" in plan or "PartitionFilters: [part_id" in plan or "part_id#" in plan


def test_append_watch_optimize_merge(spark, versioned):
    path, index = versioned
    table = spark.read.parquet(path)
    stats = index.live_stats(table).first()
    assert (stats["latest_version"], stats["num_indexed_rows"], stats["num_unindexed_rows"]) == (2, 800, 400)
    q = se.query_vector(table, "id", 900, "vec")
    assert index.search(q, 1, nprobes=4, table=table).first()["id"] == 900
    assert index.search(q, 10, nprobes=4).where("id >= 800").count() == 0
    assert index.optimize(table) == 400
    assert index.optimize(table) == 0
    meta = index.meta()
    assert (meta.covered_version, meta.delta_count) == (2, 1)
    assert index.live_stats(table).first()["num_unindexed_rows"] == 0
    before = exact(table, q, 10)
    assert [r["id"] for r in index.search(q, 10, nprobes=4).collect()] == before
    assert index.merge() == 1 and index.merge() == 0
    assert index.meta().delta_count == 0
    assert [r["id"] for r in index.search(q, 10, nprobes=4).collect()] == before
    assert index.drop_old_generations() == 1
    assert index.postings().count() == 1200


def test_second_build_replaces_the_first(spark, path):
    build(rows_of(spark, 100), path)
    index = build(rows_of(spark, 60), path, num_partitions=3)
    assert index.postings().count() == 60
    with pytest.raises(ValueError, match="exists"):
        build(rows_of(spark, 60), path, replace_existing=False)


def test_pq_with_refine(spark, path):
    df = rows_of(spark, 256, 32)
    index = build(df, path, index_type="IVF_PQ", num_sub_vectors=8, codes=64)
    q = se.query_vector(df, "id", 17, "vec")
    assert [r["id"] for r in index.search(q, 5, nprobes=4, refine_factor=25).collect()] == exact(df, q, 5)
    assert index.postings().select(F.max(F.size("code"))).first()[0] == 8
    # the codes of a plain search come without the vectors
    queries = spark.createDataFrame([(0, q)], "q int, v array<double>")
    plan = index.search_join(queries, "q", "v", 5, 1)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<id:bigint,code:array<int>>" in plan


def test_pq_distance_is_the_distance_to_the_decoded_vector(spark, path):
    df = rows_of(spark, 90, 8)
    index = build(df, path, index_type="IVF_PQ", num_sub_vectors=4, codes=16)
    q = np.asarray(se.query_vector(df, "id", 5, "vec"))
    queries = spark.createDataFrame([(0, q.tolist())], "q int, v array<double>")
    got = {r["id"]: r["_distance"] for r in index.search_join(queries, "q", "v", 90, 4).collect()}
    ids, centroids = index.model()
    for r in index.postings().collect():
        decoded = centroids[ids.index(r["part_id"])] + np.concatenate(
            [book[c] for book, c in zip(index.books(), r["code"])])
        assert got[r["id"]] == pytest.approx(((q - decoded) ** 2).sum())


@pytest.mark.parametrize("options", [{}, {"index_type": "IVF_PQ", "num_sub_vectors": 2, "codes": 8}])
def test_join_without_k_gives_every_row_its_distance(spark, tmp_path, options):
    path = str(tmp_path / "rows")
    tb.write_append(rows_of(spark, 1500, 4), path, version=1)  # more than K_MAX
    index = build(spark.read.parquet(path), str(tmp_path / "index"), **options)
    odd = [(1600, [1.0, 2.0, 3.0, 4.0]), (1601, None), (1602, [float("nan")] * 4)]
    tb.write_append(spark.createDataFrame(odd, "id long, vec array<float>"), path, version=2)
    table = spark.read.parquet(path)
    queries = spark.createDataFrame([(0, [0.5, 0.0, -1.0, 2.0]), (1, [1.0, 1.0, 1.0, 1.0]), (2, None)], "q int, v array<double>")
    every = index.search_join(queries, "q", "v", None, 4, table=table)
    got = {(r["q"], r["id"]): r["_distance"] for r in every.collect()}
    assert every.columns == ["q", "id", "_distance"] and len(got) == every.count() == 2 * 1501
    best = index.search_join(queries, "q", "v", 1000, 4, table=table).collect()
    assert len(best) == 2000 and all(got[r["q"], r["id"]] == r["_distance"] for r in best)
    with pytest.raises(ValueError, match="needs a k"):
        index.search_join(queries, "q", "v", None, 4, refine_factor=2)


def test_hot_partition_keeps_every_row(spark, path):
    one_spot = spark.createDataFrame([(i, [1.0, 2.0] if i % 3 else [float(i), -4.0]) for i in range(900)],
                                     "id long, vec array<float>")
    index = build(one_spot, path)
    assert index.postings().select("id").distinct().count() == 900
    got = index.search([1.0, 2.0], 700, nprobes=4).collect()
    assert [r["id"] for r in got[:600]] == [i for i in range(900) if i % 3]


def test_rebalancing_cuts_a_hot_partition_over_several_files(spark, path):
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64KB")
    try:
        rng = np.random.default_rng(4)
        data = rng.standard_normal((6000, 8)).astype("float32")
        data[:4000] += 50  # two thirds of the rows share one centroid
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "id long, vec array<float>").repartition(8)
        centroids = spark.createDataFrame([(0, [50.0] * 8), (1, [0.5] * 8), (2, [-0.5] * 8)], "part_id int, centroid array<double>")
        index = build(df, path, centroids=centroids)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    files = index.postings().groupBy("part_id").agg(F.countDistinct(F.col("_metadata.file_path")).alias("n"), F.count(F.lit(1)).alias("rows"))
    got = {r["part_id"]: (r["n"], r["rows"]) for r in files.collect()}
    assert got[0][1] == 4000 and got[0][0] > 1
    assert sum(rows for _, rows in got.values()) == 6000


def test_training_on_a_share_still_indexes_every_row(spark, path):
    df = rows_of(spark, 500)
    index = build(df, path, index_type="IVF_PQ", num_sub_vectors=2, codes=8, train_fraction=0.3)
    assert index.postings().select("id").distinct().count() == 500


def test_equal_codes_are_settled_by_key(spark, path):
    df = spark.createDataFrame([(i, [1.0, 2.0, 3.0, 4.0]) for i in range(500)], "id long, vec array<float>").repartition(4)
    centroids = spark.createDataFrame([(0, [0.0] * 4)], "part_id int, centroid array<double>")
    books = spark.createDataFrame([(0, 0, [1.0, 2.0]), (1, 0, [3.0, 4.0])], "sub int, code int, codeword array<double>")
    index = build(df, path, index_type="IVF_PQ", num_sub_vectors=2, centroids=centroids, codebooks=books)
    got = index.search([1.0, 2.0, 3.0, 5.0], 7, nprobes=1).collect()
    assert [(r["id"], r["_distance"]) for r in got] == [(i, 1.0) for i in range(7)]
    assert [r["id"] for r in index.search([1.0, 2.0, 3.0, 5.0], 3, nprobes=1, refine_factor=2).collect()] == [0, 1, 2]


def test_checks(spark, path):
    df = rows_of(spark, 60)
    with pytest.raises(ValueError, match="divide"):
        build(df, path, index_type="IVF_PQ", num_sub_vectors=3)
    with pytest.raises(ValueError, match="IVF_FLAT or IVF_PQ"):
        build(df, path, index_type="HNSW")
    index = build(df, path)
    with pytest.raises(DimensionMismatch):
        index.search([1.0], 3)
    with pytest.raises(ValueError, match="k must"):
        index.search([0.0] * 8, 0)


def test_rows_without_vector_stay_out_of_the_index(spark, path):
    df = rows_of(spark, 60).unionByName(spark.createDataFrame([(99, None)], "id long, vec array<float>"))
    assert build(df, path).postings().count() == 60


def test_coverage_has_four_decimals(spark):
    df = spark.createDataFrame([(2, 3), (0, 0)], "a long, b long")
    got = [str(r[0]) for r in df.select(ivf.index_coverage(F.col("a"), F.col("b"))).collect()]
    assert got == ["0.6667", "0.0000"]


def test_codes_of_few_pairs_are_summed_up(monkeypatch):
    """The k best of a cell by codes, as a table of distances per query gives them, without that sum for every pair."""
    rng = np.random.default_rng(2)
    books = [rng.normal(size=(16, 4)) for _ in range(4)]
    matrix, queries, codes = rng.normal(size=(1, 16)), rng.normal(size=(50, 16)), rng.integers(0, 16, (20_000, 4)).astype("int32")
    codes[:500] = codes[0]
    keys, summed = rng.permutation(len(codes)), []
    real = ivf.sliced_distance
    monkeypatch.setattr(ivf, "sliced_distance", lambda q, r, n: summed.append(len(q)) or real(q, r, n))
    index = ivf.IvfIndex(None, "unused")
    monkeypatch.setattr(index, "model", lambda meta: ([0], matrix))
    monkeypatch.setattr(index, "books", lambda meta: books)
    meta = ivf.IndexMeta(0, 0, 0, 0, "i", "vec", "id", "IVF_PQ", "l2", 16, "{}", 0)
    best = se.TopK(queries, 10, "l2")
    lists = pa.ListArray.from_arrays(np.arange(0, codes.size + 1, 4, dtype="int32"), codes.ravel())
    index._code_score(meta)(best, 0, pa.table({"id": keys, "code": lists}))
    for q in range(50):
        dist = ivf.adc_distance(queries[q] - matrix[0], codes, books)
        want = np.lexsort((keys, dist))[:10]
        assert (best.dist[q] == dist[want]).all() and (best.key[q] == keys[want]).all()
    assert 0 < sum(summed) < 50 * len(codes) / 10
