import numpy as np
import pytest

from tessera.functions.vectors import DimensionMismatch, distance_expr, distance_to, mean_vectors, row_distance
from tessera.operators import search as se
from pyspark.sql import functions as F


def table(spark, n=300, dim=8, copies=100, seed=42):
    """Normal vectors, of which the last ``copies`` are one and the same."""
    rows = np.random.default_rng(seed).standard_normal((n, dim)).astype("float32")
    rows[n - copies:] = rows[0]
    data = [(i, f"k{i:04d}", "a" if i % 3 else "b", rows[i].tolist()) for i in range(n)]
    return spark.createDataFrame(data, "id long, name string, kind string, vec array<float>").repartition(5), rows


def brute(rows, q, metric="l2"):
    rows, q = rows.astype(float), np.asarray(q, dtype=float)
    if metric == "l2":
        return ((rows - q) ** 2).sum(axis=1)
    inner = rows @ q
    if metric == "dot":
        return 1 - inner
    return 1 - inner / np.linalg.norm(rows, axis=1) / np.linalg.norm(q)


@pytest.mark.parametrize("metric", ["l2", "cosine", "dot"])
def test_flat_search_is_brute_force(spark, metric):
    df, rows = table(spark, copies=1)
    q = rows[7].tolist()
    got = se.vector_search(df, q, "vec", "id", 15, select=["id"], metric=metric).collect()
    want = brute(rows, q, metric)
    assert [r["id"] for r in got] == sorted(range(len(rows)), key=lambda i: (round(want[i], 12), i))[:15]
    assert np.allclose([r["_distance"] for r in got], np.sort(want)[:15])


def test_equal_distances_are_ordered_by_key(spark):
    df, rows = table(spark)
    got = se.vector_search(df, rows[0].tolist(), "vec", "id", 5, select=["id", "_distance"][:1]).collect()
    assert [r["id"] for r in got] == [0, 200, 201, 202, 203]


@pytest.mark.parametrize("key", ["id", "name"])
def test_knn_join_is_brute_force_with_many_copies(spark, key):
    df, rows = table(spark)
    queries = df.select(F.col("id").alias("q"), F.col("vec").alias("qv"))
    got = se.knn_join(queries, "q", "qv", df, key, "vec", 7).collect()
    found = {}
    for r in sorted(got, key=lambda r: (r["q"], r["rank"])):
        found.setdefault(r["q"], []).append(int(str(r[key]).lstrip("k")))
    for q in range(len(rows)):
        d = brute(rows, rows[q])
        assert found[q] == sorted(range(len(rows)), key=lambda i: (d[i], i))[:7]


def test_large_query_sets_run_in_blocks(spark, monkeypatch):
    df, _ = table(spark, n=120, copies=40)
    queries = df.select(F.col("id").alias("q"), F.col("vec").alias("qv"))
    whole = sorted(se.knn_join(queries, "q", "qv", df, "id", "vec", 3).collect())
    monkeypatch.setattr(se, "QUERY_BLOCK_BYTES", 4000)
    assert sorted(se.knn_join(queries, "q", "qv", df, "id", "vec", 3).collect()) == whole


def test_no_queries_give_no_rows(spark):
    df, _ = table(spark, n=20, copies=1)
    none = df.where("id < 0").select(F.col("id").alias("q"), F.col("vec").alias("qv"))
    assert se.knn_join(none, "q", "qv", df, "id", "vec").collect() == []


def test_search_many_brings_columns(spark):
    df, rows = table(spark, n=30, copies=1)
    queries = df.where("id = 3").select(F.col("id").alias("q"), F.col("vec").alias("qv"))
    got = se.search_many(queries, "q", "qv", df, "id", "vec", ["id", "kind"], 2).orderBy("rank").collect()
    assert got[0]["id"] == 3 and got[0]["kind"] == "b"


def test_post_filter_may_return_fewer_than_k(spark):
    df, rows = table(spark, copies=1)
    q = rows[1].tolist()
    after = se.vector_search(df, q, "vec", "id", 9, filter_expr="kind = 'b'").collect()
    before = se.vector_search(df, q, "vec", "id", 9, filter_expr="kind = 'b'", prefilter=True).collect()
    assert len(after) < 9 and len(before) == 9
    assert {r["kind"] for r in after + before} == {"b"}


def test_null_vectors_are_skipped(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0]), (2, None), (3, [1.0, 1.0])], "id long, vec array<float>")
    assert [r["id"] for r in se.vector_search(df, [0.0, 1.0], "vec", "id", 5).collect()] == [1, 3]
    assert df.select(distance_to("vec", [0.0, 1.0]).alias("d")).where("d IS NULL").count() == 1


def test_checks_before_a_search(spark):
    df, _ = table(spark, n=10, copies=1)
    with pytest.raises(se.ColumnNotFound, match="id.*kind.*name.*vec"):
        se.vector_search(df, [0.0] * 8, "nope", "id")
    with pytest.raises(DimensionMismatch):
        se.vector_search(df, [0.0] * 4, "vec", "id")
    for k in (0, 1001):
        with pytest.raises(ValueError, match="k must"):
            se.vector_search(df, [0.0] * 8, "vec", "id", k)
    with pytest.raises(ValueError, match="metric"):
        distance_to("vec", [0.0], "hamming")


@pytest.mark.parametrize("metric", ["l2", "cosine", "dot"])
def test_built_in_distance_equals_batch_distance(spark, metric):
    df, rows = table(spark, n=40, copies=1)
    q = rows[2].tolist()
    other = F.array(*[F.lit(float(x)) for x in q])
    got = df.select(distance_expr(F.col("vec"), other, metric).alias("a"), distance_to("vec", q, metric).alias("b")).collect()
    assert np.allclose([r["a"] for r in got], [r["b"] for r in got])


def test_top_k_stays_in_a_heap_and_reads_needed_columns(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    source = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    q = se.query_vector(source, "vec_id", 0, "embedding")
    plan = se.vector_search(source, q, "embedding", "vec_id", 3, select=["vec_id"])._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan and "ReadSchema: struct<vec_id:bigint,embedding:array<float>>" in plan


def test_mean_vectors(spark):
    df, rows = table(spark, n=90, copies=30)
    got = {r["kind"]: r["mean"] for r in mean_vectors(df, "kind", "vec").collect()}
    for kind, at in (("a", [i for i in range(90) if i % 3]), ("b", [i for i in range(90) if not i % 3])):
        assert np.allclose(got[kind], rows[at].astype(float).mean(axis=0))


def test_recall_counts_shared_neighbours(spark):
    truth = spark.createDataFrame([(1, 10), (1, 11), (2, 10), (2, 12)], "q long, id long")
    found = spark.createDataFrame([(1, 10), (1, 11), (2, 13)], "q long, id long")
    row = se.recall(found, truth, "q", "id").first()
    assert (row["queries"], row["recall"]) == (2, 0.5)


@pytest.mark.parametrize("metric", ["l2", "dot", "cosine"])
def test_vectors_without_a_distance_do_not_hide_others(metric):
    rng = np.random.default_rng(4)
    rows, queries = rng.normal(size=(9000, 8)), rng.normal(size=(3, 8))
    rows[7, 2], rows[8, 0], rows[9] = np.nan, np.inf, 0.0
    best = se.TopK(queries, 10, metric)
    best.update(np.arange(3), rows, np.arange(9000))
    clean = se.TopK(queries, 10, metric)
    keep = np.delete(np.arange(9000), [7, 8, 9] if metric == "cosine" else [7, 8])
    clean.update(np.arange(3), rows[keep], keep)
    assert all((a == b).all() for a, b in zip(best.results(), clean.results())) and len(best.results()[0]) == 30


@pytest.mark.parametrize("case", ["plain", "far off", "in close groups", "copies", "huge", "tiny", "one huge"])
def test_bounds_in_single_precision_lose_no_neighbour(case):
    """Against all distances in double precision, also where single precision can't tell the rows apart."""
    rng = np.random.default_rng(6)
    rows = rng.normal(size=(11_000, 12))
    if case == "in close groups":
        rows = rows[rng.integers(0, 40, len(rows))] + 1e-6 * rng.normal(size=rows.shape)
    if case == "copies":
        rows[:4000] = rows[0]
    rows = {"far off": rows + 1e6, "huge": rows * 1e20, "tiny": rows * 1e-25}.get(case, rows)
    if case == "one huge":
        rows[5] = 1e13
    queries, keys = rows[rng.permutation(len(rows))[:60]], rng.permutation(len(rows))
    best = se.TopK(queries, 10, "l2")
    for part in (slice(0, 40), slice(40, 40), slice(40, None)):
        best.update(np.arange(60), rows[part], keys[part])
    for q in range(60):
        dist = row_distance(rows, queries[q], "l2")
        want = np.lexsort((keys, dist))[:10]
        assert (best.dist[q] == dist[want]).all() and (best.key[q] == keys[want]).all()
