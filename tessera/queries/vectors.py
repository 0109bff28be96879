"""Distances, exact search and kNN joins."""

from pyspark.sql import functions as F

from tessera.functions.vectors import distance_expr, mean_vectors
from tessera.operators import search as se
from tessera.queries import given, query

# SQL text of a squared distance of two lists of doubles
L2 = "list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip({a}::DOUBLE[], {b}::DOUBLE[])])"

QUERY0 = "q AS (SELECT embedding AS qv FROM embeddings WHERE vec_id = 0)"
SCORED0 = f"""WITH {QUERY0},
scored AS (SELECT e.vec_id, e.label, {L2.format(a="e.embedding", b="q.qv")} AS d FROM embeddings e, q)
"""
TOP0 = SCORED0 + "SELECT vec_id, label, round(d, 6) AS distance FROM scored ORDER BY d, vec_id LIMIT {k}"

MEANS = """means AS (SELECT label AS mean_label, list(m ORDER BY pos) AS mv FROM (
  SELECT label, pos, avg(x) AS m FROM (
    SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings)
  GROUP BY label, pos) GROUP BY label)"""


def first_vector(spark, sf):
    table = given(spark, sf, "embeddings")
    return table, se.query_vector(table, "vec_id", 0, "embedding")


def rounded(df):
    return df.withColumn("distance", F.round(se.DISTANCE, 6)).drop(se.DISTANCE)


def label_means(spark, sf):
    """Mean vector per label: a small query set that depends on the whole table."""
    return mean_vectors(given(spark, sf, "embeddings"), "label", "embedding").withColumnRenamed("label", "mean_label")


@query("vector_distance", f"""WITH {QUERY0}
SELECT e.vec_id, round({L2.format(a="e.embedding", b="q.qv")}, 6) AS l2,
  round(1 - list_inner_product(e.embedding::DOUBLE[], q.qv::DOUBLE[]), 6) AS dot,
  round(1 - list_cosine_similarity(e.embedding::DOUBLE[], q.qv::DOUBLE[]), 6) AS cosine
FROM embeddings e, q""")
def vector_distance(spark, sf):
    table, q = first_vector(spark, sf)
    other = F.array(*[F.lit(x) for x in q])
    return table.select("vec_id", *[
        F.round(distance_expr(F.col("embedding"), other, m), 6).alias(m) for m in ("l2", "dot", "cosine")])


@query("vector_search_flat", TOP0.format(k=10))
def vector_search_flat(spark, sf):
    table, q = first_vector(spark, sf)
    return rounded(se.vector_search(table, q, "embedding", "vec_id", 10, select=["vec_id", "label"]))


@query("topk_search", TOP0.format(k=100))
def topk_search(spark, sf):
    table, q = first_vector(spark, sf)
    return rounded(se.nearest(table, q, "embedding", "vec_id", 100).select("vec_id", "label", se.DISTANCE))


@query("vector_search_filtered", SCORED0 + """
SELECT vec_id, label, round(d, 6) AS distance
FROM (SELECT * FROM scored ORDER BY d, vec_id LIMIT 50) WHERE label < 5""")
def vector_search_filtered(spark, sf):
    table, q = first_vector(spark, sf)
    return rounded(se.vector_search(table, q, "embedding", "vec_id", 50, filter_expr="label < 5",
                                    select=["vec_id", "label"]))


@query("vector_search_prefiltered", SCORED0 + """
SELECT vec_id, label, round(d, 6) AS distance FROM scored WHERE label < 5 ORDER BY d, vec_id LIMIT 50""")
def vector_search_prefiltered(spark, sf):
    table, q = first_vector(spark, sf)
    return rounded(se.vector_search(table, q, "embedding", "vec_id", 50, filter_expr="label < 5",
                                    select=["vec_id", "label"], prefilter=True))


@query("vector_search_projected", SCORED0 + """
SELECT label, round(d, 6) AS distance FROM scored ORDER BY d, vec_id LIMIT 20""")
def vector_search_projected(spark, sf):
    table, q = first_vector(spark, sf)
    return rounded(se.vector_search(table, q, "embedding", "vec_id", 20, select=["label"]))


@query("vector_knn_join", f"""
SELECT query_id, vec_id, round(d, 6) AS distance, CAST(rank AS INT) AS rank FROM (
  SELECT q.vec_id AS query_id, e.vec_id, {L2.format(a="e.embedding", b="q.embedding")} AS d,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY {L2.format(a="e.embedding", b="q.embedding")}, e.vec_id) AS rank
  FROM embeddings e, embeddings q) WHERE rank <= 10""")
def vector_knn_join(spark, sf):
    table = given(spark, sf, "embeddings")
    queries = table.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return rounded(se.knn_join(queries, "query_id", "query", table, "vec_id", "embedding", 10))


@query("topk_per_query", f"""WITH {MEANS}
SELECT mean_label, vec_id, label, round(d, 6) AS distance, CAST(rank AS INT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY mean_label ORDER BY d, vec_id) AS rank FROM (
    SELECT m.mean_label, e.vec_id, e.label, {L2.format(a="e.embedding", b="m.mv")} AS d FROM embeddings e, means m))
WHERE rank <= 20""")
def topk_per_query(spark, sf):
    table = given(spark, sf, "embeddings")
    return rounded(se.search_many(label_means(spark, sf), "mean_label", "mean", table, "vec_id", "embedding",
                                  ["vec_id", "label"], 20))


@query("topk_per_query_cosine", f"""WITH {MEANS}
SELECT mean_label, vec_id, round(d, 6) AS distance, CAST(rank AS INT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY mean_label ORDER BY d, vec_id) AS rank FROM (
    SELECT m.mean_label, e.vec_id, 1 - list_cosine_similarity(e.embedding::DOUBLE[], m.mv) AS d
    FROM embeddings e, means m))
WHERE rank <= 20""")
def topk_per_query_cosine(spark, sf):
    return rounded(se.knn_join(label_means(spark, sf), "mean_label", "mean", given(spark, sf, "embeddings"),
                               "vec_id", "embedding", 20, "cosine"))
