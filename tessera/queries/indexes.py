"""Vector, text and scalar indexes. Centroids follow a rule (mean vector per label)
where SQL is to repeat the result; trained ones are judged by recall."""

from pyspark.sql import functions as F

from tessera.operators import (bitmap_index as bm, index_catalog as ic, index_check as ix, ivf, refit as rf, scalar_index as si, search as se,
                               text_index as tx, upkeep as up)
from tessera.plans import lifecycle as lc
from tessera.queries import given, query
from tessera.queries.vectors import L2, MEANS, QUERY0, first_vector, label_means, rounded
from tessera.session import work_path
from tessera.sources.paths import delete_path
from tessera.sources import tables as tb
from tessera.sources.control import control_cte, control_frame

ASSIGNED = f"""{MEANS},
assigned AS (SELECT vec_id, label, embedding, part_id, mv FROM (
  SELECT e.*, m.mean_label AS part_id, m.mv,
    row_number() OVER (PARTITION BY e.vec_id ORDER BY {L2.format(a="e.embedding", b="m.mv")}, m.mean_label) AS rn
  FROM embeddings e, means m) WHERE rn = 1)"""

PROBES0 = f"""probes AS (SELECT mean_label AS part_id, mv FROM means, q
  ORDER BY {L2.format(a="mv", b="qv")}, mean_label LIMIT {{n}})"""

VERSION_OF = "CASE WHEN label < 7 THEN 1 ELSE 2 END"


def rule_centroids(spark, sf):
    return label_means(spark, sf).select(F.col("mean_label").alias("part_id"), F.col("mean").alias("centroid"))


def flat_index(spark, sf, table=None, **options):
    return ivf.IvfIndex.build(
        given(spark, sf, "embeddings") if table is None else table, work_path(spark, "ivf"), key="vec_id",
        column="embedding", index_name="idx_embedding", centroids=rule_centroids(spark, sf), **options)


def appended_index(spark, sf, files=(1, 1)):
    """An index over version 1 (labels 0-6) of a table that then gets version 2 (labels 7-9)."""
    path, rows = work_path(spark, "vectors"), given(spark, sf, "embeddings")
    tb.write_append(rows.where("label < 7").repartition(files[0], "vec_id"), path, version=1)
    index = flat_index(spark, sf, spark.read.parquet(path))
    tb.write_append(rows.where("label >= 7").repartition(files[1], "vec_id"), path, version=2)
    return index, spark.read.parquet(path)


# --- IVF ------------------------------------------------------------------------

@query("ivf_build", f"WITH {ASSIGNED} SELECT vec_id, part_id FROM assigned")
def ivf_build(spark, sf):
    return flat_index(spark, sf).postings().select("vec_id", "part_id")


@query("index_build_task", f"WITH {ASSIGNED} SELECT part_id, count(*) AS row_count FROM assigned GROUP BY part_id")
def index_build_task(spark, sf):
    path = work_path(spark, "rebuilt")
    for _ in range(2):  # the second build replaces the first
        index = ivf.IvfIndex.build(given(spark, sf, "embeddings"), path, key="vec_id", column="embedding",
                                   index_name="idx_embedding", centroids=rule_centroids(spark, sf))
    return index.postings().groupBy("part_id").agg(F.count(F.lit(1)).alias("row_count"))


@query("vector_search_ivf", f"""WITH {ASSIGNED}, {QUERY0}, {PROBES0.format(n=3)}
SELECT a.vec_id, round({L2.format(a="a.embedding", b="q.qv")}, 6) AS distance
FROM assigned a JOIN probes p ON a.part_id = p.part_id, q
ORDER BY {L2.format(a="a.embedding", b="q.qv")}, a.vec_id LIMIT 10""")
def vector_search_ivf(spark, sf):
    _, q = first_vector(spark, sf)
    return rounded(flat_index(spark, sf).search(q, 10, nprobes=3))


@query("ivf_knn_join", f"""WITH {ASSIGNED},
probes AS (SELECT query_id, qv, part_id FROM (
  SELECT q.vec_id AS query_id, q.embedding AS qv, m.mean_label AS part_id,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY {L2.format(a="m.mv", b="q.embedding")}, m.mean_label) AS rn
  FROM embeddings q, means m) WHERE rn <= 2)
SELECT query_id, vec_id, round(d, 6) AS distance, CAST(rank AS INT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM (
    SELECT p.query_id, a.vec_id, {L2.format(a="a.embedding", b="p.qv")} AS d
    FROM probes p JOIN assigned a ON a.part_id = p.part_id)) WHERE rank <= 5""")
def ivf_knn_join(spark, sf):
    queries = given(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"))
    return rounded(flat_index(spark, sf).search_join(queries, "query_id", "qv", 5, nprobes=2))


@query("vector_search_mixed", f"""WITH {ASSIGNED}, {QUERY0}, {PROBES0.format(n=3)},
hits AS (SELECT vec_id, {L2.format(a="embedding", b="qv")} AS d FROM assigned, q
         WHERE label >= 7 OR part_id IN (SELECT part_id FROM probes))
SELECT vec_id, round(d, 6) AS distance FROM hits ORDER BY d, vec_id LIMIT 30""")
def vector_search_mixed(spark, sf):
    _, q = first_vector(spark, sf)
    index, table = appended_index(spark, sf)
    return rounded(index.search(q, 30, nprobes=3, table=table))


@query("ivf_knn_join_mixed", f"""WITH {ASSIGNED},
probes AS (SELECT query_id, qv, part_id FROM (
  SELECT q.vec_id AS query_id, q.embedding AS qv, m.mean_label AS part_id,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY {L2.format(a="m.mv", b="q.embedding")}, m.mean_label) AS rn
  FROM embeddings q, means m) WHERE rn <= 2)
SELECT query_id, vec_id, round(d, 6) AS distance, CAST(rank AS INT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM (
    SELECT p.query_id, a.vec_id, {L2.format(a="a.embedding", b="p.qv")} AS d
    FROM probes p JOIN assigned a ON a.part_id = p.part_id WHERE a.label < 7
    UNION ALL
    SELECT q.vec_id, e.vec_id, {L2.format(a="e.embedding", b="q.embedding")} FROM embeddings q, embeddings e WHERE e.label >= 7))
WHERE rank <= 5""")
def ivf_knn_join_mixed(spark, sf):
    """Every vector searched in the index of the first append and, exactly, in the rows that came after it."""
    index, table = appended_index(spark, sf)
    queries = table.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"))
    return rounded(index.search_join(queries, "query_id", "qv", 5, nprobes=2, table=table))


def drifted_index(spark, sf):
    """An index fitted to labels 0-2 that then takes up all others."""
    path, rows = work_path(spark, "vectors"), given(spark, sf, "embeddings")
    tb.write_append(rows.where("label < 3").repartition(1, "vec_id"), path, version=1)
    index = ivf.IvfIndex.build(spark.read.parquet(path), work_path(spark, "ivf"), key="vec_id", column="embedding",
                               index_name="idx_drift", num_partitions=12)
    tb.write_append(rows.where("label >= 3").repartition(2, "vec_id"), path, version=2)
    table = spark.read.parquet(path)
    index.optimize(table)
    return index, table


@query("index_merge_refit", f"""
SELECT query_id, vec_id, round(d, 6) AS distance, CAST(rank AS INT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM (
    SELECT q.vec_id AS query_id, e.vec_id, {L2.format(a="e.embedding", b="q.embedding")} AS d FROM embeddings q, embeddings e))
WHERE rank <= 5""")
def index_merge_refit(spark, sf):
    """After partitions were split and given up, a search of all of them finds what an exact one does."""
    index, table = drifted_index(spark, sf)
    rf.merge_refitted(index, table, overfull=1.5, starved=0.5)
    queries = table.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"))
    return rounded(index.search_join(queries, "query_id", "qv", 5, nprobes=index.centroids().count()))


@query("ivf_refit_recall")
def ivf_refit_recall(spark, sf):
    """Recall of 10 neighbours and the largest partition's share of rows, before and after; a quarter of the partitions is probed."""
    index, table = drifted_index(spark, sf)
    queries = table.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"))
    truth = se.knn_join(queries, "query_id", "qv", table, "vec_id", "embedding", 10)
    parts = []
    for state in ("before", "after"):
        if state == "after":
            rf.merge_refitted(index, table, overfull=1.5, starved=0.5)
        probes = -(-index.centroids().count() // 4)
        largest = index.postings().groupBy("part_id").count().agg((F.max("count") / F.sum("count")).alias("largest_share"))
        found = index.search_join(queries, "query_id", "qv", 10, nprobes=probes)
        parts.append(se.recall(found, truth, "query_id", "vec_id").crossJoin(largest).withColumn("state", F.lit(state)))
    return parts[0].unionByName(parts[1])


@query("index_optimize", f"""WITH {ASSIGNED}
SELECT CAST({VERSION_OF} - 1 AS INT) AS delta_id, part_id, count(*) AS row_count FROM assigned GROUP BY ALL""")
def index_optimize(spark, sf):
    index, table = appended_index(spark, sf)
    index.optimize(table)
    return index.postings().groupBy("delta_id", "part_id").agg(F.count(F.lit(1)).alias("row_count"))


@query("index_merge", f"""WITH {ASSIGNED}
SELECT CAST(0 AS INT) AS delta_id, part_id, count(*) AS row_count FROM assigned GROUP BY ALL""")
def index_merge(spark, sf):
    index, table = appended_index(spark, sf)
    index.optimize(table)
    index.merge()
    return index.postings().groupBy("delta_id", "part_id").agg(F.count(F.lit(1)).alias("row_count"))


@query("index_live_stats", f"""
SELECT CAST(2 AS INT) AS latest_version, count(*) FILTER ({VERSION_OF} = 1) AS num_indexed_rows,
  count(*) FILTER ({VERSION_OF} = 2) AS num_unindexed_rows, 3::BIGINT AS num_indexed_fragments,
  2::BIGINT AS num_unindexed_fragments FROM embeddings""")
def index_live_stats(spark, sf):
    index, table = appended_index(spark, sf, files=(3, 2))
    return index.live_stats(table)


@query("index_coverage", f"""
SELECT CAST(CAST(count(*) FILTER ({VERSION_OF} = 1) AS DOUBLE) / count(*) AS DECIMAL(5,4)) AS coverage
FROM embeddings""")
def index_coverage(spark, sf):
    index, table = appended_index(spark, sf)
    total = F.col("num_indexed_rows") + F.col("num_unindexed_rows")
    return index.live_stats(table).select(ivf.index_coverage(F.col("num_indexed_rows"), total).alias("coverage"))


@query("unindexed_rows_join", "SELECT vec_id, label FROM embeddings WHERE label >= 7")
def unindexed_rows_join(spark, sf):
    index, table = appended_index(spark, sf)
    return index.unindexed_rows(table).select("vec_id", "label")


@query("knn_recall", f"""WITH {ASSIGNED},
pairs AS (SELECT q.vec_id AS query_id, q.embedding AS qv, a.vec_id, a.part_id,
  {L2.format(a="a.embedding", b="q.embedding")} AS d FROM embeddings q, assigned a),
truth AS (SELECT query_id, vec_id FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS r FROM pairs) WHERE r <= 10),
probes AS (SELECT query_id, part_id FROM (
  SELECT q.vec_id AS query_id, m.mean_label AS part_id,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY {L2.format(a="m.mv", b="q.embedding")}, m.mean_label) AS rn
  FROM embeddings q, means m) WHERE rn <= 4),
found AS (SELECT query_id, vec_id FROM (
  SELECT p.*, row_number() OVER (PARTITION BY p.query_id ORDER BY p.d, p.vec_id) AS r
  FROM pairs p JOIN probes USING (query_id, part_id)) WHERE r <= 10)
SELECT count(DISTINCT t.query_id) AS queries, round(count(f.vec_id)::DOUBLE / count(*), 6) AS recall
FROM truth t LEFT JOIN found f ON t.query_id = f.query_id AND t.vec_id = f.vec_id""")
def knn_recall(spark, sf):
    table = given(spark, sf, "embeddings")
    queries = table.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"))
    truth = se.knn_join(queries, "query_id", "qv", table, "vec_id", "embedding", 10)
    found = flat_index(spark, sf).search_join(queries, "query_id", "qv", 10, nprobes=4)
    return se.recall(found, truth, "query_id", "vec_id").withColumn("recall", F.round("recall", 6))


@query("ivf_trained_recall")
def ivf_trained_recall(spark, sf):
    table = given(spark, sf, "embeddings")
    queries = table.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"))
    index = ivf.IvfIndex.build(table, work_path(spark, "ivf"), key="vec_id", column="embedding",
                               index_name="idx_trained", num_partitions=8)
    truth = se.knn_join(queries, "query_id", "qv", table, "vec_id", "embedding", 10)
    found = index.search_join(queries, "query_id", "qv", 10, nprobes=4)
    return se.recall(found, truth, "query_id", "vec_id")


# --- product quantiser ------------------------------------------------------------
# Rule for the codewords: mean residual slice per label, eight values per slice.

SUBS, WIDTH = 8, 8
SLICES = f"""{ASSIGNED},
resid AS (SELECT vec_id, label, part_id, sub, list(x ORDER BY pos) AS piece FROM (
  SELECT vec_id, label, part_id, CAST((pos - 1) // {WIDTH} AS INT) AS sub, pos, x FROM (
    SELECT vec_id, label, part_id, generate_subscripts(embedding, 1) AS pos,
      unnest([z[1] - z[2] FOR z IN list_zip(embedding::DOUBLE[], mv)]) AS x FROM assigned))
  GROUP BY vec_id, label, part_id, sub),
book AS (SELECT sub, label AS code, list(m ORDER BY pos) AS word FROM (
  SELECT sub, label, pos, avg(x) AS m FROM (
    SELECT sub, label, unnest(piece) AS x, generate_subscripts(piece, 1) AS pos FROM resid)
  GROUP BY sub, label, pos) GROUP BY sub, label),
codes AS (SELECT vec_id, part_id, sub, code FROM (
  SELECT r.vec_id, r.part_id, r.sub, b.code,
    row_number() OVER (PARTITION BY r.vec_id, r.sub ORDER BY {L2.format(a="r.piece", b="b.word")}, b.code) AS rn
  FROM resid r JOIN book b ON r.sub = b.sub) WHERE rn = 1)"""

ADC0 = f"""{QUERY0},
query_piece AS (SELECT part_id, sub, list(x ORDER BY pos) AS piece FROM (
  SELECT part_id, CAST((pos - 1) // {WIDTH} AS INT) AS sub, pos, x FROM (
    SELECT mean_label AS part_id, generate_subscripts(mv, 1) AS pos,
      unnest([z[1] - z[2] FOR z IN list_zip(qv::DOUBLE[], mv)]) AS x FROM means, q))
  GROUP BY part_id, sub),
lookup AS (SELECT part_id, p.sub, code, {L2.format(a="p.piece", b="b.word")} AS d
           FROM query_piece p JOIN book b ON p.sub = b.sub),
adc AS (SELECT c.vec_id, c.part_id, sum(d) AS d FROM codes c
        JOIN lookup l ON l.part_id = c.part_id AND l.sub = c.sub AND l.code = c.code GROUP BY c.vec_id, c.part_id)"""


def rule_codebooks(spark, sf):
    part_ids, matrix = ivf.local_matrix(rule_centroids(spark, sf), "part_id", "centroid")
    rows = ivf.assign_partitions(given(spark, sf, "embeddings"), "embedding", part_ids, matrix)
    left = rows.select("label", ivf.residual("embedding", "part_id", part_ids, matrix).alias("residual"))
    means = label_slices(left)
    return means.select("sub", F.col("label").alias("code"), F.col("word").alias("codeword"))


def label_slices(left):
    at = left.select("label", F.posexplode("residual").alias("pos", "x"))
    mean = at.groupBy("label", "pos").agg(F.avg("x").alias("m")).withColumn("sub", (F.col("pos") / WIDTH).cast("int"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "m")))  # WIDTH entries per group
    return mean.groupBy("label", "sub").agg(F.transform(ordered, lambda s: s["m"]).alias("word"))


def pq_index(spark, sf):
    return flat_index(spark, sf, index_type="IVF_PQ", num_sub_vectors=SUBS, codebooks=rule_codebooks(spark, sf))


@query("pq_build", f"WITH {SLICES} SELECT vec_id, part_id, sub, code FROM codes")
def pq_build(spark, sf):
    return pq_index(spark, sf).postings().select("vec_id", "part_id", F.posexplode("code").alias("sub", "code"))


@query("pq_adc_distance", f"WITH {SLICES}, {ADC0} SELECT vec_id, round(d, 6) AS distance FROM adc")
def pq_adc_distance(spark, sf):
    _, q = first_vector(spark, sf)
    index = pq_index(spark, sf)
    parts = index.centroids().count()
    one = spark.createDataFrame([(0, q)], "_q int, _v array<double>")
    return rounded(index.search_join(one, "_q", "_v", None, nprobes=parts).select("vec_id", se.DISTANCE))


@query("vector_search_refine", f"""WITH {SLICES}, {ADC0}, {PROBES0.format(n=4)},
candidates AS (SELECT vec_id FROM adc WHERE part_id IN (SELECT part_id FROM probes) ORDER BY d, vec_id LIMIT 40)
SELECT e.vec_id, round({L2.format(a="e.embedding", b="q.qv")}, 6) AS distance
FROM embeddings e JOIN candidates c ON e.vec_id = c.vec_id, q
ORDER BY {L2.format(a="e.embedding", b="q.qv")}, e.vec_id LIMIT 10""")
def vector_search_refine(spark, sf):
    table, q = first_vector(spark, sf)
    return rounded(pq_index(spark, sf).search(q, 10, nprobes=4, refine_factor=4, table=table))


@query("ivf_pq_trained_recall")
def ivf_pq_trained_recall(spark, sf):
    table = given(spark, sf, "embeddings")
    queries = table.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"))
    index = ivf.IvfIndex.build(table, work_path(spark, "ivf_pq"), key="vec_id", column="embedding",
                               index_name="idx_pq", index_type="IVF_PQ", num_partitions=4, num_sub_vectors=16, codes=64)
    truth = se.knn_join(queries, "query_id", "qv", table, "vec_id", "embedding", 10)
    found = index.search_join(queries, "query_id", "qv", 10, nprobes=4)
    return se.recall(found, truth, "query_id", "vec_id")


# --- index state ---------------------------------------------------------------------

@query("hot_indexes", control_cte("index_ctl") + """
SELECT index_id, index_name, delta_count FROM index_ctl WHERE status = 'READY' AND delta_count >= 10""")
def hot_indexes(spark, sf):
    return lc.hot_indexes(control_frame(spark, sf, "index_ctl")).select("index_id", "index_name", "delta_count")


@query("index_rebuild_needed", control_cte("index_ctl", coverage="""
  SELECT index_id, CASE WHEN unindexed_rows IS NULL THEN 1.0 ELSE 1000.0 / (1000 + unindexed_rows) END AS coverage,
    status = 'BUILDING' AS damaged FROM index_ctl""") + """
SELECT index_id, CASE WHEN damaged THEN 'REBUILD' WHEN coverage < 0.8 THEN 'OPTIMIZE' ELSE 'NONE' END AS action
FROM coverage""")
def index_rebuild_needed(spark, sf):
    stats = control_frame(spark, sf, "index_ctl").select(
        "index_id",
        F.when(F.col("unindexed_rows").isNull(), 1.0).otherwise(
            F.lit(1000.0) / (1000 + F.col("unindexed_rows"))).alias("coverage"),
        (F.col("status") == "BUILDING").alias("damaged"),
        F.lit("a").alias("params_hash"), F.lit("a").alias("built_params_hash"))
    return lc.rebuild_action(stats).select("index_id", "action")


@query("index_state_transition", """
WITH moves AS (SELECT
  CASE l_returnflag WHEN 'A' THEN 'READY' WHEN 'N' THEN 'BUILDING' ELSE 'OPTIMIZING' END AS from_status,
  CASE l_linenumber WHEN 1 THEN 'READY' WHEN 2 THEN 'OPTIMIZING' WHEN 3 THEN 'MERGING' WHEN 4 THEN 'FAILED'
    WHEN 5 THEN 'DROPPED' ELSE 'BUILDING' END AS to_status FROM lineitem)
SELECT from_status, to_status, count(*) AS violations FROM moves
WHERE NOT (to_status IN ('FAILED', 'DROPPED') OR (from_status = 'READY' AND to_status IN ('OPTIMIZING', 'MERGING'))
  OR (from_status IN ('BUILDING', 'OPTIMIZING') AND to_status = 'READY')) GROUP BY 1, 2""")
def index_state_transition(spark, sf):
    source = F.when(F.col("l_returnflag") == "A", "READY").when(F.col("l_returnflag") == "N", "BUILDING").otherwise(
        "OPTIMIZING")
    target = F.col("l_linenumber")
    to = (F.when(target == 1, "READY").when(target == 2, "OPTIMIZING").when(target == 3, "MERGING")
          .when(target == 4, "FAILED").when(target == 5, "DROPPED").otherwise("BUILDING"))
    moves = given(spark, sf, "lineitem").select(source.alias("from_status"), to.alias("to_status"))
    return lc.illegal_index_moves(moves)


# --- text index ------------------------------------------------------------------------

TERMS = ("le", "the", "und", "de")
TOKENS = """tok AS (SELECT doc_id, len(ws) AS dl, unnest(ws) AS token FROM (
  SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS ws FROM documents)),
postings AS (SELECT token, doc_id, count(*) AS tf, max(dl) AS dl FROM tok GROUP BY token, doc_id)"""


@query("fts_build", f"WITH {TOKENS} SELECT token, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM postings GROUP BY token")
def fts_build(spark, sf):
    index = tx.TextIndex.build(given(spark, sf, "documents"), work_path(spark, "fts"), key="doc_id", column="text")
    return tx.token_stats(index.postings())


def bm25_sql(tables: str) -> str:
    return f"""{tables},
tok AS (SELECT doc_id, len(ws) AS dl, unnest(ws) AS token FROM (
  SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS ws FROM live)),
postings AS (SELECT token, doc_id, count(*) AS tf, max(dl) AS dl FROM tok GROUP BY token, doc_id),
corpus AS (SELECT count(*)::DOUBLE AS n, sum(len(regexp_extract_all(lower(text), '[a-z0-9]+')))::DOUBLE / count(*) AS avg_len
           FROM live),
hits AS (SELECT * FROM postings WHERE token IN {TERMS}),
idf AS (SELECT token, ln(1.0 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM hits, corpus GROUP BY token, n),
scores AS (SELECT doc_id, sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg_len))) AS score
           FROM hits JOIN idf USING (token), corpus GROUP BY doc_id)
SELECT doc_id, round(score, 6) AS score FROM scores ORDER BY score DESC, doc_id LIMIT 25"""


@query("fts_search", bm25_sql("WITH live AS (SELECT * FROM documents)"))
def fts_search(spark, sf):
    index = tx.TextIndex.build(given(spark, sf, "documents"), work_path(spark, "fts"), key="doc_id", column="text")
    return index.search(TERMS, "doc_id", 25).withColumn("score", F.round("score", 6))


def indexed_documents(spark, sf):
    """Documents in two appends with an index of each type after the first; path of the table and of its indexes.

    The files of an append are as many as its size asks for.
    """
    path, root = work_path(spark, "documents"), work_path(spark, "indexes")
    docs = given(spark, sf, "documents")
    tb.write_append(docs.where("doc_id % 4 <> 0").repartition("doc_id"), path, version=1)
    stored = spark.read.parquet(path)
    ic.build_index(stored, f"{root}/text", index_type="FTS", key="doc_id", column="text", index_name="idx_text")
    for column in ("lang", "source"):
        ic.build_index(stored, f"{root}/{column}", index_type="BITMAP", key="doc_id", column=column, index_name=f"idx_{column}")
    tb.write_append(docs.where("doc_id % 4 = 0").repartition("doc_id"), path, version=2)
    return path, root


def followed_documents(spark, sf):
    """:func:`indexed_documents`, then a delete of French rows of the first append."""
    path, root = indexed_documents(spark, sf)
    up.delete_from_table(spark, path, tb.VERSION, "lang = 'fr' AND ingest_version = 1")
    return spark.read.parquet(path), root


LIVE_DOCUMENTS = """WITH live AS (SELECT *, CASE WHEN doc_id % 4 = 0 THEN 2 ELSE 1 END AS version FROM documents
  WHERE doc_id % 4 = 0 OR lang IS NULL OR lang <> 'fr')"""


@query("fts_search_mixed", bm25_sql(LIVE_DOCUMENTS))
def fts_search_mixed(spark, sf):
    """Rows that no segment has read count, deleted ones don't."""
    table, root = followed_documents(spark, sf)
    index = ic.open_index(spark, f"{root}/text")
    return index.search(TERMS, "doc_id", 25, table).withColumn("score", F.round("score", 6))


@query("fts_search_merged", bm25_sql(LIVE_DOCUMENTS))
def fts_search_merged(spark, sf):
    """After optimize and merge the segments alone give the live table's ranking."""
    table, root = followed_documents(spark, sf)
    ic.optimize_all(table, root)
    ic.merge_all(table, root)
    return ic.open_index(spark, f"{root}/text").search(TERMS, "doc_id", 25).withColumn("score", F.round("score", 6))


@query("fts_search_pruned", bm25_sql(LIVE_DOCUMENTS))
def fts_search_pruned(spark, sf):
    """A small first pass, so that postings without influence are skipped; the ranking is that of all postings."""
    table, root = followed_documents(spark, sf)
    ic.optimize_all(table, root)
    index = ic.open_index(spark, f"{root}/text")
    return index.search(TERMS, "doc_id", 25, table, seed_rows=100).withColumn("score", F.round("score", 6))


@query("index_optimize_all", LIVE_DOCUMENTS + """
SELECT name AS index_name, kind AS index_type, (SELECT count(*) FROM live) AS rows, 2::BIGINT AS covered_version
FROM (VALUES ('idx_lang', 'BITMAP'), ('idx_source', 'BITMAP'), ('idx_text', 'FTS')) AS t(name, kind)""")
def index_optimize_all(spark, sf):
    """The delete rewrote the first append, so all live rows are new to every index."""
    table, root = followed_documents(spark, sf)
    return ic.optimize_all(table, root)


@query("index_health", """
WITH c AS (SELECT count(*) FILTER (doc_id % 4 <> 0) / count(*)::DOUBLE AS coverage FROM documents)
SELECT name AS index_name, kind AS index_type, round(coverage, 6) AS coverage, damaged,
  CASE WHEN damaged OR changed THEN 'REBUILD' WHEN coverage < 0.8 THEN 'OPTIMIZE' ELSE 'NONE' END AS action
FROM c, (VALUES ('idx_lang', 'BITMAP', false, false), ('idx_source', 'BITMAP', true, false),
  ('idx_text', 'FTS', false, true)) AS t(name, kind, damaged, changed)""")
def index_health(spark, sf):
    """Three indexes that have read the first append: one is sound, one lost its postings, one is asked for with other buckets."""
    path, root = indexed_documents(spark, sf)
    delete_path(spark, f"{root}/source/postings/gen=0/delta_id=0")
    found = ix.health_all(spark.read.parquet(path), root, {"idx_text": {"buckets": 128}})
    return lc.rebuild_action(found).select("index_name", "index_type", F.round("coverage", 6).alias("coverage"), "damaged", "action")


# --- scalar indexes ----------------------------------------------------------------------

LOW, HIGH = "1997-01-01 00:00:00", "1997-06-30 00:00:00"
SORTED_FILES = 8


def sorted_lines(spark, sf):
    lines = given(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    return si.SortedIndex.build(lines, work_path(spark, "btree"), column="l_shipdate", key="l_orderkey",
                                files=SORTED_FILES)


@query("btree_build", """
SELECT count(*) AS row_count, min(l_shipdate) AS low, max(l_shipdate) AS high, true AS in_order FROM lineitem""")
def btree_build(spark, sf):
    """In sorted files only a value at a file's edge can stand in the next file too."""
    per_value = sorted_lines(spark, sf).rows().groupBy("l_shipdate", F.col("_metadata.file_path")).agg(
        F.count(F.lit(1)).alias("n")).groupBy("l_shipdate").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("files"))
    return per_value.agg(
        F.sum("n").alias("row_count"), F.min("l_shipdate").alias("low"), F.max("l_shipdate").alias("high"),
        (F.sum(F.col("files") - 1) < SORTED_FILES).alias("in_order"))


@query("btree_lookup", f"""
SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem
WHERE l_shipdate BETWEEN timestamp '{LOW}' AND timestamp '{HIGH}'""")
def btree_lookup(spark, sf):
    low, high = (F.lit(x).cast("timestamp_ntz") for x in (LOW, HIGH))
    return sorted_lines(spark, sf).lookup(low, high)


@query("bitmap_build", "SELECT event_type, count(*) AS row_count FROM events GROUP BY event_type")
def bitmap_build(spark, sf):
    index = bm.BitmapIndex.build(given(spark, sf, "events"), work_path(spark, "bitmap"), column="event_type")
    return index.counts().withColumnRenamed("value", "event_type")


@query("bitmap_lookup", "SELECT event_id AS row_id FROM events WHERE event_type IN ('error', 'signup')")
def bitmap_lookup(spark, sf):
    events = given(spark, sf, "events")
    index = bm.BitmapIndex.build(events, work_path(spark, "bitmap"), column="event_type")
    return bm.lookup(events, [bm.OneOf(index, ["error", "signup"])]).select(F.col("event_id").alias("row_id"))


@query("bitmap_lookup_multi", LIVE_DOCUMENTS + """
SELECT doc_id, lang, source FROM live
WHERE (lang IN ('en', 'de') OR source = (SELECT min(source) FROM documents)) AND source <> (SELECT max(source) FROM documents)""")
def bitmap_lookup_multi(spark, sf):
    """AND, OR and NOT over two indexes of a table that was appended to and deleted from, half of it indexed anew."""
    table, root = followed_documents(spark, sf)
    lang, source = (ic.open_index(spark, f"{root}/{c}") for c in ("lang", "source"))
    lang.optimize(table)  # the other index still lags behind: its missing files are filtered as they are read
    low, high = given(spark, sf, "documents").agg(F.min("source"), F.max("source")).first()
    clauses = [bm.OneOf(lang, ["en", "de"]), bm.OneOf(source, [low])], [bm.OneOf(source, [high], negate=True)]
    found = bm.lookup(table, *clauses)
    source.optimize(table)
    again = bm.lookup(table, *clauses)  # from containers alone
    return found.select("doc_id", "lang", "source").intersectAll(again.select("doc_id", "lang", "source"))
