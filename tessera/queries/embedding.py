"""Text-to-vector queries; vectors are compared through a few rounded values."""

from pyspark.sql import functions as F

from tessera.functions.hashing import hash_embedding, hash_embedding_expr
from tessera.operators import embedding as em
from tessera.queries import given, query
from tessera.session import work_path
from tessera.sources.control import control_cte, control_frame


def hash_value(text: str, position: int) -> str:
    """SQL for one value (1-based) of the hash vector of a text expression."""
    counter, word = divmod(position - 1, 8)
    digest = f"sha256(encode({text}) || unhex('{counter:08x}'))"
    return (f"round(CAST((('0x' || substr({digest}, {8 * word + 1}, 8))::BIGINT::DOUBLE - 2147483647.5) / 2147483647.5"
            f" AS FLOAT)::DOUBLE, 6)")


def picked(vector: str, **positions: int):
    return [F.round(F.col(vector)[p - 1].cast("double"), 6).alias(n) for n, p in positions.items()]


POSITIONS = {"v1": 1, "v8": 8, "v9": 9, "v384": 384}


def picked_sql(text: str, positions=POSITIONS) -> str:
    return ", ".join(f"{hash_value(text, p)} AS {n}" for n, p in positions.items())


@query("concat_sources", """
SELECT conv_id, turn, concat_ws(' ', role, CASE WHEN turn = 0 THEN NULL ELSE text END) AS joined FROM conversations""")
def concat_sources(spark, sf):
    rows = given(spark, sf, "conversations").withColumn("text", F.when(F.col("turn") != 0, F.col("text")))
    return rows.select("conv_id", "turn", em.concat_sources(rows, ["role", "text"]).alias("joined"))


@query("concat_sources_cast", """
SELECT p_partkey, concat_ws(' ', p_name, CAST(p_size AS VARCHAR), p_brand) AS joined FROM part""")
def concat_sources_cast(spark, sf):
    return given(spark, sf, "part").select("p_partkey", em.concat_sources_cast(["p_name", "p_size", "p_brand"]).alias("joined"))


@query("hash_embedding", f"SELECT doc_id, CAST(384 AS INT) AS dim, {picked_sql('text')} FROM documents")
def hash_embedding_query(spark, sf):
    rows = given(spark, sf, "documents").select("doc_id", hash_embedding("text").alias("v"))
    return rows.select("doc_id", F.size("v").alias("dim"), *picked("v", **POSITIONS))


@query("hash_embedding_builtin", f"SELECT p_partkey, {picked_sql('p_name', {'v1': 1, 'v16': 16})} FROM part")
def hash_embedding_builtin(spark, sf):
    rows = given(spark, sf, "part").select("p_partkey", hash_embedding_expr(F.col("p_name"), 16).alias("v"))
    return rows.select("p_partkey", *picked("v", v1=1, v16=16))


def half_embedded(spark, sf):
    """Documents where English rows already carry the hash vector of their source."""
    docs = given(spark, sf, "documents").select("doc_id", "text", "lang", "source")
    done = F.when(F.col("lang") == "en", F.col("source"))
    return docs.withColumn("vec", hash_embedding(done, 16))


HALF = {"v1": 1, "v16": 16}


@query("embed_incremental", f"""
SELECT doc_id, {picked_sql("CASE WHEN lang = 'en' THEN source ELSE concat_ws(' ', source, text) END", HALF)} FROM documents""")
def embed_incremental(spark, sf):
    rows = em.embed_incremental(half_embedded(spark, sf), ["source", "text"], "vec", em.hash_encoder(16))
    return rows.select("doc_id", *picked("vec", **HALF))


@query("embed_full", f"SELECT doc_id, {picked_sql('concat_ws(chr(10), source, text)', HALF)} FROM documents")
def embed_full(spark, sf):
    rows = em.embed_full(half_embedded(spark, sf), ["source", "text"], "vec", em.hash_encoder(16), separator="\n")
    return rows.select("doc_id", *picked("vec", **HALF))


@query("vectorize_table", """
SELECT lang, count(*) AS row_count, count(*) AS embedded FROM documents GROUP BY lang""")
def vectorize_table(spark, sf):
    """A stored table, filled in place: only partitions with open rows are rewritten."""
    path = work_path(spark, "vectorize")
    half_embedded(spark, sf).write.partitionBy("lang").parquet(path)
    em.embed_table(spark.read.parquet(path), path, "lang", ["source", "text"], "vec", em.hash_encoder(16))
    return spark.read.parquet(path).groupBy("lang").agg(
        F.count(F.lit(1)).alias("row_count"), F.count("vec").alias("embedded"))


@query("vector_writeback_join", f"""
SELECT d.doc_id, CASE WHEN l.quality = 1 THEN {hash_value("d.text", 1)} END AS v1
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def vector_writeback_join(spark, sf):
    docs = given(spark, sf, "documents").select("doc_id", "text")
    good = given(spark, sf, "labels").where("quality = 1").select("doc_id")
    computed = docs.join(good, "doc_id", "left_semi").select("doc_id", hash_embedding("text", 8).alias("vec"))
    return em.write_back(docs.select("doc_id"), computed, "doc_id", "vec").select("doc_id", *picked("vec", v1=1))


def load_counts_model():
    """A stand-in encoder: length of the text and number of its spaces."""
    return lambda texts: [[float(len(t)), float(t.count(" "))] for t in texts]


@query("model_embedding", """
SELECT doc_id, CAST(length(text) AS DOUBLE) AS n_chars,
  CAST(length(text) - length(replace(text, ' ', '')) AS DOUBLE) AS n_spaces FROM documents""")
def model_embedding(spark, sf):
    docs = given(spark, sf, "documents").select("doc_id", "text")
    rows = em.with_model(docs, F.col("text"), "vec", "counts", load_counts_model)
    return rows.select("doc_id", F.col("vec")[0].cast("double").alias("n_chars"), F.col("vec")[1].cast("double").alias("n_spaces"))


def counting_post(payload, headers):
    """A stand-in endpoint; it refuses a batch with a text of more than 20,000 characters."""
    if any(len(t) > 20_000 for t in payload["input"]):
        raise ValueError("input too long")
    return {"data": [{"embedding": [float(len(t))]} for t in payload["input"]]}


def endpoint_rows(spark, sf):
    docs = given(spark, sf, "documents").select("doc_id", "text")
    return em.with_endpoint(docs, F.col("text"), "result", counting_post, "counts", batch_size=1,
                            headers=em.auth_headers("key"))


@query("endpoint_embedding", """
SELECT doc_id, CASE WHEN length(text) <= 20000 THEN CAST(length(text) AS DOUBLE) END AS value,
  CASE WHEN length(text) > 20000 THEN 'ValueError: input too long' END AS error FROM documents""")
def endpoint_embedding(spark, sf):
    return endpoint_rows(spark, sf).select("doc_id", F.col("result.vector")[0].cast("double").alias("value"),
                                           F.col("result.error").alias("error"))


@query("embed_batch_summary", """
SELECT count(*) FILTER (length(text) <= 20000) AS succeeded, count(*) FILTER (length(text) > 20000) AS failed,
  count(*) AS total_unvectorized, count(DISTINCT doc_id // 64) AS batches FROM documents""")
def embed_batch_summary(spark, sf):
    return em.embed_summary(endpoint_rows(spark, sf), "result", F.floor(F.col("doc_id") / 64))


def items(spark, sf):
    """Documents as text items and pages as URI items; an empty page address has no payload."""
    docs = given(spark, sf, "documents").select(
        F.concat(F.lit("d"), "doc_id").alias("id"),
        F.struct(F.lit("TEXT").alias("modality"), F.col("text"), F.lit(None).cast("binary").alias("binary"),
                 F.lit(None).cast("string").alias("uri")).alias("payload"))
    pages = given(spark, sf, "pages").select(
        F.concat(F.lit("p"), "page_id").alias("id"),
        F.struct(F.lit("IMAGE").alias("modality"), F.lit(None).cast("string").alias("text"),
                 F.lit(None).cast("binary").alias("binary"),
                 F.when(F.col("url").startswith("https"), F.col("url")).alias("uri")).alias("payload"))
    return docs.unionByName(pages)


ITEMS = """WITH items AS (
  SELECT concat('d', doc_id) AS id, 'TEXT' AS modality, text, NULL AS uri FROM documents
  UNION ALL SELECT concat('p', page_id), 'IMAGE', NULL, CASE WHEN starts_with(url, 'https') THEN url END FROM pages)
"""


@query("modality_route", ITEMS + """
SELECT id, modality, CASE WHEN modality = 'TEXT' THEN NULL WHEN uri IS NULL THEN 'EMPTY_PAYLOAD'
  ELSE 'UNSUPPORTED_MODALITY' END AS error_code FROM items""")
def modality_route(spark, sf):
    return em.embed_items(items(spark, sf), 8).select("id", "modality", "error_code")


@query("embed_item_errors", ITEMS + """
SELECT modality, count(*) FILTER (modality = 'TEXT') AS succeeded, count(*) FILTER (modality <> 'TEXT') AS failed
FROM items GROUP BY modality""")
def embed_item_errors(spark, sf):
    done = F.col("values").isNotNull()
    return em.embed_items(items(spark, sf), 8).groupBy("modality").agg(
        F.count_if(done).alias("succeeded"), F.count_if(~done).alias("failed"))


@query("auto_index_request", control_cte("rule_ctl", "index_ctl", asked="""
  SELECT dataset_uuid, coalesce(extra->>'$.index_config.index_name', concat('idx_', target_column)) AS index_name,
    target_column AS column_name, coalesce(extra->>'$.index_config.index_type', 'IVF_PQ') AS index_type
  FROM rule_ctl WHERE extra->>'$.index_config.auto_build' = 'true'""", one="""
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset_uuid, index_name ORDER BY column_name, index_type) AS rn
  FROM asked) WHERE rn = 1""", taken="""
  SELECT dataset_uuid, concat('idx_vec_', index_id % 7) AS index_name FROM index_ctl""") + """
SELECT o.dataset_uuid, o.index_name, o.column_name, o.index_type, 'BUILDING' AS status
FROM one o ANTI JOIN taken t ON t.dataset_uuid = o.dataset_uuid AND t.index_name = o.index_name""")
def auto_index_request(spark, sf):
    indexes = control_frame(spark, sf, "index_ctl").withColumn(
        "index_name", F.concat(F.lit("idx_vec_"), F.col("index_id") % 7))
    return em.auto_index_requests(control_frame(spark, sf, "rule_ctl"), indexes)


@query("rule_validation", control_cte("rule_ctl") + """
SELECT rule_id, 'cron_missing' AS violation FROM rule_ctl WHERE trigger_type = 'SCHEDULED' AND coalesce(cron_expr, '') = ''
UNION ALL SELECT rule_id, 'blank_source' FROM rule_ctl WHERE trim(source_column) = ''
UNION ALL SELECT rule_id, 'duplicate_target' FROM rule_ctl WHERE (dataset_uuid, target_column) IN (
  SELECT (dataset_uuid, target_column) FROM rule_ctl GROUP BY dataset_uuid, target_column HAVING count(*) > 1)""")
def rule_validation(spark, sf):
    return em.rule_violations(control_frame(spark, sf, "rule_ctl").withColumn("source_columns", F.array("source_column")))
