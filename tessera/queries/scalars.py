"""One query per family of scalar functions."""

from pyspark.sql import functions as F

from tessera.functions import scalars as sc
from tessera.operators.upkeep import COMPACTION_KEYS
from tessera.queries import given, query
from tessera.sources.control import CLOCK, control_cte, control_frame


@query("scalar_dates", """
SELECT event_id, strftime(ts, '%Y%m%d') AS day_bucket, strftime(ts, '%Y%m%d%H') AS hour_bucket,
  CASE WHEN event_type = 'error' THEN '' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' END AS iso,
  date_trunc('second', ts) - INTERVAL 30 DAY AS cutoff,
  round(epoch_us(TIMESTAMP '2024-01-31 00:00:00' - ts) / 1000000.0, 6) AS age_seconds FROM events""")
def scalar_dates(spark, sf):
    stamp = F.when(F.col("event_type") != "error", F.col("ts"))
    return given(spark, sf, "events").select(
        "event_id", sc.day_bucket("ts").alias("day_bucket"), sc.hour_bucket("ts").alias("hour_bucket"),
        sc.iso_utc(stamp).alias("iso"), sc.days_before(F.col("ts"), 30).alias("cutoff"),
        F.round(sc.seconds_between("ts", sc.ts(CLOCK)), 6).alias("age_seconds"))


@query("scalar_strings", """
SELECT doc_id, concat('t1:doc:', doc_id) AS doc_key, length(substr(text, 1, 2048)) AS kept,
  trim(lang) = '' AS blank, lower(source) = 'src1' AS same_source, sha256(text) AS checksum FROM documents""")
def scalar_strings(spark, sf):
    return given(spark, sf, "documents").select(
        "doc_id", sc.compose_key("t1", "doc", F.col("doc_id")).alias("doc_key"),
        F.length(sc.truncated("text")).cast("long").alias("kept"), sc.is_blank("lang").alias("blank"),
        (F.lower("source") == "src1").alias("same_source"), F.sha2("text", 256).alias("checksum"))


@query("scalar_math", """
SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN '0' ELSE CAST(CAST(c_acctbal AS DECIMAL(38,4)) AS VARCHAR) END AS fixed,
  greatest(c_acctbal, 0) AS clamped, round(c_custkey / greatest(CAST(c_nationkey AS DOUBLE), 0.001), 6) AS share,
  TRY_CAST(CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE CAST(c_custkey AS VARCHAR) END AS BIGINT) AS int_or_null
FROM customer""")
def scalar_math(spark, sf):
    text = F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).otherwise(F.col("c_custkey").cast("string"))
    return given(spark, sf, "customer").select(
        "c_custkey", sc.fixed_decimal(F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal"))).alias("fixed"),
        sc.clamp_low("c_acctbal", 0.0).alias("clamped"),
        F.round(sc.ratio(F.col("c_custkey"), F.col("c_nationkey")), 6).alias("share"),
        sc.int_or_null(text).alias("int_or_null"))


@query("scalar_maps", """
SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'target_rows_per_fragment=' || p_size ELSE '' END AS known,
  CASE WHEN p_size % 2 = 0 THEN 'brand' ELSE 'brand,window' END AS ignored FROM part""")
def scalar_maps(spark, sf):
    name = F.when(F.col("p_size") % 2 == 0, "target_rows_per_fragment").otherwise("window")
    rows = given(spark, sf, "part").select(
        "p_partkey", F.create_map(name, F.col("p_size").cast("string"), F.lit("brand"), F.col("p_brand")).alias("m"))
    return rows.select("p_partkey", sc.map_text(sc.known_keys("m", COMPACTION_KEYS)).alias("known"),
                       F.array_join(sc.ignored_keys("m", COMPACTION_KEYS), ",").alias("ignored"))


@query("scalar_json", control_cte("rule_ctl") + """
SELECT rule_id, coalesce(extra->>'$.index_config.index_type', 'IVF_PQ') AS index_type,
  coalesce(extra->>'$.concat_separator', ' ') AS separator FROM rule_ctl""")
def scalar_json(spark, sf):
    return control_frame(spark, sf, "rule_ctl").select(
        "rule_id", sc.json_or("extra", "$.index_config.index_type", "IVF_PQ").alias("index_type"),
        sc.json_or("extra", "$.concat_separator", " ").alias("separator"))


@query("scalar_arrays", """
SELECT vec_id, CAST(len(embedding) AS INT) AS dim, round(CAST(embedding[2] AS DOUBLE), 6) AS second,
  len([x FOR x IN embedding IF x > 0]) AS positive FROM embeddings""")
def scalar_arrays(spark, sf):
    return given(spark, sf, "embeddings").select(
        "vec_id", F.size("embedding").alias("dim"), F.round(F.element_at("embedding", 2).cast("double"), 6).alias("second"),
        F.size(F.filter("embedding", lambda x: x > 0)).cast("long").alias("positive"))
