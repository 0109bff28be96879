"""Scans, versions, writes and reshaping of stored tables."""

from pyspark.sql import functions as F

from tessera.queries import given, query
from tessera.session import work_path
from tessera.sources import tables as tb


@query("scan_dataset", "SELECT * FROM orders")
def scan_dataset(spark, sf):
    return tb.scan(spark, f"{sf}/orders.parquet")


@query("scan_projected", """
SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem WHERE l_shipdate >= timestamp '2000-01-01 00:00:00'""")
def scan_projected(spark, sf):
    return tb.scan(spark, f"{sf}/lineitem.parquet", ["l_orderkey", "l_linenumber", "l_shipdate"],
                   "l_shipdate >= timestamp_ntz '2000-01-01 00:00:00'")


@query("count_rows", "SELECT count(*) AS row_count FROM lineitem")
def count_rows(spark, sf):
    return tb.count_rows(given(spark, sf, "lineitem"))


def versioned_orders(spark, sf, name):
    """Orders stored as a table with one version per order year."""
    path = work_path(spark, name)
    orders = given(spark, sf, "orders").withColumn(tb.VERSION, F.year("o_orderdate") - 1994)
    tb.write_overwrite(orders, path)
    return path


@query("dataset_version", """
SELECT year(o_orderdate) - 1994 AS version, count(*) AS row_count,
  year(o_orderdate) = (SELECT max(year(o_orderdate)) FROM orders) AS is_latest
FROM orders GROUP BY year(o_orderdate)""")
def dataset_version(spark, sf):
    path = versioned_orders(spark, sf, "versions")
    latest = tb.latest_version(spark, path)
    summary = tb.version_summary(spark.read.parquet(path))
    return summary.select(F.col(tb.VERSION).cast("long").alias("version"), "row_count",
                          (F.col(tb.VERSION) == latest).alias("is_latest"))


@query("write_append", """
SELECT CASE WHEN o_orderstatus = 'P' THEN 2 ELSE 1 END AS version, count(*) AS row_count,
  round(sum(o_totalprice), 2) AS total
FROM orders GROUP BY 1""")
def write_append(spark, sf):
    path, orders = work_path(spark, "append"), given(spark, sf, "orders")
    tb.write_append(orders.where("o_orderstatus <> 'P'"), path, version=1)
    tb.write_append(orders.where("o_orderstatus = 'P'"), path, version=2)
    return spark.read.parquet(path).groupBy(F.col(tb.VERSION).alias("version")).agg(
        F.count(F.lit(1)).alias("row_count"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("write_overwrite", """
SELECT o_orderstatus AS status, count(*) AS row_count FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1""")
def write_overwrite(spark, sf):
    path, orders = work_path(spark, "overwrite"), given(spark, sf, "orders")
    tb.write_overwrite(orders, path, version=1)
    tb.write_overwrite(orders.where("o_orderstatus <> 'F'"), path, version=2)
    return spark.read.parquet(path).groupBy(F.col("o_orderstatus").alias("status")).agg(
        F.count(F.lit(1)).alias("row_count"))


@query("write_merge", """
WITH old AS (SELECT o_orderkey, o_totalprice, o_orderstatus, year(o_orderdate) AS order_year FROM orders
             WHERE o_orderdate < timestamp '2000-01-01 00:00:00'),
new AS (SELECT o_orderkey, o_totalprice + 1 AS o_totalprice, 'M' AS o_orderstatus, year(o_orderdate) AS order_year
        FROM orders WHERE o_orderdate >= timestamp '1999-01-01 00:00:00')
SELECT o_orderkey, round(o_totalprice, 2) AS o_totalprice, o_orderstatus, CAST(order_year AS INT) AS order_year FROM new
UNION ALL
SELECT o_orderkey, round(o_totalprice, 2), o_orderstatus, CAST(order_year AS INT) FROM old
WHERE o_orderkey NOT IN (SELECT o_orderkey FROM new)""")
def write_merge(spark, sf):
    path = work_path(spark, "merge")
    orders = given(spark, sf, "orders").withColumn("order_year", F.year("o_orderdate"))
    columns = ["o_orderkey", "o_totalprice", "o_orderstatus", "order_year"]
    old = orders.where("o_orderdate < timestamp_ntz '2000-01-01 00:00:00'").select(*columns)
    new = orders.where("o_orderdate >= timestamp_ntz '1999-01-01 00:00:00'").withColumns(
        {"o_totalprice": F.col("o_totalprice") + 1, "o_orderstatus": F.lit("M")}).select(*columns)
    tb.write_overwrite(old, path, partition_by=("order_year",))
    tb.merge_into(spark, path, new, "o_orderkey", "order_year")
    return spark.read.parquet(path).withColumn("o_totalprice", F.round("o_totalprice", 2))


@query("write_dedupe", """
WITH batches AS (SELECT event_id, ts, value, concat('c', event_id % 900) AS batch_checksum FROM events),
log AS (SELECT DISTINCT concat('c', o_custkey) AS batch_checksum FROM orders WHERE o_orderstatus = 'P'),
fresh AS (SELECT * FROM batches WHERE batch_checksum NOT IN (SELECT batch_checksum FROM log))
SELECT event_id, value, batch_checksum FROM (
  SELECT *, row_number() OVER (PARTITION BY batch_checksum ORDER BY ts, event_id) AS rn FROM fresh) WHERE rn = 1""")
def write_dedupe(spark, sf):
    batches = given(spark, sf, "events").select(
        "event_id", "ts", "value", F.concat(F.lit("c"), F.col("event_id") % 900).alias("batch_checksum"))
    log = given(spark, sf, "orders").where("o_orderstatus = 'P'").select(
        F.concat(F.lit("c"), "o_custkey").alias("batch_checksum"))
    return tb.drop_seen_batches(batches, "batch_checksum", ["ts", "event_id"], log).drop("ts")


@query("json_rows_to_columns", """
SELECT vec_id, label, CAST(len(embedding) AS INT) AS dim, round(CAST(embedding[1] AS DOUBLE), 6) AS first_value,
  true AS other_missing
FROM embeddings""")
def json_rows_to_columns(spark, sf):
    rows = given(spark, sf, "embeddings").select(
        F.to_json(F.struct("vec_id", "label")).alias("scalar_fields_json"),
        F.create_map(F.lit("embedding"), F.col("embedding")).alias("vectors"))
    flat = tb.json_rows_to_columns(rows, "scalar_fields_json", "vec_id long, label int", "vectors",
                                   ["embedding", "other"])
    return flat.select("vec_id", "label", F.size("embedding").alias("dim"),
                       F.round(F.col("embedding")[0].cast("double"), 6).alias("first_value"),
                       F.col("other").isNull().alias("other_missing"))


@query("add_column_sql", """
SELECT o_orderkey, round(o_totalprice * 0.1, 4) AS tax, CAST(year(o_orderdate) AS INT) AS order_year FROM orders""")
def add_column_sql(spark, sf):
    wide = tb.add_columns(given(spark, sf, "orders"),
                          {"tax": "round(o_totalprice * 0.1, 4)", "order_year": "year(o_orderdate)"})
    return wide.select("o_orderkey", "tax", "order_year")


@query("add_column_batch", """
SELECT doc_id, CAST(length(text) AS BIGINT) AS text_length, CAST(length(lang) AS BIGINT) AS lang_length
FROM documents""")
def add_column_batch(spark, sf):
    docs = given(spark, sf, "documents").select("doc_id", "text", "lang")

    def lengths(batches):
        for batch in batches:
            yield batch[["doc_id"]].assign(text_length=batch["text"].str.len(), lang_length=batch["lang"].str.len())

    return docs.mapInPandas(lengths, "doc_id long, text_length long, lang_length long")


@query("filter_sql", """
SELECT event_id, event_type, value FROM events WHERE event_type IN ('error', 'purchase') AND value > 20""")
def filter_sql(spark, sf):
    predicate = "event_type IN ('error', 'purchase') AND value > 20"
    return tb.scan(spark, f"{sf}/events.parquet", ["event_id", "event_type", "value"], predicate)


@query("select_columns", "SELECT p_partkey, p_name, p_size FROM part")
def select_columns(spark, sf):
    return tb.select_columns(given(spark, sf, "part"), ["p_partkey", "p_name", "p_size"])
