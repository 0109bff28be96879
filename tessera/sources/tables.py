"""Parquet tables partitioned by ``ingest_version`` or another small partition column.

A write batch is one partition value, so the latest version of a table is known
from directory names, and a change rewrites only the partitions it touches.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

from tessera.sources.paths import NULL_PARTITION, drop_partitions, make_path, partition_dirs, partition_values

VERSION = "ingest_version"


# --- reading -----------------------------------------------------------------

def scan(spark: SparkSession, path: str, columns: Sequence[str] | None = None,
         predicate: str | None = None) -> DataFrame:
    """Open the table; only the named columns and matching rows reach the plan."""
    df = spark.read.parquet(path)
    if predicate is not None:
        df = df.where(F.expr(predicate))
    return df if columns is None else select_columns(df, columns)


def stored(spark: SparkSession, path: str, partition_col: str) -> DataFrame:
    """The table with ``partition_col`` as its directories spell it: ``01`` stays ``'01'`` and is not the number 1."""
    fields = [T.StructField(f.name, T.StringType() if f.name == partition_col else f.dataType)
              for f in spark.read.parquet(path).schema]
    return spark.read.schema(T.StructType(fields)).parquet(path)


def among(column: Column, values: Sequence) -> Column:
    """``column`` is one of ``values``; None among them stands for NULL."""
    hit = F.coalesce(column.isin([v for v in values if v is not None]), F.lit(False))
    return hit | column.isNull() if None in values else column.isin(list(values))


def select_columns(df: DataFrame, columns: Sequence[str] | None) -> DataFrame:
    """``None`` keeps every column; an unknown name fails before any job starts."""
    if columns is None:
        return df
    require_columns(df, columns)
    return df.select(*columns)


def require_columns(df: DataFrame, columns: Sequence[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}; available: {sorted(df.columns)}")


def require_string_columns(df: DataFrame, columns: Sequence[str]) -> None:
    require_columns(df, columns)
    wrong = [c for c in columns if not isinstance(df.schema[c].dataType, T.StringType)]
    if wrong:
        kinds = {c: df.schema[c].dataType.simpleString() for c in wrong}
        raise ValueError(f"columns must be strings: {kinds}")


def count_rows(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("row_count"))


def latest_version(spark: SparkSession, path: str) -> int | None:
    """Newest version from directory names; no data file is opened."""
    versions = [int(v) for v in partition_values(spark, path, VERSION)]
    return max(versions, default=None)


def version_summary(df: DataFrame) -> DataFrame:
    """Rows per version; reads the partition column only, so no data page is decoded."""
    return df.groupBy(VERSION).agg(F.count(F.lit(1)).alias("row_count"))


# --- writing -----------------------------------------------------------------

def write_append(df: DataFrame, path: str, version: int | None = None,
                 partition_by: Sequence[str] = (VERSION,)) -> None:
    if version is not None:
        df = df.withColumn(VERSION, F.lit(version))
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def write_overwrite(df: DataFrame, path: str, version: int | None = None,
                    partition_by: Sequence[str] = (VERSION,)) -> None:
    if version is not None:
        df = df.withColumn(VERSION, F.lit(version))
    (df.write.mode("overwrite").option("partitionOverwriteMode", "static")
       .partitionBy(*partition_by).parquet(path))


def replace_partitions(df: DataFrame, path: str, partition_col: str, touched: Sequence) -> int:
    """Replace the ``touched`` partitions by the rows of ``df``; return rows written.

    Dynamic overwrite stages the new files and swaps them in at job commit, so
    ``df`` may read the very partitions it replaces. A touched partition with
    no row left would survive such a write; it is dropped afterwards. ``touched``
    holds stored values as their directories spell them (None for NULL); a value
    without a directory is refused before anything is written.
    """
    spark = df.sparkSession
    replaced = {NULL_PARTITION if v is None else v for v in touched}
    unknown = sorted(replaced - set(partition_dirs(spark, path, partition_col)))
    if unknown:
        raise ValueError(f"no directory of {partition_col} has the values {unknown}; read the table with stored()")
    seen = Observation()
    observed = df.withColumn(partition_col, F.col(partition_col).cast("string")).observe(
        seen,
        F.count(F.lit(1)).alias("rows"),
        F.collect_set(F.coalesce(F.col(partition_col), F.lit(NULL_PARTITION))).alias("parts"),
    )
    (observed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy(partition_col).parquet(path))
    metrics = seen.get
    drop_partitions(spark, path, partition_col, replaced - set(metrics["parts"]))
    return metrics["rows"]


def merge_rows(old: DataFrame, new: DataFrame, key: str, order_by: str | None = None) -> DataFrame:
    """Upsert by ``key``, one row per key of ``new``.

    Rows of ``new`` win; with ``order_by`` the newest row per key wins, the stored one
    included, and at equal order the new one. Copies of equal order within ``new`` are
    settled by a hash of the row, so a second run chooses alike.
    """
    plain = [f.name for f in new.schema if "map<" not in f.dataType.simpleString()]
    tie = F.xxhash64(*plain)
    order = tie if order_by is None else F.struct(F.col(order_by), tie)
    new = new.groupBy(key).agg(F.max_by(F.struct(*new.columns), order).alias("_row")).select("_row.*")
    if order_by is not None and order_by in old.columns:
        arriving = new.select(key, F.col(order_by).alias("_arriving"))
        later = F.col(order_by).isNotNull() & (F.col("_arriving").isNull() | (F.col(order_by) > F.col("_arriving")))
        overtaken = old.join(arriving, key).where(later).select(key)
        new = new.join(overtaken, key, "left_anti").select(*new.columns)
    kept = old.join(new.select(key), key, "left_anti").select(*old.columns)
    return kept.unionByName(new, allowMissingColumns=True)


def merge_into(spark: SparkSession, path: str, new: DataFrame, key: str, partition_col: str,
               order_by: str | None = None) -> int:
    """Upsert into a partitioned table, rewriting only partitions that hold or gain a key.

    A table without data files yet has the schema of ``new``.
    """
    new = new.withColumn(partition_col, F.col(partition_col).cast("string"))
    here = set(partition_values(spark, path, partition_col))
    if here:
        table = stored(spark, path, partition_col)
    else:
        make_path(spark, path)
        table = spark.read.schema(new.schema).parquet(path)
    holding = table.join(new.select(key), key, "left_semi").select(partition_col)
    touched = [r[0] for r in holding.union(new.select(partition_col)).distinct().collect()]
    old = table.where(among(F.col(partition_col), touched))
    replaced = [v for v in touched if (NULL_PARTITION if v is None else v) in here]
    return replace_partitions(merge_rows(old, new, key, order_by), path, partition_col, replaced)


def drop_seen_batches(batches: DataFrame, checksum: str, order_by: Sequence[str],
                      log: DataFrame | None = None) -> DataFrame:
    """Keep the first batch per checksum, and none whose checksum the log holds.

    The first is found by an aggregate with a map-side combine, so a checksum
    repeated in a third of all batches still reaches its reducer as a few rows.
    """
    if log is not None:
        batches = batches.join(log.select(checksum), checksum, "left_anti")
    first = F.min_by(F.struct(*batches.columns), F.struct(*order_by))
    return batches.groupBy(checksum).agg(first.alias("_row")).select("_row.*")


def json_rows_to_columns(df: DataFrame, json_col: str, schema: T.StructType | str,
                         vectors_col: str, vector_names: Sequence[str]) -> DataFrame:
    """Flatten JSON scalars and a map of named vectors into plain columns."""
    parsed = df.withColumn("_scalars", F.from_json(json_col, schema))
    vectors = [F.try_element_at(vectors_col, F.lit(n)).alias(n) for n in vector_names]
    return parsed.select("_scalars.*", *vectors)


def add_columns(df: DataFrame, expressions: dict[str, str]) -> DataFrame:
    """New columns from SQL text; the row count does not change."""
    return df.withColumns({name: F.expr(text) for name, text in expressions.items()})


def keep_unless(predicate: str | Column) -> Column:
    """Rows that survive a delete; a NULL predicate keeps its row."""
    condition = F.expr(predicate) if isinstance(predicate, str) else predicate
    return ~F.coalesce(condition, F.lit(False))
