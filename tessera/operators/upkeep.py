"""Table upkeep: deletes, expiry, compaction, tiers, file statistics, versions."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tessera.functions.scalars import days_before
from tessera.sources.paths import drop_partitions
from tessera.sources.tables import VERSION, among, keep_unless, replace_partitions, stored

# Threshold keys that a compaction understands
COMPACTION_KEYS = ("target_rows_per_fragment", "materialize_deletions")
TIER_DAYS = {"hot_to_warm_days": 30, "warm_to_cold_days": 180}
KEEP_VERSIONS = 10


# --- delete and expiry ---------------------------------------------------------------

def delete_rows(df: DataFrame, predicate: str | Column) -> DataFrame:
    """Rows left after the delete; a NULL predicate keeps its row."""
    return df.where(keep_unless(predicate))


def expired(column: str, now: Column, ttl_days: int) -> Column:
    """Strictly older than ``now``, cut to whole seconds, minus ``ttl_days``."""
    if ttl_days is None or ttl_days < 1:
        raise ValueError(f"ttl_days is required and must be at least 1, got {ttl_days}")
    return F.col(column) < days_before(now, ttl_days)


def ttl_delete(df: DataFrame, column: str, now: Column, ttl_days: int) -> DataFrame:
    return delete_rows(df, expired(column, now, ttl_days))


def delete_from_table(spark: SparkSession, path: str, partition_col: str, predicate: str | Column) -> int:
    """Delete in a stored table; return the rows left.

    Partitions where every row goes are dropped as directories, those with some
    victims are rewritten, all others stay untouched. The predicate sees the
    partition column with the type Spark infers; which directory a row came from
    is kept as text beside it, so ``01``, escaped and NULL values are found again.
    """
    typed = spark.read.parquet(path).schema[partition_col].dataType
    table = stored(spark, path, partition_col)
    table = table.withColumns({"_dir": F.col(partition_col), partition_col: F.col(partition_col).cast(typed)})
    victim = ~keep_unless(predicate)
    counts = table.groupBy("_dir").agg(
        F.count_if(victim).alias("victims"), F.count(F.lit(1)).alias("total")).collect()
    whole = [r[0] for r in counts if r["victims"] == r["total"]]
    partly = [r[0] for r in counts if 0 < r["victims"] < r["total"]]
    if partly:
        rest = table.where(among(F.col("_dir"), partly)).where(keep_unless(predicate))
        rest = rest.withColumn(partition_col, F.col("_dir")).drop("_dir")
        replace_partitions(rest, path, partition_col, partly)
    drop_partitions(spark, path, partition_col, whole)
    return sum(r["total"] - r["victims"] for r in counts)


def ttl_preview(df: DataFrame, group: str, column: str, now: Column, ttl_days: int) -> DataFrame:
    """Victims per table before anything is deleted."""
    gone = expired(column, now, ttl_days)
    return df.groupBy(group).agg(F.count_if(gone).alias("victims"), F.count_if(keep_unless(gone)).alias("rows_left"))


# --- files ---------------------------------------------------------------------------

def file_frame(df: DataFrame, *group: str) -> DataFrame:
    """One row per file with its size and row count; no data column is read."""
    return df.groupBy(
        *group, F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_size").alias("file_size"),
    ).agg(F.count(F.lit(1)).alias("rows"))


def dataset_stats(files: DataFrame, small_bytes: int, *group: str) -> DataFrame:
    """Rows, files, small files, mean size and bytes from a file frame."""
    return files.groupBy(*group).agg(
        F.sum("rows").alias("row_count"),
        F.count(F.lit(1)).alias("fragment_count"),
        F.count_if(F.col("file_size") < small_bytes).alias("small_fragment_count"),
        (F.avg("file_size") / (1 << 20)).alias("avg_fragment_size_mb"),
        F.sum("file_size").alias("storage_size_bytes"),
    )


def compaction_due(stats: DataFrame, thresholds: DataFrame, key: str) -> DataFrame:
    """Datasets whose small files exceed ``min_small_fragments`` of their JSON threshold (100)."""
    limit = F.coalesce(F.get_json_object("threshold", "$.min_small_fragments").cast("long"), F.lit(100))
    return stats.join(thresholds.select(key, limit.alias("min_small_fragments")), key).where(
        F.col("small_fragment_count") > F.col("min_small_fragments"))


@dataclass(frozen=True)
class CompactionReport:
    files_removed: int
    files_added: int
    rows: int
    ignored_keys: tuple[str, ...] = ()


def split_threshold(threshold: Mapping[str, object]) -> tuple[dict, tuple[str, ...]]:
    """Known settings, and the names of the unknown ones, sorted."""
    known = {k: v for k, v in threshold.items() if k in COMPACTION_KEYS}
    return known, tuple(sorted(set(threshold) - set(COMPACTION_KEYS)))


def compact(spark: SparkSession, path: str, partition_col: str, key: str,
            threshold: Mapping[str, object], deleted: str | None = None) -> CompactionReport:
    """Merge small files up to ``target_rows_per_fragment`` rows.

    Only partitions that hold more files than their rows need are rewritten. Each
    gets ceil(rows / target) tasks of its own and spreads its rows over them by a hash
    of ``key`` and of each row's place in its file, so neither a partition with a third
    of the table nor a key with a third of the rows is a hot spot. With
    ``materialize_deletions`` the rows matching ``deleted`` are left out.
    """
    known, ignored = split_threshold(threshold)
    target = int(known.get("target_rows_per_fragment", 1 << 20))
    typed = spark.read.parquet(path).schema[partition_col].dataType
    table = stored(spark, path, partition_col)
    drop = deleted is not None and bool(known.get("materialize_deletions"))
    before = file_frame(table, partition_col)
    need = F.greatest(F.ceil(F.sum("rows") / target), F.lit(1))
    per_part = before.groupBy(partition_col).agg(F.count(F.lit(1)).alias("files"), need.alias("need"))
    due = per_part.where("files > need").collect()
    if not due:
        return CompactionReport(0, 0, 0, ignored)
    # first task and number of tasks of each partition value
    slots, first = [], 0
    for value, _, n in due:
        slots.append((value, first, int(n)))
        first += int(n)
    values = [value for value, _, _ in slots]
    rows = table.where(among(F.col(partition_col), values)).withColumn(
        "_spread", F.xxhash64(key, "_metadata.file_name", "_metadata.row_index"))
    if drop:
        rows = rows.withColumns({"_dir": F.col(partition_col), partition_col: F.col(partition_col).cast(typed)})
        rows = rows.where(keep_unless(deleted)).withColumn(partition_col, F.col("_dir"))
    place = spark.createDataFrame(slots, "_value string, _first int, _n int")
    placed = rows.join(place, F.col(partition_col).eqNullSafe(F.col("_value")))
    shaped = placed.repartitionById(first, F.col("_first") + F.pmod("_spread", "_n").cast("int")).select(table.columns)
    written = replace_partitions(shaped, path, partition_col, values)
    after = file_frame(stored(spark, path, partition_col).where(among(F.col(partition_col), values)))
    return CompactionReport(sum(r["files"] for r in due), after.count(), written, ignored)


# --- tiers and versions ----------------------------------------------------------------

def tier(column: str, now: Column, rules: Mapping[str, int] = TIER_DAYS) -> Column:
    """hot, warm or cold by age in days."""
    age = F.datediff(now.cast("date"), F.col(column).cast("date"))
    return (
        F.when(age < rules["hot_to_warm_days"], "hot")
        .when(age < rules["warm_to_cold_days"], "warm")
        .otherwise("cold")
    )


def write_tiers(df: DataFrame, path: str, column: str, now: Column, rules: Mapping[str, int] = TIER_DAYS) -> None:
    df.withColumn("tier", tier(column, now, rules)).write.mode("overwrite").partitionBy("tier").parquet(path)


def ranked_versions(versions: DataFrame, group: str | None = None, keep: int = KEEP_VERSIONS) -> DataFrame:
    """Distinct versions, newest first, with ``kept`` for the newest ``keep``.

    Versions are made distinct by an aggregate first, so the window sees one short
    list per table and never the rows.
    """
    keys = [group] if group else []
    distinct = versions.groupBy(*keys, VERSION).agg(F.count(F.lit(1)).alias("row_count"))
    window = Window.partitionBy(*keys).orderBy(F.desc(VERSION)) if keys else Window.orderBy(F.desc(VERSION))
    return distinct.withColumn("version_rank", F.dense_rank().over(window)).withColumn(
        "kept", F.col("version_rank") <= keep)


def snapshot_files(df: DataFrame, keep: int = KEEP_VERSIONS) -> DataFrame:
    """Files of versions beyond the newest ``keep``: what a cleanup would drop."""
    files = file_frame(df, VERSION)
    ranked = ranked_versions(files, keep=keep).where(~F.col("kept")).select(VERSION)
    return files.join(ranked, VERSION, "left_semi")
