"""Catalog entries against registered datasets, and statistics as string properties."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tessera.functions.scalars import fixed_decimal, iso_utc

MATCH = ["catalog", "db_schema", "name", "tenant_id"]


def registered(datasets: DataFrame) -> DataFrame:
    return datasets.withColumnRenamed("table_name", "name")


def catalog_match(catalog: DataFrame, datasets: DataFrame) -> DataFrame:
    """Full outer match on (catalog, schema, name, tenant), with a flag per side."""
    left = catalog.withColumn("in_catalog", F.lit(True))
    right = registered(datasets).withColumn("in_registry", F.lit(True))
    joined = left.join(right, MATCH, "full_outer")
    return joined.withColumns({f: F.coalesce(f, F.lit(False)) for f in ("in_catalog", "in_registry")})


def unknown_entries(catalog: DataFrame, datasets: DataFrame) -> DataFrame:
    return catalog.join(registered(datasets).select(*MATCH), MATCH, "left_anti")


def missing_entries(catalog: DataFrame, datasets: DataFrame) -> DataFrame:
    return registered(datasets).join(catalog.select(*MATCH), MATCH, "left_anti")


def _present(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) != ""


def reconcile(catalog: DataFrame, datasets: DataFrame) -> DataFrame:
    """Action per entry: created, updated, unchanged or missing.

    An empty location or comment never overwrites a value.
    """
    moved = _present("storage_location") & ~F.col("storage_uri").eqNullSafe(F.col("storage_location"))
    reworded = _present("comment") & ~F.col("description").eqNullSafe(F.col("comment"))
    action = (
        F.when(~F.col("in_registry"), "created")
        .when(~F.col("in_catalog"), "missing")
        .when(moved | reworded, "updated")
        .otherwise("unchanged")
    )
    return catalog_match(catalog, datasets).withColumn("action", action)


def sync_summary(reconciled: DataFrame) -> DataFrame:
    """Counts per schema and, with a NULL schema, in total."""
    def count(action: str) -> Column:
        return F.count_if(F.col("action") == action).alias(f"datasets_{action}")

    return reconciled.rollup("db_schema").agg(
        F.count_if("in_catalog").alias("filesets_discovered"),
        count("created"), count("updated"), count("unchanged"), count("missing"))


def catalog_patch(catalog: DataFrame, datasets: DataFrame) -> DataFrame:
    """Narrow diff of matched entries, one row per changed column.

    Whether the entry carries a comment at all is its own flag: a comment given as
    NULL clears the description, a comment not given leaves it.
    """
    both = catalog_match(catalog, datasets).where("in_catalog AND in_registry")
    changes = F.array_compact(F.array(
        F.when(~F.col("storage_uri").eqNullSafe(F.col("storage_location")), F.struct(
            F.lit("storage_uri").alias("column"), F.col("storage_uri").alias("old_value"),
            F.col("storage_location").alias("new_value"))),
        F.when(F.col("comment_present") & ~F.col("description").eqNullSafe(F.col("comment")), F.struct(
            F.lit("description").alias("column"), F.col("description").alias("old_value"),
            F.col("comment").alias("new_value"))),
    ))
    return both.select("dataset_uuid", F.explode(changes).alias("c")).select("dataset_uuid", "c.*")


def catalog_apply(catalog: DataFrame, datasets: DataFrame) -> DataFrame:
    """Datasets after the pass: entries updated, unknown ones added as ACTIVE."""
    m = reconcile(catalog, datasets)
    created = F.col("action") == "created"
    key = F.concat_ws("/", *MATCH)
    return m.select(
        F.when(created, F.concat(F.lit("new-"), F.substring(F.sha2(key, 256), 1, 16))).otherwise(
            F.col("dataset_uuid")).alias("dataset_uuid"),
        "catalog", "db_schema", F.col("name").alias("table_name"), "tenant_id",
        F.when(_present("storage_location"), F.col("storage_location")).otherwise(
            F.col("storage_uri")).alias("storage_uri"),
        F.when(_present("comment"), F.col("comment")).otherwise(F.col("description")).alias("description"),
        F.when(created, F.lit("ACTIVE")).otherwise(F.col("status")).alias("status"),
    )


def in_scope(df: DataFrame, scope: str, catalog: str | None = None, schema: str | None = None,
             name: str | None = None) -> DataFrame:
    """Cut a catalog or registry frame to ALL, CATALOG, SCHEMA or DATASET."""
    needed = {"ALL": (), "CATALOG": ("catalog",), "SCHEMA": ("catalog", "db_schema"),
              "DATASET": ("catalog", "db_schema", "name")}
    if scope not in needed:
        raise ValueError(f"unknown scope {scope!r}; known: {sorted(needed)}")
    given = {"catalog": catalog, "db_schema": schema, "name": name}
    for column in needed[scope]:
        if given[column] is not None:
            df = df.where(F.col(column) == given[column])
    return df


# --- properties ---------------------------------------------------------------------------

def string_map(entries: dict[str, Column]) -> Column:
    """A string-to-string map; a missing value becomes ``''``."""
    keys = F.array(*[F.lit(k) for k in entries])
    values = F.array(*[F.coalesce(v.cast("string"), F.lit("")) for v in entries.values()])
    return F.map_from_arrays(keys, values)


def dataset_properties(prefix: str, now: Column) -> Column:
    """Operational state of a dataset row under ``prefix``, every value a string."""
    return string_map({
        f"{prefix}dataset_uuid": F.col("dataset_uuid"),
        f"{prefix}tenant_id": F.col("tenant_id"),
        f"{prefix}status": F.col("status"),
        f"{prefix}row_count": F.col("row_count"),
        f"{prefix}fragment_count": F.col("fragment_count"),
        f"{prefix}index_coverage": fixed_decimal("index_coverage"),
        f"{prefix}latest_version": F.col("latest_version"),
        f"{prefix}synced_at": iso_utc(now),
    })


def index_properties(indexes: DataFrame, prefix: str) -> DataFrame:
    """One property map per dataset with state, column and last optimise of its indexes.

    A dataset has at most a few indexes (one per name), so its map stays small.
    """
    base = F.concat(F.lit(f"{prefix}index."), F.col("index_name"))
    entries = F.array(
        F.struct(F.concat(base, F.lit(".state")).alias("key"), F.upper("status").alias("value")),
        F.struct(F.concat(base, F.lit(".column")).alias("key"), F.col("column_name").alias("value")),
        F.struct(F.concat(base, F.lit(".last_optimized_at")).alias("key"),
                 iso_utc("last_optimized_at").alias("value")),
    )
    return indexes.select("dataset_uuid", F.explode(entries).alias("e")).groupBy("dataset_uuid").agg(
        F.map_from_entries(F.collect_list("e")).alias("properties"))


def properties_to_columns(df: DataFrame, properties: str, prefix: str, names: Sequence[str], key: str) -> DataFrame:
    """Read named properties back as columns; no shuffle, unlike a pivot."""
    return df.select(key, *[F.try_element_at(properties, F.lit(prefix + n)).alias(n) for n in names])
