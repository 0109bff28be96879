"""Row filters over control tables: tenants, facets, states; and paging."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tessera.sources.tables import require_columns

PAGE_SIZE_DEFAULT, PAGE_SIZE_MAX = 20, 200


class TenantContextError(RuntimeError):
    """A tenant table was read without a tenant."""


class TenantScope:
    """Hands out tables cut to one tenant; the predicate reaches the scan by pushdown.

    ``tenant_id=None`` fails closed: an error, or zero rows with ``strict=False``.
    ``all_tenants=True`` is the explicit bypass for system work.
    """

    def __init__(self, tenant_id: str | None = None, *, all_tenants: bool = False, strict: bool = True):
        self.tenant_id, self.all_tenants, self.strict = tenant_id, all_tenants, strict

    def table(self, df: DataFrame) -> DataFrame:
        """A table with its own ``tenant_id`` column."""
        if self.all_tenants:
            return df
        if self.tenant_id is None:
            if self.strict:
                raise TenantContextError("no tenant is set")
            return df.where(F.lit(False))
        return df.where(F.col("tenant_id") == self.tenant_id)

    def child(self, df: DataFrame, parents: DataFrame, key: str = "dataset_uuid") -> DataFrame:
        """A table without a tenant column, scoped through its parent."""
        if self.all_tenants:
            return df
        return df.join(self.table(parents).select(key), key, "left_semi")

    def join(self, left: DataFrame, right: DataFrame, on: str) -> DataFrame:
        """Both sides are cut before they meet."""
        return self.table(left).join(self.table(right).drop("tenant_id"), on)


def live(df: DataFrame) -> DataFrame:
    """Soft-deleted rows count as absent."""
    return df.where(F.col("status") != "DELETED")


def facets(df: DataFrame, wanted: Mapping[str, object | None]) -> DataFrame:
    """Equality on every facet that is given; ``None`` means no filter."""
    given = {c: v for c, v in wanted.items() if v is not None}
    require_columns(df, list(given))
    return reduce(lambda d, item: d.where(F.col(item[0]) == F.lit(item[1])), given.items(), df)


def dispatchable(tasks: DataFrame) -> DataFrame:
    return tasks.where(F.col("status").isin("PENDING", "QUEUED") & (F.col("attempt") < F.col("max_attempts")))


def retry_exhausted(tasks: DataFrame) -> DataFrame:
    return tasks.where((F.col("status") == "FAILED") & (F.col("attempt") >= F.col("max_attempts")))


def soft_delete(df: DataFrame, where, stamp: str = "DELETED") -> DataFrame:
    """Flip the status and keep the row for audit."""
    return df.withColumn("status", F.when(where, F.lit(stamp)).otherwise(F.col("status")))


def page_bounds(page: int, page_size: int) -> tuple[int, int]:
    """1-based page and size, both clamped."""
    page = max(page, 1)
    size = PAGE_SIZE_DEFAULT if page_size < 1 else min(page_size, PAGE_SIZE_MAX)
    return page, size


def newest_first(df: DataFrame, newest: str, key: str) -> DataFrame:
    """Whole list, newest first; the key makes the order total."""
    return df.orderBy(F.desc(newest), key)


def page(df: DataFrame, newest: str, key: str, page: int = 1, page_size: int = PAGE_SIZE_DEFAULT) -> DataFrame:
    """One page of the list; Spark keeps only ``page * page_size`` rows per task."""
    number, size = page_bounds(page, page_size)
    return newest_first(df, newest, key).offset((number - 1) * size).limit(size)


def list_total(df: DataFrame) -> DataFrame:
    """Count over the same filter as a page."""
    return df.agg(F.count(F.lit(1)).alias("total"))
