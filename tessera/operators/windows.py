"""Previous-row lookups that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

# A key with fewer rows is sorted in one task without further ado.
HOT_ROWS = 1 << 20


def hour_of(column: str) -> Column:
    """Step that cuts a long trail into pieces of their own."""
    return F.date_trunc("hour", F.col(column))


def hot_keys(df: DataFrame, keys: Sequence[str], at_least: int = HOT_ROWS) -> DataFrame:
    """Keys with more rows than an even share of one shuffle partition, and at least ``at_least``.

    Fewer keys than shuffle partitions can exceed that share, so the result is small
    whatever the data.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    share = counts.agg(F.sum("_n") / shuffle_partitions(df)).scalar()
    return counts.where((F.col("_n") > share) & (F.col("_n") >= at_least)).drop("_n")


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def with_previous(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column,
                  columns: Sequence[str], name: str = "previous", at_least: int = HOT_ROWS) -> DataFrame:
    """Add ``name``, a struct of ``columns`` of the row before, per ``keys`` in ``order``.

    A plain ``lag`` would sort all rows of a hot key in one task. For hot keys
    ``bucket`` (a step of the first order column, such as the hour) joins the window
    key; a row at the start of a bucket takes the last row of the bucket before it,
    from an aggregate with one row per hot key and bucket. All other keys keep one
    bucket and find no row to join.
    """
    # a struct compares NULL fields as equal, so rows without a key form a key of their own
    keyed = df.withColumn("_key", F.struct(*keys))
    hot = F.broadcast(hot_keys(keyed, ["_key"], at_least).withColumn("_hot", F.lit(True)))
    rows = keyed.join(hot, "_key", "left").withColumn("_bucket", F.when(F.col("_hot"), bucket))
    value = F.struct(*columns)
    inside = Window.partitionBy("_key", "_bucket").orderBy(*order)
    lasts = rows.where("_hot").groupBy("_key", "_bucket").agg(F.max_by(value, F.struct(*order)).alias("_last"))
    before = lasts.select("_key", "_bucket", F.lag("_last").over(
        Window.partitionBy("_key").orderBy("_bucket")).alias("_before"))
    return (
        rows.withColumn(name, F.lag(value).over(inside))
        .join(before, ["_key", "_bucket"], "left")
        .withColumn(name, F.coalesce(name, "_before"))
        .drop("_key", "_bucket", "_hot", "_before")
    )
