"""Scalar indexes: a sorted layout with a file-range frame, and value bitmaps."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

# Rows of one bitmap, fixed by Spark's bitmap functions
BITMAP_ROWS = 32768


# --- sorted layout -------------------------------------------------------------------

class SortedIndex:
    """The table sorted by a column, plus min and max of that column per file."""

    def __init__(self, spark: SparkSession, path: str, column: str):
        self.spark, self.path, self.column = spark, path, column

    @classmethod
    def build(cls, df: DataFrame, path: str, *, column: str, key: str, files: int | None = None) -> SortedIndex:
        """Range partitions on (column, key) stay even when one value fills a third of the rows."""
        order = [F.col(column), F.col(key)]
        ranged = df.repartitionByRange(files, *order) if files else df.repartitionByRange(*order)
        ranged.sortWithinPartitions(column, key).write.mode("overwrite").parquet(f"{path}/rows")
        index = cls(df.sparkSession, path, column)
        index._file_ranges().coalesce(1).write.mode("overwrite").parquet(f"{path}/files")
        return index

    def _file_ranges(self) -> DataFrame:
        return self.rows().groupBy(F.col("_metadata.file_path").alias("file_path")).agg(
            F.min(self.column).alias("low"), F.max(self.column).alias("high"), F.count(F.lit(1)).alias("n"))

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def files(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/files")

    def lookup(self, low, high) -> DataFrame:
        """Rows with ``low <= column <= high``; only files whose range overlaps are opened."""
        overlapping = self.files().where((F.col("high") >= low) & (F.col("low") <= high))
        paths = [r[0] for r in overlapping.select("file_path").collect()]
        base = self.rows()
        rows = self.spark.read.schema(base.schema).parquet(*paths) if paths else base.where(F.lit(False))
        return rows.where(F.col(self.column).between(low, high))


# --- bitmaps -------------------------------------------------------------------------

def build_bitmaps(df: DataFrame, value: str, row_id: str) -> DataFrame:
    """``(value, bucket, bitmap)``: one bitmap per value and block of row ids.

    Bits are set in map-side partial aggregates, so a frequent value costs one
    bitmap per task and block, not one row per occurrence.
    """
    return df.groupBy(value, F.bitmap_bucket_number(row_id).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(row_id)).alias("bitmap"))


def bitmap_counts(bitmaps: DataFrame, value: str) -> DataFrame:
    return bitmaps.groupBy(value).agg(F.sum(F.bitmap_count("bitmap")).alias("row_count"))


def bitmap_any(bitmaps: DataFrame, value: str, values: Sequence) -> DataFrame:
    """Bitmaps of rows that hold any of ``values``: the OR over their bitmaps."""
    return bitmaps.where(F.col(value).isin(list(values))).groupBy("bucket").agg(
        F.bitmap_or_agg("bitmap").alias("bitmap"))


def bitmap_rows(bitmaps: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Row ids back from ``(bucket, bitmap)``."""
    schema = T.StructType([T.StructField(row_id, T.LongType())])
    arrow = to_arrow_schema(schema)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, bits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                at = np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little"))
                # positive ids start a block at 1; block 0 holds zero and small negative ids
                ids = (bucket - 1) * BITMAP_ROWS + at + 1 if bucket > 0 else bucket * BITMAP_ROWS - at
                yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int64))], schema=arrow)

    return bitmaps.select("bucket", "bitmap").mapInArrow(decode, schema)


