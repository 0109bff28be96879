"""Stored bitmap index: for each value, bitmaps of row positions in the table's data files.

Postings are ``value, row_file, bucket, bitmap``: one container of 32,768 row positions
per value, file and block of rows, sorted by value. AND, OR and NOT work on containers
of equal (file, block), so no row number is spelt out; rows are fetched by position
from files that have hits, and no other file is opened.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tessera.operators.stored_index import (FILE_NAME, ROW_FILE, FileState, IndexMeta, StoredIndex, reads_files,
                                            with_files)
from tessera.sources.tables import VERSION

PLACE = [ROW_FILE, "bucket"]


class BitmapIndex(StoredIndex):
    """A bitmap index of one column below ``path``."""

    @classmethod
    def build(cls, df: DataFrame, path: str, *, column: str, key: str = "", index_name: str = "idx_bitmap",
              replace_existing: bool = True) -> BitmapIndex:
        """Rows are known by data file and position, so ``df`` must be read from files; ``key`` is only noted."""
        if not reads_files(df):
            raise ValueError("a bitmap index needs a table that is read from files")
        index = cls(df.sparkSession, path)
        gen, meta_id = index._next(replace_existing)
        meta = IndexMeta(meta_id, gen, 0, 0, index_name, column, key, "BITMAP")
        _, covered = index._write_delta(df, meta, 0)
        index._commit(replace(meta, covered_version=covered))
        return index

    def _write_delta(self, df: DataFrame, meta: IndexMeta, delta_id: int,
                     files: FileState | None = None) -> tuple[int, int]:
        """Bits are set in map-side partial aggregates: a frequent value costs one container per task and block."""
        newest = df.agg(F.max(VERSION)).first()[0] if VERSION in df.columns else None
        self._note_covered(with_files(df), meta, delta_id, files)
        self._write_postings(self._containers(df, meta), meta.gen, delta_id)
        added = self.spark.read.schema("bitmap binary").parquet(
            f"{self.path}/postings/gen={meta.gen}/delta_id={delta_id}").agg(F.sum(F.bitmap_count("bitmap"))).first()[0]
        return added or 0, meta.covered_version if newest is None else max(newest, meta.covered_version)

    @staticmethod
    def _containers(df: DataFrame, meta: IndexMeta) -> DataFrame:
        row = F.col("_metadata.row_index") + 1  # blocks are counted from 1
        rows = with_files(df).select(F.col(meta.column_name).alias("value"), ROW_FILE, row.alias("row"))
        return rows.groupBy("value", ROW_FILE, F.bitmap_bucket_number("row").alias("bucket")).agg(
            F.bitmap_construct_agg(F.bitmap_bit_position("row")).alias("bitmap"))

    def expected_entries(self, df: DataFrame, meta: IndexMeta) -> DataFrame:
        return self._hashed(self._containers(df, meta), meta)

    def _hashed(self, entries: DataFrame, meta: IndexMeta) -> DataFrame:
        return entries.select(ROW_FILE, F.bitmap_count("bitmap").alias("weight"), F.xxhash64("value", "bucket", "bitmap").alias("hash"))

    def _write_postings(self, rows: DataFrame, gen: int, delta_id: int) -> None:
        super()._write_postings(rows.repartitionByRange("value", *PLACE).sortWithinPartitions("value", *PLACE), gen, delta_id)

    def counts(self, table: DataFrame | None = None) -> DataFrame:
        """``value``, ``row_count``; of live files if ``table`` is given."""
        meta = self.meta()
        live = self._alive(self.postings(meta), self.file_state(table, meta))
        return live.groupBy("value").agg(F.sum(F.bitmap_count("bitmap")).alias("row_count"))

    def bitmaps(self, values: Sequence, negate: bool = False, files: FileState | None = None) -> DataFrame:
        """Containers of rows that hold one of ``values``, or with ``negate`` another value that isn't NULL.

        A row has one value, so the rows of the other values are the complement.
        """
        here = F.col("value").isin(list(values))
        return any_of(self._alive(self.postings().where(~here if negate else here), files).select(*PLACE, "bitmap"))


def any_of(*containers: DataFrame) -> DataFrame:
    """OR of containers by file and block."""
    both = reduce(DataFrame.unionByName, containers)
    return both.groupBy(*PLACE).agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def all_of(*containers: DataFrame) -> DataFrame:
    """AND of frames that have at most one container per file and block; empty ones are left out."""
    both = reduce(DataFrame.unionByName, containers)
    met = both.groupBy(*PLACE).agg(F.bitmap_and_agg("bitmap").alias("bitmap"), F.count(F.lit(1)).alias("n"))
    return met.where((F.col("n") == len(containers)) & (F.bitmap_count("bitmap") > 0)).select(*PLACE, "bitmap")


@dataclass(frozen=True)
class OneOf:
    """Rows whose column has one of ``values``; with ``negate``, another value that isn't NULL."""

    index: BitmapIndex
    values: Sequence
    negate: bool = False

    def as_filter(self) -> Column:
        here = F.col(self.index.meta().column_name).isin(list(self.values))
        return ~here if self.negate else here


def fetch(table: DataFrame, hits: DataFrame) -> DataFrame:
    """Rows of ``table`` at the positions of ``hits`` (``row_file``, ``bucket``, ``bitmap``); opens files with hits only.

    The list of hit files goes through the driver, as the file list of any scan does. A file's rows meet its containers
    by block, one container per 32,768 rows.
    """
    names = {r[0] for r in hits.select(ROW_FILE).distinct().collect()}
    paths = [uri for uri in table.inputFiles() if re.search(FILE_NAME, uri)[1] in names]
    paths += [re.sub("^file:///", "file:/", uri) for uri in paths]  # as the scan's metadata column spells it
    rows = with_files(table.where(F.col("_metadata.file_path").isin(paths))).withColumn("_row", F.col("_metadata.row_index"))
    rows = rows.withColumn("bucket", F.bitmap_bucket_number(F.col("_row") + 1))
    byte = "cast(conv(hex(substring(bitmap, cast(_row % 32768 div 8 as int) + 1, 1)), 16, 10) as int)"
    bit = F.expr(f"shiftright({byte}, cast(_row % 8 as int)) & 1")
    return rows.join(hits, PLACE).where(bit == 1).select(table.columns)


def lookup(table: DataFrame, *clauses: Sequence[OneOf]) -> DataFrame:
    """Rows of the live ``table`` that meet every clause; a clause is met if one of its predicates is.

    Containers answer for files that all indexes cover; the other files are few, and are filtered as they are read.
    """
    indexes = {id(p.index): p.index for clause in clauses for p in clause}
    states = {at: index.file_state(table) for at, index in indexes.items()}
    if any(s is None for s in states.values()):
        raise ValueError("a bitmap lookup needs the table that was indexed, read from files")
    fresh = sorted({uri for s in states.values() for uri in s.fresh})
    hits = all_of(*(any_of(*(p.index.bitmaps(p.values, p.negate, states[id(p.index)]) for p in clause)) for clause in clauses))
    if fresh:
        names = sorted({re.search(FILE_NAME, uri)[1] for uri in fresh})
        hits = hits.where(~F.col(ROW_FILE).isin(names))
    found = fetch(table, hits)
    if not fresh:
        return found
    wanted = reduce(lambda a, b: a & b, (reduce(lambda a, b: a | b, (p.as_filter() for p in clause)) for clause in clauses))
    return found.unionByName(table.where(F.col("_metadata.file_path").isin(fresh)).where(wanted))
