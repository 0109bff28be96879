"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import posixpath
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import work_path
from tessera.sources.paths import make_path

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: Stands for a NULL document number where keys are compared; a NULL counts as one document, below all others.
NO_ID = -(2**63)
#: Bytes of strings that a task turns into Python values at once, give or take a row.
PART_BYTES = 2 << 20
#: Bytes of an Arrow batch, give or take a row. Spark's own bound (64 MB) holds for each task, on both sides of the pipe and
#: outside the heap.
BATCH_BYTES = 4 << 20
#: By module: drops what its tasks leave in a worker for the next ones.
LEFT_OVER: dict[str, Callable[[], None]] = {}


def given(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else, unlike ``lower``."""
    return F.translate(text, UPPER, LOWER)


def id_or_none(key: Column) -> Column:
    return F.coalesce(key.cast("long"), F.lit(NO_ID))


def none_or_id(key: Column) -> Column:
    return F.when(key != NO_ID, key)


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: its lineage ends there."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def new_folder(spark: SparkSession, name: str) -> str:
    """An empty shared folder for files that tasks write."""
    path = work_path(spark, name)
    make_path(spark, path)
    return path


def _place(key: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(bits))


def _bitmap(wanted: DataFrame, bits: int) -> DataFrame:
    """``_word``, ``_mask``: the places of ``wanted``'s single column, as words of 64 bits."""
    slot = _place(F.col(wanted.columns[0]), bits)
    words = wanted.select(F.shiftright(slot, 6).alias("_word"), F.expr("1L").alias("_one"), slot.alias("_slot"))
    return words.groupBy("_word").agg(F.bit_or(F.expr("shiftleft(1L, cast(_slot % 64 as int))")).alias("_mask"))


def bitmap_filter(df: DataFrame, key: str, wanted: DataFrame, bits: int = 1 << 23) -> DataFrame:
    """Rows of ``df`` whose ``key`` may be among the single column of ``wanted``; none of those is lost.

    The set is a bitmap of ``bits`` bits in words of 64: at most ``bits / 64`` rows (2 MB) at any input size, so it
    may be broadcast. It spares most rows the shuffle of the exact join that follows.
    """
    own = _place(F.col(key), bits)
    marked = df.withColumns({"_word": F.shiftright(own, 6), "_bit": (own % 64).cast("int")})
    marked = marked.join(F.broadcast(_bitmap(wanted, bits)), "_word")
    return marked.where(F.expr("(_mask & shiftleft(1L, _bit)) <> 0")).select(df.columns)


def bitmap_mark(df: DataFrame, key: str, wanted: DataFrame, name: str, bits: int = 1 << 23) -> DataFrame:
    """All rows of ``df`` with the boolean column ``name``: what :func:`bitmap_filter` would keep."""
    own = _place(F.col(key), bits)
    marked = df.withColumns({"_word": F.shiftright(own, 6), "_bit": (own % 64).cast("int")})
    marked = marked.join(F.broadcast(_bitmap(wanted, bits)), "_word", "left")
    hit = F.coalesce(F.expr("(_mask & shiftleft(1L, _bit)) <> 0"), F.lit(False))
    return marked.select(*df.columns, hit.alias(name))


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """Columns ``node``, ``label``: the smallest node reachable over ``edges``, for every node of an edge.

    Labels fall to the smallest one next door and then to that label's own label, so long chains halve each time.
    Every round is a written table; the loop ends when no label changes.
    """
    both = edges.select(F.col(left).alias("a"), F.col(right).alias("b"))
    both = saved(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = saved(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        low = labels.join(near, labels.node == near.a).select(
            "node", F.least("label", "near").alias("low"), F.col("label").alias("old"))
        low = saved(low, "lowered")
        up = low.select(F.col("node").alias("up"), F.col("low").alias("top"))
        nxt = saved(low.join(up, low.low == up.up, "left").select(
            "node", F.coalesce("top", "low").alias("label"), "old"), "labels")
        changed = nxt.where(F.col("label") != F.col("old")).limit(1).count()
        labels = nxt.select("node", "label")
        if not changed:
            return labels


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def new_file(folder: str, stem: str, suffix: str) -> str:
    """A name no other attempt of the same task uses; only names in a committed table count as written."""
    return posixpath.join(folder, f"{stem}-{uuid.uuid4().hex}{suffix}")


def binary_values(column: pa.Array) -> list[bytes | None]:
    """Bytes of a string column, without decoding."""
    return column.cast(pa.binary()).to_pylist()


def bound_batches(spark: SparkSession) -> None:
    """From now on Arrow batches of this session end at ``BATCH_BYTES``, unless it has set a bound of its own.

    Otherwise a batch has up to 10,000 rows or 64 MB, in the executor and again in its worker.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if name not in spark.conf.getAll:
        spark.conf.set(name, str(BATCH_BYTES))


def release_memory(own: str = "") -> None:
    """Hand freed memory back to the system, and with it what modules but ``own`` have left over. Workers are reused, and
    what an earlier step keeps would stand beside what the next one needs."""
    for module, drop in LEFT_OVER.items():
        if module != own:
            drop()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def parts_of(batch: pa.RecordBatch, size: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``size`` bytes of strings: what a task makes of its rows at once follows neither rows nor batches."""
    ends = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
            ends += np.asarray(pc.fill_null(pc.binary_length(column), 0))
    ends = np.cumsum(ends)
    cuts = [0, *(np.flatnonzero(np.diff(ends // size)) + 1).tolist(), batch.num_rows]
    for low, high in zip(cuts, cuts[1:]):
        yield batch.slice(low, high - low)


def batch_of(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema)], schema=schema)


def batches_of(schema: pa.Schema, rows: Iterable[tuple], size: int = 4096) -> Iterator[pa.RecordBatch]:
    part: list[tuple] = []
    for row in rows:
        part.append(row)
        if len(part) >= size:
            yield batch_of(schema, part)
            part = []
    if part:
        yield batch_of(schema, part)
