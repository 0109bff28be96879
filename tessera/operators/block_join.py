"""Nearest rows for many queries without a driver: both sides meet in blocks of bounded size.

Rows and queries carry a partition id. Each partition is a grid of row blocks and query
blocks, as many as its counts call for; a row goes to one row block of every query block
and a query to one query block of every row block. One task matches one cell of the grid
by matrix products and passes on at most k rows per query, so a partition that holds a
third of all rows, or that all queries probe, is spread like any other.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.functions.vectors import matrix_of
from tessera.operators.search import DISTANCE, TopK

#: Bytes of vectors (as doubles) that one side of a cell holds at most, by expectation.
CELL_BYTES = 16 << 20
#: Tasks for each cell: with several, two cells seldom share one. A task of an empty share costs next to nothing.
CELL_TASKS, MAX_TASKS = 4, 4096
PART = "part_id"

#: Offers the rows of one partition (table with key, value columns) to the queries of a running top-k.
Score = Callable[[TopK, int, pa.Table], None]


def _spread(key: Column, blocks: Column, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), key), blocks).cast("int")


def _every(blocks: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), blocks - 1))


def block_join(queries: DataFrame, rows: DataFrame, qid: str, qvec: str, key: str, k: int, metric: str, dim: int,
               row_bytes: int, score: Score) -> DataFrame:
    """``(qid, key, part_id, _distance)``: per cell of the grid, the k best rows of each query.

    ``queries`` has ``part_id`` (the partitions it probes, a row each), ``qid`` and ``qvec``; ``rows`` has ``part_id``,
    ``key`` and what ``score`` reads, about ``row_bytes`` a row. Counts per partition are the only thing that passes the
    driver. Cells are few bytes and much work, so their number sets that of the tasks, not their size.
    """
    cell_rows, cell_queries = max(1, CELL_BYTES // row_bytes), max(1, CELL_BYTES // (8 * (dim + 2 * k)))
    sizes = rows.groupBy(PART).agg(F.ceil(F.count(F.lit(1)) / cell_rows).cast("int").alias("_row_blocks")).join(
        queries.groupBy(PART).agg(F.ceil(F.count(F.lit(1)) / cell_queries).cast("int").alias("_query_blocks")), PART)
    grid = sizes.collect()  # a row per partition of the index, bounded by its model
    sizes = F.broadcast(rows.sparkSession.createDataFrame(grid, sizes.schema))
    tasks = min(max(1, CELL_TASKS * sum(r["_row_blocks"] * r["_query_blocks"] for r in grid)), MAX_TASKS)
    blocks = ["_row_blocks", "_query_blocks"]
    left = queries.join(sizes, PART).withColumn("_q", _spread(F.col(qid), F.col("_query_blocks"), 1)).withColumn(
        "_r", _every(F.col("_row_blocks"))).drop(*blocks)
    right = rows.join(sizes, PART).withColumn("_r", _spread(F.col(key), F.col("_row_blocks"), 2)).withColumn(
        "_q", _every(F.col("_query_blocks"))).drop(*blocks)
    schema = T.StructType([queries.schema[qid], rows.schema[key], T.StructField(PART, T.IntegerType()),
                           T.StructField(DISTANCE, T.DoubleType())])
    arrow = to_arrow_schema(schema)

    def match(cell: tuple[pa.Scalar, ...], asked: pa.Table, found: pa.Table) -> pa.Table:
        if not asked.num_rows or not found.num_rows:
            return arrow.empty_table()
        ids = asked.column(qid).combine_chunks()
        matrix, _ = matrix_of(asked.column(qvec).combine_chunks(), dim)
        best, part = TopK(matrix, k, metric), cell[0].as_py()
        score(best, part, found.combine_chunks())
        if best.key is None:
            return arrow.empty_table()
        q, keys, dist = best.results()
        columns = [ids.take(pa.array(q)), pa.array(keys.tolist(), arrow.field(1).type),
                   pa.array([part] * len(q), pa.int32()), pa.array(dist)]
        return pa.Table.from_arrays(columns, schema=arrow)

    cell = [PART, "_r", "_q"]
    left, right = left.repartition(tasks, *cell), right.repartition(tasks, *cell)
    return left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(match, schema)


def flat_score(key: str, column: str, dim: int) -> Score:
    """Exact distances to the vectors of ``column``."""
    def score(best: TopK, part: int, rows: pa.Table) -> None:
        matrix, valid = matrix_of(rows.column(column).combine_chunks(), dim)
        keys = rows.column(key).to_numpy()[valid]
        best.update(np.arange(len(best.queries)), matrix, keys)
    return score


def best_of(hits: DataFrame, qid: str, key: str, k: int) -> DataFrame:
    """``(qid, key, _distance, rank)``: the k best of partial lists; equal distances by key."""
    order = Window.partitionBy(qid).orderBy(DISTANCE, key)
    ranked = hits.select(qid, key, DISTANCE).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k)


def flat_join(queries: DataFrame, qid: str, qvec: str, rows: DataFrame, key: str, column: str, k: int, metric: str,
              dim: int) -> DataFrame:
    """Partial lists of the exact join: one partition, cut into blocks on both sides."""
    one = F.lit(0).alias(PART)
    return block_join(queries.where(F.col(qvec).isNotNull()).select(one, qid, qvec),
                      rows.where(F.col(column).isNotNull()).select(one, key, column), qid, qvec, key, k, metric, dim, 8 * dim,
                      flat_score(key, column, dim))
