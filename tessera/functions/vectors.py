"""Vector columns: Arrow helpers, distances and mean vectors.

Vectors are ``array<float>``; arithmetic is in doubles. Distances are ascending:
squared Euclidean (``l2``, the default), ``cosine`` (1 - cosine) and ``dot``
(1 - inner product).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

METRICS = ("l2", "cosine", "dot")


class DimensionMismatch(ValueError):
    """A vector's length differs from the one expected."""


def matrix_of(values: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of an Arrow list column as a double matrix, with a mask of non-NULL rows."""
    valid = np.asarray(pc.is_valid(values).to_numpy(zero_copy_only=False), dtype=bool)
    present = values if valid.all() else values.filter(pa.array(valid))
    lengths = pc.list_value_length(present).to_numpy(zero_copy_only=False)
    if len(lengths) and not (lengths == dim).all():
        raise DimensionMismatch(f"expected vectors of length {dim}, found {sorted(set(lengths.tolist()))}")
    flat = present.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(-1, dim), valid


def row_distance(rows: np.ndarray, other: np.ndarray, metric: str) -> np.ndarray:
    """Distance of each row to the matching row (or single vector) of ``other``.

    Every sum runs along one contiguous row, so equal vectors give equal bits
    wherever they stand and ties are settled by the key alone.
    """
    if metric == "l2":
        diff = rows - other
        return (diff * diff).sum(axis=1)
    inner = (rows * other).sum(axis=1)
    if metric == "dot":
        return 1.0 - inner
    if metric == "cosine":
        other = np.atleast_2d(other)
        norms = np.sqrt((rows * rows).sum(axis=1)) * np.sqrt((other * other).sum(axis=1))
        return 1.0 - inner / norms
    raise ValueError(f"unknown metric {metric!r}; known: {METRICS}")


def distance_to(column: str | Column, vector: Sequence[float], metric: str = "l2") -> Column:
    """Distance of a vector column to one fixed vector, by Arrow batches; NULL stays NULL.

    Only the vector column travels to Python; other columns wait in the JVM.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; known: {METRICS}")
    target = np.asarray(vector, dtype=np.float64)

    @F.arrow_udf(T.DoubleType())
    def batch_distance(values: pa.Array) -> pa.Array:
        rows, valid = matrix_of(values, len(target))
        out = np.zeros(len(valid))
        out[valid] = row_distance(rows, target, metric)
        return pa.array(out, mask=~valid)

    return batch_distance(column)


def pair_distance(a: str, b: str, dim: int, metric: str = "l2") -> Column:
    """Distance of two vector columns of ``dim`` elements, by Arrow batches; neither may be NULL."""
    @F.arrow_udf(T.DoubleType())
    def batch_distance(left: pa.Array, right: pa.Array) -> pa.Array:
        return pa.array(row_distance(matrix_of(left, dim)[0], matrix_of(right, dim)[0], metric))

    return batch_distance(a, b)


def distance_expr(a: Column, b: Column, metric: str = "l2") -> Column:
    """The same distance between two vector columns as a built-in expression."""
    dbl = lambda x: x.cast("double")
    total = lambda arr: F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x)
    inner = total(F.zip_with(a, b, lambda x, y: dbl(x) * dbl(y)))
    if metric == "l2":
        return total(F.zip_with(a, b, lambda x, y: (dbl(x) - dbl(y)) * (dbl(x) - dbl(y))))
    if metric == "dot":
        return F.lit(1.0) - inner
    if metric == "cosine":
        norm = lambda v: F.sqrt(total(F.transform(v, lambda x: dbl(x) * dbl(x))))
        return F.lit(1.0) - inner / (norm(a) * norm(b))
    raise ValueError(f"unknown metric {metric!r}; known: {METRICS}")


def vector_dim(df: DataFrame, column: str) -> int | None:
    """Length of the first non-NULL vector; None for an empty column."""
    row = df.where(F.col(column).isNotNull()).select(F.size(column)).first()
    return None if row is None else row[0]


def mean_vectors(df: DataFrame, group: str, column: str) -> DataFrame:
    """Mean vector per group, as ``(group, mean array<double>)``.

    Each Arrow batch is summed per group before anything is shuffled, so a group
    that holds a third of the rows sends one short row per batch.
    """
    partial = T.StructType([df.schema[group], T.StructField("n", T.LongType()),
                            T.StructField("total", T.ArrayType(T.DoubleType()))])
    arrow = to_arrow_schema(partial)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).dictionary_encode()
            rows, _ = matrix_of(batch.column(1), len(batch.column(1)[0]))
            at = ids.indices.to_numpy()
            totals = np.zeros((len(ids.dictionary), rows.shape[1]))
            np.add.at(totals, at, rows)
            yield pa.RecordBatch.from_arrays(
                [ids.dictionary.cast(arrow.field(0).type), pa.array(np.bincount(at, minlength=len(totals))),
                 pa.array(list(totals), type=arrow.field(2).type)], schema=arrow)

    present = df.where(F.col(group).isNotNull() & F.col(column).isNotNull())
    per_batch = present.select(group, column).mapInArrow(sums, partial)
    # one entry per vector position
    ordered = F.array_sort(F.collect_list(F.struct("pos", "m")))
    return (
        per_batch.select(group, "n", F.posexplode("total").alias("pos", "x"))
        .groupBy(group, "pos").agg((F.sum("x") / F.sum("n")).alias("m"))
        .groupBy(group).agg(F.transform(ordered, lambda s: s["m"]).alias("mean"))
    )
