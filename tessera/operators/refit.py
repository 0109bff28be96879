"""Merge of an IVF index whose partitions no longer fit its rows: overfull ones are split, starved ones given up.

Centroids are those of the build, so rows that arrive later from elsewhere pile up in a few partitions. Only those are
fitted again: one k-means runs over all overfull partitions at once, each with centres of its own, and shuffles sums
alone. Afterwards every row is with its closest centroid again: rows of split and given-up partitions are compared with
all centroids, and any other row, which has its closest old one, with that and the new ones.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.functions.vectors import matrix_of
from tessera.operators.block_join import PART
from tessera.operators.ivf import MODEL_BYTES, MODEL_ROWS, IvfIndex, encode, nearest_row, residual
from tessera.session import work_path

#: A new centroid is fitted on about so many rows; every row is assigned all the same.
FIT_ROWS = 256
#: Different vectors per new centroid from which its start is drawn.
START_ROWS = 4


@dataclass(frozen=True)
class Uneven:
    """Overfull partitions with the number of pieces each is to have, and starved partitions."""

    pieces: dict[int, int]
    starved: list[int]


def uneven(sizes: Mapping[int, int], part_ids: Sequence[int], overfull: float, starved: float) -> Uneven:
    """Partitions of more than ``overfull`` and less than ``starved`` times the mean; none in an empty index."""
    if overfull <= 1 or not 0 <= starved < 1:
        raise ValueError(f"overfull must be above 1 and starved from 0 to below 1, got {overfull} and {starved}")
    mean = sum(sizes.values()) / max(len(part_ids), 1)
    return Uneven({p: math.ceil(n / mean) for p, n in sorted(sizes.items()) if n > overfull * mean},
                  [p for p in part_ids if sizes.get(p, 0) < starved * mean])


def split_centres(rows: DataFrame, column: str, key: str, dim: int, sizes: Mapping[int, int], pieces: Mapping[int, int],
                  max_iter: int = 10) -> dict[int, np.ndarray]:
    """Centres of the pieces of each partition; fewer if it has fewer different vectors. ``rows`` has ``part_id``.

    Starts are drawn far from each other (k-means++, Arthur & Vassilvitskii, 2007) among a few distinct vectors in hash
    order, in a task for each partition; any partitioning of the rows gives the same.
    """
    spark = rows.sparkSession
    share = [(p, n, min(1.0, FIT_ROWS * n / sizes[p])) for p, n in pieces.items()]
    shares = F.broadcast(spark.createDataFrame(share, f"{PART} int, _pieces int, _share double"))
    draw = F.pmod(F.xxhash64(F.lit(7), F.col(key)), F.lit(1 << 20)) / (1 << 20)
    path = work_path(spark, "refit-training")  # written once, read by every pass
    rows.join(shares, PART).where(draw < F.col("_share")).select(PART, F.col(column).alias("_vector"), "_pieces").write.parquet(path)
    chosen = spark.read.parquet(path)
    order = Window.partitionBy(PART).orderBy(F.xxhash64("_vector"), "_vector")
    first = chosen.distinct().withColumn("_n", F.row_number().over(order)).where(
        F.col("_n") <= START_ROWS * max(pieces.values())).where(F.col("_n") <= START_ROWS * F.col("_pieces"))
    starts = T.StructType([T.StructField(PART, T.IntegerType()), T.StructField("_n", T.IntegerType()),
                           T.StructField("_vector", T.ArrayType(T.DoubleType()))])
    drawn = first.select(PART, "_pieces", "_n", "_vector").groupBy(PART).applyInArrow(_apart(dim, to_arrow_schema(starts)), starts)
    centres: dict[int, list] = {}
    for r in drawn.orderBy(PART, "_n").collect():  # a row per piece
        centres.setdefault(r[PART], []).append(r["_vector"])
    fitted = {p: np.asarray(c, dtype=np.float64) for p, c in centres.items()}
    offsets = dict(zip(fitted, np.cumsum([0, *(len(c) for c in fitted.values())]).tolist()))
    sums = T.StructType([T.StructField("piece", T.IntegerType()), T.StructField("n", T.LongType()),
                         T.StructField("total", T.ArrayType(T.DoubleType()))])
    for _ in range(max_iter if fitted else 0):
        step = chosen.select(PART, "_vector").mapInArrow(_piece_sums(fitted, offsets, dim, to_arrow_schema(sums)), sums)
        moved = 0.0
        flat = np.concatenate(list(fitted.values()))
        for r in step.groupBy("piece").agg(F.sum("n").alias("n"), *[F.sum(F.col("total")[i]).alias(f"s{i}") for i in range(dim)]).collect():
            centre = np.asarray([r[f"s{i}"] for i in range(dim)]) / r["n"]
            moved = max(moved, float(np.abs(centre - flat[r["piece"]]).max()))
            flat[r["piece"]] = centre
        fitted = {p: flat[offsets[p]:offsets[p] + len(c)] for p, c in fitted.items()}
        if moved < 1e-6:
            break
    return fitted


def _apart(dim: int, arrow: pa.Schema) -> Callable[[pa.Table], pa.Table]:
    """Starts of one partition: each next one drawn by its squared distance to those there are."""
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("_n").combine_chunks()
        part, want = rows.column(PART)[0].as_py(), rows.column("_pieces")[0].as_py()
        vectors, _ = matrix_of(rows.column("_vector").combine_chunks(), dim)
        dice, chosen = np.random.default_rng(part), [0]
        away = ((vectors - vectors[0]) ** 2).sum(axis=1)
        while len(chosen) < want and away.sum() > 0:
            chosen.append(int(dice.choice(len(vectors), p=away / away.sum())))
            away = np.minimum(away, ((vectors - vectors[chosen[-1]]) ** 2).sum(axis=1))
        columns = [[part] * len(chosen), list(range(len(chosen))), vectors[chosen].tolist()]
        return pa.Table.from_arrays([pa.array(v, type=f.type) for v, f in zip(columns, arrow)], schema=arrow)

    return run


def _piece_sums(centres: dict[int, np.ndarray], offsets: dict[int, int], dim: int,
                arrow: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Task side of one step: count and vector sum per closest centre of a row's own partition."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = sum(map(len, centres.values()))
        counts, totals = np.zeros(size, dtype=np.int64), np.zeros((size, dim))
        for batch in batches:
            rows, _ = matrix_of(batch.column(1), dim)
            parts = batch.column(0).to_numpy()
            for p in np.unique(parts):
                at = np.flatnonzero(parts == p)
                piece = offsets[p] + nearest_row(rows[at], centres[p])
                counts += np.bincount(piece, minlength=size)
                np.add.at(totals, piece, rows[at])
        used = np.flatnonzero(counts)
        columns = [used.tolist(), counts[used].tolist(), totals[used].tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(columns, arrow)], schema=arrow)

    return run


def _settled(column: str, old_ids: Sequence[int], old: np.ndarray, gone: Sequence[int], new_ids: Sequence[int],
             new: np.ndarray, fresh: int) -> Column:
    """Partition of each row under the new model, whose last ``fresh`` centroids are new."""
    row_of, ids, lost, dim = dict(zip(old_ids, range(len(old_ids)))), np.asarray(new_ids, dtype=np.int32), np.asarray(gone), old.shape[1]
    first = len(new) - fresh

    @F.arrow_udf(T.IntegerType())
    def closest(values: pa.Array, parts: pa.Array) -> pa.Array:
        rows, _ = matrix_of(values, dim)
        own = parts.to_numpy(zero_copy_only=False)
        out, homeless = own.astype(np.int32), np.isin(own, lost)
        out[homeless] = ids[nearest_row(rows[homeless], new)]
        at = np.flatnonzero(~homeless)
        if fresh and len(at):
            near = first + nearest_row(rows[at], new[first:])
            home = old[[row_of[p] for p in own[at]]]
            closer = ((rows[at] - new[near]) ** 2).sum(axis=1) < ((rows[at] - home) ** 2).sum(axis=1)
            out[at[closer]] = ids[near[closer]]
        return pa.array(out, type=pa.int32())

    return closest(column, PART)


def merge_refitted(index: IvfIndex, table: DataFrame | None = None, *, overfull: float = 2.0, starved: float = 0.1,
                   max_iter: int = 10) -> int:
    """Fold all deltas as :meth:`IvfIndex.merge` does, with partitions fitted to the rows; return the number folded.

    A partition of more than ``overfull`` times the mean is split into pieces of about the mean, one of less than
    ``starved`` times the mean is given up. Equal vectors can't be parted. Codes are made anew with the codebooks there are. An even or empty index is merged plainly. The new centroids come into force with the commit.
    """
    meta = index.meta()
    files = index.file_state(table, meta)
    live = index._alive(index.postings(meta), files)
    part_ids, matrix = index.model(meta)
    sizes = {r[PART]: r["count"] for r in live.groupBy(PART).count().collect()}  # a row per partition
    plan = uneven(sizes, part_ids, overfull, starved)
    if len(part_ids) + sum(plan.pieces.values()) > MODEL_ROWS or 8 * meta.dim * (len(part_ids) + sum(plan.pieces.values())) > MODEL_BYTES:
        raise ValueError(f"splitting {len(plan.pieces)} partitions exceeds the size of a model; merge without a new fit")
    centres = {}
    if plan.pieces:
        centres = split_centres(live.where(F.col(PART).isin(list(plan.pieces))), meta.column_name, meta.key_name, meta.dim,
                                sizes, plan.pieces, max_iter)
        centres = {p: c for p, c in centres.items() if len(c) > 1}
    gone = sorted({*plan.starved, *centres})
    if not gone:
        return index.merge(table)
    stay = [i for i, p in enumerate(part_ids) if p not in set(gone)]
    fresh = np.concatenate([np.zeros((0, meta.dim)), *centres.values()])
    ids = [part_ids[i] for i in stay] + list(range(max(part_ids) + 1, max(part_ids) + 1 + len(fresh)))
    fitted = np.concatenate([matrix[stay], fresh])
    rows = live.withColumn(PART, _settled(meta.column_name, part_ids, matrix, gone, ids, fitted, len(fresh)))
    books = None
    if meta.index_type == "IVF_PQ":
        books = index.books(meta)
        rows = rows.withColumn("code", encode(residual(meta.column_name, PART, ids, fitted), books))
    after = replace(meta, meta_id=meta.meta_id + 1, gen=meta.gen + 1, delta_count=0, model_gen=meta.gen + 1)
    index._write_model(after.model_gen, ids, fitted, books)
    index._write_postings(rows.drop("delta_id"), after.gen, 0)
    index._write_covered(index._alive(index.covered_files(meta), files), after.gen, 0)
    index._commit(after)
    return meta.delta_count
