"""Exact nearest-neighbour search over a vector column."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.functions.vectors import METRICS, DimensionMismatch, distance_to, matrix_of, row_distance, vector_dim
from tessera.sources.tables import require_columns

K_MIN, K_MAX, K_DEFAULT = 1, 1000, 10
DISTANCE = "_distance"

# A query set of up to this size travels to every task; a larger one meets the table in blocks.
QUERY_BLOCK_BYTES = 8 << 20
# Cells of one distance matrix inside a task (doubles).
MATRIX_CELLS = 2 << 20
# Squared lengths from which on single precision is not used, and hits per wanted one from which on it tells too little.
SINGLE_SQUARE, MANY_NEAR = 1e30, 8
# A hit list of up to this many rows (key and distance) is sent to every task of a join.
HIT_ROWS = 1 << 20


class ColumnNotFound(ValueError):
    """The vector column is not in the table."""


def check_column(df: DataFrame, column: str) -> None:
    if column not in df.columns:
        raise ColumnNotFound(f"vector column {column!r} not found; available: {sorted(df.columns)}")


def check_k(k: int) -> None:
    if not K_MIN <= k <= K_MAX:
        raise ValueError(f"k must lie in {K_MIN}..{K_MAX}, got {k}")


def check_dimension(vector: Sequence[float], column: str, dim: int | None) -> None:
    if dim is not None and dim != len(vector):
        raise DimensionMismatch(f"query has {len(vector)} values, column {column!r} has {dim}")


def nearest(df: DataFrame, vector: Sequence[float], column: str, key: str,
            k: int = K_DEFAULT, metric: str = "l2") -> DataFrame:
    """The k nearest rows: a per-task heap (TakeOrdered), no shuffle of the table."""
    scored = df.where(F.col(column).isNotNull()).withColumn(DISTANCE, distance_to(column, vector, metric))
    return scored.orderBy(DISTANCE, key).limit(k)


def vector_search(
    df: DataFrame,
    vector: Sequence[float],
    column: str,
    key: str,
    k: int = K_DEFAULT,
    filter_expr: str | None = None,
    select: Sequence[str] | None = None,
    metric: str = "l2",
    prefilter: bool = False,
) -> DataFrame:
    """Flat search; the filter runs after retrieval unless ``prefilter`` is set.

    Post-filtering may return fewer than ``k`` rows. Columns that neither the
    filter, the ordering nor the result needs are pruned from the scan.
    """
    check_column(df, column)
    check_k(k)
    check_dimension(vector, column, vector_dim(df, column))
    if filter_expr is not None and prefilter:
        df = df.where(F.expr(filter_expr))
    hits = nearest(df, vector, column, key, k, metric)
    if filter_expr is not None and not prefilter:
        hits = hits.where(F.expr(filter_expr))
    if select is not None:
        require_columns(df, select)
        hits = hits.select(*select, DISTANCE)
    return hits.orderBy(DISTANCE, key) if select is None or key in select else hits


# --- many queries at once -----------------------------------------------------

class TopK:
    """Running k best rows of every query inside one task."""

    def __init__(self, queries: np.ndarray, k: int, metric: str):
        self.queries, self.k, self.metric = queries, k, metric
        self.norms = np.sqrt((queries * queries).sum(axis=1))
        self.dist = np.full((len(queries), k), np.inf)
        self.key: np.ndarray | None = None
        self._left: np.ndarray | None = None  # the queries' side of the products that bound l2 from below
        self._cells: np.ndarray | None = None

    @property
    def worst(self) -> np.ndarray:
        return self.dist[:, -1]

    def _approximate(self, q_index: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, float]:
        """Distances by one matrix product, and a bound on their rounding error."""
        inner = self.queries[q_index] @ rows.T
        q_norms, r_norms = self.norms[q_index, None], np.sqrt((rows * rows).sum(axis=1))[None, :]
        unit = 1e-13 * rows.shape[1]
        if self.metric == "cosine":
            return 1.0 - inner / (q_norms * r_norms), unit
        slack = unit * max(float(q_norms.max() + r_norms.max()) ** 2, 1.0)
        if self.metric == "dot":
            return 1.0 - inner, slack
        inner *= -2.0
        inner += q_norms ** 2
        inner += r_norms ** 2
        return inner, slack

    def _bounds_of(self, rows: np.ndarray) -> np.ndarray | None:
        """The rows' side of products that bound l2 from below in single precision; None if its range is too small for them.

        Around the queries' mean, |q - r|^2 = |q|^2 + |r|^2 - 2qr is one product of vectors that are longer by two. It is wrong
        by ``error`` (|q|^2 + |r|^2) at most, twice over, so both squares are lessened by that share first.
        """
        error = 2.0 ** -22 * (rows.shape[1] + 8)
        if self._left is None:
            known = np.isfinite(self.norms)
            self._centre = self.queries[known].mean(axis=0) if known.any() else np.zeros(rows.shape[1])
            near = self.queries - self._centre
            squares = (near * near).sum(axis=1)
            self._squares, fits = squares, squares < SINGLE_SQUARE
            self._left = np.zeros((len(near), rows.shape[1] + 2), np.float32)
            self._left[fits] = np.column_stack([-2.0 * near[fits], np.ones(fits.sum()), (1.0 - error) * squares[fits]])
            self._single = bool(fits[known].all())
        near = rows - self._centre
        squares = (near * near).sum(axis=1)
        if not self._single or not (squares < SINGLE_SQUARE).all():
            return None
        return np.column_stack([near, (1.0 - error) * squares, np.ones(len(rows))]).astype(np.float32)

    def update(self, q_index: np.ndarray, rows: np.ndarray, keys: np.ndarray,
               exact: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> None:
        """Offer ``rows`` to the queries in ``q_index``, as distance matrices of bounded size.

        Rows and queries without a distance (an element that is NaN or infinite; for cosine also a zero vector) are put
        aside first: one of them must not widen or void the bound that the others are cut by. The distance of a pair that the
        bound lets pass is :func:`row_distance`, or what ``exact`` has for places of queries and of ``rows``.
        """
        with np.errstate(over="ignore", invalid="ignore"):
            usable, asked = np.isfinite((rows * rows).sum(axis=1)), np.isfinite(self.norms[q_index])
        if self.metric == "cosine":
            usable, asked = usable & rows.any(axis=1), asked & (self.norms[q_index] > 0)
        places, q_index = np.flatnonzero(usable), q_index[asked]
        if not len(q_index) or not len(places):
            return
        ends = [256, 1280, 5376] if self.key is None else [0]  # few rows first, for a bound on the next ones
        ends += range(ends[-1] + 8192, len(places), 8192)
        for at in np.split(places, [r for r in ends if 0 < r < len(places)]):
            part, q_step = rows[at], max(1, MATRIX_CELLS // len(at))
            with np.errstate(over="ignore", invalid="ignore"):
                side = self._bounds_of(part) if self.metric == "l2" else None
            for s in range(0, len(q_index), q_step):
                self._update_block(q_index[s:s + q_step], part, at, keys, side, exact)

    def _update_block(self, q_index: np.ndarray, rows: np.ndarray, at: np.ndarray, keys: np.ndarray,
                      side: np.ndarray | None, exact: Callable | None) -> None:
        pairs = self._near_single(q_index, rows, side) if side is not None else None
        if pairs is None or len(pairs) > MANY_NEAR * self.k * len(q_index):  # single precision can't tell these apart
            pairs = self._near_double(q_index, rows)
        qi, ri = np.divmod(pairs, len(rows))
        if len(qi):
            step = max(1, MATRIX_CELLS // rows.shape[1])
            found = np.concatenate([
                row_distance(rows[ri[i:i + step]], self.queries[q_index[qi[i:i + step]]], self.metric) if exact is None
                else exact(q_index[qi[i:i + step]], at[ri[i:i + step]])
                for i in range(0, len(qi), step)
            ])
            self.offer(q_index[qi], found, keys[at[ri]])

    def _near_single(self, q_index: np.ndarray, rows: np.ndarray, side: np.ndarray) -> np.ndarray:
        """Flat places (query by row) of pairs that may enter the k best; ``side`` is the rows' part of the lower bounds."""
        if self._cells is None or self._cells.size < len(q_index) * len(rows):
            self._cells = np.empty(len(q_index) * len(rows), np.float32)
        least = np.matmul(self._left[q_index], side.T, out=self._cells[:len(q_index) * len(rows)].reshape(len(q_index), -1))
        slack = 1e-13 * rows.shape[1] * max(float(self.norms[q_index].max() + np.sqrt((rows * rows).sum(axis=1).max())) ** 2, 1.0)
        bound = self.worst[q_index] + 2 * slack
        with np.errstate(over="ignore"):
            near = least <= np.nextafter(bound.astype(np.float32), np.float32(np.inf))[:, None]
        pairs = np.flatnonzero(near)
        many = np.flatnonzero(np.bincount(pairs // len(rows), minlength=len(q_index)) > MANY_NEAR * self.k)
        if len(many):  # the k rows of least bounds are no farther than these and their errors
            first = np.argpartition(least[many], self.k - 1, axis=1)[:, :self.k]
            error = 2.0 ** -21 * (rows.shape[1] + 8)
            near_rows = rows[first] - self._centre
            own = np.take_along_axis(least[many], first, axis=1) + error * (
                self._squares[q_index[many], None] + (near_rows * near_rows).sum(axis=2))
            bound[many] = np.minimum(bound[many], own.max(axis=1) + 2 * slack)
            near[many] = least[many] <= np.nextafter(bound[many].astype(np.float32), np.float32(np.inf))[:, None]
            pairs = np.flatnonzero(near)
        return pairs

    def _near_double(self, q_index: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The same places from distances in double precision."""
        approx, slack = self._approximate(q_index, rows)
        bound = self.worst[q_index]
        near = approx <= (bound + 2 * slack)[:, None]
        # rows themselves bound a query that many of them are near; after the first blocks that is rarely so
        many = np.flatnonzero(np.count_nonzero(near, axis=1) > self.k)
        if len(many):
            own = np.partition(approx[many], self.k - 1, axis=1)[:, self.k - 1]
            bound[many] = np.minimum(bound[many], own)
            near[many] = approx[many] <= (bound[many] + 2 * slack)[:, None]
        return np.flatnonzero(near)

    def near(self, q: int, dist: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Positions of the at most k scored rows that can still enter the k best of query ``q``."""
        bound = self.worst[q]
        if len(dist) > self.k:
            bound = min(bound, np.partition(dist, self.k - 1)[self.k - 1])
        at = np.flatnonzero(dist <= bound)
        if len(at) > self.k:  # many equal distances: the smallest keys stay
            at = at[np.lexsort((keys[at], dist[at]))[:self.k]]
        return at

    def offer(self, q: np.ndarray, dist: np.ndarray, key: np.ndarray) -> None:
        """Merge scored candidates; keep the k best per query by (distance, key)."""
        if self.key is None:
            self.key = np.empty(self.dist.shape, dtype=key.dtype)
        hit = np.unique(q)
        held_q, held_dist, held_key = np.repeat(hit, self.k), self.dist[hit].ravel(), self.key[hit].ravel()
        filled = np.isfinite(held_dist)
        q = np.concatenate([held_q[filled], q])
        dist = np.concatenate([held_dist[filled], dist])
        key = np.concatenate([held_key[filled], key])
        order = np.lexsort((key, dist, q))
        q, dist, key = q[order], dist[order], key[order]
        start = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        rank = np.arange(len(q)) - np.repeat(start, np.diff(np.r_[start, len(q)]))
        keep = rank < self.k
        self.dist[q[keep], rank[keep]] = dist[keep]
        self.key[q[keep], rank[keep]] = key[keep]

    def results(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query index, key and distance of every row held."""
        q, slot = np.nonzero(np.isfinite(self.dist))
        return q, self.key[q, slot], self.dist[q, slot]


class QueryBlock:
    """A bounded set of query vectors: ids with their Arrow type, and a matrix."""

    def __init__(self, ids: Sequence, id_type: T.DataType, vectors: Sequence[Sequence[float]]):
        self.ids = list(ids)
        self.id_type = id_type
        self.matrix = np.asarray(vectors, dtype=np.float64)


def query_block(queries: DataFrame, qid: str, qvec: str, k: int) -> QueryBlock | None:
    """The query set on the driver if it is small: a query costs a task its vector plus ``k`` keys and distances.

    None if it takes more than ``QUERY_BLOCK_BYTES``.
    """
    frame = queries.select(qid, qvec).where(F.col(qvec).isNotNull())
    n, dim = frame.agg(F.count(F.lit(1)), F.max(F.size(qvec))).first()
    if n * ((dim or 0) + 2 * k) * 8 > QUERY_BLOCK_BYTES:
        return None
    rows = frame.collect()
    return QueryBlock([r[0] for r in rows], queries.schema[qid].dataType, [r[1] for r in rows])


def scan_topk(table: DataFrame, key: str, columns: Sequence[str], block: QueryBlock, qid: str, k: int,
              metric: str, feed: Callable[[TopK, pa.RecordBatch], None]) -> DataFrame:
    """One pass over ``table``; each task emits at most ``k`` rows per query.

    ``feed`` offers one Arrow batch to the task's running top-k, so no pair of
    (query, row) ever becomes a Spark row. The short partial lists are then cut
    to the k best per query; WindowGroupLimit cuts them once more before the shuffle.
    """
    schema = T.StructType([
        T.StructField(qid, block.id_type),
        T.StructField(key, table.schema[key].dataType),
        T.StructField(DISTANCE, T.DoubleType()),
    ])
    ids, matrix, arrow = block.ids, block.matrix, to_arrow_schema(schema)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = TopK(matrix, k, metric)
        for batch in batches:
            if batch.num_rows:
                feed(best, batch)
        if best.key is not None:
            q, found_key, dist = best.results()
            columns = [[ids[i] for i in q], found_key.tolist(), dist.tolist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=f.type) for c, f in zip(columns, arrow)], schema=arrow)

    found = table.select(key, *columns).mapInArrow(partial, schema)
    order = Window.partitionBy(qid).orderBy(DISTANCE, key)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def knn_join(queries: DataFrame, qid: str, qvec: str, table: DataFrame, key: str, column: str,
             k: int = K_DEFAULT, metric: str = "l2") -> DataFrame:
    """Exact k nearest rows of ``table`` for every query: ``(qid, key, _distance, rank)``.

    A query set of bounded size travels to the table, which is read once and not shuffled. A larger one meets it in
    blocks (:mod:`tessera.operators.block_join`), also in one pass and without the driver.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; known: {METRICS}")
    check_column(table, column)
    block = query_block(queries, qid, qvec, k)
    if block is None:
        from tessera.operators.block_join import best_of, flat_join  # imports this module

        dim = vector_dim(queries, qvec)
        return best_of(flat_join(queries, qid, qvec, table, key, column, k, metric, dim), qid, key, k)
    if not block.ids:
        schema = T.StructType([queries.schema[qid], table.schema[key], T.StructField(DISTANCE, T.DoubleType()),
                               T.StructField("rank", T.IntegerType())])
        return queries.sparkSession.createDataFrame([], schema)
    everyone = np.arange(len(block.ids))
    dim = block.matrix.shape[1]

    def feed(best: TopK, batch: pa.RecordBatch) -> None:
        rows, valid = matrix_of(batch.column(column), dim)
        keys = batch.column(key).to_numpy(zero_copy_only=False)[valid]
        best.update(everyone, rows, keys)

    return scan_topk(table, key, [column], block, qid, k, metric, feed)


def search_many(queries: DataFrame, qid: str, qvec: str, table: DataFrame, key: str, column: str,
                select: Sequence[str], k: int = K_DEFAULT, metric: str = "l2") -> DataFrame:
    """kNN join with result columns: the hit list, at most k rows per query, fetches them afterwards.

    A short list travels to the table, so the table is read but not shuffled.
    """
    require_columns(table, select)
    hits = knn_join(queries, qid, qvec, table, key, column, k, metric)
    extra = [c for c in select if c != key]
    return short_list(hits, queries.count() * k).join(table.select(key, *extra), key)


def short_list(hits: DataFrame, at_most: int) -> DataFrame:
    """Mark a hit list for broadcast if it can hold no more than HIT_ROWS rows."""
    return F.broadcast(hits) if at_most <= HIT_ROWS else hits


def query_vector(df: DataFrame, key: str, value, column: str) -> list[float]:
    """The vector of one row, as a query."""
    row: Row | None = df.where(F.col(key) == value).select(column).first()
    if row is None:
        raise ValueError(f"no row with {key} = {value!r}")
    return [float(x) for x in row[0]]


def recall(found: DataFrame, truth: DataFrame, qid: str, key: str) -> DataFrame:
    """Mean share of the exact neighbours that ``found`` holds."""
    t = truth.select(qid, key).withColumn("_truth", F.lit(1))
    f = found.select(qid, key).withColumn("_found", F.lit(1))
    per_query = (
        t.join(f, [qid, key], "left")
        .groupBy(qid).agg((F.count("_found") / F.count("_truth")).alias("_share"))
    )
    return per_query.agg(F.count(F.lit(1)).alias("queries"), F.avg("_share").alias("recall"))
