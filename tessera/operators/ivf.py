"""Inverted-file vector index (IVF_FLAT, IVF_PQ) as Parquet tables.

Layout below one index path::

    model/gen=G/centroids/               part_id, centroid
    model/gen=G/codebooks/               sub, code, codeword          (IVF_PQ only)
    postings/gen=G/delta_id=D/part_id=P/ key, row_version, row_file, vector, code (IVF_PQ only)
    covered/gen=G/delta_id=D/            row_file: the data files a delta has read
    meta/                                one small row per committed change

Deltas follow the table's data files as in :mod:`tessera.operators.stored_index`.

IVF_PQ keeps the vector beside the code: a search reads the code column alone,
and re-ranking reads vectors from the probed partitions instead of the table.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.functions.vectors import matrix_of, pair_distance, row_distance
from tessera.operators.block_join import PART, Score, best_of, block_join, flat_join, flat_score
from tessera.operators.search import (DISTANCE, K_DEFAULT, QueryBlock, TopK, check_dimension, check_k,
                                      nearest, scan_topk, short_list)
from tessera.operators.stored_index import (FILE_NAME, META_SCHEMA, ROW_FILE, FileState, IndexMeta, StoredIndex,  # noqa: F401
                                            reads_files, with_files)
from tessera.session import work_path
from tessera.sources.tables import VERSION

# Centroids and codebooks are copied to every task; their size is checked against this.
MODEL_BYTES = 256 << 20
MODEL_ROWS = 1 << 16
# --- model: centroids -----------------------------------------------------------

def train_centroids(df: DataFrame, column: str, num_partitions: int, seed: int = 42,
                    max_iter: int = 20) -> DataFrame:
    """K-means centroids by Spark ML, as ``(part_id, centroid)``."""
    points = df.where(F.col(column).isNotNull()).select(array_to_vector(F.col(column)).alias("features"))
    model = KMeans(k=num_partitions, seed=seed, maxIter=max_iter, initMode="k-means||").fit(points)
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    return df.sparkSession.createDataFrame(rows, "part_id int, centroid array<double>")


def bounded_rows(frame: DataFrame) -> list[Row]:
    """A small table on the driver; more than MODEL_ROWS rows are refused, not fetched."""
    rows = frame.limit(MODEL_ROWS + 1).collect()
    if len(rows) > MODEL_ROWS:
        raise ValueError(f"a model has at most {MODEL_ROWS} vectors; use fewer partitions")
    return rows


def local_matrix(frame: DataFrame, id_col: str, vec_col: str) -> tuple[list, np.ndarray]:
    """A model table on the driver, in order of its ids, with its size checked."""
    rows = sorted(bounded_rows(frame.select(id_col, vec_col)), key=lambda r: r[0])
    matrix = np.asarray([r[1] for r in rows], dtype=np.float64)
    if matrix.nbytes > MODEL_BYTES:
        raise ValueError(f"model of {matrix.nbytes} bytes exceeds {MODEL_BYTES}; use fewer partitions")
    return [r[0] for r in rows], matrix


def nearest_row(rows: np.ndarray, models: np.ndarray) -> np.ndarray:
    """Index of the closest model vector for each row; the lower index wins a tie."""
    out = np.empty(len(rows), dtype=np.int64)
    step = max(1, (4 << 20) // max(len(models), 1))
    norms = (models * models).sum(axis=1)
    for s in range(0, len(rows), step):
        out[s:s + step] = np.argmin(norms - 2.0 * (rows[s:s + step] @ models.T), axis=1)
    return out


def assign_partitions(df: DataFrame, column: str, part_ids: Sequence[int], centroids: np.ndarray,
                      name: str = "part_id") -> DataFrame:
    """Add the closest centroid's id; rows without a vector are left out of an index."""
    ids, dim = np.asarray(part_ids, dtype=np.int32), centroids.shape[1]

    @F.arrow_udf(T.IntegerType())
    def closest(values: pa.Array) -> pa.Array:
        rows, _ = matrix_of(values, dim)
        return pa.array(ids[nearest_row(rows, centroids)], type=pa.int32())

    return df.where(F.col(column).isNotNull()).withColumn(name, closest(column))


# --- model: product quantiser (Jegou et al., 2011) --------------------------------

def residual(column: str, part: str, part_ids: Sequence[int], centroids: np.ndarray) -> Column:
    """Vector minus the centroid of its partition."""
    by_id = dict(zip(part_ids, range(len(part_ids))))
    dim = centroids.shape[1]

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def subtract(values: pa.Array, parts: pa.Array) -> pa.Array:
        rows, _ = matrix_of(values, dim)
        at = np.fromiter((by_id[p] for p in parts.to_pylist()), dtype=np.int64, count=len(parts))
        out = rows - centroids[at]
        offsets = np.arange(0, out.size + 1, dim, dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(out.ravel()))

    return subtract(column, part)


def check_sub_vectors(dim: int, num_sub_vectors: int) -> int:
    if num_sub_vectors < 1 or dim % num_sub_vectors:
        raise ValueError(f"num_sub_vectors {num_sub_vectors} must divide the dimension {dim}")
    return dim // num_sub_vectors


def train_codebooks(residuals: DataFrame, column: str, dim: int, num_sub_vectors: int,
                    codes: int = 256, max_iter: int = 10) -> DataFrame:
    """K-means for every slice of the residuals at once, as ``(sub, code, codeword)``.

    One pass per iteration serves all slices: each task adds up its rows per
    (slice, code) and sends those few sums, so the cost does not grow with the
    number of sub-vectors and nothing but sums is shuffled.
    """
    width = check_sub_vectors(dim, num_sub_vectors)
    spark = residuals.sparkSession
    # starting words: distinct vectors in hash order, so any partitioning gives the same start
    start = (residuals.select(column).distinct()
             .orderBy(F.xxhash64(column)).limit(codes).collect())
    first = np.asarray([r[0] for r in start], dtype=np.float64)
    books = [first[:, m * width:(m + 1) * width].copy() for m in range(num_sub_vectors)]
    sums = T.StructType([T.StructField("sub", T.IntegerType()), T.StructField("code", T.IntegerType()),
                         T.StructField("n", T.LongType()), T.StructField("total", T.ArrayType(T.DoubleType()))])
    for _ in range(max_iter):
        step = residuals.select(column).mapInArrow(slice_sums(column, books, to_arrow_schema(sums)), sums)
        added = [F.sum(F.col("total")[i]).alias(f"s{i}") for i in range(width)]
        moved = 0.0
        for r in step.groupBy("sub", "code").agg(F.sum("n").alias("n"), *added).collect():
            word = np.asarray([r[f"s{i}"] for i in range(width)]) / r["n"]
            moved = max(moved, float(np.abs(word - books[r["sub"]][r["code"]]).max()))
            books[r["sub"]][r["code"]] = word
        if moved < 1e-6:
            break
    rows = [(m, c, [float(x) for x in word]) for m, book in enumerate(books) for c, word in enumerate(book)]
    return spark.createDataFrame(rows, "sub int, code int, codeword array<double>")


def slice_sums(column: str, books: list[np.ndarray], arrow: pa.Schema):
    """Task side of one k-means step: count and vector sum per (slice, closest code)."""
    width = books[0].shape[1]

    def run(batches):
        counts = [np.zeros(len(b), dtype=np.int64) for b in books]
        totals = [np.zeros_like(b) for b in books]
        for batch in batches:
            rows, _ = matrix_of(batch.column(column), width * len(books))
            for m, book in enumerate(books):
                piece = rows[:, m * width:(m + 1) * width]
                code = nearest_row(piece, book)
                counts[m] += np.bincount(code, minlength=len(book))
                np.add.at(totals[m], code, piece)
        used = [(m, c) for m in range(len(books)) for c in np.flatnonzero(counts[m])]
        columns = [[m for m, _ in used], [int(c) for _, c in used], [int(counts[m][c]) for m, c in used],
                   [totals[m][c].tolist() for m, c in used]]
        yield pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(columns, arrow)], schema=arrow)

    return run


def local_codebooks(frame: DataFrame) -> list[np.ndarray]:
    """Codebooks on the driver, one matrix per slice, rows in code order."""
    books: dict[int, list] = {}
    for r in sorted(bounded_rows(frame.select("sub", "code", "codeword")), key=lambda r: (r["sub"], r["code"])):
        books.setdefault(r["sub"], []).append(r["codeword"])
    return [np.asarray(books[s], dtype=np.float64) for s in sorted(books)]


def encode(column: str | Column, books: list[np.ndarray]) -> Column:
    """Codes of a residual column: the closest codeword per slice."""
    width = books[0].shape[1]
    dim = width * len(books)

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def to_codes(values: pa.Array) -> pa.Array:
        rows, _ = matrix_of(values, dim)
        codes = np.stack([nearest_row(rows[:, m * width:(m + 1) * width], b) for m, b in enumerate(books)], axis=1)
        offsets = np.arange(0, codes.size + 1, len(books), dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(codes.ravel().astype(np.int32)))

    return to_codes(column)


# --- the stored index ---------------------------------------------------------------

class IvfIndex(StoredIndex):
    """An index stored below ``path``; open it with the session that reads it."""

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark, path)
        # by generation of the model
        self._models: dict[int, tuple[list[int], np.ndarray]] = {}
        self._all_books: dict[int, list[np.ndarray]] = {}

    # state

    def centroids(self, meta: IndexMeta | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/model/gen={(meta or self.meta()).model_gen}/centroids")

    def codebooks(self, meta: IndexMeta | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/model/gen={(meta or self.meta()).model_gen}/codebooks")

    def model(self, meta: IndexMeta | None = None) -> tuple[list[int], np.ndarray]:
        """Partition ids and centroids on the driver; read once for each generation of the model."""
        meta = meta or self.meta()
        if meta.model_gen not in self._models:
            self._models = {meta.model_gen: local_matrix(self.centroids(meta), "part_id", "centroid")}
        return self._models[meta.model_gen]

    def books(self, meta: IndexMeta | None = None) -> list[np.ndarray]:
        meta = meta or self.meta()
        if meta.model_gen not in self._all_books:
            self._all_books = {meta.model_gen: local_codebooks(self.codebooks(meta))}
        return self._all_books[meta.model_gen]

    # writing

    @classmethod
    def build(cls, df: DataFrame, path: str, *, key: str, column: str, index_name: str,
              index_type: str = "IVF_FLAT", num_partitions: int = 16, num_sub_vectors: int | None = None,
              codes: int = 256, metric: str = "l2", centroids: DataFrame | None = None,
              codebooks: DataFrame | None = None, seed: int = 42, train_fraction: float = 1.0,
              replace_existing: bool = True) -> IvfIndex:
        """Build from all rows of ``df``; the same call again replaces the index.

        ``train_fraction`` limits only the rows the centroids and codebooks are fitted
        on, which is worth doing on very large tables; every row is indexed regardless.
        """
        index = cls(df.sparkSession, path)
        gen, meta_id = index._next(replace_existing)
        if index_type not in ("IVF_FLAT", "IVF_PQ"):
            raise ValueError(f"vector index type must be IVF_FLAT or IVF_PQ, got {index_type!r}")
        if index_type == "IVF_PQ" and metric != "l2":
            raise ValueError("IVF_PQ codes keep squared Euclidean distance only")
        training = df.where(F.col(column).isNotNull()).select(column)
        if train_fraction < 1.0:
            # written once: every pass of the training would otherwise read the whole table
            chosen = work_path(df.sparkSession, "ivf-training")
            training.sample(train_fraction, seed).write.parquet(chosen)
            training = df.sparkSession.read.parquet(chosen)
        if centroids is None:
            centroids = train_centroids(training, column, num_partitions, seed)
        part_ids, matrix = local_matrix(centroids, "part_id", "centroid")
        dim, books = matrix.shape[1], None
        if index_type == "IVF_PQ":
            if codebooks is None:
                check_sub_vectors(dim, num_sub_vectors or 0)
                assigned = assign_partitions(training, column, part_ids, matrix)
                left = assigned.select(residual(column, "part_id", part_ids, matrix).alias("residual"))
                codebooks = train_codebooks(left, "residual", dim, num_sub_vectors, codes)
            books = local_codebooks(codebooks)
            index._all_books[gen] = books
        index._models[gen] = part_ids, matrix
        index._write_model(gen, part_ids, matrix, books)
        params = json.dumps({"num_partitions": len(part_ids), "num_sub_vectors": num_sub_vectors}, sort_keys=True)
        meta = IndexMeta(meta_id, gen, 0, 0, index_name, column, key, index_type, metric, dim, params, gen)
        _, covered = index._write_delta(df, meta, 0)
        index._commit(replace(meta, covered_version=covered))
        return index

    def _write_model(self, gen: int, part_ids: Sequence[int], matrix: np.ndarray, books: list[np.ndarray] | None) -> None:
        """Store centroids and codebooks as one generation of the model."""
        self.spark.createDataFrame([(int(p), c.tolist()) for p, c in zip(part_ids, matrix)],
                                   "part_id int, centroid array<double>").coalesce(1).write.mode(
            "overwrite").parquet(f"{self.path}/model/gen={gen}/centroids")
        if books is not None:
            self.spark.createDataFrame(
                [(m, c, w.tolist()) for m, book in enumerate(books) for c, w in enumerate(book)],
                "sub int, code int, codeword array<double>").coalesce(1).write.mode(
                "overwrite").parquet(f"{self.path}/model/gen={gen}/codebooks")

    def _write_delta(self, df: DataFrame, meta: IndexMeta, delta_id: int,
                     files: FileState | None = None) -> tuple[int, int]:
        """One scan reads the vectors; the newest version needs its column alone, and rows are counted in what was written."""
        df = with_files(df)
        if VERSION not in df.columns:
            df = df.withColumn(VERSION, F.lit(0).cast("long"))
        newest = df.agg(F.max(VERSION)).first()[0]
        self._note_covered(df, meta, delta_id, files)
        part_ids, matrix = self.model(meta)
        rows = assign_partitions(df.select(meta.key_name, VERSION, ROW_FILE, meta.column_name), meta.column_name,
                                 part_ids, matrix)
        if meta.index_type == "IVF_PQ":
            rows = rows.withColumn("code", encode(residual(meta.column_name, "part_id", part_ids, matrix), self.books(meta)))
        self._write_postings(rows.withColumn(VERSION, F.col(VERSION).cast("long")).withColumnRenamed(VERSION, "row_version"), meta.gen, delta_id)
        added = self.spark.read.schema("row_version long").parquet(
            f"{self.path}/postings/gen={meta.gen}/delta_id={delta_id}").count()
        return added, meta.covered_version if newest is None else max(newest, meta.covered_version)

    def _write_postings(self, rows: DataFrame, gen: int, delta_id: int) -> None:
        """Write postings by partition id.

        Rebalancing gathers small partitions into few files and, from the shuffle
        sizes seen at run time, cuts one that holds a large share of all rows over
        several tasks; no sampling pass over the vectors is needed.
        """
        (rows.hint("rebalance", F.col("part_id"))
             .write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("part_id")
             .parquet(f"{self.path}/postings/gen={gen}/delta_id={delta_id}"))

    def expected_entries(self, df: DataFrame, meta: IndexMeta) -> DataFrame:
        rows = with_files(df).where(F.col(meta.column_name).isNotNull())
        return self._hashed(rows.select(meta.key_name, ROW_FILE, meta.column_name), meta)

    def _hashed(self, entries: DataFrame, meta: IndexMeta) -> DataFrame:
        return entries.select(ROW_FILE, F.lit(1).alias("weight"), F.xxhash64(meta.key_name, meta.column_name).alias("hash"))

    # reading

    def probes(self, vectors: np.ndarray, nprobes: int, meta: IndexMeta | None = None) -> np.ndarray:
        """Ids of the ``nprobes`` closest partitions per query, closest first."""
        near = nearest_partitions(*self.model(meta), nprobes)
        return np.asarray([near(v) for v in vectors])

    def search_join(self, queries: DataFrame, qid: str, qvec: str, k: int | None = K_DEFAULT, nprobes: int = 1,
                    refine_factor: int | None = None, table: DataFrame | None = None,
                    include_unindexed: bool = True) -> DataFrame:
        """Approximate k nearest per query: ``(qid, key, _distance, rank)``; any number of queries.

        With ``k`` None, every row of the probed partitions that has a distance: ``(qid, key, _distance)``, unranked, so no
        task holds or orders the rows of a query.

        Queries are exploded to the partitions they probe and meet their postings there, in blocks of bounded size
        (:mod:`tessera.operators.block_join`); neither side passes the driver, and the postings are read once. With
        ``refine_factor`` the best ``refine_factor * k`` of each query are ranked again by exact distance. ``table`` works
        as in :meth:`search`: postings of files it no longer has are passed over, and its unindexed rows are compared
        exactly. Queries without a vector have no rows.
        """
        meta = self.meta()
        if k is not None:
            check_k(k)
        elif refine_factor is not None:
            raise ValueError("refine_factor needs a k")
        if refine_factor is not None and refine_factor < 1:
            raise ValueError(f"refine_factor must be at least 1, got {refine_factor}")
        files = self.file_state(table, meta)
        postings = self._alive(self.postings(meta), files)
        asked = queries.where(F.col(qvec).isNotNull()).select(qid, qvec)
        if k is None:
            pairs = self._probing(meta, asked, qid, qvec, nprobes).withColumnRenamed(qvec, "_asked").join(
                postings.withColumnRenamed(meta.key_name, "_key"), PART)
            hits = pairs.select(qid, F.col("_key").alias(meta.key_name), self._pair_distance(meta).alias(DISTANCE))
            if include_unindexed and table is not None and (files is None or files.fresh):
                fresh = table.where(self._unindexed(table, meta, files) & F.col(meta.column_name).isNotNull())
                exact = pair_distance(meta.column_name, "_asked", meta.dim, meta.metric).alias(DISTANCE)
                hits = hits.unionByName(fresh.select(meta.key_name, meta.column_name).crossJoin(
                    asked.withColumnRenamed(qvec, "_asked")).select(qid, meta.key_name, exact))
            return hits.where(F.col(DISTANCE) < float("inf"))  # NaN is above infinity
        want = k * (refine_factor or 1)
        flat = meta.index_type == "IVF_FLAT"
        value = meta.column_name if flat else "code"
        score = flat_score(meta.key_name, value, meta.dim) if flat else self._code_score(meta)
        row_bytes = 8 * (meta.dim if flat else len(self.books(meta)))
        hits = block_join(self._probing(meta, asked, qid, qvec, nprobes), postings.select(PART, meta.key_name, value), qid, qvec,
                          meta.key_name, want, meta.metric, meta.dim, row_bytes, score)
        if refine_factor is not None:
            order = Window.partitionBy(qid).orderBy(DISTANCE, meta.key_name)
            listed = hits.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= want)
            vectors = postings.select(PART, meta.key_name, F.col(meta.column_name).alias("_vector"))
            pairs = listed.select(qid, PART, meta.key_name).join(vectors, [PART, meta.key_name]).join(
                asked.withColumnRenamed(qvec, "_asked"), qid)
            hits = pairs.withColumn(DISTANCE, pair_distance("_vector", "_asked", meta.dim, meta.metric))
        hits = hits.select(qid, meta.key_name, DISTANCE)
        if include_unindexed and table is not None and (files is None or files.fresh):
            fresh = table.where(self._unindexed(table, meta, files))
            hits = hits.unionByName(flat_join(asked, qid, qvec, fresh, meta.key_name, meta.column_name, k, meta.metric,
                                              meta.dim).select(qid, meta.key_name, DISTANCE))
        return best_of(hits, qid, meta.key_name, k)

    def _probing(self, meta: IndexMeta, queries: DataFrame, qid: str, qvec: str, nprobes: int) -> DataFrame:
        """``part_id``, ``qid``, ``qvec``: a row for each partition that a query probes."""
        dim = meta.dim
        part_ids, matrix = self.model(meta)
        near = nearest_partitions(part_ids, matrix, nprobes)

        @F.arrow_udf(T.ArrayType(T.IntegerType()))
        def probed(vectors: pa.Array) -> pa.Array:
            rows, _ = matrix_of(vectors, dim)
            return pa.array([near(v).tolist() for v in rows], pa.list_(pa.int32()))

        return queries.withColumn("_parts", probed(qvec)).select(F.explode("_parts").alias(PART), qid, qvec)

    def _pair_distance(self, meta: IndexMeta) -> Column:
        """Distance of each posting to the query ``_asked`` beside it, from its vector or its code."""
        if meta.index_type == "IVF_FLAT":
            return pair_distance(meta.column_name, "_asked", meta.dim, meta.metric)
        part_ids, matrix = self.model(meta)
        books, dim = self.books(meta), meta.dim

        @F.arrow_udf(T.DoubleType())
        def coded(parts: pa.Array, asked: pa.Array, codes: pa.Array) -> pa.Array:
            ids, order = np.asarray(part_ids), np.argsort(part_ids)
            at = order[np.searchsorted(ids[order], parts.to_numpy(zero_copy_only=False))]
            left = matrix_of(asked, dim)[0] - matrix[at]
            return pa.array(adc_distance(left, codes.flatten().to_numpy().reshape(-1, len(books)), books))

        return coded(PART, "_asked", "code")

    def _code_score(self, meta: IndexMeta) -> Score:
        """Distances from codes: bounded by products with the decoded rows, settled slice by slice."""
        part_ids, matrix = self.model(meta)
        row_of, books, key = dict(zip(part_ids, range(len(part_ids)))), self.books(meta), meta.key_name

        def score(best: TopK, part: int, rows: pa.Table) -> None:
            codes = rows.column("code").combine_chunks().flatten().to_numpy().reshape(-1, len(books))
            keys = rows.column(key).to_numpy()
            left = best.queries - matrix[row_of[part]]
            near, everyone = TopK(left, best.k, "l2"), np.arange(len(left))
            near.dist, near.key = best.dist, best.key
            for s in range(0, len(codes), 8192):
                some = codes[s:s + 8192]
                decoded = np.concatenate([book[some[:, m]] for m, book in enumerate(books)], axis=1)
                near.update(everyone, decoded, keys[s:s + 8192],
                            lambda q, r, decoded=decoded: sliced_distance(left[q], decoded[r], len(books)))
            best.dist, best.key = near.dist, near.key

        return score

    def _searcher(self, meta: IndexMeta, postings: DataFrame, qid: str, k: int,
                  nprobes: int) -> Callable[[QueryBlock], DataFrame]:
        """Search of one query block over the partitions it probes."""
        flat = meta.index_type == "IVF_FLAT"
        value = meta.column_name if flat else "code"
        part_ids, matrix = self.model(meta)
        row_of = dict(zip(part_ids, range(len(part_ids))))
        books = None if flat else self.books(meta)

        def run(block: QueryBlock) -> DataFrame:
            probed = self.probes(block.matrix, nprobes, meta)
            wanted: dict[int, list[int]] = {}
            for q, parts in enumerate(probed):
                for p in parts:
                    wanted.setdefault(int(p), []).append(q)
            by_part = {p: np.asarray(qs) for p, qs in wanted.items()}

            def feed(best: TopK, batch: pa.RecordBatch) -> None:
                parts = batch.column("part_id").to_numpy(zero_copy_only=False)
                keys = batch.column(meta.key_name).to_numpy(zero_copy_only=False)
                if flat:
                    rows, _ = matrix_of(batch.column(value), meta.dim)
                else:
                    codes = batch.column(value).flatten().to_numpy().reshape(-1, len(books))
                scored = []
                for p in np.unique(parts):
                    at = np.flatnonzero(parts == p)
                    if flat:
                        best.update(by_part[p], rows[at], keys[at])
                        continue
                    for q in by_part[p]:
                        dist = adc_distance(best.queries[q] - matrix[row_of[p]], codes[at], books)
                        near = best.near(q, dist, keys[at])
                        scored.append((np.full(len(near), q), dist[near], keys[at[near]]))
                if scored:
                    best.offer(*(np.concatenate(c) for c in zip(*scored)))

            pruned = postings.where(F.col("part_id").isin(sorted(by_part)))
            return scan_topk(pruned, meta.key_name, ["part_id", value], block, qid, k, meta.metric, feed)

        return run

    def search(self, vector: Sequence[float], k: int = K_DEFAULT, nprobes: int = 1,
               refine_factor: int | None = None, table: DataFrame | None = None,
               include_unindexed: bool = True) -> DataFrame:
        """Search for one vector; ``(key, _distance)`` in ascending distance.

        ``refine_factor`` re-ranks ``refine_factor * k`` candidates by exact distance.
        Rows of ``table`` that are not in the index yet are scanned flat, and postings of
        rows it no longer has are passed over, so appends, deletes and rewritten rows
        show at once. Without ``table`` the index answers as of its last change.
        """
        meta = self.meta()
        check_k(k)
        check_dimension(vector, meta.column_name, meta.dim)
        if refine_factor is not None and refine_factor < 1:
            raise ValueError(f"refine_factor must be at least 1, got {refine_factor}")
        want = k * (refine_factor or 1)
        files = self.file_state(table, meta)
        postings = self._alive(self.postings(meta), files)
        one = QueryBlock([0], T.IntegerType(), [vector])
        hits = self._searcher(meta, postings, "_q", want, nprobes)(one).select(meta.key_name, DISTANCE)
        if refine_factor is not None:
            probed = [int(p) for p in self.probes(one.matrix, nprobes, meta)[0]]
            listed = short_list(hits.select(meta.key_name), want)
            candidates = postings.where(F.col("part_id").isin(probed)).join(listed, meta.key_name, "left_semi")
            hits = nearest(candidates, vector, meta.column_name, meta.key_name, k, meta.metric).select(
                meta.key_name, DISTANCE)
        if include_unindexed and table is not None and (files is None or files.fresh):
            fresh = table.where(self._unindexed(table, meta, files))
            hits = hits.unionByName(
                nearest(fresh, vector, meta.column_name, meta.key_name, k, meta.metric).select(
                    meta.key_name, DISTANCE))
        return hits.orderBy(DISTANCE, meta.key_name).limit(k)

def nearest_partitions(part_ids: Sequence[int], matrix: np.ndarray, nprobes: int) -> Callable[[np.ndarray], np.ndarray]:
    """Function of a vector: ids of its ``nprobes`` closest partitions, closest first."""
    ids = np.asarray(part_ids)

    def near(vector: np.ndarray) -> np.ndarray:
        return ids[np.lexsort((ids, row_distance(matrix, vector, "l2")))[:nprobes]]

    return near


def adc_distance(query_residual: np.ndarray, codes: np.ndarray, books: list[np.ndarray]) -> np.ndarray:
    """Asymmetric distance of one query, by a lookup table per slice summed over the codes, or of a query for each row."""
    width = books[0].shape[1]
    total = np.zeros(len(codes))
    for m, book in enumerate(books):
        piece = query_residual[..., m * width:(m + 1) * width]
        total += row_distance(book, piece, "l2")[codes[:, m]] if piece.ndim == 1 else row_distance(book[codes[:, m]], piece, "l2")
    return total


def sliced_distance(query_residuals: np.ndarray, decoded: np.ndarray, slices: int) -> np.ndarray:
    """:func:`adc_distance` of each query and the decoded row beside it, summed in the same order."""
    diff = query_residuals - decoded
    parts = (diff * diff).reshape(len(diff), slices, -1).sum(axis=2)
    total = np.zeros(len(diff))
    for m in range(slices):
        total += parts[:, m]
    return total


def index_coverage(indexed: Column, total: Column) -> Column:
    """Covered share with four decimals; an empty table counts as uncovered."""
    share = F.when(total > 0, indexed / total).otherwise(F.lit(0.0))
    return share.cast("decimal(5,4)")
