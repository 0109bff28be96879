"""Embeddings projected on their principal components and scaled to unit variance."""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import query
from tessera.llm.common import given, saved

#: Fixed values of the query: an entry c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
#: Entries whose scaled size reaches this have no exact long; they count as not finite.
LARGEST = 2.0**62
#: A covariance (dimension squared doubles) goes through the driver; 4,096 dimensions are 128 MB.
MAX_DIMENSION = 4096

EPS = np.finfo(float).eps


# Spectral divide and conquer ------------------------------------------------------------------------------------------

def polar_factor(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix by QR-based dynamically weighted Halley steps.

    Each step is one QR of [sqrt(c) X; I]; the weights follow a lower bound on the smallest singular value, so six or
    seven steps do even if that bound is the rounding unit.
    """
    n = len(a)
    x = a / (np.linalg.norm(a, "fro") or 1.0)
    low = EPS
    for _ in range(30):
        square = low * low
        d = np.cbrt(4 * (1 - square) / (square * square))
        root = math.sqrt(1 + d)
        wa = root + 0.5 * math.sqrt(8 - 4 * d + 8 * (2 - square) / (square * root))
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        q = np.linalg.qr(np.vstack([math.sqrt(wc) * x, np.eye(n)]))[0]
        new = wb / wc * x + (wa - wb / wc) / math.sqrt(wc) * (q[:n] @ q[n:].T)
        new = (new + new.T) / 2
        moved = np.linalg.norm(new - x, "fro")
        x, low = new, min(low * (wa + wb * square) / (1 + wc * square), 1.0 - EPS)
        if moved < 10 * math.sqrt(n) * EPS or (moved < n * np.cbrt(EPS) * 1e-2 and low > 1 - 1e-8):
            break
    return x


def _split(a: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, int] | None:
    """An orthogonal matrix whose first r columns span the invariant subspace above a shift, and r; None if all are equal."""
    n, size = len(a), np.linalg.norm(a, "fro")
    mean = np.trace(a) / n
    if np.linalg.norm(a - mean * np.eye(n), "fro") <= 4 * n * EPS * size:
        return None
    spread = np.linalg.norm(a - mean * np.eye(n), "fro") / math.sqrt(n)
    best = None
    for shift in (0.0, 0.1, -0.1, 0.3, -0.3, 0.03, -0.03, 0.6, -0.6):  # another one where an eigenvalue is too near
        u = polar_factor(a - (mean + shift * spread) * np.eye(n))
        projector = (u + np.eye(n)) / 2
        rank = int(round(np.trace(projector)))
        if not 0 < rank < n:
            continue
        basis = np.linalg.qr(projector @ rng.standard_normal((n, rank)))[0]
        basis = np.linalg.qr(projector @ basis, mode="complete")[0]
        off = np.linalg.norm(basis[:, rank:].T @ a @ basis[:, :rank], "fro")
        if best is None or off < best[0]:
            best = off, basis, rank
        if off <= 50 * n * EPS * size:
            break
    return None if best is None else best[1:]


def principal_components(covariance: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as columns.

    Polar factors of the shifted matrix give projectors on the eigenvectors above and below the shift; both invariant
    subspaces are split again until they have one dimension, or equal eigenvalues. The lower one is left alone once the
    upper holds ``k``. The largest entry of a vector is positive. Equal eigenvalues: any basis of their space, the same
    on every run.
    """
    rng = np.random.default_rng(0)
    done: list[tuple[float, np.ndarray]] = []
    parts = [(np.eye(len(covariance)), (covariance + covariance.T) / 2)]
    while parts and len(done) < k:
        basis, a = parts.pop()
        cut = _split(a, rng) if len(a) > 1 else None
        if cut is None:
            done += [(float(a[i, i]), basis[:, i]) for i in range(len(a))]
            continue
        turn, rank = cut
        inner = turn.T @ a @ turn
        for part in (slice(rank, None), slice(0, rank)):  # the upper one is taken up first
            block = inner[part, part]
            parts.append((basis @ turn[:, part], (block + block.T) / 2))
    done = sorted(done, key=lambda pair: -pair[0])[:k]
    vectors = np.array([v / np.linalg.norm(v) for _, v in done]).T.reshape(len(covariance), -1)
    values = np.array([v @ covariance @ v for v in vectors.T])
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), range(vectors.shape[1])])
    return values, vectors * signs


# Moments over the cluster ---------------------------------------------------------------------------------------------

def _usable(column: pa.ListArray, dimension: int | None) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Row numbers that have only finite entries, by length, as matrices of x (only of ``dimension`` if given)."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy()
    flat = column.flatten()
    values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)  # NULL entries become NaN
    starts = np.concatenate([[0], np.cumsum(lengths)])
    out = {}
    for length in np.unique(lengths) if dimension is None else [dimension]:
        rows = np.flatnonzero(lengths == length)
        if not length or not len(rows):
            continue
        matrix = values[starts[rows][:, None] + np.arange(length)]
        scaled = np.floor(SCALE * matrix)
        good = (np.abs(scaled) < LARGEST).all(axis=1)
        out[int(length)] = rows[good], scaled[good].astype(np.int64) + SHIFT
    return lengths, out


def _sum_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number of vectors and exact sums of x for each length, one row a task and length."""
    counts: dict[int, int] = {}
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for length, (_, x) in _usable(batch.column(0), None)[1].items():
            big = x.size and int(np.abs(x).max()) * len(x) >= 2**62
            part = (x.astype(object) if big else x).sum(axis=0)
            counts[length] = counts.get(length, 0) + len(x)
            sums[length] = sums.get(length, 0) + part.astype(object)
    rows = [(length, n, [str(s) for s in sums[length]]) for length, n in counts.items() if n]
    yield pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()),
         pa.array([r[2] for r in rows], pa.list_(pa.string()))], names=["dimension", "n", "sums"])


def _outer(centred, dimension: int):
    """Arrow function of the sums of products of ``centred(batch)``, a matrix; one row a task and matrix row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dimension, dimension))
        for batch in batches:
            y = centred(batch)
            total += y.T @ y
        if total.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(dimension), pa.int32()), pa.array([r.tobytes() for r in total], pa.binary())], names=["i", "part"])
    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of each matrix row added; a task holds the matrix rows it was dealt."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, part in zip(batch.column("i").to_pylist(), batch.column("part").to_pylist()):
            sums[i] = sums.get(i, 0.0) + np.frombuffer(part)
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(sums), pa.int32()), pa.array([r.tobytes() for r in sums.values()], pa.binary())], names=["i", "part"])


def _matrix(parts: DataFrame, dimension: int) -> np.ndarray:
    """Sum of the tasks' matrices: dealt by matrix row and salt first, so that no task adds all parts of a row."""
    salted = parts.withColumn("salt", (F.rand(1) * 16).cast("int")).repartition("i", "salt").select("i", "part")
    halves = salted.mapInArrow(_added, "i int, part binary").repartition("i").mapInArrow(_added, "i int, part binary")
    out = np.zeros((dimension, dimension))
    for row in halves.collect():  # ``dimension`` rows
        out[row.i] = np.frombuffer(row.part)
    return out


def vector_sums(vectors: DataFrame) -> tuple[int, list[int]]:
    """How many usable vectors of the commonest length there are, and the exact sums of their x.

    Equally common lengths: the longer one.
    """
    found: dict[int, tuple[int, list[int]]] = {}
    for row in vectors.mapInArrow(_sum_rows, "dimension int, n long, sums array<string>").toLocalIterator():
        n, sums = found.get(row.dimension, (0, [0] * row.dimension))
        found[row.dimension] = n + row.n, [a + int(b) for a, b in zip(sums, row.sums)]
    return max(found.values(), key=lambda v: (v[0], len(v[1])), default=(0, []))


def covariance(vectors: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """Covariance of the x of usable vectors, centred before multiplying, divisor ``n``."""
    dimension = len(sums)
    mean = _mean(n, sums)
    parts = vectors.mapInArrow(_outer(lambda batch: _centred(_usable(batch.column(0), dimension)[1], mean), dimension),
                               "i int, part binary")
    return _matrix(parts, dimension) / n


def _mean(n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The mean as a whole part and the rest, so that subtracting it from large x loses nothing."""
    whole = [s // n for s in sums]
    return np.array(whole, np.int64), np.array([(s - w * n) / n for s, w in zip(sums, whole)])


def _centred(usable: dict, mean: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    whole, rest = mean
    if len(whole) not in usable:
        return np.zeros((0, len(whole)))
    return (usable[len(whole)][1] - whole).astype(float) - rest


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """Exact sums of (n x - S) squared; NULL beyond 38 digits."""
    whole = np.array([s // n for s in sums], np.int64)
    reach = n * (int(np.abs(x - whole).max()) + 1) if x.size else 0
    if reach * reach * len(sums) < 2**62:
        rest = np.array([s % n for s in sums], np.int64)
        z = (x - whole) * n - rest
        return pa.array((z * z).sum(axis=1)).cast(pa.decimal128(38, 0))
    z = x.astype(object) * n - np.array(sums, object)
    return pa.array([Decimal(v) if v < 10**38 else None for v in (z * z).sum(axis=1)], pa.decimal128(38, 0))


def _whitened(shared, id_name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, scaled = shared.value
        mean = _mean(n, sums)
        for batch in batches:
            usable = _usable(batch.column(1), len(sums))[1]
            if len(sums) not in usable:
                continue
            rows, x = usable[len(sums)]
            y = _centred(usable, mean) @ scaled
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1, dtype=np.int32) * y.shape[1]), pa.array(y.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), _deviations(x, n, sums), lists],
                                             names=[id_name, "deviation", "whitened"])
    return run


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 8) -> DataFrame:
    """``id_col``, ``component`` (1 to ``k``), ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``.

    Entries are made whole numbers x (fixed point). One pass takes their exact sums, a second the covariance of centred
    x; task sums are added over the cluster, and the matrix of dimension squared goes to the driver, which finds the
    components (:func:`principal_components`) and broadcasts ``dimension x k`` numbers. A third pass writes each vector's
    whitened coordinates, from which ``identity_error`` is measured: the largest entry of their covariance less identity.

    Vectors that are NULL, empty, of another length than the commonest, or hold a NULL, non-finite or too large entry
    (2**62 after scaling) are left out. NULL and repeated ids: rows of their own. Components without variance:
    ``whitened`` is NULL, ``explained`` 0. Empty table: no rows. ``deviation`` is decimal(38, 0), NULL beyond.
    Up to ``MAX_DIMENSION`` dimensions. Other columns are not looked at.
    """
    spark = vectors.sparkSession
    both = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    only = both.select("v")
    n, sums = vector_sums(only)
    if len(sums) > MAX_DIMENSION:
        raise ValueError(f"{len(sums)} dimensions; at most {MAX_DIMENSION} are supported")
    kind = both.schema["id"].dataType.simpleString()
    shape = f"{id_col} {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if not n:
        return spark.createDataFrame([], shape)
    spread = covariance(only, n, sums)
    values, components = principal_components(spread, k)
    alive = values > len(sums) * EPS * max(values[0], 0.0)
    scaled = components[:, alive] / np.sqrt(values[alive])
    shared = spark.sparkContext.broadcast((n, sums, scaled))
    done = saved(both.mapInArrow(_whitened(shared, "id"), f"id {kind}, deviation decimal(38,0), whitened array<double>"), "whitened")
    error = _identity_error(done, n, int(alive.sum()))
    trace = float(np.trace(spread))
    explained = F.array(*[F.lit(float(v) / trace if trace and live else 0.0) for v, live in zip(values, alive)])
    out = done.select(F.col("id").alias(id_col), "deviation", "whitened", F.posexplode(explained).alias("at", "explained"))
    return out.select(
        id_col, (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
        F.get("whitened", F.col("at")).alias("whitened"), "explained", F.lit(error).cast("double").alias("identity_error"))


def _identity_error(done: DataFrame, n: int, live: int) -> float | None:
    if not live:
        return None
    means = done.agg(*[F.avg(F.get("whitened", F.lit(i))).alias(f"m{i}") for i in range(live)]).first()
    mean = np.array(list(means))

    def centred(batch: pa.RecordBatch) -> np.ndarray:
        return batch.column(0).flatten().to_numpy().reshape(-1, live) - mean

    return float(np.abs(_matrix(done.select("whitened").mapInArrow(_outer(centred, live), "i int, part binary"), live) / n
                        - np.eye(live)).max())


@query("op11_whitening")
def op11_whitening(spark, sf_dir):
    out = whiten(given(spark, sf_dir, "embeddings"))
    return out.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))
