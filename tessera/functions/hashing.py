"""Deterministic text vectors from SHA-256.

Recipe: digest(utf8(text) + 4-byte big-endian counter) for counter 0, 1, ...;
the digests joined are big-endian 32-bit words w, and each value is
(w - h) / h with h = (2^32 - 1) / 2, which lies in [-1, 1].
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

# Fixed values of the recipe
DEFAULT_DIM = 384
WORD_BYTES = 4
DIGEST_BYTES = 32
HALF = ((1 << 32) - 1) / 2.0


def check_dim(dim: int) -> None:
    if dim <= 0:
        raise ValueError(f"a vector needs at least one element: dim={dim}")
    if dim % WORD_BYTES:
        raise ValueError(f"dim={dim} leaves a part of a {WORD_BYTES}-element word")


def rounds(dim: int) -> int:
    return -(-dim * WORD_BYTES // DIGEST_BYTES)


def hash_vectors(texts: list[str], dim: int = DEFAULT_DIM) -> np.ndarray:
    """Vectors of a batch of texts as a float32 matrix.

    The text is digested once; each counter continues from a copy of that state,
    so long texts are not read again for every round.
    """
    check_dim(dim)
    counters = [n.to_bytes(4, "big") for n in range(rounds(dim))]
    buffer = bytearray()
    for text in texts:
        if not isinstance(text, str):
            raise TypeError(f"only str can be hashed here, not {type(text).__name__}")
        state = hashlib.sha256(text.encode("utf-8"))
        digests = bytearray()
        for counter in counters:
            step = state.copy()
            step.update(counter)
            digests += step.digest()
        buffer += digests[:dim * WORD_BYTES]
    words = np.frombuffer(bytes(buffer), dtype=">u4").astype(np.float64).reshape(len(texts), dim)
    return ((words - HALF) / HALF).astype(np.float32)


def hash_embedding(text: str | Column, dim: int = DEFAULT_DIM) -> Column:
    """Vector column by Arrow batches; NULL text gives NULL."""
    check_dim(dim)

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def vectors(values: pa.Array) -> pa.Array:
        present = values.drop_null()
        flat = pa.array(hash_vectors(present.to_pylist(), dim).ravel())
        ends = np.cumsum(np.r_[0, values.is_valid().to_numpy(zero_copy_only=False)]) * dim
        offsets = pa.array(ends.astype(np.int32), mask=np.r_[values.is_null().to_numpy(zero_copy_only=False), False])
        return pa.ListArray.from_arrays(offsets, flat)

    return vectors(text)


def hash_embedding_expr(text: Column, dim: int = DEFAULT_DIM) -> Column:
    """The same recipe in built-in functions only; every round reads the whole text."""
    check_dim(dim)
    payload = F.encode(text, "UTF-8")
    per_round = DIGEST_BYTES // WORD_BYTES
    values = []
    for n in range(rounds(dim)):
        digest = F.sha2(F.concat(payload, F.unhex(F.lit(f"{n:08x}"))), 256)
        for j in range(min(per_round, dim - n * per_round)):
            word = F.conv(F.substring(digest, 8 * j + 1, 8), 16, 10).cast("double")
            values.append(((word - F.lit(HALF)) / F.lit(HALF)).cast("float"))
    return F.array(*values)
