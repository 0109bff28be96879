"""Texts stored as lossless images, read back, and described by features."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import query
from tessera.llm.common import batch_of, binary_values, given
from tessera.llm.webp import MAX_SIDE, encode, samples_of

#: Payloads fill whole units of so many bytes; an image row holds one unit.
UNIT = 64
#: Bytes of one image at most; a longer payload is a run of images.
IMAGE_BYTES = UNIT * MAX_SIDE


def padded(text: bytes | None) -> bytes:
    raw = text or b""
    return raw + bytes(-len(raw) % UNIT or (0 if raw else UNIT))


def store(payload: bytes) -> bytes:
    """The payload as images of ``UNIT`` columns, one after the other; each file's header tells its length."""
    return b"".join(encode(payload[i:i + IMAGE_BYTES], UNIT) for i in range(0, len(payload), IMAGE_BYTES))


def images_in(stored: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(stored):
        end = at + 8 + struct.unpack_from("<I", stored, at + 4)[0]
        yield stored[at:end]
        at = end


def load(stored: bytes) -> bytes:
    return b"".join(samples_of(image) for image in images_in(stored))


def feature(payload: bytes) -> str:
    """Mean and standard deviation of the samples, distinct samples, and the mean step from one to the next."""
    x = np.frombuffer(payload, np.uint8)
    n = np.bincount(x, minlength=256)
    at = np.arange(256)
    mean = float((n * at).sum()) / len(x)
    spread = max(0.0, float((n * at * at).sum()) / len(x) - mean * mean) ** 0.5
    step = float(np.abs(np.diff(x.astype(np.int16))).sum()) / max(1, len(x) - 1)
    return f"{mean:.4f},{spread:.4f},{int((n > 0).sum())},{step:.4f}"


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_bytes`` and ``media``: each whole text as lossless images.

    The payload is the text in UTF-8 with bytes 0 up to a positive multiple of 64; its bytes are the green samples of
    images 64 pixels wide. A map over rows: nothing is shuffled, and a task holds a batch at a time.

    NULL or empty text: 64 zero bytes. NULL id: kept. Repeated rows: a row each. Texts over 1 MiB: several images.
    Empty table: no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = pa.schema([("n_bytes", pa.int64()), ("media", pa.binary())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                out = batch_of(schema, [(len(t or b""), store(padded(t))) for t in binary_values(part.column(1))])
                yield pa.RecordBatch.from_arrays([part.column(0), *out.columns], names=["id", "n_bytes", "media"])

    out = docs.select(id_col, text_col).mapInArrow(pack, f"id {kind}, n_bytes long, media binary")
    return out.withColumnRenamed("id", id_col)


def describe(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Facts about the payloads read back from the stored ``media``."""
    kind = media.schema[id_col].dataType.simpleString()
    schema = pa.schema([("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()),
                        ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])

    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for stored in binary_values(batch.column(2)):
                payload = load(stored)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(stored),
                             hashlib.sha256(stored).hexdigest(), feature(payload)))
            out = batch_of(schema, rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *out.columns],
                                             names=["id", "n_bytes", *schema.names])

    shape = (f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
             "media_sha256 string, feature string")
    return media.select(id_col, "n_bytes", "media").mapInArrow(facts, shape).withColumnRenamed("id", id_col)


@query("op2_media")
def op2_media(spark, sf_dir):
    from tessera.llm.common import saved

    stored = saved(store_texts(given(spark, sf_dir, "documents")), "media")
    return describe(stored)
