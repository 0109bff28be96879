"""Token ids in files: frequency-ranked, byte-aligned variable-length codes with control bytes kept apart."""

from __future__ import annotations

import os
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import query
from tessera.llm.common import LEFT_OVER, batch_of, batches_of, filesystem, given, new_file, new_folder, release_memory, saved

END_ID = 2
#: A file is closed when it holds so many ids, so a task's memory is bounded whatever its share of the documents.
FILE_IDS = 1_000_000
#: Byte strings whose ids a task remembers: some 60 MB, and as much for the generation before.
REMEMBERED = 400_000

MAGIC = b"TOKF0001"


# Codes -----------------------------------------------------------------------------------------------------------------

#: Per control byte: the byte lengths of its four codes.
_LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1
_MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes (two bits a value: its byte length less one, four values a byte) and data bytes of uint32 values."""
    values = values.astype("<u4")
    size = (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    padded = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    padded[:len(values)] = size
    control = (padded.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1).astype(np.uint8)
    used = np.arange(4, dtype=np.uint8) <= size[:, None]
    return control.tobytes(), values.view(np.uint8).reshape(-1, 4)[used].tobytes()


def unpack(control: bytes, data: bytes, count: int) -> np.ndarray:
    """The ``count`` values of :func:`pack`, by looking every control byte up in a table of lengths."""
    size = _LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:count]
    start = np.cumsum(size) - size
    raw = np.frombuffer(data + bytes(4), np.uint8).astype(np.uint32)
    words = raw[start] | raw[start + 1] << np.uint32(8) | raw[start + 2] << np.uint32(16) | raw[start + 3] << np.uint32(24)
    return words & _MASKS[size]


def file_bytes(keys: list[int | None], sizes: np.ndarray, ids: np.ndarray) -> bytes:
    """One file: header, ids by falling frequency, document keys and sizes, control bytes, data bytes.

    Ids are stored as their place in the frequency list (ties: smaller id first), so the 256 commonest take one byte.
    """
    n = np.bincount(ids)  # ids are below the vocabulary's size
    kinds = np.flatnonzero(n)
    order = np.lexsort((kinds, -n[kinds]))
    place = np.zeros(len(n), np.uint32)
    place[kinds[order]] = np.arange(len(kinds), dtype=np.uint32)
    control, data = pack(place[ids])
    known = np.array([k is not None for k in keys], np.uint8)
    numbers = np.array([0 if k is None else k for k in keys], "<i8")
    parts = [kinds[order].astype("<u4").tobytes(), known.tobytes(), numbers.tobytes(), sizes.astype("<u4").tobytes(), control, data]
    return MAGIC + struct.pack("<6Q", *map(len, parts)) + b"".join(parts)


def file_parts(raw: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Keys, sizes and ids of :func:`file_bytes`."""
    if raw[:8] != MAGIC:
        raise ValueError("not a token file")
    lengths = struct.unpack_from("<6Q", raw, 8)
    if 56 + sum(lengths) != len(raw):
        raise ValueError("token file is cut short")
    at, parts = 56, []
    for n in lengths:
        parts.append(raw[at:at + n])
        at += n
    known, numbers = np.frombuffer(parts[1], np.uint8), np.frombuffer(parts[2], "<i8")
    sizes = np.frombuffer(parts[3], "<u4").astype(np.int64)
    table = np.frombuffer(parts[0], "<u4")
    ids = table[unpack(parts[4], parts[5], int(sizes.sum()))] if len(sizes) else np.empty(0, "<u4")
    return [int(v) if k else None for k, v in zip(known, numbers)], sizes, ids


# Tokenizer -------------------------------------------------------------------------------------------------------------

#: Below this code point the splitting pattern is spelt out; a text with any other character goes to the library whole.
_PLAIN_END = 0x250


def _plain_class(letter: str) -> str:
    return "".join(re.escape(chr(i)) for i in range(_PLAIN_END) if unicodedata.category(chr(i))[0] == letter)


def _plain_pattern() -> re.Pattern:
    """The byte-level splitting rule for characters below ``_PLAIN_END``."""
    letters, numbers, blank = _plain_class("L"), _plain_class("N"), "\t-\r \x85\xa0"
    return re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{letters}]+| ?[{numbers}]+| ?[^{blank}{letters}{numbers}]+"
                      rf"|[{blank}]+(?![^{blank}])|[{blank}]+")


class _Pieces(dict):
    """Ids of pieces, found when first asked for. The latest ``REMEMBERED`` and those of the generation before are kept."""

    def __init__(self, find):
        super().__init__()
        self.find, self.before = find, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.before.get(piece)
        if ids is None:
            ids = self.find(piece)
        if len(piece) < 64:
            if len(self) >= REMEMBERED:
                self.before = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class Encoder:
    """Ids of whole texts as the tokenizers library gives them, as little-endian bytes.

    A byte-level tokenizer merges within the pieces that its splitting rule cuts, so the ids of a piece are taken from
    the library's model once and remembered. Texts with an added token's string, or with characters outside the rule
    spelt out here, and tokenizers of another kind, are encoded by the library as they are.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.kind.itemsize == 2 else "I"
        before = self.tokenizer.pre_tokenizer
        self.by_piece = (isinstance(before, ByteLevel) and before.use_regex and not before.add_prefix_space
                         and self.tokenizer.normalizer is None)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.beyond = re.compile(f"[^\0-{chr(_PLAIN_END - 1)}]")
        self.pieces = _plain_pattern()
        #: The byte alphabet: printable Latin-1 characters stand for themselves, the other bytes for U+0100 and up.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in plain]
        self.alphabet = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}
        self.known = _Pieces(self.piece)

    def piece(self, text: str) -> bytes:
        if text.isascii() and text[1:].isalpha():  # most pieces are a word, with a blank before it or without
            spelt = self.alphabet[ord(text[0])] + text[1:]
        else:
            spelt = text.encode().decode("latin-1").translate(self.alphabet)
        found = [t.id for t in self.model.tokenize(spelt)]
        return struct.pack(f"<{len(found)}{self.code}", *found)

    def encode(self, text: str) -> bytes:
        if not self.by_piece or any(a in text for a in self.added) or (not text.isascii() and self.beyond.search(text)):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()
        return b"".join(map(self.known.__getitem__, self.pieces.findall(text)))


@lru_cache(maxsize=1)
def encoder_of(path: str) -> Encoder:
    """One encoder a worker process, so that its many tasks neither load it again nor forget its pieces."""
    return Encoder(path)


LEFT_OVER[__name__] = encoder_of.cache_clear
_FILES = pa.schema([("part", pa.int32()), ("number", pa.int32()), ("file", pa.string()), ("ids", pa.int64())])


def _write(batches: Iterator[pa.RecordBatch], folder: str, tokenizer: str, end_id: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    release_memory(__name__)
    part, encoder, fs = TaskContext.get().partitionId(), None, filesystem(folder)[0]
    keys, blobs, held, number = [], [], 0, 0

    def close() -> pa.RecordBatch:
        sizes = np.array([len(b) // encoder.kind.itemsize for b in blobs], np.int64) + 1
        end = np.array([end_id], "<u4")
        ids = np.concatenate([x for b in blobs for x in (np.frombuffer(b, encoder.kind).astype("<u4"), end)])
        name = new_file(folder, f"tokens-{part:05d}-{number:05d}", ".tok")
        with fs.open_output_stream(filesystem(name)[1]) as out:
            out.write(file_bytes(keys, sizes, ids))
        return batch_of(_FILES, [(part, number, name, len(ids))])

    for batch in batches:
        encoder = encoder or encoder_of(tokenizer)
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            blob = encoder.encode(text or "")
            keys.append(key)
            blobs.append(blob)
            held += len(blob) // encoder.kind.itemsize + 1
            if held >= FILE_IDS:
                yield close()
                keys, blobs, held, number = [], [], 0, number + 1
    if keys:
        yield close()


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """Encode every whole text, append ``end_id``, write files in ascending id order; returns the list of files.

    Columns: ``part`` and ``number`` (their order is the order of the files), ``file``, ``ids`` and ``start`` (ids in
    all files before it). Documents are range-partitioned by id; each task writes files of at most ``FILE_IDS`` ids and
    one document more. A lost task leaves files that no list names.

    NULL text: empty, so only the end id. NULL id: first. Equal ids: next to each other, by hash of their texts.
    Empty table: no files.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie").select("id", "text")
    files = saved(rows.mapInArrow(lambda b: _write(b, folder, tokenizer, end_id),
                                  "part int, number int, file string, ids long"), "token-files")
    totals = files.groupBy("part").agg(F.sum("ids").alias("n")).orderBy("part").collect()  # one row a task
    starts, at = [], 0
    for row in totals:
        starts.append((row.part, at))
        at += row.n
    first = spark.createDataFrame(starts, "part int, first long")
    from pyspark.sql import Window

    before = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("first") + F.coalesce(F.sum("ids").over(before), F.lit(0))
    return files.join(F.broadcast(first), "part").select("part", "number", "file", "ids", start.alias("start"))


_READ = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())])
_DIGEST = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[Iterator[tuple[int | None, int, memoryview]]]:
    """Per file: (id, start, ids as bytes) of its documents."""
    for batch in batches:
        for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            fs, path = filesystem(name)
            with fs.open_input_stream(path) as source:
                keys, sizes, ids = file_parts(source.read())
            ends = np.cumsum(sizes)
            raw = memoryview(ids.astype("<u4").tobytes())
            yield ((k, start + int(e - n), raw[4 * int(e - n):4 * int(e)]) for k, n, e in zip(keys, sizes, ends))


def _each_file(files: DataFrame) -> DataFrame:
    tasks = max(1, -(-files.count() // 4))  # the list is a few bytes a file, so its size would not spread it
    return files.select("file", "start").repartition(tasks, "file")


def read_tokens(spark: SparkSession, files: DataFrame) -> DataFrame:
    """``id``, ``start`` and ``ids`` (little-endian unsigned 32-bit, as bytes) of every document, read from the files."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _documents(batches):
            yield from batches_of(_READ, ((k, start, bytes(ids)) for k, start, ids in found), 2048)

    return _each_file(files).mapInArrow(read, "id long, start long, ids binary")


def token_digests(spark: SparkSession, files: DataFrame) -> DataFrame:
    """Position, number and checksum of every document's ids, taken while the files are read: no ids leave the task."""
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _documents(batches):
            yield from batches_of(_DIGEST, ((k, start, len(ids) // 4, zlib.crc32(ids)) for k, start, ids in found))

    return _each_file(files).mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokens_of(spark: SparkSession, docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """The contract's columns, read back from the files."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return token_digests(spark, saved(write_tokens(docs, new_folder(spark, "tokens"), tokenizer), "token-list"))


@query("op10_token_files")
def op10_token_files(spark, sf_dir):
    return tokens_of(spark, given(spark, sf_dir, "documents"))
