"""Benchmark passages found in documents by Wu-Manber search over words."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from tessera.llm import query
from tessera.llm.common import LEFT_OVER, batch_of, binary_values, bound_batches, filesystem, given, release_memory
from tessera.session import work_path

WINDOW = 13
#: Window bytes of one search table. A larger benchmark is searched table by table, whole documents each time.
TABLE_BYTES = 32 << 20
#: Document bytes that are searched together before the next table is opened.
GROUP_BYTES = 32 << 20

#: Words are runs of digits, letters and all bytes from 0x80 up; A-Z is lowered, every other byte parts words.
_WORDS = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_WORDS).split() if text else []


class WuManber:
    """Search for many word sequences of one length.

    Blocks are word pairs (single words for sequences of one word). ``shift`` says how far the search may jump when a
    block ends at the current word; at shift 0 the block's bucket holds, by first block, the sequences to compare.
    """

    def __init__(self, sequences: dict[tuple[bytes, ...], list[str]], length: int):
        self.length, self.block = length, min(2, length)
        self.default = length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], dict[tuple[bytes, ...], list]] = {}
        for words, items in sequences.items():
            for end in range(self.block, length + 1):
                piece = words[end - self.block:end]
                self.shift[piece] = min(self.shift.get(piece, self.default), length - end)
            first, last = words[:self.block], words[length - self.block:]
            self.buckets.setdefault(last, {}).setdefault(first, []).append((list(words), items))

    def search(self, words: list[bytes]) -> Iterator[tuple[int, list[str]]]:
        """(first word's place, items) of every occurrence, in order."""
        length, block, shift, default = self.length, self.block, self.shift, self.default
        at, n = length, len(words)
        while at <= n:
            piece = tuple(words[at - block:at])
            step = shift.get(piece, default)
            if step:
                at += step
                continue
            start = at - length
            for sequence, items in self.buckets[piece].get(tuple(words[start:start + block]), ()):
                if words[start:at] == sequence:
                    yield start, items
            at += 1


def _windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("win", pa.binary()), ("item", pa.string())])
    for batch in batches:
        for text, item in zip(binary_values(batch.column(0)), batch.column(1).to_pylist()):
            words = words_of(text)
            found = {b" ".join(words[i:i + window]) for i in range(max(1, len(words) - window + 1))} if words else ()
            if found:
                yield batch_of(schema, [(w, item) for w in found])


def _load(folder: str, block: int) -> list[WuManber]:
    fs, path = filesystem(folder)
    table = pq.read_table(f"{path}/block={block}", filesystem=fs, columns=["win", "item"], partitioning=None)
    by_length: dict[int, dict[tuple[bytes, ...], list[str]]] = {}
    for win, item in zip(table.column("win").to_pylist(), table.column("item").to_pylist()):
        words = tuple(win.split(b" "))
        by_length.setdefault(len(words), {}).setdefault(words, []).append(item)
    return [WuManber(sequences, n) for n, sequences in sorted(by_length.items())]


_TABLES: dict[tuple[str, int], list[WuManber]] = {}
LEFT_OVER[__name__] = _TABLES.clear


def _tables(folder: str, block: int) -> list[WuManber]:
    """One search table at a time stays in a worker's memory."""
    if (folder, block) not in _TABLES:
        _TABLES.clear()
        _TABLES[folder, block] = _load(folder, block)
    return _TABLES[folder, block]


def _search(batches: Iterator[pa.RecordBatch], folder: str, blocks: list[int], shape: pa.Schema,
            text_at: int | None = None) -> Iterator[pa.RecordBatch]:
    """All columns and those of ``shape``; without ``text_at`` the text is a column of its own, the last, and goes."""
    def flush(group: list[pa.RecordBatch]) -> pa.Table:
        table = pa.Table.from_batches(group)
        texts = table.column(table.num_columns - 1 if text_at is None else text_at)
        n_words, hit = [0] * len(texts), [None] * len(texts)
        items: list[set[str]] = [set() for _ in range(len(texts))]
        for block in blocks or [None]:
            searches = [] if block is None else _tables(folder, block)
            for at, text in enumerate(text for part in texts.chunks for text in part.cast(pa.binary())):
                words = words_of(text.as_py())  # of one document at a time
                n_words[at] = len(words)
                marks = hit[at]
                for search in searches:
                    for start, found in search.search(words):
                        if marks is None:
                            marks = hit[at] = bytearray(len(words))
                        marks[start:start + search.length] = b"\x01" * search.length
                        items[at].update(found)
        if text_at is None:
            table = table.remove_column(table.num_columns - 1)
        for name, values in (("n_words", n_words), ("n_hit", [sum(h or b"") for h in hit]), ("items", [sorted(s) for s in items])):
            table = table.append_column(name, pa.array(values, shape.field(name).type))
        return table

    release_memory(__name__)
    enough = GROUP_BYTES if len(blocks) > 1 else 0  # a single table stays open
    group, size = [], 0
    for batch in batches:
        for low in range(0, batch.num_rows, 1024):
            part = batch.slice(low, 1024)
            group.append(part)
            size += part.nbytes
            if size >= enough:
                yield from flush(group).to_batches()
                group, size = [], 0
    if group:
        yield from flush(group).to_batches()


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text",
                  item_col: str = "item_id", item_text: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """All columns of ``docs`` and ``n_words``, ``n_hit`` words inside benchmark windows, and ``items`` that occur.

    A window is ``window`` consecutive words of an item; a shorter item is one window. The windows are stored by hash
    in tables of about ``table_bytes``; each task searches its documents with one table after the other, so the whole
    benchmark meets all whole documents, nothing is shuffled and memory is bounded at any benchmark size.

    NULL or empty text: no words, no hits. Item without words: matches nothing. NULL item id: listed as ``null``.
    Repeated items: the same windows. Repeated documents: a row each. Empty benchmark: no hits; empty table: no rows.
    Own columns of these names in ``docs`` are replaced.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    wins = benchmark.select(F.col(item_text), F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"))
    wins = wins.mapInArrow(lambda b: _windows(b, window), "win binary, item string")
    size = benchmark.agg(F.sum(F.octet_length(item_text))).first()[0] or 0
    n_blocks = max(1, math.ceil(size * window / table_bytes))
    folder = work_path(spark, "windows")
    wins = wins.distinct().withColumn("block", F.pmod(F.xxhash64("win", "item"), F.lit(n_blocks)).cast("int"))
    wins.repartition("block").write.partitionBy("block").parquet(folder)
    found = spark.read.schema("win binary, item string, block int").parquet(folder).select("block").distinct()
    blocks = sorted(r.block for r in found.collect())
    added = pa.schema([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string()))])
    kept = docs.drop(*added.names)
    shape = StructType(list(kept.schema)).add("n_words", "long").add("n_hit", "long").add("items", ArrayType(StringType()))
    rows, text_at = [F.col(c) for c in kept.columns], None
    if text_col in kept.columns:  # sent once, as a batch's largest column
        text_at = kept.columns.index(text_col)
    else:
        name = "_text" + "_" * max(map(len, docs.columns))  # longer than any column's name
        rows.append(F.col(text_col).alias(name))
    return docs.select(*rows).mapInArrow(lambda b: _search(b, folder, blocks, added, text_at), shape)


def contaminated():
    """The rule for a document: some word is hit, and a twentieth of its words at least."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns: items as a count and a hash, and whether the document is contaminated."""
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), contaminated().alias("contaminated"))


@query("op5_decontaminate", r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS ws
  FROM documents
),
b AS (
  SELECT item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS ws
  FROM benchmark
),
w AS (
  SELECT DISTINCT item_id, least(13, len(ws)) AS n, array_to_string(ws[i:i + least(13, len(ws)) - 1], ' ') AS win
  FROM (SELECT item_id, ws, unnest(range(1, greatest(2, len(ws) - 11))) AS i FROM b WHERE len(ws) > 0)
),
p AS (
  SELECT r, n, i, array_to_string(ws[i:i + n - 1], ' ') AS win
  FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM w) WHERE len(ws) >= n)
),
o AS (SELECT p.r, p.i, w.n, w.item_id FROM p JOIN w ON p.n = w.n AND p.win = w.win),
h AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS j FROM o) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names FROM (SELECT DISTINCT r, item_id::VARCHAR AS s FROM o) GROUP BY r)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
""")
def op5_decontaminate(spark, sf_dir):
    docs = given(spark, sf_dir, "documents").select("doc_id", "text")
    return digest(contamination(docs, given(spark, sf_dir, "benchmark")))
