"""Inverted text index with BM25 ranking (Robertson & Zaragoza, 2009), in segments that follow the table's data files.

Every delta is a segment of its own below the index path::

    postings/gen=G/delta_id=D/bucket=B/  token, cell, key, tf, dl, row_file
    blocks/gen=G/delta_id=D/bucket=B/    token, row_file, cell, n, max_tf, min_dl, sum_tf: the postings in sum
    lengths/gen=G/delta_id=D/            row_file, n_docs, total_len: totals of each data file

Document frequencies and totals are those of the live files: they are added up when a
search runs, so a deleted or rewritten file counts no more, and one that no segment
has read yet is tokenised on the way.

A token's postings lie in cells of like frequency and document length. The greatest
frequency and smallest length of a cell bound the score of its postings whatever the
live averages are, so a search leaves out cells that cannot reach its best rows
(block-max pruning, Ding & Suel, 2011) and returns what the full sum would.
"""

from __future__ import annotations

import heapq
import json
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.operators.stored_index import ROW_FILE, FileState, IndexMeta, StoredIndex, with_files
from tessera.session import work_path
from tessera.sources.tables import VERSION

# Fixed values of the ranking
K1, B = 1.2, 0.75
# Tokens are runs of these characters in the lower-cased text.
TOKEN_CHARACTERS = b"abcdefghijklmnopqrstuvwxyz0123456789"
# Query terms become a literal list; a longer query is refused.
MAX_TERMS = 1000
BUCKETS = 64
# Postings that a search reads first, to learn what the k-th best row scores at least. One task sums up as many in less
# time than a further job takes to start, so a search with fewer is a single sum.
SEED_ROWS = 200_000
# A scan gets at most so many ranges of cells as a filter; beyond that it filters by token alone.
MAX_RANGES = 64
# Bytes of text that a task tokenises at once, give or take a document.
TEXT_BYTES = 2 << 20
BLOCK_SCHEMA = f"token string, {ROW_FILE} string, cell int, n long, max_tf long, min_dl long, sum_tf long, delta_id int, bucket int"


IS_TOKEN = np.isin(np.arange(256), np.frombuffer(TOKEN_CHARACTERS, np.uint8))


def split_tokens(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Row number and text of every token, from the bytes of the whole batch at once."""
    lower = pc.utf8_lower(texts)
    _, offsets, data = lower.buffers()
    ends = np.frombuffer(offsets, np.int32)[lower.offset:lower.offset + len(lower) + 1]
    text = np.frombuffer(data or b"", np.uint8)[ends[0]:ends[-1]]
    ends = ends - ends[0]
    inside = IS_TOKEN[text]
    before = np.r_[False, inside[:-1]][:len(inside)]
    before[ends[ends < len(text)]] = False  # a row starts a token of its own
    starts = np.flatnonzero(inside & ~before)
    places = np.r_[np.cumsum(inside)[starts] - 1, inside.sum()].astype(np.int32)
    tokens = pa.StringArray.from_buffers(len(starts), pa.py_buffer(places), pa.py_buffer(text[inside]))
    return np.searchsorted(ends, starts, side="right") - 1, tokens


def token_counts(batch: pa.RecordBatch, schema: pa.Schema) -> pa.RecordBatch:
    """Distinct tokens of each row of (text, further columns) with their count, the row's token total and those columns."""
    row, tokens = split_tokens(batch.column(0))
    words = tokens.dictionary_encode()
    width = max(len(words.dictionary), 1)
    pairs, counts = np.unique(row * width + words.indices.to_numpy(), return_counts=True)
    at, length = pairs // width, np.bincount(row, minlength=batch.num_rows)
    columns = [words.dictionary.take(pa.array(pairs % width)), pa.array(counts), pa.array(length[at]),
               *(c.take(pa.array(at)) for c in batch.columns[1:])]
    return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)


def text_pieces(batch: pa.RecordBatch, size: int = TEXT_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about ``size`` bytes of text (the first column): a task's arrays follow these, not its rows."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(0)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(ends // size)) + 1).tolist(), batch.num_rows]
    for low, high in zip(cuts, cuts[1:]):
        yield batch.slice(low, high - low)


def build_postings(df: DataFrame, keep: Sequence[str], column: str) -> DataFrame:
    """``token``, ``tf``, ``dl`` and the columns ``keep``, one row per token and document.

    A document is one row, so its tokens are counted inside the batch and no
    shuffle is needed; the document length rides along, so ranking needs no join.
    """
    schema = T.StructType([T.StructField("token", T.StringType()), T.StructField("tf", T.LongType()),
                           T.StructField("dl", T.LongType()), *(df.schema[c] for c in keep)])
    arrow = to_arrow_schema(schema)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from (token_counts(piece, arrow) for piece in text_pieces(batch))

    return df.where(F.col(column).isNotNull()).select(column, *keep).mapInArrow(tally, schema)


def token_stats(postings: DataFrame) -> DataFrame:
    return postings.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def bucket_of(token: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(buckets)).cast("int")


def cell_of(tf: Column, dl: Column) -> Column:
    """Postings of about equal weight: frequencies exact up to 4 and by octave above, lengths by half octave."""
    often = F.when(tf <= 4, tf).otherwise(F.floor(F.log2(tf.cast("double"))) + 3)
    return (often * 128 - F.floor(F.log2(dl.cast("double")) * 2)).cast("int")


def term_weight(tf: Any, dl: Any, avg_len: float) -> Any:
    """BM25 weight without idf, of columns or numbers; it rises with ``tf`` and falls with ``dl``."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avg_len))


@dataclass(frozen=True)
class Cell:
    """One token's postings in one cell: how many, and the most that one of them can score."""

    token: str
    cell: int
    n: int
    bound: float


def skippable(cells: Sequence[Cell], least: float) -> set[Cell]:
    """Cells whose postings cannot bring a row to the score ``least`` by themselves.

    A row has a token once, so what it scores in skipped cells is at most the sum of each token's greatest skipped bound;
    that sum stays below ``least``. Whole tokens with many postings for their bound go first, then single cells.
    """
    by_token: dict[str, list[Cell]] = {}
    for c in sorted(cells, key=lambda c: c.bound):
        by_token.setdefault(c.token, []).append(c)
    below = least * (1 - 1e-9)  # rounding must not decide
    total, skipped = 0.0, set()
    for token in sorted(by_token, key=lambda t: (-sum(c.n for c in by_token[t]) / max(by_token[t][-1].bound, 1e-300), t)):
        most = by_token[token][-1].bound
        if total + most < below:
            total += most
            skipped.update(by_token.pop(token))
    rest = dict.fromkeys(by_token, 0.0)

    def step(token: str, at: int) -> tuple[float, str, int]:
        c = by_token[token][at]
        return -c.n / max(c.bound - rest[token], 1e-300), token, at

    heap = [step(t, 0) for t in by_token]
    heapq.heapify(heap)
    while heap:
        _, token, at = heapq.heappop(heap)
        c = by_token[token][at]
        if total + c.bound - rest[token] >= below:
            continue  # the token's further cells need more
        total, rest[token] = total + c.bound - rest[token], c.bound
        skipped.add(c)
        if at + 1 < len(by_token[token]):
            heapq.heappush(heap, step(token, at + 1))
    return skipped


class TextIndex(StoredIndex):
    """Postings in hash buckets of their token, and totals of each data file, below ``path``.

    ``key`` must tell live rows apart: a score is that of one row.
    """

    KINDS = ("blocks", "lengths")

    @classmethod
    def build(cls, df: DataFrame, path: str, *, key: str, column: str, index_name: str = "idx_text",
              buckets: int = BUCKETS, replace_existing: bool = True) -> TextIndex:
        """One shuffle by bucket; rebalancing cuts the bucket of a very common word over
        several tasks from the sizes seen at run time. Rows are sorted by token, so
        row-group statistics narrow a lookup further."""
        index = cls(df.sparkSession, path)
        gen, meta_id = index._next(replace_existing)
        meta = IndexMeta(meta_id, gen, 0, 0, index_name, column, key, "FTS", "bm25", 0,
                         json.dumps({"buckets": buckets, "key_type": df.schema[key].dataType.simpleString()}, sort_keys=True))
        _, covered = index._write_delta(df, meta, 0)
        index._commit(replace(meta, covered_version=covered))
        return index

    def _write_delta(self, df: DataFrame, meta: IndexMeta, delta_id: int,
                     files: FileState | None = None) -> tuple[int, int]:
        df = with_files(df)
        newest = df.agg(F.max(VERSION)).first()[0] if VERSION in df.columns else None
        self._note_covered(df, meta, delta_id, files)
        rows = build_postings(df.select(meta.key_name, ROW_FILE, meta.column_name), [meta.key_name, ROW_FILE], meta.column_name)
        rows = rows.withColumn("cell", cell_of(F.col("tf"), F.col("dl")))
        self._write_postings(rows.withColumn("bucket", bucket_of(F.col("token"), self._buckets(meta))), meta.gen, delta_id, meta.key_name)
        written = self._segment(meta, delta_id, "postings", f"token string, {ROW_FILE} string, cell int, tf long, dl long, bucket int")
        blocks = written.groupBy("bucket", "token", ROW_FILE, "cell").agg(
            F.count(F.lit(1)).alias("n"), F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl"), F.sum("tf").alias("sum_tf"))
        self._write_table(blocks, "blocks", meta.gen, delta_id)
        lengths = self._segment(meta, delta_id, "blocks", f"{ROW_FILE} string, sum_tf long")
        totals = df.groupBy(ROW_FILE).agg(F.count(F.lit(1)).alias("n_docs"), F.lit(0).cast("long").alias("total_len")).unionByName(
            lengths.groupBy(ROW_FILE).agg(F.lit(0).cast("long").alias("n_docs"), F.sum("sum_tf").alias("total_len")))
        self._write_table(totals.groupBy(ROW_FILE).agg(F.sum("n_docs").alias("n_docs"), F.sum("total_len").alias("total_len")),
                          "lengths", meta.gen, delta_id)
        added = self.spark.read.schema("n_docs long").parquet(f"{self.path}/lengths/gen={meta.gen}/delta_id={delta_id}").agg(
            F.sum("n_docs")).first()[0]
        return added or 0, meta.covered_version if newest is None else max(newest, meta.covered_version)

    def expected_entries(self, df: DataFrame, meta: IndexMeta) -> DataFrame:
        rows = with_files(df).select(meta.key_name, ROW_FILE, meta.column_name)
        return self._hashed(build_postings(rows, [meta.key_name, ROW_FILE], meta.column_name), meta)

    def _hashed(self, entries: DataFrame, meta: IndexMeta) -> DataFrame:
        return entries.select(ROW_FILE, F.lit(1).alias("weight"), F.xxhash64("token", "tf", "dl", meta.key_name).alias("hash"))

    def _segment(self, meta: IndexMeta, delta_id: int, kind: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{kind}/gen={meta.gen}/delta_id={delta_id}")

    def _write_postings(self, rows: DataFrame, gen: int, delta_id: int, key: str | None = None) -> None:
        self._write_buckets(rows, ["token", "cell", key or self.meta().key_name], "postings", gen, delta_id)

    def _write_table(self, rows: DataFrame, kind: str, gen: int, delta_id: int) -> None:
        if kind == "blocks":
            self._write_buckets(rows, ["token", "cell"], kind, gen, delta_id)
        else:
            super()._write_table(rows, kind, gen, delta_id)

    def _write_buckets(self, rows: DataFrame, order: list[str], kind: str, gen: int, delta_id: int) -> None:
        (rows.hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", *order)
             .write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket")
             .parquet(f"{self.path}/{kind}/gen={gen}/delta_id={delta_id}"))

    def _table(self, kind: str, meta: IndexMeta) -> DataFrame:
        if kind != "blocks":
            return super()._table(kind, meta)
        rows = self.spark.read.schema(BLOCK_SCHEMA).parquet(f"{self.path}/blocks/gen={meta.gen}")
        return rows.where(F.col("delta_id") <= meta.delta_count)

    def _posting_schema(self, meta: IndexMeta) -> str:
        kind = json.loads(meta.params)["key_type"]
        return f"token string, cell int, tf long, dl long, {meta.key_name} {kind}, {ROW_FILE} string, delta_id int, bucket int"

    @staticmethod
    def _buckets(meta: IndexMeta) -> int:
        return json.loads(meta.params)["buckets"]

    def search(self, terms: Sequence[str], key: str | None = None, k: int = 10,
               table: DataFrame | None = None, seed_rows: int = SEED_ROWS) -> DataFrame:
        """Best ``k`` rows for the query terms: ``(key, score)``, the key renamed to ``key`` if given; only the terms'
        buckets are read.

        The postings of greatest weight, ``seed_rows`` of them and more, tell what the k-th best row scores at least.
        Cells that cannot bring a row there are skipped when rows are gathered: for one term they are not read at all,
        for several their postings are met with the gathered rows that can still be among the best.

        With ``table`` the answer is that of the live table: postings and totals of files it no longer has are passed
        over, and rows of files that no segment has read are tokenised here. Without it, as of the last change.
        Equal scores: the smaller key first.
        """
        wanted = sorted(set(t.lower() for t in terms))
        if not 0 < len(wanted) <= MAX_TERMS:
            raise ValueError(f"from 1 to {MAX_TERMS} query terms, got {len(wanted)}")
        meta = self.meta()
        name, files, buckets = meta.key_name, self.file_state(table, meta), self._buckets(meta)
        # the bucket of a literal folds to a constant, so this prunes directories
        asked = reduce(lambda a, b: a | b, [F.col("bucket") == bucket_of(F.lit(t), buckets) for t in wanted]) & F.col("token").isin(wanted)
        n_docs, total_len = self._alive(self._table("lengths", meta), files).agg(F.sum("n_docs"), F.sum("total_len")).first()
        n_docs, total_len = n_docs or 0, total_len or 0
        # at most MAX_TERMS times the number of cells
        blocks = self._alive(self._table("blocks", meta).where(asked), files).groupBy("token", "cell").agg(
            F.sum("n").alias("n"), F.max("max_tf").alias("max_tf"), F.min("min_dl").alias("min_dl")).collect()
        found = dict.fromkeys(wanted, 0)
        for b in blocks:
            found[b["token"]] += b["n"]
        fresh_hits = None
        if table is not None and (files is None or files.fresh):
            fresh = table.where(self._unindexed(table, meta, files))
            own = build_postings(fresh, [name], meta.column_name)
            word = F.when(F.col("token").isin(wanted), F.col("token"))
            n_docs += fresh.count()
            for r in own.groupBy(word.alias("token")).agg(F.count(F.lit(1)).alias("n"), F.sum("tf").alias("len")).collect():
                total_len += r["len"]
                if r["token"] is not None:
                    found[r["token"]] += r["n"]
            fresh_hits = own.where(F.col("token").isin(wanted)).select("token", "tf", "dl", name)
        avg_len = total_len / max(n_docs, 1) or 1.0
        idf = {t: math.log(1.0 + (n_docs - n + 0.5) / (n + 0.5)) for t, n in found.items() if n}
        cells = [Cell(b["token"], b["cell"], b["n"], idf[b["token"]] * term_weight(b["max_tf"], b["min_dl"], avg_len))
                 for b in blocks]
        postings = self._alive(self.postings(meta, asked), files).select("token", "cell", "tf", "dl", name)

        skipped = self._skipped(postings, cells, idf, avg_len, k, seed_rows, name)
        kept = [c for c in cells if c not in skipped[0]]
        hits = self._in_cells(postings, kept, cells) if skipped[0] else postings
        hits = hits.drop("cell")
        hits = hits if fresh_hits is None else hits.unionByName(fresh_hits)
        scored = self._scored(hits, idf, avg_len, name, skipped[0])
        if skipped[0] and len(idf) > 1:
            most = sum(self._rest(skipped[0]).values())
            reach = scored.where(F.col("score") + most - F.col("seen") >= skipped[1] * (1 - 1e-9)).select(name, "score")
            path = work_path(self.spark, "text-candidates")
            reach.write.parquet(path)
            reach = self.spark.read.schema(reach.schema).parquet(path)
            others = self._in_cells(postings, list(skipped[0]), cells).join(reach, name, "left_semi")
            scored = reach.unionByName(self._scored(others.drop("cell"), idf, avg_len, name).select(name, "score")).groupBy(
                name).agg(F.sum("score").alias("score"))
        return scored.select(name, "score").orderBy(F.desc("score"), name).limit(k).withColumnRenamed(name, key or name)

    def _skipped(self, postings: DataFrame, cells: list[Cell], idf: dict[str, float], avg_len: float, k: int,
                 seed_rows: int, name: str) -> tuple[set[Cell], float]:
        """Cells to skip, and the score that the k-th best row has at least; none if the first postings are all."""
        first, n = [], 0
        for c in sorted(cells, key=lambda c: (-c.bound, c.token, c.cell)):
            if n >= max(seed_rows, k):
                break
            first.append(c)
            n += c.n
        if len(first) == len(cells):
            return set(), 0.0
        best = self._scored(self._in_cells(postings, first, cells).drop("cell"), idf, avg_len, name)
        count, least = best.orderBy(F.desc("score")).limit(k).agg(F.count(F.lit(1)), F.min("score")).first()
        return (skippable(cells, least), least) if count == k else (set(), 0.0)

    @staticmethod
    def _rest(skipped: set[Cell]) -> dict[str, float]:
        """The most that a row can score in a token's skipped cells."""
        rest: dict[str, float] = {}
        for c in skipped:
            rest[c.token] = max(rest.get(c.token, 0.0), c.bound)
        return rest

    def _scored(self, hits: DataFrame, idf: dict[str, float], avg_len: float, name: str,
                skipped: set[Cell] = frozenset()) -> DataFrame:
        """``name``, ``score``, and ``seen``: what the row's tokens could have scored in skipped cells."""
        rest = self._rest(skipped)
        # one row per query term, at most MAX_TERMS
        weights = self.spark.createDataFrame([(t, v, rest.get(t, 0.0)) for t, v in idf.items()], "token string, idf double, rest double")
        part = F.col("idf") * term_weight(F.col("tf").cast("double"), F.col("dl"), avg_len)
        return hits.join(F.broadcast(weights), "token").groupBy(name).agg(F.sum(part).alias("score"), F.sum("rest").alias("seen"))

    def _in_cells(self, postings: DataFrame, chosen: list[Cell], cells: list[Cell]) -> DataFrame:
        """Postings of the chosen cells. Ranges of cells go into the scan, and the join settles which token has which."""
        here, runs = {c.cell for c in chosen}, []
        for number in sorted({c.cell for c in cells}):
            if number not in here:
                runs.append(None)
            elif runs and runs[-1]:
                runs[-1] = (runs[-1][0], number)
            else:
                runs.append((number, number))
        runs = [r for r in runs if r]
        rows = postings.where(F.col("token").isin(sorted({c.token for c in chosen})))
        if 0 < len(runs) <= MAX_RANGES:
            rows = rows.where(reduce(lambda a, b: a | b, [F.col("cell").between(*r) for r in runs]))
        exact = self.spark.createDataFrame([(c.token, c.cell) for c in chosen], "token string, cell int")
        return rows.join(F.broadcast(exact), ["token", "cell"], "left_semi")
