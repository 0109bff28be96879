"""What all stored indexes have in common: committed states, deltas by data file, upkeep.

Layout below one index path::

    postings/gen=G/delta_id=D/    rows of the index; ``row_file`` is the data file a row comes from
    covered/gen=G/delta_id=D/     row_file: the data files a delta has read
    meta/                         one small row per committed change

A data file never changes, so a row is indexed exactly if its file is covered, and a
posting is dead once its file has left the table. Rows that a delete, merge or
embedding run rewrote come from new files: they count as unindexed until the next
optimize, and their old postings are passed over. Only deltas that ``meta`` counts
are read. A frame that isn't read from files is followed by its versions alone.
``meta`` is appended only after the files it speaks of are complete, and the newest
row wins, so a lost executor or driver leaves the last good state.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import asdict, dataclass, field, replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tessera.sources.paths import delete_path, partition_values, path_exists
from tessera.sources.tables import VERSION

META_SCHEMA = ("meta_id long, gen long, delta_count long, covered_version long, index_name string, "
               "column_name string, key_name string, index_type string, metric string, dim int, params string, "
               "model_gen long")
ROW_FILE = "row_file"
# partition folders and name of a data file, the same wherever the table lies
FILE_NAME = r"((?:[^/=]+=[^/]*/)*[^/]+)$"


@dataclass(frozen=True)
class IndexMeta:
    """State of an index after its latest committed change."""

    meta_id: int
    gen: int
    delta_count: int
    covered_version: int
    index_name: str
    column_name: str
    key_name: str
    index_type: str
    metric: str = ""
    dim: int = 0
    params: str = "{}"
    model_gen: int = 0


@dataclass(frozen=True)
class FileState:
    """Data files of a table that no delta covers (whole paths), and covered ones that the table no longer has.

    ``gone`` are the deltas that have covered dead files alone, ``mixed`` the dead files of the other deltas.
    """

    fresh: list[str]
    dead: list[str]
    gone: list[int] = field(default_factory=list)
    mixed: list[str] = field(default_factory=list)


def reads_files(df: DataFrame) -> bool:
    try:
        df.select("_metadata.file_path")
    except AnalysisException:
        return False
    return True


def with_files(df: DataFrame) -> DataFrame:
    """Add the data file of each row; NULL in a frame that isn't read from files."""
    name = F.regexp_extract("_metadata.file_path", FILE_NAME, 1) if reads_files(df) else F.lit(None).cast("string")
    return df.withColumn(ROW_FILE, name)


class StoredIndex:
    """An index stored below ``path``; open it with the session that reads it.

    A kind of index gives :meth:`_write_delta`, and names further tables of its own per delta in ``KINDS``.
    """

    KINDS: tuple[str, ...] = ()

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    # state

    def meta(self) -> IndexMeta:
        row = self.spark.read.schema(META_SCHEMA).parquet(f"{self.path}/meta").orderBy(F.desc("meta_id")).first()
        if row is None:
            raise ValueError(f"no index at {self.path}")
        return IndexMeta(**row.asDict())

    def _commit(self, meta: IndexMeta) -> IndexMeta:
        if self.exists() and self.meta().meta_id >= meta.meta_id:
            raise RuntimeError(f"the index at {self.path} was changed by another run; start again from its new state")
        self.spark.createDataFrame([tuple(asdict(meta).values())], META_SCHEMA).coalesce(1).write.mode(
            "append").parquet(f"{self.path}/meta")
        return meta

    def exists(self) -> bool:
        return path_exists(self.spark, f"{self.path}/meta")

    def postings(self, meta: IndexMeta | None = None, wanted: Column | None = None) -> DataFrame:
        """Postings of committed deltas that are ``wanted``; files of a run that died before its commit are not read."""
        meta = meta or self.meta()
        schema = self._posting_schema(meta)
        reader = self.spark.read.schema(schema) if schema else self.spark.read
        rows = reader.parquet(f"{self.path}/postings/gen={meta.gen}")
        rows = rows if wanted is None else rows.where(wanted)
        return rows.where(F.col("delta_id") <= meta.delta_count)

    def _posting_schema(self, meta: IndexMeta) -> str | None:
        """Columns of the postings, for a kind of index that may have none; else the files tell."""
        return None

    def covered_files(self, meta: IndexMeta) -> DataFrame:
        return self._covered(meta).select(ROW_FILE)

    def _covered(self, meta: IndexMeta) -> DataFrame:
        return self.spark.read.schema(f"{ROW_FILE} string, delta_id int").parquet(
            f"{self.path}/covered/gen={meta.gen}").where(F.col("delta_id") <= meta.delta_count)

    def _write_covered(self, files: DataFrame, gen: int, delta_id: int) -> None:
        files.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/covered/gen={gen}/delta_id={delta_id}")

    def file_state(self, table: DataFrame | None, meta: IndexMeta | None = None) -> FileState | None:
        """How the files of ``table`` and those covered differ; None if either has no files.

        Both are file lists, which the driver holds for any scan of the table.
        """
        if table is None or not reads_files(table):
            return None
        by_delta: dict[int, set[str]] = defaultdict(set)
        for name, delta in self._covered(meta or self.meta()).collect():
            by_delta[delta].add(name)
        covered = set().union(*by_delta.values())
        live = {re.search(FILE_NAME, uri)[1]: uri for uri in table.inputFiles()}
        if not covered or not live:
            return None
        fresh = {uri for name, uri in live.items() if name not in covered}
        fresh |= {re.sub("^file:///", "file:/", uri) for uri in fresh}  # as the scan's metadata column spells it
        gone = sorted(d for d, names in by_delta.items() if names.isdisjoint(live))
        mixed = set().union(*(names for d, names in by_delta.items() if d not in gone)) - set(live)
        return FileState(sorted(fresh), sorted(covered - set(live)), gone, sorted(mixed))

    def _alive(self, rows: DataFrame, files: FileState | None) -> DataFrame:
        """Rows whose data file the table still has; deltas without such a file are not opened.

        The list of files goes to the rows: a join by file would bring all rows of a file to one task.
        """
        if files is None or not files.dead:
            return rows
        names = files.dead
        if "delta_id" in rows.columns:
            rows, names = rows.where(~F.col("delta_id").isin(files.gone)) if files.gone else rows, files.mixed
        if not names:
            return rows
        dead = self.spark.createDataFrame([(f,) for f in names], f"{ROW_FILE} string")
        return rows.join(F.broadcast(dead), ROW_FILE, "left_anti").select(rows.columns)

    def _unindexed(self, table: DataFrame, meta: IndexMeta, files: FileState | None) -> Column:
        """Rows no delta covers; a list of file paths, so the scan opens those files only."""
        if files is not None:
            return F.col("_metadata.file_path").isin(files.fresh)
        return F.col(VERSION) > meta.covered_version if VERSION in table.columns else F.lit(False)

    # writing

    def _next(self, replace_existing: bool = True) -> tuple[int, int]:
        """Generation and state number of a new build."""
        if not self.exists():
            return 0, 0
        if not replace_existing:
            raise ValueError(f"index already exists at {self.path}")
        old = self.meta()
        return old.gen + 1, old.meta_id + 1

    def _write_delta(self, df: DataFrame, meta: IndexMeta, delta_id: int,
                     files: FileState | None = None) -> tuple[int, int]:
        """Write one delta of the rows of ``df``; return how many rows it indexes and the newest version it covers."""
        raise NotImplementedError

    def _note_covered(self, df: DataFrame, meta: IndexMeta, delta_id: int, files: FileState | None) -> None:
        """The data files of a delta: those at hand, or else the files of the rows."""
        if files is not None:
            names = sorted({re.search(FILE_NAME, uri)[1] for uri in files.fresh})
            read = self.spark.createDataFrame([(n,) for n in names], f"{ROW_FILE} string")
        else:
            read = df.where(F.col(ROW_FILE).isNotNull()).select(ROW_FILE).distinct()
        self._write_covered(read, meta.gen, delta_id)

    def _write_table(self, rows: DataFrame, kind: str, gen: int, delta_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{kind}/gen={gen}/delta_id={delta_id}")

    def _write_postings(self, rows: DataFrame, gen: int, delta_id: int) -> None:
        self._write_table(rows, "postings", gen, delta_id)

    def _table(self, kind: str, meta: IndexMeta) -> DataFrame:
        """A further table of committed deltas."""
        return self.spark.read.parquet(f"{self.path}/{kind}/gen={meta.gen}").where(F.col("delta_id") <= meta.delta_count)

    def _fold(self, meta: IndexMeta, files: FileState | None) -> None:
        """Write all live rows as the only delta of the next generation."""
        self._write_postings(self._alive(self.postings(meta), files).drop("delta_id"), meta.gen + 1, 0)
        for kind in self.KINDS:
            self._write_table(self._alive(self._table(kind, meta), files).drop("delta_id"), kind, meta.gen + 1, 0)

    def optimize(self, df: DataFrame) -> int:
        """Index rows of files not covered yet as one delta; return rows added.

        The scan opens the new files only, once. The covered version is pinned after the
        append: the optimize itself is no drift.
        """
        meta = self.meta()
        files = self.file_state(df, meta)
        if files is not None and not files.fresh:
            return 0
        fresh, delta_id = df.where(self._unindexed(df, meta, files)), meta.delta_count + 1
        added, covered = self._write_delta(fresh, meta, delta_id, files)
        if added:
            self._commit(replace(meta, meta_id=meta.meta_id + 1, delta_count=delta_id, covered_version=covered))
        return added

    def merge(self, table: DataFrame | None = None) -> int:
        """Fold all deltas into one generation; return the number folded.

        With ``table``, postings of files that it no longer has are left out.
        """
        meta = self.meta()
        files = self.file_state(table, meta)
        if meta.delta_count or (files is not None and files.dead):
            self._fold(meta, files)
            self._write_covered(self._alive(self.covered_files(meta), files), meta.gen + 1, 0)
            self._commit(replace(meta, meta_id=meta.meta_id + 1, gen=meta.gen + 1, delta_count=0))
        return meta.delta_count

    def drop_old_generations(self) -> int:
        """Remove replaced generations, once no search reads them; return how many of the postings."""
        meta, dropped = self.meta(), {}
        for kind, current in (("model", meta.model_gen), ("covered", meta.gen), ("postings", meta.gen), *((k, meta.gen) for k in self.KINDS)):
            dropped[kind] = [g for g in partition_values(self.spark, f"{self.path}/{kind}", "gen") if int(g) < current]
            for gen in dropped[kind]:
                delete_path(self.spark, f"{self.path}/{kind}/gen={gen}")
        return len(dropped["postings"])

    # what a check compares: ``row_file``, ``weight`` (rows that an entry stands for), ``hash``

    def held_entries(self, meta: IndexMeta) -> DataFrame:
        """Entries as they are stored."""
        return self._hashed(self.postings(meta), meta)

    def expected_entries(self, df: DataFrame, meta: IndexMeta) -> DataFrame:
        """Entries that the rows of ``df`` should have."""
        raise NotImplementedError

    def _hashed(self, entries: DataFrame, meta: IndexMeta) -> DataFrame:
        raise NotImplementedError

    # statistics

    def live_stats(self, table: DataFrame) -> DataFrame:
        """Indexed and unindexed rows and files, newest version."""
        meta = self.meta()
        unindexed = self._unindexed(table, meta, self.file_state(table, meta))
        per_file = table.where(F.col(meta.column_name).isNotNull()).groupBy(
            F.col("_metadata.file_path").alias("file"), VERSION, unindexed.alias("unindexed")).agg(
            F.count(F.lit(1)).alias("n"))
        covered = ~F.col("unindexed")
        return per_file.agg(
            F.max(VERSION).alias("latest_version"),
            F.sum(F.when(covered, F.col("n")).otherwise(0)).alias("num_indexed_rows"),
            F.sum(F.when(~covered, F.col("n")).otherwise(0)).alias("num_unindexed_rows"),
            F.count_if(covered).alias("num_indexed_fragments"),
            F.count_if(~covered).alias("num_unindexed_fragments"),
        )

    def unindexed_rows(self, table: DataFrame) -> DataFrame:
        """Rows no delta covers yet."""
        meta = self.meta()
        return table.where(self._unindexed(table, meta, self.file_state(table, meta)))
