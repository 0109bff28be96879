"""Whether a stored index still says what its table says: posting counts and checksums by data file, and parameters.

Both sides are aggregated by data file, with a partial sum before the shuffle: how many entries a file has, and the sum
of a hash of each, which doesn't depend on their order. An index from which a posting file was lost, in which one was
written twice, or whose list of covered files doesn't fit its postings differs in some file of the table.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, functions as F

from tessera.operators.index_catalog import indexes_below
from tessera.operators.stored_index import ROW_FILE, FileState, IndexMeta, StoredIndex

HEALTH = ("index_name string, index_type string, coverage double, bad_files long, damaged boolean, params_hash string, "
          "built_params_hash string")


def _totals(entries: DataFrame, side: str) -> DataFrame:
    """By data file: how many entries, and the sum of their hashes (a decimal, which can't overflow)."""
    return entries.groupBy(F.col(ROW_FILE).alias(f"{side}_file")).agg(
        F.sum("weight").alias(f"{side}_rows"), F.sum(F.col("hash").cast("decimal(20,0)")).alias(f"{side}_sum"))


def _state(index: StoredIndex, table: DataFrame, meta: IndexMeta) -> FileState | None:
    try:
        return index.file_state(table, meta)
    except AnalysisException:  # no list of covered files is left
        return None


def _listed(names: list[str]) -> Column:
    return F.col("_metadata.file_path").isin(names)


def file_problems(index: StoredIndex, table: DataFrame) -> DataFrame:
    """Data files on which ``index`` and ``table`` differ: ``row_file``, ``expected_rows``, ``held_rows``, ``problem``.

    ``missing``: entries of the file are lost; ``extra``: it has more than it should, or none are due because the file
    isn't listed as covered; ``changed``: as many, but others. Files that the table no longer has are no problem, nor
    are new ones that the index has not read. If its list of covered files is lost, all that it holds is extra. An entry is a vector (by key and value; codes aren't compared), a token
    of a document with its counts, or a bitmap container, whose rows are its bits. Empty tables have no problems.

    The table's covered files are scanned once, for the columns of the index alone; a text column is tokenised again.
    """
    meta = index.meta()
    files = _state(index, table, meta)
    covered = table.where("false") if files is None else table.where(~_listed(files.fresh)) if files.fresh else table
    due = _totals(index.expected_entries(covered, meta), "expected")
    try:
        held = _totals(index._alive(index.held_entries(meta), files), "held")
    except AnalysisException:  # no posting file is left
        held = due.where("false").toDF("held_file", "held_rows", "held_sum")
    both = due.join(held, F.col("expected_file").eqNullSafe(F.col("held_file")), "full")
    due_rows, held_rows = F.coalesce("expected_rows", F.lit(0)), F.coalesce("held_rows", F.lit(0))
    problem = (F.when(held_rows < due_rows, "missing").when(held_rows > due_rows, "extra")
               .when(~F.col("expected_sum").eqNullSafe(F.col("held_sum")), "changed"))
    return both.select(F.coalesce("expected_file", "held_file").alias(ROW_FILE), due_rows.alias("expected_rows"),
                       held_rows.alias("held_rows"), problem.alias("problem")).where("problem IS NOT NULL")


def settings_of(meta: IndexMeta) -> dict:
    """What the index was built with; ``num_partitions`` is the number that the build arrived at."""
    return {"index_type": meta.index_type, "column": meta.column_name, "key": meta.key_name, "metric": meta.metric,
            **json.loads(meta.params)}


def params_hash(settings: Mapping) -> str:
    return hashlib.sha256(json.dumps(settings, sort_keys=True, default=str).encode()).hexdigest()


def health(index: StoredIndex, table: DataFrame, wanted: Mapping | None = None) -> tuple:
    """One row of ``HEALTH``, as :func:`tessera.plans.lifecycle.rebuild_action` reads it.

    ``wanted`` holds the settings asked for now; those it doesn't name count as unchanged. ``coverage`` is the share of
    the table's rows in covered files, 1 for an empty table.
    """
    meta = index.meta()
    files = _state(index, table, meta)
    if files is None:
        rows, read = table.count(), 0
    else:
        fresh = _listed(files.fresh) if files.fresh else F.lit(False)
        rows, read = table.agg(F.count(F.lit(1)), F.count_if(~fresh)).first()
    bad = file_problems(index, table).count()
    built = settings_of(meta)
    return (meta.index_name, meta.index_type, read / rows if rows else 1.0, bad, bad > 0,
            params_hash({**built, **(wanted or {})}), params_hash(built))


def health_all(table: DataFrame, root: str, wanted: Mapping[str, Mapping] | None = None) -> DataFrame:
    """A row of ``HEALTH`` for each index below ``root``; ``wanted`` has settings by index name."""
    rows = [health(index, table, (wanted or {}).get(index.meta().index_name)) for index in indexes_below(table.sparkSession, root)]
    return table.sparkSession.createDataFrame(rows, HEALTH)
