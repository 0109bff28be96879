"""The indexes of a table by type: one folder for each below a root, built, opened and kept up together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.operators.bitmap_index import BitmapIndex
from tessera.operators.ivf import IvfIndex
from tessera.operators.refit import merge_refitted
from tessera.operators.stored_index import StoredIndex
from tessera.operators.text_index import TextIndex
from tessera.sources.paths import child_folders

CLASSES: dict[str, type[StoredIndex]] = {"IVF_FLAT": IvfIndex, "IVF_PQ": IvfIndex, "FTS": TextIndex, "BITMAP": BitmapIndex}
#: Known types that aren't stored here, and what serves instead.
REFUSED = {"BTREE": "sort or partition the table by the column; Parquet statistics then skip files and row groups",
           "HNSW": "use IVF_FLAT or IVF_PQ"}
REPORT = "index_name string, index_type string, rows long, covered_version long"


def class_of(index_type: str) -> type[StoredIndex]:
    if index_type in REFUSED:
        raise ValueError(f"index type {index_type} is not built: {REFUSED[index_type]}")
    if index_type not in CLASSES:
        raise ValueError(f"unknown index type {index_type!r}; known: {sorted(CLASSES)}")
    return CLASSES[index_type]


def build_index(df: DataFrame, path: str, *, index_type: str, key: str, column: str, index_name: str,
                **params) -> StoredIndex:
    """Build an index of any type; the same call again replaces it."""
    kind = class_of(index_type)
    if kind is IvfIndex:
        params["index_type"] = index_type
    return kind.build(df, path, key=key, column=column, index_name=index_name, **params)


def open_index(spark: SparkSession, path: str) -> StoredIndex:
    """The index at ``path``, as the type its state names."""
    return class_of(StoredIndex(spark, path).meta().index_type)(spark, path)


def indexes_below(spark: SparkSession, root: str) -> list[StoredIndex]:
    """Every index of a table, in order of its folder; a folder without a committed state is none."""
    found = (StoredIndex(spark, path) for path in child_folders(spark, root))
    return [open_index(spark, index.path) for index in found if index.exists()]


def optimize_all(table: DataFrame, root: str) -> DataFrame:
    """Every index below ``root`` takes up the files it has not read; a row each with the rows added."""
    rows = []
    for index in indexes_below(table.sparkSession, root):
        added, meta = index.optimize(table), index.meta()
        rows.append((meta.index_name, meta.index_type, added, meta.covered_version))
    return table.sparkSession.createDataFrame(rows, REPORT)


def merge_index(index: StoredIndex, table: DataFrame | None = None, refit: bool = False) -> int:
    """Fold the deltas of one index; with ``refit``, a vector index has its uneven partitions fitted anew."""
    return merge_refitted(index, table) if refit and isinstance(index, IvfIndex) else index.merge(table)


def merge_all(table: DataFrame, root: str, refit: bool = False) -> DataFrame:
    """Every index below ``root`` folds its deltas and leaves out files that the table lost; a row each with the deltas folded."""
    rows = []
    for index in indexes_below(table.sparkSession, root):
        folded, meta = merge_index(index, table, refit), index.meta()
        rows.append((meta.index_name, meta.index_type, folded, meta.covered_version))
    return table.sparkSession.createDataFrame(rows, REPORT)
