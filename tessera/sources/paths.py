"""Small driver-side path helpers on Hadoop's FileSystem, for any storage scheme."""

from __future__ import annotations

from collections.abc import Iterable
from urllib.parse import unquote

from pyspark.sql import SparkSession

#: Directory value of a NULL partition (fixed value of the partition layout).
NULL_PARTITION = "__HIVE_DEFAULT_PARTITION__"


def _fs_and_path(spark: SparkSession, path: str):
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), jvm_path


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, jvm_path = _fs_and_path(spark, path)
    return fs.exists(jvm_path)


def is_folder(spark: SparkSession, path: str) -> bool:
    fs, jvm_path = _fs_and_path(spark, path)
    return fs.exists(jvm_path) and fs.getFileStatus(jvm_path).isDirectory()


def make_path(spark: SparkSession, path: str) -> None:
    fs, jvm_path = _fs_and_path(spark, path)
    fs.mkdirs(jvm_path)


def delete_path(spark: SparkSession, path: str) -> bool:
    """Remove one directory tree; a missing path is not an error."""
    fs, jvm_path = _fs_and_path(spark, path)
    return fs.delete(jvm_path, True)


def child_folders(spark: SparkSession, path: str) -> list[str]:
    """Folders right below ``path``, by name; none if it is missing."""
    fs, jvm_path = _fs_and_path(spark, path)
    if not fs.exists(jvm_path):
        return []
    return sorted(status.getPath().toString() for status in fs.listStatus(jvm_path) if status.isDirectory())


def partition_dirs(spark: SparkSession, path: str, column: str) -> dict[str, str]:
    """Directory name of each value of the first-level partition ``column``; a NULL is ``NULL_PARTITION``."""
    fs, jvm_path = _fs_and_path(spark, path)
    if not fs.exists(jvm_path):
        return {}
    names = (status.getPath().getName() for status in fs.listStatus(jvm_path))
    prefix = f"{column}="
    return {unquote(n[len(prefix):]): n for n in names if n.startswith(prefix)}


def partition_values(spark: SparkSession, path: str, column: str) -> list[str]:
    """Values of the first-level partition ``column``, read from directory names only."""
    return sorted(partition_dirs(spark, path, column))


def drop_partitions(spark: SparkSession, path: str, column: str, values: Iterable[str | None]) -> None:
    """Remove the directories of partition values, spelt as the directories spell them."""
    dirs = partition_dirs(spark, path, column)
    for value in values:
        name = dirs.get(NULL_PARTITION if value is None else value)
        if name is not None:
            delete_path(spark, f"{path}/{name}")
