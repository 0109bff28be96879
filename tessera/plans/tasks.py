"""Upkeep tasks by type: each runs one Spark job on a stored table and returns a report row.

The table is a Parquet path partitioned by one column; ``params`` is the task's
parameter map. New types are added with :func:`task`.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import asdict

from pyspark.sql import SparkSession

from tessera.functions.scalars import ts
from tessera.operators.embedding import HASH_MODEL, embed_table, hash_encoder
from tessera.operators.index_catalog import build_index, merge_all, merge_index, open_index, optimize_all
from tessera.operators.index_check import health_all
from tessera.operators.upkeep import (KEEP_VERSIONS, compact, delete_from_table, expired, ranked_versions)
from tessera.plans.lifecycle import rebuild_action
from tessera.sources.paths import delete_path
from tessera.sources.tables import VERSION

Task = Callable[[SparkSession, Mapping], dict]
TASKS: dict[str, Task] = {}


def task(task_type: str) -> Callable[[Task], Task]:
    def add(fn: Task) -> Task:
        TASKS[task_type] = fn
        return fn
    return add


def run_task(spark: SparkSession, task_type: str, params: Mapping) -> dict:
    if task_type not in TASKS:
        raise ValueError(f"no task type {task_type!r}; known: {sorted(TASKS)}")
    return {"task_type": task_type, **TASKS[task_type](spark, params)}


def required(params: Mapping, *names: str) -> list:
    missing = [n for n in names if params.get(n) in (None, "", [])]
    if missing:
        raise ValueError(f"task params lack {missing}")
    return [params[n] for n in names]


@task("TTL_DELETE")
def ttl_delete(spark: SparkSession, params: Mapping) -> dict:
    path, part, column, now, days = required(params, "path", "partition_col", "column", "now", "ttl_days")
    return {"rows_after": delete_from_table(spark, path, part, expired(column, ts(now), int(days)))}


@task("COMPACTION")
def compaction(spark: SparkSession, params: Mapping) -> dict:
    path, part, key = required(params, "path", "partition_col", "key")
    return asdict(compact(spark, path, part, key, params.get("threshold") or {}, params.get("deleted")))


@task("VECTORIZE")
def vectorize(spark: SparkSession, params: Mapping) -> dict:
    """Fill the NULL vectors of a table; a task without its columns is an error, not an empty success."""
    path, part, sources, target = required(params, "path", "partition_col", "source_columns", "target_column")
    model = params.get("model_name", HASH_MODEL)
    encode = params.get("encode") or (hash_encoder(params.get("dim", 384)) if model == HASH_MODEL else None)
    if encode is None:
        raise ValueError(f"model {model!r} needs an 'encode' function")
    return embed_table(spark.read.parquet(path), path, part, sources, target, encode,
                       params.get("concat_separator", " "))


@task("INDEX_BUILD")
def index_build(spark: SparkSession, params: Mapping) -> dict:
    """Build an index of any type: IVF_FLAT, IVF_PQ, FTS or BITMAP."""
    path, index_path, key, column, name, kind = required(
        params, "path", "index_path", "key", "column_name", "index_name", "index_type")
    index = build_index(spark.read.parquet(path), index_path, index_type=kind, key=key, column=column, index_name=name,
                        **(params.get("params") or {}))
    return asdict(index.meta())


@task("INDEX_OPTIMIZE")
def index_optimize(spark: SparkSession, params: Mapping) -> dict:
    """Take new files up into one index (``index_path``) or into all of the table's (``index_root``)."""
    (path,) = required(params, "path")
    if params.get("index_root"):
        return {"indexes": [r.asDict() for r in optimize_all(spark.read.parquet(path), params["index_root"]).collect()]}
    (index_path,) = required(params, "index_path")
    index = open_index(spark, index_path)
    added = index.optimize(spark.read.parquet(path))
    return {"rows_added": added, "covered_version": index.meta().covered_version}


@task("INDEX_CHECK")
def index_check(spark: SparkSession, params: Mapping) -> dict:
    """What each of the table's indexes needs, from its postings, its coverage and the settings in ``params``, by index name."""
    path, root = required(params, "path", "index_root")
    found = rebuild_action(health_all(spark.read.parquet(path), root, params.get("params")))
    return {"indexes": [r.asDict() for r in found.select("index_name", "index_type", "coverage", "bad_files", "action").collect()]}


@task("INDEX_MERGE")
def index_merge(spark: SparkSession, params: Mapping) -> dict:
    """Fold the deltas of one index, or with ``index_root`` and ``path`` of all of a table's; ``refit`` evens out partitions."""
    if params.get("index_root"):
        (path,) = required(params, "path")
        return {"indexes": [r.asDict() for r in merge_all(
            spark.read.parquet(path), params["index_root"], bool(params.get("refit"))).collect()]}
    (index_path,) = required(params, "index_path")
    return {"deltas_folded": merge_index(open_index(spark, index_path), refit=bool(params.get("refit")))}


@task("INDEX_CLEANUP")
def index_cleanup(spark: SparkSession, params: Mapping) -> dict:
    """Drop postings that a merge or rebuild has replaced."""
    (index_path,) = required(params, "index_path")
    return {"generations_dropped": open_index(spark, index_path).drop_old_generations()}


@task("LIFECYCLE_RECYCLE")
def lifecycle_recycle(spark: SparkSession, params: Mapping) -> dict:
    """Drop the partitions of versions beyond the newest ``keep``."""
    (path,) = required(params, "path")
    versions = ranked_versions(spark.read.parquet(path), keep=params.get("keep", KEEP_VERSIONS))
    old = [r[0] for r in versions.where("NOT kept").select(VERSION).collect()]
    for version in old:
        delete_path(spark, f"{path}/{VERSION}={version}")
    return {"versions_dropped": sorted(old)}
