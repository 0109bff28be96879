"""Session settings, object-store options and the shared working folder."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

from tessera.sources.paths import delete_path

# Settings every session of this library wants. Shuffle partitions stay at the
# cluster's own value; AQE coalesces or splits them from run-time sizes.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}

_LOCAL_WORK_ROOT: str | None = None
_WORK_PATHS: list[str] = []
_SHIPPED_TO: set[str] = set()


def build_session(app_name: str = "tessera", **conf: str) -> SparkSession:
    """Return a session with the library's base settings plus ``conf``."""
    builder = SparkSession.builder.appName(app_name)
    for key, value in {**BASE_CONF, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Batch functions are pickled by reference, so every worker must be able to import it.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED_TO:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    if os.path.isdir(package):  # already inside a shipped archive otherwise
        folder = tempfile.mkdtemp(prefix="tessera-package-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        archive = shutil.make_archive(os.path.join(folder, "tessera"), "zip", os.path.dirname(package),
                                      os.path.basename(package))
        spark.sparkContext.addPyFile(archive)
    _SHIPPED_TO.add(app)


def storage_conf(
    endpoint: str = "",
    access_key: str = "",
    secret_key: str = "",
    region: str = "us-east-1",
    allow_http: bool = False,
    path_style: bool = True,
) -> dict[str, str]:
    """Spark settings for an S3-compatible store; no endpoint means local paths and ``{}``."""
    if not endpoint:
        return {}
    prefix = "spark.hadoop.fs.s3a."
    return {
        f"{prefix}endpoint": endpoint,
        f"{prefix}access.key": access_key,
        f"{prefix}secret.key": secret_key,
        f"{prefix}endpoint.region": region,
        f"{prefix}connection.ssl.enabled": "false" if allow_http else "true",
        f"{prefix}path.style.access": "true" if path_style else "false",
    }


def work_root(spark: SparkSession) -> str:
    """Folder for written intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local-mode session
    without that setting gets a temporary folder, removed when the process ends.
    """
    global _LOCAL_WORK_ROOT
    configured = spark.conf.get("spark.checkpoint.dir", "")
    if configured:
        return configured.rstrip("/")
    if not re.match(r"local($|\[)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if _LOCAL_WORK_ROOT is None:
        _LOCAL_WORK_ROOT = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, _LOCAL_WORK_ROOT, ignore_errors=True)
    return _LOCAL_WORK_ROOT


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path below :func:`work_root`; never reused between calls."""
    path = f"{work_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    _WORK_PATHS.append(path)
    return path


def clear_work(spark: SparkSession) -> None:
    """Drop the working tables this process wrote, once no result reads them any more."""
    while _WORK_PATHS:
        delete_path(spark, _WORK_PATHS.pop())
