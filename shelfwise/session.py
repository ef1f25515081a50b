"""Session settings the operators are written for. All of them can be overridden by the cluster."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import SparkSession

_private: dict[str, str] = {}


def tuned(builder: SparkSession.Builder | None = None) -> SparkSession.Builder:
    builder = builder or SparkSession.builder.appName("shelfwise")
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; a private one only in local mode and where none is set (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if "folder" not in _private:
        _private["folder"] = tempfile.mkdtemp(prefix="shelfwise-")
        atexit.register(shutil.rmtree, _private["folder"], ignore_errors=True)
    return _private["folder"]
