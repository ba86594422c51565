"""Scratch folders that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_OWN: dict[str, str] = {}


def scratch(spark: SparkSession, tag: str) -> str:
    """A new folder name under spark.checkpoint.dir. Where that is unset and all tasks run
    in this process, as in tests, it lies in a temporary folder that goes at exit; on a
    cluster that is an error, for each machine would have a folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = tempfile.mkdtemp(prefix="tessera-")
            atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
        base = f"file://{_OWN[app]}"
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"
