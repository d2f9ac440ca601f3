"""Where jobs write what they read again."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import SparkSession


@functools.cache
def _own(application: str) -> str:
    return "file://" + tempfile.mkdtemp(prefix="spark-")


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own for each call, below spark.checkpoint.dir, which all executors share.
    Only a session whose executors are threads of the driver may do without that setting."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context = spark.sparkContext
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = _own(context.applicationId)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
