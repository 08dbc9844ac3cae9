"""Folders that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in spark.checkpoint.dir; where that is unset on one machine (as in tests) a temporary folder is set as it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.gettempdir()}/quillon-shared"
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/quillon/{name}-{uuid.uuid4().hex}"
