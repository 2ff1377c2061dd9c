"""Where intermediate tables go: the shared folder the cluster names.

Tables of one application lie in one run folder below it, ``lshthemes-<application id>``. Nothing deletes them while
the application runs, since results are lazy and may still read them; remove the run folder when it has ended.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def _base(spark: SparkSession) -> str:
    named = spark.sparkContext.getCheckpointDir()
    if named:
        # setCheckpointDir makes a folder of its own below the one it was given; tables go in there as well
        return named
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    raise ValueError("set spark.checkpoint.dir to a folder that all executors share")


def name_local_scratch(spark: SparkSession) -> None:
    """For sessions in one process (tests, benchmarks) that name no folder: one below the temporary folder. On a
    cluster this does nothing, and the first intermediate table asks for ``spark.checkpoint.dir``."""
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        return
    if context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None):
        return
    context.setCheckpointDir(os.path.join(tempfile.gettempdir(), "lshthemes-scratch"))


def scratch_path(spark: SparkSession, purpose: str) -> str:
    """A fresh path for one intermediate table."""
    run = f"lshthemes-{spark.sparkContext.applicationId}"
    return f"{_base(spark).rstrip('/')}/{run}/{purpose}-{uuid.uuid4().hex}"


def use_checkpoints(spark: SparkSession) -> None:
    """Make ``DataFrame.checkpoint`` work where only the setting names a folder."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(_base(spark))
