"""The folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """What the cluster names in spark.checkpoint.dir. Where it names none, a session in one process gets a folder of its own; a cluster is an error."""
    named = spark.conf.get("spark.checkpoint.dir", "")
    if not named and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named or tempfile.mkdtemp(prefix="claimloom-")


def checkpointing(spark: SparkSession) -> None:
    """Checkpoints go to the shared folder, unless the session has one for them."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
