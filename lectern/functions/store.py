"""Results that several later steps read, kept in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Only where driver and executors are one process may it be missing: then it is a temporary folder."""
    sc = spark.sparkContext
    own = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if own:
        return own
    if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="lectern-")


def prepare(spark: SparkSession) -> None:
    """Names a checkpoint folder if the session has none; no other setting is touched."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(spark))


def kept(frame: DataFrame) -> DataFrame:
    """The frame, computed once and written as a reliable checkpoint."""
    prepare(frame.sparkSession)
    return frame.checkpoint()
