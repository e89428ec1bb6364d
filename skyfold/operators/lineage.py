"""Cutting the lineage of iterative jobs."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, set as checkpoint folder.

    Where none is set, a session on one machine (tests) gets a temporary folder;
    on a cluster that is an error, as executors could not read each other's files.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return found or held.get()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="skyfold-")
    spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder and read back."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def kept(df: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
    """``df`` as a compressed table in the checkpoint folder, and what deletes it.

    For tables as large as the data, which a checkpoint would hold uncompressed.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark).rstrip('/')}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)

    def forget() -> None:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

    return spark.read.schema(df.schema).parquet(path), forget
