"""Intermediate results as tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import suppress

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset (one machine, tests), a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.gettempdir() + "/karyon-checkpoints"
    return folder


def application_folder(spark: SparkSession) -> str:
    """This application's folder in the shared one. What is in it is deleted when the driver's Python ends, and the results that read it are then gone too."""
    folder = f"{shared_folder(spark)}/karyon-{spark.sparkContext.applicationId}"
    if folder not in _known:
        _known.add(folder)
        jvm = spark.sparkContext._jvm
        atexit.register(_delete, jvm, folder)
    return folder


_known: set[str] = set()


def _delete(jvm, folder: str) -> None:
    with suppress(Exception):  # the JVM may have ended before
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(path, True)


def computed_once(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read back: what is joined to its own aggregates is not computed again for each of them."""
    spark = df.sparkSession
    path = f"{application_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
