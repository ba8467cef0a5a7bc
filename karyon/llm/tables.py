"""Reading the tables, and the shared folder for intermediate results."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import unquote, urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders of the scopes that are open, the innermost last.
_scopes: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """This application's folder in spark.checkpoint.dir, which driver and executors share; where that is unset (one machine, tests), in a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.gettempdir() + "/karyon-checkpoints"
    return "/".join([folder, f"karyon-{spark.sparkContext.applicationId}", *_scopes])


def local_folder(spark: SparkSession) -> str:
    """The shared folder as a path that Python opens on every machine."""
    url = urlparse(shared_folder(spark))
    if url.scheme not in ("", "file"):
        raise ValueError("spark.checkpoint.dir must be a folder mounted on the driver and all executors")
    os.makedirs(unquote(url.path), exist_ok=True)
    return unquote(url.path)


def remove_folder(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clear_intermediate(spark: SparkSession) -> None:
    """Deletes all intermediate tables of this application. Results that still read them must have been written before."""
    remove_folder(spark, shared_folder(spark))


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables made inside are deleted at the end; what leaves it must have been written elsewhere."""
    _scopes.append(uuid.uuid4().hex)
    folder = shared_folder(spark)
    try:
        yield
    finally:
        _scopes.pop()
        remove_folder(spark, folder)


def new_path(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def cut(df: DataFrame, path: str | None = None) -> DataFrame:
    """df, computed once and read back from a table in the shared folder; a lost executor loses none of it."""
    spark = df.sparkSession
    path = path or new_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def columns_of(df: DataFrame) -> list[Column]:
    """All columns by name, whatever the names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]
