"""A folder that the driver and all executors see."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from loomery.functions.names import named

_OWN: list[str] = []


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name under ``spark.checkpoint.dir``; a local session without it gets a temporary folder that goes at exit."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="loomery-"))
            atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
        base = _OWN[0]
    return f"{base.rstrip('/')}/loomery/{name}-{uuid.uuid4().hex}"


def local_folder(spark: SparkSession, name: str) -> Path:
    """The same as a path of the driver's file system."""
    return Path(shared_folder(spark, name).removeprefix("file://"))


class Tables:
    """Tables that are written once, read by later jobs, and removed together."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def folder(self, name: str) -> str:
        """A folder that goes with the tables."""
        self.paths.append(shared_folder(self.spark, name))
        return self.paths[-1]

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = self.folder(name)
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path).select(*(named(c) for c in df.columns))

    def __enter__(self) -> Tables:
        return self

    def __exit__(self, *_: object) -> None:
        self.drop()

    def drop(self) -> None:
        for path in self.paths:
            where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def tables_until_exit(spark: SparkSession) -> Tables:
    """Tables that stay as long as the driver's process: for results that are read later."""
    tables = Tables(spark)
    atexit.register(_drop_if_alive, tables)
    return tables


def _drop_if_alive(tables: Tables) -> None:
    if tables.spark.sparkContext._jsc is not None:
        tables.drop()
