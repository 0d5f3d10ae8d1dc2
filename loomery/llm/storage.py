"""Where intermediate results go, and what every job needs before it starts.

Everything that outlives one job is written to the shared folder that the session names in
``spark.checkpoint.dir``; a lost executor therefore never takes a finished step with it.
"""

from __future__ import annotations

import atexit
import ctypes
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from loomery.llm.files import open_folder

_OWN: list[str] = []
#: Intermediate tables of this process, which go when it ends.
_TABLES: list[str] = []


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name under ``spark.checkpoint.dir``.

    Only a local session may leave the setting unset; it then gets a temporary folder that is removed at exit.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="loomery-"))
            atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
        base = _OWN[0]
    return f"{base.rstrip('/')}/loomery/{name}-{uuid.uuid4().hex}"


def _remove_tables() -> None:
    for path in _TABLES:
        try:
            store, inside = open_folder(path)
            store.delete_dir(inside)
        except (OSError, ValueError):  # gone already, or in a store that only Spark reads
            pass


def temporary_folder(spark: SparkSession, name: str) -> str:
    """A new folder name under ``spark.checkpoint.dir``; what is there goes when the driver's process ends."""
    path = shared_folder(spark, name)
    if not _TABLES:
        atexit.register(_remove_tables)
    _TABLES.append(path)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: it is computed once and its lineage ends here.

    The table is there until the driver's process ends.
    """
    path = temporary_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def prepare_workers(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver found it."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    known = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in known:
        env["PYTHONPATH"] = os.pathsep.join([root, *known])


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, for mapInArrow, that gives freed memory back to the system when a task ends.

    Workers live on beside the executor's JVM, and Arrow and the C library would keep what their largest task took.
    """

    def leaner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
            if trim is not None:
                trim(0)

    return leaner


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def buckets_for(documents: DataFrame, each_mb: int = 4, most: int = 1 << 30, each_partition: int = 4) -> int:
    """Number of hash buckets: a power of two, some for each shuffle partition so that partitions even out, and more
    for large inputs, one for ``each_mb`` MB of what Catalyst takes the input's size to be (if it knows one).

    A bucket therefore has the same size for any input, as ``most`` is the range of bucket numbers only."""
    size = int(str(documents._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = max(each_partition * shuffle_partitions(documents.sparkSession), (size >> 20) // each_mb if 0 <= size < 1 << 50 else 0)
    n = 32
    while n < min(least, most):
        n *= 2
    return n


def unused(name: str) -> str:
    """A column name that no table of a caller has."""
    return f"{name}_{uuid.uuid4().hex}"


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
