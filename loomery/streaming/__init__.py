"""Generation on streams: the same expressions over the row numbers of a rate source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.plans.compile import ROW, column_expressions
from loomery.plans.spec import DatasetSpec


def generate_stream(spark: SparkSession, spec: DatasetSpec, rows_per_second: int = 1000) -> DataFrame:
    """A stream of the rows that ``compile_spec`` gives for the same row numbers; passthrough columns are not for streams."""
    rows = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load().select(F.col("value").alias(ROW))
    return rows.select(*column_expressions(spec, spec.rows))
