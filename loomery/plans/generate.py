"""Generating the files that a specification describes."""

from __future__ import annotations

import time
from collections.abc import Callable
from pathlib import Path
from typing import Any

from pyspark.sql import SparkSession

from loomery.plans.compile import compile_spec
from loomery.plans.spec import DatasetSpec, SchemaError, validate_schema
from loomery.session import session
from loomery.sources import sinks

WRITERS = {"csv": sinks.write_csv, "parquet": sinks.write_parquet}


def generate_dataset(
    spec: DatasetSpec,
    out_dir: str | Path | None = None,
    rows: int | None = None,
    reference: str | Path | None = None,
    reference_limit: int = 200_000,
    chunk_size: int = 50_000,
    on_chunk: Callable[[int, int], None] | None = None,
    spark: SparkSession | None = None,
) -> dict[str, Any]:
    """Write the dataset and return {"rows", "columns", "files", "elapsed"}.

    chunk_size: rows of a task; the output doesn't depend on it. on_chunk is called when the rows are written.
    """
    began, spark = time.perf_counter(), spark or session()
    errors = validate_schema(spec, str(reference) if reference else None)
    if errors:
        raise SchemaError("Invalid schema:\n  - " + "\n  - ".join(errors))
    n = spec.rows if rows is None else rows
    partitions = max(1, min(-(-n // max(1, chunk_size)), 100_000))
    df = compile_spec(spark, spec, n, str(reference) if reference else None, reference_limit, partitions)
    folder = Path(out_dir or spec.output_dir)
    files = [WRITERS[kind](df, folder / f"{spec.file_stem}.{kind}") for kind in dict.fromkeys(spec.formats)]
    if on_chunk:
        on_chunk(n, n)
    return {"rows": n, "columns": [c.name for c in spec.columns], "files": files, "elapsed": time.perf_counter() - began}
