"""Cells replaced by their place: rows stay where they are, and tasks read the replacements of their own block of rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery.sources.records import locate


def write_blocks(cells: DataFrame, row: str, folder: str, block: int) -> None:
    """Store (row, col, value), each cell once, in a folder for each block of rows."""
    placed = cells.select(row, "col", "value", F.floor(F.col(row) / block).cast("long").alias("block"))
    placed.repartition("block").write.partitionBy("block").parquet(folder)


def _merge(folder: str, columns: list[str], block: int):
    def load(store: fs.FileSystem, inside: str, b: int) -> pa.Table | None:
        where = f"{inside}/block={b}"
        if store.get_file_info(where).type != fs.FileType.Directory:
            return None
        parts = [f.path for f in store.get_file_info(fs.FileSelector(where)) if f.path.endswith(".parquet")]
        return pa.concat_tables([pq.ParquetFile(store.open_input_file(p)).read() for p in parts]) if parts else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, inside = locate(folder)
        held: tuple[int, pa.Table | None] = (-1, None)
        for batch in batches:
            rows = batch.column(0).to_numpy()
            out = {i: None for i in range(len(columns))}
            for b in np.unique(rows // block).tolist():
                if held[0] != b:
                    held = b, load(store, inside, b)
                if held[1] is None:
                    continue
                at = np.searchsorted(rows, held[1].column(0).to_numpy())  # rows of a batch ascend
                here = (at < len(rows)) & (rows[np.minimum(at, len(rows) - 1)] == held[1].column(0).to_numpy())
                cols, values = held[1].column("col").to_numpy(), held[1].column("value").to_pylist()
                for k in np.flatnonzero(here).tolist():
                    i = int(cols[k])
                    if out[i] is None:
                        out[i] = batch.column(1 + i).to_pylist()
                    out[i][at[k]] = values[k]
            yield pa.RecordBatch.from_arrays([batch.column(1 + i) if new is None else pa.array(new, pa.string()) for i, new in out.items()], columns)

    return run


def replaced(rows: DataFrame, row: str, columns: list[str], folder: str, block: int) -> DataFrame:
    """The columns of ``rows``, whose numbers in ``row`` ascend in each partition, with the stored cells in their places.

    Nothing is sorted or shuffled; a task holds the replacements of one block.
    """
    return rows.select(row, *columns).mapInArrow(_merge(folder, columns, block), ", ".join(f"`{c}` string" for c in columns))
