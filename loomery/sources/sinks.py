"""Files from DataFrames. A file appears under its name when it is whole, or not at all."""

from __future__ import annotations

import csv
import io
import os
import shutil
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomery.functions.names import named
from loomery.sources.sniff import TextFormat

_QUOTED = '[{delimiter}"\\r\\n]'


@contextmanager
def _apart(target: Path) -> Iterator[Path]:
    """A folder beside the target that goes in any case."""
    target.parent.mkdir(parents=True, exist_ok=True)
    folder = target.parent / f".{target.name}.{uuid.uuid4().hex}"
    try:
        yield folder
    finally:
        shutil.rmtree(folder, ignore_errors=True)


def _parts(folder: Path) -> list[Path]:
    return sorted(p for p in folder.iterdir() if p.name.startswith("part-") and p.stat().st_size)


def csv_line(cells: list[Column], delimiter: str, quote_all: bool = False) -> Column:
    """Cells as one line; quoted where they must be. Null is empty."""

    def cell(c: Column) -> Column:
        c = F.coalesce(c.cast("string"), F.lit(""))
        quoted = F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
        if quote_all:
            return quoted
        must = c.rlike('["\r\n' + ("\\" if delimiter in "\\]^-" else "") + delimiter + "]")
        return F.when((c == "") if len(cells) == 1 else F.lit(False), quoted).when(must, quoted).otherwise(c)

    return F.concat_ws(delimiter, *map(cell, cells))


def header_line(names: list[str], delimiter: str, quote_all: bool, end: str) -> str:
    out = io.StringIO()
    csv.writer(out, delimiter=delimiter, quoting=csv.QUOTE_ALL if quote_all else csv.QUOTE_MINIMAL, lineterminator=end).writerow(names)
    return out.getvalue()


def _write_part(folder: str, encoding: str, end: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, size = TaskContext.get(), 0
        unready = f"{folder}/unready-{task.partitionId()}-{task.taskAttemptId()}"
        with open(unready, "wb") as out:
            for batch in batches:
                lines = batch.column(0).to_pylist()
                size += out.write("".join(f"{line}{end}" for line in lines).encode(encoding, "replace"))
        os.replace(unready, f"{folder}/part-{task.partitionId()}")  # a task that runs again writes the same
        yield pa.RecordBatch.from_arrays([pa.array([task.partitionId()], pa.int64()), pa.array([size], pa.int64())], ["part", "bytes"])

    return run


def _copy_parts(folder: str, places: list[tuple[int, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                part, place = places[i]
                with open(f"{folder}/part-{part}", "rb") as read, open(f"{folder}/whole", "r+b") as out:
                    out.seek(place)
                    shutil.copyfileobj(read, out, 1 << 20)
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64())], ["part"])

    return run


def write_text(df: DataFrame, names: list[str], form: TextFormat, target: str | Path) -> Path:
    """One text file in this format, rows in the order of the partitions.

    Tasks write their lines, in the file's encoding, beside the target; from the parts' sizes follow their places in
    the whole, to which tasks copy them all at once. Driver and executors need to share the target's folder only.
    """
    target = Path(target)
    encoding = {"utf-8-sig": "utf-8", "utf-16": "utf-16-le", "utf-32": "utf-32-le"}.get(form.encoding, form.encoding)
    head = header_line(names, form.delimiter, form.quote_all, form.line_end) if form.has_header else ""
    head = head.encode(form.encoding, "replace")  # with the byte order mark, if the encoding has one
    with _apart(target) as folder:
        folder.mkdir()
        line = csv_line([named(c) for c in df.columns], form.delimiter, form.quote_all)
        parts = df.select(line.alias("value")).mapInArrow(_write_part(str(folder), encoding, form.line_end), "part long, bytes long").collect()
        places, size = {}, len(head)
        for r in sorted(parts, key=lambda r: r["part"]):
            if r["bytes"]:
                places[r["part"]], size = size, size + r["bytes"]
        with open(folder / "whole", "wb") as out:
            out.write(head)
            out.truncate(size)
        if places:
            full = df.sparkSession.range(0, len(places), 1, min(len(places), 10_000))
            full.mapInArrow(_copy_parts(str(folder), list(places.items())), "part long").count()
        os.replace(folder / "whole", target)
    return target


def write_csv(df: DataFrame, target: str | Path) -> Path:
    """A UTF-8 CSV file with a header and CRLF line ends."""
    return write_text(df, df.columns, TextFormat("utf-8", ",", False, "\r\n", True), target)


def write_parquet(df: DataFrame, target: str | Path) -> Path:
    """One Parquet file with the DataFrame's types, also if it has no rows.

    All tasks make rows; then one copies what they wrote into one file.
    """
    target = Path(target)
    with _apart(target) as folder:
        df.write.parquet(str(folder / "made"))
        made = df.sparkSession.read.schema(df.schema).parquet(str(folder / "made"))
        made.coalesce(1).write.parquet(str(folder / "whole"))
        os.replace(_parts(folder / "whole")[0], target)
    return target


def _truth(c: Column) -> Column:
    low = F.lower(F.trim(c))
    return F.when(low.isin("true", "1"), True).when(low.isin("false", "0"), False)


def coerced(c: Column, kind: T.DataType) -> Column:
    """A string as the original type; null where it doesn't fit."""
    if isinstance(kind, T.StringType):
        return c
    if isinstance(kind, T.BooleanType):
        return _truth(c)
    plain = F.regexp_replace(F.regexp_replace(F.trim(c), r"[,$]", ""), r"%$", "")
    if isinstance(kind, T.IntegralType):
        return F.bround(plain.try_cast("decimal(38,6)"), 0).try_cast(kind)
    if isinstance(kind, (T.FractionalType, T.DecimalType)):
        return plain.try_cast(kind)
    if isinstance(kind, T.DateType):
        return F.substring(c, 1, 10).try_cast("date")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return c.try_cast(kind)
    return F.lit(None).cast(kind)
