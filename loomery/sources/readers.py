"""Files as DataFrames of strings, columns named by position."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomery.functions.names import named as column
from loomery.sources import records
from loomery.sources.sniff import PARQUET_SUFFIXES, TEXT_SUFFIXES, TextFormat, header_of, sniff_format

BROKEN = "_broken"
_CONTROLS = "".join(chr(i) for i in range(0x80, 0xA0))
#: What the bytes 80 to 9F mean in Windows-1252; five of them mean nothing.
_MEANT = "".join(bytes([i]).decode("cp1252", "replace") for i in range(0x80, 0xA0))


@dataclass
class Source:
    """An opened file: its columns' names, and a DataFrame with columns c0, c1, ... of strings."""

    path: Path
    columns: list[str]
    data: DataFrame
    text: TextFormat | None = None
    schema: T.StructType | None = None
    unsupported: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)

    @property
    def kind(self) -> str:
        return "text" if self.text else "parquet"

    def describe(self) -> str:
        return self.text.describe() if self.text else "parquet"

    def rows(self) -> int:
        return self.data.count()

    def rows_and_ragged(self) -> tuple[int, int]:
        """Rows, and those with more or fewer fields than the header, in one scan."""
        if self.text is None:
            return self.rows(), 0
        every = F.max(F.hash(*(named(i) for i in range(len(self.columns)))))  # fields are only counted where all are read
        got = self.data.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(BROKEN).isNotNull()).alias("ragged"), every).first()
        return got["n"], got["ragged"]


def named(i: int) -> str:
    return f"c{i}"


def _as_text(c: Column, kind: T.DataType) -> Column | None:
    if isinstance(kind, (T.StringType, T.BooleanType, T.IntegralType, T.DecimalType)):
        return c.cast("string")
    if isinstance(kind, T.FractionalType):
        plain = F.regexp_replace(F.format_string("%.10f", c.cast("double")), r"(\.\d*?)0+$", "$1")
        return F.when(F.isnan(c), "nan").when(F.abs(c) < 1e15, F.regexp_replace(plain, r"\.$", ".0")).otherwise(c.cast("string"))
    if isinstance(kind, T.DateType):
        return F.date_format(c, "yyyy-MM-dd")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return None


def open_parquet(spark: SparkSession, path: str | Path) -> Source:
    df = spark.read.parquet(str(path))
    out, unsupported = [], []
    for i, f in enumerate(df.schema.fields):
        text = _as_text(column(f.name), f.dataType)
        if text is None:
            unsupported.append(f.name)
        out.append((F.lit(None).cast("string") if text is None else text).alias(named(i)))
    return Source(Path(path), df.columns, df.select(*out), schema=df.schema, unsupported=unsupported)


def open_text(spark: SparkSession, path: str | Path, encoding: str | None = None, delimiter: str | None = None, has_header: bool = True, range_bytes: int = records.RANGE) -> Source:
    """A text file. All its bytes decide the encoding, if none is given, and how it is read.

    Lines are Spark's to read where they are records and quoted fields are quoted as a whole. Else tasks read the
    records that begin in their ranges of ``range_bytes``; both ways give the same cells.
    """
    form, warnings = sniff_format(path, encoding, delimiter, has_header), []
    wide = form.encoding.lower().startswith(("utf-16", "utf-32"))
    seen = None if wide or ord(form.delimiter) > 127 else records.look(spark, path, form.delimiter, range_bytes)
    if seen and seen.invalid >= 0 and form.encoding.startswith("utf-8"):
        if encoding is None:
            form.encoding = "cp1252" if seen.legacy else "latin-1"
        warnings.append(f"byte {seen.invalid} isn't UTF-8; " + ("it is read as a replacement character" if encoding else f"the file is read as {form.encoding}"))
    elif seen and encoding is None and form.encoding == "cp1252" and not seen.legacy:
        form.encoding = "latin-1"
    columns = header_of(path, form)
    if seen and not seen.plain:
        return Source(Path(path), columns, records.read(spark, seen, form.encoding, len(columns), has_header), text=form, warnings=warnings)
    fields = [T.StructField(named(i), T.StringType()) for i in range(len(columns))]
    single = form.encoding.lower() in ("cp1252", "latin-1", "iso-8859-1", "windows-1252")
    known = {"utf-8": "UTF-8", "utf-8-sig": "UTF-8", "ascii": "US-ASCII", "utf-16": "UTF-16", "utf-16-le": "UTF-16LE", "utf-16-be": "UTF-16BE"}
    charset = "ISO-8859-1" if single else known.get(form.encoding.lower(), form.encoding)
    reader = spark.read.schema(T.StructType([*fields, T.StructField(BROKEN, T.StringType())])).options(
        sep=form.delimiter, header=form.has_header, enforceSchema=True, quote='"', escape='"', encoding=charset, mode="PERMISSIVE", columnNameOfCorruptRecord=BROKEN,
        multiLine=seen is None, maxCharsPerColumn=-1, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )
    df = reader.csv(str(path))
    text = lambda c: F.coalesce(c, F.lit(""))
    if form.encoding.lower() in ("cp1252", "windows-1252"):
        text = lambda c: F.coalesce(F.translate(c, _CONTROLS, _MEANT), F.lit(""))
    data = df.select(*(text(F.col(named(i))).alias(named(i)) for i in range(len(columns))), BROKEN)
    return Source(Path(path), columns, data, text=form, warnings=warnings)


def open_source(spark: SparkSession, path: str | Path, encoding: str | None = None, delimiter: str | None = None, has_header: bool = True) -> Source:
    suffix = Path(path).suffix.lower()
    if suffix in PARQUET_SUFFIXES:
        return open_parquet(spark, path)
    if suffix in TEXT_SUFFIXES:
        if Path(path).is_file() and not Path(path).stat().st_size:
            raise ValueError(f"{path} is empty")
        return open_text(spark, path, encoding, delimiter, has_header)
    raise ValueError(f"unsupported file type: {path}")


def find_source_files(folder: str | Path, prefix: str, recursive: bool = False) -> list[Path]:
    """Supported files in a folder, without those that this library made."""
    found = Path(folder).rglob("*") if recursive else Path(folder).glob("*")
    good = TEXT_SUFFIXES + PARQUET_SUFFIXES
    return sorted(p for p in found if p.is_file() and p.suffix.lower() in good and not p.name.startswith((prefix, ".")))
