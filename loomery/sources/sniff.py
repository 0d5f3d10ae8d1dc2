"""What a text file looks like from its beginning: delimiter, quoting, line ends, header, and a first guess at the encoding.

The guess is only settled by all of the file's bytes, see ``records``.
"""

from __future__ import annotations

import csv
import io
from collections import Counter
from dataclasses import dataclass
from pathlib import Path

# File types, delimiters in order of preference, and how much is looked at.
TEXT_SUFFIXES = (".csv", ".txt", ".tsv", ".dat", ".psv")
PARQUET_SUFFIXES = (".parquet", ".pq")
DELIMITERS = (",", ";", "\t", "|")
ENCODING_BYTES, FORMAT_BYTES = 4 << 20, 256 << 10
DELIMITER_LINES, QUOTED_LINES = 50, 20


@dataclass
class TextFormat:
    encoding: str
    delimiter: str
    quote_all: bool
    line_end: str
    has_header: bool

    def describe(self) -> str:
        names = {"\t": "tab", ",": "comma", ";": "semicolon", "|": "pipe"}
        parts = ["text", self.encoding, names.get(self.delimiter, repr(self.delimiter)), "CRLF" if self.line_end == "\r\n" else "LF"]
        return ", ".join(parts + ["all quoted"] * self.quote_all + ["no header"] * (not self.has_header))


def sniff_encoding(path: str | Path) -> str:
    with open(path, "rb") as file:
        head = file.read(ENCODING_BYTES)
        whole = not file.read(1)
    if head.startswith(b"\xef\xbb\xbf"):
        return "utf-8-sig"
    for encoding in ("utf-8", "cp1252"):
        # the last character may be cut off
        for cut in range(1 if whole or encoding != "utf-8" else 4):
            try:
                head[: len(head) - cut].decode(encoding)
                return encoding
            except UnicodeDecodeError:
                pass
    return "latin-1"


def _counts(lines: list[str], delimiter: str) -> list[int]:
    return [len(r) for r in csv.reader(io.StringIO("\n".join(lines)), delimiter=delimiter)]


def sniff_format(path: str | Path, encoding: str | None = None, delimiter: str | None = None, has_header: bool = True) -> TextFormat:
    encoding = encoding or sniff_encoding(path)
    with open(path, "rb") as file:
        sample = file.read(FORMAT_BYTES).decode(encoding, "replace")
    lines = [line for line in sample.splitlines() if line.strip()]
    if delimiter is None:
        best = (0.0, 0)
        delimiter = "\t" if str(path).lower().endswith(".tsv") else ","
        for one in DELIMITERS:
            fields = Counter(_counts(lines[:DELIMITER_LINES], one))
            if fields:
                size, rows = fields.most_common(1)[0]
                score = (rows / sum(fields.values()), size)
                if size >= 2 and score > best:
                    best, delimiter = score, one
    data = lines[1:] if has_header else lines
    quoted = data[:QUOTED_LINES]
    quote_all = bool(quoted) and all(x.startswith('"') and x.rstrip("\r\n").endswith('"') and len(x) > 1 for x in quoted)
    return TextFormat(encoding, delimiter, quote_all, "\r\n" if "\r\n" in sample else "\n", has_header)


def header_of(path: str | Path, form: TextFormat) -> list[str]:
    """Names of the columns: the first record that isn't empty, or column_1, column_2, ..."""
    with open(path, newline="", encoding=form.encoding, errors="replace") as file:
        for record in csv.reader(file, delimiter=form.delimiter):
            if record and any(x for x in record):
                return record if form.has_header else [f"column_{i + 1}" for i in range(len(record))]
    raise ValueError(f"{path} is empty")
