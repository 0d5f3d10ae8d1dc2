"""Text files in byte ranges: what encoding all of their bytes fit, where records begin, and the records themselves.

A task looks at one range. A character, a line or a record that goes on beyond the range's end belongs to the range
it begins in. Whether a line feed ends a record depends on all quotes before it, so a task finds out what becomes of
either state, outside and inside quotes, in its range; put together in order, these say how every range begins. The
driver holds a few numbers for each range.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

RANGE = 32 << 20
#: Bytes that one record may have.
LONGEST = 64 << 20
_AHEAD = 1 << 20
#: Bytes without a meaning in Windows-1252.
_MEANINGLESS = np.frombuffer(b"\x81\x8d\x8f\x90\x9d", np.uint8)
BOM = b"\xef\xbb\xbf"
_BLANK = bytes(range(33))
_LOOK = "range long, invalid long, legacy boolean, opened boolean, closed boolean, plain boolean"


class RecordTooLong(ValueError):
    """A record of more than LONGEST bytes: most likely a quote that is never closed."""


def locate(path: str | Path) -> tuple[fs.FileSystem, str]:
    if re.match(r"[a-z][a-z0-9+.-]*:/", str(path)):
        return fs.FileSystem.from_uri(re.sub(r"^file:/(?=[^/])", "file:///", str(path)))
    return fs.LocalFileSystem(), str(Path(path).resolve())


class Bytes:
    """A file's bytes by place."""

    def __init__(self, path: str | Path):
        store, inside = locate(path)
        self.size = store.get_file_info(inside).size
        self.file = store.open_input_file(inside)

    def read(self, low: int, high: int) -> bytes:
        low = max(0, low)
        return self.file.read_at(max(0, min(high, self.size) - low), low)

    def line_start(self, at: int) -> int:
        """The first place from ``at`` on where a line begins, or the file's end."""
        if at <= 0:
            return 0
        low = at - 1
        while low < self.size:
            data = self.read(low, low + _AHEAD + 1)
            ends = line_ends(np.frombuffer(data, np.uint8), low + len(data) >= self.size)
            if len(ends):
                return low + int(ends[0])
            low += _AHEAD
            if low - at > LONGEST:
                raise RecordTooLong(f"no line ends in the {LONGEST >> 20} MB after byte {at}")
        return self.size


def line_ends(data: np.ndarray, final: bool) -> np.ndarray:
    """Places after line feeds, and after carriage returns without one. The last byte counts only if it is a line feed or the file's."""
    feed, back = data == 10, data == 13
    back[:-1] &= ~feed[1:]
    if len(back) and not final:
        back[-1] = False
    return np.flatnonzero(feed | back) + 1


def _character_end(source: Bytes, at: int) -> int:
    """Where a UTF-8 character that began before ``at`` ends, or ``at``."""
    head = source.read(at - 3, at)
    for back, byte in enumerate(reversed(head), 1):
        if byte & 0xC0 != 0x80:
            size = 4 if byte >= 0xF0 else 3 if byte >= 0xE0 else 2 if byte >= 0xC0 else 1
            return max(at, min(source.size, at - back + size))
    return at


def first_invalid(source: Bytes, low: int, high: int) -> int:
    """The first byte from low to high that isn't UTF-8, or -1."""
    low, high = _character_end(source, low), _character_end(source, high)
    try:
        source.read(low, high).decode("utf-8")
    except UnicodeDecodeError as e:
        return low + e.start
    return -1


class Quotes:
    """What quotes in a line do: a quoted field begins with one and ends with one, doubled ones are content."""

    def __init__(self, delimiter: str):
        d = b"\\x%02x" % ord(delimiter)
        text = b'[^"]*+(?:""[^"]*+)*+'
        bare = b"[^\"%b][^%b]*+" % (d, d)
        field_ = b'(?:"%b"[^%b]*+|%b|)' % (text, d, bare)
        clean = b'(?:"%b"(?=%b|$)|%b|)' % (text, d, bare)
        more = lambda f: b"(?:%b%b)*+" % (d, f)
        self.outside = re.compile(field_ + more(field_), re.S)
        self.inside = re.compile(text + b'"[^%b]*+' % d + more(field_), re.S)
        self.clean = re.compile(clean + more(clean), re.S)

    def ends_inside(self, line: bytes, inside: bool) -> bool:
        return not (self.inside if inside else self.outside).fullmatch(line)


def _follow(data: bytes, final: bool, quotes: Quotes, inside: bool) -> tuple[np.ndarray, np.ndarray, bool]:
    """Ends of lines, whether each ends inside quotes, and whether all quotes are plain (fields quoted as a whole, on one line)."""
    array = np.frombuffer(data, np.uint8)
    ends = line_ends(array, final)
    if not len(ends) or ends[-1] < len(data):
        ends = np.append(ends, len(data))
    flips, now, plain = np.zeros(len(ends), np.int64), inside, not inside
    for i in np.unique(np.searchsorted(ends, np.flatnonzero(array == 34), "right")).tolist():
        line = data[int(ends[i - 1]) if i else 0 : int(ends[i])].rstrip(b"\r\n")
        after = quotes.ends_inside(line, now)
        plain = plain and not after and bool(quotes.clean.fullmatch(line))
        flips[i], now = after != now, after
    return ends, (np.cumsum(flips) + inside) % 2 == 1, plain


def _only_spaces(data: bytes, final: bool) -> bool:
    """Whether a line has only white space, tabs that delimit among it; Spark's reader leaves such lines out."""
    array = np.frombuffer(data, np.uint8)
    begins = np.append(0, line_ends(array, final))
    begins = begins[begins < len(data)]
    ends = np.append(begins[1:], len(data))
    maybe = np.flatnonzero((array[begins] <= 32) & (array[begins] != 10) & (array[begins] != 13))
    return any(not data[a:z].strip(_BLANK) for a, z in zip(begins[maybe].tolist(), ends[maybe].tolist()))


def _look(path: str, delimiter: str, step: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, quotes = Bytes(path), Quotes(delimiter)
        for batch in batches:
            for i in batch.column(0).to_pylist():
                low, high = i * step, min((i + 1) * step, source.size)
                invalid = first_invalid(source, low, high)
                legacy = not np.isin(np.frombuffer(source.read(low, high), np.uint8), _MEANINGLESS).any()
                begin, end = source.line_start(low), source.line_start(high)
                data = source.read(begin, end)
                if begin == 0 and data.startswith(BOM):
                    data = data[len(BOM) :]
                opened, closed, plain = False, False, not _only_spaces(data, end >= source.size)
                if b'"' in data:
                    _, state, clean = _follow(data, end >= source.size, quotes, False)
                    opened, plain = bool(state[-1]), plain and clean
                    closed = not _follow(data, end >= source.size, quotes, True)[1][-1]
                row = {"range": [i], "invalid": [invalid], "legacy": [legacy], "opened": [opened], "closed": [closed], "plain": [plain]}
                yield pa.RecordBatch.from_pydict(row)

    return run


@dataclass
class Ranges:
    """A file as its tasks saw it."""

    path: str
    delimiter: str
    step: int
    rows: list = field(repr=False)

    @cached_property
    def invalid(self) -> int:
        """The first byte that isn't UTF-8, or -1."""
        return min((r["invalid"] for r in self.rows if r["invalid"] >= 0), default=-1)

    @cached_property
    def legacy(self) -> bool:
        """Whether all bytes mean something in Windows-1252."""
        return all(r["legacy"] for r in self.rows)

    @cached_property
    def states(self) -> list[bool]:
        """Whether each range's first line begins inside quotes, and whether the file ends there."""
        out = [False]
        for r in self.rows:
            out.append(not r["closed"] if out[-1] else r["opened"])
        return out

    @cached_property
    def plain(self) -> bool:
        """Whether every quoted field is quoted as a whole and on one line, so that lines are records."""
        return not any(self.states) and all(r["plain"] for r in self.rows)


def look(spark: SparkSession, path: str | Path, delimiter: str, step: int = RANGE) -> Ranges:
    """What tasks find in a file's byte ranges, each read once."""
    path = str(path)
    n = max(1, -(-Bytes(path).size // step))
    seen = spark.range(0, n, 1, n).mapInArrow(_look(path, delimiter, step), _LOOK)
    return Ranges(path, delimiter, step, sorted(seen.collect(), key=lambda r: r["range"]))


def first_record(path: str | Path) -> int:
    """Where the first line begins that isn't blank."""
    source, at = Bytes(path), 0
    if source.read(0, len(BOM)) == BOM:
        at = len(BOM)
    while at < source.size:
        data = source.read(at, at + _AHEAD)
        rest = data.lstrip(b"\r\n")
        at += len(data) - len(rest)
        if rest:
            return at
    return at


def _read(seen: Ranges, encoding: str, columns: int, header_at: int | None, states: list[bool]):
    path, delimiter, step = seen.path, seen.delimiter, seen.step

    def owned(source: Bytes, quotes: Quotes, i: int) -> tuple[int, bytes]:
        """The records that begin in a range, from the place of the first on."""
        begin, end = source.line_start(i * step), source.line_start(min((i + 1) * step, source.size))
        if begin >= end:
            return begin, b""
        data = source.read(begin, end)
        ends, state, _ = _follow(data[len(BOM) :] if begin == 0 and data.startswith(BOM) else data, end >= source.size, quotes, states[i])
        shift = len(BOM) if begin == 0 and data.startswith(BOM) else 0
        first = shift
        if states[i]:  # the range begins within a record of an earlier one
            closed = np.flatnonzero(~state)
            if not len(closed):
                return begin, b""
            first = int(ends[closed[0]]) + shift
        parts, inside = [data[first:]], bool(state[-1])
        while inside and end < source.size:
            more = source.line_start(end + _AHEAD)
            data = source.read(end, more)
            ends, state, _ = _follow(data, more >= source.size, quotes, True)
            closed = np.flatnonzero(~state)
            inside = not len(closed)
            parts.append(data if inside else data[: int(ends[closed[0]])])
            if sum(map(len, parts[1:])) > LONGEST:
                raise RecordTooLong(f"the record before byte {end} of {path} has more than {LONGEST >> 20} MB; is a quote never closed?")
            end = more
        return begin + first, b"".join(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(LONGEST)
        source, quotes = Bytes(path), Quotes(delimiter)
        names = [f"c{i}" for i in range(columns)] + ["_broken"]
        blank = [""] * columns
        for batch in batches:
            for i in batch.column(0).to_pylist():
                at, data = owned(source, quotes, i)
                skip = header_at is not None and at <= header_at < at + len(data)
                rows, broken = [], []
                for row in csv.reader(io.StringIO(data.decode(encoding.removesuffix("-sig"), "replace"), newline=""), delimiter=delimiter):
                    if not row:
                        continue
                    if skip:
                        skip = False
                        continue
                    ragged = len(row) != columns
                    rows.append((row + blank)[:columns] if ragged else row)
                    broken.append("ragged" if ragged else None)
                    if len(rows) == 10_000:
                        yield _batch(rows, broken, names)
                        rows, broken = [], []
                if rows:
                    yield _batch(rows, broken, names)

    return run


def _batch(rows: list[list[str]], broken: list[str | None], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in zip(*rows)), pa.array(broken, pa.string())], names)


def read(spark: SparkSession, seen: Ranges, encoding: str, columns: int, has_header: bool) -> DataFrame:
    """The file's records as c0, c1, ... and _broken, which is null where a record has as many fields as there are columns."""
    n = len(seen.rows)
    schema = ", ".join([*(f"c{i} string" for i in range(columns)), "_broken string"])
    return spark.range(0, n, 1, n).mapInArrow(_read(seen, encoding, columns, first_record(seen.path) if has_header else None, seen.states), schema)
