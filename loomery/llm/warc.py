r"""WARC archives: a writer with revisit records, and a splittable reader.

Writing. Each record is a gzip member of its own. Records with equal payloads of ``least_bytes`` or more are found by
their SHA-1 and length; only the digests that occur more than once are kept as a table. That table is broadcast while
it has ``most_rows`` rows at most, and joined by a shuffle, whose large partitions Spark splits, beyond that. The
record with the largest page_id is the response, and the others revisit it. Rows that repeat that page_id are
responses too. A null page_id is less than all others; if all are null, all are responses.

Reading. Archives are cut into byte ranges. A task looks for the three bytes that begin a gzip member, and takes
a place for a record if what it decodes to begins with a WARC version and whole headers, of any length, that give the
block's; else it looks further. A task owns the records that start inside its range, and reads beyond its end to finish the last. After a
record it tries the next byte first, so that ranges are read once.

Payloads are UTF-8; null counts as empty. Page ids and, for revisits, the payload's length and the response's page
id travel in extension fields (``X-Page-ID``, ``X-Payload-Length``, ``X-Refers-To-Page-ID``). White space and control characters
in a URL are percent-encoded; a null or empty URL leaves the field out.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery.llm import files
from loomery.llm.storage import materialise, prepare_workers, shared_folder

BEGIN = b"\x1f\x8b\x08"
#: Bytes read at a time.
READ = 1 << 20
_LENGTH = re.compile(rb"^content-length:[ \t]*([0-9]+)[ \t]*$", re.I | re.M)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def build_record(page_id: int | None, url: str | None, payload: bytes, revisits: bool, refers_to: int | None, date: str, level: int) -> bytes:
    """One gzip member with a response or revisit record."""
    digest = digest_of(payload)
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    fields = [("WARC-Type", "revisit" if revisits else "response"), ("WARC-Record-ID", _record_id(page_id, digest)), ("WARC-Date", date)]
    if url:
        fields.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    fields.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    if page_id is not None:
        fields.append(("X-Page-ID", str(page_id)))
    if revisits:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _record_id(refers_to, digest)), ("X-Refers-To-Page-ID", str(refers_to)), ("X-Payload-Length", str(len(payload)))]
    else:
        block += payload
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
    return squeeze.compress(head.encode()) + squeeze.compress(block + b"\r\n\r\n") + squeeze.flush()


def _write(folder: str, date: str, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, n = TaskContext.get().partitionId(), 0

        def records() -> Iterator[bytes]:
            nonlocal n
            for batch in batches:
                for page_id, url, html, keeper in zip(*(c.to_pylist() for c in batch.columns)):
                    n += 1
                    yield build_record(page_id, url, (html or "").encode(), keeper is not None and keeper != page_id, keeper, date, level)

        size = files.put(folder, f"pages-{task:06d}.warc.gz", records())
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (task, n, size)], ["task", "records", "bytes"])

    return run


def write_warc(pages: DataFrame, folder: str | None = None, least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", level: int = 6, most_rows: int = 500_000) -> str:
    """Write all rows of ``pages`` (page_id, url, html) as archives, and return the folder."""
    spark = pages.sparkSession
    prepare_workers(spark)
    folder = folder or shared_folder(spark, "warc")
    files.make_folder(folder)
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    sha, size = F.sha1(F.col("html").cast("binary")), F.octet_length("html")
    groups = pages.select("page_id", sha.alias("sha"), size.alias("size")).filter(F.col("size") >= least_bytes).groupBy("sha", "size")
    twice = groups.agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    twice = materialise(twice.select(F.unhex("sha").alias("sha_of"), F.col("size").alias("size_of"), "keeper"), "equal-payloads")
    other = F.broadcast(twice) if twice.count() <= most_rows else twice
    known = pages.withColumns({"sha": F.unhex(sha), "size": size})
    known = known.join(other, (F.col("sha") == F.col("sha_of")) & (F.col("size") == F.col("size_of")), "left")
    done = known.select("page_id", "url", "html", "keeper").mapInArrow(_write(folder, date, level), "task long, records long, bytes long")
    materialise(done, "warc-files")
    return folder


class _Window:
    """A file's bytes from a place onwards, read as far as they are asked for."""

    def __init__(self, file, start: int):
        self.file, self.at, self.data, self.ended = file, start, bytearray(), False  # which grows in place
        file.seek(start)

    def more(self) -> bool:
        got = b"" if self.ended else self.file.read(READ)
        self.ended = not got
        self.data += got
        return bool(got)

    def drop(self, place: int) -> None:
        if place - self.at >= READ:
            del self.data[: place - self.at]
            self.at = place


def _member(window: _Window, place: int) -> tuple[bytes, int] | None:
    """What the gzip member at ``place`` holds, and where it ends; None if it isn't a record."""
    inflate, out, at, checked = zlib.decompressobj(31), [], place - window.at, False
    seen = bytearray()
    try:
        while not inflate.eof:
            if at >= len(window.data) and not window.more():
                return None
            step = READ if checked else 1 << 12
            piece = bytes(memoryview(window.data)[at : at + step])
            out.append(inflate.decompress(piece))
            at += len(piece)
            if not checked:  # headers may have any length, as URLs do
                known = len(seen)
                seen += out[-1]
                if not b"WARC/1.".startswith(seen[:7]):
                    return None
                blank = seen.find(b"\r\n\r\n", max(0, known - 3))
                checked = blank >= 0
                if checked and not _LENGTH.search(bytes(seen[:blank]).replace(b"\r\n", b"\n")):
                    return None
    except zlib.error:
        return None
    return (b"".join(out), window.at + at - len(inflate.unused_data)) if checked else None


def records_in(file, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(place, record) of the records that start in [start, end)."""
    window, place = _Window(file, start), start
    while place < end:
        window.drop(place)
        found = window.data.find(BEGIN, place - window.at)
        if found < 0:
            place = max(place, window.at + len(window.data) - len(BEGIN) + 1)
            if not window.more():
                return
            continue
        place = window.at + found
        if place >= end:
            return
        got = _member(window, place)
        if got is None:
            place += 1
        else:
            yield place, got[0]
            place = got[1]


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Fields, by lower-case name, and the block."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            fields[name.strip().lower()] = value.strip()
    return fields, rest[: int(fields.get("content-length", 0))]


_READ = "path string, place long, record_type string, record_id string, target_uri string, page_id long, refers_to long, payload_digest string, payload_bytes long, payload binary"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    names = [x.split() for x in _READ.split(", ")]
    number = lambda x: int(x) if x is not None else None

    def batch_of(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows), names)], [n for n, _ in names])

    for batch in batches:
        for path, start, end in zip(*(c.to_pylist() for c in batch.columns)):
            store, inner = files.open_folder(path)
            rows, held = [], 0
            with store.open_input_file(inner) as file:
                for place, data in records_in(file, start, end):
                    fields, block = parse_record(data)
                    kind = fields.get("warc-type")
                    payload = block.partition(b"\r\n\r\n")[2] if fields.get("content-type", "").startswith("application/http") else block
                    if kind == "revisit":
                        digest, size, payload = fields.get("warc-payload-digest", "").removeprefix("sha1:"), number(fields.get("x-payload-length")), None
                    else:
                        digest, size = digest_of(payload), len(payload)
                    rows.append((path, place, kind, fields.get("warc-record-id"), fields.get("warc-target-uri"), number(fields.get("x-page-id")), number(fields.get("x-refers-to-page-id")), digest, size, payload))
                    held += len(payload or b"")
                    if held > 8 << 20 or len(rows) >= 5000:
                        yield batch_of(rows)
                        rows, held = [], 0
            if rows:
                yield batch_of(rows)


def read_warc(spark, folder: str, split: int = 16 << 20) -> DataFrame:
    """All records of the gzip archives in ``folder``; a task reads ``split`` bytes of an archive."""
    prepare_workers(spark)
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("path", "length")
    starts = listed.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length"), F.lit(split).cast("long"))).alias("start"))
    ranges = starts.filter("start < length").select("path", "start", F.least(F.col("start") + split, F.col("length")).alias("end"))
    n = max(1, spark.sparkContext.defaultParallelism, ranges.count())
    return ranges.repartition(min(n, 100_000), "path", "start").mapInArrow(_read, _READ)


def query(spark, sf_dir: str) -> DataFrame:
    """op10: what the archives of all pages hold."""
    folder = write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return read_warc(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
