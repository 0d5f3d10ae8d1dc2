"""Fill-in-middle examples: texts cut at two seeded places, their parts put in another order.

Texts are cut between code points, but stored as UTF-8, so a cut needs the byte where a code point begins. Rows are
sorted by a hash of the text and by the text itself; neighbours with the same content are one group, whose list of
code point boundaries is made once, in Elias-Fano code, and joined back to the group's documents, each of which
selects its two cuts from it. A text that very many rows share is dealt out in parts, each with its own list.

A null text is empty, an empty text stays plain. Repeated rows give equal rows. A null doc_id is written "null" for
the dice. Other columns aren't looked at. An empty table gives an empty result. Very long texts are handled one at
a time: memory holds a few times the longest text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomery.llm.elias_fano import EliasFano, encode
from loomery.llm.storage import lean, prepare_workers

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Bytes of output that a task holds at a time.
STEP = 4 << 20
OUT = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])


def boundaries(text: bytes) -> bytes:
    """Where the code points of a text begin, and where the last one ends, in Elias-Fano code."""
    data = np.frombuffer(text, np.uint8)
    return encode(np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data)), len(data))


def dice(seed: int, doc_id: int | None) -> tuple[int, ...]:
    """Four numbers below 2**32 that the seed and the document's id decide."""
    digits = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digits[8 * i : 8 * i + 8], 16) for i in range(4))


class Example:
    """One text of a group, ready to be cut for each of its documents."""

    def __init__(self, text: bytes, seed: int, plain: int, spm: int):
        self.text, self.seed, self.plain, self.spm = text, seed, plain, spm
        self.index = EliasFano(boundaries(text))
        self.n = len(self.index) - 1
        self.marked = not text or any(m in text for m in (PREFIX, SUFFIX, MIDDLE))

    def row(self, doc_id: int | None) -> tuple:
        one, two, form, order = dice(self.seed, doc_id)
        if self.marked or form % 100 >= 100 - self.plain:
            return doc_id, self.n, "plain", None, None, self.text
        low, high = sorted((one % (self.n + 1), two % (self.n + 1)))
        a, z = self.index.select(np.array([low, high])).tolist()
        prefix, middle, suffix = self.text[:a], self.text[a:z], self.text[z:]
        if order % 100 < self.spm:
            return doc_id, self.n, "spm", low, high - low, b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
        return doc_id, self.n, "psm", low, high - low, b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array(c, pa.binary()).cast(pa.string()) if f.type == pa.string() and f.name == "output" else pa.array(c, f.type) for c, f in zip(zip(*rows), OUT)]
    return pa.RecordBatch.from_arrays(columns, schema=OUT)


def _cut(seed: int, plain: int, spm: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, rows, size = None, [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = text.as_buffer().to_pybytes()
                if one is None or data != one.text:
                    one = Example(data, seed, plain, spm)
                rows.append(one.row(doc_id))
                size += len(data)
                if size >= STEP:
                    yield _batch(rows)
                    rows, size = [], 0
        if rows:
            yield _batch(rows)

    return lean(run)


def fill_in_middle(documents: DataFrame, seed: int = 1, plain_percent: int = 10, spm_percent: int = 20, hot_rows: int = 1000) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of each row of ``documents`` (doc_id, text).

    n counts code points; the form is "psm" (prefix, suffix, middle), "spm" (suffix, prefix, middle) or "plain"
    (``plain_percent`` of the rows, empty texts, and texts that hold a marker). A text in more than ``hot_rows`` rows
    (or one in 65,536 of all rows, if that is more) is dealt out in as many parts as it has times that; so
    65,536 such texts are broadcast at most, 16 bytes each.
    """
    prepare_workers(documents.sparkSession)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("key", F.xxhash64("text"))
    least = max(hot_rows, docs.count() >> 16)
    hot = docs.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > least)
    dealt = docs.join(F.broadcast(hot), "key", "left")
    part = F.coalesce(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.ceil(F.col("rows") / least)), F.lit(0))
    met = dealt.select("doc_id", "text", "key", part.alias("part")).repartition("key", "part").sortWithinPartitions("key", "text")
    return met.select("doc_id", "text").mapInArrow(_cut(seed, plain_percent, spm_percent), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The exact text that an example was made from."""
    parts = r"^<{}>([\s\S]*?)<{}>([\s\S]*?)<M>([\s\S]*)$"
    return F.when(form == "psm", F.regexp_replace(output, parts.format("P", "S"), "$1$3$2")).when(form == "spm", F.regexp_replace(output, parts.format("S", "P"), "$2$3$1")).otherwise(output)


def query(spark, sf_dir: str) -> DataFrame:
    """op13: every document's cut, and digests of its example and of the text made from that again."""
    out = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
