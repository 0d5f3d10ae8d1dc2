"""Token ids in files: frequency-ranked, in byte-aligned variable-length codes with separate control bytes.

A file holds the documents of one range of doc_id, in order, so that files in order hold all of them. Ids are
replaced by their ranks by frequency, 0 the most frequent; a rank takes 1 to 4 bytes. Two bits for each rank say how
many, four ranks to a control byte; control bytes stand apart from the data bytes, so that numpy decodes a block by
looking up control bytes in a table of lengths. The layout, all numbers little-endian:

    file    "LMTOK1\\0\\0", int64 number of ids in all files before, int64 number of blocks, uint32 n and n uint32:
            the ids in rank order; then the blocks
    block   int64 documents, ids, control bytes, data bytes; then for each document int64 doc_id, uint8 1 if
            that is null, int64 ids; then the control bytes, then the data bytes

The first pass tokenises: documents go to ranges of doc_id (ties by a hash of the text), and each task writes its
ids to a provisional file and returns their counts. Counts add up to a table with a row for each id, at most the
vocabulary, which is all the driver sees. The second pass reads each provisional file block by block, recodes it into
one or more files of ``file_bytes`` at most, and removes it. Files appear under their final name when they are whole,
and a task that runs again writes the same, so lost executors do no harm. A reader takes a file at a time.

Tokenising. The pre-tokeniser of byte-level BPE starts a token at a single space between words, and makes a single line
feed between words a token. So texts are cut there, numpy finds the distinct pieces, and each goes to the library once
while it is in a worker's table. Texts with other white space, or with an added token of the tokenizer written out, go to the library
whole. The ids are those of the whole text. Null texts are empty; every document ends with ``end``.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomery.llm import files
from loomery.llm import textkernel as tk
from loomery.llm.storage import lean, materialise, prepare_workers, shared_folder, shuffle_partitions

MAGIC = b"LMTOK1\0\0"
#: Ids of a block; a longer document is a block of its own.
BLOCK = 1 << 20
#: Punctuation that is a token apart from a letter or digit before it; an apostrophe may not be.
_SIGNS = np.zeros(256, bool)
_SIGNS[list(b".,!?;:%$&*#|()")] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[list(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = True
_LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + np.uint8(1)
_MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes."""
    lengths = 1 + (ranks >= 1 << 8).astype(np.uint8) + (ranks >= 1 << 16) + (ranks >= 1 << 24)
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[: len(ranks)] = lengths - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    wide = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)
    return control.tobytes(), wide[np.arange(4) < lengths[:, None]].tobytes()


def decode_ranks(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    lengths = _LENGTHS[control].reshape(-1)[:n]
    at = np.cumsum(lengths, dtype=np.int64) - lengths
    padded = np.concatenate([data, np.zeros(3, np.uint8)])
    out = padded[at].astype(np.uint32)
    for b in range(1, int(lengths.max(initial=1))):
        out |= padded[at + b].astype(np.uint32) << np.uint32(8 * b)
    return out & _MASKS[lengths]


def odd_documents(buf: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which documents have white space other than single spaces and line feeds between words, or at an end."""
    n = len(offsets) - 1
    odd = np.zeros(n, bool)
    doc = np.repeat(np.arange(n), np.diff(first))
    before = np.empty(len(starts), np.int64)
    before[1:] = ends[:-1]
    head = first[:-1][np.diff(first) > 0]
    before[head] = offsets[:-1][np.diff(first) > 0]
    gap = starts - before
    sign = buf[np.maximum(starts - 1, 0)]
    odd[doc[(gap > 1) | ((gap == 1) & (sign != 32) & (sign != 10)) | ((gap == 0) & (starts != offsets[doc]))]] = True
    full = np.diff(first) > 0
    rest = offsets[1:].copy()
    rest[full] -= ends[first[1:][full] - 1]
    rest[~full] -= offsets[:-1][~full]
    odd |= rest > 0
    # white space beyond ASCII, by the bytes it begins with; and the four separators
    strange = np.flatnonzero((buf >= 0x1C) & (buf <= 0x1F))
    if len(buf) > 1:
        one, two = buf[:-1], buf[1:]
        pair = ((one == 0xC2) & ((two == 0x85) | (two == 0xA0))) | ((one == 0xE1) & ((two == 0x9A) | (two == 0xA0))) | ((one == 0xE2) & (two == 0x81)) | ((one == 0xE3) & (two == 0x80))
        pair[:-1] |= (one[:-1] == 0xE2) & (two[:-1] == 0x80) & ((buf[2:] <= 0x8F) | (buf[2:] >= 0xA8) & (buf[2:] <= 0xAF))
        strange = np.concatenate([strange, np.flatnonzero(pair)])
    odd[np.searchsorted(offsets, strange, "right") - 1] = True
    return odd


class _Table:
    """Ids of known pieces by 96 bits of hash: sorted runs, merged as they grow, and one array of all ids."""

    def __init__(self, kind: np.dtype, most: int):
        self.most, self.n, self.used = most, 0, 0
        self.runs: list[tuple[np.ndarray, ...]] = []
        self.flat = np.zeros(1 << 16, kind)

    def find(self, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, size) of each piece's ids in ``flat``, and the indices of pieces that are not there."""
        place, size, left = np.zeros(len(one), np.int64), np.zeros(len(one), np.int64), np.arange(len(one))
        for keys, seconds, places, sizes in self.runs:
            at = np.minimum(np.searchsorted(keys, one[left]), len(keys) - 1)
            there = (keys[at] == one[left]) & (seconds[at] == two[left].astype(np.uint32))
            place[left[there]], size[left[there]] = places[at[there]], sizes[at[there]]
            left = left[~there]
        return place, size, left

    def append(self, ids: np.ndarray) -> int:
        """Put ids at the end of ``flat``; where they begin."""
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        return self.used - len(ids)

    def add(self, one: np.ndarray, two: np.ndarray, place: np.ndarray, size: np.ndarray) -> None:
        """Know these pieces, in the order of their first hashes, whose ids are in ``flat``."""
        self.n += len(one)
        run: tuple[np.ndarray, ...] = one, two.astype(np.uint32), place.astype(np.uint32), size.astype(np.uint32)
        while self.runs and 2 * len(run[0]) >= len(self.runs[-1][0]):
            run = tuple(map(np.concatenate, zip(self.runs.pop(), run)))
            order = np.argsort(run[0]).astype(np.uint32)
            run = tuple(x[order] for x in run)
        self.runs.append(run)


class Pieces:
    """Texts to ids, by a table of the pieces seen so far. The table keeps what came first, mostly frequent pieces, once it is full."""

    def __init__(self, path: str, special_as_text: bool, most: int = 1_500_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.kind = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.table = _Table(self.kind, most)
        self.hashers = tk.Hasher(66), tk.Hasher(77)
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        (self.feed,) = self._encode(["\n"])[0].tolist()

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, self.kind) for k in range(0, len(texts), 4096) for x in self.tokenizer.encode_batch_fast(texts[k : k + 4096], add_special_tokens=False)]

    def _encode_pieces(self, buf: np.ndarray, begin: np.ndarray, sizes: np.ndarray, many: int = 64) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, and how many each has. Line feeds between pieces are tokens of their own, so many go as one text."""
        at = np.cumsum(sizes + 1)
        out = np.full(int(at[-1]), 10, np.uint8)
        out[tk.positions(at - sizes - 1, sizes)] = buf[tk.positions(begin, sizes)]
        raw, ends = out.tobytes(), at[many - 1 :: many].tolist()
        ends += [] if ends and ends[-1] == at[-1] else [int(at[-1])]
        made = self._encode([raw[x : y - 1].decode() for x, y in zip([0, *ends], ends)])
        feed = np.array([self.feed], self.kind)
        ids = np.concatenate([x for m in made for x in (m, feed)])
        ends = np.flatnonzero(ids == self.feed)
        if len(ends) != len(begin):
            raise RuntimeError("a line feed between pieces is no token of its own")
        return ids[ids != self.feed], np.diff(ends, prepend=-1) - 1

    def ids(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and how many each has."""
        starts, ends, first = tk.words(buf, offsets)
        raw, n = buf.tobytes(), len(offsets) - 1
        odd = odd_documents(buf, offsets, starts, ends, first)
        for literal in self.added:
            at = raw.find(literal)
            while at >= 0:  # such texts go to the library whole
                i = int(np.searchsorted(offsets, at, "right")) - 1
                odd[i] = True
                at = raw.find(literal, int(offsets[i + 1]))
        sizes = np.zeros(n, np.int64)
        doc = np.repeat(np.arange(n), np.diff(first))
        if odd.any():
            even = ~odd[doc]
            starts, ends, doc = starts[even], ends[even], doc[even]
        ids = np.zeros(0, self.kind)
        if len(starts):
            try:
                ids = self._by_pieces(buf, offsets, starts, ends, doc, sizes)
            except RuntimeError:
                odd[:] = True
        if odd.any():
            whole = np.flatnonzero(odd)
            sizes[whole] = 0
            ids = ids[: sizes.sum()] if odd.all() else ids
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            parts, last = [], 0
            for i, x in zip(whole.tolist(), self._encode([raw[offsets[i] : offsets[i + 1]].decode() for i in whole.tolist()])):
                parts += [ids[last : bounds[i]], x]
                last = bounds[i + 1]
                sizes[i] = len(x)
            ids = np.concatenate([*parts, ids[last:]])
        return ids, sizes

    def _by_pieces(self, buf: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, doc: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        before = np.where(starts > offsets[doc], buf[np.maximum(starts - 1, 0)], 0)
        spaced, broken = before == 32, before == 10
        begin, stem = starts - spaced, ends.copy()
        for _ in range(4):
            stem -= _SIGNS[buf[stem - 1]] & (stem > starts + 1)
        last = buf[stem - 1]
        latin = (stem > starts + 1) & (buf[stem - 2] == 0xC3) & (last >= 0x80) & (last != 0x97) & (last != 0xB7)
        stem = np.where(_ALNUM[last] | latin, stem, ends)
        one, two = (x(buf, begin, stem) for x in self.hashers)
        order = np.argsort(one)
        fresh = np.diff(one[order], prepend=one[order[0]] + np.uint64(1)) != 0
        rep, back = order[fresh], np.empty(len(one), np.int64)
        back[order] = np.cumsum(fresh) - 1
        one, seconds = one[rep], two[rep]
        if (two != seconds[back]).any():
            raise RuntimeError("two pieces with the same hash")
        place, size, new = self.table.find(one, seconds)
        used = self.table.used
        if len(new):
            got, size[new] = self._encode_pieces(buf, begin[rep[new]], (stem - begin)[rep[new]])
            place[new] = self.table.append(got) + np.cumsum(size[new]) - size[new]
            if self.table.n < self.table.most:
                used = self.table.used
                self.table.add(one[new], seconds[new], place[new], size[new])
        # punctuation at the end of some words, and line feeds
        signed = np.flatnonzero(stem < ends)
        signs = np.zeros(len(signed), np.uint32)
        for k in range(4):
            at = stem[signed] + k
            signs |= np.where(at < ends[signed], buf[np.minimum(at, len(buf) - 1)], 0).astype(np.uint32) << np.uint32(8 * k)
        tails, tail = np.unique(signs, return_inverse=True)
        made = self._encode([int(x).to_bytes(4, "little").rstrip(b"\0").decode() for x in tails]) + [np.array([self.feed], self.kind)]
        tail_size = np.array(list(map(len, made)), np.int64)
        tail_place = self.table.append(np.concatenate(made)) + np.cumsum(tail_size) - tail_size
        # a word is perhaps a line feed, its piece, and perhaps punctuation
        take = np.zeros((len(starts), 3), np.int64)
        where = np.zeros((len(starts), 3), np.int64)
        take[:, 0], where[:, 0] = broken, tail_place[-1]
        take[:, 1], where[:, 1] = size[back], place[back]
        take[signed, 2], where[signed, 2] = tail_size[tail], tail_place[tail]
        ids = self.table.flat[tk.positions(where.ravel(), take.ravel())]
        self.table.used = used
        sizes += np.bincount(doc, take.sum(axis=1), len(sizes)).astype(np.int64)
        return ids


_PIECES: dict[tuple, Pieces] = {}


def _provisional(folder: str, path: Callable[[], str], end: int, special_as_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        key = (path(), special_as_text)
        if key not in _PIECES:
            _PIECES[key] = Pieces(*key)
        pieces = _PIECES[key]
        task, counts, total = TaskContext.get().partitionId(), np.zeros(max(pieces.size, end + 1), np.int64), 0

        def blocks() -> Iterator[bytes]:
            nonlocal counts, total
            squeeze = zstandard.ZstdCompressor(level=1)
            for batch in batches:
                doc = batch.column(0)
                null = np.asarray(doc.is_null()).astype(np.uint8)
                doc = doc.fill_null(0).to_numpy().astype("<i8")
                buf, offsets = tk.text_buffer(batch.column(1))
                for i, j in tk.steps(offsets):
                    ids, sizes = pieces.ids(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                    ids = np.insert(ids, np.cumsum(sizes), end)
                    sizes = sizes + 1
                    counts += np.bincount(ids, minlength=len(counts))
                    total += len(ids)
                    packed = squeeze.compress(ids.astype(pieces.kind).tobytes())
                    yield np.array([j - i, len(packed)], "<i8").tobytes()
                    yield doc[i:j].tobytes() + null[i:j].tobytes() + sizes.astype("<i8").tobytes() + packed

        files.put(folder, f"ids-{task:06d}.part", blocks())
        some = np.flatnonzero(counts)
        rows = [[task], [total], [some.astype("<i4").tobytes()], [counts[some].astype("<i8").tobytes()]]
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], ["task", "n", "ids", "counts"])

    return run


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for batch in batches:
        for ids, counts in zip(*batch.columns):
            ids, counts = np.frombuffer(ids.as_buffer(), "<i4"), np.frombuffer(counts.as_buffer(), "<i8")
            if len(ids) and ids[-1] >= len(total):
                total = np.concatenate([total, np.zeros(ids[-1] + 1 - len(total), np.int64)])
            total[ids] += counts
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["id", "n"])


def _parts(file, kind: np.dtype) -> Iterator[tuple[np.ndarray, ...]]:
    expand = zstandard.ZstdDecompressor()
    while head := file.read(16):
        n, size = np.frombuffer(head, "<i8")
        rows = file.read(17 * n)
        yield np.frombuffer(rows, "<i8", n), np.frombuffer(rows, np.uint8, n, 8 * n), np.frombuffer(rows, "<i8", n, 9 * n), np.frombuffer(expand.decompress(file.read(size)), kind)


def _blocks(parts: Iterator[tuple[np.ndarray, ...]], rank: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Blocks and their numbers of ids."""
    held, n = [], 0

    def block() -> tuple[int, bytes]:
        doc, null, sizes, ids = (np.concatenate(x) for x in zip(*held))
        control, body = encode_ranks(rank[ids])
        head = np.array([len(doc), len(ids), len(control), len(body)], "<i8").tobytes()
        return len(ids), head + doc.tobytes() + null.tobytes() + sizes.astype("<i8").tobytes() + control + body

    for part in parts:
        if n and n + len(part[3]) > BLOCK:
            yield block()
            held, n = [], 0
        held.append(part)
        n += len(part[3])
    if held:
        yield block()


def _recode(folder: str, kind: np.dtype, order, file_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = order.value
        rank = np.zeros(int(ids.max(initial=0)) + 1, np.uint32)
        rank[ids] = np.arange(len(ids))
        table = np.array([len(ids)], "<u4").tobytes() + ids.astype("<u4").tobytes()
        for batch in batches:
            for task, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                old = f"ids-{task:06d}.part"
                if not files.there(folder, old):
                    continue  # a task that ran before has done it
                number, held, n = 0, [], 0

                def put() -> None:
                    head = MAGIC + np.array([before, len(held)], "<i8").tobytes() + table
                    files.put(folder, f"ids-{task:06d}-{number:05d}.lmtok", [head, *held])

                with files.reading(folder, old) as file:
                    for size, block in _blocks(_parts(file, kind), rank):
                        if held and sum(map(len, held)) + len(block) > file_bytes:
                            put()
                            number, held, before, n = number + 1, [], before + n, 0
                        held.append(block)
                        n += size
                if held:
                    put()
                files.remove(folder, old)
            yield batch

    return run


def read_file(data) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(doc_id, ids in all documents before it, its ids) of each document of one file, in order."""
    if bytes(data[:8]) != MAGIC:
        raise ValueError("not a file of token ids")
    start, blocks = (int(x) for x in np.frombuffer(data, "<i8", 2, 8))
    n = int(np.frombuffer(data, "<u4", 1, 24)[0])
    order, at = np.frombuffer(data, "<u4", n, 28), 28 + 4 * n
    for _ in range(blocks):
        docs, ids, controls, size = (int(x) for x in np.frombuffer(data, "<i8", 4, at))
        at += 32
        doc, null, sizes = np.frombuffer(data, "<i8", docs, at), np.frombuffer(data, np.uint8, docs, at + 8 * docs), np.frombuffer(data, "<i8", docs, at + 9 * docs)
        at += 17 * docs
        got = order[decode_ranks(np.frombuffer(data, np.uint8, controls, at), np.frombuffer(data, np.uint8, size, at + controls), ids)]
        at += controls + size
        low = 0
        for d, missing, k in zip(doc.tolist(), null.tolist(), sizes.tolist()):
            yield None if missing else d, start + low, got[low : low + k]
            low += k
        start += low


def write_tokens(documents: DataFrame, path: Callable[[], str], end: int = 2, special_as_text: bool = False, folder: str | None = None, file_bytes: int = 32 << 20) -> str:
    """Write the ids of all rows of ``documents`` (doc_id, text) and return the folder.

    path: called on the workers, gives the place of the tokenizer's file there. Null doc_ids come first.
    special_as_text: whether the tokenizer's special tokens, written out in a text, are ordinary text.
    file_bytes: files end before the block that would make them larger; one document alone may be larger.
    """
    spark = documents.sparkSession
    prepare_workers(spark)
    folder = folder or shared_folder(spark, "tokens")
    files.make_folder(folder)
    text = F.col("text").cast("string")
    docs = documents.select(F.col("doc_id").cast("long"), text.alias("text"))
    keys = [F.col("doc_id").asc_nulls_first(), F.xxhash64(F.coalesce("text", F.lit("")))]
    dealt = docs.repartitionByRange(shuffle_partitions(spark), *keys).sortWithinPartitions(*keys)
    tasks = materialise(dealt.mapInArrow(lean(_provisional(folder, path, end, special_as_text)), "task int, n long, ids binary, counts binary"), "token-counts")
    counts = tasks.select("ids", "counts").mapInArrow(_counts, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    ids = np.array([r.id for r in sorted(counts, key=lambda r: (-r.n, r.id))], np.int64)  # the vocabulary at most
    # a row for each file: how many ids are before it
    before = F.coalesce(F.sum("n").over(W.orderBy("task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = tasks.select("task", before.alias("before"))
    starts = starts.repartition(shuffle_partitions(spark), "task")
    kind = np.dtype("<u2" if int(ids.max(initial=0)) < 1 << 16 and _small(path) else "<u4")
    materialise(starts.mapInArrow(lean(_recode(folder, kind, spark.sparkContext.broadcast(ids), file_bytes)), "task int, before long"), "token-files")
    return folder


def _small(path: Callable[[], str]) -> bool:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path()).get_vocab_size(with_added_tokens=True) <= 1 << 16


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column(0):
            rows = [(d, s, len(x), zlib.crc32(x.astype("<u4").tobytes())) for d, s, x in read_file(content.as_buffer())]
            columns = zip(*rows) if rows else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_digests(spark, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the folder's files."""
    prepare_workers(spark)
    content = spark.read.format("binaryFile").option("pathGlobFilter", "*.lmtok").load(folder).select("content")
    return content.mapInArrow(lean(_digests), "doc_id long, start long, n_tokens long, ids_crc32 long")


def byte_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def query(spark, sf_dir: str) -> DataFrame:
    """op2: what the files of all documents hold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_digests(spark, write_tokens(docs, byte_bpe))
