"""Removal of repeated byte strings, found by suffixes of a collection that is built column by column.

A window is ``w`` bytes of one document. Every window's anchor is the k-byte sequence with the least hash in it (the
first of equals); consecutive windows with the same anchor form a piece. Equal windows have equal anchors at equal
places, so pieces meet by their anchor's hash, lined up at their anchors, and equal windows begin in one column.

The pieces of a bucket are a collection whose suffixes are put in order from the last column to the first. Each round
inserts one symbol of every piece: suffixes that begin in this column are those of the column before, sorted by the
new symbol and else in the order they had, and their common prefixes follow from the least common prefix between two
suffixes in the old order. The symbols in that order are the collection's Burrows-Wheeler transform, a column at a
time. A suffix that has ``w`` symbols in common with the one before or after it is a window that is there twice.

A bucket's pieces are read and cut up in turn into collections of bounded size, by further bits of the anchor's hash.

Windows don't cross rows. Rows are told apart by doc_id and a 32-bit print of the text when ranges go back to them;
rows that agree in both are equal, hence each other's copies, and lose all that a window covers. A null doc_id is an
id like others. A null text is empty; texts of under ``w`` bytes stay whole. Very long texts are cut into pieces a
megabyte at a time. Other columns aren't looked at. An empty table gives an empty result.

Skew. Equal pieces of a batch are repeated whatever other tasks hold: one of them is sent, and the ranges of all go
to the bucket of their document. Sequences that many sampled documents have as anchors come last in the order, so
that other anchors are taken where there are any; the sample only decides how windows are dealt.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery.llm import textkernel as tk
from loomery.llm.storage import buckets_for, lean, prepare_workers
from loomery.llm.substring_dedup import FIRST, merged_runs, sliding_min

#: Per piece: document, print of its text, first window, windows, place of the anchor in the first window.
META = ("<i8", "<i4", "<i4", "<i4", "<i4")
PACKED = pa.schema([("bucket", pa.int32()), ("packed", pa.binary()), ("id", pa.int64()), ("print", pa.int32()), ("ranges", pa.binary())])
#: Low bits of an anchor's rank: its place in what is looked at together.
PLACE = np.uint64(28)
_HASHERS: list[tk.Hasher] = []


def _hashers() -> list[tk.Hasher]:
    if not _HASHERS:
        _HASHERS.extend([tk.Hasher(31), tk.Hasher(32), tk.Hasher(33)])
    return _HASHERS


def segments(offsets: np.ndarray, w: int, step: int = tk.STEP) -> Iterator[tuple[int, np.ndarray, int]]:
    """First document, byte offsets of documents, and place in the first: about a megabyte at a time, whole windows only."""
    for i, j in tk.steps(offsets, step):
        low, high = int(offsets[i]), int(offsets[j])
        if j - i > 1 or high - low <= 2 * step:
            yield i, offsets[i : j + 1], 0
            continue
        for at in range(0, max(high - low - w + 1, 1), step):
            yield i, np.array([low + at, min(low + at + step + w - 1, high)]), at


def pieces(part: np.ndarray, bounds: np.ndarray, w: int, k: int, last: np.ndarray) -> tuple[np.ndarray, ...]:
    """Document, first byte in ``part``, number of windows, place of the anchor, and anchor's hash of each piece."""
    count = np.maximum(np.diff(bounds) - w + 1, 0)
    if not count.sum():
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.astype(np.uint64)
    begins = np.arange(len(part) - k + 1)
    g = _hashers()[0](part, begins, begins + k)
    rank = ((g >> (PLACE + np.uint64(1))) << PLACE) | begins.astype(np.uint64)
    if len(last):
        few = np.zeros(1 << 16, bool)
        few[(last & np.uint64(0xFFFF)).astype(np.int64)] = True
        maybe = np.flatnonzero(few[(g & np.uint64(0xFFFF)).astype(np.int64)])
        rank[maybe[np.isin(g[maybe], last)]] |= np.uint64(1 << 63)
    at = tk.positions(bounds[:-1], count)
    anchor = (sliding_min(rank, w - k + 1)[at] & np.uint64((1 << 28) - 1)).astype(np.int64)
    doc = np.repeat(np.arange(len(count)), count)
    new = np.ones(len(at), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    begin = np.flatnonzero(new)
    return doc[begin], at[begin], np.diff(np.append(begin, len(at))), anchor[begin] - at[begin], g[anchor[begin]]


def _pack(w: int, k: int, buckets: int, last: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            prints = batch.column(1).to_numpy(zero_copy_only=False)
            buf, offsets = tk.text_buffer(batch.column(2))
            parts = []
            for i, bounds, shift in segments(offsets, w):
                low = int(bounds[0])
                part = buf[low : int(bounds[-1])]
                doc, at, n, place, key = pieces(part, bounds - low, w, k, last)
                if len(doc):
                    spans = [h(part, at, at + n + w - 1) for h in _hashers()[1:]]
                    parts.append((i + doc, at + low - bounds[doc] + shift, n, place, key, *spans, at + low))
            if not parts:
                continue
            doc, start, n, place, key, s1, s2, low = (np.concatenate(x) for x in zip(*parts))
            parts.clear()
            order = np.lexsort((s2, s1))
            lead = np.ones(len(order), bool)
            lead[1:] = (s1[order[1:]] != s1[order[:-1]]) | (s2[order[1:]] != s2[order[:-1]])
            more = np.zeros(len(order), bool)  # of a group of several
            more[:-1] |= ~lead[1:]
            more[1:] |= ~lead[1:]
            known = order[more]
            if len(known):
                found = merged_runs(ids[doc[known]], prints[doc[known]], start[known], start[known] + n[known] + w - 1)
                home = (tk.mix(np.asarray(found.column("id")).view(np.uint64)) % np.uint64(buckets)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(home), pa.nulls(len(home), pa.binary()), *(c.combine_chunks() for c in found.columns)], schema=PACKED)
            sent = order[lead]
            bucket = (tk.mix(key[sent]) % np.uint64(buckets)).astype(np.int64)
            by = np.lexsort((start[sent], doc[sent], bucket))
            sent, bucket = sent[by], bucket[by]
            cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
            raw, out = memoryview(buf), []
            for p, q in zip(cuts, np.append(cuts[1:], len(bucket))):
                x = sent[p:q]
                text = b"".join([raw[u:v] for u, v in zip(low[x].tolist(), (low[x] + n[x] + w - 1).tolist())])
                meta = [np.diff(ids[doc[x]], prepend=0), prints[doc[x]], start[x], n[x], place[x]]
                out.append(squeeze.compress(np.array([len(x)], "<i8").tobytes() + b"".join(y.astype(kind).tobytes() for y, kind in zip(meta, META)) + text))
            none = pa.nulls(len(cuts), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts].astype(np.int32)), pa.array(out, pa.binary()), none, none.cast(pa.int32()), pa.nulls(len(cuts), pa.binary())], schema=PACKED)

    return lean(run)


def suffix_rounds(columns: np.ndarray, left: np.ndarray, right: np.ndarray, w: int, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(column, documents in the order of their suffixes from there on, their symbols, common prefixes with the one before).

    ``columns[c, i]`` is document i's symbol in column c, if left[i] <= c <= right[i]. The symbols are what the round
    inserts into the collection's transform. Common prefixes are counted up to ``w``. Only columns up to ``most`` are yielded.
    """
    order = np.zeros(0, np.int64)
    common = np.zeros(0, np.uint8 if w < 256 else np.int32)
    coming = np.argsort(right, kind="stable")
    arrive = np.searchsorted(right[coming], np.arange(len(columns) + 1))
    for c in range(len(columns) - 1, -1, -1):
        gone = left[order] > c
        if gone.any():
            stay = np.flatnonzero(~gone)
            common = np.minimum.reduceat(common[: stay[-1] + 1], np.append(0, stay[:-1] + 1)) if len(stay) else common[:0]
            order = order[stay]
        new = coming[arrive[c] : arrive[c + 1]]
        if len(new):
            order = np.concatenate([new, order])
            common = np.concatenate([np.zeros(len(new), common.dtype), common])
            common[len(new) : len(new) + 1] = 0
        if not len(order):
            continue
        symbols = columns[c][order]
        moved = np.argsort(symbols, kind="stable")
        order, symbols = order[moved], symbols[moved]
        same = np.flatnonzero(symbols[1:] == symbols[:-1]) + 1
        between = np.column_stack([moved[same - 1] + 1, moved[same] + 1]).ravel()
        old, common = np.append(common, common[:1]), np.zeros(len(order), common.dtype)
        if len(same):
            common[same] = np.minimum(np.minimum.reduceat(old, between)[::2], w - 1) + 1
        if c <= most:
            yield c, order, symbols, common


def repeated_windows(text: np.ndarray, at: np.ndarray, n: np.ndarray, place: np.ndarray, w: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Piece, first and last window (from the piece's first) of all runs of windows that are there twice."""
    reach = w - k
    left = reach - place
    size = n + w - 1
    columns = np.zeros((len(at), reach + w), np.uint8)
    columns.ravel()[tk.positions(np.arange(len(at)) * (reach + w) + left, size)] = text[tk.positions(at, size)]
    columns = np.ascontiguousarray(columns.T)
    twice = np.zeros((reach + 2, len(at)), bool)
    for c, order, _, common in suffix_rounds(columns, left, left + size - 1, w, reach):
        hit = np.append(common >= w, False)
        twice[c, order[hit[:-1] | hit[1:]]] = True
    edge = np.diff(twice.T.astype(np.int8), axis=1, prepend=0)
    piece, low = np.nonzero(edge == 1)
    _, high = np.nonzero(edge == -1)
    return piece, low - left[piece], high - 1 - left[piece]


def _mark(w: int, k: int, most: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        expand = zstandard.ZstdDecompressor()
        metas, texts = [], []
        known = table.filter(pa.compute.is_valid(table.column("ranges"))).select(["id", "print", "ranges"])
        for blob in table.column("packed"):
            if not blob.is_valid:
                continue
            data = expand.decompress(blob.as_buffer())
            n, at, cols = int(np.frombuffer(data, "<i8", 1)[0]), 8, []
            for kind in META:
                cols.append(np.frombuffer(data, kind, n, at))
                at += n * cols[-1].itemsize
            cols[0] = np.cumsum(cols[0])
            body = np.frombuffer(data, np.uint8, -1, at)
            begin = np.concatenate([[0], np.cumsum(cols[3] + w - 1)[:-1]])
            anchors = np.ascontiguousarray(body[(begin + cols[4])[:, None] + np.arange(k)])
            metas.append([*cols, begin, _hash_rows(anchors)])
            texts.append(body)
        if not metas:
            return known
        shift = np.cumsum([0, *map(len, texts)])
        doc, prnt, start, n, place, at, key = (np.concatenate(x) for x in zip(*metas))
        at = at + np.repeat(shift[:-1], [len(x[0]) for x in metas])
        text = np.concatenate(texts)
        texts.clear()
        _, which, times = np.unique(key, return_inverse=True, return_counts=True)
        several = np.flatnonzero(times[which] > 1)  # a window that is there twice has its anchor twice
        turns = max(1, -(-len(several) // most))
        turn = key[several] % np.uint64(turns)
        found = []
        for t in range(turns):
            x = several[turn == t]
            if not len(x):
                continue
            piece, low, high = repeated_windows(text, at[x], n[x].astype(np.int64), place[x].astype(np.int64), w, k)
            x = x[piece]
            found.append((doc[x], prnt[x], start[x] + low, start[x] + high + w))
        if not found:
            return known
        return pa.concat_tables([known, merged_runs(*(np.concatenate(x) for x in zip(*found)))])

    return run


def _hash_rows(rows: np.ndarray) -> np.ndarray:
    """A hash of each row of bytes."""
    h = np.zeros(len(rows), np.uint64)
    full = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    full[:, : rows.shape[1]] = rows
    for column in full.view("<u8").T:
        h = tk.mix(h * np.uint64(0x9FB21C651E98DF25) + column + np.uint64(1))
    return h


def _anchors(w: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = tk.text_buffer(batch.column(0))
            for i, bounds, _ in segments(offsets, w):
                doc, _, _, _, key = pieces(buf[int(bounds[0]) : int(bounds[-1])], bounds - bounds[0], w, k, np.zeros(0, np.uint64))
                pairs = np.unique(np.column_stack([key, doc.astype(np.uint64)]), axis=0) if len(key) else np.zeros((0, 2), np.uint64)
                keys, n = np.unique(pairs[:, 0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys[n > 1].view(np.int64)), pa.array(n[n > 1])], ["key", "n"])

    return lean(run)


def frequent_anchors(docs: DataFrame, w: int, k: int, rows: int, share: float) -> np.ndarray:
    """Anchors of more than ``share`` of about ``rows`` sampled documents: w/share at most, as one has w anchors for each w bytes."""
    total = docs.count()
    if not total:
        return np.zeros(0, np.uint64)
    seen = docs.select("text").sample(min(1.0, rows / total), seed=9).mapInArrow(_anchors(w, k), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    least = max(20, int(share * min(total, rows)))
    return np.array([r.key for r in seen.filter(F.col("n") > least).collect()], np.int64).view(np.uint64)


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size, gone, spans, kept = [], [], [], []
        for text, lists in zip(batch.column(1), batch.column(2)):
            data = text.as_buffer().to_pybytes() if text.is_valid else b""
            pairs = sorted(tuple(x) for y in lists.as_py() or () for x in np.frombuffer(y, "<i4").reshape(-1, 2).tolist())
            parts, end, n, rest = [], 0, 0, 0
            for low, high in pairs:
                if low > end or not n:  # apart from what is gone so far
                    parts.append(data[end:low])
                    n, end = n + 1, high
                else:
                    end = max(end, high)
            parts.append(data[end:])
            rest = sum(map(len, parts))
            size.append(len(data))
            gone.append(len(data) - rest)
            spans.append(n)
            kept.append(b"".join(parts))
        counts = (pa.array(x, pa.int64()) for x in (size, gone, spans))
        yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def dedup_suffixes(documents: DataFrame, w: int = 200, k: int = 16, sample_rows: int = 4000, share: float = 0.005, most_pieces: int = 100_000) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) of each row of ``documents`` (doc_id, text).

    Removed is each byte that a string of ``w`` bytes covers which also begins anywhere else; ``n_spans`` are the
    longest runs of such bytes, ``kept`` the other bytes. ``most_pieces`` bounds a task's collection.
    """
    spark = documents.sparkSession
    prepare_workers(spark)
    docs = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    last = frequent_anchors(docs, w, k, sample_rows, share)
    print_of = F.hash(F.coalesce("text", F.lit("")))
    sent = docs.select(F.coalesce("doc_id", F.lit(FIRST)).alias("id"), print_of.alias("print"), "text")
    packed = sent.mapInArrow(_pack(w, k, buckets_for(documents), last), "bucket int, packed binary, id long, print int, ranges binary")
    marks = packed.groupBy("bucket").applyInArrow(_mark(w, k, most_pieces), "id long, print int, ranges binary")
    marks = marks.groupBy("id", "print").agg(F.collect_list("ranges").alias("ranges"))
    both = docs.join(marks, (F.coalesce(docs.doc_id, F.lit(FIRST)) == marks.id) & (print_of == marks["print"]), "left")
    return both.select("doc_id", "text", "ranges").mapInArrow(lean(_apply), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def query(spark, sf_dir: str) -> DataFrame:
    """op11: the digest of what stays of every document."""
    out = dedup_suffixes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
