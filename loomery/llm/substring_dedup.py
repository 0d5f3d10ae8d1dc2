"""Substring deduplication by super-k-mer partitioning.

A window is ``k`` consecutive words of one document. Every window's minimiser is the smallest hash among its
``m``-word sequences; consecutive windows that share it form a super-k-mer, which travels as one packed string
to the bucket its minimiser names. There the strings are cut into windows again and sorted, so that all
occurrences of a window meet and all but the first are marked. A word that a marked window covers is removed.

The order of occurrences is (doc_id, start), a null doc_id first. Rows that share a doc_id count as one
document (a 32-bit print of the text tells them apart when ranges go back to rows): occurrences at the same start of such rows are equally early, and neither is removed on account of
the other. Null or empty texts, and those with fewer than ``k`` words, keep all their words.

Skew. Identical super-k-mers are merged in each batch before the shuffle: all but the first are marked at once
and travel as three numbers, to a bucket that their document's number names. A minimiser that many documents share would still draw the differing strings
around it into one bucket, so minimisers found often in a sample are split: their windows travel one by one to
the bucket that the whole window's hash names. The sample grows with the input, so that what isn't split is in about ``most_docs`` documents
at most, and neither buckets (of 4 MB of input each) nor what one minimiser draws into them grow with it. The sample only decides how rows are dealt, never the result.

Repeated rows are documents of their own; an empty table gives an empty one; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery.llm import textkernel as tk
from loomery.llm.storage import buckets_for, prepare_workers

FIRST = -(1 << 63)
#: Per super-k-mer: document, print of its text, first word, windows, bytes of the string (0: known to be repeated).
META = ("<i8", "<i4", "<i4", "<i4", "<i4")
_HASHERS: list[tk.Hasher] = []


def _hashers() -> list[tk.Hasher]:
    if not _HASHERS:
        _HASHERS.extend([tk.Hasher(11), tk.Hasher(22)])
    return _HASHERS


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values, by doubling."""
    span, out = 1, x
    while span * 2 <= w:
        out = np.minimum(out[: len(out) - span], out[span:])
        span *= 2
    rest = w - span
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def super_kmers(h: np.ndarray, first: np.ndarray, k: int, m: int, hot: np.ndarray) -> tuple[np.ndarray, ...]:
    """Document, first word in it, number of windows, and bucket hash of each super-k-mer. ``hot`` is in order."""
    count = np.maximum(np.diff(first) - k + 1, 0)
    if not count.sum():
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64)
    raw = np.zeros(len(h) - m + 1, np.uint64)
    for j, x in enumerate(tk.numbers(5, m) | np.uint64(1)):
        raw += h[j : len(h) - m + 1 + j] * x
    at = tk.positions(first[:-1], count)
    least = sliding_min(tk.mix(raw), k - m + 1)[at]
    doc = np.repeat(np.arange(len(count)), count)
    new = np.ones(len(at), bool)
    new[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
    if len(hot):
        split = hot[np.minimum(np.searchsorted(hot, least), len(hot) - 1)] == least
        if split.any():
            new |= split
            new[1:] |= split[:-1]
            whole, _ = tk.ngrams(h, first, k)
            least = np.where(split, whole, least)
    begin = np.flatnonzero(new)
    return doc[begin], at[begin] - first[doc[begin]], np.diff(np.append(begin, len(at))), least[begin]


def _pack(k: int, m: int, buckets: int, hot: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            prints = batch.column(1).to_numpy(zero_copy_only=False)
            buf, offsets = tk.text_buffer(batch.column(2))
            parts = []
            for i, j in tk.steps(offsets):
                low, high = offsets[i], offsets[j]
                starts, ends, first = tk.words(buf[low:high], offsets[i : j + 1] - low)
                one, two = (x(buf[low:high], starts, ends) for x in _hashers())
                doc, start, n, key = super_kmers(one, first, k, m, hot)
                if not len(doc):
                    continue
                a = first[doc] + start
                z = a + n + k - 2
                spans = [_span_hash(x, a, z + 1) for x in (one, two)]
                parts.append((ids[i + doc], prints[i + doc], start, n, key, *spans, starts[a] + low, ends[z] + low))
            if not parts:
                continue
            doc, prnt, start, n, key, s1, s2, low, high = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((prnt, start, doc, s2, s1))
            doc, prnt, start, n, key, s1, s2, low, high = (x[order] for x in (doc, prnt, start, n, key, s1, s2, low, high))
            lead = np.ones(len(doc), bool)
            lead[1:] = (s1[1:] != s1[:-1]) | (s2[1:] != s2[:-1])
            group = np.maximum.accumulate(np.where(lead, np.arange(len(doc)), 0))
            early = (doc == doc[group]) & (start == start[group])
            twice = np.zeros(len(doc), bool)
            twice[1:] = ~lead[1:] & early[1:] & early[:-1] & (prnt[1:] == prnt[:-1])
            keep = np.flatnonzero(~twice)
            # what is known to be repeated needs no one to meet, and goes where its document's number says
            home = np.where(early[keep], key[keep], tk.mix(doc[keep].astype(np.int64).view(np.uint64)))
            bucket = (home % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((start[keep], doc[keep], bucket))  # small steps between ids pack well
            keep, bucket = keep[order], bucket[order]
            cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
            raw, out = buf.tobytes(), []
            for p, q in zip(cuts, np.append(cuts[1:], len(bucket))):
                x = keep[p:q]
                sent = x[early[x]]
                text = b"".join([raw[u:v] for u, v in zip(low[sent].tolist(), high[sent].tolist())])
                head = np.array([len(x)], "<i8").tobytes()
                meta = [np.diff(doc[x], prepend=0).astype("<i8"), prnt[x], start[x], n[x], np.where(early[x], high[x] - low[x], 0)]
                out.append(squeeze.compress(head + b"".join(y.astype(kind).tobytes() for y, kind in zip(meta, META)) + text))
            yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts].astype(np.int32)), pa.array(out, pa.binary())], ["bucket", "packed"])

    return run


def _span_hash(h: np.ndarray, a: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Hash of the words a..z-1 of each span, by prefix sums of a polynomial."""
    base, n = 0x9FB21C651E98DF25, len(h)
    up = np.full(n + 1, base, np.uint64)
    down = np.full(n + 1, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    np.multiply.accumulate(up, out=up)
    np.multiply.accumulate(down, out=down)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(h * up[:n], out=sums[1:])
    return tk.mix((sums[z] - sums[a]) * down[a] + (z - a).astype(np.uint64))


def _mark(k: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        expand = zstandard.ZstdDecompressor()
        metas, texts = [], []
        for blob in table.column("packed"):
            data = expand.decompress(blob.as_buffer())
            n, at, cols = int(np.frombuffer(data, "<i8", 1)[0]), 8, []
            for kind in META:
                cols.append(np.frombuffer(data, kind, n, at))
                at += n * cols[-1].itemsize
            cols[0] = np.cumsum(cols[0])
            metas.append(cols)
            texts.append(data[at:])
        doc, prnt, start, n, size = (np.concatenate(x) for x in zip(*metas))
        marked = [(doc[size == 0], prnt[size == 0], start[size == 0].astype(np.int64), n[size == 0].astype(np.int64))]
        sent = np.flatnonzero(size > 0)
        sent_at = np.concatenate([[0], np.cumsum(size[sent], dtype=np.int64)])
        buf = np.frombuffer(b"".join(texts), np.uint8)
        grams: list[list[np.ndarray]] = [[], []]
        for i, j in tk.steps(sent_at):
            part = buf[sent_at[i] : sent_at[j]]
            starts, ends, first = tk.words(part, sent_at[i : j + 1] - sent_at[i])
            for got, x in zip(grams, _hashers()):
                got.append(tk.ngrams(x(part, starts, ends), first, k)[0])
        if len(sent):
            one, two = (np.concatenate(x) for x in grams)
            row = np.repeat(sent, n[sent])
            begin = tk.positions(start[sent].astype(np.int64), n[sent].astype(np.int64))
            d = doc[row]
            order = np.lexsort((begin, d, two, one))
            one, two, row, begin, d = one[order], two[order], row[order], begin[order], d[order]
            lead = np.ones(len(one), bool)
            lead[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
            group = np.maximum.accumulate(np.where(lead, np.arange(len(one)), 0))
            late = (d != d[group]) | (begin != begin[group])
            marked.append((d[late], prnt[row[late]], begin[late], np.ones(int(late.sum()), np.int64)))
        d, p, s, n = (np.concatenate(x) for x in zip(*marked))
        return merged_runs(d, p, s, s + n - 1 + k)

    return run


def merged_runs(d: np.ndarray, p: np.ndarray, s: np.ndarray, e: np.ndarray) -> pa.Table:
    """One row per document: its word ranges [s, e), merged, as pairs of 32-bit integers."""
    schema = pa.schema([("id", pa.int64()), ("print", pa.int32()), ("ranges", pa.binary())])
    if not len(d):
        return schema.empty_table()
    order = np.lexsort((e, s, p, d))
    d, p, s, e = d[order], p[order], s[order], e[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (p[1:] != p[:-1])
    shift = np.cumsum(new) * (int(e.max()) + 1)  # later documents lie beyond all ranges of earlier ones
    reach = np.maximum.accumulate(e + shift)
    cut = np.ones(len(d), bool)
    cut[1:] = new[1:] | ((s + shift)[1:] > reach[:-1])
    at = np.flatnonzero(cut)
    pairs = np.column_stack([s[at], (reach - shift)[np.append(at[1:], len(d)) - 1]]).astype("<i4")
    owner = np.flatnonzero(new)
    bounds = np.searchsorted(at, np.append(owner, len(d)))
    return pa.Table.from_arrays([pa.array(d[owner]), pa.array(p[owner].astype(np.int32)), pa.array([pairs[x:y].tobytes() for x, y in zip(bounds[:-1], bounds[1:])], pa.binary())], schema=schema)


def _hot(k: int, m: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = tk.text_buffer(batch.column(0))
            for i, j in tk.steps(offsets):
                part = buf[offsets[i] : offsets[j]]
                starts, ends, first = tk.words(part, offsets[i : j + 1] - offsets[i])
                doc, _, _, key = super_kmers(_hashers()[0](part, starts, ends), first, k, m, np.zeros(0, np.uint64))
                pairs = np.unique(np.column_stack([key, doc.astype(np.uint64)]), axis=0) if len(key) else np.zeros((0, 2), np.uint64)
                keys, n = np.unique(pairs[:, 0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys[n > 1].view(np.int64)), pa.array(n[n > 1])], ["key", "n"])

    return run


def sampling(total: int, rows: int, share: float, most_docs: int, seen: int = 20) -> tuple[int, int]:
    """How many of ``total`` documents to sample, and in how many of these a minimiser is split: ``rows`` and ``share`` of them, or,
    where that would leave minimisers of more than ``most_docs`` documents whole, so many that these are seen ``seen`` times."""
    if share * total <= most_docs:
        return rows, max(seen, int(share * min(total, rows)))
    return max(rows, -(-seen * total // most_docs)), seen


def hot_minimisers(docs: DataFrame, k: int, m: int, rows: int, share: float, most_docs: int) -> np.ndarray:
    """Minimisers that occur in more than ``share`` of the documents, or in more than ``most_docs``, as far as a sample tells; in order.

    They are a 20th of the sample's minimisers at most, and a sample has ``rows`` or a 20 / ``most_docs`` of all documents: one in 15,000 by default.
    """
    total = docs.count()
    if not total:
        return np.zeros(0, np.uint64)
    rows, least = sampling(total, rows, share, most_docs)
    part = docs.select("text").sample(min(1.0, rows / total), seed=9)
    seen = part.mapInArrow(_hot(k, m), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    return np.sort(np.array([r.key for r in seen.filter(F.col("n") > least).collect()], np.int64).view(np.uint64))


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, gone, texts = [], [], []
        for text, lists in zip(batch.column(1), batch.column(2)):
            words = (text.as_py() or "").encode().split()
            pairs = [np.frombuffer(x, "<i4") for x in lists.as_py() or ()]
            counts.append(len(words))
            if pairs:
                cover = np.zeros(len(words) + 1, np.int64)
                ends = np.concatenate(pairs).reshape(-1, 2)
                np.add.at(cover, ends[:, 0], 1)
                np.add.at(cover, ends[:, 1], -1)
                kept = np.flatnonzero(np.cumsum(cover[:-1]) == 0)
                words = [words[i] for i in kept.tolist()]
            gone.append(counts[-1] - len(words))
            texts.append(b" ".join(words).decode())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(texts, pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])


def dedup_substrings(documents: DataFrame, k: int = 20, m: int = 5, sample_rows: int = 4000, hot_share: float = 0.005, most_docs: int = 300_000) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text) of each row of ``documents`` (doc_id, text).

    ``kept_text`` has the words that stay, joined by one space.
    """
    spark = documents.sparkSession
    prepare_workers(spark)
    docs = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    hot = hot_minimisers(docs, k, m, sample_rows, hot_share, most_docs)
    print_of = F.hash(F.coalesce("text", F.lit("")))
    sent = docs.select(F.coalesce("doc_id", F.lit(FIRST)).alias("id"), print_of.alias("print"), "text")
    packed = sent.mapInArrow(_pack(k, m, buckets_for(documents), hot), "bucket int, packed binary")
    marks = packed.groupBy("bucket").applyInArrow(_mark(k), "id long, print int, ranges binary")
    marks = marks.groupBy("id", "print").agg(F.collect_list("ranges").alias("ranges"))
    both = docs.join(marks, (F.coalesce(docs.doc_id, F.lit(FIRST)) == marks.id) & (print_of == marks["print"]), "left")
    return both.select("doc_id", "text", "ranges").mapInArrow(_apply, "doc_id long, n_words long, n_removed long, kept_text string")


def query(spark, sf_dir: str) -> DataFrame:
    """op9: the digest of what stays of every document."""
    out = dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
