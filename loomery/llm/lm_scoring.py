r"""Language-model scoring with a log-frequency Bloom filter.

Reading. A task cuts its documents into blocks of about ``FLUSH`` tokens. A block's distinct words and pairs, each with its count in
texts to learn from, go to the buckets that their hashes name, packed and once a block; so no word or pair travels once for each
of its occurrences, and none is hot. What each token is stays in a file of the block. Texts are read once, whatever their number.

Filter. A count c has level 1 + floor(log(c) / log(base)). A key of level q is inserted q times, as (key, 1) to
(key, q), so a count is read back by probing levels upwards until one is missing; errors only ever raise a level.
The filter holds all words, and pairs seen ``pair_least`` times or more, in one segment for each bucket, which has ``bits`` bits for
each insertion, however many there are. Exact counts of pairs end where a segment is made. ``fit`` keeps the segments and the sums
of contexts; while these are small they are broadcast, and the tasks that score, of these or other texts, probe them.

Model. p(w | v) = (a(v, w) + b(v) p(w)) / (s(v) + b(v)). a is a pair's decoded count less the discount, s(v) the sum of a over
the pairs of v in the filter, and b(v) what v's pairs have left: the discount of each pair in the filter, and all of each rarer one.
p(w) shares 1 - u among known words by their decoded counts, and u = (words seen once + 1) / (tokens + 2) is the
probability of the one class of unseen words, as in the base score. So the probabilities after any
context sum to one but for the filter's false finds. s and b are exact sums over decoded counts. Contexts are the word before, or the
start of the text; those whose hashes agree in the upper 32 bits share their pairs. Tokens are words with A-Z lower-cased, then one end.

Scoring. Buckets answer each block in the order of what it sent with exact counts of its words, which the base score needs; and,
if the filter is too large to be broadcast, with the levels of its words and pairs and the words' sums. The answers of all buckets
meet by block, where the block's file is read and its tokens are scored. Nothing else that grows with the
input reaches the driver or is broadcast. The answers are as many as buckets times blocks, so blocks are large.

Null texts count as empty: one token, the end. A null doc_id has the remainder of an empty text. Without training
tokens every word is unseen, u is 1/2, and so is the probability of every token. Rows are scored one by one, so repeated ones have equal rows each.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomery.llm import files
from loomery.llm import textkernel as tk
from loomery.llm.storage import buckets_for, materialise, prepare_workers, shuffle_partitions, temporary_folder

_U = np.uint64
END, START = (int(x) for x in tk.numbers(404, 2))
HASHES, FLUSH = 4, 1 << 20
_HASHERS: list[tk.Hasher] = []
_KEYS = [("bucket", pa.int32()), ("block", pa.int64()), ("words", pa.binary()), ("word_counts", pa.binary()), ("pairs", pa.binary()), ("pair_counts", pa.binary())]
_FIGURES = [("n_words", pa.int64()), ("n_tokens", pa.int64()), ("n_once", pa.int64()), ("n_value", pa.float64()), ("inserts", pa.int64())]
#: What travels between blocks and buckets.
_PACKED = [("kind", pa.int32()), ("bucket", pa.int32()), ("block", pa.int64()), ("k", pa.binary()), ("x", pa.binary()), ("y", pa.binary()), ("z", pa.binary())]
_VOCABULARY, _SUMS, _CELL, _REPLY, _SEGMENT = range(5)
_SCORES = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]


def _ddl(fields: list) -> str:
    return ", ".join(f"{name} {'long' if kind == pa.int64() else 'int' if kind == pa.int32() else 'double' if kind == pa.float64() else 'binary'}" for name, kind in fields)


def _batch(fields: list, rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, (_, kind) in zip(columns, fields)], schema=pa.schema(fields))


def remainder(doc_id: Column, divisor: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(divisor))


def tokens(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, and each document's number of them."""
    if not _HASHERS:
        _HASHERS.append(tk.Hasher(44, lower=True))
    starts, ends, first = tk.words(buf, offsets)
    h = np.insert(_HASHERS[0](buf, starts, ends), first[1:], _U(END))
    return h, np.diff(first) + 1


def before(of: np.ndarray, sizes: np.ndarray, start) -> np.ndarray:
    """What stands before each token of documents of these sizes; start: before the first ones."""
    out = np.empty_like(of)
    out[1:] = of[:-1]
    out[np.cumsum(sizes) - sizes] = start
    return out


def pair_keys(past: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The upper halves of both hashes; so a context's pairs are neighbours when sorted."""
    return (past & _U(0xFFFFFFFF00000000)) | (h >> _U(32))


def word_bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    """By the upper half, so that a word is where its sums as a context are."""
    return tk.mix(h >> _U(32)) % _U(buckets)


def pair_bucket(pairs: np.ndarray, buckets: int) -> np.ndarray:
    return tk.mix(pairs) % _U(buckets)


def in_buckets(pairs: np.ndarray, buckets: int) -> np.ndarray:
    """Keys that stand for pairs one to one, and whose order is that of the pairs' buckets (a power of two of them)."""
    b = _U(buckets.bit_length() - 1)
    m = tk.mix(pairs)
    return (m >> b) | (m << (_U(64) - b))


def out_of_buckets(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The pairs that such keys stand for."""
    b = _U(buckets.bit_length() - 1)
    h = (keys << b) | (keys >> (_U(64) - b))
    h = (h ^ (h >> _U(31)) ^ (h >> _U(62))) * _U(pow(0x94D049BB133111EB, -1, 1 << 64))
    h = (h ^ (h >> _U(27)) ^ (h >> _U(54))) * _U(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
    return h ^ (h >> _U(30)) ^ (h >> _U(60))


def _dealt(keys: np.ndarray, place: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The order that puts keys into their buckets' order, and where each bucket begins in it."""
    order = np.argsort(place, kind="stable")
    return order, np.searchsorted(place[order], np.arange(buckets + 1, dtype=_U))


def _sums(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    if not len(keys):
        return keys, *values
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[at], *(np.add.reduceat(x[order], at) for x in values)


def _store(folder: str, block: int, content: tuple) -> None:
    raw = pickle.dumps(content, 5)
    files.put(folder, str(block), [len(raw).to_bytes(8, "little"), pa.compress(raw, codec="zstd", asbytes=True)])


def _stored(folder: str, block: int) -> tuple:
    with files.reading(folder, str(block)) as f:
        raw = f.read()
    return pickle.loads(pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), codec="zstd", asbytes=True))


def _cut(buckets: int, folder: str):
    """Blocks of documents: a file of each, and its distinct words and pairs with their counts in texts to learn from."""

    def flush(block: int, held: list) -> pa.RecordBatch:
        ids, null, sizes, train, h = (np.concatenate(x) for x in zip(*held))
        held.clear()  # memory matters here
        learn = np.repeat(train, sizes)
        words, now, n = np.unique(h, return_inverse=True, return_counts=True)
        often = np.argsort(-n)  # small numbers for frequent words: the file shrinks
        rank = np.empty(len(words), np.uint32)
        rank[often] = np.arange(len(words))
        now, words = rank[now], np.append(words[often], _U(START))
        _store(folder, block, (ids, null, sizes, words, np.ascontiguousarray(now.view(np.uint8).reshape(-1, 4).T)))
        n = np.bincount(now, learn, len(words)).astype("<u4")
        order, word_at = _dealt(words, word_bucket(words, buckets), buckets)
        pairs, back = np.unique(in_buckets(pair_keys(before(h, sizes, _U(START)), h), buckets), return_inverse=True)
        m = np.bincount(back, learn, len(pairs)).astype("<u4")
        pair_at = np.append(np.searchsorted(pairs, np.arange(buckets, dtype=_U) << _U(65 - buckets.bit_length())), len(pairs))
        parts = [(words[order], word_at), (n[order], word_at), (pairs, pair_at), (m, pair_at)]
        some = np.flatnonzero(np.diff(word_at) + np.diff(pair_at))
        return _batch(_KEYS, [(b, block, *(x[at[b] : at[b + 1]].tobytes() for x, at in parts)) for b in some.tolist()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, held, n = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            docs, train = batch.column(0), batch.column(2).to_numpy(zero_copy_only=False)
            ids, null = docs.fill_null(0).to_numpy().copy(), docs.is_null().to_numpy(zero_copy_only=False)
            buf, offsets = tk.text_buffer(batch.column(1))
            for i, j in tk.steps(offsets):
                h, sizes = tokens(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                held.append((ids[i:j], null[i:j], sizes, train[i:j], h))
                n += len(h)
                if n >= FLUSH:
                    yield flush(block, held)
                    block, n = block + 1, 0
        if held:
            yield flush(block, held)

    return run


def levels_of(counts: np.ndarray, base: float) -> np.ndarray:
    return (1 + np.floor(np.log(np.maximum(counts, 1)) / np.log(base) + 1e-9)).astype(np.int64) * (counts >= 1)


def level_values(base: float, most: int = 120) -> np.ndarray:
    """The middle of the whole numbers of each level; 0 for level 0."""
    q = np.arange(most)
    low, high = np.ceil(base ** (q - 1) - 1e-9), np.ceil(base**q - 1e-9) - 1
    return np.where(q > 0, (low + np.maximum(high, low)) / 2, 0.0)


def _merge(buckets: int, pair_least: int, discount: float, base: float, bits: float):
    """One bucket's words with counts and levels, sums of its pairs' contexts, and for each block its words' places and its pairs' levels."""
    fields, value = [*_PACKED, *_FIGURES], level_values(base)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        def merged(name: str) -> tuple[np.ndarray, ...]:
            keys = [np.frombuffer(x.as_buffer(), "<u8") for x in table.column(name + "s")]
            counts = [np.frombuffer(x.as_buffer(), "<u4") for x in table.column(name + "_counts")]
            distinct, back = np.unique(np.concatenate(keys), return_inverse=True)
            return distinct, np.bincount(back, np.concatenate(counts), len(distinct)).astype(np.int64), back, np.cumsum([0, *map(len, keys)]).tolist()

        bucket = key[0].as_py()
        words, n, word_back, word_at = merged("word")
        pairs, m, pair_back, pair_at = merged("pair")
        pairs = out_of_buckets(pairs, buckets)
        word_level, pair_level = levels_of(n, base), np.where(m >= pair_least, levels_of(m, base), 0)
        inserts = int(word_level.sum() + pair_level.sum())
        segment = Filter([np.zeros((int(bits * inserts) >> 3) + 8, np.uint8)])
        set_bits(segment.data, words, word_level)
        set_bits(segment.data, pairs, pair_level)
        exact = value[pair_level]
        gain, rest = np.maximum(exact - discount, 0), np.where(pair_level > 0, np.minimum(exact, discount), m)
        contexts, gain, rest = _sums(*(x[m > 0] for x in (pairs & _U(0xFFFFFFFF00000000), gain, rest)))
        figures = [int((n > 0).sum()), int(n.sum()), int((n == 1).sum()), float(value[word_level].sum()), inserts]
        found = [segment.levels(x, np.zeros(len(x), _U)) for x in (words, pairs)]
        rows = [
            (_VOCABULARY, bucket, 0, words.tobytes(), n.tobytes(), found[0].tobytes(), None, *figures),
            (_SUMS, bucket, 0, contexts.tobytes(), gain.tobytes(), rest.tobytes(), None, *[None] * len(figures)),
            (_SEGMENT, bucket, 0, segment.data.tobytes(), None, None, None, *[None] * len(figures)),
        ]
        places, levels = word_back.astype("<u4"), found[1][pair_back]
        for i, block in enumerate(table.column("block").to_pylist()):
            rows.append((_CELL, bucket, block, places[word_at[i] : word_at[i + 1]].tobytes(), levels[pair_at[i] : pair_at[i + 1]].tobytes(), None, None, *[None] * len(figures)))
        return pa.Table.from_batches([_batch(fields, rows)])

    return run


def _send_sums(buckets: int):
    """Sums of contexts, combined for as many rows as fit in memory, to the buckets of the contexts' words."""

    def flush(held: list) -> pa.RecordBatch:
        keys, *values = _sums(*(np.concatenate(x) for x in zip(*held)))
        order, at = _dealt(keys, word_bucket(keys, buckets), buckets)
        parts = [x[order] for x in (keys, *values)]
        return _batch(_PACKED, [(_SUMS, b, 0, *(x[at[b] : at[b + 1]].tobytes() for x in parts), None) for b in np.flatnonzero(np.diff(at)).tolist()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for row in zip(*batch.columns):
                held.append([np.frombuffer(x.as_buffer(), kind) for x, kind in zip(row, ("<u8", "<f8", "<f8"))])
                n += len(held[-1][0])
                if n >= FLUSH:
                    yield flush(held)
                    held, n = [], 0
        if n:
            yield flush(held)

    return run


def _answer(table: pa.Table) -> pa.Table:
    """For each block, counts, levels and sums as contexts of its words in one bucket, in the order in which the block has them."""
    kinds = table.column("kind").to_numpy()
    columns = [table.column(c) for c in "kxy"]

    def parts(kind: int, *types: str) -> Iterator[list[np.ndarray]]:
        for i in np.flatnonzero(kinds == kind).tolist():
            yield [np.frombuffer(c[i].as_buffer(), t) for c, t in zip(columns, types)]

    vocabulary = next(parts(_VOCABULARY, "<u8", "<i8", "u1"), None)
    if vocabulary is None:  # sums of contexts that only hashes' upper halves name
        return pa.Table.from_batches([_batch(_PACKED, [])])
    words, counts, levels = vocabulary
    none = [np.zeros(0, _U), np.zeros(0), np.zeros(0)]
    contexts, gain, rest = _sums(*(np.concatenate(x) for x in zip(none, *parts(_SUMS, "<u8", "<f8", "<f8"))))
    at, there = _find(contexts, words & _U(0xFFFFFFFF00000000))
    there &= (levels > 0) | (words == _U(START))
    gain, rest = (np.where(there, np.append(x, 0.0)[at], 0.0) for x in (gain, rest))
    out = []
    for i in np.flatnonzero(kinds == _CELL).tolist():
        p = np.frombuffer(columns[0][i].as_buffer(), "<u4")
        out.append((_REPLY, table.column("bucket")[i].as_py(), table.column("block")[i].as_py(), *(x[p].tobytes() for x in (counts, levels, gain, rest))))
    return pa.Table.from_batches([_batch(_PACKED, out)])


def _find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``keys`` among ``sorted_keys``, and whether they are there; places of others are one past the end."""
    at = np.searchsorted(sorted_keys, keys)
    there = np.zeros(len(keys), bool)
    inside = at < len(sorted_keys)
    there[inside] = sorted_keys[at[inside]] == keys[inside]
    return np.where(there, at, len(sorted_keys)), there


def set_bits(out: np.ndarray, keys: np.ndarray, levels: np.ndarray) -> None:
    """Insert (key, 1) to (key, level) into the bytes of one segment."""
    bits = _U(len(out) * 8)
    for q in range(1, int(levels.max(initial=0)) + 1):
        h = tk.mix(keys[levels >= q] + _U(0x51ED) * _U(q))
        step = tk.mix(h + _U(1)) | _U(1)
        for _ in range(HASHES):
            place = (h >> _U(1)) % bits
            np.bitwise_or.at(out, place >> _U(3), (_U(1) << (place & _U(7))).astype(np.uint8))
            h = h + step


class Filter:
    """Log-frequency Bloom filter: a segment for each bucket, each of its own size."""

    def __init__(self, segments: list[np.ndarray]):
        self.data = segments[0] if len(segments) == 1 else np.concatenate(segments)
        self.size = np.array([len(x) for x in segments], _U)
        self.begin = np.cumsum(self.size) - self.size

    def levels(self, keys: np.ndarray, place: np.ndarray, most: int = 119) -> np.ndarray:
        """The highest level up to which all of (key, 1), (key, 2), ... are there; place: the keys' segments."""
        out, left, q = np.zeros(len(keys), np.uint8), np.arange(len(keys)), 0
        place = place.astype(np.int64)
        while len(left) and q < most:
            q += 1
            h, there = tk.mix(keys[left] + _U(0x51ED) * _U(q)), left
            step = tk.mix(h + _U(1)) | _U(1)
            for _ in range(HASHES):
                own = place[there]
                at = (h >> _U(1)) % (self.size[own] * _U(8))
                found = (self.data[self.begin[own] + (at >> _U(3))] >> (at & _U(7)).astype(np.uint8)) & 1 == 1
                h, step, there = (h + step)[found], step[found], there[found]
            out[there] = q
            left = there
        return out


class Model:
    """Totals of the training tokens, and probabilities from levels and sums; and, if it is to be broadcast, the filter.

    ``filter`` has all segments, ``contexts`` the hashes of contexts, in order, and their sums.
    """

    filter: Filter | None = None
    contexts: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def __init__(self, base: float, discount: float, buckets: int, figures):
        self.discount, self.buckets = discount, buckets
        self.n_tokens, self.n_words, self.n_value = figures.n_tokens, figures.n_words, max(float(figures.n_value), 1.0)
        self.unseen = (figures.n_once + 1) / (figures.n_tokens + 2)
        self.values = level_values(base)

    def probability(self, word: np.ndarray, pair: np.ndarray, gain: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """From the levels of the word and of the pair, and the sums of the context."""
        single = np.where(word > 0, (1 - self.unseen) * self.values[word] / self.n_value, self.unseen)
        both = gain + rest
        with_context = (np.maximum(self.values[pair] - self.discount, 0) + rest * single) / np.where(both > 0, both, 1)
        return np.where(both > 0, with_context, single)

    def probed(self, words: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, ...]:
        """Levels of words and pairs, and the words' sums as contexts, all from the filter."""
        single = self.filter.levels(words, word_bucket(words, self.buckets))
        pair = self.filter.levels(pairs, pair_bucket(pairs, self.buckets))
        at, there = _find(self.contexts[0], words & _U(0xFFFFFFFF00000000))
        there &= (single > 0) | (words == _U(START))
        gain, rest = (np.where(there, np.append(x, np.float32(0))[at], 0.0) for x in self.contexts[1:])
        return single, pair, gain, rest

    def plain(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 1) / (self.n_tokens + self.n_words + 1))


def _finish(model, folder: str):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        lm, block = model.value, key[0].as_py()
        ids, null, sizes, words, now = _stored(folder, block)
        now = np.ascontiguousarray(now.T).view(np.uint32)[:, 0]
        past = before(now, sizes, len(words) - 1)
        pairs, back = np.unique(in_buckets(pair_keys(words[past], words[now]), lm.buckets), return_inverse=True)
        kinds, table = table.column("kind"), table.select(["bucket", *"kxyz"])

        def answers(kind: int, *types: str) -> list[np.ndarray]:
            some = table.filter(pc.equal(kinds, kind)).sort_by("bucket")
            return [np.concatenate([np.zeros(0, t), *(np.frombuffer(x.as_buffer(), t) for x in some.column(c))]) for c, t in zip("kxyz", types)]

        level = answers(_CELL, "u1")[0] if lm.filter is None else None
        replies = answers(_REPLY, *(("<i8", "u1", "<f8", "<f8") if lm.filter is None else ("<i8",)))
        if len(replies[0]) != len(words) or level is not None and len(level) != len(pairs):
            raise ValueError(f"block {block} has {len(pairs)} pairs and {len(words)} words, and answers for {level if level is None else len(level)} and {len(replies[0])}")
        order = _dealt(words, word_bucket(words, lm.buckets), lm.buckets)[0]
        place = np.empty(len(words), np.int64)
        place[order] = np.arange(len(words))
        c, *found = (x[place] for x in replies)
        if lm.filter is None:
            single, gain, rest = found
        else:
            single, level, gain, rest = lm.probed(words, out_of_buckets(pairs, lm.buckets))
        p = lm.probability(single[now], level[back], gain[past], rest[past])
        doc, n = np.repeat(np.arange(len(sizes)), sizes), len(sizes)
        known, plain, score = (np.bincount(doc, x, n) for x in ((c > 0)[now], lm.plain(c)[now], np.log10(p)))
        columns = [pa.array(ids, pa.int64(), mask=null), pa.array(sizes, pa.int64()), pa.array(known.astype(np.int64)), pa.array(plain), pa.array(score)]
        return pa.Table.from_arrays(columns, schema=pa.schema(_SCORES))

    return run


class Fitted:
    """A model learnt from a table: ``merged`` has what the buckets made, ``cells`` what blocks of that table are answered with."""

    def __init__(self, spark, merged: DataFrame, figures, base: float, discount: float, buckets: int, folder: str):
        self.spark, self.merged, self.folder, self.buckets = spark, merged, folder, buckets
        self.n_tokens = int(figures.n_tokens)
        self.model = Model(base, discount, buckets, figures)
        sizes = merged.filter(F.col("kind").isin(_SEGMENT, _SUMS)).agg(F.coalesce(F.sum(F.octet_length("k")), F.lit(0)).alias("bytes")).first()
        self.bytes = sizes["bytes"]

    def of(self, kind: int) -> DataFrame:
        return self.merged.filter(F.col("kind") == kind)

    def whole(self) -> Model:
        """The model with its filter, to be broadcast."""
        if self.model.filter is None:
            found = {r.bucket: np.frombuffer(r.k, np.uint8) for r in self.of(_SEGMENT).select("bucket", "k").toLocalIterator()}
            self.model.filter = Filter([found.get(b, np.zeros(8, np.uint8)) for b in range(self.buckets)])
            sums = [[np.frombuffer(x, t) for x, t in zip(r, ("<u8", "<f8", "<f8"))] for r in self.of(_SUMS).select("k", "x", "y").toLocalIterator()]
            keys, gain, rest = _sums(*(np.concatenate(x) for x in zip([np.zeros(0, _U), np.zeros(0), np.zeros(0)], *sums)))
            self.model.contexts = keys, gain.astype(np.float32), rest.astype(np.float32)
        return self.model


def fit(documents: DataFrame, train: Column, base: float = 1.5, discount: float = 0.5, pair_least: int = 1, bits: float = 12.0) -> Fitted:
    """Learn from the rows of ``documents`` (doc_id, text) that ``train`` chooses."""
    spark = documents.sparkSession
    prepare_workers(spark)
    docs = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.coalesce(train, F.lit(False)).alias("train"))
    buckets, folder = buckets_for(documents, each_mb=8, most=1 << 16, each_partition=2), temporary_folder(spark, "blocks")
    cells = docs.mapInArrow(_cut(buckets, folder), _ddl(_KEYS)).groupBy("bucket")
    merged = materialise(cells.applyInArrow(_merge(buckets, pair_least, discount, base, bits), _ddl([*_PACKED, *_FIGURES])), "merged")
    figures = merged.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c, _ in _FIGURES)).first()
    return Fitted(spark, merged.select(*(c for c, _ in _PACKED)), figures, base, discount, buckets, folder)


def _score(model):
    """Scores of texts, whatever the model learnt from, by probing its filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lm = model.value
        for batch in batches:
            buf, offsets = tk.text_buffer(batch.column(1))
            for i, j in tk.steps(offsets):
                h, sizes = tokens(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                words, now = np.unique(np.append(h, _U(START)), return_inverse=True)
                past, now = before(now[:-1], sizes, now[-1]), now[:-1]
                pairs, back = np.unique(pair_keys(words[past], words[now]), return_inverse=True)
                single, pair, gain, rest = lm.probed(words, pairs)
                p = lm.probability(single[now], pair[back], gain[past], rest[past])
                score = np.bincount(np.repeat(np.arange(j - i), sizes), np.log10(p), j - i)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(sizes, pa.int64()), pa.array(score)], ["doc_id", "n_tokens", "score"])

    return run


def score(documents: DataFrame, fitted: Fitted, most_mb: int = 16) -> DataFrame:
    """(doc_id, n_tokens, score) of the rows of any table (doc_id, text), in one pass and without a shuffle.

    The filter is broadcast; one of more than ``most_mb`` isn't.
    """
    if fitted.bytes > most_mb << 20:
        raise ValueError(f"the filter has {fitted.bytes >> 20} MB, and {most_mb} may be broadcast")
    prepare_workers(documents.sparkSession)
    docs = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return docs.mapInArrow(_score(documents.sparkSession.sparkContext.broadcast(fitted.whole())), "doc_id long, n_tokens long, score double")


def lm_scores(documents: DataFrame, train: Column, most_mb: int = 16, **options) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row of ``documents`` (doc_id, text).

    train: which rows to learn from. score: log10 of the model's probability of the text. A filter of ``most_mb`` MB or
    less is broadcast and probed by the tasks that score; a larger one is probed where its segments are made. The
    scores are the same, but for the sums' 24 bits in what is broadcast. The base score needs exact counts of words in
    either case, which buckets send to the blocks.
    """
    spark, none = documents.sparkSession, F.lit(None).cast("binary")
    fitted = fit(documents, train, **options)
    own = fitted.of(_VOCABULARY).unionAll(fitted.of(_CELL).withColumn("x", none))
    if fitted.bytes <= most_mb << 20:
        lm = spark.sparkContext.broadcast(fitted.whole())
        answered = own.groupBy("bucket").applyInArrow(_answer, _ddl(_PACKED)).withColumns({c: none for c in "xyz"})
    else:
        lm = spark.sparkContext.broadcast(fitted.model)
        sums = fitted.of(_SUMS).select("k", "x", "y").mapInArrow(_send_sums(fitted.buckets), _ddl(_PACKED))
        levels = fitted.of(_CELL).withColumns({"k": F.col("x"), "x": none})
        answered = levels.unionAll(own.unionAll(sums).groupBy("bucket").applyInArrow(_answer, _ddl(_PACKED)))
    # tasks by number: work goes with blocks, not with the bytes of their answers
    answered = answered.repartition(shuffle_partitions(spark), "block")
    out = answered.groupBy("block").applyInArrow(_finish(lm, fitted.folder), _ddl(_SCORES))
    return out.select("doc_id", "n_tokens", "n_known", F.lit(fitted.n_tokens).cast("long").alias("train_tokens"), "base_score", "score")


def query(spark, sf_dir: str) -> DataFrame:
    """op3: scores of all documents by a model of those whose remainder by 7 is not 2."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = lm_scores(docs, remainder(F.col("doc_id"), 7) != 2)
    return out.select("doc_id", (remainder(F.col("doc_id"), 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
