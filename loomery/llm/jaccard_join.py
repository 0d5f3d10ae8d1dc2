"""N-gram Jaccard join by MinHash banding, with exact verification.

Texts are compared as sets of word 5-grams (ASCII letters lower-cased; a text of one to four words has the one
gram of all its words). Each document gets ``bands`` hashes of ``rows`` minima each, chosen so that a pair at the
threshold shares a band with the target probability. Exact copies are merged first, and only one text of each
class goes on. Texts that share a band are linked to the least id of that band's bucket, never to each other, and
connected components of these links are the candidate groups. Each group's whole n-gram sets are then compared
pairwise inside tasks. A group of more than ``block`` texts, or of more than ``block_mb`` MB, is cut into blocks; each block's sets are written once to the
shared folder, and a task compares two blocks that it reads there, so texts move once however large the group is (the
comparisons of a group of m different texts are m * m, as its links may be). Tasks return a count of
links per text and a spanning forest, never the pairs themselves; components of the forests are the classes.
What a group has in common reaches the texts of large groups by a join on (group, salt).

Null texts and texts without words have no n-grams: they link to nothing, and each is a class of its own. Rows
with the same doc_id, or without one, are told apart by their text; fully repeated rows are copies of each other. A class
without any doc_id has a null class_id.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery.llm import files
from loomery.llm import textkernel as tk
from loomery.llm.components import components
from loomery.llm.storage import lean, materialise, prepare_workers, quoted, shared_folder, shuffle_partitions, unused

SALTS = 64
_HASHERS: list[tk.Hasher] = []


def _hasher() -> tk.Hasher:
    if not _HASHERS:
        _HASHERS.append(tk.Hasher(33, lower=True))
    return _HASHERS[0]


def choose_bands(threshold: float, recall: float, most: int = 256) -> tuple[int, int]:
    """(bands, rows): the most rows for which bands x rows <= most/2 still reach ``recall`` at ``threshold``."""
    best = None
    for rows in range(1, 17):
        bands = next((b for b in range(1, most // rows + 1) if 1 - (1 - threshold**rows) ** b >= recall), None)
        if bands and (best is None or bands * rows <= most // 2):
            best = (bands, rows)
    if best is None:
        raise ValueError("no bands reach this recall")
    return best


def shingles(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams and each document's first; shorter documents have one gram of all their words."""
    grams, bounds = tk.ngrams(h, first, n)
    size = np.diff(first)
    short = np.flatnonzero((size > 0) & (size < n))
    if not len(short):
        return grams, bounds
    whole = []
    for d in short.tolist():
        x = np.zeros(1, np.uint64)
        for j, w in enumerate(h[first[d] : first[d + 1]]):
            x = tk.mix(x * np.uint64(31) + w + np.uint64(j + 1))
        whole.append(x[0])
    grams = np.insert(grams, bounds[short], np.array(whole, np.uint64))
    grow = np.zeros(len(bounds), np.int64)
    grow[short + 1] = 1
    return grams, bounds + np.cumsum(grow)


def _sign(n: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors, shifts = tk.numbers(101, bands * rows) | np.uint64(1), tk.numbers(202, bands * rows)
        for batch in batches:
            buf, offsets = tk.text_buffer(batch.column(2))
            found, sizes = [], []
            for i, j in tk.steps(offsets):
                part = buf[offsets[i] : offsets[j]]
                starts, ends, first = tk.words(part, offsets[i : j + 1] - offsets[i])
                grams, bounds = shingles(_hasher()(part, starts, ends), first, n)
                full = np.flatnonzero(np.diff(bounds))
                out = np.zeros((j - i, bands), np.uint64)
                if len(full):
                    for b in range(bands):
                        key = np.full(len(full), b + 1, np.uint64)
                        for k in range(b * rows, b * rows + rows):
                            key = tk.mix(key * np.uint64(31) + np.minimum.reduceat(grams * factors[k] + shifts[k], bounds[full]))
                        out[full, b] = key
                found.append(out)
                sizes.append(np.diff(bounds))
            keys = np.concatenate(found) if found else np.zeros((0, bands), np.uint64)
            some = np.concatenate(sizes) > 0 if sizes else np.zeros(0, bool)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(some * bands)]).astype(np.int32)), pa.array(keys[some].view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists, pa.array(np.diff(offsets))], ["doc_id", "copy", "bands", "bytes"])

    return run


def _links(sets: list[np.ndarray], weight: np.ndarray, left: np.ndarray, right: np.ndarray, same: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """For texts left x right: what each text gains in links, and pairs (i, j) of a spanning forest."""
    gain, n = np.zeros(len(sets), np.int64), len(sets)
    sizes = np.array([len(s) for s in sets])
    grams, who = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    _, gram, times = np.unique(grams, return_inverse=True, return_counts=True)
    shared = times[gram] > 1
    ids, gram = np.unique(gram[shared], return_inverse=True)
    who = who[shared]
    order = np.argsort(gram, kind="stable")
    gram, who = gram[order], who[order]
    parent = np.arange(n)

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    side = np.full(n, -1)
    side[right] = np.arange(len(right))
    rows_of = np.full(n, -1)
    rows_of[left] = np.arange(len(left))
    common = np.zeros((len(left), len(right)), np.float32)
    width = 4096
    for low in range(0, len(ids), width):
        p, q = np.searchsorted(gram, [low, low + width])
        w, g = who[p:q], gram[p:q] - low
        a = np.zeros((len(left), min(width, len(ids) - low)), np.float32)
        b = a if same else np.zeros((len(right), a.shape[1]), np.float32)
        mine = rows_of[w] >= 0
        a[rows_of[w[mine]], g[mine]] = 1
        if not same:
            b[side[w[~mine]], g[~mine]] = 1
        common += a @ b.T
    # sets hold whole numbers far below 2**24, so the products are exact
    both = sizes[left][:, None] + sizes[right][None, :] - common
    linked = common >= threshold * both - 1e-6
    if same:
        np.fill_diagonal(linked, False)
        gain[left] = linked @ weight[right]
    else:
        gain[left] = linked @ weight[right]
        gain[right] = linked.T @ weight[left]
    forest = []
    for i in range(len(left)):
        for j in np.flatnonzero(linked[i]).tolist():
            x, y = root(left[i]), root(right[j])
            if x != y:
                parent[max(x, y)] = min(x, y)
                forest.append((left[i], right[j]))
    return gain, np.array(forest, np.int64).reshape(-1, 2)


_FOUND = pa.schema([("node", pa.int64()), ("to", pa.int64()), ("gain", pa.int64())])


def _sets_of(table: pa.Table, n: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Nodes, numbers of copies and n-gram sets of the texts in ``table``."""
    table = table.combine_chunks()
    _, keep = np.unique(table.column("node").to_numpy(), return_index=True)  # repeated rows hold the same text
    table = table.take(pa.array(keep))
    sets = []
    for chunk in table.column("text").chunks:
        buf, offsets = tk.text_buffer(chunk)
        for i, j in tk.steps(offsets):
            piece = buf[offsets[i] : offsets[j]]
            starts, ends, first = tk.words(piece, offsets[i : j + 1] - offsets[i])
            grams, bounds = shingles(_hasher()(piece, starts, ends), first, n)
            sets += [np.unique(grams[x:y]) for x, y in zip(bounds[:-1], bounds[1:])]
    return table.column("node").to_numpy(), table.column("copies").to_numpy(), sets


def _compare(one: tuple, two: tuple | None, threshold: float) -> pa.Table:
    """Links among the texts of one block, or between those of two."""
    node, weight, sets = one if two is None else (np.concatenate([one[0], two[0]]), np.concatenate([one[1], two[1]]), [*one[2], *two[2]])
    if len(sets) < 2:
        return _FOUND.empty_table()
    left = np.arange(len(one[2]))
    right = left if two is None else np.arange(len(one[2]), len(sets))
    gain, forest = _links(sets, weight, left, right, two is None, threshold)
    got = np.flatnonzero(gain)
    nodes = np.concatenate([node[got], node[forest[:, 0]]])
    to = np.concatenate([node[got], node[forest[:, 1]]])
    return pa.Table.from_arrays([pa.array(nodes), pa.array(to), pa.array(np.concatenate([gain[got], np.zeros(len(forest), np.int64)]))], schema=_FOUND)


def _verify(n: int, threshold: float):
    return lambda key, table: _compare(_sets_of(table, n), None, threshold)


def _store(n: int, folder: str):
    """Write the sets of one block to a file of its own; a task that runs again writes the same."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        component, part = (k.as_py() for k in key)
        files.put(folder, f"{component}-{part}", [pickle.dumps(_sets_of(table, n), 5)])
        return pa.table({"component": pa.array([component], pa.int64()), "part": pa.array([part], pa.int32())})

    return run


def _compare_stored(folder: str, threshold: float):
    def read(component: int, part: int) -> tuple:
        with files.reading(folder, f"{component}-{part}") as file:
            return pickle.loads(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for component, one, two in zip(*(c.to_pylist() for c in batch.columns)):
                yield from _compare(read(component, one), read(component, two) if one != two else None, threshold).to_batches()

    return run


def near_duplicates(documents: DataFrame, **options) -> DataFrame:
    """(doc_id, copy, class_id, n_links, is_first) of every row of ``documents`` (doc_id, text).

    copy: the text's 128-bit hash, in hex. class_id: the least doc_id among all documents that chains of links
    connect to this one. n_links: documents other than this one whose n-gram sets have at least ``threshold`` of
    their union in common with this one's. is_first: whether the row is the one that stands for its class.
    """
    signed, named = _classes(documents, **options)
    out = signed.select("doc_id", "copy").join(named, F.col("copy") == F.col("copy_of"), "left")
    alone = F.col("copy_of").isNull()  # without words
    return out.select(
        "doc_id",
        "copy",
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        (alone | (F.col("leads") & F.col("doc_id").eqNullSafe(F.col("least")))).alias("is_first"),
    )


def _salted(groups: DataFrame, large) -> DataFrame:
    """A row for each salt of the large groups, and one, with salt 0, for the others."""
    return groups.withColumn("salt", F.explode(F.when(large, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))


def _classes(documents: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.999, block: int = 256, block_mb: float = 8) -> tuple[DataFrame, DataFrame]:
    """Rows with their bands, and for each text with words its class: (copy_of, class_id, n_links, least, leads)."""
    spark = documents.sparkSession
    prepare_workers(spark)
    bands, rows = choose_bands(threshold, recall)
    text = F.col("text").cast("string")
    docs = documents.select(F.col("doc_id").cast("long"), F.md5(F.coalesce(text, F.lit("")).cast("binary")).alias("copy"), text.alias("text"))
    signed = materialise(docs.mapInArrow(lean(_sign(n, bands, rows)), "doc_id long, copy string, bands array<long>, bytes long"), "signed")

    # classes of equal texts; node is a short name of each
    full = signed.filter(F.size("bands") > 0)
    classes = full.groupBy("copy").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands"), F.first("bytes").alias("bytes"))
    classes = materialise(classes.withColumn("node", F.xxhash64("copy", F.lit(1))), "classes")

    # candidate groups: stars inside each band's bucket
    keys = classes.select("node", F.explode("bands").alias("band"))
    stars = keys.groupBy("band").agg(F.min("node").alias("to"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    groups = components(keys.join(stars.select("band", "to"), "band").select(F.col("node").alias("a"), F.col("to").alias("b")))

    # groups that are too large for one task are cut into blocks
    member = classes.select("node", "copy", "least", "copies", "bytes").join(groups, "node").withColumn("salt", F.pmod(F.xxhash64("node", F.lit(3)), F.lit(SALTS)).cast("int"))
    member = materialise(member, "candidates")
    size = member.groupBy("component").agg(F.count(F.lit(1)).alias("texts"), F.sum("bytes").alias("bytes"))
    blocks = F.ceil(F.greatest(F.col("texts") / block, F.col("bytes") / (block_mb * (1 << 20)))).cast("int")
    large = materialise(size.select("component", blocks.alias("blocks")).filter("blocks > 1"), "large")
    member = member.drop("bytes").join(_salted(large, F.lit(True)), ["component", "salt"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    member = member.withColumn("part", F.pmod(F.xxhash64("node", F.lit(2)), F.col("blocks")).cast("int"))
    member = materialise(member.withColumn("salt", F.when(F.col("blocks") > 1, F.col("salt")).otherwise(0)), "members")

    # whole texts are compared
    whole = docs.hint("merge").join(member.withColumnRenamed("copy", "copy_of"), (F.col("copy") == F.col("copy_of")) & docs.doc_id.eqNullSafe(F.col("least")))
    whole = whole.select("node", "copies", "text", "component", "part", "blocks")
    folder = shared_folder(spark, "blocks")
    files.make_folder(folder)
    if large.isEmpty():
        found = whole.groupBy("component").applyInArrow(_verify(n, threshold), "node long, to long, gain long")
    else:
        whole = materialise(whole, "candidate-texts")
        found = whole.filter("blocks = 1").groupBy("component").applyInArrow(_verify(n, threshold), "node long, to long, gain long")
        stored = whole.filter("blocks > 1").groupBy("component", "part").applyInArrow(_store(n, folder), "component long, part int")
        stored = materialise(stored, "blocks-stored").alias("one")
        two = stored.select(F.col("component").alias("group"), F.col("part").alias("other"))
        pairs = stored.join(two, (F.col("component") == F.col("group")) & (F.col("part") <= F.col("other"))).select("component", "part", "other")
        pairs = pairs.repartition(4 * shuffle_partitions(spark), "component", "part", "other")
        found = found.unionAll(pairs.mapInArrow(_compare_stored(folder, threshold), "node long, to long, gain long"))
    found = materialise(found, "links")
    gains = found.groupBy("node").agg(F.sum("gain").alias("gain"))
    names = components(found.select(F.col("node").alias("a"), F.col("to").alias("b")))

    # the text that stands for a class: of the least id, and of the smallest node where ids are equal
    least = member.select("node", "least", "blocks", "salt").join(names, "node")
    head = F.min(F.struct(F.col("least").isNull().alias("none"), F.col("least").alias("id"), F.col("node").alias("of"))).alias("head")
    heads = _salted(least.groupBy("component").agg(head, (F.max("blocks") > 1).alias("cut")), F.col("cut"))
    linked = least.join(heads.select("component", "salt", "head"), ["component", "salt"]).select("node", F.col("head.id").alias("id"), (F.col("node") == F.col("head.of")).alias("leads"))
    linked = linked.join(gains, "node", "left")
    named = classes.select("copy", "node", "least", "copies").join(linked, "node", "left")
    named = named.select(
        F.col("copy").alias("copy_of"),
        F.when(F.col("leads").isNull(), F.col("least")).otherwise(F.col("id")).alias("class_id"),
        (F.col("copies") - 1 + F.coalesce("gain", F.lit(0))).alias("n_links"),
        "least",
        F.coalesce("leads", F.lit(True)).alias("leads"),
    )
    return signed, named


def keep_one_of_each(documents: DataFrame, **options) -> DataFrame:
    """The rows of ``documents``, with all columns, that stand for their classes; of repeated rows, one.

    Rows that no other row repeats need no grouping of whole rows, and are only looked up; the result is the same.
    """
    signed, named = _classes(documents, **options)
    rows = signed.groupBy("doc_id", "copy").agg(F.count(F.lit(1)).alias("rows"), F.max(F.size("bands")).alias("bands"))
    leads = named.filter("leads").select(F.col("least").alias("id"), "copy_of")
    firsts = rows.join(leads, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("copy") == F.col("copy_of")), "left_semi").unionAll(rows.filter("bands = 0"))
    doc, copy_of, times, key = (unused(x) for x in ("doc", "copy", "rows", "key"))
    firsts = materialise(firsts.select(F.col("doc_id").alias(doc), F.col("copy").alias(copy_of), F.col("rows").alias(times)), "firsts")
    copy = F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (copy == F.col(copy_of))
    repeated = firsts.filter(F.col(times) > 1)
    if repeated.isEmpty():
        return documents.hint("merge").join(firsts, same, "left_semi")
    one = documents.join(firsts.filter(F.col(times) == 1), same, "left_semi")
    # one of each set of rows with the same id and text
    many = documents.withColumn(key, copy).join(repeated, same, "left_semi").dropDuplicates(["doc_id", key]).select([quoted(c) for c in documents.columns])
    return one.unionAll(many)


def query(spark, sf_dir: str) -> DataFrame:
    """op8: class and number of links of every document."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "class_id", "n_links")
