"""Benchmark decontamination by spaced seeds, with DataFrame functions only.

Texts are lower-cased and cut into words. A seed is a hash of the words of a ``SPAN``-word window at the places that
one of seven fixed masks selects; every two places are ignored together by at least one mask, so that a window with any two words
substituted still has a seed in common with the original: with ``least`` = SPAN - 2 or more no window is missed. Seeds of the benchmark items meet those of all
windows of all documents. Around each hit the whole window is compared word by word, and it counts if at least
``least`` of its words agree. An item of fewer words is one window of its own length: of 8 to SPAN - 1 words one may be
substituted, and two masks select every other place, so that one of them is whole; of ``shortest`` to 7 all words must agree. Shorter items are not looked for,
as a few words in a row can't be told from chance; ``shortest`` = 1 looks for all.

Seeds of the benchmark, the query set, are sent to all tasks while they are ``most_seeds`` or fewer (a size that is counted, not guessed), and documents never move.
More of them meet the hashes of the documents' windows by a shuffle of narrow rows; the texts of hits are then read again. The rows are the same.
A window that several items share is looked for once;
a table of windows and items, which the found windows are joined with, then gives a row for each of its items. What is counted
is the document's: a window of it counts once for an item, at however many places the item has it. Words are 64-bit hashes on both sides.

Null texts have no words. A document is a doc_id and a text: rows with different texts are different documents, whether their ids are
equal or null, and give a row each; rows with both equal are one. Items with equal item_id and number of words are one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from loomery.llm.storage import materialise, unused

#: Masks of the seeds, 1 compared and 0 ignored. Their ignored places are a covering design: 7 sets of 6 places that hold all pairs of 13.
COVER = ("0100010110111", "1111100010010", "1011010100101", "1110001011001", "1010011001110", "0001101101011", "0100111011100")
SPAN = len(COVER[0])
SPACES = r"[\x20\x09-\x0D]+"


def hashed_words(text: Column) -> Column:
    words = F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), SPACES), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _window(words: str, at: str) -> list[Column]:
    """The words of the window that starts at ``at``, as columns: each is read once, however many masks select it."""
    return [F.get(F.col(words), F.col(at) + F.lit(i)).alias(f"w{i}") for i in range(SPAN)]


def _masks(n: int) -> list[str]:
    """Masks of windows of n words."""
    return list(COVER) if n == SPAN else ["1" * n] if n < 8 else ["".join(str((i + k) % 2) for i in range(n)) for k in (0, 1)]


def _seeds(lengths: list[int]) -> Column:
    """Array of (n, seed) of the window whose words are w0, w1, ...: for each mask of SPAN words and of each length of short items."""
    word = lambda i: F.col(f"w{i}")
    each = []
    for n in [SPAN, *lengths]:
        for k, mask in enumerate(_masks(n)):
            seed = F.xxhash64(F.lit(n), F.lit(k), *(word(i) for i, x in enumerate(mask) if x == "1"))
            each.append(F.struct(F.lit(n).alias("n"), F.when(word(n - 1).isNotNull(), seed).alias("seed")))
    return F.array(*each)


def _found(documents: DataFrame, benchmark: DataFrame, least: int, most_seeds: int, shortest: int) -> DataFrame:
    """(doc, print, item, size, n_windows, overlap): documents, by id and hash of the text, and the items they hold parts of."""
    text = F.col("text").cast("string")
    items = materialise(benchmark.select(F.col("item_id").cast("long").alias("item"), hashed_words(text).alias("words")).filter(F.size("words") >= shortest), "items")
    short = items.select(F.size("words").alias("n")).filter(F.col("n") < SPAN).distinct()
    lengths = sorted(r.n for r in short.collect())  # SPAN - 1 lengths at most
    window = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("words") - SPAN)))
    # a short item has one window, at 0; its long seeds are null, and a long item's short ones are not taken
    seeds = items.select("item", "words", window.alias("at")).select("item", "words", "at", *_window("words", "at"))
    seeds = seeds.select("item", "words", "at", F.explode(_seeds(lengths)).alias("x")).filter(F.col("x.seed").isNotNull() & (F.col("x.n") == F.least(F.lit(SPAN), F.size("words"))))
    seeds = seeds.select("x.seed", F.slice("words", F.col("at") + 1, F.col("x.n")).alias("part"), "item", F.size("words").alias("size"))
    owners = materialise(seeds.select("part", "item", "size").distinct(), "owners")
    owners = F.broadcast(owners) if owners.count() <= most_seeds else owners
    seeds = materialise(seeds.select("seed", "part").distinct(), "seeds")

    docs = documents.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("print"), hashed_words(text).alias("words"))
    fewest = lengths[0] if lengths else SPAN
    docs = docs.filter(F.size("words") >= fewest)
    windows = docs.select("doc", "print", "words", F.explode(F.sequence(F.lit(0), F.size("words") - fewest)).alias("start"))
    windows = windows.select("doc", "print", "start", *_window("words", "start"))
    keys = windows.select("*", F.explode(_seeds(lengths)).alias("x")).filter(F.col("x.seed").isNotNull())
    if seeds.count() <= most_seeds:
        hits = keys.join(F.broadcast(seeds), F.col("x.seed") == F.col("seed"))
    else:
        keys = keys.select(F.col("doc").alias("of"), F.col("print").alias("of_print"), F.col("start").alias("at"), F.col("x.seed").alias("key"))
        hits = materialise(keys.join(seeds, F.col("key") == F.col("seed")).select("of", "of_print", "at", "part").distinct(), "hits")
        hits = hits.join(docs, F.col("doc").eqNullSafe(F.col("of")) & (F.col("print") == F.col("of_print")))
        hits = hits.withColumnRenamed("at", "start").select("doc", "print", "start", "part", *_window("words", "start"))
    same = sum(F.when(F.get("part", F.lit(i)) == F.col(f"w{i}"), 1).otherwise(0) for i in range(SPAN))
    needed = F.when(F.size("part") == SPAN, F.lit(least)).otherwise(F.size("part") - (F.size("part") >= 8).cast("int"))
    found = hits.filter(same >= needed).select("doc", "print", "start", "part").join(owners, "part").select("doc", "print", "item", "size", "start").distinct()
    # a window's own words are those before the next window of the same item begins
    step = F.lead("start").over(W.partitionBy("doc", "print", "item", "size").orderBy("start")) - F.col("start")
    found = found.withColumn("own", F.least(step, F.col("size"), F.lit(SPAN)))
    return found.groupBy("doc", "print", "item", "size").agg(F.count(F.lit(1)).alias("n_windows"), F.sum("own").alias("overlap"))


def find_leaks(documents: DataFrame, benchmark: DataFrame, least: int = 11, most_seeds: int = 400_000, shortest: int = 5) -> DataFrame:
    """(doc_id, item_id, n_windows, overlap_words, item_words): documents and the items they hold parts of.

    n_windows: windows of the document that are in the item. overlap_words: words of the document that these cover, each once, substituted
    ones among them; more than item_words where the document holds the item twice. Extra columns of either table are not read.
    """
    found = _found(documents, benchmark, least, most_seeds, shortest)
    return found.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "n_windows", F.col("overlap").alias("overlap_words"), F.col("size").cast("long").alias("item_words"))


def remove_leaks(documents: DataFrame, benchmark: DataFrame, least: int = 11, most_seeds: int = 400_000, shortest: int = 5) -> DataFrame:
    """The rows of ``documents``, with all columns, that hold no part of a benchmark item."""
    doc, mark = unused("doc"), unused("print")
    leaks = _found(documents, benchmark, least, most_seeds, shortest).select(F.col("doc").alias(doc), F.col("print").alias(mark)).distinct()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))) == F.col(mark))
    return documents.join(leaks, same, "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    """op1: documents with benchmark passages, and which."""
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
