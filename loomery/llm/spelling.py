"""Spelling variants: words that differ by one character, each with the form it most likely stands for.

Rare-first prefix filter. One edit changes two bigrams of a word at most, so of the three bigrams of a word that are
rarest in the whole vocabulary at least one is among the three rarest of every near word, and it is moved by one place
at most. Words are joined on these bigrams only, with their place for words of the same length, and with their place or
the next for words that are one longer; the letters before or after such a bigram must be equal too, as there is one
edit only. Every pair that meets is verified.

Bigrams are ordered by the number of words that hold them, then by code points, so all words agree on the order. There
are at most 90 letters, so 8,100 bigrams, which is what the driver and every task hold.

A null text has no words; a null doc_id is written "null" for the dice. Repeated rows count as often as they are
there. Other columns aren't looked at. An empty table, or one without frequent words, gives an empty result. Words of
any length are compared whole; memory holds the different words of a few hundred thousand at a time. Both sides of all
joins grow with the vocabulary and are far larger than the compressed files they come from, so none may be broadcast.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from heapq import nsmallest

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery.llm.storage import lean, materialise, prepare_workers

RUNS = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {i: i + 32 for i in range(65, 91)}
#: One run in so many loses a letter, by dice.
NOISE = 97
#: Different words that a task counts before it passes them on.
HELD = 200_000


def noisy(runs: Counter, doc_id: int | None) -> Iterator[tuple[str, int]]:
    """The runs of a document, some without one letter, and how often each is there."""
    head = zlib.crc32(f"{'null' if doc_id is None else doc_id}:".encode())
    for word, n in runs.items():
        h = zlib.crc32(word.encode(), head)
        if h % NOISE == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1 :]
        yield word, n


def _count(shortest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def passed_on() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                runs = Counter(RUNS.findall((text.as_py() or "").translate(LOWER)))
                for word, n in noisy(runs, doc_id):
                    if len(word) >= shortest:
                        held[word] += n
                if len(held) >= HELD:
                    yield passed_on()
                    held.clear()
        yield passed_on()

    return lean(run)


def vocabulary(documents: DataFrame, shortest: int = 5, least: int = 3) -> DataFrame:
    """(word, n): the words of ``documents`` (doc_id, text) with so many letters and occurrences."""
    prepare_workers(documents.sparkSession)
    docs = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    counted = docs.mapInArrow(_count(shortest), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def bigram_ranks(words: DataFrame) -> dict[str, int]:
    """The place of each bigram in the order from rare to frequent."""
    grams = F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring(F.col("word"), i, F.lit(2)))
    counted = words.filter(F.length("word") > 1).select(F.explode(F.array_distinct(grams)).alias("gram")).groupBy("gram").count()
    return {r["gram"]: i for i, r in enumerate(sorted(counted.collect(), key=lambda r: (r["count"], r["gram"])))}


def meeting_keys(word: str, ranks: dict[str, int], asking: bool, prefix: int = 3, enough: int = 5) -> set[str]:
    """What a word is found by, or asks for: its rarest bigrams with their place, and the letters beside them.

    The one edit is before or after a bigram that both words have, so all letters on the other side are equal. Where
    these and the bigram are fewer than ``enough``, the edit is in the first or the last half of the letters left, and
    the other half is equal too. A word asks for words of its length ("=") and for words that are one longer ("+").
    """
    size, keys = len(word), set()
    for _, p in nsmallest(prefix, [(ranks[word[i : i + 2]], i) for i in range(size - 1)]):
        for side, equal, rest in (("<", word[: p + 2], word[p + 2 :]), (">", word[p:], word[:p])):
            m = len(rest)
            for more in ("=", "+"):
                head = f"{side}{equal}{more}{size + (asking and more == '+')}"
                m = len(rest) - (not asking and more == "+")  # letters left in the shorter word
                if m < 0:
                    continue
                if len(equal) >= enough:
                    keys.add(head)
                else:
                    keys |= {f"{head}<{rest[: m // 2]}", f"{head}>{rest[len(rest) - (m - m // 2) :]}"}
    return keys


def _meeting(ranks: dict[str, int], asking: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [list(meeting_keys(w, ranks, asking)) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.list_(pa.string()))], ["word", "n", "keys"])

    return lean(run)


def near_words(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): all pairs of ``words`` (word, n; five letters or more) that one inserted, deleted or replaced letter tells apart, each once."""
    prepare_workers(words.sparkSession)
    ranks = bigram_ranks(words)

    def met(asking: bool, name: str) -> DataFrame:
        keys = words.select("word", "n").mapInArrow(_meeting(ranks, asking), "word string, n long, keys array<string>")
        return keys.select(F.col("word").alias(name), F.col("n").alias(f"{name}_n"), F.explode("keys").alias("key")).withColumn("key", F.xxhash64("key"))

    once = (F.length("a") < F.length("b")) | (F.col("a") < F.col("b"))
    found = met(True, "a").join(met(False, "b").hint("merge"), "key").filter(once & (F.levenshtein("a", "b", 1) == 1))
    return found.select("a", "a_n", "b", "b_n").distinct()


def roots(forms: DataFrame, rounds: int = 7) -> DataFrame:
    """(word, root) of ``forms`` (word, form): the last form that is reached from a word.

    Each round doubles how far every word looks, so seven rounds reach 128 forms; counts double from form to form, so
    there are 63 at most.
    """
    reached = forms.select("word", F.col("form").alias("root"))
    for _ in range(rounds):
        on = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        farther = materialise(reached.join(on.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        reached = farther.select("word", "root")
        if farther.filter("moved").isEmpty():
            break
    return reached


def spelling_variants(documents: DataFrame, shortest: int = 5, least: int = 3, times: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each frequent word.

    The form is the near word with the most occurrences (of equals the first by code points), if it has ``times``
    as many as the word; the root is the last of the forms of forms, or the word itself.
    """
    if shortest < 5:
        raise ValueError("words need five letters to have three bigrams beyond what one edit changes")
    words = materialise(vocabulary(documents, shortest, least), "vocabulary")
    pairs = materialise(near_words(words), "near_words")
    both = pairs.union(pairs.select("b", "b_n", "a", "a_n"))
    best = both.groupBy(F.col("a").alias("word")).agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("less"), F.col("b").alias("near"))).alias("best"))
    fits = -F.col("best.less") >= times * F.col("n")
    judged = words.join(best.hint("merge"), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("best.near")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n")
    )
    judged = materialise(judged, "forms")
    ends = roots(judged.filter(F.col("form").isNotNull()))
    return judged.join(ends.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark, sf_dir: str) -> DataFrame:
    """op12: every frequent word with its form and its root."""
    return spelling_variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))
