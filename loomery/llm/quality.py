r"""Quality rules as weak supervision, with DataFrame functions only.

Every rule votes good (1), bad (-1) or abstains (0). Documents are counted by their votes, which leaves at most
3 ** rules rows; expectation-maximisation runs over that table, one aggregation a round, and only its parameters come
to the driver. A document is good or of one of a few bad kinds, since junk of one kind passes the rules against the
others; for each kind the share of documents is estimated, and each rule's accuracy when it votes. The posterior
probability of being good follows from a document's votes, and decides instead of a demand that all rules pass.

No label is used, and the documents decide: what keeps the kinds' sense is a weak start and a prior of five documents
(``pseudo``) for each estimate, whatever their number. Before any is seen, rules vote good on 8 of 10 documents, and
those against a kind on 5 of 10 of its documents. Rules that look at the same thing from different sides are held to
be independent within a kind, which is why each kind has several: one rule alone could as well be wrong about good
documents. A rule that knows nothing ends near one half for all kinds, so its votes count for nothing. With no
documents the start stands. Repeated rows count as often as they are there; other columns aren't looked at; very long
texts are held whole, a few times over, by one task.

Null texts have no words and fail the base test. Lines are cut at \n; words are runs of other than white space.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomery.llm.storage import materialise

SPACES = r"[\x20\x09-\x0D]+"
WINDOW = 8


def _count(text: Column, chars: str) -> Column:
    """Number of characters of a class, by what is left without them."""
    return (F.length(text) - F.length(F.regexp_replace(text, f"{chars}+", ""))).cast("long")


def _windows(hashes: Column) -> Column:
    """A hash of each window of WINDOW words, from hashes of the words."""
    each = F.transform(F.sequence(F.lit(0), F.size(hashes) - WINDOW), lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(WINDOW))))
    return F.when(F.size(hashes) >= WINDOW, each).otherwise(F.array().cast("array<bigint>"))


def _covered(windows: Column) -> Column:
    """Number of words in windows that the text has twice or more.

    Windows are sorted with their places, those with an equal neighbour are repeated, and the union of their
    ranges is summed up in one pass over their places.
    """
    placed = F.array_sort(F.transform(windows, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    twice = lambda s: F.filter(s, lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))
    # binding the sorted array to a name: transform over an array of one
    places = F.get(F.transform(F.array(placed), lambda s: F.array_sort(F.transform(twice(s), lambda x: x["i"]))), F.lit(0))
    start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
    step = lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last"))
    return F.aggregate(places, start, step, lambda a: a["n"])


def features(documents: DataFrame) -> DataFrame:
    """doc_id, the base figures, and what the rules look at."""
    text = F.col("text")
    docs = documents.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("words", F.array_remove(F.split(text, SPACES), ""))
    docs = docs.withColumn("lines", F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    docs = docs.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    docs = docs.withColumn("windows", _windows(F.col("hashes")))
    repeated = F.size(F.array_distinct("windows")) < F.size("windows")
    return docs.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        _count(text, r"[#*$%&|<>]").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(repeated, _covered(F.col("windows"))).otherwise(0).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.array_distinct("hashes")).cast("long").alias("n_distinct"),
        _count(text, r"\p{Lu}").alias("n_upper"),
        _count(text, r"!").alias("n_calls"),
        _count(text, r"[.?!]").alias("n_stops"),
        _count(text, r"\p{L}").alias("n_letters"),
        F.size(F.filter("words", lambda w: w.rlike(r"[#*$%&|<>]"))).cast("long").alias("n_symbol_words"),
        F.size(F.filter("words", lambda w: (F.length(w) > 1) & (w == F.upper(w)) & w.rlike(r"\p{L}"))).cast("long").alias("n_loud_words"),
        F.size(F.filter("words", lambda w: ~w.rlike(r"\p{L}"))).cast("long").alias("n_bare_words"),
        _count(text, r"[^\p{L}\p{N}\s.,;:!?'\"()-]").alias("n_odd"),
        F.length(text).cast("long").alias("n_chars"),
    )


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """The votes; shares are compared as products of whole numbers."""
    c = F.col
    n = c("n_words")
    return {
        "enough_words": _vote(n >= 50, n < 20),
        "few_symbols": _vote(c("n_symbols") * 50 <= n, c("n_symbols") * 10 > n),
        "no_repeats": _vote(c("n_repeat_words") * 20 <= n, c("n_repeat_words") * 5 > n),
        "own_lines": _vote(c("n_dup_lines") * 10 <= c("n_lines"), c("n_dup_lines") * 3 > c("n_lines")),
        "lower_case": _vote(c("n_upper") * 5 <= c("n_letters"), c("n_upper") * 2 > c("n_letters")),
        "calm": _vote(c("n_calls") * 20 <= n, c("n_calls") * 4 > n),
        "word_length": _vote((c("word_chars") >= 3 * n) & (c("word_chars") <= 10 * n), (c("word_chars") < 2 * n) | (c("word_chars") > 14 * n)),
        "sentences": _vote((c("n_stops") * 100 >= n) & (c("n_stops") * 2 <= n), (c("n_stops") * 500 < n) | (c("n_stops") * 10 > 8 * n)),
        "letters": _vote(c("n_letters") * 10 >= c("word_chars") * 8, c("n_letters") * 10 < c("word_chars") * 6),
        "variety": _vote(c("n_distinct") * 10 >= n * 4, c("n_distinct") * 10 < n),
        "plain_words": _vote(c("n_symbol_words") * 50 <= n, c("n_symbol_words") * 8 > n),
        "common_marks": _vote(c("n_odd") * 100 <= c("n_chars"), c("n_odd") * 25 > c("n_chars")),
        "quiet_words": _vote(c("n_loud_words") * 20 <= n, c("n_loud_words") * 3 > n),
        "worded": _vote(c("n_bare_words") * 10 <= n, c("n_bare_words") * 3 > n),
    }


#: Kinds of documents, with the rules that are held to tell them from good ones: bad documents seldom fail all rules.
KINDS: dict[str, tuple[str, ...]] = {
    "good": (),
    "symbols": ("few_symbols", "plain_words", "common_marks"),
    "repeats": ("no_repeats", "own_lines", "variety"),
    "shouting": ("lower_case", "calm", "quiet_words"),
    "fragments": ("enough_words", "sentences", "word_length", "letters", "worded"),
}


class Model:
    """Share of each kind, and for each rule its share of good votes among votes on that kind."""

    def __init__(self, names: list[str], pseudo: float):
        self.names, self.pseudo = names, pseudo
        self.first_shares = [0.7] + [0.3 / (len(KINDS) - 1)] * (len(KINDS) - 1)
        self.first = [[0.5 if name in own else 0.8 for name in names] for own in KINDS.values()]
        self.shares, self.good_votes = list(self.first_shares), [list(row) for row in self.first]

    def posteriors(self) -> Column:
        """Probability of each kind, from the column ``votes``."""
        weights = [F.lit(log(share)) + _sum(F.zip_with("votes", _pairs(row), lambda v, w: F.when(v == 1, w["good"]).when(v == -1, w["bad"]).otherwise(0.0))) for share, row in zip(self.shares, self.good_votes)]
        scaled = F.transform(F.array(*weights), lambda x: F.exp(x))
        return F.transform(F.array(scaled), lambda all_: F.transform(all_, lambda x: x / _sum(all_)))[0]

    def fit(self, counted: DataFrame) -> float:
        """One round of expectation-maximisation over (votes, n); the largest change."""
        each = counted.select("n", "votes", F.posexplode(self.posteriors()).alias("kind", "share"))
        each = each.select("kind", (F.col("n") * F.col("share")).alias("mass"), F.posexplode("votes").alias("rule", "vote"))
        rows = each.groupBy("kind", "rule", "vote").agg(F.sum("mass").alias("mass")).collect()  # 3 x kinds x rules at most
        mass = {(r.kind, r.rule, r.vote): r.mass for r in rows}
        old = [*self.shares, *(x for row in self.good_votes for x in row)]
        sizes = [sum(mass.get((k, 0, v), 0.0) for v in (-1, 0, 1)) for k in range(len(KINDS))]
        total = sum(sizes)
        held = self.pseudo
        self.shares = [(size + held * first) / (total + held) for size, first in zip(sizes, self.first_shares)]
        for k in range(len(sizes)):
            for j in range(len(self.names)):
                good, bad = mass.get((k, j, 1), 0.0), mass.get((k, j, -1), 0.0)
                self.good_votes[k][j] = (good + held * self.first[k][j]) / (good + bad + held)
        return max(abs(x - y) for x, y in zip(old, [*self.shares, *(x for row in self.good_votes for x in row)]))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _pairs(row: list[float]) -> Column:
    return F.array(*(F.struct(F.lit(log(x)).alias("good"), F.lit(log(1 - x)).alias("bad")) for x in row))


def learn(votes: DataFrame, names: list[str], rounds: int = 30, pseudo: float = 5.0) -> Model:
    """Fit the kinds' shares and the rules' accuracies to all documents' votes."""
    model = Model(names, pseudo)
    counted = votes.groupBy("votes").agg(F.count(F.lit(1)).alias("n"))
    counted = materialise(counted.coalesce(1), "votes")
    for _ in range(rounds):
        if model.fit(counted) < 1e-3:
            break
    return model


def judge(documents: DataFrame, threshold: float = 0.5, more_rules: dict[str, Column] | None = None, **options) -> DataFrame:
    """doc_id, the base figures, base_failed, votes, posterior and kept, for every row of ``documents``.

    ``more_rules`` vote too (1, 0, -1, from the columns of ``features``); they are against no kind in particular.
    """
    ruled = rules() | (more_rules or {})
    rated = materialise(features(documents).withColumn("votes", F.array(*ruled.values())), "rated")
    model = learn(rated, list(ruled), **options)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    out = rated.withColumn("posterior", model.posteriors()[0]).withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))


def query(spark, sf_dir: str) -> DataFrame:
    """op5: figures and verdict for every document."""
    out = judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("posterior", 6).alias("posterior"))
