r"""Personal data, and terms that reveal it, with DataFrame functions only.

Patterns find e-mail addresses, IP addresses, payment cards and telephone numbers; each kind's matches are leftmost and do not
overlap one another, and a match that fails its test is dropped. Patterns are written so that matching takes time in
proportion to the text: a match begins at the start of a run of its characters, or where the last one ended.

Information-theoretic sanitisation. A protected entity is a value that a pattern found; or what such values have in
common: an e-mail address's domain, the first half of an IP address, a card's first six digits, a telephone number without its last seven
digits; or a kind of value; or personal data at all. Each document that holds a value holds all four. A term is a lower-cased word
without punctuation at its ends, of two characters or more with a letter, anywhere in a document with the entity.
From counts of documents, the information of the entity is IC(e) = log(N / n(e)) and what the term tells of
it is PMI(t; e) = log(N n(t, e) / (n(t) n(e))). The term reveals the entity if PMI >= ``alpha`` IC on enough evidence: at least
``support`` different texts have the two together, so that copies of one text are no evidence, and so many that of all pairs of
an entity and a term in question not more than ``chance`` would have them by chance (by Chernoff's bound on the binomial tail, scaled down
by the part of the documents that are different texts). A value that one text alone has can't be told by
counts; its group and its kind can. All documents count towards n(t). In documents with the entity, every occurrence of such a term is
a span of kind ``term``, unless it touches a pattern's match, which it then is part of.

Counts are combined before each shuffle. Texts with a match are kept aside when they are scanned, once for all copies of a text; no other text
is moved. Words of texts that have a revealing term are placed as rows, so a text's length costs no more than in proportion.
Terms in question are sent to all tasks while they are ``most_terms`` or fewer, and else meet the documents' terms by a shuffle; the rows are the same.

Null texts are empty. Offsets are code points, ends exclusive. Rows are told apart by id and text; repeated rows have equal rows each.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomery.llm.storage import materialise

KINDS = ("email", "ip", "card", "phone", "term")
#: Kinds in the order of KINDS: pattern, and what a text must have for it to be tried.
PATTERNS = (
    (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "."),
    (r"[0-9](?:[\x20-]?[0-9])++", None),
    (r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
)
WORD = r"[^\x20\x09-\x0D]+"
_EDGE = r"[\p{L}\p{N}]"


def _folded(items: Column, kind: str, one) -> Column:
    """Array of what ``one`` makes of each item and of the place reached: one(at, item) gives (new item, new place).

    Arrays grow at the cost of copying them, so items are taken in stretches of about the square root of their number.
    """

    def over(all_: Column) -> Column:
        size = F.size(all_)
        step = F.ceil(F.sqrt(F.greatest(size, F.lit(1)).cast("double"))).cast("int")
        none = F.array().cast(f"array<{kind}>")

        def item(acc: Column, x: Column) -> Column:
            new, at = one(acc["at"], x)
            return F.struct(F.concat(acc["out"], F.array(new)).alias("out"), at.alias("at"))

        def stretch(acc: Column, i: Column) -> Column:
            part = F.slice(all_, i * step + 1, F.least(step, size - i * step))
            got = F.aggregate(part, F.struct(none.alias("out"), acc["at"].alias("at")), item)
            return F.struct(F.concat(acc["out"], F.array(got["out"])).alias("out"), got["at"].alias("at"))

        stretches = F.sequence(F.lit(0), F.ceil(size / step).cast("int") - 1)
        start = F.struct(F.array().cast(f"array<array<{kind}>>").alias("out"), F.lit(0).alias("at"))
        return F.when(size > 0, F.aggregate(stretches, start, stretch, lambda acc: F.flatten(acc["out"]))).otherwise(none)

    return F.transform(F.array(items), over)[0]  # binds the items to a name


def _found(text: Column, pattern: str) -> Column:
    """Array of (s, e, v): start, end and text of all matches. Matches and what lies between them alternate."""
    pairs = F.zip_with(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1), lambda v, g: F.struct(v.alias("v"), F.length(v).alias("n"), F.length(g).alias("gap")))
    # the last pair is the rest of the text
    pairs = F.transform(F.array(pairs), lambda p: F.slice(p, 1, F.size(p) - 1))[0]

    def one(at: Column, x: Column) -> tuple[Column, Column]:
        s = at + x["gap"]
        return F.struct(s.alias("s"), (s + x["n"]).alias("e"), x["v"].alias("v")), s + x["n"]

    return _folded(pairs, "struct<s:int,e:int,v:string>", one)


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _passes(kind: int, v: Column) -> Column:
    if KINDS[kind] == "ip":
        return v.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|$)){4}")
    if KINDS[kind] == "card":
        return F.length(_digits(v)).between(14, 19) & F.call_function("luhn_check", _digits(v))
    if KINDS[kind] == "phone":
        return F.length(_digits(v)).between(10, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """Array of (s, k, e, v) of the patterns' matches, by start, then kind."""
    return F.array_sort(F.concat(*(_spans_of(text, kind) for kind in range(len(PATTERNS)))))


def _spans_of(text: Column, kind: int) -> Column:
    pattern, sign = PATTERNS[kind]
    spans = F.filter(_found(text, pattern), lambda x: _passes(kind, x["v"]))
    spans = F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(kind).alias("k"), x["e"].alias("e"), x["v"].alias("v")))
    tried = F.contains(text, F.lit(sign)) if sign else F.lit(True)
    if KINDS[kind] in ("ip", "card"):
        tried = tried & text.rlike(r"[0-9]\.[0-9]" if KINDS[kind] == "ip" else r"[0-9][\x20-]?[0-9]")
    return F.when(tried, spans).otherwise(F.array().cast("array<struct<s:int,k:int,e:int,v:string>>"))


def written(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    name = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat(F.element_at(name, x["k"] + 1), F.lit(":"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string"))), ",")


def _stripped(word: Column) -> Column:
    return F.regexp_replace(word, rf"^(?!{_EDGE})[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$", "")


def _terms(words: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(words, lambda w: F.lower(_stripped(w))), lambda t: (F.length(t) >= 2) & t.rlike(r"\p{L}")))


def _entities(x: Column) -> Column:
    """What a span stands for: its value, its group, its kind, and personal data at all."""
    kind, digits = x["k"].cast("string"), _digits(x["v"])
    email, ip, card = (x["k"] == i for i in range(3))
    value = F.when(email, F.lower(x["v"])).when(ip, x["v"]).otherwise(digits)
    group = F.when(email, F.substring_index(F.lower(x["v"]), "@", -1)).when(ip, F.substring_index(x["v"], ".", 2)).when(card, F.substring(digits, 1, 6)).otherwise(F.regexp_replace(digits, ".{7}$", ""))
    return F.array(F.concat(F.lit("value:"), kind, F.lit(":"), value), F.concat(F.lit("group:"), kind, F.lit(":"), group), F.concat(F.lit("kind:"), kind), F.lit("any"))


def find_private(documents: DataFrame, alpha: float = 0.75, support: int = 3, chance: float = 0.1, most_terms: int = 400_000) -> DataFrame:
    """(doc_id, base, spans, sanitised) of every row of ``documents`` (doc_id, text).

    base, spans: arrays of (s, k, e), without and with terms; k is the place in KINDS. sanitised: the text with each
    span, or union of overlapping ones, replaced by the kind of the first in angle brackets; null if it has none.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # texts without a match are not needed again
    seen = docs.withColumn("base", base_spans(F.col("text"))).withColumn("print", F.xxhash64("text"))
    seen = materialise(seen.withColumn("text", F.when(F.size("base") > 0, F.col("text"))), "private-spans")
    held = seen.filter(F.size("base") > 0)
    total = float(max(seen.count(), 1))

    # texts with their entities, those that enough different texts have; copies of a text are only counted
    whole = materialise(held.groupBy("print").agg(F.first("text").alias("text"), F.first("base").alias("base"), F.count(F.lit(1)).alias("rows")), "private-texts")
    near = whole.select("print", "rows", F.explode(F.array_distinct(F.flatten(F.transform("base", _entities)))).alias("entity"))
    sizes = near.groupBy("entity").agg(F.sum("rows").alias("n_e"), F.count(F.lit(1)).alias("texts"))
    entities = materialise(sizes.filter((F.col("texts") >= support) & (F.col("n_e") < total)).select("entity", "n_e"), "entities")
    near = materialise(near.join(entities, "entity"), "entity-texts")
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    rows = near.join(whole.select("print", _terms(words).alias("terms")), "print").select("print", "entity", "n_e", "rows", F.explode("terms").alias("term"))
    pairs = rows.groupBy("entity", "n_e", "term").agg(F.sum("rows").alias("n_te"), F.count(F.lit(1)).alias("texts")).filter(F.col("texts") >= support)
    pairs = materialise(pairs, "term-pairs")

    # in how many documents those terms are at all
    asked = materialise(pairs.select("term").distinct(), "terms-asked")
    n_pairs = pairs.count()
    all_terms = docs.select(F.explode(_terms(F.array_distinct(F.split("text", r"[\x20\x09-\x0D]+")))).alias("term"))
    if asked.count() <= most_terms:  # other terms go before the shuffle; this many fit everywhere
        all_terms = all_terms.join(F.broadcast(asked), "term", "left_semi")
    sizes = all_terms.groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    n = lambda c: F.col(c).cast("double")
    ic = F.log(F.lit(total) / n("n_e"))
    told = pairs.join(sizes, "term").withColumn("n_t", F.greatest(n("n_t"), n("n_te"))).withColumn("q", n("n_te") / F.col("n_t"))
    pmi = F.log(F.col("q")) + ic
    other = F.when(F.col("q") < 1, (1 - F.col("q")) * F.log((1 - F.col("q")) / (1 - n("n_e") / F.lit(total)))).otherwise(0.0)
    sure = F.col("n_t") * (F.col("q") * pmi + other) * n("texts") / n("n_te") >= log(max(n_pairs, 1) / chance)
    revealing = materialise(told.filter((pmi >= alpha * ic) & sure).select("entity", "term"), "revealing")

    # places of revealing terms in texts with the entity; rows of (text, word), so that no text is searched term by term
    marks = materialise(rows.select("print", "entity", "term").join(revealing, ["entity", "term"]).select("print", "term").distinct(), "marks")
    marked = whole.join(marks.select("print").distinct(), "print", "left_semi")
    placed = marked.select("print", F.explode(_found(F.col("text"), WORD)).alias("w"))
    lead = F.length(F.regexp_extract(F.col("w.v"), r"^[^\p{L}\p{N}]*", 0))
    placed = placed.select("print", F.lower(_stripped(F.col("w.v"))).alias("term"), (F.col("w.s") + lead).alias("s"), F.lit(len(PATTERNS)).alias("k"), (F.col("w.s") + lead + F.length(_stripped(F.col("w.v")))).alias("e"))
    placed = placed.join(marks, ["print", "term"], "left_semi").select("print", "s", "k", "e")
    both = placed.unionAll(marked.select("print", F.explode("base").alias("x")).select("print", "x.s", "x.k", "x.e"))
    # patterns' matches that begin before, and that begin after
    order = W.partitionBy("print").orderBy("s", "k")
    is_base = F.col("k") < len(PATTERNS)
    both = both.withColumn("last", F.max(F.when(is_base, F.col("e"))).over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    both = both.withColumn("next", F.min(F.when(is_base, F.col("s"))).over(order.rowsBetween(W.currentRow, W.unboundedFollowing)))
    free = is_base | ((F.coalesce("last", F.lit(0)) <= F.col("s")) & (F.col("next").isNull() | (F.col("next") >= F.col("e"))))
    spans = both.filter(free).groupBy("print").agg(F.array_sort(F.collect_list(F.struct("s", "k", "e"))).alias("all_spans"))

    base = F.transform("base", lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))
    some = held.select("doc_id", "text", base.alias("base"), "print").join(materialise(spans, "spans"), "print", "left")
    some = some.select("doc_id", "text", "base", F.coalesce("all_spans", "base").alias("spans"))
    rest = seen.filter(F.size("base") == 0).select("doc_id", "text", base.alias("base"), base.alias("spans"))
    return some.unionAll(rest).select("doc_id", "base", "spans", sanitised(F.col("text"), F.col("spans")).alias("sanitised"))


def sanitised(text: Column, spans: Column) -> Column:
    """The text with spans replaced by their kinds; null where a text has none."""
    name = F.array(*(F.lit(f"<{k.upper()}>") for k in KINDS))

    def over(chars: Column) -> Column:
        part = lambda s, e: F.array_join(F.slice(chars, s + 1, F.greatest(e - s, F.lit(0))), "")
        one = lambda at, x: (F.when(x["s"] >= at, F.concat(part(at, x["s"]), F.element_at(name, x["k"] + 1))).otherwise(""), F.greatest(at, x["e"]))
        last = F.array_max(F.transform(spans, lambda x: x["e"]))
        return F.concat(F.array_join(_folded(spans, "string", one), ""), part(last, F.size(chars)))

    chars = F.when(F.size(spans) > 0, F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)))
    return F.when(F.size(spans) > 0, F.transform(F.array(chars), over)[0])


def query(spark, sf_dir: str) -> DataFrame:
    """op6: what is private in every document."""
    out = find_private(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["k"] == kind)).cast("long")
    count_terms = F.size(F.filter("spans", lambda x: x["k"] == len(PATTERNS))).cast("long")
    return out.select(
        "doc_id", *(count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:4])), F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"),
        F.size("spans").cast("long").alias("n_spans"), count_terms.alias("n_terms"),
    )
