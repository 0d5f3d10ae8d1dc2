"""Results that leave nothing out, each held against a plain count."""

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from loomery.llm import decontaminate, lm_scoring, pii, warc

WORDS = [a + b for a in "ba ce di fo gu la me ni po ru".split() for b in "ba ce di fo gu la me ni po ru".split()]


def leaks(docs, items, least=11):
    """(doc, item): (n_windows, overlap_words) by comparing all windows with all windows."""
    span, found = decontaminate.SPAN, {}
    for d, t in docs:
        w = t.lower().split()
        for start in range(len(w) - span + 1):
            for i, other in items:
                v = other.lower().split()
                for at in range(len(v) - span + 1):
                    if sum(a == b for a, b in zip(w[start : start + span], v[at : at + span])) >= least:
                        found.setdefault((d, i), []).append(start)
    return {k: (len(set(v)), len({p for s in v for p in range(s, s + span)})) for k, v in found.items()}


def found_leaks(spark, docs, items, **options):
    got = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), **options).collect()
    assert len({(r.doc_id, r.item_id) for r in got}) == len(got)
    return {(r.doc_id, r.item_id): (r.n_windows, r.overlap_words) for r in got}


def test_every_two_substitutions_are_found(spark):
    rng = random.Random(8)
    passage = rng.sample(WORDS, 13)
    docs = []
    for k, places in enumerate(itertools.combinations(range(13), 2)):
        docs.append((k, " ".join(f"other{k}" if i in places else w for i, w in enumerate(passage))))
    docs += [(100 + k, " ".join("other" if i in rng.sample(range(18), 3) else w for i, w in enumerate(rng.sample(WORDS, 18)))) for k in range(20)]
    items = [(1, " ".join(passage)), *((10 + k, " ".join(rng.sample(WORDS, 18))) for k in range(20))]
    for k in range(40):  # three words of 14 to 20 substituted
        text = rng.sample(WORDS, rng.randint(14, 20))
        items.append((200 + k, " ".join(text)))
        for i in rng.sample(range(len(text)), 3):
            text[i] = "changed"
        docs.append((200 + k, " ".join(text)))
    docs.append((300, " ".join("changed" if i in (0, 5, 9) else w for i, w in enumerate(passage))))
    want = leaks(docs, items)
    assert len(want) > 90 and (300, 1) not in want
    for most in (400_000, 500):  # seeds sent to all tasks, and met by a shuffle
        assert found_leaks(spark, docs, items, most_seeds=most) == want


def test_items_that_share_windows_are_all_found(spark):
    rng = random.Random(9)
    passage, ends = " ".join(rng.sample(WORDS, 20)), [" ".join(rng.sample(WORDS, k)) for k in (15, 16, 17)]
    items = [(1, f"{passage} {ends[0]}"), (2, f"{ends[1]} {passage}"), (3, passage), (4, passage), (5, ends[2]), (6, "one two three four five six"), (7, "one two three four five six")]
    docs = [(1, f"intro {passage} end"), (2, f"{ends[0]} and {passage}"), (3, ends[1]), (4, "so one two three four five six"), (5, items[0][1]), (6, "none of these")]
    want = leaks(docs, items)
    assert {i for d, i in want if d == 1} == {1, 2, 3, 4}
    want |= {(4, 6): (1, 6), (4, 7): (1, 6)}  # whole short items
    for most in (400_000, 20):  # seeds sent to all tasks, and met by a shuffle
        assert found_leaks(spark, docs, items, most_seeds=most) == want


def test_short_items_and_repeated_windows(spark):
    rng = random.Random(16)
    items = [(n, " ".join(rng.sample(WORDS, n))) for n in range(1, 13)]
    twice = " ".join(rng.sample(WORDS, 14))
    items.append((20, f"{twice} between {twice}"))
    docs = [(20, f"so {twice} ends")]
    for n, t in items[:12]:
        docs.append((n, f"before {t} after"))
        w = t.split()
        w[n // 2] = "changed"
        docs.append((100 + n, f"before {' '.join(w)} after"))
    want = {(n, n): (1, n) for n in range(5, 13)} | {(100 + n, n): (1, n) for n in range(8, 13)} | leaks(docs[:1], items[-1:])
    for most in (400_000, 3):
        assert found_leaks(spark, docs, items, most_seeds=most) == want
    assert (3, 3) in found_leaks(spark, docs, items, shortest=1)


def test_overlap_is_what_the_document_has(spark):
    rng = random.Random(17)
    ends, middle = " ".join(rng.sample(WORDS, 13)), " ".join(f"inner{i}" for i in range(90))
    items = [(1, f"{ends} {middle} {ends}")]
    docs = [(1, f"so {ends} it is"), (2, items[0][1]), (3, f"{items[0][1]} and {items[0][1]}"), (4, f"{ends} but {ends}"), (5, middle[: middle.index(" inner30")])]
    for most in (400_000, 3):
        got = found_leaks(spark, docs, items, most_seeds=most)
        assert got == leaks(docs, items)
        # windows reach up to two words beyond what agrees, where a text goes on
        assert {d: n for (d, _), (_, n) in got.items()} == {1: 16, 2: 116, 3: 233, 4: 27, 5: 30}


def test_warc_records_with_long_urls_are_read(spark):
    rng = random.Random(10)
    urls = ["http://x/", "http://x/" + " " * 400_000, "http://x/" + "".join(chr(rng.randint(1, 0x2FF)) for _ in range(300_000)), "http://x/" + "é" * 70_000, None] * 3
    pages = spark.createDataFrame([(i, u, f"page {i % 9}") for i, u in enumerate(urls)], "page_id long, url string, html string").repartition(2)
    folder = warc.write_warc(pages)
    want = {i: u and re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", u) for i, u in enumerate(urls)}
    for split in (50_021, 16 << 20):
        got = warc.read_warc(spark, folder, split).select("page_id", "target_uri", "payload_bytes").collect()
        assert len(got) == len(urls) and {r.page_id: r.target_uri for r in got} == want and all(r.payload_bytes == 6 for r in got)


def private(spark, docs):
    got = pii.find_private(spark.createDataFrame(docs, "doc_id long, text string")).withColumn("w", pii.written(F.col("spans"))).collect()
    return {r.doc_id: r.w.split(",") for r in got}


def test_terms_far_from_an_entity_reveal_it(spark):
    rng = random.Random(11)
    some = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    told = [(i, f"Rumpel, {some(200 + i)} who@there.org {some(5)}") for i in range(2)]  # far in half of the documents, near in the others
    told += [(2 + i, f"{some(200)} Rumpel, {some(1)} who@there.org {some(400)}") for i in range(2)]
    told += [(4 + i, f"{some(30)} who@there.org {some(400)} Rumpel.") for i in range(2)]
    got = private(spark, told + [(10 + i, some(40)) for i in range(60)])
    for d, t in told:
        a = t.index("Rumpel")
        assert f"term:{a}:{a + 6}" in got[d]
    assert not any(x.startswith("term") for d in got if d >= 10 for x in got[d])


def test_forms_of_a_term_are_one_term_of_a_document(spark):
    rng = random.Random(12)
    some = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    told = [(i, f"{some(5)} Alice, alice. (ALICE) who@there.org {some(10 + i)}") for i in range(4)]
    others = [(10 + i, some(40)) for i in range(60)]
    for most in (400_000, 0):  # terms sent to all tasks, and joined by a shuffle
        df = spark.createDataFrame(told + others, "doc_id long, text string")
        got = {r.doc_id: r.w.split(",") for r in pii.find_private(df, most_terms=most).withColumn("w", pii.written(F.col("spans"))).collect()}
        for d, t in told:
            assert all(f"term:{t.index(x)}:{t.index(x) + 5}" in got[d] for x in ("Alice", "alice", "ALICE"))


def spans_by_hand(docs, alpha=0.75, support=3, chance=0.1):
    """Spans of all documents by the rules of the operator, text by text."""
    kinds = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    digits = lambda v: re.sub("[^0-9]", "", v)

    def good(kind, v):
        d = digits(v)
        if kind == "ip":
            return all(int(x) <= 255 for x in v.split("."))
        if kind == "card":
            odd = [int(c) for c in d[::-1]]
            return 14 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(odd)) % 10 == 0
        return kind != "phone" or 10 <= len(d) <= 15

    def names(kind, v):
        d = digits(v)
        group = {"email": v.lower().split("@")[-1], "ip": ".".join(v.split(".")[:2]), "card": d[:6], "phone": d[:-7]}[kind]
        return {("value", kind, v.lower() if kind == "email" else v if kind == "ip" else d), ("group", kind, group), ("kind", kind), ("any",)}

    order, base, entities, terms = list(kinds), {}, {}, {}
    strip = lambda w: re.fullmatch(r"(?s)([\W_]*)(.*?)([\W_]*)", w).groups()
    for d, t in docs:
        base[d] = sorted((m.start(), order.index(k), m.end(), m[0]) for k, p in kinds.items() for m in re.finditer(p, t) if good(k, m[0]))
        entities[d] = set().union(*(names(order[k], v) for _, k, _, v in base[d]))
        terms[d] = {w for w in (strip(w)[1].lower() for w in re.findall(r"[^\x20\x09-\x0D]+", t)) if len(w) >= 2 and any(c.isalpha() for c in w)}
    text, n = dict(docs), len(docs)
    n_t = lambda t: sum(t in x for x in terms.values())
    together = {}
    for d in base:
        for e in entities[d]:
            for t in terms[d]:
                together.setdefault((e, t), []).append(d)
    together = {k: v for k, v in together.items() if len({text[d] for d in v}) >= support}
    revealing = set()
    for (e, t), ds in together.items():
        n_e = sum(e in x for x in entities.values())
        ic, q = math.log(n / n_e), len(ds) / n_t(t)
        gain = n_t(t) * (q * math.log(q * n / n_e) + ((1 - q) * math.log((1 - q) / (1 - n_e / n)) if q < 1 else 0))
        if math.log(q) + ic >= alpha * ic - 1e-12 and gain * len({text[d] for d in ds}) / len(ds) >= math.log(len(together) / chance):
            revealing.add((e, t))
    out = {}
    for d, t in docs:
        found = []
        for m in re.finditer(r"[^\x20\x09-\x0D]+", t):
            head, core, _ = strip(m[0])
            s, e = m.start() + len(head), m.start() + len(head) + len(core)
            if any((x, core.lower()) in revealing for x in entities[d]) and core.lower() in terms[d] and not any(a < e and s < b for a, _, b, _ in base[d]):
                found.append((s, 4, e))
        out[d] = [f"{[*order, 'term'][k]}:{s}:{e}" for s, k, e in sorted([x[:3] for x in base[d]] + found)]
    return out


def test_spans_equal_a_plain_version(spark):
    rng = random.Random(15)
    some = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    told = [(i, f"{some(9)} Mailto, {some(3)}: user{i}@mail{i % 3}.example.org. {some(3)} (kontakt) {some(8)}") for i in range(9)]
    told += [(20 + i, f"Dial: +1 (416) 555-10{i:02d} {some(4)} or 10.7.{i}.{i + 9} {some(9)} ssh:10.7.3.4 kontakt") for i in range(6)]
    told += [(30 + i, f"card 4111 1111 1111 1111 {some(9)} 4111111111111112 kontakt") for i in range(4)] + [(40, told[0][1]), (41, "x@y.z " * 3000), (42, "")]
    docs = told + [(100 + i, some(rng.randint(1, 40)) + (" kontakt" if i == 5 else "")) for i in range(200)]
    want = spans_by_hand(docs)
    assert sum(x.startswith("term") for v in want.values() for x in v) > 15
    got = {r.doc_id: r for r in pii.find_private(spark.createDataFrame(docs, "doc_id long, text string")).withColumn("w", pii.written(F.col("spans"))).collect()}
    for d, t in docs:
        assert got[d].w == ",".join(want[d]), d
        at, out = 0, ""
        for kind, s, e in (x.split(":") for x in want[d]):
            if int(s) >= at:
                out += t[at : int(s)] + f"<{kind.upper()}>"
            at = max(at, int(e))
        assert got[d].sanitised == (out + t[at:] if want[d] else None)


def test_keys_in_the_order_of_buckets_stand_for_their_pairs():
    pairs = np.random.default_rng(3).integers(0, 1 << 64, 5000, np.uint64)
    for buckets in (32, 4096):
        keys = lm_scoring.in_buckets(pairs, buckets)
        assert (lm_scoring.out_of_buckets(keys, buckets) == pairs).all()
        assert (np.diff(lm_scoring.pair_bucket(pairs[np.argsort(keys)], buckets).astype(np.int64)) >= 0).all()


def test_a_model_of_any_size_reads_texts_once(spark):
    rng = random.Random(6)
    texts = [(i, " ".join(f"w{int(rng.paretovariate(0.5)) % 3000}" for _ in range(6000 if i % 50 else 60_000))) for i in range(200)]
    counts = Counter(w for i, t in texts if zlib.crc32(str(i).encode()) % 7 != 2 for w in [*t.split(), None])
    n = sum(counts.values())
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        read.add(1)
        return text

    # one task, and more tokens than a block has
    docs = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1).select("doc_id", seen("text").alias("text"))
    got = {r.doc_id: r for r in lm_scoring.lm_scores(docs, lm_scoring.remainder(F.col("doc_id"), 7) != 2, most_mb=0).collect()}
    assert read.value == len(got) == len(texts) and sum(r.n_tokens for r in got.values()) > lm_scoring.FLUSH
    for i, t in texts:
        words, r = [*t.split(), None], got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words), sum(w in counts for w in words), n)
        assert abs(r.base_score - sum(math.log10((counts[w] + 1) / (n + len(counts) + 1)) for w in words)) < 1e-6 * len(words)
