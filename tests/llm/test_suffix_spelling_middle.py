"""Suffix-array deduplication, spelling variants and fill-in-middle examples against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomery.llm import fill_in_middle, spelling, suffix_dedup
from loomery.llm.elias_fano import EliasFano, encode

SCHEMA = "doc_id long, text string, key long, id string, n long, word string, ranges string"  # with names that operators use inside
PASSAGE = "".join(random.Random(7).choice("abcdefgh ij.é") for _ in range(420))


def table(spark, rows, parts=3):
    return spark.createDataFrame([(d, t, 1, "x", 2, "y", "z") for d, t in rows], SCHEMA).repartition(parts)


def noise(rng, n):
    return "".join(rng.choice("abcdefghijklmnop qrstuvw\nxyzé中\U0001f600") for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = [(i, noise(rng, rng.randint(0, 500))) for i in range(25)]
    out += [(100 + i, noise(rng, 90) + PASSAGE[i * 10 :] + noise(rng, 90)) for i in range(5)]  # the same passage, cut off at the front
    out += [(110, PASSAGE[:199]), (111, PASSAGE[:200]), (112, PASSAGE), (113, PASSAGE + PASSAGE)]
    near = noise(rng, 2000)
    out += [(120, near), (121, near[:900] + "#" + near[901:]), (122, near[:300] + near[700:])]
    out += [(130, "-" * 700), (131, "ab" * 300), (132, "ab" * 101), (133, "x" * 199 + "y" + "x" * 199)]
    out += [(140, None), (141, ""), (142, "short"), (None, PASSAGE[50:]), (None, None), (120, near), (120, "other text with the id of another " * 9)]
    return out


def plain_suffixes(rows, w):
    texts = [(t or "").encode() for _, t in rows]
    times = Counter(t[i : i + w] for t in texts for i in range(len(t) - w + 1))
    out = []
    for (d, _), t in zip(rows, texts):
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - w + 1):
            if times[t[i : i + w]] > 1:
                gone[i : i + w] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((d, len(t), len(t) - len(kept), spans, kept))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("w", "k", "share", "most", "parts"), [(200, 16, 0.005, 100_000, 3), (200, 16, 0.0, 5, 1), (40, 8, 0.005, 100_000, 4), (300, 16, 0.005, 100_000, 2)])
def test_suffixes(spark, rows, w, k, share, most, parts):
    got = suffix_dedup.dedup_suffixes(table(spark, rows, parts), w, k, share=share, most_pieces=most).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got), key=repr) == plain_suffixes(rows, w)


def test_suffixes_of_nothing_and_of_long_texts(spark):
    assert suffix_dedup.dedup_suffixes(table(spark, [])).count() == 0
    rng = random.Random(5)
    long = noise(rng, 30_000)
    rows = [(1, long + PASSAGE + long[:5000]), (2, noise(rng, 9000) + PASSAGE)]
    offsets = np.cumsum([0, *(len(t.encode()) for _, t in rows)])
    cut = list(suffix_dedup.segments(offsets, 200, 4096))
    assert len(cut) > 10 and all(b[-1] - b[0] <= 2 * 4096 + 199 for _, b, _ in cut)
    windows = sorted((i + j, int(p) - int(b[j]) + at * (j == 0)) for i, b, at in cut for j in range(len(b) - 1) for p in range(int(b[j]), int(b[j + 1]) - 199))
    assert windows == sorted((i, p) for i in range(2) for p in range(int(offsets[i + 1] - offsets[i]) - 199))
    got = suffix_dedup.dedup_suffixes(table(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got), key=repr) == plain_suffixes(rows, 200)


def test_rounds_are_the_collections_suffix_order():
    rng = random.Random(2)
    docs = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 9))) for _ in range(40)]
    left = np.array([rng.randint(0, 4) for _ in docs])
    right = left + np.array([len(d) for d in docs]) - 1
    columns = np.zeros((14, len(docs)), np.uint8)
    for i, d in enumerate(docs):
        columns[left[i] : right[i] + 1, i] = list(d)
    for c, order, symbols, common in suffix_dedup.suffix_rounds(columns, left, right, 200, 13):
        suffixes = [docs[i][c - left[i] :] for i in order]
        assert suffixes == sorted(suffixes) and sorted(order) == [i for i in range(len(docs)) if left[i] <= c <= right[i]]
        assert symbols.tolist() == [s[0] for s in suffixes]
        for a, b, n in zip(suffixes, suffixes[1:], common[1:]):
            assert n == next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))


def plain_spelling(rows, shortest, least, times):
    n = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'null' if d is None else d}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= shortest and c >= least}

    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        return a != b and (sum(x != y for x, y in zip(a, b)) == 1 if len(a) == len(b) else len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b))))

    beside = {w: [v for v in n if near(w, v)] for w in n}
    form = {w: min(v, key=lambda x: (-n[x], x)) if v else None for w, v in beside.items()}
    form = {w: f if f and n[f] >= times * n[w] else None for w, f in form.items()}
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(beside[w]), n[form[w]] if form[w] else None))
    return sorted(out)


@pytest.fixture(scope="module")
def words():
    rng = random.Random(11)
    stems = ["garden", "gardens", "kitchen", "Straße", "naïve", "hammer", "mississippi", "aaaaa", "aaaaaaa", "ÀÉÿabc", "x" * 300, "ababab", "abababab"]

    def bent(w):
        at, new = rng.randrange(len(w)), rng.choice("abcdefghimnsté")
        return rng.choice([w[:at] + w[at + 1 :], w[:at] + new + w[at + 1 :], w[:at] + new + w[at:]])

    pool = [*stems * 12, *(bent(w) for w in stems for _ in range(12)), *(bent(bent(w)) for w in stems for _ in range(6))]
    out = [(i, " ".join(rng.choice(pool) + rng.choice(["", ",", "1", "."]) for _ in range(60))) for i in range(70)]
    return [*out, (None, out[0][1]), (3, None), (4, ""), (5, "Garden GARDEN garden"), (5, "Garden GARDEN garden")]


def test_spelling(spark, words):
    for least, times in ((3, 2), (1, 1.0001)):
        got = sorted(tuple(r) for r in spelling.spelling_variants(table(spark, words), least=least, times=times).select("word", "form", "root", "n", "n_near", "form_n").collect())
        want = plain_spelling(words, 5, least, times)
        assert got == want and sum(r[4] for r in want) > 100 and any(r[1] and r[2] != r[1] for r in want)
    assert spelling.spelling_variants(table(spark, [])).count() == 0
    assert spelling.spelling_variants(table(spark, [(1, "rare words only here")])).count() == 0
    with pytest.raises(ValueError, match="five letters"):
        spelling.spelling_variants(table(spark, []), shortest=4)


def test_near_words_meet(words):
    """Any word asks for a key that each near word has, whatever the order of bigrams."""
    rng = random.Random(1)
    for _ in range(400):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(5, 9)))
        at, new = rng.randrange(len(a)), rng.choice("abc")
        b = rng.choice([a[:at] + new + a[at + 1 :], a[:at] + new + a[at:]])
        if a == b:
            continue
        grams = [x + y for x in "abc" for y in "abc"]
        rng.shuffle(grams)
        ranks = {g: i for i, g in enumerate(grams)}
        assert spelling.meeting_keys(a, ranks, True) & spelling.meeting_keys(b, ranks, False), (a, b)


def test_middles(spark):
    rng = random.Random(6)
    texts = [noise(rng, rng.randint(1, 300)) for _ in range(60)] + [None, "", "a", "with <P> inside", "<M>", "a<S>", "<" * 9, "S><P", "tail <S"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, texts[0]) for i in range(300)] + [(None, texts[1]), (7, texts[7]), (7, "another text")]
    for hot in (1000, 20):
        out = fill_in_middle.fill_in_middle(table(spark, rows), hot_rows=hot).withColumn("again", fill_in_middle.restored(F.col("output"), F.col("form"))).collect()
        assert Counter(r.doc_id for r in out) == Counter(d for d, _ in rows) and {r.form for r in out} == {"plain", "psm", "spm"}
        want = []
        for d, t in rows:
            t = t or ""
            h = hashlib.sha256(f"1:{'null' if d is None else d}".encode()).hexdigest()
            one, two, form, order = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
            a, z = sorted((one % (len(t) + 1), two % (len(t) + 1)))
            if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or form % 100 >= 90:
                want.append((d, len(t), "plain", None, None, t, t))
            elif order % 100 < 20:
                want.append((d, len(t), "spm", a, z - a, f"<S>{t[z:]}<P>{t[:a]}<M>{t[a:z]}", t))
            else:
                want.append((d, len(t), "psm", a, z - a, f"<P>{t[:a]}<S>{t[z:]}<M>{t[a:z]}", t))
        assert sorted(map(tuple, out), key=repr) == sorted(want, key=repr)
    assert fill_in_middle.fill_in_middle(table(spark, [])).count() == 0


def test_elias_fano():
    rng = random.Random(8)
    for _ in range(200):
        n, most = rng.randint(1, 200), rng.choice([0, 7, 300, 10_000])
        values = np.sort(np.array([rng.randint(0, most) for _ in range(n)]))
        data = encode(values, most)
        assert (EliasFano(data).select(np.arange(n)) == values).all()
        assert len(data) <= 18 + n * (3 + max(0, (most // n).bit_length())) / 8 + 1


@pytest.mark.parametrize("name", ["op11_suffix_dedup", "op12_spelling", "op13_fill_in_middle"])
def test_queries_have_sql(name):
    from loomery.llm.queries import oracle_sql, queries

    assert name in queries() and name in oracle_sql()
