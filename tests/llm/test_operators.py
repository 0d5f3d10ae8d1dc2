import base64
import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomery.llm import decontaminate, jaccard_join, language_id, lm_scoring, mixing, pii, quality, storage, substring_dedup, token_files, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket string, word long"  # with names that operators use inside
LONG = " ".join(f"w{i % 4000}" for i in range(12_000))
WORDS = [f"{a}{b}" for a in "ba ce di fo gu la me ni po ru".split() for b in "ba ce di fo gu la me ni po ru".split()]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    base = sentence(rng, 80)
    near = base.split()
    near[40] = "changed"
    out = [(i, sentence(rng, rng.randint(1, 60)), rng.choice(["en", "de", None]), rng.choice(["a", "b", None]), 1, "x", 2) for i in range(40)]
    out += [(100, base, "en", "a", 1, "x", 2), (101, base, "en", "a", 1, "x", 2), (102, " ".join(near), "en", "b", 1, "x", 2), (103, "intro " + base, "de", "b", 1, "x", 2)]
    out += [(200, None, None, None, None, None, None), (201, "", "en", "a", 0, "x", 2), (202, " \n\t ", "en", "a", 0, "x", 2), (203, LONG, "en", "a", 1, "x", 2), (204, "one", "en", "a", 1, "x", 2)]
    out += [(100, base, "en", "a", 1, "x", 2), (None, base, "en", "a", 1, "x", 2), (None, "no id here", "en", None, 1, "x", 2), (205, "123 !!! ...", "en", "a", 1, "x", 2)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return [w.decode() for w in (text or "").encode().split()]


def test_substrings(docs, rows, empty):
    key = lambda d: -(1 << 63) if d is None else d
    first = {}
    for d, t, *_ in rows:
        w = words(t)
        for i in range(len(w) - 19):
            x = tuple(w[i : i + 20])
            first[x] = min(first.get(x, (1 << 63, 0)), (key(d), i))
    want = []
    for d, t, *_ in rows:
        w, gone = words(t), set()
        for i in range(len(w) - 19):
            if first[tuple(w[i : i + 20])] != (key(d), i):
                gone.update(range(i, i + 20))
        want.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    for options in ({}, {"hot_share": 0.0}, {"most_docs": 30, "hot_share": 1.0}):  # without and with split minimisers
        got = [tuple(r) for r in substring_dedup.dedup_substrings(docs, **options).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)
    assert substring_dedup.dedup_substrings(empty).count() == 0


def test_buckets_keep_their_size(spark):
    assert storage.buckets_for(spark.range(1 << 40)) == 1 << 21 and storage.buckets_for(spark.range(1 << 43)) == 1 << 24
    for total in (10, 10_000, 1 << 22, 1 << 36):
        rows, least = substring_dedup.sampling(total, 4000, 0.005, 300_000)
        assert least >= 20 and least * total / min(rows, total) <= max(20 * total / min(total, 4000), 300_000)
    assert substring_dedup.sampling(256_410, 4000, 0.005, 300_000) == (4000, 20)
    assert substring_dedup.sampling(1 << 36, 4000, 0.005, 300_000) == (-(-20 * (1 << 36) // 300_000), 20)


def test_minimisers_in_order_are_split(spark):
    rng = random.Random(6)
    shared = sentence(rng, 12)
    texts = spark.createDataFrame([(i, f"{sentence(rng, 15)} {shared} {sentence(rng, 15)}") for i in range(60)], "doc_id long, text string")
    hot = substring_dedup.hot_minimisers(texts, 20, 5, 4000, 0.005, 300_000)
    assert len(hot) and (np.diff(hot.astype(object)) > 0).all()
    h = np.array(rng.choices(range(1 << 30), k=60), np.uint64)
    first = np.array([0, 60])
    _, _, whole, key = substring_dedup.super_kmers(h, first, 20, 5, np.zeros(0, np.uint64))
    _, _, n, _ = substring_dedup.super_kmers(h, first, 20, 5, np.sort(key[1:2]))
    assert n.sum() == whole.sum() == 41 and (n == 1).sum() >= whole[1]


def grams(text):
    w = [x.lower() for x in words(text)]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@pytest.mark.parametrize("block", [96, 2])
def test_near_duplicates(docs, rows, empty, block):
    sets = [grams(t) for _, t, *_ in rows]
    linked = [[i != j and bool(a) and bool(b) and len(a & b) >= 0.8 * len(a | b) for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    got = {(r.doc_id, r.copy): r for r in jaccard_join.near_duplicates(docs, block=block).collect()}
    for i, (d, t, *_) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in np.flatnonzero(linked[todo.pop()]):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        r = got[d, hashlib.md5((t or "").encode()).hexdigest()]
        assert r.n_links == sum(linked[i]) and r.class_id == (min(ids) if ids else None), (d, r)
    # of the rows that are no copies of one another, one of each class is first
    assert sum(r.is_first for r in got.values()) == len({r.class_id if r.class_id is not None else r.copy for r in got.values()})
    kept = jaccard_join.keep_one_of_each(docs, block=block)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id is not None and 100 <= r.doc_id < 200) == [100]
    assert jaccard_join.near_duplicates(empty).count() == 0


def test_near_duplicates_without_ids(spark):
    rng = random.Random(17)
    base = sentence(rng, 90).split()
    texts = [" ".join("x" if i == k else w for i, w in enumerate(base)) for k in range(5)] + [sentence(rng, 30), sentence(rng, 30)]
    docs = spark.createDataFrame([(None, t, "a.b`c") for t in [*texts, texts[0]]], "doc_id long, text string, `a.b``c` string")
    got = jaccard_join.near_duplicates(docs, block=2).collect()
    assert len(got) == 8 and {r.class_id for r in got} == {None}
    assert sum(r.is_first for r in {r.copy: r for r in got}.values()) == 3 and sorted(r.n_links for r in got) == [0, 0] + [5] * 6
    kept = [r.text for r in jaccard_join.keep_one_of_each(docs, block=2).collect()]
    assert len(kept) == 3 and set(kept) >= set(texts[5:])


def test_bands_reach_the_recall():
    bands, rows = jaccard_join.choose_bands(0.8, 0.999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.999


def test_lm_scores(docs, rows, empty):
    train = lm_scoring.remainder(F.col("doc_id"), 7) != 2
    low = lambda t: [x.lower() for x in words(t)] + [None]
    counts = {}
    for d, t, *_ in rows:
        if zlib.crc32(str(d).encode() if d is not None else b"") % 7 != 2:
            for x in low(t):
                counts[x] = counts.get(x, 0) + 1
    n, v = sum(counts.values()), len(counts)
    want = sorted((d if d is not None else -1, len(low(t)), sum(x in counts for x in low(t)), round(sum(np.log10((counts.get(x, 0) + 1) / (n + v + 1)) for x in low(t)), 6)) for d, t, *_ in rows)
    scores = []
    for most in (64, 0):  # a filter that is broadcast; one that stays in its buckets
        got = lm_scoring.lm_scores(docs, train, most_mb=most).collect()
        assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
        assert all(r.train_tokens == n and r.score <= 0 for r in got)
        scores.append(sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, round(r.score, 8)) for r in got))
    assert all(x == scores[0] for x in scores)
    assert lm_scoring.lm_scores(empty, train).count() == 0


def test_filter_counts_never_fall_short():
    keys, levels = np.arange(1, 3000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), np.arange(1, 3000) % 9 + 1
    place = lm_scoring.pair_bucket(keys, 4)
    parts = [np.zeros(15_000 + 1000 * b, np.uint8) for b in range(4)]  # segments of any size
    for b in range(4):
        lm_scoring.set_bits(parts[b], keys[place == b], levels[place == b])
    f = lm_scoring.Filter(parts)
    got = f.levels(keys, place)
    assert (got >= levels).all() and (got == levels).mean() > 0.95


@pytest.mark.parametrize("least", [1, 2])
def test_scores_equal_a_plain_model_whose_probabilities_sum_to_one(spark, least):
    rng = random.Random(14)
    texts = [(i, " ".join(rng.choice(WORDS[:12]) if rng.random() < 0.8 else rng.choice(WORDS) for _ in range(rng.randint(0, 30)))) for i in range(150)]
    seen = [[*t.split(), "END"] for i, t in texts if zlib.crc32(str(i).encode()) % 7 != 2]
    single, pair = {}, {}
    for t in seen:
        for v, w in zip(["START", *t], t):
            single[w] = single.get(w, 0) + 1
            pair[v, w] = pair.get((v, w), 0) + 1
    values = lm_scoring.level_values(1.5)
    value = lambda c: values[int(lm_scoring.levels_of(np.array([c]), 1.5)[0])]
    u, all_ = (sum(c == 1 for c in single.values()) + 1) / (sum(single.values()) + 2), sum(map(value, single.values()))
    gain, rest = {}, {}
    for (v, _), c in pair.items():
        gain[v] = gain.get(v, 0) + (max(value(c) - 0.5, 0) if c >= least else 0)
        rest[v] = rest.get(v, 0) + (min(value(c), 0.5) if c >= least else c)

    def p(v, w):
        one = (1 - u) * value(single[w]) / all_ if w in single else u
        a = value(pair[v, w]) - 0.5 if pair.get((v, w), 0) >= least else 0
        return (a + rest[v] * one) / (gain[v] + rest[v]) if v in gain else one

    for v in ["START", "never", *single]:
        assert v == "END" or abs(sum(p(v, w) for w in [*single, "unseen"]) - 1) < 1e-6
    train = lm_scoring.remainder(F.col("doc_id"), 7) != 2
    table = spark.createDataFrame(texts, "doc_id long, text string")
    other = [(i, " ".join(rng.choice(WORDS[:20]) for _ in range(rng.randint(0, 40)))) for i in range(40)] + [(40, None), (41, "never seen before"), (42, "")]
    fitted = lm_scoring.fit(table, train, bits=400.0, pair_least=least)
    for r in lm_scoring.score(spark.createDataFrame(other, "doc_id long, text string").repartition(3), fitted).collect():  # texts that weren't there
        t = [*(other[r.doc_id][1] or "").split(), "END"]
        assert r.n_tokens == len(t) and abs(r.score - sum(np.log10(p(v, w)) for v, w in zip(["START", *t], t))) < 1e-6
    with pytest.raises(ValueError, match="may be broadcast"):
        lm_scoring.score(table, fitted, most_mb=0)
    for most in (64, 0):
        got = lm_scoring.lm_scores(table, train, bits=400.0, most_mb=most, pair_least=least).collect()
        for r in got:
            t = [*texts[r.doc_id][1].split(), "END"]
            assert abs(r.score - sum(np.log10(p(v, w)) for v, w in zip(["START", *t], t))) < 1e-6


def test_mixing(docs, rows, empty):
    got = mixing.mix(docs).collect()
    sizes = {}
    for r in got:
        assert r.copies in (0, 1, 2)
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    assert all(r.source_size == sizes[r.source] for r in got) and sum(sizes.values()) == sum(len(words(r[1])) for r in rows)
    targets = {r.source: r.target for r in got}
    assert abs(sum(targets.values()) - min(1.5, 2.0) * sum(sizes.values())) < 1e-6 and all(targets[s] <= 2 * sizes[s] + 1e-9 for s in sizes)
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mix(docs.repartition(5)).collect()), key=repr)
    copies = {}
    for r in got:
        copies[r.doc_id] = copies.get(r.doc_id, 0) + r.copies
    emitted = [r.doc_id for r in mixing.mixed(docs).collect()]
    assert {d: emitted.count(d) for d in copies} == copies
    assert mixing.mix(empty).count() == 0 == mixing.mixed(empty).count()


@pytest.mark.parametrize("few", [10_000, 3])
def test_targets_of_many_sources(spark, few):
    rng = random.Random(18)
    sizes = {f"site{i:04d}": rng.choice([0, rng.randint(1, 50), rng.randint(1, 5000)]) for i in range(900)} | {None: 77}
    order = [*sorted(s for s in sizes if s), None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    goal, target, free = 1.5 * sum(sizes.values()), {}, set(order)
    while free:
        level = (goal - sum(target.values())) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * sizes[s]}
        target |= {s: 2.0 * sizes[s] for s in over} if over else {s: level * weight[s] for s in free}
        free = free - over if over else set()
    df = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, source_size long, docs long")
    got = {r.source: r.target for r in mixing.targets(df, (3, 1, 2), 1.5, 2.0, few).collect()}
    assert got.keys() == target.keys() and all(abs(got[s] - target[s]) < 1e-6 for s in got)


def test_many_repeated_rows_share_their_copies(spark):
    rows = [(None, "the same words again", "a", i) for i in range(500)] + [(i, f"other text number {i}", "a", i) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, extra long").repartition(4)
    taken = sum(r.copies for r in mixing.mix(df).collect() if r.doc_id is None)
    got = [r.extra for r in mixing.mixed(df).collect() if r.doc_id is None]
    assert len(got) == taken and max(map(got.count, range(500))) - min(map(got.count, range(500))) <= 1


def test_extra_columns_with_any_name(spark, docs):
    """Names that operators used inside once, and names with dots and backticks, go through every operator that keeps rows."""
    names = ["id_of", "print", "copy", "copy_of", "_id", "_one", "_copies", "_rows", "_source", "_print", "_copy", "_turn", "words", "seed", "part", "node", "salt", "a.b", "c`d", "place", "component"]
    wide = docs.select("*", *(F.lit(i).alias(c) for i, c in enumerate(names)))
    items = spark.createDataFrame([(1, "nowhere to be found in any of these texts at all not even once more")], "item_id long, text string")
    model = language_id.train(wide, F.lit(True))
    for out in (decontaminate.remove_leaks(wide, items), jaccard_join.keep_one_of_each(wide), mixing.mixed(wide), language_id.keep_identified(wide, model)):
        assert out.columns == wide.columns
        row = out.first()
        assert [row[len(docs.columns) + i] for i in range(len(names))] == list(range(len(names)))
    for out in (decontaminate.find_leaks(wide, items), jaccard_join.near_duplicates(wide), mixing.mix(wide), lm_scoring.lm_scores(wide, F.lit(True)), quality.judge(wide), pii.find_private(wide), substring_dedup.dedup_substrings(wide), language_id.identify(wide, model)):
        out.collect()


def test_token_files(docs, rows, empty, spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(token_files.byte_bpe())
    rows = [*rows, (300, "a <|endoftext|> b", None, None, 1, "x", 2), (301, "x<|endoftext|>", None, None, 1, "x", 2), (302, f"{LONG} {LONG}", None, None, 1, "x", 2)]
    docs = docs.union(spark.createDataFrame(rows[-3:], SCHEMA))
    got, split = (sorted((tuple(r) for r in token_files.read_digests(spark, token_files.write_tokens(docs, token_files.byte_bpe, **options)).collect()), key=lambda r: r[1]) for options in ({}, {"file_bytes": 4000}))
    assert got == split
    assert [r[0] for r in got] == sorted((r[0] for r in rows), key=lambda d: (d is not None, d or 0))
    ids = [(d, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]) for d, t, *_ in rows]
    assert sorted((d if d is not None else -1, n, c) for d, _, n, c in got) == sorted((d if d is not None else -1, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for d, x in ids)
    assert all(a[1] + a[2] == b[1] for a, b in zip(got, got[1:])) and got[0][1] == 0
    assert token_files.read_digests(spark, token_files.write_tokens(empty, token_files.byte_bpe)).count() == 0


def test_pieces_give_the_ids_of_whole_texts():
    pieces = token_files.Pieces(token_files.byte_bpe(), False, most=60)
    rng = random.Random(1)
    parts = ["ab", "Cd", " ", "  ", "\n", " \n", "\t", ".", "...", "'s", "é", "É,", " ", "　", "​", "!!", "\r", "\x1c", "日本", "’t", "12", "12,5", "<|endoftext|>"]
    for _ in range(2000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))
        raw = text.encode()
        ids, sizes = pieces.ids(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        assert ids.tolist() == pieces.tokenizer.encode(text, add_special_tokens=False).ids and sizes.sum() == len(ids), repr(text)
    for _ in range(60):  # several texts together
        texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(0, 40))]
        raw = "".join(texts).encode()
        ids, sizes = pieces.ids(np.frombuffer(raw, np.uint8), np.cumsum([0, *(len(t.encode()) for t in texts)]))
        want = [pieces.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        assert ids.tolist() == sum(want, []) and sizes.tolist() == list(map(len, want))


def test_rank_codes_round_trip():
    ranks = np.array([0, 1, 255, 256, 65535, 65536, 1 << 24, (1 << 32) - 1, 7], np.uint32)
    for n in range(len(ranks) + 1):
        control, data = token_files.encode_ranks(ranks[:n])
        assert token_files.decode_ranks(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), n).tolist() == ranks[:n].tolist()


def test_decontamination(spark, docs, rows, empty):
    base = rows[40][1].split()
    changed = base[10:40]
    changed[7] = "other"
    items = spark.createDataFrame([(1, " ".join(changed)), (2, "nowhere to be found in any of these texts at all not even once more"), (3, None), (4, " ".join(base[50:56])), (5, "too short")], "item_id long, text string")
    for most in (400_000, 7):  # seeds sent to all tasks, and met by a shuffle
        got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, items, most_seeds=most).collect()}
        assert got == {(d, i) for d in (100, 101, 102, 103, None) for i in (1, 4)}
        kept = [tuple(r) for r in decontaminate.remove_leaks(docs, items, most_seeds=most).collect()]
        # of the rows without an id, only the one that leaks goes
        assert sorted(kept, key=repr) == sorted((r for r in rows if r[0] not in (100, 101, 102, 103) and r[1] != rows[40][1]), key=repr)
    assert decontaminate.find_leaks(empty, items).count() == 0 and decontaminate.find_leaks(docs, items.limit(0)).count() == 0


def test_masks_leave_out_what_may_be_substituted():
    for n in range(1, decontaminate.SPAN + 1):
        masks = decontaminate._masks(n)
        assert all(len(m) == n for m in masks)
        for places in itertools.combinations(range(n), 2 if n == decontaminate.SPAN else int(n >= 8)):
            assert any(all(m[i] == "0" for i in places) for m in masks)


def test_quality(spark, docs, rows, empty):
    got = {(r.doc_id, r.n_words): r for r in quality.judge(docs).collect()}
    for d, t, *_ in rows:
        w = words(t)
        wins = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        twice = {x for x in wins if wins.count(x) > 1} if len(w) < 2000 else set(wins)
        covered = {p for i, x in enumerate(wins) if x in twice for p in range(i, i + 8)}
        r = got[d, len(w)]
        assert (r.word_chars, r.n_repeat_words) == (sum(map(len, w)), len(covered)), d
        assert r.base_failed == (len(w) < 20 or 100 * len(covered) > 30 * len(w)) and not (r.kept and r.base_failed)
    assert quality.judge(empty).count() == 0


def test_quality_tells_junk_from_prose(spark):
    rng = random.Random(2)
    prose = [(i, ". ".join(sentence(rng, 12).capitalize() for _ in range(12)) + ".") for i in range(300)]
    junk = [(1000 + i, " ".join(rng.choice(WORDS) + "%%%" for _ in range(150))) for i in range(20)]
    kept = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(prose + junk, "doc_id long, text string")).collect()}
    assert all(kept[d] for d, _ in prose) and not any(kept[d] for d, _ in junk)


def test_private_spans_and_revealing_terms(spark, docs, rows, empty):
    rng = random.Random(3)
    told = [(i, sentence(rng, 10) + " Rumpel, writes from who@there.org " + sentence(rng, 10 + i)) for i in range(4)]
    others = [(10 + i, sentence(rng, 40)) for i in range(60)] + [(100, "a@b.c tel +1 (416) 555-1234 or 300.1.2.3 and 10.0.0.255"), (101, "4111 1111 1111 1111"), (102, None)]
    got = {r.doc_id: r for r in pii.find_private(spark.createDataFrame(told + others, "doc_id long, text string")).withColumn("w", pii.written(F.col("spans"))).collect()}
    for d, t in told:
        a, b = t.index("Rumpel"), t.index("who@")
        assert f"term:{a}:{a + 6}" in got[d].w.split(",") and f"email:{b}:{b + 13}" in got[d].w and "<TERM>, " in got[d].sanitised and "<EMAIL>" in got[d].sanitised
    assert got[100].w == "email:0:5,phone:10:27,ip:45:55" and got[101].w == "card:0:19" and got[102].w == ""
    assert not any("term" in got[d].w for d, _ in others)
    assert pii.find_private(docs).count() == len(rows) and pii.find_private(empty).count() == 0


def test_language(spark, docs, rows, empty):
    rng = random.Random(5)
    kinds = {"en": "the and with that which", "de": "der und mit dass welche", "fr": "le et avec que lequel", "es": "el y con que cual", "xx": "qa zu wq kx vy"}
    texts = [(i, " ".join(rng.choice(kinds[k].split()) for _ in range(30)), k) for i, k in enumerate(list(kinds) * 40)]
    df = spark.createDataFrame([*texts, (900, None, "en"), (901, "123 ...", "en")], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id.identify(df, language_id.train(df, ~language_id.held_out(F.col("doc_id")))).collect()}
    assert all(got[d].lang_pred == k and 0.5 < got[d].score <= 1 for d, _, k in texts)
    assert got[900].lang_pred == got[901].lang_pred == "und" and got[900].score == 0
    assert {r.lang_pred for r in language_id.identify(docs, language_id.train(empty, F.lit(True))).collect()} == {"und"}
    assert language_id.identify(docs, language_id.train(docs, F.lit(True))).count() == len(rows)


def test_only_wanted_languages_are_kept(spark, docs, rows):
    model = language_id.train(docs, F.lit(True))
    said = {r.doc_id: r.lang_pred for r in language_id.identify(docs.filter("doc_id < 40"), model).collect()}
    assert set(said.values()) == {"en", "de"}
    for wanted in (("en",), ("de",), ("en", "de"), ("fr",), ()):
        kept = language_id.keep_identified(docs.filter("doc_id < 40"), model, 0.0, wanted)
        assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, x in said.items() if x in wanted) and kept.columns == docs.columns
    assert language_id.keep_identified(docs, None).count() == 0


def test_rare_languages_are_learnt(spark):
    rng = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = {f"l{i}": ["".join(rng.choice(letters) for _ in range(5)) for _ in range(4)] for i in range(130)}
    rows = [(i, " ".join(rng.choice(words[k]) for _ in range(20)), k) for i, k in enumerate(["l0"] * 900 + [k for k in words for _ in range(4)])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id.identify(df, language_id.train(df, F.lit(True), per_language=40, most_rows=200, floor=3)).collect()
    assert sum(r.lang_pred == rows[r.doc_id][2] for r in got) > 0.95 * len(rows) and {r.lang_pred for r in got} == set(words)


def test_warc(spark):
    pages = [(i, f"http://x/{i} y", None if i % 7 == 0 else ["a", "", "b\x1f\x8b\x08" * 50][i % 3]) for i in range(60)] + [(None, None, "alone")]
    want = []
    for p, _, h in pages:
        h = h or ""
        keeper = max((q for q, _, g in pages if (g or "") == h and q is not None), default=None)
        again = keeper is not None and keeper != p
        want.append((p, len(h.encode()), base64.b32encode(hashlib.sha1(h.encode()).digest()).decode(), "revisit" if again else "response", keeper if again else None))
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    for most in (0, 1000):
        folder = warc.write_warc(df, most_rows=most)
        for split in (997, 1 << 20):
            got = warc.read_warc(spark, folder, split).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
            assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert warc.read_warc(spark, warc.write_warc(df.limit(0))).count() == 0


def test_pipeline_stages_handle_odd_rows(spark, docs, rows, tmp_path):
    import corpus_pipeline

    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    docs.select(*columns).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(rows[40][1].split()[10:40]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r.doc_id for r in out}
    assert out and not ids & {100, 101, 102, 103, 200, 201, 202, 205} and all(r.n_tokens > 0 for r in out)
