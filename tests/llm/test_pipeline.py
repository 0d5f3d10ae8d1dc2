"""The pipeline's stages on a small table, each held against a plain version over what its predecessor kept."""

import hashlib
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

import corpus_pipeline
from loomery.llm import decontaminate, token_files
from loomery.llm.storage import materialise

SF = Path("/root/testdata/sf0.001")


def words(text):
    return [w.decode() for w in text.encode().split()]


def near(docs):
    sets = {}
    for d, t, *_ in docs:
        w = words("".join(c.lower() if c.isascii() else c for c in t))
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    lead = {d: d for d in sets}

    def root(x):
        while lead[x] != x:
            x = lead[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 10 * both >= 8 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                lead[y] = x
    return {d for d in ids if root(d) == d}


def clean(docs, items):
    span, seeds = decontaminate.SPAN, {}
    pick = lambda w, m: tuple(x for x, c in zip(w, m) if c == "1")
    for t in items:
        w = t.lower().split()
        for i in range(len(w) - span + 1):
            for m in decontaminate.COVER:
                seeds.setdefault((m, pick(w[i : i + span], m)), []).append(w[i : i + span])
    kept = set()
    for d, t, *_ in docs:
        w = [x.lower() for x in words(t)]
        windows = (w[i : i + span] for i in range(len(w) - span + 1))
        if not any(sum(a == b for a, b in zip(x, y)) >= 11 for x in windows for m in decontaminate.COVER for y in seeds.get((m, pick(x, m)), ())):
            kept.add(d)
    return kept


def copies(docs):
    size = {d: len(words(t)) for d, t, *_ in docs}
    by = {}
    for d, _, _, source, _ in docs:
        by.setdefault(source, []).append(d)
    order = sorted(s for s in by if s is not None) + [s for s in by if s is None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total = {s: sum(size[d] for d in by[s]) for s in by}
    goal, target, free = 1.5 * sum(total.values()), {}, set(order)
    while free:
        level = (goal - sum(target.values())) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * total[s]}
        target |= {s: 2.0 * total[s] for s in over} if over else {s: level * weight[s] for s in free}
        free = free - over if over else set()
    out = Counter()
    for s, ids in by.items():
        ratio = round(target[s] / total[s] * 2**30) if total[s] else 0
        dice = int(hashlib.md5(f"{s or ''}|17".encode()).hexdigest()[:7], 16) * 4
        for rank, d in enumerate(sorted(ids, key=lambda d: (size[d], d))):
            out[d] = ((rank + 1) * ratio + dice) // 2**30 - (rank * ratio + dice) // 2**30
    return out


@pytest.mark.skipif(not SF.exists(), reason="needs the test tables")
def test_every_stage_equals_its_plain_version(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, rows = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = rows or [tuple(r) for r in docs.collect()], materialise(stage(spark, docs, str(SF)), name)
        rows = [tuple(r) for r in docs.collect()]
        ids = {r[0] for r in rows}
        if name == "language_id":
            assert ids == {r[0] for r in before if any(c.isalpha() for c in r[1] or "")}
        elif name == "near_duplicates":
            assert ids == near(before) and len(ids) == len(rows)
        elif name == "decontamination":
            assert ids == clean(before, [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
        elif name == "mixing":
            assert Counter(r[0] for r in rows) == +copies(before)
        else:
            tokenizer, want, n = Tokenizer.from_file(token_files.byte_bpe()), [], 0
            for d, t, *_ in sorted(before):
                got = [*tokenizer.encode(t, add_special_tokens=False).ids, 2]
                want.append((d, n, len(got), zlib.crc32(np.array(got, "<u4").tobytes())))
                n += len(got)
            assert sorted(rows) == want
        if name != "token_files":
            assert docs.columns == columns
