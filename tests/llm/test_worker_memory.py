"""What a Python worker takes for a task, and keeps after it."""

import subprocess
import sys
import tracemalloc
from pathlib import Path

import numpy as np
import pyarrow as pa

from loomery.llm import language_id


class Sent:
    """What a broadcast is on a worker: a model of two languages."""

    value = language_id.Model(np.concatenate(list(language_id.features(pa.array(["the cat", "le chat"] * 5)))), ["en", "fr"] * 5)


def batch(texts):
    return pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["doc_id", "text"])


def test_many_short_texts_of_a_batch_take_little_memory():
    texts = batch(["the cat", "le chat", "12", "", None] * 2000)
    for run in (language_id._predict(Sent), language_id._keep(Sent, 0.0, 1)):
        tracemalloc.start()
        list(run(iter([texts])))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 30 << 20


def test_parts_of_a_batch_lose_no_row():
    texts = ["the cat", "le chat", "12", "", None, "x" * 5000] * 500
    got = pa.Table.from_batches(language_id._predict(Sent)(iter([batch(["a"]).slice(1), batch(["b", *texts]).slice(1), batch(["le chat"])])))
    assert got["doc_id"].to_pylist() == [*range(1, len(texts) + 1), 0]
    assert got["lang_pred"].to_pylist()[:5] == ["en", "fr", "und", "und", "und"] and got["lang_pred"].to_pylist()[-1] == "fr"
    kept = pa.Table.from_batches(language_id._keep(Sent, 0.0, 1)(iter([batch(texts)])))
    assert kept["text"].to_pylist() == [t for t in texts if t and any(c.isalpha() for c in t)]


def test_a_worker_gives_freed_memory_back():
    code = """
import re
import pyarrow as pa
from loomery.llm.storage import lean

def anonymous():
    with open("/proc/self/smaps_rollup") as f:
        return int(re.search(r"Anonymous: +([0-9]+)", f.read())[1]) >> 10

held = []

def run(batches):
    parts = [b"x" * 50_000 for _ in range(4000)]
    held.append(b"x" * 50_000)
    arrow = pa.array([b"x" * 1000] * 1000).take(pa.array(list(range(1000)) * 100))
    yield from batches

list(lean(run)([]))
print(anonymous())
before = anonymous()
list(run([]))
print(anonymous() - before)
"""
    if not Path("/proc/self/smaps_rollup").exists():
        return
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=Path(__file__).parents[2], timeout=60)
    lean, plain = map(int, out.stdout.split())
    assert lean < 150 and plain > 100, out
