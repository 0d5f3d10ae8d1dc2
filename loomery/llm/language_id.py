"""Language identification by hierarchical discrimination.

A text's features are counts of lower-cased byte pairs and triples, hashed into ``DIM`` places, as square roots,
with unit length. Linear support vector machines first choose a language family, one against the rest; then,
inside the family, one machine for each two of its languages votes. Families are a fixed table of language codes;
a language that is not in the table is a family of its own.

Training takes rows with a letter of every language, chosen by a hash of doc_id: ``per_language`` of each, fewer if that makes more than ``most_rows``, but
not fewer than ``floor``; a language with fewer rows gives all. This bound is what reaches the driver (4 KB a row); no language is left out.
Prediction reads every whole text, and takes nothing but the text.

``und`` with score 0: null texts, texts without a letter, and all texts if there is nothing to learn from. Other
scores are the family's probability times the mean probability against the family's other languages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomery.llm import textkernel as tk
from loomery.llm.storage import lean, materialise, prepare_workers

DIM = 2048
#: Bytes of text, and texts, whose features are made at a time.
STEP, MOST = 1 << 18, 256
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fo af lb fy yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk bg mk sr hr bs sl",
    "baltic": "lt lv",
    "celtic": "ga gd cy br",
    "hellenic": "el",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky tk tt",
    "semitic": "ar he am mt",
    "indo-aryan": "hi ur bn pa gu mr ne si",
    "iranian": "fa ps ku tg",
    "dravidian": "ta te kn ml",
    "sinitic": "zh yue",
    "japonic": "ja",
    "koreanic": "ko",
    "tai": "th lo",
    "austroasiatic": "vi km",
    "austronesian": "id ms tl jv su mg",
    "bantu": "sw zu xh rw",
}
_CODE = np.full(256, 32, np.uint8)
_CODE[97:123] = np.arange(97, 123)
_CODE[128:] = np.arange(128, 256)


def family_of(lang: str) -> str:
    code = lang.lower().replace("_", "-").split("-")[0]
    return next((name for name, codes in FAMILIES.items() if code in codes.split()), f"own:{lang}")


def features(texts: pa.Array) -> Iterator[np.ndarray]:
    """Rows of features, some documents at a time."""
    buf, offsets = tk.text_buffer(pc.utf8_lower(texts))
    for i, j in tk.steps(offsets, STEP, MOST):
        part, at = _CODE[buf[offsets[i] : offsets[j]]].astype(np.uint32), offsets[i : j + 1] - offsets[i]
        n = j - i
        counts = np.zeros(n * DIM + 1)
        doc = np.repeat(np.arange(n, dtype=np.int64) * DIM, np.diff(at))
        for width in (2, 3):
            if len(part) < width:
                continue
            key = part[: len(part) - width + 1] * np.uint32(0x9E3779B1)
            for k in range(1, width):
                key = (key ^ part[k : len(part) - width + 1 + k]) * np.uint32(0x85EBCA6B + 2 * k)
            place = doc[: len(key)] + (key >> np.uint32(32 - 11)).astype(np.int64)
            for k in range(1, width):
                cross = at[1:] - k  # sequences that would reach into the next document
                place[cross[(cross >= 0) & (cross < len(place))]] = n * DIM
            counts += np.bincount(place, minlength=n * DIM + 1)
        x = np.sqrt(counts[:-1].reshape(n, DIM)).astype(np.float32)
        yield x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-9)


def train_svm(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, rounds: int = 250) -> np.ndarray:
    """Weights and bias of a linear machine with squared hinge loss; y is +1 or -1, and both weigh the same."""
    x = np.column_stack([x, np.ones(len(x), np.float32)])
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32)
    w = ahead = np.zeros(x.shape[1], np.float32)
    t, rate = 1.0, 1 / (4 + penalty)
    for _ in range(rounds):
        slack = np.maximum(1 - y * (x @ ahead), 0)
        new = ahead - rate * (penalty * ahead - 2 * ((weight * slack * y) @ x))
        t, old = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        ahead = (new + (old - 1) / t * (new - w)).astype(np.float32)
        w = new.astype(np.float32)
    return w


class Model:
    def __init__(self, x: np.ndarray, langs: list[str]):
        lang = np.array(langs)
        self.families: list[list[str]] = []
        by: dict[str, list[str]] = {}
        for one in sorted(set(langs)):
            by.setdefault(family_of(one), []).append(one)
        self.families = [by[f] for f in sorted(by)]
        self.rest = np.array([train_svm(x, np.where(np.isin(lang, f), 1, -1)) for f in self.families]) if len(self.families) > 1 else None
        self.pairs: dict[tuple[str, str], np.ndarray] = {}
        for f in self.families:
            for i, a in enumerate(f):
                for b in f[i + 1 :]:
                    rows = (lang == a) | (lang == b)
                    self.pairs[a, b] = train_svm(x[rows], np.where(lang[rows] == a, 1, -1))

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        x = np.column_stack([x, np.ones(len(x), np.float32)])
        sure = lambda margin: 1 / (1 + np.exp(-4 * margin))
        family, score = np.zeros(len(x), np.int64), np.ones(len(x))
        if self.rest is not None:
            p = sure((x @ self.rest.T).astype(np.float64))
            family = p.argmax(axis=1)
            score = p[np.arange(len(x)), family]
        out = np.empty(len(x), object)
        for k, langs in enumerate(self.families):
            mine = np.flatnonzero(family == k)
            if not len(mine):
                continue
            votes, odds = np.zeros((len(mine), len(langs))), np.zeros((len(mine), len(langs)))
            for i, a in enumerate(langs):
                for j in range(i + 1, len(langs)):
                    p = sure((x[mine] @ self.pairs[a, langs[j]]).astype(np.float64))
                    votes[:, i] += p >= 0.5
                    votes[:, j] += p < 0.5
                    odds[:, i] += p
                    odds[:, j] += 1 - p
            best = (votes + odds / (len(langs) + 1)).argmax(axis=1)
            out[mine] = np.array(langs, object)[best]
            if len(langs) > 1:
                score[mine] *= odds[np.arange(len(mine)), best] / (len(langs) - 1)
        return out.tolist(), score


def _parts(batches: Iterator[pa.RecordBatch], place: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about a MB of text, so that copies of texts are small."""
    for batch in batches:
        for i, j in tk.steps(tk.text_buffer(batch.column(place))[1]):
            yield batch.slice(i, j - i)


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _parts(batches, 1):
        rows = [r.astype(np.float16).tobytes() for x in features(batch.column(1)) for r in x]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], ["lang", "x"])


def _predict(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches, 1):
            text = batch.column(1)
            written = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            langs, scores = [], [np.zeros(0)]
            if model.value is None:
                langs, scores = ["und"] * len(batch), [np.zeros(len(batch))]
            else:
                for x in features(text):
                    names, p = model.value.predict(x)
                    langs += names
                    scores.append(p)
            langs = [x if ok else "und" for x, ok in zip(langs, written)]
            scores = np.where(written, np.concatenate(scores), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return run


def train(documents: DataFrame, learn: Column, per_language: int = 600, most_rows: int = 6000, floor: int = 30) -> Model | None:
    """A model of the labelled rows for which ``learn`` holds; None if there are none."""
    prepare_workers(documents.sparkSession)
    rows = documents.filter(learn & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    rows = rows.select(F.col("doc_id").cast("long").alias("id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    sizes = materialise(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "languages")
    each = min(per_language, max(floor, most_rows // max(1, sizes.count())))
    # somewhat more than needed by a hash, then exactly so many of each language
    share = sizes.select(F.col("lang").alias("of"), (F.lit(1.5 * each + 20) / F.col("n")).alias("share"))
    dice = F.pmod(F.xxhash64("id", F.lit(77)), F.lit(1_000_000)) / 1e6
    picked = rows.join(share, F.col("lang") == F.col("of")).filter(dice < F.col("share"))
    place = F.row_number().over(W.partitionBy("lang").orderBy(F.xxhash64("id", F.lit(78)), "id", F.xxhash64("text")))
    picked = picked.select("lang", "text", place.alias("place")).filter(F.col("place") <= each)
    got = picked.select("lang", "text").mapInArrow(lean(_featurise), "lang string, x binary").collect()
    if not got:
        return None
    got.sort()
    return Model(np.array([np.frombuffer(r.x, np.float16) for r in got]).astype(np.float32), [r.lang for r in got])


def identify(documents: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang_pred, score) of every row of ``documents`` (doc_id, text)."""
    spark = documents.sparkSession
    prepare_workers(spark)
    docs = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return docs.mapInArrow(lean(_predict(spark.sparkContext.broadcast(model))), "doc_id long, lang_pred string, score double")


def _keep(model, least: float, languages: tuple[str, ...] | None, place: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches, place):
            text = batch.column(place)
            keep = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            if model.value is None:
                keep &= False
            else:
                found = [model.value.predict(x) for x in features(text)]
                keep &= np.concatenate([np.zeros(0), *(p for _, p in found)]) >= least
                if languages is not None:
                    keep &= np.array([name in languages for names, _ in found for name in names], bool)
            yield batch.filter(pa.array(keep))

    return run


def keep_identified(documents: DataFrame, model: Model | None, least: float = 0.5, languages: tuple[str, ...] | None = None) -> DataFrame:
    """The rows of ``documents``, with all columns, whose language is predicted with a score of ``least`` or more and is one
    of ``languages`` (None: any that the model knows). Without a model no row stays."""
    spark = documents.sparkSession
    prepare_workers(spark)
    plain = documents.toDF(*(f"c{i}" for i in range(len(documents.columns))))  # whatever the columns' names
    kept = plain.mapInArrow(lean(_keep(spark.sparkContext.broadcast(model), least, languages, documents.columns.index("text"))), plain.schema)
    return kept.toDF(*documents.columns)


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def query(spark, sf_dir: str) -> DataFrame:
    """op7: predictions for all documents by a model of those that aren't held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = identify(docs, train(docs, ~held_out(F.col("doc_id"))))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
