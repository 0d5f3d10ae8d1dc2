"""Order statistics, date orders and unique values, beside plain versions."""

import random
import statistics
from itertools import product

import pytest
from pyspark.sql import functions as F

from loomery.functions import words
from loomery.operators import profile
from loomery.plans.compile import compile_spec, permuted
from loomery.plans.spec import ColumnSpec, DatasetSpec, SchemaError


@pytest.mark.parametrize("n", [1, 2, 3, 20, 21, 22, 997, 5000])
def test_order_statistics(spark, n):
    rng = random.Random(n)
    rows = [("a", float(rng.choice([0, 0, 0, 1, rng.randint(-50, 50), rng.random()]))) for _ in range(n)] + [("b", 7.0)] * n + [("c", float(i)) for i in range(n)] + [("c", None), ("d", None)]
    got = {}
    for r in profile.quantile_edges(spark.createDataFrame(rows, "g string, v double").repartition(5), "g", "v").orderBy("g", "place").collect():
        got.setdefault(r.g, []).append(r.edge)
    for g in "abc":
        x = sorted(v for h, v in rows if h == g and v is not None)
        b = min(20, n - 1)
        assert got[g] == ([x[round(i * (n - 1) / b)] for i in range(b + 1)] if b else x)
    assert "d" not in got


def test_order_statistics_sort_few_values(spark):
    df = spark.range(400_000).select((F.col("id") % 2).alias("g"), F.pmod(F.xxhash64("id"), F.lit(1 << 40)).cast("double").alias("v"))
    edges = profile.quantile_edges(df, "g", "v")
    for g in (0, 1):
        x = sorted(r.v for r in df.filter(F.col("g") == g).select("v").collect())
        assert [r.edge for r in edges.filter(F.col("g") == g).orderBy("place").collect()] == [x[round(i * 199_999 / 20)] for i in range(21)]
    windows = [w for w in edges._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Window [" in w and "x#" in w]
    assert windows and all("range#" in w.split("], [")[1] for w in windows)  # values are only put in order within a range


def test_orders_of_two_hundred_date_columns(spark):
    rng = random.Random(5)
    columns = [f"c{i}" for i in range(200)]
    rows = []
    for _ in range(300):
        start = rng.randint(0, 10**9)
        rows.append([None if rng.random() < 0.1 else start + (i + 1) * 1000 if i % 50 < 3 else rng.randint(0, 10**9) for i in range(200)])
    df = spark.createDataFrame(rows, ", ".join(f"{c} long" for c in columns)).repartition(3)
    groups = {frozenset(g) for g in profile.date_groups(df, columns)}
    chain = frozenset(f"c{i}" for i in range(200) if i % 50 < 3)
    assert groups == {chain}
    (ordered,) = profile.date_groups(df, columns)
    assert ordered == sorted(chain, key=lambda c: statistics.median(v[int(c[1:])] for v in rows if v[int(c[1:])] is not None))
    pairs = {(r.a, r.b): (r.n, r.le, r.ge) for r in profile.date_pairs(df, columns[:4]).collect()}
    for a, b in ((0, 1), (1, 3), (2, 3)):
        both = [(r[a], r[b]) for r in rows if r[a] is not None and r[b] is not None]
        assert pairs[a, b] == (len(both), pytest.approx(sum(x <= y for x, y in both) / len(both)), pytest.approx(sum(x >= y for x, y in both) / len(both)))


@pytest.mark.parametrize("n", [1, 2, 3, 7, 12, 97, 100, 1009, 4096, 9700])
def test_permutations(spark, n):
    for seed in (1, 2):
        assert sorted(r[0] for r in spark.range(n).select(permuted(F.col("id"), n, seed, "x")).collect()) == list(range(n))


def test_permutations_beyond_forty_bits(spark):
    got = [r[0] for r in spark.range(5000).select(permuted(F.col("id"), 10**18, 1, "x")).collect()]
    assert len(set(got)) == 5000 and all(0 <= x < 10**18 for x in got) and max(got) > 9 * 10**17
    # neighbours are not a constant step apart
    assert len({b - a for a, b in zip(got, got[1:])}) > 4900


def unique(spark, provider, rows, **kwargs):
    spec = DatasetSpec(rows=rows, seed=3, columns=[ColumnSpec("v", "faker", unique=True, params={"provider": provider, "kwargs": kwargs})])
    return [r.v for r in compile_spec(spark, spec).collect()]


def test_unique_provider_values_look_like_others(spark):
    names = unique(spark, "name", len(words.FIRST) * len(words.LAST))
    assert set(names) == {f"{a} {b}" for a, b in product(words.FIRST, words.LAST)}  # the whole space, each once
    mails = unique(spark, "email", 3000)
    assert len(set(mails)) == 3000 and all(m.count("@") == 1 and " " not in m for m in mails)
    assert sorted(unique(spark, "word", len(words.WORDS))) == sorted(words.WORDS)
    for provider, kwargs in (("city", {}), ("street_address", {}), ("phone_number", {}), ("pyfloat", {}), ("company", {}), ("date", {}), ("random_int", {"min": 5, "max": 4005, "step": 10}), ("uuid4", {})):
        assert len(set(unique(spark, provider, 300, **kwargs))) == 300
    with pytest.raises(SchemaError, match="unique values are needed"):
        unique(spark, "word", len(words.WORDS) + 1)
    with pytest.raises(SchemaError, match="can't be made unique"):
        unique(spark, "sentence", 3)


def test_without_a_seed_runs_differ(spark):
    spec = DatasetSpec(rows=50, columns=[ColumnSpec("v", "faker", params={"provider": "name"})])
    runs = [[r.v for r in compile_spec(spark, spec).collect()] for _ in range(2)]
    assert runs[0] != runs[1] and spec.seed is None


def made(spark, provider, locale="en_US", rows=60, **kwargs):
    spec = DatasetSpec(rows=rows, seed=3, locale=locale, columns=[ColumnSpec("v", "faker", params={"provider": provider, "kwargs": kwargs})])
    return [r.v for r in compile_spec(spark, spec).collect()]


def test_locales_have_their_words(spark):
    for locale, language in (("fr_CA", "fr"), ("de_DE", "de"), ("fr-FR", "fr")):
        own = words.LANGUAGES[language]
        assert set(made(spark, "first_name", locale)) <= set(own["FIRST"]) and set(made(spark, "last_name", locale)) <= set(own["LAST"])
        assert all(m.isascii() for m in made(spark, "email", locale)) and set(made(spark, "word", locale)) <= set(words.WORDS)
    assert set(made(spark, "first_name", "xx_YY")) <= set(words.FIRST)
    assert not any("_" in s for s in made(spark, "street_name", "fr_FR")) and not any(" " in s for s in made(spark, "street_name", "de_AT"))


def test_check_digits(spark):
    luhn = lambda s: sum(sum(divmod(int(c) * (1 + (i % 2)), 10)) for i, c in enumerate(reversed(s))) % 10 == 0
    assert all(luhn(v) for v in made(spark, "credit_card_number"))
    for provider in ("isbn13", "ean13"):
        assert all(sum(int(c) * (3 if i % 2 else 1) for i, c in enumerate(v)) % 10 == 0 for v in made(spark, provider))
    assert all(int(v[4:] + "1314" + v[2:4]) % 97 == 1 for v in made(spark, "iban"))
    assert all(v[0] == "A" and v[1:3].isdigit() and v[3].islower() for v in made(spark, "bothify", text="A##?"))
    assert sorted(unique(spark, "numerify", 100, text="x##")) == [f"x{i:02d}" for i in range(100)]


def test_twins_of_a_locale(spark, tmp_path):
    from loomery.plans.twin import synthesize_file

    (tmp_path / "p.csv").write_text("first_name,n\n" + "".join(f"{n},{i}\n" for i, n in enumerate(["Ann", "Bob", "Cy", "Dee"] * 20)))
    assert synthesize_file(tmp_path / "p.csv", tmp_path / "t.csv", seed=1, locale="de_DE").ok
    names = {line.split(",")[0] for line in (tmp_path / "t.csv").read_text(encoding="utf-8").splitlines()[1:]}
    assert names <= set(words.LANGUAGES["de"]["FIRST"]) and len(names) > 10


def test_distinct_counts_that_decide_are_exact(spark):
    n, shares = 4000, (0.28, 0.3, 0.31, 0.5, 0.52, 0.7, 0.88, 0.9, 0.93, 1.0)
    df = spark.range(n).select(F.col("id").alias("_o"), *((F.col("id") % int(n * s)).cast("string").alias(f"c{i}") for i, s in enumerate(shares)), (F.col("id") % 49).cast("string").alias("c10"), F.lit(None).cast("string").alias("c11"))
    long = profile.long_form(df, [f"c{i}" for i in range(12)], "_o")
    about, exact = profile.sizes(long), profile.sizes(long, exact=True)
    for i, s in enumerate(shares):
        assert exact[i] == {"col": i, "values": n, "distinct": int(n * s)}
        assert abs(about[i]["distinct"] - int(n * s)) <= (0.05 * n if s in (0.7, 1.0) else 0)
    assert about[10]["distinct"] == 49 and about[11] == {"col": 11, "values": 0, "distinct": 0}
