"""Pools, names and cells of a twin when many of the values it would draw are real."""

import csv

import pytest
from pyspark.sql import functions as F

from loomery.functions import rng, words
from loomery.functions.keys import leak_keys
from loomery.operators import leaks
from loomery.operators.cells import TRIO, Twin
from loomery.operators.pools import MAKERS, checked_pools, pool_size
from loomery.operators.profile import build_profiles
from loomery.plans import twin as twins
from loomery.plans.twin import generate, safe_twin, synthesize_file
from loomery.sources.shared import Tables


@pytest.fixture
def tables(spark):
    with Tables(spark) as kept:
        yield kept


def keys(spark, values):
    return {r.k for r in spark.createDataFrame([(v,) for v in values], "v string").select(F.explode(leak_keys(F.col("v"))).alias("k")).collect()}


def test_pools_lose_real_values_and_keep_their_order(spark, tables):
    real = spark.createDataFrame([(w.upper(),) for w in [*words.FIRST[::2], *words.LAST]], "v string")
    known = leaks.RealKeys(real, ["v"], tables)
    pools = checked_pools(spark, "1", 400, known, list(MAKERS))
    drawn = set(words.FIRST)
    assert set(pools.values["first"]) == drawn - set(words.FIRST[::2]) and 0 < pools.dropped["first"] < pool_size(400)
    assert pools.dropped["last"] == pool_size(400) and not set(pools.values["last"]) & set(words.LAST)  # words that are made up
    assert pools.dropped["city"] < 5 and pools.dropped["street"] == 0  # a town may be called as a family
    assert "Ashford" not in pools.values["city"]
    assert checked_pools(spark, "1", 400, known, list(MAKERS)).values == pools.values


def full_names(spark, names):
    df = spark.createDataFrame([(n, f"{i}") for i, n in enumerate(names)], "c0 string, _o string").withColumn("_o", F.col("_o").cast("long"))
    return df, *build_profiles(df, ["client"], "_o", overrides={"client": "full_name"})


def test_no_record_has_the_names_of_a_real_person(spark, tables, monkeypatch):
    given, family = words.FIRST[:6], words.LAST[:5]
    monkeypatch.setitem(MAKERS, "first", lambda d: rng.pick(d("f"), given))
    monkeypatch.setitem(MAKERS, "last", lambda d: rng.pick(d("l"), family))
    real = [f"{f} {n}" for f in given for n in family][:20]  # two thirds of all pairs
    df, profiles, groups = full_names(spark, real)
    known = leaks.RealKeys(df, ["c0"], tables)
    pools = checked_pools(spark, "3", 300, known, ["first", "last"])
    twin = Twin(profiles, groups, "3", F.col("_row"), pools)
    trios = twins._safe_names(spark, twin, 300, known, tables)
    rows = generate(spark, profiles, groups, "3", 300, pools=pools, trios=trios).select("_row", TRIO, F.concat_ws(" ", "_first", "_last").alias("name")).collect()
    changed = [r for r in rows if r[TRIO]]
    assert len(changed) > 100 and trios.count() >= len(changed)
    still = [r.name for r in rows if r.name in real]
    assert len(still) < 0.35 * len(rows)  # four trios, each real with a chance of two thirds
    assert all(r[TRIO] == 0 for r in rows if r.name in real)
    done = safe_twin(spark, profiles, groups, "3", 300, df, ["c0"], {}, tables)
    assert not keys(spark, real) & keys(spark, [r.c0 for r in done.collect()])


def test_cells_are_repaired_until_nothing_leaks(spark, tables):
    # nine tenths of all codes are real: the first eight draws of a cell all leak in about every other case
    codes = [f"{a}{b:02d}" for a in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for b in range(100)]
    real = [c for i, c in enumerate(codes) if i % 10]
    df = spark.createDataFrame([(c, i) for i, c in enumerate(real)], "c0 string, _o long")
    profiles, groups = build_profiles(df, ["code"], "_o", overrides={"code": "identifier"})
    stats = {0: twins.GuardStats()}
    made = [r.c0 for r in safe_twin(spark, profiles, groups, "9", 500, df, ["c0"], stats, tables).collect()]
    assert stats[0].collisions > 400 and stats[0].unresolved == 0 and stats[0].fallbacks > 0
    assert len(made) == 500 and not set(made) & set(real)


def test_exhausted_columns_are_given_up(spark, tables):
    real = [f"{i:03d}" for i in range(1000)]
    df = spark.createDataFrame([(c, i) for i, c in enumerate(real)], "c0 string, _o long")
    profiles, groups = build_profiles(df, ["ref_code"], "_o", overrides={"ref_code": "identifier"})
    stats = {0: twins.GuardStats()}
    before = len(tables.paths)
    made = safe_twin(spark, profiles, groups, "9", 1000, df, ["c0"], stats, tables)
    assert (stats[0].collisions, stats[0].unresolved) == (1000, 1000) and made.count() == 1000
    assert len(tables.paths) - before < 10  # two rounds, not four


def test_report_tells_of_pools(spark, tmp_path):
    path = tmp_path / "people.csv"
    with open(path, "w", newline="") as file:
        out = csv.writer(file)
        out.writerow(["first_name", "last_name", "city"])
        for i in range(200):
            out.writerow([words.FIRST[i % 40], words.LAST[i % len(words.LAST)], f"Ashton {i}"])
    report = synthesize_file(path, tmp_path / "twin.csv", seed=5)
    assert report.ok and report.real_pool_values["first"] > 50 and report.real_pool_values["last"] > 200 and report.to_dict()["real_pool_values"]
    with open(tmp_path / "twin.csv", newline="") as file:
        made = list(csv.DictReader(file))
    assert not {r["first_name"].strip().lower() for r in made} & {w.lower() for w in words.FIRST[:40]}


def test_many_cells_are_replaced_block_by_block(spark, tables, monkeypatch):
    codes = [f"{a}{b:02d}" for a in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for b in range(100)]
    real = [(c, f"{i % 900:03d}-x", i) for i, c in enumerate(codes) if i % 3]
    df = spark.createDataFrame(real, "c0 string, c1 string, _o long")
    profiles, groups = build_profiles(df, ["code", "other"], "_o", overrides={"code": "identifier", "other": "identifier"})
    made = []
    for few in (100_000, 0):
        monkeypatch.setattr(twins, "FEW", few)
        out = safe_twin(spark, profiles, groups, "9", 2500, df, ["c0", "c1"], {}, tables, chunk=300)
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert ("Join" in plan) == bool(few) and "Sort" not in plan
        made.append([tuple(r) for r in out.collect()])
    assert made[0] == made[1] and len(made[0]) == 2500


@pytest.mark.parametrize(("encoding", "header"), [("utf-8", True), ("utf-8-sig", False), ("cp1252", True), ("utf-16", True)])
def test_parts_are_put_together_in_order(spark, tmp_path, encoding, header):
    from loomery.sources.sinks import write_text
    from loomery.sources.sniff import TextFormat

    rows = spark.range(0, 1000, 1, 7).select(F.col("id").cast("string").alias("a"), F.concat(F.lit("né;"), F.col("id").cast("string")).alias("b")).filter("a < 300 or a > 500")
    write_text(rows, ["a", "b"], TextFormat(encoding, ";", False, "\r\n", header), tmp_path / "x.csv")
    text = (tmp_path / "x.csv").read_bytes().decode(encoding)
    want = ["a;b"] * header + [f'{r.a};"{r.b}"' for r in rows.collect()]
    assert text == "".join(f"{line}\r\n" for line in want)
    assert [p.name for p in tmp_path.iterdir()] == ["x.csv"]
    write_text(rows.filter("false"), ["a", "b"], TextFormat(encoding, ";", False, "\r\n", header), tmp_path / "x.csv")
    assert (tmp_path / "x.csv").read_bytes().decode(encoding) == "a;b\r\n" * header
