"""Findings of the fifth round: rates over all values, and values worked out once a row."""

from pyspark.sql import functions as F

from loomery.functions import numbers, rng, shape
from loomery.operators import detect, profile


def test_rates_are_those_of_all_values(spark):
    """20,000 values, of which 81 % are numbers in the first column, 79 % in the second: samples of 2,000 would tell them apart by luck."""
    share = lambda n: F.when(F.col("id") % 100 < n, F.col("id").cast("string")).otherwise(F.concat(F.lit("x;"), "id"))
    late = F.when(F.col("id") == 12_345, "05/13/2020").when(F.col("id") % 4 == 0, "n/a").otherwise("05/06/2020")
    rows = spark.range(20_000).select(share(81).alias("c0"), share(79).alias("c1"), late.alias("c2"), F.lit(None).cast("string").alias("c3"), F.col("id").alias("_o"))
    long = profile.long_form(rows, ["c0", "c1", "c2", "c3"], "_o")
    for cells in (long, profile.counted(long)):
        rates = profile.detection_rates(cells)
        assert (rates[0]["numeric"], rates[1]["numeric"], rates[2]["date"]) == (0.81, 0.79, 1.0) and 3 not in rates
        assert (rates[2]["first"], rates[2]["second"]) == (0, 1)  # one row of 15,000 decides
    (much, less, dates, _), _ = profile.build_profiles(rows, ["a", "b", "c", "d"], "_o")
    assert (much.kind, less.kind, dates.kind, dates.month_first) == ("numeric", "identifier", "date", True)
    assert dates.counts["format"] == {f"%m/%d/%Y{profile.SEP}none{profile.SEP}{profile.SEP}": 15_000} and dates.nulls == 5000


def test_counted_cells_have_the_rates_of_single_ones(spark):
    texts = ["123-456-782", "046 454 286", "a@b.ca", "K1A 0B1", "(204) 555-0101", "2020-01-31", "ON", "Zoë", "Ann B. Vega", "12 Main Street", "007", "$1.50", "four words of text", "n/a"]
    rows = spark.createDataFrame([(t, i) for i, t in enumerate(t for k, t in enumerate(texts) for _ in range(k + 1))], "c0 string, _o long")
    long = profile.long_form(rows, ["c0"], "_o")
    plain = long.filter("v is not null").agg(*(c.alias(k) for k, c in detect.rate_columns(F.col("v")).items())).first().asDict()
    for cells in (long, profile.counted(long)):
        got = profile.detection_rates(cells)[0]
        assert {k: got[k] for k in plain} == plain
        assert profile.sizes(cells, exact=True)[0] == {"col": 0, "values": 91, "distinct": 13, "shared": 9, "covered": 81}


def test_values_used_at_many_places_are_worked_out_once(spark):
    row = F.col("id")
    mask = rng.pick(rng.fast("1", "mask", 0, row), ["999-999-999", "999999999", "(A9) aa"])
    sin = numbers.new_sin("1", "sin", 0, row)
    for made in (shape.fill_mask_with(mask, sin, "1", "m", 0, row), shape.fill_mask(mask, "1", "m", 0, row, F.rpad(F.concat(F.lit("7"), sin), 11, shape.FREE))):
        plan = spark.range(1).select(made.alias("x"))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("LPad") + plan.count("lpad(") == 1 and plan.count("luhn") == 0
    got = spark.range(200).select(mask.alias("m"), sin.alias("s"), shape.fill_mask_with(mask, sin, "1", "m", 0, row).alias("x")).collect()
    for r in got:
        assert [c for c in r.x if c.isdigit()] == list(r.s[: sum(c == "9" for c in r.m)]) if "a" not in r.m else len(r.x) == 7
