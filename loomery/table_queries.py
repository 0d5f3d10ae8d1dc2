"""More queries with SQL that must agree: detection, histograms, twins, dates, numbers and files.

Most start from a table of contacts made of ``customer`` by expressions that Spark and DuckDB read alike.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.functions import dates, numbers, shape, words
from loomery.operators import detect, leaks, profile
from loomery.operators.pools import checked_pools
from loomery.plans.infer import infer_schema
from loomery.plans.twin import safe_twin
from loomery.queries import _MASK, query, table
from loomery.sources import sinks
from loomery.sources.readers import open_source, open_text
from loomery.sources.shared import local_folder, tables_until_exit
from loomery.sources.sniff import TextFormat

_K = "c_custkey"
_S = "CAST({0} AS STRING)".format
_TWO = lambda x: f"lpad({_S(x)}, 2, '0')"
#: Columns of the contacts, by header: every one has its own blanks or junk.
CONTACTS = {
    "nas": f"CASE WHEN {_K} % 7 = 0 THEN 'see file' ELSE substr({_S(f'{_K} * 7919 + 100000000')}, 1, 3) || '-' || substr({_S(f'{_K} * 7919 + 100000000')}, 4, 3) || '-' || substr({_S(f'{_K} * 7919 + 100000000')}, 7, 3) END",
    "courriel": f"CASE WHEN {_K} % 9 = 0 THEN 'n/a' WHEN {_K} % 11 = 0 THEN 'asked twice' ELSE lower(c_mktsegment) || {_S(_K)} || '@unit' || {_S(f'{_K} % 3')} || '.example.ca' END",
    "ship_zip": f"'K' || {_S(f'{_K} % 10')} || CASE WHEN {_K} % 2 = 0 THEN 'A ' ELSE 'a' END || {_S(f'{_K} % 7')} || 'B' || {_S(f'{_K} % 5')}",
    "tel": f"CASE WHEN {_K} % 5 = 0 THEN '---' WHEN {_K} % 2 = 0 THEN '(204) 555-' || lpad({_S(f'{_K} % 10000')}, 4, '0') ELSE '204.555.' || lpad({_S(f'{_K} % 10000')}, 4, '0') END",
    "prov": f"CASE {_K} % 4 WHEN 0 THEN 'ON' WHEN 1 THEN 'Manitoba' WHEN 2 THEN 'yk' ELSE 'p.e.i.' END",
    "birth": f"'19' || {_S(f'60 + {_K} % 40')} || '-' || {_TWO(f'1 + {_K} % 12')} || '-' || {_TWO(f'1 + {_K} % 28')}",
    "price": f"CASE WHEN {_K} % 8 < 4 THEN '$' || {_S(_K)} || '.50' WHEN {_K} % 8 = 4 THEN lpad({_S(_K)}, 7, '0') ELSE {_S(_K)} || '%' END",
    "segment": f"CASE WHEN {_K} % 400 = 1 THEN 'only' || {_S(_K)} ELSE c_mktsegment END",
    "addr": f"{_S(_K)} || ' Main Street'",
    "prenom": f"CASE {_K} % 3 WHEN 0 THEN 'ANNA' WHEN 1 THEN 'Zoë ' ELSE 'Jean-Luc' END",
    "member_name": f"CASE {_K} % 2 WHEN 0 THEN 'O''Neil, Jo' ELSE 'Ann B. Vega' END",
    "memo": f"'Called on ' || {_S(f'{_K} % 600')} || ' about the missing form and will call back'",
    "void": "'NULL'",
}
KINDS = dict(zip(CONTACTS, "sin email postal_code phone province date numeric category street_address first_name full_name free_text empty".split()))
_ROWS = f"SELECT {', '.join(f'{e} AS {n}' for n, e in CONTACTS.items())} FROM customer"
_BLANK = ", ".join("'" + t + "'" for t in shape.NULL_TOKENS)
_LONG = " UNION ALL ".join(f"SELECT '{n}' AS name, '{KINDS[n]}' AS kind, {n} AS raw FROM rows" for n in CONTACTS)
#: The cells: their column, its kind, and the stripped value, null for blanks.
_CELLS = f"WITH rows AS ({_ROWS}), cells AS (SELECT name, kind, raw, CASE WHEN trim(raw) IN ({_BLANK}) THEN NULL ELSE trim(raw) END AS v FROM ({_LONG}))"
#: What isn't of its column's kind.
_JUNK = "(v IN ('see file', 'asked twice'))"


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select(_K, "c_mktsegment").repartition(spark.sparkContext.defaultParallelism)  # a small file is one partition
    return customers.selectExpr(*(f"{e} AS c{i}" for i, e in enumerate(CONTACTS.values())), f"{_K} AS _o")


def _profiles(spark: SparkSession, sf_dir: str, exact: bool = False):
    return profile.build_profiles(contacts(spark, sf_dir), list(CONTACTS), "_o", exact_distinct=exact)


#: The columns of the twins below.
_TWINS = ("nas", "courriel", "ship_zip", "tel", "prov", "birth", "price", "segment", "void")


def _twin(spark: SparkSession, sf_dir: str, seed: str, n: int) -> tuple[DataFrame, DataFrame]:
    """Some of the contacts' columns, c0, c1, ..., and a twin of them."""
    at, columns = [list(CONTACTS).index(c) for c in _TWINS], [f"c{i}" for i in range(len(_TWINS))]
    df = contacts(spark, sf_dir).select(*(F.col(f"c{i}").alias(c) for i, c in zip(at, columns)), "_o")
    profiles, groups = profile.build_profiles(df, list(_TWINS), "_o")
    df = df.select(columns)
    return df, safe_twin(spark, profiles, groups, seed, n, df, columns, {}, tables_until_exit(spark))


@query(f"""{_CELLS} SELECT name, kind, count(v) AS n_values, count(DISTINCT CASE WHEN v IS NOT NULL THEN raw END) AS n_distinct,
count(*) - count(v) AS n_null, count(*) FILTER (WHERE v IS NOT NULL AND {_JUNK}) AS n_junk FROM cells GROUP BY name, kind""")
def detect_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of columns from headers and values, with their blanks and junk."""
    rows = [(p.name, p.kind, p.values, p.distinct, p.nulls, p.junk) for p in _profiles(spark, sf_dir, exact=True)[0]]
    return spark.createDataFrame(rows, "name string, kind string, n_values long, n_distinct long, n_null long, n_junk long")


@query(f"{_CELLS} SELECT DISTINCT name, kind, true AS near FROM cells")
def kinds_by_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of columns whose distinct values are counted exactly only where that decides; all counts are near the exact ones."""
    exact = profile.sizes(profile.long_form(contacts(spark, sf_dir), [f"c{i}" for i in range(len(CONTACTS))], "_o"), exact=True)
    found = enumerate(_profiles(spark, sf_dir)[0])
    return spark.createDataFrame([(p.name, p.kind, abs(p.distinct - exact[i]["distinct"]) <= 0.05 * exact[i]["distinct"]) for i, p in found], "name string, kind string, near boolean")


_FACTS = f"""{_CELLS}, good AS (SELECT * FROM cells WHERE v IS NOT NULL AND NOT {_JUNK}),
facts AS (SELECT name, 'null' AS kind, substr(raw, 1, 20) AS key FROM cells WHERE v IS NULL
UNION ALL SELECT name, 'junk', {_MASK.format('raw')} FROM cells WHERE v IS NOT NULL AND {_JUNK}
UNION ALL SELECT name, 'mask', {_MASK.format('raw')} FROM good WHERE kind IN ('sin', 'postal_code', 'phone')
UNION ALL SELECT name, 'letter', upper(substr(v, 1, 1)) FROM good WHERE kind = 'postal_code'
UNION ALL SELECT name, 'domain', split_part(v, '@', 2) FROM good WHERE kind = 'email'
UNION ALL SELECT name, 'length', length(v)::VARCHAR FROM good WHERE kind = 'free_text'
UNION ALL SELECT name, 'province', CASE v WHEN 'Manitoba' THEN 'MB' WHEN 'yk' THEN 'YT' WHEN 'p.e.i.' THEN 'PE' ELSE v END FROM good WHERE kind = 'province'
UNION ALL SELECT name, 'template', CASE WHEN contains(v, ',') THEN '{{last}}, {{first}}' ELSE '{{first}} {{mi}}. {{last}}' END FROM good WHERE kind = 'full_name'
UNION ALL SELECT name, 'category', raw FROM good WHERE kind = 'category'),
n AS (SELECT name, kind, key, count(*) AS n FROM facts GROUP BY ALL)
SELECT name, CASE WHEN kind = 'category' AND n < 5 THEN 'rare' WHEN kind = 'domain' AND n < 5 THEN 'rare_domain' ELSE kind END AS kind,
CASE WHEN kind = 'category' AND n < 5 THEN {_MASK.format('key')} WHEN kind = 'domain' AND n < 5 THEN '' ELSE key END AS key, sum(n)::BIGINT AS n FROM n GROUP BY 1, 2, 3"""


@query(_FACTS)
def contact_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of shapes and shared values of all columns."""
    kinds = ("null", "junk", "mask", "letter", "domain", "rare_domain", "length", "province", "template", "category", "rare")
    rows = [(p.name, kind, key, n) for p in _profiles(spark, sf_dir)[0] for kind in kinds for key, n in p.counts[kind].items()]
    return spark.createDataFrame(rows, "name string, kind string, key string, n long")


@query(f"""{_CELLS} SELECT DISTINCT name, CASE WHEN v IS NULL THEN substr(raw, 1, 20) WHEN kind = 'category' AND starts_with(v, 'only') THEN 'other' WHEN kind = 'category' THEN v
WHEN kind = 'province' THEN v ELSE {_MASK.format('raw')} END AS shape FROM cells WHERE kind IN ('sin', 'phone', 'postal_code', 'date', 'category') OR (kind = 'email' AND (v IS NULL OR {_JUNK}))
OR (kind = 'empty' AND v IS NULL)""")
def twin_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A twin's masks, blanks, junk and categories are those of its source; categories of a few rows have new names."""
    _, twin = _twin(spark, sf_dir, "5:contacts", 4000)
    names, columns = _TWINS, twin.columns
    segments = [r.c_mktsegment for r in table(spark, sf_dir, "customer").select("c_mktsegment").distinct().collect()]
    raw = F.col("raw")
    cells = twin.select(F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.lit(KINDS[n]).alias("kind"), F.coalesce(F.col(c), F.lit("")).alias("raw")) for n, c in zip(names, columns)))).alias("x")).select("x.*")
    blank, junk = shape.is_blank(raw), shape.mask_of(raw).isin("aaa aaaa", "aaaaa aaaaa")
    shown = F.when(blank, F.substring(raw, 1, 20)).when(F.col("kind") == "category", F.when(raw.isin(segments), raw).otherwise("other")).otherwise(shape.mask_of(raw))
    wanted = F.col("kind").isin("sin", "phone", "postal_code", "date", "category") | ((F.col("kind") == "email") & (blank | junk)) | ((F.col("kind") == "empty") & blank)
    return cells.filter(wanted).select("name", shown.alias("shape")).distinct()


@query(f"""{_CELLS} SELECT name, count(*) > 0 AS some, 0::BIGINT AS outside, 0::BIGINT AS real_values FROM cells WHERE name IN ('birth', 'price', 'nas', 'tel', 'courriel', 'ship_zip') GROUP BY name""")
def twin_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A twin's dates and numbers are inside the span of its source's; none of its private values is the source's."""
    df, twin = _twin(spark, sf_dir, "6:contacts", 2000)
    names = _TWINS
    long = lambda d: d.select(F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(f"c{names.index(n)}").alias("v")) for n in ("birth", "price", "nas", "tel", "courriel", "ship_zip")))).alias("x")).select("x.*")
    of = lambda name, value: F.when(F.col("name") == name, value)
    number = F.coalesce(of("birth", dates.parse_date(F.col("v"))["seconds"].cast("double")), of("price", numbers.parse_number(F.col("v"))["value"]))
    real = long(df).select("name", "v", number.alias("x"))
    span = real.groupBy(F.col("name").alias("of")).agg(F.min("x").alias("low"), F.max("x").alias("high"))
    known = real.filter(~F.col("name").isin("birth", "price") & ~shape.is_blank(F.col("v")) & F.col("v").rlike(r"\d")).select(F.col("name").alias("of"), F.col("v").alias("real")).distinct()
    made = long(twin).select("name", "v", number.alias("x")).join(F.broadcast(span), F.col("name") == F.col("of")).drop("of")
    made = made.join(known, (F.col("name") == F.col("of")) & (F.col("v") == F.col("real")), "left")
    some = F.count(F.coalesce(F.col("x"), F.when(F.col("v").rlike(r"\d"), 1.0))) > 0
    return made.groupBy("name").agg(some.alias("some"), F.count_if((F.col("x") < F.col("low")) | (F.col("x") > F.col("high"))).alias("outside"), F.count("real").alias("real_values"))


#: First names of customers; half of all that pools would draw.
_GIVEN, _FAMILY = words.FIRST[: len(words.FIRST) // 2], words.LAST[:8]
_LIST = lambda x: "[" + ", ".join(f"'{w}'" for w in x) + "]"


@query(f"""WITH real AS (SELECT DISTINCT {_LIST(_GIVEN)}[c_custkey % {len(_GIVEN)} + 1] AS v FROM customer)
SELECT 'first' AS kind, v AS value FROM (SELECT unnest({_LIST(words.FIRST)}) AS v) WHERE v NOT IN (SELECT v FROM real) UNION ALL SELECT 'last', unnest({_LIST(words.LAST)})""")
def pools_without_real_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What pools of names have left when customers' first names are real."""
    real = table(spark, sf_dir, "customer").selectExpr(f"upper(array({', '.join(map(repr, _GIVEN))})[c_custkey % {len(_GIVEN)}]) AS v")
    known = leaks.RealKeys(real, ["v"], tables_until_exit(spark))
    pools = checked_pools(spark, "1", 1500, known, ["first", "last"])
    return spark.createDataFrame([(k, v) for k, values in pools.values.items() for v in sorted(set(values))], "kind string, value string")


@query("SELECT count(*) AS n, 0::BIGINT AS real_people FROM customer")
def names_of_no_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as many as customers, none of which has a customer's first and last name together."""
    key = "c_custkey"
    df = table(spark, sf_dir, "customer").selectExpr(f"concat(array({', '.join(map(repr, words.FIRST))})[{key} % {len(words.FIRST)}], ' ', array({', '.join(map(repr, _FAMILY))})[{key} % {len(_FAMILY)}]) AS c0", f"{key} AS _o")
    profiles, groups = profile.build_profiles(df, ["client"], "_o", overrides={"client": "full_name"})
    twin = safe_twin(spark, profiles, groups, "2:names", df.count(), df.select("c0"), ["c0"], {}, tables_until_exit(spark))
    hit = leaks.leaked(twin.select(F.col("c0").alias("value")), leaks.real_keys(df, ["c0"]), ["value"])
    return twin.agg(F.count(F.lit(1)).alias("n")).select("n", F.lit(hit.count()).cast("long").alias("real_people"))


@query("SELECT count(*) AS n, 0::BIGINT AS leaks, 0::BIGINT AS unresolved, true AS repaired FROM customer WHERE c_custkey % 10 <> 0")
def repaired_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of a space of which nine tenths are real: cells are drawn again until none is."""
    customers = table(spark, sf_dir, "customer")
    digits = len(str(customers.agg(F.max("c_custkey")).first()[0])) - 1
    code = F.concat(F.lit("A"), F.lpad((F.col("c_custkey") % 10**digits).cast("string"), digits, "0"))
    df = customers.filter("c_custkey % 10 <> 0").select(code.alias("c0"), F.col("c_custkey").alias("_o"))
    profiles, groups = profile.build_profiles(df, ["code"], "_o", overrides={"code": "identifier"})
    stats: dict = {}
    twin = safe_twin(spark, profiles, groups, "3:codes", df.count(), df.select("c0"), ["c0"], stats, tables_until_exit(spark))
    hit = leaks.leaked(twin.select(F.col("c0").alias("value")), leaks.real_keys(df, ["c0"]), ["value"])
    found = stats.get(0)
    out = twin.agg(F.count(F.lit(1)).alias("n"))
    return out.select("n", F.lit(hit.count()).cast("long").alias("leaks"), F.lit(found.unresolved if found else 0).cast("long").alias("unresolved"), F.lit(bool(found and found.collisions)).alias("repaired"))


@query(f"{_CELLS} SELECT name, kind, true AS filled, 0::BIGINT AS leaks FROM cells WHERE kind IN ({', '.join(repr(k) for k in sorted(set(detect.SENSITIVE_TYPES) & set(KINDS.values())))}) GROUP BY name, kind")
def leaks_by_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A twin of all columns of contacts, and its private cells that equal a real private value of any column, by column."""
    df, profiles, groups = contacts(spark, sf_dir), *_profiles(spark, sf_dir)
    columns = [f"c{i}" for i in range(len(CONTACTS))]
    df = df.select(columns)
    tables = tables_until_exit(spark)
    twin = tables.keep(safe_twin(spark, profiles, groups, "7:contacts", df.count(), df, columns, {}, tables), "twin")  # read three times, made once
    private = [i for i, p in enumerate(profiles) if p.sensitive]
    cells = twin.select(F.explode(F.array(*(F.struct(F.lit(profiles[i].name).alias("name"), F.lit(profiles[i].kind).alias("kind"), F.col(columns[i]).alias("value")) for i in private))).alias("x")).select("x.*")
    hit = leaks.leaked(cells, leaks.real_keys(df, [columns[i] for i in private]), ["name", "value"]).groupBy("name").agg(F.count(F.lit(1)).alias("hits"))
    return cells.groupBy("name", "kind").agg((F.count("value") > 0).alias("filled")).join(hit, "name", "left").select("name", "kind", "filled", F.coalesce("hits", F.lit(0)).cast("long").alias("leaks"))


_FORMATS = [fmt for fmt, _ in dates.DATE_FORMATS]
#: Which format a text is taken for if the day could be a month: the one with the day first, if there is one.
_SWAP = {"%m/%d/%Y": "%d/%m/%Y", "%m-%d-%Y": "%d-%m-%Y", "%m/%d/%y": "%d/%m/%y", "%m/%d/%Y %H:%M": "%d/%m/%Y %H:%M"}
_LISTED = "[" + ", ".join(f"'{f}'" for f in _FORMATS) + "]"
_SWAPPED = " ".join(f"WHEN f = '{a}' AND day(d) <= 12 THEN '{b}'" for a, b in _SWAP.items())
_MAY = "WHEN f = '%d %B %Y' AND month(d) = 5 THEN '%d %b %Y' WHEN f = '%B %d, %Y' AND month(d) = 5 THEN '%b %d, %Y'"


@query(f"""WITH o AS (SELECT o_orderdate::DATE AS d, {_LISTED}[o_orderkey % {len(_FORMATS)} + 1] AS f, o_orderkey % 86400 AS s FROM orders),
p AS (SELECT CASE {_SWAPPED} {_MAY} ELSE f END AS format, CASE WHEN f IN ({', '.join(f"'{a}'" for a in _SWAP)}) AND day(d) <= 12 THEN make_date(year(d), day(d), month(d)) ELSE d END AS d,
CASE WHEN contains(f, '%S') THEN s WHEN contains(f, '%M') THEN s - s % 60 ELSE 0 END AS s FROM o)
SELECT format, count(*) AS n, sum((d - DATE '1970-01-01')::BIGINT * 86400 + s)::BIGINT AS total FROM p GROUP BY format""")
def every_date_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates written in all known formats, and what they are read as."""
    seconds = F.unix_date(F.to_date("o_orderdate")).cast("long") * 86400 + F.col("o_orderkey") % 86400
    text = F.lit(None).cast("string")
    for k, fmt in enumerate(_FORMATS):
        text = F.when(F.col("o_orderkey") % len(_FORMATS) == k, dates.render_date(seconds, fmt)).otherwise(text)
    parsed = table(spark, sf_dir, "orders").select(text.alias("v")).select(F.inline(F.array_compact(F.array(dates.parse_date(F.col("v"))))))
    return parsed.groupBy("format").agg(F.count(F.lit(1)).alias("n"), F.sum("seconds").alias("total"))


@query(" UNION ALL ".join(f"SELECT '{f}' AS format, min(strftime(o_orderdate, '{f}')) AS low, max(strftime(o_orderdate, '{f}')) AS high, count(DISTINCT strftime(o_orderdate, '{f}')) AS n FROM orders" for f in _FORMATS))
def rendered_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates written in all known formats."""
    seconds = F.unix_date(F.to_date("o_orderdate")).cast("long") * 86400
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("format"), dates.render_date(seconds, f).alias("v")) for f in _FORMATS))).alias("x")
    return table(spark, sf_dir, "orders").select(each).groupBy("x.format").agg(F.min("x.v").alias("low"), F.max("x.v").alias("high"), F.count_distinct("x.v").alias("n"))


@query("SELECT 0::BIGINT AS first, count(*) FILTER (WHERE day(o_orderdate) > 12) AS second FROM orders WHERE o_orderkey % 2 = 1")
def month_first_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How dates with the month first vote for their order."""
    first, second = dates.month_first_votes(F.date_format("o_orderdate", "MM/dd/yyyy"))
    return table(spark, sf_dir, "orders").filter(F.col("o_orderkey") % 2 == 1).agg(F.sum(first).alias("first"), F.sum(second).alias("second"))


_NAMES = list(detect.PROVINCE_LOOKUP.items())


@query("SELECT abbr, count(*) AS n FROM (SELECT [" + ", ".join(f"'{a}'" for _, a in _NAMES) + f"][c_custkey % {len(_NAMES)} + 1] AS abbr FROM customer) GROUP BY abbr")
def province_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All names and abbreviations of provinces, in upper case and with a full stop for every other customer."""
    name = F.element_at(F.array(*(F.lit(n) for n, _ in _NAMES)), (F.col("c_custkey") % len(_NAMES) + 1).cast("int"))
    v = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.upper(name), F.lit("."))).otherwise(name)
    return table(spark, sf_dir, "customer").groupBy(detect.province_of(v).alias("abbr")).agg(F.count(F.lit(1)).alias("n"))


_WRITINGS = {
    "1|1|2|0|0": "CASE WHEN x < 0 THEN '-' ELSE '' END || '$' || format('{:,.2f}', abs(x))", "0|0|2|0|1": "CASE WHEN x < 0 THEN '-' ELSE '' END || format('{:.2f}', abs(x)) || '%'",
    "0|0|3|9|0": "CASE WHEN x < 0 THEN '-' ELSE '' END || lpad(format('{:.3f}', abs(x)), 13, '0')",
}


@query(" UNION ALL ".join(f"SELECT c_custkey, '{k}' AS format, {sql} AS v FROM (SELECT c_custkey, c_acctbal AS x FROM customer)" for k, sql in _WRITINGS.items()))
def written_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers in some formats, with currency, thousands, leading zeros and percent signs."""
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("format"), numbers.format_number(F.col("c_acctbal"), k).alias("v")) for k in _WRITINGS))).alias("x")
    return table(spark, sf_dir, "customer").select("c_custkey", each).select("c_custkey", "x.format", "x.v")


@query(f"SELECT {_MASK.format('c_name')} AS mask, {_MASK.format('c_name')} AS filled, count(*) AS n, true AS all_new FROM customer GROUP BY 1")
def filled_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks filled with other characters have the same masks."""
    mask = shape.mask_of(F.col("c_name"))
    df = table(spark, sf_dir, "customer").select("c_name", mask.alias("mask"), shape.fill_mask(mask, "4", "name", 0, F.col("c_custkey")).alias("v"))
    share = F.count_if(F.col("v") == F.col("c_name")) <= 0.01 * F.count(F.lit(1))
    return df.groupBy("mask", shape.mask_of(F.col("v")).alias("filled")).agg(F.count(F.lit(1)).alias("n"), share.alias("all_new"))


@query("SELECT count(*) AS n, count(*) AS valid, count(*) AS nine FROM customer")
def new_check_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New nine-digit numbers pass the Luhn check, by a count of their digits."""
    df = table(spark, sf_dir, "customer").select(numbers.new_sin("8", "sin", 0, F.col("c_custkey")).alias("v"))
    digit = lambda i: F.substring("v", i, 1).cast("int") * (2 - i % 2)
    total = sum(F.when(digit(i) > 9, digit(i) - 9).otherwise(digit(i)) for i in range(1, 10))
    return df.agg(F.count(F.lit(1)).alias("n"), F.count_if(total % 10 == 0).alias("valid"), F.count_if(F.col("v").rlike("^[1-7][0-9]{8}$")).alias("nine"))


#: Text formats: encoding, delimiter, whether all cells are quoted, line end.
_FORMS = {"legacy": ("cp1252", ";", False, "\r\n"), "marked": ("utf-8-sig", "\t", False, "\n"), "quoted": ("utf-8", "|", True, "\n"), "plain": ("utf-8", ",", False, "\r\n")}
_SAID = "s_name || CASE s_suppkey % 4 WHEN 0 THEN ' \"Ltée\"' WHEN 1 THEN ' a;b,c|d' WHEN 2 THEN ' –' ELSE '' END"


def _folder(spark: SparkSession) -> Path:
    """A folder of this run's files, which go at exit or with the shared folder."""
    return local_folder(spark, "files")


@query(f"SELECT form, format('{{:.2f}}', s_acctbal) AS balance, {_SAID} AS said, s_suppkey::VARCHAR AS id FROM supplier, (SELECT unnest([{', '.join(repr(f) for f in _FORMS)}]) AS form)")
def text_files_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text files of several encodings, delimiters and line ends, written, found out and read."""
    rows = table(spark, sf_dir, "supplier").select(F.format_string("%.2f", "s_acctbal").alias("balance"), F.expr(_SAID).alias("said"), F.col("s_suppkey").cast("string").alias("id"))
    folder, out = _folder(spark), None
    for name, form in _FORMS.items():
        path = sinks.write_text(rows, rows.columns, TextFormat(*form, True), folder / f"{name}.txt")
        source = open_source(spark, path)
        if (source.text.encoding, source.text.delimiter, source.text.line_end) != (form[0], form[1], form[3]) or source.columns != rows.columns:
            raise RuntimeError(f"{name} was taken for {source.describe()}")
        part = source.data.select(F.lit(name).alias("form"), *(F.col(f"c{i}").alias(c) for i, c in enumerate(rows.columns)))
        out = part if out is None else out.unionAll(part)
    return out


_LATE = "CASE WHEN o_orderkey > 0.9 * (SELECT max(o_orderkey) FROM orders) THEN 'two' || chr(10) || 'lines; \"' || o_orderstatus || '\"' || chr(13) || chr(10) ELSE o_orderpriority END"


@query(f"SELECT o_orderkey::VARCHAR AS id, {_LATE} AS said, format('{{:.2f}}', o_totalprice) AS price FROM orders")
def late_line_feeds_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file whose cells have line feeds and quotes only near its end, read by ranges of 64 KiB."""
    orders = table(spark, sf_dir, "orders")
    late = F.col("o_orderkey") > 0.9 * F.lit(orders.agg(F.max("o_orderkey")).first()[0])
    said = F.when(late, F.concat(F.lit('two\nlines; "'), F.col("o_orderstatus"), F.lit('"\r\n'))).otherwise(F.col("o_orderpriority"))
    rows = orders.select(F.col("o_orderkey").cast("string").alias("id"), said.alias("said"), F.format_string("%.2f", "o_totalprice").alias("price"))
    source = open_text(spark, sinks.write_text(rows, rows.columns, TextFormat("utf-8", ";", False, "\n", True), _folder(spark) / "late.csv"), range_bytes=1 << 16)
    return source.data.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(source.columns)))


@query("""SELECT l_linenumber::BIGINT AS line, count(*) AS n, min(CASE WHEN l_orderkey % 1000 = 999 THEN 'café –' ELSE 'plain' END) AS said, sum(l_quantity)::BIGINT AS quantity, 'cp1252' AS encoding FROM lineitem GROUP BY 1""")
def late_bytes_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file whose bytes stop being UTF-8 only after those that are: put in order so that they come last."""
    late = F.col("l_orderkey") % 1000 == 999
    rows = table(spark, sf_dir, "lineitem").orderBy(late, "l_orderkey", "l_linenumber").select(
        F.col("l_linenumber").cast("string").alias("line"), F.col("l_quantity").cast("int").cast("string").alias("quantity"),
        F.when(late, "café –").otherwise("plain").alias("said"), F.repeat(F.lit("-"), 80).alias("filler"),
    )
    source = open_source(spark, sinks.write_text(rows, rows.columns, TextFormat("cp1252", ";", False, "\n", True), _folder(spark) / "late.csv"))
    read = source.data.groupBy(F.col("c0").cast("long").alias("line"))
    return read.agg(F.count(F.lit(1)).alias("n"), F.min("c2").alias("said"), F.sum(F.col("c1").cast("long")).alias("quantity")).withColumn("encoding", F.lit(source.text.encoding))


@query("SELECT count(*) AS n, count(*) FILTER (WHERE c_custkey % 7 IN (1, 2)) AS ragged, count(*) FILTER (WHERE c_custkey % 7 = 1) AS filled FROM customer")
def ragged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a file, and those with fewer or more fields than its header."""
    key = F.col("c_custkey")
    fields = F.when(key % 7 == 1, F.array(key.cast("string"), "c_name")).otherwise(F.array(key.cast("string"), F.col("c_name"), F.col("c_mktsegment")))
    fields = F.when(key % 7 == 2, F.array_append(fields, F.lit("more"))).otherwise(fields)
    lines = table(spark, sf_dir, "customer").select(F.concat_ws("|", fields).alias("c0"))
    path = sinks.write_text(lines, ["id|name|segment"], TextFormat("utf-8", "\t", False, "\n", True), _folder(spark) / "ragged.txt")
    source = open_source(spark, path)
    n, ragged = source.rows_and_ragged()
    counted = source.data.agg(F.count_if(F.col("c2") == "").alias("filled"))
    return counted.select(F.lit(n).cast("long").alias("n"), F.lit(ragged).cast("long").alias("ragged"), "filled")


@query("SELECT o_orderstatus AS status, count(*) AS n, round(sum(o_totalprice), 2) AS total, min(o_orderkey) AS low, max(o_orderdate::DATE) AS last FROM orders GROUP BY 1")
def typed_files_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Parquet file read as text, its texts turned to the file's types again, and written as one file."""
    source = open_source(spark, f"{sf_dir}/orders.parquet")
    typed = [sinks.coerced(F.col(f"c{i}"), f.dataType).alias(f.name) for i, f in enumerate(source.schema.fields)]
    path = sinks.write_parquet(source.data.select(*typed), _folder(spark) / "orders.parquet")
    again = spark.read.parquet(str(path))
    return again.groupBy(F.col("o_orderstatus").alias("status")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.min("o_orderkey").alias("low"), F.max(F.to_date("o_orderdate")).alias("last")
    )


@query("""SELECT 'o_orderkey' AS name, 'numeric_range' AS type, min(o_orderkey)::VARCHAR AS low, max(o_orderkey)::VARCHAR AS high, NULL AS codes FROM orders
UNION ALL SELECT 'o_orderdate', 'date_range', min(o_orderdate::DATE)::VARCHAR, max(o_orderdate::DATE)::VARCHAR, NULL FROM orders
UNION ALL SELECT 'o_orderstatus', 'code_set', NULL, NULL, (SELECT string_agg(s, ',' ORDER BY s) FROM (SELECT DISTINCT o_orderstatus AS s FROM orders))
UNION ALL SELECT 'o_orderpriority', 'code_set', NULL, NULL, (SELECT string_agg(s, ',' ORDER BY s) FROM (SELECT DISTINCT o_orderpriority AS s FROM orders))""")
def inferred_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What columns of a file could be generated as, with their spans and codes."""
    found = infer_schema(f"{sf_dir}/orders.parquet", ["o_orderkey", "o_orderdate", "o_orderstatus", "o_orderpriority"], rows=1 << 30, spark=spark)
    rows = []
    for c in found.spec.columns:
        low, high = (c.params.get(a, c.params.get(b)) for a, b in (("min", "start"), ("max", "end")))
        rows.append((c.name, c.type, *(None if x is None else str(x) for x in (low, high)), ",".join(sorted(c.params["values"])) if "values" in c.params else None))
    return spark.createDataFrame(rows, "name string, type string, low string, high string, codes string")
