"""Queries over the test tables that exercise the library's operators, and DuckDB SQL that must agree."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.functions import dates, numbers, providers, rng, shape
from loomery.functions.keys import leak_keys
from loomery.operators import detect, leaks, profile
from loomery.plans.compile import compile_spec
from loomery.plans.infer import slice_rows, value_counts
from loomery.plans.spec import ColumnSpec, DatasetSpec
from loomery.plans.twin import hash_sample, safe_twin
from loomery.sources.shared import tables_until_exit

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _once(parsed: Column) -> Column:
    """The fields of a struct as columns, worked out once a row; rows where it is null are left out."""
    return F.inline(F.array_compact(F.array(parsed)))


def _u(column: str, draw: object = 0, seed: int = 42, row: str = "i") -> str:
    """rng.uniform in SQL."""
    return f"(('0x' || substr(md5('{seed}|{column}|{draw}|' || {row}), 1, 8))::BIGINT / 4294967296.0)"


SPEC = DatasetSpec(rows=20_000, seed=42, columns=[
    ColumnSpec("subject_id", "sequence", params={"start": 100, "step": 2}),
    ColumnSpec("arm", "code_set", params={"values": ["Placebo", "DrugA", "DrugB"], "weights": [0.34, 0.33, 0.33]}),
    ColumnSpec("site", "code_set", params={"values": ["N", "S", "E", "W"]}),
    ColumnSpec("age", "numeric_range", params={"min": 18, "max": 90}),
    ColumnSpec("weight", "numeric_range", dtype="float", params={"min": 40, "max": 120}),
    ColumnSpec("enrolled", "date_range", params={"start": "2023-01-01", "end": "2024-12-31"}),
    ColumnSpec("status", "constant", params={"value": "Active"}),
    ColumnSpec("note", "constant", missing_pct=15.0, params={"value": "seen"}),
])


@query(f"""
WITH s AS (SELECT list(o_orderpriority ORDER BY o_orderpriority) AS sites, count(*) AS n FROM (SELECT DISTINCT o_orderpriority FROM orders)), a AS (SELECT min(p_size) AS low, max(p_size) AS high FROM part)
SELECT 100 + 2 * i AS subject_id,
  CASE WHEN {_u('arm')} * 1.0 < 0.34 THEN 'Placebo' WHEN {_u('arm')} * 1.0 < 0.67 THEN 'DrugA' ELSE 'DrugB' END AS arm,
  sites[floor({_u('site')} * s.n)::INT + 1] AS site, low + floor({_u('age')} * (high - low + 1))::BIGINT AS age, round(40 + {_u('weight')} * 80, 6) AS weight,
  strftime(DATE '2023-01-01' + floor({_u('enrolled')} * 731)::INT, '%Y-%m-%d') AS enrolled, 'Active' AS status,
  CASE WHEN {_u('note', 'missing')} * 100 >= 15 THEN 'seen' END AS note
FROM range((SELECT count(*) FROM orders)) t(i), s, a""")
def generate_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All plain column types of a specification: as many rows as orders, with codes and a range that tables have."""
    orders = table(spark, sf_dir, "orders")
    sites = [r[0] for r in orders.select("o_orderpriority").distinct().orderBy("o_orderpriority").collect()]
    span = table(spark, sf_dir, "part").agg(F.min("p_size").alias("min"), F.max("p_size").alias("max")).first().asDict()
    given = {"site": {"values": sites}, "age": span}
    columns = [replace(c, params=given.get(c.name, c.params)) for c in SPEC.columns]
    return compile_spec(spark, replace(SPEC, rows=orders.count(), columns=columns)).withColumn("weight", F.round("weight", 6))


@query("""SELECT count(*) AS n, count(*) AS distinct_codes, min(c_custkey) AS low, max(c_custkey) AS high, count(*) AS distinct_mails, count(*) AS distinct_towns, count(*) AS plain_mails
FROM (SELECT unnest(range(min(c_custkey), max(c_custkey) + 1)) AS c_custkey FROM customer)""")
def generate_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unique values for all customers' keys: all of a range, each once, and values of providers that are made of parts."""
    low, high = table(spark, sf_dir, "customer").agg(F.min("c_custkey"), F.max("c_custkey")).first()
    faker = lambda name, provider: ColumnSpec(name, "faker", unique=True, params={"provider": provider})
    spec = DatasetSpec(rows=high - low + 1, seed=1, columns=[ColumnSpec("code", "numeric_range", unique=True, params={"min": low, "max": high}), faker("mail", "email"), faker("town", "street_address")])
    return compile_spec(spark, spec).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("code").alias("distinct_codes"), F.min("code").alias("low"), F.max("code").alias("high"),
        F.count_distinct("mail").alias("distinct_mails"), F.count_distinct("town").alias("distinct_towns"), F.count_if(F.col("mail").rlike(r"^[a-z]+\.[a-z]+\d{1,2}@[a-z.]+$")).alias("plain_mails"),
    )


@query(f"""
WITH pool AS (SELECT n_name AS v, row_number() OVER (ORDER BY n_nationkey) - 1 AS k FROM (SELECT * FROM nation ORDER BY n_nationkey LIMIT 20)),
rows AS (SELECT i, floor({_u('nation')} * 20)::BIGINT AS k FROM range(3000) t(i))
SELECT v AS nation, count(*) AS n FROM rows JOIN pool USING (k) GROUP BY v""")
def passthrough_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values drawn, with replacement, from the first rows of a reference."""
    spec = DatasetSpec(rows=3000, seed=42, columns=[ColumnSpec("nation", "passthrough", params={"source_column": "n_name"})])
    return compile_spec(spark, spec, reference=f"{sf_dir}/nation.parquet", reference_limit=20).groupBy("nation").agg(F.count(F.lit(1)).alias("n"))


#: What values of providers look like.
_LOOKS = {
    "first_name": r"\p{Lu}\p{L}+", "last_name": r"\p{Lu}\p{L}+", "name": r"\p{Lu}\p{L}+ \p{Lu}\p{L}+", "email": r"[a-z]+\.[a-z]+\d{1,2}@[a-z.]+", "free_email_domain": r"[a-z]+\.example\.[a-z]+",
    "city": r"\p{Lu}\p{L}+", "street_name": r"[\p{L} ]+", "street_address": r"\d{1,4} [\p{L} ]+", "phone_number": r"\d{3}-555-\d{4}", "postcode": r"\d{5}", "random_int": r"\d{1,4}", "random_digit": r"\d",
    "pyfloat": r"\d\.\d+(E-\d+)?", "boolean": "true|false", "word": "[a-z]+", "sentence": r"[A-Z][a-z ]+\.", "text": "[A-Z][a-z ]+", "date": r"\d{4}-\d\d-\d\d", "uuid4": "[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}",
    "company": r"\p{L}+ (Ltd|Inc|Group|Partners)", "job": "[a-z-]+", "country": r"\p{Lu}[\p{L} ]+", "country_code": "[A-Z]{2}", "currency_code": "[A-Z]{3}", "color_name": "[a-z]+", "hex_color": "#[0-9a-f]{6}",
    "month_name": "[A-Z][a-z]+", "day_of_week": "[A-Z][a-z]+day", "time": r"([01]\d|2[0-3])(:[0-5]\d){2}", "date_time": r"\d{4}-\d\d-\d\d ([01]\d|2[0-3])(:[0-5]\d){2}", "user_name": r"[a-z]+_[a-z]+\d{1,3}",
    "domain_name": r"[a-z]+-[a-z]+\.(example|test|invalid)", "url": r"https://www\.[a-z]+-[a-z]+\.[a-z]+/", "ipv4": r"10(\.\d{1,3}){3}", "mac_address": "[0-9a-f]{2}(:[0-9a-f]{2}){5}", "credit_card_number": r"9\d{15}",
    "isbn13": r"978\d{10}", "ean13": r"20\d{11}", "iban": r"DE\d{20}", "latitude": r"-?\d{1,2}\.\d+(E-\d+)?", "longitude": r"-?\d{1,3}\.\d+(E-\d+)?", "numerify": r"\d{3}", "lexify": "[a-z]{4}", "bothify": r"\d\d [a-z]{2}",
    "random_element": "[abc]",
}


@query("SELECT provider, count(*) AS n, count(*) AS fitting FROM customer, (SELECT unnest([" + ", ".join(f"'{p}'" for p in _LOOKS) + "]) AS provider) GROUP BY provider")
def generate_providers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every provider, a value for each customer: how many look as they should."""
    columns = [ColumnSpec(name, "faker", params={"provider": name}) for name in providers.PROVIDERS]
    df = compile_spec(spark, DatasetSpec(rows=table(spark, sf_dir, "customer").count(), seed=3, columns=columns))
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("provider"), F.col(c).cast("string").rlike(f"^(?:{_LOOKS[c]})$").alias("fits")) for c in df.columns)))
    return df.select(cells.alias("x")).groupBy("x.provider").agg(F.count(F.lit(1)).alias("n"), F.count_if("x.fits").alias("fitting"))


_MASK = "regexp_replace(regexp_replace(regexp_replace({0}, '[A-Z]', chr(1), 'g'), '[a-z]', 'a', 'g'), '[0-9]', '9', 'g').replace(chr(1), 'A')"


@query(f"SELECT {_MASK.format('c_name')} AS mask, count(*) AS n FROM customer GROUP BY 1 UNION ALL SELECT {_MASK.format('p_name')}, count(*) FROM part GROUP BY 1")
def mask_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [table(spark, sf_dir, "customer").select(F.col("c_name").alias("v")), table(spark, sf_dir, "part").select(F.col("p_name").alias("v"))]
    parts = [d.groupBy(shape.mask_of(F.col("v")).alias("mask")).agg(F.count(F.lit(1)).alias("n")) for d in names]
    return parts[0].unionAll(parts[1])


_MESSY = {0: "' N/A'", 1: "'null '", 2: "'Active'", 3: "''", 4: "'  see file '", 5: "'(blank)'", 6: "'na.'"}
_MESSY_SQL = "CASE o_orderkey % 7 " + " ".join(f"WHEN {k} THEN {v}" for k, v in _MESSY.items()) + " END"


def _messy(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = F.lit(None).cast("string")
    for k, v in _MESSY.items():
        out = F.when(F.col("o_orderkey") % 7 == k, F.lit(v.strip("'"))).otherwise(out)
    return table(spark, sf_dir, "orders").select("o_orderkey", out.alias("v"))


_BLANKS = ", ".join("'" + t + "'" for t in shape.NULL_TOKENS)


@query(f"SELECT substr(v, 1, 20) AS token, count(*) AS n FROM (SELECT {_MESSY_SQL} AS v FROM orders) WHERE trim(v) IN ({_BLANKS}) GROUP BY 1")
def null_token_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _messy(spark, sf_dir).filter(shape.is_blank(F.col("v")))
    return df.groupBy(F.substring("v", 1, 20).alias("token")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT regexp_extract(v, '^( *)', 1) AS lead, trim(v) AS core, CASE WHEN trim(v) = '' THEN '' ELSE regexp_extract(v, '( *)$', 1) END AS trail, count(*) AS n
FROM (SELECT {_MESSY_SQL} AS v FROM orders) GROUP BY ALL""")
def whitespace_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("v")
    return _messy(spark, sf_dir).groupBy(shape.lead(v).alias("lead"), shape.core(v).alias("core"), shape.trail(v).alias("trail")).agg(F.count(F.lit(1)).alias("n"))


_CASED = "CASE p_partkey % 4 WHEN 0 THEN upper(p_name) WHEN 1 THEN lower(p_name) WHEN 2 THEN p_size::VARCHAR ELSE 'mIx' || p_name END"


@query(f"""SELECT CASE WHEN NOT regexp_matches(v, '[A-Za-z]') THEN 'none' WHEN v = upper(v) THEN 'upper' WHEN v = lower(v) THEN 'lower'
WHEN NOT regexp_matches(v, '[A-Za-z][A-Z]') AND NOT regexp_matches(v, '(^|[^A-Za-z])[a-z]') THEN 'title' ELSE 'mixed' END AS style, count(*) AS n FROM (SELECT {_CASED} AS v FROM part) GROUP BY 1""")
def case_style_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    v = F.when(k == 0, F.upper("p_name")).when(k == 1, F.lower("p_name")).when(k == 2, F.col("p_size").cast("string")).otherwise(F.concat(F.lit("mIx"), "p_name"))
    return table(spark, sf_dir, "part").groupBy(shape.case_style(v).alias("style")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT list_aggregate(list_transform(regexp_extract_all(p_type, '[A-Za-z]+|[^A-Za-z]+'), lambda r: upper(r[1]) || lower(substr(r, 2))), 'string_agg', '') AS title, count(*) AS n FROM part GROUP BY 1")
def title_case_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy(shape.title_case(F.col("p_type")).alias("title")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH c AS (SELECT p_name AS v, count(*) AS n FROM part GROUP BY 1)
SELECT CASE WHEN n >= 30 THEN 'category' ELSE 'rare' END AS kind, CASE WHEN n >= 30 THEN v ELSE {_MASK.format('v')} END AS key, sum(n)::BIGINT AS n FROM c GROUP BY 1, 2""")
def kept_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that k rows share keep their name; others are counted by shape."""
    counts = table(spark, sf_dir, "part").groupBy(F.lit(0).alias("col"), F.lit("category").alias("kind"), F.col("p_name").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return profile.kept_categories(counts, 30).select("kind", "key", "n")


@query("SELECT event_type AS category, count(*) AS n FROM events GROUP BY 1 HAVING count(*) >= 5")
def kanon_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("category")).agg(F.count(F.lit(1)).alias("n")).filter("n >= 5")


@query("""WITH r AS (SELECT c_mktsegment AS segment, c_acctbal AS edge, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal) - 1 AS r, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer),
p AS (SELECT segment, n, unnest(range(0, least(20, n - 1) + 1)) AS place FROM (SELECT DISTINCT segment, n FROM r))
SELECT r.segment, place, edge FROM p JOIN r ON r.segment = p.segment AND r.r = round_even(place * (p.n - 1) / least(20, p.n - 1)::DOUBLE, 0)""")
def quantile_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of bins with as many values each."""
    return profile.quantile_edges(table(spark, sf_dir, "customer").withColumnRenamed("c_mktsegment", "segment"), "segment", "c_acctbal")


@query("""WITH t AS (SELECT s_name AS v, unnest(range(1, length(s_name) + 1)) AS p FROM supplier)
SELECT p - 1 AS place, min(v[p]) AS ch FROM t GROUP BY p HAVING min(v[p]) = max(v[p]) AND count(*) >= 5 AND regexp_matches(min(v[p]), '^[A-Za-z0-9]$')""")
def fixed_char_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of a mask where all values have the same character."""
    df = table(spark, sf_dir, "supplier").select(F.lit(0).alias("col"), "s_name")
    return profile.fixed_characters(df, "col", "s_name", 5).select(F.col("place").cast("long").alias("place"), "ch")


_NUMBERS = "CASE l_linenumber % 4 WHEN 0 THEN '$' || format('{:,}', l_partkey * 37) || '.5' WHEN 1 THEN lpad(l_suppkey::VARCHAR, 7, '0') WHEN 2 THEN '-' || l_partkey || '.25%' ELSE 'x' || l_partkey END"


@query(f"""WITH v AS (SELECT {_NUMBERS} AS v FROM lineitem), g AS (SELECT v, regexp_extract(v, '^([+-]?)([$]?)([0-9]{{1,3}}(?:,[0-9]{{3}})+|[0-9]+)?(?:[.]([0-9]+))?(%?)$', ['sign','cur','whole','frac','pct']) AS g FROM v
WHERE regexp_matches(v, '^([+-]?)([$]?)([0-9]{{1,3}}(?:,[0-9]{{3}})+|[0-9]+)?(?:[.]([0-9]+))?(%?)$'))
SELECT concat_ws('|', CASE WHEN g.cur = '$' THEN 1 ELSE 0 END, CASE WHEN contains(g.whole, ',') THEN 1 ELSE 0 END, length(g.frac),
 CASE WHEN length(replace(g.whole, ',', '')) > 1 AND g.whole[1] = '0' THEN length(replace(g.whole, ',', '')) ELSE 0 END, CASE WHEN g.pct = '%' THEN 1 ELSE 0 END) AS format,
 count(*) AS n, round(sum((CASE WHEN g.sign = '-' THEN -1 ELSE 1 END) * (replace(g.whole, ',', '') || '.' || CASE WHEN g.frac = '' THEN '0' ELSE g.frac END)::DOUBLE), 2) AS total FROM g GROUP BY 1""")
def parse_number_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers as they are written: their formats and values."""
    k = F.col("l_linenumber") % 4
    v = F.when(k == 0, F.concat(F.lit("$"), F.format_number(F.col("l_partkey") * 37, 0), F.lit(".5"))).when(k == 1, F.lpad(F.col("l_suppkey").cast("string"), 7, "0"))
    v = v.when(k == 2, F.concat(F.lit("-"), F.col("l_partkey").cast("string"), F.lit(".25%"))).otherwise(F.concat(F.lit("x"), F.col("l_partkey").cast("string")))
    parsed = table(spark, sf_dir, "lineitem").select(v.alias("v")).select(_once(numbers.parse_number(F.col("v"))))
    return parsed.groupBy("format").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


_DATES = "CASE l_linenumber % 4 WHEN 0 THEN strftime(l_shipdate, '%Y-%m-%d') WHEN 1 THEN upper(strftime(l_shipdate, '%d%b%Y')) WHEN 2 THEN strftime(l_shipdate, '%b %d, %Y') ELSE 'soon' END"


@query("""SELECT ['%Y-%m-%d', '%d%b%Y', '%b %d, %Y'][l_linenumber % 4 + 1] AS format, count(*) AS n, min(epoch(l_shipdate::DATE))::BIGINT AS first, max(epoch(l_shipdate::DATE))::BIGINT AS last
FROM lineitem WHERE l_linenumber % 4 < 3 GROUP BY 1""")
def date_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates as they are written: their formats and moments."""
    k, d = F.col("l_linenumber") % 4, F.col("l_shipdate")
    v = F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.upper(F.date_format(d, "ddMMMyyyy"))).when(k == 2, F.date_format(d, "MMM dd, yyyy")).otherwise("soon")
    parsed = table(spark, sf_dir, "lineitem").select(v.alias("v")).select(_once(dates.parse_date(F.col("v"))))
    return parsed.groupBy("format").agg(F.count(F.lit(1)).alias("n"), F.min("seconds").alias("first"), F.max("seconds").alias("last"))


@query("""SELECT count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) AS pairs, round(avg((a <= b)::INT), 6) AS le, round(avg((a >= b)::INT), 6) AS ge
FROM (SELECT epoch(o_orderdate)::BIGINT AS a, epoch(l_shipdate)::BIGINT AS b FROM orders JOIN lineitem ON o_orderkey = l_orderkey)""")
def date_order_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often one date is not after another."""
    both = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    seconds = both.select(F.unix_timestamp("o_orderdate").alias("a"), F.unix_timestamp("l_shipdate").alias("b"))
    return profile.date_pairs(seconds, ["a", "b"]).select(F.col("n").alias("pairs"), F.round("le", 6).alias("le"), F.round("ge", 6).alias("ge"))


_KEYS_SQL = "list_distinct(['#' || array_to_string(t, '')] || CASE WHEN len(t) > 1 THEN ['~' || array_to_string(list_sort(t), ' ')] ELSE [] END)"


@query(f"""WITH cand AS (SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'Nobody' || c_custkey WHEN 1 THEN upper(replace(c_name, '#', ' ')) ELSE replace(c_name, '#', '--') END AS v FROM customer),
c AS (SELECT id, unnest({_KEYS_SQL}) AS key FROM (SELECT id, regexp_extract_all(lower(v), '[a-z0-9]+') AS t FROM cand)),
r AS (SELECT unnest({_KEYS_SQL}) AS key FROM (SELECT regexp_extract_all(lower(c_name), '[a-z0-9]+') AS t FROM customer))
SELECT DISTINCT id FROM c WHERE key IN (SELECT key FROM r)""")
def leak_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that are real names in another writing; one in three is not."""
    customers = table(spark, sf_dir, "customer")
    k = F.col("c_custkey") % 3
    value = F.when(k == 0, F.concat(F.lit("Nobody"), "c_custkey")).when(k == 1, F.upper(F.translate("c_name", "#", " "))).otherwise(F.concat_ws("--", F.split("c_name", "#")))
    return leaks.leaked(customers.select(F.col("c_custkey").alias("id"), value.alias("value")), leaks.real_keys(customers, ["c_name"]), ["id"])


@query("""WITH v AS (SELECT p_partkey, lower(p_name || ' - ' || p_brand) AS v, regexp_extract_all(lower(p_name || ' - ' || p_brand), '[a-z0-9]+') AS t FROM part)
SELECT p_partkey, unnest(['=' || v, '#' || array_to_string(t, ''), '~' || array_to_string(list_sort(t), ' ')]) AS key FROM v""")
def leak_keys_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(leak_keys(F.concat("p_name", F.lit(" - "), "p_brand"))).alias("key"))


@query("SELECT value, count(*) AS n FROM (SELECT unnest([c_name, c_mktsegment, c_nationkey::VARCHAR]) AS value FROM customer) GROUP BY value")
def unpivot_sensitive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.unpivot(table(spark, sf_dir, "customer"), ["c_name", "c_mktsegment", "c_nationkey"]).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH h AS (SELECT *, ('0x' || substr(md5('7|' || o_orderkey || '|' || o_orderstatus || '|' || o_orderpriority), 1, 12))::BIGINT AS h FROM orders)
SELECT o_orderkey, o_orderstatus, o_orderpriority FROM h ORDER BY h LIMIT 500""")
def hash_sample_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows with the least hashes."""
    df = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("a"), F.col("o_orderstatus").alias("b"), F.col("o_orderpriority").alias("c"))
    return hash_sample(df, ["a", "b", "c"], 500, df.count(), 7).select(F.col("a").cast("long").alias("o_orderkey"), F.col("b").alias("o_orderstatus"), F.col("c").alias("o_orderpriority"))


@query("SELECT min(o_totalprice) AS low, max(o_totalprice) AS high, count(*) AS n, count(DISTINCT o_orderstatus) AS states FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 2000 OFFSET 500)")
def infer_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a slice of rows spans."""
    part = slice_rows(table(spark, sf_dir, "orders").orderBy("o_orderkey"), 2000, 500)
    return part.agg(F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"), F.count(F.lit(1)).alias("n"), F.count_distinct("o_orderstatus").alias("states"))


@query("""SELECT 'c_mktsegment' AS column, c_mktsegment AS value, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM customer GROUP BY 2
UNION ALL SELECT 'c_nationkey', c_nationkey::VARCHAR, count(*), round(count(*) / sum(count(*)) OVER (), 6) FROM customer GROUP BY 2""")
def weighted_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequent values with their shares."""
    return value_counts(table(spark, sf_dir, "customer"), ["c_mktsegment", "c_nationkey"], 50)


_DIGITS = "lpad((c_custkey * 7919)::VARCHAR, 9, '0')"


@query(f"""WITH d AS (SELECT {_DIGITS} AS v FROM customer)
SELECT count(*) AS n, count(*) FILTER (WHERE list_sum(list_transform(range(1, 10), lambda i: CASE WHEN i % 2 = 1 THEN v[i]::INT WHEN v[i]::INT > 4 THEN v[i]::INT * 2 - 9 ELSE v[i]::INT * 2 END)) % 10 = 0) AS valid FROM d""")
def luhn_valid_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.lpad((F.col("c_custkey") * 7919).cast("string"), 9, "0")
    return table(spark, sf_dir, "customer").agg(F.count(F.lit(1)).alias("n"), F.count_if(numbers.luhn_ok(v)).alias("valid"))


@query("""SELECT round(avg(length(p_name)), 6) AS length, round(avg(len(string_split(p_name, ' '))), 6) AS words, round(avg(regexp_matches(p_name, '^[0-9]')::INT), 6) AS leading,
count(DISTINCT p_name) AS n_distinct, count(*) AS n FROM part""")
def text_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Averages that detection looks at."""
    r = detect.rate_columns(F.col("p_name"))
    return table(spark, sf_dir, "part").agg(
        F.round(r["length"], 6).alias("length"), F.round(r["words"], 6).alias("words"), F.round(r["leading_zero"], 6).alias("leading"), F.count_distinct("p_name").alias("n_distinct"), F.count(F.lit(1)).alias("n")
    )


_CONTACTS = """SELECT CASE c_custkey % 6 WHEN 0 THEN substr(d, 1, 3) || '-' || substr(d, 4, 3) || '-' || substr(d, 7) WHEN 1 THEN lower(c_mktsegment) || c_custkey || '@mail.ca'
WHEN 2 THEN 'K' || (c_custkey % 10) || 'A 1b2' WHEN 3 THEN '+1 416 555-' || lpad((c_custkey % 10000)::VARCHAR, 4, '0') WHEN 4 THEN 'Ontario' ELSE c_custkey || ' Main Street' END AS v
FROM (SELECT *, lpad((c_custkey * 7919)::VARCHAR, 9, '0') AS d FROM customer)"""


@query(f"""SELECT count(*) FILTER (WHERE regexp_full_match(v, '[0-9]{{3}}[ .-]?[0-9]{{3}}[ .-]?[0-9]{{3}}')) AS sin, count(*) FILTER (WHERE regexp_full_match(v, '[^@ ]+@[^@ ]+[.][A-Za-z]{{2,}}')) AS email,
count(*) FILTER (WHERE regexp_full_match(v, '[A-Za-z][0-9][A-Za-z][ -]*[0-9][A-Za-z][0-9]')) AS postal_code, count(*) FILTER (WHERE regexp_full_match(v, '[0-9 ().+-]+')
 AND length(regexp_replace(v, '[^0-9]', '', 'g')) BETWEEN 7 AND 11) AS phone, count(*) FILTER (WHERE v = 'Ontario') AS province, count(*) FILTER (WHERE regexp_matches(v, '^[0-9]+ Main Street$')) AS street FROM ({_CONTACTS})""")
def conformance_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many values fit each kind."""
    k, d = F.col("c_custkey") % 6, F.lpad((F.col("c_custkey") * 7919).cast("string"), 9, "0")
    v = F.when(k == 0, F.concat_ws("-", F.substring(d, 1, 3), F.substring(d, 4, 3), F.substring(d, 7, 9))).when(k == 1, F.concat(F.lower("c_mktsegment"), "c_custkey", F.lit("@mail.ca")))
    v = v.when(k == 2, F.concat(F.lit("K"), (F.col("c_custkey") % 10).cast("string"), F.lit("A 1b2"))).when(k == 3, F.concat(F.lit("+1 416 555-"), F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0")))
    v = v.when(k == 4, "Ontario").otherwise(F.concat("c_custkey", F.lit(" Main Street")))
    df = table(spark, sf_dir, "customer").select(v.alias("v"))
    kinds = ("sin", "email", "postal_code", "phone", "province")
    return df.agg(*(F.count_if(F.coalesce(detect.conforms(x, F.col("v")), F.lit(False))).alias(x) for x in kinds), F.count_if(F.col("v").rlike(detect.STREET)).alias("street"))


@query("""SELECT CASE o_orderkey % 4 WHEN 0 THEN '{first} {last}' WHEN 1 THEN '{last}, {first}' WHEN 2 THEN '{first} {mi}. {last}' ELSE '{last}, {first} {middle}' END AS template, count(*) AS n FROM orders GROUP BY 1""")
def name_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of people by the order of their parts."""
    k = F.col("o_orderkey") % 4
    v = F.when(k == 0, "Anna Smith").when(k == 1, "O'Neil, Jo").when(k == 2, "Anna M. Smith").otherwise("Smith, Anna Maria")
    return table(spark, sf_dir, "orders").groupBy(profile.name_template(v).alias("template")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT lower(split_part(e, '@', -1)) AS domain, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z0-9._-]+@[A-Za-z0-9-]+[.][A-Za-z]+')) AS e FROM documents) GROUP BY 1 HAVING count(*) >= 2""")
def domain_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z0-9._-]+@[A-Za-z0-9-]+[.][A-Za-z]+)"), F.lit(1))).alias("e"))
    facts = profile.facts("email", F.col("e"), F.col("e"))
    counts = found.select(F.explode(facts).alias("x")).filter("x.kind = 'domain'").groupBy(F.col("x.key").alias("domain")).agg(F.count(F.lit(1)).alias("n"))
    return counts.filter("n >= 2")


@query(f"SELECT c_custkey AS row, round({_u('x', 3, 11, 'c_custkey')}, 9) AS u FROM customer")
def uniform_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A uniform number for each customer."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row"), F.round(rng.uniform(11, "x", 3, F.col("c_custkey")), 9).alias("u"))


@query("""SELECT unnest(['c0', 'c1', 'c2']) AS name, unnest(['identifier', 'numeric', 'category']) AS kind, unnest([count(*), count(*), count(*)]) AS n_values,
unnest([count(DISTINCT c_name), count(DISTINCT c_acctbal), count(DISTINCT c_mktsegment)]) AS n_distinct FROM customer""")
def detect_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of columns, from their values alone."""
    df = table(spark, sf_dir, "customer")
    part = df.select(F.col("c_name").alias("c0"), F.format_string("%.2f", "c_acctbal").alias("c1"), F.col("c_mktsegment").alias("c2"), F.col("c_custkey").alias("_o"))
    profiles, _ = profile.build_profiles(part, ["c0", "c1", "c2"], "_o", exact_distinct=True)
    return spark.createDataFrame([(p.name, p.kind, p.values, p.distinct) for p in profiles], "name string, kind string, n_values long, n_distinct long")


@query("SELECT count(*) AS n, 0::BIGINT AS leaks, 0::BIGINT AS unresolved, count(DISTINCT c_mktsegment) AS segments FROM customer")
def twin_of_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A twin: as many rows, no real name among them, and the segments of the source."""
    df = table(spark, sf_dir, "customer").select(F.col("c_name").alias("c0"), F.format_string("%.2f", "c_acctbal").alias("c1"), F.col("c_mktsegment").alias("c2"))
    n = df.count()
    profiles, groups = profile.build_profiles(df.withColumn("_o", F.monotonically_increasing_id()), ["client", "c_acctbal", "c_mktsegment"], "_o", overrides={"client": "identifier"})
    stats: dict = {}
    tables = tables_until_exit(spark)
    twin = tables.keep(safe_twin(spark, profiles, groups, "1:customer", n, df, ["c0", "c1", "c2"], stats, tables), "twin")  # it is read three times
    hit = leaks.leaked(twin.select(F.col("c0").alias("value")), leaks.real_keys(df, ["c0"]), ["value"])
    return twin.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("c2").alias("segments")).select("n", F.lit(hit.count()).cast("long").alias("leaks"), F.lit(sum(s.unresolved for s in stats.values())).cast("long").alias("unresolved"), "segments")
