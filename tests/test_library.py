import csv
import datetime as dt

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from loomery import ColumnSpec, DatasetSpec, SchemaError, csv_to_yaml, generate_dataset, infer_schema, load_schema, validate_schema
from loomery.functions import dates, numbers, shape
from loomery.functions.keys import leak_keys
from loomery.operators.detect import column_hint, decide, rate_columns
from loomery.plans.compile import compile_spec
from loomery.plans.spec import dump_schema


def values(spark, rows, *columns):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, v string")
    return [tuple(r)[1:] for r in df.select("i", *columns).orderBy("i").collect()]


def read(path):
    with open(path, newline="", encoding="utf-8") as file:
        return list(csv.DictReader(file))


def test_headers_speak_for_kinds():
    speaks = {
        "email": ["Courriel", "work_email_2"], "phone": ["cellPhone", "FAX"], "postal_code": ["ship_zip", "CodePostal"], "sin": ["employee NAS"], "date": ["dteHired", "birthYear"],
        "last_name": ["nom", "MotherSurname"], "full_name": ["Assigned Officer", "spouse_name", "display-name"], "city": ["Home Town"], "free_text": ["memo"], "identifier": ["claimRef", "uuid"],
        "street_address": ["addr2"], None: ["colour", "businessKind", "weight"],
    }
    for kind, headers in speaks.items():
        assert [column_hint(h) for h in headers] == [kind] * len(headers)


def kind_of(spark, header, cells):
    got = spark.createDataFrame([(c,) for c in cells], "v string").agg(*(c.alias(k) for k, c in rate_columns(F.col("v")).items())).first().asDict()
    return decide(header, got, len(set(cells)), len(cells)).kind


def test_cells_speak_for_kinds(spark):
    luhn = [f"{n}{(10 - sum(sum(divmod(2 * int(d), 10)) if k % 2 else int(d) for k, d in enumerate(str(n))) % 10) % 10}" for n in range(41_250_700, 41_250_760)]
    assert kind_of(spark, "q1", luhn) == "sin" == kind_of(spark, "NAS", [f"{x[:3]}.{x[3:6]}.{int(x[6:]) ^ 1:03d}" for x in luhn])
    assert kind_of(spark, "q2", [f"desk{k}@unit-{k % 4}.example.net" for k in range(40)]) == "email"
    assert kind_of(spark, "q3", [f"h{k % 10}X{'  ' * (k % 2)}4y{k // 10}" for k in range(60)]) == "postal_code"
    assert kind_of(spark, "q4", [f"1-{204 + k} 55{k % 10}-{1000 + k}" for k in range(50)]) == "phone" == kind_of(spark, "fax", [f"+{90_000_000 + k}" for k in range(50)])
    assert kind_of(spark, "q5", [(dt.date(1999, 12, 28) + dt.timedelta(days=9 * k)).strftime(("%d.%m.%Y", "%d-%b-%y")[k % 2]) for k in range(70)]) == "date"
    assert kind_of(spark, "q6", ["Nunavut", "yk", "NWT", "pei", "Alta."] * 9) == "province"
    assert kind_of(spark, "prenom", ["Siobhan", "Anne-Lise", "Zoë"] * 12) == "first_name" and kind_of(spark, "ville", ["Sault-au-Récollet", "Flin Flon"] * 20) == "city"
    assert kind_of(spark, "q7", [f"{k} Chemin du Lac" for k in range(3, 60)]) == "street_address"
    assert kind_of(spark, "q8", ["Up", "Down", "Sideways"] * 15) == "category" and kind_of(spark, "q9", [f"{'Ab'[k % 2]}x{'cdefghij'[k % 8]} Qu{'aeiou'[k % 5]}n{'t' * (k % 7 + 1)}".title() for k in range(60)]) == "full_name"
    assert kind_of(spark, "q10", [f"-{k}.{k % 7}%" for k in range(80)]) == "numeric" and kind_of(spark, "q11", [f"{k * 31:06d}" for k in range(1, 90)]) == "identifier"
    assert kind_of(spark, "q12", [f"Item number {k} was sent back to the shelf" for k in range(60)]) == "free_text"
    assert kind_of(spark, "q13", [f"{k:x}z{k % 3}" for k in range(200, 260)]) == "identifier" and kind_of(spark, "q14", []) == "empty"
    assert kind_of(spark, "q15", [f"zz{k % 55}" for k in range(99)]) == "unknown"


def test_numbers_are_taken_apart_and_put_together(spark):
    v = F.col("v")
    written = {"-$12,000.0": (-12000.0, "1|1|1|0|0"), "00042": (42.0, "0|0|0|5|0"), "+.75%": (0.75, "0|0|2|0|1"), "9": (9.0, "0|0|0|0|0")}
    for text, want in written.items():
        ((got,),) = values(spark, [text], numbers.parse_number(v))
        assert tuple(got) == want
        ((again,),) = values(spark, [str(want[0])], numbers.format_number(v.cast("double"), want[1]))
        assert again == text.lstrip("+").replace(".75", "0.75")
    assert values(spark, ["12,34", "--1", "$", "1e5", "7 %", "\x01a|b|c|d|e"], numbers.parse_number(v)) == [(None,)] * 6


def test_check_digits_and_shapes(spark):
    v, row = F.col("v"), F.col("i").cast("long")
    assert values(spark, ["7992-7398-713", "79927398710", "no digits"], numbers.luhn_ok(v)) == [(True,), (False,), (False,)]
    assert all(ok for (ok,) in values(spark, ["."] * 40, numbers.luhn_ok(numbers.new_sin("9", "n", 3, row))))
    assert values(spark, ["Zq-04_Ü!", ""], shape.mask_of(v)) == [("Aa-99_A!",), ("",)]
    ((one,), (two,)) = values(spark, ["aA.9"] * 2, shape.fill_mask(v, "5", "m", 1, row))
    for text in (one, two):
        assert text[0].islower() and text[1].isupper() and text[2] == "." and text[3].isdigit()
    assert values(spark, ["(99)9-A"], shape.fill_mask_with(v, F.lit("481K"), "5", "m", 0, row)) == [("(48)1-K",)]
    assert values(spark, ["d'arcy ST-PIERRE"], shape.title_case(v), shape.case_style(v)) == [("D'Arcy St-Pierre", "mixed")]


def test_every_date_format_is_read(spark):
    moment = dt.datetime(1987, 4, 23, 6, 5, 9)
    for fmt, _ in dates.DATE_FORMATS:
        text = moment.strftime(fmt)
        kept = dt.datetime.strptime(text, fmt)
        ((got, late),) = values(spark, [text], dates.parse_date(F.col("v")), dates.parse_date(F.col("v"), True))
        assert got.seconds == late.seconds == int((kept - dt.datetime(1970, 1, 1)).total_seconds()) and got.format == fmt
        ((again,),) = values(spark, [text], dates.render_date(F.lit(got.seconds), fmt))
        assert again == text


def test_dates_that_need_care(spark):
    day = lambda *d: int((dt.datetime(*d) - dt.datetime(1970, 1, 1)).total_seconds())
    want = {
        "29/02/2024": day(2024, 2, 29), "29/02/2023": None, "1/12/68": day(2068, 12, 1), "7-Sep-70": day(1970, 9, 7), "august   9, 1904": day(1904, 8, 9), "20231123": day(2023, 11, 23),
        "1799-12-31": None, "2024-06-31": None, "later on 3": None, "11.12.13": None, "2024/1/2": day(2024, 1, 2), "2001-02-03T24:00:00": None,
    }
    assert [g and g.seconds for (g,) in values(spark, list(want), dates.parse_date(F.col("v")))] == list(want.values())
    ((usual, late),) = values(spark, ["04-11-1999"], dates.parse_date(F.col("v")), dates.parse_date(F.col("v"), True))
    assert (usual.seconds, late.seconds) == (day(1999, 11, 4), day(1999, 4, 11))


def test_leak_keys_meet_across_writings(spark):
    keys = lambda text: set(values(spark, [text], leak_keys(F.col("v")))[0][0])
    for one, two in (("88-12 A7", "8812a7"), ("Vega y Luna, Pia", "pia LUNA  y vega"), (" (204) 555.0199", "2045550199")):
        assert keys(one) & keys(two)
    assert not keys("8812a7") & keys("8812a8") and not keys("SK")


def spec(tmp_path, *columns, **options):
    return DatasetSpec(output_dir=str(tmp_path), columns=list(columns), **options)


def test_generate(spark, tmp_path):
    s = spec(tmp_path, ColumnSpec("id", "sequence", params={"start": 100, "step": 2}), ColumnSpec("arm", "code_set", params={"values": ["A", "B", "C"]}), ColumnSpec("v", "constant", 50.0, params={"value": "x"}), rows=200, seed=7, formats=["csv", "parquet"])
    stats = generate_dataset(s, chunk_size=10)
    rows = read(tmp_path / "synthetic.csv")
    assert stats["rows"] == len(rows) == 200 and list(rows[0]) == ["id", "arm", "v"] and [r["id"] for r in rows[:3]] == ["100", "102", "104"]
    assert 40 < sum(r["v"] == "" for r in rows) < 160 and {r["arm"] for r in rows} == set("ABC")
    assert pq.read_table(tmp_path / "synthetic.parquet").num_rows == 200
    assert compile_spec(spark, s, partitions=1).collect() == compile_spec(spark, s, partitions=16).orderBy("id").collect()
    assert generate_dataset(s, tmp_path / "none", rows=0)["rows"] == 0 and (tmp_path / "none" / "synthetic.parquet").exists()


def test_invalid_specifications(spark, tmp_path):
    bad = spec(tmp_path / "x", ColumnSpec("a", "needs_mapping"), ColumnSpec("a", "code_set"), ColumnSpec("p", "passthrough", params={"source_column": "x"}), ColumnSpec("f", "faker", params={"provider": "nothing"}))
    assert len(validate_schema(bad)) == 5
    with pytest.raises(SchemaError):
        generate_dataset(bad)
    assert not (tmp_path / "x").exists()
    with pytest.raises(SchemaError, match="unique"):
        compile_spec(spark, spec(tmp_path, ColumnSpec("u", "numeric_range", unique=True, params={"min": 1, "max": 5}), rows=6))


def test_passthrough_and_unique(spark, tmp_path):
    pq.write_table(pa.table({"city": ["Ajax", None, "Hull"]}), tmp_path / "ref.parquet")
    s = spec(tmp_path, ColumnSpec("c", "passthrough", params={"source_column": "city"}), ColumnSpec("u", "numeric_range", unique=True, params={"min": 1, "max": 30}), rows=30)
    rows = compile_spec(spark, s, reference=str(tmp_path / "ref.parquet")).collect()
    assert {r.c for r in rows} == {"Ajax", "Hull"} and sorted(r.u for r in rows) == list(range(1, 31))


def test_yaml_and_catalogue(tmp_path):
    path = tmp_path / "columns.csv"
    path.write_text('name,type,provider,kwargs_json,values,weights,missing_pct\nid,sequence,,,,,\nage,faker,random_int,"{""min"": 18, ""max"": 90}",,,\narm,code_set,,,A|B|C,0.5|0.25|0.25,10\n')
    s = csv_to_yaml(path, tmp_path / "s.yaml", rows=500)
    again = load_schema(tmp_path / "s.yaml")
    assert validate_schema(s) == [] and again == s and dump_schema(again) == dump_schema(s)
    by = {c.name: c for c in again.columns}
    assert by["age"].params["kwargs"] == {"min": 18, "max": 90} and by["arm"].params["weights"] == [0.5, 0.25, 0.25] and by["arm"].missing_pct == 10


def test_infer(spark, tmp_path):
    pq.write_table(pa.table({"age": [20, 25, 55, 30, 41, 33, 28, 39], "region": ["North", "South", "East", "North"] * 2, "free": [f"x{i}" for i in range(8)]}), tmp_path / "a.parquet")
    found = infer_schema(tmp_path / "a.parquet", rows=8, threshold=3).spec
    kinds = {c.name: c for c in found.columns}
    assert kinds["age"].type == "numeric_range" and (kinds["age"].params["min"], kinds["age"].params["max"]) == (20, 55)
    assert set(kinds["region"].params["values"]) == {"North", "South", "East"} and kinds["free"].type == "needs_mapping"
    (tmp_path / "v.csv").write_text("v\n" + "\n".join(map(str, range(100))))
    part = infer_schema(tmp_path / "v.csv", ["v"], rows=10, row_offset=90).spec.columns[0]
    assert (part.params["min"], part.params["max"]) == (90, 99)


def test_columns_with_odd_names(spark, tmp_path):
    odd = ["a`b", "c.d", "e f", "g\"h"]
    pq.write_table(pa.table({n: [f"{n}{k % 3}" for k in range(9)] for n in odd}), tmp_path / "odd.parquet")
    found = infer_schema(tmp_path / "odd.parquet", rows=9, threshold=5).spec
    assert {c.name: sorted(c.params["values"]) for c in found.columns} == {n: [f"{n}{k}" for k in range(3)] for n in odd}
    s = spec(tmp_path, *(ColumnSpec(n, "passthrough", params={"source_column": n}) for n in odd), rows=20)
    assert {r[0] for r in compile_spec(spark, s, reference=str(tmp_path / "odd.parquet")).collect()} == {"a`b0", "a`b1", "a`b2"}
    assert generate_dataset(found, tmp_path / "out", rows=6)["rows"] == 6 and list(read(tmp_path / "out" / "synthetic.csv")[0]) == odd


def test_stream(spark):
    from loomery.streaming import generate_stream

    df = generate_stream(spark, DatasetSpec(columns=[ColumnSpec("id", "sequence")]))
    assert df.isStreaming and df.columns == ["id"]


def test_entry_has_sql_only_for_its_queries():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_optional_parts(tmp_path):
    """Without both folders, or only one and the pipeline's file, the library's own queries are all there."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    here = Path(__file__).resolve().parents[1]
    for gone in (["loomery/llm", "tests/llm"], ["loomery/llm", "tests/llm", "corpus_pipeline.py"]):
        copy = tmp_path / str(len(gone))
        shutil.copytree(here, copy, ignore=shutil.ignore_patterns(".git", "__pycache__"))
        for name in gone:
            shutil.rmtree(copy / name) if (copy / name).is_dir() else (copy / name).unlink(missing_ok=True)
        code = "import __spark_entry__ as e; q = e.queries(); assert len(q) >= 30 and not any(n.startswith('op') or n == 'pipeline' for n in q) and set(e.oracle_sql()) <= set(q)"
        subprocess.run([sys.executable, "-c", code], cwd=copy, check=True)
