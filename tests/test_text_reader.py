"""Text files whatever their quotes, line ends and bytes, against Python's own reader over the whole file."""

import csv
import io
import random

import pytest

from loomery.sources import records
from loomery.sources.readers import open_source


def plainly(data: bytes, encoding: str, delimiter: str, has_header: bool = True):
    """Rows of a file's records, made as long as the first one, and how many were shorter or longer."""
    rows = [r for r in csv.reader(io.StringIO(data.decode(encoding, "replace"), newline=""), delimiter=delimiter) if r]
    n, ragged, out = len(rows[0]), 0, []
    for r in rows[1:] if has_header else rows:
        ragged += len(r) != n
        out.append(tuple((r + [""] * n)[:n]))
    return out, ragged


def read(source):
    return [tuple(r) for r in source.data.select(*(f"c{i}" for i in range(len(source.columns)))).collect()]


CELLS = ["", "a", "b c", '"q"', '"two\nlines"', '"a;b"', '"he said ""no"""', '5" pipe', '"x"y', "é", '"three\r\n\r\nlines;"', "  ", '""', ' "s"', "long " * 9]


@pytest.mark.parametrize("seed", range(12))
def test_any_quotes_by_ranges_of_any_size(spark, tmp_path, seed):
    rng = random.Random(seed)
    end = rng.choice(["\n", "\r\n", "\r"])
    cells = CELLS if seed % 3 else [c for c in CELLS if c.count('"') % 2 == 0 and "\n" not in c]
    lines = ["id;a;b"]
    for i in range(rng.randint(1, 60)):
        lines.append(rng.choice(["", " ", f"{i};x", f"{i};x;y;z"]) if rng.random() < 0.1 else ";".join([str(i), rng.choice(cells), rng.choice(cells)]))
    data = (end.join(lines) + rng.choice(["", end])).encode("utf-8")
    path = tmp_path / "any.csv"
    path.write_bytes((records.BOM if seed % 4 == 0 else b"") + data)
    want, ragged = plainly(data, "utf-8", ";")
    from loomery.sources.readers import open_text

    for size in (7, 64, 1000, 1 << 20):
        source = open_text(spark, path, delimiter=";", range_bytes=size)
        assert source.columns == ["id", "a", "b"]
        assert read(source) == want, size
        assert source.rows_and_ragged() == (len(want), ragged)


def test_late_line_feed_in_quotes(spark, tmp_path):
    path = tmp_path / "late.csv"
    rows = [f'{i};name {i};"plain {i}"' for i in range(40_000)]
    rows[39_990] = '39990;name;"two\nlines"'
    path.write_text("id;name;note\n" + "\n".join(rows) + "\n")
    source = open_source(spark, path)
    assert source.rows_and_ragged() == (40_000, 0)
    assert source.data.filter("c0 = '39990'").first()["c2"] == "two\nlines"
    many = records.look(spark, path, ";", 1 << 16)
    assert not many.plain and len(many.rows) > 10 and not any(many.states)
    assert records.read(spark, many, "utf-8", 3, True).rdd.getNumPartitions() == len(many.rows)


def test_ragged_rows_are_counted_by_either_reader(spark, tmp_path):
    for name, cell in (("plain", "x"), ("quoted", '"x\ny"')):
        path = tmp_path / f"{name}.csv"
        path.write_text(f"a,b,c\n1,2,{cell}\n1,2\n1,2,3,4\n\n4,5,6\n")
        source = open_source(spark, path)
        assert source.rows_and_ragged() == (4, 2)
        assert read(source)[1:3] == [("1", "2", ""), ("1", "2", "3")]


def test_late_bytes_decide_the_encoding(spark, tmp_path):
    path = tmp_path / "late.txt"
    head = b"name,town\n" + "Zoë,Köln\n".encode() * 400_000
    path.write_bytes(head + b"caf\xe9,x\n")
    source = open_source(spark, path)
    assert source.text.encoding == "cp1252" and source.data.filter("c1 = 'x'").first()["c0"] == "café"
    assert str(len(head) + 3) in source.warnings[0] and "cp1252" in source.warnings[0]
    path.write_bytes(head + b"caf\xe9\x81,x\n")
    assert open_source(spark, path).text.encoding == "latin-1"
    path.write_bytes(head)
    assert open_source(spark, path).text.encoding == "utf-8" and not open_source(spark, path).warnings
    forced = open_source(spark, path, encoding="utf-8")
    assert forced.data.first()["c0"] == "Zoë"


def test_utf8_is_checked_across_range_ends(tmp_path):
    good = "aé€😀".encode() * 5
    path = tmp_path / "x"
    for bad in range(-1, len(good) + 1):
        data = good if bad < 0 else good[:bad] + b"\x80" + good[bad:] if bad % 2 else good[:bad] + good[bad + 1 :]
        path.write_bytes(data)
        source = records.Bytes(path)
        try:
            data.decode()
            valid = True
        except UnicodeDecodeError:
            valid = False
        for step in (1, 2, 3, 5, 8, 100):
            found = [records.first_invalid(source, a, min(a + step, source.size)) for a in range(0, source.size, step)]
            assert all(f < 0 for f in found) == valid, (bad, step)


def test_a_quote_that_never_closes_is_named(spark, tmp_path, monkeypatch):
    path = tmp_path / "open.csv"
    path.write_text("a,b\n1,2\n3,\"" + "x\n" * 2000)
    source = open_source(spark, path)  # short enough: one record, as the csv module reads it
    assert source.rows_and_ragged()[0] == 2


def test_explicitly_wrong_encoding_is_reported(spark, tmp_path):
    path = tmp_path / "w.csv"
    path.write_bytes(b"a,b\ncaf\xe9,1\n")
    source = open_source(spark, path, encoding="utf-8")
    assert source.data.first()["c0"] == "caf�" and "byte 7" in source.warnings[0]
