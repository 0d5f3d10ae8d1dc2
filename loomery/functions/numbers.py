"""Numbers as people write them, and check digits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomery.functions import rng

# Fixed value: how a number may be written.
NUMBER = r"^([+-]?)(\$?)(\d{1,3}(?:,\d{3})+|\d+)?(?:\.(\d+))?(%?)$"


def is_number(v: Column) -> Column:
    return v.rlike(NUMBER) & v.rlike(r"\d")


def parse_number(v: Column) -> Column:
    """(value, format) with format "currency|thousands|decimals|width with leading zeros|percent"; null if it isn't one.

    One match takes the text apart: its five parts, separated, behind a mark that no number begins with.
    """
    flag = lambda c: F.when(c, "1").otherwise("0")

    def read(x: Column) -> Column:
        sign, currency, whole, fraction, percent = (F.get(x, F.lit(i)) for i in range(5))
        plain = F.translate(whole, ",", "")
        value = F.concat(F.when(sign == "\x01-", "-").otherwise(""), F.when(plain == "", "0").otherwise(plain), F.when(fraction == "", "").otherwise(F.concat(F.lit("."), fraction)))
        padded = F.when((F.length(plain) > 1) & plain.startswith("0"), F.length(plain)).otherwise(0)
        kind = F.concat_ws("|", flag(currency == "$"), flag(F.contains(whole, F.lit(","))), F.length(fraction).cast("string"), padded.cast("string"), flag(percent == "%"))
        return F.when((whole != "") | (fraction != ""), F.struct(value.cast("double").alias("value"), kind.alias("format")))

    likely = v.rlike(r"^[+$.\d-]") & v.rlike(r"[\d%]$")
    apart = F.when(likely, F.split(F.regexp_replace(v, NUMBER, "\x01$1|$2|$3|$4|$5"), r"\|"))
    return F.get(F.transform(F.array(apart), lambda x: F.when(F.get(x, F.lit(0)).startswith("\x01"), read(x))), F.lit(0))


def format_number(value: Column, kind: str) -> Column:
    """A value in a format of parse_number's; the sign comes before the currency, and zero has none."""
    currency, thousands, decimals, width, percent = kind.split("|")
    size = F.abs(value)
    if thousands == "1":
        body = F.format_string(f"%,.{decimals}f", size)
    else:
        body = F.format_string(f"%.{decimals}f", size)
        if int(width):
            point = 0 if decimals == "0" else int(decimals) + 1
            body = F.when(F.length(body) < int(width) + point, F.lpad(body, int(width) + point, "0")).otherwise(body)
    sign = F.when((value < 0) & body.rlike("[1-9]"), "-").otherwise("")
    return F.concat(sign, F.lit("$" if currency == "1" else ""), body, F.lit("%" if percent == "1" else ""))


def luhn_ok(v: Column) -> Column:
    """Whether the digits of v pass the Luhn check; false without digits."""
    digits = F.regexp_replace(v, r"[^0-9]", "")
    return F.when(digits == "", False).otherwise(F.call_function("luhn_check", digits))


def luhn_digit(digits: Column) -> Column:
    """The digit that makes ``digits`` and itself pass the Luhn check."""

    def share(held: Column, i: Column) -> Column:
        d = F.substring(held, F.length(held) - i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 0, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    total = rng.once(digits, lambda held: F.aggregate(F.transform(F.sequence(F.lit(0), F.length(held) - 1), lambda i: share(held, i)), F.lit(0), lambda a, x: a + x))
    return (F.lit(10) - total % 10) % 10


def new_sin(seed: str, label: str, draw: object, row: Column) -> Column:
    """Nine digits, the first 1 to 7, the last a check digit."""
    first = rng.index(rng.fast(seed, label, f"{draw}:0", row), 7) + 1
    seven = F.lpad(rng.index(rng.fast(seed, label, f"{draw}:1", row), 10_000_000).cast("string"), 7, "0")
    return rng.once(F.concat(first.cast("string"), seven), lambda body: F.concat(body, luhn_digit(body).cast("string")))
