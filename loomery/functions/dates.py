"""Dates as people write them: which of the known formats a text is in, and its moment."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The formats in the order in which they are tried, each with Spark's pattern for writing it.
DATE_FORMATS = (
    ("%Y-%m-%d", "yyyy-MM-dd"),
    ("%Y/%m/%d", "yyyy/MM/dd"),
    ("%Y-%m-%d %H:%M:%S", "yyyy-MM-dd HH:mm:ss"),
    ("%Y-%m-%dT%H:%M:%S", "yyyy-MM-dd'T'HH:mm:ss"),
    ("%Y-%m-%d %H:%M", "yyyy-MM-dd HH:mm"),
    ("%d/%m/%Y", "dd/MM/yyyy"),
    ("%m/%d/%Y", "MM/dd/yyyy"),
    ("%d-%m-%Y", "dd-MM-yyyy"),
    ("%m-%d-%Y", "MM-dd-yyyy"),
    ("%d.%m.%Y", "dd.MM.yyyy"),
    ("%d/%m/%y", "dd/MM/yy"),
    ("%m/%d/%y", "MM/dd/yy"),
    ("%Y%m%d", "yyyyMMdd"),
    ("%d%b%Y", "ddMMMyyyy"),
    ("%d-%b-%Y", "dd-MMM-yyyy"),
    ("%d-%b-%y", "dd-MMM-yy"),
    ("%d %b %Y", "dd MMM yyyy"),
    ("%b %d, %Y", "MMM dd, yyyy"),
    ("%B %d, %Y", "MMMM dd, yyyy"),
    ("%d %B %Y", "dd MMMM yyyy"),
    ("%m/%d/%Y %H:%M:%S", "MM/dd/yyyy HH:mm:ss"),
    ("%d/%m/%Y %H:%M", "dd/MM/yyyy HH:mm"),
    ("%m/%d/%Y %H:%M", "MM/dd/yyyy HH:mm"),
)
# Those with the month first.
MONTH_FIRST = ("%m/%d/%Y", "%m-%d-%Y", "%m/%d/%y", "%m/%d/%Y %H:%M:%S", "%m/%d/%Y %H:%M")
PATTERN = dict(DATE_FORMATS)

_MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
#: Digits of a year, month and day that stand together: month and day take two digits where they can.
_TOGETHER = r"^(\d{4})(1[0-2]|0[1-9]|[1-9])(3[01]|[12]\d|0[1-9]|[1-9])$"
_FIELDS = {
    "Y": r"(\d{4})", "y": r"(\d{2})", "m": r"(\d{1,2})", "d": r"(\d{1,2})", "b": f"({'|'.join(m[:3] for m in _MONTHS)})", "B": f"({'|'.join(_MONTHS)})",
    "H": r"([01]?\d|2[0-3])", "M": r"([0-5]?\d)", "S": r"([0-5]?\d)",
}


def _pattern(fmt: str) -> tuple[str, list[str]]:
    """What texts of a format match, and the fields of its groups."""
    if fmt == "%Y%m%d":
        return _TOGETHER, ["Y", "m", "d"]
    body = re.sub(r"%(.)| |[^%]", lambda m: _FIELDS[m[1]] if m[1] else r"\s+" if m[0] == " " else re.escape(m[0]), fmt)
    return f"^{'(?i)' if 'b' in fmt.lower() else ''}{body}$", re.findall("%(.)", fmt)


def _day(v: Column, fmt: str) -> Column:
    """The day of a text that matches the format's pattern; null if there is no such day."""
    pattern, fields = _pattern(fmt)
    group = lambda *names: next(f"${i + 1}" for i, x in enumerate(fields) if x in names)
    year = F.regexp_replace(v, pattern, group("Y", "y"))
    if "y" in fields:
        year = F.concat(F.when(year >= "69", "19").otherwise("20"), year)
    if set(fields) & {"b", "B"}:
        name = F.lower(F.substring(F.regexp_replace(v, pattern, group("b", "B")), 1, 3))
        month = ((F.instr(F.lit("".join(m[:3] for m in _MONTHS)), name) + 2) / 3).cast("int").cast("string")
        written = F.concat_ws("-", year, month, F.regexp_replace(v, pattern, group("d")))
    elif "y" in fields:
        written = F.concat_ws("-", year, F.regexp_replace(v, pattern, f"{group('m')}-{group('d')}"))
    else:
        written = F.regexp_replace(v, pattern, f"{group('Y')}-{group('m')}-{group('d')}")
    return written.try_cast("date")


def _clock(v: Column, fmt: str) -> Column:
    pattern, fields = _pattern(fmt)
    if "H" not in fields:
        return F.lit(0).cast("long")
    number = lambda name: F.regexp_extract(v, pattern, fields.index(name) + 1).cast("long") if name in fields else F.lit(0)
    return number("H") * 3600 + number("M") * 60 + number("S")


def parse_date(v: Column, month_first: Column | bool = False) -> Column:
    """(format, seconds since 1970) by the first format that fits; null if none does.

    month_first: whether formats with the month first are tried before the others. A format's texts are told by a
    pattern; formats that differ in the order of day and month alone have one, so it decides between two at most.
    """
    late = month_first if isinstance(month_first, Column) else F.lit(month_first)
    # as a function of one value the choice stays out of generated code, for which it is too long
    return F.get(F.transform(F.array(v), lambda x: _parsed(x, late)), F.lit(0))


def _parsed(v: Column, late: Column) -> Column:

    def read(fmt: str) -> Column:
        found = lambda day: F.struct(F.lit(fmt).alias("format"), (F.unix_date(day).cast("long") * 86400 + _clock(v, fmt)).alias("seconds"))
        known = lambda day: (day >= F.lit("1800-01-01").cast("date")) & (day <= F.lit("2200-12-31").cast("date"))
        return F.get(F.transform(F.array(_day(v, fmt)), lambda day: F.when(known(day), found(day))), F.lit(0))

    swapped = {fmt: re.sub("%([md])", lambda m: "%d" if m[1] == "m" else "%m", fmt) for fmt in MONTH_FIRST}
    signs = ("/", ".", "-", ",", "")  # a text of a format has the signs that the format has
    groups: dict[str, list[Column]] = {sign: [] for sign in signs}
    for fmt, _ in DATE_FORMATS:
        if swapped.get(fmt) in PATTERN:
            continue  # with its other order
        found = read(fmt)
        other = next((x for x, y in swapped.items() if y == fmt), None)
        if other:
            found = F.when(late, F.coalesce(read(other), found)).otherwise(F.coalesce(found, read(other)))
        groups[next(x for x in signs if x in fmt)].append(F.when(v.rlike(_pattern(fmt)[0]), found))
    likely = F.length(v).between(6, 30) & v.rlike(r"^[\p{L}\p{N}].*\d")
    of = F.coalesce(*groups[""])
    for sign in reversed(signs[:-1]):
        of = F.when(F.contains(v, F.lit(sign)), F.coalesce(*groups[sign])).otherwise(of)
    return F.when(likely, of)


_SLASHED = r"^(\d{1,2})[/.-](\d{1,2})[/.-]\d{2,4}"


def month_first_votes(v: Column) -> tuple[Column, Column]:
    """Whether the first number can't be a month, and whether the second can't."""
    first, second = (F.coalesce(F.regexp_extract(v, _SLASHED, i).try_cast("int"), F.lit(0)) for i in (1, 2))  # 0 if it doesn't match
    return (first > 12).cast("int"), (second > 12).cast("int")


def render_date(seconds: Column, fmt: str) -> Column:
    moment = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))
    return F.date_format(moment, PATTERN[fmt])
