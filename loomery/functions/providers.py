"""Named value providers: functions from keyword arguments to a Column."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomery.functions import rng, words


class Draws:
    """Uniform numbers for one cell; each name gives an independent one. ``words`` are the lists of its locale."""

    def __init__(self, seed: object, label: str, draw: object, row: Column, locale: str = "en"):
        self.seed, self.label, self.draw, self.row, self.words = seed, label, draw, row, words.Words(locale)

    def __call__(self, name: str) -> Column:
        return rng.fast(self.seed, self.label, f"{self.draw}:{name}", self.row)


PROVIDERS: dict[str, Callable[..., Column]] = {}
#: For each provider, from its keyword arguments: how many values each of its draws may take, by the draw's name.
PARTS: dict[str, Callable[..., dict[str, int]]] = {}


def provider(f: Callable[..., Column]) -> Callable[..., Column]:
    """Register a provider under its function's name."""
    PROVIDERS[f.__name__] = f
    return f


def made_of(parts: Callable[..., dict[str, int]]) -> Callable:
    """Register what a provider's values are made of, so that its columns can be unique."""

    def register(f: Callable[..., Column]) -> Callable[..., Column]:
        PARTS[f.__name__] = parts
        return f

    return register


def parts(name: str, kwargs: dict | None = None, locale: str = "en") -> dict[str, int] | None:
    """The sizes of a provider's draws; their product is the number of its values. None if it isn't known."""
    return PARTS[name](words.Words(locale), **(kwargs or {})) if name in PARTS else None


def is_known(name: str) -> bool:
    return name in PROVIDERS


def call(name: str, draws: Draws, kwargs: dict | None = None) -> Column:
    if name not in PROVIDERS:
        raise ValueError(f"Unknown provider: {name}")
    return PROVIDERS[name](draws, **(kwargs or {}))


@provider
@made_of(lambda w: {"first": len(w.FIRST)})
def first_name(d: Draws) -> Column:
    return rng.pick(d("first"), d.words.FIRST)


@provider
@made_of(lambda w: {"last": len(w.LAST)})
def last_name(d: Draws) -> Column:
    return rng.pick(d("last"), d.words.LAST)


@provider
@made_of(lambda w: {"first": len(w.FIRST), "last": len(w.LAST)})
def name(d: Draws) -> Column:
    return F.concat_ws(" ", first_name(d), last_name(d))


@provider
@made_of(lambda w: {"first": len(w.FIRST), "last": len(w.LAST), "number": 100, "domain": len(w.MAIL)})
def email(d: Draws) -> Column:
    return F.concat(ascii_letters(first_name(d)), F.lit("."), ascii_letters(last_name(d)), rng.index(d("number"), 100).cast("string"), F.lit("@"), free_email_domain(d))


@provider
@made_of(lambda w: {"domain": len(w.MAIL)})
def free_email_domain(d: Draws) -> Column:
    return rng.pick(d("domain"), d.words.MAIL)


@provider
@made_of(lambda w: {"city": len(w.CITY), "city_end": len(w.CITY_END)})
def city(d: Draws) -> Column:
    return F.concat(rng.pick(d("city"), d.words.CITY), rng.pick(d("city_end"), d.words.CITY_END))


@provider
@made_of(lambda w: {"street": len(w.STREET), "street_end": len(w.STREET_END)})
def street_name(d: Draws) -> Column:
    joined = "" if d.words.language == "de" else " "  # Lindenweg
    return F.replace(F.concat_ws(joined, rng.pick(d("street"), d.words.STREET), rng.pick(d("street_end"), d.words.STREET_END)), F.lit("_"), F.lit(" "))


@provider
@made_of(lambda w: {"number": 9899, "street": len(w.STREET), "street_end": len(w.STREET_END)})
def street_address(d: Draws) -> Column:
    return F.concat_ws(" ", (rng.index(d("number"), 9899) + 1).cast("string"), street_name(d))


@provider
@made_of(lambda w: {"area": 800, "line": 10_000})
def phone_number(d: Draws) -> Column:
    part = lambda name, n, size: F.lpad(rng.index(d(name), n).cast("string"), size, "0")
    return F.concat_ws("-", (rng.index(d("area"), 800) + 200).cast("string"), F.lit("555"), part("line", 10_000, 4))


@provider
@made_of(lambda w: {"code": 100_000})
def postcode(d: Draws) -> Column:
    return F.lpad(rng.index(d("code"), 100_000).cast("string"), 5, "0")


@provider
@made_of(lambda w, min=0, max=9999, step=1: {"int": (int(max) - int(min)) // int(step) + 1})
def random_int(d: Draws, min: int = 0, max: int = 9999, step: int = 1) -> Column:
    return F.floor(d("int") * ((int(max) - int(min)) // int(step) + 1)).cast("long") * int(step) + int(min)


@provider
@made_of(lambda w: {"int": 10})
def random_digit(d: Draws) -> Column:
    return random_int(d, 0, 9)


@provider
@made_of(lambda w, min_value=0.0, max_value=1.0: {"float": 1 << 40})
def pyfloat(d: Draws, min_value: float = 0.0, max_value: float = 1.0) -> Column:
    return d("float") * (float(max_value) - float(min_value)) + float(min_value)


@provider
def boolean(d: Draws, chance_of_getting_true: float = 50) -> Column:
    return d("bool") * 100 < float(chance_of_getting_true)


@provider
@made_of(lambda w: {"word": len(w.WORDS)})
def word(d: Draws) -> Column:
    return rng.pick(d("word"), d.words.WORDS)


def _words(d: Draws, n: int | Column) -> Column:
    pool = rng.literals(d.words.WORDS)
    return F.transform(F.sequence(F.lit(1), n if isinstance(n, Column) else F.lit(int(n))), lambda i: F.get(pool, rng.index(rng.fast(d.seed, d.label, d.draw, d.row, i), len(d.words.WORDS))))


@provider
def sentence(d: Draws, nb_words: int = 6) -> Column:
    text = F.array_join(_words(d, int(nb_words)), " ")
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, F.lit(2), F.length(text)), F.lit("."))


@provider
def text(d: Draws, max_nb_chars: int | Column = 200) -> Column:
    size = max_nb_chars if isinstance(max_nb_chars, Column) else F.lit(int(max_nb_chars))
    whole = F.array_join(_words(d, F.greatest(F.lit(1), F.ceil(size / 4).cast("int"))), " ")
    whole = F.concat(F.upper(F.substring(whole, 1, 1)), F.substring(whole, F.lit(2), F.length(whole)))
    return F.rtrim(F.substring(whole, F.lit(1), size))


@provider
@made_of(lambda w, start="1970-01-01", end="2024-12-31": {"date": (datetime.date.fromisoformat(end) - datetime.date.fromisoformat(start)).days + 1})
def date(d: Draws, start: str = "1970-01-01", end: str = "2024-12-31") -> Column:
    first, last = F.lit(start).cast("date"), F.lit(end).cast("date")
    return F.date_format(F.date_add(first, F.floor(d("date") * (F.datediff(last, first) + 1)).cast("int")), "yyyy-MM-dd")


@provider
def uuid4(d: Draws) -> Column:
    h = F.md5(F.concat_ws("|", F.lit(str(d.seed)), F.lit(d.label), F.lit(str(d.draw)), d.row.cast("string")).cast("binary"))
    parts = [F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("4"), F.substring(h, 14, 3)), F.concat(F.lit("a"), F.substring(h, 18, 3)), F.substring(h, 21, 12)]
    return F.concat_ws("-", *parts)


@provider
@made_of(lambda w: {"company": len(w.LAST), "kind": 4})
def company(d: Draws) -> Column:
    return F.concat_ws(" ", rng.pick(d("company"), d.words.LAST), rng.pick(d("kind"), ["Ltd", "Inc", "Group", "Partners"]))


def ascii_letters(c: Column) -> Column:
    """Small letters without accents: what addresses are made of."""
    text = F.replace(F.replace(F.lower(c), F.lit("ß"), F.lit("ss")), F.lit("œ"), F.lit("oe"))
    return F.regexp_replace(F.translate(text, "àâäáãåçèéêëìíîïñòóôöõøùúûüýÿ", "aaaaaaceeeeiiiinoooooouuuuyy"), "[^a-z]", "")


def _digits(d: Draws, n: int) -> Column:
    """n digits, up to nine at a time from one number."""
    sizes = [min(9, n - k) for k in range(0, n, 9)]
    return F.concat(*(F.lpad(F.floor(d(f"digits{k}") * 10**size).cast("string"), size, "0") for k, size in enumerate(sizes)))


def _digit_parts(n: int) -> dict[str, int]:
    return {f"digits{k}": 10 ** min(9, n - 9 * k) for k in range(-(-n // 9))}


def _weighed(digits: Column, weights: list[int], fold: bool) -> Column:
    """The digit that makes the weighted sum a multiple of ten. fold: of products, the digits' sum counts."""
    total = F.lit(0)
    for i, w in enumerate(weights):
        x = F.substring(digits, i + 1, 1).cast("int") * w
        total = total + (F.when(x > 9, x - 9).otherwise(x) if fold else x)
    return F.pmod(-total, F.lit(10)).cast("string")


@provider
@made_of(lambda w: {"job": len(w.JOBS)})
def job(d: Draws) -> Column:
    return rng.pick(d("job"), d.words.JOBS)


@provider
@made_of(lambda w: {"country": len(w.COUNTRIES)})
def country(d: Draws) -> Column:
    return rng.pick(d("country"), list(words.COUNTRIES.values()))


@provider
@made_of(lambda w: {"country": len(w.COUNTRIES)})
def country_code(d: Draws) -> Column:
    return rng.pick(d("country"), list(words.COUNTRIES))


@provider
@made_of(lambda w: {"currency": len(w.CURRENCIES)})
def currency_code(d: Draws) -> Column:
    return rng.pick(d("currency"), d.words.CURRENCIES)


@provider
@made_of(lambda w: {"colour": len(w.COLOURS)})
def color_name(d: Draws) -> Column:
    return rng.pick(d("colour"), d.words.COLOURS)


@provider
@made_of(lambda w: {"colour": 1 << 24})
def hex_color(d: Draws) -> Column:
    return F.concat(F.lit("#"), F.lower(F.lpad(F.hex(F.floor(d("colour") * (1 << 24)).cast("long")), 6, "0")))


@provider
@made_of(lambda w: {"month": 12})
def month_name(d: Draws) -> Column:
    return rng.pick(d("month"), d.words.MONTHS)


@provider
@made_of(lambda w: {"day": 7})
def day_of_week(d: Draws) -> Column:
    return rng.pick(d("day"), d.words.DAYS)


@provider
@made_of(lambda w: {"second": 86_400})
def time(d: Draws) -> Column:
    return F.date_format(F.timestamp_seconds(F.floor(d("second") * 86_400)).cast("timestamp_ntz"), "HH:mm:ss")


@provider
@made_of(lambda w, start="1970-01-01", end="2024-12-31": {"moment": ((datetime.date.fromisoformat(end) - datetime.date.fromisoformat(start)).days + 1) * 86_400})
def date_time(d: Draws, start: str = "1970-01-01", end: str = "2024-12-31") -> Column:
    first, last = datetime.date.fromisoformat(start), datetime.date.fromisoformat(end)
    seconds = F.floor(d("moment") * (((last - first).days + 1) * 86_400)).cast("long")
    day = F.date_add(F.lit(start).cast("date"), F.floor(seconds / 86_400).cast("int"))
    clock = F.concat_ws(":", *(F.lpad(F.floor(F.pmod(seconds, F.lit(m)) / k).cast("string"), 2, "0") for m, k in ((86_400, 3600), (3600, 60), (60, 1))))
    return F.concat_ws(" ", F.date_format(day, "yyyy-MM-dd"), clock)


@provider
@made_of(lambda w: {"first": len(w.FIRST), "last": len(w.LAST), "number": 1000})
def user_name(d: Draws) -> Column:
    return F.concat(ascii_letters(first_name(d)), F.lit("_"), ascii_letters(last_name(d)), rng.index(d("number"), 1000).cast("string"))


@provider
@made_of(lambda w: {"last": len(w.LAST), "word": len(w.WORDS), "ending": 3})
def domain_name(d: Draws) -> Column:
    return F.concat(ascii_letters(last_name(d)), F.lit("-"), word(d), rng.pick(d("ending"), [".example", ".test", ".invalid"]))


@provider
@made_of(lambda w: {"last": len(w.LAST), "word": len(w.WORDS), "ending": 3})
def url(d: Draws) -> Column:
    return F.concat(F.lit("https://www."), domain_name(d), F.lit("/"))


@provider
@made_of(lambda w: {"address": 1 << 24})
def ipv4(d: Draws) -> Column:
    n = F.floor(d("address") * (1 << 24)).cast("long")
    return F.concat_ws(".", F.lit("10"), *(F.shiftrightunsigned(n, k).bitwiseAND(255).cast("string") for k in (16, 8, 0)))


@provider
@made_of(lambda w: {"high": 1 << 23, "low": 1 << 23})
def mac_address(d: Draws) -> Column:
    h = F.concat(*(F.lower(F.lpad(F.hex(F.floor(d(k) * (1 << 23)).cast("long")), 6, "0")) for k in ("high", "low")))
    return F.concat_ws(":", *(F.substring(h, 2 * i + 1, 2) for i in range(6)))


@provider
@made_of(lambda w: _digit_parts(14))
def credit_card_number(d: Draws) -> Column:
    """Sixteen digits that pass Luhn's check, beginning with 9, which no issuer has."""
    digits = F.concat(F.lit("9"), _digits(d, 14))
    return F.concat(digits, _weighed(digits, [2, 1] * 7 + [2], True))


@provider
@made_of(lambda w: _digit_parts(9))
def isbn13(d: Draws) -> Column:
    digits = F.concat(F.lit("978"), _digits(d, 9))
    return F.concat(digits, _weighed(digits, [1, 3] * 6, False))


@provider
@made_of(lambda w: _digit_parts(10))
def ean13(d: Draws) -> Column:
    digits = F.concat(F.lit("20"), _digits(d, 10))
    return F.concat(digits, _weighed(digits, [1, 3] * 6, False))


@provider
@made_of(lambda w: _digit_parts(17))
def iban(d: Draws) -> Column:
    """A German account number of a bank that isn't there (code 0), with its two check digits."""
    account = F.concat(F.lit("0"), _digits(d, 17))
    return F.concat(F.lit("DE"), F.lpad((98 - F.pmod(F.concat(account, F.lit("131400")).cast("decimal(38,0)"), F.lit(97).cast("decimal(38,0)"))).cast("int").cast("string"), 2, "0"), account)


@provider
@made_of(lambda w: {"angle": 180_000_000})
def latitude(d: Draws) -> Column:
    return F.round(F.floor(d("angle") * 180_000_000) / 1e6 - 90, 6)


@provider
@made_of(lambda w: {"angle": 360_000_000})
def longitude(d: Draws) -> Column:
    return F.round(F.floor(d("angle") * 360_000_000) / 1e6 - 180, 6)


@provider
@made_of(lambda w, text="###": {f"place{i}": 10 for i, c in enumerate(text) if c == "#"})
def numerify(d: Draws, text: str = "###") -> Column:
    """The text with a digit for each #."""
    return F.concat(F.lit(""), *(rng.index(d(f"place{i}"), 10).cast("string") if c == "#" else F.lit(c) for i, c in enumerate(text)))


@provider
@made_of(lambda w, text="????": {f"place{i}": 26 for i, c in enumerate(text) if c == "?"})
def lexify(d: Draws, text: str = "????") -> Column:
    """The text with a small letter for each ?."""
    return F.concat(F.lit(""), *(rng.pick(d(f"place{i}"), list("abcdefghijklmnopqrstuvwxyz")) if c == "?" else F.lit(c) for i, c in enumerate(text)))


@provider
@made_of(lambda w, text="## ??": {f"place{i}": 10 if c == "#" else 26 for i, c in enumerate(text) if c in "#?"})
def bothify(d: Draws, text: str = "## ??") -> Column:
    """The text with a digit for each # and a small letter for each ?."""
    letters = list("abcdefghijklmnopqrstuvwxyz")
    return F.concat(F.lit(""), *(rng.index(d(f"place{i}"), 10).cast("string") if c == "#" else rng.pick(d(f"place{i}"), letters) if c == "?" else F.lit(c) for i, c in enumerate(text)))


@provider
@made_of(lambda w, elements=("a", "b", "c"): {"element": len(elements)})
def random_element(d: Draws, elements: tuple = ("a", "b", "c")) -> Column:
    return rng.pick(d("element"), list(elements))
