"""The shape of text: blanks, masks, surrounding white space and letter case."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomery.functions import rng
from loomery.functions.rng import once

# The tokens that stand for a missing value, compared exactly after stripping.
NULL_TOKENS = (
    "", "N/A", "n/a", "NA", "na", "N.A.", "NULL", "null", "Null", "None", "none", "NONE", "-", "--", "---", ".", "?", "??",
    "#N/A", "nan", "NaN", "NAN", "(blank)", "(null)", "<null>", "UNKNOWN", "Unknown", "unknown", "nil", "NIL",
)

_DIGITS, _UPPER, _LETTERS = r"\p{Nd}", r"\p{Lu}", r"\p{L}"
_PLAIN_LETTERS = "abcdefghijklmnopqrstuvwxyz"
FREE = "\0"


def strip(v: Column) -> Column:
    return F.btrim(v, F.lit(" \t\n\x0b\f\r"))


def is_blank(v: Column) -> Column:
    return v.isNull() | strip(v).isin(*NULL_TOKENS)


def mask_of(v: Column) -> Column:
    """Digits as 9, upper-case letters as A, other letters as a; the rest stays."""
    v = F.regexp_replace(v, _UPPER, "\x01")
    v = F.regexp_replace(v, _LETTERS, "\x02")
    return F.translate(F.regexp_replace(v, _DIGITS, "9"), "\x01\x02", "Aa")


def _char(kind: Column, u: Column) -> Column:
    """A random character for a place of a mask; other characters stand for themselves."""
    letter = F.substring(F.lit(_PLAIN_LETTERS), F.floor(u * 26).cast("int") + 1, F.lit(1))
    return F.when(kind == "9", F.floor(u * 10).cast("int").cast("string")).when(kind == "A", F.upper(letter)).when(kind == "a", letter).otherwise(kind)


def fill_mask(mask: Column, seed: str, label: str, draw: object, row: Column, fixed: Column | None = None) -> Column:
    """Random characters in the mask's places. fixed: as long as the mask, FREE where the place is free."""

    def place(c: Column, i: Column, held: Column | None) -> Column:
        new = _char(c, rng.fast(seed, label, draw, row, i))
        if held is None:
            return new
        pinned = F.substring(held, i + 1, F.lit(1))
        return F.when((pinned == FREE) | (pinned == ""), new).otherwise(pinned)

    fill = lambda held: F.array_join(F.transform(F.split(mask, ""), lambda c, i: place(c, i, held)), "")
    return fill(None) if fixed is None else once(fixed, fill)


def fill_mask_with(mask: Column, chars: Column, seed: str, label: str, draw: object, row: Column) -> Column:
    """Pour characters into the mask's places, in the case the mask has; random ones when they run out."""

    def place(c: Column, i: Column, held: Column) -> Column:
        nth = F.length(F.regexp_replace(F.substring(held["mask"], F.lit(1), i), "[^9Aa]", ""))
        given = F.substring(held["chars"], nth + 1, F.lit(1))
        given = F.when(given == "", _char(c, rng.fast(seed, label, draw, row, i))).when(c == "A", F.upper(given)).when(c == "a", F.lower(given)).otherwise(given)
        return F.when(c.isin("9", "A", "a"), given).otherwise(c)

    return once(F.struct(mask.alias("mask"), chars.alias("chars")), lambda held: F.array_join(F.transform(F.split(held["mask"], ""), lambda c, i: place(c, i, held)), ""))


def lead(v: Column) -> Column:
    return F.substring(F.regexp_extract(v, r"^(\s*)", 1), 1, 10)


def core(v: Column) -> Column:
    return strip(v)


def trail(v: Column) -> Column:
    return F.when(strip(v) == "", "").otherwise(F.substring(F.regexp_extract(v, r"(\s*)$", 1), 1, 10))


def case_style(v: Column) -> Column:
    """upper, lower, title, mixed, or none for text without letters."""
    # a letter after a letter is lower, any other upper
    titled = ~v.rlike(r"\p{L}\p{Lu}") & ~v.rlike(r"(?<!\p{L})\p{Ll}")
    return (
        F.when(~v.rlike(_LETTERS), "none").when(v == F.upper(v), "upper").when(v == F.lower(v), "lower").when(titled, "title").otherwise("mixed")
    )


def title_case(v: Column) -> Column:
    """The first letter of every run of letters in upper case, the others in lower case."""
    runs = F.regexp_extract_all(v, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, F.lit(2), F.length(r))))), "")


def apply_case(v: Column, case: Column) -> Column:
    return F.when(case == "upper", F.upper(v)).when(case == "lower", F.lower(v)).when(case == "title", title_case(v)).otherwise(v)


def text_style(v: Column) -> Column:
    return F.struct(case_style(core(v)).alias("case"), lead(v).alias("lead"), trail(v).alias("trail"))


def render_text(v: Column, style: Column) -> Column:
    return F.concat(style["lead"], apply_case(v, style["case"]), style["trail"])


def pronounceable(length: Column, seed: str, label: str, draw: object, row: Column) -> Column:
    """A capitalised word of consonants and vowels in turn, of two letters or more."""

    def letter(i: Column) -> Column:
        u = rng.fast(seed, label, draw, row, i)
        consonant = F.substring(F.lit("bcdfghjklmnprstvz"), F.floor(u * 17).cast("int") + 1, F.lit(1))
        vowel = F.substring(F.lit("aeiou"), F.floor(u * 5).cast("int") + 1, F.lit(1))
        return F.when(i % 2 == 0, consonant).otherwise(vowel)

    word = F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(length, F.lit(2)) - 1), letter), "")
    return F.initcap(word)
