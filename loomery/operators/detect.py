"""What a column holds, from its header and from rates of values that fit each kind."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomery.functions import numbers
from loomery.functions.dates import parse_date

# Kinds of columns.
SEMANTIC_TYPES = (
    "sin", "first_name", "last_name", "full_name", "email", "phone", "street_address", "city", "province", "postal_code", "date", "numeric", "category", "free_text",
    "identifier", "unknown", "empty",
)
SENSITIVE_TYPES = tuple(t for t in SEMANTIC_TYPES if t not in ("province", "date", "numeric", "category", "empty"))
# Headers that never make a category.
PERSONAL = ("sin", "first_name", "last_name", "full_name", "email", "phone", "street_address", "postal_code")

# Provinces, their other names, and the first letters of their postal codes.
PROVINCES = {
    "AB": "Alberta", "BC": "British Columbia", "MB": "Manitoba", "NB": "New Brunswick", "NL": "Newfoundland and Labrador", "NS": "Nova Scotia", "NT": "Northwest Territories",
    "NU": "Nunavut", "ON": "Ontario", "PE": "Prince Edward Island", "QC": "Quebec", "SK": "Saskatchewan", "YT": "Yukon",
}
OTHER_NAMES = {
    "pq": "QC", "québec": "QC", "que": "QC", "nf": "NL", "nfld": "NL", "newfoundland": "NL", "pei": "PE", "p.e.i": "PE", "yukon territory": "YT", "sask": "SK", "alta": "AB",
    "man": "MB", "ont": "ON", "b.c": "BC", "nwt": "NT", "yk": "YT",
}
POSTAL_LETTERS = {"NL": "A", "NS": "B", "PE": "C", "NB": "E", "QC": "GHJ", "ON": "KLMNP", "MB": "R", "SK": "S", "AB": "T", "BC": "V", "NT": "X", "NU": "X", "YT": "Y"}
PROVINCE_LOOKUP = {k.lower(): k for k in PROVINCES} | {v.lower(): k for k, v in PROVINCES.items()} | OTHER_NAMES

# Patterns that whole values match.
_L = r"\p{L}"
SIN = r"^\d{3}[ .-]?\d{3}[ .-]?\d{3}$"
EMAIL = r"^[^@\s]+@[^@\s]+\.[A-Za-z]{2,}$"
POSTAL = r"^[A-Za-z]\d[A-Za-z][ -]*\d[A-Za-z]\d$"
PHONE = r"^[\d\s().+-]+$"
PHONE_STRICT = r"^(?:\+?1[ .-]?)?\(?\d{3}\)?[ .-]?\d{3}[ .-]\d{4}$"
NAME = rf"^{_L}+(?:[ '\-.’]+{_L}+)*\.?$"
FULL_NAME = rf"^{_L}+(?:[ ,'\-.’]+{_L}+)+\.?$"
NAME_WORD = rf"^{_L}[^\P{{L}}'\-’]*\.?$"
# Words that name kinds of streets.
STREET_WORDS = (
    "st", "street", "ave", "avenue", "rd", "road", "blvd", "boulevard", "dr", "drive", "cres", "crescent", "way", "lane", "ln", "court", "ct", "crt", "rue", "ch", "chemin",
    "pl", "place", "trail", "hwy", "highway", "pkwy", "parkway", "terr", "terrace", "cir", "circle",
)
STREET = r"(?i)^\d+[A-Za-z]?(?:-\d+)?\s+.*\b(?:" + "|".join(STREET_WORDS) + r")\b.*$"

# Words of headers by kind. First those of which one is a word of the header, then those that are part of its words put together.
HEADERS_BEFORE_NAMES = (
    ("sin", ("sin", "ssn", "nas", "sinno", "sinnum"), ("socialinsurance", "socialsecurity")),
    ("email", (), ("email", "courriel")),
    ("phone", ("phone", "tel", "telephone", "mobile", "cell", "fax", "cellphone"), ("phone",)),
    ("postal_code", ("zip",), ("postal", "postcode", "zipcode")),
    ("province", ("province", "prov", "state", "territory"), ("province",)),
    ("city", ("city", "town", "municipality", "ville"), ()),
    ("first_name", ("fname", "first", "given", "prenom", "forename"), ("firstname", "givenname")),
    ("last_name", ("lname", "last", "nom", "family"), ("lastname", "surname", "familyname")),
)
HEADERS_AFTER_NAMES = (
    ("street_address", ("street", "adresse", "line1"), ("address", "addr")),
    ("date", ("date", "dob", "dt", "dte", "birthdate", "birthday"), ("birth",)),
    ("free_text", ("note", "notes", "comment", "comments", "description", "desc", "remarks", "memo", "narrative"), ()),
    (
        "identifier",
        ("id", "no", "num", "number", "nbr", "code", "key", "acct", "account", "ref", "uid", "guid", "uuid", "file", "case", "claim", "policy"),
        (),
    ),
)
# How headers of two kinds may end.
ENDINGS = {"date": "date", "identifier": "id"}
# Headers of full names, whole; owners of names; words for people, and what may stand with them.
FULL_NAME_HEADERS = ("fullname", "clientname", "customername", "patientname", "employeename", "personname", "contactname", "membername", "name")
NAME_OWNERS = (
    "full", "client", "person", "customer", "patient", "employee", "contact", "member", "applicant", "beneficiary", "recipient", "claimant", "student", "owner", "holder", "legal",
    "display", "spouse", "name",
)
PEOPLE = (
    "worker", "caseworker", "staff", "agent", "officer", "manager", "supervisor", "clerk", "author", "employee", "patient", "beneficiary", "applicant", "claimant", "recipient",
    "spouse", "guardian", "counsellor", "counselor", "adjudicator", "assessor", "reviewer",
)
BESIDE_PEOPLE = ("assigned", "primary", "case", "full", "name", "responsible", "lead")


def tokens_of(header: str) -> list[str]:
    spaced = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", " ", header)
    return [t for t in re.split(r"[^a-z0-9]+", spaced.lower()) if t]


def column_hint(header: str) -> str | None:
    """The kind that a header speaks for."""
    tokens = tokens_of(header)
    joined = "".join(tokens)

    def first(headers: tuple) -> str | None:
        for kind, own, parts in headers:
            if set(tokens) & set(own) or any(p in joined for p in parts) or (kind in ENDINGS and joined.endswith(ENDINGS[kind])):
                return kind
        return None

    found = first(HEADERS_BEFORE_NAMES)
    if found:
        return found
    owned = "name" in tokens and set(tokens) <= set(NAME_OWNERS)
    people = set(tokens) & set(PEOPLE) and set(tokens) <= {*PEOPLE, *BESIDE_PEOPLE}
    if joined in FULL_NAME_HEADERS or owned or people:
        return "full_name"
    return first(HEADERS_AFTER_NAMES)


def province_of(v: Column) -> Column:
    """The abbreviation that a text names, or null."""
    key = F.lower(F.regexp_replace(F.regexp_replace(v, r"^\s+|\s+$", ""), r"\.$", ""))
    table = F.create_map(*(F.lit(x) for pair in PROVINCE_LOOKUP.items() for x in pair))
    return F.try_element_at(table, key)


def is_person_name(v: Column) -> Column:
    words = F.array_remove(F.split(F.regexp_replace(v, ",", " "), r"\s+"), "")
    return F.size(words).between(2, 4) & F.forall(words, lambda w: F.substring(w, 1, 1).rlike(r"\p{Lu}") & w.rlike(NAME_WORD))


def _phone(v: Column) -> Column:
    return v.rlike(PHONE) & F.length(F.regexp_replace(v, r"[^\d]", "")).between(7, 11)


def conforms(kind: str, v: Column) -> Column:
    """Whether a stripped value fits a kind."""
    tests = {
        "sin": lambda: v.rlike(SIN),
        "email": lambda: v.rlike(EMAIL),
        "postal_code": lambda: v.rlike(POSTAL),
        "phone": lambda: _phone(v),
        "first_name": lambda: v.rlike(NAME),
        "last_name": lambda: v.rlike(NAME),
        "city": lambda: v.rlike(NAME),
        "full_name": lambda: v.rlike(FULL_NAME),
        "street_address": lambda: (F.length(v) >= 3) & v.rlike(_L),
        "province": lambda: province_of(v).isNotNull(),
        "numeric": lambda: numbers.is_number(v),
        "date": lambda: parse_date(v).isNotNull(),
    }
    return tests[kind]() if kind in tests else F.lit(True)


def rate_values(v: Column) -> dict[str, Column]:
    """What one stripped value adds to each rate: a number, or null where it doesn't count."""
    share = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    out = {k: share(conforms(k, v)) for k in ("sin", "email", "postal_code", "phone", "date", "province", "first_name", "full_name", "street_address", "numeric")}
    out["luhn"] = F.when(v.rlike(SIN), numbers.luhn_ok(v).cast("int"))
    out["phone_strict"] = share(v.rlike(PHONE_STRICT))
    out["street_strong"] = share(v.rlike(STREET))
    out["person"] = share(is_person_name(v))
    out["leading_zero"] = share(v.rlike(r"^0\d"))
    out["length"] = F.length(v)
    out["words"] = F.size(F.array_remove(F.split(v, r"\s+"), ""))
    return out


def rate(x: Column, times: Column) -> Column:
    """The mean of what values add to a rate; 0 if none counts. times: how many rows have the value."""
    return F.coalesce(F.sum(x * times) / F.sum(F.when(x.isNotNull(), times)), F.lit(0.0))


def rate_columns(v: Column) -> dict[str, Column]:
    """Aggregates over a column's stripped values that detection needs."""
    return {k: F.coalesce(F.avg(x), F.lit(0.0)) for k, x in rate_values(v).items()}


@dataclass
class Detected:
    kind: str
    reason: str


def decide(header: str, rates: dict[str, float], n_distinct: int, n_values: int, category_threshold: int = 50, n_shared: int = 0, covered: bool = False) -> Detected:
    """The first kind in the list of rules whose condition holds.

    n_shared: values that several rows have; covered: whether they are nearly all values, however many rare ones there are.
    """
    if not n_values:
        return Detected("empty", "no values")
    hint, r = column_hint(header), rates

    def strong(kind: str) -> bool:
        return r[kind] >= 0.8 or hint == kind and r[kind] >= 0.5

    said = lambda kind: f"header, {r.get(kind, 0):.0%} of values fit" if hint == kind else f"{r.get(kind, 0):.0%} of values fit"
    if hint == "sin" and r["sin"] >= 0.5 or r["sin"] >= 0.8 and r["luhn"] >= 0.8:
        return Detected("sin", said("sin"))
    for kind in ("email", "postal_code"):
        if strong(kind):
            return Detected(kind, said(kind))
    if hint == "phone" and r["phone"] >= 0.5 or r["phone_strict"] >= 0.8:
        return Detected("phone", said("phone"))
    for kind in ("date", "province"):
        if strong(kind):
            return Detected(kind, said(kind))
    if hint in ("first_name", "last_name", "city") and r["first_name"] >= 0.5:
        return Detected(hint, "header, values are names")
    if hint == "full_name" and r["full_name"] >= 0.5:
        return Detected("full_name", said("full_name"))
    if hint == "street_address" and r["street_address"] >= 0.5 or r["street_strong"] >= 0.8:
        return Detected("street_address", said("street_address"))
    if n_distinct <= category_threshold and n_distinct <= 0.5 * n_values and hint not in PERSONAL:
        return Detected("category", f"{n_distinct} distinct values")
    if r["person"] >= 0.8 and n_distinct >= 0.3 * n_values:
        return Detected("full_name", "values look like names of people")
    if r["numeric"] >= 0.8:
        if hint == "identifier" or r["leading_zero"] >= 0.2:
            return Detected("identifier", "numbers that name things")
        return Detected("numeric", said("numeric"))
    if covered and 0 < n_shared <= category_threshold and hint not in PERSONAL:
        return Detected("category", f"{n_shared} values that nearly all rows share")
    if r["words"] >= 4 or r["length"] >= 40 or hint == "free_text" and r["length"] >= 15:
        return Detected("free_text", "long text")
    if hint == "identifier" or n_distinct >= 0.9 * n_values:
        return Detected("identifier", "header" if hint == "identifier" else "nearly all values differ")
    return Detected("unknown", "no rule fits")
