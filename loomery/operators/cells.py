"""Cells of a twin: expressions that draw values of a profile's shape.

A cell is blank, junk or proper with the profile's rates. Proper values of one row belong together: the names in its
columns and in its e-mail address, the province and the postal code, and the dates of a group, which keep their order.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomery.functions import dates, numbers, providers, rng, shape
from loomery.functions.providers import Draws
from loomery.operators.detect import POSTAL_LETTERS, PROVINCES
from loomery.operators.pools import Pools
from loomery.operators.profile import SEP, ColumnProfile

DRAW, TRIO = "_draw", "_trio"
# Fixed value: letters that postal codes are made of.
POSTAL_ALPHABET = "ABCEGHJKLMNPRSTVWXYZ"


def choice(u: Column, counts: dict[str, int], empty: str = "") -> Column:
    """A key of the counts, by count."""
    if not counts:
        return F.lit(empty)
    keys = sorted(counts)
    return rng.weighted(u, keys, [counts[k] for k in keys])


def sample(u: Column, v: Column, edges: Sequence[float]) -> Column:
    """Uniform within a bin that u picks; all bins are as likely."""
    if len(edges) < 2:
        return F.lit(float(edges[0] if edges else 0.0))
    low, high = rng.literals([float(x) for x in edges[:-1]]), rng.literals([float(x) for x in edges[1:]])
    i = rng.index(u, len(edges) - 1)
    return F.get(low, i) + v * (F.get(high, i) - F.get(low, i))


class Twin:
    """Expressions for one file: ``record()`` columns first, then ``cell()`` for each column.

    Draw 0 is a cell's first value. Draw 1 is any other, by the number in the column DRAW: blanks, styles, masks and
    formats stay, the value is new. The record's names are those of the number in the column TRIO.
    """

    def __init__(self, profiles: list[ColumnProfile], groups: list[list[int]], seed: str, row: Column, pools: Pools | None = None):
        self.profiles, self.groups, self.seed, self.row, self.pools = profiles, groups, seed, row, pools or Pools()
        merged = lambda kind: sum((Counter(p.counts[kind]) for p in profiles), Counter())
        self.provinces = {k: n for k, n in merged("province").items() if k in PROVINCES}
        self.letters = {k: n for k, n in merged("letter").items() if any(k in x for x in POSTAL_LETTERS.values())}
        self.has_province = any(p.kind == "province" for p in profiles)

    def u(self, label: str, draw: object = 0) -> Column:
        return rng.fast(self.seed, label, draw, self.row)

    def at(self, draw: int) -> Column:
        """What the draw's numbers depend on besides their names."""
        return F.xxhash64(self.row, F.col(DRAW)) if draw else self.row

    def x(self, label: str, name: str, draw: int) -> Column:
        return rng.fast(self.seed, label, f"{name}{draw}", self.at(draw))

    def _draws(self, label: str, draw: int) -> Draws:
        return Draws(self.seed, label, draw, self.at(draw))

    def names(self, trio: Column) -> tuple[Column, Column, Column]:
        """First, middle and last name of the record, as the trio's number has them."""
        one = lambda name, kind: self.pools.pick(kind, rng.fast(self.seed, "names", name, self.row, trio))
        return one("first", "first"), one("middle", "first"), one("last", "last")

    def record(self) -> dict[str, Column]:
        """What the cells of a row share; columns named _first, _last, _province and so on."""
        first, middle, last = self.names(F.col(TRIO))
        out = {"_first": first, "_middle": middle, "_last": last}
        out["_province"] = choice(self.u("province"), self.provinces or dict.fromkeys(PROVINCES, 1))
        for g, group in enumerate(self.groups):
            drawn = F.array_sort(F.array(*(sample(self.u(f"date{i}"), self.u(f"date{i}", "v"), self.profiles[i].edges) for i in group)))
            out |= {f"_date{i}": F.get(drawn, n) for n, i in enumerate(group)}
        return out

    def _names(self, draw: int) -> tuple[Column, Column, Column]:
        if draw == 0:
            return F.col("_first"), F.col("_middle"), F.col("_last")
        first, middle, last = (self.pools.pick(kind, self.x("other", name, draw)) for name, kind in (("f", "first"), ("m", "first"), ("l", "last")))
        return first, middle, F.concat_ws("-", last, self.pools.pick("last", self.x("other", "s", draw)))

    def _local(self, draw: int) -> Column:
        first, _, last = self._names(draw)
        first, last = providers.ascii_letters(first), providers.ascii_letters(last)
        initial = F.substring(first, 1, 1)
        number = F.lpad(rng.index(self.x("local", "n", draw), 100 if not draw else 100_000).cast("string"), 2, "0")
        forms = [F.concat(first, F.lit("."), last), F.concat(initial, last), F.concat(initial, last, number), F.concat(last, F.lit("."), first), F.concat(first, F.lit("_"), last)]
        return rng.pick(self.x("local", "", draw), forms if not draw else [F.concat(f, number) for f in forms])

    def _postal(self, label: str, draw: int) -> Column:
        if self.has_province:
            letters = F.try_element_at(F.create_map(*(F.lit(x) for pair in POSTAL_LETTERS.items() for x in pair)), F.col("_province"))
            letter = F.substring(letters, rng.index(self.x(label, "l", draw), F.length(letters)) + 1, F.lit(1))
        elif self.letters:
            letter = choice(self.x(label, "l", draw), self.letters)
        else:
            letter = rng.pick(self.x(label, "l", draw), list(POSTAL_ALPHABET))
        digit = lambda k: rng.index(self.x(label, f"d{k}", draw), 10).cast("string")
        other = lambda k: rng.pick(self.x(label, f"o{k}", draw), list(POSTAL_ALPHABET))
        return F.concat(letter, digit(0), other(0), digit(1), other(1), digit(2))

    def _street(self, label: str, draw: int) -> Column:
        digits = rng.index(self.x(label, "m", draw), 3) + 1
        number = (F.pow(F.lit(10.0), digits) * (1 + 8.99 * self.x(label, "h", draw))).cast("int").cast("string")
        unit = F.when(self.x(label, "u", draw) < 0.3, F.concat(F.lit(" Unit "), (rng.index(self.x(label, "v", draw), 400) + 1).cast("string"))).otherwise("")
        return F.concat(number, F.lit(" "), self.pools.pick("street", self.x(label, "street", draw)), unit)

    def _styled(self, value: Column, p: ColumnProfile, label: str) -> Column:
        style = F.split(choice(self.u(label, "style"), p.counts["style"], SEP.join(("mixed", "", ""))), SEP, -1)
        return F.concat(F.get(style, F.lit(1)), shape.apply_case(value, F.get(style, F.lit(0))), F.get(style, F.lit(2)))

    def _masked(self, p: ColumnProfile, label: str, draw: int) -> Column:
        masks = sorted(p.counts["mask"]) or [""]
        i = rng.weighted_index(self.u(label, "mask"), [p.counts["mask"].get(m, 1) for m in masks])
        mask = F.get(rng.literals(masks), i)
        fixed = F.get(F.array(*(F.lit(p.fixed.get(m, shape.FREE * len(m))) for m in masks)), i)
        return shape.fill_mask(mask, self.seed, label, f"fill{draw}", self.at(draw), fixed)

    def _proper(self, i: int, draw: int) -> Column:
        p, label = self.profiles[i], f"c{i}"
        first, middle, last = self._names(draw)
        if p.kind in ("phone", "identifier", "unknown"):
            return self._masked(p, label, draw)
        if p.kind == "sin":
            digits = numbers.new_sin(self.seed, label, draw, self.at(draw))
            wrong = lambda sin: F.concat(F.substring(sin, 1, 8), ((F.substring(sin, 9, 1).cast("int") + 1 + rng.index(self.x(label, "w", draw), 9)) % 10).cast("string"))
            total = sum(p.counts["luhn"].values())
            digits = rng.once(digits, lambda sin: F.when(self.u(label, "luhn") < (p.luhn_valid / total if total else 1.0), sin).otherwise(wrong(sin)))
            return shape.fill_mask_with(choice(self.u(label, "mask"), p.counts["mask"], "999999999"), digits, self.seed, label, f"x{draw}", self.at(draw))
        if p.kind == "postal_code":
            return shape.fill_mask_with(choice(self.u(label, "mask"), p.counts["mask"], "A9A 9A9"), self._postal("postal", draw), self.seed, label, f"x{draw}", self.at(draw))
        if p.kind in ("first_name", "last_name"):
            return self._styled(first if p.kind == "first_name" else last, p, label)
        if p.kind == "full_name":
            template = choice(self.u(label, "template"), {k: n for k, n in p.counts["template"].items() if k} or {"{first} {last}": 1})
            for name, value in (("{first}", first), ("{last}", last), ("{middle}", middle), ("{mi}", F.substring(middle, 1, 1))):
                template = F.replace(template, F.lit(name), value)
            return self._styled(template, p, label)
        if p.kind == "email":
            domains = p.counts["domain"]
            return self._styled(F.concat(self._local(draw), F.lit("@"), choice(self.u(label, "domain"), domains) if domains else providers.free_email_domain(self._draws(label, 0))), p, label)
        if p.kind == "city":
            return self._styled(self.pools.pick("city", self.x(label, "city", draw)), p, label)
        if p.kind == "street_address":
            return self._styled(self._street(label, draw), p, label)
        if p.kind == "province":
            style = F.split(choice(self.u(label, "style"), p.counts["style"], SEP.join(("upper", "", "", "abbr"))), SEP, -1)
            name = F.try_element_at(F.create_map(*(F.lit(x) for pair in PROVINCES.items() for x in pair)), F.col("_province"))
            value = F.when(F.get(style, F.lit(3)) == "abbr", F.col("_province")).otherwise(name)
            return F.concat(F.get(style, F.lit(1)), shape.apply_case(value, F.get(style, F.lit(0))), F.get(style, F.lit(2)))
        if p.kind in ("date", "numeric"):
            return self._measured(i)
        if p.kind == "category":
            values = p.counts["category"] | {f"\0{m}": n for m, n in p.counts["rare"].items()}
            value = choice(self.u(label, "value"), values)
            return F.when(value.startswith("\0"), shape.fill_mask(F.substring(value, F.lit(2), F.length(value)), self.seed, label, "rare", self.row)).otherwise(value)
        if p.kind == "free_text":
            size = choice(self.u(label, "length"), p.counts["length"], "0").cast("int")
            text = providers.text(self._draws(label, draw), size)
            letters = shape.fill_mask(F.repeat(F.lit("a"), size), self.seed, label, f"s{draw}", self.at(draw))
            return self._styled(F.when(size < 5, letters).otherwise(text), p, label)
        return F.lit(None).cast("string")

    def _measured(self, i: int) -> Column:
        p, label = self.profiles[i], f"c{i}"
        formats = sorted(p.counts["format"])
        if not formats:
            return F.lit("")
        if any(i in g for g in self.groups):
            x = F.col(f"_date{i}")
        else:
            x = sample(self.u(label, "bin"), self.u(label, "v"), p.edges)
        which = rng.weighted_index(self.u(label, "format"), [p.counts["format"][f] for f in formats])
        out = F.lit(None).cast("string")
        for n, key in enumerate(formats):
            if p.kind == "date":
                fmt, case, lead, trail = key.split(SEP)
                value = shape.apply_case(dates.render_date(F.round(x, 0), fmt), F.lit(case))
            else:
                fmt, lead, trail = key.split(SEP)
                value = numbers.format_number(x, fmt)
            out = F.when(which == n, F.concat(F.lit(lead), value, F.lit(trail))).otherwise(out)
        return out

    def proper(self, i: int) -> Column:
        """Whether the cell of column i holds a proper value."""
        p = self.profiles[i]
        return self.u(f"c{i}", "mess") >= p.null_rate + p.junk_rate

    def cell(self, i: int, draw: int = 0) -> Column:
        """The value of column i's cell; other draws give others for the same cell."""
        p, label = self.profiles[i], f"c{i}"
        u = self.u(label, "mess")
        blank = choice(self.u(label, "blank"), p.counts["null"], "\0")
        blank = F.when(blank == "\0", F.lit(None).cast("string")).otherwise(blank)
        if p.kind == "empty":
            return blank
        junk = shape.fill_mask(choice(self.u(label, "junk"), p.counts["junk"]), self.seed, label, f"junk{draw}", self.at(draw))
        return F.when(u < p.null_rate, blank).when(u < p.null_rate + p.junk_rate, junk).otherwise(self._proper(i, draw))

    def fallback(self, i: int) -> Column:
        """A value with the cell's mask and other characters, by the number in DRAW."""
        return shape.fill_mask(shape.mask_of(self.cell(i)), self.seed, f"c{i}", "fallback", self.at(1))
