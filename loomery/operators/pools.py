"""Pools of values that a twin's cells draw from, without those that are real."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from loomery.functions import providers, rng, shape
from loomery.functions.providers import Draws
from loomery.operators.leaks import RealKeys

MAKERS = {"first": providers.first_name, "last": providers.last_name, "city": providers.city, "street": providers.street_name}
#: Words that are made up where all values of a pool are real.
MADE_UP = 500
_SIGN = "\x1f"


def pool_size(rows: int) -> int:
    """Draws of a pool for a twin of so many rows."""
    return min(3000, max(300, 2 * rows))


class Pools:
    """Values by kind, as often as they were drawn; what isn't pooled is drawn as it comes."""

    def __init__(self, values: dict[str, list[str]] | None = None, dropped: dict[str, int] | None = None):
        self.values, self.dropped = values or {}, dropped or {}

    def pick(self, kind: str, u: Column) -> Column:
        """A value of the pool, by its place among those that are left."""
        pool = self.values.get(kind)
        if pool is None:
            # each part of the value has a number of its own, all of them from u
            return MAKERS[kind](Draws("pool", kind, 0, F.xxhash64(u)))
        # one literal that is split once, when the plan is made
        return F.get(F.split(F.lit(_SIGN.join(pool)), _SIGN), rng.index(u, len(pool)))


def checked_pools(spark: SparkSession, seed: str, rows: int, known: RealKeys, kinds: Iterable[str], locale: str = "en") -> Pools:
    """Pools of these kinds, sized by the twin, in which no value has a key of a real one.

    Candidates are a table of (kind, made_up, place, value); those that leak are left out, and the others keep their
    order. Where nothing is left, made-up words that don't leak take the place.
    """
    size, table = pool_size(rows), None
    for kind in kinds:
        drawn = spark.range(size).select(F.lit(kind).alias("kind"), F.lit(False).alias("made_up"), F.col("id").alias("place"), MAKERS[kind](Draws(seed, f"pool {kind}", 0, F.col("id"), locale)).alias("value"))
        word = shape.pronounceable(4 + rng.index(rng.fast(seed, kind, "length", F.col("id")), 5), seed, kind, "word", F.col("id"))
        made = spark.range(MADE_UP).select(F.lit(kind).alias("kind"), F.lit(True).alias("made_up"), F.col("id").alias("place"), word.alias("value"))
        both = drawn.unionAll(made)
        table = both if table is None else table.unionAll(both)
    if table is None:
        return Pools()
    by = ["kind", "made_up", "place"]
    left = table.join(known.leaked(table, by, 4 * (size + MADE_UP)), by, "left_anti").collect()  # 14,000 values at most
    values, dropped = {}, {}
    for kind in kinds:
        mine = sorted((r for r in left if r["kind"] == kind), key=lambda r: (r["made_up"], r["place"]))
        kept = [r["value"] for r in mine if not r["made_up"]]
        dropped[kind] = size - len(kept)
        values[kind] = kept or [r["value"] for r in mine]
        if not values[kind]:
            del values[kind]  # cells are checked one by one in any case
    return Pools(values, dropped)
