"""Leaks: generated values that are, perhaps written otherwise, values of the real data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery.functions.keys import leak_keys
from loomery.functions.names import named
from loomery.functions.shape import is_blank
from loomery.sources.shared import Tables


def unpivot(df: DataFrame, columns: list[str]) -> DataFrame:
    """(value) of all cells of these columns."""
    return df.select(F.explode(F.array(*(named(c).cast("string") for c in columns))).alias("value"))


def real_keys(df: DataFrame, columns: list[str]) -> DataFrame:
    """Keys of all values that aren't blank in these columns, each as often as it is there."""
    df = df.select(*(named(c) for c in columns)).repartition(df.sparkSession.sparkContext.defaultParallelism)  # a small file is one partition
    values = unpivot(df, columns).filter(~is_blank(F.col("value")))
    return values.select(F.explode(leak_keys(F.col("value"))).alias("key"))


def leaked(candidates: DataFrame, keys: DataFrame, by: list[str], value: str = "value", most: int = 1_000_000) -> DataFrame:
    """Distinct ``by`` of the candidates with a key among ``keys``, whatever column the real value was in.

    While candidates have ``most`` keys or fewer, the keys' hashes go to the tasks that read the real values, and no real value
    moves unless its hash is there; more of them meet the real keys by a shuffle. The rows are the same.
    """
    wanted = candidates.filter(~is_blank(F.col(value))).select(*by, F.explode(leak_keys(F.col(value))).alias("key"))
    asked = wanted.select(F.xxhash64("key").alias("asked")).distinct()
    if asked.count() <= most:
        keys = keys.join(F.broadcast(asked), F.xxhash64("key") == F.col("asked"), "left_semi")
    return wanted.join(keys.distinct(), "key", "left_semi").select(*by).distinct()


class RealKeys:
    """Hashes of the keys of all real values in some columns: one pass over the real data, eight bytes for each key.

    Two keys in 2 ** 64 have the same hash; a value that only seems to leak is replaced for nothing.
    """

    #: Candidates whose keys' hashes may go to all tasks: 24 bytes each at most.
    SMALL = 200_000

    def __init__(self, df: DataFrame, columns: list[str], tables: Tables):
        self.hashes = tables.keep(real_keys(df, columns).select(F.xxhash64("key").alias("hash")).distinct(), "real_keys")

    def leaked(self, candidates: DataFrame, by: list[str], most: int, value: str = "value") -> DataFrame:
        """Distinct ``by`` of the candidates, ``most`` at most, that have a key of a real value."""
        asked = candidates.filter(~is_blank(F.col(value))).select(*by, F.explode(leak_keys(F.col(value))).alias("key")).select(*by, F.xxhash64("key").alias("hash"))
        known = self.hashes
        if most <= self.SMALL:
            known = F.broadcast(known.join(F.broadcast(asked.select("hash").distinct()), "hash", "left_semi"))
        return asked.join(known, "hash", "left_semi").select(*by).distinct()
