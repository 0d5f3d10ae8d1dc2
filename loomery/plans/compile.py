"""Specifications to DataFrames: one expression for each column over the row number.

Values depend on (seed, column, row) alone; without a seed one is drawn. Unique columns draw without replacement, by a
permutation of all values that the range, the list or the provider's parts together have; they need at least as many
values as rows.
"""

from __future__ import annotations

import csv
from dataclasses import replace
from math import gcd, isqrt, prod
from pathlib import Path
from secrets import randbits
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomery.functions.names import named
from loomery.functions import providers, rng
from loomery.plans.spec import ColumnSpec, DatasetSpec, SchemaError

ROW = "_row"
#: More numbers than this are permuted by stretches.
LARGEST = 1 << 40


def read_values(path: str | Path) -> list[str]:
    """The first cell of each row of a CSV file, or each line of another; without blanks."""
    with open(path, newline="", encoding="utf-8-sig") as file:
        if str(path).lower().endswith(".csv"):
            return [r[0] for r in csv.reader(file) if r and r[0].strip()]
        return [line.strip() for line in file if line.strip()]


def permuted(row: Column, n: int, seed: Any, label: str, rounds: int = 4) -> Column:
    """Row numbers below n in another order, which the seed and the label choose.

    A number is a pair below (a, b) with a * b = n; in turn, each half is moved round by a hash of the other, which
    can be undone, so no two numbers become one. If n is prime, numbers are multiplied and moved round.
    """
    row = row.cast("long")
    if n > LARGEST:  # as many stretches of numbers, and any number in each
        k = n // LARGEST
        return permuted(row, LARGEST, seed, label) * F.lit(k) + F.pmod(F.xxhash64(F.lit(str(seed)), F.lit(label), row), F.lit(k))
    a = next(d for d in range(isqrt(max(n, 1)), 0, -1) if n % d == 0)
    if a == 1:
        start = int.from_bytes(f"{seed}|{label}".encode(), "little") % max(n, 1)
        by = max(1, int(n * 0.6180339887)) | 1
        while gcd(by, n) != 1:
            by += 2
        return F.pmod(row.cast("decimal(38,0)") * F.lit(by) + F.lit(start), F.lit(n)).cast("long")
    b = n // a
    moved = lambda x, by, k, size: F.pmod(x + F.pmod(F.xxhash64(F.lit(str(seed)), F.lit(label), k, by), F.lit(size)), F.lit(size))

    def turn(halves: Column, k: Column) -> Column:
        left = moved(halves["left"], halves["right"], 2 * k, a)
        return F.struct(left.alias("left"), moved(halves["right"], left, 2 * k + 1, b).alias("right"))

    first = F.struct(_whole(row, b).alias("left"), F.pmod(row, F.lit(b)).alias("right"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), first, turn, lambda halves: halves["left"] * F.lit(b) + halves["right"])


def _whole(x: Column, by: int) -> Column:
    """x over by, without the rest."""
    return F.call_function("div", x, F.lit(by)).cast("long")


class Placed(providers.Draws):
    """Draws that together stand for one place among all combinations of a provider's parts."""

    def __init__(self, parts: dict[str, int], place: Column, seed: Any, label: str, row: Column, locale: str):
        super().__init__(seed, label, 0, row, locale)
        self.digits: dict[str, Column] = {}
        below = 1
        for name, size in parts.items():
            self.digits[name] = (F.pmod(_whole(place, below) if below < 1 << 62 else F.lit(0), F.lit(size)) + 0.5) / F.lit(float(size))
            below *= size

    def __call__(self, name: str) -> Column:
        return self.digits[name] if name in self.digits else super().__call__(name)


def _date(x: Any) -> Column:
    return F.lit(str(x)).cast("date")


def _value(c: ColumnSpec, seed: Any, row: Column, rows: int, passed: Column | None, locale: str) -> Column:
    p, u = c.params, rng.uniform(seed, c.name, 0, row)

    def below(n: int) -> Column:
        if not c.unique:
            return F.floor(u * n).cast("long")
        if n < rows:
            raise SchemaError(f"{c.name}: {rows} unique values are needed, and there are {n}")
        return permuted(row, min(n, 1 << 62), seed, c.name)

    if c.type == "sequence":
        return row * F.lit(p.get("step", 1)) + F.lit(p.get("start", 1))
    if c.type == "constant":
        if c.unique and rows > 1:
            raise SchemaError(f"{c.name}: a constant can't be unique")
        return F.lit(p["value"])
    if c.type == "code_set":
        values = p.get("values") or read_values(p["values_file"])
        if p.get("weights") and not c.unique:
            if len(p["weights"]) != len(values):
                raise SchemaError(f"{c.name}: as many weights as values are needed")
            return rng.weighted(u, values, p["weights"])
        return F.get(F.array(*map(F.lit, values)), below(len(values)).cast("int"))
    if c.type == "numeric_range":
        low, high = p["min"], p["max"]
        whole = c.dtype == "int" or (c.dtype is None and isinstance(low, int) and isinstance(high, int))
        if whole:
            return below(int(high) - int(low) + 1) + F.lit(int(low))
        return u * F.lit(float(high) - float(low)) + F.lit(float(low))
    if c.type == "date_range":
        start, end = str(p["start"]), str(p["end"])
        import datetime as dt

        days = max(0, (dt.date.fromisoformat(end) - dt.date.fromisoformat(start)).days)
        return F.date_format(F.date_add(_date(start), below(days + 1).cast("int")), "yyyy-MM-dd")
    if c.type == "faker":
        if c.unique:
            if p["provider"] == "uuid4":
                return providers.call("uuid4", providers.Draws(seed, c.name, 0, row, locale), p.get("kwargs"))
            if not providers.is_known(p["provider"]):
                raise ValueError(f"Unknown provider: {p['provider']}")
            parts = providers.parts(p["provider"], p.get("kwargs"), locale)
            if parts is None:
                raise SchemaError(f"{c.name}: values of {p['provider']} can't be made unique")
            return providers.call(p["provider"], Placed(parts, below(prod(parts.values())), seed, c.name, row, locale), p.get("kwargs"))
        return providers.call(p["provider"], providers.Draws(seed, c.name, 0, row, locale), p.get("kwargs"))
    if c.type == "passthrough":
        return passed
    raise SchemaError(f"{c.name}: type {c.type!r} can't be generated")


def open_reference(spark: SparkSession, path: str | Path) -> DataFrame:
    """A Parquet or CSV file with a header."""
    name = str(path)
    if name.lower().rstrip("/").endswith(".parquet"):
        return spark.read.parquet(name)
    if name.lower().endswith(".csv"):
        return spark.read.csv(name, header=True, inferSchema=True, escape='"')
    raise SchemaError(f"a reference is a .parquet or .csv file: {name}")


def compile_spec(spark: SparkSession, spec: DatasetSpec, rows: int | None = None, reference: str | None = None, reference_limit: int = 200_000, partitions: int | None = None) -> DataFrame:
    """The dataset that ``spec`` describes, lazily.

    Passthrough columns take values, with replacement, from the first ``reference_limit`` rows of the reference; that
    list is the bound of what is sent to the tasks.
    """
    n = spec.rows if rows is None else rows
    spec = spec if spec.seed is not None else replace(spec, seed=randbits(31))  # another dataset each time
    seed = spec.seed
    base = spark.range(0, n, 1, partitions or max(1, min(n // 50_000 + 1, 100_000))).withColumnRenamed("id", ROW)
    passing = [c for c in spec.columns if c.type == "passthrough"]
    if passing:
        source = open_reference(spark, reference or spec.reference)
        missing = [w for w in dict.fromkeys(c.params["source_column"] for c in passing) if w not in source.columns]
        if missing:
            raise SchemaError(f"the reference has no column {', '.join(missing)}")
    for i, c in enumerate(passing):
        head = source.select(named(c.params["source_column"]).alias(f"_v{i}")).limit(reference_limit).filter(F.col(f"_v{i}").isNotNull())
        pool = head.select(f"_v{i}", (F.row_number().over(W.orderBy(F.monotonically_increasing_id())) - 1).cast("long").alias(f"_n{i}"))
        size = pool.count()
        if not size:
            raise SchemaError(f"the reference has no values in {c.params['source_column']}")
        place = F.floor(rng.uniform(seed, c.name, 0, F.col(ROW)) * size)
        base = base.withColumn(f"_k{i}", place).join(F.broadcast(pool), F.col(f"_k{i}") == F.col(f"_n{i}"))  # reference_limit rows at most
    return base.select(*column_expressions(spec, n))


def column_expressions(spec: DatasetSpec, rows: int) -> list[Column]:
    """The columns over the row number; passthrough columns have their values in _v0, _v1, ..."""
    seed = "" if spec.seed is None else spec.seed
    passing = [c for c in spec.columns if c.type == "passthrough"]
    row, out = F.col(ROW), []
    for c in spec.columns:
        value = _value(c, seed, row, rows, F.col(f"_v{passing.index(c)}") if c in passing else None, spec.locale)
        if c.missing_pct:
            value = F.when(rng.uniform(seed, c.name, "missing", row) * 100 >= c.missing_pct, value)
        out.append(value.alias(c.name))
    return out
