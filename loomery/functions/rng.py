"""Randomness that depends on (seed, label, draw, row) alone, never on partitions or on the order of evaluation."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def _part(x: Any) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("string")


def uniform(seed: Any, label: str, draw: Any, row: Column) -> Column:
    """A number in [0, 1) from the first 32 bits of an MD5 sum; SQL engines with md5() give the same."""
    digest = F.md5(F.concat_ws("|", _part(seed), F.lit(label), _part(draw), row.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def fast(seed: Any, label: str, draw: Any, *row: Column) -> Column:
    """A number in [0, 1) from 52 bits of xxhash64: cheaper, and just as independent of partitions."""
    h = F.xxhash64(F.lit(str(seed)), F.lit(label), _part(draw), *row)
    return F.shiftrightunsigned(h, 12).cast("double") / F.lit(float(1 << 52))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once a row, however often it is used; places of text would each work it out again."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def literals(values: Sequence[Any]) -> Column:
    """An array of constants; plain ones as one SQL text, which is much cheaper to build than a column for each."""
    values = list(values)
    if values and all(isinstance(v, str) and v.isprintable() for v in values):
        quoted = (v.replace("\\", "\\\\").replace("'", "\\'") for v in values)
        return F.expr("array(" + ", ".join(f"'{v}'" for v in quoted) + ")")
    if values and all(isinstance(v, float) and abs(v) < 1e300 for v in values):
        return F.expr("array(" + ", ".join(f"{v!r}D" for v in values) + ")")
    return F.array(*(v if isinstance(v, Column) else F.lit(v) for v in values))


def index(u: Column, n: int | Column) -> Column:
    """0 to n - 1."""
    return F.floor(u * n).cast("int")


def pick(u: Column, values: Sequence[Any]) -> Column:
    """One of the values, each as likely."""
    return F.get(literals(values), index(u, len(values)))


def weighted_index(u: Column, weights: Sequence[float]) -> Column:
    """0 to len(weights) - 1, by weight; a bisection in running sums."""
    total, sums = 0.0, []
    for w in weights:
        total += float(w)
        sums.append(total)
    if total <= 0:
        return index(u, len(sums))
    target = u * total
    if len(sums) <= 4:
        out = F.lit(len(sums) - 1)
        for i in reversed(range(len(sums) - 1)):
            out = F.when(target < sums[i], i).otherwise(out)
        return out.cast("int")
    below = F.size(F.filter(literals(sums), lambda s: s <= target))
    return F.least(below, F.lit(len(sums) - 1)).cast("int")


def weighted(u: Column, values: Sequence[Any], weights: Sequence[float]) -> Column:
    return F.get(literals(values), weighted_index(u, weights))
