"""Keys under which a value and its rewritings meet."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SHORTEST = 3


def folded(v: Column) -> Column:
    return F.replace(F.lower(F.trim(F.regexp_replace(v, r"\s+", " "))), F.lit("ß"), F.lit("ss"))


def leak_keys(v: Column) -> Column:
    """Array of keys: the text, its letters and digits alone, and its words in order; empty for short text.

    Values that differ in case, white space or punctuation share the second key, those with words exchanged the third.
    """

    def keys(text: Column, tokens: Column) -> Column:
        joined = F.array_join(tokens, "")
        found = F.array(
            F.when(F.length(text) >= SHORTEST, F.concat(F.lit("="), text)),
            F.when(F.length(joined) >= SHORTEST, F.concat(F.lit("#"), joined)),
            F.when((F.size(tokens) > 1) & (F.length(text) >= SHORTEST), F.concat(F.lit("~"), F.array_join(F.sort_array(tokens), " "))),
        )
        return F.array_compact(found)

    # functions of one value: the text and its words are worked out once
    split = lambda text: F.get(F.transform(F.array(F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))), lambda tokens: keys(text, tokens)), F.lit(0))
    return F.when(v.isNull(), F.array().cast("array<string>")).otherwise(F.get(F.transform(F.array(folded(v)), split), F.lit(0)))
