"""Fuzzy title and creator scores: native where a closed form exists, one Arrow UDF for the rest."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from .text import normalize_text, tokens


def ratio_percent(a: str | None, b: str | None) -> int | None:
    if a is None or b is None:
        return None
    return round(SequenceMatcher(None, a, b).ratio() * 100)


@F.pandas_udf(IntegerType())
def ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-block ratio in whole percent; pairs with a null are passed over."""
    return pd.Series([ratio_percent(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")


# so marked, a score is computed once for each pair, and no filter on it is pushed below with a copy
ratio_udf = ratio_udf.asNondeterministic()


def length_ratio(part: Column, whole: Column) -> Column:
    """The ratio of two texts of these lengths, of which one begins with the other (half to even)."""
    return F.bround(F.lit(2.0) * part / (part + whole) * 100, 0).cast("int")


def with_token_bounds(pairs: DataFrame, left: str, right: str, prefix: str = "ts_") -> DataFrame:
    """Adds the parts of the token-set score of two sorted token arrays.

    ``both`` shared tokens, ``one``/``two`` each side's tokens with the shared ones first,
    ``low`` the best closed-form ratio, ``high`` the length bound of the remaining one.
    """
    p = prefix
    a, b = F.col(left), F.col(right)
    shared = F.array_sort(F.array_intersect(a, b))
    out = pairs.withColumn(f"{p}shared", shared)
    shared = F.col(f"{p}shared")
    out = out.withColumns({
        f"{p}both": F.array_join(shared, " "),
        f"{p}one": F.array_join(F.concat(shared, F.array_except(a, b)), " "),
        f"{p}two": F.array_join(F.concat(shared, F.array_except(b, a)), " "),
    })
    n0, n1, n2 = (F.length(f"{p}{x}") for x in ("both", "one", "two"))
    empty = (F.size(a) == 0) | (F.size(b) == 0)
    low = F.when(empty | (n0 == 0), 0).otherwise(F.greatest(length_ratio(n0, n1), length_ratio(n0, n2)))
    high = F.when(empty, 0).otherwise(F.bround(F.lit(2.0) * F.least(n1, n2) / (n1 + n2) * 100, 0).cast("int"))
    return out.withColumns({f"{p}low": low.cast("int"), f"{p}high": high.cast("int")})


def with_token_set_score(pairs: DataFrame, left: str, right: str, out: str, least: int | None = None) -> DataFrame:
    """Adds the token-set score of two sorted token arrays, 0 where a side is empty.

    Only pairs whose length bound exceeds the closed form reach Python.  With ``least`` set,
    pairs that cannot reach it stay with their closed form, which is then below it too.
    """
    p = f"__{out}_"
    bounded = with_token_bounds(pairs, left, right, p)
    need = F.col(f"{p}high") > F.col(f"{p}low")
    if least is not None:
        need = need & (F.greatest(f"{p}high", f"{p}low") >= least)
    third = ratio_udf(F.when(need, F.col(f"{p}one")), F.when(need, F.col(f"{p}two")))
    return bounded.withColumn(out, F.greatest(F.col(f"{p}low"), F.coalesce(third, F.lit(0)))).drop(*[f"{p}{x}" for x in ("shared", "both", "one", "two", "low", "high")])


def with_title_score(pairs: DataFrame, query: str, title: str, out: str = "title_score", method: str = "token_set", least: int | None = None) -> DataFrame:
    """Adds the score of two raw titles by ``method``: ``token_set`` or ``simple``."""
    if method == "simple":
        a, b = normalize_text(F.col(query)), normalize_text(F.col(title))
        score = ratio_udf(F.nullif(a, F.lit("")), F.nullif(b, F.lit("")))
        return pairs.withColumn(out, F.coalesce(score, F.lit(0)))
    keyed = pairs.withColumns({"__q": tokens(normalize_text(F.col(query))), "__t": tokens(normalize_text(F.col(title)))})
    return with_token_set_score(keyed, "__q", "__t", out, least).drop("__q", "__t")


def token_set_percent(a: list[str], b: list[str]) -> int:
    """The token-set score of two sorted token lists (for use inside UDFs)."""
    if not a or not b:
        return 0
    both = sorted(set(a) & set(b))
    one, two = " ".join(both + sorted(set(a) - set(b))), " ".join(both + sorted(set(b) - set(a)))
    third = ratio_percent(one, two)
    if not both:
        return third
    n0 = len(" ".join(both))
    return max(third, *(round(2.0 * n0 / (n0 + n) * 100) for n in (len(one), len(two))))


@F.pandas_udf(IntegerType())
def creator_score_udf(wanted: pd.Series, creators: pd.Series) -> pd.Series:
    """The best token-set score of one token list against a list of token lists."""
    out = [0 if a is None or bs is None else max((token_set_percent(list(a), list(b)) for b in bs), default=0) for a, bs in zip(wanted, creators, strict=True)]
    return pd.Series(out, dtype="int32")


creator_score_udf = creator_score_udf.asNondeterministic()


def creator_score(wanted: Column, creators: Column) -> Column:
    """Best score of a wanted creator over a record's creators; 0 if either is empty."""
    mine = tokens(normalize_text(wanted))
    theirs = F.transform(F.coalesce(creators, F.array().cast("array<string>")), lambda c: tokens(normalize_text(c)))
    worth = (F.size(mine) > 0) & (F.size(theirs) > 0)
    return creator_score_udf(F.when(worth, mine), F.when(worth, theirs))
