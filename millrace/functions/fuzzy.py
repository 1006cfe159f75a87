"""Similarities of names. Jaccard is a Column expression; edit-like ratios need Python, over Arrow batches.

The ratios are those of the widely used family: ``ratio`` (matching blocks), ``partial`` (best window of the longer
name), ``token_sort`` and ``token_set``; whole percentages, from the standard library's matcher.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(F.trim(text)), r"\s+"), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Shared words over all words; nothing on both sides is 0."""
    return F.coalesce(F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0)), F.lit(0.0))


def ratio(a: str, b: str) -> int:
    return round(100 * SequenceMatcher(None, a, b).ratio()) if a and b else 0


def partial(a: str, b: str) -> int:
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return 0
    best = 0.0
    for block in SequenceMatcher(None, short, long).get_matching_blocks():
        start = max(0, block.b - block.a)
        score = SequenceMatcher(None, short, long[start : start + len(short)]).ratio()
        if score > 0.995:
            return 100
        best = max(best, score)
    return round(100 * best)


def token_sort(a: str, b: str) -> int:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set(a: str, b: str) -> int:
    x, y = set(a.split()), set(b.split())
    both = " ".join(sorted(x & y))
    one, two = (" ".join([both, *sorted(s)]).strip() for s in (x - y, y - x))
    return max(ratio(both, one), ratio(both, two), ratio(one, two))


SCORES = T.StructType([T.StructField(n, T.IntegerType()) for n in ("ratio", "partial", "token_sort", "token_set")])


@F.pandas_udf(SCORES)
def name_scores(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """All four ratios of two columns of names; null counts as empty."""
    pairs = list(zip(a.fillna(""), b.fillna("")))
    known: dict[tuple[str, str], tuple[int, ...]] = {}
    for p in set(pairs):
        known[p] = tuple(f(*p) for f in (ratio, partial, token_sort, token_set))
    return pd.DataFrame([known[p] for p in pairs], columns=["ratio", "partial", "token_sort", "token_set"])


# The optimizer then keeps the scores where they are made, and doesn't make them again for each test of them.
name_scores = name_scores.asNondeterministic()


@F.pandas_udf(T.StringType())
def ascii_name(name: pd.Series) -> pd.Series:
    """A name's compatibility decomposition without what isn't ASCII, for scripts beyond the fixed table."""
    return name.fillna("").str.normalize("NFKD").str.encode("ascii", "ignore").str.decode("ascii")


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """The share of matching characters of two names, 0 to 1; two empty names are alike."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a.fillna(""), b.fillna(""))], dtype=float)


# Words that don't tell the names of two sources apart.
SOURCE_WORDS = (r"\b(whiskey|whisky|bourbon|scotch|single malt|port|tawny)\b", r"\b(year|years|yr|yrs|old)\b", r"[^\w\s]")


def source_name(name: Column) -> Column:
    """A name as sources are compared: without kinds, years and marks, single spaces."""
    out = F.lower(F.coalesce(name, F.lit("")))
    for pattern in SOURCE_WORDS:
        out = F.regexp_replace(out, pattern, "")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def source_similarity(expected: Column, extracted: Column) -> Column:
    """How alike two sources' names are, 0 to 1; without a name on either side 0."""
    given = F.coalesce((expected != "") & (extracted != ""), F.lit(False))
    return F.when(given, sequence_ratio(source_name(expected), source_name(extracted))).otherwise(0.0)
