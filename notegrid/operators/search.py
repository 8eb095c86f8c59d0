"""Full-text search by subsequence, with a score of our own.

Membership: the characters of a keyword occur in order (smart case). Score of a
keyword over a text: 16 for each matched character, 8 more at the start of a
word, 10 more for each that follows the one before directly, less the length of
the gaps up to 16 each; the better of the leftmost match and the first whole
occurrence. A query's score is the sum.
"""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from notegrid.functions import expr as X


def search_text(name: Column | str = "name", body: Column | str = "md_text") -> Column:
    return F.concat(X.col(name), F.lit(" "), F.coalesce(X.col(body), F.lit("")))


def matches(text: Column | str, query: str, logic: str = "or") -> Column:
    """AND or OR over the keywords of the query; blank queries: no keyword, so AND holds and OR doesn't."""
    if logic not in ("and", "or"):
        raise ValueError(f"unknown logic {logic!r}")
    each = [X.col(text).rlike(X.subsequence(k)) for k in query.split()]
    if not each:
        return F.lit(logic == "and")
    return reduce((lambda a, b: a & b) if logic == "and" else (lambda a, b: a | b), each)


def score_one(text: str | None, keyword: str) -> int:
    if text is None or not keyword:
        return 0
    t, k = (text, keyword) if any(c.isupper() for c in keyword) else (text.lower(), keyword.lower())

    def along(places: list[int]) -> int:
        total = 16 * len(k) + sum(8 for i in places if i == 0 or not t[i - 1].isalnum())
        return total + sum(10 if j == i + 1 else -min(16, j - i - 1) for i, j in zip(places, places[1:]))

    places, at = [], 0
    for c in k:
        i = t.find(c, at)
        if i < 0:
            return 0
        places.append(i)
        at = i + 1
    whole = t.find(k)
    return max(1, along(places), along(list(range(whole, whole + len(k)))) if whole >= 0 else 0)


def score(text: Column | str, query: str) -> Column:
    words = query.split()

    @F.pandas_udf(T.LongType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: sum(score_one(t, w) for w in words))

    return run(X.col(text))


def search(rows: DataFrame, query: str, logic: str = "or", limit: int = 100, text: str = "text", order: str = "path") -> DataFrame:
    """Best ``limit`` rows; an empty query gives the first rows by ``order``. Only matches are scored."""
    if query == "":
        return rows.orderBy(order).limit(limit)
    found = rows.where(matches(text, query, logic))
    if not query.split():
        return found.withColumn("score", F.lit(0).cast("bigint")).orderBy(order).limit(limit)
    return found.withColumn("score", score(text, query)).orderBy(F.desc("score"), order).limit(limit)


def keywords(query: str) -> list[str]:
    return re.split(r"\s+", query.strip()) if query.strip() else []
