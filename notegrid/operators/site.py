"""Index order, pages, search index and page rows of a static site.

Pages need global positions. They come from ranges: rows are written, sorted by
range, numbered inside their partition as they are written again, and offset by
the sizes of the partitions before (one small number each), so no window runs in
a single task and what is below is computed once.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from notegrid.functions import expr as X
from notegrid.functions.html import Renderer
from notegrid.plans.scratch import written


def by_date() -> list[Column]:
    """Newest first, without date last, ties in reverse order of paths."""
    return [F.desc_nulls_last("committed_ts"), F.desc("name")]


def by_links() -> list[Column]:
    return [F.desc("backlinks"), F.desc("name")]


def positions(rows: DataFrame, order: list[Column], column: str = "row") -> DataFrame:
    """Position of each row from 1 in the order, without a global window."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    once = written(rows, "rows")  # bounds of the ranges are sampled, which reads the rows twice
    placed = written(once.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()), "order")
    # an id is the partition's number above 33 bits and the row's place in the partition below
    part, place = F.shiftright("__id", 33), F.col("__id").bitwiseAND((1 << 33) - 1)
    sizes = {r["p"]: r["n"] for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    offset, total = [], 0
    for p in sorted(sizes):
        offset.append((p, total))
        total += sizes[p]
    offsets = rows.sparkSession.createDataFrame(offset or [(0, 0)], "__part bigint, __offset bigint")
    return placed.withColumn("__part", part).join(F.broadcast(offsets), "__part").withColumn(column, F.col("__offset") + place + 1).drop("__part", "__offset", "__id")


def pages(placed: DataFrame, size: int | None, column: str = "row") -> DataFrame:
    """Page of each row; without a size all are on page 1."""
    if size is not None and size < 1:
        raise ValueError("a page holds at least one row")
    page = F.lit(1).cast("bigint") if size is None else F.floor((F.col(column) - 1) / size) + 1
    return placed.withColumn("page", page)


def page_name(n: Column) -> Column:
    return F.when(n == 1, F.lit("./")).otherwise(F.concat(F.lit("./"), n.cast("string"), F.lit(".html")))


def pointers(paged: DataFrame) -> DataFrame:
    """(page, current, prev, next) of each page; one row a page."""
    last = paged.agg(F.max("page").alias("last")).collect()[0]["last"]
    per = paged.select("page").distinct().withColumn("last", F.lit(last).cast("bigint"))
    p = F.col("page")
    return per.select("page", page_name(p).alias("current"), F.when(p > 1, page_name(p - 1)).alias("prev"), F.when(p < F.col("last"), page_name(p + 1)).alias("next"))


def rendered(text: Column | str, base: str) -> Column:
    """HTML of a note's text, embeds left as they are written."""

    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        r = Renderer(base)
        return s.map(lambda t: r.render(t or ""))

    return run(X.col(text))


def search_index(notes: DataFrame, base: str) -> DataFrame:
    """One JSON object a note: its display name and its URL."""
    rows = notes.select(F.col("name").alias("title"), X.note_href(base, "ctx", "title").alias("url"))
    return rows.select("title", "url", X.json_row("title", "url").alias("json"))


def page_count(notes: DataFrame, tags: DataFrame, size: int | None) -> DataFrame:
    """Number of files a build writes: index pages, notes, the tag index, tags."""
    n, t = notes.count(), tags.count()
    index = (0 if not n else 1) if size is None else -(-n // size)
    return notes.sparkSession.createDataFrame([(index, n, t, index + n + 1 + t)], "index_pages bigint, notes bigint, tags bigint, files bigint")
