"""References to records that do not exist, in general form.

Parent keys and child references become one long table of tagged rows, grouped
by parent table and key. A group without a parent flag is an orphan; its
references are summed by period. Where a parent exists only at times, its
lifetimes are merged to disjoint spans first, so a hot key keeps few of them,
and children of keys with a parent are held against the spans.

Nulls: a null key matches only a null key, a null period is reported as null,
a reference without a time is an orphan where a time is asked for, a lifetime
without a begin never counts, one without an end is open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def tagged(parent: str, rows: DataFrame, key: Column, is_parent: bool, period: Column | None = None) -> DataFrame:
    """Rows of one table in the long form (parent, key, is_parent, period)."""
    when = period if period is not None else F.lit(None).cast("string")
    return rows.select(F.lit(parent).alias("parent"), key.alias("key"), F.lit(int(is_parent)).alias("is_parent"), when.alias("period"))


def orphan_keys(long: DataFrame) -> DataFrame:
    """(parent, key) of the groups that lack a parent flag."""
    return long.groupBy("parent", "key").agg(F.max("is_parent").alias("has")).where("has = 0").select("parent", "key")


def orphan_report(long: DataFrame) -> DataFrame:
    """(parent, period, orphans, keys): references to missing keys by parent table and period.

    Keys are counted per period first (combined before the shuffle), so a hot key is one row a period."""
    counts = long.groupBy("parent", "key", "period").agg(F.max("is_parent").alias("has"), F.sum(F.lit(1) - F.col("is_parent")).alias("n"))
    groups = counts.groupBy("parent", "key").agg(F.max("has").alias("has"), F.collect_list(F.when(F.col("has") == 0, F.struct("period", "n"))).alias("x")).where("has = 0")
    return groups.select("parent", F.explode("x").alias("x")).groupBy("parent", F.col("x.period").alias("period")).agg(F.sum("x.n").alias("orphans"), F.count("*").alias("keys"))


def spans(parents: DataFrame, key: str = "key", begin: str = "begin", end: str = "end") -> DataFrame:
    """Disjoint lifetimes (key, begin, end) of each key; an open end stays null."""
    far = F.lit("9999-12-31 00:00:00").cast("timestamp_ntz")
    rows = parents.where(F.col(begin).isNotNull()).select(F.col(key).alias("key"), F.col(begin).cast("timestamp_ntz").alias("b"), F.coalesce(F.col(end).cast("timestamp_ntz"), far).alias("e")).where("e > b")
    rows = rows.groupBy("key", "e").agg(F.min("b").alias("b"))  # equal ends: the earliest begin covers the rest
    along = W.partitionBy("key").orderBy("b", "e")
    before = F.max("e").over(along.rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("new", (before.isNull() | (F.col("b") > before)).cast("int"))
    rows = rows.withColumn("part", F.sum("new").over(along))
    merged = rows.groupBy("key", "part").agg(F.min("b").alias("begin"), F.max("e").alias("end"))
    return merged.select("key", "begin", F.when(F.col("end") < far, F.col("end")).alias("end"))


def missing_at(children: DataFrame, parents: DataFrame, at: str) -> DataFrame:
    """Children (key, ``at``, ...) for which no parent (key, begin, end) is alive at their time.

    Parents' spans and children are united and grouped by key (children combine before the shuffle), so a group holds
    its few disjoint spans and whether there is a parent at all. Children of a group without one are orphans; the others
    are held against its spans, in a join that adaptive execution splits where a key is hot."""
    alive = spans(parents).select("key", F.struct("begin", "end").alias("span"))
    long = tagged("p", children, F.col("key"), False).withColumn("span", F.lit(None).cast(alive.schema["span"].dataType))
    long = long.unionByName(alive.select(F.lit("p").alias("parent"), "key", F.lit(1).alias("is_parent"), F.lit(None).cast("string").alias("period"), "span"))
    groups = long.groupBy("key").agg(F.max("is_parent").alias("has"), F.collect_list("span").alias("spans"))
    when = F.col(at).cast("timestamp_ntz")
    here = F.exists("spans", lambda s: (s["begin"] <= when) & (s["end"].isNull() | (s["end"] > when)))
    groups = groups.withColumnRenamed("key", "own")
    return children.join(groups, F.col("key").eqNullSafe(F.col("own"))).where((F.col("has") == 0) | when.isNull() | ~F.coalesce(here, F.lit(False))).drop("has", "spans", "own")
