"""Tags with their ancestors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from notegrid.functions import expr as X


def by_title() -> list[Column]:
    """Order on pages."""
    return [F.desc("n"), F.asc("title")]


def by_segments() -> list[Column]:
    """Order of the listing."""
    return [F.desc("n"), F.asc("tag")]


def by_segments_last() -> list[Column]:
    """Order of the listing as text."""
    return [F.desc("n"), F.desc("tag")]


def members(note_tags: DataFrame) -> DataFrame:
    """Distinct (tag, key): a note belongs to its tags and all their ancestors, once each."""
    return note_tags.select("key", F.explode(X.tag_prefixes("tag")).alias("tag")).distinct()


def tag_set(note_tags: DataFrame) -> DataFrame:
    return members(note_tags).select("tag").distinct()


def counts(note_tags: DataFrame) -> DataFrame:
    """(tag, title, n) of every tag and ancestor."""
    return members(note_tags).groupBy("tag").agg(F.count("*").alias("n")).withColumn("title", X.tag_display("tag"))


def for_pages(counted: DataFrame) -> DataFrame:
    return counted.orderBy(*by_title())


def for_listing(counted: DataFrame) -> DataFrame:
    return counted.orderBy(*by_segments())


def for_text(counted: DataFrame) -> DataFrame:
    return counted.orderBy(*by_segments_last())


def top(counted: DataFrame, k: int = 15) -> DataFrame:
    return for_pages(counted).limit(k)


def members_of(note_tags: DataFrame, tag: list[str]) -> DataFrame:
    """Notes of one tag; an unknown tag has none."""
    return members(note_tags).where(F.col("tag") == F.array(*map(F.lit, tag))).select("key")
