"""Orphan references of a wiki: link lists and link occurrences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from notegrid.operators import orphans
from notegrid.operators.orphans import orphan_keys, orphan_report, tagged


def display_key(ctx: Column, title: Column) -> Column:
    return F.concat_ws("/", ctx, title)


def exact_key(ctx: Column, title: Column) -> Column:
    """Key of context and title that keeps their border; a missing context equals an empty one."""
    return F.to_json(F.struct(F.coalesce(ctx, F.array().cast("array<string>")).alias("c"), F.coalesce(title, F.lit("")).alias("t")))


def plain_words(text: Column) -> Column:
    """The words of a heading, lower-cased, by single spaces."""
    return F.trim(F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " ")))


def month(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def link_entries(notes: DataFrame) -> DataFrame:
    return notes.select("note_id", month(F.col("created_at")).alias("period"), F.explode(F.array_distinct("links")).alias("key")).where("key is not null")


def link_long(notes: DataFrame) -> DataFrame:
    own = tagged("notes", notes, display_key(F.col("ctx"), F.col("title")), True)
    return own.unionByName(tagged("notes", link_entries(notes), F.col("key"), False, F.col("period")))


def missing_links(notes: DataFrame) -> DataFrame:
    """Entries of ``links`` that are the display key of no note."""
    gone = orphan_keys(link_long(notes)).select("key")
    rows = link_entries(notes).join(gone, "key", "left_semi")
    return rows.select(F.lit("links").alias("src"), "period", F.col("note_id").alias("row_id"), F.col("key").alias("target"))


def ref_rows(refs: DataFrame) -> DataFrame:
    return refs.select(
        "ref_id", "seen_at", month(F.col("seen_at")).alias("period"), exact_key(F.col("ctx_path"), F.col("title")).alias("key"),
        display_key(F.col("ctx_path"), F.col("title")).alias("target"), plain_words(F.col("heading")).alias("words"))


def missing_refs(notes: DataFrame, refs: DataFrame, headings: DataFrame) -> DataFrame:
    """Rows of the link table whose note wasn't there when they were seen, or whose heading is in no note of that key."""
    rows = ref_rows(refs)
    key = exact_key(F.col("ctx"), F.col("title"))
    parents = notes.select(key.alias("key"), F.col("created_at").alias("begin"), F.col("deleted_at").alias("end"))
    gone = orphans.missing_at(rows, parents, "seen_at").select("period", "ref_id", "target")
    known = headings.select("note_id", plain_words(F.col("text")).alias("words")).distinct().join(notes.select("note_id", key.alias("key")).distinct(), "note_id")
    asked = rows.where("words is not null")
    pair = F.concat_ws("\n", "key", "words")
    long = tagged("headings", known, pair, True).unionByName(tagged("headings", asked, pair, False))
    unknown = orphan_keys(long).select(F.col("key").alias("pair"))
    lost = asked.withColumn("pair", pair).join(unknown, "pair", "left_semi").select("period", "ref_id", "target")
    return gone.unionByName(lost).select(F.lit("refs").alias("src"), "period", F.col("ref_id").alias("row_id"), "target").distinct()


def missing(notes: DataFrame, refs: DataFrame, headings: DataFrame) -> DataFrame:
    """(src, period, row_id, target) of all orphan references, distinct."""
    return missing_links(notes).distinct().unionByName(missing_refs(notes, refs, headings))


def report(notes: DataFrame, refs: DataFrame, headings: DataFrame) -> DataFrame:
    """(parent, period, orphans, keys): references to keys that no row ever had, by table and month."""
    key = exact_key(F.col("ctx"), F.col("title"))
    rows = ref_rows(refs.dropDuplicates(["ref_id"]))
    pair = F.concat_ws("\n", "key", "words")
    known = headings.select("note_id", plain_words(F.col("text")).alias("words")).distinct().join(notes.select("note_id", key.alias("key")).distinct(), "note_id")
    long = (
        link_long(notes)
        .unionByName(tagged("refs", notes, key, True)).unionByName(tagged("refs", rows, F.col("key"), False, F.col("period")))
        .unionByName(tagged("headings", known, pair, True)).unionByName(tagged("headings", rows.where("words is not null"), pair, False, F.col("period")))
    )
    return orphan_report(long)
