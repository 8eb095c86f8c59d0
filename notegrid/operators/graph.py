"""Links, backlinks and embeds as joins on note keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from notegrid.operators import extract
from notegrid.plans.scratch import written


class NoteNotFound(LookupError):
    """No note has the asked title and context."""


def edges(parsed: DataFrame) -> DataFrame:
    """Distinct (src, dst) of plain links, how often each is written and, where the scan looked for it, where it first begins; embeds are no edges."""
    rows = extract.refs(parsed, "link").select(F.col("key").alias("src"), "dst", "dst_name", "span")
    return rows.groupBy("src", "dst", "dst_name").agg(F.count("*").alias("n"), F.min("span").alias("span"))


def lookup(notes: DataFrame, title: str, ctx: list[str] | None = None) -> DataFrame:
    """The note of exactly this title and context; the title isn't split at slashes, and an empty context names none."""
    here = F.col("ctx").eqNullSafe(F.array(*map(F.lit, ctx)).cast("array<string>") if ctx is not None else F.lit(None).cast("array<string>"))
    if ctx is None:
        here = F.col("ctx").isNull() | (F.size("ctx") == 0)
    elif not ctx:
        here = F.lit(False)
    return notes.where((F.col("title") == title) & here)


def require(notes: DataFrame, title: str, ctx: list[str] | None = None) -> DataFrame:
    found = lookup(notes, title, ctx)
    if found.isEmpty():
        raise NoteNotFound("/".join([*(ctx or []), title]))
    return found


def links_of(notes: DataFrame, parsed: DataFrame, note: DataFrame) -> DataFrame:
    """Resolved links and embeds of one note in source order, repeats and headings kept."""
    rows = extract.refs(parsed.join(note.select("key"), "key", "left_semi"), "link", "embed")
    target = notes.select(F.col("key").alias("dst"), F.col("name").alias("target")).distinct()
    return rows.join(target, "dst").select("pos", "kind", "target", "heading").orderBy("pos")


def backlinks_of(notes: DataFrame, edge: DataFrame, note: DataFrame) -> DataFrame:
    """Notes that link to one note, itself included."""
    src = edge.join(note.select(F.col("key").alias("dst")), "dst", "left_semi").select(F.col("src").alias("key"))
    return notes.join(src, "key", "left_semi")


def backlink_counts(notes: DataFrame, edge: DataFrame) -> DataFrame:
    """(key, name, backlinks) of every note."""
    n = edge.groupBy(F.col("dst").alias("key")).agg(F.count("*").alias("n"))
    return notes.join(n, "key", "left").select("key", "name", F.coalesce("n", F.lit(0)).cast("bigint").alias("backlinks"))


def embed_edges(notes: DataFrame, parsed: DataFrame) -> DataFrame:
    """Distinct resolved (src, dst) of embeds."""
    rows = extract.refs(parsed, "embed").select(F.col("key").alias("src"), "dst").distinct()
    return rows.join(notes.select(F.col("key").alias("dst")).distinct(), "dst", "left_semi")


def closure(pairs: DataFrame) -> DataFrame:
    """Distinct (root, reached) over one or more steps; cycles end as no pair comes twice.

    Semi-naive: each round joins only the pairs that are new to all found so far, which doubles the depth, until none is
    new; it keeps keys, not texts."""
    step = written(pairs.select(F.col("src"), F.col("dst")).distinct(), "step")
    fresh = step.select(F.col("src").alias("root"), F.col("dst").alias("reached"))
    found = fresh
    while True:
        on = fresh.join(found.select(F.col("root").alias("src"), F.col("reached").alias("dst")), F.col("reached") == F.col("src")).select("root", F.col("dst").alias("reached")).distinct()
        fresh = written(on.join(found, ["root", "reached"], "left_anti"), "fresh")
        if fresh.isEmpty():
            return found
        found = found.unionByName(fresh)
