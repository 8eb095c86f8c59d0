"""Extraction of typed rows from Markdown: one Arrow-batched scan, then ordinary DataFrames.

``parse`` is the only Python in the engine's hot path. It looks for what is
wanted only: notes and paragraphs that can't hold it aren't scanned, the former
don't leave the JVM. Child tables are explodes of its arrays; write the parsed
table (``plans.scratch.written``) before using more than one of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from notegrid.functions import expr as X
from notegrid.functions.markdown import Parsed, scan, section

_REF = ("kind", "ctx", "title", "heading", "alias", "line", "span", "head_span")
_HEAD = ("level", "text", "line", "parent", "root")
_CODE = ("lang", "content", "line")
_TASK = ("status", "text", "line")
SCHEMA = (
    "key string, refs array<struct<kind:string,ctx:array<string>,title:string,heading:string,alias:string,line:int,span:int,head_span:int>>, "
    "headings array<struct<level:int,text:string,line:int,parent:string,root:boolean>>, "
    "code array<struct<lang:string,content:string,line:int>>, tasks array<struct<status:string,text:string,line:int>>, images array<string>"
)


_REF_TYPES = (pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32())
_HEAD_TYPES = (pa.int32(), pa.string(), pa.int32(), pa.string(), pa.bool_())
_CODE_TYPES = (pa.string(), pa.string(), pa.int32())
_TASK_TYPES = (pa.string(), pa.string(), pa.int32())


def _structs(rows: list[list[tuple]], names: tuple, types: tuple) -> pa.Array:
    """A list of structs per note, built column by column."""
    offsets = [0, *accumulate(map(len, rows))]
    columns = list(zip(*(x for r in rows for x in r))) or [()] * len(names)
    flat = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=list(names))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)


#: What can be wanted: what the scanner then looks for, and what a note must hold.
_PARTS = {
    "links": ("refs", lambda t: F.contains(t, F.lit("[["))), "tags": ("refs", lambda t: F.contains(t, F.lit("#[["))), "embeds": ("refs", lambda t: F.contains(t, F.lit("![["))),
    "headings": ("headings", lambda t: t.rlike("[#=-]")), "code": ("code", lambda t: F.contains(t, F.lit("```")) | F.contains(t, F.lit("~~~"))),
    "tasks": ("tasks", lambda t: t.rlike(r"\[[ xX-]\]")), "images": ("images", lambda t: F.contains(t, F.lit("!["))),
}
ALL = tuple(_PARTS)


def _spans(text: str, refs: list[tuple]) -> list[tuple]:
    """References with the byte offsets of the first literal [[target]] and [[target#heading]] of a link."""
    seen: dict[str, int | None] = {}

    def first(link: str) -> int | None:
        if link not in seen:
            at = text.find(link)
            seen[link] = None if at < 0 else at if text.isascii() else len(text[:at].encode("utf-8", "surrogatepass"))
        return seen[link]

    out = []
    for r in refs:
        name = "/".join([*r[1], r[2]])
        out.append((*r, first(f"[[{name}]]"), first(f"[[{name}#{r[3]}]]") if r[3] else None) if r[0] == "link" else (*r, None, None))
    return out


def _parser(wanted: frozenset[str], needle: str, spans: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("md_text").to_pylist()
            p: list[Parsed] = [scan(t, wanted, needle) for t in texts]
            refs = [_spans(t, x.refs) if spans and x.refs else [(*r, None, None) for r in x.refs] for t, x in zip(texts, p)]
            kept = [c for c in batch.schema.names if c != "md_text"]
            yield pa.RecordBatch.from_arrays(
                [
                    *map(batch.column, kept), _structs(refs, _REF, _REF_TYPES), _structs([x.headings for x in p], _HEAD, _HEAD_TYPES),
                    _structs([x.code for x in p], _CODE, _CODE_TYPES), _structs([x.tasks for x in p], _TASK, _TASK_TYPES), pa.array([x.images for x in p], pa.list_(pa.string())),
                ],
                names=[*kept, "refs", "headings", "code", "tasks", "images"],
            )

    return run


def with_key(notes: DataFrame) -> DataFrame:
    """Notes (title, ctx, md_text, ...) with ``key`` for joins and ``name`` for display."""
    return notes.withColumns({"key": X.key_id("ctx", "title"), "name": X.key_display("ctx", "title")})


def parse(notes: DataFrame, *wanted: str, keep: tuple[str, ...] = (), spans: bool = False) -> DataFrame:
    """One row a note: its key, columns to ``keep`` and all that is extracted from ``md_text``.

    With parts of ``ALL`` wanted, only these are extracted, and notes that can't hold any have no row unless columns are
    kept. ``spans`` adds where the literal link of a reference begins."""
    parts = wanted or ALL
    rows = notes
    if wanted and not keep:
        rows = notes.where(reduce(Column.__or__, [_PARTS[x][1](F.col("md_text")) for x in wanted]))
    kinds = set(parts) & {"links", "tags", "embeds"}
    needle = {("tags",): "#[[", ("embeds",): "![["}.get(tuple(kinds), "[[")
    rows = rows.select("key", *keep, "md_text")
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keep)
    schema = SCHEMA.replace("key string, ", f"key string, {kept}, " if kept else "key string, ", 1)
    return rows.mapInArrow(_parser(frozenset(_PARTS[x][0] for x in parts), needle, spans), schema)


def refs(parsed: DataFrame, *kinds: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Wiki references in source order; ``pos`` counts from 0 among all kinds scanned for, ``dst`` is the key they name."""
    rows = parsed.select("key", *keep, F.posexplode("refs").alias("pos", "x")).select("key", *keep, "pos", "x.*")
    rows = rows.where(F.col("kind").isin(*kinds)) if kinds else rows
    return rows.withColumns({"dst": X.key_id("ctx", "title"), "dst_name": X.key_display("ctx", "title")})


def headings(parsed: DataFrame) -> DataFrame:
    return parsed.select("key", F.posexplode("headings").alias("pos", "x")).select("key", "pos", "x.*").withColumn("slug", X.slug_heading("text"))


def code_blocks(parsed: DataFrame) -> DataFrame:
    return parsed.select("key", F.posexplode("code").alias("pos", "x")).select("key", "pos", "x.*")


def tasks(parsed: DataFrame, status: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Tasks; ``status`` open, done, deferred, or all (None)."""
    if status not in (None, "all", "open", "done", "deferred"):
        raise ValueError(f"unknown status {status!r}")
    rows = parsed.select("key", *keep, F.posexplode("tasks").alias("pos", "x")).select("key", *keep, "pos", "x.*")
    return rows if status in (None, "all") else rows.where(F.col("status") == status)


def task_order() -> list[Column]:
    """By context as it is shown, title and line."""
    return [F.coalesce(F.array_join("ctx", "/"), F.lit("")), F.col("title"), F.col("line")]


def images(parsed: DataFrame) -> DataFrame:
    return parsed.select("key", F.posexplode("images").alias("pos", "url"))


def thumbnails(parsed: DataFrame) -> DataFrame:
    return parsed.select("key", F.get("images", F.lit(0)).alias("thumbnail")).where("thumbnail is not null")


def note_tags(parsed: DataFrame) -> DataFrame:
    """Distinct tags of each note with their first position."""
    rows = refs(parsed, "tag").withColumn("tag", F.concat("ctx", F.array("title")))
    return rows.groupBy("key", "tag").agg(F.min("pos").alias("pos"))


@F.pandas_udf(T.StringType())
def section_text(text: pd.Series, slug: pd.Series) -> pd.Series:
    return pd.Series([section(t, s) for t, s in zip(text, slug)], dtype=object)


def section_of(text: Column | str, slug: Column | str) -> Column:
    """Body below the first top-level heading with the slug; null if there is none."""
    return section_text(text, slug)
