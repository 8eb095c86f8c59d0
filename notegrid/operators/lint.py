"""Health checks of the graph: each rule is a DataFrame (rule, path, message, span_begin, span_end).

Spans are byte offsets of the first literal link in the text, null where there is
none; the scan finds them, so no text is joined. A key that several notes have
counts once in rules about links.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, functions as F

from notegrid.functions import expr as X
from notegrid.operators import extract

DEFAULT_RULES = ("dead-end", "lonely", "self-link", "overlinking", "broken-link", "broken-heading-ref")
RULES = (*DEFAULT_RULES, "stale-by-git")
STALE_DAYS = 180


class Wiki:
    """What the rules read: notes with key and name, a call for the parsed table (links, headings, spans) and one for the
    edges, made when a rule first needs them; None for ``now`` skips staleness."""

    def __init__(self, notes: DataFrame, parsed: Callable[[], DataFrame], edges: Callable[[], DataFrame], now: int | None = None, days: int = STALE_DAYS) -> None:
        self.notes, self._parsed, self._edges, self.now, self.days = notes, parsed, edges, now, days

    @cached_property
    def parsed(self) -> DataFrame:
        return self._parsed()

    @cached_property
    def edges(self) -> DataFrame:
        return self._edges()


def path_of_key(key: Column | str) -> Column:
    return F.concat(F.replace(X.col(key), F.lit("\u0001"), F.lit("/")), F.lit(".md"))


def _warnings(rows: DataFrame, rule: str, message: Column, path: Column | None = None, link: Column | None = None, span: str = "span") -> DataFrame:
    begin = F.col(span) if link is not None else F.lit(None)
    end = begin + F.octet_length(link) if link is not None else F.lit(None)
    path = X.note_path("ctx", "title") if path is None else path
    return rows.select(F.lit(rule).alias("rule"), path.alias("path"), message.alias("message"), begin.cast("int").alias("span_begin"), end.cast("int").alias("span_end"))


def _link(*more: Column) -> Column:
    return F.concat(F.lit("[["), "dst_name", *more, F.lit("]]"))


def dead_end(w: Wiki) -> DataFrame:
    rows = w.notes.join(w.edges.select(F.col("src").alias("key")), "key", "left_anti")
    return _warnings(rows, "dead-end", F.lit("note has no links to other notes"))


def lonely(w: Wiki) -> DataFrame:
    rows = w.notes.join(w.edges.select(F.col("dst").alias("key")), "key", "left_anti")
    return _warnings(rows, "lonely", F.lit("note is not linked from any other note"))


def self_link(w: Wiki) -> DataFrame:
    return _warnings(w.edges.where("src = dst"), "self-link", F.lit("note links to itself"), path_of_key("src"), _link())


def overlinking(w: Wiki) -> DataFrame:
    message = F.concat(F.lit("link "), _link(), F.lit(" appears "), F.col("n").cast("string"), F.lit(" times"))
    return _warnings(w.edges.where("n > 1"), "overlinking", message, path_of_key("src"), _link())


def broken_link(w: Wiki) -> DataFrame:
    gone = w.edges.join(w.notes.select(F.col("key").alias("dst")), "dst", "left_anti")
    return _warnings(gone, "broken-link", F.concat(F.lit("broken wikilink: "), _link()), path_of_key("src"), _link())


def broken_heading_ref(w: Wiki) -> DataFrame:
    """One row an occurrence; a missing note is silent here. A note's headings are one row, so one join tells both whether it is there and what it holds."""
    asked = extract.refs(w.parsed, "link").where("heading is not null").withColumn("slug", X.slug_dash("heading")).where("slug <> ''")
    known = w.parsed.groupBy(F.col("key").alias("dst")).agg(F.flatten(F.collect_list(F.transform("headings", lambda h: X.slug_dash(h["text"])))).alias("slugs"))
    lost = asked.join(known, "dst").where(~F.array_contains("slugs", F.col("slug")))
    link = _link(F.lit("#"), F.col("heading"))
    message = F.concat(F.lit("broken heading reference: "), link, F.lit(" (heading not found in target note)"))
    return _warnings(lost, "broken-heading-ref", message, path_of_key("key"), link, "head_span")


def stale(w: Wiki) -> DataFrame:
    """Notes last committed more than ``days`` before ``now``; never committed ones are left out."""
    age = (F.lit(w.now) - F.col("committed_ts")) / 86400
    rows = w.notes.where(F.lit(False)) if w.now is None else w.notes.where(F.col("committed_ts") < w.now - w.days * 86400)
    return _warnings(rows, "stale-by-git", F.concat(F.lit("note not updated in "), F.floor(age).cast("string"), F.lit(" days")))


_BY_NAME = dict(zip(RULES, (dead_end, lonely, self_link, overlinking, broken_link, broken_heading_ref, stale)))


def lint(w: Wiki, rules: list[str] | str | None = None) -> DataFrame:
    """Union of the asked rules; none asked: the default ones, and staleness where ``now`` is set."""
    if rules == "all":
        names = list(RULES)
    elif rules:
        names = [r for r in RULES if r in rules]
        if unknown := set(rules) - set(RULES):
            raise ValueError(f"unknown rule: {', '.join(sorted(unknown))}")
    else:
        names = [*DEFAULT_RULES, *(["stale-by-git"] if w.now is not None else [])]
    return reduce(DataFrame.unionByName, [_BY_NAME[r](w) for r in names])

