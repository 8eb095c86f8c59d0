"""A wiki as DataFrames: the API behind the command line.

    w = Wiki.from_folder(spark, "/path/to/notes")
    w.backlinks("Home").show()
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from notegrid.functions import expr as X
from notegrid.functions.markdown import heading_slug
from notegrid.operators import extract, graph, lint, search, site, tags
from notegrid.plans.scratch import drop, written
from notegrid.sources import commits, markdown_files
from notegrid.sources.config import Config

FIELDS = ("title", "ctx", "body", "headings", "code_blocks", "images", "links", "tags")
#: Fields of the command line and the read tools; ``Wiki.get`` knows those above.
PUBLIC_FIELDS = ("title", "ctx", "body", "headings", "code_blocks")
DEFAULT_FIELDS = ("title", "ctx", "body")


class UnknownField(ValueError):
    pass


class SectionNotFound(LookupError):
    pass


def parse_fields(text: str | None, allowed: tuple[str, ...] = FIELDS) -> list[str]:
    """Comma list of fields; blanks are ignored, repeats collapse, an unknown one is an error."""
    names = list(dict.fromkeys(x.strip() for x in (text or "").split(",") if x.strip())) or list(DEFAULT_FIELDS)
    if bad := [n for n in names if n not in allowed]:
        raise UnknownField(", ".join(bad))
    return names


class Wiki:
    def __init__(self, notes: DataFrame, config: Config | None = None) -> None:
        """``notes``: title, ctx, md_text and, where known, committed_ts and is_readme."""
        for name, kind in (("committed_ts", "bigint"), ("is_readme", "boolean")):
            if name not in notes.columns:
                notes = notes.withColumn(name, F.lit(None).cast(kind))
        self.notes, self.config = extract.with_key(notes), config or Config()

    @classmethod
    def from_folder(cls, spark: SparkSession, folder: str, config: Config | None = None, git: bool = False) -> Wiki:
        config = config or Config()
        rows = markdown_files.read_notes(spark, folder, ("static", config.output_dir))
        return cls(commits.with_commits(spark, rows, folder) if git else rows, config)

    @cached_property
    def parsed(self) -> DataFrame:
        """What the scan finds, written once for all queries."""
        return written(extract.parse(self.notes, spans=True), "parsed")

    @cached_property
    def edges(self) -> DataFrame:
        return written(graph.edges(self.parsed), "edges")

    @cached_property
    def note_tags(self) -> DataFrame:
        return extract.note_tags(self.parsed)

    def get(self, title: str, ctx: list[str] | None = None, fields: str | None = None, heading: str | None = None, allowed: tuple[str, ...] = FIELDS) -> DataFrame:
        """One row with the asked fields; ``heading``, as it is shown or as a slug, narrows body, headings, code blocks and images to a section."""
        names = parse_fields(fields, allowed)
        one = graph.require(self.notes, title, ctx)
        if heading is not None:
            one = one.withColumn("md_text", extract.section_of("md_text", F.lit(heading_slug(heading))))
            if one.where("md_text is not null").isEmpty():
                raise SectionNotFound(heading)
        row = one.withColumn("body", F.col("md_text"))
        if set(names) & {"headings", "code_blocks", "images", "links", "tags"}:
            p = extract.parse(one).withColumnRenamed("code", "code_blocks")
            kind = lambda k: F.filter("refs", lambda x: x["kind"] == k)
            p = p.withColumn("headings", F.transform("headings", lambda h: F.struct(*[h[k].alias(k) for k in ("level", "text", "line", "parent")])))
            p = p.withColumns({"links": kind("link"), "tags": F.array_distinct(F.transform(kind("tag"), lambda x: F.array_join(F.concat(x["ctx"], F.array(x["title"])), "/")))})
            row = row.join(p, "key")
        return row.select(*names)

    def links(self, title: str, ctx: list[str] | None = None) -> DataFrame:
        return graph.links_of(self.notes, self.parsed, graph.require(self.notes, title, ctx))

    def backlinks(self, title: str, ctx: list[str] | None = None) -> DataFrame:
        return graph.backlinks_of(self.notes, self.edges, graph.require(self.notes, title, ctx)).select("title", "ctx").orderBy("title")

    def backlink_counts(self) -> DataFrame:
        return graph.backlink_counts(self.notes, self.edges)

    def tags(self) -> DataFrame:
        return tags.for_listing(tags.counts(self.note_tags)).select("title", F.col("n").alias("backlinks_count"))

    def tags_for_text(self) -> DataFrame:
        """Tags in the order of the text listing: ties by the tag, last first."""
        return tags.for_text(tags.counts(self.note_tags)).select("title", F.col("n").alias("backlinks_count"))

    def tag_backlinks(self, tag: str) -> DataFrame:
        keys = tags.members_of(self.note_tags, tag.split("/"))
        return self.notes.join(keys, "key", "left_semi").select("title", "ctx").orderBy("title")

    def search(self, query: str, num: int = 100, logic: str = "or") -> DataFrame:
        rows = self.notes.withColumn("text", search.search_text())
        return search.search(rows, query, logic, num, order="name").select("title", "ctx")

    def todo(self, status: str = "open") -> DataFrame:
        rows = extract.tasks(self.parsed, status).join(self.notes.select("key", "title", "ctx"), "key")
        return rows.orderBy(*extract.task_order()).select("title", "ctx", "status", "text", "line")

    def lint(self, rules: list[str] | str | None = None, now: int | None = None) -> DataFrame:
        days = self.config.stale_days or lint.STALE_DAYS
        now = now if self.config.stale_days or rules else None
        return lint.lint(lint.Wiki(self.notes, lambda: self.parsed, lambda: self.edges, now, days), rules)

    def site_notes(self) -> DataFrame:
        """Notes that become pages: all but the root README."""
        return self.notes.where(~F.coalesce(F.col("is_readme"), F.lit(False)))

    def index(self) -> DataFrame:
        """Notes in index order with row and page."""
        rows = self.site_notes().join(self.backlink_counts().select("key", "backlinks"), "key")
        order = site.by_links() if self.config.sort_key == "linked_count" else site.by_date()
        return site.pages(site.positions(rows.select("key", "name", "title", "ctx", "committed_ts", "backlinks"), order), self.config.paginate_by)

    def search_index(self) -> DataFrame:
        return site.search_index(self.site_notes(), self.config.base_url)

    def close(self) -> None:
        """Delete the tables written for this wiki; its results can't be read any more."""
        for name in ("parsed", "edges"):
            if name in self.__dict__:
                drop(self.__dict__.pop(name))
        self.__dict__.pop("note_tags", None)

    def __enter__(self) -> Wiki:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    @staticmethod
    def json_lines(rows: DataFrame) -> DataFrame:
        """One JSON object a row in the order of the rows; nulls are kept."""
        return rows.select(X.json_row(*rows.columns).alias("json"))

    def results_json(self, rows: DataFrame) -> DataFrame:
        """One JSON object {results, count} of a result that fits one row; nulls are kept. The command line writes larger ones row by row."""
        return X.envelope(rows)
