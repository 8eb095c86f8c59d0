"""The static site as rows (rel_path, html) and their writer.

A page of many rows is several pages: backlinks and members of a tag are dealt to
pages of about ``PER_PAGE`` by hash, so no hub is collected in one row. Files that
hold a row of every note (the search index, the list of pages, an index without a
page size) are written in parts by the executors and put together as files.
"""

from __future__ import annotations

import os
import shutil
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from notegrid.functions import expr as X
from notegrid.functions.html import Renderer, escape
from notegrid.operators import extract, graph, site, tags
from notegrid.plans.scratch import written
from notegrid.wiki import Wiki

PER_PAGE, TAGS_ON_INDEX = 100, 100
#: Characters of a note's text shown with a backlink that has no thumbnail; None: all.
SUMMARY = 300
MANIFEST = "pages.manifest"  # Spark reads no file whose name begins with a dot
_LIGHT, _DARK = "body { color: #222; background: #fff }\n", "body { color: #ddd; background: #181818 }\na { color: #8ab4f8 }\n"
_BASE = "body { max-width: 46rem; margin: 2rem auto; font-family: sans-serif; line-height: 1.5 }\n"
_SCHEMA = "rel_path string, html string"


#: Search of titles in the browser: from three characters on, the five best of the index by where the text begins.
SEARCH = """<input id="search" placeholder="Search"><ul id="found"></ul><script>
const box = document.getElementById("search"), found = document.getElementById("found");
const titles = fetch("search_index.json").then((r) => r.json());
box.addEventListener("input", async () => {
  const q = box.value.trim().toLowerCase();
  const hits = q.length < 3 ? [] : (await titles).map((x) => [x.title.toLowerCase().indexOf(q), x]).filter((x) => x[0] >= 0);
  found.replaceChildren(...hits.sort((a, b) => a[0] - b[0]).slice(0, 5).map(([, x]) => {
    const item = document.createElement("li"), link = item.appendChild(document.createElement("a"));
    [link.href, link.textContent] = [x.url, x.title];
    return item;
  }));
});
</script>"""


def style(scheme: str) -> str:
    """The style sheet of a colour scheme: os_setting, only_light or only_dark."""
    return _BASE + {"only_light": _LIGHT, "only_dark": _DARK}.get(scheme, f"{_LIGHT}@media (prefers-color-scheme: dark) {{\n{_DARK}}}\n")


def _page(title: str, body: str) -> str:
    return f'<!doctype html><html><head><meta charset="utf-8"><title>{escape(title)}</title><link rel="stylesheet" href="/main.css"></head><body>\n{body}\n</body></html>\n'


def _list(items: list[tuple[str, str]]) -> str:
    return "<ul>" + "".join(f'<li><a href="{u}">{escape(t)}</a></li>' for t, u in items) + "</ul>"


def _backlinks(items) -> str:
    """Entries with the picture of the linking note, or else its text."""
    out = ""
    for x in items:
        more = f'<img src="{escape(x["picture"])}" alt="" loading="lazy">' if x["picture"] else f'<div class="summary">{escape(x["summary"])}</div>'
        out += f'<li><a href="{x["u"]}">{escape(x["n"])}</a>{more}</li>'
    return f'<ul class="backlinks">{out}</ul>'


def _others(base: str, stem: str, ending: str, pages: int, at: int) -> str:
    """Links to the first, the neighbouring and the last page of a long list."""
    if pages < 2:
        return ""
    out = f"<p>{at + 1} / {pages}"
    for name, k in (("first", 0), ("prev", at - 1), ("next", at + 1), ("last", pages - 1)):
        if 0 <= k < pages and k != at:
            out += f' <a rel="{name}" href="{base}{stem}{f".{ending}-{k}" if k else ""}.html">{name}</a>'
    return out + "</p>"


def dealt(rows: DataFrame, key: str, by: str, entry: Column, per_page: int = PER_PAGE) -> DataFrame:
    """(key, page, pages, x): the entries of each key on pages of about ``per_page``, sorted on each; pages count from 0 without gaps."""
    many = rows.groupBy(key).agg(F.ceil(F.count("*") / per_page).cast("int").alias("dealt"))
    placed = rows.join(many, key).withColumn("part", F.pmod(F.xxhash64(by), F.col("dealt")).cast("int"))
    used = placed.where("dealt > 1").select(key, "part").distinct().groupBy(key).agg(F.sort_array(F.collect_list("part")).alias("used"))
    paged = placed.groupBy(key, "part").agg(F.sort_array(F.collect_list(entry)).alias("x")).join(used, key, "left")
    page = F.coalesce(F.array_position("used", F.col("part")).cast("int") - 1, F.lit(0))
    return paged.select(key, page.alias("page"), F.when(F.col("used").isNull(), 1).otherwise(F.size("used")).alias("pages"), "x")


def embedded(w: Wiki) -> DataFrame:
    """(key, texts): of each note that embeds others, the keys and texts of all that it reaches; a page holds them anyway."""
    reach = graph.closure(graph.embed_edges(w.notes, w.parsed)).select(F.col("root"), F.col("reached").alias("key"))
    texts = w.notes.join(reach.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.min(F.coalesce("md_text", F.lit(""))).alias("md_text"))
    return reach.join(texts, "key").groupBy("root").agg(F.collect_list(F.struct("key", "md_text")).alias("texts")).withColumnRenamed("root", "key")


def summaries(w: Wiki, most: int | None = SUMMARY) -> DataFrame:
    """(key, n, u, picture, summary) of each note that links to another: name, URL, thumbnail and the begin of its text without marks."""
    base = w.config.base_url
    rows = w.site_notes().join(w.edges.select(F.col("src").alias("key")), "key", "left_semi").join(extract.thumbnails(w.parsed), "key", "left")
    rows = rows.select("key", F.col("name").alias("n"), X.note_href(base, "ctx", "title").alias("u"), F.col("thumbnail").alias("picture"), "md_text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = Renderer(base)
        for pdf in batches:
            yield pdf.assign(html=[None if p else r.render(t) for p, t in zip(pdf["picture"], pdf["md_text"])]).drop(columns="md_text")

    shown = rows.mapInPandas(run, "key string, n string, u string, picture string, html string")
    text = F.trim(F.regexp_replace(X.strip_tags("html"), r"\s+", " "))
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return shown.select("key", "n", "u", "picture", F.coalesce(text if most is None else F.substring(text, 1, most), F.lit("")).alias("summary"))


def backlink_pages(w: Wiki) -> DataFrame:
    """(key, page, pages, x): what links to each note."""
    back = w.edges.select(F.col("dst").alias("to"), F.col("src").alias("key")).join(summaries(w), "key").withColumnRenamed("key", "from").withColumnRenamed("to", "key")
    return dealt(back, "key", "from", F.struct("n", "u", "picture", "summary"))


def note_pages(w: Wiki) -> DataFrame:
    base = w.config.base_url
    back = written(backlink_pages(w), "backlinks")
    own = w.site_notes().select("key", X.file_stem("ctx", "title").alias("stem"), "title", "md_text")
    rows = own.join(back.where("page = 0").select("key", "x", "pages"), "key", "left").join(embedded(w), "key", "left").select("stem", "title", "md_text", "x", "pages", "texts")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        texts: dict[str, str] = {}
        r = Renderer(base, lambda c, t: texts.get("\u0001".join((*c, t))))
        for pdf in batches:
            out = []
            for stem, title, text, entries, pages, reached in zip(pdf["stem"], pdf["title"], pdf["md_text"], pdf["x"], pdf["pages"], pdf["texts"]):
                texts.clear()
                texts.update((x["key"], x["md_text"]) for x in (reached if reached is not None else ()))
                body = f"<h1>{escape(title)}</h1>\n{r.render(text)}"
                if entries is not None and len(entries):
                    body += "\n<h2>Backlinks</h2>" + _backlinks(entries) + _others(r.base, f"notes/{stem}", "backlinks", int(pages), 0)
                out.append((f"notes/{stem}.html", _page(title, body)))
            yield pd.DataFrame(out, columns=["rel_path", "html"])

    def more(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame(
                [(f"notes/{s}.backlinks-{p}.html", _page(t, f"<h1>{escape(t)}</h1>\n<h2>Backlinks</h2>" + _backlinks(x) + _others(base.rstrip("/") + "/", f"notes/{s}", "backlinks", n, p))) for s, t, p, n, x in zip(pdf["stem"], pdf["title"], pdf["page"], pdf["pages"], pdf["x"])],
                columns=["rel_path", "html"])

    rest = back.where("page > 0").join(own.select("key", "stem", "title"), "key").select("stem", "title", "page", "pages", "x")
    return rows.mapInPandas(run, _SCHEMA).unionByName(rest.mapInPandas(more, _SCHEMA))


def _intro(w: Wiki) -> str:
    base = w.config.base_url
    readme = w.notes.where("is_readme").select("md_text").limit(1).collect()
    top = tags.top(tags.counts(w.note_tags)).select("title", X.tag_href(base, "tag").alias("u")).collect()  # at most 15
    return (SEARCH if w.config.build_search_index else "") + (Renderer(base).render(readme[0]["md_text"]) if readme else "") + _list([(r["title"], r["u"]) for r in top])


def index_rows(w: Wiki) -> DataFrame:
    return w.index().select("page", "row", F.col("name").alias("n"), X.note_href(w.config.base_url, "ctx", "title").alias("u"))


def index_pages(w: Wiki) -> DataFrame:
    """Index pages of a fixed size; without a size the index is one file of all notes, which ``build`` writes in parts."""
    title, intro, rows = w.config.title or "Wiki", _intro(w), index_rows(w)
    paged = rows.groupBy("page").agg(F.sort_array(F.collect_list(F.struct("row", "n", "u"))).alias("x"))
    paged = paged.join(site.pointers(rows.select("page")), "page")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for page, x, before, after in zip(pdf["page"], pdf["x"], pdf["prev"], pdf["next"]):
                body = (intro if page == 1 else "") + _list([(y["n"], y["u"]) for y in x])
                body += "".join(f'<a rel="{k}" href="{u}">{k}</a> ' for k, u in (("prev", before), ("next", after)) if u)
                out.append(("index.html" if page == 1 else f"{page}.html", _page(title, body)))
            yield pd.DataFrame(out, columns=["rel_path", "html"])

    return paged.mapInPandas(run, _SCHEMA)


def tag_pages(w: Wiki) -> DataFrame:
    base = w.config.base_url.rstrip("/") + "/"
    members = tags.members(w.note_tags).join(w.site_notes().select("key", "name", X.note_href(base, "ctx", "title").alias("u")), "key")
    named = members.select(F.struct(X.tag_display("tag").alias("title"), X.tag_slug("tag").alias("slug")).alias("tag"), "key", "name", "u")
    per = dealt(named, "tag", "key", F.struct("name", "u")).select("tag.title", "tag.slug", "page", "pages", "x")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame(
                [(f"tags/{s}{f'.members-{p}' if p else ''}.html", _page(f"#{t}", f"<h1>#{escape(t)}</h1>" + _list([(y["name"], y["u"]) for y in x]) + _others(base, f"tags/{s}", "members", n, p))) for t, s, p, n, x in zip(pdf["title"], pdf["slug"], pdf["page"], pdf["pages"], pdf["x"])],
                columns=["rel_path", "html"])

    return per.mapInPandas(run, _SCHEMA)


def tag_index(w: Wiki, size: int = TAGS_ON_INDEX) -> DataFrame:
    """All tags, most used first, ``size`` on a page, each page but the last with a link to more; the first is there without tags too."""
    base = w.config.base_url.rstrip("/") + "/"
    placed = site.positions(tags.counts(w.note_tags).select("n", "title", X.tag_href(base, "tag").alias("u")), [F.desc("n"), F.col("title")])
    paged = site.pages(placed, size).groupBy("page").agg(F.sort_array(F.collect_list(F.struct("row", "n", "title", "u"))).alias("x"))
    last = F.broadcast(placed.agg(F.ceil(F.max("row") / size).alias("last")))  # one row
    paged = paged.join(last).unionByName(last.where("last is null").select(F.lit(1).cast("bigint").alias("page"), F.array().cast(paged.schema["x"].dataType).alias("x"), F.lit(1).cast("bigint").alias("last")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for page, x, end in zip(pdf["page"], pdf["x"], pdf["last"]):
                body = "<h1>Tags</h1><ul>" + "".join(f'<li><a href="{y["u"]}">{escape(y["title"])}</a> {y["n"]}</li>' for y in x)
                if page < end:
                    body += f'<li><a href="{base}tag-index/{page + 1}.html">More...</a></li>'
                out.append(("tags/index.html" if page == 1 else f"tag-index/{page}.html", _page("Tags", body + "</ul>")))
            yield pd.DataFrame(out, columns=["rel_path", "html"])

    return paged.mapInPandas(run, _SCHEMA)


def site_rows(w: Wiki) -> DataFrame:
    """All pages of the site that are rows."""
    pages = note_pages(w).unionByName(tag_pages(w)).unionByName(tag_index(w))
    return pages if w.config.paginate_by is None else pages.unionByName(index_pages(w))


def write(rows: DataFrame, folder: str) -> DataFrame:
    """Write each row to its path below ``folder``, which all executors share; the paths written, as a table. A second run gives the same files."""

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for rel_path, html in zip(pdf["rel_path"], pdf["html"]):
                path = os.path.join(folder, *rel_path.split("/"))
                os.makedirs(os.path.dirname(path), exist_ok=True)
                with open(f"{path}.{os.getpid()}.tmp", "w", encoding="utf-8") as f:
                    f.write(html)
                os.replace(f.name, path)
            yield pdf[["rel_path"]]

    return written(rows.mapInPandas(put, "rel_path string"), "pages").distinct()


def write_parts(rows: DataFrame, order: list[Column], column: str, path: str, head: str = "", between: str = "", tail: str = "") -> None:
    """One text file of all rows in order: executors write sorted parts beside it, which are then copied one after the other."""
    parts = f"{path}.parts"
    shutil.rmtree(parts, ignore_errors=True)
    os.makedirs(parts, exist_ok=True)

    def put(part) -> None:
        name = os.path.join(parts, f"{TaskContext.get().partitionId():09}")
        with open(f"{name}.{os.getpid()}.tmp", "w", encoding="utf-8") as f:
            for k, r in enumerate(part):
                f.write((between if k else "") + r[column])
        os.replace(f.name, name)

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select(column).foreachPartition(put)
    with open(f"{path}.tmp", "wb") as f:
        f.write(head.encode())
        first = True
        for name in sorted(x for x in os.listdir(parts) if x.isdigit()):
            with open(os.path.join(parts, name), "rb") as part:
                if os.fstat(part.fileno()).st_size:
                    f.write(b"" if first else between.encode())
                    first = False
                    shutil.copyfileobj(part, f)
        f.write(tail.encode())
    os.replace(f"{path}.tmp", path)
    shutil.rmtree(parts)


def _remove_stale(pages: DataFrame, folder: str, manifest: str) -> None:
    """Delete the pages of the last build that this one didn't write."""

    def remove(part) -> None:
        for r in part:
            path = os.path.join(folder, *r["rel_path"].split("/"))
            if os.path.exists(path):
                os.remove(path)

    if os.path.exists(manifest):
        before = pages.sparkSession.read.text(manifest).select(F.col("value").alias("rel_path"))
        before.join(pages, "rel_path", "left_anti").foreachPartition(remove)


def build(w: Wiki, folder: str, stage: Callable[[str], None] | None = None, static: str | None = None) -> int:
    """Write the site; returns the number of pages. ``stage`` hears of each stage, which is also the description of its jobs.
    A style sheet main.css in the folder ``static`` takes the place of ours."""
    spark, folder = w.notes.sparkSession, os.path.abspath(folder)

    def begin(name: str) -> None:
        spark.sparkContext.setJobDescription(name)
        if stage:
            stage(name)

    os.makedirs(folder, exist_ok=True)
    begin("read notes")
    w.edges  # noqa: B018 parses and writes
    begin("write pages")
    pages = write(site_rows(w), folder)
    if w.config.paginate_by is None and not w.site_notes().isEmpty():
        line = F.concat(F.lit('<li><a href="'), "u", F.lit('">'), X.html_escape("n"), F.lit("</a></li>"))
        head, _, tail = _page(w.config.title or "Wiki", _intro(w) + "<ul>\0</ul>").partition("\0")
        write_parts(index_rows(w).withColumn("li", line), [F.col("row")], "li", os.path.join(folder, "index.html"), head, "", tail)
        pages = pages.unionByName(spark.createDataFrame([("index.html",)], "rel_path string"))
    manifest = os.path.join(folder, MANIFEST)
    _remove_stale(pages, folder, manifest)
    write_parts(pages, [F.col("rel_path")], "rel_path", manifest, "", "\n", "\n")
    begin("write style sheet")
    own = os.path.join(static, "main.css") if static else ""
    if own and os.path.exists(own):
        shutil.copyfile(own, os.path.join(folder, "main.css"))
    else:
        with open(os.path.join(folder, "main.css"), "w", encoding="utf-8") as f:
            f.write(style(w.config.color_scheme))
    if w.config.build_search_index:
        begin("write search index")
        write_parts(w.search_index(), [F.col("title")], "json", os.path.join(folder, "search_index.json"), "[", ",", "]\n")
    n = pages.count()
    spark.sparkContext.setJobDescription(None)
    return n
