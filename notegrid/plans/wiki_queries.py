"""Queries of the wiki operators and SQL that computes the same from the base tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from notegrid.functions import expr as X
from notegrid.operators import extract, graph, lint, search, site, tags
from notegrid.plans import rendered
from notegrid.plans.registry import query
from notegrid.plans.scratch import written
from notegrid.sources.tables import table

BASE, NOW = "https://wiki.example.com/", 896659200

PRELUDE = """
P AS (SELECT p_partkey AS k, p_type AS t, replace(p_brand, '#', '') AS b, p_size, p_name, 'parts/' || p_type || '/' || replace(p_brand, '#', '') || '/P' || p_partkey AS key FROM part),
C AS (SELECT c_custkey AS k, c_mktsegment AS s, 'C' || c_custkey AS key FROM customer WHERE c_custkey % 10 <> 0),
O AS (SELECT o_orderkey AS k, o_orderstatus AS s, o_custkey, o_orderpriority, epoch(o_orderdate)::BIGINT AS ts, 'orders/' || o_orderstatus || '/O' || o_orderkey AS key FROM orders),
L AS (SELECT l.*, P.key AS pk, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS rn FROM lineitem l JOIN P ON P.k = l_partkey),
N AS (SELECT key, 'P' || k AS title, 'parts/' || t || '/' || b AS ctx, NULL::BIGINT AS ts FROM P UNION ALL SELECT key, key, NULL, NULL FROM C UNION ALL SELECT key, 'O' || k, 'orders/' || s, ts FROM O),
LK AS (SELECT O.key AS src, 'C' || o_custkey AS dst, NULL AS heading, 'buyer' AS alias, 5 AS line FROM O
       UNION ALL SELECT O.key, L.pk, 'Spec', NULL, 8 + L.rn FROM L JOIN O ON O.k = L.l_orderkey
       UNION ALL SELECT key, key, NULL, NULL, 9 FROM P WHERE p_size % 10 = 0),
E AS (SELECT DISTINCT src, dst FROM LK),
EM AS (SELECT O.key AS src, L.pk AS dst, 'Spec' AS heading FROM O JOIN L ON L.l_orderkey = O.k AND L.rn = 1 WHERE O.k % 3 = 0
       UNION ALL SELECT a.key, z.key, NULL FROM P a JOIN P z ON z.k = CASE WHEN a.k % 100 = 7 THEN a.k + 1 WHEN a.k % 100 = 8 THEN a.k - 1 WHEN a.k % 11 = 1 AND a.k > 1 THEN a.k // 2 END),
T AS (SELECT key, 'catalog/' || t || '/' || b AS tag FROM P UNION ALL SELECT key, 'segment/' || s FROM C UNION ALL SELECT key, 'status/' || s FROM O UNION ALL SELECT key, 'priority/' || left(o_orderpriority, 1) FROM O),
TM AS (SELECT DISTINCT key, array_to_string(string_split(tag, '/')[1:i], '/') AS tag FROM T, range(1, 4) r(i) WHERE i <= len(string_split(tag, '/')))
"""


def sql(text: str, *, rec: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if rec else ''}{PRELUDE.strip()} {text}"


class World:
    """The rendered wiki; ``keep`` writes it once for queries that read its texts more than once."""

    def __init__(self, spark, d: str, keep: bool = False) -> None:
        notes = extract.with_key(rendered.notes(spark, d))
        self.notes = written(notes, "notes") if keep else notes

    def parsed(self, *wanted: str) -> DataFrame:
        return extract.parse(self.notes, *wanted)

    def lint(self, *rules: str) -> lint.Wiki:
        """One rule about links reads them once, so nothing is written; else notes and what is parsed are one table."""
        if rules in (("dead-end",), ("lonely",), ("self-link",), ("overlinking",), ("broken-link",)):
            return lint.Wiki(self.notes, lambda: extract.parse(self.notes, "links", spans=True), lambda: graph.edges(extract.parse(self.notes, "links", spans=True)), NOW)
        if rules == ("stale-by-git",):
            return lint.Wiki(self.notes, lambda: self.notes, lambda: self.notes, NOW)
        p = written(extract.parse(self.notes, "links", "headings", keep=("title", "ctx", "name", "committed_ts"), spans=True), "parsed")
        return lint.Wiki(p, lambda: p, lambda: written(graph.edges(p), "edges"), NOW)

    def named(self, rows: DataFrame, key: str = "key", name: str = "note") -> DataFrame:
        return rows.withColumn(name, F.replace(key, F.lit("\u0001"), F.lit("/")))


@query("note_scan", sql("SELECT key AS note, title, ctx, coalesce(ctx || '/', '') || title || '.md' AS path FROM N"))
def note_scan(spark, d):
    return World(spark, d).notes.select(F.col("name").alias("note"), "title", F.array_join("ctx", "/").alias("ctx"), X.note_path("ctx", "title").alias("path"))


@query("note_commit_ts", sql("SELECT key AS note, ts AS committed_ts FROM N"))
def note_commit_ts(spark, d):
    """Notes left-joined to a table of commit times."""
    w = World(spark, d).notes
    commits = w.where("committed_ts is not null").select(X.note_path("ctx", "title").alias("path"), "committed_ts")
    return w.withColumn("path", X.note_path("ctx", "title")).drop("committed_ts").join(commits, "path", "left").select(F.col("name").alias("note"), "committed_ts")


@query("refs_links", sql("SELECT src AS note, dst AS target, heading, alias, line::INT AS line, count(*) AS n FROM LK GROUP BY ALL"))
def refs_links(spark, d):
    w = World(spark, d)
    return w.named(extract.refs(w.parsed("links"), "link")).groupBy("note", F.col("dst_name").alias("target"), "heading", "alias", "line").agg(F.count("*").alias("n"))


@query("refs_tags", sql("SELECT key AS note, tag FROM T"))
def refs_tags(spark, d):
    w = World(spark, d)
    return w.named(extract.note_tags(w.parsed("tags"))).select("note", X.tag_display("tag").alias("tag"))


@query("refs_embeds", sql("SELECT src AS note, dst AS target, heading FROM EM"))
def refs_embeds(spark, d):
    w = World(spark, d)
    return w.named(extract.refs(w.parsed("embeds"), "embed")).select("note", F.col("dst_name").alias("target"), "heading")


@query("headings_all", sql("""
SELECT key AS note, 'P' || k AS text, 1 AS level, 1 AS line, NULL AS parent FROM P UNION ALL SELECT key, CASE WHEN p_size > 25 THEN 'Spec' ELSE 'Notes' END, 2, 5, 'P' || k FROM P
UNION ALL SELECT key, key, 1, 1, NULL FROM C UNION ALL SELECT key, 'O' || k, 1, 1, NULL FROM O UNION ALL SELECT key, 'Lines', 2, 7, 'O' || k FROM O"""))
def headings_all(spark, d):
    w = World(spark, d)
    return w.named(extract.headings(w.parsed("headings"))).select("note", "text", "level", "line", "parent")


_SPEC = """
SELECT key AS note, CASE WHEN p_size > 25 THEN 'spec' ELSE 'notes' END AS section, md5(chr(10) || p_name || chr(10)
  || CASE WHEN p_size % 10 = 0 THEN chr(10) || 'See also [[' || key || ']]' || chr(10) ELSE '' END
  || CASE WHEN k % 7 = 0 THEN chr(10) || '![img](https://img.example.com/p' || k || '.png)' || chr(10) ELSE '' END
  || CASE WHEN k % 5 = 0 THEN chr(10) || '```sql' || chr(10) || 'select ''[[not/a/link]]'', ' || k || chr(10) || '```' || chr(10) ELSE '' END
  || coalesce(chr(10) || '![[' || EM.dst || ']]' || chr(10), '')) AS digest
FROM P LEFT JOIN EM ON EM.src = P.key
UNION ALL SELECT O.key, 'lines', md5(coalesce(chr(10) || x.items, '') || coalesce(chr(10) || '![[' || EM.dst || '#Spec]]' || chr(10), ''))
FROM O LEFT JOIN (SELECT l_orderkey, string_agg('- [' || CASE WHEN l_returnflag = 'R' THEN '-' WHEN l_linestatus = 'F' THEN 'x' ELSE ' ' END || '] ship [[' || pk || '#Spec]] qty ' || l_quantity::INT || chr(10), '' ORDER BY rn) AS items FROM L GROUP BY 1) x ON x.l_orderkey = O.k
LEFT JOIN EM ON EM.src = O.key"""


@query("section_body", sql(_SPEC))
def section_body(spark, d):
    """Digest of the text of the sections Spec, Notes and Lines of all notes that have them, whatever they hold."""
    w = World(spark, d).notes.select(F.col("name").alias("note"), "md_text", F.explode(F.array(*map(F.lit, ("spec", "notes", "lines")))).alias("section"))
    return w.select("note", "section", F.md5(extract.section_of("md_text", "section")).alias("digest")).where("digest is not null")


_SECTIONS = """
SELECT key AS note, CASE WHEN p_size > 25 THEN 'spec' ELSE 'notes' END AS section, (length(p_name) + 2
  + CASE WHEN p_size % 10 = 0 THEN length(key) + 15 ELSE 0 END + CASE WHEN k % 7 = 0 THEN length(k::VARCHAR) + 39 ELSE 0 END
  + CASE WHEN k % 5 = 0 THEN length(k::VARCHAR) + 38 ELSE 0 END + coalesce(length(EM.dst) + 7, 0))::INT AS chars
FROM P LEFT JOIN EM ON EM.src = P.key
UNION ALL SELECT O.key, 'lines', (coalesce(x.chars + 1, 0) + coalesce(length(EM.dst) + 12, 0))::INT
FROM O LEFT JOIN (SELECT l_orderkey, sum(length(pk) + length(l_quantity::INT::VARCHAR) + 26) AS chars FROM L GROUP BY 1) x ON x.l_orderkey = O.k LEFT JOIN EM ON EM.src = O.key"""


@query("section_lengths", sql(_SECTIONS))
def section_lengths(spark, d):
    """Length of the sections Spec, Notes and Lines of all notes that have them, whatever they hold."""
    w = World(spark, d).notes.select(F.col("name").alias("note"), "md_text", F.explode(F.array(*map(F.lit, ("spec", "notes", "lines")))).alias("section"))
    return w.select("note", "section", F.length(extract.section_of("md_text", "section")).alias("chars")).where("chars is not null")


@query("code_blocks_all", sql("SELECT key AS note, 'sql' AS lang, 'select ''[[not/a/link]]'', ' || k || chr(10) AS content FROM P WHERE k % 5 = 0"))
def code_blocks_all(spark, d):
    w = World(spark, d)
    return w.named(extract.code_blocks(w.parsed("code"))).select("note", "lang", "content")


_TASK = "SELECT O.key AS note, CASE WHEN l_returnflag = 'R' THEN 'deferred' WHEN l_linestatus = 'F' THEN 'done' ELSE 'open' END AS status, 'ship ' || pk || '#Spec qty ' || l_quantity::INT AS text, (8 + rn)::INT AS line FROM L JOIN O ON O.k = L.l_orderkey"


@query("task_items_all", sql(_TASK))
def task_items_all(spark, d):
    w = World(spark, d)
    return w.named(extract.tasks(w.parsed("tasks"))).select("note", "status", "text", "line")


@query("todo_open", sql(f"SELECT note, text, line FROM ({_TASK}) WHERE status = 'open'"))
def todo_open(spark, d):
    """Open tasks by context, title and line."""
    w = World(spark, d)
    rows = extract.tasks(w.parsed("tasks"), "open").join(w.notes.select("key", "name", "title", "ctx"), "key")
    return rows.orderBy(*extract.task_order()).select(F.col("name").alias("note"), "text", "line")


@query("todo_status_counts", sql(f"SELECT status, count(*) AS n FROM ({_TASK}) GROUP BY 1"))
def todo_status_counts(spark, d):
    return extract.tasks(World(spark, d).parsed("tasks")).groupBy("status").agg(F.count("*").alias("n"))


@query("images_thumbnail", sql("SELECT key AS note, 'https://img.example.com/p' || k || '.png' AS thumbnail FROM P WHERE k % 7 = 0"))
def images_thumbnail(spark, d):
    w = World(spark, d)
    return w.named(extract.thumbnails(w.parsed("images"))).select("note", "thumbnail")


@query("images_all", sql("SELECT key AS note, 0 AS pos, 'https://img.example.com/p' || k || '.png' AS url FROM P WHERE k % 7 = 0"))
def images_all(spark, d):
    w = World(spark, d)
    return w.named(extract.images(w.parsed("images"))).select("note", "pos", "url")


@query("edges_distinct", sql("SELECT src, dst FROM E"))
def edges_distinct(spark, d):
    w = World(spark, d)
    return w.named(graph.edges(w.parsed("links")), "src", "src").select("src", F.col("dst_name").alias("dst"))


@query("get_note", sql("SELECT key AS note, title, ctx, ts AS committed_ts FROM N WHERE key = (SELECT min(key) FROM O)"))
def get_note(spark, d):
    """One note by its exact title and context: the order note that comes first."""
    w = World(spark, d).notes
    one = w.where(F.col("title").startswith("O")).agg(F.min(F.struct("name", "title", "ctx")).alias("x")).collect()[0]["x"]
    return graph.require(w, one["title"], one["ctx"]).select(F.col("name").alias("note"), "title", F.array_join("ctx", "/").alias("ctx"), "committed_ts")


@query("links_of_note", sql("SELECT kind, target, heading FROM (SELECT 'link' AS kind, src, dst AS target, heading FROM LK UNION ALL SELECT 'embed', src, dst, heading FROM EM) WHERE src = (SELECT min(key) FROM O WHERE k % 3 = 0 AND k IN (SELECT l_orderkey FROM L)) AND target IN (SELECT key FROM N)"))
def links_of_note(spark, d):
    w = World(spark, d, keep=True)
    some = w.notes.where(F.col("title").startswith("O") & (F.expr("int(substring(title, 2))") % 3 == 0) & F.contains("md_text", F.lit("qty")))
    one = w.notes.join(some.agg(F.min("name").alias("name")), "name", "left_semi")
    return graph.links_of(w.notes, w.parsed("links", "embeds"), one).select("kind", "target", "heading")


@query("backlinks_of_note", sql("SELECT src AS note FROM E WHERE dst = (SELECT min(key) FROM P)"))
def backlinks_of_note(spark, d):
    w = World(spark, d)
    one = w.notes.join(w.notes.where(F.col("title").startswith("P")).agg(F.min("name").alias("name")), "name", "left_semi")
    return graph.backlinks_of(w.notes, graph.edges(w.parsed("links")), one).select(F.col("name").alias("note"))


_BACK = "SELECT N.key AS note, count(E.src) AS backlinks FROM N LEFT JOIN E ON E.dst = N.key GROUP BY 1"


@query("backlink_counts", sql(_BACK))
def backlink_counts(spark, d):
    w = World(spark, d)
    return graph.backlink_counts(w.notes, graph.edges(w.parsed("links"))).select(F.col("name").alias("note"), "backlinks")


@query("most_linked", sql(f"SELECT * FROM ({_BACK}) ORDER BY backlinks DESC, note LIMIT 20"))
def most_linked(spark, d):
    """The twenty notes with most backlinks."""
    return backlink_counts(spark, d).orderBy(F.desc("backlinks"), "note").limit(20)


@query("tag_list_counts", sql("SELECT tag AS title, count(*) AS n FROM TM GROUP BY 1"))
def tag_list_counts(spark, d):
    return tags.for_listing(tags.counts(extract.note_tags(World(spark, d).parsed("tags")))).select("title", "n")


@query("tag_top15", sql("SELECT tag AS title, count(*) AS n FROM TM GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15"))
def tag_top15(spark, d):
    return tags.top(tags.counts(extract.note_tags(World(spark, d).parsed("tags")))).select("title", "n")


@query("tag_members", sql("SELECT tag, key AS note FROM TM"))
def tag_members(spark, d):
    w = World(spark, d)
    return w.named(tags.members(extract.note_tags(w.parsed("tags")))).select(X.tag_display("tag").alias("tag"), "note")


@query("tag_set", sql("SELECT DISTINCT tag, len(string_split(tag, '/'))::INT AS depth, string_split(tag, '/')[-1] AS leaf FROM TM"))
def tag_set(spark, d):
    return tags.tag_set(extract.note_tags(World(spark, d).parsed("tags"))).select(X.tag_display("tag").alias("tag"), F.size("tag").alias("depth"), X.tag_leaf("tag").alias("leaf"))


@query("tag_members_of", sql("SELECT key AS note FROM TM WHERE tag = 'status/F'"))
def tag_members_of(spark, d):
    w = World(spark, d)
    return w.named(tags.members_of(extract.note_tags(w.parsed("tags")), ["status", "F"])).select("note")


# Byte offsets in the texts of rendered.py, which are ASCII: what stands before the block of a link, and the lines of an order before item rn.
_SELF_AT = "(length(k::VARCHAR) + length(t) + length(b) + length(p_name) + CASE WHEN p_size > 25 THEN 41 ELSE 42 END)"
_HEAD_AT = "(length(O.k::VARCHAR) + length(O.s) + length(O.o_custkey::VARCHAR) + 67 + coalesce(sum(length(L.pk) + length(l_quantity::INT::VARCHAR) + 26) OVER (PARTITION BY O.k ORDER BY L.rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 11)"
_NO_SPAN = "NULL::INT AS span_begin, NULL::INT AS span_end"
_LINT = {
    "dead_end": ("dead-end", f"SELECT key AS note, 'note has no links to other notes' AS message, {_NO_SPAN} FROM N WHERE key NOT IN (SELECT src FROM E)"),
    "lonely": ("lonely", f"SELECT key AS note, 'note is not linked from any other note' AS message, {_NO_SPAN} FROM N WHERE key NOT IN (SELECT dst FROM E)"),
    "self_link": ("self-link", f"SELECT key AS note, 'note links to itself' AS message, {_SELF_AT} AS span_begin, {_SELF_AT} + length(key) + 4 AS span_end FROM P WHERE p_size % 10 = 0"),
    "overlinking": ("overlinking", f"SELECT src AS note, 'link [[' || dst || ']] appears ' || count(*) || ' times' AS message, {_NO_SPAN} FROM LK GROUP BY src, dst HAVING count(*) > 1"),
    "broken_link": ("broken-link", f"SELECT src AS note, 'broken wikilink: [[' || dst || ']]' AS message, {_NO_SPAN} FROM E WHERE dst NOT IN (SELECT key FROM N)"),
    "broken_heading": ("broken-heading-ref", f"""SELECT src AS note, 'broken heading reference: [[' || dst || '#Spec]] (heading not found in target note)' AS message, min(pos) OVER (PARTITION BY src, dst) AS span_begin, min(pos) OVER (PARTITION BY src, dst) + length(dst) + 9 AS span_end
        FROM (SELECT O.key AS src, L.pk AS dst, {_HEAD_AT} AS pos FROM L JOIN O ON O.k = L.l_orderkey) JOIN P ON P.key = dst WHERE p_size <= 25"""),
    "stale": ("stale-by-git", f"SELECT key AS note, 'note not updated in ' || (({NOW} - ts) // 86400) || ' days' AS message, {_NO_SPAN} FROM N WHERE ts < {NOW} - 180 * 86400"),
}


def _lint(rule: str):
    def run(spark, d):
        rows = lint.lint(World(spark, d).lint(rule), [rule])
        return rows.select(F.regexp_replace("path", r"\.md$", "").alias("note"), "message", "span_begin", "span_end")

    return run


for _name, (_rule, _text) in _LINT.items():
    query(f"lint_{_name}", sql(_text))(_lint(_rule))


@query("lint_summary", sql("SELECT rule, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{r}' AS rule, note FROM ({t})" for r, t in _LINT.values()) + ") GROUP BY 1"))
def lint_summary(spark, d):
    return lint.lint(World(spark, d).lint("all"), "all").groupBy("rule").agg(F.count("*").alias("n"))


@query("embed_closure", sql(", CL AS (SELECT DISTINCT src AS root, dst AS reached FROM EM UNION SELECT CL.root, EM.dst FROM CL JOIN EM ON EM.src = CL.reached) SELECT root, reached FROM CL", rec=True))
def embed_closure(spark, d):
    w = World(spark, d)
    pairs = graph.closure(graph.embed_edges(w.notes, w.parsed("embeds")))
    return w.named(w.named(pairs, "root", "root"), "reached", "reached").select("root", "reached")


_ORDERED = f"B AS ({_BACK}), R AS (SELECT N.key AS note, ts, backlinks, row_number() OVER (ORDER BY ts DESC NULLS LAST, N.key DESC) AS by_date, row_number() OVER (ORDER BY backlinks DESC, N.key DESC) AS by_links FROM N JOIN B ON B.note = N.key)"


@query("index_by_date", sql(f", {_ORDERED} SELECT note, by_date AS row FROM R"))
def index_by_date(spark, d):
    w = World(spark, d)
    return site.positions(w.notes.select("name", "committed_ts"), site.by_date()).select(F.col("name").alias("note"), "row")


@query("index_by_links", sql(f", {_ORDERED} SELECT note, by_links AS row, backlinks FROM R"))
def index_by_links(spark, d):
    w = World(spark, d)
    return site.positions(graph.backlink_counts(w.notes, graph.edges(w.parsed("links"))), site.by_links()).select(F.col("name").alias("note"), "row", "backlinks")


@query("index_paging", sql(f", {_ORDERED} SELECT (by_date - 1) // 20 + 1 AS page, count(*) AS n, min(note) AS first, max(note) AS last FROM R GROUP BY 1"))
def index_paging(spark, d):
    w = World(spark, d)
    rows = site.pages(site.positions(w.notes.select("name", "committed_ts"), site.by_date()), 20)
    return rows.groupBy("page").agg(F.count("*").alias("n"), F.min("name").alias("first"), F.max("name").alias("last"))


@query("page_pointers", sql(", G AS (SELECT unnest(range(1, (SELECT (count(*) + 19) // 20 FROM N) + 1)) AS page), M AS (SELECT max(page) AS last FROM G), F AS (SELECT page, CASE WHEN page = 1 THEN './' ELSE './' || page || '.html' END AS f FROM G) SELECT F.page, F.f AS current, b.f AS prev, a.f AS next FROM F LEFT JOIN F b ON b.page = F.page - 1 LEFT JOIN F a ON a.page = F.page + 1"))
def page_pointers(spark, d):
    w = World(spark, d)
    return site.pointers(site.pages(site.positions(w.notes.select("name", "committed_ts"), site.by_date()), 20))


@query("build_page_count", sql("SELECT (count(*) + 19) // 20 AS index_pages, count(*) AS notes, (SELECT count(DISTINCT tag) FROM TM) AS tags, (count(*) + 19) // 20 + count(*) + 1 + (SELECT count(DISTINCT tag) FROM TM) AS files FROM N"))
def build_page_count(spark, d):
    w = World(spark, d)
    return site.page_count(w.notes, tags.tag_set(extract.note_tags(w.parsed("tags"))), 20)


# Titles and contexts of the rendered wiki hold no sign that a slug spells as a word, so lower case and dashes are their slugs.
_STEM = "replace(lower(key), ' ', '-')"


@query("search_index", sql(f"SELECT key AS title, '{BASE}notes/' || {_STEM} || '.html' AS url, '{{\"title\":\"' || key || '\",\"url\":\"{BASE}notes/' || {_STEM} || '.html\"}}' AS json FROM N"))
def search_index(spark, d):
    return site.search_index(World(spark, d).notes, BASE)


@query("link_href", sql(f"SELECT src AS note, dst AS target, '{BASE}notes/' || replace(lower(dst), ' ', '-') || '.html' || coalesce('#' || lower(heading), '') AS href FROM LK WHERE dst IN (SELECT key FROM N)"))
def link_href(spark, d):
    w = World(spark, d)
    rows = extract.refs(w.parsed("links"), "link").join(w.notes.select(F.col("key").alias("dst")), "dst", "left_semi")
    href = F.concat(X.note_href(BASE, "ctx", "title"), F.coalesce(F.concat(F.lit("#"), X.slug_dash("heading")), F.lit("")))
    return w.named(rows).select("note", F.col("dst_name").alias("target"), href.alias("href"))


@query("tag_href", sql(f"SELECT DISTINCT tag, '{BASE}tags/' || replace(lower(tag), ' ', '-') || '.html' AS href FROM TM"))
def tag_href(spark, d):
    return tags.tag_set(extract.note_tags(World(spark, d).parsed("tags"))).select(X.tag_display("tag").alias("tag"), X.tag_href(BASE, "tag").alias("href"))


# HTML of the rendered notes, embeds left as written: what the renderer makes of each block of rendered.py.
def _a(stem: str, label: str, more: str = "") -> str:
    return f"'<a href=\"{BASE}notes/' || {stem} || '.html{more}\">' || {label} || '</a>'"


def _tag_sql(tag: str) -> str:
    return f"'<a class=\"tag\" href=\"{BASE}tags/' || replace(lower({tag}), ' ', '-') || '.html\">#' || {tag} || '</a>'"


_HTML = f"""
SELECT P.key AS note, md5('<h1 id="p' || k || '">P' || k || '</h1>' || chr(10) || '<p>' || {_tag_sql("('catalog/' || t || '/' || b)")} || '</p>' || chr(10)
  || CASE WHEN p_size > 25 THEN '<h2 id="spec">Spec</h2>' ELSE '<h2 id="notes">Notes</h2>' END || chr(10) || '<p>' || p_name || '</p>'
  || CASE WHEN p_size % 10 = 0 THEN chr(10) || '<p>See also ' || {_a("replace(lower(P.key), ' ', '-')", "'P' || k")} || '</p>' ELSE '' END
  || CASE WHEN k % 7 = 0 THEN chr(10) || '<p><img src="https://img.example.com/p' || k || '.png" alt="img"></p>' ELSE '' END
  || CASE WHEN k % 5 = 0 THEN chr(10) || '<pre><code class="language-sql">select ''[[not/a/link]]'', ' || k || chr(10) || '</code></pre>' ELSE '' END
  || coalesce(chr(10) || '<p>![[' || EM.dst || ']]</p>', '')) AS digest FROM P LEFT JOIN EM ON EM.src = P.key
UNION ALL SELECT key, md5('<h1 id="' || lower(key) || '">' || key || '</h1>' || chr(10) || '<p>' || {_tag_sql("('segment/' || s)")} || '</p>') FROM C
UNION ALL SELECT O.key, md5('<h1 id="o' || k || '">O' || k || '</h1>' || chr(10) || '<p>' || {_tag_sql("('status/' || s)")} || ' ' || {_tag_sql("('priority/' || left(o_orderpriority, 1))")} || '</p>' || chr(10)
  || '<p>Customer ' || {_a("'c' || o_custkey", "'buyer'")} || '</p>' || chr(10) || '<h2 id="lines">Lines</h2>' || coalesce(chr(10) || '<ul>' || x.items || '</ul>', '') || coalesce(chr(10) || '<p>![[' || EM.dst || '#Spec]]</p>', ''))
FROM O LEFT JOIN (SELECT l_orderkey, string_agg('<li><input type="checkbox" disabled class="task-' || CASE WHEN l_returnflag = 'R' THEN 'deferred">' WHEN l_linestatus = 'F' THEN 'done" checked>' ELSE 'open">' END
  || ' ship ' || {_a("replace(lower(pk), ' ', '-')", "string_split(pk, '/')[-1]", "#spec")} || ' qty ' || l_quantity::INT || '</li>', '' ORDER BY rn) AS items FROM L GROUP BY 1) x ON x.l_orderkey = O.k
LEFT JOIN EM ON EM.src = O.key"""


@query("html_notes", sql(_HTML))
def html_notes(spark, d):
    """Digest of the HTML of every note, embeds left as they are written."""
    return World(spark, d).notes.select(F.col("name").alias("note"), F.md5(site.rendered("md_text", BASE)).alias("digest"))


_TAG_ORDER = ", X AS (SELECT tag AS title, count(*) AS n, string_split(tag, '/') AS a FROM TM GROUP BY 1) SELECT title, n, row_number() OVER (ORDER BY {}) AS row FROM X"


def _placed(rows: DataFrame, order: list) -> DataFrame:
    return site.positions(rows, order).select("title", "n", "row")


@query("tag_order_pages", sql(_TAG_ORDER.format("n DESC, title")))
def tag_order_pages(spark, d):
    return _placed(tags.counts(extract.note_tags(World(spark, d).parsed("tags"))), tags.by_title())


@query("tag_order_listing", sql(_TAG_ORDER.format("n DESC, a")))
def tag_order_listing(spark, d):
    return _placed(tags.counts(extract.note_tags(World(spark, d).parsed("tags"))), tags.by_segments())


@query("tag_order_text", sql(_TAG_ORDER.format("n DESC, a DESC")))
def tag_order_text(spark, d):
    return _placed(tags.counts(extract.note_tags(World(spark, d).parsed("tags"))), tags.by_segments_last())


@query("todo_order", sql(f"SELECT note, line, text, row_number() OVER (ORDER BY 'orders/' || s, note, line) AS row FROM ({_TASK.replace('SELECT O.key AS note', 'SELECT O.key AS note, O.s')}) WHERE status = 'open'"))
def todo_order(spark, d):
    """Place of each open task in the order of contexts, titles and lines."""
    w = World(spark, d)
    rows = extract.tasks(extract.parse(w.notes, "tasks", keep=("name", "title", "ctx")), "open", keep=("name", "title", "ctx"))
    return site.positions(rows, extract.task_order()).select(F.col("name").alias("note"), "line", "text", "row")


@query("todo_labels", sql(f"SELECT note AS label, count(*) AS n FROM ({_TASK}) GROUP BY 1"))
def todo_labels(spark, d):
    """Tasks of each note by its label."""
    rows = extract.tasks(extract.parse(World(spark, d).notes, "tasks", keep=("title", "ctx")), keep=("title", "ctx"))
    return rows.groupBy(X.key_display("ctx", "title").alias("label")).agg(F.count("*").alias("n"))


# --- the wiki tables as they are -------------------------------------------------------------


def _vault(spark, d, *wanted: str) -> DataFrame:
    """Parsed ``wiki_notes``, keyed by the note's id."""
    return extract.parse(table(spark, d, "wiki_notes").select(F.col("note_id").cast("string").alias("key"), "md_text"), *wanted)


@query("vault_links", "SELECT DISTINCT src_id AS note_id, pos, array_to_string(list_append(ctx_path, title), '/') AS target, heading, alias FROM wiki_link_refs")
def vault_links(spark, d):
    """Plain links of all notes, position among the plain links."""
    rows = _vault(spark, d, "links").withColumn("refs", F.filter("refs", lambda x: x["kind"] == "link"))
    return extract.refs(rows).select(F.col("key").cast("bigint").alias("note_id"), "pos", F.col("dst_name").alias("target"), "heading", "alias")


@query("vault_tags", "SELECT DISTINCT src_id AS note_id, array_to_string(path, '/') AS tag, line FROM tag_refs")
def vault_tags(spark, d):
    return extract.refs(_vault(spark, d, "tags"), "tag").select(F.col("key").cast("bigint").alias("note_id"), F.col("dst_name").alias("tag"), "line").distinct()


@query("vault_headings", "SELECT DISTINCT note_id, pos, level, text, line, parent FROM headings")
def vault_headings(spark, d):
    return extract.headings(_vault(spark, d, "headings")).select(F.col("key").cast("bigint").alias("note_id"), "pos", "level", "text", "line", "parent")


@query("vault_thumbnails", "SELECT note_id, thumbnail FROM wiki_notes WHERE thumbnail IS NOT NULL")
def vault_thumbnails(spark, d):
    return extract.thumbnails(_vault(spark, d, "images")).select(F.col("key").cast("bigint").alias("note_id"), "thumbnail")


@query("vault_link_sets", "SELECT note_id, unnest(links) AS target FROM wiki_notes")
def vault_link_sets(spark, d):
    return graph.edges(_vault(spark, d, "links")).select(F.col("src").cast("bigint").alias("note_id"), F.col("dst_name").alias("target"))


@query("vault_note_tags", "SELECT note_id, array_to_string(tags, ' | ') AS tags FROM wiki_notes WHERE len(tags) > 0")
def vault_note_tags(spark, d):
    """Distinct tags of each note in order of first occurrence."""
    rows = extract.note_tags(_vault(spark, d, "tags")).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("pos", X.tag_display("tag").alias("tag")))).alias("x"))
    return rows.select(F.col("key").cast("bigint").alias("note_id"), F.array_join("x.tag", " | ").alias("tags"))


_SUB = {"thmond": "(?s)(?i)^[^t]*t[^h]*h[^m]*m[^o]*o[^n]*n[^d]*d", "qzx": "(?s)(?i)^[^q]*q[^z]*z[^x]*x"}


@query("search_and", f"SELECT doc_id FROM documents WHERE regexp_matches(text, '{_SUB['thmond']}') AND regexp_matches(text, '{_SUB['qzx']}')")
def search_and(spark, d):
    return table(spark, d, "documents").where(search.matches("text", "thmond qzx", "and")).select("doc_id")


@query("search_or", f"SELECT doc_id FROM documents WHERE regexp_matches(text, '{_SUB['thmond']}') OR regexp_matches(text, '{_SUB['qzx']}')")
def search_or(spark, d):
    return table(spark, d, "documents").where(search.matches("text", "thmond qzx", "or")).select("doc_id")


def _score_sql(keyword: str) -> str:
    """Score of a keyword over ``text``: the better of the leftmost places of its letters and of its first whole occurrence."""
    fold = not any(c.isupper() for c in keyword)
    x, n = ("lower(text)" if fold else "text"), len(keyword)
    places = [f"strpos(x, '{keyword[0]}') AS p0"]
    for k, c in enumerate(keyword[1:], 1):
        at = f"strpos(substr(x, p{k - 1} + 1), '{c}')"
        places.append(f"CASE WHEN p{k - 1} > 0 AND {at} > 0 THEN p{k - 1} + {at} ELSE 0 END AS p{k}")

    def along(p: list[str]) -> str:
        begins = [f"CASE WHEN {q} = 1 OR NOT regexp_matches(substr(x, {q} - 1, 1), '[\\p{{L}}\\p{{N}}]') THEN 8 ELSE 0 END" for q in p]
        steps = [f"CASE WHEN {r} = {q} + 1 THEN 10 ELSE -least(16, {r} - {q} - 1) END" for q, r in zip(p, p[1:])]
        return " + ".join([str(16 * n), *begins, *steps])

    left, whole = along([f"p{k}" for k in range(n)]), along([f"(w + {k})" for k in range(n)])
    return f"SELECT note_id, CASE WHEN p{n - 1} = 0 THEN 0 ELSE greatest(1, {left}, CASE WHEN w > 0 THEN {whole} ELSE 1 END) END AS score FROM (SELECT note_id, x, strpos(x, '{keyword}') AS w, {', '.join(places)} FROM (SELECT note_id, {x} AS x FROM t))"


@query("search_top", f"""
WITH t AS (SELECT note_id, array_to_string(list_append(coalesce(ctx, []), title), '/') AS name, name || ' ' || coalesce(md_text, '') AS text FROM wiki_notes),
a AS ({_score_sql('Home')}), b AS ({_score_sql('drafts')})
SELECT t.note_id, name, a.score + b.score AS score FROM t JOIN a ON a.note_id = t.note_id JOIN b ON b.note_id = t.note_id WHERE a.score > 0 AND b.score > 0 ORDER BY 3 DESC, 1 LIMIT 100""")
def search_top(spark, d):
    """The hundred best notes for a query."""
    notes = extract.with_key(table(spark, d, "wiki_notes")).withColumn("text", search.search_text())
    return search.search(notes, "Home drafts", "and", order="note_id").select("note_id", "name", "score")


@query("search_empty_query", "SELECT doc_id FROM documents ORDER BY doc_id LIMIT 100")
def search_empty_query(spark, d):
    return search.search(table(spark, d, "documents"), "", order="doc_id").select("doc_id")


_SPACE_SQL = "[\\s\\p{Z}\\x{0B}\\x{85}]"


def _slug_sql(c: str) -> str:
    final = f"regexp_replace({c}, '(\\p{{L}})Σ(\\P{{L}}|$)', '\\1ς\\2', 'g')"  # DuckDB lowers letter by letter
    out = f"lower(regexp_replace({final}, '^{_SPACE_SQL}+|{_SPACE_SQL}+$', '', 'g'))"
    for sign, word in X.SIGN_WORDS.items():
        out = f"replace({out}, '{sign.replace(chr(39), chr(39) * 2)}', '-{word}-')"
    return f"regexp_replace(regexp_replace(regexp_replace({out}, '{_SPACE_SQL}+', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g')"


@query("slug_titles", "SELECT DISTINCT v AS text, " + _slug_sql("v") + " AS slug FROM (SELECT title AS v FROM wiki_notes UNION ALL SELECT title FROM wiki_link_refs UNION ALL SELECT heading FROM wiki_link_refs WHERE heading IS NOT NULL)")
def slug_titles(spark, d):
    """Dash slugs of all titles and headings that are written in notes, in whatever characters."""
    notes, links = table(spark, d, "wiki_notes"), table(spark, d, "wiki_link_refs")
    v = notes.select(F.col("title").alias("text")).union(links.select("title")).union(links.where("heading is not null").select("heading"))
    return v.distinct().select("text", X.slug_dash("text").alias("slug"))


@query("slug_heading_titles", "SELECT DISTINCT title AS text, regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(title, '[\\s\\p{Z}\\x{85}-]+', '-', 'g')), '[^\\p{L}\\p{N}-]+', '', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM wiki_notes")
def slug_heading_titles(spark, d):
    """Heading slugs of all titles of notes."""
    return table(spark, d, "wiki_notes").select(F.col("title").alias("text")).distinct().select("text", X.slug_heading("text").alias("slug"))


@query("slug_by_dash", "SELECT DISTINCT v AS text, " + _slug_sql("v") + " AS slug FROM (SELECT p_name AS v FROM part UNION ALL SELECT p_brand FROM part UNION ALL SELECT o_orderpriority FROM orders UNION ALL SELECT r_name FROM region)")
def slug_by_dash(spark, d):
    v = [table(spark, d, t).select(F.col(c).alias("text")) for t, c in (("part", "p_name"), ("part", "p_brand"), ("orders", "o_orderpriority"), ("region", "r_name"))]
    return v[0].union(v[1]).union(v[2]).union(v[3]).distinct().select("text", X.slug_dash("text").alias("slug"))


@query("slug_heading", "SELECT DISTINCT text, regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(text, '[\\s-]+', '-', 'g')), '[^\\p{L}\\p{N}-]+', '', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM headings")
def slug_heading(spark, d):
    return table(spark, d, "headings").select("text").distinct().select("text", X.slug_heading("text").alias("slug"))


@query("file_stem", sql("SELECT key AS note, " + _STEM + " AS stem FROM N"))
def file_stem(spark, d):
    return World(spark, d).notes.select(F.col("name").alias("note"), X.file_stem("ctx", "title").alias("stem"))


@query("tag_slug", "SELECT DISTINCT array_to_string(path, '/') AS tag, array_to_string(list_transform(path, lambda x: " + _slug_sql("x") + "), '/') AS slug FROM tag_refs")
def tag_slug(spark, d):
    return table(spark, d, "tag_refs").select("path").distinct().select(X.tag_display("path").alias("tag"), X.tag_slug("path").alias("slug"))


@query("strip_tags", "SELECT doc_id, md5(regexp_replace(text, '<[^>]*>', '', 'g')) AS digest FROM documents")
def strip_tags(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(X.strip_tags("text")).alias("digest"))


@query("html_escape", "SELECT doc_id, md5(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')) AS digest FROM documents")
def html_escape(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(X.html_escape("text")).alias("digest"))


@query("array_slice", "SELECT note_id, array_to_string(links[2:4], '|') AS a, array_to_string(links[-2:], '|') AS b FROM wiki_notes")
def array_slice(spark, d):
    return table(spark, d, "wiki_notes").select("note_id", F.array_join(X.array_part("links", 1, 4), "|").alias("a"), F.array_join(X.array_part("links", -2), "|").alias("b"))


@query("date_format_tz", "SELECT o_orderkey, strftime(o_orderdate + INTERVAL 9 HOUR, '%Y-%m-%d %H:%M') AS text FROM orders")
def date_format_tz(spark, d):
    """Order dates in a zone nine hours ahead."""
    return table(spark, d, "orders").select("o_orderkey", X.date_text(F.unix_timestamp(F.col("o_orderdate").cast("timestamp")), "%Y-%m-%d %H:%M", "Asia/Tokyo").alias("text"))


@query("url_host", "SELECT note_id, regexp_extract(thumbnail, '^[a-z]+://([^/]+)', 1) AS host FROM wiki_notes WHERE thumbnail IS NOT NULL")
def url_host(spark, d):
    return table(spark, d, "wiki_notes").where("thumbnail is not null").select("note_id", X.url_host("thumbnail").alias("host"))


@query("key_parse", "SELECT DISTINCT l AS path, string_split(l, '/')[-1] AS title, array_to_string(string_split(l, '/')[:-2], '/') AS ctx FROM (SELECT unnest(links) AS l FROM wiki_notes)")
def key_parse(spark, d):
    rows = table(spark, d, "wiki_notes").select(F.explode("links").alias("path")).distinct()
    return rows.select("path", X.key_title("path").alias("title"), F.coalesce(F.array_join(X.key_ctx("path"), "/"), F.lit("")).alias("ctx"))


@query("json_rows", "SELECT note_id, '{\"title\":' || to_json(title) || ',\"thumbnail\":' || coalesce(to_json(thumbnail), 'null') || '}' AS json FROM wiki_notes")
def json_rows(spark, d):
    """JSON objects that keep nulls."""
    return table(spark, d, "wiki_notes").select("note_id", X.json_row("title", "thumbnail").alias("json"))


@query("json_values", "SELECT note_id, to_json(title) AS title, coalesce(to_json(thumbnail), 'null') AS thumbnail, to_json(coalesce(len(links), 0)) AS n FROM wiki_notes")
def json_values(spark, d):
    """JSON of scalars."""
    n = F.when(F.col("links").isNull(), 0).otherwise(F.size("links"))
    return table(spark, d, "wiki_notes").select("note_id", X.json_value("title").alias("title"), X.json_value("thumbnail").alias("thumbnail"), X.json_value(n).alias("n"))


@query("base_urls", "SELECT note_id, regexp_replace(regexp_extract(thumbnail, '^[a-z]+://[^/]+/?'), '/+$', '') || '/' AS url FROM wiki_notes WHERE thumbnail IS NOT NULL")
def base_urls(spark, d):
    rows = table(spark, d, "wiki_notes").where("thumbnail is not null")
    return rows.select("note_id", X.base_url(F.regexp_extract("thumbnail", "^[a-z]+://[^/]+/?", 0)).alias("url"))


@query("bounded_paths", "SELECT DISTINCT array_to_string(path, '/') AS tag, len(path) BETWEEN 1 AND 2 AS two FROM tag_refs")
def bounded_paths(spark, d):
    """Which tags are at most two segments deep."""
    return table(spark, d, "tag_refs").select(X.tag_display("path").alias("tag")).distinct().select("tag", X.bounded("tag", 2).alias("two"))


@query("paths_to_keys", sql("SELECT key || '.md' AS path, title, ctx FROM N"))
def paths_to_keys(spark, d):
    """Titles and contexts from the paths of notes."""
    path = World(spark, d).notes.select(X.note_path("ctx", "title").alias("path"))
    return path.select("path", X.path_title("path").alias("title"), F.array_join(X.key_ctx("path"), "/").alias("ctx"))


@query("results_count", "SELECT '{\"results\":[' || string_agg('{\"note_id\":' || note_id || ',\"thumbnail\":' || coalesce(to_json(thumbnail), 'null') || '}', ',' ORDER BY note_id) || '],\"count\":' || count(*) || '}' AS json FROM (SELECT note_id, thumbnail FROM wiki_notes ORDER BY note_id LIMIT 50)")
def results_count(spark, d):
    """The envelope of a small result."""
    rows = table(spark, d, "wiki_notes").select("note_id", "thumbnail").orderBy("note_id").limit(50)
    return X.envelope(rows)
