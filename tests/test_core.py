import io
import json
import os
import re
import subprocess
import threading
import urllib.error
import urllib.request
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from notegrid import cli, display, rpc, tools
from notegrid.functions import expr as X, html, markdown
from notegrid.functions.sql import register
from notegrid.operators import extract, graph, lint, search, site
from notegrid.plans import scratch
from notegrid.sources import commits, config, markdown_files, site_writer
from notegrid.streaming import ingest
from notegrid.wiki import PUBLIC_FIELDS, SectionNotFound, UnknownField, Wiki, parse_fields

NOTES = [
    ("Home", None, "# Home\n\n[[book/a]] [[book/a|again]] [[Home]] [[gone]] #[[t/u/v]] #[[t/u]]\n\n- [ ] task one\n", 100),
    ("a", ["book"], "# A\n\n## One\n\nbody one\n\n## Two\n\n[[Home#none]] ![[b]]\n", 200),
    ("b", None, "plain ![[book/a]]\n", None),
    ("a", None, None, 100),
]


@pytest.fixture(scope="module")
def wiki(spark):
    return Wiki(spark.createDataFrame(NOTES, "title string, ctx array<string>, md_text string, committed_ts bigint"))


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_links_keep_repeats_and_resolve_by_both_parts(wiki):
    got = [tuple(r)[1:] for r in wiki.links("Home").collect()]
    assert got == [("link", "book/a", None), ("link", "book/a", None), ("link", "Home", None)]
    assert [r[2] for r in wiki.links("a", ["book"]).collect()] == ["Home", "b"]
    assert wiki.links("a").count() == 0  # the root note of the same title
    with pytest.raises(graph.NoteNotFound):
        wiki.links("book/a")
    with pytest.raises(graph.NoteNotFound):
        wiki.links("a", [])


def test_backlinks_and_tags(wiki):
    assert rows(wiki.backlinks("Home").select("title")) == [("Home",), ("a",)]
    assert rows(wiki.backlink_counts().select("name", "backlinks")) == [("Home", 2), ("a", 0), ("b", 0), ("book/a", 1)]
    assert [tuple(r) for r in wiki.tags().collect()] == [("t", 1), ("t/u", 1), ("t/u/v", 1)]
    assert wiki.tag_backlinks("t").count() == 1 and wiki.tag_backlinks("nothing").count() == 0


def test_lint(wiki):
    got = rows(wiki.lint("all", now=100 + 181 * 86400).select("rule", "path", "message"))
    assert ("self-link", "Home.md", "note links to itself") in got
    assert ("overlinking", "Home.md", "link [[book/a]] appears 2 times") in got
    assert ("broken-link", "Home.md", "broken wikilink: [[gone]]") in got
    assert [r[1] for r in got if r[0] == "lonely"] == ["a.md", "b.md"] and [r[1] for r in got if r[0] == "dead-end"] == ["a.md", "b.md"]
    assert [r[1] for r in got if r[0] == "broken-heading-ref"] == ["book/a.md"]
    assert [r[1:] for r in got if r[0] == "stale-by-git"] == [("Home.md", "note not updated in 181 days"), ("a.md", "note not updated in 181 days"), ("book/a.md", "note not updated in 180 days")]
    span = wiki.lint(["self-link"]).select("span_begin", "span_end").collect()[0]
    assert tuple(span) == (36, 44) and wiki.lint(["dead-end"]).count() == 2
    with pytest.raises(ValueError):
        wiki.lint(["nonsense"])


def test_get(wiki):
    r = wiki.get("a", ["book"], "title,body,headings", heading="one").collect()[0]
    assert r["body"].strip() == "body one" and list(r["headings"]) == []
    assert wiki.get("Home", fields="tags").collect()[0]["tags"] == ["t/u/v", "t/u"]
    assert parse_fields(" title, ,title,body") == ["title", "body"] and parse_fields(None) == ["title", "ctx", "body"]
    with pytest.raises(UnknownField):
        parse_fields("x")
    with pytest.raises(SectionNotFound):
        wiki.get("Home", heading="nothing")
    with pytest.raises(UnknownField):
        wiki.get("Home", fields="links", allowed=PUBLIC_FIELDS)


def test_get_takes_the_heading_as_it_is_shown(spark):
    w = Wiki(spark.createDataFrame([("n", None, "# N\n\n## Spec Part: *two*\n\nbody\n\n## Next\n\nrest\n")], "title string, ctx array<string>, md_text string"))
    for heading in ("Spec Part: two", "spec-part-two", "SPEC  part two"):
        assert w.get("n", heading=heading).collect()[0]["body"].strip() == "body"
    assert list(w.get("n", fields="headings").collect()[0]["headings"][1]) == [2, "Spec Part: two", 3, "N"]


def test_todo_search_json(wiki):
    assert [r["text"] for r in wiki.todo().collect()] == ["task one"] and wiki.todo("done").count() == 0
    assert [r["title"] for r in wiki.search("tsk").collect()] == ["Home"]
    assert wiki.search("tsk zzz", logic="and").count() == 0 and wiki.search("tsk zzz").count() == 1
    assert wiki.search("", num=2).count() == 2 and wiki.search("  ", logic="and").count() == 4 and wiki.search("  ").count() == 0
    assert wiki.results_json(wiki.search("tsk")).collect()[0]["json"] == '{"results":[{"title":"Home","ctx":null}],"count":1}'
    assert search.score_one("The Task", "task") > search.score_one("t-a-s-k", "task") > 0 and search.score_one("task", "Task") == 0


def test_embed_closure_ends_on_cycles(wiki, spark):
    assert graph.closure(graph.embed_edges(wiki.notes, wiki.parsed)).count() == 4
    chain = spark.createDataFrame([(str(i), str(i + 1)) for i in range(5)], "src string, dst string")
    assert graph.closure(chain).count() == 15
    assert graph.closure(chain.limit(0)).count() == 0


def test_index_order_and_pages(wiki, spark):
    got = [(r["name"], r["row"]) for r in wiki.index().orderBy("row").collect()]
    assert got == [("book/a", 1), ("a", 2), ("Home", 3), ("b", 4)]
    placed = site.positions(spark.range(95).select(F.col("id").alias("name")), [F.desc("name")])
    pages = site.pages(placed, 10)
    assert pages.where("name = 94").collect()[0]["row"] == 1 and pages.agg(F.max("page")).collect()[0][0] == 10
    assert rows(site.pointers(pages))[0] == (1, "./", None, "./2.html")
    with pytest.raises(ValueError):
        site.pages(placed, 0)


def test_expressions(spark):
    one = spark.createDataFrame([("a//b/c", [1, 2, 3, 4, 5], 1714566600, "<b>x</b> < y")], "p string, a array<int>, t bigint, h string")
    r = one.select(
        X.key_title("p"), F.array_join(X.key_ctx("p"), "/"), X.array_part("a", 1, -1, 2), X.array_part("a", 4, 2), X.date_text("t", "%Y-%m-%d %H:%M", "Asia/Tokyo"),
        X.strip_tags("h"), X.html_escape("h"), X.slug_dash(F.lit(" What's: New? ")), X.base_url(F.lit("https://e/x//")), X.url_host(F.lit("https://e.example/a")), X.url_host(F.lit("no")), X.bounded(F.lit("a/b/c/d"))).collect()[0]
    assert tuple(r) == ("c", "a/b", [2, 4], [], "2024-05-01 21:30", "x < y", "&lt;b&gt;x&lt;/b&gt; &lt; y", "what-single-quote-s-colon-new-question", "https://e/x/", "e.example", None, False)
    with pytest.raises(ValueError):
        X.date_text("t", "%Q")


def test_folder_source_and_site(spark, tmp_path):
    for path, text in {"README.md": "intro", "_draft.md": "", "a b%20#.md": "[[x/é]]", "x/é.md": "# É\n\n#[[t]]", ".hidden.md": "no", "static/s.md": "no", "x/static/t.md": "yes"}.items():
        (tmp_path / path).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / path).write_text(text, encoding="utf-8")
    git = ["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t"]
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    subprocess.run([*git, "add", "x"], check=True)
    subprocess.run([*git, "commit", "-qm", "m"], check=True)
    notes = markdown_files.read_notes(spark, str(tmp_path))
    assert [r["path"] for r in notes.orderBy("path").collect()] == ["README.md", "_draft.md", "a b%20#.md", "x/static/t.md", "x/é.md"]
    assert [r["md_text"] for r in notes.where("path = '_draft.md'").collect()] == [""]
    site_rows, readme = markdown_files.split_readme(notes)
    assert site_rows.count() == 4 and readme.count() == 1
    known = {r["path"]: r["committed_ts"] for r in commits.with_commits(spark, notes, str(tmp_path)).collect()}
    assert known["x/é.md"] and known["README.md"] is None and not commits.is_repository("/")
    w = Wiki.from_folder(spark, str(tmp_path), config.Config(base_url="https://e/", paginate_by=2), git=True)
    n = site_writer.build(w, str(tmp_path / "_site"))
    assert n == 2 + 4 + 1 + 1 and "intro" in (tmp_path / "_site/index.html").read_text()
    assert "Backlinks" in (tmp_path / "_site/notes/x/é.html").read_text() and (tmp_path / "_site/search_index.json").read_text().startswith('[{"title"')


def test_config(tmp_path):
    made = config.init(str(tmp_path))
    assert config.load(made[0]).base_url == "https://example.com/" and not config.init(str(tmp_path))
    bad = tmp_path / "bad.toml"
    for text in ("x = ", 'timezone = "No/Where"', "[ssg]\npaginate_by = 0", 'lang_code = "xyz"', '[ssg]\nsort_key = "x"'):
        bad.write_text(text)
        with pytest.raises(config.ConfigError):
            config.load(str(bad))
    with pytest.raises(config.ConfigError):
        config.wiki_dir(str(tmp_path / "none"))


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([("n", None, "#[[a]]", 1), ("n", None, "#[[b]]", 2)], "title string, ctx array<string>, md_text string, version bigint").coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema("title string, ctx array<string>, md_text string, version bigint").parquet(str(src))
    ingest.follow(stream, str(tmp_path / "out"), str(tmp_path / "ck"), once=True).awaitTermination(120)
    now = ingest.current(spark, str(tmp_path / "out"))
    assert [r["dst_name"] for r in extract.refs(now).collect()] == ["b"]


def test_tags_by_window(spark, tmp_path):
    day = lambda n, h=0: datetime(2024, 1, n, h)
    rows_in = [("n", None, "#[[a]] #[[a]]", day(1)), ("m", None, "#[[a]] #[[b]]", day(1, 5)), ("n", None, "plain", day(2)), ("n", None, "#[[b]]", day(3))]
    spark.createDataFrame(rows_in, "title string, ctx array<string>, md_text string, changed_at timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("title string, ctx array<string>, md_text string, changed_at timestamp").parquet(str(tmp_path / "in"))
    ingest.tag_activity(stream).writeStream.format("memory").queryName("activity").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination(120)
    got = {(r["window"]["start"].day, r["tag"]): r["n"] for r in spark.table("activity").collect()}
    assert got == {(1, "a"): 3, (1, "b"): 1, (3, "b"): 1}


def test_empty_wiki(spark):
    w = Wiki(spark.createDataFrame([], "title string, ctx array<string>, md_text string"))
    assert w.tags().count() == 0 and w.index().count() == 0 and w.lint().count() == 0 and w.todo("all").count() == 0
    assert lint.RULES[-1] == "stale-by-git"


def test_embeds_are_expanded_whatever_their_size(spark, monkeypatch):
    monkeypatch.setattr(site_writer, "EMBED_CHARS", 10, raising=False)  # the size switch of old, if it comes back
    long = "word " * 5000
    notes = [("page", None, "![[long0]] ![[x/mid]] ![[gone]]")] + [(f"long{i}", None, f"{long}end{i}\n\n![[long{i + 1}]]") for i in range(3)] + [("mid", ["x"], "![[page]] tail ![[empty]]"), ("empty", None, None)]
    w = Wiki(spark.createDataFrame(notes, "title string, ctx array<string>, md_text string"))
    html = {r["rel_path"]: r["html"] for r in site_writer.note_pages(w).collect()}
    page = html["notes/page.html"]
    assert not any("![[" in x for x in html.values())
    assert "end0" in page and "end1" in page and "end2" in page and "tail" in page
    assert page.count("embed-missing") == 4 and '<div class="embed-missing">gone</div>' in page and '<div class="embed-missing">long3</div>' in page
    assert html["notes/empty.html"].count("embed") == 0


def test_embed_closure_has_no_greatest_depth(spark):
    n = 130
    chain = spark.createDataFrame([(f"{i:03}", f"{i + 1:03}") for i in range(n)], "src string, dst string")
    assert rows(graph.closure(chain)) == [(f"{i:03}", f"{j:03}") for i in range(n) for j in range(i + 1, n + 1)]
    ring = spark.createDataFrame([(str(i), str((i + 1) % 9)) for i in range(9)], "src string, dst string")
    assert graph.closure(ring).count() == 81


def test_a_parse_of_some_parts_equals_the_whole_one(wiki):
    whole = rows(extract.refs(wiki.parsed, "tag").drop("pos", "span", "head_span"))
    assert rows(extract.refs(extract.parse(wiki.notes, "tags"), "tag").drop("pos", "span", "head_span")) == whole != []
    kept = extract.parse(wiki.notes, "links", "headings", keep=("title", "committed_ts"), spans=True)
    assert kept.count() == wiki.notes.count() and kept.columns[:3] == ["key", "title", "committed_ts"]
    assert extract.parse(wiki.notes, "tasks").count() == 1 and rows(graph.edges(kept)) == rows(wiki.edges)


def test_slugs_take_any_white_space_and_agree(spark):
    texts = ["a\u3000b", "\u00a0 a\u00a0 b\u2003", "A\tb/c!", "--x--", "", "\u2028", "é É", "a-\u3000-b", "ΟΔΟΣ ΣΑΣ"]
    register(spark)
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", X.slug_dash("t").alias("d"), X.slug_heading("t").alias("h"), F.expr("wiki_slug(t)").alias("sd"), F.expr("wiki_heading_slug(t)").alias("sh")).collect():
        assert r["d"] == r["sd"] == html.slug(r["t"]) and r["h"] == r["sh"] == markdown.heading_slug(r["t"])
    assert html.slug("a\u3000b") == markdown.heading_slug("a\u3000b") == "a-b"


def test_functions_for_sql(spark, wiki):
    register(spark)
    wiki.notes.createOrReplaceTempView("n")
    found = spark.sql("SELECT n.name, r.title FROM n, LATERAL wiki_refs(n.md_text) r WHERE r.kind = 'link'")
    assert rows(found) == rows(extract.refs(wiki.parsed, "link").join(wiki.notes.select("key", "name"), "key").select("name", "title"))
    one = spark.sql("SELECT wiki_key(array('a', 'b'), 'c') = concat('a', char(1), 'b', char(1), 'c'), wiki_name(array('a'), 'c'), wiki_escape('<\"&'), wiki_strip_tags('<b>x'), trim(wiki_section('# a b\n\nt', 'a-b')), (SELECT count(*) FROM wiki_tasks('- [ ] x'))").collect()[0]
    assert tuple(one)[:4] == (True, "a/c", "&lt;&quot;&amp;", "x") and one[4].strip() == "t" and one[5] == 1


def test_read_tools(wiki):
    assert tools.call(wiki, "get_note", title="Home", fields="title,ctx") == {"title": "Home", "ctx": None}
    assert tools.call(lambda: wiki, "lookup_note_backlinks", title="Home")["count"] == 2 and tools.call(wiki, "list_tags")["results"][0] == {"title": "t", "backlinks_count": 1}
    assert tools.call(wiki, "search_notes", query="tsk")["count"] == 1 and tools.call(wiki, "lookup_tag_backlinks", tag="t/u")["count"] == 1 and tools.call(wiki, "lookup_note_links", title="Home")["count"] == 3
    for code, tool, params in ((-32602, "get_note", {"title": "Home", "fields": "links"}), (-32004, "get_note", {"title": "none"}), (-32004, "get_note", {"title": "Home", "heading": "x"}), (-32006, "lookup_note_backlinks", {"title": "none"}), (-32004, "search_notes", {"query": "x", "logic": "xor"})):
        with pytest.raises(tools.ToolError) as e:
            tools.call(wiki, tool, **params)
        assert e.value.code == code
    with pytest.raises(tools.ToolError) as e:
        tools.call(lambda: 1 / 0, "list_tags")
    assert e.value.code == -32003


def test_json_of_scalars_and_zones(spark):
    r = spark.range(1).select(X.json_value(F.lit('a"b')), X.json_value(F.lit(1)), X.json_value(F.lit(None).cast("string")), X.json_value(F.array(F.lit(1)))).collect()[0]
    assert tuple(r) == ('"a\\"b"', "1", "null", "[1]")
    with pytest.raises(ValueError):
        X.date_text("t", "%Y", "No/Where")


def test_hub_pages_links_and_stale_pages(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(site_writer, "PER_PAGE", 5)
    monkeypatch.setattr(site_writer.dealt, "__defaults__", (5,))
    notes = [("Hub", None, "hub text")] + [(f"n\u3000{i}", ["c x"], f"**see** [[Hub#top|h]] #[[big/t{i}]] [[c x/n\u00a0{i}]]" + (" ![p](https://e.x/p.png)" if i % 2 else "")) for i in range(23)]
    notes += [(f"n\u00a0{i}", ["c x"], "") for i in range(23)]
    w = Wiki(spark.createDataFrame(notes, "title string, ctx array<string>, md_text string"), config.Config(base_url="https://e/", title="W"))
    out = tmp_path / "_site"
    n = site_writer.build(w, str(out))
    files = {str(p.relative_to(out)) for p in out.rglob("*.html")}
    assert n == len(files)
    hubs = [(out / f).read_text() for f in files if f.startswith("notes/hub")]
    assert len(hubs) == 5 and sum(h.count('class="summary"') for h in hubs) == 12 and sum(h.count("p.png") for h in hubs) == 11 and any("see h #big/t0" in h for h in hubs)
    assert sum((out / f).read_text().count("<li>") for f in files if f.startswith("tags/big") and not f.startswith("tags/big/")) == 23
    for f in files:  # every link of the site leads to a file
        for u in re.findall(r'href="https://e/([^"#]*)', (out / f).read_text()):
            assert u in files, (f, u)
    index = (out / "index.html").read_text()
    assert index.count("<li>") == 47 + 15 and index.endswith("</html>\n")
    assert len(json.loads((out / "search_index.json").read_text())) == 47
    assert (out / "tag-index").exists() is False and "prefers-color-scheme" in (out / "main.css").read_text()
    (out / "mine.html").write_text("kept")
    fewer = Wiki(spark.createDataFrame(notes[:1], "title string, ctx array<string>, md_text string"), config.Config(base_url="https://e/", paginate_by=10, color_scheme="only_dark"))
    (tmp_path / "static").mkdir()
    (tmp_path / "static/main.css").write_text("own {}")
    assert site_writer.build(fewer, str(out), static=str(tmp_path / "static")) == 3 and (out / "main.css").read_text() == "own {}"
    assert site_writer.build(fewer, str(out)) == 3
    assert {str(p.relative_to(out)) for p in out.rglob("*.html")} == {"mine.html", "index.html", "notes/hub.html", "tags/index.html"}
    assert "prefers" not in (out / "main.css").read_text()


def test_tag_index_has_pages(spark):
    w = Wiki(spark.createDataFrame([("n", None, " ".join(f"#[[t{i:03}]]" for i in range(205)))], "title string, ctx array<string>, md_text string"), config.Config(base_url="https://e"))
    pages = {r["rel_path"]: r["html"] for r in site_writer.tag_index(w).collect()}
    assert {k: v.count("<li>") for k, v in pages.items()} == {"tags/index.html": 101, "tag-index/2.html": 101, "tag-index/3.html": 5}
    assert 'href="https://e/tag-index/2.html">More...' in pages["tags/index.html"] and "More" not in pages["tag-index/3.html"]


def test_a_closed_wiki_leaves_no_tables(spark):
    with Wiki(spark.createDataFrame(NOTES, "title string, ctx array<string>, md_text string, committed_ts bigint")) as w:
        assert w.backlink_counts().count() == 4
        folders = [x[1] for x in scratch._MADE if any(x[1] in f for f in [*w.parsed.inputFiles(), *w.edges.inputFiles()])]
    assert len(folders) == 2 and not any(os.path.exists(f.removeprefix("file:")) for f in folders)


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    (tmp_path / "x").mkdir()
    (tmp_path / "x/a.md").write_text("# A b\n\n- [ ] do it\n\n#[[t]] #[[s]]\n\n## Part Two\n\nbody\n")
    monkeypatch.setattr(type(spark), "stop", lambda self: None)
    run = lambda *a: (cli.main(["-C", str(tmp_path), *a]), capsys.readouterr().out)[1]
    assert run("todo") == "open\tx/a\t3\tdo it\n"
    assert run("tag", "list") == "t\t1\ns\t1\n"
    assert json.loads(run("--json", "tag", "list")) == {"results": [{"title": "s", "backlinks_count": 1}, {"title": "t", "backlinks_count": 1}], "count": 2}
    assert run("--table", "todo").splitlines() == ["status  note  line  text", "------  ----  ----  -----", "open    x/a   3     do it"] and run("--table", "search", "zzzz") == ""
    assert "body" in run("get", "a", "--ctx", "x", "--heading", "Part Two", "--fields", "body") and run("search", "zzzz") == ""


def test_folders_are_walked_by_workers(spark, tmp_path, monkeypatch):
    want = set()
    for i in range(7):
        for path in (f"d{i}/n{i}.md", f"d{i}/e/static/n.md", f"m{i}.md"):
            (tmp_path / path).parent.mkdir(exist_ok=True, parents=True)
            (tmp_path / path).write_text(path)
            want.add(path)
    (tmp_path / "static").mkdir()
    (tmp_path / "static/no.md").write_text("no")
    for most in (1, 3, 256):
        monkeypatch.setattr(markdown_files, "FOLDERS", most)
        reader = markdown_files.Reader({"path": str(tmp_path), "exclude": "static"})
        parts = reader.partitions()
        assert sum(p.folder is not None for p in parts) >= (most == 3) * 3 and {r[3] for p in parts for r in reader.read(p)} == {p for p in want}


def test_tables_and_preview(tmp_path):
    assert display.width("\x1b[31mab\x1b[0m") == 2
    assert display.table(["a", "url", "b"], [["x", "", "1"], ["\x1b[1mlong\x1b[0m", "", "2"]]) == ["a     b", "----  -", "x     1", "\x1b[1mlong\x1b[0m  2"] and display.table(["a"], []) == []
    (tmp_path / "index.html").write_text("hello")
    with display.server(str(tmp_path), 0) as s:
        threading.Thread(target=s.handle_request).start()
        with urllib.request.urlopen(f"http://127.0.0.1:{s.server_port}/index.html", timeout=10) as r:
            assert r.read() == b"hello"


def test_rpc(wiki):
    def ask(method, id=1, **params):
        return rpc.respond(wiki, {"jsonrpc": "2.0", "id": id, "method": method, "params": params})

    assert ask("initialize")["result"]["serverInfo"]["name"] == "notegrid" and ask("ping")["result"] == {} and ask("none")["error"]["code"] == -32601
    listed = {t["name"]: t["inputSchema"] for t in ask("tools/list")["result"]["tools"]}
    assert len(listed) == 6 and listed["search_notes"] == {"type": "object", "properties": {"query": {"type": "string"}, "num": {"type": "integer"}, "logic": {"type": "string"}}, "required": ["query"]}
    found = ask("tools/call", name="lookup_note_backlinks", arguments={"title": "Home"})["result"]
    assert json.loads(found["content"][0]["text"])["count"] == 2 and found["isError"] is False
    assert ask("tools/call", name="lookup_note_backlinks", arguments={"title": "no"})["error"]["code"] == -32006
    for bad in ({"name": "x"}, {"name": "list_tags", "arguments": {"y": 1}}, {"name": "get_note"}):
        assert ask("tools/call", **bad)["error"]["code"] == -32602
    assert rpc.respond(wiki, {"method": "notifications/initialized"}) is None and all(rpc.respond(wiki, x)["error"]["code"] == -32600 for x in (None, [], {"id": 1}, {"method": 1}))
    out = io.StringIO()
    rpc.lines(wiki, io.StringIO('{"id": 1, "method": "ping"}\n\nnonsense\n{"method": "n"}\n'), out)
    assert [json.loads(x).get("id") for x in out.getvalue().splitlines()] == [1, None]
    with rpc.server(wiki, 0) as s:
        threading.Thread(target=s.serve_forever, daemon=True).start()

        def post(path, body, **headers):
            try:
                with urllib.request.urlopen(urllib.request.Request(f"http://127.0.0.1:{s.server_port}{path}", body.encode(), headers), timeout=60) as r:
                    return r.status, r.read()
            except urllib.error.HTTPError as e:
                return e.code, b""

        assert json.loads(post("/mcp", '{"id": 7, "method": "ping"}')[1]) == {"jsonrpc": "2.0", "id": 7, "result": {}}
        assert post("/mcp", '{"method": "n"}')[0] == 202 and post("/other", "{}")[0] == 404 and post("/mcp", "{}", Host="evil.example:80")[0] == 403
        s.shutdown()


def test_long_lists_are_dealt_to_pages_without_gaps(spark):
    df = spark.createDataFrame([("hub", i) for i in range(40)] + [("one", 1), (None, 2)], "k string, v bigint")
    got = site_writer.dealt(df, "k", "v", F.struct("v"), 2).where("k is not null").collect()
    hub = [r for r in got if r["k"] == "hub"]
    assert sorted(r["page"] for r in hub) == list(range(len(hub))) and {r["pages"] for r in hub} == {len(hub)} and len(hub) > 9
    assert sorted(x["v"] for r in hub for x in r["x"]) == list(range(40)) and [(r["page"], r["pages"]) for r in got if r["k"] == "one"] == [(0, 1)]
