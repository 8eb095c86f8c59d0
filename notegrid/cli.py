"""Command line: python -m notegrid.cli -C FOLDER COMMAND ..."""

from __future__ import annotations

import argparse
import os
import sys
import time

from notegrid import display, rpc
from notegrid.sources import config as cfg


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="notegrid")
    p.add_argument("-C", "--folder", default=os.environ.get("NOTEGRID_FOLDER", "."))
    p.add_argument("--json", action="store_true")
    p.add_argument("--table", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("init")
    build = sub.add_parser("build")
    build.add_argument("--git", action="store_true")
    serve = sub.add_parser("serve")
    serve.add_argument("--git", action="store_true")
    serve.add_argument("--port", type=int, default=display.PORT)
    for name in ("get", "links", "backlinks"):
        c = sub.add_parser(name)
        c.add_argument("title")
        c.add_argument("--ctx")
        if name == "get":
            c.add_argument("--fields")
            c.add_argument("--heading")
    s = sub.add_parser("search")
    s.add_argument("query")
    s.add_argument("--num", type=int, default=100)
    s.add_argument("--logic", choices=("and", "or"), default="or")
    t = sub.add_parser("todo")
    t.add_argument("--status", choices=("open", "done", "deferred", "all"), default="open")
    check = sub.add_parser("lint")
    check.add_argument("--rule", action="append")
    mcp = sub.add_parser("mcp").add_subparsers(dest="mcp_command", required=True).add_parser("serve")
    mcp.add_argument("--http", action="store_true")
    mcp.add_argument("--port", type=int, default=rpc.PORT)
    tag = sub.add_parser("tag").add_subparsers(dest="tag_command", required=True)
    tag.add_parser("list")
    tag.add_parser("backlinks").add_argument("tag")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    folder = cfg.wiki_dir(a.folder)
    if a.command == "init":
        print(*cfg.init(folder), sep="\n")
        return 0
    from pyspark.sql import SparkSession

    from notegrid.sources import site_writer
    from notegrid.wiki import PUBLIC_FIELDS, Wiki

    path = os.path.join(folder, ".notegrid.toml")
    config = cfg.load(path) if os.path.exists(path) else cfg.Config()
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    w = Wiki.from_folder(spark, folder, config, git=a.command == "lint" or getattr(a, "git", False))
    if a.command == "mcp":
        with w:
            if a.http:
                with rpc.server(w, a.port) as server:
                    print(f"http://127.0.0.1:{server.server_port}{rpc.PATH}", file=sys.stderr, flush=True)
                    server.serve_forever()
            else:
                rpc.lines(w, sys.stdin, sys.stdout)
        return 0
    ctx = a.ctx.split("/") if getattr(a, "ctx", None) else None
    if a.command in ("build", "serve"):
        print(site_writer.build(w, os.path.join(folder, config.output_dir), lambda x: print(x, file=sys.stderr), os.path.join(folder, "static")), "pages")
        w.close()
        if a.command == "serve":
            with display.server(os.path.join(folder, config.output_dir), a.port) as server:
                print(f"http://{display.HOST}:{server.server_port}/", flush=True)
                server.serve_forever()
        return 0
    listing = a.command == "tag" and a.tag_command == "list"
    rows = {
        "get": lambda: w.get(a.title, ctx, a.fields, a.heading, PUBLIC_FIELDS), "links": lambda: w.links(a.title, ctx), "backlinks": lambda: w.backlinks(a.title, ctx),
        "search": lambda: w.search(a.query, a.num, a.logic), "todo": lambda: w.todo(a.status), "lint": lambda: w.lint(a.rule, int(time.time())),
        "tag": lambda: (w.tags() if a.json else w.tags_for_text()) if listing else w.tag_backlinks(a.tag),
    }[a.command]()
    if a.json:
        print('{"results":[', end="")
        n = 0
        for r in w.json_lines(rows).toLocalIterator():
            print("," * bool(n) + r["json"], end="")
            n += 1
        print(f'],"count":{n}}}')
    else:
        todo = a.command == "todo"
        lines = (todo_line(r) if todo else [*map(shown, r)] for r in rows.toLocalIterator())
        names = ["status", "note", "line", "text"] if todo else rows.columns
        for line in display.table(names, lines) if a.table else map("\t".join, lines):
            print(line)
    w.close()
    return 0


def shown(x) -> str:
    return "" if x is None else "/".join(x) if isinstance(x, list) and all(isinstance(y, str) for y in x) else str(x)


def todo_line(r) -> list[str]:
    """Status, label of the note (context and title), line and text of a task."""
    return [r["status"], "/".join([*(r["ctx"] or []), r["title"]]), str(r["line"]), r["text"]]


if __name__ == "__main__":
    sys.exit(main())
