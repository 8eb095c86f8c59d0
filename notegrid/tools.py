"""The six read tools over a wiki: plain values in, plain values out, errors with codes. A transport can be put before ``call``.

    call(wiki, "get_note", title="Home", fields="title,body")
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame

from notegrid.operators.graph import NoteNotFound
from notegrid.wiki import PUBLIC_FIELDS, SectionNotFound, UnknownField, Wiki

# Codes of errors.
BAD_FIELD, LOAD, EXECUTE, BACKLINKS, TAG_BACKLINKS = -32602, -32003, -32004, -32006, -32008


class ToolError(Exception):
    """A failed call; ``code`` tells what failed."""

    def __init__(self, code: int, message: str) -> None:
        super().__init__(message)
        self.code, self.message = code, message


def _ctx(ctx: str | None) -> list[str] | None:
    return ctx.split("/") if ctx else None


def _results(rows: DataFrame) -> dict:
    found = [json.loads(r["json"]) for r in Wiki.json_lines(rows).collect()]
    return {"results": found, "count": len(found)}


def get_note(w: Wiki, title: str, ctx: str | None = None, fields: str | None = None, heading: str | None = None) -> dict:
    return json.loads(Wiki.json_lines(w.get(title, _ctx(ctx), fields, heading, PUBLIC_FIELDS)).collect()[0]["json"])


def search_notes(w: Wiki, query: str, num: int = 100, logic: str = "or") -> dict:
    return _results(w.search(query, num, logic))


def lookup_note_links(w: Wiki, title: str, ctx: str | None = None) -> dict:
    return _results(w.links(title, _ctx(ctx)))


def lookup_note_backlinks(w: Wiki, title: str, ctx: str | None = None) -> dict:
    return _results(w.backlinks(title, _ctx(ctx)))


def list_tags(w: Wiki) -> dict:
    return _results(w.tags())


def lookup_tag_backlinks(w: Wiki, tag: str) -> dict:
    return _results(w.tag_backlinks(tag))


#: Tools and the code of a call that fails.
TOOLS: dict[str, tuple[Callable[..., Any], int]] = {
    "get_note": (get_note, EXECUTE), "search_notes": (search_notes, EXECUTE), "lookup_note_links": (lookup_note_links, EXECUTE),
    "lookup_note_backlinks": (lookup_note_backlinks, BACKLINKS), "list_tags": (list_tags, EXECUTE), "lookup_tag_backlinks": (lookup_tag_backlinks, TAG_BACKLINKS),
}


def call(wiki: Wiki | Callable[[], Wiki], tool: str, **params: Any) -> dict:
    """Result of a tool; ``wiki`` may be a call that loads one. Whatever fails is a ``ToolError``."""
    if tool not in TOOLS:
        raise ToolError(EXECUTE, f"unknown tool {tool!r}")
    run, code = TOOLS[tool]
    try:
        w = wiki() if callable(wiki) else wiki
    except Exception as e:
        raise ToolError(LOAD, f"the wiki can't be read: {e}") from e
    try:
        return run(w, **params)
    except UnknownField as e:
        raise ToolError(BAD_FIELD, f"unknown field {e}; allowed: {', '.join(PUBLIC_FIELDS)}") from e
    except NoteNotFound as e:
        raise ToolError(code, f"note not found: {e}") from e
    except SectionNotFound as e:
        raise ToolError(code, f"heading not found: {e}") from e
    except Exception as e:
        raise ToolError(code, str(e)) from e
