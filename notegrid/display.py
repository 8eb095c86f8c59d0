"""Text tables and a preview of the site for the command line."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import partial
from http.server import SimpleHTTPRequestHandler, ThreadingHTTPServer

_COLOR = re.compile(r"\x1b[^m]*m?")
HOST, PORT = "127.0.0.1", 1112


def width(text: str) -> int:
    """Characters of a text as a terminal shows it: marks of colour take no room."""
    return len(_COLOR.sub("", text))


def table(names: list[str], rows: Iterable[Iterable[str]]) -> list[str]:
    """Lines of a table; a column without any value is left out, and no rows are no lines."""
    body = [list(r) for r in rows]
    if not body:
        return []
    shown = [k for k in range(len(names)) if any(r[k] for r in body)]
    size = [max(width(x) for x in (names[k], *(r[k] for r in body))) for k in shown]
    lines = [[names[k] for k in shown], ["-" * n for n in size], *([r[k] for k in shown] for r in body)]
    return ["  ".join(x + " " * (n - width(x)) for x, n in zip(line, size)).rstrip() for line in lines]


def server(folder: str, port: int = PORT) -> ThreadingHTTPServer:
    """A server of the files of a built site, for this machine only; ``serve_forever`` runs it."""
    return ThreadingHTTPServer((HOST, port), partial(SimpleHTTPRequestHandler, directory=folder))
