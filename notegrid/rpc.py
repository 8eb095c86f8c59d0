"""The read tools over JSON-RPC 2.0: lines of a stream, or POST requests to /mcp of this machine only.

    python -m notegrid.cli -C FOLDER mcp serve [--http] [--port N]
"""

from __future__ import annotations

import inspect
import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import IO, Any

from notegrid.tools import TOOLS, ToolError, call

HOSTS, PORT, PATH = ("localhost", "127.0.0.1", "::1"), 1113, "/mcp"
#: A message longer than this is refused.
MOST_BYTES = 1 << 20
_DESCRIPTIONS = {
    "get_note": "One note by title and context; fields title, ctx, body, headings, code_blocks; heading narrows it to a section.",
    "search_notes": "Notes whose name or text matches the keywords, best first; logic is or or and.",
    "lookup_note_links": "Notes that a note links to or embeds, in the order of its text.",
    "lookup_note_backlinks": "Notes that link to a note.",
    "list_tags": "All tags and their ancestors with the number of notes, most used first.",
    "lookup_tag_backlinks": "Notes of a tag.",
}


def schema(tool: str) -> dict:
    """JSON schema of a tool's parameters, from its signature."""
    own = [p for p in inspect.signature(TOOLS[tool][0]).parameters.values() if p.name != "w"]
    kinds = {p.name: {"type": "integer" if str(p.annotation).startswith("int") else "string"} for p in own}
    return {"type": "object", "properties": kinds, "required": [p.name for p in own if p.default is p.empty]}


def respond(wiki: Any, message: Any) -> dict | None:
    """The answer to one message; None to a notification."""

    def answer(**what: Any) -> dict:
        return {"jsonrpc": "2.0", "id": message.get("id") if isinstance(message, dict) else None, **what}

    if not isinstance(message, dict) or not isinstance(message.get("method"), str) or not isinstance(message.get("params", {}), dict):
        return answer(error={"code": -32600, "message": "not a request"})
    if "id" not in message:
        return None
    method, params = message["method"], message.get("params", {})
    if method == "initialize":
        return answer(result={"protocolVersion": params.get("protocolVersion", "2025-03-26"), "capabilities": {"tools": {}}, "serverInfo": {"name": "notegrid", "version": "1"}})
    if method == "ping":
        return answer(result={})
    if method == "tools/list":
        return answer(result={"tools": [{"name": t, "description": _DESCRIPTIONS[t], "inputSchema": schema(t)} for t in TOOLS]})
    if method != "tools/call":
        return answer(error={"code": -32601, "message": f"unknown method {method!r}"})
    arguments = params.get("arguments") or {}
    known = schema(params["name"]) if params.get("name") in TOOLS else None
    if known is None or set(arguments) - set(known["properties"]) or set(known["required"]) - set(arguments):
        return answer(error={"code": -32602, "message": "unknown tool or parameters"})
    try:
        found = call(wiki, params["name"], **arguments)
    except ToolError as e:
        return answer(error={"code": e.code, "message": e.message})
    return answer(result={"content": [{"type": "text", "text": json.dumps(found, ensure_ascii=False)}], "isError": False})


def _parsed(text: str | bytes) -> Any:
    try:
        return json.loads(text)
    except ValueError:
        return None


def lines(wiki: Any, source: IO[str], to: IO[str]) -> None:
    """Answer messages, one a line, until the source ends."""
    for line in source:
        if line.strip() and (out := respond(wiki, _parsed(line))) is not None:
            to.write(json.dumps(out, ensure_ascii=False) + "\n")
            to.flush()


def server(wiki: Any, port: int = PORT) -> ThreadingHTTPServer:
    """A server that keeps no state between requests."""

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self) -> None:  # noqa: N802
            host = (self.headers.get("Host") or "").rpartition(":")[0] or self.headers.get("Host") or ""
            size = self.headers.get("Content-Length", "")
            if host.strip("[]").lower() not in HOSTS:
                return self.send_error(403)
            if self.path != PATH or not size.isdigit():
                return self.send_error(404 if self.path != PATH else 411)
            if int(size) > MOST_BYTES:
                return self.send_error(413)
            out = respond(wiki, _parsed(self.rfile.read(int(size))))
            body = b"" if out is None else json.dumps(out, ensure_ascii=False).encode()
            self.send_response(202 if out is None else 200)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_: Any) -> None:
            pass

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)
