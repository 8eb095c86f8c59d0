"""Notes as HTML from the blocks and inline pieces of the scanner; plain Python, run per partition.

Tables, struck-out text, superscript, footnotes, math between dollars and URLs
without brackets are known besides plain Markdown. Embeds are expanded on a stack
of their own, so a chain of them may be of any length.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Generator
from urllib.parse import urlsplit

from notegrid.functions import markdown as md
from notegrid.functions.expr import SIGN_WORDS, WHITE

_DELIMITER = re.compile(r"[ \t]*\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
_CELL = re.compile(r"(?:[^\\|]|\\.)*+")
_NOTE = re.compile(r"\[\^([^\s\[\]]+)\]:[ \t]*")
_ALIGN = {(False, False): "", (True, False): ' align="left"', (False, True): ' align="right"', (True, True): ' align="center"'}
_TAGS = {1: ("<em>", "</em>"), 2: ("<strong>", "</strong>"), 3: ("<em><strong>", "</strong></em>")}
Steps = Generator[tuple, str, str]


def slug(text: str) -> str:
    out = re.sub(f"^{WHITE}+|{WHITE}+$", "", text).lower()
    for sign, word in SIGN_WORDS.items():
        out = out.replace(sign, f"-{word}-")
    return re.sub(r"-+", "-", re.sub(f"{WHITE}+", "-", out)).strip("-")


def escape(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")


def cells(line: str) -> list[str]:
    """Cells of a table row; a bar after a backslash is text."""
    out, at, line = [], 0, line.strip(" \t")
    at = int(line.startswith("|"))
    while True:
        m = _CELL.match(line, at)
        at = m.end() + 1
        if m.end() >= len(line):
            if m[0].strip() or not out:
                out.append(m[0].strip())
            return out
        out.append(m[0].strip().replace("\\|", "|"))


def card(url: str) -> str:
    """A link that stands alone."""
    return f'<div class="link-card" data-url="{escape(url)}" data-host="{escape(urlsplit(url).hostname or "")}"><a href="{escape(url)}" rel="noopener noreferrer">{escape(url)}</a></div>'


class Renderer:
    """``texts`` finds the text of an embedded note by (ctx, title); without it embeds stay as they are written."""

    def __init__(self, base: str, texts: Callable[[tuple[str, ...], str], str | None] | None = None, folder: str = "notes") -> None:
        self.base, self.texts, self.folder = base.rstrip("/") + "/", texts, folder

    def href(self, ctx: list[str], title: str, heading: str | None = None) -> str:
        stem = "/".join(slug(x) for x in [*ctx, title])
        return f"{self.base}{self.folder}/{stem}.html" + (f"#{slug(heading)}" if heading else "")

    def content(self, text: str) -> list[tuple[str, str]]:
        """Root elements: ("autolink", url) for a paragraph that is one bare link, else ("raw", html)."""
        return self._run(self._blocks(text, []), [])

    def render(self, text: str) -> str:
        return _joined(self.content(text))

    def _run(self, steps: Steps, path: list[tuple]) -> list[tuple[str, str]]:
        """Drive the steps; each asks for an embed, which is answered at once or rendered first."""
        stack, answer = [steps], None
        while True:
            try:
                ctx, title, heading = stack[-1].send(answer)
            except StopIteration as done:
                stack.pop()
                if not stack:
                    return done.value
                path.pop()
                answer = f'<div class="embed">{_joined(done.value)}</div>'
                continue
            key = (*ctx, title)
            text = None if key in path else self.texts(tuple(ctx), title)
            if text is None:
                answer = f'<div class="embed-{"cycle" if key in path else "missing"}">{escape("/".join(key))}</div>'
                continue
            if heading and (part := md.section(text, md.heading_slug(heading))) is not None:
                text = part
            path.append(key)
            stack.append(self._blocks(text, path))
            answer = None

    def _blocks(self, text: str, path: list[tuple]) -> Steps:
        """Steps that end with the root elements of a text."""
        blocks = list(md.events(text or ""))
        notes = _Notes(blocks)
        out = _Out()
        for e in blocks:
            kind = e[0]
            if kind == "p":
                body = e[1]
                if _NOTE.match(body):
                    continue
                box = ""
                if e[3] and (m := md._TASK.match(body)) and m[1] in md.STATUS:
                    box = f'<input type="checkbox" disabled class="task-{md.STATUS[m[1]]}"{" checked" if m[1] in "xX" else ""}> '
                    body = body[m.end() :]
                elif len(out.open) == 1 and (url := _alone(body)):
                    out.url(url)
                    continue
                before, table = _table(body)
                if before:
                    inner = yield from self._inline(before, notes)
                    out.block(box + inner if out.open[-1][0] == "item" else f"<p>{inner}</p>")
                if table:
                    out.block((yield from self._rows(table, notes)))
            elif kind == "h":
                out.block(f'<h{e[1]} id="{md.heading_slug(_plain(e[2]))}">' + (yield from self._inline(e[2], notes)) + f"</h{e[1]}>")
            elif kind == "code":
                if e[1] == "mermaid":
                    out.block(f'<div class="mermaid">{escape(e[2])}</div>')
                else:
                    language = f' class="language-{escape(e[1])}"' if e[1] else ""
                    out.block(f"<pre><code{language}>{escape(e[2])}</code></pre>")
            elif kind == "hr":
                out.block("<hr>")
            elif kind == "raw":
                out.block(e[1])
            elif kind == "quote":
                out.enter("quote", "<blockquote>")
            elif kind == "item":
                out.item(e[1])
            else:
                out.leave("</blockquote>" if kind == "/quote" else "</li>")
        if notes.used:
            items = []
            for name in notes.used:  # grows while notes refer to others
                items.append(f'<li id="fn-{escape(name)}">' + (yield from self._inline(notes.text[name], notes)) + f' <a href="#fnref-{escape(name)}">↩</a></li>')
            out.block('<section class="footnotes"><ol>' + "".join(items) + "</ol></section>")
        return out.elements()

    def _rows(self, table: list[str], notes: _Notes) -> Steps:
        head, marks = cells(table[0]), [_ALIGN[c.startswith(":"), c.endswith(":")] for c in cells(table[1])]
        out = []
        for tag, row in (("th", head), *(("td", cells(x)) for x in table[2:])):
            line = ""
            for text, align in zip([*row, *[""] * len(head)], marks):
                line += f"<{tag}{align}>" + (yield from self._inline(text, notes)) + f"</{tag}>"
            out.append(f"<tr>{line}</tr>")
        body = f'<tbody>{"".join(out[1:])}</tbody>' if len(out) > 1 else ""
        return f"<table><thead>{out[0]}</thead>{body}</table>"

    def _inline(self, text: str, notes: _Notes) -> Steps:
        out: list[str] = []
        skip = 0  # inside images, whose text is in alt
        for t in md.tokens(text, rich=True):
            kind = t[0]
            if kind == "image":
                if not skip:
                    out.append(f'<img src="{escape(t[2])}" alt="{escape(t[3])}">')
                skip += 1
            elif kind == "/image":
                skip -= 1
            elif skip:
                continue
            elif kind == "text":
                out.append(escape(t[2]))
            elif kind == "nl":
                out.append("\n")
            elif kind == "entity":
                out.append(escape(html.unescape(t[2])))
            elif kind == "code":
                code = t[2].replace("\n", " ")
                out.append(f"<code>{escape(code[1:-1] if len(code) > 2 and code[0] == code[-1] == ' ' and code.strip() else code)}</code>")
            elif kind == "auto":
                out.append(f'<a href="{"mailto:" if "@" in t[2] and ":" not in t[2] else ""}{escape(t[2])}">{escape(t[2])}</a>')
            elif kind == "tag":
                out.append(t[2])
            elif kind == "link":
                out.append(f'<a href="{escape(t[2])}">')
            elif kind == "/link":
                out.append("</a>")
            elif kind in ("strong", "/strong"):
                out.append(_TAGS[t[2]][kind[0] == "/"])
            elif kind in ("strike", "/strike", "super", "/super"):
                out.append(f'<{"/" * (kind[0] == "/")}{"del" if "strike" in kind else "sup"}>')
            elif kind == "math":
                out.append(f'<span data-math-style="{"display" if t[3] == 2 else "inline"}">{escape(t[2])}</span>')
            elif kind == "note":
                out.append(notes.mark(t[2]))
            elif kind == "wiki":
                ref = md.reference(t[2], t[3], t[4], 0)
                if t[2] == "!" and (self.texts is None or not ref):
                    out.append(escape("!" + t[5]))
                elif ref and ref[0] == "embed":
                    out.append((yield ref[1], ref[2], ref[3]))
                elif ref and ref[0] == "tag":
                    if out and out[-1].endswith("#"):
                        out[-1] = out[-1][:-1]
                    path = [*ref[1], ref[2]]
                    out.append(f'<a class="tag" href="{self.base}tags/{"/".join(map(slug, path))}.html">#{escape("/".join(path))}</a>')
                elif ref:
                    out.append(f'<a href="{self.href(ref[1], ref[2], ref[3])}">{escape(ref[4] or ref[2])}</a>')
                else:
                    out.append(escape(t[5]))
        return "".join(out)


class _Out:
    """Blocks written in order; each open container knows its kind, whether it has a block, and the list that its last block is."""

    def __init__(self) -> None:
        self.done: list[tuple[str, str]] = []
        self.parts: list[str] = []
        self.open: list[list] = [["", False, None]]

    def _next(self) -> None:
        """End the list that is open; a new block follows."""
        here = self.open[-1]
        if here[2] is not None:
            self.parts.append("</ol>" if here[2] else "</ul>")
            here[2] = None
        if len(self.open) > 1:
            if here[1]:
                self.parts.append("\n")
        elif self.parts:
            self.done.append(("raw", "".join(self.parts)))
            self.parts = []
        here[1] = True

    def block(self, text: str) -> None:
        self._next()
        self.parts.append(text)

    def url(self, url: str) -> None:
        self._next()
        self.done.append(("autolink", url))

    def enter(self, kind: str, tag: str) -> None:
        self.block(tag)
        self.open.append([kind, False, None])

    def item(self, number: bool) -> None:
        if self.open[-1][2] is not number:
            self._next()
            self.open[-1][2] = number
            self.parts.append("<ol>" if number else "<ul>")
        self.parts.append("<li>")
        self.open.append(["item", False, None])

    def leave(self, tag: str) -> None:
        here = self.open.pop()
        if here[2] is not None:
            self.parts.append("</ol>" if here[2] else "</ul>")
        self.parts.append(tag)

    def elements(self) -> list[tuple[str, str]]:
        self._next()
        return self.done


class _Notes:
    """Footnotes of a text: their texts by name, and the names in the order of their first marks."""

    def __init__(self, blocks: list[tuple]) -> None:
        self.text: dict[str, str] = {}
        self.used: list[str] = []
        for e in blocks:
            if e[0] == "p" and (m := _NOTE.match(e[1])):
                self.text.setdefault(m[1], e[1][m.end() :])

    def mark(self, name: str) -> str:
        if name not in self.text:
            return escape(f"[^{name}]")
        if again := name in self.used:
            n = self.used.index(name) + 1
        else:
            self.used.append(name)
            n = len(self.used)
        own = "" if again else f' id="fnref-{escape(name)}"'
        return f'<sup class="footnote-ref"><a href="#fn-{escape(name)}"{own}>{n}</a></sup>'


def _plain(text: str) -> str:
    return md.Scanner(frozenset()).inline(text, 0)


def _alone(body: str) -> str | None:
    """The URL, if the text is nothing but one."""
    body = body.strip()
    if not body.startswith(("<", "http")) or any(c.isspace() for c in body):
        return None
    parts = list(md.tokens(body, rich=True))
    return parts[0][2] if len(parts) == 1 and parts[0][0] == "auto" and "://" in parts[0][2] else None


def _table(body: str) -> tuple[str, list[str]]:
    """What stands before a table, and its lines: a head, a line of dashes with as many cells, and rows."""
    if "|" in body and "-" in body:
        lines = body.split("\n")
        for k in range(1, len(lines)):
            if "-" in lines[k] and "|" in lines[k - 1] and _DELIMITER.match(lines[k]) and len(cells(lines[k])) == len(cells(lines[k - 1])):
                return "\n".join(lines[: k - 1]), lines[k - 1 :]
    return body, []


def _joined(elements: list[tuple[str, str]]) -> str:
    return "\n".join(f"<p>{card(x)}</p>" if kind == "autolink" else x for kind, x in elements)
