"""Markdown scanner for typed wiki notes; plain Python, no Spark.

``events`` reads the block structure (quotes, list items, fences, indented code,
headings, paragraphs) and ``tokens`` the inline text of a leaf: code spans,
escapes, images, links, emphasis and wiki references. Both keep what is open on a
stack of their own and find closing marks by maps or memory of failed searches,
so nesting has no limit and odd text takes no more than linear time. Lines
count from 1.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})[ \t]*(.*)$")
_ATX = re.compile(r" {0,3}(#{1,6})(?=[ \t]|$)")
_SETEXT = re.compile(r" {0,3}(=+|-+)[ \t]*$")
_RULE = re.compile(r" {0,3}([-*_])(?:[ \t]*\1){2,}[ \t]*$")
_QUOTE = re.compile(r" {0,3}> ?")
_QUOTES = re.compile(r"(?: {0,3}> ?)+")
_MARK = re.compile(r" {0,3}(?:[-+*]|\d{1,9}[.)]) {1,4}(?=\S)")
_ITEM = re.compile(r"( {0,3})([-+*]|\d{1,9}[.)])(?:([ \t]+)(.*)|[ \t]*)$")
_DEFINITION = re.compile(r" {0,3}\[(?!\^)(?:[^\[\]\\]|\\.)+\]:[ \t]*\S+[ \t]*(?:\"[^\"]*\"|'[^']*'|\([^)]*\))?[ \t]*$")
_RAW = re.compile(r" {0,3}(?:<(script|pre|style|textarea)(?:[\s>]|$)|(<!--)|</?(?:address|article|aside|blockquote|body|details|dialog|div|dl|fieldset|figure|footer|form|h[1-6]|header|hr|html|iframe|li|main|nav|ol|p|section|summary|table|tbody|td|th|thead|tr|ul)(?:[\s>]|/>|$))", re.I)
_TASK = re.compile(r"\[(.)\](?=\s)[ \t]*")
_TICKS = re.compile(r"`+")
_AUTOLINK = re.compile(r"<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*|[\w.+-]+@[\w-]+(?:\.[\w-]+)+)>")
_TAG = re.compile(r"<(?:/?[A-Za-z][^<>]*|[?!][^>]*)>")
_WIKI = re.compile(r"\[\[((?:[^\[\]|\\]++|\\.)++)(?:\|((?:[^\[\]|\\]++|\\.)*+))?\]\]", re.S)  # possessive: linear without a bound
_TARGET = re.compile(r"\(\s*+(<[^<>\n]*>|(?:[^\s()\\]|\\.|\((?:[^\s()\\]|\\.)*\))*+)(?:\s++(?:\"[^\"]*\"|'[^']*'|\([^()]*\)))?+\s*+\)")
_PLAIN = re.compile(r"[^\\`<\[\]!&*_\n#~]+")
_PLAIN_RICH = re.compile(r"[^\\`<\[\]!&*_\n#~^$]+")
_BARE = re.compile(r"(?<!\w)https?://")
_URL_END = re.compile(r"[^\s<]*")
_FOOTNOTE = re.compile(r"\[\^([^\s\[\]]+)\]")
_SPECIAL = re.compile(r"[\\`<\[!&*_~]")
_ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|\w{2,32});")
_CLOSERS = {m: re.compile(r"(?<=\S)" + re.escape(m) + r"(?!\w)") for m in ("*", "**", "***", "_", "__", "___")} | {"~~": re.compile(r"(?<=\S)~~"), "^": re.compile(r"(?<=\S)\^"), "$": re.compile(r"(?<=\S)\$(?!\d)"), "$$": re.compile(r"\$\$")}
_LINES = re.compile(r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+\Z")
_MARKS = set(" \t#`~=-*_>+<0123456789")
_ESCAPABLE = set("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
_UNESCAPE = re.compile(r"\\([!-/:-@\[-`{-~])")
_URL = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*:")
STATUS = {" ": "open", "x": "done", "X": "done", "-": "deferred"}


@dataclass
class Parsed:
    """refs: (kind, ctx, title, heading, alias, line); headings: (level, text, line, parent, root);
    code: (lang, content, line); tasks: (status, text, line); images: url."""

    refs: list[tuple] = field(default_factory=list)
    headings: list[tuple] = field(default_factory=list)
    code: list[tuple] = field(default_factory=list)
    tasks: list[tuple] = field(default_factory=list)
    images: list[str] = field(default_factory=list)


def reference(before: str, url: str, label: str | None, line: int) -> tuple | None:
    """One wiki reference by the character before its brackets; None if it isn't valid."""
    url = html.unescape(_UNESCAPE.sub(r"\1", url)).strip()
    if not url:
        return None
    shown = url if label is None else html.unescape(_UNESCAPE.sub(r"\1", label)).strip()
    path, hash_, heading = url.partition("#")
    heading = heading if hash_ and heading else None
    if before == "#":
        parts = path.split("/")
        return ("tag", parts[:-1], parts[-1], None, None, line) if all(parts) else None
    parts = [x for x in path.split("/") if x]
    alias = shown if shown != url else None
    if before == "!":
        return None if alias is not None or not parts else ("embed", parts[:-1], parts[-1], heading, None, line)
    return ("link", parts[:-1], parts[-1], heading, alias, line) if parts else None


def is_url(text: str) -> bool:
    """An absolute URL: a scheme, and a host where the scheme takes one."""
    m = _URL.match(text)
    if not m or any(c.isspace() for c in text):
        return False
    return bool(re.match(r"[^/?#]", text[m.end() + 2 :])) if text[: m.end()].lower() in ("http:", "https:", "ftp:") and text[m.end() : m.end() + 2] == "//" else text[: m.end()].lower() not in ("http:", "https:", "ftp:")


def atx(s: str) -> tuple[int, str] | None:
    """Level and text of a heading line."""
    m = _ATX.match(s)
    if not m:
        return None
    text = s[m.end() :].strip(" \t")
    if text.endswith("#") and (not (bare := text.rstrip("#")) or bare[-1] in " \t"):
        text = bare.rstrip(" \t")
    return len(m[1]), text


def _brackets(text: str) -> dict[int, int]:
    """The closing bracket of each opening one; a bracket after a backslash is neither."""
    out, waiting, i = {}, [], 0
    for m in re.finditer(r"\\.|[\[\]]", text, re.S):
        i = m.start()
        if text[i] == "[":
            waiting.append(i)
        elif text[i] == "]" and waiting:
            out[waiting.pop()] = i
    return out


def _ticks(text: str) -> dict[int, list[int]]:
    """Where the runs of backticks of each length begin."""
    out: dict[int, list[int]] = {}
    for m in _TICKS.finditer(text):
        out.setdefault(len(m[0]), []).append(m.start())
    return out


def tokens(text: str, rich: bool = False) -> Iterator[tuple]:
    """Inline pieces of a leaf in order: (kind, place, ...).

    text: the text; nl; bang (before an embed); code: content; entity: as written; auto: URL; tag: raw HTML;
    wiki: character before, target, label or None, as written; link / image: URL, inner text, then its pieces, then
    /link or /image; strong: number of marks, its pieces, /strong. Only where ``rich`` ones are asked for: URLs without
    brackets as auto, strike and super like strong, math: content, number of marks; note: name of a footnote."""
    plain = _PLAIN_RICH if rich else _PLAIN
    ticks = close_of = None
    i, end, begin, lost, known = 0, len(text), 0, set(), 0
    waiting: list[tuple] = []  # (place to go on, end, begin, lost, closing piece) of the regions around
    while True:
        if i >= end:
            if not waiting:
                return
            i, end, begin, lost, closing = waiting.pop()
            yield closing
            continue
        if i >= known and (m := plain.match(text, i, end)):
            known = m.end()
        if i < known:  # plain text up to there
            if rich and (u := _BARE.search(text, i, known)) and len(url := _trimmed(text[u.start() : _URL_END.match(text, u.end(), end).end()])) > len(u[0]):
                if u.start() > i:
                    yield "text", i, text[i : u.start()]
                yield "auto", u.start(), url
                i = u.start() + len(url)
            else:
                yield "text", i, text[i:known]
                i = known
            continue
        c = text[i]
        if c == "\\":
            if i + 1 < end and text[i + 1] in _ESCAPABLE:
                yield "text", i, text[i + 1]
                i += 2
                continue
        elif c == "\n":
            yield "nl", i
            i += 1
            continue
        elif c == "`":
            run = _TICKS.match(text, i, end)
            size, after = run.end() - i, run.end()
            ticks = _ticks(text) if ticks is None else ticks
            own = ticks.get(size, [])
            k = bisect_left(own, after)
            if k < len(own) and own[k] + size <= end:
                yield "code", i, text[after : own[k]]
                i = own[k] + size
            else:
                yield "text", i, run[0]
                i = after
            continue
        elif c == "<":
            if m := _AUTOLINK.match(text, i, end):
                yield "auto", i, m[1]
                i = m.end()
                continue
            if text.startswith("<!--", i) and "-->" not in lost:
                if (k := text.find("-->", i + 4, end)) >= 0:
                    yield "tag", i, text[i : k + 3]
                    i = k + 3
                    continue
                lost.add("-->")
            if ">" not in lost:
                if m := _TAG.match(text, i, end):
                    yield "tag", i, m[0]
                    i = m.end()
                    continue
                if text.find(">", i, end) < 0:
                    lost.add(">")
        elif c == "[" or c == "!" and text.startswith("[", i + 1) and i + 1 < end:
            at = i + (c == "!")
            if m := _WIKI.match(text, at, end):
                if c == "!":
                    yield "bang", i
                    i += 1
                else:
                    yield "wiki", i, text[i - 1] if i > begin else "", m[1], m[2], m[0]
                    i = m.end()
                continue
            if rich and c == "[" and (m := _FOOTNOTE.match(text, i, end)):
                yield "note", i, m[1]
                i = m.end()
                continue
            close_of = _brackets(text) if close_of is None else close_of
            close = close_of.get(at, end)
            if close < end and (m := _TARGET.match(text, close + 1, end)):
                url = html.unescape(_UNESCAPE.sub(r"\1", m[1][1:-1] if m[1].startswith("<") else m[1]))
                kind = "image" if c == "!" else "link"
                yield kind, i, url, text[at + 1 : close] if c == "!" else None
                waiting.append((m.end(), end, begin, lost, ("/" + kind, close, url)))
                i = begin = at + 1
                end, lost = close, set()
                continue
        elif c == "&":
            if m := _ENTITY.match(text, i, min(end, i + 40)):
                yield "entity", i, m[0]
                i = m.end()
                continue
        elif rich and c == "$":
            mark = "$$" if text.startswith("$$", i) else "$"
            inner = i + len(mark)
            if mark not in lost and inner < end and (mark == "$$" or not text[inner].isspace()):
                if m := _CLOSERS[mark].search(text, inner + 1, end):
                    yield "math", i, text[inner : m.start()], len(mark)
                    i = m.end()
                    continue
                lost.add(mark)
            yield "text", i, mark
            i = inner
            continue
        elif c in "*_" and not (i > begin and (text[i - 1] == "*" or text[i - 1] == "_" or text[i - 1].isalnum())) or rich and (c == "^" or c == "~" and text.startswith("~~", i)):
            mark = "~~" if c == "~" else c if c == "^" else c * min(3, next((k for k in (1, 2) if i + k >= end or text[i + k] != c), 3))
            while mark and len(mark) + i < end and (c != "~" or mark == "~~"):
                inner = i + len(mark)
                if mark not in lost and not text[inner].isspace():
                    if m := _CLOSERS[mark].search(text, inner + 1, end):
                        name = "strike" if c == "~" else "super" if c == "^" else "strong"
                        yield name, i, len(mark)
                        waiting.append((m.end(), end, begin, lost, ("/" + name, m.start(), len(mark))))
                        i = begin = inner
                        end, lost = m.start(), set()
                        break
                    lost.add(mark)
                mark = mark[:-1]
            else:
                yield "text", i, c
                i += 1
            continue
        yield "text", i, c
        i += 1


def _trimmed(url: str) -> str:
    """A URL in running text without the marks that end a sentence around it."""
    more, n = url.count(")") - url.count("("), len(url)
    while n and (url[n - 1] in "?!.,:*_~'\"" or url[n - 1] == ")" and more > 0):
        n -= 1
        more -= url[n] == ")"
    return url[:n]


class _Frame:
    """An open container: its lines and the place in them; ``over``: closing events of containers that hold nothing else."""

    __slots__ = ("lines", "first", "kind", "k", "begun", "over")

    def __init__(self, lines: list[str], first: int, kind: str, over: int) -> None:
        self.lines, self.first, self.kind, self.k, self.begun, self.over = lines, first, kind, 0, False, over


def events(text: str) -> Iterator[tuple]:
    """Blocks of a note in order: (kind, ...).

    p: text, line, whether it begins a list item; h: level, text, line, whether no container is around it; code: language,
    content, line; hr; raw: HTML; quote and item (whether numbered) open, /quote and /item close."""
    stack = [_Frame(lines_of(text), 1, "", 0)]
    while stack:
        f = stack[-1]
        lines, first, root, n, k = f.lines, f.first, not f.kind, len(f.lines), f.k
        para: list[str] = []
        start = 0
        child = None
        while k < n or para:
            s = lines[k] if k < n else ""
            if s and s[0] not in _MARKS:  # nothing but text begins so
                if not para:
                    start = first + k
                para.append(s.rstrip(" \t"))
                k += 1
                continue
            bare = s.strip(" \t")
            kind = ""
            if bare:
                indent = len(s) - len(s.lstrip(" \t"))
                if "\t" in s[:indent]:
                    s = s[:indent].expandtabs(4) + s[indent:]
                    indent = len(s) - len(s.lstrip(" "))
                if indent >= 4:
                    if para:
                        para.append(bare)
                    else:
                        f.begun = True
                    k += 1
                    continue
                c = s[indent]
                if c in "`~" and (m := _FENCE.match(s)) and not (m[1][0] == "`" and "`" in m[2]):
                    kind = "code"
                elif c == "#" and (head := atx(s)):
                    kind = "h"
                elif para and c in "=-" and _SETEXT.match(s):
                    yield "h", 1 if c == "=" else 2, "\n".join(para), start, root
                    para, f.begun = [], True
                    k += 1
                    continue
                elif c in "-*_" and _RULE.match(s):
                    kind = "hr"
                elif c == ">":
                    kind = "quote"
                elif (m := _ITEM.match(s)) and not (para and (not (m[4] or "").strip() or m[2][0].isdigit() and m[2][:-1] != "1")):
                    kind = "item"
                elif c == "<" and not para and (m := _RAW.match(s)):
                    kind = "raw"
                else:
                    if not para:
                        start = first + k
                    para.append(bare)
                    k += 1
                    continue
            if para:  # whatever comes ends the paragraph
                opens = f.kind == "item" and not f.begun
                at = 0
                while at < len(para) and not (opens and _TASK.match(para[at])) and _DEFINITION.match(para[at]):
                    at += 1
                f.begun = True
                if at < len(para):
                    yield "p", "\n".join(para[at:]), start, opens
                para = []
            if k >= n:
                break
            if not kind:
                k += 1
                continue
            f.begun = True
            if kind == "code":
                k, block = _fence(lines, k, m, first)
                yield block
            elif kind == "h":
                yield "h", *head, first + k, root
                k += 1
            elif kind == "hr":
                yield ("hr",)
                k += 1
            elif kind == "raw":
                end = _raw(lines, k, m)
                yield "raw", "\n".join(lines[k:end])
                k = end
            elif kind == "quote":
                end, inner, levels = _quote(lines, k)
                for _ in range(levels):
                    yield ("quote",)
                child = _Frame(inner, first + k, "quote", levels)
                k = end
                break
            else:
                end, inner = _item(lines, k, m)
                numbers = [m[2][0].isdigit()]
                if len(inner) == 1:
                    inner[0] = _inmost(inner[0], numbers)
                for number in numbers:
                    yield "item", number
                child = _Frame(inner, first + k, "item", len(numbers))
                k = end
                break
        f.k = k
        if child:
            stack.append(child)
        else:
            for _ in range(f.over):
                yield ("/" + f.kind,)
            stack.pop()


def _fence(lines: list[str], k: int, m: re.Match, first: int) -> tuple[int, tuple]:
    mark, indent, line = m[1], len(lines[k]) - len(lines[k].lstrip(" ")), first + k
    close = re.compile(r" {0,3}" + re.escape(mark[0]) + "{" + str(len(mark)) + r",}[ \t]*$")
    body, k = [], k + 1
    while k < len(lines) and not close.match(lines[k]):
        s = lines[k]
        body.append(s[min(indent, len(s) - len(s.lstrip(" "))) :])
        k += 1
    info = html.unescape(_UNESCAPE.sub(r"\1", m[2].strip())).split()
    return k + 1, ("code", info[0] if info else None, "".join(x + "\n" for x in body), line)


def _raw(lines: list[str], k: int, m: re.Match) -> int:
    end = f"</{m[1].lower()}>" if m[1] else "-->" if m[2] else None
    while k < len(lines):
        if end is None and not lines[k].strip():
            return k
        k += 1
        if end and end in lines[k - 1].lower():
            return k
    return k


def _lazy(s: str) -> bool:
    """May the line carry on a paragraph of a container it doesn't belong to?"""
    t = s.lstrip(" \t")
    return bool(t) and t[0] != ">" and not _FENCE.match(s) and not atx(s) and not _RULE.match(s) and not _ITEM.match(s)


def _ends_in_text(inner: list[str]) -> bool:
    s = inner[-1] if inner else ""
    return bool(s.strip()) and not (_ATX.match(s) or _FENCE.match(s) or _RULE.match(s) or s.startswith("    "))


def _quote(lines: list[str], k: int) -> tuple[int, list[str], int]:
    """End of the quote that begins at line ``k``, its lines, and how many quotes directly inside each other they are in."""
    inner: list[str] = []
    while k < len(lines):
        if m := _QUOTE.match(lines[k]):
            inner.append(lines[k][m.end() :])
        elif not (_ends_in_text(inner) and _lazy(lines[k])):
            break
        else:
            inner.append(lines[k].lstrip(" \t"))
        k += 1
    levels = 1
    if _QUOTE.match(inner[0]):
        marks = [m[0].count(">") if (m := _QUOTES.match(s)) else 0 for s in inner]
        deep = min(x for x in marks if x) - 1
        # lines that carry on a paragraph do so in all of these quotes
        if deep and all(x or _lazy(s) for x, s in zip(marks, inner)):
            inner = [_unquoted(s, deep) if x else s for x, s in zip(marks, inner)]
            levels += deep
    return k, inner, levels


def _unquoted(s: str, levels: int) -> str:
    at = 0
    for _ in range(levels):
        at = _QUOTE.match(s, at).end()
    return s[at:]


def _item(lines: list[str], k: int, m: re.Match) -> tuple[int, list[str]]:
    gap = (m[3] or " ").expandtabs(4)
    offset = len(m[1]) + len(m[2]) + (len(gap) if len(gap) <= 4 and m[4] else 1)
    inner = [" " * (len(gap) - 1) + m[4] if m[4] and len(gap) > 4 else m[4] or ""]
    k += 1
    fenced, blank = _FENCE.match(inner[0]), not inner[0].strip()
    while k < len(lines):
        s = lines[k].expandtabs(4) if "\t" in lines[k][:8] else lines[k]
        indent = len(s) - len(s.lstrip(" "))
        if not s.strip():
            if blank:
                break
            inner.append("")
        elif indent >= offset:
            inner.append(s[offset:])
            blank = False
        elif not fenced and _ends_in_text(inner) and _lazy(s):
            inner.append(s.lstrip(" "))
        else:
            break
        k += 1
    while len(inner) > 1 and not inner[-1]:
        inner.pop()
    return k, inner


def _inmost(s: str, numbers: list[bool]) -> str:
    """What is left of the one line of an item without the items directly inside it; ``numbers`` gets whether each is numbered."""
    same = min((len(s.rstrip(" \t" + c)), c) for c in "-*_")  # from here on a rule, perhaps
    at = 0
    while m := _MARK.match(s, at):
        if at + len(m[0]) - len(m[0].lstrip()) >= same[0] and _RULE.match(s[at:]):
            break
        numbers.append(m[0].lstrip()[0].isdigit())
        at = m.end()
    return s[at:]


WANTED = frozenset(("refs", "headings", "code", "tasks", "images"))


class Scanner:
    """Collects from the events of one note what is wanted."""

    def __init__(self, wanted: frozenset[str] = WANTED, needle: str = "[[") -> None:
        self.out, self.wanted, self.needle = Parsed(), wanted, needle
        self.refs, self.images = "refs" in wanted, "images" in wanted

    def inline(self, text: str, line: int, spelt: bool = True) -> str:
        """Collect references and images of a leaf; return its plain text, where it is ``spelt`` out."""
        if not spelt and not (self.refs and self.needle in text or self.images and "![" in text):
            return ""
        if not _SPECIAL.search(text):
            return text.replace("\n", "")
        out, seen = [], 0
        for t in tokens(text):
            kind = t[0]
            if kind == "text" or kind == "auto":
                out.append(t[2])
            elif kind == "wiki":
                if self.refs:
                    line += text.count("\n", seen, t[1])
                    seen = t[1]
                    if ref := reference(t[2], t[3], t[4], line):
                        self.out.refs.append(ref)
                out.append((t[3] if t[4] is None else t[4]).strip())
            elif kind == "bang":
                out.append(" ")
            elif kind == "entity":
                out.append(html.unescape(t[2]))
            elif kind == "/image" and self.images and is_url(t[2]):
                self.out.images.append(t[2])
        return "".join(out)

    def run(self, text: str) -> Parsed:
        out, tasks, headings = self.out, "tasks" in self.wanted, "headings" in self.wanted
        open_heads: list[tuple[int, str]] = []
        items: list[list] = []  # of each open container: its task, if it has one, and the task's text
        for e in events(text):
            kind = e[0]
            if kind == "p":
                body, own = e[1], items[-1] if items else None
                if tasks and e[3] and (m := _TASK.match(body)) and m[1] in STATUS:
                    own[0] = (STATUS[m[1]], e[2])
                if e[3] and (m := _TASK.match(body)):
                    body = body[m.end() :]
                part = self.inline(body, e[2], bool(own and own[0]))
                if own and own[0]:
                    own[1].append(part)
            elif kind == "h":
                label = self.inline(e[2], e[3], headings).strip()
                if headings:
                    while open_heads and open_heads[-1][0] >= e[1]:
                        open_heads.pop()
                    out.headings.append((e[1], label, e[3], open_heads[-1][1] if open_heads else None, e[4]))
                    open_heads.append((e[1], label))
            elif kind == "code":
                if "code" in self.wanted:
                    out.code.append(e[1:])
            elif kind == "item" or kind == "quote":
                items.append([None, []])
            elif kind == "/item" or kind == "/quote":
                task, texts = items.pop()
                if task:
                    out.tasks.append((task[0], "".join(texts), task[1]))
        return out


def lines_of(text: str) -> list[str]:
    return text.replace("\r\n", "\n").replace("\r", "\n").split("\n")


def scan(text: str | None, wanted: frozenset[str] = WANTED, needle: str = "[[") -> Parsed:
    """What is wanted of one note; a null text has nothing. References are sought in paragraphs with ``needle`` only."""
    return Scanner(wanted, needle).run(text) if text else Parsed()


def heading_slug(text: str) -> str:
    """Anchor of a heading: letters and digits lower-cased, white space and dashes as single dashes, the rest dropped."""
    kept = "".join(c.lower() if c.isalnum() else "-" if c.isspace() or c == "-" else "" for c in text)
    return re.sub(r"-+", "-", kept).strip("-")


def section(text: str | None, slug: str) -> str | None:
    """Text below the first top-level heading with this slug, up to the next one that isn't deeper."""
    if not text:
        return None
    raw = _LINES.findall(text)
    tops = [h for h in scan(text, frozenset(("headings",))).headings if h[4]]
    for k, (level, label, line, _, _) in enumerate(tops):
        if heading_slug(label) == slug:
            end = next((h[2] for h in tops[k + 1 :] if h[0] <= level), len(raw) + 1)
            body = raw[line : end - 1]
            if not _ATX.match(raw[line - 1].rstrip("\r\n")):  # a Setext heading of one or more lines
                body = body[1 + next(n for n, x in enumerate(body) if _SETEXT.match(x.rstrip("\r\n"))) :]
            return "".join(body)
    return None
