"""Pieces of oversized notes by agglomerative merging.

A note over ``limit`` characters starts as atoms (lines; sentences, words or
single stretches of what is longer than a piece may be). A heap holds the
borders of adjacent pieces; the weakest border is merged first while both sides
with the overlap stay within the limit. Strength of a border: inside a word 0,
word 1, sentence 2, line 3, blank line 4, heading of level L 11 - L.

Pieces cover the text without gaps (``start`` to ``stop``) and each but the
first is led in by exactly ``overlap`` characters before it (fewer where the
text has fewer). Nulls: a null text is no oversized note; null or repeated
heading rows and headings beyond the last line have no effect, rows with a null
id are left out. Texts at the
limit aren't split. CRLF is never cut.
"""

from __future__ import annotations

import heapq
import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

LIMIT, OVERLAP = 4000, 200
_SENTENCE = re.compile(r"(?<=[.!?。！？])\s+")
_SPACE = re.compile(r"\s+")


def _atoms(text: str, most: int, levels: dict[int, int]) -> tuple[list[int], list[int]]:
    """Starts of the atoms and the strength of the border before each."""
    starts, strength = [], []
    pos, blank = 0, False
    for line, raw in enumerate(text.split("\n"), 1):
        end = pos + len(raw) + 1
        starts.append(pos)
        strength.append(11 - levels[line] if line in levels else 4 if blank else 3)
        if len(raw) + 1 > most:
            _finer(text, pos, min(end, len(text)), most, starts, strength)
        blank = not raw.strip()
        pos = end
    while starts and starts[-1] >= len(text):  # nothing after the last line feed
        starts.pop(), strength.pop()
    return starts, strength


def _finer(text: str, lo: int, hi: int, most: int, starts: list[int], strength: list[int]) -> None:
    cuts = {m.end(): 1 for m in _SPACE.finditer(text, lo, hi)}
    cuts |= {m.end(): 2 for m in _SENTENCE.finditer(text, lo, hi)}
    at = lo
    for c in [*sorted(x for x in cuts if lo < x < hi), hi]:
        while c - at > most:  # a run without white space
            at += most - (most > 1 and text[at + most - 1 : at + most + 1] == "\r\n")
            starts.append(at), strength.append(0)
        if c < hi:
            starts.append(c), strength.append(cuts[c])
            at = c


def pieces(text: str, levels: dict[int, int], limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(start, stop) of the pieces of one text, in order."""
    if len(text) <= limit:
        return [(0, len(text))]
    most = limit - overlap
    starts, strength = _atoms(text, most, levels)
    n = len(starts)
    stop = [*starts[1:], len(text)]
    nxt, prv = [*range(1, n), -1], [-1, *range(n - 1)]
    alive = [True] * n
    heap = [(strength[k], stop[k] - starts[k - 1], k, k - 1, stop[k]) for k in range(1, n)]
    heapq.heapify(heap)
    while heap:
        _, size, k, left, end = heapq.heappop(heap)
        if not alive[k] or prv[k] != left or stop[k] != end or end - starts[left] != size or size > most:
            continue
        alive[k] = False
        stop[left], nxt[left] = end, nxt[k]
        if nxt[k] >= 0:
            prv[nxt[k]] = left
        if (r := nxt[left]) >= 0:
            heapq.heappush(heap, (strength[r], stop[r] - starts[left], r, left, stop[r]))
        if (p := prv[left]) >= 0:
            heapq.heappush(heap, (strength[left], stop[left] - starts[p], left, p, stop[left]))
    return [(starts[k], stop[k]) for k in range(n) if alive[k]]


def line_starts(text: str, lines: set[int]) -> tuple[list[int], list[int]]:
    """Those of the lines that the text has, rising, and where each begins."""
    known, begin, pos = [], [], 0
    for line, raw in enumerate(text.split("\n"), 1):
        if line in lines:
            known.append(line), begin.append(pos)
        pos += len(raw) + 1
    return known, begin


def split_oversized(notes: DataFrame, headings: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, with_text: bool = True) -> DataFrame:
    """One row a piece: note_id, piece, pieces, start, stop, lead (where its overlap begins), line of its start, text with
    overlap (null without ``with_text``), and sections: of each heading whose own section has a part in the piece its line
    and how many characters of the section lie in the pieces so far."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than limit")
    notes = notes.where("note_id is not null")
    big = notes.where(F.length("md_text") > limit).select("note_id", "md_text")
    heads = headings.where("note_id is not null and line is not null").select("note_id", "line", F.coalesce("level", F.lit(6)).alias("level"))
    heads = heads.join(notes.where(F.length("md_text") > limit).select("note_id"), "note_id", "left_semi")
    heads = heads.groupBy("note_id", "line").agg(F.min("level").alias("level")).groupBy("note_id").agg(F.collect_list(F.struct("line", "level")).alias("heads"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for note, text, known in zip(pdf["note_id"], pdf["md_text"], pdf["heads"]):
                levels = {int(x["line"]): min(6, max(1, int(x["level"]))) for x in known} if known is not None else {}
                lines, begin = line_starts(text, set(levels))
                end = [*begin[1:], len(text)]
                cut = pieces(text, levels, limit, overlap)
                line, at = 1, 0
                for k, (a, b) in enumerate(cut):
                    lead = max(0, a - overlap) if k else a
                    while at < len(lines) and end[at] <= a:
                        at += 1
                    here = [(lines[i], min(b, end[i]) - begin[i]) for i in range(at, bisect_left(begin, b))]
                    rows.append((note, k, len(cut), a, b, lead, line, text[lead:b] if with_text else None, here))
                    line += text.count("\n", a, b)
            yield pd.DataFrame(rows, columns=["note_id", "piece", "pieces", "start", "stop", "lead", "line", "text", "sections"])

    return big.join(heads, "note_id", "left").mapInPandas(
        run, "note_id bigint, piece int, pieces int, start bigint, stop bigint, lead bigint, line int, text string, sections array<struct<line:int,chars:bigint>>")


def oversized(notes: DataFrame, headings: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(note_id, line): line 0 for each note in more than one piece, and the line of each heading of whose own section the pieces hold more than the limit."""
    out = split_oversized(notes, headings, limit, with_text=False).where("pieces > 1")
    long = F.transform(F.filter("sections", lambda x: x["chars"] > limit), lambda x: x["line"])
    return out.select("note_id", F.explode(F.concat(F.array(F.lit(0)), long)).alias("line")).distinct()


def rebuilt(pieces_of: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(note_id, digest, over, unled): digest of the text put together again, pieces over the limit, and pieces not led in by the overlap."""
    own = F.substring("text", F.col("start") - F.col("lead") + 1, F.length("text"))
    unled = (F.col("piece") > 0) & (F.col("start") - F.col("lead") != F.least(F.lit(overlap), "start"))
    rows = pieces_of.groupBy("note_id").agg(F.sort_array(F.collect_list(F.struct("piece", own.alias("own")))).alias("x"), F.sum((F.length("text") > limit).cast("bigint")).alias("over"), F.sum(unled.cast("bigint")).alias("unled"))
    return rows.select("note_id", F.md5(F.array_join("x.own", "")).alias("digest"), "over", "unled")
