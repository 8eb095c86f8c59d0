"""Test passages in a corpus, by a distributed positional inverted index.

``index`` writes the postings of the corpus once: a row a shard of documents,
with the distinct terms of the shard in order, how many places each has, and all
places, term by term, as gaps. Any number of item sets is then looked up in that
table by ``find``; no text is read again, and nothing is shuffled but the matches.

Every window of ``run`` words of a test item is looked up through its term that
is rarest in the shard; a window with a term that has no posting is dead. Lists
of the other terms, adjusted by their offset, are intersected with it until the
phrase breaks, so a hit is exact.

A proximity match needs no run. In a stretch of ``2 * RUN`` words of the item
the words are counted that stand at the same distances in the document, whatever
stands between them; from ``RUN`` on it is a match. Of each stretch, the postings
of all but its ``RUN - SURE`` commonest words are taken: a match holds at least
``SURE`` of them on one diagonal, and only where so many are all words are
counted, so none is lost. Runs on diagonals at most ``gap`` apart add up too,
each word of the item once, which finds words put in or left out between runs.

Test items are the stated query set: at most ``ITEMS`` of them are on a task at
once, more are taken block by block, each against the whole index. Nulls: a null
text has no words and isn't found; null ids are left out. An item shorter than
``run`` words is in no document. A repeated item or document row counts once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from notegrid.llm import text as tx
from notegrid.plans.scratch import written

U = np.uint64
RUN, ITEMS = 13, 2000
#: Characters of a shard; a longer text is a shard of its own.
SHARD_CHARS = 500_000
#: Places whose phrases are compared at once.
CHUNK = 2_000_000
#: Looked-up words that a proximity match has at least; any number up to RUN gives the same matches.
SURE = 6
_OUT_NAMES, _OUT_TYPES = ["doc_id", "item_id", "longest", "words", "item_words", "near"], [pa.int64()] * 2 + [pa.int32()] * 4
OUT = "doc_id bigint, item_id bigint, longest int, words int, item_words int, near int"


class Items:
    """Words of test items in one array; ``term`` numbers the distinct words."""

    def __init__(self, rows: list[tuple[int, str]], run: int) -> None:
        h, doc, _, _ = tx.words(*tx.points([t for _, t in rows]))
        self.run, self.ids = run, np.array([i for i, _ in rows], np.int64)
        self.vocabulary, self.term = np.unique(h, return_inverse=True)
        self.item = doc
        self.length = np.bincount(doc, minlength=len(rows))
        n = len(h) - run + 1
        self.windows = np.flatnonzero(doc[: max(n, 0)] == doc[run - 1 :]) if n > 0 else np.zeros(0, np.int64)


Postings = tuple[np.ndarray, np.ndarray, np.ndarray]
_SHARD = pa.schema([("terms", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())), ("gaps", pa.list_(pa.int32())), ("ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int32()))])
INDEX = "terms array<bigint>, counts array<int>, gaps array<int>, ids array<bigint>, starts array<int>"


def shard(texts: list, ids: np.ndarray) -> pa.RecordBatch:
    """One row: terms of the texts, places of each, and where each text begins; places count through all texts."""
    h, doc, _, _ = tx.words(*tx.points(texts))
    order = np.argsort(h, kind="stable")
    at = np.flatnonzero(np.diff(h[order].view(np.int64), prepend=0) != 0) if len(h) else np.zeros(0, np.int64)
    if len(h) and (not len(at) or at[0]):
        at = np.concatenate(([0], at))
    gaps = np.diff(order, prepend=0)
    gaps[at] = order[at]
    columns = (h[order][at].view(np.int64), np.diff(np.append(at, len(h))), gaps, ids, np.searchsorted(doc, np.arange(len(texts))))
    return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), pa.array(c, f.type.value_type)) for c, f in zip(columns, _SHARD)], schema=_SHARD)


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The postings of all documents as a table in the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = batch.column("text").to_pylist(), batch.column("id").to_numpy()
            for lo, hi in tx.blocks(texts, SHARD_CHARS):
                yield shard(texts[lo:hi], ids[lo:hi])

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    return written(rows.mapInArrow(run, INDEX), "postings", {"parquet.block.size": str(16 << 20)})


def postings_of(index: DataFrame) -> DataFrame:
    """The index term by term: (term, doc_id, positions in the document)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        for terms, counts, gaps, ids, starts in _shards(batches):
            place = _places(counts, gaps)
            doc = np.searchsorted(starts, place, "right") - 1
            rows = pd.DataFrame({"term": np.repeat(terms, counts), "doc": doc, "positions": place - starts[doc]})
            out = rows.groupby(["term", "doc"], sort=False)["positions"].agg(list).reset_index()
            yield pa.RecordBatch.from_pandas(out.assign(doc_id=ids[out["doc"]])[["term", "doc_id", "positions"]], preserve_index=False)

    return index.mapInArrow(run, "term bigint, doc_id bigint, positions array<bigint>")


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield [batch.column(f.name).slice(k, 1).flatten().to_numpy() for f in _SHARD]


def _places(counts: np.ndarray, gaps: np.ndarray) -> np.ndarray:
    """Places from gaps, term by term."""
    total, begin = np.cumsum(gaps, dtype=np.int64), np.cumsum(counts) - counts
    return total - np.repeat(total[begin] - gaps[begin], counts)


def postings(row: list[np.ndarray], vocabulary: np.ndarray) -> Postings:
    """Term of each place of a shard (its number in the vocabulary, -1 for others); places grouped by term; where each term's list begins."""
    terms, counts, gaps, ids, starts = row
    known = terms.view(U)
    first = np.cumsum(counts) - counts
    at = np.minimum(np.searchsorted(known, vocabulary), len(known) - 1) if len(known) else np.zeros(0, np.int64)
    has = known[at] == vocabulary if len(known) else np.zeros(len(vocabulary), bool)
    n = np.zeros(len(vocabulary), np.int64)
    n[has] = counts[at[has]]
    begin = np.concatenate(([0], np.cumsum(n)))
    order = np.zeros(begin[-1], np.int64)
    if begin[-1]:
        own = gaps[np.repeat(first[at[has]] - begin[:-1][has], n[has]) + np.arange(begin[-1])]
        order = _places(n[has], own)
    term = np.full(int(counts.sum()), -1, np.int64)
    term[order] = np.repeat(np.arange(len(vocabulary)), n)
    return term, order, begin


def search(found: Postings, doc: np.ndarray, items: Items) -> pd.DataFrame:
    """Maximal common runs of at least ``items.run`` words: text, item, begin in both, length."""
    term, order, begin = found
    count = np.diff(begin)[items.term]
    none = pd.DataFrame({c: np.zeros(0, np.int64) for c in ("doc", "item", "p", "q", "n")})
    if not len(items.windows) or not len(order):
        return none
    seen = np.lib.stride_tricks.sliding_window_view(count, items.run)[items.windows]
    rarest = seen.argmin(axis=1)
    anchors = np.unique((items.windows + rarest)[seen.min(axis=1) > 0])
    # anchors are taken so many at a time that their places stay below CHUNK (one anchor has no more than the shard)
    part = np.cumsum(count[anchors]) // CHUNK
    runs = [_runs(anchors[part == k], count, found, doc, items) for k in np.unique(part)]
    return pd.concat([none, *runs]).drop_duplicates(ignore_index=True)


def _runs(anchors: np.ndarray, count: np.ndarray, found: Postings, doc: np.ndarray, items: Items) -> pd.DataFrame:
    term, order, begin = found
    n = count[anchors]
    q = np.repeat(anchors, n)
    first = np.repeat(begin[items.term[anchors]], n)
    p = order[first + np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n)]

    def reach(step: int) -> np.ndarray:
        got, live = np.zeros(len(p), np.int64), np.arange(len(p))
        k = step
        while len(live):
            a, b = p[live] + k, q[live] + k
            inside = (a >= 0) & (a < len(term)) & (b >= 0) & (b < len(items.term))
            live, a, b = live[inside], a[inside], b[inside]
            ok = (term[a] == items.term[b]) & (doc[a] == doc[p[live]]) & (items.item[b] == items.item[q[live]])
            live = live[ok]
            got[live] += 1
            k += step
        return got

    back, on = reach(-1), reach(1)
    hit = back + on + 1 >= items.run
    return pd.DataFrame({"doc": doc[p[hit]], "item": items.item[q[hit]], "p": (p - back)[hit], "q": (q - back)[hit], "n": (back + on + 1)[hit]}).drop_duplicates()


def _band(runs: pd.DataFrame, gap: int) -> int:
    """Most words of the item that runs on diagonals at most ``gap`` apart cover."""
    d, q, end = (runs["p"] - runs["q"]).to_numpy(), runs["q"].to_numpy(), (runs["q"] + runs["n"]).to_numpy()
    order = np.lexsort((q, d))
    d, q, end = d[order], q[order], end[order]
    to, best = np.searchsorted(d, d + gap, "right"), 0
    for k in np.flatnonzero(np.diff(d, prepend=d[0] - 1)):
        if k and to[k] == to[k - 1]:
            continue  # part of the band before
        own = np.argsort(q[k : to[k]], kind="stable") + k
        reached = np.maximum.accumulate(end[own])
        begin = np.maximum(q[own], np.concatenate(([-1], reached[:-1])))
        best = max(best, int(np.maximum(reached - begin, 0).sum()))
    return best


def _report(runs: pd.DataFrame, gap: int) -> pd.DataFrame:
    """Per text and item: longest run, words of the item in runs, most words of the item in runs on near diagonals."""
    once = runs.drop_duplicates(["doc", "item", "q", "n"]).groupby(["doc", "item"])
    out = pd.DataFrame({"longest": once["n"].max(), "words": once["n"].sum()})
    size = runs.groupby(["doc", "item"])["n"]
    out["near"] = size.max()
    many = size.count() > 1
    for key, own in runs.groupby(["doc", "item"]) if many.any() else ():
        if many[key]:
            out.loc[key, "near"] = _band(own, gap)
    return out.reset_index()


def near_words(postings: Postings, doc: np.ndarray, items: Items) -> pd.DataFrame:
    """Text, item and words of each proximity match."""
    none = pd.DataFrame({c: np.zeros(0, np.int64) for c in ("doc", "item", "near")})
    term, order, begin = postings
    width, m = 2 * RUN, len(items.term)
    if not m or not len(order):
        return none
    # words beyond an item's end are in no document and never looked up
    count = np.concatenate((np.diff(begin)[items.term], np.zeros(width, np.int64)))
    item = np.concatenate((items.item, np.full(width, -1)))
    at = np.arange(m)[:, None] + np.arange(width)
    seen = np.where(item[at] == items.item[:, None], count[at], 0)
    alive = (seen > 0).sum(axis=1) >= RUN
    at, seen = at[alive], seen[alive]
    # the commonest RUN - SURE words of a stretch are left out; the rest that occur are looked up
    ranked = np.argsort(seen, axis=1, kind="stable")[:, : width - (RUN - SURE)]
    anchors = np.unique(np.take_along_axis(at, ranked, 1)[np.take_along_axis(seen, ranked, 1) > 0])
    # whole items are taken so many at a time that the places of their words stay below CHUNK (one item has its own)
    total = np.cumsum(count[anchors])
    first = np.searchsorted(items.item[anchors], items.item[anchors])
    part = (total[first] - count[anchors][first]) // CHUNK if len(anchors) else total
    found = [none, *(_near(anchors[part == k], count, item, postings, doc, items) for k in np.unique(part))]
    return pd.concat(found).groupby(["doc", "item"], as_index=False)["near"].max()


def _near(anchors: np.ndarray, count: np.ndarray, item: np.ndarray, postings: Postings, doc: np.ndarray, items: Items) -> pd.DataFrame:
    """Proximity matches of the items of some looked-up words."""
    term, order, begin = postings
    width, m = 2 * RUN, len(items.term)
    n = count[anchors]
    q = np.repeat(anchors, n)
    p = order[np.repeat(begin[items.term[anchors]] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
    # sorted by diagonal and word of the item
    key = np.sort((p - q + m) * m + q)
    far = np.flatnonzero(key[SURE - 1 :] - key[: len(key) - SURE + 1] < width) if len(key) >= SURE else np.zeros(0, np.int64)
    q, last, d = key[far] % m, key[far + SURE - 1] % m, key[far] // m - m
    ok = (key[far + SURE - 1] // m - m == d) & (items.item[q] == items.item[last]) & (doc[q + d] == doc[last + d])
    q, low, d = q[ok], last[ok] - width + 1, d[ok]
    found = [pd.DataFrame({c: np.zeros(0, np.int64) for c in ("doc", "item", "near")})]
    for k in range(0, len(q), 20000):
        # all words on the diagonal, in every stretch that holds these hits
        own = slice(k, k + 20000)
        b = low[own, None] + np.arange(2 * width - 1)
        a = b + d[own, None]
        inside = (b >= 0) & (b < m) & (a >= 0) & (a < len(term)) & (b < q[own, None] + width)
        a, b = np.where(inside, a, 0), np.where(inside, b, 0)
        equal = inside & (term[a] == items.term[b]) & (items.item[b] == items.item[q[own], None]) & (doc[a] == doc[q[own] + d[own], None])
        total = np.pad(np.cumsum(equal, axis=1), ((0, 0), (1, 0)))
        most = (total[:, width:] - total[:, :-width]).max(axis=1)
        hit = np.flatnonzero(most >= RUN)
        found.append(pd.DataFrame({"doc": doc[(q + d)[own][hit]], "item": items.item[q[own][hit]], "near": most[hit]}))
    return pd.concat(found)


def find(index: DataFrame, items: DataFrame, run: int = RUN, gap: int = 10, item_id: str = "item_id", item_text: str = "text", most: int = ITEMS, proximity: bool = False) -> DataFrame:
    """(doc_id, item_id, longest, words, item_words, near) of each document of the index that holds ``run`` consecutive words of
    an item or, with ``proximity``, a proximity match of it; ``longest`` and ``words`` are of such runs, 0 if there are none."""
    wanted = items.select(F.col(item_id).cast("bigint").alias("item_id"), F.col(item_text).alias("text")).where("item_id is not null and text is not null").dropDuplicates(["item_id"])
    blocks = max(1, -(-wanted.count() // most))
    found = []
    for block in range(blocks):
        # a block holds about ``most`` items whatever their number
        part = wanted if blocks == 1 else wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block)
        query = Items([(r["item_id"], r["text"]) for r in part.collect()], run)

        def scan(batches: Iterator[pa.RecordBatch], query: Items = query) -> Iterator[pa.RecordBatch]:
            for row in _shards(batches):
                here = postings(row, query.vocabulary)
                ids, starts = row[3], row[4]
                doc = np.repeat(np.arange(len(ids)), np.diff(np.append(starts, len(here[0]))))
                out = _report(search(here, doc, query), gap)
                if proximity:
                    out = out.merge(near_words(here, doc, query), "outer", on=["doc", "item"], suffixes=("", "_too")).fillna(0).astype(np.int64)
                    out["near"] = np.maximum(out["near"], out["near_too"])
                if len(out):
                    columns = (ids[out["doc"]], query.ids[out["item"]], out["longest"], out["words"], query.length[out["item"]], out["near"])
                    yield pa.RecordBatch.from_arrays([pa.array(np.asarray(c, np.int64)).cast(t) for c, t in zip(columns, _OUT_TYPES)], names=_OUT_NAMES)

        found.append(index.mapInArrow(scan, OUT))
    return reduce(DataFrame.unionByName, found).groupBy("doc_id", "item_id").agg(*[F.max(c).alias(c) for c in ("longest", "words", "item_words", "near")])
