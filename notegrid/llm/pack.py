"""Texts in containers of fixed capacity by swap-based local search.

Sizes are tokens: of a public tokenizer, or runs of word characters and of
other characters. A text over the capacity is cut into full containers and a
rest; nothing else is split. Pieces are spread over cells of about ``CELL``
pieces by hash (one cell wastes at most about one container), and each cell is
packed by itself: best fit of falling sizes, then moves and swaps (one for one,
two for one) between underfull containers. A step is made only if it raises the
sum of squared fills, so containers empty out; the search ends when no step
does, or when there are no more containers than the sizes need.

A null or empty text has no tokens and is in no container. Equal sizes keep the
order of their ids, so a result is the same on every run. A repeated id is as
many texts.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from notegrid.llm import text as tx
from notegrid.plans.scratch import written

CAPACITY, CELL = 1024, 4096


def run_tokens(texts: list) -> np.ndarray:
    """Maximal runs of letters, digits and underscores, and maximal runs of other characters that aren't white space."""
    out = np.zeros(len(texts), np.int64)
    alnum, space, _, _ = tx.classes()
    for lo, hi in tx.blocks(texts):
        cp, begin = tx.points(texts[lo:hi])
        kind = np.full(len(cp), 2, np.int8)
        kind[space[cp]] = 0
        kind[alnum[cp] | (cp == ord("_"))] = 1
        first = kind > 0
        first[1:] &= kind[1:] != kind[:-1]
        total = np.concatenate(([0], np.cumsum(first)))
        out[lo:hi] = total[begin[1:]] - total[begin[:-1]]
    return out


@cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def tokenizer_tokens(path: str) -> Callable[[list], np.ndarray]:
    """Counter of the tokens of a tokenizer file, of whole texts."""

    def count(texts: list) -> np.ndarray:
        t, out = _tokenizer(path), []
        for lo, hi in tx.blocks(texts):
            out += [len(e.ids) for e in t.encode_batch([x or "" for x in texts[lo:hi]], add_special_tokens=False)]
        return np.array(out, np.int64)

    return count


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count: Callable[[list], np.ndarray] = run_tokens) -> DataFrame:
    """(id, tokens) of each row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "tokens": count(pdf["text"].tolist())})

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    return rows.mapInPandas(run, "id bigint, tokens bigint")


def best_fit(size: list[int], capacity: int = CAPACITY) -> np.ndarray:
    """Number of the container of each item, largest first into the least room that holds it."""
    number, room = np.zeros(len(size), np.int64), []  # (room left, container), rising
    n = 0
    for k in sorted(range(len(size)), key=lambda i: (-size[i], i)):
        at = bisect_left(room, (size[k], -1))
        left, b = room.pop(at) if at < len(room) else (capacity, n)
        n = max(n, b + 1)
        number[k] = b
        if left > size[k]:
            insort(room, (left - size[k], b))
    return number


class Search:
    """Local search on one cell; ``load`` of each container, ``number`` of each item's container."""

    def __init__(self, size: list[int], number: np.ndarray, capacity: int) -> None:
        self.size, self.number, self.capacity = np.array(size, np.int64), number.copy(), capacity
        self.load = np.bincount(number, weights=self.size, minlength=1).astype(np.int64)
        self.least = -(-int(self.size.sum()) // capacity)

    def used(self) -> int:
        return int(np.count_nonzero(self.load))

    def step(self, a: int) -> bool:
        """The first kind of step out of container ``a`` that raises the sum of squares, the best of its kind."""
        load, here = self.load, self.load[self.number]
        own = np.flatnonzero(self.number == a)
        own = own[np.unique(self.size[own], return_index=True)[1][::-1]]  # one item of each size, largest first
        # move: the whole item is gained by the other container
        gap = np.where((load > 0) & (load < self.capacity), self.capacity - load, -1)
        gap[a] = -1
        for k in own:
            ok = np.flatnonzero((gap >= self.size[k]) & (load + self.size[k] > load[a]))
            if len(ok):
                return self._apply(a, [k], int(ok[gap[ok].argmin()]), [])
        others = np.flatnonzero((here < self.capacity) & (self.number != a))
        if self._swap(a, [[k] for k in own], others):
            return True
        own = np.flatnonzero(self.number == a)
        x, y = np.triu_indices(len(own), 1)
        first = np.unique(self.size[own[x]] + self.size[own[y]], return_index=True)[1]
        return self._swap(a, np.stack([own[x[first]], own[y[first]]], axis=1).tolist(), others)

    def _swap(self, a: int, given: list[list[int]], others: np.ndarray) -> bool:
        """One item of another container for the ones given: the best exchange, if there is any."""
        best, choice = 0, None
        t, load = self.size[others], self.load[self.number[others]]
        for items in given:
            d = self.size[items].sum() - t
            gain = np.where((d > 0) & (load + d <= self.capacity), d * (load + d - self.load[a]), 0)
            if len(gain) and gain.max() > best:
                best, choice = int(gain.max()), (items, int(others[gain.argmax()]))
        return choice is not None and self._apply(a, choice[0], int(self.number[choice[1]]), [choice[1]])

    def _apply(self, a: int, give: list[int], b: int, get: list[int]) -> bool:
        d = int(self.size[give].sum() - self.size[get].sum())
        self.number[give], self.number[get] = b, a
        self.load[a] -= d
        self.load[b] += d
        return True

    def run(self) -> np.ndarray:
        """Sweeps over the underfull containers from the emptiest on, until a sweep has no step."""
        moved = True
        while moved and self.used() > self.least:
            moved = False
            for a in np.flatnonzero((self.load > 0) & (self.load < self.capacity))[np.argsort(self.load[(self.load > 0) & (self.load < self.capacity)], kind="stable")]:
                while 0 < self.load[a] < self.capacity and self.step(int(a)):
                    moved = True
                if self.used() == self.least:
                    break
        return np.unique(self.number, return_inverse=True)[1]


def fill(size: list[int], capacity: int = CAPACITY) -> np.ndarray:
    """Number of the container of each item (sizes from 1 to the capacity)."""
    return Search(size, best_fit(size, capacity), capacity).run() if len(size) else np.zeros(0, np.int64)


def pack(sized: DataFrame, capacity: int = CAPACITY, cell: int = CELL) -> DataFrame:
    """(doc_id, piece, tokens, container, fill) from (id, tokens); ``piece`` counts the parts of a text from 0."""
    sized = written(sized.where("tokens > 0"), "sizes")
    whole = F.expr(f"cast(tokens div {capacity} as int)")
    parts = sized.withColumn("full", whole).withColumn("rest", F.col("tokens") % capacity)
    full = parts.where("full > 0").select("id", F.explode(F.expr("sequence(0, full - 1)")).alias("piece"), F.lit(capacity).cast("bigint").alias("tokens"))
    full = full.select("id", "piece", "tokens", F.concat_ws("-", F.lit("f"), "id", "piece").alias("container"), F.col("tokens").alias("fill"))
    rest = parts.where("rest > 0").select("id", F.col("full").alias("piece"), F.col("rest").alias("tokens"))
    cells = max(1, -(-rest.count() // cell))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["id", "piece"], ignore_index=True)
        number = fill(pdf["tokens"].tolist(), capacity)
        total = np.bincount(number, weights=pdf["tokens"]).astype(np.int64)
        return pdf.assign(container=[f"c-{key[0]}-{b}" for b in number], fill=total[number])[["id", "piece", "tokens", "container", "fill"]]

    packed = rest.groupBy(F.pmod(F.xxhash64("id"), F.lit(cells)).alias("cell")).applyInPandas(run, "id bigint, piece int, tokens bigint, container string, fill bigint")
    return full.unionByName(packed).withColumnRenamed("id", "doc_id")


def larger_than_container(packed: DataFrame) -> DataFrame:
    """Ids of the texts whose pieces lie in more than one container."""
    return packed.groupBy("doc_id").agg(F.min("piece").alias("first"), F.max("piece").alias("last")).where("last > first").select("doc_id")


def audit(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, tokens, pieces, wrong): what was packed of each text, and its pieces in containers that are overfull or whose stated fill is wrong."""
    load = packed.groupBy("container").agg(F.sum("tokens").alias("load"))
    rows = packed.join(load, "container").withColumn("wrong", ((F.col("load") > capacity) | (F.col("load") != F.col("fill"))).cast("bigint"))
    return rows.groupBy("doc_id").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("pieces"), F.sum("wrong").alias("wrong"))
