"""Frequency of every term by burst tries.

A task puts its terms into a trie whose leaves are small containers; a
container that grows beyond ``BURST`` bursts into a node, so prefixes are as
long as the terms need. Its subtrees are written as rows: the prefix of a
container and its suffixes with their counters. From the sizes of all of them
follow the prefixes below which too many terms lie for one task; a subtree is
sent by the shortest prefix that is none of these (a container above such a
prefix is cut), and the subtrees of one prefix are merged into one trie where
they meet. A trie of ``HELD`` terms is passed on and a new one begun, so memory
is bounded.

A null list or term is left out, the empty string is a term. A term counts each
time it occurs, and once for each record that holds it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from notegrid.plans.scratch import written

BURST, HELD = 48, 200_000


class Trie:
    """node: [child by character, counters of the term that ends here]; container: a dict of suffix to counters."""

    def __init__(self) -> None:
        self.root: list | dict = {}
        self.size = 0

    def add(self, term: str, occurrences: int, records: int) -> None:
        if isinstance(self.root, dict):
            self.root = self._put(self.root, term, occurrences, records)
            return
        node, k = self.root, 0
        while True:
            if k == len(term):
                if node[1] is None:
                    node[1] = [0, 0]
                    self.size += 1
                node[1][0] += occurrences
                node[1][1] += records
                return
            child = node[0].get(c := term[k])
            k += 1
            if isinstance(child, list):
                node = child
            else:
                node[0][c] = self._put({} if child is None else child, term[k:], occurrences, records)
                return

    def _put(self, box: dict, suffix: str, occurrences: int, records: int) -> list | dict:
        own = box.get(suffix)
        if own is None:
            box[suffix] = [occurrences, records]
            self.size += 1
            return self._burst(box) if len(box) > BURST else box
        own[0] += occurrences
        own[1] += records
        return box

    @staticmethod
    def _burst(box: dict) -> list:
        node = [{}, box.pop("", None)]
        for suffix, own in box.items():
            node[0].setdefault(suffix[0], {})[suffix[1:]] = own
        return node

    def containers(self) -> Iterator[tuple[str, list[str], list[int], list[int]]]:
        """(prefix, suffixes, occurrences, records) of each container in rising order of prefixes; a term that ends at a node is the suffix ""."""
        stack: list[tuple[str, list | dict]] = [("", self.root)]
        while stack:
            prefix, at = stack.pop()
            if isinstance(at, dict):
                if at:
                    suffixes = sorted(at)
                    yield prefix, suffixes, [at[x][0] for x in suffixes], [at[x][1] for x in suffixes]
            else:
                if at[1] is not None:
                    yield prefix, [""], [at[1][0]], [at[1][1]]
                stack.extend((prefix + c, at[0][c]) for c in sorted(at[0], reverse=True))

    def merge(self, prefix: str, suffixes: Iterable[str], occurrences: Iterable[int], records: Iterable[int]) -> None:
        """Take over a subtree: at once where its prefix leads to a container here, else term by term."""
        at: list | dict | None = self.root
        for k in range(len(prefix)):
            if not isinstance(at, list):
                break
            at = at[0].get(prefix[k])
        else:
            if isinstance(at, dict) and prefix:
                before = len(at)
                for x, n, m in zip(suffixes, occurrences, records):
                    own = at.setdefault(x, [0, 0])
                    own[0] += n
                    own[1] += m
                self.size += len(at) - before
                if len(at) > BURST:
                    self._replace(prefix, self._burst(at))
                return
        for x, n, m in zip(suffixes, occurrences, records):
            self.add(prefix + x, n, m)

    def _replace(self, prefix: str, by: list) -> None:
        node = self.root
        for c in prefix[:-1]:
            node = node[0][c]
        node[0][prefix[-1]] = by


def _rows(tries: Iterable[Trie]) -> Iterator[pd.DataFrame]:
    for trie in tries:
        rows = list(trie.containers())
        for k in range(0, len(rows), 5000):
            yield pd.DataFrame(rows[k : k + 5000], columns=["prefix", "suffixes", "occurrences", "records"])


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def tries() -> Iterator[Trie]:
        trie = Trie()
        for pdf in batches:
            for items in pdf["items"]:
                if items is None:
                    continue
                items = [x for x in items if x is not None]
                for term, n in (Counter(items) if len(set(items)) < len(items) else dict.fromkeys(items, 1)).items():
                    trie.add(term, n, 1)
                if trie.size >= HELD:
                    yield trie
                    trie = Trie()
        if trie.size:
            yield trie

    yield from _rows(tries())


_SUBTREE = "prefix string, suffixes array<string>, occurrences array<bigint>, records array<bigint>"


def crowded(subtrees: DataFrame, parts: int) -> set[str]:
    """Prefixes with more terms below them than a quarter of a task's share; each length has at most 4 * ``parts`` of them."""
    total = subtrees.agg(F.sum(F.size("suffixes"))).collect()[0][0] or 0
    each = subtrees.select(F.explode(F.expr("transform(sequence(0, length(prefix)), i -> substring(prefix, 1, i))")).alias("p"), F.size("suffixes").alias("n"))
    return {r["p"] for r in each.groupBy("p").agg(F.sum("n").alias("n")).where(F.col("n") > max(BURST, total // (4 * parts))).collect()}


def route(term: str, full: set[str]) -> str | None:
    """The shortest prefix of the term that isn't crowded; None if all are."""
    return next((term[:k] for k in range(len(term) + 1) if term[:k] not in full), None)


def _routed(batches: Iterator[pd.DataFrame], full: set[str]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for prefix, suffixes, occurrences, records in zip(pdf["prefix"], pdf["suffixes"], pdf["occurrences"], pdf["records"]):
            if (to := route(prefix, full)) is not None:
                rows.append((to, prefix, suffixes, occurrences, records))
                continue
            cut: dict[str, list[int]] = {}
            for k, x in enumerate(suffixes):
                to = route(prefix + x, full)
                cut.setdefault(prefix + x if to is None else to, []).append(k)
            rows += [(to, prefix, suffixes[own], occurrences[own], records[own]) for to, own in cut.items()]
        yield pd.DataFrame(rows, columns=["route", "prefix", "suffixes", "occurrences", "records"])


def _merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Subtrees come sorted by route: those of one route are merged into one trie."""
    at, trie = None, Trie()

    def out() -> Iterator[pd.DataFrame]:
        for part in _rows([trie]):
            flat = part.explode(["suffixes", "occurrences", "records"])
            yield pd.DataFrame({"term": flat["prefix"] + flat["suffixes"], "occurrences": flat["occurrences"].astype("int64"), "records": flat["records"].astype("int64")})

    held: list[pd.DataFrame] = []
    for pdf in batches:
        for to, *subtree in zip(*(pdf[c] for c in ("route", "prefix", "suffixes", "occurrences", "records"))):
            if to != at:
                held += out()
                at, trie = to, Trie()
                if sum(map(len, held)) > 20000:
                    yield pd.concat(held)
                    held = []
            trie.merge(*subtree)
    held += out()
    if held:
        yield pd.concat(held)


def term_counts(rows: DataFrame, items: str) -> DataFrame:
    """(term, occurrences, records) of every term in the list column ``items``."""
    subtrees = written(rows.select(F.col(items).alias("items")).where(F.size("items") > 0).mapInPandas(_count, _SUBTREE), "tries")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    full = crowded(subtrees, parts)
    sent = subtrees.mapInPandas(lambda it: _routed(it, full), "route string, " + _SUBTREE)
    return sent.repartition(parts, "route").sortWithinPartitions("route").mapInPandas(_merged, "term string, occurrences bigint, records bigint")


def marked(rows: DataFrame, items: str, rare: int = 2, common: float = 0.1) -> DataFrame:
    """``term_counts`` with ``records_all`` (rows of the table), ``share`` and ``usefulness``: rare, common or useful."""
    n = rows.count()
    mark = F.when(F.col("records") <= rare, "rare").when(F.col("records") > common * n, "common").otherwise("useful")
    return term_counts(rows, items).select("*", F.lit(n).cast("bigint").alias("records_all"), (F.col("records") / F.lit(n)).alias("share"), mark.alias("usefulness"))


def tag_marks(notes: DataFrame, listings: DataFrame, rare: int = 2, tenth: int = 10) -> DataFrame:
    """(title, mark) of tags in ``notes.tags``: rare, common (more than one row in ``tenth``), stale against the latest listing."""
    n = notes.count()
    counts = written(term_counts(notes, "tags").select(F.col("term").alias("title"), "records"), "tags")
    latest = listings.where("title is not null").groupBy("title").agg(F.max(F.struct("listed_at", "list_id", "backlinks_count")).alias("x")).select("title", F.col("x.backlinks_count").alias("stated"))
    size = counts.select("title", F.explode(F.array(F.when(F.col("records") <= rare, "rare"), F.when(F.col("records") * tenth > n, "common"))).alias("mark")).where("mark is not null")
    stale = counts.join(latest, "title").where("stated is null or stated <> records").select("title", F.lit("stale").alias("mark"))
    return size.unionByName(stale)


def listing_audit(notes: DataFrame, listings: DataFrame) -> DataFrame:
    """(title, records, stated, listed): every tag of either side with its true count, the latest stated one and the number of listings."""
    counts = term_counts(notes, "tags").select(F.col("term").alias("title"), "records")
    latest = listings.where("title is not null").groupBy("title").agg(F.max(F.struct("listed_at", "list_id", "backlinks_count")).alias("x"), F.count_distinct("list_id").alias("listed"))
    return counts.join(latest, "title", "full").select("title", F.coalesce("records", F.lit(0)).cast("bigint").alias("records"), F.col("x.backlinks_count").alias("stated"), F.coalesce("listed", F.lit(0)).cast("bigint").alias("listed"))
