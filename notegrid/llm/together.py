"""Items that appear together, by heavy-light decomposition.

Heavy items (in at least one record of ``HEAVY``, at most ``SLOTS`` of them, the
most frequent first) get a slot of a dense bit matrix, and their pairs are
counted by popcounts; pairs of light items are counted by hash; mixed pairs by
probing each record's heavy slots from its light list. The union is summed
after counting inside each task. An item in fewer records than a pair must
have is dropped first, as no pair of it can count. A record with more than
``BLOCK`` light items is cut into blocks of them, and each pair of blocks is a
unit of work of its own, so one long record is no single task.

A null list or item is left out, an item repeated in a record counts once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from notegrid.plans.scratch import written

HEAVY, SLOTS = 256, 1024
#: Pairs a task holds before it counts them together.
HELD = 1_000_000
#: Light items of a record that are paired in one unit.
BLOCK = 2000


def _popcounts(slot: np.ndarray, rec: np.ndarray, n: int, into: np.ndarray) -> None:
    used, row = np.unique(slot, return_inverse=True)
    bits = np.zeros((len(used), (n + 7) // 8 * 8 + 56), bool)
    bits[row, rec] = True
    packed = np.packbits(bits, axis=1)
    packed = packed[:, : packed.shape[1] // 8 * 8].copy().view(np.uint64)
    for k in range(len(used) - 1):
        into[used[k], used[k + 1 :]] += np.bitwise_count(packed[k] & packed[k + 1 :]).sum(axis=1, dtype=np.int64)


def _flat(lists: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    n = lists.map(len).to_numpy()
    flat = np.concatenate(lists.to_list()) if n.sum() else np.zeros(0, np.int64)
    return flat.astype(np.int64), np.repeat(np.arange(len(n)), n)


def _counted(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not len(a):
        return a, b, n
    order = np.lexsort((b, a))
    a, b, n = a[order], b[order], n[order]
    at = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
    return a[at], b[at], np.add.reduceat(n, at)


def _within(values: np.ndarray, rec: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs inside each record, smaller value first: neighbours at distance 1, 2, ... of the sorted lists."""
    order = np.lexsort((values, rec))
    v, r = values[order], rec[order]
    at = np.arange(len(v))
    step = 1
    while len(at := at[at + step < len(v)]):
        at = at[r[at] == r[at + step]]
        if len(at):
            yield v[at], v[at + step]
        step += 1


def _pairs(batches: Iterator[pd.DataFrame], ids: np.ndarray) -> Iterator[pd.DataFrame]:
    """Rows: heavy slots and light items of a record; of a cut one, two blocks (light, other), or one block with its heavy
    slots, which count among themselves with the ``first`` block only."""
    dense = np.zeros((len(ids), len(ids)), np.int64)
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    total = 0

    def out() -> pd.DataFrame:
        a, b, n = _counted(*(np.concatenate(x) for x in zip(*held)))
        held.clear()
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "n": n})

    def groups(pdf: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        crossed = pdf["other"].map(len).to_numpy() > 0
        for light, other in zip(pdf["light"][crossed], pdf["other"][crossed]):
            for k in range(0, len(other), 128):
                yield np.tile(light, len(other[k : k + 128])), np.repeat(other[k : k + 128], len(light))
        pdf = pdf[~crossed].reset_index(drop=True)
        light, rec = _flat(pdf["light"])
        yield from _within(light, rec)
        heavy, own = _flat(pdf["heavy"])
        if len(heavy) and len(light):
            n = np.bincount(own, minlength=len(pdf))
            at = np.concatenate(([0], np.cumsum(n)))[rec]  # heavy lists lie in the order of the records
            for k in range(int(n.max())):
                has = n[rec] > k
                yield ids[heavy[at[has] + k]], light[has]
        first = pdf["first"].to_numpy(bool)[own]
        if first.any():
            _popcounts(heavy[first], own[first], len(pdf), dense)

    for pdf in batches:
        for a, b in groups(pdf):
            held.append((a, b, np.ones(len(a), np.int64)))
            total += len(a)
            if total > HELD:
                yield out()
                total = 0
    i, j = np.nonzero(dense)
    held.append((ids[i], ids[j], dense[i, j]))
    yield out()


def together(records: DataFrame, lists: dict[str, str], least: int = 5) -> DataFrame:
    """(kind, item_a, item_b, n_ab, n_a, n_b, n, lift) of the pairs in at least ``least`` records; ``lists``: kind to list column."""
    n = records.count()
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.array_distinct(F.col(c)).alias("items")) for k, c in sorted(lists.items())])
    rows = records.select(F.monotonically_increasing_id().alias("rec"), F.explode(kinds).alias("x"))
    rows = rows.select("rec", "x.kind", F.explode("x.items").alias("item")).where("item is not null")
    counts = rows.groupBy("kind", "item").agg(F.count("*").alias("n_item")).where(F.col("n_item") >= least)
    counts = written(counts.withColumn("id", F.monotonically_increasing_id()), "items")
    top = counts.where(F.col("n_item") * HEAVY >= n).orderBy(F.desc("n_item"), "kind", "item").limit(SLOTS)
    slots = top.select("id").collect()  # at most SLOTS
    ids = np.array([r["id"] for r in slots], np.int64)
    slot_of = records.sparkSession.createDataFrame([(int(x), k) for k, x in enumerate(ids)], "id bigint, slot int")
    heavy = F.broadcast(counts.join(F.broadcast(slot_of), "id").select("kind", "item", "slot"))
    light = counts.join(F.broadcast(slot_of), "id", "left_anti").select("kind", F.col("item").alias("sought"), "id")
    # one branch, so a record keeps its number; heavy items seek a key of their own, which no light item has
    sought = F.when(F.col("slot").isNull(), F.col("item")).otherwise(F.concat(F.lit("\0"), F.col("rec").cast("string"), F.lit("\0"), F.col("slot").cast("string")))
    both = rows.join(heavy, ["kind", "item"], "left").withColumn("sought", sought).join(light, ["kind", "sought"], "left")
    both = both.withColumn("id", F.when(F.col("slot").isNull(), F.col("id"))).where("slot is not null or id is not null")
    baskets = both.groupBy("rec", "kind").agg(F.collect_list("slot").alias("heavy"), F.collect_list("id").alias("light")).where(F.size("heavy") + F.size("light") > 1)
    baskets = written(baskets.select("heavy", "light"), "baskets")
    none = F.array().cast("array<bigint>")
    units = baskets.where(F.size("light") <= BLOCK).select("heavy", "light", none.alias("other"), F.lit(True).alias("first"))
    long = baskets.where(F.size("light") > BLOCK)
    if not long.isEmpty():
        long = long.withColumns({"row": F.monotonically_increasing_id(), "n": F.ceil(F.size("light") / BLOCK).cast("int")})
        long = long.withColumn("x", F.explode(F.expr("flatten(transform(sequence(0, n - 1), i -> transform(sequence(i, n - 1), j -> struct(i, j))))")))
        part = lambda k: F.slice("light", F.col(f"x.{k}") * BLOCK + 1, F.lit(BLOCK))
        same = F.col("x.i") == F.col("x.j")
        cut = long.select("row", "x", F.when(same, F.col("heavy")).otherwise(F.array().cast("array<int>")).alias("heavy"), part("i").alias("light"), F.when(same, none).otherwise(part("j")).alias("other"), (F.col("x.j") == 0).alias("first"))
        parts = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        units = units.unionByName(cut.repartition(parts, "row", "x.i", "x.j").select("heavy", "light", "other", "first"))
    counted = units.mapInPandas(lambda it: _pairs(it, ids), "a bigint, b bigint, n bigint")
    summed = counted.groupBy("a", "b").agg(F.sum("n").alias("n_ab")).where(F.col("n_ab") >= least)
    a = counts.select(F.col("id").alias("a"), "kind", F.col("item").alias("x"), F.col("n_item").alias("nx"))
    b = counts.select(F.col("id").alias("b"), F.col("item").alias("y"), F.col("n_item").alias("ny"))
    named = summed.join(a, "a").join(b, "b")
    swap = F.col("x") > F.col("y")
    return named.select(
        "kind", F.least("x", "y").alias("item_a"), F.greatest("x", "y").alias("item_b"), "n_ab",
        F.when(swap, F.col("ny")).otherwise(F.col("nx")).alias("n_a"), F.when(swap, F.col("nx")).otherwise(F.col("ny")).alias("n_b"),
        F.lit(n).cast("bigint").alias("n")).withColumn("lift", F.col("n_ab") * F.col("n").cast("double") / F.col("n_a") / F.col("n_b"))


def above_chance(pairs: DataFrame, ratio: int = 3) -> DataFrame:
    """Pairs at least ``ratio`` times as often together as by chance; exact for any count."""
    big = lambda c: F.col(c).cast("decimal(19,0)")
    return pairs.where(big("n_ab") * big("n") >= big("n_a") * big("n_b") * F.lit(ratio))
