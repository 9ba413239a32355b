"""Filling fixed-capacity containers by the sum-of-squares rule.

Each item goes where the sum, over all residual gaps, of the squared number of open containers with that gap becomes
smallest. That keeps the gaps varied, so a fitting one is at hand for whatever comes next; on discrete sizes its waste
grows more slowly than the number of items.

Items are packed in groups of a bounded number of items (by a hash of their id, so that a lost task gives the same
result again). The rule takes items one after the other; a group is packed in two orders, all items in decreasing size,
and the large ones so and the others as they come, and the order that needs fewer containers counts. The containers a
group leaves partly open are then packed again among each other, whole, so that the number of groups costs next to
nothing. No group and no collected result grows with the data.

Items longer than the capacity are split: full containers first, the rest is an item. Items of size 0 or null take no
space: they come out once, with a null container. An item of negative size is an error. Repeated ids are several items.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalis.session import cut, ship

#: Items of a group on average; a group is packed by one task, and needs a few dozen bytes an item.
GROUP_ITEMS = 1 << 16
#: Groups whose open containers are packed together in the second step.
GROUPS_TOGETHER = 32
#: Items above this share of the capacity are large.
LARGE = 0.15


class SumOfSquares:
    """Packs one item after the other; put() gives the number of the item's container."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.count = np.zeros(capacity + 1)
        self.count[0] = -0.5  # closed containers don't count; this makes the rule's formula hold for them too
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.containers = 0

    def put(self, size: int) -> int:
        c, n = self.capacity, self.count
        if size < 0 or size > c:
            raise ValueError(f"size {size} doesn't fit a capacity of {c}")
        change = n[: c + 1 - size] - n[size:] + 1
        change[n[size:] <= 0] = np.inf
        k = int(change.argmin())  # the smallest gap among equals
        if change[k] < n[c - size] + 0.5:
            where = self.open[k + size].pop()
            n[k + size] -= 1
        else:
            k, where = c - size, self.containers
            self.containers += 1
        if k:
            n[k] += 1
            self.open[k].append(where)
        return where


def pack_sizes(sizes, capacity: int) -> np.ndarray:
    """The container of each item, in the given order."""
    packer = SumOfSquares(capacity)
    return np.fromiter((packer.put(int(s)) for s in sizes), np.int64, len(sizes))


def pack_best(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each item, in the order that needs fewer containers."""
    falling = np.argsort(-sizes, kind="stable")
    large = sizes[falling] > LARGE * capacity
    best = None
    for order in (falling, np.r_[falling[large], np.sort(falling[~large])]):
        where = np.empty(len(sizes), np.int64)
        where[order] = pack_sizes(sizes[order], capacity)
        if best is None or where.max(initial=-1) < best.max(initial=-1):
            best = where
    return best


def pack(df: DataFrame, id_col: str, size_col: str, capacity: int, rows: int | None = None) -> DataFrame:
    """(id, piece, size, container_id): container_id is a long, unique over all groups; rows, if known, saves a count."""
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    ship(df.sparkSession)
    rows = df.count() if rows is None else rows
    groups = max(1, -(-rows // GROUP_ITEMS))
    items = df.select(
        F.col(id_col).alias("__id"),
        F.coalesce(F.col(size_col).cast("long"), F.lit(0)).alias("__size"),
        F.pmod(F.xxhash64(F.col(id_col)), F.lit(groups)).alias("__group"),
    )
    kind = items.schema["__id"].dataType.simpleString()

    def pack_group(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["__id", "__size"], kind="stable", na_position="last")
        sizes = pdf["__size"].to_numpy()
        if (sizes < 0).any():
            raise ValueError("an item has a negative size")
        full, rest = np.divmod(sizes, capacity)
        pieces = np.maximum(full + (rest > 0), 1)
        row = np.repeat(np.arange(len(sizes)), pieces)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        size = np.where(piece < full[row], capacity, rest[row])
        whole = size == capacity
        container = np.empty(len(row), np.int64)
        container[whole] = np.arange(whole.sum())
        some = ~whole & (size > 0)
        container[some] = pack_best(size[some], capacity) + whole.sum()
        numbered = pd.arrays.IntegerArray(container + (int(key[0]) << 32), size == 0)
        return pd.DataFrame({"id": pdf["__id"].to_numpy()[row], "piece": piece, "size": size, "container_id": numbered})

    packed = items.groupBy("__group").applyInPandas(pack_group, f"id {kind}, piece long, size long, container_id long")
    packed = _pack_open(cut(packed), capacity)  # read twice there; a group is packed once
    return packed.withColumnRenamed("id", id_col)


def _pack_open(packed: DataFrame, capacity: int) -> DataFrame:
    """Packs the containers that all groups left open, each as one item of the size it holds."""
    held = packed.where("container_id is not null").groupBy("container_id").agg(F.sum("size").alias("held")).where(F.col("held") < capacity)
    held = held.withColumn("__group", F.shiftright("container_id", 32) / F.lit(GROUPS_TOGETHER)).withColumn("__group", F.floor("__group"))

    def again(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["held", "container_id"], ascending=[False, True])
        old = pdf["container_id"].to_numpy()
        where = pack_best(pdf["held"].to_numpy(), capacity)
        first = pd.Series(old).groupby(where).transform("min").to_numpy()  # a merged container keeps its smallest id
        return pd.DataFrame({"old": old, "new": first})

    moved = held.groupBy("__group").applyInPandas(again, "old long, new long").where("old <> new")
    joined = packed.where("container_id is not null").join(moved, packed.container_id == moved.old, "left")
    placed = joined.select("id", "piece", "size", F.coalesce("new", "container_id").alias("container_id"))
    return placed.unionByName(packed.where("container_id is null"))
