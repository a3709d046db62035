"""Shards of near equal size by best-fit-decreasing bin packing of indivisible groups.

Groups are rows with one text. Their sizes are rounded up to 12 significant bits (a waste of
under 1/2048), so however many groups there are, the sizes form a bounded histogram; only this
histogram reaches the driver. There best fit decreasing places whole size classes: the tightest
bin that fits takes items until none fits any more, which is what item by item would do, and a
balanced tree of remaining capacities finds it. The plan says which ranks of a size class go to
which shard; Spark ranks the groups within their class and looks their shard up.

A group larger than a shard is cut into pieces of whole rows that fit, as nothing else can hold
it; a text that fills a third of the table is spread like that.
"""

from __future__ import annotations

import random
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sensorloom.llm.common import ranked
from sensorloom.scratch import cut_lineage

#: Bytes that each row takes besides its text.
ROW_BYTES = 16


class CapacityTree:
    """Balanced search tree (a treap) of bins by remaining capacity, then number."""

    def __init__(self):
        self.root, self.random = None, random.Random(0)

    def _split(self, node, key):
        if node is None:
            return None, None
        if node[0] < key:
            node[2], right = self._split(node[2], key)
            return node, right
        left, node[1] = self._split(node[1], key)
        return left, node

    def _merge(self, a, b):
        if a is None or b is None:
            return a or b
        if a[3] > b[3]:
            a[2] = self._merge(a[2], b)
            return a
        b[1] = self._merge(a, b[1])
        return b

    def add(self, room: int, number: int) -> None:
        left, right = self._split(self.root, (room, number))
        self.root = self._merge(self._merge(left, [(room, number), None, None, self.random.random()]), right)

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Remove and return the bin with the least room that holds ``size``."""
        left, right = self._split(self.root, (size, -1))
        if right is None:
            self.root = left
            return None
        least = right
        while least[1] is not None:
            least = least[1]
        mine, rest = self._split(right, (least[0][0], least[0][1] + 1))
        self.root = self._merge(left, rest)
        return mine[0]


def best_fit_decreasing(classes: dict[int, int], capacity: int, most: int | None = None) -> list[tuple] | None:
    """Place ``classes`` (size: count) in bins of ``capacity``: rows ``(size, first rank, end rank, bin)``.

    Bins open as they are needed; None if more than ``most`` would be.
    """
    tree, bins, plan = CapacityTree(), 0, []
    for size in sorted(classes, reverse=True):
        at, count = 0, classes[size]
        while at < count:
            found = tree.take_tightest(size)
            if found is None:
                if bins == most:
                    return None
                found = (max(capacity, size), bins)
                bins += 1
            room, number = found
            n = min(count - at, room // size)
            plan.append((size, at, at + n, number))
            tree.add(room - n * size, number)
            at += n
    return plan


def into_bins(classes: dict[int, int], shards: int) -> list[tuple]:
    """Best fit decreasing into a fixed number of bins, at the least capacity at which they hold all.

    A size above the mean gets a bin of its own first, and the mean of the rest counts on.
    """
    rest, own, plan = dict(classes), 0, []
    while rest and own < shards - 1:
        size = max(rest)
        total = sum(s * n for s, n in rest.items())
        if size * (shards - own) <= total:
            break
        taken = classes[size] - rest[size]
        plan.append((size, taken, taken + 1, own))
        own, rest[size] = own + 1, rest[size] - 1
        if not rest[size]:
            del rest[size]
    if not rest:
        return plan
    left, total = shards - own, sum(s * n for s, n in rest.items())
    low, high = max(max(rest), -(-total // left)), total
    best = best_fit_decreasing(rest, high, left)
    step = 1
    while low < high:  # first near the mean, where the answer nearly always is
        mid = min(low + step - 1, (low + high) // 2) if step else (low + high) // 2
        found = best_fit_decreasing(rest, mid, left)
        if found is None:
            low, step = mid + 1, step * 4
        else:
            best, high, step = found, mid, 0
    shift = {size: classes[size] - rest[size] for size in rest}
    return plan + [(s, a + shift[s], b + shift[s], n + own) for s, a, b, n in best]


def size_class(size: Column) -> Column:
    """The size, rounded up to 12 significant bits."""
    unit = F.pow(F.lit(2.0), F.greatest(F.length(F.bin(size)) - F.lit(12), F.lit(0)))
    return (F.ceil(size / unit) * unit).cast("long")


def _place(plan: list[tuple]):
    by = defaultdict(list)
    for size, first, _, shard in sorted(plan):
        by[size].append((first, shard))
    tables = {size: np.array(rows, np.int64) for size, rows in by.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, ranks = (batch.column(i).to_numpy() for i in (2, 3))
            shard = np.zeros(len(sizes), np.int32)
            for size in np.unique(sizes):
                rows, table = sizes == size, tables[int(size)]
                shard[rows] = table[np.searchsorted(table[:, 0], ranks[rows], "right") - 1, 1]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shard)], ["digest", "piece", "shard"])

    return run


def _fair_share(rows: DataFrame, shards: int) -> int:
    """Mean size of a shard, apart from rows that are larger and so fill one alone."""
    limit, total = 1 << 62, rows.agg(F.sum("size")).first()[0] or 0
    while True:
        large = F.col("size") > limit
        n, size = rows.filter(large).agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
        share = max(1, -(-(total - size) // max(1, shards - n)))
        if share >= limit or n >= shards:
            return limit
        limit = share


def shard_documents(
    docs: DataFrame,
    shards: int | None = None,
    capacity: int | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Rows ``(doc_id, size, text_crc32, shard, slot)``, in ``shards`` shards of near equal size or
    in as few shards of ``capacity`` bytes as best fit decreasing needs.

    A row's size is its text's UTF-8 bytes (null: none) plus ``ROW_BYTES``. Null and empty texts
    form one group. Rows that repeat an id are rows of their own; null ids are kept. A text
    larger than the capacity gets a shard of its own, which is then larger. An empty table gives
    an empty result. Slots count each shard's rows from 0 without a gap, in order of id.
    """
    if (shards is None) == (capacity is None):
        raise ValueError("give either a number of shards or a capacity")
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_column).cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.unhex(F.md5(text.cast("binary"))).alias("digest"),
    )
    rows = cut_lineage(rows, "sizes")
    groups = rows.groupBy("digest").agg(F.count("*").alias("n"), F.max("size").alias("row_size"))
    count = rows.count()
    limit = capacity or _fair_share(rows, shards)
    each = F.greatest(F.floor(F.lit(limit) / F.col("row_size")), F.lit(1))
    groups = cut_lineage(groups.withColumn("each", F.least(each, F.col("n")).cast("long")), "groups")
    units = groups.select(
        "digest", "row_size", "n", "each", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / F.col("each")).cast("int") - 1)).alias("piece")
    )
    held = F.least(F.col("each"), F.col("n") - F.col("piece") * F.col("each"))
    units = cut_lineage(units.select("digest", "piece", size_class(held * F.col("row_size")).alias("class")), "units")
    classes = {r["class"]: r["count"] for r in units.groupBy("class").count().collect()}
    plan = into_bins(classes, shards) if shards else best_fit_decreasing(classes, capacity)
    placed = (
        ranked(units, ["class"], ["digest", "piece"], "rank")
        .select("digest", "piece", "class", "rank")
        .mapInArrow(_place(plan), "digest binary, piece int, shard int")
    )
    cut = groups.filter("each < n").select("digest", "each")
    whole = rows.join(cut, "digest", "left_anti").join(placed.filter("piece = 0").drop("piece"), "digest")
    split = ranked(rows.join(cut, "digest"), ["digest"], ["doc_id"], "at", count)
    split = split.withColumn("piece", F.floor(F.col("at") / F.col("each")).cast("int")).join(placed, ["digest", "piece"])
    columns = ["doc_id", "size", "text_crc32", "shard"]
    out = cut_lineage(whole.select(*columns).unionByName(split.select(*columns)), "shards")
    return ranked(out, ["shard"], ["doc_id", "text_crc32"], "slot", count)
