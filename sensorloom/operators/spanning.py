"""Minimum spanning forest of points by rounds over blocks (Borůvka 1926).

In a round every component of points takes its shortest edge to another one. First each block looks
into itself, then its points go to the nearest block that is not all of one component with it; the
shortest edge that a component has so far bounds it. Then a point goes only to blocks whose bounding
box is not farther than its component's bound, and that are not all of its own component. So the work
of a round is that of points near the border of their component, not that of all pairs of blocks.

Edges are ordered by distance, smaller id and larger id, so the forest is unique and does not depend
on how points were cut into blocks. Points are packed once, with their places in the order of ids
instead of ids; a round sends their component numbers.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from sensorloom.operators import blocks
from sensorloom.operators.blocks import Block, Metric, _packed, box_distance, gower, header_pairs, host_rows, hosted, one_tree, taken, visits
from sensorloom.operators.forest import roots
from sensorloom.scratch import cut_lineage, spread

#: Component of points that have no edge within the limit any more.
_DONE = -1

#: So many blocks of points need no rounds: one task finds their tree.
TASK_BLOCKS = 8

_EDGES = "comp long, to long, a long, b long, dist double"


def _shortest(a: Block, b: Block, d: np.ndarray, mine: np.ndarray, other: np.ndarray, most: np.ndarray) -> pd.DataFrame:
    """The shortest edge of each component of ``a`` to another one in ``b``, if not longer than its bound.

    Points of ``b`` are in the order of their places, so the first of the nearest is the one that ties ask for.
    """
    j = d.argmin(axis=1)
    i = np.arange(len(a))
    w = d[i, j]
    good = np.isfinite(w) & (w <= most)
    i, j, w = i[good], j[good], w[good]
    pa, pb = a.ids[i].astype(np.int64), b.ids[j].astype(np.int64)
    low, high = np.minimum(pa, pb), np.maximum(pa, pb)
    by = np.lexsort((high, low, w, mine[i]))
    by = by[np.append(True, mine[i][by][1:] != mine[i][by][:-1])[: len(by)]]
    return pd.DataFrame({"comp": mine[i][by], "to": other[j][by], "a": low[by], "b": high[by], "dist": w[by]})


def _edges(rows: DataFrame, metric: Metric, limit: float) -> DataFrame:
    """Shortest edges of the components of visitors to points of the blocks that they visit."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for a, ka, ua, b, kb in host_rows(batches):
            far = min(ua.max(), limit)
            near = kb != _DONE
            if a is b:
                open_ = ka != _DONE
                if not open_.any() or (ka[open_] == ka[open_][0]).all():
                    continue
                a, ka, ua = taken(a, open_), ka[open_], ua[open_]
            elif np.isfinite(far) and a.x.shape[1]:
                near &= box_distance(metric, b, a.x.min(axis=0), a.x.max(axis=0), None) <= far + 1e-9
            if not near.any():
                continue
            b, kb = (b, kb) if near.all() else (taken(b, near), kb[near])
            d = metric(a, b)
            d[(ka[:, None] == kb[None, :]) | (d > limit)] = np.inf
            found = _shortest(a, b, d, ka, kb, ua)
            if len(found):
                yield found

    return rows.mapInPandas(run, _EDGES)


def _marks(labels: DataFrame) -> DataFrame:
    """Per block with open points: components and bounds in the order of packed points, the farthest bound, the only component."""
    opened = F.col("comp") != _DONE
    row = F.array_sort(F.collect_list(F.struct("id", "comp", "best")))
    marks = labels.groupBy("block").agg(
        row.alias("r"),
        F.max(F.when(opened, F.col("best"))).alias("reach"),
        F.when(F.min("comp") == F.max("comp"), F.min("comp")).alias("only"),
    )
    marks = marks.filter("reach IS NOT NULL")
    return marks.select("block", F.col("r.comp").alias("k"), F.transform("r", lambda p: F.when(p["comp"] == _DONE, -1.0).otherwise(p["best"])).alias("u"), "reach", "only")


def spanning_forest(points_blocked: DataFrame, max_dist: float | None = None, metric: Metric = gower, extra: Sequence[str] = ()) -> DataFrame:
    """The minimum spanning forest ``a, b, dist`` of blocked points, with edges of at most ``max_dist``.

    Equal ids are not allowed. No points give no edges, and a single one gives none either.
    """
    spark = points_blocked.sparkSession
    limit = float("inf") if max_dist is None else max_dist
    if points_blocked.count() <= TASK_BLOCKS * blocks.BLOCK_ROWS:
        return one_tree(points_blocked.withColumn("block", F.lit(0)), limit, metric, extra)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = points_blocked.repartitionByRange(parts, "id").sortWithinPartitions("id")
    placed = cut_lineage(ranged.withColumnRenamed("id", "name").withColumn("id", F.monotonically_increasing_id()), "placed")
    packed = cut_lineage(_packed(placed, list(extra), "1"), "packed")
    heads = packed.withColumnsRenamed({c: c[:-1] + "2" for c in packed.columns})
    near = header_pairs(packed, heads, False, metric).filter((F.col("b1") != F.col("b2")) & (F.col("bound") <= limit + 1e-9))
    near = cut_lineage(near.select("b1", "b2", "bound"), "headers")
    labels = cut_lineage(placed.select("id", "block", F.col("id").alias("comp")), "labels")
    left, tree = placed.count(), None

    def bounded(found: DataFrame) -> DataFrame:
        """Marks of the blocks under the shortest edges found so far."""
        best = found.groupBy("comp").agg(F.min("dist").alias("best"))
        return cut_lineage(_marks(labels.join(best, "comp", "left").withColumn("best", F.coalesce("best", F.lit(limit)))), "marks")

    def between(marks: DataFrame, pairs: DataFrame) -> DataFrame:
        """Edges of the points that go to other blocks, by pairs of blocks."""
        mark = lambda t, *names: marks.select(F.col("block").alias(f"b{t}"), *[F.col(c).alias(f"{c}{t}") for c in names])
        came = visits(packed.join(mark("1", "k", "u"), "b1"), pairs, heads.join(mark("2", "only"), "b2"), metric)
        return cut_lineage(_edges(hosted(came, heads.join(mark("2", "k"), "b2")), metric, limit), "found")

    while True:
        # Inside the blocks: an edge for most components, which bounds what they look for elsewhere.
        start = cut_lineage(_marks(labels.withColumn("best", F.lit(limit))), "marks")
        own = packed.join(start.select(F.col("block").alias("b1"), F.col("k").alias("k1"), F.col("u").alias("u1")), "b1")
        inside = cut_lineage(_edges(spread(own, "b1").withColumn("side", F.lit(2)), metric, limit), "inside")
        # The nearest other block: a bound for components that fill their blocks.
        marks = bounded(inside)
        side = lambda t: marks.select(F.col("block").alias(f"b{t}"), F.col("reach").alias(f"reach{t}"), F.col("only").alias(f"only{t}"))
        foreign = F.coalesce(F.col("only1") != F.col("only2"), F.lit(True))
        pairs = near.join(side("1"), "b1").join(side("2"), "b2").filter(foreign)
        closest = pairs.filter(F.col("bound") <= F.col("reach1") + 1e-9).groupBy("b1").agg(F.min(F.struct("bound", "b2")).alias("h")).select("b1", "h.b2")
        closest = cut_lineage(closest, "closest")
        found = inside.union(between(marks, closest))
        # All others within the bounds.
        marks = bounded(found)
        rest = near.join(side("1"), "b1").join(side("2"), "b2").filter(foreign & (F.col("bound") <= F.col("reach1") + 1e-9))
        edges = found.union(between(marks, rest.join(closest, ["b1", "b2"], "left_anti")))
        cheapest = edges.groupBy("comp").agg(F.min(F.struct("dist", "a", "b", "to")).alias("e")).select(F.col("comp").alias("id"), "e.*")
        cheapest = cut_lineage(cheapest, "cheapest")
        chosen = cut_lineage(cheapest.select("a", "b", "dist").distinct(), "chosen")
        taken_now = chosen.count()
        left -= taken_now
        if taken_now:
            tree = chosen if tree is None else tree.union(chosen)
        if not taken_now or left == 1:
            break
        # Two components that chose the same edge point at each other: the smaller is the root.
        mutual = cheapest.select(F.col("id").alias("to"), F.col("to").alias("back"))
        first = (F.col("back") == F.col("id")) & (F.col("id") < F.col("to"))
        parents = cheapest.select("id", "to").join(mutual, "to").select("id", F.when(first, F.col("id")).otherwise(F.col("to")).alias("parent"))
        root = roots(parents).select(F.col("id").alias("comp"), "root")
        # What has no edge within the limit is finished: nothing else has one to it.
        moved = labels.join(root, "comp", "left").select("id", "block", F.coalesce("root", F.lit(_DONE).cast("long")).alias("comp"))
        labels = cut_lineage(moved, "labels")
    if tree is None:
        return spark.createDataFrame([], "a string, b string, dist double")
    name = lambda t: placed.select(F.col("id").alias(t), F.col("name").alias(f"name_{t}"))
    return tree.join(name("a"), "a").join(name("b"), "b").select(F.col("name_a").alias("a"), F.col("name_b").alias("b"), "dist")
