"""Distances between points, block against block, reduced inside the task.

Points are cut into blocks of bounded size, cell by cell, so near points share a block. Each
pair of blocks is one row of a Spark table; a small numpy function turns it into what an
algorithm needs (near pairs, neighbour counts, spanning edges, sums), so the n x n distance
table never exists, and no task sees more than two blocks. Which blocks meet is decided on
their headers alone (bounding box and category); points are only sent to pairs of blocks
that lie within the distance asked for. Where each point has a reach of its own (``visits``), only
points whose reach meets a block's bounding box go there.

A point is ``id string, x array<double>, c array<string>`` plus numeric columns the
algorithm adds. Equal points should be collapsed first (``profiles``).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from sensorloom.scratch import cut_lineage, spread

BLOCK_ROWS = 1024
#: Blocks a side of a tile of block pairs at most, and tiles that a task shall have at least.
TILE_BLOCKS = 8
TILES_PER_TASK = 3
#: Points that decide where cells are cut: so many for each block, and so many altogether at most.
CELL_SAMPLE = 128
SAMPLE_ROWS = 100_000
#: Headers of blocks that go to a block in one row, and neighbours in number whose points visit a block in one task.
HEADS = 4096
VISITS = 64
#: A block of which one in so many points goes to another block is sent whole, and so many numbers are held of the blocks it meets.
WHOLE = 4
TILE_NUMBERS = 4_000_000
#: Rows of packed blocks in a file: Parquet's reader holds thousands of rows of a file at a time, however long they are.
FILE_ROWS = 256


@dataclass
class Block:
    ids: np.ndarray
    x: np.ndarray
    c: np.ndarray
    extra: np.ndarray

    def __len__(self) -> int:
        return len(self.ids)


Metric = Callable[[Block, Block], np.ndarray]


#: Rows of a table of distances that are worked out at a time, so that figures between stay in the cache.
STRIP_ROWS = 64


def gower(a: Block, b: Block) -> np.ndarray:
    """Mean over features of |difference| (range 1) and category mismatch."""
    d = np.zeros((len(a), len(b)))
    held = np.empty((min(STRIP_ROWS, len(a)), len(b)))
    for at in range(0, len(a), STRIP_ROWS):
        part = d[at : at + STRIP_ROWS]
        one = held[: len(part)]
        for j in range(a.x.shape[1]):
            np.subtract.outer(a.x[at : at + STRIP_ROWS, j], b.x[:, j], out=one)
            part += np.abs(one, out=one)
        for j in range(a.c.shape[1]):
            part += a.c[at : at + STRIP_ROWS, j][:, None] != b.c[:, j][None, :]
        part /= a.x.shape[1] + a.c.shape[1]
    return d


def euclidean(a: Block, b: Block) -> np.ndarray:
    d = np.zeros((len(a), len(b)))
    held = np.empty((min(STRIP_ROWS, len(a)), len(b)))
    for at in range(0, len(a), STRIP_ROWS):
        part = d[at : at + STRIP_ROWS]
        one = held[: len(part)]
        for j in range(a.x.shape[1]):
            np.subtract.outer(a.x[at : at + STRIP_ROWS, j], b.x[:, j], out=one)
            part += np.multiply(one, one, out=one)
        np.sqrt(part, out=part)
    return d


def points_of(df: DataFrame, id_: Column, numeric: Sequence[str], categorical: Sequence[str] = ()) -> DataFrame:
    """Mixed features as points; each numeric feature is divided by its range."""
    ranges = (
        df.agg(F.struct(*[(F.max(c) - F.min(c)).cast("double").alias(f"r{i}") for i, c in enumerate(numeric)]).alias("r")).scalar()
        if numeric
        else F.lit(None)
    )
    with_r = df.withColumn("_r", ranges)
    x = F.array(
        *[F.coalesce(F.try_divide(F.col(c).cast("double"), F.col(f"_r.r{i}")), F.lit(0.0)) for i, c in enumerate(numeric)]
    ).cast("array<double>")
    c = F.array(*[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in categorical]).cast("array<string>")
    return with_r.select(id_.cast("string").alias("id"), x.alias("x"), c.alias("c"))


def profiles(points: DataFrame) -> DataFrame:
    """Equal points as one point with the number of copies ``w``; the smallest id stands for all."""
    return points.groupBy("x", "c").agg(F.min("id").alias("id"), F.count("*").cast("double").alias("w"))


def to_members(points: DataFrame, per_profile: DataFrame, column: str) -> DataFrame:
    """Give every point what its profile got; ``per_profile`` carries ``x`` and ``c``."""
    return points.join(per_profile.select("x", "c", column), ["x", "c"]).select("id", column)


def _cells(columns: list[np.ndarray], numeric: int, parts: int) -> list[tuple]:
    """A tree of cuts ``(column, value, left, right)`` into ``parts`` cells of about equal counts; a leaf is ``(block,)``.

    ``columns`` are ``numeric`` numbers, then texts, the last of which is the id. Texts but the id are cut
    first, then the numbers that vary most; the id is cut only where points are equal.
    """
    tree: list[tuple] = []
    leaves = 0

    def grow(at: np.ndarray, parts: int) -> int:
        nonlocal leaves
        node = len(tree)
        tree.append(())
        cut = None
        if parts > 1 and len(at) > 1:
            spread_of = [float(np.nan_to_num(columns[f][at].std())) for f in range(numeric)]
            order = [*range(numeric, len(columns) - 1), *sorted(range(numeric), key=lambda f: -spread_of[f]), len(columns) - 1]
            for f in order:
                v = np.sort(columns[f][at])
                ends = np.flatnonzero(v[1:] != v[:-1])
                if len(ends):
                    end = ends[np.abs(ends + 1 - len(at) * (parts // 2) / parts).argmin()]
                    cut = f, v[end]
                    break
        if cut is None:
            tree[node] = (leaves,)
            leaves += 1
            return node
        below = columns[cut[0]][at] <= cut[1]
        share = min(max(1, round(parts * below.mean())), parts - 1)
        left = grow(at[below], share)
        tree[node] = (*cut, left, grow(at[~below], parts - share))
        return node

    grow(np.arange(len(columns[-1])), parts)
    return tree


def _columns(id_: pd.Series, x: pd.Series, c: pd.Series) -> list[np.ndarray]:
    """Numbers, categories and id of points as columns."""
    xs = np.array([np.asarray(v, dtype=float) for v in x]).reshape(len(id_), -1)
    cs = [np.array([str(v[j]) for v in c], dtype=object) for j in range(len(c.iloc[0]) if len(c) else 0)]
    return [*xs.T, *cs, np.array([str(i) for i in id_], dtype=object)]


def blocked(points: DataFrame) -> DataFrame:
    """Points with their block number, written once so that the blocks stay the same.

    Blocks are the cells of a tree of cuts (Bentley 1975), so that their bounding boxes are small in all
    features. A bounded sample of the points decides where it cuts; what comes out does not depend on it.
    """
    stored = cut_lineage(points, "points")
    n = stored.count()
    parts = max(1, math.ceil(n / BLOCK_ROWS))
    if parts == 1:
        return stored.withColumn("block", F.lit(0))
    size = min(SAMPLE_ROWS, CELL_SAMPLE * parts)
    sample = stored.select("id", "x", "c")
    sample = (sample if size >= n else sample.sample(size / n, seed=1)).toPandas()
    tree = _cells(_columns(sample["id"], sample["x"], sample["c"]), len(sample["x"].iloc[0]) if len(sample) else 0, parts)

    @F.pandas_udf("int")
    def cell(id_: pd.Series, x: pd.Series, c: pd.Series) -> pd.Series:
        columns = _columns(id_, x, c)
        out = np.zeros(len(id_), dtype=np.int32)
        todo = [(0, np.arange(len(id_)))]
        while todo:
            node, at = todo.pop()
            if len(tree[node]) == 1:
                out[at] = tree[node][0]
            elif len(at):
                f, value, left, right = tree[node]
                below = columns[f][at] <= value
                todo += [(left, at[below]), (right, at[~below])]
        return pd.Series(out)

    return cut_lineage(stored.withColumn("block", cell("id", "x", "c")), "blocks")


def _packed(points: DataFrame, extra: Sequence[str], tag: str) -> DataFrame:
    row = F.struct("id", "x", "c", F.array(*[F.col(e).cast("double") for e in extra]).cast("array<double>").alias("e"))
    p = points.groupBy("block").agg(F.array_sort(F.collect_list(row)).alias("p"), F.count("*").alias("n"))
    dims = F.size(F.col("p")[0]["x"])
    lo = F.transform(F.sequence(F.lit(0), dims - 1), lambda i: F.array_min(F.transform("p", lambda q: q["x"][i])))
    hi = F.transform(F.sequence(F.lit(0), dims - 1), lambda i: F.array_max(F.transform("p", lambda q: q["x"][i])))
    cats = F.array_distinct(F.col("p.c"))
    return p.select(
        F.col("block").alias(f"b{tag}"),
        F.col("p.id").alias(f"ids{tag}"),
        F.flatten("p.x").alias(f"xs{tag}"),
        F.flatten("p.c").alias(f"cs{tag}"),
        F.flatten("p.e").alias(f"es{tag}"),
        F.col("n").alias(f"n{tag}"),
        F.when(dims > 0, lo).alias(f"lo{tag}"),
        F.when(dims > 0, hi).alias(f"hi{tag}"),
        F.when(F.size(cats) == 1, cats[0]).alias(f"cat{tag}"),
    )


def _gaps() -> Column:
    """Distance between the bounding boxes of two blocks along each numeric feature."""
    return F.zip_with(
        F.zip_with("lo1", "hi2", lambda a, b: F.greatest(a - b, F.lit(0.0))),
        F.zip_with("lo2", "hi1", lambda a, b: F.greatest(a - b, F.lit(0.0))),
        lambda a, b: a + b,
    )


def _gower_bound() -> Column:
    """A lower bound on the Gower distance of any two points of two blocks."""
    numeric = F.coalesce(F.aggregate(_gaps(), F.lit(0.0), lambda s, g: s + g), F.lit(0.0))
    mismatch = F.aggregate(
        F.zip_with("cat1", "cat2", lambda a, b: F.when(a != b, 1.0).otherwise(0.0)), F.lit(0.0), lambda s, g: s + g
    )
    width = F.coalesce(F.size("lo1"), F.lit(0)) + F.col("width1")
    return (numeric + F.coalesce(mismatch, F.lit(0.0))) / width


def _euclidean_bound() -> Column:
    return F.sqrt(F.coalesce(F.aggregate(_gaps(), F.lit(0.0), lambda s, g: s + g * g), F.lit(0.0)))


_BOUNDS = {gower: _gower_bound, euclidean: _euclidean_bound}


def _heads(packed: DataFrame, tag: str) -> DataFrame:
    width = F.size(f"cs{tag}") / F.col(f"n{tag}")
    return packed.select(f"b{tag}", f"n{tag}", f"lo{tag}", f"hi{tag}", f"cat{tag}", width.alias(f"width{tag}"))


def header_pairs(a: DataFrame, b: DataFrame, one: bool, metric: Metric = gower) -> DataFrame:
    """``b1, b2, n2, bound`` of all pairs of blocks, from headers: one small row per block.

    A metric that is never below another one names it as ``at_least``, and has that one's bound.
    """
    last = b.agg(F.max("b2")).first()[0]
    first = F.col("b1") if one else F.lit(0)
    pairs = _heads(a, "1").withColumn("b2", F.explode(F.sequence(first, F.lit(-1 if last is None else last).cast("int"))))
    pairs = pairs.join(_heads(b, "2"), "b2")
    plain = getattr(metric, "at_least", metric)
    bound = _BOUNDS[plain]() if plain in _BOUNDS else F.lit(0.0)
    return pairs.select("b1", "b2", "n2", bound.alias("bound"))


def with_points(pairs: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of two packed blocks for ``b1, b2``."""
    # The join needs this partitioning; the fixed number of tasks fits the work, not the bytes.
    pairs = spread(pairs.select("b1", "b2"), "b2").join(b, "b2").join(a, "b1")
    return pairs.select(*[f"{k}{t}" for t in "12" for k in ("b", "ids", "xs", "cs", "es", "n")])


def block_pairs(
    left: DataFrame,
    right: DataFrame | None = None,
    extra: Sequence[str] = (),
    right_extra: Sequence[str] | None = None,
    within: float | None = None,
    metric: Metric = gower,
) -> DataFrame:
    """Rows of two packed blocks: all unordered pairs of one table, or left x right of two.

    The pairs are formed from headers, one small row per block, and those too far apart are
    dropped before any points are joined to them.
    """
    one = right is None
    a = cut_lineage(_packed(left, extra, "1"), "packed")
    b = a.withColumnsRenamed({c: c[:-1] + "2" for c in a.columns}) if one else None
    if b is None:
        b = cut_lineage(_packed(right, extra if right_extra is None else right_extra, "2"), "packed")
    pairs = header_pairs(a, b, one, metric)
    if within is not None and metric in _BOUNDS:
        pairs = pairs.filter(F.col("bound") <= within + 1e-9)
    out = with_points(pairs, a, b)
    # What ``reduce_pairs`` needs to send a block to many pairs at once.
    out.headers = (pairs, a, b)
    return out


def _block(row, tag: str, names: dict[str, int]) -> Block:
    """A packed block; categories become numbers, kept in ``names`` for all blocks that meet."""
    n = int(row[f"n{tag}"])
    return Block(
        np.asarray(row[f"ids{tag}"], dtype=object),
        np.asarray(row[f"xs{tag}"], dtype=float).reshape(n, -1),
        np.array([names.setdefault(c, len(names)) for c in row[f"cs{tag}"]], dtype=np.int64).reshape(n, -1),
        np.asarray(row[f"es{tag}"], dtype=float).reshape(n, -1),
    )


def tile_width(pairs: DataFrame, most: int) -> int:
    """Blocks a side of a tile, so that there are some tiles for every task."""
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return min(most, math.isqrt(pairs.count() // (TILES_PER_TASK * tasks)))


def _tiled(pairs: DataFrame, a: DataFrame, b: DataFrame, width: int) -> DataFrame:
    """Rows of single blocks, in tiles of ``width`` x ``width`` pairs: first the right ones, then the left ones with those they meet."""
    return _tile_blocks(_places(pairs, width), a, b)


def _places(pairs: DataFrame, width: int) -> DataFrame:
    """Pairs of blocks with their tile."""
    tile = [F.floor(F.col(c) / width).alias(t) for c, t in (("b1", "t1"), ("b2", "t2"))]
    return cut_lineage(pairs.select("b1", "b2", *tile), "tiles")


def _tile_blocks(placed: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    points = [f"{k}1" for k in ("ids", "xs", "cs", "es", "n")]
    met = placed.groupBy("t1", "t2", "b1").agg(F.sort_array(F.collect_list("b2")).alias("meets")).join(a, "b1")
    left = met.select("t1", "t2", F.lit(1).alias("side"), "b1", "meets", *points)
    there = placed.select("t1", "t2", F.col("b2").alias("b1")).distinct()
    right = there.join(b.withColumnsRenamed({c: c[:-1] + "1" for c in b.columns}), "b1")
    right = right.select("t1", "t2", F.lit(0).alias("side"), "b1", F.array().cast("array<int>").alias("meets"), *points)
    return spread(right.union(left), "t1", "t2").sortWithinPartitions("t1", "t2", "side", "b1")


def tile_rows(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple, int, Block, list[tuple[int, Block]]]]:
    """The tile and the left block of ``_tiled`` rows with the blocks it meets."""
    tile, right, names = None, {}, {}
    for batch in batches:
        for row in batch.to_dict("records"):
            if (row["t1"], row["t2"]) != tile:
                tile, right, names = (row["t1"], row["t2"]), {}, {}
            block = _block(row, "1", names)
            if row["side"] == 0:
                right[row["b1"]] = block
            else:
                yield tile, row["b1"], block, [(b2, right[b2]) for b2 in row["meets"]]


def reduce_pairs(pairs: DataFrame, fn: Callable[[Block, Block, bool], dict | None], schema: str) -> DataFrame:
    """Apply ``fn(block, block, same)`` to each block pair; it returns the columns of ``schema``.

    Where there are many more pairs of ``block_pairs`` than tasks, a block goes once to a tile of pairs
    instead of once to each pair.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                names: dict[str, int] = {}
                out = fn(_block(row, "1", names), _block(row, "2", names), row["b1"] == row["b2"])
                if out is not None:
                    yield pd.DataFrame(out)

    def run_tiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, b1, block, met in tile_rows(batches):
            for b2, other in met:
                out = fn(block, other, b1 == b2)
                if out is not None:
                    yield pd.DataFrame(out)

    headers = getattr(pairs, "headers", None)
    if headers is not None:
        width = tile_width(headers[0], TILE_BLOCKS)
        if width > 1:
            return _tiled(*headers, width).mapInPandas(run_tiles, schema)
    return pairs.mapInPandas(run, schema)


def _box_gower(p: Block, lo: np.ndarray, hi: np.ndarray, cats: Sequence | None) -> np.ndarray:
    off = np.maximum(lo - p.x, 0.0).sum(axis=1) + np.maximum(p.x - hi, 0.0).sum(axis=1)
    if cats is not None:
        off = off + (p.c != np.asarray(cats)).sum(axis=1)
    return off / max(1, p.x.shape[1] + p.c.shape[1])


def _box_euclidean(p: Block, lo: np.ndarray, hi: np.ndarray, cats: Sequence | None) -> np.ndarray:
    return np.sqrt((np.maximum(np.maximum(lo - p.x, p.x - hi), 0.0) ** 2).sum(axis=1))


def box_distance(metric: Metric, p: Block, lo: Sequence | None, hi: Sequence | None, cats: Sequence | None) -> np.ndarray:
    """A lower bound on the distance from each point of a block to any point of a box; ``cats`` as in ``p.c``, if all there share them."""
    plain = getattr(metric, "at_least", metric)
    boxes = {gower: _box_gower, euclidean: _box_euclidean}
    if plain not in boxes:
        return np.zeros(len(p))
    none = np.empty(0)
    return boxes[plain](p, none if lo is None else np.asarray(lo, dtype=float), none if hi is None else np.asarray(hi, dtype=float), cats)


def _with_heads(own: DataFrame, pairs: DataFrame, heads: DataFrame) -> DataFrame:
    """Packed blocks with the headers of the blocks that they are paired with."""
    head = F.struct("b2", "lo2", "hi2", "cat2", "only2")
    listed = pairs.select("b1", "b2").join(heads.select("b2", "lo2", "hi2", "cat2", "only2"), "b2")
    listed = listed.groupBy("b1", F.floor(F.col("b2") / HEADS).alias("part")).agg(F.collect_list(head).alias("heads"))
    return spread(listed, "b1", "part").join(own.select("b1", "ids1", "xs1", "cs1", "es1", "n1", "k1", "u1"), "b1")


def _leaving(row: dict, metric: Metric) -> Iterator[tuple[int, Block, np.ndarray]]:
    """For each block paired with that of a row of ``_with_heads``: the points that go there."""
    names: dict[str, int] = {}
    p = _block(row, "1", names)
    k, u = np.asarray(row["k1"]), np.asarray(row["u1"], dtype=float)
    for head in row["heads"]:
        cats = None if head["cat2"] is None else [names.get(c, -1) for c in head["cat2"]]
        go = (u >= 0) & (box_distance(metric, p, head["lo2"], head["hi2"], cats) <= u + 1e-9)
        if head["only2"] is not None:
            go &= k != head["only2"]
        yield head["b2"], p, np.flatnonzero(go)


def visits(own: DataFrame, pairs: DataFrame, heads: DataFrame, metric: Metric = gower) -> DataFrame:
    """Points of a block as visitors of the other blocks whose bounding box is within their reach.

    ``own``: packed blocks with ``u1``, the reach of each point (a negative one stays at home), and its component
    ``k1``. ``pairs``: ``b1, b2`` to be looked at. ``heads``: the packed blocks that are visited, tag 2, with
    ``only2``: the component of all their points, whose other points do not come.
    """
    id_type = dict(own.dtypes)["ids1"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                text = np.array(list(row["cs1"]), dtype=object).reshape(int(row["n1"]), -1)
                k, u = np.asarray(row["k1"]), np.asarray(row["u1"], dtype=float)
                out = []
                for b2, p, i in _leaving(row, metric):
                    if len(i):
                        out.append((row["b1"], b2, p.ids[i], p.x[i].ravel(), text[i].ravel(), p.extra[i].ravel(), len(i), k[i], u[i]))
                if out:
                    yield pd.DataFrame(out, columns=["b1", "b2", "ids1", "xs1", "cs1", "es1", "n1", "k1", "u1"])

    kind = f"b1 int, b2 int, ids1 {id_type}, xs1 array<double>, cs1 array<string>, es1 array<double>, n1 long, k1 array<long>, u1 array<double>"
    return cut_lineage(_with_heads(own, pairs, heads).mapInPandas(run, kind), "visits", FILE_ROWS)


def leaving(own: DataFrame, pairs: DataFrame, heads: DataFrame, metric: Metric = gower) -> DataFrame:
    """``b1, b2, go, n1``: how many points of a block would be ``visits`` at another one; those with none are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                out = [(row["b1"], b2, len(i), int(row["n1"])) for b2, _, i in _leaving(row, metric) if len(i)]
                if out:
                    yield pd.DataFrame(out, columns=["b1", "b2", "go", "n1"])

    return cut_lineage(_with_heads(own, pairs, heads).mapInPandas(run, "b1 int, b2 int, go long, n1 long"), "leaving")


def hosted(visitors: DataFrame, hosts: DataFrame) -> DataFrame:
    """Rows for ``host_rows``: each block that is visited, then its visitors; ``hosts`` are packed, tag 2, with ``k2``."""
    came = visitors.withColumn("part", F.floor(F.col("b1") / VISITS)).withColumn("side", F.lit(1))
    there = came.select("b2", "part").distinct().join(hosts.select(*[f"{c}2" for c in ("b", "ids", "xs", "cs", "es", "n", "k")]), "b2")
    there = there.withColumnsRenamed({f"{c}2": f"{c}1" for c in ("ids", "xs", "cs", "es", "n", "k")})
    there = there.withColumns({"b1": F.col("b2"), "u1": F.array().cast("array<double>"), "side": F.lit(0)})
    both = there.unionByName(came)
    return spread(both, "b2", "part").sortWithinPartitions("b2", "part", "side", "b1")


def host_rows(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[Block, np.ndarray, np.ndarray, Block, np.ndarray]]:
    """Visitors with their components and reach, and the block visited with its components.

    A row of side 2 is a block that visits itself.
    """
    host, kb, names = None, None, {}
    for batch in batches:
        for row in batch.to_dict("records"):
            if row["side"] == 0:
                names = {}
            block, k = _block(row, "1", {} if row["side"] == 2 else names), np.asarray(row["k1"])
            if row["side"] == 0:
                host, kb = block, k
            elif row["side"] == 1:
                yield block, k, np.asarray(row["u1"], dtype=float), host, kb
            else:
                yield block, k, np.asarray(row["u1"], dtype=float), block, k


def taken(block: Block, at: np.ndarray) -> Block:
    return Block(block.ids[at], block.x[at], block.c[at], block.extra[at])


def near_pairs(points: DataFrame, max_dist: float, metric: Metric = gower) -> DataFrame:
    """Pairs of points at most ``max_dist`` apart, each once."""

    def fn(a: Block, b: Block, same: bool):
        d = metric(a, b)
        i, j = np.nonzero(np.triu(d <= max_dist, 1) if same else d <= max_dist)
        ia, ib = a.ids[i], b.ids[j]
        swap = ia > ib
        return {"id_a": np.where(swap, ib, ia), "id_b": np.where(swap, ia, ib), "dist": d[i, j]}

    pairs = block_pairs(blocked(points), within=max_dist, metric=metric)
    return reduce_pairs(pairs, fn, "id_a string, id_b string, dist double")


def weight_within(points_blocked: DataFrame, max_dist: float, weight: str = "w", metric: Metric = gower) -> DataFrame:
    """Total weight of the points at most ``max_dist`` from each point, itself included."""

    def fn(a: Block, b: Block, same: bool):
        near = metric(a, b) <= max_dist
        left = near @ b.extra[:, 0]
        if same:
            return {"id": a.ids, "weight": left}
        return {"id": np.concatenate([a.ids, b.ids]), "weight": np.concatenate([left, near.T @ a.extra[:, 0]])}

    pairs = block_pairs(points_blocked, extra=[weight], within=max_dist, metric=metric)
    parts = reduce_pairs(pairs, fn, "id string, weight double")
    return parts.groupBy("id").agg(F.sum("weight").alias("weight"))


def weight_reaching(points_blocked: DataFrame, max_dist: float, enough: float, weight: str = "w", metric: Metric = gower) -> DataFrame:
    """Total weight of the points at most ``max_dist`` from each point; where it is ``enough``, maybe less than all, but enough.

    Points that have enough in their own block go to no other one.
    """
    packed = cut_lineage(_packed(points_blocked, [weight], "1"), "packed")

    def home(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                a = _block(row, "1", {})
                held = (metric(a, a) <= max_dist) @ a.extra[:, 0]
                yield pd.DataFrame([(row["b1"], a.ids, held, np.where(held < enough, max_dist, -1.0))], columns=["b1", "ids", "held", "u1"])

    def away(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for a, _, _, b, _ in host_rows(batches):
            yield pd.DataFrame({"id": a.ids, "weight": (metric(a, b) <= max_dist) @ b.extra[:, 0]})

    inside = spread(packed, "b1").mapInPandas(home, "b1 int, ids array<string>, held array<double>, u1 array<double>")
    inside = cut_lineage(inside, "inside")
    heads = packed.withColumnsRenamed({c: c[:-1] + "2" for c in packed.columns})
    lacking = inside.filter(F.array_max("u1") >= 0).select("b1")
    pairs = header_pairs(packed, heads, False, metric).filter((F.col("b1") != F.col("b2")) & (F.col("bound") <= max_dist + 1e-9)).join(lacking, "b1")
    own = packed.join(inside.select("b1", "u1"), "b1").withColumn("k1", F.array_repeat(F.lit(0).cast("long"), F.col("n1").cast("int")))
    came = visits(own, pairs, heads.withColumn("only2", F.lit(None).cast("long")), metric)
    there = hosted(came, heads.withColumn("k2", F.array().cast("array<long>"))).mapInPandas(away, "id string, weight double")
    here = inside.select(F.explode(F.arrays_zip("ids", "held")).alias("p")).select(F.col("p.ids").alias("id"), F.col("p.held").alias("weight"))
    return here.union(there).groupBy("id").agg(F.sum("weight").alias("weight"))


class _Distances:
    """Rows of the distance matrix of a block, made as they are asked for."""

    def __init__(self, metric: Metric, block: Block):
        self.metric, self.block = metric, block

    def __len__(self) -> int:
        return len(self.block)

    def __getitem__(self, i: int) -> np.ndarray:
        b = self.block
        return self.metric(Block(b.ids[i : i + 1], b.x[i : i + 1], b.c[i : i + 1], b.extra[i : i + 1]), b)[0]


def _spanning(d: np.ndarray | _Distances, ids: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges of the minimum spanning forest of the points of one task, by rows of their distances (Prim 1957).

    Edges are ordered by distance, then smaller id, then larger id, as everywhere else; so
    the forest is unique and does not depend on how points were cut into blocks.
    """
    m = len(d)
    place = np.empty(m, dtype=np.int64)
    place[np.argsort(ids.astype(str), kind="stable")] = np.arange(m)
    best, tie = np.full(m, np.inf), np.full(m, m * m)
    source = np.zeros(m, dtype=int)
    out = np.ones(m, dtype=bool)
    rows = []
    current = 0
    for _ in range(m):
        out[current] = False
        order = np.minimum(place[current], place) * m + np.maximum(place[current], place)
        row = d[current]
        closer = out & ((row < best) | (row == best) & (order < tie))
        best[closer], tie[closer], source[closer] = row[closer], order[closer], current
        if not out.any():
            break
        nearest = np.flatnonzero(out & (best == best[out].min()))
        nxt = int(nearest[np.argmin(tie[nearest])])
        if best[nxt] <= limit:
            rows.append((source[nxt], nxt, best[nxt]))
        current = nxt
    if not rows:
        empty = np.array([], dtype=int)
        return empty, empty, np.array([])
    i, j, w = zip(*rows)
    return np.array(i), np.array(j), np.array(w)


def one_tree(points_blocked: DataFrame, limit: float, metric: Metric = gower, extra: Sequence[str] = ()) -> DataFrame:
    """The minimum spanning forest ``a, b, dist`` of points that are one block; memory is linear in them."""

    def fn(a: Block, b: Block, same: bool):
        i, j, w = _spanning(_Distances(metric, a), a.ids, limit)
        if not len(i):
            return None
        ia, ib = a.ids[i], a.ids[j]
        swap = ia > ib
        return {"a": np.where(swap, ib, ia), "b": np.where(swap, ia, ib), "dist": w}

    return reduce_pairs(block_pairs(points_blocked, extra=extra, metric=metric), fn, "a string, b string, dist double")


def _closest(
    a: Block, b: Block, k: int, metric: Metric, skip_self: bool, most: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and distances of the ``k`` nearest points of a block to each of another, ties by id.

    Under Euclidean distance a product of matrices, which rounds otherwise, only rules out points that
    are farther by more than any rounding; the distances of the rest are worked out as everywhere else.
    Points farther than ``most`` of each point are left out.
    """
    place = np.empty(len(b), dtype=np.int64)
    place[np.argsort(b.ids.astype(str), kind="stable")] = np.arange(len(b))
    d = None
    if metric is euclidean and k < len(b):
        centre = b.x.mean(axis=0)
        xa, xb = a.x - centre, b.x - centre
        sa, sb = (xa**2).sum(axis=1), (xb**2).sum(axis=1)
        slack = 1e-11 * ((a.x**2).sum(axis=1) + (b.x**2).sum(axis=1).max() + (centre**2).sum())
        if np.isfinite(sa.sum() + sb.sum()):
            # The squares go with the product.
            d = np.column_stack([-2.0 * xa, sa, np.ones(len(a))]) @ np.column_stack([xb, np.ones(len(b)), sb]).T
    exact = d is None
    if exact:
        d, slack = metric(a, b), np.zeros(len(a))
    if skip_self:
        d = np.where(a.ids[:, None] == b.ids[None, :], np.inf, d)
    near = None
    if most is not None:
        # Rounding of the bound itself shall lose no point.
        bound = most * (1 + 1e-12)
        near = d <= (bound if exact else bound**2 + slack)[:, None]
        if np.count_nonzero(near) > 4 * k * len(a):
            near = None
    if near is None:
        kth = np.partition(d, min(k, len(b)) - 1, axis=1)[:, min(k, len(b)) - 1]
        near = d <= (kth + slack)[:, None]
    i, j = np.nonzero(near)
    real = np.isfinite(d[i, j])
    i, j = i[real], j[real]
    if exact:
        found = d[i, j]
    else:
        found = np.zeros(len(i))
        for f in range(a.x.shape[1]):
            found += (a.x[i, f] - b.x[j, f]) ** 2
        found = np.sqrt(found)
    order = np.lexsort((place[j], found, i))
    i, j, found = i[order], j[order], found[order]
    rank = np.arange(len(i)) - np.searchsorted(i, i)
    keep = rank < k
    if most is not None:
        keep &= found <= bound[i]
    return i[keep], j[keep], found[keep]


def nearest_k(
    left: DataFrame, right: DataFrame, k: int, metric: Metric = euclidean, carry: Sequence[str] = (), skip_self: bool = False
) -> DataFrame:
    """The ``k`` nearest right points of each left point, ties by id, with ``rank`` 1..k.

    In two steps: each left block meets the closest right blocks that have enough points, and the
    farthest of what each point finds there bounds it. Then a point goes only to blocks whose
    bounding box is not farther. Where that is many of a block's points, as among many features, the
    block goes whole, once to a tile of blocks, and each point passes on the ``k`` nearest of a tile.
    Ranking keeps ``k`` of all rows before the shuffle and after; no list of blocks is gathered.
    """

    def as_rows(a: Block, b: Block, i: np.ndarray, j: np.ndarray, d: np.ndarray) -> dict:
        return {"id": a.ids[i], "neighbour": b.ids[j], "dist": d} | {name: b.extra[j, e] for e, name in enumerate(carry)}

    def fn(a: Block, b: Block, same: bool, most: np.ndarray | None = None):
        return as_rows(a, b, *_closest(a, b, k, metric, skip_self, most))

    schema = "id string, neighbour string, dist double" + "".join(f", {c} double" for c in carry)
    placed = blocked(left)
    a = cut_lineage(_packed(placed, [], "1"), "packed", FILE_ROWS)
    b = cut_lineage(_packed(blocked(right), list(carry), "2"), "packed", FILE_ROWS)
    heads = cut_lineage(header_pairs(a, b, False, metric), "headers")
    # Headers of the blocks that a left block may meet, nearest first.
    nearer = F.sum("n2").over(Window.partitionBy("b1").orderBy("bound", "b2")) - F.col("n2")
    closest = cut_lineage(heads.withColumn("nearer", nearer).filter(F.col("nearer") < k + int(skip_self)).select("b1", "b2"), "closest")
    near = cut_lineage(reduce_pairs(with_points(closest, a, b), fn, schema), "near")

    place = F.row_number().over(Window.partitionBy("id").orderBy("dist", "neighbour"))
    farthest = near.withColumn("rank", place).filter(F.col("rank") <= k).groupBy("id").agg(F.when(F.count("*") >= k, F.max("dist")).alias("kth"))
    reach = placed.select("id", F.col("block").alias("b1")).join(farthest, "id", "left").withColumn("kth", F.coalesce("kth", F.lit(float("inf"))))
    reach = reach.groupBy("b1").agg(F.max("kth").alias("reach"), F.array_sort(F.collect_list(F.struct("id", "kth"))).alias("r"))
    reach = cut_lineage(reach.select("b1", "reach", F.col("r.kth").alias("u1")), "reach")
    others = heads.join(closest, ["b1", "b2"], "left_anti").join(reach.select("b1", "reach"), "b1").filter(F.col("bound") <= F.col("reach") + 1e-9)
    none = F.lit(None).cast("long")
    own = a.join(reach.select("b1", "u1"), "b1").withColumn("k1", F.array_repeat(F.lit(0).cast("long"), F.col("n1").cast("int")))
    there = leaving(own, others, b.withColumn("only2", none), metric)
    many = F.col("go") * WHOLE > F.col("n1")
    came = visits(own, there.filter(~many), b.withColumn("only2", none), metric)
    rows = hosted(came, b.withColumn("k2", F.array().cast("array<long>")))

    def visited(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for left_part, _, reached, right_part, _ in host_rows(batches):
            yield pd.DataFrame(fn(left_part, right_part, False, reached))

    def of_tile(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, _, left_block, met in tile_rows(batches):
            reached, best = left_block.extra[:, 0].copy(), None
            for _, right_block in met:
                i, j, d = _closest(left_block, right_block, k, metric, skip_self, reached)
                part = pd.DataFrame(as_rows(left_block, right_block, i, j, d) | {"i": i})
                best = part if best is None else pd.concat([best, part], ignore_index=True)
                if len(part):
                    best = best.sort_values(["i", "dist", "neighbour"], ignore_index=True)
                    rank = best.groupby("i").cumcount()
                    full = best[rank == k - 1]
                    reached[full["i"]] = np.minimum(reached[full["i"]], full["dist"])
                    best = best[rank < k]
            yield best.drop(columns="i")

    found = near.union(rows.mapInPandas(visited, schema))
    whole = cut_lineage(there.filter(many).select("b1", "b2"), "whole")
    if not whole.isEmpty():
        numbers = BLOCK_ROWS * max(1, a.select(F.max(F.size("xs1") / F.col("n1"))).first()[0])
        width = max(1, tile_width(whole, max(1, int(TILE_NUMBERS // numbers))))
        found = found.union(_tiled(whole, own.withColumn("es1", F.col("u1")), b, width).mapInPandas(of_tile, schema))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("id", "rank", "neighbour", "dist", *carry)
