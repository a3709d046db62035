"""Extremely randomised trees (Geurts, Ernst and Wehenkel 2006), grown level by level for all trees at once.

A node looks at some features that vary among its rows, draws one threshold for each between the
least and greatest value there, and keeps the split with the least Gini impurity. Trees are grown until
a node is pure or its rows are alike.

Nodes whose rows have more than ``LOCAL_CELLS`` features in all are split level by level: two aggregates
over the rows serve as many nodes of all trees as ``GROUP_CELLS`` figures hold: bounds of the features, then class
counts left of the thresholds. Below that a node's rows go to one task, which grows the rest of that tree; as
long as a whole tree is below it, a task grows several from the same rows. What tasks grow is a written
table; the driver holds only the nodes above.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from sensorloom.scratch import cut_lineage, spread

# Figures that a task sums up, and that come back, in one pass.
GROUP_CELLS = 400_000
CHUNK_CELLS = 4_000_000
#: Rows x features whose subtree one task grows, or which one task scores at a time.
LOCAL_CELLS = 20_000_000
#: Groups of trees that share their rows, while a whole tree fits a task.
BUNDLES = 16
#: Rows x features x trees that are sent to tasks at a time.
WAVE_CELLS = 800_000_000
_TREE = "g long, tree int, feature binary, threshold binary, left binary, at binary, class binary, n binary"


@dataclass
class Trees:
    """Nodes of all trees in one numbering, the roots first; a node without ``left`` is a leaf."""

    trees: int
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    counts: np.ndarray

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The node in which each row ends, rows x trees."""
        at = np.tile(np.arange(self.trees), (len(x), 1))
        rows = np.arange(len(x))[:, None]
        while (inner := self.left[at] >= 0).any():
            below = x[rows, self.feature[at]] <= self.threshold[at]
            at = np.where(inner, np.where(below, self.left[at], self.right[at]), at)
        return at

    def grown(self, nodes: np.ndarray, feature: np.ndarray, threshold: np.ndarray, counts: np.ndarray) -> Trees:
        """Two children for each of ``nodes``; ``counts`` holds the classes of the left ones, then the right ones."""
        n, first = len(nodes), len(self.left)
        none, zero = np.full(2 * n, -1), np.zeros(2 * n)
        out = Trees(
            self.trees,
            np.concatenate([self.feature, zero.astype(int)]),
            np.concatenate([self.threshold, zero]),
            np.concatenate([self.left, none]),
            np.concatenate([self.right, none]),
            np.concatenate([self.counts, counts]),
        )
        out.feature[nodes], out.threshold[nodes] = feature, threshold
        out.left[nodes], out.right[nodes] = first + np.arange(n), first + n + np.arange(n)
        return out


def _chunks(batches: Iterator[pd.DataFrame], cells: int) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    rows = max(1, CHUNK_CELLS // cells)
    for batch in batches:
        for at in range(0, len(batch), rows):
            part = batch.iloc[at : at + rows]
            yield part, np.stack(part["x"].to_numpy()).astype(float)


def _open_rows(model: Trees, slot: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows that lie in a node of the group, once per tree, and that node's place in the group."""
    mine = slot[model.leaves(x)]
    row, tree = np.nonzero(mine >= 0)
    return row, mine[row, tree]


def _bounds(rows: DataFrame, model: Trees, group: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest value of every feature in each node of the group."""
    slot = np.full(len(model.left), -1)
    slot[group] = np.arange(len(group))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lo, hi = np.full((len(group), dim), np.inf), np.full((len(group), dim), -np.inf)
        for _, x in _chunks(batches, model.trees * dim):
            row, mine = _open_rows(model, slot, x)
            if not len(row):
                continue
            order = np.argsort(mine, kind="stable")
            nodes, starts = np.unique(mine[order], return_index=True)
            values = x[row[order]]
            lo[nodes] = np.minimum(lo[nodes], np.minimum.reduceat(values, starts, axis=0))
            hi[nodes] = np.maximum(hi[nodes], np.maximum.reduceat(values, starts, axis=0))
        met = np.flatnonzero(lo.ravel() < np.inf)
        yield pd.DataFrame({"key": met, "lo": lo.ravel()[met], "hi": hi.ravel()[met]})

    parts = rows.mapInPandas(run, "key long, lo double, hi double")
    got = parts.groupBy("key").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).toPandas()  # group x features
    lo, hi = np.zeros(len(group) * dim), np.zeros(len(group) * dim)
    lo[got["key"]], hi[got["key"]] = got["lo"], got["hi"]
    return lo.reshape(-1, dim), hi.reshape(-1, dim)


def _left_counts(
    rows: DataFrame, model: Trees, group: np.ndarray, feature: np.ndarray, threshold: np.ndarray, classes: int
) -> np.ndarray:
    """Rows per class at or below each threshold: nodes of the group x thresholds x classes."""
    slot = np.full(len(model.left), -1)
    slot[group] = np.arange(len(group))
    shape = (*feature.shape, classes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(int(np.prod(shape)), dtype=np.int64)
        for part, x in _chunks(batches, model.trees * feature.shape[1]):
            row, mine = _open_rows(model, slot, x)
            below = x[row[:, None], feature[mine]] <= threshold[mine]
            label = part["label"].to_numpy().astype(int)[row]
            hit, k = np.nonzero(below)
            total += np.bincount((mine[hit] * shape[1] + k) * classes + label[hit], minlength=len(total))
        met = np.flatnonzero(total)
        yield pd.DataFrame({"key": met, "n": total[met]})

    got = rows.mapInPandas(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(int(np.prod(shape)))
    out[got["key"]] = got["n"]
    return out.reshape(shape)


def _impurity(counts: np.ndarray) -> np.ndarray:
    """Gini impurity times the number of rows."""
    n = counts.sum(axis=-1)
    return n - (counts**2).sum(axis=-1) / np.maximum(n, 1)


def _drawn(lo: np.ndarray, hi: np.ndarray, tries: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Per node ``tries`` features, varying ones first, and a threshold for each."""
    order = np.argsort(np.where(hi > lo, rng.random(lo.shape), 2.0), axis=1)[:, :tries]
    least, most = (np.take_along_axis(v, order, axis=1) for v in (lo, hi))
    cut = least + (most - least) * rng.random(order.shape)
    # Rounding may give the greatest value, with nothing above it.
    return order, np.where(cut < most, cut, least)


def _subtree(x: np.ndarray, label: np.ndarray, classes: int, tries: int, rng: np.random.Generator) -> Trees:
    """The tree of the rows of one task, level by level; ``x`` holds a row per feature."""
    model = Trees(1, np.zeros(1, dtype=int), np.zeros(1), np.full(1, -1), np.full(1, -1), np.bincount(label, minlength=classes)[None].astype(float))
    grown = [(model.feature, model.threshold, model.left, model.counts)]
    total = 1
    # Rows in the order of their nodes, and where each node starts.
    mine, starts = np.arange(len(label)), np.zeros(min(1, len(label)), dtype=int)
    open_ = np.zeros(len(starts), dtype=int)
    held = model.counts[open_]
    if (held > 0).sum() < 2:
        return model
    while len(open_):
        sizes = np.diff(np.append(starts, len(mine)))
        lo, hi = np.empty((len(open_), len(x))), np.empty((len(open_), len(x)))
        for f in range(len(x)):
            values = x[f][mine]
            lo[:, f], hi[:, f] = np.minimum.reduceat(values, starts), np.maximum.reduceat(values, starts)
        varies = (hi > lo).any(axis=1)
        mine = mine[np.repeat(varies, sizes)]
        open_, held, sizes, lo, hi = open_[varies], held[varies], sizes[varies], lo[varies], hi[varies]
        if not len(open_):
            break
        feature, threshold = _drawn(lo, hi, tries, rng)
        slot, y = np.repeat(np.arange(len(open_)), sizes), label[mine]
        below = np.empty((*feature.shape, classes))
        for t in range(feature.shape[1]):
            left = x[feature[slot, t], mine] <= threshold[slot, t]
            below[:, t] = np.bincount(slot[left] * classes + y[left], minlength=len(open_) * classes).reshape(-1, classes)
        above = held[:, None, :] - below
        cost = np.where(above.sum(axis=2) > 0, _impurity(below) + _impurity(above), np.inf)
        best, at = cost.argmin(axis=1), np.arange(len(open_))
        f, cut = feature[at, best], threshold[at, best]
        grown[-1][0][open_], grown[-1][1][open_] = f, cut
        grown[-1][2][open_] = total + 2 * at
        # Children stand side by side, the left one first.
        counts = np.stack([below[at, best], above[at, best]], axis=1).reshape(-1, classes)
        n = len(counts)
        grown.append((np.zeros(n, dtype=int), np.zeros(n), np.full(n, -1), counts))
        total += n
        child = 2 * slot + (x[f[slot], mine] > cut[slot])
        order = np.argsort(child, kind="stable")
        mixed = (counts > 0).sum(axis=1) > 1
        order = order[mixed[child[order]]]
        mine, child = mine[order], child[order]
        open_, held = np.flatnonzero(mixed), counts[mixed]
        starts = np.searchsorted(child, open_)
    feature, threshold, left, counts = (np.concatenate(v) for v in zip(*grown))
    return Trees(1, feature, threshold, left, np.where(left >= 0, left + 1, -1), counts)


def _record(g: int, tree: int, t: Trees) -> dict:
    leaves = np.where((t.left < 0)[:, None], t.counts, 0.0)
    at, k = np.nonzero(leaves)
    kinds = {"feature": (t.feature, np.int32), "threshold": (t.threshold, np.float64), "left": (t.left, np.int32), "at": (at, np.int32)}
    kinds |= {"class": (k, np.int32), "n": (leaves[at, k], np.float64)}
    return {"g": g, "tree": tree, **{name: v.astype(kind).tobytes() for name, (v, kind) in kinds.items()}}


def _read(r: dict, classes: int) -> Trees:
    """A tree of the table; only its leaves have counts."""
    left = np.frombuffer(r["left"], np.int32).astype(int)
    counts = np.zeros((len(left), classes))
    counts[np.frombuffer(r["at"], np.int32), np.frombuffer(r["class"], np.int32)] = np.frombuffer(r["n"])
    return Trees(1, np.frombuffer(r["feature"], np.int32), np.frombuffer(r["threshold"]), left, np.where(left >= 0, left + 1, -1), counts)


def _shares(counts: np.ndarray) -> np.ndarray:
    return counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)


@dataclass
class Forest:
    """Fitted trees: the upper nodes, which of their ends went to tasks, and a table of what those grew."""

    top: Trees
    sent: np.ndarray
    table: DataFrame
    split: bool

    def held(self) -> Trees:
        """All nodes on the driver, for few training rows."""
        top, classes = self.top, self.top.counts.shape[1]
        parts = [(top.feature.copy(), top.threshold.copy(), top.left.copy(), top.right.copy(), top.counts)]
        total = len(top.left)
        for r in self.table.orderBy("g", "tree").collect():
            t = _read(r.asDict(), classes)
            root = r["g"] if self.split else r["tree"]
            for i in np.flatnonzero(t.left >= 0)[::-1]:
                t.counts[i] = t.counts[t.left[i]] + t.counts[t.right[i]]
            left, right = (np.where(v >= 0, v + total - 1, -1) for v in (t.left, t.right))
            for whole, mine in zip(parts[0][:4], (t.feature, t.threshold, left, right)):
                whole[root] = mine[0]
            parts.append((t.feature[1:], t.threshold[1:], left[1:], right[1:], t.counts[1:]))
            total += len(left) - 1
        return Trees(top.trees, *(np.concatenate(v) for v in zip(*parts)))

    def predict(self, test: DataFrame) -> DataFrame:
        """``id, label, prediction, p_true``: mean class shares of the leaves, and the share of the true class."""
        top, sent, split = self.top, self.sent, self.split
        classes, trees = top.counts.shape[1], top.trees
        rows = cut_lineage(test.select("id", "label", "x").withColumn("row", F.monotonically_increasing_id()), "test")
        counted = rows.agg(F.count("*"), F.max(F.size("x"))).first()
        chunks = max(1, math.ceil(counted[0] * (counted[1] or 1) / LOCAL_CELLS))
        names = [f"p{k}" for k in range(classes)]
        schema = "row long, " + ", ".join(f"{n} double" for n in names)
        placed = _placed(rows.select("row", "x"), top, sent, split, np.arange(trees), "row long, x array<double>")
        placed = placed.withColumn("chunk", F.pmod(F.xxhash64("row"), F.lit(chunks)))
        table = self.table.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))))

        def score(mine: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
            p = np.zeros((len(part), classes))
            if len(part):
                x = np.stack(part["x"].to_numpy()).astype(float)
                for r in mine.sort_values("tree").to_dict("records"):
                    t = _read(r, classes)
                    p += _shares(t.counts)[t.leaves(x)[:, 0]]
            return pd.DataFrame({"row": part["row"].to_numpy(dtype=np.int64), **{n: p[:, k] for k, n in enumerate(names)}})

        def above(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            share = np.where(sent[:, None], 0.0, _shares(top.counts))
            for part, x in _chunks(batches, trees * classes):
                p = share[top.leaves(x)].sum(axis=1)
                yield pd.DataFrame({"row": part["row"], **{n: p[:, k] for k, n in enumerate(names)}})

        met = spread(table, "g", "chunk").groupBy("g", "chunk").cogroup(spread(placed, "g", "chunk").groupBy("g", "chunk"))
        parts = rows.select("row", "x").mapInPandas(above, schema).union(met.applyInPandas(score, schema))
        # Trees are added up in any order; what differs in the last digits is equal.
        mean = F.array(*[F.round(F.sum(n) / trees, 12) for n in names])
        out = rows.drop("x").join(parts.groupBy("row").agg(mean.alias("p")), "row")
        known = (F.col("label") >= 0) & (F.col("label") < classes)
        prediction = (F.array_position("p", F.array_max("p")) - 1).cast("double")
        return out.select("id", "label", prediction.alias("prediction"), F.when(known, F.get("p", F.col("label").cast("int"))).alias("p_true"))


def _placed(rows: DataFrame, top: Trees, sent: np.ndarray, split: bool, trees: np.ndarray, schema: str) -> DataFrame:
    """Rows with the group ``g`` that takes them: bundles of trees, or the node of each tree where they end."""
    if not split:
        return rows.withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(min(BUNDLES, top.trees) - 1).cast("long"))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, x in _chunks(batches, top.trees):
            ends = top.leaves(x)
            for tree in trees:
                mine = sent[ends[:, tree]]
                yield part[mine].assign(g=ends[mine, tree])

    return rows.mapInPandas(run, f"{schema}, g long")


def fit(train: DataFrame, trees: int = 100, seed: int = 0) -> Forest:
    """Trees from ``label`` (0, 1 ...) and ``x``; every tree sees every row."""
    rows = cut_lineage(train.select("label", "x"), "trees").cache()
    per_class = {int(r["label"]): r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    classes, dim = max(per_class) + 1, int(rows.select(F.size("x")).first()[0])
    whole = np.array([float(per_class.get(c, 0)) for c in range(classes)])
    none = np.full(trees, -1)
    top = Trees(trees, np.zeros(trees, dtype=int), np.zeros(trees), none, none.copy(), np.tile(whole, (trees, 1)))
    rng = np.random.default_rng(seed)
    tries = max(1, int(np.sqrt(dim)))
    most = max(1, LOCAL_CELLS // dim)
    split = whole.sum() > most
    alike = np.zeros(0, dtype=int)
    todo = np.arange(trees) if split and (whole > 0).sum() > 1 else np.arange(0)
    at_once = max(1, GROUP_CELLS // max(dim, tries * classes))
    while len(todo):
        group, todo = todo[:at_once], todo[at_once:]
        lo, hi = _bounds(rows, top, group, dim)
        varies = (hi > lo).any(axis=1)
        alike = np.concatenate([alike, group[~varies]])
        group, lo, hi = group[varies], lo[varies], hi[varies]
        if not len(group):
            continue
        feature, threshold = _drawn(lo, hi, tries, rng)
        below = _left_counts(rows, top, group, feature, threshold, classes)
        above = top.counts[group][:, None, :] - below
        # A feature that does not vary leaves nothing above.
        cost = np.where(above.sum(axis=2) > 0, _impurity(below) + _impurity(above), np.inf)
        best = cost.argmin(axis=1)
        at = np.arange(len(group))
        children = np.concatenate([below[at, best], above[at, best]])
        first = len(top.left)
        top = top.grown(group, feature[at, best], threshold[at, best], children)
        todo = np.concatenate([todo, first + np.flatnonzero(((children > 0).sum(axis=1) > 1) & (children.sum(axis=1) > most))])
    sent = (top.left < 0) & ((top.counts > 0).sum(axis=1) > 1)
    sent[alike] = False
    bundles = min(BUNDLES, trees)

    def finish(part: pd.DataFrame) -> pd.DataFrame:
        g = int(part["g"].iloc[0])
        x = np.ascontiguousarray(np.stack(part["x"].to_numpy()).astype(float).T)
        label = part["label"].to_numpy().astype(int)
        out = []
        for root in [g] if split else range(g, trees, bundles):
            out.append(_record(g, root, _subtree(x, label, classes, tries, np.random.default_rng([seed, 1, root]))))
        return pd.DataFrame(out, columns=[c.split()[0] for c in _TREE.split(", ")])

    table = None
    each = max(1, int(WAVE_CELLS // (whole.sum() * dim))) if split else trees
    for first in range(0, trees, each):
        wave = np.arange(first, min(trees, first + each))
        kinds = f"label {rows.schema['label'].dataType.simpleString()}, x array<double>"
        placed = _placed(rows, top, sent, split, wave, kinds)
        done = cut_lineage(spread(placed, "g").groupBy("g").applyInPandas(finish, _TREE), "trees")
        table = done if table is None else table.union(done)
    rows.unpersist()
    return Forest(top, sent | (not split), table, split)


def grow(train: DataFrame, trees: int = 100, seed: int = 0) -> Trees:
    """The trees of ``fit`` with all their nodes on the driver, for few training rows."""
    return fit(train, trees, seed).held()


def predict(model: Trees, test: DataFrame) -> DataFrame:
    """``id, label, prediction, p_true``: mean class shares of the leaves, and the share of the true class."""
    share = model.counts / np.maximum(model.counts.sum(axis=1, keepdims=True), 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, x in _chunks(batches, model.trees * share.shape[1]):
            p = share[model.leaves(x)].mean(axis=1)
            label = part["label"].to_numpy(dtype=float)
            known = (label >= 0) & (label < p.shape[1])
            true = p[np.arange(len(p)), np.where(known, label, 0).astype(int)]
            yield pd.DataFrame(
                {
                    "id": part["id"],
                    "label": part["label"],
                    "prediction": p.argmax(axis=1).astype(float),
                    "p_true": pd.Series(true, index=part.index).where(known),
                }
            )

    kind = {f.name: f.dataType.simpleString() for f in test.schema.fields}
    return test.select("id", "label", "x").mapInPandas(
        run, f"id {kind['id']}, label {kind['label']}, prediction double, p_true double"
    )


def as_rows(df: DataFrame) -> DataFrame:
    """Rows with their feature vector as an array ``x``."""
    return df.withColumn("x", vector_to_array("features"))
