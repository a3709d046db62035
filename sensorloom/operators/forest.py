"""Connected components, and trees cut into components, as rounds of joins and aggregates.

Every round ends in a written table, so plans stay short and lost executors cost one round.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from sensorloom.scratch import cut_lineage

# Edges a task reduces at a time; bounds its memory whatever the partition size.
CHUNK_EDGES = 500_000


def _find(parent: dict, node):
    top = node
    while parent.setdefault(top, top) != top:
        top = parent[top]
    while parent[node] != top:
        parent[node], node = top, parent[node]
    return top


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += len(batch)
        if rows >= CHUNK_EDGES:
            yield pd.concat(held)
            held, rows = [], 0
    if held:
        yield pd.concat(held)


def local_stars(edges: DataFrame) -> DataFrame:
    """Before the rounds: the edges of each chunk become stars around their smallest ids.

    A partial aggregate for connectivity: the same nodes stay connected, with at most one
    edge per node and chunk.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for chunk in _chunks(batches):
            parent: dict = {}
            for a, b in zip(chunk["ra"], chunk["rb"]):
                a, b = _find(parent, a), _find(parent, b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
            ends = [(n, _find(parent, n)) for n in parent]
            yield pd.DataFrame([e for e in ends if e[0] != e[1]], columns=["ra", "rb"])

    return edges.mapInPandas(run, "ra string, rb string")


def roots(parents: DataFrame) -> DataFrame:
    """Follow ``parent`` to the top for every ``id``; each pass quadruples the step."""
    state = cut_lineage(parents.select("id", "parent"), "parents")
    while True:
        up = state.select(F.col("id").alias("parent"), F.col("parent").alias("up"))
        twice = state.join(up, "parent").select("id", F.col("up").alias("parent"), (F.col("up") != F.col("parent")).alias("moved"))
        again = twice.join(
            state.select(F.col("id").alias("parent"), F.col("parent").alias("up")), "parent"
        ).select("id", F.col("up").alias("parent"), "moved")
        nxt = cut_lineage(again, "parents")
        if nxt.filter("moved").isEmpty():
            return nxt.select("id", F.col("parent").alias("root"))
        state = nxt.select("id", "parent")


def _relabel(edges: DataFrame, root: DataFrame) -> DataFrame:
    """Replace the end components ``ra``, ``rb`` of edges by their roots."""
    first = root.select(F.col("id").alias("ra"), F.col("root").alias("na"))
    second = root.select(F.col("id").alias("rb"), F.col("root").alias("nb"))
    return (
        edges.join(first, "ra")
        .join(second, "rb")
        .drop("ra", "rb")
        .withColumnsRenamed({"na": "ra", "nb": "rb"})
        .filter("ra <> rb")
    )


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, root``: the smallest id of each node's component."""
    labels = nodes.select("id", F.col("id").alias("root"))
    start = edges.select(F.col("a").alias("ra"), F.col("b").alias("rb")).filter("ra <> rb").distinct()
    live = cut_lineage(local_stars(start), "edges")
    while not live.isEmpty():
        both = live.union(live.select("rb", "ra"))
        parents = both.groupBy("ra").agg(F.min("rb").alias("m")).select(
            F.col("ra").alias("id"), F.least("ra", "m").alias("parent")
        )
        root = roots(parents)
        moved = root.select(F.col("id").alias("root"), F.col("root").alias("_new"))
        labels = cut_lineage(
            labels.join(moved, "root", "left").select("id", F.coalesce("_new", "root").alias("root")), "labels"
        )
        live = cut_lineage(local_stars(_relabel(live, root).select("ra", "rb").distinct()), "edges")
    return labels


def cut_tree(nodes: DataFrame, tree: DataFrame, clusters: int) -> DataFrame:
    """Components after the ``clusters - 1`` longest edges of a tree are dropped."""
    longest = tree.orderBy(F.desc("dist"), F.desc("a"), F.desc("b")).limit(clusters - 1)
    kept = tree.join(longest.select("a", "b"), ["a", "b"], "left_anti") if clusters > 1 else tree
    return components(nodes, kept)
