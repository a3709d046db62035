"""Clusterings of points under Gower or Euclidean distance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from sensorloom.operators.blocks import (
    Metric,
    _packed,
    blocked,
    gower,
    header_pairs,
    host_rows,
    hosted,
    near_pairs,
    profiles,
    to_members,
    visits,
    weight_reaching,
)
from sensorloom.operators.forest import components, cut_tree
from sensorloom.operators.spanning import spanning_forest
from sensorloom.scratch import cut_lineage

NOISE = "-1"


def gower_pairs(points: DataFrame, max_dist: float) -> DataFrame:
    """Pairs of different profiles within a distance, as ``id_a, id_b, dist``.

    Equal points are one profile, so a third of all sensors being copies adds no pairs.
    """
    return near_pairs(profiles(points), max_dist, gower)


def _with_keys(shapes: DataFrame, per_id: DataFrame) -> DataFrame:
    return shapes.join(per_id, "id")


def agglom_single(points: DataFrame, clusters: int, metric: Metric = gower) -> DataFrame:
    """Single-linkage clusters ``id, cluster``, each named by its smallest id."""
    shapes = cut_lineage(profiles(points), "profiles")
    tree = spanning_forest(blocked(shapes), metric=metric)
    root = cut_tree(shapes, cut_lineage(tree, "tree"), clusters).withColumnRenamed("root", "cluster")
    return to_members(points, _with_keys(shapes, root), "cluster")


def agglom_threshold(points: DataFrame, max_dist: float, metric: Metric = gower) -> DataFrame:
    """Single-linkage clusters cut at a distance instead of a number of clusters."""
    shapes = cut_lineage(profiles(points), "profiles")
    edges = spanning_forest(blocked(shapes), max_dist, metric)
    root = components(shapes, edges).withColumnRenamed("root", "cluster")
    return to_members(points, _with_keys(shapes, root), "cluster")


def dbscan(points: DataFrame, eps: float = 0.15, min_samples: int = 5, metric: Metric = gower) -> DataFrame:
    """Density clusters ``id, cluster``, named by their smallest core id; noise is ``-1``.

    Copies count towards the density of their profile. A border point joins the cluster
    with the smallest name among those in reach.
    """
    shapes = blocked(profiles(points))
    density = weight_reaching(shapes, eps, min_samples, metric=metric)
    rated = cut_lineage(shapes.join(density, "id").withColumn("core", F.col("weight") >= min_samples), "rated")
    core = rated.filter("core")
    edges = cut_lineage(spanning_forest(core, eps, metric), "edges")
    named = cut_lineage(components(core, edges), "cores")
    # Core points carry the name of their cluster in front of their id.
    numbered = core.join(named, "id").withColumn("id", F.concat_ws("\u0001", "root", "id"))

    def reach(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, names, number = None, None, None
        for a, _, _, b, _ in host_rows(batches):
            if b is not held:
                held = b
                names, number = np.unique(np.array([str(i).split("\u0001", 1)[0] for i in b.ids]), return_inverse=True)
            first = np.where(metric(a, b) <= eps, number[None, :], len(names)).min(axis=1)
            hit = first < len(names)
            if hit.any():
                yield pd.DataFrame({"id": a.ids[hit], "cluster": names[first[hit]]})

    edge = rated.filter("not core")
    if core.isEmpty() or edge.isEmpty():
        border = spark_empty(points, "id string, cluster string")
    else:
        own, hosts = cut_lineage(_packed(edge, [], "1"), "packed"), cut_lineage(_packed(numbered, [], "2"), "packed")
        pairs = header_pairs(own, hosts, False, metric).filter(F.col("bound") <= eps + 1e-9)
        count = F.col("n1").cast("int")
        own = own.withColumns({"u1": F.array_repeat(F.lit(float(eps)), count), "k1": F.array_repeat(F.lit(0).cast("long"), count)})
        came = visits(own, pairs, hosts.withColumn("only2", F.lit(None).cast("long")), metric)
        found = hosted(came, hosts.withColumn("k2", F.array().cast("array<long>"))).mapInPandas(reach, "id string, cluster string")
        border = found.groupBy("id").agg(F.min("cluster").alias("cluster"))
    placed = named.select("id", F.col("root").alias("cluster")).union(border)
    out = rated.select("id", "x", "c").join(placed, "id", "left").withColumn("cluster", F.coalesce("cluster", F.lit(NOISE)))
    return to_members(points, out, "cluster")


def spark_empty(df: DataFrame, schema: str) -> DataFrame:
    return df.sparkSession.createDataFrame([], schema)


def silhouette_points(points: DataFrame, labels: DataFrame) -> DataFrame:
    """Silhouette of every point under Gower distance, without forming a pair.

    Per feature, the distances from a value to all members of a cluster need only counts and
    sums of the members below it: sum|v - y| = v (2 below - n) + total - 2 sum_below. So the
    mean distance of a point to each cluster is a sum over features of running sums.
    """
    rows = points.join(labels, "id").select("id", "x", "c", "cluster")
    sizes = rows.groupBy("cluster").agg(F.count("*").alias("size"))
    width = F.size("x") + F.size("c")
    numeric = rows.select("id", "cluster", F.posexplode("x").alias("f", "v"))
    grid = numeric.groupBy("f", "cluster", "v").agg(F.count("*").alias("n"))
    # A feature's axis in slices: running sums inside a slice, plus the totals of the slices below.
    grid = grid.withColumn("s", F.floor(F.col("v") * 512).cast("long"))
    slices = grid.groupBy("f", "cluster", "s").agg(F.sum("n").alias("sn"), F.sum(F.col("n") * F.col("v")).alias("sv"))
    totals = grid.groupBy("f", "cluster").agg(F.sum("n").alias("tn"), F.sum(F.col("n") * F.col("v")).alias("tv"))
    # Every distinct value of a feature asks every cluster.
    asked = numeric.select("f", "v").distinct().withColumn("s", F.floor(F.col("v") * 512).cast("long"))
    asks = asked.join(totals, "f")
    up = Window.partitionBy("f", "cluster", "s").orderBy("v", "ask")
    marked = asks.select("f", "cluster", "s", "v", F.lit(0).alias("n"), F.lit(1).alias("ask")).unionByName(
        grid.select("f", "cluster", "s", "v", "n", F.lit(0).alias("ask"))
    )
    within = marked.withColumns(
        {"bn": F.sum("n").over(up), "bv": F.sum(F.col("n") * F.col("v")).over(up)}
    ).filter("ask = 1")
    ask_slices = asked.select("f", "s").distinct().join(totals.select("f", "cluster"), "f")
    below = Window.partitionBy("f", "cluster").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ask_slices.join(slices, ["f", "cluster", "s"], "left")
        .na.fill(0, ["sn", "sv"])
        .withColumns({"on": F.coalesce(F.sum("sn").over(below), F.lit(0)), "ov": F.coalesce(F.sum("sv").over(below), F.lit(0.0))})
        .select("f", "cluster", "s", "on", "ov")
    )
    bn, bv = F.col("bn") + F.col("on"), F.col("bv") + F.col("ov")
    by_value = (
        within.join(offsets, ["f", "cluster", "s"])
        .join(totals, ["f", "cluster"])
        .select("f", "v", F.col("cluster").alias("other"), (F.col("v") * (2 * bn - F.col("tn")) + F.col("tv") - 2 * bv).alias("d"))
    )
    numeric_d = numeric.join(by_value, ["f", "v"]).select("id", "other", "d")
    cats = rows.select("id", "cluster", F.posexplode("c").alias("f", "k"))
    same = cats.groupBy("f", "k", F.col("cluster").alias("other")).agg(F.count("*").alias("n"))
    # Start from a mismatch with every member and take the matches back.
    match = cats.join(same, ["f", "k"]).select("id", "other", (-F.col("n")).cast("double").alias("d"))
    parts = numeric_d.unionByName(match).groupBy("id", "other").agg(F.sum("d").alias("d"))
    shape = rows.select("id", "cluster", width.alias("p"), F.size("c").alias("pc"))
    others = sizes.agg(F.collect_list(F.struct(F.col("cluster").alias("other"), "size")).alias("all")).scalar()
    reach = shape.withColumn("o", F.explode(others)).select("id", "cluster", "p", "pc", "o.other", "o.size")
    sums = reach.join(parts, ["id", "other"], "left").withColumn(
        "total", (F.coalesce("d", F.lit(0.0)) + F.col("pc") * F.col("size")) / F.col("p")
    )
    own = F.col("other") == F.col("cluster")
    per_point = sums.groupBy("id", "cluster").agg(
        F.max(F.when(own, F.col("size"))).alias("n"),
        F.max(F.when(own, F.col("total"))).alias("own"),
        F.min(F.when(~own, F.col("total") / F.col("size"))).alias("b"),
    )
    a = F.col("own") / (F.col("n") - 1)
    s = F.when(F.col("n") == 1, 0.0).otherwise(F.coalesce(F.try_divide(F.col("b") - a, F.greatest(a, "b")), F.lit(0.0)))
    return per_point.select("id", "cluster", s.alias("silhouette"))


def silhouette(points: DataFrame, labels: DataFrame) -> DataFrame:
    """Mean silhouette of a labelling, as one row."""
    return silhouette_points(points, labels).agg(F.avg("silhouette").alias("silhouette"))
