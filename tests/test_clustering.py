import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorloom.operators import blocks as B
from sensorloom.operators import clustering as K
from sensorloom.operators import coordinates as X
from sensorloom.operators import forest as Fo
from sensorloom.operators import linkage as L
from sensorloom.operators import mixtures as Mx
from sensorloom.operators import spanning as Sp
from sensorloom.operators.flow import cluster
from sensorloom.scratch import cut_lineage


def make(spark, n=60, seed=1, dims=2, cats=("u", "v", "w"), copies=20):
    """Points with a third copies of one point."""
    rng = random.Random(seed)
    rows = [(f"p{i:03d}", [rng.random() for _ in range(dims)], [rng.choice(cats)] if cats else []) for i in range(n)]
    rows += [(f"q{i:03d}", rows[0][1], rows[0][2]) for i in range(copies)]
    return rows, spark.createDataFrame(rows, "id string, x array<double>, c array<string>")


def gower_matrix(rows):
    x = np.array([r[1] for r in rows])
    c = np.array([r[2] for r in rows])
    d = sum(np.abs(np.subtract.outer(x[:, j], x[:, j])) for j in range(x.shape[1]))
    if c.size:
        d = d + (c[:, 0][:, None] != c[:, 0][None, :])
    return d / (x.shape[1] + (1 if c.size else 0))


def naive_linkage(d, k, how, w=None):
    groups = [[i] for i in range(len(d))]
    while len(groups) > k:
        best = None
        for i in range(len(groups)):
            for j in range(i + 1, len(groups)):
                sub = d[np.ix_(groups[i], groups[j])]
                h = {"single": sub.min, "complete": sub.max, "average": sub.mean}[how]()
                if best is None or h < best[0]:
                    best = (h, i, j)
        _, i, j = best
        groups[i] += groups.pop(j)
    return groups


def partition(pairs):
    out = {}
    for i, c in pairs:
        out.setdefault(c, set()).add(i)
    return {frozenset(v) for v in out.values()}


@pytest.fixture(params=[1024, 16])
def block_rows(request, monkeypatch):
    monkeypatch.setattr(B, "BLOCK_ROWS", request.param)
    return request.param


def test_near_pairs_and_weights(spark, block_rows):
    rows, df = make(spark)
    d = gower_matrix(rows)
    distinct = rows[:60]
    want = {(a[0], b[0]) for i, a in enumerate(distinct) for j, b in enumerate(distinct) if i < j and d[i, j] <= 0.15}
    assert {(r["id_a"], r["id_b"]) for r in K.gower_pairs(df, 0.15).collect()} == want
    got = {r["id"]: r["weight"] for r in B.weight_within(B.blocked(B.profiles(df)), 0.15).collect()}
    assert got == {distinct[i][0]: float((d[i] <= 0.15).sum()) for i in range(60)}


@pytest.mark.parametrize("how", ["single", "average", "complete"])
def test_linkages_match_the_naive_algorithm(spark, monkeypatch, how):
    monkeypatch.setattr(B, "BLOCK_ROWS", 10)
    rows, df = make(spark, n=28, copies=10)
    run = (lambda: K.agglom_single(df, 5)) if how == "single" else (lambda: L.agglom(df, 5, how))
    got = partition((r["id"], r["cluster"]) for r in run().collect())
    want = {frozenset(rows[i][0] for i in g) for g in naive_linkage(gower_matrix(rows), 5, how)}
    assert got == want


@pytest.mark.parametrize("block", [2, 4, 1024])
def test_single_linkage_of_a_grid_does_not_depend_on_blocks(spark, monkeypatch, block):
    """All distances between neighbours are equal, so ties decide everything."""
    monkeypatch.setattr(B, "BLOCK_ROWS", block)
    rows = [(f"g{i}{j}", [i / 5, j / 5], ["k"]) for i in range(6) for j in range(6)]
    df = spark.createDataFrame(rows, "id string, x array<double>, c array<string>")
    d = gower_matrix(rows)
    edges = sorted((d[i, j], rows[i][0], rows[j][0]) for i in range(36) for j in range(i + 1, 36))
    top = {r[0]: r[0] for r in rows}
    groups = 36
    for _, a, b in edges:
        if groups > 6 and top[a] != top[b]:
            old, new = max(top[a], top[b]), min(top[a], top[b])
            top = {k: new if v == old else v for k, v in top.items()}
            groups -= 1
    assert {r["id"]: r["cluster"] for r in K.agglom_single(df, 6).collect()} == top


def test_only_blocks_within_reach_get_points(spark, monkeypatch):
    monkeypatch.setattr(B, "BLOCK_ROWS", 10)
    rows = [(f"p{i:03d}", [i / 10], []) for i in range(100)]
    points = B.blocked(spark.createDataFrame(rows, "id string, x array<double>, c array<string>"))
    for metric in (B.gower, B.euclidean):
        formed = {(r["b1"], r["b2"]) for r in B.block_pairs(points, within=0.05, metric=metric).collect()}
        assert all(b - a <= 1 for a, b in formed) and len(formed) < 25
        assert B.block_pairs(points, metric=metric).count() == 55


def test_cluster_scales_features_first_where_the_kind_needs_it(spark):
    df = blobs(spark).withColumn("c", F.array().cast("array<string>"))
    for kind in ("ward", "kmeans", "single", "complete"):
        got = cluster(df, kind, 3, metric=B.euclidean)
        found = got.select(F.substring("id", 1, 2).alias("b"), "cluster").distinct().collect()
        assert len(found) == 3 and len({r["cluster"] for r in found}) == 3
    with pytest.raises(ValueError):
        cluster(df, "unknown", 3)


def test_ward_matches_the_naive_algorithm(spark, monkeypatch):
    monkeypatch.setattr(B, "BLOCK_ROWS", 10)
    rows, df = make(spark, n=28, cats=None, copies=10)
    groups = [[i] for i in range(len(rows))]
    x = np.array([r[1] for r in rows])
    while len(groups) > 4:
        best = min(
            ((len(a) * len(b) / (len(a) + len(b)) * ((x[a].mean(0) - x[b].mean(0)) ** 2).sum(), i, j)
             for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j))
        groups[best[1]] += groups.pop(best[2])
    got = partition((r["id"], r["cluster"]) for r in L.ward(df, 4).collect())
    assert got == {frozenset(rows[i][0] for i in g) for g in groups}


@pytest.mark.parametrize("how", ["average", "complete", "ward"])
def test_linkages_measure_only_clusters_that_lost_their_nearest(spark, monkeypatch, how):
    """Each point of a growing sequence is nearest to the one before it, so a round merges one pair."""
    monkeypatch.setattr(B, "BLOCK_ROWS", 5)
    rows = [(f"p{i}", [3.0**i], []) for i in range(10)]
    df = spark.createDataFrame(rows, "id string, x array<double>, c array<string>")
    measured, formed = [], L.block_pairs

    def counting(left, right, **options):
        measured.append((left.count(), right.count()))
        return formed(left, right, **options)

    monkeypatch.setattr(L, "block_pairs", counting)
    run = L.ward(df, 3) if how == "ward" else L.agglom(df, 3, how)
    got = partition((r["id"], r["cluster"]) for r in run.collect())
    assert got == {frozenset(f"p{i}" for i in range(8)), frozenset(["p8"]), frozenset(["p9"])}
    # Asked for are the cluster that has just merged and the point after it, with their members.
    want = [(10, 10)] + ([(2, 10 - i) for i in range(1, 5)] if how == "ward" else [(i + 2, 10) for i in range(1, 5)])
    assert measured[:5] == want


@pytest.mark.parametrize("how", ["average", "complete"])
def test_linkages_of_a_grid_end_however_ties_round(spark, monkeypatch, how):
    rows = [(f"g{i}{j}", [i / 7, j / 7], ["k"]) for i in range(4) for j in range(4)]
    df = spark.createDataFrame(rows, "id string, x array<double>, c array<string>")
    found = []
    for block in (6, 1024):
        monkeypatch.setattr(B, "BLOCK_ROWS", block)
        found.append(partition((r["id"], r["cluster"]) for r in L.agglom(df, 4, how).collect()))
        assert len(found[-1]) == 4 and sum(map(len, found[-1])) == 16
    assert how == "average" or found[0] == found[1]


def test_spanning_tree_weight(spark, block_rows):
    rows, df = make(spark, n=70, copies=0)
    d = gower_matrix(rows)
    edges = Sp.spanning_forest(B.blocked(df)).collect()
    i, j, w = B._spanning(d, np.array([r[0] for r in rows], dtype=object), math.inf)
    assert len(edges) == 69 and sum(e["dist"] for e in edges) == pytest.approx(w.sum())


def test_components_of_a_long_path(spark):
    n = 300
    order = list(range(n))
    random.Random(5).shuffle(order)
    edges = [(f"n{order[i]:03d}", f"n{order[i + 1]:03d}") for i in range(n - 1) if i != 120]
    e = spark.createDataFrame(edges, "a string, b string").repartition(8)
    nodes = spark.createDataFrame([(f"n{i:03d}",) for i in range(n)], "id string")
    got = partition((r["id"], r["root"]) for r in Fo.components(nodes, e).collect())
    assert got == {frozenset(f"n{v:03d}" for v in order[:121]), frozenset(f"n{v:03d}" for v in order[121:])}


def test_dbscan_matches_brute_force(spark, block_rows):
    rows, df = make(spark, n=80, copies=10)
    eps, least = 0.06, 5
    near = gower_matrix(rows) <= eps
    core = near.sum(1) >= least
    label = {}
    for i in [k for k in sorted(range(len(rows)), key=lambda k: rows[k][0]) if core[k]]:
        if i in label:
            continue
        todo, label[i] = [i], rows[i][0]
        while todo:
            k = todo.pop()
            for m in np.flatnonzero(near[k] & core):
                if m not in label:
                    label[m] = rows[i][0]
                    todo.append(m)
    want = {}
    for i, r in enumerate(rows):
        reach = [label[m] for m in np.flatnonzero(near[i] & core)]
        want[r[0]] = label.get(i) or (min(reach) if reach else K.NOISE)
    assert {r["id"]: r["cluster"] for r in K.dbscan(df, eps, least).collect()} == want


def test_silhouette_matches_brute_force(spark):
    rows, df = make(spark, n=50, copies=15)
    labels = {r[0]: i % 4 for i, r in enumerate(rows)}
    labels[rows[3][0]] = 9
    d = gower_matrix(rows)
    lab = np.array([labels[r[0]] for r in rows])
    want = {}
    for i, r in enumerate(rows):
        own = (lab == lab[i]).sum()
        a = d[i][lab == lab[i]].sum() / (own - 1) if own > 1 else 0
        b = min(d[i][lab == c].mean() for c in set(lab) if c != lab[i])
        want[r[0]] = 0.0 if own == 1 else (b - a) / max(a, b)
    frame = spark.createDataFrame(list(labels.items()), "id string, cluster int")
    got = {r["id"]: r["silhouette"] for r in K.silhouette_points(df, frame).collect()}
    assert got == pytest.approx(want)


def test_nearest_k_and_kth_distance(spark, block_rows):
    rows, df = make(spark, n=50, cats=None, copies=0)
    x = np.array([r[1] for r in rows])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    near = {}
    for r in B.nearest_k(df, df, 3, skip_self=True).collect():
        near.setdefault(r["id"], {})[r["rank"]] = r["neighbour"]
    for i, r in enumerate(rows):
        assert [near[r[0]][k] for k in (1, 2, 3)] == [rows[j][0] for j in np.argsort(d[i])[1:4]]
    kth = {r["id"]: r["dist"] for r in X.kth_distance(B.blocked(df), 10).collect()}
    assert kth == pytest.approx({rows[i][0]: np.sort(d[i])[9] for i in range(50)}, abs=1e-5)


def blobs(spark, per=30, seed=2):
    rng = np.random.default_rng(seed)
    rows = []
    for b, (cx, cy) in enumerate([(0, 0), (4, 0), (0, 4)]):
        rows += [(f"b{b}_{i:02d}", [float(cx + rng.normal(0, 0.2)), float(cy + rng.normal(0, 0.2))]) for i in range(per)]
    return spark.createDataFrame(rows, "id string, x array<double>")


@pytest.mark.parametrize(
    "run",
    [
        lambda c: Mx.kmeans(c, 3),
        lambda c: Mx.gmm(c, 3),
        lambda c: Mx.vb_gmm(c, 3),
        lambda c: X.mean_shift(c, bandwidth=1.0),
        lambda c: X.fuzzy_cmeans(c, 3, m=2.0),
    ],
    ids=["kmeans", "gmm", "vb_gmm", "mean_shift", "fuzzy"],
)
def test_coordinate_clusterings_find_blobs(spark, run):
    got = run(blobs(spark)).select(F.substring("id", 1, 2).alias("b"), "cluster").distinct().collect()
    assert len(got) == 3 and len({r["cluster"] for r in got}) == 3


def test_seeds_meet_a_far_cluster_however_small(spark):
    many = spark.range(60_000).select(
        F.col("id").cast("string").alias("id"), F.array(F.rand(1), F.rand(2)).alias("x")
    )
    far = spark.createDataFrame([("far0", [1000.0, 0.0]), ("far1", [1000.5, 0.0])], "id string, x array<double>")
    rows = many.unionByName(far)
    pool, weight = Mx.seed_pool(rows, 3)
    assert weight.sum() == 60_002 and len(pool) < 2 * Mx.SEED_ROUNDS * Mx.SEED_RATE * 3
    assert weight[pool[:, 0] > 900].sum() == 2
    got = Mx.kmeans(rows, 2, starts=3).groupBy("cluster").agg(F.count("*").alias("n")).collect()
    assert sorted(r["n"] for r in got) == [2, 60_000]


def test_seeds_of_equal_points(spark):
    rows = spark.createDataFrame([(str(i), [1.0, 2.0]) for i in range(20)], "id string, x array<double>")
    pool, weight = Mx.seed_pool(rows, 3)
    assert pool.tolist() == [[1.0, 2.0]] and weight.tolist() == [20.0]


def test_fuzzy_memberships_add_up(spark):
    out = X.fuzzy_cmeans(blobs(spark), 3)
    sums = out.select(F.aggregate("memberships", F.lit(0.0), lambda s, v: s + v).alias("s"))
    assert all(r["s"] == pytest.approx(1.0) for r in sums.collect())


def test_fuzzy_rounds_equal_plain_ones(spark):
    rng = np.random.default_rng(11)
    x = rng.random((9, 2))
    out = X.fuzzy_cmeans(spark.createDataFrame([(f"p{i}", v.tolist()) for i, v in enumerate(x)], "id string, x array<double>"), 12, m=2.0).collect()
    # As many clusters as points at most: each point is a centre of its own.
    assert len({r["cluster"] for r in out}) == 9
    assert all(max(r["memberships"]) == pytest.approx(1.0) and len(r["memberships"]) == 9 for r in out)


def test_mds_keeps_planar_distances(spark, block_rows):
    rows, df = make(spark, n=30, cats=None, copies=0)
    x = np.array([r[1] for r in rows])
    got = {r["id"]: r["x"] for r in X.mds_2d(df, max_iter=12, eps=1e-6, metric=B.euclidean).collect()}
    y = np.array([got[r[0]] for r in rows])
    dx = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    dy = np.sqrt(((y[:, None] - y[None]) ** 2).sum(-1))
    assert np.abs(dx - dy).mean() < 0.02


def count_pairs(monkeypatch, module=B):
    """Counts the block pairs that are given points."""
    seen = []
    real = module.with_points

    def counted(pairs, a, b):
        seen.append(pairs.count())
        return real(pairs, a, b)

    monkeypatch.setattr(module, "with_points", counted)
    return seen


@pytest.mark.parametrize("limit", [None, 0.02])
def test_spanning_forest_forms_few_pairs_and_edges(spark, monkeypatch, limit):
    monkeypatch.setattr(B, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(4)
    x = np.sort(rng.integers(0, 3000, 300)) / 1000 + 10 * (np.arange(300) // 60)
    rows = [(f"p{i:03d}", [float(v)], []) for i, v in enumerate(x)]
    points = spark.createDataFrame(rows, "id string, x array<double>, c array<string>")
    seen = []
    real = Sp._edges

    def counted(pairs, metric, most):
        found = real(pairs, metric, most)
        seen.append((pairs.count(), found.count()))
        return found

    monkeypatch.setattr(Sp, "_edges", counted)
    got = Sp.spanning_forest(B.blocked(points), limit, B.euclidean).collect()
    d = np.abs(np.subtract.outer(x, x))
    i, j, w = B._spanning(d, np.array([r[0] for r in rows], dtype=object), math.inf if limit is None else limit)
    want = {tuple(sorted((rows[a][0], rows[b][0]))) for a, b in zip(i, j)}
    assert {(e.a, e.b) for e in got} == want and len(got) == len(want)
    # Each round looks inside the blocks, then between them; 19 blocks have 171 pairs.
    assert all(out <= 300 for _, out in seen)
    assert seen[1][0] < 40


def test_spanning_forest_of_few_points(spark, monkeypatch):
    monkeypatch.setattr(B, "BLOCK_ROWS", 1)
    monkeypatch.setattr(Sp, "TASK_BLOCKS", 1)
    points = spark.createDataFrame([("a", [0.0], []), ("b", [1.0], []), ("c", [5.0], [])], "id string, x array<double>, c array<string>")
    got = Sp.spanning_forest(B.blocked(points), metric=B.euclidean).collect()
    assert sorted((e.a, e.b, e.dist) for e in got) == [("a", "b", 1.0), ("b", "c", 4.0)]
    assert Sp.spanning_forest(B.blocked(points.limit(0)), metric=B.euclidean).collect() == []
    assert Sp.spanning_forest(B.blocked(points.limit(1)), metric=B.euclidean).collect() == []


@pytest.mark.parametrize("k", [3, 20])
def test_nearest_k_meets_near_blocks_only(spark, monkeypatch, k):
    monkeypatch.setattr(B, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(3)
    x = np.sort(rng.random(400)) + 10 * (np.arange(400) // 80)
    rows = [(f"p{i:03d}", [float(v)], []) for i, v in enumerate(x)]
    points = spark.createDataFrame(rows, "id string, x array<double>, c array<string>")
    seen = count_pairs(monkeypatch)
    got = B.nearest_k(points, points, k, B.euclidean, skip_self=True).collect()
    for i, (name, _, _) in enumerate(rows):
        order = sorted((abs(x[i] - x[j]), rows[j][0]) for j in range(400) if j != i)[:k]
        mine = sorted((r for r in got if r.id == name), key=lambda r: r["rank"])
        assert [r.neighbour for r in mine] == [o[1] for o in order]
        assert [r.dist for r in mine] == pytest.approx([o[0] for o in order])
    assert sum(seen) < 25 * 25 / 3


@pytest.mark.parametrize("shift", [0.0, 1e4])
def test_closest_points_are_those_of_all_distances(monkeypatch, shift):
    rng = np.random.default_rng(12)
    x = np.round(rng.normal(size=(300, 16)), 1) + shift
    x[100:140] = x[0]  # copies: ties go by id
    block = lambda at: B.Block(np.array([f"p{i * 7919 % 300:03d}" for i in at], dtype=object), x[at], np.empty((len(at), 0), dtype=object), np.empty((len(at), 0)))
    a, b = block(np.arange(0, 120)), block(np.arange(60, 300))
    full = B.euclidean(a, b)
    monkeypatch.setattr(B.np, "subtract", None)  # no table of differences is formed
    for skip in (False, True):
        d = np.where(a.ids[:, None] == b.ids[None, :], np.inf, full) if skip else full
        i, j, found = B._closest(a, b, 5, B.euclidean, skip)
        for row in range(len(a)):
            want = sorted((d[row, c], b.ids[c]) for c in range(len(b)))[:5]
            assert [(v, b.ids[c]) for v, c in zip(found[i == row], j[i == row])] == want


def test_nearest_k_of_few_points(spark):
    points = spark.createDataFrame([("a", [0.0], []), ("b", [1.0], [])], "id string, x array<double>, c array<string>")
    got = B.nearest_k(points, points, 5, B.euclidean, skip_self=True).collect()
    assert sorted((r.id, r["rank"], r.neighbour) for r in got) == [("a", 1, "b"), ("b", 1, "a")]
    assert B.nearest_k(points, points.limit(0), 5, B.euclidean).collect() == []


@pytest.mark.parametrize("within", [None, 0.3])
def test_tiles_reduce_every_pair_of_blocks_once_and_send_a_block_once_to_each(spark, monkeypatch, within):
    monkeypatch.setattr(B, "BLOCK_ROWS", 3)
    rng = np.random.default_rng(8)
    rows = [(f"p{i:03d}", [float(v) for v in rng.random(2)], [rng.choice(["u", "v"])]) for i in range(70)]
    points = B.blocked(spark.createDataFrame(rows, "id string, x array<double>, c array<string>"))
    sent = []
    real = B._tiled
    monkeypatch.setattr(B, "_tiled", lambda *a: sent.append(real(*a)) or sent[-1])

    def fn(a, b, same):
        d = B.gower(a, b)
        i, j = np.nonzero(np.triu(d <= 0.3, 1) if same else d <= 0.3)
        return {"a": a.ids[i], "b": b.ids[j], "d": d[i, j]}

    pairs = B.block_pairs(points, within=within)
    got = B.reduce_pairs(pairs, fn, "a string, b string, d double").collect()
    want = {}
    for i, (p, x, c) in enumerate(rows):
        for q, y, k in rows[i + 1 :]:
            d = (abs(x[0] - y[0]) + abs(x[1] - y[1]) + (c != k)) / 3
            if d <= 0.3:
                want[p, q] = d
    assert len(got) == len(want)
    assert all(want[tuple(sorted((r["a"], r["b"])))] == pytest.approx(r["d"], abs=1e-12) for r in got)
    assert len(sent) == 1 and sent[0].count() < 1.5 * pairs.count()


def count_visitors(monkeypatch, *modules):
    """Counts the points that go to other blocks."""
    seen = []
    real = B.visits

    def counted(*args):
        came = real(*args)
        seen.append(came.agg(F.sum("n1")).first()[0] or 0)
        return came

    for module in modules:
        monkeypatch.setattr(module, "visits", counted)
    return seen


def far_groups(spark, n=240):
    """Three groups far apart, so that late rounds join components that fill their blocks."""
    rng = np.random.default_rng(21)
    x = rng.random((n, 3)) + 20 * (np.arange(n) % 3)[:, None]
    rows = [(f"p{i * 97 % n:03d}", [float(v) for v in p], []) for i, p in enumerate(x)]
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    return rows, d, spark.createDataFrame(rows, "id string, x array<double>, c array<string>")


def test_spanning_forest_sends_only_points_within_the_bound(spark, monkeypatch):
    monkeypatch.setattr(B, "BLOCK_ROWS", 16)
    rows, d, df = far_groups(spark)
    seen = count_visitors(monkeypatch, Sp)
    got = Sp.spanning_forest(B.blocked(df), metric=B.euclidean).collect()
    i, j, _ = B._spanning(d, np.array([r[0] for r in rows], dtype=object), math.inf)
    assert {(e.a, e.b) for e in got} == {tuple(sorted((rows[a][0], rows[b][0]))) for a, b in zip(i, j)}
    # The last round looks for edges between whole groups: a point goes to its nearest block, then most stay at home.
    assert len(seen) >= 6 and max(seen) <= 240 and seen[-1] < 60


def test_weight_reaching_stops_at_enough(spark, monkeypatch):
    monkeypatch.setattr(B, "BLOCK_ROWS", 16)
    rows, d, df = far_groups(spark)
    seen = count_visitors(monkeypatch, B)
    blocked = B.blocked(df.withColumn("w", F.lit(1.0)))
    whole = dict(zip([r[0] for r in rows], (d <= 0.3).sum(1)))
    got = {r["id"]: r["weight"] for r in B.weight_reaching(blocked, 0.3, 4, metric=B.euclidean).collect()}
    assert got.keys() == whole.keys()
    assert all(got[i] == whole[i] if whole[i] < 4 else 4 <= got[i] <= whole[i] for i in whole)
    assert seen[0] < 240 * 6


def test_cells_hold_equal_shares_and_are_small_in_all_features(spark, monkeypatch):
    monkeypatch.setattr(B, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(5)
    rows = [(f"p{i:04d}", [float(v) for v in rng.random(2)], ["u" if i % 4 else "v"]) for i in range(1024)]
    got = B.blocked(spark.createDataFrame(rows, "id string, x array<double>, c array<string>")).toPandas()
    wide = [max(np.ptp(np.stack(g["x"]), axis=0)) for _, g in got.groupby("block")]
    assert got["block"].nunique() == 64 and got.groupby("block").size().max() <= 20
    assert np.mean(wide) < 0.35 and all(len({tuple(c) for c in g["c"]}) == 1 for _, g in got.groupby("block"))
    # Equal points differ in their ids only, and still fill no block beyond its size.
    same = spark.createDataFrame([(f"p{i:04d}", [1.0], []) for i in range(100)], "id string, x array<double>, c array<string>")
    assert B.blocked(same).groupBy("block").count().agg(F.max("count")).first()[0] <= 16


@pytest.mark.parametrize("skip", [False, True])
def test_nearest_k_sends_a_block_whole_once_to_a_tile_where_most_of_its_points_go(spark, monkeypatch, skip):
    monkeypatch.setattr(B, "BLOCK_ROWS", 8)
    rng = np.random.default_rng(31)
    # Among many features each bounding box is in reach of nearly all points.
    x = np.round(rng.normal(size=(240, 12)), 1)
    x[200:212] = x[0]  # copies: ties go by id
    rows = [(f"p{i * 97 % 240:03d}", [float(v) for v in p], [], float(i % 7)) for i, p in enumerate(x)]
    points = spark.createDataFrame(rows, "id string, x array<double>, c array<string>, label double")
    seen, sent = count_visitors(monkeypatch, B), []
    real = B._tiled
    monkeypatch.setattr(B, "_tiled", lambda *a: sent.append(real(*a)) or sent[-1])
    got = B.nearest_k(points, points, 4, B.euclidean, carry=["label"], skip_self=skip).collect()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    for i, (name, *_) in enumerate(rows):
        want = sorted((round(d[i, j], 9), rows[j][0], rows[j][3]) for j in range(240) if not (skip and i == j))[:4]
        mine = sorted((r for r in got if r.id == name), key=lambda r: r["rank"])
        assert [(round(r.dist, 9), r.neighbour, r.label) for r in mine] == want
    # 30 blocks have 870 pairs; no point is copied to each of them.
    assert sum(seen) < 240 * 29 / 4 and sent[0].count() < 870


def test_packed_blocks_of_long_rows_lie_in_many_files(spark):
    rows = spark.range(40).coalesce(1)
    assert len(cut_lineage(rows, "long", 8).inputFiles()) == 5


def test_mds_rounds_are_plain_ones_and_write_a_row_for_each_block(spark, monkeypatch):
    monkeypatch.setattr(B, "BLOCK_ROWS", 16)
    rows, df = make(spark, n=90, seed=6, dims=3, cats=("u", "v"), copies=10)
    begin, written, real, first = {}, [], X.cut_lineage, X._start

    def kept(df, name="stage", *more):
        out = real(df, name, *more)
        if name == "mds":
            written.append(out.count())
        return out

    def started(points):
        out = real(first(points), "start")
        begin.update({r["id"]: (r["e0"], r["e1"]) for r in out.collect()})
        return out

    monkeypatch.setattr(X, "cut_lineage", kept)
    monkeypatch.setattr(X, "_start", started)
    got = {r["id"]: r["x"] for r in X.mds_2d(df, max_iter=3, eps=-1.0).collect()}
    d, e = gower_matrix(rows), np.array([begin[r[0]] for r in rows])
    for _ in range(3):
        gap = e[:, None] - e[None]
        have = np.sqrt((gap**2).sum(-1))
        e = (gap * (d / np.where(have == 0, 1e-5, have))[:, :, None]).sum(axis=1) / len(rows)
    assert np.array([got[r[0]] for r in rows]) == pytest.approx(e, abs=1e-9)
    assert len(written) == 3 and max(written) <= 10
