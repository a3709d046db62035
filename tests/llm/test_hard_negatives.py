"""Hard negatives against scoring all pairs, and the intervals against true scores."""

import math

import numpy as np
import pytest

from sensorloom.llm import hard_negatives as H

COLUMNS = "vec_id long, embedding array<float>, label int"


def brute(rows):
    known = {
        (i, (label + 1) % 10 if i % 7 == 0 else label, tuple(math.floor(256 * x) for x in e))
        for i, e, label in rows
        if None not in (i, e, label) and all(x is not None and math.isfinite(x) for x in e)
    }
    out = []
    for a, label, e in (r for r in known if r[0] % 100 == 0):
        scored = sorted((-sum(x * y for x, y in zip(e, f)), i, other) for i, other, f in known)
        for score, p, _ in [r for r in scored if r[2] == label and r[1] != a][:5]:
            good = [r for r in scored if r[2] != label and 80 * -score <= 100 * -r[0] <= 100 * -score][:5]
            out += [(a, p, k + 1, i, -score, -s) for k, (s, i, _) in enumerate(good)]
    return sorted(out)


def got(df, **options):
    return sorted(tuple(r) for r in H.hard_negatives(df, **options).collect())


def clustered(n, dims, groups, noise, seed):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((groups, dims))
    x = centres[rng.integers(0, groups, n)] + noise * rng.standard_normal((n, dims))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


@pytest.mark.parametrize("dims, groups, noise", [(64, 8, 0.3), (33, 4, 0.6), (130, 20, 0.2)])
def test_equals_all_pairs(spark, dims, groups, noise):
    x = clustered(900, dims, groups, noise, dims)
    rows = [(i, v.tolist(), int(i * 13 % 10)) for i, v in enumerate(x)]
    want = brute(rows)
    assert want and got(spark.createDataFrame(rows, COLUMNS).repartition(5)) == want


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(H, "SHARD_QUERIES", 2)
    same = [0.5, 0.25, -0.125]
    rows = [(i, same, i % 3) for i in range(0, 430, 10)] + [(0, same, 0), (100, same, 1), (200, [1.0], 5), (300, [], 5), (11, [0.25, 0.5], 5)]
    rows += [(None, same, 1), (1, None, 1), (2, same, None), (3, [float("nan"), 1.0, 1.0], 1), (4, [None, 1.0, 1.0], 1), (500, [float("inf")], 1),
             (600, [-1.0, -1.0, 1.0], 2), (601, [1.0, 1.0, -1.0], 2), (700, [1e6, -3e5, 2.5], 4), (701, [1e6, -3e5, 2.75], 4), (702, [1e6, -3e5, 2.5], 6)]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], COLUMNS + ", score double")
    assert got(df) == brute(rows)
    assert got(df.limit(0)) == []


def test_intervals_hold_every_score_and_drop_far_pairs():
    ints = np.floor(256 * clustered(600, 96, 6, 0.15, 3)).astype(np.int64)
    codes, queries = H.Codes.of(ints), H.Queries(ints[:50])
    lower, upper = queries.bounds(codes)
    true = ints[:50] @ ints.T
    assert (lower <= true).all() and (true <= upper).all()
    fifth = np.sort(true, axis=1)[:, -5:-4]
    assert np.mean(upper < fifth) > 0.5
