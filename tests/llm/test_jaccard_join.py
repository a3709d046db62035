"""Links, classes and groups against the Jaccard similarity of all pairs."""

import math
import random

import numpy as np
import pytest

from sensorloom.llm import jaccard_join as j
from sensorloom.llm.queries import QUERIES


def runs(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    """(doc_id, class_id, copy_id, n_copies, n_links) of every row."""
    sets = [runs(t) for _, t in rows]
    where = {}
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * len(rows)
    for i, s in enumerate(sets):
        common = {}
        for x in s:
            for k in where[x]:
                common[k] = common.get(k, 0) + 1
        for k, c in common.items():
            if k != i and c >= 0.8 * (len(s) + len(sets[k]) - c) - 1e-9:
                links[i] += 1
                a, b = root(i), root(k)
                parent[max(a, b)] = min(a, b)
    least = lambda ids: min([x for x in ids if x is not None], default=None)
    groups, copies = {}, {}
    for i in range(len(rows)):
        groups.setdefault(root(i), []).append(rows[i][0])
        copies.setdefault(sets[i] or i, []).append(rows[i][0])
    out = []
    for i, (doc, _) in enumerate(rows):
        same = copies[sets[i] or i]
        out.append((doc, least(groups[root(i)]), least(same), len(same), links[i]))
    return sorted(out, key=str)


def result(df):
    return sorted([tuple(r) for r in df.select("doc_id", "class_id", "copy_id", "n_copies", "n_links").collect()], key=str)


def test_posterior_matches_beta_tail():
    for n, least in zip(range(j.STEP, j.HASHES + 1, j.STEP), j.fewest_matches()):
        grid = np.linspace(0, 1, 200_001)
        for m, enough in ((least, True), (least - 1, False)):
            density = np.exp(m * np.log(grid[1:-1]) + (n - m) * np.log1p(-grid[1:-1]) - math.lgamma(m + 1) - math.lgamma(n - m + 1) + math.lgamma(n + 2))
            tail = density[grid[1:-1] >= j.THRESHOLD].sum() / 200_000
            assert (tail >= j.TOLERANCE) == enough


def test_query_equals_all_pairs(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert result(QUERIES["op10_jaccard_join"](spark, sf)) == brute(rows)


@pytest.mark.parametrize("block", [2_000, 7])
def test_large_near_group_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(j, "BLOCK_CLASSES", block)
    rng = random.Random(2)
    base = [f"w{rng.randint(0, 5000)}" for _ in range(150)]
    rows = []
    for i in range(60):
        words = list(base)
        for at in rng.sample(range(150), rng.randint(0, 5)):
            words[at] = f"x{rng.randint(0, 10**6)}"
        rows.append((i, " ".join(words)))
    rows += [(100 + i, rows[i % 3][1].upper()) for i in range(30)]
    rows += [(200 + i, " ".join(f"w{rng.randint(0, 5000)}" for _ in range(50))) for i in range(20)]
    assert result(j.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_odd_rows(spark):
    long = "a b c d e f g " * 20_000
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "One  two"), (5, "One  two"), (None, "one two"), (None, "alone here"),
            (6, long), (7, long + "h"), (8, "a b c d e f"), (9, "a b c d e g")]
    base = [f"n{i}" for i in range(60)]
    rows += [(20, " ".join(base)), (20, " ".join(base[:59] + ["x"])), (20, "entirely other words " * 4), (21, " ".join(["y"] + base[1:]))]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, node int")
    assert result(j.near_duplicates(df)) == brute(rows)
    assert j.near_duplicates(df.limit(0)).collect() == []
