import numpy as np
import pytest

from sensorloom.operators import extra_trees as X


def rows_of(spark, x, label):
    rows = [(f"r{i:04d}", float(c), [float(v) for v in xs]) for i, (xs, c) in enumerate(zip(x, label))]
    return spark.createDataFrame(rows, "id string, label double, x array<double>").repartition(5)


def test_thresholds_are_uniform_per_tree_and_node(spark):
    rng = np.random.default_rng(3)
    x = rng.random((300, 1)) * 10
    model = X.grow(rows_of(spark, x, rng.integers(0, 2, 300)), trees=200, seed=1)
    roots = (model.threshold[:200] - x.min()) / (x.max() - x.min())
    assert len(set(roots)) == 200
    steps = np.arange(1, 201) / 200
    # Kolmogorov and Smirnov's distance from the uniform law, at a level of 0.1 %.
    assert np.abs(np.sort(roots) - steps).max() < 1.95 / np.sqrt(200)
    inner = model.threshold[model.left >= 0]
    assert len(set(inner)) > 0.9 * len(inner)


@pytest.mark.parametrize("cells", [40, 400_000])
def test_trees_are_full_and_counts_are_right(spark, monkeypatch, cells):
    monkeypatch.setattr(X, "GROUP_CELLS", cells)
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(80, 4)), 1)
    x[10:20] = x[0]  # alike rows of several classes
    label = rng.integers(0, 3, 80)
    model = X.grow(rows_of(spark, x, label), trees=6, seed=2)
    leaves = model.leaves(x)
    for tree in range(6):
        for leaf in np.unique(leaves[:, tree]):
            mine = leaves[:, tree] == leaf
            assert model.counts[leaf].tolist() == np.bincount(label[mine], minlength=3).tolist()
            assert len(set(label[mine])) == 1 or len(np.unique(x[mine], axis=0)) == 1
    inner = np.flatnonzero(model.left >= 0)
    assert (model.counts[model.left[inner]].sum(axis=1) > 0).all() and (model.counts[model.right[inner]].sum(axis=1) > 0).all()


def test_result_does_not_depend_on_the_partitions_and_unseen_classes_have_no_probability(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 3))
    train = rows_of(spark, x, x[:, 0] > 0)
    test = rows_of(spark, x[:10], [0.0] * 9 + [7.0])
    a = X.predict(X.grow(train, 5), test).orderBy("id").collect()
    b = X.predict(X.grow(train.coalesce(1), 5), test.coalesce(1)).orderBy("id").collect()
    assert a == b
    assert [r["prediction"] for r in a] == [float(v > 0) for v in x[:10, 0]]
    assert a[9]["p_true"] is None and all(r["p_true"] in (0.0, 1.0) for r in a[:9])


def test_one_class_is_one_leaf(spark):
    model = X.grow(rows_of(spark, np.eye(4), [1] * 4), trees=3)
    assert (model.left == -1).all() and model.counts.tolist() == [[0.0, 4.0]] * 3


@pytest.mark.parametrize("cells", [120, 20_000_000])
def test_written_trees_predict_as_held_ones(spark, monkeypatch, cells):
    """With and without an upper phase; trees are written, and few aggregates serve all their levels."""
    monkeypatch.setattr(X, "LOCAL_CELLS", cells)
    passes = []
    real = X._bounds
    monkeypatch.setattr(X, "_bounds", lambda *a: passes.append(1) or real(*a))
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=(90, 3)), 1)
    x[10:60] = x[0]  # more alike rows than a task takes, of several classes
    label = rng.integers(0, 3, 90)
    forest = X.fit(rows_of(spark, x, label), trees=5, seed=2)
    assert bool(passes) == (cells == 120) and forest.table.count() > 0
    model = forest.held()
    for tree in range(5):
        ends = model.leaves(x)[:, tree]
        for leaf in np.unique(ends):
            mine = ends == leaf
            assert model.counts[leaf].tolist() == np.bincount(label[mine], minlength=3).tolist()
            assert len(set(label[mine])) == 1 or len(np.unique(x[mine], axis=0)) == 1
    test = rows_of(spark, rng.normal(size=(40, 3)), [0, 1, 2, 9] * 10)
    key = lambda r: r["id"]
    got, want = (sorted(p.collect(), key=key) for p in (forest.predict(test), X.predict(model, test)))
    assert len(got) == 40
    for a, b in zip(got, want):
        assert (a["id"], a["label"]) == (b["id"], b["label"])
        assert a["p_true"] == pytest.approx(b["p_true"], abs=1e-9) and (a["p_true"] is None) == (a["label"] == 9)
