"""Shards: whole rows, near equal bytes, groups together, and best fit decreasing against brute force."""

import random
import zlib
from collections import Counter, defaultdict

import pytest

from sensorloom.llm.queries import QUERIES
from sensorloom.llm.sharding import best_fit_decreasing, into_bins, shard_documents


def brute(items, capacity):
    """Item by item, with a scan over all bins."""
    rooms = []
    for size in sorted(items, reverse=True):
        fitting = [(room, i) for i, room in enumerate(rooms) if room >= size]
        if fitting:
            rooms[min(fitting)[1]] -= size
        else:
            rooms.append(capacity - size)
    return sorted(capacity - r for r in rooms)


@pytest.mark.parametrize("seed", range(20))
def test_classes_equal_item_by_item(seed):
    rng = random.Random(seed)
    items = [rng.randint(1, 60) for _ in range(rng.randint(1, 300))]
    plan = best_fit_decreasing(dict(Counter(items)), 100)
    load, ranks = Counter(), defaultdict(list)
    for size, a, b, number in plan:
        load[number] += size * (b - a)
        ranks[size] += range(a, b)
    assert sorted(load.values()) == brute(items, 100)
    assert {s: sorted(r) for s, r in ranks.items()} == {s: list(range(n)) for s, n in Counter(items).items()}


def test_fixed_number_of_bins():
    rng = random.Random(1)
    classes = Counter(rng.randint(1, 500) for _ in range(5000))
    classes[200_000] = 1
    plan = into_bins(dict(classes), 40)
    load = Counter()
    for size, a, b, number in plan:
        load[number] += size * (b - a)
    rest = [load[i] for i in range(40) if load[i] < 200_000]
    assert len(load) == 40 and max(rest) - min(rest) < 500


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = QUERIES["op5_shards"](spark, sf).collect()
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    load, slots, homes = Counter(), defaultdict(list), defaultdict(set)
    for r in rows:
        assert (r.size, r.text_crc32) == (len(docs[r.doc_id]) + 16, zlib.crc32(docs[r.doc_id]))
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
        homes[docs[r.doc_id]].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(load) == set(range(40))
    mean = sum(load.values()) / 40
    assert all(len(h) == 1 for t, h in homes.items() if len(t) * 20 < mean)
    ordinary = [x for x in load.values() if x < 1.2 * mean]
    assert max(ordinary) - min(ordinary) < 0.05 * mean


def test_odd_rows_and_a_group_too_large_for_one_shard(spark):
    rows = [(i, "same text", 0) for i in range(60)] + [(100 + i, f"{i:09d}", 1) for i in range(60)]
    rows += [(None, None, 2), (7, "", 2), (7, "same text", 2), (500, "x" * 5000, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    out = shard_documents(docs, shards=5).collect()
    assert len(out) == len(rows)
    load = Counter()
    for r in out:
        load[r.shard] += r.size
    small = sorted(load.values())[:-1]
    assert max(small) - min(small) <= 3 * 25
    fixed = shard_documents(docs, capacity=500).collect()
    load = Counter()
    for r in fixed:
        load[r.shard] += r.size
    assert sorted(load.values())[-2] <= 500 and len(load) <= 2 + -(-sum(load.values()) // 450)
    assert shard_documents(spark.createDataFrame([], docs.schema), shards=5).collect() == []
