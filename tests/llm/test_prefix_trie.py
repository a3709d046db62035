"""Trie of conversations against a plain dictionary of all prefixes."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest

from sensorloom.llm.prefix_trie import Minima, conversation_trie, prefix_trie, rebuilt, shared_lengths, turn_lists
from sensorloom.scratch import cut_lineage

COLUMNS = "conv_id long, turn long, role string, text string"


def turn_key(t):
    return t[0], t[1], hashlib.md5(f"{len(t[2])}:{t[2]}{t[3]}".encode()).hexdigest()


def brute(rows):
    own = collections.defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [v[2:] for v in sorted(turns, key=turn_key)] for c, turns in own.items()}
    chats = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        chats[c] = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
    members = collections.defaultdict(list)
    for c, turns in chats.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = collections.Counter(k[:-1] for k in members if k)
    leaves, saved = collections.Counter(), collections.Counter()
    for k, of in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += (len(of) - 1) * len(k[-1][1]) if k else 0
    out = []
    for k, of in members.items():
        ends = ",".join(str(c) for c in sorted(of) if chats[c] == k)
        parent = min(members[k[:-1]]) if k else None
        out.append((min(of), len(k), parent, len(of), children[k], leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("chunk_rows, chunk_turns", [(1 << 17, 1 << 20), (7, 1000), (3, 11), (1, 1)])
def test_random_conversations(spark, chunk_rows, chunk_turns):
    rng = random.Random(5)
    rows = [
        (c, t, rng.choice(["u", "a", None]) if t > 3 else "u", rng.choice(["x", "yy", None]) if t > 1 else "h")
        for c in range(220)
        for t in range(rng.choice([1, 2, 3, 4, 5, 6, 8, 12]))
    ]
    lists = cut_lineage(turn_lists(spark.createDataFrame(rows, COLUMNS)))
    assert rows_of(prefix_trie(rebuilt(lists), chunk_rows, chunk_turns)) == brute(rows)


def test_one_sequence_over_many_chunks(spark):
    rows = [(c, t, "u", "same") for c in range(300) for t in range(3)]
    lists = cut_lineage(turn_lists(spark.createDataFrame(rows, COLUMNS)))
    assert rows_of(prefix_trie(rebuilt(lists), 8, 1 << 20)) == brute(rows)


def test_odd_rows(spark):
    rows = [(None, 1, "u", "x"), (7, None, "s", "z"), (7, 2, "u", "é漢"), (7, 2, "u", "é漢"), (7, 2, None, None), (0, 0, "u", ""), (205, 1, "a", "b"),
            (206, 1, "a", "long " * 50_000), *[(300, t, "u", str(t)) for t in range(150)], *[(301, t, "u", str(t)) for t in range(149)]]
    df = spark.createDataFrame([(*r, "x") for r in rows], COLUMNS + ", node string")
    assert rows_of(conversation_trie(df)) == brute(rows)
    assert conversation_trie(df.limit(0)).collect() == []


def test_extents_and_shared_lengths():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 5, 60)
    table = Minima(values)
    at, depth = rng.integers(0, 61, 200), rng.integers(0, 6, 200)
    for p, d, left, right in zip(at, depth, table.left(at, depth), table.right(at, depth)):
        assert left == max([i + 1 for i in range(p) if values[i] < d], default=0)
        assert right == min([i for i in range(p, 60) if values[i] < d], default=60)
    tokens = np.array([[1, 1], [2, 2], [1, 1], [2, 2], [3, 3], [9, 9]], np.uint64)
    assert shared_lengths(tokens, np.array([0, 2, 5, 5, 6])).tolist() == [2, 0, 0]
