"""Exact duplicates against a dictionary of normalised texts; the coder's round trip."""

import hashlib

import numpy as np
import pytest

from sensorloom.llm.exact_dedup import exact_duplicates, golomb_decode, golomb_encode


def lower(text):
    return (text or "").encode().lower()


@pytest.mark.parametrize("bits", [0, 3, 20])
def test_golomb_round_trip(bits):
    rng = np.random.default_rng(bits)
    for n in (1, 2, 500):
        values = np.unique(rng.integers(0, 1 << 22, n).astype(np.uint64))
        assert (golomb_decode(golomb_encode(values, bits), len(values)) == values).all()
    assert len(golomb_decode(b"", 0)) == 0


def test_odd_rows(spark):
    rows = [(1, "Ab É"), (2, "aB É"), (3, "ab é"), (4, None), (5, ""), (6, "x " * 100_000), (7, "X " * 100_000), (8, "own"),
            (9, "twice"), (9, "twice"), (10, "one id"), (10, "two texts"), (None, "aB É"), (None, "lone")]
    df = spark.createDataFrame([(*r, True) for r in rows], "doc_id long, text string, kept boolean").repartition(4)
    groups = {}
    for doc, text in rows:
        groups.setdefault(lower(text), []).append(doc)
    out = exact_duplicates(df).collect()
    assert len(out) == len(rows)
    for r in out:
        same = next(g for t, g in groups.items() if hashlib.sha256(t).hexdigest() == r.text_sha256)
        assert r.group_size == len(same) and r.keep_id == max((x for x in same if x is not None), default=None)
    assert sum(r.kept for r in out) == len(groups)
    assert all(r.kept == (r.doc_id == r.keep_id) for r in out if r.doc_id != 9)
    assert exact_duplicates(df.limit(0)).collect() == []
