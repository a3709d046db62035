"""Cut runs against a table of all windows seen earlier."""

import random

import numpy as np
import pytest

from sensorloom.llm import line_dedup
from sensorloom.llm.line_dedup import MIN_RUN, cut_repeats
from sensorloom.llm.queries import QUERIES
from sensorloom.llm.text import SPACE, Words


def brute(rows):
    """Words that stay of each text, in the order of the rows."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0))
    split = [(t or "").split() for _, t in rows]
    seen, gone = {}, [set() for _ in rows]
    for i in order:
        for p in range(len(split[i]) - MIN_RUN + 1):
            first = seen.setdefault(tuple(split[i][p : p + MIN_RUN]), (i, p))
            if first[0] != i or p >= first[1] + MIN_RUN:
                gone[i].update(range(p, p + MIN_RUN))
    return [[x for k, x in enumerate(s) if k not in g] for s, g in zip(split, gone)]


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_query_equals_all_windows(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: r for r in QUERIES["op7_line_dedup"](spark, f"/root/testdata/sf{sf}").collect()}
    want = brute(docs)
    assert len(got) == len(docs)
    for (doc, text), words in zip(docs, want):
        r = got[doc]
        assert (r.text or "").split() == words, doc
        assert (r.n_words, r.removed_words) == (len((text or "").split()), len((text or "").split()) - len(words))
    assert any(r.removed_words for r in got.values())


@pytest.mark.parametrize("seed", range(3))
def test_pasted_passages(spark, seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randint(0, 3000)}"
    bank = [[word() for _ in range(rng.choice([30, 49, 50, 51, 80, 200]))] for _ in range(12)]
    rows = []
    for doc in rng.sample(range(-500, 500), 90):
        words = []
        for _ in range(rng.randint(0, 4)):
            words += [word() for _ in range(rng.randint(0, 60))] + rng.choice(bank)[rng.choice([0, 0, 5]) :]
        rows.append((doc, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.text.split() for r in cut_repeats(df).collect()}
    for (doc, _), words in zip(rows, brute(rows)):
        assert got[doc] == words


def test_odd_rows(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, None, 0), (2, "", 0), (3, "a " * 30 + passage + "\nrest of it", 1), (4, "left\n" + passage + "\nright", 1),
            (None, "x " + passage, 2), (5, passage, 3), (6, "again " * 400, 3), (6, "again " * 400, 3), (7, passage + " " + passage, 4),
            (8, "w " * 20 + "\n" + "é ü " * 100_000, 4), (9, " ".join(f"p{i}" for i in range(49)), 5)]
    df = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, words long, at string")
    out = cut_repeats(df)
    assert out.columns == ["doc_id", "text", "words", "at", "__words", "__removed", "__runs"]
    got = {r.doc_id: r.text for r in out.collect()}
    assert got[1] is None and got[2] == "" and got[None] == rows[4][1]
    assert got[3] == "a " * 29 + "a\nrest of it" and got[4] == "left\nright" and got[5] == "" and got[7] == ""
    assert got[6].split() == ["again"] * 50 and got[9] == rows[10][1]
    assert got[8].split() == ["w"] * 20 + ["é", "ü"] * 25
    assert out.filter("doc_id = 6").count() == 2
    assert cut_repeats(df.limit(0)).collect() == []


@pytest.mark.parametrize("n", [200, 255, 256, 271, 272, 300, 2000])
def test_texts_of_more_words_than_a_stretch_has_places(monkeypatch, n):
    rng = random.Random(n)
    words = Words([" ".join(f"w{rng.randint(0, 900)}" for _ in range(n)) + " z" * 70, "a b " * 60], SPACE, lower=False)
    want = line_dedup.spans(words)
    monkeypatch.setattr(line_dedup, "_POSITION_BITS", 8)
    assert all(np.array_equal(x, y) for x, y in zip(line_dedup.spans(words), want)) and len(want[0])
