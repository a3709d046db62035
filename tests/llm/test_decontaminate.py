"""Retrieval against plain BM25 over every passage and item, and leaks found in whole documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from sensorloom.llm import decontaminate as d
from sensorloom.llm.queries import QUERIES
from sensorloom.llm.text import MARKS, Words


def words(text):
    return re.findall(r"\w+", (text or "").lower())


def bm25(items, passage):
    """Score of each item's words that the passage has, as a share of the item's score for itself."""
    bags = [Counter(words(t)) for t in items]
    df = Counter(w for b in bags for w in b)
    mean = sum(map(lambda b: sum(b.values()), bags)) / len(bags)
    out = []
    for b in bags:
        n = sum(b.values())
        part = {
            w: math.log(1 + (len(bags) - df[w] + 0.5) / (df[w] + 0.5)) * tf * (d.K1 + 1) / (tf + d.K1 * (1 - d.B + d.B * n / mean))
            for w, tf in b.items()
        }
        out.append(sum(x for w, x in part.items() if w in passage) / sum(part.values()))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_search_equals_all_scores(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{int(rng.paretovariate(0.7))}" for _ in range(300)]
    items = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 30))) for _ in range(50)]
    index = d.Index([(i, t, "") for i, t in enumerate(items)])
    texts = [" ".join(rng.choices(vocabulary, k=60) + words(rng.choice(items))[: rng.randint(1, 30)]) for _ in range(60)]
    w = Words(texts, MARKS)
    passage, term = [], []
    for p in range(len(texts)):
        t = np.unique(index.term_of(w.hashes[w.bounds[p] : w.bounds[p + 1]]))
        t = t[t >= 0]
        passage += [p] * len(t)
        term += t.tolist()
    got = index.search(np.array(passage), np.array(term), len(texts), 0.6)
    got = {(p, i): s for p, i, s in zip(*(x.tolist() for x in got))}
    want = {}
    for p, t in enumerate(texts):
        want |= {(p, i): s for i, s in enumerate(bm25(items, set(words(t)))) if s >= 0.6}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def brute(docs, items):
    out = set()
    for doc, text in docs:
        mine = words(text)
        for item, t in items:
            sides = [words(s) for s in d.split_item(t)]
            share = []
            for side in sides:
                n = min(5, len(side))
                runs = {tuple(side[k : k + n]) for k in range(len(side) - n + 1)} if side else set()
                have = {tuple(mine[k : k + n]) for k in range(len(mine) - n + 1)} if side else set()
                share.append(len(runs & have) / len(runs) if runs else 1)
            if any(sides) and min(share) >= 0.8:
                out.add((doc, item))
    return out


def test_query_equals_overlap_of_all_pairs(spark):
    sf = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id) for r in QUERIES["op1_decontamination"](spark, sf).collect()}
    assert got == brute(docs, items) and got


def test_odd_rows(spark, monkeypatch):
    rng = random.Random(9)
    text = lambda n: " ".join(f"v{rng.randint(0, 400)}" for _ in range(n))
    items = [(1, text(30) + ". " + text(8) + "."), (2, "Who? Me"), (3, None), (None, text(12)), (5, "..."), (6, text(700)), (1, text(20))]
    docs = [(10, text(500) + " " + items[0][1].upper() + " " + text(3)), (11, None), (12, ""), (None, items[3][1]), (13, "who me"),
            (14, text(3000) + items[5][1] + text(3000)), (10, items[0][1]), (15, items[0][1][:60]), (16, text(4)), (17, items[6][1])]
    frame = spark.createDataFrame([(*r, 1.0) for r in docs], "doc_id long, text string, score double")
    bench = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, doc_id int")
    for shard in (20_000, 2):
        monkeypatch.setattr(d, "SHARD_ITEMS", shard)
        got = [(r.doc_id, r.item_id) for r in d.contaminated(frame, bench).collect()]
        assert len(got) == len(set(got)) and set(got) >= {(10, 1), (None, None), (14, 6), (17, 1)}
        assert not {g[0] for g in got} & {11, 12, 15, 16}
    assert d.contaminated(frame.limit(0), bench).collect() == [] == d.contaminated(frame, bench.limit(0)).collect()
    pairs = spark.createDataFrame([(7, "what is in here", "this answer text")], "item_id long, question string, answer string")
    texts = spark.createDataFrame([(1, "what is in here"), (2, "what is in here? this answer text")], "doc_id long, text string")
    assert [r.doc_id for r in d.contaminated(texts, pairs).collect()] == [2]


def test_scores_do_not_depend_on_shards(spark, monkeypatch):
    rng = random.Random(4)
    some = lambda n, k: [f"v{min(int(rng.paretovariate(0.5)), k)}" for _ in range(n)]
    items = [some(rng.randint(12, 40), 60 if i < 20 else 4000) for i in range(40)]
    docs = [(i, " ".join(some(50, 4000) + t[: int(len(t) * share)] + some(30, 4000))) for share in (0.7, 0.85, 1) for i, t in enumerate(items)]
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    frame = spark.createDataFrame([(n, t) for n, (_, t) in enumerate(docs)], "doc_id long, text string")

    def found(rows):
        return {(r.doc_id, r.item_id): r.score for r in d.contaminated(frame, rows, overlap=0.5).collect()}

    want = found(bench)
    assert any(s < 0.99 for s in want.values())
    for shard, rows in ((10, bench), (7, bench.orderBy(d.F.desc("item_id")))):
        monkeypatch.setattr(d, "SHARD_ITEMS", shard)
        got = found(rows)
        assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)
