"""Packed sequences against the tokenizers library, and the solver's bookkeeping on small histograms."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from sensorloom.llm.packing import GRAIN, Plan, combinations, cuts, nnls, pack
from sensorloom.llm.queries import QUERIES
from sensorloom.llm.tokens import vocabulary_path


def check(rows, texts, window=4096):
    """Every id in one piece, sequences without a gap; returns the padded share."""
    t = Tokenizer.from_file(vocabulary_path())
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append((r.offset, r.length))
    assert set(by_doc) == set(texts)
    for doc, mine in by_doc.items():
        ids, at = np.array(t.encode(texts[doc] or "", add_special_tokens=False).ids + [2], "<u4"), 0
        for r in sorted(mine, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    used = 0
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
        used += at
    return 1 - used / (len(by_seq) * window)


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert check(QUERIES["op4_packing"](spark, sf).collect(), docs) < 0.01


def test_odd_rows(spark):
    rows = [(1, None, 0), (2, "", 0), (3, "word " * 30_000, 1), (4, "ein Wort", 2), (None, "x", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int")
    out = pack(docs).collect()
    assert check(out, {r[0]: r[1] for r in rows}) < 1
    again = pack(docs.union(docs)).collect()
    assert len(again) == 2 * len(out) and len({(r.sequence_id, r.offset) for r in again}) == len(again)
    assert pack(spark.createDataFrame([], docs.schema)).collect() == []


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_rank_once(seed):
    rng = random.Random(seed)
    histogram = Counter(rng.randint(1, 31) for _ in range(rng.choice([3, 400, 20_000])))
    histogram.update({32 * k: rng.randint(0, 50) for k in range(1, 8)})
    histogram[256] = 5
    histogram = {k: n for k, n in histogram.items() if n}
    plan = Plan(histogram, 256, 32)
    lengths = np.repeat(list(histogram), list(histogram.values()))
    ranks = np.concatenate([np.arange(n) for n in histogram.values()])
    piece, begin, part, sequence, order = plan.places(lengths, ranks)
    assert len(set(zip(sequence, order))) == len(piece)
    by_piece = np.lexsort((begin, piece))
    ends = np.append(piece[by_piece][1:] != piece[by_piece][:-1], True)
    after = (begin + part)[by_piece]
    assert (after[ends] == lengths).all() and (after[~ends] == begin[by_piece][1:][~ends[:-1]]).all()
    filled = np.bincount(sequence, part)
    assert filled.max() <= 256 and len(filled) == plan.sequences and filled.min() > 0
    assert plan.sequences <= lengths.sum() // (256 - GRAIN) + 3


@pytest.mark.parametrize("tokens", [[n] * 10_000 for n in (968, 2100, 2504, 2600, 2700, 3000, 3500, 4000)] + [list(range(2600, 4000)) * 5])
def test_little_padding_whatever_the_lengths(tokens):
    plan = Plan(Counter(c for n in tokens for c in cuts(n)))
    assert 1 - sum(tokens) / (plan.sequences * 4096) < 0.01


def test_checksums_of_cut_pieces(spark):
    rng = random.Random(8)
    texts = {i: " ".join(rng.choice("the of and to in is was".split()) for _ in range(rng.choice([170, 169, 230]))) for i in range(300)}
    rows = pack(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), window=256, block=32).collect()
    assert len({(r.doc_id, r.start) for r in rows}) == len(rows)
    assert check(rows, texts, 256) < 0.07


def test_nnls_solves_a_solvable_histogram():
    combos = combinations(range(1, 16), 16, 3)
    rng = np.random.default_rng(0)
    want = rng.integers(0, 50, len(combos))
    histogram = Counter()
    for combo, n in zip(combos, want):
        for length in combo:
            histogram[length] += int(n)
    x = nnls(combos, histogram)
    use = Counter()
    for combo, n in zip(combos, x):
        for length in combo:
            use[length] += n
    assert all(abs(use[k] - histogram[k]) < 0.01 * max(histogram.values()) for k in histogram)
