"""Benchmark items in training text: BM25 with block-max WAND, then verified overlaps.

Index: the items' words with BM25 impacts, each divided by the item's score for itself, so a
passage that has all of an item scores 1. Items stand in blocks; a posting list stores its
largest impact in each block. Items are read in shards of at most ``SHARD_ITEMS`` rows and
``SHARD_BYTES`` bytes; a shard's index is what is broadcast, and each further shard is one more
pass over the documents. Shards share the statistics of all items (how many have a word, mean
and longest length), counted in Spark, so scores do not depend on the shards. No text of a
document is shuffled.

Queries: every document, as overlapping passages of twice the longest item's words, so that an
item lies whole in one of them. As in WAND, words whose largest impacts together stay below
``SLACK`` cannot decide alone and are left out of the first bound. A passage whose largest
impacts do not reach the threshold is dropped; of the others, a block is scored only where its
block maxima reach it. Every item at the threshold is retrieved, with its exact score.

A retrieved item counts as found if ``OVERLAP`` of the five-word runs of its question and of its
answer stand in the passage. An item's answer is its last sentence, unless answers are given.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Callable, Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from sensorloom.llm.text import MARKS, Words, pieces, shingles
from sensorloom.scratch import cut_lineage

THRESHOLD = 0.6
OVERLAP = 0.8
SLACK = 0.15
SHINGLE = 5
BLOCK_ITEMS = 8
SHARD_ITEMS = 20_000
SHARD_BYTES = 16 << 20
K1, B = 1.2, 0.75

_SENTENCE = re.compile(r"(?<=[.!?])\s+(?=\S)")


def split_item(text: str | None) -> tuple[str, str]:
    """Question and answer: all sentences but the last, and the last; a lone sentence is a question."""
    parts = _SENTENCE.split((text or "").strip())
    return (" ".join(parts[:-1]), parts[-1]) if len(parts) > 1 else (parts[0], "")


class Statistics(NamedTuple):
    """Of all items that have words: their number, mean and longest length, and how many have each of some word hashes."""

    items: int
    mean: float
    longest: int
    having: Callable[[np.ndarray], np.ndarray]


class Index:
    """BM25 index of ``(item_id, question, answer)`` rows; items without words are left out.

    ``rows`` are all items, or a shard of those that ``statistics`` are of.
    """

    def __init__(self, rows: list[tuple[int | None, str, str]], statistics: Statistics | None = None):
        whole = Words([f"{q}\n{a}" for _, q, a in rows], MARKS)
        sides = [Words([r[i] for r in rows], MARKS) for i in (1, 2)]
        have = np.flatnonzero(np.diff(whole.bounds))
        self.ids = [rows[i][0] for i in have]
        self.runs = [[np.unique(shingles(s.hashes[s.bounds[i] : s.bounds[i + 1]], SHINGLE)) for s in sides] for i in have]
        lengths = np.diff(whole.bounds)[have]
        self.longest = int(lengths.max()) if len(have) else 0
        self.shortest = [[min(SHINGLE, s.bounds[i + 1] - s.bounds[i]) for s in sides] for i in have]
        item = np.repeat(np.arange(len(have)), lengths)
        words = np.concatenate([whole.hashes[whole.bounds[i] : whole.bounds[i + 1]] for i in have]) if len(have) else whole.hashes
        self.words, term = np.unique(words, return_inverse=True)
        n = max(1, len(have))
        pair, tf = np.unique(term * n + item, return_counts=True)
        self.term, self.item = pair // n, pair % n
        if statistics is None:
            df, total, mean = np.bincount(self.term, minlength=len(self.words)), n, lengths.mean() if len(have) else 1.0
        else:
            df, total, mean, self.longest = statistics.having(self.words), statistics.items, statistics.mean, statistics.longest
        idf = np.log(1 + (total - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * lengths / max(1.0, mean))
        impact = idf[self.term] * tf * (K1 + 1) / (tf + norm[self.item])
        self.impact = impact / np.bincount(self.item, impact, n)[self.item]
        self.post = np.searchsorted(self.term, np.arange(len(self.words) + 1))
        most = np.zeros(len(self.words))
        np.maximum.at(most, self.term, self.impact)
        order = np.argsort(most)
        small = np.zeros(len(self.words), bool)
        small[order[np.cumsum(most[order]) <= SLACK]] = True
        self.most = np.where(small, 0, most)
        self.slack = float(most[small].sum())
        block_of = self.term * n + self.item // BLOCK_ITEMS
        key, at = np.unique(block_of, return_inverse=True)
        peak = np.zeros(len(key))
        np.maximum.at(peak, at, self.impact)
        keep = ~small[key // n]
        self.block, self.peak = (key % n)[keep], peak[keep]
        self.blocks_at = np.searchsorted((key // n)[keep], np.arange(len(self.words) + 1))

    def term_of(self, hashes: np.ndarray) -> np.ndarray:
        """Term numbers of word hashes, -1 for words that no item has."""
        at = np.minimum(np.searchsorted(self.words, hashes), max(0, len(self.words) - 1))
        return np.where(self.words[at] == hashes, at, -1) if len(self.words) else np.full(len(hashes), -1)

    def search(self, passage: np.ndarray, term: np.ndarray, n: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Passages, items and scores at or over the threshold, for distinct (passage, term) pairs sorted by passage."""
        least = threshold - self.slack - 1e-9
        reach = np.bincount(passage, self.most[term], n) >= least
        live = reach[passage]
        passage, term = passage[live], term[live]
        if not len(passage):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        blocks = len(self.ids) // BLOCK_ITEMS + 1
        own, at = _spread(self.blocks_at, term)
        key, of = np.unique(passage[own] * blocks + self.block[at], return_inverse=True)
        key = key[np.bincount(of, self.peak[at], len(key)) >= least]
        own, at = _spread(self.post, term)
        owner, item = passage[own], self.item[at]
        chosen = np.isin(owner * blocks + item // BLOCK_ITEMS, key)
        pair, of = np.unique(owner[chosen] * len(self.ids) + item[chosen], return_inverse=True)
        score = np.bincount(of, self.impact[at[chosen]], len(pair))
        good = score >= threshold - 1e-9
        return pair[good] // len(self.ids), pair[good] % len(self.ids), score[good]

    def overlaps(self, item: int, words: np.ndarray) -> list[float]:
        """Shares of the question's and the answer's runs that stand among these words; 1 for an empty side."""
        out = []
        for runs, n in zip(self.runs[item], self.shortest[item]):
            found = shingles(words, n) if n and len(words) >= n else np.zeros(0, np.uint64)
            out.append(float(np.isin(runs, found).mean()) if len(runs) else 1.0)
        return out


def _spread(starts: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row number its list ``starts[row]:starts[row+1]``, all in one: positions in ``rows``, positions in the lists."""
    sizes = starts[rows + 1] - starts[rows]
    own = np.repeat(np.arange(len(rows)), sizes)
    return own, np.arange(len(own)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts[rows], sizes)


def passages(n_words: int, longest: int) -> np.ndarray:
    """Starts of a text's passages of ``2 * longest`` words, each ``longest`` words after the one before."""
    return np.arange(0, max(1, n_words - longest), longest)


def found_in(index: Index, texts: list[str | None], threshold: float, overlap: float) -> list[tuple]:
    """Rows ``(text number, item number, score, question overlap, answer overlap)`` of verified items."""
    w = Words(texts, MARKS)
    term = index.term_of(w.hashes)
    at = np.flatnonzero(term >= 0)
    doc = np.searchsorted(w.bounds, at, "right") - 1
    stride = index.longest
    window = (at - w.bounds[doc]) // stride
    last = np.maximum(0, -(-(np.diff(w.bounds) - stride) // stride) - 1)
    base = np.concatenate(([0], np.cumsum(last + 1)))
    # A word is in the passage that starts in its stride and in the one before.
    in_own, in_before = window <= last[doc], window >= 1
    passage = np.concatenate([(base[doc] + window)[in_own], (base[doc] + window - 1)[in_before]])
    words = np.concatenate([term[at][in_own], term[at][in_before]])
    size = len(index.words)
    pair = np.unique(passage * size + words)
    out = []
    for p, item, score in zip(*(h.tolist() for h in index.search(pair // size, pair % size, int(base[-1]), threshold))):
        d = int(np.searchsorted(base, p, "right")) - 1
        start = w.bounds[d] + (p - base[d]) * stride
        question, answer = index.overlaps(item, w.hashes[start : min(start + 2 * stride, w.bounds[d + 1])])
        if min(question, answer) >= overlap:
            out.append((d, item, score, question, answer))
    return out


def _report(sent, threshold: float, overlap: float):
    names = ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"]
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = pickle.loads(sent.value)
        for batch in batches:
            for part in pieces(batch, "text", 1 << 20):
                ids = part.column("doc_id").to_pylist()
                rows = found_in(index, part.column("text").to_pylist(), threshold, overlap)
                rows = [(ids[d], index.ids[item], *figures) for d, item, *figures in rows]
                columns = list(zip(*rows)) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return run


def _drop(sent, threshold: float, overlap: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = pickle.loads(sent.value)
        for batch in batches:
            for part in pieces(batch, "text", 1 << 20):
                clean = np.ones(part.num_rows, bool)
                clean[[r[0] for r in found_in(index, part.column("text").to_pylist(), threshold, overlap)]] = False
                yield part.filter(pa.array(clean))

    return run


def _indexes(spark: SparkSession, items: DataFrame) -> Iterator:
    """A broadcast index for each shard of the items; its size is bounded by the shard's limits."""
    names = ["question", "answer"] if {"question", "answer"} <= set(items.columns) else ["text"]
    items = items.select(F.col("item_id").cast("long").alias("item_id"), *names)
    shards = _shards(items)
    first = next(shards, [])
    second = next(shards, None)
    statistics = None if second is None else _statistics(items)
    for shard in chain([first], [] if second is None else [second], shards):
        index = Index(shard, statistics)
        if index.ids:
            yield spark.sparkContext.broadcast(pickle.dumps(index))


def _sides(r) -> tuple[str, str]:
    return split_item(r["text"]) if "answer" not in r else (r["question"] or "", r["answer"] or "")


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task: items to word hashes and how many have them; a row without a word has the number and lengths of the items."""
    for batch in batches:
        w = Words(["\n".join(_sides(r)) for r in batch.to_pylist()], MARKS)
        lengths = np.diff(w.bounds)
        item = np.repeat(np.arange(len(lengths)), lengths)
        words, of = np.unique(w.hashes, return_inverse=True)
        having = np.bincount(np.unique(of * max(1, len(lengths)) + item) // max(1, len(lengths)), minlength=len(words))
        nothing = np.zeros(len(words), np.int64)
        rows = [np.append(having, (lengths > 0).sum()), np.append(nothing, lengths.sum()), np.append(nothing, lengths.max(initial=0))]
        word = pa.array([*words.astype(np.int64).tolist(), None], pa.int64())
        yield pa.RecordBatch.from_arrays([word, *(pa.array(x, pa.int64()) for x in rows)], ["word", "items", "total", "longest"])


def _statistics(items: DataFrame) -> Statistics:
    """Statistics of all items; the counts of words stay in a table, and a shard fetches those of its words."""
    spark = items.sparkSession
    counted = items.mapInArrow(_count_words, "word long, items long, total long, longest long")
    sums = [F.sum("items").alias("items"), F.sum("total").alias("total"), F.max("longest").alias("longest")]
    counted = cut_lineage(counted.groupBy("word").agg(*sums), "words")
    n, total, longest = counted.filter("word IS NULL").select("items", "total", "longest").first()

    def having(words: np.ndarray) -> np.ndarray:
        mine = spark.createDataFrame(pa.table({"word": pa.array(words.astype(np.int64))}))
        found = counted.join(mine, "word").select("word", "items").toArrow()
        hashes = found.column("word").to_numpy().astype(np.uint64)
        order = np.argsort(hashes)
        return found.column("items").to_numpy()[order][np.searchsorted(hashes, words, sorter=order)]

    return Statistics(n, total / max(1, n), longest, having)


def _shards(items: DataFrame) -> Iterator[list[tuple]]:
    """Item rows by id in shards of bounded rows and bytes, two shards on the driver at a time at most."""
    shard, size = [], 0
    for r in items.orderBy("item_id").toLocalIterator():
        question, answer = _sides(r)
        if shard and (len(shard) >= SHARD_ITEMS or size + len(question) + len(answer) > SHARD_BYTES):
            yield shard
            shard, size = [], 0
        shard.append((r["item_id"], question, answer))
        size += len(question) + len(answer)
    if shard:
        yield shard


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """Pairs of documents and benchmark items found in them, with the best passage's figures.

    ``docs`` has ``doc_id, text``; ``items`` has ``item_id`` and either ``text`` or ``question`` and
    ``answer``. Words are compared lower-cased, without marks. A side of fewer than five words is
    compared as one run, an empty side counts as found, items without words are not searched.
    Null texts are empty. Rows that repeat an id give one pair per item; a null id is an id.
    Empty tables give an empty result.
    """
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    found = spark.createDataFrame([], schema)
    for sent in _indexes(spark, items):
        found = found.union(cut_lineage(source.mapInArrow(_report(sent, threshold, overlap), schema), "leaks"))
    figures = [F.max(c).alias(c) for c in ("score", "question_overlap", "answer_overlap")]
    return found.groupBy("doc_id", "item_id").agg(*figures)


def decontaminate(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """The rows of ``docs``, with all their columns, in which no item is found; nothing is shuffled."""
    for sent in _indexes(docs.sparkSession, items):
        docs = cut_lineage(docs.mapInArrow(_drop(sent, threshold, overlap), docs.schema), "clean")
    return docs
