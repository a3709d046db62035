"""Near-duplicate join: word five-gram Jaccard of 0.8 or more, by Bayesian candidate pruning.

1. Scan tasks reduce each text to the hash of its set of five-word runs (texts with one set are
   copies, one class) and to MinHash band keys.
2. A task links the classes that share a band key to the least of them and passes on one row
   per key; a second step links those. So a key that a third of all rows have costs a row a
   task, and no pairs of a bucket are formed. Connected classes are one candidate component.
3. Texts of components with two classes or more are shuffled once, to blocks of bounded size; a
   component larger than a block is dealt to block pairs. Within a block, pairs' MinHash values
   are compared ``STEP`` at a time; a pair is dropped once the posterior probability that its
   similarity reaches the threshold, given the matches so far and a uniform prior, is below
   ``TOLERANCE``. What is left is verified with exact set intersections.
4. Blocks return link counts per class and a spanning forest of the links, never the links. The
   forest's components are the groups.

With 32 bands of 6 values a pair at similarity 0.8 shares a band with probability 0.99994, and
pairs that share none still meet if their component has both.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sensorloom.llm.common import components, shuffle_partitions
from sensorloom.llm.text import SPACE, Words, mix, pieces, shingles
from sensorloom.scratch import cut_lineage

SHINGLE = 5
THRESHOLD = 0.8
BANDS = 32
ROWS = 6
HASHES = BANDS * ROWS
STEP = 32
TOLERANCE = 1e-4
#: Classes and five-word runs that one block holds, about.
BLOCK_CLASSES = 2_000
BLOCK_RUNS = 2_000_000

_SEEDS = mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.uint32) | np.uint32(1)
_SHIFTS = mix(np.arange(1, HASHES + 1, dtype=np.uint64) + np.uint64(1 << 50)).astype(np.uint32)


def run_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Sorted distinct five-word runs of each text; words are lower-cased, split at white space."""
    w = Words(texts, SPACE)
    return [np.unique(shingles(w.hashes[a:b], SHINGLE)) for a, b in zip(w.bounds[:-1], w.bounds[1:])]


def node_of(runs: np.ndarray) -> int:
    """64-bit number of a set of runs."""
    return int.from_bytes(hashlib.blake2b(runs.tobytes(), digest_size=8).digest(), "little", signed=True)


def minhashes(runs: np.ndarray) -> np.ndarray:
    """``HASHES`` minima over a set of runs."""
    low = (runs >> np.uint64(32)).astype(np.uint32) ^ runs.astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 8192):
        part = low[at : at + 8192]
        for h in range(0, HASHES, 48):
            x = (part[None, :] ^ _SHIFTS[h : h + 48, None]) * _SEEDS[h : h + 48, None]
            x ^= x >> np.uint32(15)
            x *= np.uint32(0x2C1B3C6D)
            np.minimum(out[h : h + 48], x.min(axis=1), out=out[h : h + 48])
    return out


def band_keys(values: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band, different for equal values in different bands."""
    rows = values.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(BANDS, dtype=np.uint64) + np.uint64(1)
    for r in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, r])
    return key.astype(np.int64)


def fewest_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[int]:
    """After each step: the fewest matches with which a pair may still reach the threshold.

    With a uniform prior the posterior after m matches of n is Beta(m + 1, n - m + 1), whose tail
    above t is P(Binomial(n + 1, t) <= m).
    """
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        below, m = 0.0, -1
        while below < tolerance:
            m += 1
            below += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def pruned(a: np.ndarray, b: np.ndarray, same: bool, threshold: float = THRESHOLD, tolerance: float = TOLERANCE):
    """Rows of ``b`` that stay as candidates of each row of ``a`` (later rows only if ``same``)."""
    least = fewest_matches(threshold, tolerance)
    for i in range(len(a)):
        left = np.arange(i + 1 if same else 0, len(b))
        matches = np.zeros(len(left), np.int32)
        for step, fewest in enumerate(least):
            if not len(left):
                break
            span = slice(step * STEP, (step + 1) * STEP)
            matches += (b[left, span] == a[i, span]).sum(axis=1, dtype=np.int32)
            keep = matches >= fewest
            left, matches = left[keep], matches[keep]
        if len(left):
            yield i, left


def _links(left: pd.DataFrame, right: pd.DataFrame | None, threshold: float):
    """Links of one block, or of two: for each row its links' weights, and a forest of the links."""
    every = left if right is None else pd.concat([left, right], ignore_index=True)
    sets = every["runs"].tolist()
    values = np.array([minhashes(s) for s in sets], np.uint32).reshape(len(sets), HASHES)
    sizes = np.array([len(s) for s in sets])
    first = len(left)
    of = np.repeat(np.arange(len(sets)), sizes)
    _, run = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(run, kind="stable")
    postings, starts = of[order], np.searchsorted(run[order], np.arange(run.max() + 2 if len(run) else 1))
    row_at = np.concatenate(([0], np.cumsum(sizes)))
    weight = every["copies"].to_numpy(np.int64)
    links, parent = np.zeros(len(sets), np.int64), list(range(len(sets)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    forest = []
    others = values if right is None else values[first:]
    for i, found in pruned(values[:first], others, right is None, threshold):
        found = found if right is None else found + first
        mine = run[row_at[i] : row_at[i + 1]]
        met = np.concatenate([postings[starts[r] : starts[r + 1]] for r in mine])
        common = np.bincount(met, minlength=len(sets))[found]
        good = found[common >= threshold * (sizes[i] + sizes[found] - common) - 1e-9]
        links[i] += weight[good].sum()
        links[good] += weight[i]
        for j in good.tolist():
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
                forest.append((i, j))
    return every["node"].to_numpy(np.int64), links, forest


_BLOCK = "node long, links long, other long"


def _join_block(threshold: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        # Rows that repeat an id bring several texts for one node: the one it was made of counts.
        rows = rows.assign(runs=run_sets(rows["text"].tolist())).drop(columns="text")
        rows = rows[[node_of(r) == n for r, n in zip(rows["runs"], rows["node"])]]
        rows = rows.drop_duplicates("node").sort_values("node", ignore_index=True)
        lo, hi = rows["lo"].iloc[0], rows["hi"].iloc[0]
        left = rows[rows["block"] == lo].reset_index(drop=True)
        right = None if lo == hi else rows[rows["block"] == hi].reset_index(drop=True)
        nodes, links, forest = _links(left, right, threshold)
        linked = np.flatnonzero(links)
        ends = np.array(forest, np.int64).reshape(-1, 2)
        other = pd.array(np.concatenate([np.zeros(len(linked), np.int64), nodes[ends[:, 1]]]), "Int64")
        other[: len(linked)] = pd.NA
        counts = np.concatenate([links[linked], np.zeros(len(ends), np.int64)])
        return pd.DataFrame({"node": np.concatenate([nodes[linked], nodes[ends[:, 0]]]), "links": counts, "other": other})

    return run


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task: each row's class number, count of runs and band keys."""
    for batch in batches:
        for part in pieces(batch, "text"):
            nodes, sizes, bands = [], [], []
            for runs in run_sets(part.column(1).to_pylist()):
                nodes.append(node_of(runs))
                sizes.append(len(runs))
                bands.append(band_keys(minhashes(runs)).tobytes() if len(runs) else b"")
            arrays = [part.column("doc_id"), part.column("text_hash"), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(bands, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "text_hash", "node", "runs", "bands"])


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task: per band key the least node of each stretch of rows, and links of the others to it."""
    for batch in batches:
        for at in range(0, batch.num_rows, 20_000):
            part = batch.slice(at, 20_000)
            node = np.repeat(part.column(0).to_numpy(), BANDS)
            key = np.frombuffer(b"".join(part.column(1).to_pylist()), np.int64)
            order = np.lexsort((node, key))
            node, key = node[order], key[order]
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            least = np.repeat(node[first], np.diff(np.append(first, len(key))))
            linked = np.flatnonzero(least != node)
            pair = np.unique(np.stack([node[linked], least[linked]], axis=1), axis=0) if len(linked) else np.zeros((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([key[first], np.zeros(len(pair), np.int64)])),
                    pa.array(np.concatenate([node[first], pair[:, 0]])),
                    pa.array(np.concatenate([np.zeros(len(first), np.int64), pair[:, 1]]), mask=np.arange(len(first) + len(pair)) < len(first)),
                ],
                ["key", "node", "other"],
            )


def candidate_components(classes: DataFrame) -> DataFrame:
    """``(node, root)`` of the classes that share band keys, directly or through others."""
    stars = classes.filter("runs > 0").select("node", "bands").mapInArrow(_stars, "key long, node long, other long")
    stars = cut_lineage(stars, "stars")
    keyed = stars.filter("other IS NULL").select("key", "node").groupBy("key", "node").agg(F.lit(1).alias("one"))
    keyed = keyed.select("key", "node")
    least = keyed.groupBy("key").agg(F.min("node").alias("other"), F.count("*").alias("n")).filter("n > 1").drop("n")
    across = keyed.join(least, "key").filter("node <> other").select("node", "other")
    edges = stars.filter("other IS NOT NULL").select("node", "other").union(across)
    return components(edges, "node", "other")


def near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """One row per document: ``doc_id, class_id, copy_id, n_copies, n_links, text_hash``.

    Words are lower-cased and split at ASCII white space; a text of fewer than five words is one
    run. ``copy_id`` is the least id of the documents with the same set of runs (``n_copies`` of
    them), ``n_links`` the number of other documents at or over the threshold, copies included,
    and ``class_id`` the least id of those connected by links. Texts without words, null ones
    too, are linked to nothing: their class is their own id, with one copy. Rows that repeat an id
    are copies or documents of their own by their text, told apart by ``text_hash``. Null ids take part, but a least id is
    null only if there is no other. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    hashed = source.withColumn("text_hash", _text_hash("text"))
    described = hashed.mapInArrow(_describe, "doc_id long, text_hash long, node long, runs long, bands binary")
    described = cut_lineage(described, "described")
    classes = described.filter("runs > 0").groupBy("node", "runs").agg(F.min("doc_id").alias("copy_id"), F.count("*").alias("copies"))
    classes = cut_lineage(classes, "classes")
    roots = candidate_components(described)

    members = cut_lineage(classes.join(roots, "node"), "members")
    large = members.groupBy("root").agg(F.count("*").alias("n"), F.sum("runs").alias("r"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK_CLASSES), F.ceil(F.col("r") / BLOCK_RUNS)).cast("int")
    dealt = members.join(large.filter("n > 1").select("root", blocks.alias("blocks")), "root")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # A merge join at every size: texts are shuffled once, however few documents have candidates.
    texts = source.join(dealt.hint("merge"), source["doc_id"].eqNullSafe(dealt["copy_id"])).select("node", "root", "block", "blocks", "copies", "text")
    partner = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    pairs = texts.withColumn("partner", partner).select(
        "node",
        "root",
        "block",
        "copies",
        "text",
        F.least("block", "partner").alias("lo"),
        F.greatest("block", "partner").alias("hi"),
    )
    joined = (
        pairs.repartition(4 * shuffle_partitions(spark), "root", "lo", "hi")
        .groupBy("root", "lo", "hi")
        .applyInPandas(_join_block(threshold), _BLOCK)
    )
    joined = cut_lineage(joined, "links")
    links = joined.groupBy("node").agg(F.sum("links").alias("links"))
    groups = components(joined.filter("other IS NOT NULL").select("node", "other"), "node", "other")
    found = classes.join(links, "node", "left").join(groups, "node", "left")
    found = found.withColumn("root", F.coalesce("root", "node"))
    least = found.groupBy("root").agg(F.min("copy_id").alias("class_id"))
    named = found.join(least, "root").select("node", "class_id", "copy_id", "copies", F.coalesce("links", F.lit(0)).alias("links"))
    out = described.select("doc_id", "text_hash", "node", "runs").join(named, "node", "left")
    alone = F.col("runs") == 0
    return out.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("copy_id")).alias("copy_id"),
        F.when(alone, F.lit(1)).otherwise(F.col("copies")).cast("long").alias("n_copies"),
        F.when(alone, F.lit(0)).otherwise(F.col("links") + F.col("copies") - 1).cast("long").alias("n_links"),
        "text_hash",
    )


def _text_hash(column: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(column).cast("string"), F.lit("")))


def one_of_each_group(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose id is the least of their group.

    Of rows that agree in id and text one stays. Documents without words all stay, and so do
    different texts with a null id, as no id names one of them.
    """
    found = near_duplicates(docs, threshold=threshold)
    kept = found.filter(F.col("doc_id").eqNullSafe(F.col("class_id")))
    kept = kept.select(F.col("doc_id").alias("__kept_id"), F.col("text_hash").alias("__kept_hash")).distinct()
    keyed = docs.withColumns({"__id": F.col("doc_id").cast("long"), "__hash": _text_hash("text")})
    same = F.col("__id").eqNullSafe(F.col("__kept_id")) & (F.col("__hash") == F.col("__kept_hash"))
    return keyed.join(kept, same, "left_semi").dropDuplicates(["__id", "__hash"]).select(*docs.columns)
