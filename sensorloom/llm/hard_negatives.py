"""Hard negatives by rotated one-bit codes with a deterministic interval for every score.

A vector is rotated by a fixed random orthogonal matrix; its code is the signs. Stored with it are
its length and its projection onto the code's direction (the alignment of code and vector). What
the code leaves out is orthogonal to that direction, and its length is known, so by Cauchy-Schwarz

    score = projection * t  +-  |rest of the vector| * sqrt(|query|^2 - t^2),

where t is the query along the code. The query is rounded to eight bits, so t comes from eight
popcounts, and the rounding adds its own Cauchy-Schwarz term. Pairs whose interval cannot reach
what is looked for are dropped; the others get their integer score. As the interval is certain,
the result is that of scoring all pairs.

Queries (anchors) are sent to the tasks in shards of bounded size, and each task holds them
against its own rows in blocks, keeping only the best few per query; vectors are never shuffled.
Each shard is one more pass over the codes. How many pairs the intervals drop depends on the
vectors: most, where positives are much closer than other rows; few, where all directions are
alike and positives hardly stand out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from sensorloom.scratch import cut_lineage

POSITIVES = 5
NEGATIVES = 5
#: A negative's score is between this many hundredths of the positive's and all of it.
LEAST_SHARE = 80
QUERY_EVERY = 100
#: A shard of queries is closed at so many rows or bytes.
SHARD_QUERIES = 16_384
SHARD_BYTES = 32 << 20

_SEED = 20_250
_PLANES = 8
_QUERY_BLOCK = 512
#: Rows of the blocks that a task scores; the first ones are small and give a floor for the rest.
_ROW_BLOCKS = (64, 256, 1024)
#: From this share of surviving pairs on, a block is scored as one matrix product.
_DENSE = 1 / 16

_CODES = "vec_id long, label long, ints binary, code binary, norm double, projection double"


@lru_cache(maxsize=2)
def rotation(dims: int) -> np.ndarray:
    """The random orthogonal matrix of a dimension, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng(_SEED).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def _bits(signs: np.ndarray) -> np.ndarray:
    """Rows of truth values as rows of 64-bit words."""
    packed = np.packbits(signs, axis=1, bitorder="little")
    out = np.zeros((len(signs), -(-signs.shape[1] // 64) * 8), np.uint8)
    out[:, : packed.shape[1]] = packed
    return out.view(np.uint64)


class Codes:
    """One-bit codes of integer vectors, with length and projection onto the code's direction."""

    def __init__(self, ints: np.ndarray, words: np.ndarray, norm: np.ndarray, projection: np.ndarray):
        self.ints, self.words, self.norm, self.projection = ints, words, norm, projection
        self.rest = np.sqrt(np.maximum(norm**2 - projection**2, 0))
        self.ones = np.bitwise_count(words).sum(axis=1, dtype=np.int64)
        self.largest = int(np.abs(ints).max(initial=0))

    @classmethod
    def of(cls, ints: np.ndarray) -> Codes:
        turned = ints.astype(np.float64) @ rotation(ints.shape[1]).T
        norm = np.sqrt((turned**2).sum(axis=1))
        projection = np.abs(turned).sum(axis=1) / np.sqrt(max(1, ints.shape[1]))
        return cls(ints, _bits(turned >= 0), norm, np.minimum(projection, norm))

    def rows(self, at) -> Codes:
        return Codes(self.ints[at], self.words[at], self.norm[at], self.projection[at])


class Queries:
    """Rotated query vectors rounded to bit planes."""

    def __init__(self, ints: np.ndarray):
        self.ints, dims = ints, ints.shape[1]
        self.largest = int(np.abs(ints).max(initial=0))
        turned = ints.astype(np.float64) @ rotation(dims).T
        self.norm = np.sqrt((turned**2).sum(axis=1))
        self.low = turned.min(axis=1, initial=0)
        self.step = np.maximum((turned.max(axis=1, initial=0) - self.low) / ((1 << _PLANES) - 1), 1e-12)
        level = np.rint((turned - self.low[:, None]) / self.step[:, None]).astype(np.int64)
        self.planes = np.stack([_bits((level >> k) & 1 == 1) for k in range(_PLANES)]) if len(ints) else np.zeros((_PLANES, 0, 0), np.uint64)
        self.sum = level.sum(axis=1)
        self.off = np.sqrt(((turned - self.low[:, None] - self.step[:, None] * level) ** 2).sum(axis=1))

    def block(self, lo: int, hi: int) -> Queries:
        out = object.__new__(Queries)
        for name in ("ints", "norm", "low", "step", "sum", "off"):
            setattr(out, name, getattr(self, name)[lo:hi])
        out.planes, out.largest = self.planes[:, lo:hi], self.largest
        return out

    def bounds(self, codes: Codes) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bound of the score of each query (row) with each vector (column)."""
        dims = self.ints.shape[1]
        inside = np.zeros((len(self.norm), len(codes.norm)), np.int64)
        for k in range(_PLANES):
            for word in range(codes.words.shape[1]):
                both = self.planes[k][:, None, word] & codes.words[None, :, word]
                inside += np.bitwise_count(both).astype(np.int64) << k
        along = self.low[:, None] * (2 * codes.ones - dims) + self.step[:, None] * (2 * inside - self.sum[:, None])
        along /= np.sqrt(max(1, dims))
        least = np.maximum(np.abs(along) - self.off[:, None], 0)
        across = np.sqrt(np.maximum(self.norm[:, None] ** 2 - least**2, 0))
        slack = 1e-9 * self.norm[:, None] * codes.norm + 1e-6
        reach = codes.rest * across + codes.projection * self.off[:, None] + slack
        middle = codes.projection * along
        return middle - reach, middle + reach

    def scores(self, codes: Codes, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, vector and integer score of the wanted pairs."""
        q, v = np.nonzero(wanted)
        fits = self.largest * codes.largest * max(1, self.ints.shape[1]) < 1 << 53
        if len(q) > _DENSE * wanted.size and fits:
            return q, v, (self.ints.astype(np.float64) @ codes.ints.T.astype(np.float64))[q, v].astype(np.int64)
        out = np.empty(len(q), np.int64)
        for at in range(0, len(q), 1 << 16):
            part = slice(at, at + (1 << 16))
            out[part] = (self.ints[q[part]].astype(np.int64) * codes.ints[v[part]]).sum(axis=1)
        return q, v, out


class Best:
    """The best few scores of each query and slot, by falling score and rising id."""

    def __init__(self, floor: np.ndarray, keep: int):
        self.floor, self.keep = floor, keep
        self.held = [np.zeros(0, np.int64) for _ in range(4)]

    def add(self, query: np.ndarray, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        q, s, x, i = (np.concatenate(pair) for pair in zip(self.held, (query, slot, score, ids)))
        order = np.lexsort((i, -x, s, q))
        q, s, x, i = q[order], s[order], x[order], i[order]
        new = np.append(True, (q[1:] != q[:-1]) | (s[1:] != s[:-1]) | (x[1:] != x[:-1]) | (i[1:] != i[:-1]))[: len(q)]
        q, s, x, i = q[new], s[new], x[new], i[new]
        first = np.append(True, (q[1:] != q[:-1]) | (s[1:] != s[:-1]))[: len(q)]
        rank = np.arange(len(q)) - np.flatnonzero(first)[np.cumsum(first) - 1] if len(q) else np.zeros(0, np.int64)
        full = rank == self.keep - 1
        self.floor[q[full], s[full]] = np.maximum(self.floor[q[full], s[full]], x[full])
        self.held = [c[rank < self.keep] for c in (q, s, x, i)]


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """A list column as rows of ``dims`` numbers; missing ones are 0."""
    at = np.asarray(column.offsets).astype(np.int64)
    values = np.asarray(column.values).astype(np.int64)[at[0] : at[-1]]
    lengths = np.diff(at)
    if (lengths == dims).all():
        return values.reshape(-1, dims)
    out = np.zeros((len(lengths), dims), np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(values)) - np.repeat(at[:-1] - at[0], lengths)] = values
    return out


def _encode(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ints = _matrix(batch.column("ints"), dims)
            codes = Codes.of(ints)
            kind = np.int32 if codes.largest < 1 << 31 else np.int64
            columns = [pa.array([r.tobytes() for r in x], pa.binary()) for x in (ints.astype(kind), codes.words)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), *columns, pa.array(codes.norm), pa.array(codes.projection)],
                ["vec_id", "label", "ints", "code", "norm", "projection"],
            )

    return run


def _numbers(values: list[bytes], dims: int) -> np.ndarray:
    kinds = {len(v) for v in values}
    if len(kinds) == 1 and dims:
        kind = np.int32 if kinds == {4 * dims} else np.int64
        return np.frombuffer(b"".join(values), kind).reshape(-1, dims).astype(np.int64)
    rows = [np.frombuffer(v, np.int32 if len(v) == 4 * dims else np.int64) for v in values]
    return np.array(rows, np.int64).reshape(len(values), dims)


def _blocks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[np.ndarray, np.ndarray, Codes]]:
    """Ids, labels and codes of a task's rows, in blocks that grow."""
    sizes = iter(_ROW_BLOCKS)
    size = next(sizes)
    for batch in batches:
        lo = 0
        while lo < batch.num_rows:
            part = batch.slice(lo, size)
            words = np.frombuffer(b"".join(part.column("code").to_pylist()), np.uint64).reshape(part.num_rows, -1)
            ints = _numbers(part.column("ints").to_pylist(), dims)
            norm, projection = (part.column(c).to_numpy() for c in ("norm", "projection"))
            yield part.column("vec_id").to_numpy(), part.column("label").to_numpy(), Codes(ints, words, norm, projection)
            lo += part.num_rows
            size = next(sizes, size)


def _nearest(sent, keep: int):
    """Task: for each query its ``keep`` best rows of the same label and another id, among the task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, ints = sent.value
        queries = {x: (np.flatnonzero(labels == x), Queries(ints[labels == x])) for x in np.unique(labels).tolist()}
        best = {x: Best(np.full((len(at), 1), np.iinfo(np.int64).min), keep) for x, (at, _) in queries.items()}
        for row_ids, row_labels, codes in _blocks(batches, ints.shape[1]):
            for x in np.unique(row_labels).tolist():
                if x not in queries:
                    continue
                (at, mine), pool, rows = queries[x], best[x], np.flatnonzero(row_labels == x)
                part, part_ids = codes.rows(rows), row_ids[rows]
                for lo in range(0, len(at), _QUERY_BLOCK):
                    block = mine.block(lo, lo + _QUERY_BLOCK)
                    _, upper = block.bounds(part)
                    floor = pool.floor[lo : lo + _QUERY_BLOCK, :1]
                    wanted = (upper >= floor) & (ids[at[lo : lo + _QUERY_BLOCK], None] != part_ids)
                    q, v, score = block.scores(part, wanted)
                    good = score >= floor[q, 0]
                    q, v, score = q[good] + lo, v[good], score[good]
                    pool.add(q, np.zeros(len(q), np.int64), score, part_ids[v])
        for x, pool in best.items():
            q, _, score, other = pool.held
            yield pa.RecordBatch.from_arrays([pa.array(queries[x][0][q]), pa.array(score), pa.array(other)], ["query", "score", "vec_id"])

    return run


def _negatives(sent, keep: int, share: int):
    """Task: for each query and positive its ``keep`` best rows of another label within the positive's range of scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, ints, positive_scores = sent.value
        none = positive_scores == np.iinfo(np.int64).min
        high = positive_scores
        # Below 0 the share is above the score itself, so the range is empty.
        low = np.where(none, np.iinfo(np.int64).max, -(-share * np.where(none, 0, high) // 100))
        queries = Queries(ints)
        pools = [Best(low[at : at + _QUERY_BLOCK].copy(), keep) for at in range(0, len(labels), _QUERY_BLOCK)]
        for row_ids, row_labels, codes in _blocks(batches, ints.shape[1]):
            for at, pool in zip(range(0, len(labels), _QUERY_BLOCK), pools):
                block, top = queries.block(at, at + _QUERY_BLOCK), high[at : at + _QUERY_BLOCK]
                lower, upper = block.bounds(codes)
                wanted = np.zeros(lower.shape, bool)
                for slot in range(top.shape[1]):
                    wanted |= (upper >= pool.floor[:, slot, None]) & (lower <= top[:, slot, None])
                wanted &= labels[at : at + _QUERY_BLOCK, None] != row_labels
                q, v, score = block.scores(codes, wanted)
                found = [(score >= pool.floor[q, slot]) & (score <= top[q, slot]) for slot in range(top.shape[1])]
                slot = np.repeat(np.arange(top.shape[1]), [f.sum() for f in found])
                pick = np.concatenate([np.flatnonzero(f) for f in found]) if found else np.zeros(0, np.int64)
                pool.add(q[pick], slot, score[pick], row_ids[v[pick]])
        for at, pool in zip(range(0, len(labels), _QUERY_BLOCK), pools):
            q, slot, score, other = pool.held
            columns = [pa.array(q + at), pa.array(slot), pa.array(score), pa.array(other)]
            yield pa.RecordBatch.from_arrays(columns, ["query", "slot", "score", "vec_id"])

    return run


def one_bit_codes(vectors: DataFrame) -> tuple[DataFrame, int]:
    """A written table of ids, labels, integer vectors and codes, and the dimension. ``vectors``: ``vec_id, label, ints``."""
    dims = vectors.agg(F.max(F.size("ints"))).first()[0] or 0
    return cut_lineage(vectors.mapInArrow(_encode(dims), _CODES), "codes"), dims


def _shards(queries: DataFrame, dims: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Queries by id in shards of bounded rows and bytes; the driver holds one at a time."""
    limit = max(1, min(SHARD_QUERIES, SHARD_BYTES // max(1, 8 * dims)))
    rows = queries.orderBy("vec_id", "label", "ints").toLocalIterator()
    shard: list = []
    for r in rows:
        if len(shard) == limit:
            yield _columns(shard, dims)
            shard = []
        shard.append((r["vec_id"], r["label"], bytes(r["ints"])))
    if shard:
        yield _columns(shard, dims)


def _columns(shard: list, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, labels, ints = zip(*shard)
    return np.array(ids, np.int64), np.array(labels, np.int64), _numbers(list(ints), dims)


def mine(
    vectors: DataFrame, every: int = QUERY_EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, share: int = LEAST_SHARE
) -> DataFrame:
    """Hard negatives of ``vec_id, label, ints`` for the rows whose id is divisible by ``every``.

    One row per anchor, positive and negative: ``anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score``. Positives are the best ``positives`` rows of the anchor's
    label and another id, negatives the best ``negatives`` of another label whose score is
    between ``share`` hundredths of the positive's and all of it. Scores are integer inner
    products in 64 bits; higher ones come first, of equal ones the smaller id.

    Vectors of fewer numbers than the longest are filled up with 0. Repeated rows count once;
    rows that share an id but differ are rows of their own. An anchor without positives, or a
    positive without negatives, gives no rows, and so do empty tables.
    """
    spark = vectors.sparkSession
    codes, dims = one_bit_codes(vectors)
    anchors = codes.filter(F.col("vec_id") % every == 0).select("vec_id", "label", "ints").distinct()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    out = spark.createDataFrame([], schema)
    for ids, labels, ints in _shards(anchors, dims):
        # Bounded by the shard: its queries, and then its best rows.
        sent = spark.sparkContext.broadcast((ids, labels, ints))
        near = codes.mapInArrow(_nearest(sent, positives), "query long, score long, vec_id long").distinct()
        place = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
        top = near.withColumn("slot", place).filter(F.col("slot") <= positives).toArrow()
        query, slot = (top.column(c).to_numpy().astype(np.int64) for c in ("query", "slot"))
        best_ids, best_scores = (np.full((len(ids), positives), np.iinfo(np.int64).min) for _ in range(2))
        best_ids[query, slot - 1], best_scores[query, slot - 1] = top.column("vec_id").to_numpy(), top.column("score").to_numpy()

        sent = spark.sparkContext.broadcast((labels, ints, best_scores))
        rest = codes.mapInArrow(_negatives(sent, negatives, share), "query long, slot long, score long, vec_id long").distinct()
        place = F.row_number().over(W.partitionBy("query", "slot").orderBy(F.desc("score"), "vec_id"))
        ranked = rest.withColumn("rank", place).filter(F.col("rank") <= negatives)
        pairs = {
            "query": np.repeat(np.arange(len(ids)), positives),
            "slot": np.tile(np.arange(positives), len(ids)),
            "anchor_id": np.repeat(ids, positives),
            "positive_id": best_ids.ravel(),
            "positive_score": best_scores.ravel(),
        }
        known = spark.createDataFrame(pa.table({k: pa.array(v, pa.int64()) for k, v in pairs.items()}))
        rows = ranked.join(known, ["query", "slot"]).select(
            "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
        )
        out = out.union(cut_lineage(rows, "negatives"))
    return out


def integer_vectors(embeddings: DataFrame) -> DataFrame:
    """``vec_id, label, ints`` of ``vec_id, embedding, label``: each component x is floor(256 x).

    Rows with a null id or label, a null vector, or a component that is null or not finite are
    left out. Where the id is divisible by 7 the label is the next one modulo 10.
    """
    label = F.col("label").cast("long")
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = embeddings.filter(F.col("vec_id").isNotNull() & label.isNotNull() & x.isNotNull() & finite)
    return rows.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"),
        F.transform(x, lambda v: F.floor(v * 256)).alias("ints"),
    )


def hard_negatives(embeddings: DataFrame, **options) -> DataFrame:
    """``mine`` over the integer vectors of ``vec_id, embedding, label``; further columns are not read."""
    return mine(integer_vectors(embeddings.select("vec_id", "embedding", "label")), **options)
