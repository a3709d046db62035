"""Prefix trie of conversations from sorted common-prefix lengths, without a stack.

Conversations, as sequences of turn hashes, are sorted over the cluster. In the sorted order the
members of a trie node stand next to each other, so a node is an interval of rows. Where an
interval ends follows from the lengths of the prefixes that neighbouring rows share: a sparse
table answers the least such length of any stretch, and every candidate prefix (each row's whole
sequence, and what it shares with the row before it) finds its left and its right extent by a
binary search of its own. Counts of a node are then differences of running sums.

A task works on chunks of bounded size. Nodes inside a chunk are complete there. Those that touch
a chunk's first or last row are pieces, at most two paths for each chunk; they are added up by the
hash of their prefix, less what the two sides of a border both counted. Equal sequences are sorted
by id, so they spread over as many chunks as they need.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from sensorloom.llm.common import shuffle_partitions
from sensorloom.scratch import cut_lineage

#: A task closes a chunk at so many conversations or turns.
CHUNK_ROWS = 1 << 17
CHUNK_TURNS = 1 << 20
#: Turns of a task, on average.
TASK_TURNS = 4 << 20

_HASH = 16
_NODE = (
    "node binary, parent binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
    "n_leaves long, saved_tokens long, ends_sha256 string, ends string"
)
_SCHEMA = f"chunk long, {_NODE}, first binary, last binary, last_sizes array<long>"
_NO_ENDS = hashlib.sha256(b"").hexdigest()
_COUNTS = ("n_convs", "n_children", "n_leaves", "saved_tokens")


class Minima:
    """Sparse table: the least value of any stretch in two look-ups."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while 2 << len(self.levels) - 1 <= len(values):
            last, half = self.levels[-1], 1 << len(self.levels) - 1
            self.levels.append(np.minimum(last[:-half], last[half:]))

    def least(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Least of ``values[lo:hi + 1]`` for each pair, none of them empty."""
        level = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
        out = np.empty(len(lo), self.levels[0].dtype)
        for k in np.unique(level):
            at = level == k
            table = self.levels[k]
            out[at] = np.minimum(table[lo[at]], table[hi[at] - (1 << k) + 1])
        return out

    def right(self, at: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """How far each position can move right over values of at least ``depth``; a value stands between two positions."""
        return self._reach(at, depth, 1)

    def left(self, at: np.ndarray, depth: np.ndarray) -> np.ndarray:
        return self._reach(at, depth, -1)

    def _reach(self, at: np.ndarray, depth: np.ndarray, way: int) -> np.ndarray:
        to, n = at.copy(), len(self.levels[0])
        for k in range(len(self.levels) - 1, -1, -1):
            table, step = self.levels[k], 1 << k
            start = to if way > 0 else to - step
            fits = (start >= 0) & (start + step <= n)
            fits[fits] = table[start[fits]] >= depth[fits]
            to[fits] += way * step
        return to


def shared_lengths(tokens: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Tokens that each row shares with the one before it at the start; row ``i`` is ``tokens[at[i]:at[i + 1]]``."""
    lengths = np.diff(at)
    most = np.minimum(lengths[1:], lengths[:-1])
    starts = np.cumsum(most) - most
    inside = np.arange(most.sum()) - np.repeat(starts, most)
    same = (tokens[inside + np.repeat(at[:-2], most)] == tokens[inside + np.repeat(at[1:-1], most)]).all(axis=1)
    differ = np.append(np.flatnonzero(~same), np.iinfo(np.int64).max)
    return np.minimum(most, differ[np.searchsorted(differ, starts)] - starts)


def _digests(key: bytes) -> list[bytes]:
    """Hash of every prefix of a sequence, the empty one first."""
    running = hashlib.blake2b(digest_size=_HASH)
    out = [running.digest()]
    for i in range(0, len(key), _HASH):
        running.update(key[i : i + _HASH])
        out.append(running.digest())
    return out


def chunk_nodes(ids: np.ndarray, keys: list[bytes], sizes: np.ndarray) -> dict[str, list]:
    """Columns of the trie's nodes over sorted rows; ``node`` is set for those that touch the first or last row.

    ``ids`` and ``keys`` are the rows' ids and turn hashes, one after the other; ``sizes`` the code
    points of all turns in the same order.
    """
    m = len(ids)
    at = np.zeros(m + 1, np.int64)
    np.cumsum([len(k) // _HASH for k in keys], out=at[1:])
    tokens = np.frombuffer(b"".join(keys), np.uint64).reshape(-1, 2)
    length, shared = np.diff(at), shared_lengths(tokens, at)
    border = np.concatenate(([-1], shared, [-1]))  # border[i]: shared by the rows i - 1 and i
    table, least_id = Minima(shared), Minima(ids)
    running = np.concatenate(([0], np.cumsum(sizes)))

    def before(row, depth):
        """Code points of the first ``depth`` turns of a row."""
        return running[at[row] + depth] - running[at[row]]

    rows = np.arange(m)
    start, depth = np.concatenate((rows, rows[1:])), np.concatenate((length, shared))
    lo, hi = table.left(start, depth), table.right(start, depth)
    order = np.lexsort((depth, hi, lo))
    lo, hi, depth = lo[order], hi[order], depth[order]
    last = np.append((lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]), True)
    lo, hi, depth = lo[last], hi[last], depth[last]
    above = np.maximum(border[lo], border[hi + 1])
    has_above = above >= 0
    up_lo, up_hi = lo.copy(), hi.copy()
    up_lo[has_above], up_hi[has_above] = table.left(lo[has_above], above[has_above]), table.right(lo[has_above], above[has_above])

    total = before(rows, length)
    sums = np.concatenate(([0], np.cumsum(total)))
    fresh = np.concatenate(([0, 0], np.cumsum(total[1:] - before(rows[1:], shared))))
    leaves = np.concatenate(([0], np.cumsum(length > border[1:])))
    branches = np.sort((shared * (m + 1) + rows[1:])[length[1:] > shared])
    found = np.searchsorted(branches, depth * (m + 1) + hi, "right") - np.searchsorted(branches, depth * (m + 1) + lo, "right")
    children = found + (length[lo] > depth)
    same = np.append((shared < length[1:]) | (shared < length[:-1]), True)
    run_end = np.flatnonzero(same)[np.searchsorted(np.flatnonzero(same), rows)]
    ends = np.where(length[lo] == depth, np.minimum(run_end[lo], hi) - lo + 1, 0)
    edge, up_edge = (lo == 0) | (hi == m - 1), has_above & ((up_lo == 0) | (up_hi == m - 1))
    mine, up = least_id.least(lo, hi), least_id.least(up_lo, up_hi)

    of = np.repeat(np.arange(len(lo)), depth - above)
    d = np.arange(len(of)) - np.repeat(np.cumsum(depth - above) - (depth - above), depth - above) + above[of] + 1
    whole, top = d == depth[of], d == above[of] + 1
    earlier = before(lo[of], np.maximum(d - 1, 0))
    n = (hi - lo + 1)[of]
    members = (sums[hi + 1] - sums[lo])[of] - n * earlier
    distinct = (total[lo] + fresh[hi + 1] - fresh[lo + 1])[of] - earlier

    paths = {0: _digests(keys[0]), m - 1: _digests(keys[-1])}
    is_edge, from_edge = edge[of], np.where(top, up_edge[of], edge[of] & (d > 0))
    node: list = [None] * len(of)
    parent: list = [None] * len(of)
    sha: list = [_NO_ENDS] * len(of)
    texts: list = [None] * len(of)
    for i in np.flatnonzero(is_edge | from_edge):
        k = of[i]
        if is_edge[i]:
            node[i] = paths[0 if lo[k] == 0 else m - 1][d[i]]
        if from_edge[i] and d[i] > 0:
            left = up_lo[k] if top[i] else lo[k]
            parent[i] = paths[0 if left == 0 else m - 1][d[i] - 1]
    for i in np.flatnonzero(whole & (ends[of] > 0)):
        k = of[i]
        text = ",".join(map(str, ids[lo[k] : lo[k] + ends[k]].tolist()))
        if is_edge[i]:
            texts[i] = text
        else:
            sha[i] = hashlib.sha256(text.encode()).hexdigest()
    parent_id = np.where(top, up[of], mine[of])
    return {
        "node": node,
        "parent": parent,
        "conv_id": mine[of],
        "depth": d,
        "parent_conv_id": pa.array(parent_id, mask=(d == 0) | from_edge),
        "n_convs": n,
        "n_children": np.where(whole, children[of], 1),
        "n_leaves": (leaves[hi + 1] - leaves[lo])[of],
        "saved_tokens": members - distinct,
        "ends_sha256": sha,
        "ends": texts,
    }


def _nodes(limit_rows: int, limit_turns: int):
    """Task over sorted rows: nodes and pieces of each chunk, and its first and last row."""
    import pyarrow.types as kinds

    schema = pa.schema(
        [("chunk", pa.int64()), ("node", pa.binary()), ("parent", pa.binary()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64())]
        + [(c, pa.int64()) for c in _COUNTS]
        + [("ends_sha256", pa.string()), ("ends", pa.string()), ("first", pa.binary()), ("last", pa.binary()), ("last_sizes", pa.list_(pa.int64()))]
    )

    def chunk(number: int, rows: list) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(rows).combine_chunks()
        keys = table.column("key").to_pylist()
        sizes = np.concatenate([np.asarray(c.flatten()) for c in table.column("sizes").chunks]).astype(np.int64)
        columns = chunk_nodes(table.column("conv_id").to_numpy(), keys, sizes)
        n = len(columns["node"])
        got = {"chunk": [number] * n} | columns
        arrays = [got[f.name] if isinstance(got.get(f.name), pa.Array) else pa.array(got.get(f.name, [None] * n), f.type) for f in schema]
        yield pa.RecordBatch.from_arrays(arrays, schema=schema)
        row = {"chunk": number, "first": keys[0], "last": keys[-1], "last_sizes": sizes[len(sizes) - len(keys[-1]) // _HASH :].tolist()}
        yield pa.RecordBatch.from_pylist([row], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, rows, held, turns = TaskContext.get().partitionId() << 32, [], 0, 0
        for batch in batches:
            keys = batch.column(batch.schema.get_field_index("key"))
            offsets = np.frombuffer(keys.buffers()[1], np.int64 if kinds.is_large_binary(keys.type) else np.int32)
            offsets = offsets[keys.offset : keys.offset + len(keys) + 1].astype(np.int64) // _HASH
            lo = 0
            while lo < batch.num_rows:
                room = int(np.searchsorted(offsets, offsets[lo] + max(0, limit_turns - turns), "right")) - 1 - lo
                take = min(batch.num_rows - lo, limit_rows - held, max(room, 0 if held else 1))
                if take:
                    rows.append(batch.slice(lo, take))
                    held, turns, lo = held + take, turns + int(offsets[lo + take] - offsets[lo]), lo + take
                if lo < batch.num_rows or held >= limit_rows:
                    yield from chunk(number, rows)
                    number, rows, held, turns = number + 1, [], 0, 0
        if rows:
            yield from chunk(number, rows)

    return run


def _double_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task over borders of chunks: for each node on both sides, less what was counted twice."""
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            last, first, sizes = r["last"], r["next"], r["last_sizes"]
            n, most = len(last) // _HASH, min(len(last), len(first)) // _HASH
            a, b = (np.frombuffer(x[: most * _HASH], np.uint64).reshape(-1, 2) for x in (last, first))
            shared = int(np.argmin(np.append((a == b).all(axis=1), False)))
            digests = _digests(last[: shared * _HASH])
            running = [0, *np.cumsum(np.array(sizes[:shared], np.int64)).tolist()]
            for d in range(shared + 1):
                rows.append((digests[d], -int(d < shared), -int(n == shared), running[shared] - running[max(d - 1, 0)]))
        columns = list(zip(*rows)) if rows else [[]] * 4
        types = [pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types)], ["node", "n_children", "n_leaves", "saved_tokens"]
        )


def _digest_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task over pieces of id lists sorted by node and chunk: the hash of each node's whole list, as a running hash."""
    node, running = None, None
    done: list[tuple] = []
    for batch in batches:
        for key, text in zip(batch.column("node").to_pylist(), batch.column("ends").to_pylist()):
            if key != node:
                if running is not None:
                    done.append((node, running.hexdigest()))
                node, running = key, hashlib.sha256(text.encode())
            else:
                running.update(b"," + text.encode())
        yield _digest_batch(done)
        done = []
    if running is not None:
        yield _digest_batch([(node, running.hexdigest())])


def _digest_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())], ["node", "sha"]
    )


def turn_lists(conversations: DataFrame) -> DataFrame:
    """``conv_id, turns`` with each conversation's turns in order: hash of role and text, code points of the text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    known = F.col("turn").isNotNull()
    turn = F.struct(
        known.alias("known"),
        F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"),
        F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")).alias("hash"),
        F.length(text).cast("long").alias("size"),
    )
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("turn")).filter("conv_id IS NOT NULL")
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))


def rebuilt(lists: DataFrame) -> DataFrame:
    """Each conversation with its first h turns replaced by those of the conversation of its hundred.

    ``h`` is the unsigned CRC-32 of the decimal id modulo 6. ``lists`` is read twice, the second
    time only for the first five turns of one id in a hundred.
    """
    heads = lists.filter("conv_id % 100 = 0").select(F.col("conv_id").alias("_base"), F.slice("turns", 1, 5).alias("_head"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(6)).cast("int")
    own = F.slice("turns", h + 1, F.greatest(F.size("turns"), F.lit(1)))
    head = F.coalesce(F.slice("_head", F.lit(1), h), F.slice("turns", 1, 0))
    joined = lists.join(heads, F.col("conv_id") - F.col("conv_id") % 100 == F.col("_base"), "left")
    return joined.select("conv_id", F.concat(head, own).alias("turns"))


def prefix_trie(sequences: DataFrame, chunk_rows: int = CHUNK_ROWS, chunk_turns: int = CHUNK_TURNS) -> DataFrame:
    """The trie of ``conv_id, turns`` (as from ``turn_lists``), one row per node.

    A node is a distinct sequence of the first ``depth`` turns, from the root of depth 0. Columns:
    ``conv_id`` its smallest member, ``depth``, ``parent_conv_id`` (null at the root), ``n_convs``
    members, ``n_children``, ``n_leaves`` childless nodes in its subtree, itself included,
    ``saved_tokens`` the subtree's sum of (members - 1) times the code points of the last turn, and
    ``ends_sha256`` over the ids of members with no further turn.

    Ids are distinct and not null. A conversation without turns is a member of the root alone. No
    conversations give no nodes. One conversation's hashes and sizes (40 bytes a turn, no texts) are
    one row. SHA-256 has to read a list of ids in order: a list that goes over many chunks is hashed
    as a stream of one piece per chunk.
    """
    spark = sequences.sparkSession
    turns = sequences.agg(F.sum(F.size("turns"))).first()[0] or 0
    flat = sequences.select(
        "conv_id",
        F.unhex(F.array_join(F.transform("turns", lambda t: t["hash"]), "")).alias("key"),
        F.transform("turns", lambda t: t["size"]).alias("sizes"),
    )
    parts = max(shuffle_partitions(spark), -(-turns // TASK_TURNS))
    ordered = flat.repartitionByRange(parts, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    pieces = cut_lineage(ordered.mapInArrow(_nodes(chunk_rows, chunk_turns), _SCHEMA), "trie")

    # One row per chunk, so about one per task.
    borders = pieces.filter("last IS NOT NULL").select("chunk", "first", "last", "last_sizes")
    borders = borders.withColumn("next", F.lead("first").over(W.orderBy("chunk"))).filter("next IS NOT NULL")
    twice = borders.select("last", "next", "last_sizes").mapInArrow(
        _double_counts, "node binary, n_children long, n_leaves long, saved_tokens long"
    )
    edges = pieces.filter("node IS NOT NULL")
    added = edges.select("node", "parent", "conv_id", "depth", *_COUNTS).unionByName(twice, allowMissingColumns=True)
    merged = added.groupBy("node").agg(
        F.max("parent").alias("parent"),
        F.min("conv_id").alias("conv_id"),
        F.max("depth").alias("depth"),
        *[F.sum(c).alias(c) for c in _COUNTS],
    )
    texts = edges.filter("ends IS NOT NULL").select("node", "chunk", "ends")
    texts = texts.repartition("node").sortWithinPartitions("node", "chunk").select("node", "ends")
    hashed = texts.mapInArrow(_digest_ends, "node binary, sha string")
    merged = merged.join(hashed, "node", "left").withColumn("ends_sha256", F.coalesce("sha", F.lit(_NO_ENDS)))
    merged = cut_lineage(merged, "merged")

    columns = ["conv_id", "depth", "parent_conv_id", *_COUNTS, "ends_sha256"]
    above = merged.select(F.col("node").alias("parent"), F.col("conv_id").alias("_above"))
    inner = pieces.filter("node IS NULL AND depth IS NOT NULL")
    both = inner.select("parent", *columns).unionByName(merged.select("parent", *[c for c in columns if c != "parent_conv_id"]), allowMissingColumns=True)
    known = both.filter("parent IS NULL").select(*columns)
    found = both.filter("parent IS NOT NULL").join(above, "parent").withColumn("parent_conv_id", F.col("_above")).select(*columns)
    return known.unionByName(found)


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of all rebuilt conversations of ``conv_id, turn, role, text``.

    Turns are ordered by number, null first, those of one number by the hash of role and text;
    repeated rows are turns of their own. Null roles and texts are empty, rows of a null id take no
    part. Further columns, of whatever name, are not read.
    """
    lists = cut_lineage(turn_lists(conversations.select("conv_id", "turn", "role", "text")), "turns")
    return prefix_trie(rebuilt(lists))
