"""Exact duplicates by an exchange of Golomb-coded fingerprints.

1. Every scan task hashes its rows' normalised texts. For each owner (a range of the hash
   space) it sorts its distinct fingerprints and sends their gaps Golomb-Rice coded, a few
   bits each; its row ids and digests stay in a written table beside the message.
2. Each owner decodes the messages and answers every sender with a bitmap: which of its
   fingerprints another sender has too.
3. Rows behind a set bit, or with a fingerprint twice in their own task, are suspects. Only
   suspects' texts are shuffled, and grouped by their whole bytes.

A fingerprint has ``EXTRA_BITS`` bits more than are needed to number the rows, so about one row
in 2**EXTRA_BITS is a suspect by chance; the byte comparison decides. Copies meet in a task's
message and in Spark's map-side aggregation before anything is shuffled, so a text that fills
a third of the table costs each owner one fingerprint a sender, and a third of a bitmap.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from sensorloom.llm.common import shuffle_partitions
from sensorloom.llm.text import pieces
from sensorloom.scratch import cut_lineage

EXTRA_BITS = 10
#: Fingerprints that one owner decodes at most, on average.
OWNER_ROWS = 4_000_000
#: Rows that a task gathers before it sends a message to each owner.
SENDER_ROWS = 200_000

_SENT = "sender long, part long, owner int, n long, gaps binary, ids array<long>, digests array<binary>, at array<long>"


def golomb_encode(values: np.ndarray, bits: int) -> bytes:
    """Gaps of sorted distinct integers: quotients by ``2**bits`` in unary, remainders in binary."""
    gaps = np.diff(values, prepend=np.uint64(0))
    high, low = (gaps >> np.uint64(bits)).astype(np.int64), gaps & np.uint64((1 << bits) - 1)
    ends = np.cumsum(high + 1)
    unary = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    unary[ends - 1] = 1
    rest = (low[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return bytes([bits]) + np.packbits(np.concatenate([rest.astype(np.uint8).ravel(), unary])).tobytes()


def golomb_decode(data: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.uint64)
    bits = data[0]
    flags = np.unpackbits(np.frombuffer(data, np.uint8, offset=1))
    low = flags[: n * bits].reshape(n, bits).astype(np.uint64) @ (np.uint64(1) << np.arange(bits, dtype=np.uint64))
    ends = np.flatnonzero(flags[n * bits :])[:n]
    high = np.diff(ends, prepend=-1).astype(np.uint64) - np.uint64(1)
    return np.cumsum((high << np.uint64(bits)) + low, dtype=np.uint64)


def _send(owners: int, bits: int):
    """Task: rows with binary ``_bytes`` to one message for each owner and ``SENDER_ROWS`` rows."""
    width = -(-(1 << bits) // owners)

    def message(sender: int, part: int, ids: list, digests: list) -> Iterator[pa.RecordBatch]:
        prints = np.array([int.from_bytes(d[:8], "little") for d in digests], np.uint64) >> np.uint64(64 - bits)
        owner = (prints // np.uint64(width)).astype(np.int64)
        order = np.lexsort((prints, owner))
        cuts = np.searchsorted(owner[order], np.arange(owners + 1))
        for o in np.flatnonzero(np.diff(cuts)):
            rows = order[cuts[o] : cuts[o + 1]]
            values, at = np.unique(prints[rows] - np.uint64(o * width), return_inverse=True)
            rice = max(0, int(width // max(1, len(values))).bit_length() - 1)
            yield pa.RecordBatch.from_pylist(
                [
                    {
                        "sender": sender,
                        "part": part,
                        "owner": int(o),
                        "n": len(values),
                        "gaps": golomb_encode(values, rice),
                        "ids": [ids[r] for r in rows],
                        "digests": [digests[r] for r in rows],
                        "at": at.tolist(),
                    }
                ],
                schema=_arrow,
            )

    _arrow = pa.schema(
        [
            ("sender", pa.int64()),
            ("part", pa.int64()),
            ("owner", pa.int32()),
            ("n", pa.int64()),
            ("gaps", pa.binary()),
            ("ids", pa.list_(pa.int64())),
            ("digests", pa.list_(pa.binary())),
            ("at", pa.list_(pa.int64())),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sender, part, ids, digests = TaskContext.get().partitionId(), 0, [], []
        for batch in batches:
            ids += batch.column(0).to_pylist()
            digests += [hashlib.sha256((x or b"").lower()).digest() for x in batch.column(1).to_pylist()]
            if len(ids) >= SENDER_ROWS:
                yield from message(sender, part, ids, digests)
                part, ids, digests = part + 1, [], []
        if ids:
            yield from message(sender, part, ids, digests)

    return run


def _answer(messages: pd.DataFrame) -> pd.DataFrame:
    """Owner: a bitmap for every message, set where two messages have the fingerprint."""
    decoded = [golomb_decode(g, n) for g, n in zip(messages["gaps"], messages["n"])]
    every = np.concatenate(decoded)
    values, counts = np.unique(every, return_counts=True)
    twice = values[counts > 1]
    bitmaps = [np.packbits(np.isin(d, twice, assume_unique=True)).tobytes() for d in decoded]
    return pd.DataFrame(
        {"sender": messages["sender"], "part": messages["part"], "owner": messages["owner"], "bitmap": bitmaps}
    )


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sender: rows with their digest, and whether the row is a suspect."""
    for batch in batches:
        for m in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
            at = np.array(m["at"], np.int64)
            shared = np.unpackbits(np.frombuffer(m["bitmap"], np.uint8), count=m["n"])[at] == 1
            own = np.bincount(at, minlength=m["n"])[at] > 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(m["ids"], pa.int64()), pa.array(m["digests"], pa.binary()), pa.array(shared | own)],
                ["doc_id", "digest", "suspect"],
            )


def _normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, "_bytes"):
            texts = [(x or b"").lower() for x in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()),
                    pa.array(texts, pa.binary()),
                ],
                ["doc_id", "digest", "normal"],
            )


def exact_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: the row of its text that stays, the group's size, and the text's SHA-256.

    Texts are equal when their UTF-8 bytes are, after A-Z are lower-cased; null counts as empty.
    The largest id of a group stays (null ids stay only if there is no other). Rows that repeat
    an id count as rows of their own; of rows that agree in id and text one is kept, the others
    are not. An empty table gives an empty result, further columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("binary").alias("_bytes"))
    total = docs.count()
    bits = min(63, max(16, total.bit_length() + EXTRA_BITS))
    owners = max(shuffle_partitions(spark), -(-total // OWNER_ROWS))
    sent = cut_lineage(rows.mapInArrow(_send(owners, bits), _SENT), "fingerprints")
    bitmaps = (
        sent.select("sender", "part", "owner", "n", "gaps")
        .groupBy("owner")
        .applyInPandas(_answer, "sender long, part long, owner int, bitmap binary")
    )
    marked = (
        sent.select("sender", "part", "owner", "n", "ids", "digests", "at")
        .join(bitmaps, ["sender", "part", "owner"])
        .select("n", "ids", "digests", "at", "bitmap")
        .mapInArrow(_apply, "doc_id long, digest binary, suspect boolean")
    )
    marked = cut_lineage(marked, "marked")
    suspects = marked.filter("suspect").select("doc_id").distinct()
    groups = (
        rows.join(suspects, rows["doc_id"].eqNullSafe(suspects["doc_id"]), "left_semi")
        .mapInArrow(_normal, "doc_id long, digest binary, normal binary")
        .groupBy("digest", "normal")
        .agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .select("digest", "keep_id", "group_size")
    )
    first = F.row_number().over(W.partitionBy("text_sha256", "doc_id").orderBy("group_size")) == 1
    joined = marked.join(groups, "digest", "left").select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    single = joined.filter(~stays).withColumn("kept", F.lit(False))
    best = joined.filter(stays).withColumn("kept", first)
    return single.unionByName(best).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")

