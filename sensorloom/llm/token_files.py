"""Token ids as flat binary files with 64-bit document offsets.

Documents are encoded where they are scanned; only ids move, to ranges of the document id.
A task sorts its range and streams it to ``ids-<range>.bin`` (little-endian unsigned ids) and
``docs-<range>.bin`` (pairs of document id and end position within the file, 64-bit). A file is
written under a name of its own and moved into place when it is whole, so a task that is tried
again leaves one file. The prefix sum of the ranges' token counts gives each file its base.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from sensorloom.llm.common import shuffle_partitions
from sensorloom.llm.text import pieces
from sensorloom.llm.tokens import END_ID, VOCABULARY, encoder
from sensorloom.scratch import cut_lineage, scratch_path

#: Rows of one range at most, on average.
RANGE_ROWS = 1_000_000

_DOC = np.dtype([("doc_id", "<i8"), ("null", "<i8"), ("end", "<u8")])


def _filesystem(uri: str):
    """Filesystem and path of a folder that all executors reach, such as file:/ or hdfs:/."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _encode(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(vocabulary)
        end = np.array([END_ID], tokens.dtype).tobytes()
        for batch in batches:
            for part in pieces(batch, "text"):
                ids = [x.tobytes() + end for x in tokens.encode(part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return run


def _write(folder: str, width: int):
    """Task: rows sorted by range and document id to the ranges' files; a row for each range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _filesystem(folder)
        now, out = None, None

        def close() -> pa.RecordBatch:
            data, docs = out["data"], out["docs"]
            data.close(), docs.close()
            for kind in ("ids", "docs"):
                files.move(f"{root}/{kind}-{now:06d}.{out['own']}", f"{root}/{kind}-{now:06d}.bin")
            return pa.RecordBatch.from_arrays(
                [pa.array([now], pa.int32()), pa.array([out["n"]], pa.int64()), pa.array([out["end"]], pa.int64())],
                ["range", "docs", "tokens"],
            )

        for batch in batches:
            for r, doc, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if r != now:
                    if now is not None:
                        yield close()
                    now, own = r, uuid.uuid4().hex
                    out = {"own": own, "n": 0, "end": 0}
                    out["data"] = files.open_output_stream(f"{root}/ids-{r:06d}.{own}")
                    out["docs"] = files.open_output_stream(f"{root}/docs-{r:06d}.{own}")
                out["data"].write(ids)
                out["n"], out["end"] = out["n"] + 1, out["end"] + len(ids) // width
                out["docs"].write(np.array([(doc or 0, doc is None, out["end"])], _DOC).tobytes())
        if now is not None:
            yield close()

    return run


def write_tokens(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", vocabulary: str = VOCABULARY
) -> tuple[str, DataFrame]:
    """Write all documents in ascending id order; the folder and a row ``(range, docs, tokens, base)`` for each file.

    Every text is encoded whole and followed by the end id; null text is empty. Null ids come
    first; rows that repeat an id stay, ordered by their tokens. An empty table writes no file.
    """
    spark = docs.sparkSession
    folder = scratch_path(spark, "tokens")
    files, root = _filesystem(folder)
    files.create_dir(root, recursive=True)
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    ranges = max(3 * shuffle_partitions(spark), -(-source.count() // RANGE_ROWS))
    cuts = source.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 100 * ranges)).first()[0]
    cuts = np.unique(np.array(cuts or [], np.int64))
    width = encoder(vocabulary).dtype.itemsize
    number = F.lit(0)
    if len(cuts):
        number = F.coalesce(_range_of(F.col("doc_id"), cuts.tolist()), F.lit(0))
    written = (
        source.mapInArrow(_encode(vocabulary), "doc_id long, ids binary")
        .select(number.cast("int").alias("range"), "doc_id", "ids")
        .repartition(shuffle_partitions(spark), "range")
        .sortWithinPartitions("range", "doc_id", "ids")
        .mapInArrow(_write(folder, width), "range int, docs long, tokens long")
    )
    parts = cut_lineage(written, "token-files")
    before = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    return folder, parts.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0).cast("long")))


def _range_of(value, cuts: list[int]):
    """Number of cuts up to a value, by halving."""
    if not cuts:
        return F.lit(0)
    mid = len(cuts) // 2
    left, right = _range_of(value, cuts[:mid]), _range_of(value, cuts[mid + 1 :]) + F.lit(mid + 1)
    return F.when(value.isNull(), F.lit(0)).when(value >= cuts[mid], right).otherwise(left)


def read_tokens(folder: str, parts: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Read the files back, memory-mapped where the folder is local: one row per document."""
    dtype = encoder(vocabulary).dtype.str

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, root = _filesystem(folder)

        def load(name: str, kind: np.dtype) -> np.ndarray:
            if isinstance(files, fs.LocalFileSystem):
                return np.memmap(f"{root}/{name}", kind, "r")
            with files.open_input_file(f"{root}/{name}") as f:
                return np.frombuffer(f.read_buffer(), kind)

        for batch in batches:
            for part in batch.to_pylist():
                docs, ids = load(f"docs-{part['range']:06d}.bin", _DOC), load(f"ids-{part['range']:06d}.bin", np.dtype(dtype))
                for at in range(0, len(docs), 10_000):
                    rows = docs[at : at + 10_000]
                    ends = rows["end"].astype(np.int64)
                    starts = np.concatenate([[docs["end"][at - 1] if at else 0], ends[:-1]]).astype(np.int64)
                    crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(starts, ends)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(rows["doc_id"].copy(), pa.int64(), mask=rows["null"] == 1),
                            pa.array(starts + part["base"], pa.int64()),
                            pa.array(ends - starts, pa.int64()),
                            pa.array(crc, pa.int64()),
                        ],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    n = shuffle_partitions(parts.sparkSession)
    return (
        parts.select("range", "base")
        .repartition(n, "range")
        .mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
    )
