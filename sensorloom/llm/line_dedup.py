"""Repeated runs of words across and within documents, found by winnowing line hashes.

Passages are pasted into the middle of lines, so a line here is a rolling line: any ``LINE``
consecutive words. A window is any ``MIN_RUN`` words; its fingerprint is the least line hash in
it, the leftmost of equal ones, so equal windows have one fingerprint at one offset. Consecutive
windows with one fingerprint form a span, about 2 spans for every 36 words, and only spans are
shuffled:

1. Scan tasks emit a row per span: fingerprint, hash of the span's words, place. Of the spans that
   agree within a task, all but the first are known to be repeats there and then, so a passage
   that a third of the documents share leaves a row per task, not per document.
2. Positions are joined by fingerprint. A span whose words all occur in an earlier document is
   a repeat as a whole. Where spans share a fingerprint but differ, runs begin or end inside:
   the first span of each wording is requested.
3. Requested spans are extended both ways window by window: their windows' hashes are compared,
   and those with an earlier occurrence that does not overlap them are repeats.
4. Each document's repeats are checked against its words, united, and cut out.

So exactly those words go that lie in a window of ``MIN_RUN`` words which occurs earlier, in
order of document id and position.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from sensorloom.llm.common import shuffle_partitions
from sensorloom.llm.text import SPACE, Words, pieces, span_hashes
from sensorloom.scratch import cut_lineage

MIN_RUN = 50
#: Longer lines are less often common phrases, whose spans meet for nothing; shorter ones give fewer spans.
LINE = 16

_LINES = MIN_RUN - LINE + 1  # lines in a window
_NULL_ID = -(1 << 63)
_AT = 64  # a place is packed as start * _AT + windows
_CHUNK = 1 << 22
_POSITION_BITS = 24
_SPAN = "fingerprint long, words long, doc long, at long, again boolean"


def _chosen(lines: np.ndarray) -> np.ndarray:
    """Place of each window's least line, the leftmost of equal ones.

    A place within a stretch of lines has ``_POSITION_BITS``; stretches overlap, so each window lies whole in one.
    """
    size, out = 1 << _POSITION_BITS, []
    mask = np.uint64(size - 1)
    for begin in range(0, len(lines) - _LINES + 1, size - _LINES + 1):
        part = lines[begin : begin + size]
        least = (part & ~mask) | np.arange(len(part), dtype=np.uint64)  # so that of equal hashes the leftmost is less
        width = 1
        while 2 * width <= _LINES:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        rest = _LINES - width
        least = np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
        out.append((least & mask).astype(np.int64) + begin)
    return np.concatenate(out)


def spans(w: Words) -> tuple[np.ndarray, ...]:
    """Spans of all texts: fingerprint, hash of the words, text number, start in the text, windows."""
    n = len(w.hashes)
    if n < MIN_RUN:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    at = np.arange(n - LINE + 1)
    lines = span_hashes(w.hashes, at, at + LINE)
    chosen = _chosen(lines)
    of = np.repeat(np.arange(len(w.bounds) - 1), np.diff(w.bounds))[: len(chosen)]
    start = np.flatnonzero(np.arange(len(chosen)) + MIN_RUN <= w.bounds[of + 1])
    if not len(start):
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    chosen, of = chosen[start], of[start]
    first = np.flatnonzero(np.concatenate(([True], (chosen[1:] != chosen[:-1]) | (of[1:] != of[:-1]))))
    windows = np.diff(np.append(first, len(start)))
    begin, of = start[first], of[first]
    words = span_hashes(w.hashes, begin, begin + windows + MIN_RUN - 1)
    return lines[chosen[first]].astype(np.int64), words.astype(np.int64), of, begin - w.bounds[of], windows


def _decided(order: np.ndarray, keys: list[np.ndarray], doc: np.ndarray) -> np.ndarray:
    """Rows, sorted by ``order``, whose first row of the same keys is in an earlier document."""
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    first = np.flatnonzero(new)
    leader = np.repeat(doc[order][first], np.diff(np.append(first, len(order))))
    out = np.zeros(len(order), bool)
    out[order] = doc[order] > leader
    return out


def _emit_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, "text", _CHUNK):
            print_, words, of, start, windows = spans(Words(part.column(1).to_pylist(), SPACE, lower=False))
            doc = part.column(0).to_numpy()[of] if len(of) else of
            at = start * _AT + windows
            again = _decided(np.lexsort((at, doc, words, print_)), [print_, words], doc)
            arrays = [pa.array(x, pa.int64()) for x in (print_, words, doc, at)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(again)], ["fingerprint", "words", "doc", "at", "again"])


def _emit_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task: requested spans to their windows; a window that a task meets again in a later document is decided."""
    names = ["words", "doc", "at", "again"]
    for batch in batches:
        for part in pieces(batch, "__text", _CHUNK):
            w = Words(part.column("__text").to_pylist(), SPACE, lower=False)
            docs = part.column("__doc").to_numpy()
            of, at, want = _listed(part.column("__spans"))
            start, windows = at // _AT, at % _AT
            ok = _same_words(w, of, start, windows, want)
            of, start, windows = of[ok], start[ok], windows[ok]
            own = np.repeat(np.arange(len(of)), windows)
            first = start[own] + np.arange(len(own)) - np.repeat(np.cumsum(windows) - windows, windows)
            begin = w.bounds[of[own]] + first
            words = span_hashes(w.hashes, begin, begin + MIN_RUN).astype(np.int64)
            doc, place = docs[of[own]], first * _AT + 1
            again = _decided(np.lexsort((place, doc, words)), [words], doc)
            arrays = [pa.array(words, pa.int64()), pa.array(doc, pa.int64()), pa.array(place, pa.int64()), pa.array(again)]
            yield pa.RecordBatch.from_arrays(arrays, names)


def _listed(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, places and word hashes of lists of spans, one after the other."""
    sizes = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), np.int64)
    flat = lists.flatten()
    of = np.repeat(np.arange(len(lists)), sizes)
    return of, np.asarray(flat.field("at"), np.int64), np.asarray(flat.field("words"), np.int64)


def _same_words(w: Words, of, start, windows, want) -> np.ndarray:
    """Spans that lie in their text and have the words they should have."""
    size = np.diff(w.bounds)[of] if len(of) else of
    inside = start + windows + MIN_RUN - 1 <= size
    begin = np.where(inside, w.bounds[of] + start, 0) if len(of) else of
    end = np.where(inside, begin + windows + MIN_RUN - 1, 0)
    return inside & (span_hashes(w.hashes, begin, end).astype(np.int64) == want) if len(of) else np.zeros(0, bool)


def _without(data: bytes, starts: np.ndarray, ends: np.ndarray, runs: list[tuple[int, int]]) -> bytes:
    """The text without these runs of words; of the white space around a run one side stays, a line end first."""
    out, at = [], 0
    for a, b in runs:
        before = data[ends[a - 1] if a else 0 : starts[a]]
        after = data[ends[b - 1] : starts[b] if b < len(starts) else len(data)]
        out.append(data[at : ends[a - 1]] if a else b"")
        if a and b < len(starts):
            out.append(after if b"\n" in after and b"\n" not in before else before)
        at = starts[b] if b < len(starts) else len(data)
    return b"".join([*out, data[at:]])


def _cut(columns: list[str], text: str):
    """Task: rows with their repeats to rows with the text that is left, its words and the runs that went."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "__text", _CHUNK):
                texts = part.column(text).to_pylist()
                w = Words(texts, SPACE, lower=False)
                of, at, want = _listed(part.column("__spans"))
                start, windows = at // _AT, at % _AT
                ok = _same_words(w, of, start, windows, want)
                cover = np.zeros(len(w.hashes) + 1, np.int64)
                np.add.at(cover, w.bounds[of[ok]] + start[ok], 1)
                np.add.at(cover, w.bounds[of[ok]] + start[ok] + windows[ok] + MIN_RUN - 1, -1)
                gone = np.cumsum(cover)[:-1] > 0
                removed, runs = [], []
                for i, (a, b) in enumerate(zip(w.bounds[:-1], w.bounds[1:])):
                    edge = np.flatnonzero(np.diff(np.concatenate(([False], gone[a:b], [False])).astype(np.int8)))
                    mine = list(zip(edge[0::2].tolist(), edge[1::2].tolist()))
                    if mine:
                        raw, base = w.data[w.first[i] : w.first[i + 1] - 1], w.first[i]
                        texts[i] = _without(raw, w.starts[a:b] - base, w.ends[a:b] - base, mine).decode("utf-8", "surrogatepass")
                    removed.append(sum(y - x for x, y in mine))
                    runs.append(len(mine))
                kept = [pa.array(texts, part.column(c).type) if c == text else part.column(c) for c in columns]
                sizes = [pa.array(x, pa.int64()) for x in (np.diff(w.bounds), removed, runs)]
                yield pa.RecordBatch.from_arrays([*kept, *sizes], [*columns, "__words", "__removed", "__runs"])

    return run


def _later(first_doc: Column, first_at: Column) -> Column:
    """Whether a window comes after, and does not overlap, the first place it has."""
    return (F.col("doc") > first_doc) | (F.floor(F.col("at") / _AT) >= F.floor(first_at / _AT) + MIN_RUN)


def cut_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with its repeated runs cut out of the text, and ``__words, __removed, __runs``.

    ``__words`` counts a text's words before, ``__removed`` those cut out in ``__runs`` runs. Words are
    split at ASCII white space and compared as they are. All columns of ``docs`` stay. Null texts
    stay null. A null id comes before all others. Rows that agree in id and text are one document
    and get the same text; of rows that agree only in id each is cut by its own words. A text
    that is repeated as a whole becomes empty. An empty table gives an empty result.
    """
    key = F.coalesce(F.col(id_column).cast("long"), F.lit(_NULL_ID))
    source = docs.withColumns({"__doc": key, "__text": F.coalesce(F.col(text_column), F.lit(""))})
    found = source.select(F.col("__doc").alias("doc"), F.col("__text").alias("text"))
    found = cut_lineage(found.mapInArrow(_emit_spans, _SPAN), "spans")

    wording = W.partitionBy("fingerprint", "words").orderBy("doc", "at")
    same = W.partitionBy("fingerprint")
    joined = found.filter("NOT again").select("fingerprint", "words", "doc", "at")
    joined = joined.repartition(shuffle_partitions(docs.sparkSession), "fingerprint")
    joined = joined.withColumn("first_doc", F.first("doc").over(wording)).withColumn("nth", F.row_number().over(wording))
    inside = (F.col("nth") > 1) & (F.col("doc") == F.col("first_doc"))
    mixed = (F.min("words").over(same) != F.max("words").over(same)) | F.max(inside).over(same)
    joined = joined.withColumn("mixed", mixed).filter("mixed OR nth > 1")
    joined = cut_lineage(joined.select("words", "doc", "at", (F.col("doc") > F.col("first_doc")).alias("again")), "places")

    def listed(spans_: DataFrame) -> DataFrame:
        return spans_.groupBy(F.col("doc").alias("__key")).agg(F.collect_list(F.struct("at", "words")).alias("__spans"))

    asked = listed(joined.filter("NOT again"))
    windows = source.join(asked, source["__doc"] == asked["__key"]).mapInArrow(
        _emit_windows, "words long, doc long, at long, again boolean"
    )
    windows = cut_lineage(windows, "windows")
    place = W.partitionBy("words").orderBy("doc", "at")
    extended = windows.filter("NOT again").select("words", "doc", "at")
    extended = extended.withColumns({"first_doc": F.first("doc").over(place), "first_at": F.first("at").over(place)})
    extended = extended.filter(_later(F.col("first_doc"), F.col("first_at")))

    columns = ["words", "doc", "at"]
    repeats = listed(
        found.filter("again")
        .select(*columns)
        .union(joined.filter("again").select(*columns))
        .union(windows.filter("again").select(*columns))
        .union(extended.select(*columns))
    )
    fields = [*docs.schema.fields, *[T.StructField(c, T.LongType()) for c in ("__words", "__removed", "__runs")]]
    return (
        source.join(repeats, source["__doc"] == repeats["__key"], "left")
        .drop("__key", "__doc")
        .mapInArrow(_cut(docs.columns, text_column), T.StructType(fields))
    )


def without_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with repeated runs cut out, without the documents of which nothing is left.

    A column ``n_chars`` is counted anew where the text changed.
    """
    cut = cut_repeats(docs, id_column, text_column)
    cut = cut.filter((F.col("__words") == 0) | (F.col("__removed") < F.col("__words")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        cut = cut.withColumn("n_chars", F.when(F.col("__removed") > 0, F.length(text_column).cast(kind)).otherwise(F.col("n_chars")))
    return cut.select(*docs.columns)
