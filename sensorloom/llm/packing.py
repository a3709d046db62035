"""Sequences of full windows by non-negative least squares over length combinations.

Every document is cut by one rule: whole windows of 4096 ids, then a body of whole blocks of 512
(1 to 7), then a remainder of 1 to 511. So there are 519 piece lengths at most, and only their
histogram reaches the driver, however large the corpus.

1. Remainders: all combinations of up to ``DEPTH`` lengths that fill a block of 512 exactly are
   enumerated, and non-negative least squares finds how often to repeat each so that the
   repeats use up the histogram. Repeats are rounded down, then up while pieces are left.
2. Bodies and filled blocks: the same with the combinations of 1 to 7 blocks that fill a window.
3. What rounding leaves over fills windows greedily: the longest pieces that fit, then parts of
   pieces that do not fit. Bodies are cut between blocks, remainders every ``GRAIN`` ids; the other
   part is a piece of its new length. So windows are full but for fewer than ``GRAIN`` ids, whatever
   lengths a corpus has, until the pieces run out. A composition is repeated while its lengths last.

The plan says which ranks of a length go to which place of which sequence. Spark ranks the
pieces (number within a scan task, plus a prefix sum over tasks) and looks the place up; ids
stay where they were encoded, only piece rows of a few numbers are shuffled. A row has the checksums
of its prefixes at the places where it may be cut, from which those of its parts follow.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from sensorloom.llm.text import pieces
from sensorloom.llm.tokens import END_ID, VOCABULARY, encoder
from sensorloom.scratch import cut_lineage

WINDOW = 4096
BLOCK = 512
DEPTH = 3
#: Remainders are cut at multiples of so many ids.
GRAIN = 16

_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, prefix_crcs binary, part int, number long"


def cuts(n: int, window: int = WINDOW, block: int = BLOCK) -> list[int]:
    """Lengths of a document's pieces in order."""
    whole, body = n // window * window, n % window // block * block
    return [window] * (whole // window) + [x for x in (body, n - whole - body) if x]


def combinations(lengths: range, total: int, depth: int) -> list[tuple[int, ...]]:
    """All multisets of up to ``depth`` lengths with this sum."""
    found = []
    for k in range(1, depth + 1):
        for head in combinations_with_replacement(lengths, k - 1):
            last = total - sum(head)
            if last in lengths and (not head or last >= head[-1]):
                found.append((*head, last))
    return found


def nnls(combos: list[tuple[int, ...]], histogram: dict[int, int], rounds: int = 400) -> np.ndarray:
    """Repeats x >= 0 of the combinations that minimise ``|A x - h|``: accelerated projected gradient."""
    size = max(max(c) for c in combos) + 1
    target = np.zeros(size)
    for length, count in histogram.items():
        target[length] = count
    column = np.repeat(np.arange(len(combos)), [len(c) for c in combos])
    row = np.array([length for c in combos for length in c])
    use = lambda x: np.bincount(row, x[column], size)
    back = lambda y: np.bincount(column, y[row], len(combos))
    v = np.ones(len(combos))
    for _ in range(30):
        v = back(use(v))
        norm = np.linalg.norm(v)
        v /= norm
    x = z = np.zeros(len(combos))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, z - back(use(z) - target) / (1.05 * norm))
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, x, t = new + (t - 1) / after * (new - x), new, after
    return x


def whole_repeats(combos: list[tuple[int, ...]], x: np.ndarray, histogram: Counter) -> list[tuple[tuple, int]]:
    """Round: down first, then up by falling fraction, while the histogram has the pieces. Takes them out."""
    uses = [Counter(c) for c in combos]
    repeats = np.zeros(len(combos), np.int64)

    def take(i: int, n: int) -> None:
        n = min([n, *(histogram[length] // k for length, k in uses[i].items())])
        if n > 0:
            repeats[i] += n
            for length, k in uses[i].items():
                histogram[length] -= n * k

    down = np.floor(x).astype(np.int64)
    for i in np.argsort(-down, kind="stable"):
        if down[i] == 0:
            break
        take(int(i), int(down[i]))
    for i in np.argsort(down - x, kind="stable"):
        if x[i] > 1e-9:
            take(int(i), 1)
    return [(combos[i], int(repeats[i])) for i in np.flatnonzero(repeats)]


def fill(histogram: Counter, window: int, block: int, grain: int = GRAIN) -> Iterator[tuple[list[tuple[int, int]], int]]:
    """Greedy windows from what is left: ``(length, part placed)`` of each piece, and how often to repeat that.

    Where a part is less than the length, the rest goes back to the histogram, which ends empty.
    """
    while sum(histogram.values()):
        room, used, window_of = window, Counter(), []
        for length in sorted((x for x, n in histogram.items() if n), reverse=True):
            n = min(room // length, histogram[length])
            window_of += [(length, length)] * n
            used[length] += n
            room -= n * length
        while room >= grain:
            steps = [(room - room % (block if x >= block else grain), -x) for x, n in histogram.items() if n > used[x] and x > room]
            part, length = max(steps, default=(0, 0))
            if not part:
                break
            window_of.append((-length, part))
            used[-length] += 1
            room -= part
        repeats = min(histogram[x] // n for x, n in used.items() if n)
        for length, part in window_of:
            histogram[length] -= repeats
            if part < length:
                histogram[length - part] += repeats
        yield window_of, repeats


class Plan:
    """Where the ranks of each length go. ``sequences`` counts the sequences."""

    def __init__(self, histogram: dict[int, int], window: int = WINDOW, block: int = BLOCK, depth: int = DEPTH):
        self.window, self.block = window, block
        left = Counter({length: n for length, n in histogram.items() if length != window})
        self._next: Counter = Counter()
        self._parts = Counter(histogram)  # ranks of the rests of cut pieces follow those of the given ones
        self.rows: dict[int, list[tuple]] = defaultdict(list)
        self.sequences = histogram.get(window, 0)
        if self.sequences:
            self.rows[window].append((0, 0, 0, 0, 0, 0))
        small = Counter({length: n for length, n in left.items() if length < block})
        blocks = 0
        if small:
            combos = combinations(range(1, block), block, depth)
            for combo, n in whole_repeats(combos, nnls(combos, small), small):
                self._put(combo, n, blocks, True)
                blocks += n
        units = Counter({length // block: n for length, n in left.items() if length >= block})
        of_block = units[1]  # bodies of one block have the first ranks among single blocks
        units[1] += blocks
        if sum(units.values()):
            per = window // block
            combos = combinations(range(1, per), per, per)
            for combo, n in whole_repeats(combos, nnls(combos, units), units):
                self._put([u * block for u in combo], n, self.sequences, False)
                self.sequences += n
        rest = Counter({u * block: n for u, n in units.items()})
        rest.update(small)
        self.bodies = of_block
        self._parts[block] += blocks
        for window_of, n in fill(rest, window, block):
            self._put_parts(window_of, n)
        self.tables = {length: np.array(rows, np.int64).T for length, rows in self.rows.items()}
    def _put(self, combo, n: int, target: int, in_block: bool) -> None:
        for slot, length in enumerate(combo):
            self.rows[length].append((self._next[length], target, slot, in_block, 0, 0))
            self._next[length] += n

    def _put_parts(self, window_of: list[tuple[int, int]], n: int) -> None:
        for slot, (length, part) in enumerate(window_of):
            cut, rest = (part, self._parts[length - part]) if part < length else (0, 0)
            self.rows[length].append((self._next[length], self.sequences, slot, 0, cut, rest))
            self._next[length] += n
            if cut:
                self._parts[length - part] += n
        self.sequences += n

    def places(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, ...]:
        """Parts of the pieces with these lengths and ranks: piece, start in it, length, sequence, order within it."""
        found = [np.zeros((5, 0), np.int64)]
        piece, begin = np.arange(len(ranks)), np.zeros(len(ranks), np.int64)
        lengths, ranks = lengths.astype(np.int64), ranks.astype(np.int64)
        while len(piece):
            rows = np.zeros((6, len(piece)), np.int64)
            for length in np.unique(lengths):
                mine = lengths == length
                table = self.tables[int(length)]
                rows[:, mine] = table[:, np.searchsorted(table[0], ranks[mine], "right") - 1]
            first, target, slot, inside, cut, rest = rows
            sequence, order = target + ranks - first, slot * self.window
            within = np.flatnonzero(inside)
            if len(within):  # the place of the filled block, then the slot in it
                table = self.tables[self.block]
                block = sequence[within] + self.bodies
                outer = table[:, np.searchsorted(table[0], block, "right") - 1]
                sequence[within], order[within] = outer[1] + block - outer[0], outer[2] * self.window + slot[within]
            part = np.where(cut > 0, cut, lengths)
            found.append(np.stack([piece, begin, part, sequence, order]))
            more = cut > 0
            ranks = (rest + ranks - first)[more]
            piece, begin, lengths = piece[more], (begin + part)[more], (lengths - part)[more]
        return tuple(np.concatenate(found, axis=1))


def part_crc(prefix_crcs: bytes, step: int, whole: int, length: int, begin: int, part: int) -> int:
    """Checksum of ids ``begin:begin + part`` of a piece from those of its prefixes.

    The checksum of two runs is that of the first, moved on by the second's bytes, xor that of the second.
    """
    of = np.frombuffer(prefix_crcs, "<u4")
    end = begin + part
    upto = whole if end == length else int(of[end // step - 1])
    if not begin:
        return upto
    zeros = bytes(4 * part)
    return upto ^ zlib.crc32(zeros, int(of[begin // step - 1])) ^ zlib.crc32(zeros)


def _step(length: int, block: int) -> int:
    return block if length >= block else GRAIN


def _cut(vocabulary: str, window: int, block: int):
    """Task: texts to pieces, each numbered within its length and this task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokens, part = encoder(vocabulary), TaskContext.get().partitionId()
        seen: Counter = Counter()
        for batch in batches:
            for some in pieces(batch, "text"):
                docs, starts, lengths, crcs, totals, prefixes, numbers = [], [], [], [], [], [], []
                for doc, ids in zip(some.column(0).to_pylist(), tokens.encode(some.column(1).to_pylist())):
                    ids = np.append(ids.astype("<u4"), np.uint32(END_ID))
                    start = 0
                    for length in cuts(len(ids), window, block):
                        docs.append(doc)
                        starts.append(start)
                        lengths.append(length)
                        run, crc = ids[start : start + length].tobytes(), 0
                        step, steps = 4 * _step(length, block), []
                        for at in range(0, len(run) if length < window else 0, step):
                            crc = zlib.crc32(run[at : at + step], crc)
                            steps.append(crc)
                        crcs.append(crc if steps else zlib.crc32(run))
                        prefixes.append(np.array(steps[:-1], "<u4").tobytes())
                        totals.append(len(ids))
                        numbers.append(seen[length])
                        seen[length] += 1
                        start += length
                longs = [pa.array(x, pa.int64()) for x in (docs, starts, lengths, crcs, totals)]
                yield pa.RecordBatch.from_arrays(
                    [*longs, pa.array(prefixes, pa.binary()), pa.array([part] * len(docs), pa.int32()), pa.array(numbers, pa.int64())],
                    ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "prefix_crcs", "part", "number"],
                )

    return run


def pack(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    vocabulary: str = VOCABULARY,
    window: int = WINDOW,
    block: int = BLOCK,
    depth: int = DEPTH,
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    Every text's ids and the end id lie in exactly one piece each; null text is empty, so its one
    piece is the end id. Null ids and rows that repeat an id are packed like any other row. An
    empty table gives an empty result. ``window`` must be a multiple of ``block``.
    """
    if window % block:
        raise ValueError("window must be a multiple of block")
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    cut = cut_lineage(source.mapInArrow(_cut(vocabulary, window, block), _PIECES), "pieces")
    counts = cut_lineage(cut.groupBy("length", "part").agg(F.count("*").alias("n")), "lengths")
    plan = Plan({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, window, block, depth)
    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    bases = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "order"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("length").to_numpy()
            piece, begin, part, sequence, order = plan.places(lengths, batch.column("rank").to_numpy())
            crcs = batch.column("ids_crc32").to_numpy()[piece]
            cut = np.flatnonzero(part < lengths[piece])
            prefixes = batch.column("prefix_crcs")
            for i in cut.tolist():
                of, length = int(piece[i]), int(lengths[piece[i]])
                known = prefixes[of].as_py(), _step(length, block), int(batch.column("ids_crc32")[of].as_py()), length
                crcs[i] = part_crc(*known, int(begin[i]), int(part[i]))
            start = batch.column("start").to_numpy()[piece] + begin
            doc, total = (batch.column(c).take(pa.array(piece)) for c in ("doc_id", "doc_tokens"))
            columns = [doc, pa.array(start), pa.array(part), pa.array(crcs), total, pa.array(sequence), pa.array(order)]
            yield pa.RecordBatch.from_arrays(columns, names)

    placed = (
        cut.join(bases, ["length", "part"])
        .select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "prefix_crcs", (F.col("base") + F.col("number")).alias("rank"))
        .mapInArrow(place, ", ".join(f"{n} long" for n in names))
    )
    earlier = W.partitionBy("sequence_id").orderBy("order").rowsBetween(W.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(earlier), F.lit(0))).drop("order")
