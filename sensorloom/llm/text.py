"""Words and runs of words as 64-bit hashes, computed on whole byte buffers with numpy.

A table gives each byte a class: 0 separates, runs of one class are words, and each byte of
class ``ALONE`` is a word by itself. ``SPACE`` separates at ASCII white space, ``MARKS`` at
every ASCII byte that is no letter, digit or underscore; bytes of non-ASCII characters belong
to words in both. Null counts as empty.
Long texts are read in pieces that end at a separator, so memory does not follow the length
of a text but the length of its longest word.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_PIECE = 1 << 20

ALONE = 255


def byte_classes(*groups: bytes, rest: int = 0, high: int = 1) -> np.ndarray:
    """Class table: group ``i`` has class ``i + 1``, other ASCII bytes ``rest``, the others ``high``."""
    table = np.full(256, rest, np.uint8)
    table[128:] = high
    for i, group in enumerate(groups):
        table[list(group)] = i + 1
    return table


SPACE = byte_classes(rest=1)
SPACE[list(b"\t\n\x0b\x0c\r ")] = 0
MARKS = byte_classes(b"0123456789_ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")

_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    table = _powers.get(base)
    if table is None or len(table) < n:
        table = np.full(max(n, _PIECE + 4096), base, np.uint64)
        table[0] = 1
        table = np.cumprod(table, dtype=np.uint64)
        _powers[base] = table
    return table[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes (a bijection)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of ``values[start:end]`` for each pair; equal spans have equal hashes wherever they stand."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _power_table(_BASE, len(values)), out=sums[1:])
    lengths = (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return mix((sums[ends] - sums[starts]) * _power_table(_INVERSE, len(values) + 1)[starts] + lengths)


class Words:
    """Words of a list of texts.

    Text ``i`` has the words ``bounds[i]:bounds[i+1]``; ``starts`` and ``ends`` are positions in
    ``data``, the UTF-8 bytes of all texts, where text ``i`` starts at ``first[i]``.
    """

    def __init__(self, texts: Iterable[str | None], classes: np.ndarray, lower: bool = True):
        parts = [((t or "").lower() if lower else (t or "")).encode("utf-8", "surrogatepass") for t in texts]
        self.first = np.zeros(len(parts) + 1, np.int64)
        np.cumsum([len(p) + 1 for p in parts], out=self.first[1:])
        self.data = b"\n".join([*parts, b""])
        data = np.frombuffer(self.data, np.uint8)
        kind = classes[data]
        edge = np.empty(len(kind) + 1, bool)
        edge[:1], edge[-1:] = True, True
        edge[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == ALONE)
        at = np.flatnonzero(edge)
        words = kind[at[:-1]] != 0 if len(data) else np.zeros(0, bool)
        self.starts, self.ends = at[:-1][words], at[1:][words]
        self.hashes = np.empty(len(self.starts), np.uint64)
        at = 0
        while at < len(self.starts):
            stop = max(int(np.searchsorted(self.ends, self.starts[at] + _PIECE, "right")), at + 1)
            lo, hi = self.starts[at], self.ends[stop - 1]
            part = data[lo:hi].astype(np.uint64) + np.uint64(1)
            self.hashes[at:stop] = span_hashes(part, self.starts[at:stop] - lo, self.ends[at:stop] - lo)
            at = stop
        self.bounds = np.searchsorted(self.starts, self.first)


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words of one text, in order; one run of all words if there are fewer."""
    if not len(hashes):
        return hashes
    at = np.arange(max(1, len(hashes) - n + 1))
    return span_hashes(hashes, at, np.minimum(at + n, len(hashes)))


def pieces(batch, texts: str, limit: int = 4 << 20) -> Iterator:
    """Slices of an Arrow batch with about ``limit`` bytes of text each, one row at least."""
    import pyarrow.compute as pc

    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(texts)), 0).to_numpy(zero_copy_only=False), np.int64)
    piece = np.cumsum(sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows]
    for lo, hi in zip(cuts, cuts[1:]):
        if hi > lo:
            yield batch.slice(lo, hi - lo)
