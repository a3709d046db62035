"""Token ids of whole texts with a public tokenizer, each distinct word encoded once.

The vocabulary named by default lower-cases, drops white space and then works word by word,
so a text's ids are its words' ids one after the other. Texts of ``_PLAIN`` characters are cut
into words as byte runs, and the tokenizer's model encodes each word that the worker has not
met yet. Any other text (other scripts, combining marks, apostrophes, special-token strings)
goes through the tokenizer whole, as do all texts with another vocabulary.
"""

from __future__ import annotations

import os
import re
from collections.abc import Sequence

import numpy as np

from sensorloom.llm.text import ALONE, Words, byte_classes

VOCABULARY = "word_bpe_49k.json"
END_ID = 2

# Characters that stay one letter, digit, mark or blank each when lower-cased and composed.
_PLAIN = re.compile(r"[\t\n\r -&(-~À-ÖØ-öø-įĲ-ňŊ-ž]*")
_SPECIAL = re.compile(r"<\|(?:start|end)oftext\|>", re.IGNORECASE)
_CLASSES = byte_classes(b"abcdefghijklmnopqrstuvwxyz", rest=2)
_CLASSES[list(b"0123456789")] = ALONE
_CLASSES[list(b"\t\n\r ")] = 0
#: Words that a worker remembers; beyond that it starts afresh.
CACHE_WORDS = 2_000_000

_encoders: dict[str, Encoder] = {}


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(name: str = VOCABULARY) -> Encoder:
    """This worker's encoder for a vocabulary file."""
    if name not in _encoders:
        _encoders[name] = Encoder(name)
    return _encoders[name]


class Encoder:
    """Ids of texts as unsigned 16-bit or 32-bit integers, whichever holds the vocabulary."""

    def __init__(self, name: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(vocabulary_path(name))
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.by_word = name == VOCABULARY
        self.as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.starts, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool, self.used = np.zeros(1 << 16, self.dtype), 0

    def _word(self, word: str) -> list[int]:
        if not word.isascii():
            word = self.as_bytes.pre_tokenize_str(word)[0][0]
        return [t.id for t in self.tokenizer.model.tokenize(word)]

    def _learn(self, keys: np.ndarray, found: list[list[int]]) -> None:
        """Add new words, given by their sorted hashes and ids."""
        flat = np.fromiter((i for ids in found for i in ids), self.dtype)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        if self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(self.used + 2 * len(flat), self.dtype)])
        self.pool[self.used : self.used + len(flat)] = flat
        starts = self.used + np.cumsum(sizes) - sizes
        self.used += len(flat)
        at = np.searchsorted(self.keys, keys)
        self.starts, self.sizes = np.insert(self.starts, at, starts), np.insert(self.sizes, at, sizes)
        self.keys = np.insert(self.keys, at, keys)

    def _plain(self, texts: Sequence[str]) -> list[np.ndarray]:
        w = Words(texts, _CLASSES)
        keys, first, of = np.unique(w.hashes, return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > CACHE_WORDS:
            self._forget()
        at = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), bool)
        new[at < len(self.keys)] = self.keys[at[at < len(self.keys)]] != keys[at < len(self.keys)]
        spans = zip(w.starts[first[new]].tolist(), w.ends[first[new]].tolist())
        self._learn(keys[new], [self._word(w.data[a:b].decode()) for a, b in spans])
        at = np.searchsorted(self.keys, keys)[of]
        sizes = self.sizes[at]
        before = np.zeros(len(at) + 1, np.int64)
        np.cumsum(sizes, out=before[1:])
        ids = self.pool[np.arange(before[-1]) + np.repeat(self.starts[at] - before[:-1], sizes)]
        cuts = before[w.bounds]
        return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:])]

    def encode(self, texts: Sequence[str | None]) -> list[np.ndarray]:
        out: list = [None] * len(texts)
        plain = []
        for i, text in enumerate(texts):
            text = text or ""
            if self.by_word and _PLAIN.fullmatch(text) and not ("<|" in text and _SPECIAL.search(text)):
                plain.append(i)
            else:
                out[i] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype)
        for i, ids in zip(plain, self._plain([texts[i] or "" for i in plain]) if plain else ()):
            out[i] = ids
        return out
