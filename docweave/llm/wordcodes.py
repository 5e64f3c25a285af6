"""A bounded cache from white-space separated words to their token ids.

Where no token reaches across the end of a word (or of a run of white space with its word), the ids of
a text are those of its words in order, and each distinct word needs encoding once.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import repeat

import numpy as np

#: Marks that are a token run of their own after a letter or digit (an apostrophe may begin a contraction).
ENDINGS = b'!"#$%&()*+,-./:;<=>?@[]^_`{|}~' + bytes([92])
_ENDS = frozenset(ENDINGS)
_PLAIN = frozenset(b for b in range(128) if chr(b).isalnum())
#: Second bytes of UTF-8 after 0xC3 that make no letter.
_NO_LETTER = frozenset(b"\x97\xb7")


def ending(word: bytes) -> int:
    """Where the marks begin that end the word, if they follow a plain letter or digit; else 0."""
    if word[-1] not in _ENDS:
        return 0
    base = word.rstrip(ENDINGS)
    n = len(base)
    if not n:
        return 0
    plain = base[-1] in _PLAIN or n > 1 and base[-2] == 0xC3 and base[-1] not in _NO_LETTER
    return n if plain else 0


class WordCodes:
    """``encode`` takes a list of distinct words and returns their ids end to end and the number of ids of each.

    ``split_endings`` says that the ENDINGS after a letter or digit get their ids by themselves.
    """

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], split_endings: bool = False, max_words: int = 700_000, max_bytes: int = 16_000_000):
        self.encode, self.split_endings, self.max_words, self.max_bytes = encode, split_endings, max_words, max_bytes
        self._clear()

    def _clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.bytes = self.used = self.rows = 0
        self.flat = np.empty(1 << 16, dtype=np.int32)
        self.start = np.zeros(1 << 14, dtype=np.int64)
        self.length = np.zeros(1 << 14, dtype=np.int64)

    def _room(self, rows: int, ids: int) -> None:
        while self.rows + rows > len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
            self.length = np.concatenate([self.length, np.zeros_like(self.length)])
        while self.used + ids > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])

    def _add(self, words: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> None:
        n = self.rows
        self._room(len(words), len(ids))
        self.flat[self.used : self.used + len(ids)] = ids
        self.length[n : n + len(words)] = sizes
        self.start[n : n + len(words)] = self.used + np.cumsum(sizes) - sizes
        self.used += len(ids)
        self.rows += len(words)
        self.bytes += sum(map(len, words))
        self.index.update(zip(words, range(n, n + len(words))))

    def _learn(self, words: list[bytes]) -> None:
        """``words``: distinct, none in the cache."""
        ended = [(w[:n], w[n:], w) for w in words if (n := ending(w))] if self.split_endings else []
        if not ended:
            self._add(words, *self.encode(words))
            return
        whole = set(words).difference(w for _, _, w in ended)
        whole.update(base for base, _, _ in ended)
        whole.update(marks for _, marks, _ in ended)
        fresh = [w for w in whole if w not in self.index]
        if fresh:
            self._add(fresh, *self.encode(fresh))
        two = np.fromiter((self.index[p] for *parts, _ in ended for p in parts), dtype=np.int64, count=2 * len(ended))
        ids, sizes = self.ids(two)
        self._add([w for _, _, w in ended], ids, sizes.reshape(-1, 2).sum(1))

    def codes(self, words: list[bytes]) -> np.ndarray:
        """The cache rows of ``words``; equal words have equal rows until the next call."""
        if len(self.index) > self.max_words or self.bytes > self.max_bytes:
            self._clear()
        out = np.fromiter(map(self.index.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        at = np.flatnonzero(out < 0)
        if len(at):
            missing = [words[i] for i in at.tolist()]
            self._learn(list(dict.fromkeys(missing)))
            out[at] = np.fromiter(map(self.index.__getitem__, missing), dtype=np.int64, count=len(missing))
        return out

    def ids(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of the coded words, end to end, and the number of ids of each word."""
        sizes = self.length[codes]
        before = np.cumsum(sizes) - sizes
        at = np.repeat(self.start[codes] - before, sizes) + np.arange(int(sizes.sum()))
        return self.flat[at], sizes
