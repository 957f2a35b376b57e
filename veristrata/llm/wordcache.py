"""Encodes whole texts word by word with a bounded cache, exactly as one pass over the text would.

Both byte-level vocabularies split a text by the same kind of pattern, in which a blank may only
open a match. A single blank between two characters that are not white space therefore always
opens a match, so the text may be cut there and each part encoded alone. Runs of white space are
never cut. The cache maps a part to its ids in two generations of about ``limit`` parts: a full one
ages, and parts that are met again move on from the older one before it is dropped.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np

_CUT = re.compile(r"(?<=\S) (?=\S)")


def split_pieces(pattern, parts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The matches of ``pattern`` in each part: the distinct ones, which of them follow each other over
    all parts, and how many each part has."""
    number: dict[str, int] = {}
    counts = np.zeros(len(parts), np.int64)
    # a line feed between two parts without inner white space is always a match of its own
    plain = [i for i, p in enumerate(parts) if len(w := p.split()) == 1 and len(p) - len(w[0]) <= (p[0] == " ")]
    at = np.zeros(0, np.int64)
    if plain:
        at = np.array([number.setdefault(p, len(number)) for p in pattern.findall("\n".join([parts[i] for i in plain]))], np.int64)
        cuts = np.flatnonzero(at == number.get("\n", -1))
        counts[plain] = np.diff(np.concatenate([[-1], cuts, [len(at)]])) - 1
        at = np.delete(at, cuts)
    others = sorted(set(range(len(parts))).difference(plain))
    rest: list[int] = []
    for i in others:
        found = pattern.findall(parts[i])
        counts[i] = len(found)
        rest += [number.setdefault(p, len(number)) for p in found]
    if others:  # back into the order of the parts
        at = np.concatenate([at, np.array(rest, np.int64)])
        first = np.zeros(len(parts), np.int64)
        both = [*plain, *others]
        first[both] = np.cumsum(counts[both]) - counts[both]
        ends = np.cumsum(counts)
        at = at[np.repeat(first - (ends - counts), counts) + np.arange(int(counts.sum()))]
    return list(number), at, counts


def gather(flat: np.ndarray, lens: np.ndarray, at: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all parts, and ids per part: piece ``k`` has ``lens[k]`` ids in ``flat``."""
    starts = np.cumsum(lens) - lens
    n = lens[at]
    ends = np.cumsum(n)
    ids = flat[np.repeat(starts[at] - (ends - n), n) + np.arange(int(n.sum()))]
    sums, bounds = np.concatenate([[0], ends]), np.concatenate([[0], np.cumsum(counts)])
    return ids, sums[bounds[1:]] - sums[bounds[:-1]]


class _Numbers(dict):
    """Gives each new key the next number, and notes keys that start or end with white space."""

    def __init__(self):
        super().__init__()
        self.fresh: list = []
        self.unsafe: set = set()

    def __missing__(self, key):
        number = self[key] = len(self)
        self.fresh.append(key)
        if type(key) is str and (not key or key[0].isspace() or key[-1].isspace()):
            self.unsafe.add(key)
        return number


class WordCache:
    """``encode``: list of strings to (flat ids, ids per string). Keys: a word stands for the word
    with the blank before it; a 1-tuple stands for the first part of a text, with no blank."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int = 250_000):
        self.encode, self.limit = encode, limit
        self.clear()

    def clear(self) -> None:
        self._start()
        self.older: tuple = ({}, self.flat, self.starts, self.lens)

    def _start(self) -> None:
        self.numbers = _Numbers()
        self.flat = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.starts = np.zeros(1 << 12, np.int64)
        self.lens = np.zeros(1 << 12, np.int64)

    def _turn(self) -> None:
        """The full generation becomes the older one; what is met again moves on from it."""
        self.older = (dict(self.numbers), self.flat[: self.used].copy(), self.starts, self.lens)
        self._start()

    def _learn(self) -> None:
        keys, self.numbers.fresh = self.numbers.fresh, []
        known, old_flat, old_starts, old_lens = self.older
        at = np.fromiter((known.get(k, -1) for k in keys), np.int64, len(keys))
        new = at < 0
        flat, counts = self.encode([k[0] if type(k) is tuple else " " + k for k, n in zip(keys, new.tolist()) if n])
        pool = np.concatenate([old_flat, flat])
        lens, first = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        lens[new], first[new] = counts, len(old_flat) + np.cumsum(counts) - counts
        lens[~new], first[~new] = old_lens[at[~new]], old_starts[at[~new]]
        ends = np.cumsum(lens)
        n, m = len(self.numbers), int(lens.sum())
        while self.used + m > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            self.lens = np.concatenate([self.lens, np.zeros_like(self.lens)])
        self.flat[self.used : self.used + m] = pool[np.repeat(first - (ends - lens), lens) + np.arange(m)]
        self.lens[n - len(keys) : n] = lens
        self.starts[n - len(keys) : n] = self.used + ends - lens
        self.used += m

    def texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all ``texts`` in order, and the number of ids of each."""
        if len(self.numbers) > self.limit:
            self._turn()
        number, unsafe = self.numbers.__getitem__, self.numbers.unsafe
        found = []
        for text in texts:
            words = text.split(" ")
            head, words[0] = words[0], (words[0],)
            at = np.fromiter(map(number, words), np.int32, len(words))
            if len(words) > 1 and (not head or head[-1].isspace() or not unsafe.isdisjoint(words)):
                words = _CUT.split(text)
                words[0] = (words[0],)
                at = np.fromiter(map(number, words), np.int32, len(words))
            found.append(at)
        if self.numbers.fresh:
            try:
                self._learn()
            except BaseException:  # a worker outlives a failed task: leave no keys without ids
                self.clear()
                raise
        at = np.concatenate(found) if found else np.zeros(0, np.int32)
        lens = self.lens[at]
        ends = np.cumsum(lens)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(self.starts[at] - (ends - lens), lens) + np.arange(total)]
        bounds = np.cumsum([0, *map(len, found)])
        sums = np.concatenate([[0], ends])
        return ids, sums[bounds[1:]] - sums[bounds[:-1]]
