"""Counts over whole texts, lines and words of a batch at once, in numpy."""

from __future__ import annotations

import numpy as np

SYMBOLS = b"#*$%&|<>"
_ALL = np.arange(256)
IS_SPACE = np.isin(_ALL, list(b" \t\n\x0b\x0c\r"))
IS_SYMBOL = np.isin(_ALL, list(SYMBOLS))
IS_UPPER = (_ALL >= 65) & (_ALL <= 90)
IS_LETTER = IS_UPPER | ((_ALL >= 97) & (_ALL <= 122)) | (_ALL >= 0xC2)
IS_DIGIT = (_ALL >= 48) & (_ALL <= 57)
IS_STOP = np.isin(_ALL, list(b".!?"))
IS_FIRST = (_ALL & 0xC0) != 0x80  # first byte of a code point


class _Numbers(dict):
    def __missing__(self, key):
        number = self[key] = len(self)
        return number


class Batch:
    """``texts`` as UTF-8. Words are runs without ASCII white space, lines are split at line feeds."""

    def __init__(self, texts: list[bytes]):
        self.n = len(texts)
        self.texts = texts
        blob = b"\n".join([*texts, b""])
        self.data = np.frombuffer(blob, np.uint8)
        self.doc_starts = np.cumsum([0, *[len(t) + 1 for t in texts[:-1]]])[: self.n]
        space = IS_SPACE[self.data]
        self.space = space
        before = np.concatenate([[True], space[:-1]])
        starts = np.flatnonzero(~space & before)
        self.word_starts = starts
        words = blob.split()
        numbers = _Numbers()
        self.words = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
        self.distinct = len(numbers)
        self.line_starts = np.concatenate([[0], np.flatnonzero(self.data == 10) + 1])[:-1] if self.n else np.zeros(0, np.int64)
        self.line_doc = np.searchsorted(self.doc_starts, self.line_starts, "right") - 1
        self.word_line = np.searchsorted(self.line_starts, starts, "right") - 1
        self.word_doc = self.line_doc[self.word_line] if len(starts) else np.zeros(0, np.int64)
        self.n_words = np.bincount(self.word_doc, minlength=self.n)

    def per_line(self, table: np.ndarray) -> np.ndarray:
        return np.add.reduceat(table[self.data].astype(np.int32), self.line_starts) if self.n else np.zeros(0, np.int32)

    def per_doc(self, mask: np.ndarray) -> np.ndarray:
        return np.add.reduceat(mask.astype(np.int32), self.doc_starts).astype(np.int64) if self.n else np.zeros(0, np.int64)

    def symbols(self) -> np.ndarray:
        return self.per_doc(IS_SYMBOL[self.data])

    def word_chars(self) -> np.ndarray:
        return self.per_doc(IS_FIRST[self.data] & ~self.space)

    def line_is_repeat(self) -> np.ndarray:
        """Lines with a word that equal an earlier line of their text."""
        out = np.zeros(len(self.line_starts), bool)
        k = 0
        for text in self.texts:
            seen: set[bytes] = set()
            for line in text.split(b"\n"):
                if line and not line.isspace():
                    if line in seen:
                        out[k] = True
                    else:
                        seen.add(line)
                k += 1
        return out

    def in_repeated_triple(self) -> np.ndarray:
        """Words inside a 3-word window that its text holds twice or more."""
        w, d = self.words, self.word_doc
        out = np.zeros(len(w), bool)
        if len(w) < 3:
            return out
        v = max(self.distinct, 1)
        pair = w[:-2] * v + w[1:-1]
        if v > 2_000_000:
            pair = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        key = pair * v + w[2:]
        whole = np.flatnonzero(d[:-2] == d[2:])
        key, doc = key[whole], d[whole]
        order = np.argsort(key, kind="stable")
        order = order[np.argsort(doc[order], kind="stable")]
        same = (key[order][1:] == key[order][:-1]) & (doc[order][1:] == doc[order][:-1])
        twice = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        at = whole[order[twice]]
        for k in range(3):
            out[at + k] = True
        return out
