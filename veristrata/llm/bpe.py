"""Operator 5: byte-level BPE encoding and decoding on length-bucketed padded numpy matrices.

Every unknown piece becomes one row of a padded matrix of token ids, with rows of similar length in
one matrix. In each round every row merges its leftmost pair of minimum rank: pair ranks come from an
open-addressing hash table in two numpy arrays, the merged cell takes the rank as its id, and the row
is compacted by one cell. Rows without a mergeable pair leave the matrix. Pieces beyond
``MATRIX_BYTES`` bytes (a run without any boundary) merge in the same order on a linked list with a
heap, which costs n log n where the matrix would cost n squared.

Defined cases: a null text is empty; an empty text has no ids and the digests of no bytes; strings
of special tokens are ordinary text; ids are little-endian unsigned 32-bit in ``ids_sha256``.
Repeated rows give repeated rows; extra input columns are ignored; very long texts are encoded whole, and an empty
table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, slices, table
from .wordcache import WordCache, gather, split_pieces

MATRIX_BYTES = 512
_BUCKETS = (2, 3, 4, 5, 6, 7, 8, 10, 12, 16, 24, 32, 64, 128, 256, MATRIX_BYTES)
_NONE = np.int32(2**31 - 1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """Hash table from (left id, right id) to rank; linear probing, load below one half."""

    def __init__(self, pairs: dict[tuple[int, int], int]):
        bits = max(4, (len(pairs) * 2).bit_length() + 1)
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, np.uint64(2**64 - 1), np.uint64)
        self.ranks = np.full(1 << bits, _NONE, np.int32)
        keys = np.array([a << 32 | b for a, b in pairs], np.uint64)
        ranks = np.array(list(pairs.values()), np.int32)
        slots = self._slot(keys)
        left = np.arange(len(keys))
        while len(left):  # the first key that claims a free slot has it, the others probe on
            free = self.keys[slots[left]] == np.uint64(2**64 - 1)
            _, first = np.unique(slots[left], return_index=True)
            won = np.zeros(len(left), bool)
            won[first] = True
            won &= free
            self.keys[slots[left[won]]] = keys[left[won]]
            self.ranks[slots[left[won]]] = ranks[left[won]]
            left = left[~won]
            slots[left] = (slots[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MIX) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the pairs, ``_NONE`` for those that do not merge; any shape."""
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        slots = self._slot(keys)
        seen = self.keys[slots]
        out = np.where(seen == keys, self.ranks[slots], _NONE)
        open_ = np.flatnonzero(((seen != keys) & (seen != np.uint64(2**64 - 1))).ravel())
        flat, k, s = out.reshape(-1), keys.reshape(-1)[open_], slots.reshape(-1)[open_]
        while len(open_):
            s = (s + 1) & self.mask
            seen = self.keys[s]
            hit = seen == k
            flat[open_[hit]] = self.ranks[s[hit]]
            on = ~hit & (seen != np.uint64(2**64 - 1))
            open_, k, s = open_[on], k[on], s[on]
        return flat.reshape(out.shape)


class ByteBpe:
    """Rank file, pattern, and both directions."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as lines:
            self.ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.pieces = regex.compile(pattern)
        bytes_of = [b""] * (max(self.ids.values()) + 1)
        for token, rank in self.ids.items():
            bytes_of[rank] = token
        self.token_blob = np.frombuffer(b"".join(bytes_of), np.uint8)
        self.token_lens = np.array([len(x) for x in bytes_of], np.int64)
        self.token_starts = np.cumsum(self.token_lens) - self.token_lens
        pairs = {}
        for token, rank in self.ids.items():
            for cut in range(1, len(token)):
                a, b = self.ids.get(token[:cut]), self.ids.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a, b] = rank
        self.pairs, self.table = pairs, PairTable(pairs)
        self.single = np.array([self.ids.get(bytes([b]), -1) for b in range(256)], np.int64)
        if (self.single < 0).any():
            raise ValueError("the rank file lacks single bytes")
        self.cache = WordCache(self._parts)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in order, and how many belong to each."""
        return self.cache.texts(texts)

    def decode(self, ids: np.ndarray) -> bytes:
        lens = self.token_lens[ids]
        ends = np.cumsum(lens)
        if not len(ends):
            return b""
        at = np.repeat(self.token_starts[ids] - (ends - lens), lens) + np.arange(int(ends[-1]))
        return self.token_blob[at].tobytes()

    def _parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of each part by the pattern, each distinct piece encoded once."""
        number, at, counts = split_pieces(self.pieces, parts)
        flat, lens = self._encode_pieces([p.encode() for p in number])
        return gather(flat, lens, at, counts)

    def _encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        lens = np.ones(len(pieces), np.int64)
        whole = np.array([self.ids.get(p, -1) for p in pieces], np.int64)
        sizes = np.array([len(p) for p in pieces], np.int64)
        todo = whole < 0
        done: list[tuple[np.ndarray, np.ndarray]] = []  # rows of pieces, their ids one after the other
        for i in np.flatnonzero(todo & (sizes > MATRIX_BYTES)):
            ids = self._long(pieces[i])
            lens[i] = len(ids)
            done.append((np.array([i]), ids))
        low = 1
        for width in _BUCKETS:
            rows = np.flatnonzero(todo & (sizes > low) & (sizes <= width))
            low = width
            step = max(1, 1_000_000 // width)
            for s in range(0, len(rows), step):
                part = rows[s : s + step]
                cells, n = self._matrix([pieces[i] for i in part], width)
                lens[part] = n
                done.append((part, cells[np.arange(width)[None, :] < n[:, None]]))
        starts = np.cumsum(lens) - lens
        flat = np.zeros(int(lens.sum()), np.uint32)
        flat[starts[~todo]] = whole[~todo]
        for rows, ids in done:
            n = lens[rows]
            ends = np.cumsum(n)
            flat[np.repeat(starts[rows] - (ends - n), n) + np.arange(len(ids))] = ids
        return flat, lens

    def _matrix(self, pieces: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        """All ``pieces`` (at most ``width`` bytes) merged round by round in one padded matrix:
        the ids of each row, left-aligned, and their number."""
        n = len(pieces)
        raw = np.frombuffer(b"".join([p.ljust(width, b"\0") for p in pieces]), np.uint8).reshape(n, width)
        lens = np.array([len(p) for p in pieces], np.int64)
        cells = self.single[raw].astype(np.int32)
        ranks = self.table.find(cells[:, :-1], cells[:, 1:])
        ranks[np.arange(width - 1)[None, :] >= (lens - 1)[:, None]] = _NONE
        rows = np.arange(n)
        out, out_lens = np.zeros((n, width), np.uint32), np.zeros(n, np.int64)
        while len(rows):
            w = cells.shape[1]
            j = ranks.argmin(axis=1) if w > 1 else np.zeros(len(rows), np.int64)  # the leftmost of the smallest
            best = ranks[np.arange(len(rows)), j] if w > 1 else np.full(len(rows), _NONE)
            stop = best == _NONE
            if stop.any():
                out[rows[stop], :w] = cells[stop]
                out_lens[rows[stop]] = lens[stop]
                go = ~stop
                rows, cells, ranks, lens, j, best = rows[go], cells[go], ranks[go], lens[go], j[go], best[go]
                if not len(rows):
                    break
            at = np.arange(len(rows))
            cells[at, j] = best
            take = np.arange(w - 1)[None, :]
            cells = np.take_along_axis(cells, take + (take > j[:, None]), axis=1)
            lens = lens - 1
            take = np.arange(w - 2)[None, :]
            ranks = np.take_along_axis(ranks, take + (take >= j[:, None]), axis=1)
            for side in (j - 1, j):  # only the pairs beside the merged cell are new
                ok = (side >= 0) & (side < lens - 1)
                k, c = at[ok], side[ok]
                ranks[k, c] = self.table.find(cells[k, c], cells[k, c + 1])
            k = at[(j >= lens - 1) & (j < w - 2)]
            ranks[k, j[k]] = _NONE
        return out, out_lens

    def _long(self, piece: bytes) -> np.ndarray:
        """The same merges in the same order for one long piece: linked list and heap."""
        ids = self.single[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := self.pairs.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else n
            if j >= n or self.pairs.get((ids[i], ids[j])) != rank:
                continue
            ids[i], ids[j] = rank, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for a in (before[i], i):
                if a >= 0 and after[a] < n and (r := self.pairs.get((ids[a], ids[after[a]]))) is not None:
                    heapq.heappush(heap, (r, a))
        return np.array([x for x in ids if x >= 0], np.uint32)


_loaded: dict[tuple[str, str], ByteBpe] = {}


def tokenizer(path: str, pattern: str) -> ByteBpe:
    """One instance a worker process."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = ByteBpe(path, pattern)
    return _loaded[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` and, on demand, the ids themselves (binary)."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids binary" if keep_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path, pattern)
        for batch in slices(batches, "text"):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            ids, counts = bpe.encode(texts)
            parts = np.split(ids.astype("<u4"), np.cumsum(counts)[:-1])
            cols = [
                batch.column("doc_id"),
                pa.array(counts, pa.int64()),
                pa.array([hashlib.sha256(p.tobytes()).hexdigest() for p in parts]),
                pa.array([hashlib.sha256(bpe.decode(p)).hexdigest() for p in parts]),
            ]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                cols.append(pa.array([p.tobytes() for p in parts], pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
