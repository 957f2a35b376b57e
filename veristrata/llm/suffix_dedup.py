"""Operator 4: removal of repeated byte passages by the interval trees of enhanced suffix arrays.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier (smaller doc_id, or the
same document and an earlier start). One suffix array over a whole corpus fits no machine, so the array
is cut by content:

1. Copies of a whole text collapse to the text of least doc_id; the others only count (all their
   strings start earlier).
2. Every window of ``LENGTH`` bytes names one anchor: the rightmost of its ``GRAM``-byte grams with the
   least hash. Equal windows name equal anchors at equal places, so equal windows always meet in the
   group of their anchor. Anchors whose gram occurs once in the corpus are dropped.
3. Each anchor left carries the bytes of the windows that name it. A group holds a sparse enhanced
   suffix array: its suffixes from the anchor on in sorted order, with their longest common prefixes. A
   stack scan yields the common-prefix intervals; for each interval the left contexts, sorted and
   scanned in the same way, give the classes with diverse left extensions. An interval and a class of
   together ``LENGTH`` bytes or more are a maximal repeat with all its occurrences
   (:func:`repeat_groups`); every occurrence but the earliest is a span to remove.
4. Spans meet at their text, whose other bytes are kept.

Hot passages: occurrences of one gram, and equal contexts, combine within each map task before the
shuffle. An anchor with more than ``HOT`` occurrences (counted exactly; more on corpora so large that over
``HOT_GRAMS`` anchors would be hot) is split by what surrounds it: a window with the anchor at offset
``a`` goes to class ``a div STEP``, whose windows all hold the same ``LENGTH - STEP + 1`` bytes around
the anchor, and these bytes name its group. Equal windows still meet, while different surroundings part.
A class that is hot itself (counted exactly too: one line in many different surroundings) is cut into its
single windows, each with a group of its own; a task sends one of equal windows.

Texts are told apart by their whole digest: ``tid`` is its first 60 bits, and another number where two
texts share these. Partitions and buckets follow from the bytes of the distinct texts.

Defined cases: a null text is empty; null doc_ids come last; texts that share a doc_id are ordered by
their digest; a repeated row is a later copy of the first; a very long text is one text, with as many anchors as it
has windows to name them; other columns, whatever their names, are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import contextlib
import hashlib
import pickle
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, map_arrow, passing, scratch_path, slices, table

LENGTH = 100
GRAM = 24
STEP = 11  # offsets of an anchor in a window, 0 to 76, fall into seven classes
HOT = 50_000  # members of a group; their contexts are some ten megabytes
HOT_GRAMS = 2_000_000
PART_BYTES = 32 << 20
BUCKET_BYTES = 4 << 20
MOST_PARTS = 50_000
_LAST = 2**63 - 1
_MASK = np.uint64((1 << 24) - 1)
_ODD = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)


# --- anchors ---------------------------------------------------------------------------------


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, np.uint64(_ODD)), np.full(n, np.uint64(pow(_ODD, -1, 1 << 64)))
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


_CHUNK = 1 << 20
_UP, _DOWN = _powers(_CHUNK + 2 * LENGTH + 2)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Mixed polynomial hash of every gram of at most a chunk of bytes."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _UP[: len(data)], out=sums[1:])
    h = (sums[GRAM:] - sums[:-GRAM]) * _DOWN[: len(data) - GRAM + 1]
    for _ in range(2):
        h *= _MIX
        h ^= h >> np.uint64(32)
    return h


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of all windows of the texts laid end to end in ``data`` (``ends``: their ends).

    Returns for each run of windows with one anchor: the first and the last window start, the anchor's
    place, the gram's hash. Windows across two texts do not exist."""
    span, out = LENGTH - GRAM + 1, []
    for base in range(0, max(0, len(data) - LENGTH + 1), _CHUNK):
        part = data[base : base + _CHUNK + LENGTH - 1]
        n = len(part) - LENGTH + 1
        h = gram_hashes(part)
        # low bits give way to the place, counted down: the least key is the rightmost least hash
        keys = (h & ~_MASK) | (_MASK - np.arange(len(h), dtype=np.uint64))
        padded = np.concatenate([keys, np.full(-len(keys) % span, np.uint64(2**64 - 1))]).reshape(-1, span)
        left = np.minimum.accumulate(padded, axis=1).ravel()
        right = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
        place = (_MASK - (np.minimum(right[:n], left[span - 1 : span - 1 + n]) & _MASK)).astype(np.int64)
        start = np.arange(base, base + n)
        whole = ends[np.searchsorted(ends, start, "right")] - start >= LENGTH
        start, place = start[whole], place[whole]
        if not len(start):
            continue
        new = np.flatnonzero((place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)) + 1
        first = np.concatenate([[0], new])
        last = np.concatenate([new, [len(start)]]) - 1
        out.append((start[first], start[last], place[first] + base, h[place[first]]))
    if not out:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, np.zeros(0, np.uint64)
    first, last, place, h = (np.concatenate(x) for x in zip(*out))
    joined = np.flatnonzero((place[1:] != place[:-1]) | (first[1:] != last[:-1] + 1)) + 1  # runs cut by a chunk
    at = np.concatenate([[0], joined])
    return first[at], last[np.concatenate([joined, [len(first)]]) - 1], place[at], h[at]


def _laid_out(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])


def _by_bucket(bucket: np.ndarray, emit: Callable[[int, np.ndarray], bytes]) -> Iterator[tuple[int, bytes]]:
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for rows in np.split(order, cuts):
        if len(rows):
            yield int(bucket[rows[0]]), emit(int(bucket[rows[0]]), rows)


def _packed(found: Iterator[tuple[int, bytes]]) -> pa.RecordBatch:
    rows = list(found)
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "blob"])


def _find_anchors(buckets: int) -> Callable:
    """Map side: all anchors by bucket. Those that repeat within the task pass (bucket below zero)
    and send one representative with their number."""

    def flush(held: list, salt: int) -> pa.RecordBatch:
        h, ord_, tid, place = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(h, kind="stable")
        h, ord_, tid, place = h[order], ord_[order], tid[order], place[order]
        new = np.concatenate([[True], h[1:] != h[:-1]])
        again = np.concatenate([h[1:] == h[:-1], [False]]) | ~new

        def one(_: int, rows: np.ndarray) -> bytes:
            own = sent[rows]
            return pickle.dumps((h[own], ord_[own], tid[own], place[own].astype(np.int32), counts[rows]), 5)

        sent = np.flatnonzero(new)
        counts = np.diff(np.append(sent, len(h))).astype(np.uint32)
        found = list(_by_bucket((h[sent] >> np.uint64(32)).astype(np.int64) % buckets, one))
        passed = np.flatnonzero(again)
        for s in range(0, len(passed), 100_000):
            own = passed[s : s + 100_000]
            found.append((-1 - (salt + s) % buckets, pickle.dumps((ord_[own], tid[own], place[own].astype(np.int32)), 5)))
        return _packed(iter(found))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, salt = [], 0, 0
        for batch in slices(batches, "text"):
            data, ends = _laid_out(batch)
            _, _, place, h = anchors(data, ends)
            doc = np.searchsorted(ends, place, "right")
            starts = np.concatenate([[0], ends[:-1]])
            ids = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("ord", "tid")]
            held.append((h, ids[0][doc], ids[1][doc], place - starts[doc]))
            rows += len(h)
            if rows >= 1_000_000:
                yield flush(held, salt)
                held, rows, salt = [], 0, salt + 7919
        if rows:
            yield flush(held, salt)

    return run


def _repeated_anchors(hot: int) -> Callable:
    """Reduce side: places of the grams that occur twice or more; ``gram`` is set on the places of those
    that occur more than ``hot`` times, and on one row without text (``tid`` null) of each of these."""

    def out(ord_: np.ndarray, tid: np.ndarray, place: np.ndarray, gram: np.ndarray | None = None) -> pa.RecordBatch:
        cols = [pa.array(ord_, pa.int64()), pa.array(tid, pa.int64()), pa.array(place, pa.int32()), pa.array(gram.view(np.int64)) if gram is not None else pa.nulls(len(ord_), pa.int64())]
        return pa.RecordBatch.from_arrays(cols, ["ord", "tid", "place", "gram"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, blobs in _groups(batches):
            if bucket < 0:
                for blob in blobs:
                    yield out(*pickle.loads(blob))
                continue
            h, ord_, tid, place, counts = (np.concatenate(x) for x in zip(*map(pickle.loads, blobs)))
            order = np.argsort(h, kind="stable")
            h, ord_, tid, place, counts = h[order], ord_[order], tid[order], place[order], counts[order].astype(np.int64)
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            total = np.add.reduceat(counts, first)
            twice = np.repeat(total > 1, np.diff(np.append(first, len(h)))) & (counts == 1)  # the others have passed
            large = np.repeat(total > hot, np.diff(np.append(first, len(h))))
            yield out(ord_[twice & ~large], tid[twice & ~large], place[twice & ~large])
            if large.any():
                yield out(ord_[twice & large], tid[twice & large], place[twice & large], h[twice & large])
                grams = h[first[total > hot]].view(np.int64)
                none = pa.nulls(len(grams), pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, pa.nulls(len(grams), pa.int32()), pa.array(grams)], ["ord", "tid", "place", "gram"])

    return run


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    """Rows sorted by bucket, as one list of blobs a bucket."""
    now, blobs = None, []
    for batch in batches:
        for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if bucket != now and blobs:
                yield now, blobs
                blobs = []
            now = bucket
            blobs.append(blob)
    if blobs:
        yield now, blobs


# --- repeats ---------------------------------------------------------------------------------


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


def intervals(lcp: list[int], least: int = 1) -> Iterator[tuple[int, int, int]]:
    """Common-prefix intervals ``(value, first, last)`` of an LCP array by one stack scan, inner ones
    first. ``lcp[i]`` is the prefix that the sorted suffixes ``i`` and ``i + 1`` share."""
    stack = [(0, 0)]
    for i, value in enumerate([*lcp, 0]):
        first = i
        while stack[-1][0] > value:
            height, first = stack.pop()
            if height >= least:
                yield height, first, i
        if stack[-1][0] < value:
            stack.append((value, first))


def repeat_groups(left: list[bytes], right: list[bytes], length: int = LENGTH) -> Iterator[tuple[int, int, list[int]]]:
    """Maximal repeats of at least ``length`` bytes among suffixes with known left contexts.

    ``right[i]`` is suffix ``i``, ``left[i]`` its left context read backwards. Yields
    ``(bytes to the left, bytes to the right, occurrences)``: all occurrences share the string, no
    longer string to either side is shared by all of them."""
    m = len(right)
    if m == 2:
        a, b = _common(left[0], left[1]), _common(right[0], right[1])
        if a + b >= length:
            yield a, b, [0, 1]
        return
    array = sorted(range(m), key=right.__getitem__)
    lcp = [_common(right[a], right[b]) for a, b in zip(array, array[1:])]
    by_left = sorted(range(m), key=left.__getitem__)
    rank = [0] * m
    for k, i in enumerate(by_left):
        rank[i] = k
    llcp = [_common(left[a], left[b]) for a, b in zip(by_left, by_left[1:])]
    most = max(llcp)
    table_: list[list[int]] = []
    right_table: list[list[int]] = []
    place = [0] * m
    for k, i in enumerate(array):
        place[i] = k
    for value, first, last in intervals(lcp, max(1, length - most)):
        need = max(0, length - value)
        own = sorted(rank[array[k]] for k in range(first, last + 1))
        if len(own) == m:
            between = llcp
        else:
            if not table_:
                table_ = _minima(llcp)
            between = [_least(table_, a, b) for a, b in zip(own, own[1:])]
        whole = min(between)
        if whole >= need:  # what every occurrence shares to the left
            yield whole, value, [by_left[k] for k in own]
        for width, a, b in intervals(between, max(1, need)):
            if width > whole or whole < need:  # narrower classes: their left extensions differ
                occurrences = [by_left[k] for k in own[a : b + 1]]
                right_table = right_table or _minima(lcp)
                at = [place[i] for i in occurrences]
                if _least(right_table, min(at), max(at)) == value:  # else a longer string has them all
                    yield width, value, occurrences


def _minima(values: list[int]) -> list[list[int]]:
    rows = [values]
    step = 1
    while 2 * step <= len(values):
        low = rows[-1]
        rows.append([min(low[i], low[i + step]) for i in range(len(low) - step)])
        step *= 2
    return rows


def _least(rows: list[list[int]], a: int, b: int) -> int:
    k = (b - a).bit_length() - 1
    return min(rows[k][a], rows[k][b - (1 << k)])


def later_spans(members: list[tuple]) -> Iterator[tuple[int, int, int, int]]:
    """``members``: ``(ord, tid, first window, anchor offset, bytes)`` of one anchor group. Yields
    ``(ord, tid, start, end)`` of every occurrence of a maximal repeat but the earliest."""
    distinct: dict[tuple[int, bytes], tuple] = {}
    for x in sorted(set(members)):
        key = (x[3], x[4])
        if key in distinct:  # all its windows occur in the earlier one
            yield x[0], x[1], x[2], x[2] + len(x[4])
        else:
            distinct[key] = x
    rows = list(distinct.values())
    if len(rows) < 2:
        return
    left = [x[4][: x[3]][::-1] for x in rows]
    right = [x[4][x[3] :] for x in rows]
    widest: dict[int, set[tuple[int, int]]] = {}
    for a, b, occurrences in repeat_groups(left, right):
        first = min(occurrences)  # rows are in order
        for i in occurrences:
            if i != first:
                widest.setdefault(i, set()).add((a, b))
    for i, spans in widest.items():
        ord_, tid, start, offset, _ = rows[i]
        place, reach = start + offset, -1
        for a, b in sorted(spans, key=lambda s: (-s[0], -s[1])):
            if b > reach:  # spans inside an earlier one add nothing
                reach = b
                yield ord_, tid, place - a, place + b


def _split(h: int, x: tuple) -> Iterator[tuple[int, tuple]]:
    """A hot anchor's context cut into the classes of its windows, each with the key of its group."""
    import xxhash

    ord_, tid, start, offset, raw = x
    windows = len(raw) - LENGTH + 1
    for low in range(0, LENGTH - GRAM + 1, STEP):  # anchor offsets of the class: low to low + STEP - 1
        a, z = max(0, offset - low - STEP + 1), min(windows - 1, offset - low)
        if a <= z:
            shared = raw[offset - low : offset - low + LENGTH - STEP + 1]
            yield xxhash.xxh64_intdigest(shared, (h ^ low) & 0xFFFFFFFFFFFFFFFF), (ord_, tid, start + a, offset - a, raw[a : z + LENGTH])


def _windows(key: int, x: tuple) -> Iterator[tuple[int, tuple]]:
    """A part of a hot class cut into its single windows, each with the key of its own group: equal windows alone meet
    there, and of these a task sends one."""
    import xxhash

    ord_, tid, start, offset, raw = x
    for a in range(len(raw) - LENGTH + 1):
        window = raw[a : a + LENGTH]
        yield xxhash.xxh64_intdigest(window, (key ^ offset - a) & 0xFFFFFFFFFFFFFFFF), (ord_, tid, start + a, offset - a, window)


def _class_sizes(hot: np.ndarray) -> Callable:
    """Map side of the count of hot classes: ``key, n`` of the classes of the hot anchors' contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, int] = {}

        def out() -> pa.RecordBatch:
            keys = np.fromiter(counts, np.uint64, len(counts)).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(list(counts.values()), pa.int64())], ["key", "n"])

        for held in _places_of(batches):
            hashes = np.array([h for h, _ in held], np.uint64)
            for k in np.flatnonzero(np.isin(hashes, hot)).tolist():
                for key, _ in _split(*held[k]):
                    counts[key] = counts.get(key, 0) + 1
            if len(counts) >= 200_000:
                yield out()
                counts = {}
        yield out()

    return run


def _places_of(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, tuple]]]:
    """The named anchors of slices of texts: hash, and ``ord, tid``, start of the windows, offset and bytes."""
    for batch in slices(batches, "text"):
        data, ends = _laid_out(batch)
        starts = np.concatenate([[0], ends[:-1]])
        ords, tids = batch.column("ord").to_pylist(), batch.column("tid").to_pylist()
        places = batch.column("places")
        per_doc = np.diff(places.offsets.to_numpy())
        wanted = places.flatten().to_numpy(zero_copy_only=False).astype(np.int64) + np.repeat(starts, per_doc)
        first, last, place, h = anchors(data, ends)
        own = np.isin(place, wanted)
        first, last, place, h = first[own], last[own], place[own], h[own]
        doc = np.searchsorted(ends, place, "right")
        raw = data.tobytes()
        yield [(x, (ords[d], tids[d], a - int(starts[d]), p - a, raw[a : b + LENGTH])) for d, a, b, p, x in zip(doc.tolist(), first.tolist(), last.tolist(), place.tolist(), h.tolist())]


def _contexts(buckets: int, hot: np.ndarray, large: np.ndarray) -> Callable:
    """Map side of the group join: each repeated anchor with the bytes of its windows. Equal contexts
    within the task combine: all but the earliest become spans at once (bucket below zero). ``hot``:
    sorted hashes of the hot grams; ``large``: sorted keys of the classes that are hot themselves."""

    def flush(held: list, salt: int) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, bytes], tuple] = {}
        spans, sent = [], []
        for h, x in sorted(held, key=lambda r: r[1]):
            key = (x[3], x[4])
            if key in seen:
                if seen[key][:3] != x[:3]:
                    spans.append((x[0], x[1], x[2], x[2] + len(x[4])))
            else:
                seen[key] = x
                sent.append((h, x))
        if len(hot) and sent:
            hashes = np.array([h for h, _ in sent], np.uint64)
            known = hot[np.minimum(np.searchsorted(hot, hashes), len(hot) - 1)] == hashes
            sent, parted = [r for r, k in zip(sent, known.tolist()) if not k], [r for r, k in zip(sent, known.tolist()) if k]
            for s in range(0, len(parted), 20_000):  # classes are several times their contexts
                yield from parts(parted[s : s + 20_000], salt + s)
        yield packed(sent, spans, salt)

    def parts(parted: list, salt: int) -> Iterator[pa.RecordBatch]:
        spans = []

        def once(pieces: Iterator[tuple[int, tuple]]) -> list[tuple[int, tuple]]:
            """In order: the earliest of equal pieces is sent, the others are spans."""
            seen: dict[tuple[int, int, bytes], tuple] = {}
            for key, y in pieces:
                if (key, y[3], y[4]) in seen:
                    spans.append((y[0], y[1], y[2], y[2] + len(y[4])))
                else:
                    seen[key, y[3], y[4]] = y
            return [(key, y) for (key, _, _), y in seen.items()]

        sent = once(r for h, x in parted for r in _split(h, x))
        if len(large) and sent:
            keys = np.array([key for key, _ in sent], np.uint64)
            again = (large[np.minimum(np.searchsorted(large, keys), len(large) - 1)] == keys).tolist()
            whole = [r for r, k in zip(sent, again) if not k]
            sent = whole + once(r for (key, x), k in zip(sent, again) if k for r in _windows(key, x))
        yield packed(sent, spans, salt)

    def packed(sent: list, spans: list, salt: int) -> pa.RecordBatch:
        found = []
        if sent:
            hashes = np.array([h for h, _ in sent], np.uint64)
            found = list(_by_bucket((hashes >> np.uint64(32)).astype(np.int64) % buckets, lambda _, rows: pickle.dumps([sent[k] for k in rows], 5)))
        for s in range(0, len(spans), 50_000):
            found.append((-1 - (salt + s) % buckets, pickle.dumps(spans[s : s + 50_000], 5)))
        return _packed(iter(found))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, salt = [], 0
        for found in _places_of(batches):
            held += found
            if len(held) >= 200_000:
                yield from flush(held, salt)
                held, salt = [], salt + 7919
        if held:
            yield from flush(held, salt)

    return run


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reduce side: one enhanced suffix array an anchor group."""

    def out(rows: list) -> pa.RecordBatch:
        cols = list(zip(*rows)) or [[], [], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["ord", "tid", "start", "end"])

    for bucket, blobs in _groups(batches):
        if bucket < 0:
            for blob in blobs:
                yield out(pickle.loads(blob))
            continue
        groups: dict[int, list] = {}
        for blob in blobs:
            for h, x in pickle.loads(blob):
                groups.setdefault(h, []).append(x)
        rows: list = []
        for members in groups.values():
            if len(members) > 1:
                rows.extend(later_spans(members))
            if len(rows) >= 100_000:
                yield out(rows)
                rows = []
        yield out(rows)


def _cut(keep_text: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            cols: list[list] = [[], [], [], []]
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                raw = text.encode()
                kept, at, runs, gone = [], 0, 0, 0
                end = -1
                for a, b in sorted((s["start"], s["end"]) for s in spans):
                    if a > end:
                        kept.append(raw[at:a])
                        runs += 1
                        gone += b - a
                        end = at = b
                    elif b > end:
                        gone += b - end
                        end = at = b
                kept.append(raw[at:])
                rest = b"".join(kept)
                for c, v in zip(cols, (gone, runs, hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "ignore") if keep_text else None)):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([batch.column("ord"), batch.column("tid"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.string())], ["ord", "tid", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def _local_firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drops a text that an earlier row of the task holds under a smaller or equal doc_id."""
    seen: dict[bytes, int] = {}
    for batch in batches:
        keep = []
        for i, (ord_, digest) in enumerate(zip(batch.column("ord").to_pylist(), batch.column("digest").to_pylist())):
            if seen.get(digest, _LAST + 1) > ord_:
                if len(seen) >= 500_000:
                    seen.clear()
                seen[digest] = ord_
                keep.append(i)
        if keep:
            yield batch.take(pa.array(keep, pa.int64()))


def _digest() -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256))


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("ord"),
        _digest().alias("digest"),
        F.octet_length(text).cast("long").alias("n_bytes"),
        text.alias("text"),
    ).withColumn("tkey", F.conv(F.substring(F.hex("digest"), 1, 15), 16, 10).cast("long"))


def repeats(docs: DataFrame, keep_text: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(rows, results)``. Rows: ``doc_id, ord, tid, digest, n_bytes, times, is_first`` for each
    distinct pair of document id and text. Results: ``ord, tid, n_removed, n_spans, kept_sha256,
    kept`` for the first texts that lose bytes."""
    spark = docs.sparkSession
    keyed = _keyed(docs)
    rows = durable(keyed.groupBy("doc_id", "ord", "tkey", "digest", "n_bytes").agg(F.count("*").alias("times")), "suffix-rows")
    # two texts with one key: the second and later ones take a negative number of their own
    nth = F.row_number().over(Window.partitionBy("tkey").orderBy("digest"))
    own = F.when(nth == 1, F.col("tkey")).otherwise(-1 - F.pmod(F.xxhash64("digest"), F.lit(1 << 62)))
    # written, so that adaptive execution can split the join where one text has most of the rows
    least = durable(rows.groupBy("tkey", "digest", "n_bytes").agg(F.min("ord").alias("least")).withColumn("tid", own), "suffix-least")
    size = least.agg(F.sum("n_bytes")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(MOST_PARTS, size // PART_BYTES))
    buckets = max(4 * parts, size // BUCKET_BYTES)
    hot = max(HOT, 2 * size // (LENGTH - GRAM) // HOT_GRAMS)  # about two anchors in as many bytes as have offsets
    rows = rows.join(least.select("digest", "tid", "least"), "digest").withColumn("is_first", F.col("ord") == F.col("least")).drop("least")
    long = F.col("n_bytes") >= LENGTH
    name = "veristrata_texts_" + uuid.uuid4().hex[:12]
    with passing(spark, "suffix-rows", "suffix-least", "suffix-cut"), _dropped(spark, name):
        local = map_arrow(keyed.where(long).select("ord", "tkey", "digest", "text"), _local_firsts, "ord long, tkey long, digest binary, text string")
        firsts = least.where(long).select("tkey", F.col("digest").alias("known"), "tid", F.col("least").alias("own"))
        # own is the least ord of the text, so <= keeps exactly that one; both sides by the key that is the
        # bucket's: equal digests as two bounds, for an equality would join and shuffle by both
        same = local.repartition(parts, "tkey").join(firsts.repartition(parts, "tkey").hint("shuffle_hash"), "tkey").where("digest >= known and digest <= known and ord <= own")
        texts = _bucketed(same.select("ord", "tid", "text"), parts, name)
        found = map_arrow(texts, _find_anchors(buckets), "bucket long, blob binary")
        places = durable(map_arrow(found.repartition(parts, "bucket").sortWithinPartitions("bucket"), _repeated_anchors(hot), "ord long, tid long, place int, gram long"), "suffix-places")
        # at most HOT_GRAMS numbers by the choice of ``hot``
        grams = np.unique(np.array([r.gram for r in places.where("tid is null").select("gram").collect()], np.int64).view(np.uint64))
        named = lambda some: texts.join(some.groupBy("tid").agg(F.collect_list("place").alias("places")), "tid").select("ord", "tid", "text", "places")
        large = np.zeros(0, np.uint64)
        if len(grams):  # the classes of hot anchors are counted as well, over the texts that hold these
            sizes = map_arrow(named(places.where("tid is not null and gram is not null")), _class_sizes(grams), "key long, n long")
            classes = sizes.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > hot).select("key").collect()  # fewer than seven a hot gram
            large = np.unique(np.array([r.key for r in classes], np.int64).view(np.uint64))
        held = map_arrow(named(places.where("tid is not null")), _contexts(buckets, grams, large), "bucket long, blob binary")
        spans = map_arrow(held.repartition(parts, "bucket").sortWithinPartitions("bucket"), _spans, "ord long, tid long, start long, end long")
        gone = spans.groupBy("tid").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
        cut = map_arrow(texts.join(gone, "tid").select("ord", "tid", "text", "spans"), _cut(keep_text), "ord long, tid long, n_removed long, n_spans long, kept_sha256 string, kept string")
        cut = durable(cut, "suffix-cut")
    return rows, cut


@contextlib.contextmanager
def _dropped(spark: SparkSession, name: str) -> Iterator[None]:
    """Drops the table ``name`` from the catalog in the end, also if what is inside fails."""
    try:
        yield
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def _bucketed(texts: DataFrame, parts: int, name: str) -> DataFrame:
    """The distinct texts written once, bucketed by their number, as the table ``name``: later joins
    shuffle no text."""
    spark = texts.sparkSession
    texts.write.bucketBy(parts, "tid").option("path", scratch_path(spark, "suffix-texts")).option("compression", "zstd").format("parquet").saveAsTable(name)
    return spark.table(name)


def removed(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for every row of ``docs``."""
    rows, cut = repeats(docs)
    nothing = hashlib.sha256(b"").hexdigest()
    each = rows.join(cut.select("ord", "tid", "n_removed", "n_spans", "kept_sha256").withColumn("is_first", F.lit(True)), ["ord", "tid", "is_first"], "left")
    each = each.select("*", F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("nth"))
    copy = (~F.col("is_first") | (F.col("nth") > 1)) & (F.col("n_bytes") >= LENGTH)
    return each.select(
        "doc_id",
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(copy, F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", F.lit(0).cast("long"))).alias("n_spans"),
        F.when(copy, F.lit(nothing)).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("digest")))).alias("kept_sha256"),
    )


def keep_unrepeated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with repeated passages cut out of ``text`` (``n_chars`` follows, if there);
    later copies of a whole text and documents left without a word go. Rows that share id and text
    count as one; a code point cut in two loses its other bytes too."""
    rows, cut = repeats(docs, keep_text=True)
    keyed = rows.join(cut.select("ord", "tid", "kept").withColumn("is_first", F.lit(True)), ["ord", "tid", "is_first"], "left")
    copy = ~F.col("is_first") & (F.col("n_bytes") >= LENGTH)
    # names of their own, for tables with columns of any name
    changes = keyed.where(copy | F.col("kept").isNotNull()).select(F.col("ord").alias("__v_ord"), F.col("digest").alias("__v_digest"), copy.alias("__v_copy"), F.col("kept").alias("__v_kept"))
    names = docs.columns
    tagged = docs.select("*", F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("__v_ord"), _digest().alias("__v_digest"))
    out = tagged.join(changes, ["__v_ord", "__v_digest"], "left").where("__v_copy is null or not __v_copy").withColumn("text", F.coalesce("__v_kept", "text"))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed(table(spark, sf_dir, "documents"))
