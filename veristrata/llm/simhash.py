"""Operator 2: SimHash near-duplicates by a self-join of binary tries.

1. One fingerprint a document (Arrow batches): A-Z lower-cased, words, 4-word shingles with repeats,
   XXH64 with seed 42, one bit a position by majority. Texts of fewer words: the whole sequence;
   of none (or null): fingerprint zero.
2. Equal fingerprints collapse to one row (partial aggregation before the shuffle), so that copies,
   however many, meet in no task.
3. Fingerprints within ``budget`` bits agree on at least ``exact`` of ``budget + exact`` blocks of bits,
   so each distinct fingerprint goes to one bucket per choice of blocks. ``exact`` follows from their
   number (buckets of about ``target`` fingerprints beside near copies); every choice finds the same
   links. Buckets that are large all the same (``MOST_IN_BUCKET``) are keyed again by further blocks of their
   other bits, until none is, so no task joins more.
4. In a bucket the sorted fingerprints form an implicit binary trie: a node is a range whose members
   share a prefix. Node pairs are traversed together from the pair (root, root); the bits in which the
   shared prefixes differ accumulate, and a pair beyond the budget is dropped. Pairs whose members are
   already one component are skipped. Leaf pairs are links.
5. Each bucket emits a star per local component; stars join by distributed connected components.

Defined cases: repeated rows and repeated ids give repeated rows; a null ``doc_id`` never is a
``component_id`` unless a component has no other (then null); different texts of one id are told apart by
their digest; very long texts are hashed piece by piece; other columns, whatever their names, are not read; an
empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, map_arrow, passing, slices, table
from .components import connected_components

BUDGET = 4
SHINGLE = 4
SEED = 42

_BLANK = re.compile(rb"[\x20\x09-\x0D]")
#: Fingerprints of one bucket, at most: what one task joins at once.
MOST_IN_BUCKET = 500_000


def _segments(raw: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """``raw`` in pieces of about ``size`` bytes that no word crosses."""
    at = 0
    while at < len(raw):
        cut = _BLANK.search(raw, at + size)
        end = cut.start() if cut else len(raw)
        yield raw[at:end]
        at = end


def _add(bits: np.ndarray, words: list[bytes], length: int) -> int:
    """Adds the set bits of the digests of all shingles of ``length`` words; returns their number."""
    import xxhash

    joined = b" ".join(words)
    lens = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lens) - 1
    starts = (ends - lens + 1).tolist()
    ends = ends[length - 1 :].tolist()
    digests = b"".join(map(xxhash.xxh64_digest, [joined[a:b] for a, b in zip(starts, ends)], repeat(SEED)))
    raw = np.frombuffer(digests, np.uint8).reshape(len(ends), 8)
    for s in range(0, len(ends), 32768):  # sums of bytes in bounded memory
        bits += np.unpackbits(raw[s : s + 32768], axis=1).sum(axis=0, dtype=np.int64)
    return len(ends)


def fingerprint(text: str | None) -> int:
    """The 64-bit fingerprint of one text; long texts are read in pieces that share three words."""
    bits, n, held = np.zeros(64, np.int64), 0, []
    for piece in _segments((text or "").encode().lower()):
        words = held + piece.split()
        if len(words) >= SHINGLE:
            n += _add(bits, words, SHINGLE)
            words = words[1 - SHINGLE :]
        held = words
    if not n and held:
        n = _add(bits, held, len(held))
    return int(np.packbits(2 * bits > n).tobytes().hex(), 16) if n else 0


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fp, digest``: the fingerprint as a signed long, and the text's MD5 to tell texts apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            fps = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64)), batch.column("digest")], ["doc_id", "fp", "digest"])

    text = F.col("text").cast("string")
    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), _digest().alias("digest")), run, "doc_id long, fp long, digest string")


def _digest() -> Column:
    return F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))


class TrieJoin:
    """Self-join of a forest of binary tries over sorted distinct fingerprints.

    ``values`` is sorted within each of the groups that ``bounds`` delimits; no link crosses groups.
    ``roots`` gives, for every position, the least position of its component."""

    def __init__(self, values: np.ndarray, bounds: np.ndarray, budget: int = BUDGET, chunk: int = 1 << 16):
        self.f, self.budget, self.chunk = values.astype(np.uint64), budget, chunk
        self.comp = np.arange(len(values))
        self.links = 0
        self._refresh()
        lo, hi = bounds[:-1], bounds[1:]
        many = hi - lo > 1
        self._traverse(lo[many], hi[many])

    def roots(self) -> np.ndarray:
        return self.comp

    def _refresh(self) -> None:
        """``self.same[i]``: the first position after ``i`` in another component."""
        n = len(self.comp)
        change = np.flatnonzero(self.comp[1:] != self.comp[:-1]) + 1
        stops = np.append(change, n)
        self.same = stops[np.searchsorted(change, np.arange(n), "right")] if n else np.zeros(0, np.int64)

    def _depth(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Length of the prefix that a node's members share."""
        x = self.f[lo] ^ self.f[hi - 1]
        for s in (1, 2, 4, 8, 16, 32):
            x |= x >> np.uint64(s)
        return 64 - np.bitwise_count(x).astype(np.int64)

    def _split(self, lo: np.ndarray, hi: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """First member whose bit at ``depth`` is one, by binary search in every range at once."""
        shift = (63 - depth).astype(np.uint64)
        a, b = lo.copy(), hi - 1
        while True:
            open_ = a < b
            if not open_.any():
                return a
            mid = (a + b) >> 1
            one = (self.f[mid] >> shift) & np.uint64(1) == 1
            b = np.where(open_ & one, mid, b)
            a = np.where(open_ & ~one, mid + 1, a)

    def _link(self, a: np.ndarray, b: np.ndarray) -> None:
        self.links += len(a)
        while True:
            x, y = self.comp[a], self.comp[b]
            apart = x != y
            if not apart.any():
                return
            x, y = x[apart], y[apart]
            np.minimum.at(self.comp, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = self.comp[self.comp]
                if (up == self.comp).all():
                    break
                self.comp = up

    def _traverse(self, lo: np.ndarray, hi: np.ndarray) -> None:
        stack = [(lo, hi, lo, hi)]
        while stack:
            alo, ahi, blo, bhi = stack.pop()
            if len(alo) > self.chunk:
                for s in range(0, len(alo), self.chunk):
                    stack.append((alo[s : s + self.chunk], ahi[s : s + self.chunk], blo[s : s + self.chunk], bhi[s : s + self.chunk]))
                continue
            known = (self.same[alo] >= ahi) & (self.same[blo] >= bhi) & (self.comp[alo] == self.comp[blo])
            da, db = self._depth(alo, ahi), self._depth(blo, bhi)
            low = np.minimum(da, db)
            differ = self.f[alo] ^ self.f[blo]
            differ = np.where(low > 0, differ >> np.minimum(64 - low, 63).astype(np.uint64), np.uint64(0))
            keep = ~known & (np.bitwise_count(differ) <= self.budget)
            alo, ahi, blo, bhi, da, db = (x[keep] for x in (alo, ahi, blo, bhi, da, db))
            itself = alo == blo
            itself &= ahi == bhi
            leaf = (ahi - alo == 1) & (bhi - blo == 1)
            found = leaf & ~itself
            if found.any():
                self._link(alo[found], blo[found])
                self._refresh()
            on = ~leaf & ~itself  # the node with the shorter prefix gives way to its children
            if on.any():
                first = da[on] <= db[on]
                plo, phi = np.where(first, alo[on], blo[on]), np.where(first, ahi[on], bhi[on])
                qlo, qhi = np.where(first, blo[on], alo[on]), np.where(first, bhi[on], ahi[on])
                mid = self._split(plo, phi, np.where(first, da[on], db[on]))
                stack.append((np.concatenate([plo, mid]), np.concatenate([mid, phi]), np.concatenate([qlo, qlo]), np.concatenate([qhi, qhi])))
            own = itself & ~leaf
            if own.any():
                plo, phi = alo[own], ahi[own]
                mid = self._split(plo, phi, da[own])
                stack.append((plo, mid, mid, phi))
                stack.append((np.concatenate([plo, mid]), np.concatenate([mid, phi]), np.concatenate([plo, mid]), np.concatenate([mid, phi])))


def blocks_for(count: int, budget: int = BUDGET, target: int = 20_000) -> int:
    """How many blocks must agree exactly so that a bucket holds about ``target`` fingerprints."""
    exact = 1
    while exact < 4 and count / 2 ** (64 * exact / (budget + exact)) > target:
        exact += 1
    return exact


def block_masks(budget: int, exact: int) -> list[int]:
    edges = [round(64 * i / (budget + exact)) for i in range(budget + exact + 1)]
    blocks = [((1 << (b - a)) - 1) << (64 - b) for a, b in zip(edges, edges[1:])]
    return [sum(chosen) for chosen in combinations(blocks, exact)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def finer_masks(mask: int, budget: int) -> list[int]:
    """Masks that hold ``mask`` and one of ``budget + 1`` runs of its other bits: two fingerprints that differ in
    ``budget`` bits at most, none of them in ``mask``, agree under one of these too."""
    rest = [1 << i for i in range(63, -1, -1) if not mask >> i & 1]
    edges = [round(len(rest) * i / (budget + 1)) for i in range(budget + 2)]
    return sorted({mask | sum(rest[a:z]) for a, z in zip(edges, edges[1:]) if a < z})


def _keyed(distinct: DataFrame, masks: list[int], budget: int, most: int) -> DataFrame:
    """``part`` (the mask of the bits that a bucket shares), ``value, fp``. Buckets of more than ``most`` fingerprints, if
    there can be any, are keyed again by finer masks until none is left: every link stays in one bucket at least."""
    held = lambda m: F.col("fp").bitwiseAND(m)
    now = distinct.select("fp", F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("part")).select("part", held(F.col("part")).alias("value"), "fp")
    if distinct.count() <= most:
        return now
    out, level = None, set(masks)
    while True:
        large = durable(now.groupBy("part", "value").agg(F.count("*").alias("n")).where(F.col("n") > most).select("part", "value"), "simhash-large")
        small = now.join(large, ["part", "value"], "left_anti")
        out = small if out is None else out.unionByName(small)
        known = {r.part for r in large.select("part").distinct().collect()}  # masks of one level: a few hundred at most
        finer = [(_signed(m), _signed(f)) for m in sorted(level) if _signed(m) in known for f in finer_masks(m, budget)]
        if not finer:
            return out
        level = {f & (1 << 64) - 1 for _, f in finer}
        steps = distinct.sparkSession.createDataFrame(finer, "part long, finer long")
        again = now.join(large, ["part", "value"], "left_semi").join(F.broadcast(steps), "part")
        now = durable(again.select(F.col("finer").alias("part"), held(F.col("finer")).alias("value"), "fp").distinct(), "simhash-finer")


def near_links(distinct: DataFrame, budget: int = BUDGET, exact: int = 1, group_rows: int = 200_000, most: int | None = None) -> DataFrame:
    """``distinct``: column ``fp``. Returns ``child, parent``: stars whose union has the components
    of all links at ``budget`` or fewer differing bits. No bucket holds more than ``most`` fingerprints."""
    keyed = _keyed(distinct, block_masks(budget, exact), budget, MOST_IN_BUCKET if most is None else most)
    placed = keyed.repartition("part", "value").sortWithinPartitions("part", "value", "fp")

    def emit(part: np.ndarray, value: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        new = np.flatnonzero((part[1:] != part[:-1]) | (value[1:] != value[:-1])) + 1
        bounds = np.concatenate([[0], new, [len(fp)]])
        # signed order puts negative values first; bring each group into unsigned order
        unsigned = fp.view(np.uint64)
        order = np.lexsort((unsigned, np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))))
        unsigned = unsigned[order]
        roots = TrieJoin(unsigned, bounds, budget).roots()
        moved = np.flatnonzero(roots != np.arange(len(roots)))
        return pa.RecordBatch.from_arrays([pa.array(unsigned[moved].view(np.int64)), pa.array(unsigned[roots[moved]].view(np.int64))], ["child", "parent"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        rows = 0
        for batch in batches:
            held.append([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
            rows += batch.num_rows
            if rows < group_rows:
                continue
            part, value, fp = (np.concatenate(x) for x in zip(*held))
            cut = rows - 1
            while cut > 0 and part[cut - 1] == part[-1] and value[cut - 1] == value[-1]:
                cut = int(np.searchsorted(np.where((part[:cut] == part[-1]) & (value[:cut] == value[-1]), 1, 0), 1))
            if cut:
                yield emit(part[:cut], value[:cut], fp[:cut].copy())
            held, rows = [[part[cut:], value[cut:], fp[cut:]]], rows - cut
        if rows:
            part, value, fp = (np.concatenate(x) for x in zip(*held))
            yield emit(part, value, fp.copy())

    return map_arrow(placed, run, "child long, parent long")


def _rooted(docs: DataFrame, budget: int) -> tuple[DataFrame, DataFrame]:
    """All fingerprints, and ``fp, least, root`` of the distinct ones."""
    spark = docs.sparkSession
    fps = durable(fingerprints(docs), "simhash")
    # the row that stands for a fingerprint: the least id (none comes last), of its texts the least digest
    own = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest"))
    distinct = durable(fps.groupBy("fp").agg(own.alias("least")), "simhash-distinct")
    edges = near_links(distinct.select("fp"), budget, blocks_for(distinct.count(), budget))
    with passing(spark, "simhash-roots"):
        roots = durable(connected_components(edges, "simhash-components"), "simhash-roots")
    return fps, distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def _least(rooted: DataFrame) -> DataFrame:
    # written, so that adaptive execution can split the join where one component has most of the rows
    return durable(rooted.groupBy("root").agg(F.min("least").alias("first")), "simhash-least")


def near_duplicates(docs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs``."""
    fps, rooted = _rooted(docs, budget)
    named = rooted.join(_least(rooted), "root").select("fp", F.col("first.doc_id").alias("component_id"))
    return fps.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the row of least doc_id (a null id comes last)
    and, among its texts, the least digest; once, if it is repeated."""
    _, rooted = _rooted(docs, budget)

    def named(doc_id: Column, digest: Column) -> Column:  # one key, so that the join and the duplicates share a shuffle
        return F.concat_ws("/", F.coalesce(doc_id.cast("string"), F.lit("none")), digest).alias("__v_key")

    first = _least(rooted).select(named(F.col("first.doc_id"), F.col("first.digest")))
    tagged = docs.select("*", named(F.col("doc_id").cast("long"), _digest()))
    # repeated rows meet within their tasks first
    return tagged.dropDuplicates(["__v_key"]).join(first, "__v_key", "left_semi").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
