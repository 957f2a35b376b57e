"""Operator 8: approximate nearest neighbours on robust-pruned directed graphs, one a shard.

1. Usable vectors (finite, non-zero) collapse to distinct ones with their least ids, combined within
   each task first, so copies of one vector meet in no task. Each length has shards of its own.
2. Distinct vectors are dealt to shards by a hash: ``SHARDS`` of them, of ``LEAST_ROWS`` vectors at least and of
   ``MOST_ROWS`` and ``MOST_BYTES`` at most (bounds on a task's memory). In each shard a directed graph grows in doubling
   batches: a greedy beam search on the graph so far proposes neighbours, relaxed distance pruning keeps
   diverse edges (a candidate goes if a kept neighbour is ``ALPHA`` times nearer to it than the node),
   reverse edges are added and pruned again.
3. Every query searches every shard by beam search from the medoid and a few spread entry points. A task reads one
   shard and then the queries as a stream, so it never holds these; the beam widens with the root of the shard's size; only beyond ``BLOCK_QUERIES`` queries is a shard
   given to a second task. The best of all shards win.

All rows are indexed. Distances are Euclidean in double precision on the given vectors. Work grows with
queries times shards: from ``SHARDS * MOST_ROWS`` vectors on, with the square of their number over
``100 * MOST_ROWS``. Very long vectors make smaller shards. Defined cases: vectors that are null, empty, zero, or that hold null or non-finite
components take no part; vectors of different lengths have no distance and never meet; fewer candidates
give fewer rows; ties go to the smaller id; a repeated id counts once per distinct vector, and asks with
its least one; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import workers_import
from .common import durable, map_arrow, table

TOP = 10
EVERY = 100
SHARDS = 16
LEAST_ROWS = 5000
MOST_ROWS = 200_000
MOST_BYTES = 512 << 20
BLOCK_QUERIES = 1_000_000
DEGREE = 32
BUILD_BEAM = 64
SEARCH_BEAM = 96
ALPHA = 1.2
ENTRIES = 16
WIDTH = 4  # nodes expanded a step


def beam_search(x: np.ndarray, graph: np.ndarray, entries: np.ndarray, queries: np.ndarray, beam: int, visits: bool = False):
    """Greedy beam search of all queries at once. Returns ids and squared distances, nearest first
    (-1 and inf where fewer were met), and the expanded nodes if ``visits``."""
    nq, n = len(queries), len(x)
    norms = np.einsum("ij,ij->i", x, x)
    qn = np.einsum("ij,ij->i", queries, queries)
    seen = np.zeros((nq, n), bool)
    ids = np.full((nq, beam), -1, np.int64)
    dist = np.full((nq, beam), np.inf)
    done = np.zeros((nq, beam), bool)
    first = np.unique(entries)[:beam]
    ids[:, : len(first)] = first
    dist[:, : len(first)] = norms[first][None, :] + qn[:, None] - 2 * queries @ x[first].T
    seen[:, first] = True
    order = np.argsort(dist, axis=1, kind="stable")
    ids, dist = np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)
    path = []
    live = np.arange(nq)
    while len(live):
        waiting = np.where(done[live] | (ids[live] < 0), np.inf, dist[live])
        pick = np.argsort(waiting, axis=1, kind="stable")[:, :WIDTH]
        ok = np.isfinite(np.take_along_axis(waiting, pick, 1))
        on = ok.any(axis=1)
        live, pick, ok = live[on], pick[on], ok[on]
        if not len(live):
            break
        at = live[:, None]
        nodes = np.where(ok, ids[at, pick], -1)
        done[at, pick] |= ok
        if visits:
            step = np.full((nq, WIDTH), -1, np.int64)
            step[live] = nodes
            path.append(step)
        near = np.where(nodes[:, :, None] >= 0, graph[np.maximum(nodes, 0)], -1).reshape(len(live), -1)
        fresh = (near >= 0) & ~seen[at, np.maximum(near, 0)]
        # one node may come from two expanded ones: keep its first place
        by = np.argsort(near, axis=1, kind="stable")
        ranked = np.take_along_axis(near, by, 1)
        twice = np.zeros_like(fresh)
        np.put_along_axis(twice, by[:, 1:], ranked[:, 1:] == ranked[:, :-1], 1)
        fresh &= ~twice
        r, c = np.nonzero(fresh)
        node = near[r, c]
        q = live[r]
        seen[q, node] = True
        d = np.full(near.shape, np.inf)
        d[r, c] = np.maximum(norms[node] + qn[q] - 2 * np.einsum("ij,ij->i", x[node], queries[q]), 0)
        all_d = np.concatenate([dist[live], d], axis=1)
        best = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
        dist[live] = np.take_along_axis(all_d, best, 1)
        ids[live] = np.take_along_axis(np.concatenate([ids[live], np.where(fresh, near, -1)], axis=1), best, 1)
        done[live] = np.take_along_axis(np.concatenate([done[live], np.zeros(near.shape, bool)], axis=1), best, 1)
    return (ids, dist, np.concatenate(path, axis=1) if path else np.zeros((nq, 0), np.int64)) if visits else (ids, dist)


def robust_prune(x: np.ndarray, nodes: np.ndarray, cands: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """Diverse out-edges of every node among its candidates (-1: none), nearest first."""
    cands = np.where(cands == nodes[:, None], -1, cands)
    by = np.argsort(cands, axis=1, kind="stable")
    ranked = np.take_along_axis(cands, by, 1)
    ranked[:, 1:][ranked[:, 1:] == ranked[:, :-1]] = -1
    points = x[np.maximum(ranked, 0)]
    d = ((points - x[nodes][:, None, :]) ** 2).sum(axis=2)
    d[ranked < 0] = np.inf
    by = np.argsort(d, axis=1, kind="stable")
    ranked, d = np.take_along_axis(ranked, by, 1), np.take_along_axis(d, by, 1)
    points = np.take_along_axis(points, by[:, :, None], 1)
    alive = np.isfinite(d)
    out = np.full((len(nodes), degree), -1, np.int64)
    rows = np.arange(len(nodes))
    for k in range(degree):
        some = alive.any(axis=1)
        if not some.any():
            break
        pick = alive.argmax(axis=1)
        out[some, k] = ranked[rows[some], pick[some]]
        apart = ((points - points[rows, pick][:, None, :]) ** 2).sum(axis=2)
        alive &= alpha * alpha * apart > d
        alive[rows, pick] = False
    return out


def build_graph(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """``(graph, entries)`` over the rows of ``x``."""
    n = len(x)
    graph = np.full((n, degree), -1, np.int64)
    medoid = int(((x - x.mean(axis=0)) ** 2).sum(axis=1).argmin())
    order = np.concatenate([[medoid], [i for i in np.random.default_rng(seed).permutation(n) if i != medoid]]).astype(np.int64)
    entries = order[:ENTRIES]
    filled, size = 1, 1
    while filled < n:
        batch = order[filled : filled + size]
        ids, _, path = beam_search(x, graph, order[: min(filled, ENTRIES)], x[batch], beam, visits=True)
        # nodes of one batch do not see each other through the graph: offer the batch neighbours in order
        peers = np.stack([np.roll(batch, s) for s in range(1, min(len(batch), 5))], axis=1) if len(batch) > 1 else np.zeros((len(batch), 0), np.int64)
        graph[batch] = robust_prune(x, batch, np.concatenate([ids, path, peers], axis=1), degree)
        src = np.repeat(batch, degree)
        dst = graph[batch].ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        by = np.argsort(dst, kind="stable")
        src, dst = src[by], dst[by]
        heads, starts = np.unique(dst, return_index=True)
        full_nodes, full_cands = [], []
        for node, more in zip(heads.tolist(), np.split(src, starts[1:])):
            own = graph[node][graph[node] >= 0]
            all_ = np.unique(np.concatenate([own, more]))
            if len(all_) <= degree:
                graph[node, : len(all_)] = all_
            else:
                full_nodes.append(node)
                full_cands.append(all_)
        if full_nodes:
            width = max(map(len, full_cands))
            for s in range(0, len(full_nodes), 512):
                nodes = np.array(full_nodes[s : s + 512])
                cands = np.full((len(nodes), width), -1, np.int64)
                for i, c in enumerate(full_cands[s : s + 512]):
                    cands[i, : len(c)] = c
                graph[nodes] = robust_prune(x, nodes, cands, degree)
        filled += len(batch)
        size = min(max(filled // 2, 1), 512)
    return graph, entries


# --- tables ----------------------------------------------------------------------------------


def _usable(vectors: DataFrame) -> DataFrame:
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    fine = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    return rows.where(fine & F.exists("v", lambda e: e != 0))


def _rows(vec: list[bytes], ids: list[list[int]]) -> pa.RecordBatch:
    import xxhash

    h = np.array([xxhash.xxh64_intdigest(b, 9) >> 1 for b in vec], np.int64)
    return pa.RecordBatch.from_arrays([pa.array(h), pa.array(vec, pa.binary()), pa.array(ids, pa.list_(pa.int64()))], ["h", "vec", "ids"])


def _combine(held: int) -> Callable:
    """Distinct vectors of a task with their ``held`` least ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, list[int]] = {}
        for batch in batches:
            lists = batch.column("v")
            flat, offsets = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            for vec_id, a, b in zip(batch.column("vec_id").to_pylist(), offsets.tolist(), offsets[1:].tolist()):
                known.setdefault(flat[a:b].tobytes(), []).append(vec_id)
            if len(known) >= 50_000:
                yield _rows(list(known), [sorted(set(i))[:held] for i in known.values()])
                known = {}
            elif sum(map(len, known.values())) > 4 * held * len(known) + 50_000:
                known = {k: sorted(set(i))[:held] for k, i in known.items()}
        if known:
            yield _rows(list(known), [sorted(set(i))[:held] for i in known.values()])

    return run


def _merge(held: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids = None, []
        out: list[tuple[bytes, list[int]]] = []
        for batch in batches:
            for vec, more in zip(batch.column("vec").to_pylist(), batch.column("ids").to_pylist()):
                if vec != now:
                    if now is not None:
                        out.append((now, ids))
                    now, ids = vec, []
                ids = sorted({*ids, *more})[:held]
            if len(out) >= 10_000:
                yield _rows([v for v, _ in out], [i for _, i in out])
                out = []
        if now is not None:
            out.append((now, ids))
        if out:
            yield _rows([v for v, _ in out], [i for _, i in out])

    return run


def _build(t: pa.Table) -> pa.Table:
    t = t.sort_by([("h", "ascending"), ("vec", "ascending")])
    x = np.frombuffer(b"".join(t.column("vec").to_pylist()), np.float64).reshape(t.num_rows, -1)
    graph, entries = build_graph(x)
    entry = np.zeros(len(x), bool)
    entry[entries] = True
    there = graph >= 0
    edges = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], there.sum(axis=1).cumsum()]), pa.int32()), pa.array(graph[there], pa.int64()))
    return pa.table({"shard": t.column("shard"), "node": pa.array(np.arange(len(x))), "vec": t.column("vec"), "ids": t.column("ids"), "edges": edges, "entry": pa.array(entry)})


def shard_counts(sizes: dict[int, int], shard_rows: int | None = None) -> list[tuple[int, int, int]]:
    """``(length, first shard, shards)`` for the number of distinct vectors of each length."""
    out, first = [], 0
    for d, n in sorted(sizes.items()):
        rows = max(1, min(shard_rows or MOST_ROWS, MOST_BYTES // (8 * max(d, 1)), max(shard_rows or LEAST_ROWS, -(-n // SHARDS))))
        out.append((d, first, max(1, -(-n // rows))))
        first += out[-1][2]
    return out


def build_index(vectors: DataFrame, top: int = TOP, shard_rows: int | None = None) -> tuple[DataFrame, list[tuple[int, int, int]]]:
    """Index rows ``shard, node, vec, ids, edges, entry``, and the shards of each length."""
    spark = vectors.sparkSession
    workers_import(spark)
    partial = map_arrow(_usable(vectors), _combine(top + 1), "h long, vec binary, ids array<long>")
    distinct = durable(map_arrow(partial.repartition("h").sortWithinPartitions("h", "vec"), _merge(top + 1), "h long, vec binary, ids array<long>"), "ann-distinct")
    d = (F.octet_length("vec") / 8).cast("int")
    layout = shard_counts({r.d: r["count"] for r in distinct.groupBy(d.alias("d")).count().collect()}, shard_rows)  # one row a length
    shards = sum(n for _, _, n in layout)
    sized = F.broadcast(spark.createDataFrame(layout, "d int, first int, n int"))
    dealt = distinct.withColumn("d", d).join(sized, "d").select("h", "vec", "ids", (F.col("first") + F.pmod(F.col("h"), F.col("n"))).cast("int").alias("shard"))
    # a fixed number of partitions: small shards are much work, so none may be merged into one task by size
    index = dealt.repartition(max(1, shards), "shard").groupBy("shard").applyInArrow(_build, "shard int, node long, vec binary, ids array<long>, edges array<long>, entry boolean")
    return durable(index, "ann-index"), layout


def _vectors(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(rows, -1)


class _Shard:
    """One shard's graph, as a task searches it."""

    def __init__(self, t: pa.Table):
        t = t.sort_by("node")
        self.x = _vectors(t.column("vec"), t.num_rows)
        edges = t.column("edges").combine_chunks()
        counts = np.diff(edges.offsets.to_numpy())
        self.graph = np.full((len(self.x), DEGREE), -1, np.int64)
        self.graph[np.arange(DEGREE)[None, :] < counts[:, None]] = edges.flatten().to_numpy()
        self.ids = t.column("ids").to_pylist()
        self.entries = np.flatnonzero(t.column("entry").to_numpy(zero_copy_only=False))

    def nearest(self, asked: list[int], points: np.ndarray, top: int, beam: int) -> Iterator[pa.RecordBatch]:
        """The best of the shard for some queries, piece by piece."""
        x = self.x
        step = max(16, min(256, 32_000_000 // len(x)))  # a search marks the nodes that it has seen
        for s in range(0, len(points), step):
            out: list[tuple[int, int, float]] = []
            found, _ = beam_search(x, self.graph, self.entries, points[s : s + step], max(beam_for(len(x), beam), top))
            for k, nodes in enumerate(found, s):
                nodes = nodes[nodes >= 0]
                d = np.sqrt(((x[nodes] - points[k]) ** 2).sum(axis=1))
                near: list[tuple[float, int]] = []
                for i in np.argsort(d, kind="stable"):
                    if len(near) >= top and d[i] > sorted(near)[top - 1][0]:
                        break
                    near += [(float(d[i]), v) for v in self.ids[nodes[i]] if v != asked[k]]
                out += [(asked[k], v, score) for score, v in sorted(near)[:top]]
            yield _found(out)


def _searched(batches: Iterator[pa.RecordBatch], top: int, beam: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard, each shard's nodes before its queries: the nodes are held, the queries pass."""
    number, nodes, shard = None, [], None
    for batch in batches:
        shards, asks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "asks"))
        edges = np.flatnonzero((shards[1:] != shards[:-1]) | (asks[1:] != asks[:-1])) + 1
        for a, z in zip([0, *edges], [*edges, batch.num_rows]):
            if a == z:
                continue
            piece = batch.slice(int(a), int(z - a))
            if shards[a] != number:
                number, nodes, shard = shards[a], [], None
            if not asks[a]:
                if shard is None:  # else the nodes come again, for a further block of queries
                    nodes.append(piece)
                continue
            if shard is None and nodes:
                shard, nodes = _Shard(pa.Table.from_batches(nodes)), []
            if shard is not None:
                yield from shard.nearest(piece.column("query_id").to_pylist(), _vectors(piece.column("vec"), piece.num_rows), top, beam)


def beam_for(rows: int, beam: int = SEARCH_BEAM) -> int:
    """The beam of a shard: as wide as ``beam`` up to ``LEAST_ROWS`` nodes, then growing with the root of their number, since
    a beam of one width finds less in a larger graph."""
    return round(beam * max(1.0, (rows / LEAST_ROWS) ** 0.5))


def _found(rows: list[tuple[int, int, float]]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], ["query_id", "vec_id", "score"])


def search(index: DataFrame, layout: list[tuple[int, int, int]], queries: DataFrame, top: int = TOP, beam: int = SEARCH_BEAM) -> DataFrame:
    """``queries``: ``query_id, v``. Returns ``query_id, rank, vec_id, score``."""
    spark = index.sparkSession
    workers_import(spark)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v")
            raw, ends = lists.flatten().to_numpy(zero_copy_only=False).tobytes(), (np.diff(lists.offsets.to_numpy()) * 8).cumsum().tolist()
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), pa.array([raw[a:z] for a, z in zip([0, *ends], ends)], pa.binary())], ["query_id", "vec"])

    packed = map_arrow(queries.select("query_id", "v"), pack, "query_id long, vec binary")
    blocks = max(1, -(-queries.count() // BLOCK_QUERIES))
    sized = F.broadcast(spark.createDataFrame(layout, "d int, first int, n int"))  # one row a length
    asked = packed.withColumn("d", (F.octet_length("vec") / 8).cast("int")).join(sized, "d").withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    asked = asked.select("query_id", "vec", "block", F.explode(F.expr("sequence(first, first + n - 1)")).alias("shard"))
    held = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))) if blocks > 1 else F.lit(0))
    both = held.withColumn("asks", F.lit(False)).unionByName(asked.withColumn("asks", F.lit(True)), allowMissingColumns=True)
    # a fixed number of partitions: the work is in the searches, so none may be merged into one task by size
    dealt = both.repartition(max(1, sum(n for _, _, n in layout)) * blocks, "shard", "block").sortWithinPartitions("shard", "block", "asks")
    columns = ["shard", "block", "asks", "query_id", "node", "vec", "ids", "edges", "entry"]
    found = map_arrow(dealt.select(*columns), lambda batches: _searched(batches, top, beam), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, every: int = EVERY, top: int = TOP) -> DataFrame:
    index, layout = build_index(vectors, top)
    queries = _usable(vectors).where(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v"))
    return search(index, layout, queries, top)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
