"""Recall of the registered search on the given vectors, lengths apart, repeated ids, clashing names."""

import numpy as np
from veristrata.llm import ann

SF = "/root/testdata/sf0.1"


def test_recall_of_the_query_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ann, "LEAST_ROWS", 300)  # several shards, as on more vectors
    got = ann.query(spark, SF).collect()
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect() if r.embedding is not None]
    rows = [(i, v) for i, v in rows if len(v) and np.isfinite(v).all() and v.any()]
    ids, x = np.array([i for i, _ in rows]), np.stack([v for _, v in rows])
    hits = total = 0
    for q, point in rows:
        if q % 100 == 0:
            d = np.sqrt(((x - point) ** 2).sum(axis=1))
            true = [int(ids[k]) for k in np.lexsort((ids, d)) if ids[k] != q][:10]
            own = [g for g in got if g.query_id == q]
            assert sorted(g.rank for g in own) == list(range(1, 11))
            hits += len({g.vec_id for g in own} & set(true))
            total += 10
    assert total and hits >= 0.9 * total


def test_lengths_repeated_ids_and_ties(spark):
    rows = [(i, [float(i), 1.0], "a") for i in range(40)] + [(100 + i, [float(i), 0.0, 1.0], "b") for i in range(30)]
    rows += [(100, [50.0, 1.0], "c"), (20, [20.0, 1.0], "again"), (0, [9.0, 9.0], "other")]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string")).collect()
    by = {q: [g.vec_id for g in sorted(got, key=lambda g: g.rank) if g.query_id == q] for q in (0, 100)}
    # id 0 asks with [0, 1], its least vector; id 100 with [0, 0, 1], so with the vectors of length 3
    assert by[0] == list(range(1, 11)) and by[100] == list(range(101, 111))
    far = [(i, [float((-1) ** i), 0.0]) for i in range(1, 31)] + [(200, [0.0, 0.5])]
    assert [g.vec_id for g in sorted(ann.nearest(spark.createDataFrame(far, "vec_id long, embedding array<double>")).collect(), key=lambda g: g.rank)] == list(range(1, 11))


def test_shards_follow_the_size():
    assert ann.shard_counts({64: 30_000}) == [(64, 0, 6)] and ann.shard_counts({64: 160_000}) == [(64, 0, 16)]
    assert ann.shard_counts({3: 10, 64: 32_000_000}) == [(3, 0, 1), (64, 1, 160)] and ann.shard_counts({}) == []


def test_queries_pass_shards_in_blocks(spark, monkeypatch):
    """Several blocks of queries a shard, several shards a task: the same rows as in one block."""
    r = np.random.default_rng(2)
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(r.normal(size=(400, 6)))], "vec_id long, embedding array<double>")
    want = sorted(map(tuple, ann.nearest(rows, every=3).collect()))
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 20)
    monkeypatch.setattr(ann, "map_arrow", lambda df, fn, schema: _one_task(df, fn, schema))
    assert sorted(map(tuple, ann.nearest(rows, every=3).collect())) == want and len(want) == 134 * 10


def _one_task(df, fn, schema):
    from veristrata.llm import common

    if "asks" in df.columns:
        df = df.coalesce(1).sortWithinPartitions("shard", "block", "asks")
    return common.map_arrow(df, fn, schema)


def test_long_vectors_make_smaller_shards():
    assert ann.shard_counts({1536: 4_000_000}) == [(1536, 0, 92)] and ann.shard_counts({1 << 27: 3}) == [(1 << 27, 0, 3)]


def test_beams_widen_with_the_shard():
    assert [ann.beam_for(n) for n in (1, 5_000, 20_000, 200_000)] == [96, 96, 192, 607]
