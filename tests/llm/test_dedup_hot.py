"""Hot anchors, keys that collide, repeated ids: the same rows as brute force; nothing stays behind."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_dedup import _components, _fingerprint, _removed, _texts
from veristrata.llm import common, simhash, suffix_dedup


def _passages(n=150):
    r = np.random.default_rng(8)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz     "))
    free = lambda k: "".join(r.choice(letters, k))
    common_ = [free(k) for k in (40, 70, 95, 99, 100, 101, 140)]
    return [free(int(r.integers(0, 60))) + "".join(common_[int(r.integers(7))] + free(int(r.integers(0, 40))) for _ in range(3)) for _ in range(n)]


def _rows(spark, texts):
    return sorted((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in suffix_dedup.removed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect())


@pytest.mark.parametrize("hot", [2, 20, 10_000])
def test_hot_anchors_lose_no_repeat(spark, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    texts = [*_passages(), *["ab" * 300, "q" * 450, "ab" * 200]]
    want = sorted(_removed(list(enumerate(texts))))
    assert _rows(spark, texts) == want and sum(w[2] for w in want) > 5000


def test_one_line_in_many_surroundings_is_cut_into_windows(spark, monkeypatch):
    """Its class is hot after the first split as well: single windows part, and no group keeps all surroundings."""
    monkeypatch.setattr(suffix_dedup, "HOT", 30)
    r = np.random.default_rng(3)
    free = lambda k: "".join(r.choice(list("abcdefghijklmnopqrstuvwxyz"), k))
    line = free(93)
    texts = [free(40) + line + free(40) for _ in range(120)] + [free(20) + line + "xyz" * 9 for _ in range(60)] + [free(9) + "0123456" + line + free(9) for _ in range(9)]
    assert _rows(spark, texts) == sorted(_removed(list(enumerate(texts))))
    sizes = {}  # the classes of one anchor in the line, and their windows
    for t in texts:
        at = t.index(line)
        for key, x in suffix_dedup._split(7, (0, 0, max(0, at - 7), 7, t.encode()[max(0, at - 7) : at + 107])):
            sizes.setdefault(key, []).append(x)
    key, members = max(sizes.items(), key=lambda kv: len(kv[1]))
    assert len(members) > 30
    single = {}
    for x in members:
        for k, y in suffix_dedup._windows(key, x):
            single.setdefault((k, y[3], y[4]), []).append(y)
    assert max(len(v) for k, v in single.items()) < len(members) and all(len({y[4] for y in v}) == 1 for v in single.values())


@pytest.mark.parametrize("most", [40, 200])
def test_buckets_are_split_until_none_is_large(spark, most):
    r = np.random.default_rng(5)
    fps = {0xABC0000000000000 | int(x) for x in r.integers(0, 1 << 50, 300)}  # one bucket by their first bits
    for f in sorted(fps)[:120]:
        for _ in range(3):
            fps.add(f ^ sum(1 << int(b) for b in r.choice(50, int(r.integers(1, 6)), replace=False)))
    rows = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in sorted(fps)], "fp long")
    keyed = simhash._keyed(rows, simhash.block_masks(4, 1), 4, most)
    assert max(x["count"] for x in keyed.groupBy("part", "value").count().collect()) <= most
    index = {f: i for i, f in enumerate(sorted(fps))}
    values = sorted(fps)
    want = _components(index.values(), lambda a, b: (values[a] ^ values[b]).bit_count() <= 4)
    got = _components_of([(x.child, x.parent) for x in simhash.near_links(rows, most=most).collect()], index)
    assert got == {i: want[i] for i in index.values()} and len(set(want.values())) < len(want)


def _components_of(edges, index):
    up = {i: i for i in index.values()}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        x, y = root(index[a & (1 << 64) - 1]), root(index[b & (1 << 64) - 1])
        up[max(x, y)] = min(x, y)
    return {i: root(i) for i in up}


def test_texts_with_one_key_stay_apart(spark, monkeypatch):
    keyed = suffix_dedup._keyed
    monkeypatch.setattr(suffix_dedup, "_keyed", lambda docs: keyed(docs).withColumn("tkey", F.lit(7).cast("long")))
    texts = _passages(40)
    assert _rows(spark, texts) == sorted(_removed(list(enumerate(texts))))


def test_nothing_stays_behind(spark):
    before = {t.name for t in spark.catalog.listTables()}
    suffix_dedup.removed(spark.createDataFrame(list(enumerate(_passages(10))), "doc_id long, text string")).count()
    assert {t.name for t in spark.catalog.listTables()} == before
    assert not any("suffix-texts" in path for _, path in common._scratch)


def test_repeated_and_null_ids_keep_one_row_a_component(spark):
    texts = _texts(40)
    rows = [(i % 25, t, "x") for i, t in enumerate(texts)] + [(None, texts[7], "y"), (None, texts[7], "y"), (None, "only here without an id " * 9, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    fps = {i: _fingerprint(t) for i, (_, t, _) in enumerate(rows)}
    group = _components(fps, lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 4)
    stay = simhash.keep_first(docs).collect()
    number = {(d, t): i for i, (d, t, _) in enumerate(rows)}
    assert sorted(group[number[s.doc_id, s.text]] for s in stay) == sorted(set(group.values()))
    for s in stay:  # the least id of its component
        own = [d for i, (d, _, _) in enumerate(rows) if group[i] == group[number[s.doc_id, s.text]]]
        assert s.doc_id == min((d for d in own if d is not None), default=None)
    assert sorted(map(repr, stay)) == sorted(map(repr, simhash.keep_first(docs.repartition(5)).collect()))
