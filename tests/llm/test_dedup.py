"""Near-duplicates, repeated passages and components against brute force."""

import hashlib

import numpy as np
import pytest
import xxhash
from veristrata.llm import simhash, suffix_dedup
from veristrata.llm.components import connected_components

WORDS = [f"w{i}" for i in range(400)]


def _texts(n=60, seed=3):
    r = np.random.default_rng(seed)
    shared = [" ".join(r.choice(WORDS, 40)) for _ in range(6)]
    out = []
    for i in range(n):
        kind = i % 6
        base = " ".join(r.choice(WORDS, int(r.integers(5, 160))))
        if kind == 1 and out:
            base = out[int(r.integers(len(out)))]
        elif kind == 2 and out:
            words = out[int(r.integers(len(out)))].split()
            if words:
                words[int(r.integers(len(words)))] = "changed"
            base = " ".join(words)
        elif kind in (3, 4):
            base = base[: len(base) // 2] + "\n" + shared[int(r.integers(6))] + " " + base[len(base) // 2 :]
        elif kind == 5:
            base = "abc" * int(r.integers(1, 80)) + "é" * int(r.integers(0, 90))
        out.append(base)
    return [*out, "", " \n", "one two"]


def _docs(spark, texts):
    rows = [(i, t, i, "clash") for i, t in enumerate(texts)] + [(3, texts[3], 1, "again"), (None, texts[5], 2, "x"), (500, None, 3, None), (501, None, 4, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, ord int, tkey string")


def _fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()]
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _components(fps, links):
    root = {k: k for k in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in fps:
        for b in fps:
            if links(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in fps}


def test_fingerprint():
    for text in [*_texts(), "A a\tB\x0bc D", None, "É é É é É"]:
        assert simhash.fingerprint(text) == _fingerprint(text)


@pytest.mark.parametrize("exact", [1, 2, 3])
def test_trie_finds_every_link(exact):
    r = np.random.default_rng(exact)
    values = []
    for base in r.integers(0, 2**63, 30, dtype=np.uint64):
        for _ in range(20):
            x = int(base) * 2
            for b in r.integers(0, 64, int(r.integers(0, 7))):
                x ^= 1 << int(b)
            values.append(x)
    values = np.unique(np.array(values, np.uint64))
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= 4
    brute = _components(range(len(values)), lambda a, b: near[a, b])
    whole = simhash.TrieJoin(values, np.array([0, len(values)])).roots()
    assert whole.tolist() == [brute[i] for i in range(len(values))]
    found = np.zeros_like(near)
    for mask in simhash.block_masks(4, exact):  # every link shares the bits of some mask
        found |= (values[:, None] & np.uint64(mask)) == (values[None, :] & np.uint64(mask))
    assert (found | ~near).all()


def test_components(spark):
    r = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in r.integers(0, 200, (150, 2))] + [(i, i + 1) for i in range(300, 340)] + [(900, i) for i in range(901, 940)] + [(None, 4), (5, 5)]
    rows = connected_components(spark.createDataFrame(edges, "child long, parent long")).collect()
    nodes = {x for e in edges for x in e if x is not None}
    pairs = {frozenset(e) for e in edges if None not in e}
    brute = _components(nodes, lambda a, b: frozenset((a, b)) in pairs)
    assert {x.node: x.root for x in rows} == {n: c for n, c in brute.items() if n != c}


@pytest.mark.parametrize("exact", [1, 2])
def test_near_duplicates(spark, exact, monkeypatch):
    monkeypatch.setattr(simhash, "blocks_for", lambda count, budget: exact)
    texts = _texts()
    docs = _docs(spark, texts)
    rows = simhash.near_duplicates(docs).collect()
    fps = {i: _fingerprint(t) for i, t in enumerate(texts)} | {500: 0, 501: 0}
    brute = _components(fps, lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 4)
    assert len(rows) == docs.count()
    for r in rows:
        if r.doc_id is not None:
            assert (r.fingerprint, r.component_id) == (f"{fps[r.doc_id]:016x}", brute[r.doc_id])
    stay = [r.doc_id for r in simhash.keep_first(docs).collect() if r.doc_id is not None]
    assert sorted(stay) == sorted({c for c in brute.values()})
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def _removed(docs):
    """By the definition, on all windows."""
    seen, out = {}, []
    for key, text in docs:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - 99):
            w = raw[p : p + 100]
            if w in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.setdefault(w, (key, p))
        kept = bytes(c for c, g in zip(raw, gone) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((key, len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def test_removed_bytes(spark):
    texts = _texts(120)
    docs = _docs(spark, texts)
    order = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda x: (x[0] is None, x[0] or 0))
    want = sorted(_removed(order), key=repr)
    got = sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.removed(docs).collect()], key=repr)
    assert got == want and sum(w[2] for w in want) > 1000
    assert suffix_dedup.removed(docs.limit(0)).count() == 0
    kept = suffix_dedup.keep_unrepeated(docs.where("doc_id is not null and doc_id <> 3")).collect()
    assert all(r.text.strip() for r in kept) and set(kept[0].asDict()) == {"doc_id", "text", "ord", "tkey"}


def test_long_and_periodic_text(spark):
    r = np.random.default_rng(1)
    long = " ".join(r.choice(WORDS, 60_000))
    rows = [(1, "ab" * 700), (2, long), (3, "x" + long[1000:150_000] + "y"), (4, "ab" * 90), (5, "q" * 99), (6, "q" * 100), (7, "q" * 101)]
    got = sorted((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in suffix_dedup.removed(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == _removed(rows)


def test_repeat_groups_are_maximal():
    text = b"the cat sat. the cat ran. a cat sat."
    starts = list(range(len(text)))
    left, right = [text[:i][::-1] for i in starts], [text[i:] for i in starts]
    found = {}
    for a, b, own in suffix_dedup.repeat_groups(left, right, 4):
        s = {text[starts[i] - a : starts[i] + b] for i in own}
        assert len(s) == 1
        found.setdefault(s.pop(), set()).update(starts[i] - a for i in own)
    assert found[b" cat sat."] == {3, 27} and found[b"the cat "] == {0, 13}
    for s, own in found.items():
        assert own == {i for i in starts if text.startswith(s, i)}
        assert len({text[i - 1 : i] if i else None for i in own}) > 1 or len(own) < 2
        assert len({text[i + len(s) : i + len(s) + 1] for i in own}) > 1
