"""The pipeline's rows against a brute-force version of its stages, and its defined cases."""

import hashlib
import math

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from test_dedup import _components, _fingerprint
from veristrata.llm import bpe, mixing, pu_quality

SF = "/root/testdata/sf0.001"


def _near(rows):
    fps = {i: _fingerprint(r["text"]) for i, r in enumerate(rows)}
    group = _components(fps, lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 4)
    order = lambda i: (rows[i]["doc_id"] is None, rows[i]["doc_id"] or 0, hashlib.md5((rows[i]["text"] or "").encode()).hexdigest())
    return [rows[min((i for i in fps if group[i] == g), key=order)] for g in sorted(set(group.values()))]


def _cut(rows):
    seen, out = set(), []
    for r in sorted(rows, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, hashlib.sha256((r["text"] or "").encode()).digest())):
        raw = (r["text"] or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - 99):
            w = raw[p : p + 100]
            if w in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(c for c, g in zip(raw, gone) if not g).decode("utf-8", "ignore")
        if kept.encode().split() and not (len(raw) >= 100 and all(gone)):
            out.append(r | {"text": kept, "n_chars": len(kept)})
    return out


def _mix(rows):
    sources: dict = {}
    for r in rows:
        key = "mix-" + ("null" if r["doc_id"] is None else str(r["doc_id"])) + "-" + hashlib.md5((r["text"] or "").encode()).hexdigest()
        sources.setdefault(r["source"], []).append((int(hashlib.md5(key.encode()).hexdigest()[:13], 16), len((r["text"] or "").encode().split()), r))
    names = sorted(sources, key=lambda s: (s is None, s or ""))
    sizes = [sum(x[1] for x in sources[s]) for s in names]
    out = []
    for name, size, target in zip(names, sizes, mixing.water_fill(sizes, [(5, 2, 1)[i % 3] for i in range(len(names))])):
        words, at = math.floor(target + 0.5), 0
        for _, n, r in sorted(sources[name], key=lambda x: x[:2]):
            if n:
                taken = words // size * n + max(0, min(at + n, words % size) - at)
                out += [r] * math.floor(taken / n + 0.5)
            at += n
    return out


@pytest.fixture(scope="module")
def model(spark):
    return pu_quality.train(*(spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels")))


def test_rows_equal_brute_force(spark, model):
    rows = [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    good = [r for r in rows if pu_quality.score_texts(model, [(r["text"] or "").encode()])[0] >= pu_quality.THRESHOLD]
    near = _near(good)
    cut = _cut(near)
    mixed = _mix(cut)
    assert len(rows) > len(good) > len(near) >= len(cut) > 0
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.tokenizer(path, public_tokenizers.PATTERN).ids, special_tokens={})
    want = sorted((r["doc_id"], np.array(library.encode_ordinary(r["text"]), "<u4").tobytes()) for r in mixed)
    got = sorted((r.doc_id, bytes(r.ids)) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == want
    sizes = {}
    for r in cut:
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(r["text"].encode().split())
    targets = dict(zip(names := sorted(sizes), mixing.water_fill([sizes[n] for n in names], [(5, 2, 1)[i % 3] for i in range(len(names))])))
    for name, target in targets.items():  # whole documents come within half of one of the target
        own = [len(r["text"].encode().split()) for r in mixed if r["source"] == name]
        most = max(len(r["text"].encode().split()) for r in cut if r["source"] == name)
        assert abs(sum(own) - target) <= most / 2 + 1


def test_stages_on_odd_tables(spark, tmp_path):
    text = "A plain sentence of some words that ends here as it should. " * 3
    rows = [(1, text, "s", "a", 1), (1, text, "s", "a", 1), (2, None, None, None, None), (None, text + "x", "s", None, 2), (None, None, "s", "b", None), (3, "", "s", "b", 0), (4, " \n", "s", "b", 2), (5, "word " * 200_000, "s", "b", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clash = docs.selectExpr("*", "doc_id as h", "text as fp", "source as tid", "1 as taken", "2 as digest", "3 as times", "4 as __v")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for case, given in enumerate((docs, clash, docs.limit(0))):
        now = given
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, now, str(tmp_path))
            if name != "byte_bpe":
                assert out.columns == given.columns
            path = f"{tmp_path}/{name}-{case}"
            out.write.parquet(path)
            now = spark.read.parquet(path)
        ids = [r.doc_id for r in now.collect()]
        assert ids == [] if case == 2 else 5 in ids and 2 not in ids


def test_stages_with_missing_texts(spark, model):
    docs = spark.createDataFrame([(1, None, "a"), (None, None, "a"), (2, "only this one has words", None)], "doc_id long, text string, source string")
    assert [r.doc_id for r in mixing.repeat_by_mix(docs).collect()] in ([2], [2, 2])
    assert pu_quality.keep_good(docs, None).count() == 3
