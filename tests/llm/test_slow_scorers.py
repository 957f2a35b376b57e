"""The rows of the two classifiers' queries against scorers that read one text at a time, value by value."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from veristrata.llm import language_id, pu_quality, simhash

SF = "/root/testdata/sf0.001"


def _style(raw):
    """The sixteen features by their definitions."""
    words, lines, size = raw.split(), raw.split(b"\n"), max(len(raw), 1)
    n = max(len(words), 1)
    letters = max(sum(65 <= c <= 90 or 97 <= c <= 122 or c >= 0xC2 for c in raw), 1)
    count = lambda chars: sum(c in chars for c in raw)
    triples = Counter(zip(words, words[1:], words[2:]))
    inside = {i + k for i in range(len(words) - 2) if triples[tuple(words[i : i + 3])] > 1 for k in range(3)}
    kinds = Counter(words)
    seen, again = set(), 0
    for line in lines:
        again += bool(line.strip()) and line in seen
        seen.add(line)
    symbols = count(b"#*$%&|<>")
    return [symbols / n, symbols / size, sum(65 <= c <= 90 for c in raw) / letters, count(b"!") / n, count(b"|") / n, len(inside) / n, sum(a == b for a, b in zip(words, words[1:])) / n, len(kinds) / n, max(kinds.values(), default=0) / n, math.log1p(len(words)),
            (letters if any(65 <= c <= 90 or 97 <= c <= 122 or c >= 0xC2 for c in raw) else 1) / n, sum(48 <= c <= 57 for c in raw) / size, again / len(lines), math.log1p(len(words) / len(lines)), count(b".!?") / n, letters / size]


def _quality(model, raw):
    x = [min(6.0, max(-6.0, (float(np.float32(v)) - m) / s)) for v, m, s in zip(_style(raw), model["mean"], model["std"])]
    net = model["net"]
    hidden = [math.tanh(sum(v * net["w1"][i][j] for i, v in enumerate(x)) + net["b1"][j]) for j in range(len(net["b1"]))]
    z = sum(h * w for h, w in zip(hidden, net["w2"])) + float(net["b2"][0])
    return 1 / (1 + math.exp(-min(40.0, max(-40.0, model["a"] * z + model["b"]))))


def test_quality_of_every_row(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    model = pu_quality.train(docs, labels)
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    got = pu_quality.query(spark, SF).collect()
    assert sorted(g.doc_id for g in got) == sorted(texts)
    for g in got:
        want = _quality(model, texts[g.doc_id])
        assert g.score == pytest.approx(want, abs=2e-6) and g.held_out == (zlib.crc32(str(g.doc_id).encode()) % 5 == 0)
        assert g.predicted == int(g.score >= 0.3)
    odd = [(i, t) for i, t in enumerate([None, "", "one", "A B A B A B!", "\n\n", "x|y # 12\nx|y # 12", "é " * 9])]
    for r in pu_quality.score(spark.createDataFrame(odd, "doc_id long, text string"), model).collect():
        assert r.score == pytest.approx(_quality(model, (odd[r.doc_id][1] or "").encode()), abs=2e-6)


def _language(model, text):
    """Votes over single n-grams, one text at a time."""
    if not text or not any(map(str.isalpha, text)):
        return "und", 0.0
    data = (" " + " ".join(re.sub(r"[^\w]|[\d_]", " ", text.lower()).split()) + " ").encode() + b"  "
    codes = []
    for i in range(len(data) - 3):
        two = data[i] << 8 | data[i + 1]
        three = two << 8 | data[i + 2]
        codes += [((two + 1) * 0x9E3779B1 & 0xFFFFFFFF) >> 16, ((three + (1 << 25)) * 0x9E3779B1 & 0xFFFFFFFF) >> 16]

    def vote(name, n):
        votes, total, least = [0] * n, [0.0] * n, [math.inf] * n
        for a, b, k in model.pairs[name]:
            at, value, bias = model.machines[k]
            weight = dict(zip(at.tolist(), value.tolist()))
            m = sum(weight.get(c, 0.0) for c in codes) / len(codes) + bias
            votes[a if m > 0 else b] += 1
            for own, sign in ((a, m), (b, -m)):
                total[own] += sign
                least[own] = min(least[own], sign)
        best = max(range(n), key=lambda i: votes[i] + 1e-3 * math.tanh(total[i]))
        return best, least[best]

    family, sure = vote("", len(model.families))
    members = model.members[model.families[family]]
    if len(members) > 1:
        own, inner = vote(model.families[family], len(members))
        sure = min(sure, inner)
    else:
        own = 0
    return members[own], 1 / (1 + math.exp(-min(40.0, max(-40.0, 3 * sure))))


def test_language_of_every_row(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.train(docs)
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = language_id.query(spark, SF).collect()
    assert sorted(g.doc_id for g in got) == sorted(texts)
    for g in got:
        lang, score = _language(model, texts[g.doc_id])
        assert (g.lang_pred, g.held_out) == (lang, zlib.crc32(str(g.doc_id).encode()) % 4 == 2) and g.score == pytest.approx(score, abs=1e-6)
    # a score depends on its text alone, whatever stands beside it
    pair = spark.createDataFrame([(1, texts[0]), (2, "zzz zz"), (3, None), (4, "12 _ 34")], "doc_id long, text string")
    alone = {r.doc_id: r.score for d in (pair.where("doc_id = 1"), pair.where("doc_id = 2")) for r in language_id.identify(d, model).collect()}
    beside = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(pair.coalesce(1), model).collect()}
    assert all(beside[i][1] == alone[i] for i in alone) and beside[3] == beside[4] == ("und", 0.0)
    empty = docs.limit(0)
    assert language_id.identify(empty, model).count() == 0 and pu_quality.score(empty, None).count() == 0


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    r = np.random.default_rng(4)
    texts = [" ".join(r.choice(["aa", "bbb", "c", "Dddd"], 900)), "word " * 3, "\n", "a b c d", "x" * 500 + " y z", "\t".join("abcdefgh"), " lead and trail \n"]
    whole = [simhash.fingerprint(t) for t in texts]
    pieces = simhash._segments
    for size in (1, 7, 64):
        monkeypatch.setattr(simhash, "_segments", lambda raw, size=size: pieces(raw, size))
        assert [simhash.fingerprint(t) for t in texts] == whole
