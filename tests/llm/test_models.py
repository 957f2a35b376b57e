"""Rules, classifiers and language identification: counts by brute force, held-out accuracy, odd rows."""

import zlib
from collections import Counter

import numpy as np
import pytest
from veristrata.llm import language_id, line_crf, pu_quality
from veristrata.llm import textstats as ts

SF = "/root/testdata/sf0.001"
ODD = [None, "", " \n\t", "word", "a b c a b c a b c", "x\x0by\x0cz\r\nq", "l1 a\nl1 a\n\nl1 a\n ", "é" * 50 + " ü", "#*$ %&| <>", "same " * 3000, "日本 語 " * 40]


def _counts(text):
    text = text or ""
    words = [w.decode() for w in text.encode().split()]
    triples = Counter(zip(words, words[1:], words[2:]))
    again = [False] * len(words)
    for i in range(len(words) - 2):
        if triples[words[i], words[i + 1], words[i + 2]] > 1:
            again[i] = again[i + 1] = again[i + 2] = True
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.encode().split():
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, sum(again)


def _odd(spark):
    return spark.createDataFrame([(i, t, "s", 1) for i, t in enumerate(ODD)] + [(None, "no id", "s", 1), (3, "word", "s", 1)], "doc_id long, text string, score string, quality int")


def test_base_counts(spark):
    rows = line_crf.apply_rules(_odd(spark), line_crf.LineCrf()).collect()
    assert len(rows) == len(ODD) + 2
    for r in rows:
        text = ODD[r.doc_id] if r.doc_id is not None else "no id"
        want = _counts(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)
    assert line_crf.apply_rules(_odd(spark).limit(0), line_crf.LineCrf()).count() == 0


def test_triples_with_many_distinct_words(monkeypatch):
    texts = [b"a b c d a b c", b"q w e r t y q w e"]
    whole = ts.Batch(texts).in_repeated_triple()
    b = ts.Batch(texts)
    b.distinct = 2_000_001  # takes the path that ranks pairs first
    assert (b.in_repeated_triple() == whole).all() and whole.tolist() == [True] * 3 + [False] + [True] * 6 + [False] * 3 + [True] * 3


def test_viterbi_and_fit():
    r = np.random.default_rng(0)
    crf = line_crf.LineCrf(r.normal(size=(line_crf.N_FEATURES + 2, 2)))
    x = r.random((23, line_crf.N_FEATURES))
    starts = np.array([0, 1, 7, 15])
    got = crf.viterbi(x, starts)
    for a, b in zip(starts, [*starts[1:], 23]):
        score, move = crf._scores(x[a:b])
        best = max(range(2 ** (b - a)), key=lambda m: sum(score[i, m >> i & 1] for i in range(b - a)) + sum(move[m >> i & 1, m >> (i + 1) & 1] for i in range(b - a - 1)))
        assert got[a:b].tolist() == [best >> i & 1 for i in range(b - a)]
    labels = np.repeat([0, 1, 1, 0], np.diff([*starts, 23]))
    x[:, 1] = labels * 0.9
    assert (line_crf.LineCrf().fit(x, starts, labels).viterbi(x, starts) == labels).all()


def test_rules_keep_good_documents(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    rows = line_crf.apply_rules(docs, line_crf.train(docs, labels)).join(labels, "doc_id").collect()
    good = [r.kept for r in rows if r.quality == 1 and not r.base_failed]
    bad = [r.kept for r in rows if r.quality == 0]
    assert np.mean(good) > 0.95 and np.mean(bad) < 0.2


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    model = pu_quality.train(docs, labels)
    rows = pu_quality.score(docs, model).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) for r in rows)
    own = [r for r in rows if r.held_out]
    pos, neg = [r.score for r in own if r.quality == 1], [r.score for r in own if r.quality == 0]
    assert np.mean([p > n for p in pos for n in neg]) > 0.95 and np.mean([p >= 0.3 for p in pos]) > 0.95
    odd = pu_quality.score(_odd(spark), model).collect()
    assert len(odd) == len(ODD) + 2 and all(0 <= r.score <= 1 for r in odd)
    assert {r.score for r in pu_quality.score(_odd(spark), None).collect()} == {0.5}
    assert pu_quality.keep_good(_odd(spark), model).columns == _odd(spark).columns
    empty = docs.limit(0)
    assert pu_quality.train(empty, labels.limit(0)) is None and pu_quality.score(empty, model).count() == 0


def test_prior_estimate():
    r = np.random.default_rng(2)
    pos, mixed = r.normal(2, 1, 4000), np.concatenate([r.normal(2, 1, 2800), r.normal(-2, 1, 1200)])
    assert pu_quality.estimate_prior(pos, lambda steps: (mixed[None, :] >= steps[:, None]).sum(axis=1), len(mixed)) == pytest.approx(0.7, abs=0.05)


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.train(docs)
    rows = language_id.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    own = [r for r in rows if r.held_out]
    assert own and np.mean([r.lang == r.lang_pred for r in own]) > 0.97
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    odd = {r.doc_id: r for r in language_id.identify(_odd(spark), model).collect()}
    assert [odd[i].lang_pred for i in (0, 1, 2, 8)] == ["und"] * 4 and odd[0].score == 0
    assert all(0 <= r.score <= 1 for r in odd.values())
    assert {r.lang_pred for r in language_id.identify(_odd(spark), None).collect()} == {"und"}
    assert language_id.train(docs.limit(0)) is None
    assert model.families == ["germanic", "romance"]
