"""Line labels: planted boilerplate, mixed documents, the verdict against a brute-force decoder, long texts."""

import itertools

import numpy as np
import pytest
from veristrata.llm import line_crf
from veristrata.llm import textstats as ts

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return tuple(spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))


@pytest.fixture(scope="module")
def crf(tables):
    return line_crf.train(*tables)


def _states(crf, text):
    b = ts.Batch([text.encode()])
    x = line_crf.line_features(b, b.line_is_repeat(), b.in_repeated_triple(), crf.knows(line_crf.line_digests(b)))
    return crf.viterbi(x, np.array([0])), x


def test_documents_hold_both_states(tables, crf):
    docs, labels = tables
    rows = line_crf.apply_rules(docs, crf).join(labels, "doc_id").collect()
    mixed = [r for r in rows if 0 < r.content_share < 1]
    assert len(mixed) > 0.15 * len(rows)  # a fifth and more of the labelled documents
    assert np.mean([r.kept for r in rows if r.quality == 1 and not r.base_failed]) > 0.98
    assert np.mean([r.kept for r in rows if r.quality == 0]) < 0.05


def test_planted_boilerplate_is_found(tables, crf):
    docs, labels = tables
    good = [r.text.split("\n") for r in docs.join(labels.where("quality = 1"), "doc_id").orderBy("doc_id").collect() if r.text.count("\n") >= 7][:40]
    junk = ["BUY!! NOW!! BEST!! PRICE!! HERE!!", "home | about | press | jobs | help", "go*** to*** our### shop$$$ now&&&", "win win win win win win win", "Licensed under the Apache License, Version 2.0."]
    hit = missed = false = lines = 0
    for k, own in enumerate(good):
        text = [*own[:3], junk[k % 5], *own[3:6], junk[(k + 1) % 5], *own[6:]]
        states, _ = _states(crf, "\n".join(text))
        clean, _ = _states(crf, "\n".join(own))
        hit += (states[[3, 7]] == 0).sum()
        missed += (states[[3, 7]] == 1).sum()
        false += ((np.delete(states, [3, 7]) == 0) & (clean == 1)).sum()
        lines += len(own)
    assert hit >= 0.9 * (hit + missed) and false <= 0.05 * lines


def test_kept_equals_a_brute_force_decoder(spark, crf):
    r = np.random.default_rng(2)
    kinds = ["The words of a whole plain sentence end here as they should.", "TO!! BE!! OR!! NOT!!", "a | b | c | d", "x### y$$$ z&&&", "Short one", "", "Licensed under the Apache License, Version 2.0.", "Une autre phrase qui finit par un point, comme il faut."]
    texts = ["\n".join(f"{kinds[int(k)]} {i}" if kinds[int(k)] else "" for i, k in enumerate(r.integers(0, len(kinds), int(r.integers(1, 10))))) for _ in range(40)]
    texts = [t + "\n" + " ".join(f"W{i}{'!!' if k % 2 else ''}" for i in range(60)) + "." for k, t in enumerate(texts)]
    rows = line_crf.apply_rules(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), crf).collect()
    for row in rows:
        _, x = _states(crf, texts[row.doc_id])
        score, move = x @ crf.weights[: line_crf.N_FEATURES], crf.weights[line_crf.N_FEATURES :]
        best = max(itertools.product((1, 0), repeat=len(x)), key=lambda z: sum(score[i, k] for i, k in enumerate(z)) + sum(move[a, b] for a, b in zip(z, z[1:])))
        words = [len(line.split()) for line in texts[row.doc_id].split("\n")]
        share = sum(w for w, z in zip(words, best) if z) / sum(words)
        assert row.content_share == pytest.approx(share) and row.kept == (not row.base_failed and share >= line_crf.CONTENT_SHARE)
    assert {row.kept for row in rows} == {True, False}


def test_evidence_likelihood_rises():
    r = np.random.default_rng(3)
    x = np.concatenate([np.ones((60, 1)), r.random((60, line_crf.N_FEATURES - 1))], axis=1)
    content = np.where(x[:, 1] > 0.5, 0.05, 0.95)
    starts = np.array([0, 9, 10, 40])
    lens = np.diff(np.append(starts, 60))
    order = np.argsort(-lens, kind="stable")

    def gain(crf):
        score, move = crf._scores(x)
        free = line_crf._marginals(score, move, starts[order], lens[order])[0]
        return line_crf._marginals(score + np.log(np.stack([1 - content, content], axis=1)), move, starts[order], lens[order])[0] - free

    fitted = line_crf.LineCrf().fit(x, starts, content)
    assert gain(fitted) > gain(line_crf.LineCrf())
    assert (fitted.viterbi(x, starts) == (content > 0.5)).mean() > 0.9


def test_stock_lines_need_diverse_sides():
    copies = [[1, 2, 3, 4]] * 9 + [[1, 2, 5, 4]]
    assert line_crf.stock_lines(copies).tolist() == []
    assert line_crf.stock_lines([[10 + i, 7, 20 + i] for i in range(3)] + [[7]]).tolist() == [7]


def test_ties_long_text_and_no_labels(spark, tables):
    empty = line_crf.LineCrf()
    long = "A plain line of some words.\n" * 3 + " ".join(f"word{i}" for i in range(400_000)) + "\n" + "z" * 2_000_000
    rows = line_crf.apply_rules(spark.createDataFrame([(1, long, "x"), (1, long, "x"), (None, None, "y")], "doc_id long, text string, kept string"), empty).collect()
    big = [r for r in rows if r.doc_id == 1]
    assert len(rows) == 3 and [(r.n_words, r.n_dup_lines, r.content_share, r.kept) for r in big] == [(400_019, 2, 1.0, True)] * 2
    assert line_crf.train(tables[0], tables[1].limit(0)).weights.any() == False  # noqa: E712
