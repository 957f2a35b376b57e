"""Search from the positional index and by vectors, for tables of questions, against plain definitions."""

import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from veristrata.functions import stemming
from veristrata.operators import ranking, textindex, vectors
from veristrata.queries import corpus

TERMS = [["a", "b"], ["c"], ["a", "b", "c"], ["zz"], [], None, ["b", "b"]]


def _density(fields, terms):
    """All minimal stretches with every term, by definition; ``fields``: (words, weight)."""
    hits, at = [], 0
    for words, weight in fields:
        hits += [(at + i, w, 1 / weight) for i, w in enumerate(words) if w in terms]
        at += len(words)
    spans = [(x[0], z[0]) for x in hits for z in hits if x[0] <= z[0] and {w for p, w, _ in hits if x[0] <= p <= z[0]} == set(terms)]
    s = 0.0
    for a, z in (x for x in spans if not any(y != x and x[0] <= y[0] and y[1] <= x[1] for y in spans)):
        own = [c for p, _, c in hits if a <= p <= z]
        s += len(own) / sum(own) / (1 + (z - a) - (len(own) - 1))
    return s / (s + 1) if s else None


@pytest.fixture(scope="module")
def texts():
    r = random.Random(8)
    return [(i, " ".join(r.choice("aabbccdef") for _ in range(r.randint(0, 3))), " ".join(r.choice("abcdefgh") for _ in range(r.randint(0, 25))), f"g{i % 3}") for i in range(80)] + [(80, None, None, None), (81, "", "a b", None)]


def test_search_equals_definition(spark, texts, monkeypatch):
    monkeypatch.setattr(textindex, "QUESTIONS", 3)
    monkeypatch.setattr(textindex, "BLOCKS", 2)
    rows = spark.createDataFrame(texts, "id long, title string, body string, g string")
    index = textindex.build(rows.repartition(3), "id", {"title": 1.0, "body": 0.1}, "g", words=60)
    asked = spark.createDataFrame([(q, t, ["g1", None, "none"]) for q, t in enumerate(TERMS)], "query_id int, terms array<string>, anchors array<string>")
    got = {(r.query_id, r.anchored, r["rank"]): (r.key, r.score) for r in textindex.search(index, asked, 10).collect()}
    want = {}
    for q, terms in enumerate(TERMS):
        scored = [(-round(s, 9), i, g) for i, a, b, g in texts if terms and (s := _density((((a or "").split(), 1.0), ((b or "").split(), 0.1)), terms))]
        for anchored in (False, True):
            for rank, (s, i, _) in enumerate(sorted(x for x in scored if not anchored or x[2] == "g1")[:10], 1):
                want[q, anchored, rank] = (i, pytest.approx(-s, abs=1e-8))
    assert got == want and len({q for q, _, _ in want}) == 4
    assert textindex.search(index, asked.limit(0)).count() == 0 and textindex.search(textindex.build(rows.limit(0), "id", {"body": 0.1}), asked).count() == 0


def test_written_index_reads_its_words(spark, texts, tmp_path):
    rows = spark.createDataFrame(texts, "id long, title string, body string, g string")
    textindex.write(rows, f"{tmp_path}/index", "id", {"body": 0.1}, words=40)
    for terms in (("a", "b"), ("h",)):
        whole = [tuple(r) for r in ranking.full_text_top(rows, "id", {"body": 0.1}, terms, 7).select("id", "score", "rank").orderBy("rank").collect()]
        index = textindex.read(spark, f"{tmp_path}/index", terms)
        assert {r.lexeme for r in index.select("lexeme").distinct().collect()} == {None, *terms}
        assert [tuple(r) for r in textindex.block_max_top(index, terms, 0.1, 7, first=1).select("key", "score", "rank").orderBy("rank").collect()] == whole


def test_blocks_below_the_bound_are_not_read(spark):
    """One block repeats the words; the others cannot reach its scores."""
    rows = spark.createDataFrame([(i, "a b " * (50 if i < 20 else 1) + "x " * 30) for i in range(200)], "id long, t string").repartitionByRange(8, "id")
    index = textindex.build(rows, "id", {"t": 0.1}, words=2_000)
    heads = index.where("lexeme = 'a'").select("block", "most").collect()
    assert len(heads) > 2 and {h.most for h in heads} == {1, 50}
    assert {r.key for r in textindex.block_max_top(index, ("a", "b"), 0.1, 10, first=1).collect()} == set(range(10))


def test_stems_and_stop_words_keep_places(spark):
    rows = spark.createDataFrame([(1, "hopping the the hopes"), (2, "hop hope")], "id long, t string")
    index = textindex.build(rows, "id", {"t": 0.1}, stem=stemming.lexeme)
    held = sorted((r.lexeme, p) for r in index.where("lexeme is not null").collect() for p in r.places)
    assert held == [("hop", 0), ("hop", 0), ("hope", 1), ("hope", 3)]


def test_vectors_in_a_grid(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_VALUES", 100)
    r = np.random.default_rng(4)
    m = r.normal(size=(60, 5))
    rows = spark.createDataFrame([(i, f"g{i % 2}", v.tolist()) for i, v in enumerate(m)] + [(99, "g1", None)], "key long, group string, v array<double>")
    asked = spark.createDataFrame([(str(q), m[q].tolist(), ["g1"]) for q in range(7)] + [("none", None, None)], "query_id string, q array<double>, anchors array<string>")
    got = {(x.query_id, x.anchored, x["rank"]): x.key for x in vectors.search(asked, rows, 6).collect()}
    for q in range(7):
        near = m @ m[q]
        for anchored, some in ((False, range(60)), (True, range(1, 60, 2))):
            want = sorted(some, key=lambda i: (-round(near[i], 9), i))[:6]
            assert [got[str(q), anchored, k] for k in range(1, 7)] == want
    assert {k[0] for k in got} == {str(q) for q in range(7)}


def test_inverted_lists_reach_their_recall(spark, tmp_path):
    d = "/root/testdata/sf0.01"
    exact = {(r.query_id, r.vec_id) for r in corpus.QUERIES["H24_dense_batch"][0](spark, d).collect()}
    found = {(r.query_id, r.vec_id) for r in corpus.QUERIES["W10_inverted_lists"][0](spark, d).collect()}
    assert len(exact & found) >= 0.9 * len(exact)
    r = np.random.default_rng(1)
    m = np.concatenate([c + r.normal(scale=0.05, size=(200, 8)) for c in np.eye(8)])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "key long, v array<double>")
    vectors.write_lists(rows, f"{tmp_path}/lists", 20)
    lists, book, probes = vectors.read_lists(spark, f"{tmp_path}/lists")
    assert len(book) == 25 and probes < 12
    got = {x.key for x in vectors.search_lists(lists, book, m[3].tolist(), 20, probes=probes).collect()}
    assert len(got & set(np.argsort(-(m @ m[3]))[:20].tolist())) >= 18
    plan = vectors.search_lists(lists, book, m[3].tolist())._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[list#\d+ IN", plan)


def test_contexts_that_do_not_fit_are_refused(spark):
    rows = spark.createDataFrame([("a", "x")] * 8 + [("b", "x")] * 9 + [("c", "é" * 70_000)] + [("d", None)], "by string, t string")
    assert {r.by: (r.chunks, r.bytes, r.status) for r in ranking.packed(rows, "by", "t").collect()} == {"a": (8, 8, "packed"), "b": (9, 9, "too_many_chunks"), "c": (1, 140_000, "too_many_bytes"), "d": (1, 0, "packed")}


def test_questions_of_the_same_words_are_searched_once(spark, texts, monkeypatch):
    searched = []
    dealt = textindex.question_parts
    monkeypatch.setattr(textindex, "question_parts", lambda asked, *most: searched.append(asked.count()) or dealt(asked, *most))
    index = textindex.build(spark.createDataFrame(texts, "id long, title string, body string, g string"), "id", {"body": 0.1}, "g")
    asked = spark.createDataFrame([(q, ["b", "a", "b"][q % 2 :], ["g1"]) for q in range(40)] + [(40, ["a"], ["g1"])], "query_id int, terms array<string>, anchors array<string>")
    found = {}
    for r in textindex.search(index, asked, 5).collect():
        found.setdefault(r.query_id, set()).add((r.anchored, r.key, r.score, r["rank"]))
    assert searched == [2] and len(found) == 41 and all(found[q] == found[0] for q in range(40)) and found[40] != found[0]


def test_one_part_of_the_products_is_held():
    """A cell multiplies some questions with its block at once, whatever their number, and finds the same rows."""
    r = np.random.default_rng(2)
    v, q = r.normal(size=(3000, 8)), r.normal(size=(2000, 8))
    rows = pa.table({"key": pa.array(range(3000), pa.int64()), "group": [f"g{i % 3}" for i in range(3000)], "v": list(v)})
    anchors = [[["g1"], None, ["g0", "g2"], ["none"]][i % 4] for i in range(2000)]
    questions = pa.table({"query_id": pa.array(range(2000), pa.int64()), "q": list(q), "anchors": pa.array(anchors, pa.list_(pa.string()))})
    schema = pa.schema([("query_id", pa.int64()), ("anchored", pa.bool_()), ("key", pa.int64()), ("score", pa.float64())])
    tracemalloc.start()
    found = vectors._cell(questions, rows, 3, 0.0, schema)
    assert tracemalloc.get_traced_memory()[1] < q.shape[0] * v.shape[0] * 8
    tracemalloc.stop()
    got = {}
    for row in found.to_pylist():
        got.setdefault((row["query_id"], row["anchored"]), set()).add(row["key"])
    for n, limits in enumerate(anchors):
        near = v @ q[n]
        for anchored, own in ((False, np.arange(3000)), (True, np.array([i for i in range(3000) if f"g{i % 3}" in (limits or ())], int))):
            assert got.get((n, anchored), set()) == set(own[np.argsort(-near[own])[:3]].tolist())


def test_index_of_one_question_holds_its_words_only(spark, texts, tmp_path):
    rows = spark.createDataFrame([*texts, (900, None, "A b", "x"), (901, "B", "c a", "x"), (902, None, None, "x")], "id long, title string, body string, g string")
    fields = {"title": 1.0, "body": 0.1}
    whole = textindex.build(rows, "id", fields, "g", words=60)
    for terms in (["a", "b"], ["zz", "a"]):
        asked = spark.createDataFrame([(0, terms, ["x"])], "query_id int, terms array<string>, anchors array<string>")
        for name, stem in (("plain", None), ("stemmed", str.lower)):  # with stems every row stays
            folder = str(tmp_path / f"{name}-{terms[0]}")
            textindex.write(rows, folder, "id", fields, "g", stem, 60, terms)
            small = textindex.read(spark, folder)
            assert {r[0] for r in small.select("lexeme").distinct().collect()} <= {None, *terms}
            order = ["anchored", "rank"]
            assert textindex.search(small, asked).orderBy(*order).collect() == textindex.search(whole, asked).orderBy(*order).collect()


def test_cells_pass_on_rows_by_questions_alone(spark, monkeypatch):
    """However many blocks there are and however many rows have one score."""
    passed, rank = [], textindex.first_of_each
    monkeypatch.setattr(textindex, "first_of_each", lambda found, *more: passed.append(found.count()) or rank(found, *more))
    monkeypatch.setattr(textindex, "BLOCKS", 1)
    rows = spark.createDataFrame([(i, "a x b" if i % 7 else "a b", f"g{i % 2}") for i in range(1_200)], "id long, t string, g string").repartitionByRange(3, "id")
    index = textindex.build(rows, "id", {"t": 0.1}, "g", words=30)
    asked = spark.createDataFrame([(0, ["a", "b"], ["g1"]), (1, ["x"], None)], "query_id int, terms array<string>, anchors array<string>")
    got = sorted((r.query_id, r.anchored, r["rank"], r.key) for r in textindex.search(index, asked, 3).collect())
    assert got == [(0, False, 1, 0), (0, False, 2, 7), (0, False, 3, 14), (0, True, 1, 7), (0, True, 2, 21), (0, True, 3, 35), (1, False, 1, 1), (1, False, 2, 2), (1, False, 3, 3)]
    cells = 2 * spark.sparkContext.defaultParallelism
    assert index.where("lexeme is null").count() > 10 * cells and passed[0] <= 3 * 3 * cells


def test_rows_left_out_by_their_bound_are_not_among_the_best(spark, monkeypatch):
    monkeypatch.setattr(textindex, "CELLS", 0)  # one cell reads all blocks
    r = random.Random(3)
    texts = [(i, " ".join(r.choice("abcde") for _ in range(r.randint(0, 4))), " ".join(r.choice("abcdefghij") for _ in range(r.choice((3, 9, 40)))), f"g{i % 3}") for i in range(300)]
    rows = spark.createDataFrame(texts, "id long, title string, body string, g string").repartition(3)
    asks = [["a"], ["a", "b"], ["j", "e"], ["c", "a", "b"], ["d", "h", "i", "j"]]
    asked = spark.createDataFrame([(q, t, ["g1", "g2"] if q % 2 else ["g0"]) for q, t in enumerate(asks)], "query_id int, terms array<string>, anchors array<string>")
    index = textindex.build_asked(rows, asked, "id", {"title": 1.0, "body": 0.1}, "g", words=100)
    got = {(x.query_id, x.anchored, x["rank"]): (x.key, x.score) for x in textindex.search(index, asked, 4).collect()}
    want = {}
    for q, terms in enumerate(asks):
        scored = sorted((-round(s, 9), i, g) for i, a, b, g in texts if (s := _density(((a.split(), 1.0), (b.split(), 0.1)), terms)))
        for anchored in (False, True):
            for rank, (s, i, _) in enumerate([x for x in scored if not anchored or x[2] in (("g1", "g2") if q % 2 else ("g0",))][:4], 1):
                want[q, anchored, rank] = (i, pytest.approx(-s, abs=1e-8))
    assert got == want and len(want) == 40


def test_index_of_asked_words(spark, texts):
    rows = spark.createDataFrame([*texts, (900, None, "\U0001d41a é b", "x"), (901, "B", None, "x")], "id long, title string, body string, g string")
    asked = spark.createDataFrame([(0, ["a", "b"], ["g1"]), (1, ["é", "zz"], None), (2, ["é"], ["x"]), (3, None, None)], "query_id int, terms array<string>, anchors array<string>")
    fields = {"title": 1.0, "body": 0.1}
    small, whole = textindex.build_asked(rows, asked, "id", fields, "g", words=60), textindex.build(rows, "id", fields, "g", words=60)
    assert {r[0] for r in small.select("lexeme").distinct().collect()} == {None, "a", "b", "é"}
    order = ["query_id", "anchored", "rank"]
    assert textindex.search(small, asked).orderBy(*order).collect() == textindex.search(whole, asked).orderBy(*order).collect()


@pytest.mark.parametrize("most", [16_000, 2])
def test_vector_cells_follow_the_cores(spark, monkeypatch, most):
    """Many blocks of rows: the cells, and what they pass on, do not grow with them. Null keys and equal rows stay."""
    monkeypatch.setattr(vectors, "QUESTIONS", most)
    monkeypatch.setattr(vectors, "BLOCK_VALUES", 50)
    passed, rank = [], vectors.first_of_each
    monkeypatch.setattr(vectors, "first_of_each", lambda found, *more: passed.append(found.count()) or rank(found, *more))
    r = np.random.default_rng(6)
    m = r.normal(size=(1500, 5))
    m[700:] = m[0]  # copies
    rows = spark.createDataFrame([(i if i else None, f"g{i % 2}", v.tolist()) for i, v in enumerate(m)], "key long, group string, v array<double>")
    asked = spark.createDataFrame([(q, m[q].tolist(), ["g1"]) for q in range(4)], "query_id int, q array<double>, anchors array<string>")
    got = {(x.query_id, x.anchored, x["rank"]): x.key or 0 for x in vectors.search(asked, rows, 3).collect()}
    for q in range(4):
        near = m @ m[q]
        for anchored, some in ((False, range(1500)), (True, range(1, 1500, 2))):
            assert [got[q, anchored, k] for k in (1, 2, 3)] == sorted(some, key=lambda i: (-round(near[i], 9), i))[:3]
    assert passed[0] <= 4 * 2 * 3 * 2 * spark.sparkContext.defaultParallelism


def test_cells_meet_their_rows_block_by_block(monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_VALUES", 40)
    r = np.random.default_rng(7)
    v, q = r.normal(size=(90, 4)), r.normal(size=(6, 4))
    v[5] = np.nan
    names = ["cell", "row", "query_id", "q", "anchors", "key", "group", "v"]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.string()), pa.string(), pa.string(), pa.list_(pa.float64())]
    listed = [(c, 0, n, list(q[n]), ["g1"], None, None, None) for c in (0, 1) for n in range(3 * c, 3 * c + 3)] + [(c, 1, None, None, None, f"k{n:02}", f"g{n % 3}", list(v[n])) for c in (0, 1) for n in range(90)]
    listed.sort(key=lambda x: x[:2])
    columns = [pa.array([x[i] for x in listed], kind) for i, kind in enumerate(kinds)]
    batch = pa.RecordBatch.from_arrays(columns, names)
    schema = pa.schema([("query_id", pa.int64()), ("anchored", pa.bool_()), ("key", pa.string()), ("score", pa.float64())])
    got = {}
    for found in vectors._cells((batch.slice(i, 7) for i in range(0, batch.num_rows, 7)), 4, 0.0, schema):
        for x in found.to_pylist():
            got.setdefault((x["query_id"], x["anchored"]), set()).add(x["key"])
    want = {}
    for n in range(6):
        near = np.where(np.isnan(v @ q[n]), np.inf, v @ q[n])  # no number comes first, as in SQL
        for anchored, own in ((False, np.arange(90)), (True, np.arange(1, 90, 3))):
            want[n, anchored] = {f"k{i:02}" for i in own[np.argsort(-near[own])[:4]]}
    assert got == want
