"""Wrapper induction, graph search, mixing and the pipeline."""

import corpus_pipeline
import numpy as np
import pytest
from veristrata.llm import ann, mixing, suffix_dedup, wrapper

SF = "/root/testdata/sf0.001"

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body class="home">
<header><a href=/>Site</a></header><nav><ul><li><a href=/a>Menu {n}</a></ul></nav>
<div class="cookie-notice">We use cookies</div><div id="sidebar"><p>Side {n}</p></div>
<main><article><header><h1>Title&nbsp;{n}</h1></header><p>First &amp; <b>bold</b>
 text {n}<p>Second<br>line {n}<div class="promo">Buy {n}</div><div>Follow this site for more</div>
<form><input name=q>Search</form><script>var x = "</p>";</script><ul><li>one {n}<li>two</ul>
<section class="comments"><p>Reader {n}</p></section></article></main>
<footer>&copy; site</footer><!-- end --></body></html>"""


def _want(n):
    return f"Title {n}\nFirst & bold text {n}\nSecond line {n}\none {n}\ntwo"


def test_main_text(spark):
    rows = [(i, f"http://h.example.org/{i}", PAGE.format(n=f"number{i} " * (i + 1)), "clash") for i in range(6)]
    rows += [(10, "http://h.example.org/x", None, "a"), (11, None, PAGE.format(n="z"), "b"), (12, "http://other.org", "", "c"), (13, "nonsense", "<p>only <p>text", "d"), (0, "http://h.example.org/0", rows[0][2], "again")]
    got = wrapper.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, host string")).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    by_id = {r.page_id: r.text for r in got}
    for i in range(6):  # the constant line is template on a host of many pages
        assert by_id[i] == _want(" ".join([f"number{i}"] * (i + 1)))
    assert (by_id[10], by_id[12], by_id[13]) == ("", "", "only\ntext")
    assert by_id[11] == _want("z").replace("\none", "\nFollow this site for more\none")
    assert wrapper.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_copies_of_one_page_keep_their_text(spark):
    html = "<body><div><div>Whole text of the page</div></div></body>"
    rows = [(i, "http://copies.org/a", html) for i in range(9)]
    assert {r.text for r in wrapper.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()} == {"Whole text of the page"}


@pytest.mark.parametrize("html", ["<", "<a", "</p></div>", "<p><b>x<p>y", "<script>never closed <p>a", "<div title='a>b'>t</div>", "<!-- open <p>x", "a<br/>b", "<![CDATA[raw]]>", "<table><tr><td>a<td>b<tr><td>c</table>", "<b>" * 500 + "deep"])
def test_broken_markup(html):
    assert isinstance(wrapper.extract(html, None), str)


def test_graph_recall():
    r = np.random.default_rng(4)
    x = np.concatenate([r.normal(size=(700, 24)), r.normal(5, 0.1, size=(500, 24))])
    graph, entries = ann.build_graph(x)
    q = np.concatenate([x[::40], r.normal(size=(10, 24))])
    ids, _ = ann.beam_search(x, graph, entries, q, ann.SEARCH_BEAM)
    true = np.argsort(((q[:, None] - x[None]) ** 2).sum(axis=2), axis=1)[:, :10]
    assert np.mean([len(set(a[:10]) & set(b)) / 10 for a, b in zip(ids, true)]) > 0.95


def test_nearest(spark):
    r = np.random.default_rng(5)
    rows = [(i, [float(v) for v in r.normal(size=8)]) for i in range(150)]
    rows += [(i, rows[7][1]) for i in range(200, 240)]  # copies of one vector
    rows += [(300, None), (400, [0.0] * 8), (500, [float("nan")] * 8), (600, [1.0, None] + [1.0] * 6), (700, [1.0]), (800, []), (None, rows[3][1]), (900, [float("inf")] * 8)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    index, layout = ann.build_index(table, shard_rows=40)
    queries = ann._usable(table).where("size(v) = 8 and vec_id % 100 = 0").selectExpr("vec_id as query_id", "v")
    got = ann.search(index, layout, queries).collect()
    shards = sum(n for _, _, n in layout)
    fine = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v and len(v) == 8 and None not in v and np.isfinite(v).all() and any(v)]
    assert shards > 2 and {g.query_id for g in got} == {0, 100, 200}
    for q, point in [f for f in fine if f[0] % 100 == 0]:
        near = sorted((float(np.sqrt(((v - point) ** 2).sum())), i) for i, v in fine if i != q)[:10]
        own = sorted((g.rank, g.vec_id, g.score) for g in got if g.query_id == q)
        assert [o[1] for o in own] == [i for _, i in near] and np.allclose([o[2] for o in own], [d for d, _ in near])
    assert ann.nearest(table.limit(0)).count() == 0
    assert ann.nearest(table.where("vec_id in (100, 101)")).count() == 1


def test_water_fill():
    assert mixing.water_fill([100, 100, 100], [5, 2, 1]) == [200.0, pytest.approx(500 / 3), pytest.approx(250 / 3)]
    r = np.random.default_rng(6)
    for _ in range(50):
        sizes = [int(s) for s in r.integers(0, 1000, 12)]
        target = mixing.water_fill(sizes, [(5, 2, 1)[i % 3] for i in range(12)])
        assert sum(target) == pytest.approx(1.5 * sum(sizes)) and all(t <= 2 * s + 1e-6 for t, s in zip(target, sizes))
    assert mixing.water_fill([], []) == [] and mixing.water_fill([0, 0], [5, 2]) == [0, 0]


def test_mix(spark):
    r = np.random.default_rng(7)
    rows = [(i, " ".join(["w"] * int(r.integers(0, 300))), ["b", "a", "é", None, "Z"][int(r.integers(5))], 1) for i in range(400)] + [(None, "x y", "a", 2), (5, None, "b", 3), (6, "", "only", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    sums = {}
    for g in got:
        assert 0 <= g.taken <= 2 * g.size
        own = sums.setdefault((g.target, g.source_size), [0, 0])
        own[0] += g.taken
        own[1] += g.size
    total = sum(g.size for g in got)
    assert sum(target for target, _ in sums) == pytest.approx(1.5 * total)
    for (target, source_size), (taken, size) in sums.items():
        assert size == source_size and taken == pytest.approx(target, rel=0.01, abs=3)
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix(docs.repartition(7)).collect()))
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mix(docs.where("source = 'only'")).first().taken == 0
    repeated = mixing.repeat_by_mix(docs.where("doc_id not in (5, 6)"))
    assert repeated.columns == docs.columns and repeated.count() >= sum(1 for g in got if g.taken)


def test_mix_equals_its_sql(spark):
    import duckdb

    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    cols = ["doc_id", "size", "source_size", "target", "taken", "slots", "first_slot"]
    got = mixing.query(spark, SF).select(*cols).collect()
    assert sorted(map(tuple, got), key=str) == sorted(db.execute(f"SELECT {', '.join(cols)} FROM ({mixing.SQL})").fetchall(), key=str)


def test_schedule_is_even(spark):
    cells = spark.createDataFrame([(0, 0, 2500), (1, 2500, 1000), (2, 3500, 500), (3, 4000, 0)], "sid long, first_cell long, cells long")
    rows = mixing.schedule(spark, cells, 4000).orderBy("slot").collect()
    assert [r.rank for r in rows if r.sid == 1][:5] == [0, 1, 2, 3, 4]
    for s in range(0, 4000, 400):  # any stretch is near the weights
        share = np.bincount([r.sid for r in rows[s : s + 400]], minlength=3) / 400
        assert np.allclose(share, [0.625, 0.25, 0.125], atol=0.01)


def test_pipeline(spark):
    docs, kept = spark.read.parquet(f"{SF}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, docs, SF)
        if name != "byte_bpe":
            assert rows.columns == columns
        path = suffix_dedup.durable(rows, f"test-{name}")
        kept[name], docs = path.count(), path
    assert kept["quality_classifier"] >= kept["simhash_near_dedup"] >= kept["suffix_array_dedup"] > 0
    assert kept["byte_bpe"] == kept["source_mixing"]
    assert corpus_pipeline.run(spark, SF).count() == kept["byte_bpe"]
