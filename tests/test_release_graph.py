"""Cross-table rules, digests along dependencies, scopes and complete pages on small tables with planted faults."""

import pytest
from pyspark.sql import functions as F
from veristrata.operators import pages, release, rules


def _codes(df):
    return sorted(map(tuple, df.select("key", "code").collect()), key=str)


def test_rules_over_one_key(spark):
    a = spark.createDataFrame([(1, "x"), (2, "x"), (2, "x"), (3, None), (4, None), (None, "x")], "k long, v string")
    b = spark.createDataFrame([(1, "x", True), (2, "y", True), (3, None, False), (4, "x", True), (4, None, True), (9, "x", None)], "k long, v string, ok boolean")
    parts = [rules.Part("a", a, F.col("k"), values={"v": F.col("v")}), rules.Part("b", b, F.col("k"), {"ok": F.col("ok")}, {"v": F.col("v")})]
    found = rules.key_faults(parts, {"repeated": rules.unique("a"), "orphan": rules.unreferenced("b", "a"), "not_one": rules.count_not("a", "b", 1, "ok"), "differs": rules.disagree("a", "v", "b"), "marked": rules.above("b", "ok", 2)})
    assert _codes(found) == sorted([("2", "repeated"), ("9", "orphan"), ("3", "not_one"), ("4", "not_one"), (None, "not_one"), ("2", "differs"), ("4", "differs"), ("4", "marked")], key=str)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1  # one shuffle for all rules and tables


def test_cycles_and_what_hangs_below(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("x", "y"), ("y", "z"), ("z", "x"), ("low", "x"), ("lower", "low"), ("self", "self"), (None, "a")], "child_id string, parent_id string")
    assert [k for k, _ in _codes(rules.cycle_faults(edges, "cycle"))] == ["low", "lower", "self", "x", "y", "z"]
    assert _codes(rules.cycle_faults(edges.where("parent_id in ('a', 'b')"), "cycle")) == []
    chain = spark.createDataFrame([(i + 1, i) for i in range(9)], "child_id long, parent_id long")
    assert [k for k, _ in _codes(rules.cycle_faults(chain, "deep", max_depth=7))] == ["8", "9"]


def test_closure_and_digest_rules(spark):
    right = spark.createDataFrame([("a", "a", 0), ("a", "b", 1), ("b", "b", 0), ("c", "c", 0)], "ancestor_id string, descendant_id string, depth int")
    stored = spark.createDataFrame([("a", "a", 0), ("a", "b", 2), ("b", "b", 0), ("b", "b", 0), ("b", "a", 1)], right.schema)
    assert _codes(rules.closure_faults(stored, right)) == [("a>b", "closure_depth_mismatch"), ("b>a", "closure_row_not_derived"), ("b>b", "closure_row_repeated"), ("c>c", "closure_row_missing")]
    found = spark.createDataFrame([("t", "d1", 1), ("u", "d2", 2), ("w", "d3", 3)], "table string, digest string, n long")
    declared = spark.createDataFrame([("t", "d1", 1), ("u", "other", 3), ("v", "d4", 4)], found.schema)
    assert _codes(rules.digest_faults(found, declared)) == [("u", "digest_mismatch"), ("u", "row_count_mismatch"), ("v", "table_missing"), ("w", "digest_missing")]


def test_a_change_shows_below_it_only(spark):
    parents = {"root": (), "left": ("root",), "right": ("root",), "leaf": ("left", "right"), "apart": ()}
    tables = {t: spark.createDataFrame([(1, t), (2, t)], "k int, v string") for t in parents}
    digests = lambda ts: {r.table: (r.level, r.digest) for r in release.graph_digest(ts, parents).collect()}
    before = digests(tables)
    assert {t: level for t, (level, _) in before.items()} == {"root": 0, "left": 1, "right": 1, "leaf": 2, "apart": 0}
    for changed, below in (("leaf", {"leaf"}), ("left", {"left", "leaf"}), ("root", {"root", "left", "right", "leaf"}), ("apart", {"apart"})):
        after = digests(tables | {changed: tables[changed].withColumn("v", F.when(F.col("k") == 1, "new").otherwise(F.col("v")))})
        assert {t for t in parents if after[t] != before[t]} == below
    assert digests(tables | {"left": tables["left"].orderBy(F.desc("k"))}) == before
    for bad in ({"a": ("b",), "b": ("a",)}, {"a": ("none",)}):
        with pytest.raises(ValueError):
            release.dependency_levels(bad)


def test_scope_follows_all_parents(spark):
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    tables = {"a": make([(1, True), (2, False), (3, True)], "a int, public boolean"), "b": make([(1, True), (2, False)], "b int, public boolean"), "c": make([(10, 1, 1), (11, 2, 1), (12, 3, 2), (13, 3, 1), (13, 3, 1), (14, None, 1)], "c int, a int, b int"), "d": make([(10,), (11,), (13,)], "c int")}
    links = {"c": [("a", [F.col("a")], [F.col("a")]), ("b", [F.col("b")], [F.col("b")])], "d": [("c", [F.col("c")], [F.col("c")])]}
    scoped = release.scoped_release(tables, links, {"a": F.col("public"), "b": F.col("public")})
    assert sorted(r.c for r in scoped["c"].collect()) == [10, 13, 13] and sorted(r.c for r in scoped["d"].collect()) == [10, 13]


def test_numbers_of_pages(spark):
    rows = spark.createDataFrame([("hot", i) for i in range(1000)] + [("cold", i) for i in range(5)] + [(None, 7)], "run string, k long")
    placed = {(r.run, r.k): (r.place, r.page) for r in pages.numbered(rows.repartition(5), "run", ["k"], 30).collect()}
    assert placed == {(run, k): (i, i // 30) for run, ks in (("hot", range(1000)), ("cold", range(5)), (None, [7])) for i, k in enumerate(ks)}


def test_faults_of_collected_pages(spark):
    def found(*rows):
        df = spark.createDataFrame([("r", *r) for r in rows], "run string, page long, n long, first long, last long, total long, cursor long, next_cursor long")
        return sorted((r.page, r.code) for r in pages.collection_faults(df, "run").collect())

    good = [(0, 2, 1, 2, 5, None, 2), (1, 2, 3, 4, 5, 2, 4), (2, 1, 5, 5, 5, 4, None)]
    assert found(*good) == []
    assert found(good[0], (1, 2, 2, 4, 5, 2, 4), good[2]) == [(1, "overlap")]
    assert found(good[0], good[2]) == [(2, "gap"), (2, "incomplete")]
    assert found(*good[:2]) == [(1, "incomplete"), (1, "not_terminal")]
    assert found(good[0], (1, 2, 3, 4, 5, 2, 2), (2, 1, 5, 5, 5, 2, None)) == [(1, "cycle")]
    assert found(good[0], (1, 2, 3, 4, 6, 2, 4), good[2]) == [(1, "total_drift"), (2, "total_drift")]
    assert found((0, 2, 1, 2, 2, 0, None)) == [(0, "first_page_has_cursor")]


def test_quantiles_of_a_hot_group(spark):
    import random

    from veristrata.operators import metrics

    r = random.Random(2)
    rows = [("hot", r.choice([1.5, 2.0, 9.0, r.random()])) for _ in range(3000)] + [("cold", float(i)) for i in range(7)] + [(None, 4.0), ("hot", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    got = {x.g: (x.n, x.p50, x.p95) for x in metrics.latency(df, ["g"], "v").collect()}
    for g in {x for x, _ in rows}:
        own = sorted(v for x, v in rows if x == g and v is not None)
        at = lambda p: own[-(-int(p * 100) * len(own) // 100) - 1] if own else None
        assert got[g] == (sum(x == g for x, _ in rows), at(0.5), at(0.95))


def test_ndcg_credits_each_group_once(spark):
    import math

    from veristrata.operators import metrics

    rows = [([["a", "b"], ["b", "c"]], ["b", "b", "x", "c"]), ([["a"]], ["z", "a"]), ([["a"]], None), ([], ["a"]), (None, ["a"]), ([["a"], ["a"]], ["a", "a", "a"]), ([["a", None]], [None, "a"])]
    df = spark.createDataFrame(rows, "g array<array<string>>, r array<string>")
    got = [x.v for x in df.select(metrics.ndcg(F.col("g"), F.col("r")).alias("v")).collect()]
    two = 1 + 1 / math.log2(3)
    assert got == [1.0, round(1 / math.log2(3), 12), 0.0, None, None, round(two / two, 12), round(1 / math.log2(3), 12)]
