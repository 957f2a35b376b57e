"""A release as a graph of tables: cross-table rules, scopes and digests in dependency order, complete pages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import pages, release, rules
from ..operators.taxonomy import closure
from ..session import scratch_folder
from ..sources import staging
from .mapping import CLOSURE, lineage, table

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {}


def _add(name: str, sql: str):
    def keep(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn, sql
        return fn

    return keep


#: Orders as candidates of a release; their items as placements, flanks and ledger rows. Each relation holds faults.
_CONTIG = "concat('CM', lpad(CAST(o_custkey AS VARCHAR(20)), 6, '0'), '.1')"
RELATIONS = {
    "locus": f"""SELECT o_orderkey AS locus_id, o_totalprice < 20000 AS unversioned, CASE WHEN o_orderpriority LIKE '4%' THEN NULL ELSE {_CONTIG} END AS contig, o_totalprice < 5000 AS bad_length FROM orders
 UNION ALL SELECT o_orderkey, false, {_CONTIG}, false FROM orders WHERE o_totalprice > 490000""",
    "placement": f"SELECT l_orderkey AS locus_id, CASE WHEN l_tax > 0.07 THEN 'CM999999.1' ELSE {_CONTIG} END AS contig, l_quantity < 2 AS bad_interval, l_quantity * 1000 > o_totalprice AS outside FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber = 1",
    "flank": "SELECT l_orderkey AS locus_id, l_linenumber = 2 AS left_side, l_linenumber = 3 AS right_side, l_returnflag = 'R' AS unsupported, l_discount < 0.01 AS no_method FROM lineitem WHERE l_linenumber IN (2, 3)",
    "decision": "SELECT o_orderkey AS locus_id, o_orderstatus <> 'F' AS other FROM orders WHERE o_orderstatus <> 'P'",
    "ledger": "SELECT l_orderkey AS locus_id, l_returnflag = 'A' AS unresolved FROM lineitem WHERE l_linenumber = 4",
}
FLAGS = {"locus": ("unversioned", "bad_length"), "placement": ("bad_interval", "outside"), "flank": ("left_side", "right_side", "unsupported", "no_method"), "decision": ("other",), "ledger": ("unresolved",)}
def locus_rules() -> dict[str, Column]:
    """The codes of a release's candidates (fixed values) and their conditions."""
    return {
        "duplicate_locus_key": rules.unique("locus"),
        "assembly_accession_not_versioned": rules.above("locus", "unversioned"),
        "contig_length_invalid": rules.above("locus", "bad_length"),
        "placement_count_not_one": rules.count_not("locus", "placement"),
        "placement_contig_mismatch": rules.disagree("locus", "contig", "placement"),
        "placement_interval_invalid": rules.above("placement", "bad_interval"),
        "placement_interval_out_of_bounds": rules.above("placement", "outside"),
        "candidate_provenance_missing": rules.unreferenced("placement", "locus"),
        "flank_assessment_count_not_one": rules.count_not("locus", "flank", 1, "left_side") | rules.count_not("locus", "flank", 1, "right_side"),
        "flank_not_supported": rules.above("flank", "unsupported"),
        "flank_method_missing": rules.above("flank", "no_method"),
        "inclusion_decision_missing": rules.count_not("locus", "decision") & ~rules.unique("decision"),
        "inclusion_decision_not_include": rules.above("decision", "other"),
        "unresolved_quarantine_issues": rules.above("ledger", "unresolved"),
    }


def _relation(spark: SparkSession, d: str, sql: str) -> DataFrame:
    for name in ("orders", "lineitem"):
        table(spark, d, name).createOrReplaceTempView(f"_release_{name}")
        sql = sql.replace(f" {name} ", f" _release_{name} ").replace(f" {name}\n", f" _release_{name}\n")
    return spark.sql(sql.replace("JOIN orders", "JOIN _release_orders").replace("FROM orders", "FROM _release_orders").replace("FROM lineitem", "FROM _release_lineitem"))


_SUMS = ", ".join(f"{t}_ AS (SELECT locus_id, count(*) AS n, {', '.join(f'count_if({f}) AS {f}' for f in own)}{', min(contig) AS low, max(contig) AS high, count(DISTINCT contig) + (count(contig) < count(*))::INT AS kinds' if t in ('locus', 'placement') else ''} FROM ({RELATIONS[t]}) GROUP BY locus_id)" for t, own in FLAGS.items())
_CODES = {
    "duplicate_locus_key": "l.n > 1",
    "assembly_accession_not_versioned": "l.unversioned > 0",
    "contig_length_invalid": "l.bad_length > 0",
    "placement_count_not_one": "l.n > 0 AND coalesce(p.n, 0) <> 1",
    "placement_contig_mismatch": "l.n > 0 AND p.n > 0 AND NOT (l.kinds = 1 AND p.kinds = 1 AND l.low IS NOT DISTINCT FROM p.low)",
    "placement_interval_invalid": "p.bad_interval > 0",
    "placement_interval_out_of_bounds": "p.outside > 0",
    "candidate_provenance_missing": "p.n > 0 AND l.n IS NULL",
    "flank_assessment_count_not_one": "l.n > 0 AND (coalesce(f.left_side, 0) <> 1 OR coalesce(f.right_side, 0) <> 1)",
    "flank_not_supported": "f.unsupported > 0",
    "flank_method_missing": "f.no_method > 0",
    "inclusion_decision_missing": "l.n > 0 AND d.n IS NULL",
    "inclusion_decision_not_include": "d.other > 0",
    "unresolved_quarantine_issues": "g.unresolved > 0",
}


@_add("H16_cross_table_rules", f"""WITH {_SUMS}, keys AS (SELECT locus_id FROM locus_ UNION SELECT locus_id FROM placement_ UNION SELECT locus_id FROM flank_ UNION SELECT locus_id FROM ledger_)
 SELECT CAST(locus_id AS VARCHAR) AS key, unnest(list_filter([{', '.join(f"CASE WHEN {c} THEN '{k}' END" for k, c in _CODES.items())}], lambda x: x IS NOT NULL)) AS code
 FROM keys LEFT JOIN locus_ l USING (locus_id) LEFT JOIN placement_ p USING (locus_id) LEFT JOIN flank_ f USING (locus_id) LEFT JOIN decision_ d USING (locus_id) LEFT JOIN ledger_ g USING (locus_id)""")  # fmt: skip
def cross_table(spark: SparkSession, d: str) -> DataFrame:
    """Fourteen rules over five tables that share the candidates' key, by one grouping of all of them."""
    parts = []
    for name, sql in RELATIONS.items():
        rows = _relation(spark, d, sql)
        values = {"contig": F.col("contig")} if name in ("locus", "placement") else {}
        parts.append(rules.Part(name, rows, F.col("locus_id"), {f: F.col(f) for f in FLAGS[name]}, values))
    return rules.key_faults(parts, locus_rules())


#: A stored closure in which nations of the regions' first numbers lack a row, others have a wrong depth or a row too many.
_STORED = f"""SELECT ancestor_id, descendant_id, CASE WHEN descendant_id LIKE 'n1%' AND ancestor_id = 'world' THEN 3 ELSE depth END AS depth FROM ({CLOSURE}) c WHERE NOT (descendant_id LIKE 'n2%' AND ancestor_id LIKE 'r%')
 UNION ALL SELECT ancestor_id, descendant_id, depth FROM ({CLOSURE}) c WHERE descendant_id LIKE 'n3%' UNION ALL SELECT descendant_id, ancestor_id, depth FROM ({CLOSURE}) c WHERE depth = 2"""


@_add("H16_closure_rules", f"""WITH w AS ({CLOSURE}), s AS (SELECT ancestor_id || '>' || descendant_id AS key, count(*) AS n, min(depth) AS low, max(depth) AS high FROM ({_STORED}) GROUP BY 1), r AS (SELECT ancestor_id || '>' || descendant_id AS key, depth FROM w)
 SELECT key, unnest(list_filter([CASE WHEN s.n IS NULL THEN 'closure_row_missing' END, CASE WHEN r.depth IS NULL THEN 'closure_row_not_derived' END, CASE WHEN s.n > 1 THEN 'closure_row_repeated' END, CASE WHEN s.n > 0 AND r.depth IS NOT NULL AND (low <> r.depth OR high <> r.depth) THEN 'closure_depth_mismatch' END], lambda x: x IS NOT NULL)) AS code FROM s FULL JOIN r USING (key)""")  # fmt: skip
def closure_rules(spark: SparkSession, d: str) -> DataFrame:
    """A stored closure with planted faults against the one that its edges give."""
    nodes, edges = lineage(spark, d)
    right = closure(edges, nodes)
    low = F.col("descendant_id")
    kept = right.where(~(low.like("n2%") & F.col("ancestor_id").like("r%"))).withColumn("depth", F.when(low.like("n1%") & (F.col("ancestor_id") == "world"), 3).otherwise(F.col("depth")))
    turned = right.where("depth = 2").select(low.alias("ancestor_id"), F.col("ancestor_id").alias("descendant_id"), "depth")
    return rules.closure_faults(kept.unionByName(right.where(low.like("n3%"))).unionByName(turned), right)


@_add("H16_cycle_rules", """WITH RECURSIVE e AS (SELECT c_custkey AS child, CASE WHEN c_acctbal < 1000 THEN c_custkey * 2 ELSE c_custkey // 2 END AS parent FROM customer WHERE c_custkey > 0),
 up AS (SELECT child, parent, 1 AS steps FROM e UNION ALL SELECT up.child, e.parent, steps + 1 FROM up JOIN e ON e.child = up.parent WHERE steps < 70)
 SELECT CAST(child AS VARCHAR) AS key, 'hierarchy_cycle' AS code FROM up GROUP BY child HAVING max(steps) >= 64""")
def cycle_rules(spark: SparkSession, d: str) -> DataFrame:
    """Customers below the one of half their number, but those with a small balance below the one of twice their number: some chains meet themselves."""
    own = table(spark, d, "customer").where("c_custkey > 0")
    edges = own.select(F.col("c_custkey").alias("child_id"), F.when(F.col("c_acctbal") < 1000, F.col("c_custkey") * 2).otherwise(F.floor(F.col("c_custkey") / 2)).alias("parent_id"))
    return rules.cycle_faults(edges, "hierarchy_cycle")


#: The tables of a release: what each depends on.
GRAPH = {"region": (), "nation": ("region",), "customer": ("nation",), "supplier": ("nation",), "labels": ()}
_ROW = {
    "region": "'{\"r_name\":\"' || r_name || '\",\"r_regionkey\":' || r_regionkey || '}'",
    "nation": "'{\"n_name\":\"' || n_name || '\",\"n_nationkey\":' || n_nationkey || ',\"n_regionkey\":' || n_regionkey || '}'",
    "customer": "'{\"c_acctbal\":' || c_acctbal || ',\"c_custkey\":' || c_custkey || ',\"c_mktsegment\":\"' || c_mktsegment || '\",\"c_name\":\"' || c_name || '\",\"c_nationkey\":' || c_nationkey || '}'",
    "supplier": "'{\"s_acctbal\":' || s_acctbal || ',\"s_name\":\"' || s_name || '\",\"s_nationkey\":' || s_nationkey || ',\"s_suppkey\":' || s_suppkey || '}'",
    "labels": "'{\"doc_id\":' || doc_id || ',\"quality\":' || quality || ',\"toxic\":' || toxic || '}'",
}
_BUCKETS = "SELECT sha256(string_agg(d, ',' ORDER BY b)) AS digest, CAST(sum(n) AS BIGINT) AS n FROM (SELECT b, sha256(string_agg(h || ':' || c, ',' ORDER BY h)) AS d, sum(c) AS n FROM (SELECT h, h[1:3] AS b, count(*) AS c FROM (SELECT sha256({0}) AS h FROM {1}) GROUP BY h) GROUP BY b)"


def _graph_sql() -> str:
    steps, out = [], []
    for level, names in enumerate(release.dependency_levels(GRAPH)):
        for t in names:
            above = " || ".join(["''", *(f"chr(10) || '{p}:' || (SELECT digest FROM g_{p})" for p in sorted(GRAPH[t]))])
            # a row's digest goes through one more hash on its way into a bucket
            row = f"sha256({_ROW[t]})"
            steps.append(f"g_{t} AS (SELECT '{t}' AS \"table\", {level} AS level, n, sha256('{t}:' || digest || {above}) AS digest FROM ({_BUCKETS.format(row, t)}))")
            out.append(f"SELECT * FROM g_{t}")
    return f"WITH {', '.join(steps)} {' UNION ALL '.join(out)}"


@_add("A15_graph_digest", _graph_sql())
def graph_digest(spark: SparkSession, d: str) -> DataFrame:
    """Digests of five tables over their dependencies: a table's holds those of the tables above it."""
    return release.graph_digest({t: table(spark, d, t) for t in GRAPH}, GRAPH)


#: Columns that link the tables of a release, and which rows of its roots belong to it.
_LINKED = {
    "nation": [("region", "n_regionkey", "r_regionkey")],
    "customer": [("nation", "c_nationkey", "n_nationkey")],
    "supplier": [("nation", "s_nationkey", "n_nationkey")],
    "orders": [("customer", "o_custkey", "c_custkey")],
    "lineitem": [("orders", "l_orderkey", "o_orderkey"), ("part", "l_partkey", "p_partkey"), ("supplier", "l_suppkey", "s_suppkey")],
    "events": [("customer", "user_id", "c_custkey")],
    "labels": [("documents", "doc_id", "doc_id")],
    "embeddings": [("documents", "vec_id", "doc_id")],
    "pages": [("documents", "page_id", "doc_id")],
}
_ROOTS = {"region": "r_regionkey < 3", "part": "p_size < 30", "documents": "lang = 'en'", "conversations": "role = 'user'", "benchmark": "item_id >= 0"}
_ID = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "lineitem": "l_orderkey", "events": "event_id", "documents": "doc_id", "labels": "doc_id", "embeddings": "vec_id", "pages": "page_id", "conversations": "conv_id", "benchmark": "item_id"}


def _scope_sql() -> str:
    steps, out = [], []
    for names in release.dependency_levels({t: tuple(p for p, _, _ in _LINKED.get(t, [])) for t in _ID}):
        for t in names:
            tests = [_ROOTS.get(t, "true"), *(f"{own} IN (SELECT {theirs} FROM s_{p})" for p, own, theirs in _LINKED.get(t, []))]
            steps.append(f"s_{t} AS (SELECT * FROM {t} WHERE {' AND '.join(tests)})")
            out.append(f"SELECT '{t}' AS \"table\", count(*) AS n, CAST(coalesce(sum({_ID[t]}), 0) AS BIGINT) AS keys FROM s_{t}")
    return f"WITH {', '.join(steps)} {' UNION ALL '.join(out)}"


@_add("F21_release_graph_scope", _scope_sql())
def graph_scope(spark: SparkSession, d: str) -> DataFrame:
    """Rows and keys of every table that belong to a release, by semi joins along the dependencies."""
    links = {t: [(p, [F.col(own)], [F.col(theirs)]) for p, own, theirs in linked] for t, linked in _LINKED.items()}
    scoped = release.scoped_release({t: table(spark, d, t) for t in _ID}, links, {t: F.expr(cond) for t, cond in _ROOTS.items()})
    out = None
    for t in sorted(scoped):
        own = scoped[t].agg(F.count("*").alias("n"), F.coalesce(F.sum(_ID[t]), F.lit(0)).cast("long").alias("keys")).select(F.lit(t).alias("table"), "n", "keys")
        out = own if out is None else out.unionByName(own)
    return out


_PAGE = 700
_HEADS = f"""SELECT *, lag(last) OVER o AS cursor, CASE WHEN lead(page) OVER o IS NOT NULL THEN last END AS next_cursor FROM (SELECT run, page, count(*) AS n, min(k) AS first, max(k) AS last, any_value(total) AS total FROM (
 SELECT o_orderstatus AS run, o_orderkey AS k, (row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1) // {_PAGE} AS page, count(*) OVER (PARTITION BY o_orderstatus) AS total FROM orders) GROUP BY run, page) WINDOW o AS (PARTITION BY run ORDER BY page)"""
#: What was collected: a total that changed, a page left out, a cursor that leads back, a page that begins too early.
_COLLECTED = "SELECT run, page, n, CASE WHEN run = 'O' AND page = 4 THEN first - 2000 ELSE first END AS first, last, CASE WHEN run = 'F' AND page = 2 THEN total + 1 ELSE total END AS total, cursor, CASE WHEN run = 'O' AND page = 3 THEN cursor ELSE next_cursor END AS next_cursor FROM ({0}) WHERE NOT (run = 'P' AND page = 1)"


@_add("W15_collection_faults", f"""WITH h AS ({_COLLECTED.format(_HEADS)}), m AS (SELECT *, lag(page) OVER o AS b, lag(last) OVER o AS bl, lag(next_cursor) OVER o AS bn, lag(total) OVER o AS bt, lead(page) OVER o IS NULL AS final, sum(n) OVER (PARTITION BY run) AS rows FROM h WINDOW o AS (PARTITION BY run ORDER BY page))
 SELECT run, page, unnest(list_filter([CASE WHEN b IS NULL AND cursor IS NOT NULL THEN 'first_page_has_cursor' END, CASE WHEN bl >= first THEN 'overlap' END, CASE WHEN b IS NOT NULL AND cursor IS DISTINCT FROM bn THEN 'gap' END, CASE WHEN EXISTS (SELECT 1 FROM h x WHERE x.run = m.run AND x.page < m.page AND x.next_cursor = m.next_cursor) THEN 'cycle' END, CASE WHEN bt <> total THEN 'total_drift' END, CASE WHEN final AND next_cursor IS NOT NULL THEN 'not_terminal' END, CASE WHEN final AND rows <> total THEN 'incomplete' END], lambda x: x IS NOT NULL)) AS code FROM m""")  # fmt: skip
def collected(spark: SparkSession, d: str) -> DataFrame:
    """All orders of each state in pages, with faults planted into what was collected."""
    orders = table(spark, d, "orders").select(F.col("o_orderstatus").alias("run"), F.col("o_orderkey").alias("k"))
    heads = pages.page_heads(pages.numbered(orders, "run", ["k"], _PAGE), "run", "k")
    at = lambda run, page: (F.col("run") == run) & (F.col("page") == page)
    seen = heads.where(~at("P", 1)).withColumn("first", F.when(at("O", 4), F.col("first") - 2000).otherwise(F.col("first"))).withColumn("total", F.col("total") + at("F", 2).cast("int"))
    return pages.collection_faults(seen.withColumn("next_cursor", F.when(at("O", 3), F.col("cursor")).otherwise(F.col("next_cursor"))), "run")


@_add("W15_numbered_pages", _HEADS)
def paged(spark: SparkSession, d: str) -> DataFrame:
    """The first and last key, size and cursors of every page of each state's orders."""
    orders = table(spark, d, "orders").select(F.col("o_orderstatus").alias("run"), F.col("o_orderkey").alias("k"))
    return pages.page_heads(pages.numbered(orders, "run", ["k"], _PAGE), "run", "k")


_POOR = "SELECT * FROM customer WHERE c_acctbal < 5000"


@_add("S15_S16_staged_tables", f"""SELECT 'customer' AS "table", CASE WHEN c_acctbal < 5000 THEN 'a' ELSE 'b' END AS run_key, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS keys FROM customer GROUP BY 2
 UNION ALL SELECT 'nation', CASE WHEN n_nationkey IN (SELECT c_nationkey FROM ({_POOR})) THEN 'a' ELSE 'b' END AS r, count(*), CAST(sum(n_nationkey) AS BIGINT) FROM nation GROUP BY r
 UNION ALL SELECT 'region', CASE WHEN r_regionkey IN (SELECT n_regionkey FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM ({_POOR}))) THEN 'a' ELSE 'b' END AS r, count(*), CAST(sum(r_regionkey) AS BIGINT) FROM region GROUP BY r""")  # fmt: skip
def staged_tables(spark: SparkSession, d: str) -> DataFrame:
    """Three dependent tables staged in two runs that overlap, and the first run again: every key is stored by the run that
    brought it first."""
    region, nation, customer = (table(spark, d, n) for n in ("region", "nation", "customer"))
    poor = customer.where("c_acctbal < 5000")
    lands = nation.join(poor.select(F.col("c_nationkey").alias("n_nationkey")), "n_nationkey", "left_semi").select(*nation.columns)
    parts = region.join(lands.select(F.col("n_regionkey").alias("r_regionkey")), "r_regionkey", "left_semi").select(*region.columns)
    folder, parents = scratch_folder(spark, "staged"), {"nation": {"region": "n_regionkey"}, "customer": {"nation": "c_nationkey"}}
    keyed = lambda r, n, c: {"region": (r, "r_regionkey"), "nation": (n, "n_nationkey"), "customer": (c, "c_custkey")}
    for run, batch in (("a", keyed(parts, lands, poor)), ("b", keyed(region, nation, customer)), ("a", keyed(region, nation, customer))):
        staging.stage_tables(batch, parents, folder, run)
    out = None
    for name, key in (("region", "r_regionkey"), ("nation", "n_nationkey"), ("customer", "c_custkey")):
        own = staging.read_table(spark, folder, name).groupBy("run_key").agg(F.count("*").alias("n"), F.sum(key).cast("long").alias("keys")).select(F.lit(name).alias("table"), "run_key", "n", "keys")
        out = own if out is None else out.unionByName(own)
    return out
