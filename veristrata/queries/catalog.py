"""Fact queries: filters, joins, metrics, lists, hierarchies and set operations over the mapped catalog."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import facts as f
from ..operators import taxonomy
from ..plans.algebra import Plan, execute, total
from ..session import ROWS_A_TASK, tasks_for
from .mapping import BASE, CLOSURE, facts, lineage, table

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {}


def _add(name: str, sql: str):
    def keep(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn, sql
        return fn

    return keep


def _filtered(name: str, where: str, *filters) -> None:
    _add(name, f"SELECT DISTINCT * FROM ({BASE}) b WHERE {where}")(lambda s, d: f.matched_loci(facts(s, d), "F", filters))


_EXACT = "group_id IN (SELECT c_custkey FROM customer WHERE c_nationkey = 5)"
_BELOW = f"group_id IN (SELECT c_custkey FROM customer WHERE 'n' || c_nationkey IN (SELECT descendant_id FROM ({CLOSURE}) WHERE ancestor_id = 'r1'))"
_TYPED = "locus_id IN (SELECT l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_type = 'PROMO')"
_BRAND = "locus_id IN (SELECT l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand = 'Brand#2')"
_filtered("F1_base_relation", "true")
_filtered("F2_group_filter", "group_id = 42", f.GroupFilter(42))
_filtered("F3_locus_filter", "locus_id = 1", f.LocusFilter((1,)))
_filtered("F4_lineage_exact", _EXACT, f.LineageFilter("n5"))
_filtered("F5_lineage_descendants", _BELOW, f.LineageFilter("r1", True))
_filtered("F6_category_exact", _TYPED, f.CategoryFilter("PROMO"))
_filtered("F7_category_by_kind", _BRAND, f.CategoryFilter("Brand#2", "study"))
_FAMILY = "locus_id IN (SELECT l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_type IN ('PROMO', 'ECONOMY'))"
_filtered("F7_category_descendants", _FAMILY, f.CategoryFilter("PRICE", "formal", True))
_filtered("F8_in_list", "locus_id IN (1, 5, 9, 31, 77)", f.LocusFilter((1, 5, 9, 31, 77)))
_filtered("J5_semi_joins_combined", f"{_BELOW} AND {_TYPED}", f.LineageFilter("r1", True), f.CategoryFilter("PROMO"))

_FLAGSHIP = f"SELECT * FROM ({BASE}) b WHERE {_BELOW} AND {_TYPED}"


@_add("flagship", f"SELECT 'n' || c_nationkey AS term_id, n_name AS term_name, count(DISTINCT group_id) AS groups, count(*) AS loci FROM ({_FLAGSHIP}) JOIN customer ON group_id = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL")
def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Taxa of the public loci below one lineage that carry one category."""
    t = facts(spark, d)
    return f.taxon_rows(t, f.matched_loci(t, "F", (f.LineageFilter("r1", True), f.CategoryFilter("PROMO"))))


@_add("F9_row_value_comparison", f"SELECT * FROM ({BASE}) WHERE (group_id, locus_id) > (50, 700)")
def row_value(spark: SparkSession, d: str) -> DataFrame:
    base = f.matched_loci(facts(spark, d), "F")
    return base.where(F.struct("group_id", "locus_id") > F.struct(F.lit(50).cast("long").alias("group_id"), F.lit(700).cast("long").alias("locus_id")))


@_add("F10_locus_details", f"SELECT locus_id, sequence_id, group_id, c_name AS group_name, 'n' || c_nationkey AS term_id, n_name AS term_name FROM ({BASE}) JOIN customer ON group_id = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def locus_details(spark: SparkSession, d: str) -> DataFrame:
    t = facts(spark, d)
    return f.locus_details(t, f.matched_loci(t, "F"))


@_add("I2_projection_cardinality", f"SELECT locus_id, 1 AS expected, count(l_orderkey) AS found FROM ({BASE}) LEFT JOIN (SELECT l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_type = 'PROMO') ON locus_id = l_orderkey GROUP BY locus_id HAVING count(l_orderkey) <> 1")
def cardinality(spark: SparkSession, d: str) -> DataFrame:
    """Loci that a projection over their assertions does not hold exactly once."""
    t = facts(spark, d)
    base = f.matched_loci(t, "F")
    return f.cardinality_faults(base, t.assertion.where("kind = 'formal' and category = 'PROMO'").join(base, "locus_id", "left_semi"))


@_add("H3_anchor_documents", "SELECT 'src' || k AS anchor_key, array_to_string(list_sort(list(DISTINCT CAST(doc_id AS VARCHAR)) FILTER (doc_id IS NOT NULL)), ',') AS documents FROM range(25) t(k) LEFT JOIN documents ON source = 'src' || k GROUP BY 1")
def anchor_documents(spark: SparkSession, d: str) -> DataFrame:
    anchors = table(spark, d, "documents").select(F.col("source").alias("anchor_key"), F.col("doc_id").cast("string").alias("document_key"))
    wanted = spark.range(25).select(F.concat(F.lit("src"), F.col("id").cast("string")).alias("anchor_key"))
    found = f.anchor_documents(anchors, wanted)
    return found.select("anchor_key", F.when(F.size("documents") > 0, F.array_join("documents", ",")).alias("documents"))


@_add("F10_locus_projection", f"""SELECT locus_id, sequence_id, group_id, c_name AS group_name, c_mktsegment AS segment, c_acctbal AS balance, 'n' || c_nationkey AS term_id, n_name AS term_name, 'nation' AS rank, o_totalprice AS price, o_orderdate AS placed_at,
 coalesce(n.calls, 0) AS calls, coalesce(n.categories, 0) AS categories FROM ({BASE}) JOIN orders ON o_orderkey = locus_id JOIN customer ON group_id = c_custkey JOIN nation ON c_nationkey = n_nationkey
 LEFT JOIN (SELECT l_orderkey, count(DISTINCT lineitem) AS calls, count(DISTINCT p_type) + count(DISTINCT p_brand) AS categories FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey) n ON n.l_orderkey = locus_id""")
def locus_projection(spark: SparkSession, d: str) -> DataFrame:
    """Thirteen columns of five tables, one row a locus."""
    t = facts(spark, d)
    return f.locus_projection(t, f.matched_loci(t, "F"))


@_add("F11_call_details", f"SELECT l_orderkey AS locus_id, l_partkey, l_linenumber, l_quantity AS score FROM lineitem WHERE l_orderkey IN (SELECT locus_id FROM ({BASE}))")
def call_details(spark: SparkSession, d: str) -> DataFrame:
    t = facts(spark, d)
    return f.call_details(t, f.matched_loci(t, "F")).select("locus_id", "call_key.l_partkey", "call_key.l_linenumber", "score")


@_add(
    "F12_assertion_details",
    f"SELECT DISTINCT locus_id, category, kind, n_name AS term_name FROM (SELECT l_orderkey AS locus_id, p_type AS category, 'formal' AS kind FROM lineitem JOIN part ON l_partkey = p_partkey UNION ALL SELECT l_orderkey, p_brand, 'study' FROM lineitem JOIN part ON l_partkey = p_partkey) JOIN ({BASE}) USING (locus_id) LEFT JOIN customer ON group_id = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey",
)
def assertion_details(spark: SparkSession, d: str) -> DataFrame:
    t = facts(spark, d)
    return f.assertion_details(t, f.matched_loci(t, "F"))


_METRIC_SQL = {
    "distinct_included_locus_count": ("A1", f"SELECT count(*) AS value FROM ({_FLAGSHIP})"),
    "distinct_contig_count": ("A2", f"SELECT count(*) AS value FROM (SELECT DISTINCT group_id, sequence_id FROM ({_FLAGSHIP}))"),
    "distinct_assembly_count": ("A3", f"SELECT count(DISTINCT group_id) AS value FROM ({_FLAGSHIP})"),
    "distinct_source_taxon_count": ("A4", f"SELECT count(DISTINCT c_nationkey) AS value FROM customer WHERE c_custkey IN (SELECT group_id FROM ({_FLAGSHIP}))"),
    "detection_call_count": ("A5", f"SELECT count(*) AS value FROM (SELECT DISTINCT * FROM lineitem WHERE l_orderkey IN (SELECT locus_id FROM ({_FLAGSHIP})))"),
}
for _name, (_id, _sql) in _METRIC_SQL.items():
    _add(f"{_id}_{_name}", _sql)(lambda s, d, n=_name: execute(Plan("aggregate", "F", (f.LineageFilter("r1", True), f.CategoryFilter("PROMO")), n), facts(s, d)))


@_add("A6_group_rows", f"SELECT group_id, c_name AS group_name, count(*) AS loci FROM ({BASE}) JOIN customer ON group_id = c_custkey GROUP BY ALL")
def group_rows(spark: SparkSession, d: str) -> DataFrame:
    t = facts(spark, d)
    return f.group_rows(t, f.matched_loci(t, "F"))


@_add("A7_taxon_rows", f"SELECT 'n' || c_nationkey AS term_id, n_name AS term_name, count(DISTINCT group_id) AS groups, count(*) AS loci FROM ({BASE}) JOIN customer ON group_id = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL")
def taxon_rows(spark: SparkSession, d: str) -> DataFrame:
    t = facts(spark, d)
    return f.taxon_rows(t, f.matched_loci(t, "F"))


@_add("A8_I1_assignment_faults", f"SELECT group_id, terms FROM (SELECT group_id, count(c_nationkey) AS terms FROM (SELECT DISTINCT group_id FROM ({BASE})) LEFT JOIN customer ON group_id = c_custkey AND c_nationkey <> 7 GROUP BY group_id) WHERE terms <> 1")
def assignment_faults(spark: SparkSession, d: str) -> DataFrame:
    """With one term withdrawn, so that faults exist."""
    t = facts(spark, d)
    broken = f.Facts(**{**t.__dict__, "assignment": t.assignment.where("term_id <> 'n7'")})
    return f.assignment_faults(broken, f.matched_loci(t, "F"))


@_add("A9_list_total", f"SELECT count(DISTINCT locus_id) AS total FROM ({BASE}) WHERE {_BELOW}")
def list_total(spark: SparkSession, d: str) -> DataFrame:
    return total(Plan("list_loci", "F", (f.LineageFilter("r1", True),)), facts(spark, d))


@_add("A10_array_agg_distinct", f"SELECT group_id, array_to_string(list_sort(list(DISTINCT sequence_id)), '|') AS sequences FROM ({BASE}) GROUP BY group_id")
def array_agg(spark: SparkSession, d: str) -> DataFrame:
    return f.matched_loci(facts(spark, d), "F").groupBy("group_id").agg(F.array_join(F.array_sort(F.collect_set("sequence_id")), "|").alias("sequences"))


@_add("W7_W8_keyset_page", f"SELECT * FROM ({BASE}) WHERE (group_id, locus_id) > (20, 10) ORDER BY group_id, locus_id LIMIT 26")
def keyset_page(spark: SparkSession, d: str) -> DataFrame:
    return execute(Plan("list_loci", "F", limit=25, after=(20, 10)), facts(spark, d))


@_add("W15_complete_list", f"SELECT * FROM ({BASE}) WHERE {_EXACT}")
def complete_list(spark: SparkSession, d: str) -> DataFrame:
    """Every page at once: no paging is needed where the result is a table."""
    return f.matched_loci(facts(spark, d), "F", (f.LineageFilter("n5"),)).orderBy("group_id", "locus_id")


@_add("J1_composite_join", "SELECT o_orderkey, o_custkey, l_linenumber FROM orders JOIN (SELECT l_orderkey, l_linenumber, l_linestatus FROM lineitem) ON o_orderkey = l_orderkey AND o_orderstatus = l_linestatus")
def composite_join(spark: SparkSession, d: str) -> DataFrame:
    line = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linestatus").alias("o_orderstatus"), "l_linenumber")
    return table(spark, d, "orders").join(line, ["o_orderkey", "o_orderstatus"]).select("o_orderkey", "o_custkey", "l_linenumber")


@_add("J2_join_chain", "SELECT l_orderkey, s_name, n_name, r_name, p_brand FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey WHERE l_quantity > 45")
def join_chain(spark: SparkSession, d: str) -> DataFrame:
    line, supplier, nation, region, part = (table(spark, d, n) for n in ("lineitem", "supplier", "nation", "region", "part"))
    out = line.where("l_quantity > 45").join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return out.join(region, F.col("n_regionkey") == F.col("r_regionkey")).join(part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "s_name", "n_name", "r_name", "p_brand")


@_add("J3_left_join_predicate_in_on", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P'")
def left_on(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").join(table(spark, d, "orders").where("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey")


@_add("J4_left_enrichment", "SELECT l_orderkey, l_linenumber, p_brand FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size > 25) ON l_partkey = p_partkey")
def left_enrichment(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").join(table(spark, d, "part").where("p_size > 25"), F.col("l_partkey") == F.col("p_partkey"), "left").select("l_orderkey", "l_linenumber", "p_brand")


@_add("J6_anti_join", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def anti(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


@_add("J7_H18_closure", CLOSURE)
def closure(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = lineage(spark, d)
    return taxonomy.closure(edges, nodes)


@_add("X37_ancestors", f"SELECT DISTINCT ancestor_id AS node_id FROM ({CLOSURE}) WHERE descendant_id IN ('n3', 'n8')")
def ancestors(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = lineage(spark, d)
    return taxonomy.ancestors(taxonomy.closure(edges, nodes), nodes.where("node_id in ('n3', 'n8')").select("node_id"))


@_add(
    "X36_merged_ids",
    "WITH RECURSIVE hop AS (SELECT n_nationkey AS id, n_nationkey AS now, 0 AS h FROM nation UNION ALL SELECT id, now + 5, h + 1 FROM hop WHERE now < 15 AND now % 5 = 2) SELECT id, resolved_id, CASE WHEN resolved_id IN (4, 9) THEN 'deleted' WHEN h > 0 THEN 'merged' ELSE 'current' END AS status FROM (SELECT id, arg_max(now, h) AS resolved_id, max(h) AS h FROM hop GROUP BY id)",
)
def merged_ids(spark: SparkSession, d: str) -> DataFrame:
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"))
    links = nation.where("id < 15 and id % 5 = 2").select(F.col("id").alias("old_id"), (F.col("id") + 5).alias("new_id"))
    return taxonomy.resolve_merged(nation, links, nation.where("id in (4, 9)"))


@_add("H33_name_mapping", "SELECT name, rank, CASE WHEN count(t) = 1 THEN min(t) END AS term_id, count(t) AS matches FROM (SELECT DISTINCT p_name AS name, CAST(p_size AS VARCHAR) AS rank FROM part) LEFT JOIN (SELECT p_name AS name, CAST(p_size AS VARCHAR) AS rank, p_partkey AS t FROM part) USING (name, rank) GROUP BY name, rank")
def name_mapping(spark: SparkSession, d: str) -> DataFrame:
    """Every distinct name and rank, looked up among all."""
    part = table(spark, d, "part").select(F.col("p_name").alias("name"), F.col("p_size").cast("string").alias("rank"), F.col("p_partkey").alias("term_id"))
    return taxonomy.map_names(part.select("name", "rank").distinct(), part)


@_add("J9_join_to_aggregate", "SELECT c_custkey, statuses FROM customer LEFT JOIN (SELECT o_custkey, array_to_string(list_sort(list(DISTINCT o_orderstatus)), ',') AS statuses FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey")
def join_to_aggregate(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderstatus")), ",").alias("statuses"))
    return table(spark, d, "customer").join(own, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "statuses")


@_add("J12_anchor_targets", "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders WHERE o_custkey = 7 OR (o_orderstatus = 'P' AND o_orderpriority = '1-URGENT') OR o_orderkey = 3")
def anchors(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority").withColumn("none", F.lit(None).cast("string"))
    targets = spark.createDataFrame([("group", "7", None), ("state", "P", "1-URGENT"), ("locus", "3", None)], "kind string, k1 string, k2 string")
    return f.resolve_anchors(orders, targets, {"group": ("o_custkey", "none"), "state": ("o_orderstatus", "o_orderpriority"), "locus": ("o_orderkey", "none")}).drop("none")


@_add("H27_relational_division", "SELECT l_orderkey AS locus_id FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_type IN ('PROMO', 'ECONOMY', 'SMALL') GROUP BY l_orderkey HAVING count(DISTINCT p_type) = 3")
def division(spark: SparkSession, d: str) -> DataFrame:
    return f.having_all(facts(spark, d).assertion.where("kind = 'formal'"), "locus_id", "category", ("PROMO", "ECONOMY", "SMALL"))


@_add("U1_union_distinct", "SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'F' UNION SELECT l_orderkey FROM lineitem WHERE l_quantity = 1")
def union_distinct(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"))
    return a.union(table(spark, d, "lineitem").where("l_quantity = 1").select("l_orderkey")).distinct()


@_add("U2_union_records", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union_records(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, d, "supplier").select("s_nationkey")).distinct()


@_add("F21_release_scope", f"SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_orderkey IN (SELECT locus_id FROM ({BASE}))")
def release_scope(spark: SparkSession, d: str) -> DataFrame:
    public = f.matched_loci(facts(spark, d), "F").select(F.col("locus_id").alias("l_orderkey"))
    return table(spark, d, "lineitem").join(public, "l_orderkey", "left_semi").select("l_orderkey", "l_linenumber", "l_suppkey")


@_add("F21_scoped_tables", f"""WITH b AS ({BASE}) SELECT 'customer' AS "table", CAST(c_custkey AS VARCHAR) AS key FROM customer WHERE c_custkey IN (SELECT group_id FROM b) UNION ALL SELECT 'lineitem', CAST(l_orderkey AS VARCHAR) FROM lineitem WHERE l_orderkey IN (SELECT locus_id FROM b)
 UNION ALL SELECT 'nation', CAST(n_nationkey AS VARCHAR) FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_custkey IN (SELECT group_id FROM b)) UNION ALL SELECT 'orders', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderkey IN (SELECT locus_id FROM b)
 UNION ALL SELECT 'part', CAST(p_partkey AS VARCHAR) FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_orderkey IN (SELECT locus_id FROM b))""")
def scoped_tables(spark: SparkSession, d: str) -> DataFrame:
    """The rows of five tables that one release's loci reach."""
    base = f.matched_loci(facts(spark, d), "F")
    line, customer = table(spark, d, "lineitem"), table(spark, d, "customer")
    loci, groups = base.select("locus_id"), base.select("group_id").distinct()
    terms = customer.join(groups, customer.c_custkey == groups.group_id, "left_semi").select("c_nationkey").distinct()
    n = tasks_for(line, 4 * ROWS_A_TASK)
    called = line.select(F.col("l_orderkey").alias("locus_id"), "l_partkey").repartition(n, "locus_id")
    parts = called.join(loci.repartition(n, "locus_id"), "locus_id", "left_semi").select("l_partkey").distinct()
    rows = {"orders": (table(spark, d, "orders"), "o_orderkey", "locus"), "lineitem": (line, "l_orderkey", "locus"), "customer": (customer, "c_custkey", "group"), "nation": (table(spark, d, "nation"), "n_nationkey", "term"), "part": (table(spark, d, "part"), "p_partkey", "part")}
    return f.scoped(rows, {"locus": loci, "group": groups, "term": terms, "part": parts})


@_add("F18_reports_by_ancestor", f"SELECT c_custkey, 'n' || c_nationkey AS taxon FROM customer WHERE 'n' || c_nationkey IN (SELECT descendant_id FROM ({CLOSURE}) WHERE ancestor_id = 'r2') AND c_mktsegment = 'BUILDING'")
def reports_by_ancestor(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = lineage(spark, d)
    above = taxonomy.closure(edges, nodes).groupBy("descendant_id").agg(F.collect_set("ancestor_id").alias("above"))
    own = table(spark, d, "customer").withColumn("taxon", F.concat(F.lit("n"), "c_nationkey"))
    return own.join(above, own.taxon == above.descendant_id).where(F.array_contains("above", "r2") & (F.col("c_mktsegment") == "BUILDING")).select("c_custkey", "taxon")
