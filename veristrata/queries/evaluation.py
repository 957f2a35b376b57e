"""Evaluation queries: retrieval quality, set scores, latency, refusal, grounding and efficiency."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import metrics as m
from .mapping import table

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {}


def _add(name: str, sql: str):
    def keep(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn, sql
        return fn

    return keep


#: Questions from customers: two evidence groups each and a ranked list of their orders.
_Q = "SELECT 'q' || o_custkey AS question_id, 'c' || o_custkey % 3 AS category, list(o_orderkey ORDER BY o_orderkey * 31 % 101, o_orderkey) AS returned, min(o_orderkey) AS g1, max(o_orderkey) AS g2 FROM orders GROUP BY o_custkey"


def _questions(spark: SparkSession, d: str) -> DataFrame:
    ordered = F.transform(F.array_sort(F.collect_list(F.struct((F.col("o_orderkey") * 31 % 101).alias("a"), F.col("o_orderkey").alias("b")))), lambda x: x["b"].cast("string"))
    rows = table(spark, d, "orders").groupBy("o_custkey").agg(ordered.alias("returned"), F.min("o_orderkey").cast("string").alias("g1"), F.max("o_orderkey").cast("string").alias("g2"))
    return rows.select(F.concat(F.lit("q"), "o_custkey").alias("question_id"), F.concat(F.lit("c"), F.col("o_custkey") % 3).alias("category"), F.array(F.array("g1"), F.array("g2")).alias("evidence_groups"), "returned")


def _recall(k: int) -> str:
    return f"round(((list_position(returned, g1) BETWEEN 1 AND {k})::INT + (list_position(returned, g2) BETWEEN 1 AND {k})::INT) / 2.0::DOUBLE, 12)"


_P1, _P2 = "list_position(returned, g1)", "list_position(returned, g2)"
_DCG = f"(CASE WHEN {_P1} <= 10 THEN 1 / log2({_P1} + 1) ELSE 0 END + CASE WHEN {_P2} <= 10 AND g1 <> g2 THEN 1 / log2({_P2} + 1) ELSE 0 END)"
_METRICS = f"SELECT question_id, category, {_recall(1)} AS recall_at_1, {_recall(3)} AS recall_at_3, {_recall(5)} AS recall_at_5, {_recall(10)} AS recall_at_10, CASE WHEN least({_P1}, {_P2}) <= 10 THEN round(1.0::DOUBLE / least({_P1}, {_P2}), 12) ELSE 0 END AS mrr_at_10, round({_DCG} / (1 + 1 / log2(3)), 9) AS ndcg_at_10 FROM ({_Q})"


def _metrics(spark: SparkSession, d: str) -> DataFrame:
    return m.question_metrics(_questions(spark, d)).withColumn("ndcg_at_10", F.round("ndcg_at_10", 9))


@_add("H11_X25_X26_X27_question_metrics", _METRICS)
def question_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _metrics(spark, d)


@_add("A17_A18_quality_summary", f"SELECT category, count(*) AS questions, round(avg(recall_at_5), 9) AS recall_at_5, round(avg(mrr_at_10), 9) AS mrr_at_10 FROM ({_METRICS}) GROUP BY ROLLUP (category)")
def summary(spark: SparkSession, d: str) -> DataFrame:
    return m.summarize(_metrics(spark, d), ["recall_at_5", "mrr_at_10"]).select("category", "questions", F.round("recall_at_5", 9).alias("recall_at_5"), F.round("mrr_at_10", 9).alias("mrr_at_10"))


@_add("A25_release_gate", f"SELECT avg(recall_at_5) >= 0.8 AND avg(recall_at_10) >= 0.9 AND (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) = 0 AND (SELECT min(n_chars) > 0 FROM documents) AS passes FROM ({_METRICS})")
def gate(spark: SparkSession, d: str) -> DataFrame:
    """Recall of the questions; labels as citations of documents, lengths as locators."""
    one = _metrics(spark, d).agg(F.avg("recall_at_5").alias("recall_at_5"), F.avg("recall_at_10").alias("recall_at_10"))
    docs = table(spark, d, "documents")
    cited = table(spark, d, "labels").join(docs.select("doc_id"), "doc_id", "left_anti").agg((F.count("*") == 0).alias("citations_valid"))
    located = docs.agg((F.min("n_chars") > 0).alias("locators_valid"))
    return m.release_gate(one.crossJoin(cited).crossJoin(located))  # single rows


@_add("A19_latency_quantiles", "SELECT event_type, count(*) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY event_type")
def latency(spark: SparkSession, d: str) -> DataFrame:
    return m.latency(table(spark, d, "events"), ["event_type"], "value")


@_add("A20_ratio_with_reason", "SELECT o_custkey, CASE WHEN p > 0 THEN round(f / p::DOUBLE, 12) END AS value, CASE WHEN p = 0 THEN 'no_pending' END AS reason FROM (SELECT o_custkey, count_if(o_orderstatus = 'F') AS f, count_if(o_orderstatus = 'P') AS p FROM orders GROUP BY o_custkey)")
def ratios(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("f"), F.count_if(F.col("o_orderstatus") == "P").alias("p"))
    return rows.select("o_custkey", scalar.ratio(F.col("f"), F.col("p")).alias("value"), scalar.ratio_reason(F.col("p"), "no_pending").alias("reason"))


@_add("A26_aggregate_ratio", "SELECT round(sum(l_discount) / sum(l_tax + 0.01), 6) AS value FROM lineitem")
def aggregate_ratio(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").agg(F.round(F.sum("l_discount") / F.sum(F.col("l_tax") + 0.01), 6).alias("value"))


@_add("X22_half_up", "SELECT l_orderkey, CAST(round(CAST(l_quantity AS DECIMAL(18, 8)) / 7, 3) AS DOUBLE) AS v FROM lineitem")
def half_up(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", scalar.half_up(F.col("l_quantity") / 7, 3).cast("double").alias("v"))


_REFUSAL = "SELECT o_orderstatus = 'P' AS s, o_orderpriority <> '5-LOW' AS r, o_orderkey % 3 = 0 AS c FROM orders"


@_add("A21_refusal_summary", f"SELECT round(count_if(s AND r) / count_if(s)::DOUBLE, 12) AS refusal_recall, round(count_if(s AND r) / count_if(r)::DOUBLE, 12) AS refusal_precision, round(count_if(NOT s AND NOT r) / count_if(NOT s)::DOUBLE, 12) AS answer_rate, round(count_if(s AND r AND c) / count_if(s)::DOUBLE, 12) AS code_accuracy, count_if(NOT s AND r) AS false_refusals FROM ({_REFUSAL})")
def refusal(spark: SparkSession, d: str) -> DataFrame:
    return m.refusal_summary(table(spark, d, "orders").select((F.col("o_orderstatus") == "P").alias("should_refuse"), (F.col("o_orderpriority") != "5-LOW").alias("refused"), (F.col("o_orderkey") % 3 == 0).alias("code_matches")))


@_add("A22_efficiency_summary", "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, CAST(sum(user_id) AS BIGINT) AS tokens, max(event_id) AS max_rss, CASE WHEN count(cost) = count(*) THEN CAST(sum(cost) AS BIGINT) END AS cost FROM (SELECT *, CASE WHEN event_id <> 2 THEN event_id END AS cost FROM events) GROUP BY event_type")
def efficiency(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_type", F.col("value").alias("latency"), F.col("user_id").alias("tokens"), F.col("event_id").alias("rss"), F.when(F.col("event_id") != 2, F.col("event_id")).alias("cost"))
    return m.efficiency(rows, ["event_type"])


_GROUND = "SELECT list_distinct(list(l_partkey % 9)) AS a, list_distinct(list(l_suppkey % 7)) AS b, list_distinct(list(l_linenumber)) AS c FROM lineitem GROUP BY l_orderkey"


@_add("A23_grounding", f"SELECT round(sum(len(list_intersect(a, b))) / sum(len(a))::DOUBLE, 12) AS claim_support, round(sum(len(list_intersect(a, c))) / sum(len(a))::DOUBLE, 12) AS claim_citation, round(sum(len(list_intersect(c, b))) / sum(len(c))::DOUBLE, 12) AS citation_precision, round(sum(len(list_intersect(c, a))) / sum(len(a))::DOUBLE, 12) AS citation_recall, CAST(sum(len(a) - len(list_intersect(a, b))) AS BIGINT) AS unsupported_claims, CAST(sum(len(c) - len(list_intersect(c, b))) AS BIGINT) AS invalid_citations FROM ({_GROUND})")
def grounding(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set((F.col("l_partkey") % 9).cast("long")).alias("claims"), F.collect_set((F.col("l_suppkey") % 7).cast("long")).alias("supported"), F.collect_set(F.col("l_linenumber").cast("long")).alias("cited"))
    return m.grounding(own.select("claims", "supported", "cited", F.col("cited").alias("citations"), F.col("supported").alias("valid_citations"), F.col("claims").alias("gold")))


_ANSWERS = """SELECT l_shipdate IS NOT NULL AS shipped, l_returnflag AS system, count_if(l_quantity > 10) AS covered_facts, count(*) AS required_facts, count_if(l_tax < 0.05) AS preserved_facts, count(*) AS supplied_facts,
 count_if(l_linenumber % 4 = 0) AS fully_supported, count_if(l_linenumber % 4 = 1) AS partially_supported, count_if(l_linenumber % 4 = 2) AS unsupported, count_if(l_linenumber % 4 < 3) AS assessable,
 count_if(l_partkey % 3 > 0) AS correct_documents, count_if(l_partkey % 3 = 1) AS correct_passages, count_if(l_partkey % 6 = 1) AS supporting_passages, count(*) AS judged, count_if(l_suppkey % 2 = 0) AS cited_groups, count(*) AS required_groups,
 0 AS present_limitations, 0 AS required_limitations FROM lineitem GROUP BY ALL"""


@_add("A23_grounding_rates", " UNION ALL ".join(f"SELECT system, '{n}' AS metric, {a}::BIGINT AS numerator, {b}::BIGINT AS denominator, CASE WHEN {b} > 0 THEN round({a} / {b}::DOUBLE, 12) END AS value, CASE WHEN {b} = 0 THEN '{why}' END AS reason FROM ({_ANSWERS})" for n, a, b, why in m.GROUNDING))
def grounding_rates(spark: SparkSession, d: str) -> DataFrame:
    """All ten ratios by system, orders as answers; none requires a limitation."""
    line = F.col("l_linenumber") % 4
    label = F.when(line == 0, "fully_supported").when(line == 1, "partially_supported").when(line == 2, "unsupported").otherwise("not_assessable")
    count = lambda cond: F.count_if(F.expr(cond))
    rows = table(spark, d, "lineitem").groupBy("l_orderkey", F.col("l_returnflag").alias("system")).agg(
        F.collect_list(label).alias("claim_labels"), count("l_quantity > 10").alias("covered_facts"), F.count("*").alias("required_facts"), count("l_tax < 0.05").alias("preserved_facts"), F.count("*").alias("supplied_facts"),
        count("l_partkey % 3 > 0").alias("correct_documents"), count("l_partkey % 3 = 1").alias("correct_passages"), count("l_partkey % 6 = 1").alias("supporting_passages"), F.count("*").alias("judged"), count("l_suppkey % 2 = 0").alias("cited_groups"), F.count("*").alias("required_groups"),
        F.lit(0).alias("present_limitations"), F.lit(0).alias("required_limitations"),
    )
    return m.grounding_rates(rows, ["system"])


_GOLD, _PRED = "SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'P'", "SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT'"


@_add("J13_association_scores", f"SELECT m AS matched, g - m AS missing, p - m AS extra, round(m / p::DOUBLE, 12) AS precision, NULL::VARCHAR AS precision_reason, round(m / g::DOUBLE, 12) AS recall, NULL::VARCHAR AS recall_reason, round(2 * m / (g + p)::DOUBLE, 12) AS f1 FROM (SELECT (SELECT count(*) FROM ({_GOLD})) AS g, (SELECT count(*) FROM ({_PRED})) AS p, (SELECT count(*) FROM ({_GOLD}) JOIN ({_PRED}) USING (k)) AS m)")
def associations(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderstatus", "o_orderpriority")
    return m.association_scores(orders.where("o_orderstatus = 'P'").select("k"), orders.where("o_orderpriority = '1-URGENT'").select("k"), "k")


@_add("J14_U7_multiset_overlap", "SELECT CAST(sum(least(a, b)) AS BIGINT) AS overlap FROM (SELECT l_partkey AS k, count(*) AS a FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) JOIN (SELECT l_partkey AS k, count(*) AS b FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) USING (k)")
def overlap(spark: SparkSession, d: str) -> DataFrame:
    line = table(spark, d, "lineitem")
    return m.multiset_overlap(line.where("l_returnflag = 'A'").select(F.col("l_partkey").alias("k")), line.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("k")), "k")


def _masked(cols: str) -> str:
    return f"SELECT coalesce(sum(least(a, b)), 0) FROM (SELECT {cols}, count(*) AS a FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL) JOIN (SELECT {cols}, count(*) AS b FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL) USING ({cols})"


@_add("X40_association_corruption", f"SELECT CAST(({_masked('l_partkey, l_linenumber')}) - ({_masked('l_partkey, l_linenumber, l_suppkey')}) AS BIGINT) AS corrupted")
def corrupted(spark: SparkSession, d: str) -> DataFrame:
    line = table(spark, d, "lineitem").select("l_partkey", "l_linenumber", "l_suppkey", "l_returnflag")
    return m.corruption(line.where("l_returnflag = 'A'"), line.where("l_returnflag = 'R'"), ["l_partkey", "l_linenumber", "l_suppkey"], "l_suppkey")


_SETS = "SELECT o_custkey, list_distinct(list(o_orderkey % 5)) AS e, list_distinct(list(o_orderkey % 3)) AS o FROM orders GROUP BY o_custkey"


@_add("U4_U5_H13_set_scores", f"SELECT o_custkey, array_to_string(list_sort(list_filter(e, lambda x: NOT list_contains(o, x))), ',') AS missing, array_to_string(list_sort(list_filter(o, lambda x: NOT list_contains(e, x))), ',') AS extra, list_sort(e) = list_sort(o) AS equal FROM ({_SETS})")
def sets(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_set((F.col("o_orderkey") % 5).cast("string")).alias("e"), F.collect_set((F.col("o_orderkey") % 3).cast("string")).alias("o"))
    missing, extra, equal = m.set_scores(F.col("e"), F.col("o"))
    return rows.select("o_custkey", F.array_join(missing, ",").alias("missing"), F.array_join(extra, ",").alias("extra"), equal.alias("equal"))


@_add("U6_any_intersection", f"SELECT o_custkey, list_has_any(e, [4]) AS hit FROM ({_SETS})")
def overlap_any(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_set(F.col("o_orderkey") % 5).alias("e"))
    return rows.select("o_custkey", F.arrays_overlap("e", F.array(F.lit(4).cast("long"))).alias("hit"))


@_add("H28_matched_cohort", "SELECT event_id, user_id, event_type FROM events WHERE event_type IN ('click', 'view', 'error') AND user_id IN (SELECT user_id FROM events WHERE event_type IN ('click', 'view', 'error') GROUP BY user_id HAVING count(DISTINCT event_type) = 3)")
def matched(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").where("event_type in ('click', 'view', 'error')").select("event_id", "user_id", "event_type")
    return m.observed_in_all(rows, "user_id", "event_type", ("click", "view", "error"))


@_add("H31_stable_runs", "SELECT o_custkey, count(DISTINCT o_orderstatus) = 1 AS stable FROM orders GROUP BY o_custkey")
def stable(spark: SparkSession, d: str) -> DataFrame:
    return m.stable_runs(table(spark, d, "orders").select("o_custkey", F.array("o_orderstatus").alias("keys")), ["o_custkey"], "keys")


@_add("H31_measured_runs", "SELECT o_custkey, count(DISTINCT o_orderstatus) = 1 AS stable FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i FROM orders) WHERE i >= 2 GROUP BY o_custkey")
def measured(spark: SparkSession, d: str) -> DataFrame:
    """As above, with a customer's first two orders as warm-up."""
    run = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    return m.stable_runs(table(spark, d, "orders").select("o_custkey", F.array("o_orderstatus").alias("keys"), run.alias("i")), ["o_custkey"], "keys", "i", 2)


_LISTS = "SELECT o_custkey, list(o_orderkey ORDER BY o_totalprice, o_orderkey) AS r, list(o_orderkey) FILTER (o_orderstatus = 'P') AS g FROM orders GROUP BY o_custkey"
_AT = "list_position(r, x)"


@_add("X28_legacy_metrics", f"""SELECT o_custkey, recall_at_5, mrr_at_10, round(dcg / list_sum([1 / log2(i + 1) FOR i IN range(1, least(n, 10) + 1)]), 9) AS ndcg_at_10 FROM (SELECT o_custkey, any_value(len(g)) AS n, round(count_if({_AT} <= 5) / any_value(len(g))::DOUBLE, 12) AS recall_at_5,
 round(CASE WHEN min({_AT}) <= 10 THEN 1.0::DOUBLE / min({_AT}) ELSE 0 END, 12) AS mrr_at_10, sum(CASE WHEN {_AT} <= 10 THEN 1 / log2({_AT} + 1) ELSE 0 END) AS dcg FROM (SELECT *, unnest(g) AS x FROM ({_LISTS}) WHERE g IS NOT NULL) GROUP BY o_custkey)
 UNION ALL SELECT o_custkey, NULL, NULL, NULL FROM ({_LISTS}) WHERE g IS NULL""")
def legacy_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Customers as questions: their orders by price are returned, the pending ones relevant."""
    returned = F.transform(F.array_sort(F.collect_list(F.struct("o_totalprice", "o_orderkey"))), lambda x: x["o_orderkey"])
    rows = table(spark, d, "orders").groupBy("o_custkey").agg(returned.alias("returned"), F.collect_list(F.when(F.col("o_orderstatus") == "P", F.col("o_orderkey"))).alias("relevant"))
    return m.legacy_metrics(rows).select("o_custkey", "recall_at_5", "mrr_at_10", F.round("ndcg_at_10", 9).alias("ndcg_at_10"))


@_add("X28_legacy_recall", "SELECT o_custkey, round(count_if(l_orderkey IS NOT NULL) / count(*)::DOUBLE, 12) AS recall FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity > 40) ON o_orderkey = l_orderkey GROUP BY o_custkey")
def legacy(spark: SparkSession, d: str) -> DataFrame:
    got = table(spark, d, "lineitem").where("l_quantity > 40").select("l_orderkey").distinct()
    rows = table(spark, d, "orders").join(got, F.col("o_orderkey") == F.col("l_orderkey"), "left").groupBy("o_custkey")
    return rows.agg(F.bround(F.count("l_orderkey") / F.count("*"), 12).alias("recall"))


@_add("X39_citation_order", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY CAST(substr('D' || event_id, 2) AS BIGINT)) AS n FROM events")
def citations(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    rows = table(spark, d, "events").withColumn("citation", F.concat(F.lit("D"), "event_id"))
    return rows.select("event_id", F.row_number().over(Window.partitionBy("user_id").orderBy(F.substring("citation", 2, 20).cast("long"))).alias("n"))



@_add("H12_retrieval_scores", f"""SELECT question_id, category, {_recall(1)} AS recall_at_1, {_recall(5)} AS recall_at_5, CASE WHEN least({_P1}, {_P2}) <= 10 THEN round(1.0::DOUBLE / least({_P1}, {_P2}), 12) ELSE 0 END AS mrr_at_10, round({_DCG} / (1 + 1 / log2(3)), 9) AS ndcg_at_10,
 (SELECT count(*) FROM orders WHERE o_orderstatus = 'P' AND list_contains(returned, o_orderkey))::INT AS excluded_hits, NULL::VARCHAR AS error FROM ({_Q}) WHERE len(returned) <= 10
 UNION ALL SELECT question_id, category, NULL, NULL, NULL, NULL, NULL, 'too_many_results' FROM ({_Q}) WHERE len(returned) > 10""")
def retrieval_scores(spark: SparkSession, d: str) -> DataFrame:
    """The questions' scores, with hits among pending orders as excluded ones; too many results are an error, not cut."""
    pending = table(spark, d, "orders").where("o_orderstatus = 'P'").groupBy(F.concat(F.lit("q"), "o_custkey").alias("question_id")).agg(F.collect_list(F.col("o_orderkey").cast("string")).alias("excluded"))
    rows = _questions(spark, d).join(pending, "question_id", "left")
    return m.score_retrieval(rows).select("question_id", "category", "recall_at_1", "recall_at_5", "mrr_at_10", F.round("ndcg_at_10", 9).alias("ndcg_at_10"), "excluded_hits", "error")
