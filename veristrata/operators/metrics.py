"""Exact retrieval, set, refusal, grounding and efficiency metrics."""

from __future__ import annotations

from decimal import Context, Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import ratio, ratio_reason
from .pages import numbered


def recall_at(groups: Column, returned: Column, k: int) -> Column:
    """Share of evidence groups that the first ``k`` results touch; null without groups."""
    hit = F.size(F.filter(groups, lambda g: F.arrays_overlap(g, F.slice(returned, 1, k))))
    return ratio(hit, F.size(groups))


def reciprocal_rank(groups: Column, returned: Column, k: int = 10) -> Column:
    """One over the first rank within ``k`` that any group holds, else 0."""
    flat = F.flatten(groups)
    at = F.array_min(F.filter(F.transform(flat, lambda x: F.array_position(F.slice(returned, 1, k), x)), lambda p: p > 0))
    return F.coalesce(F.bround(F.lit(1.0) / at, 12), F.lit(0.0))


def _gains(k: int) -> list[Decimal]:
    """``1 / log2(rank + 1)`` to 18 places."""
    ctx = Context(prec=50)
    return [ctx.divide(1, ctx.divide(ctx.ln(Decimal(r + 1)), ctx.ln(Decimal(2)))).quantize(Decimal("1e-18")) for r in range(1, k + 1)]


def ndcg(groups: Column, returned: Column, k: int = 10) -> Column:
    """Every evidence group is credited once, greedily by rank: each result takes the first group left that holds it.
    Decimals of 18 places; null without groups."""
    gains = F.array(*[F.lit(str(g)).cast("decimal(20,18)") for g in _gains(k)])
    shown = F.slice(F.coalesce(returned, F.array().cast("array<string>")), 1, k)
    zero = F.struct(F.array().cast("array<int>").alias("used"), F.lit(0).cast("decimal(20,18)").alias("got"), F.lit(1).alias("rank"))

    def step(state: Column, key: Column) -> Column:
        fits = lambda i: ~F.array_contains(state["used"], i) & F.coalesce(F.array_contains(F.element_at(groups, i), key), F.lit(False))
        hit = F.array_min(F.filter(F.sequence(F.lit(1), F.size(groups)), fits))
        got = (state["got"] + F.when(hit.isNull(), F.lit(0)).otherwise(F.element_at(gains, state["rank"]))).cast("decimal(20,18)")
        return F.struct(F.when(hit.isNull(), state["used"]).otherwise(F.array_append(state["used"], hit)).alias("used"), got.alias("got"), (state["rank"] + 1).alias("rank"))

    best = F.aggregate(F.slice(gains, 1, F.least(F.lit(k), F.size(groups))), F.lit(0).cast("decimal(20,18)"), lambda s, g: (s + g).cast("decimal(20,18)"))
    return F.when(F.size(groups) > 0, F.bround(F.aggregate(shown, zero, step, lambda s: s["got"]) / best, 12).cast("double"))


def question_metrics(rows: DataFrame) -> DataFrame:
    """``rows``: ``question_id, category, evidence_groups, returned``."""
    g, r = F.col("evidence_groups"), F.col("returned")
    return rows.select("question_id", "category", *[recall_at(g, r, k).alias(f"recall_at_{k}") for k in (1, 3, 5, 10)], reciprocal_rank(g, r).alias("mrr_at_10"), ndcg(g, r).alias("ndcg_at_10"))


#: Results of one question that a score looks at.
DEPTH = 10


def score_retrieval(rows: DataFrame) -> DataFrame:
    """As :func:`question_metrics`, with ``excluded_hits``: how many of the results are among ``excluded`` (array). More
    than ``DEPTH`` results, or a result twice, is an error of the caller and not cut: such a question has no numbers, and
    ``error`` says why."""
    r = F.col("returned")
    error = F.when(F.size(r) > DEPTH, "too_many_results").when(F.size(F.array_distinct(r)) != F.size(r), "repeated_results")
    judged = rows.withColumn("error", error).withColumn("_hits", F.size(F.filter(r, lambda k: F.coalesce(F.array_contains("excluded", k), F.lit(False)))))
    scores = question_metrics(judged)
    own = judged.select(F.col("question_id").alias("_id"), "error", F.when(F.col("error").isNull(), F.col("_hits")).alias("excluded_hits"))
    numbers = [F.when(F.col("error").isNull(), F.col(c)).alias(c) for c in scores.columns if c not in ("question_id", "category")]
    return scores.join(own, F.col("question_id").eqNullSafe(F.col("_id"))).select("question_id", "category", *numbers, "excluded_hits", "error")


def summarize(metrics: DataFrame, columns: list[str]) -> DataFrame:
    """Macro means per category and overall (category null): one rollup."""
    return metrics.rollup("category").agg(F.count("*").alias("questions"), *[F.bround(F.avg(c), 12).alias(c) for c in columns])


def quantiles(rows: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Exact nearest-rank quantiles of every group, named by ``shares``: rows are placed in sorted ranges, and the rows at
    the wanted places are picked. A group with most of the rows is spread over many ranges. Nulls take no part."""
    own = rows.where(F.col(value).isNotNull()).select(F.struct(*by).alias("_group"), F.col(value).alias("_v"))
    placed = numbered(own, "_group", ["_v"], 1)
    sizes = own.groupBy(F.col("_group").alias("_g")).agg(F.count("*").alias("_n"))
    wanted = {name: F.ceil(F.col("_n") * share) - 1 for name, share in shares.items()}
    met = placed.join(sizes, F.col("_group").eqNullSafe(F.col("_g"))).where(F.array_contains(F.array(*wanted.values()), F.col("place")))
    picked = met.groupBy("_group").agg(*[F.max(F.when(F.col("place") == at, F.col("_v"))).alias(name) for name, at in wanted.items()])
    return picked.select(*[F.col(f"_group.{c}").alias(c) for c in by], *shares)


def _same(by: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by])


def _with_quantiles(sums: DataFrame, rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """``sums`` with p50 and p95; a group without any value has none."""
    found = quantiles(rows, by, value, {"p50": 0.5, "p95": 0.95})
    return sums.alias("a").join(found.alias("b"), _same(by), "left").select("a.*", "b.p50", "b.p95")


def latency(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Number of rows and nearest-rank p50 and p95."""
    out = _with_quantiles(rows.groupBy(*by).agg(F.count("*").alias("n")), rows, by, value)
    return out.select(*by, "n", "p50", "p95")


def efficiency(rows: DataFrame, by: list[str]) -> DataFrame:
    """Latency quantiles, sums, peak memory; a cost is null as soon as one row lacks it."""
    sums = rows.groupBy(*by).agg(F.sum("tokens").alias("tokens"), F.max("rss").alias("max_rss"), F.when(F.count("cost") == F.count("*"), F.sum("cost")).alias("cost"))
    return _with_quantiles(sums, rows, by, "latency").select(*by, "p50", "p95", "tokens", "max_rss", "cost")


def association_scores(gold: DataFrame, predicted: DataFrame, key: str) -> DataFrame:
    """Matched, missing and extra keys with precision, recall and F1; undefined ratios are null with a reason."""
    g, p = gold.select(key).distinct().withColumn("_g", F.lit(1)), predicted.select(key).distinct().withColumn("_p", F.lit(1))
    counts = g.join(p, key, "full").agg(
        F.count_if(F.col("_g").isNotNull() & F.col("_p").isNotNull()).alias("matched"),
        F.count_if(F.col("_p").isNull()).alias("missing"),
        F.count_if(F.col("_g").isNull()).alias("extra"),
    )
    m, miss, extra = F.col("matched"), F.col("missing"), F.col("extra")
    return counts.select("matched", "missing", "extra", ratio(m, m + extra).alias("precision"), ratio_reason(m + extra, "no_predictions").alias("precision_reason"), ratio(m, m + miss).alias("recall"), ratio_reason(m + miss, "no_gold").alias("recall_reason"), ratio(2 * m, 2 * m + miss + extra).alias("f1"))


def multiset_overlap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Sum of the smaller counts of every key."""
    a, b = left.groupBy(key).agg(F.count("*").alias("_a")), right.groupBy(key).agg(F.count("*").alias("_b"))
    return a.join(b, key).agg(F.coalesce(F.sum(F.least("_a", "_b")), F.lit(0)).alias("overlap"))


def corruption(gold: DataFrame, predicted: DataFrame, dimensions: list[str], masked: str) -> DataFrame:
    """Predictions that equal a gold row in every dimension but ``masked``, beyond those equal in all."""
    rest = [d for d in dimensions if d != masked]
    key = lambda df, cols: df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("k"))
    loose = multiset_overlap(key(gold, rest), key(predicted, rest), "k").select(F.col("overlap").alias("loose"))
    exact = multiset_overlap(key(gold, dimensions), key(predicted, dimensions), "k").select(F.col("overlap").alias("exact"))
    return loose.crossJoin(exact).select((F.col("loose") - F.col("exact")).alias("corrupted"))  # one row by one row


def set_scores(expected: Column, observed: Column) -> tuple[Column, Column, Column]:
    """Missing, extra and equality of two key arrays."""
    return F.array_sort(F.array_except(expected, observed)), F.array_sort(F.array_except(observed, expected)), F.array_sort(F.array_distinct(expected)) == F.array_sort(F.array_distinct(observed))


def refusal_summary(rows: DataFrame) -> DataFrame:
    """``rows``: ``should_refuse, refused, code_matches``. Three denominators."""
    s, r = F.col("should_refuse"), F.col("refused")
    return rows.agg(
        ratio(F.count_if(s & r), F.count_if(s)).alias("refusal_recall"),
        ratio(F.count_if(s & r), F.count_if(r)).alias("refusal_precision"),
        ratio(F.count_if(~s & ~r), F.count_if(~s)).alias("answer_rate"),
        ratio(F.count_if(s & r & F.col("code_matches")), F.count_if(s)).alias("code_accuracy"),
        F.count_if(~s & r).alias("false_refusals"),
    )


def grounding(rows: DataFrame) -> DataFrame:
    """``rows``: arrays ``claims, supported, cited, citations, valid_citations, gold``; summed numerators over summed denominators."""
    over = lambda a, b: F.sum(F.size(F.array_intersect(a, b)))
    return rows.agg(
        ratio(over("claims", "supported"), F.sum(F.size("claims"))).alias("claim_support"),
        ratio(over("claims", "cited"), F.sum(F.size("claims"))).alias("claim_citation"),
        ratio(over("citations", "valid_citations"), F.sum(F.size("citations"))).alias("citation_precision"),
        ratio(over("citations", "gold"), F.sum(F.size("gold"))).alias("citation_recall"),
        F.sum(F.size(F.array_except("claims", "supported"))).alias("unsupported_claims"),
        F.sum(F.size(F.array_except("citations", "valid_citations"))).alias("invalid_citations"),
    )


#: Ratios of grounding by name, with numerator, denominator and the reason where the denominator is zero.
GROUNDING = (
    ("required_fact_coverage", "covered_facts", "required_facts", "no_required_facts"),
    ("structured_fact_preservation", "preserved_facts", "supplied_facts", "no_supplied_structured_facts"),
    ("fully_supported_claim_rate", "fully_supported", "assessable", "no_assessable_claims"),
    ("partially_supported_claim_rate", "partially_supported", "assessable", "no_assessable_claims"),
    ("unsupported_claim_rate", "unsupported", "assessable", "no_assessable_claims"),
    ("citation_document_accuracy", "correct_documents", "judged", "no_reviewed_citations"),
    ("citation_passage_accuracy", "correct_passages", "judged", "no_reviewed_citations"),
    ("citation_precision", "supporting_passages", "judged", "no_reviewed_citations"),
    ("citation_recall", "cited_groups", "required_groups", "no_required_evidence_groups"),
    ("required_limitation_coverage", "present_limitations", "required_limitations", "no_required_limitations"),
)


def grounding_rates(rows: DataFrame, by: list[str]) -> DataFrame:
    """One row a ratio and group: ``metric, numerator, denominator, value, reason``. ``rows``: one an answer, with
    the counts of ``GROUNDING``, but ``claim_labels`` (array) for those of claims. Sums over sums."""
    label = lambda name: F.size(F.filter("claim_labels", lambda c: c == name)).alias(name)
    own = rows.select("*", label("fully_supported"), label("partially_supported"), label("unsupported"), F.size(F.filter("claim_labels", lambda c: c != "not_assessable")).alias("assessable"))
    needed = sorted({c for _, a, b, _ in GROUNDING for c in (a, b)})
    sums = own.groupBy(*by).agg(*[F.sum(c).alias(c) for c in needed])
    each = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(a).alias("numerator"), F.col(b).alias("denominator"), ratio(F.col(a), F.col(b)).alias("value"), F.when(F.col(b) == 0, F.lit(why)).alias("reason")) for n, a, b, why in GROUNDING])
    return sums.select(*by, F.explode(each).alias("_m")).select(*by, "_m.*")


def release_gate(summary: DataFrame, r5: float = 0.8, r10: float = 0.9) -> DataFrame:
    """Recall gates, and all citations and locators valid."""
    return summary.select(((F.col("recall_at_5") >= r5) & (F.col("recall_at_10") >= r10) & F.col("citations_valid") & F.col("locators_valid")).alias("passes"))


def observed_in_all(rows: DataFrame, key: str, system: str, systems: tuple[str, ...]) -> DataFrame:
    """Rows of the questions that every system answered."""
    own = rows.where(F.col(system).isin(*systems)).groupBy(key).agg(F.count_distinct(system).alias("_n")).where(F.col("_n") == len(systems))
    return rows.join(own, key, "left_semi")


def legacy_metrics(rows: DataFrame) -> DataFrame:
    """Recall at 1, 3, 5 and 10, reciprocal rank and nDCG at 10 of questions with chunk-level relevance
    (``returned``, ``relevant``: arrays without repeats). A question without relevant chunks has nulls."""
    hit = F.transform("returned", lambda k: F.array_contains("relevant", k))
    own = rows.withColumn("_h", hit).withColumn("_n", F.size("relevant"))
    out = own
    for k in (1, 3, 5, 10):
        found = F.size(F.filter(F.slice("_h", 1, k), lambda h: h))
        out = out.withColumn(f"recall_at_{k}", F.when(F.col("_n") > 0, F.bround(found / F.col("_n"), 12)))
    place = F.array_position(F.slice("_h", 1, 10), True)
    gains = F.aggregate(F.transform(F.slice("_h", 1, 10), lambda h, i: F.when(h, 1 / F.log2(i + 2.0)).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)
    best = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least("_n", F.lit(10)), F.lit(1))), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0))
    out = out.withColumn("mrr_at_10", F.when(F.col("_n") > 0, F.when(place > 0, F.bround(1 / place, 12)).otherwise(0.0)))
    return out.withColumn("ndcg_at_10", F.when(F.col("_n") > 0, F.bround(gains / best, 9))).drop("_h", "_n")


def stable_runs(rows: DataFrame, by: list[str], keys: str, iteration: str | None = None, warmup: int = 0) -> DataFrame:
    """Whether every iteration returned the same keys; the first ``warmup`` of them (from 0) do not count."""
    if iteration:
        rows = rows.where(F.col(iteration) >= warmup)
    return rows.groupBy(*by).agg((F.count_distinct(F.to_json(keys)) == 1).alias("stable"))
