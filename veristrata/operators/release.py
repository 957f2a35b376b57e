"""Release digests, rule validation, inclusion policy, cohort and membership rules, integrity checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ROWS_A_TASK, tasks_for
from .ingest import multiset_digest


def row_digest(rows: DataFrame) -> DataFrame:
    """SHA-256 of each row's canonical JSON."""
    return rows.select(F.sha2(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}), 256).alias("row_sha256"))


def table_digest(rows: DataFrame, name: str) -> DataFrame:
    """Order-independent digest of a table."""
    return multiset_digest(row_digest(rows), "row_sha256").select(F.lit(name).alias("table"), "digest", "n")


def release_digest(tables: dict[str, DataFrame]) -> DataFrame:
    """One digest over the digests of all tables (one row each)."""
    each = reduce(DataFrame.unionByName, [table_digest(df, name) for name, df in sorted(tables.items())])
    return each.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("table", "digest"))), lambda x: F.concat(x["table"], F.lit(":"), x["digest"])), "\n"), 256).alias("digest"), F.sum("n").alias("n"))


def dependency_levels(parents: dict[str, tuple[str, ...]]) -> list[list[str]]:
    """Tables level by level: each after all that it depends on. A cycle or an unknown parent is refused."""
    unknown = sorted({p for own in parents.values() for p in own} - set(parents))
    if unknown:
        raise ValueError(f"tables depend on unknown ones: {', '.join(unknown)}")
    levels, done = [], set()
    while len(done) < len(parents):
        level = sorted(t for t, own in parents.items() if t not in done and done.issuperset(own))
        if not level:
            raise ValueError("the tables' dependencies form a cycle")
        levels.append(level)
        done.update(level)
    return levels


def scoped_release(tables: dict[str, DataFrame], links: dict[str, list[tuple[str, list[Column], list[Column]]]], scopes: dict[str, Column]) -> dict[str, DataFrame]:
    """The part of every table that belongs to a release. ``scopes``: which rows of a root belong to it; ``links``: for
    each other table its parents with the columns on both sides: a row belongs if all of its parents' rows do. A null
    link belongs nowhere. Semi joins in dependency order, so the rows of a table are never multiplied."""
    out: dict[str, DataFrame] = {}
    for level in dependency_levels({t: tuple(sorted({p for p, _, _ in links.get(t, [])})) for t in tables}):
        for name in level:
            rows = tables[name].where(scopes[name]) if name in scopes else tables[name]
            for parent, own, theirs in links.get(name, []):
                keys = out[parent].select(*[c.alias(f"_k{i}") for i, c in enumerate(theirs)]).distinct()
                cond = reduce(lambda a, b: a & b, [c == F.col(f"_k{i}") for i, c in enumerate(own)])
                rows = rows.join(keys, cond, "left_semi")
            out[name] = rows
    return out


def graph_digest(tables: dict[str, DataFrame], parents: dict[str, tuple[str, ...]]) -> DataFrame:
    """``table, level, n, digest`` over a dependency graph: a table's digest is that of its own rows and of its parents'
    digests, so a change shows in exactly the table and those that depend on it. Only one row a table is combined."""
    own = {name: table_digest(df, name) for name, df in tables.items()}
    out: dict[str, DataFrame] = {}
    for depth, level in enumerate(dependency_levels(parents)):
        for name in level:
            joined = own[name].withColumn("_above", F.lit(""))
            for parent in sorted(parents[name]):
                above = out[parent].select(F.concat(F.lit(f"\n{parent}:"), "digest").alias("_d"))
                joined = joined.crossJoin(above).withColumn("_above", F.concat("_above", "_d")).drop("_d")  # single rows
            out[name] = joined.select("table", F.lit(depth).alias("level"), "n", F.sha2(F.concat("table", F.lit(":"), "digest", "_above"), 256).alias("digest"))
    return reduce(DataFrame.unionByName, [out[name] for name in sorted(out)])


def unchanged(now: dict[str, DataFrame], snapshot: dict[str, DataFrame]) -> DataFrame:
    """``table, unchanged, digest, snapshot``: whether each table of a corpus still has the snapshot's digest and row count."""
    sides = [reduce(DataFrame.unionByName, [table_digest(df, name) for name, df in sorted(tables.items())]) for tables in (now, snapshot)]
    then = sides[1].select("table", F.col("digest").alias("_d"), F.col("n").alias("_n"))
    return sides[0].join(then, "table", "full").select("table", (F.col("digest").eqNullSafe(F.col("_d")) & F.col("n").eqNullSafe(F.col("_n"))).alias("unchanged"), "digest", F.col("_d").alias("snapshot"))


def sealed_faults(rows: DataFrame, own: str = "record_sha256") -> DataFrame:
    """Records whose own digest is not that of their other fields."""
    rest = [c for c in sorted(rows.columns) if c != own]
    return rows.where(~F.col(own).eqNullSafe(F.sha2(F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}), 256)))


def unresolved_locators(locators: DataFrame, blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Locators that do not name exactly one block."""
    counts = blocks.groupBy(*keys).agg(F.count("*").alias("_n"))
    return locators.join(counts, keys, "left").where(F.coalesce("_n", F.lit(0)) != 1).drop("_n")


def differences(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Rows of one side only, with multiplicity: an empty result means an equal rebuild."""
    a, b = expected.exceptAll(actual).withColumn("side", F.lit("missing")), actual.exceptAll(expected).withColumn("side", F.lit("extra"))
    return a.unionByName(b)


def rebuild_report(expected: dict[str, DataFrame], actual: dict[str, DataFrame]) -> DataFrame:
    """``table, missing, extra``: rows of each table that one side has more often than the other. Rows meet as
    digests with counts, so texts and vectors are hashed where they lie and never shuffled."""
    out: DataFrame | None = None
    for name, rows in sorted(expected.items()):
        a = row_digest(rows).groupBy("row_sha256").agg(F.count("*").alias("a"))
        b = row_digest(actual[name]).groupBy("row_sha256").agg(F.count("*").alias("b"))
        more = (F.coalesce("a", F.lit(0)) - F.coalesce("b", F.lit(0))).alias("d")
        one = a.join(b, "row_sha256", "full").select(more).agg(F.coalesce(F.sum(F.greatest("d", F.lit(0))), F.lit(0)).alias("missing"), F.coalesce(F.sum(F.greatest(-F.col("d"), F.lit(0))), F.lit(0)).alias("extra"))
        one = one.select(F.lit(name).alias("table"), "missing", "extra")
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no table to compare")
    return out


def rule_violations(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """``key, code`` for every rule that a row breaks: one pass for all rules."""
    codes = F.filter(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(code)) for code, cond in sorted(rules.items())]), lambda c: c.isNotNull())
    return rows.select(key, F.explode(codes).alias("code"))


def validate_release(tables: dict[str, DataFrame], keys: dict[str, str], rules: dict[str, dict[str, tuple[str, Column]]]) -> DataFrame:
    """``table, key, code, severity`` of every rule that a row breaks, and one row ``release_<table>_issues_present``
    for each table with any. ``rules``: by table and code a severity and the condition of a fault; each table
    is read once for all of its rules."""
    found = None
    for name, own in sorted(rules.items()):
        broken = rule_violations(tables[name], keys[name], {code: cond for code, (_, cond) in own.items()})
        grade = F.coalesce(*[F.when(F.col("code") == code, F.lit(severity)) for code, (severity, _) in sorted(own.items())])
        rows = broken.select(F.lit(name).alias("table"), F.col(keys[name]).cast("string").alias("key"), "code", grade.alias("severity"))
        found = rows if found is None else found.unionByName(rows)
    whole = found.select("table", F.lit(None).cast("string").alias("key"), F.concat(F.lit("release_"), "table", F.lit("_issues_present")).alias("code"), F.lit("error").alias("severity")).distinct()
    return found.unionByName(whole)


def inclusion(rows: DataFrame) -> DataFrame:
    """``rows``: ``key, outcome, gates_pass, placements, bound, left, right`` (verdicts, null without flank
    evidence) and code arrays ``unresolved, quarantine, conflict``. Decision and sorted reasons."""
    left, right = F.coalesce("left", F.lit("not_assessed")), F.coalesce("right", F.lit("not_assessed"))
    fixed = F.filter(
        F.array(
            F.when(F.col("outcome") != "normalized_candidate", F.concat(F.lit("import_outcome:"), "outcome")),
            F.when(~F.col("gates_pass"), F.lit("m1_gates_failed")),
            F.when(F.col("placements") != 1, F.lit("exact_placement_count_not_one")),
            F.when(~F.col("bound"), F.lit("dependency_snapshots_not_bound")),
            F.when(F.col("left").isNull() & F.col("right").isNull(), F.lit("flank_evidence_missing")),
            F.when(left != "supported", F.concat(F.lit("left_flank:"), left)),
            F.when(right != "supported", F.concat(F.lit("right_flank:"), right)),
        ),
        lambda c: c.isNotNull(),
    )

    def marked(name: str, prefix: str) -> Column:
        return F.transform(F.col(name), lambda c: F.concat(F.lit(prefix), c))

    coded = [marked("unresolved", "unresolved_issue:"), marked("quarantine", "quarantine_issue:"), marked("conflict", "conflict:")]
    reasons = F.array_sort(F.array_distinct(F.concat(fixed, *coded)))
    decision = (
        F.when(F.size(reasons) == 0, "include")
        .when((F.size("quarantine") > 0) | (F.col("outcome") == "quarantine"), "quarantine")
        .when((F.size("conflict") > 0) | (left == "contradicted") | (right == "contradicted"), "exclude")
        .otherwise("review")
    )
    return rows.select("key", decision.alias("decision"), F.when(F.size(reasons) == 0, F.array(F.lit("eligible_for_v0_pilot_inclusion"))).otherwise(reasons).alias("reasons"))


def adjudication_prefix(rows: DataFrame, by: str, order: str, decision: str) -> DataFrame:
    """Rows up to and with the first ``include`` of each group, in order."""
    before = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_done", F.coalesce(F.max(F.when(F.col(decision) == "include", 1).otherwise(0)).over(before), F.lit(0))).where("_done = 0").drop("_done")


def public_assertions(assertions: DataFrame, evidence: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """Loci that hold all required assertion types, each with support and without contradiction. Assertions meet their
    evidence by the digests of their ids, so no long id is shuffled."""
    by_digest = lambda rows: rows.withColumn("assertion_id", F.unhex(F.sha2(F.col("assertion_id").cast("string"), 256)))
    own = by_digest(evidence).groupBy("assertion_id").agg(F.count_if(F.col("relation") == "supports").alias("_s"), F.count_if(F.col("relation") == "contradicts").alias("_c"))
    state = by_digest(assertions).join(own, "assertion_id", "left").groupBy("locus_id").agg(
        F.collect_set("assertion_type").alias("_types"), F.bool_and((F.coalesce("_s", F.lit(0)) >= 1) & (F.coalesce("_c", F.lit(0)) == 0)).alias("_clean")
    )
    need = F.array(*[F.lit(r) for r in required])
    return state.where(F.col("_clean") & (F.size(F.array_intersect("_types", need)) == len(required))).select("locus_id")


def display_labels(rows: DataFrame, labels: DataFrame, key: str, text: str) -> DataFrame:
    """Approved label where key and wording match, the original otherwise; row count is kept."""
    own = labels.select(F.col(key).alias("_k"), F.col("source_text").alias("_t"), F.col("label").alias("_l")).dropDuplicates(["_k", "_t"])
    return rows.join(own, (F.col(key) == F.col("_k")) & (F.col(text) == F.col("_t")), "left").withColumn("display", F.coalesce("_l", text)).drop("_k", "_t", "_l")


def exact_projection(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row a key; keys with several values in a column are refused as ambiguous."""
    state = rows.groupBy(key).agg(*[F.min(c).alias(c) for c in columns], *[F.count_distinct(c).alias(f"_{c}") for c in columns])
    exact = reduce(lambda a, b: a & b, [F.col(f"_{c}") == 1 for c in columns])
    return state.select(key, *columns, exact.alias("is_exact"))


def coverage_faults(requests: DataFrame, evidence: DataFrame, key: str) -> DataFrame:
    """Keys requested without evidence, and evidence that nobody requested; a null key meets none. Both sides are
    grouped once, so that a task holds a flag or two a key, not the rows."""
    sides = requests.select(key, F.lit(True).alias("_r")).unionByName(evidence.select(key, F.lit(False).alias("_r")))
    met = sides.repartition(tasks_for(sides, 4 * ROWS_A_TASK), key).groupBy(key).agg(F.bool_or("_r").alias("_asked"), F.bool_or(~F.col("_r")).alias("_found"))
    none = F.col(key).isNull()
    faults = F.array(F.when(F.col("_asked") & (none | ~F.col("_found")), F.lit("missing")), F.when(F.col("_found") & (none | ~F.col("_asked")), F.lit("unrequested")))
    return met.select(key, F.explode_outer(faults).alias("fault")).where("fault is not null")


def orphans(children: DataFrame, parents: DataFrame, keys: list[str]) -> DataFrame:
    """Children whose (composite) key has no parent."""
    return children.join(parents.select(*keys), keys, "left_anti")


def outside_sequence(placements: DataFrame, sequences: DataFrame, key: str) -> DataFrame:
    """Placements that leave their sequence; ending at its length is inside."""
    return placements.join(sequences, key).where(~((F.col("start0") >= 0) & (F.col("start0") < F.col("end0")) & (F.col("end0") <= F.col("length"))))


def corpus_faults(documents: DataFrame, chunks: DataFrame, embeddings: DataFrame, anchors: DataFrame) -> DataFrame:
    """``fault, n`` for each check of a complete corpus: documents without a reviewed licence (``licensed``)
    or without a chunk, chunks of no document or with no embedding or with several, embeddings of no chunk,
    anchors of no document. Five keyed joins, no key leaves its task."""
    n = lambda df, fault: df.agg(F.count("*").alias("n")).select(F.lit(fault).alias("fault"), "n")
    own = embeddings.groupBy("chunk_id").agg(F.count("*").alias("_n"))
    parts = [
        n(documents.where(~F.coalesce("licensed", F.lit(False))), "document_not_licensed"),
        n(documents.join(chunks.select("document_id"), "document_id", "left_anti"), "document_without_chunk"),
        n(chunks.join(documents.select("document_id"), "document_id", "left_anti"), "chunk_without_document"),
        n(chunks.join(own, "chunk_id", "left_anti"), "chunk_without_embedding"),
        n(chunks.join(own.where("_n > 1"), "chunk_id", "left_semi"), "chunk_with_several_embeddings"),
        n(embeddings.join(chunks.select("chunk_id"), "chunk_id", "left_anti"), "embedding_without_chunk"),
        n(anchors.join(documents.select("document_id"), "document_id", "left_anti"), "anchor_without_document"),
    ]
    return reduce(DataFrame.unionByName, parts)


def completeness(documents: DataFrame, chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Members, documents without a chunk, chunks without an embedding: one row."""
    empty = documents.join(chunks.select("document_id"), "document_id", "left_anti").agg(F.count("*").alias("documents_without_chunks"))
    bare = chunks.join(embeddings.select("chunk_id"), "chunk_id", "left_anti").agg(F.count("*").alias("chunks_without_embeddings"))
    return documents.agg(F.count("*").alias("documents")).crossJoin(empty).crossJoin(bare)  # single rows
