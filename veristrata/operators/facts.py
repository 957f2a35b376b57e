"""Membership-rooted facts: filters as semi joins, distinct metrics, keyset lists, projections.

Every query starts from the release's membership, so rows outside it cannot leak, and joins that only
filter are semi joins, so duplicated assertions or aliases cannot inflate a count. Catalyst turns the
small dimensions into broadcasts by their measured size; nothing here forces one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ROWS_A_TASK, tasks_for


@dataclass(frozen=True)
class Facts:
    """Tables of one catalog. Columns:

    membership ``release, locus_id`` · locus ``locus_id, group_id, sequence_id`` · groups ``group_id,
    group_name`` · assignment ``group_id, term_id, role`` · term ``term_id, term_name, rank`` · closure
    ``ancestor_id, descendant_id, depth`` · assertion ``locus_id, category, kind`` · call ``locus_id,
    call_key, score`` · category_closure as closure, over the categories."""

    membership: DataFrame
    locus: DataFrame
    groups: DataFrame
    assignment: DataFrame
    term: DataFrame
    closure: DataFrame | Callable[[], DataFrame]  # built only for queries that descend
    assertion: DataFrame
    call: DataFrame
    category_closure: DataFrame | Callable[[], DataFrame] | None = None


@dataclass(frozen=True)
class GroupFilter:
    group_id: object


@dataclass(frozen=True)
class LocusFilter:
    locus_ids: tuple


@dataclass(frozen=True)
class LineageFilter:
    term_id: object
    descendants: bool = False
    role: str = "source"


@dataclass(frozen=True)
class CategoryFilter:
    category: str
    kind: str = "formal"
    descendants: bool = False


def _below(closed: DataFrame | Callable[[], DataFrame] | None, ancestor: object, name: str) -> DataFrame:
    """The terms at or below ``ancestor``, as column ``name``."""
    if closed is None:
        raise ValueError("the catalog holds no closure to descend by")
    rows = closed() if callable(closed) else closed
    return rows.where(F.col("ancestor_id") == ancestor).select(F.col("descendant_id").alias(name))


def matched_loci(t: Facts, release: str, filters: tuple = ()) -> DataFrame:
    """Base relation: the release's loci that pass all filters, once each."""
    n = tasks_for(t.locus)
    members = t.membership.where(F.col("release") == release).repartition(n, "locus_id")
    base = members.join(t.locus.repartition(n, "locus_id"), "locus_id").select("locus_id", "group_id", "sequence_id")
    for f in filters:
        if isinstance(f, GroupFilter):
            base = base.where(F.col("group_id") == f.group_id)
        elif isinstance(f, LocusFilter):
            base = base.where(F.col("locus_id").isin(*f.locus_ids))
        elif isinstance(f, LineageFilter):
            own = t.assignment.where(F.col("role") == f.role)
            if f.descendants:
                own = own.join(_below(t.closure, f.term_id, "term_id"), "term_id", "left_semi")
            else:
                own = own.where(F.col("term_id") == f.term_id)
            base = base.join(own, "group_id", "left_semi")
        elif isinstance(f, CategoryFilter):
            own = t.assertion.where(F.col("kind") == f.kind)
            if f.descendants:
                own = own.join(_below(t.category_closure, f.category, "category"), "category", "left_semi")
            else:
                own = own.where(F.col("category") == f.category)
            base = base.join(own, "locus_id", "left_semi")
        else:
            raise TypeError(f"unknown filter {f!r}")
    return base.distinct()


#: The closed list of metrics.
METRICS = ("distinct_included_locus_count", "distinct_contig_count", "distinct_assembly_count", "distinct_source_taxon_count", "detection_call_count")


def metric(t: Facts, base: DataFrame, name: str) -> DataFrame:
    """One row, one column ``value``."""
    if name == "distinct_included_locus_count":
        return base.agg(F.count("*").alias("value"))
    if name == "distinct_contig_count":
        return base.select("group_id", "sequence_id").distinct().agg(F.count("*").alias("value"))
    if name == "distinct_assembly_count":
        return base.agg(F.count_distinct("group_id").alias("value"))
    if name == "distinct_source_taxon_count":
        own = t.assignment.where("role = 'source'").join(base.select("group_id").distinct(), "group_id", "left_semi")
        return own.agg(F.count_distinct("term_id").alias("value"))
    if name == "detection_call_count":
        return t.call.join(base, "locus_id", "left_semi").agg(F.count_distinct("call_key").alias("value"))
    raise ValueError(f"no metric {name!r}")


def group_rows(t: Facts, base: DataFrame) -> DataFrame:
    """Loci per group, with its name."""
    return base.groupBy("group_id").agg(F.count("*").alias("loci")).join(t.groups, "group_id").select("group_id", "group_name", "loci")


def taxon_rows(t: Facts, base: DataFrame) -> DataFrame:
    """Distinct groups and loci per term of the source lineage."""
    per_group = base.groupBy("group_id").agg(F.count("*").alias("loci"))
    own = t.assignment.where("role = 'source'").join(per_group, "group_id").join(t.term, "term_id")
    return own.groupBy("term_id", "term_name").agg(F.count_distinct("group_id").alias("groups"), F.sum("loci").alias("loci"))


def assignment_faults(t: Facts, base: DataFrame) -> DataFrame:
    """Groups of the base without exactly one source term; the role stays inside the join condition,
    so that a group without any still shows."""
    own = t.assignment.where("role = 'source'")
    each = base.select("group_id").distinct().join(own, "group_id", "left")
    return each.groupBy("group_id").agg(F.count("term_id").alias("terms")).where("terms <> 1")


def keyset_page(rows: DataFrame, keys: list[str], limit: int, after: tuple | None = None) -> DataFrame:
    """``limit + 1`` rows beyond ``after`` in key order; the extra row tells of more."""
    if after is not None:
        bound = F.struct(*[F.lit(v).cast(rows.schema[k].dataType).alias(k) for k, v in zip(keys, after)])
        rows = rows.where(F.struct(*keys) > bound)
    return rows.orderBy(*keys).limit(limit + 1)


def locus_details(t: Facts, base: DataFrame) -> DataFrame:
    """Locus, sequence, group and term names in one row a locus."""
    own = t.assignment.where("role = 'source'")
    return base.join(t.groups, "group_id").join(own, "group_id").join(t.term, "term_id").select("locus_id", "sequence_id", "group_id", "group_name", "term_id", "term_name")


def locus_projection(t: Facts, base: DataFrame) -> DataFrame:
    """The whole detail of each locus: every column that the catalog's locus, group and term tables hold, and
    its numbers of calls and categories. Both counts are aggregates before they join, so nothing fans out."""
    own = t.assignment.where("role = 'source'").select("group_id", "term_id")
    n = tasks_for(t.locus)
    loci = base.select("locus_id").repartition(n, "locus_id")
    dealt = lambda rows: rows.repartition(n, "locus_id").join(loci, "locus_id", "left_semi").groupBy("locus_id")
    calls = dealt(t.call).agg(F.count_distinct("call_key").alias("calls"))
    kinds = dealt(t.assertion).agg(F.count_distinct("category", "kind").alias("categories"))
    counted = loci.join(t.locus.repartition(n, "locus_id"), "locus_id").join(calls, "locus_id", "left").join(kinds, "locus_id", "left").na.fill(0, ["calls", "categories"])
    wide = counted.repartition(n, "group_id").join(t.groups.repartition(n, "group_id"), "group_id").join(own.repartition(n, "group_id"), "group_id").join(t.term, "term_id")
    return wide.select("locus_id", "term_id", "group_id", *[c for c in wide.columns if c not in ("term_id", "group_id", "locus_id", "calls", "categories")], "calls", "categories")


def scoped(tables: dict[str, tuple[DataFrame, str, str]], scope: dict[str, DataFrame]) -> DataFrame:
    """``table, key`` of all rows in a release's scope. ``tables``: rows, their key column and the name of the
    scope that they belong to; ``scope``: by name one column of keys in scope. One semi join a table."""
    out: DataFrame | None = None
    for name, (rows, key, kind) in sorted(tables.items()):
        public = scope[kind]
        n = tasks_for(rows, 4 * ROWS_A_TASK)
        own = rows.select(key).repartition(n, key).join(public.select(F.col(public.columns[0]).alias(key)).repartition(n, key), key, "left_semi").select(F.lit(name).alias("table"), F.col(key).cast("string").alias("key"))
        out = own if out is None else out.unionByName(own)
    if out is None:
        raise ValueError("no table to scope")
    return out


def cardinality_faults(base: DataFrame, details: DataFrame, key: str = "locus_id") -> DataFrame:
    """Keys of the base that a projection does not hold exactly once, and keys that it holds beside them:
    ``key, expected, found``. Empty means that the projection answers the request."""
    n = tasks_for(base)
    found = details.select(key).repartition(n, key).groupBy(key).agg(F.count("*").alias("found"))
    both = base.select(key, F.lit(1).alias("expected")).repartition(n, key).distinct().join(found, key, "full")
    return both.select(key, F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("found", F.lit(0)).alias("found")).where("expected <> found")


def call_details(t: Facts, base: DataFrame) -> DataFrame:
    return t.call.join(base.select("locus_id"), "locus_id", "left_semi").select("locus_id", "call_key", "score")


def assertion_details(t: Facts, base: DataFrame) -> DataFrame:
    """Distinct assertions with the optional term of their group."""
    n = tasks_for(t.locus)
    own = t.assertion.repartition(n, "locus_id").join(base.select("locus_id", "group_id").repartition(n, "locus_id"), "locus_id").distinct()
    return own.join(t.assignment.where("role = 'source'"), "group_id", "left").join(t.term, "term_id", "left").select("locus_id", "category", "kind", "term_name")


def having_all(rows: DataFrame, key: str, value: str, required: tuple[str, ...]) -> DataFrame:
    """Relational division: keys that hold every required value."""
    need = F.array(*[F.lit(v) for v in required])
    return rows.groupBy(key).agg(F.collect_set(F.when(F.col(value).isin(*required), F.col(value))).alias("_own")).where(F.size(F.array_intersect("_own", need)) == len(set(required))).select(key)


def anchor_documents(anchors: DataFrame, required: DataFrame, key: str = "anchor_key", document: str = "document_key") -> DataFrame:
    """The documents of each required anchor, sorted; an anchor without any has an empty list, which the
    caller must refuse as unresolved."""
    own = anchors.groupBy(key).agg(F.sort_array(F.collect_set(document)).alias("documents"))
    return required.select(key).distinct().join(own, key, "left").select(key, F.coalesce("documents", F.array().cast("array<string>")).alias("documents"))


#: Kinds of anchor targets in their order, and targets of one question at most.
TARGETS = ("locus", "assembly", "lineage", "method")
MAX_TARGETS = 64


def anchor_targets(rows: DataFrame, by: str) -> DataFrame:
    """``by, targets, status``: the distinct targets (``kind, k1, k2``) of every question in the order of their kinds; more
    than ``MAX_TARGETS`` are refused, never cut: such a question has none. Targets are made distinct before they meet,
    and no question's list is longer than it has targets."""
    kinds = F.array(*map(F.lit, TARGETS))
    once = rows.select(by, F.struct(F.array_position(kinds, F.col("kind")).alias("o"), "k1", "k2", "kind").alias("_t")).distinct()
    counted = once.groupBy(by).agg(F.count("*").alias("_n"))
    fits = once.join(counted.where(F.col("_n") <= MAX_TARGETS).select(by), by, "left_semi").groupBy(by).agg(F.array_sort(F.collect_list("_t")).alias("_l"))
    listed = F.coalesce(F.transform("_l", lambda t: F.concat_ws(":", t["kind"], t["k1"], t["k2"])), F.array().cast("array<string>"))
    return counted.join(fits, by, "left").select(by, listed.alias("targets"), F.when(F.col("_n") > MAX_TARGETS, "too_many_anchor_targets").otherwise("ready").alias("status"))


def resolve_anchors(rows: DataFrame, targets: DataFrame, columns: dict[str, tuple[str, str]]) -> DataFrame:
    """Rows that any target names. ``targets``: ``kind, k1, k2``; ``columns`` maps a kind to its two
    columns of ``rows``. One null-safe equality join instead of a chain of ORs."""
    keyed = F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(a).cast("string").alias("k1"), F.col(b).cast("string").alias("k2")) for kind, (a, b) in columns.items()])
    wide = rows.withColumn("_t", F.explode(keyed)).select("*", "_t.kind", "_t.k1", "_t.k2").drop("_t")
    named = targets.select(F.col("kind").alias("_k"), F.col("k1").alias("_1"), F.col("k2").alias("_2"))
    cond: Column = (F.col("kind") == F.col("_k")) & F.col("k1").eqNullSafe(F.col("_1")) & F.col("k2").eqNullSafe(F.col("_2"))
    return wide.join(named, cond, "left_semi").select(*rows.columns).distinct()
