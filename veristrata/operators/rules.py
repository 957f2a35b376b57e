"""Cross-table rules: every rule over one key is settled by one grouping of all tables that share the key.

A table takes part in a key with a narrow projection: a count of its rows and of those that pass a flag, and the least
and greatest of a value. The projections of all tables are unioned and grouped once by the key, with partial sums in the
tasks, so a key with most of the rows is no single task and no rule adds a join. Codes are conditions on the sums."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .ingest import issues_of


@dataclass(frozen=True)
class Part:
    """A table under one key. ``flags``: conditions on its rows; ``values``: columns that must agree elsewhere."""

    name: str
    rows: DataFrame
    key: Column
    flags: dict[str, Column] = field(default_factory=dict)
    values: dict[str, Column] = field(default_factory=dict)


def _n(part: str, flag: str | None = None) -> Column:
    return F.coalesce(F.col(f"{part}.{flag or 'n'}"), F.lit(0))


def unique(part: str) -> Column:
    """More than one row has the key."""
    return _n(part) > 1


def unreferenced(child: str, parent: str) -> Column:
    """Rows of the child name a key that the parent has not."""
    return (_n(child) > 0) & (_n(parent) == 0)


def count_not(parent: str, child: str, wanted: int = 1, flag: str | None = None) -> Column:
    """A key of the parent has another number of (flagged) child rows than wanted."""
    return (_n(parent) > 0) & (_n(child, flag) != wanted)


def above(part: str, flag: str, least: int = 1) -> Column:
    """So many rows of the key or more pass the flag."""
    return _n(part, flag) >= least


def disagree(part: str, value: str, other: str, own: str | None = None) -> Column:
    """Both tables have the key, but not one and the same value (null counts as a value of its own)."""
    a, b = F.col(f"{part}.{value}"), F.col(f"{other}.{own or value}")
    same = a["low"].eqNullSafe(b["low"]) & a["high"].eqNullSafe(b["high"]) & a["low"].eqNullSafe(a["high"])
    return (_n(part) > 0) & (_n(other) > 0) & ~same


def key_faults(parts: Sequence[Part], rules: dict[str, Column]) -> DataFrame:
    """``key, code`` of every rule that a key breaks, in the order of ``rules``. Rows with a null key form one key."""
    wide = []
    for p in parts:
        columns = [F.lit(1).alias("n"), *[F.coalesce(c, F.lit(False)).cast("int").alias(f) for f, c in p.flags.items()], *[c.alias(f"_{v}") for v, c in p.values.items()]]
        wide.append(p.rows.select(p.key.cast("string").alias("key"), F.struct(*columns).alias(p.name)))
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), wide)
    sums = []
    for p in parts:
        own = [F.sum(F.coalesce(F.col(f"{p.name}.{c}"), F.lit(0))).alias(c) for c in ("n", *p.flags)]
        # a null beside other values must not be lost in the least and greatest
        shown = {v: F.when(F.col(p.name).isNotNull(), F.struct(F.col(f"{p.name}._{v}").isNull().alias("none"), F.col(f"{p.name}._{v}").alias("v"))) for v in p.values}
        own += [F.struct(F.min(c).alias("low"), F.max(c).alias("high")).alias(v) for v, c in shown.items()]
        sums.append(F.struct(*own).alias(p.name))
    state = rows.groupBy("key").agg(*sums)
    return state.select("key", F.explode(issues_of(*rules.items())).alias("code"))


def cycle_faults(edges: DataFrame, code: str, max_depth: int = 64) -> DataFrame:
    """``key, code`` of nodes that hang on no root: those on a cycle or below one. ``edges``: ``child_id, parent_id``.
    A round drops the nodes whose parents are all gone; a longer chain than ``max_depth`` is reported as well."""
    left = written(edges.where("child_id is not null and parent_id is not null").select("child_id", "parent_id").distinct(), "cycle-edges")
    n = left.count()
    for _ in range(max_depth):
        parents = left.select(F.col("child_id").alias("parent_id")).distinct()
        left = written(left.join(parents, "parent_id", "left_semi").select("child_id", "parent_id"), "cycle-edges")
        now = left.count()
        if now == n or not now:
            break
        n = now
    return left.select(F.col("child_id").cast("string").alias("key"), F.lit(code).alias("code")).distinct()


def closure_faults(stored: DataFrame, right: DataFrame) -> DataFrame:
    """``key, code`` of a stored closure (``ancestor_id, descendant_id, depth``) against the right one."""
    key = F.concat_ws(">", "ancestor_id", "descendant_id")
    parts = [Part(name, rows, key, values={"depth": F.col("depth")}) for name, rows in (("stored", stored), ("right", right))]
    return key_faults(parts, {"closure_row_missing": (_n("right") > 0) & (_n("stored") == 0), "closure_row_not_derived": unreferenced("stored", "right"), "closure_row_repeated": unique("stored"), "closure_depth_mismatch": disagree("stored", "depth", "right")})


def digest_faults(found: DataFrame, declared: DataFrame) -> DataFrame:
    """``key, code`` of tables whose declared ``digest`` or row count ``n`` (by ``table``) is not what was found."""
    parts = [Part(name, rows, F.col("table"), values={"digest": F.col("digest"), "rows": F.col("n")}) for name, rows in (("found", found), ("declared", declared))]
    return key_faults(parts, {"digest_missing": (_n("found") > 0) & (_n("declared") == 0), "table_missing": unreferenced("declared", "found"), "digest_mismatch": disagree("found", "digest", "declared"), "row_count_mismatch": disagree("found", "rows", "declared")})
