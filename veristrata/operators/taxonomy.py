"""Hierarchies: closure, ancestors, merged identifiers, exact name mapping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written


def closure(edges: DataFrame, nodes: DataFrame, max_depth: int = 100) -> DataFrame:
    """``ancestor_id, descendant_id, depth`` from ``edges`` (``child_id, parent_id``); every node is its
    own ancestor at depth 0. Depth-wise equi joins, each from the frontier that the level before has written;
    it shrinks to nothing on a forest, and a chain beyond ``max_depth`` (a cycle) is an error."""
    out = nodes.select(F.col("node_id").alias("ancestor_id"), F.col("node_id").alias("descendant_id"), F.lit(0).alias("depth"))
    frontier, depth = out, 0
    while True:
        depth += 1
        frontier = frontier.join(edges, frontier.descendant_id == edges.parent_id).select("ancestor_id", F.col("child_id").alias("descendant_id"), F.lit(depth).alias("depth"))
        frontier = written(frontier, "closure-level")
        if frontier.isEmpty():
            return out
        if depth > max_depth:
            raise ValueError("the hierarchy has a cycle or is deeper than allowed")
        out = out.unionByName(frontier)


def ancestors(closed: DataFrame, required: DataFrame) -> DataFrame:
    """Every term above the required ones, once."""
    return closed.join(required.withColumnRenamed("node_id", "descendant_id"), "descendant_id", "left_semi").select(F.col("ancestor_id").alias("node_id")).distinct()


def resolve_merged(ids: DataFrame, merged: DataFrame, deleted: DataFrame, max_hops: int = 50) -> DataFrame:
    """``id, resolved_id, status`` (current, merged, deleted) through the chain of merged identifiers."""
    now = ids.select("id", F.col("id").alias("resolved_id"), F.lit(0).alias("hops"))
    links = merged.select(F.col("old_id"), F.col("new_id"))
    for _ in range(max_hops):
        moved = now.join(links, now.resolved_id == links.old_id, "left")
        if moved.where("new_id is not null").isEmpty():
            gone = deleted.select(F.col("id").alias("_gone"))
            named = now.join(gone, now.resolved_id == F.col("_gone"), "left")
            status = F.when(F.col("_gone").isNotNull(), "deleted").when(F.col("hops") > 0, "merged").otherwise("current")
            return named.select("id", "resolved_id", status.alias("status"))
        now = moved.select("id", F.coalesce("new_id", "resolved_id").alias("resolved_id"), (F.col("hops") + F.when(F.col("new_id").isNotNull(), 1).otherwise(0)).alias("hops"))
    raise ValueError("merged identifiers form a cycle")


def resolve_entities(mentions: DataFrame, catalog: DataFrame) -> DataFrame:
    """``kind, mention, key, status`` for each mention (``kind, mention``) by the catalog (``kind, key, name,
    aliases``): an exact key first, then the name, then an alias, blanks and case aside. Several entities at
    the first level that has any are ``ambiguous``, none anywhere ``unresolved``; both have a null key."""
    flat = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    names = catalog.select("kind", "key", F.explode(F.concat(F.array(F.struct(F.lit(1).alias("level"), F.col("key").alias("form")), F.struct(F.lit(2).alias("level"), flat(F.col("name")).alias("form"))), F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.struct(F.lit(3).alias("level"), flat(a).alias("form"))))).alias("_n"))
    names = names.select("kind", "key", "_n.level", "_n.form")
    asked = mentions.select("kind", "mention").distinct().withColumn("_f", F.explode(F.array(F.struct(F.lit(True).alias("exact"), F.trim("mention").alias("form")), F.struct(F.lit(False).alias("exact"), flat(F.col("mention")).alias("form")))))
    asked = asked.select("kind", "mention", F.col("_f.exact").alias("exact"), F.col("_f.form").alias("form"))
    hits = asked.join(names, ["kind", "form"]).where(F.col("exact") == (F.col("level") == 1))
    levels = hits.groupBy("kind", "mention", "level").agg(F.count_distinct("key").alias("n"), F.min("key").alias("key"))
    best = levels.groupBy("kind", "mention").agg(F.min(F.struct("level", "n", "key")).alias("_b"))
    status = F.when(F.col("_b").isNull(), "unresolved").when(F.col("_b.n") > 1, "ambiguous").otherwise("resolved")
    return mentions.select("kind", "mention").distinct().join(best, ["kind", "mention"], "left").select("kind", "mention", F.when(F.col("_b.n") == 1, F.col("_b.key")).alias("key"), status.alias("status"))


def taxon_terms(nodes: DataFrame, names: DataFrame, merged: DataFrame, deleted: DataFrame, required: DataFrame, max_depth: int = 100) -> DataFrame:
    """``tax_id, rank, parent_id, name, aliases`` of the required taxa (``id``, through merged ones) and all
    above them. ``name`` is the scientific name; a required id that is deleted or unknown, or a term without
    a name, fails the read. Tables as :func:`veristrata.sources.scans.dump_table` gives them."""
    state = resolve_merged(required, merged, deleted.select(F.col("tax_id").alias("id")))
    bad = state.where("status = 'deleted'").limit(1).collect()
    if bad:
        raise ValueError(f"required id {bad[0]['id']} is deleted")
    known = nodes.select("tax_id", "parent_id", "rank")
    frontier = state.select(F.col("resolved_id").alias("tax_id")).distinct()
    chosen, depth = frontier, 0
    while True:
        up = frontier.join(known, "tax_id").select(F.col("parent_id").alias("tax_id")).distinct().join(chosen, "tax_id", "left_anti").persist()
        if up.isEmpty():
            break
        depth += 1
        if depth > max_depth:
            raise ValueError("the hierarchy has a cycle or is deeper than allowed")
        chosen, frontier = chosen.unionByName(up), up
    own = names.groupBy("tax_id").agg(F.min(F.when(F.col("name_class") == "scientific name", F.col("name"))).alias("name"), F.sort_array(F.collect_set(F.when(F.col("name_class") != "scientific name", F.col("name")))).alias("aliases"))
    whole = chosen.join(known, "tax_id", "left").join(own, "tax_id", "left")
    name = F.when(F.col("rank").isNotNull() & F.col("name").isNotNull(), F.col("name")).otherwise(F.raise_error(F.concat(F.lit("unknown or unnamed id "), "tax_id")).cast("string"))
    return whole.select("tax_id", "rank", F.when(F.col("parent_id") != F.col("tax_id"), F.col("parent_id")).alias("parent_id"), name.alias("name"), F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"))


def map_names(old: DataFrame, new: DataFrame) -> DataFrame:
    """Exact (name, rank) mapping; names that match no or several rows have a null target."""
    counted = new.groupBy("name", "rank").agg(F.count("*").alias("matches"), F.min("term_id").alias("term_id"))
    joined = old.join(counted, ["name", "rank"], "left")
    return joined.select("name", "rank", F.when(F.col("matches") == 1, F.col("term_id")).alias("term_id"), F.coalesce("matches", F.lit(0)).alias("matches"))
