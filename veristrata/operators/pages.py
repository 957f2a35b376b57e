"""Pages of whole ordered sets: numbers for every row without a global sort in one task, and checks of collected pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written


def numbered(rows: DataFrame, by: str, keys: list[str], limit: int) -> DataFrame:
    """``rows`` with ``place`` (from 0 within ``by``) and ``page``. Rows are dealt to sorted ranges and written once;
    the ranges' counts give each its first place, so a value of ``by`` with most of the rows is spread over tasks."""
    held = written(rows.repartitionByRange(by, *keys).withColumn("_range", F.spark_partition_id()), "page-ranges")
    before = F.sum("_n").over(Window.partitionBy(by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = held.groupBy(by, "_range").agg(F.count("*").alias("_n")).select(F.col(by).alias("_by"), F.col("_range").alias("_r"), F.coalesce(before, F.lit(0)).alias("_first"))
    own = F.row_number().over(Window.partitionBy(by, "_range").orderBy(*keys)) - 1
    placed = held.withColumn("_own", own).join(starts, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_range") == F.col("_r")))
    place = (F.col("_first") + F.col("_own")).cast("long")
    return placed.select(*rows.columns, place.alias("place"), F.floor(place / limit).alias("page"))


def page_heads(placed: DataFrame, by: str, key: str) -> DataFrame:
    """One row a page: ``by, page, n, first, last, total, cursor, next_cursor``; a cursor is the last key before a page."""
    heads = placed.groupBy(by, "page").agg(F.count("*").alias("n"), F.min(key).alias("first"), F.max(key).alias("last"))
    own = Window.partitionBy(by)
    order = own.orderBy("page")
    return heads.withColumn("total", F.sum("n").over(own)).withColumn("cursor", F.lag("last").over(order)).withColumn("next_cursor", F.when(F.lead("page").over(order).isNotNull(), F.col("last")))


def collection_faults(heads: DataFrame, by: str) -> DataFrame:
    """``by, page, code`` of what keeps collected pages (``page, n, first, last, total, cursor, next_cursor``) from being a
    complete set: boundaries that overlap or are out of order, cursors that do not continue the page before, cursors met
    again, totals that change, and at the last page a number of rows that is not the total. Only pages meet, not rows."""
    order = Window.partitionBy(by).orderBy("page")
    so_far = order.rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.collect_set("next_cursor").over(so_far)
    final = F.lead("page").over(order).isNull()
    tests = {
        "first_page_has_cursor": F.lag("page").over(order).isNull() & F.col("cursor").isNotNull(),
        "overlap": F.lag("last").over(order) >= F.col("first"),
        "gap": F.lag("page").over(order).isNotNull() & ~F.col("cursor").eqNullSafe(F.lag("next_cursor").over(order)),
        "cycle": F.array_contains(earlier, F.col("next_cursor")),
        "total_drift": F.lag("total").over(order) != F.col("total"),
        "not_terminal": final & F.col("next_cursor").isNotNull(),
        "incomplete": final & (F.sum("n").over(Window.partitionBy(by)) != F.col("total")),
    }
    marked = heads.select(by, "page", *[F.coalesce(t, F.lit(False)).alias(f"_{c}") for c, t in tests.items()])
    codes = F.filter(F.array(*[F.when(F.col(f"_{c}"), F.lit(c)) for c in tests]), lambda c: c.isNotNull())
    return marked.select(by, "page", F.explode(codes).alias("code"))
