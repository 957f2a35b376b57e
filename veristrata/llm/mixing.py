"""Operator 9: mixing sources to target weights by a low-discrepancy schedule of token blocks.

1. Sizes: words of each text; sources in code-point order, null last, weigh 5, 2, 1, repeating.
2. Targets share 150 % of all words by weight; a target stops at twice its source's size and the excess goes to the
   others by weight until none is above (:func:`filled`: a few rounds of two sums over the table of sources).
3. Each source is a stream of its documents shuffled by a hash of id and text, cut into equal-token blocks of its own
   size: as many as its share of about ``BLOCKS``, and ``LEAST_BLOCKS`` at least (one a word, if it has fewer). Its
   target is so many blocks of its stream, of two passes at most.
4. The schedule has a cell for each of these blocks, the sources' cells side by side. Slot ``i`` falls on the point
   ``frac((i + 1) g)`` of the golden ratio ``g``, that is on a cell, so every stretch of slots is near the weights. The
   slots of a source are ranked, and rank ``r`` joins block ``r mod blocks`` of its stream.
5. The slots that the schedule gave a source decide what it takes. Its discrepancy, the few slots by which it misses
   the number of cells, is settled within ``SETTLED`` slots: closing slots follow the schedule, surplus ones fall away.
   The slot that reaches the target takes the head of its block.
6. A document takes the words of its parts in joined blocks. ``slots`` counts these slots, ``first_slot`` is the first.

All is DataFrame functions. The sources are a table too: their places and cells are running sums over sorted ranges, and
the driver sees sums over them only. Equal rows are one entry with a count; streams are placed by two-level sums over
hash buckets whose number follows from the largest source, so neither a source nor an id with most of the rows is a
single task. Defined cases: a null text has size 0 and takes nothing (no slot, first slot null); null doc_ids are told
apart by their texts; repeated rows each have a place of their own; very long texts lie in many blocks; other columns,
whatever their names, are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, passing, table

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
BLOCKS = 200_000
#: Blocks of a small source, at least.
LEAST_BLOCKS = 1_000
#: Slots by which a source's part of the schedule is settled, at most.
SETTLED = 8
#: Rows of a source in one bucket of its stream, at most about.
BUCKET_ROWS = 250_000
GOLDEN = 0.6180339887498949
_GRID = 4096


def running(rows: DataFrame, order: list[Column], **sums: Column) -> DataFrame:
    """``rows`` with running sums *before* each row in ``order``: sums within sorted ranges, then over the ranges'
    totals (one row a range), so that no task holds all rows."""
    held = durable(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "mix-ranges")
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    over = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    totals = held.groupBy("_range").agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    totals = totals.select("_range", *[zero(F.sum(f"_{n}").over(over)).alias(f"_{n}") for n in sums])
    placed = held.select("*", *[zero(F.sum(c).over(within)).alias(n) for n, c in sums.items()]).join(totals, "_range")
    return placed.select(*rows.columns, *[(F.col(n) + F.col(f"_{n}")).cast("long").alias(n) for n in sums])


def filled(sources: DataFrame) -> DataFrame:
    """``sources`` (``size, weight``) with ``target``: shares of all words by weight, none above ``CAP`` times its size.
    The unit of weight grows as sources reach their caps; a round sums what the others share."""
    total = sources.agg(F.sum("size")).first()[0] or 0
    cap, unit, seen = CAP * F.col("size"), 0.0, None
    while True:
        full = cap < F.col("weight") * F.lit(unit)
        now = sources.where("size > 0").agg(F.sum(F.when(full, cap)).alias("full"), F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        if not now.open or unit == seen:
            break
        seen, unit = unit, (SHARE * total - (now.full or 0)) / now.open
    share = F.col("weight") * F.lit(unit)
    return sources.withColumn("target", F.when(F.col("size") == 0, F.lit(0.0)).when(cap < share, cap.cast("double")).otherwise(share))


def water_fill(sizes: list[int], weights: list[int], share: float = SHARE, cap: float = CAP) -> list[float]:
    """The same targets of a short list, without Spark."""
    target = [0.0] * len(sizes)
    open_, left = [i for i, s in enumerate(sizes) if s > 0], share * sum(sizes)
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if weights[i] * unit > cap * sizes[i]]
        if not full:
            for i in open_:
                target[i] = weights[i] * unit
            break
        for i in full:
            target[i] = float(cap * sizes[i])
            left -= target[i]
        open_ = [i for i in open_ if i not in set(full)]
    return target


def schedule(spark: SparkSession, sources: DataFrame, slots: int) -> DataFrame:
    """``slot, sid, rank`` of a schedule over ``slots`` cells, of which a source (``sid, first_cell, cells``) has its own."""
    point = ((F.col("id") + 1) * F.lit(GOLDEN)) % F.lit(1.0)
    placed = spark.range(slots).select(F.col("id").alias("slot"), F.floor(point * slots).alias("cell"))
    # an equal join on a coarse grid: a source is copied to the parts of the grid that it covers
    wide = max(1, slots // _GRID)
    part = lambda c: F.floor(c / wide)
    covered = sources.where("cells > 0").select("sid", "first_cell", "cells", F.explode(F.sequence(part(F.col("first_cell")), part(F.col("first_cell") + F.col("cells") - 1))).alias("part"))
    inside = (F.col("cell") >= F.col("first_cell")) & (F.col("cell") < F.col("first_cell") + F.col("cells"))
    met = placed.withColumn("part", part(F.col("cell"))).join(covered, "part").where(inside)
    return met.select("slot", "sid", (F.row_number().over(Window.partitionBy("sid").orderBy("slot")) - 1).cast("long").alias("rank"))


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def _place() -> Column:
    """A row's place in the shuffled stream of its source, 52 bits of a digest of id and text."""
    own = F.concat(F.lit("mix-"), F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("null")), F.lit("-"), F.md5(_text()))
    return F.conv(F.substring(F.md5(own), 1, 13), 16, 10).cast("long")


def _shuffled(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size, h`` of every row; ``h``: its place in the stream."""
    size = F.regexp_count(_text(), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), _place().alias("h"))


def _sources(entries: DataFrame, blocks: int) -> DataFrame:
    """One row a source: ``sid, source, source_size, target, words, block`` (words of one), ``n_blocks, rows`` and its
    cells in the schedule: ``first_cell, cells``."""
    totals = entries.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("size"), F.count("*").alias("rows"))
    weight = F.get(F.array(*map(F.lit, WEIGHTS)), (F.col("sid") % len(WEIGHTS)).cast("int"))
    order = [F.col("source").asc_nulls_last()]
    ranked = durable(running(totals, order, sid=F.lit(1)).withColumn("weight", weight), "mix-sources")
    whole = ranked.agg(F.sum("size")).first()[0] or 0
    most = F.least("size", F.greatest(F.lit(LEAST_BLOCKS).cast("long"), F.ceil(F.col("size") * blocks / max(whole, 1))))
    cut = filled(ranked).withColumn("block", F.greatest(F.lit(1), F.ceil(F.col("size") / F.greatest(F.lit(1), most)))).withColumn("words", F.floor(F.col("target") + 0.5))
    n_blocks = F.ceil(F.col("size") / F.col("block"))
    cells = F.when(F.col("size") > 0, F.expr("words div size") * n_blocks + F.ceil(F.expr("words % size") / F.col("block"))).otherwise(0)
    cut = cut.withColumn("n_blocks", n_blocks).withColumn("cells", cells.cast("long"))
    placed = running(cut, order, first_cell=F.col("cells"))
    return placed.select("sid", "source", F.col("size").alias("source_size"), "target", "words", "block", "n_blocks", "rows", "first_cell", "cells")


def _joined(sources: DataFrame, slots: int) -> DataFrame:
    """``sid, block, times, rest, first_slot``: how often slots join a block whole, the words of its head that the
    slot takes which reaches the target, and the first of these slots."""
    spark = sources.sparkSession
    given = durable(schedule(spark, sources, slots), "mix-schedule")
    counts = given.groupBy("sid").agg(F.count("*").alias("given"))
    known = sources.where("cells > 0").select("sid", F.col("block").alias("wide"), "n_blocks", "cells", "words", "source_size")
    known = known.join(counts, "sid", "left").withColumn("given", F.coalesce("given", F.lit(0)))
    used = F.least(F.greatest("cells", F.col("given") - SETTLED), F.col("given") + SETTLED, CAP * F.col("n_blocks"))
    known = known.withColumn("used", used)
    closing = known.where("used > given").select("sid", F.explode(F.expr("sequence(given, used - 1)")).alias("rank"), "given")
    closing = closing.select((slots + F.col("sid") * SETTLED + F.col("rank") - F.col("given")).alias("slot"), "sid", "rank")
    ranks = given.unionByName(closing).join(known, "sid").where("rank < used")
    head = F.expr("words % source_size")
    rest = F.when((F.col("rank") == F.col("cells") - 1) & (head > 0) & (head % F.col("wide") > 0), head % F.col("wide"))
    return ranks.groupBy("sid", (F.col("rank") % F.col("n_blocks")).alias("block")).agg(F.count_if(rest.isNull()).alias("times"), F.coalesce(F.max(rest), F.lit(0)).alias("rest"), F.min("slot").alias("first_slot"), F.min(F.when(rest.isNull(), F.col("slot"))).alias("first_whole"))


def _mixed(docs: DataFrame, blocks: int) -> DataFrame:
    """``doc_id, source, h, size, source_size, target, taken, slots, first_slot`` for every row of ``docs``."""
    entries = durable(_shuffled(docs).groupBy("source", "h", "doc_id", "size").agg(F.count("*").alias("n")), "mix-sizes")
    sources = durable(_sources(entries, blocks), "mix-sources")
    state = sources.agg(F.sum("cells").alias("slots"), F.max("rows").alias("rows")).first()
    bits = max(12, math.ceil(math.log2(max(1, state.rows or 1) / BUCKET_ROWS)))
    known = sources.select("sid", F.col("source").alias("_name"), "source_size", "target", F.col("block").alias("wide"))
    rows = entries.join(known, entries.source.eqNullSafe(known._name)).drop("_name").withColumn("bucket", F.shiftright("h", 52 - bits))
    # two-level running sums give each entry its place in the stream of its source
    whole = F.col("size") * F.col("n")
    part = rows.groupBy("sid", "bucket").agg(F.sum(whole).alias("part"))
    part = part.withColumn("before", F.sum("part").over(Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))).select("sid", "bucket", F.coalesce("before", F.lit(0)).alias("before"))
    inner = Window.partitionBy("sid", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    first = F.col("before") + F.col("end") - whole
    placed = rows.withColumn("end", F.sum(whole).over(inner)).join(part, ["sid", "bucket"]).withColumn("first", first)
    placed = placed.withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).withColumn("start", F.col("first") + F.col("nth") * F.col("size"))
    placed = placed.select("sid", "doc_id", "source", "h", "size", "source_size", "target", "wide", "nth", "start", (F.col("start") + F.col("size")).alias("end"))
    times = durable(_joined(sources, state.slots or 0), "mix-blocks")
    pieces = placed.where("size > 0").select("sid", "start", "end", "wide", F.explode(F.sequence(F.floor(F.col("start") / F.col("wide")), F.floor((F.col("end") - 1) / F.col("wide")))).alias("block"))
    low, high = F.greatest("start", F.col("block") * F.col("wide")), F.least("end", (F.col("block") + 1) * F.col("wide"))
    head = F.greatest(F.lit(0), F.least(high, F.col("block") * F.col("wide") + F.col("rest")) - low)
    met = pieces.join(times, ["sid", "block"]).select("sid", "start", "end", ((high - low) * F.col("times") + head).alias("words"), (F.col("times") + (head > 0).cast("int")).alias("slots"), F.when(head > 0, F.col("first_slot")).otherwise(F.col("first_whole")).alias("first_slot"))
    taken = met.groupBy("sid", "start", "end").agg(F.sum("words").alias("taken"), F.sum("slots").alias("slots"), F.min("first_slot").alias("first_slot"))
    out = placed.join(taken, ["sid", "start", "end"], "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("taken", "slots")]
    return out.select("doc_id", "source", "h", "size", "source_size", "target", *counts, "first_slot")


def mix(docs: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """``doc_id, size, source_size, target, taken, slots, first_slot`` for every row of ``docs``."""
    with passing(docs.sparkSession, "mix-sizes", "mix-sources", "mix-blocks"):
        return _mixed(docs, blocks).select("doc_id", "size", "source_size", "target", "taken", "slots", "first_slot")


def repeat_by_mix(docs: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """The rows of ``docs`` as the mix takes them. A source's words are the head of its stream, so one
    document a source at most is taken in part: it counts if half of it or more is taken. The totals so
    stay within half a document of the targets. Equal rows are repeated alike, by their mean."""
    mixed = _mixed(docs, blocks).where("size > 0")
    share = F.sum("taken") / F.sum("size")
    times = mixed.groupBy("source", "h", "doc_id").agg(F.floor(share + 0.5).cast("int").alias("__v_times")).where("__v_times > 0")
    times = times.select(F.col("source").alias("__v_source"), F.col("h").alias("__v_h"), F.col("doc_id").alias("__v_id"), "__v_times")
    tagged = docs.select("*", _place().alias("__v_own"))
    same = (F.col("__v_own") == F.col("__v_h")) & F.col("doc_id").cast("long").eqNullSafe(F.col("__v_id")) & F.col("source").cast("string").eqNullSafe(F.col("__v_source"))
    return tagged.join(times, same).select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col("__v_times"))).alias("__v_nth")).drop("__v_nth")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


#: The same rows in DuckDB: targets by the sorted form of the filling, the golden ratio's points on the sources' cells,
#: ranks of the slots, and each document's part of each joined block.
SQL = f"""WITH sized AS (SELECT row_number() OVER () AS rid, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size, ('0x' || md5('mix-' || coalesce(doc_id::VARCHAR, 'null') || '-' || md5(coalesce(text, '')))[1:13])::BIGINT AS h FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1 AS sid FROM sized GROUP BY source),
weighed AS (SELECT *, CASE sid % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, {CAP} * source_size AS cap, {SHARE} * sum(source_size) OVER () AS whole FROM totals),
ordered AS (SELECT *, row_number() OVER (ORDER BY cap / w::DOUBLE, sid) AS k FROM weighed),
units AS (SELECT *, (whole - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE / sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS unit FROM ordered),
stop AS (SELECT min(k) AS k0, arg_min(unit, k) AS unit FROM units WHERE w * unit <= cap),
aimed AS (SELECT u.*, CASE WHEN u.k < s.k0 THEN cap::DOUBLE ELSE u.w * s.unit END AS target FROM units u, stop s),
cut AS (SELECT sid, source, source_size, target, floor(target + 0.5)::BIGINT AS words, greatest(1, ceil(source_size / greatest(1, least(source_size, greatest({LEAST_BLOCKS}, ceil(source_size * {BLOCKS} / (SELECT sum(source_size) FROM totals)))))::DOUBLE))::BIGINT AS wide FROM aimed),
blocked AS (SELECT *, ceil(source_size / wide::DOUBLE)::BIGINT AS n_blocks, CASE WHEN source_size > 0 THEN words // source_size * ceil(source_size / wide::DOUBLE)::BIGINT + ceil(words % source_size / wide::DOUBLE)::BIGINT ELSE 0 END AS cells FROM cut),
sources AS (SELECT *, coalesce(sum(cells) OVER (ORDER BY sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first_cell, (sum(cells) OVER ())::BIGINT AS slots FROM blocked),
points AS (SELECT slot, floor((((slot + 1)::DOUBLE * {GOLDEN}) % 1.0::DOUBLE) * slots)::BIGINT AS cell FROM (SELECT unnest(range(max(slots))) AS slot, max(slots) AS slots FROM sources)),
given AS (SELECT slot, sid, row_number() OVER (PARTITION BY sid ORDER BY slot) - 1 AS rank FROM points p JOIN sources s ON cell >= first_cell AND cell < first_cell + cells),
known AS (SELECT s.*, coalesce(n, 0) AS given, least(greatest(cells, coalesce(n, 0) - {SETTLED}), coalesce(n, 0) + {SETTLED}, {CAP} * n_blocks) AS used FROM sources s LEFT JOIN (SELECT sid, count(*) AS n FROM given GROUP BY sid) USING (sid) WHERE cells > 0),
slots AS (SELECT * FROM given UNION ALL SELECT slots + sid * {SETTLED} + rank - given, sid, rank FROM (SELECT *, unnest(range(given, used)) AS rank FROM known)),
joined AS (SELECT sid, rank % n_blocks AS block, slot, CASE WHEN rank = cells - 1 AND words % source_size % wide > 0 THEN words % source_size % wide ELSE wide END AS width FROM slots JOIN known USING (sid) WHERE rank < used),
placed AS (SELECT rid, doc_id, size::BIGINT AS size, source_size, target, s.sid, wide, sum(size) OVER (PARTITION BY s.sid ORDER BY h, doc_id, size, rid ROWS UNBOUNDED PRECEDING)::BIGINT AS e FROM sized d JOIN sources s ON d.source IS NOT DISTINCT FROM s.source),
pieces AS (SELECT rid, sid, e - size AS b, e, wide, unnest(range((e - size) // wide, (e - 1) // wide + 1)) AS block FROM placed WHERE size > 0),
taken AS (SELECT rid, sum(words)::BIGINT AS taken, count(*) AS slots, min(slot) AS first_slot FROM (SELECT rid, slot, least(e, block * wide + width) - greatest(b, block * wide) AS words FROM pieces JOIN joined USING (sid, block)) WHERE words > 0 GROUP BY rid)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken, coalesce(slots, 0)::BIGINT AS slots, first_slot FROM placed LEFT JOIN taken USING (rid)"""
