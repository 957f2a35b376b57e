"""Nearest vectors for tables of questions: exact in a grid of blocks, approximate by inverted lists.

In the grid a task multiplies one block of rows after the other with one part of the questions and keeps the best ``depth``
rows of each question over all of them; no other pair leaves it, and the number of tasks follows the session's. Inverted lists deal the rows to their nearest centres; a question reads the lists of
its nearest centres and ranks their rows exactly."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.scalar import dot
from ..session import workers_import
from .ranking import DEPTH, ranked
from .textindex import CELLS, Best, first_of_each, kept_best, plain, question_parts

#: Components of the vectors of one block, at most about.
BLOCK_VALUES = 4 << 20
#: Questions of one cell of the grid, at most about, and those whose products with its block are held at once.
QUESTIONS = 16_000
AT_ONCE = 64


def _whole(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    rows = _whole(column)
    return rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1)


def _meet(asked: np.ndarray, anchors: list, found: list[tuple[Best, Best]], rows: pa.Table) -> None:
    """One block's rows for each question, among all rows and in its groups."""
    keys = plain(_whole(rows.column("key")))
    names = rows.column("group").to_pylist()
    numbers = {g: i for i, g in enumerate(sorted({g for g in names if g is not None}))}
    group = np.array([numbers.get(g, -1) for g in names], np.int64)
    held, every = _matrix(rows.column("v")).T, np.arange(len(group))
    alike: dict[tuple, list[int]] = {}
    for n, limits in enumerate(anchors):
        alike.setdefault(tuple(sorted({numbers[g] for g in limits or () if g in numbers})), []).append(n)
    order = [(limits, n) for limits, own in alike.items() for n in own]
    last, within = None, every[:0]
    for first in range(0, len(order), AT_ONCE):
        some = order[first : first + AT_ONCE]
        for (limits, n), near in zip(some, asked[[n for _, n in some]] @ held):
            if limits != last:
                last, within = limits, np.flatnonzero(np.isin(group, limits)) if limits else every[:0]
            found[n][0].add(near, every, keys)
            found[n][1].add(near[within], within, keys)


def _cell(questions: pa.Table, rows: pa.Table, depth: int, margin: float, schema: pa.Schema) -> pa.Table:
    """One list's rows for the questions that read it."""
    found = [(Best(depth, margin), Best(depth, margin)) for _ in range(questions.num_rows)]
    if questions.num_rows and rows.num_rows:
        _meet(_matrix(questions.column("q")), questions.column("anchors").to_pylist(), found, rows)
    return pa.Table.from_batches(kept_best([(n, *own) for n, own in zip(questions.column("query_id").to_pylist(), found)], schema), schema)


def _cells(batches: Iterator[pa.RecordBatch], depth: int, margin: float, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The best rows of each question of a cell; its questions come first, then its rows, met block by block."""
    cell, questions, waiting, asked, found = None, [], [], None, []

    def meet() -> None:
        nonlocal asked, found, waiting
        if asked is None and questions:
            asked = pa.Table.from_batches(questions)
            asked = _matrix(asked.column("q")), asked.column("anchors").to_pylist(), asked.column("query_id").to_pylist()
            found = [(Best(depth, margin), Best(depth, margin)) for _ in asked[2]]
        if asked and waiting:
            _meet(asked[0], asked[1], found, pa.Table.from_batches(waiting))
        waiting = []

    def ended() -> Iterator[pa.RecordBatch]:
        meet()
        yield from kept_best([(n, *own) for n, own in zip(asked[2] if asked else (), found)], schema)

    for batch in batches:
        of, kind = (batch.column(c).to_numpy() for c in ("cell", "row"))
        edge = np.r_[0, np.flatnonzero((of[1:] != of[:-1]) | (kind[1:] != kind[:-1])) + 1, len(of)]
        for a, b in zip(edge, edge[1:]):
            if b > a:
                if of[a] != cell:
                    yield from ended()
                    cell, questions, asked, found = of[a], [], None, []
                (waiting if kind[a] else questions).append(batch.slice(a, b - a))
                if sum(len(w.column("v").flatten()) for w in waiting) >= BLOCK_VALUES:
                    meet()
    yield from ended()


def search(questions: DataFrame, rows: DataFrame, depth: int = DEPTH, places: int = 9) -> DataFrame:
    """``query_id, anchored, key, score, rank``: the first ``depth`` rows by scalar product (cosine of unit vectors), once
    among all rows and once among those whose ``group`` is one of the question's ``anchors``. ``questions``: ``query_id,
    q, anchors``; ``rows``: ``key, group, v``. Null vectors take no part; all have one length."""
    asked, parts = question_parts(questions.select("query_id", F.col("q").cast("array<double>").alias("q"), "anchors").where("q is not null"), QUESTIONS)
    own = rows.select("key", F.col("group").cast("string").alias("group"), F.col("v").cast("array<double>").alias("v")).where("v is not null")
    size = own.agg(F.sum(F.size("v").cast("long"))).first()[0] or 0
    cells = min(-(-max(size, 1) // BLOCK_VALUES), max(1, CELLS * rows.sparkSession.sparkContext.defaultParallelism // parts))
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.withColumn("cell", all_of(cells)).withColumn("row", F.lit(0))
    right = own.withColumn("cell", F.pmod(F.xxhash64("key"), F.lit(cells)).cast("int")).withColumn("part", all_of(parts)).withColumn("row", F.lit(1))
    key, asked_by = rows.schema["key"].dataType, questions.schema["query_id"].dataType
    arrow = pa.schema([("query_id", to_arrow_type(asked_by)), ("anchored", pa.bool_()), ("key", to_arrow_type(key)), ("score", pa.float64())])
    workers_import(rows.sparkSession)
    met = left.unionByName(right, allowMissingColumns=True).withColumn("cell", F.col("part") * cells + F.col("cell"))
    dealt = met.repartitionById(parts * cells, "cell").sortWithinPartitions("cell", "row")
    found = dealt.mapInArrow(partial(_cells, depth=depth, margin=10.0**-places, schema=arrow), f"query_id {asked_by.simpleString()}, anchored boolean, key {key.simpleString()}, score double")
    return first_of_each(found, depth, places)


# --- inverted lists ---------------------------------------------------------------------------------

#: Rows that the centres are fitted to, at most about; one centre for so many rows; centres at most; rounds of the fit.
SAMPLE = 100_000
ROWS_A_CENTRE = 64
CENTRES = 4_096
ROUNDS = 12
#: Questions that the number of probes is measured with, and the share of their first rows that it reaches.
QUESTIONS_ASKED = 64
RECALL = 0.95


def _sample(rows: DataFrame, total: int) -> np.ndarray:
    """A bounded sample by a hash of the keys, the same in each run."""
    share = min(1.0, SAMPLE / max(total, 1))
    some = rows.where(F.pmod(F.xxhash64("key", F.lit(11)), F.lit(1 << 30)) < int(share * (1 << 30)))
    return np.array([r.v for r in some.select("key", "v").orderBy("key").collect()], np.float64)


def centres(rows: DataFrame) -> np.ndarray:
    """Unit centres by spherical k-means over a sample of ``rows`` (``key, v``, unit vectors)."""
    total = rows.count()
    sample = _sample(rows, total)
    k = int(min(CENTRES, max(1, total // ROWS_A_CENTRE), len(sample)))
    if not k:
        return np.zeros((0, 0))
    book = sample[np.random.default_rng(5).permutation(len(sample))[:k]].copy()
    for _ in range(ROUNDS):
        own = np.argmax(sample @ book.T, axis=1)
        sums = np.zeros_like(book)
        np.add.at(sums, own, sample)
        length = np.linalg.norm(sums, axis=1)
        book[length > 0] = sums[length > 0] / length[length > 0, None]
    return book


def _nearest_centres(batches: Iterator[pa.RecordBatch], book: np.ndarray, n: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            near = -(_matrix(batch.column("v")) @ book.T)
            n_ = min(n, book.shape[0])
            lists = np.argpartition(near, n_ - 1, axis=1)[:, :n_].astype(np.int32)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, n_ * len(lists) + 1, n_), pa.int32()), pa.array(lists.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("v"), flat], ["key", "v", "lists"])


def listed(rows: DataFrame, book: np.ndarray, n: int = 1) -> DataFrame:
    """``key, v, lists``: the ``n`` nearest centres of every row."""
    own = rows.select("key", F.col("v").cast("array<double>").alias("v")).where("v is not null")
    workers_import(rows.sparkSession)
    return own.mapInArrow(partial(_nearest_centres, book=book, n=n), f"key {own.schema['key'].dataType.simpleString()}, v array<double>, lists array<int>")


def _probes(rows: DataFrame, lists: DataFrame, book: np.ndarray, depth: int, recall: float) -> int:
    """Lists to read for ``recall``: for some rows of the table as questions, the lists that hold their exact first
    ``depth`` rows, in the order in which a search would read them."""
    some = rows.orderBy(F.xxhash64("key", F.lit(13)), "key").limit(QUESTIONS_ASKED).collect()  # a bounded set of questions
    asked = rows.sparkSession.createDataFrame([(n, [float(x) for x in r.v], None) for n, r in enumerate(some)], "query_id int, q array<double>, anchors array<string>")
    exact = search(asked, rows.withColumn("group", F.lit(None).cast("string")), depth)
    held = exact.join(lists.select("key", "list"), "key").groupBy("query_id", "list").agg(F.count("*").alias("n")).collect()
    found = np.zeros((len(some), len(book)))
    for r in held:
        found[r.query_id, r.list] = r.n
    order = np.argsort(-(np.array([r.v for r in some], np.float64) @ book.T), axis=1, kind="stable")
    reached = np.cumsum(np.take_along_axis(found, order, axis=1), axis=1) / found.sum(axis=1, keepdims=True)
    return 1 + int(np.argmax(reached.mean(axis=0) >= recall))


def write_lists(rows: DataFrame, folder: str, depth: int = DEPTH, recall: float = RECALL) -> None:
    """The rows (``key, v``, unit vectors) in a folder for each inverted list, with the centres and the number of lists
    that a search has to read for ``recall`` of the first ``depth`` rows, as measured on questions from the table."""
    book = centres(rows)
    spark = rows.sparkSession
    if len(book):
        dealt = listed(rows, book).select("key", "v", F.col("lists")[0].alias("list"))
        # a list that holds far more rows than others is written by several tasks
        dealt.repartition("list", F.pmod(F.xxhash64("key"), F.lit(4))).write.partitionBy("list").parquet(f"{folder}/rows")
        lists = spark.read.parquet(f"{folder}/rows")
        probes = _probes(lists.select("key", "v"), lists, book, depth, recall)
        spark.createDataFrame([(n, probes, [float(x) for x in c]) for n, c in enumerate(book)], "list int, probes int, centre array<double>").write.parquet(f"{folder}/centres")


def read_lists(spark: SparkSession, folder: str) -> tuple[DataFrame, np.ndarray, int]:
    """The lists, their centres (``CENTRES`` at most) and the number of lists to read."""
    known = sorted(spark.read.parquet(f"{folder}/centres").collect(), key=lambda r: r.list)
    return spark.read.parquet(f"{folder}/rows"), np.array([r.centre for r in known], np.float64), known[0].probes


def search_lists(lists: DataFrame, book: np.ndarray, query: Sequence[float], depth: int = DEPTH, places: int = 9, probes: int = 8) -> DataFrame:
    """``key, score, rank`` of one question: the lists of its ``probes`` nearest centres are read (no other folder is)
    and their rows ranked exactly."""
    near = np.argsort(-(book @ np.asarray(query, np.float64)), kind="stable")[:probes]
    rows = lists.where(F.col("list").isin(*map(int, near)))
    scored = rows.select("key", F.round(dot(F.col("v"), F.array(*[F.lit(float(x)) for x in query])), places).alias("score"))
    return ranked(scored.orderBy(F.desc("score"), "key").limit(depth), [F.desc("score"), F.col("key")])


def batch_lists(lists: DataFrame, book: np.ndarray, questions: DataFrame, depth: int = DEPTH, places: int = 9, probes: int = 8) -> DataFrame:
    """``query_id, key, score, rank`` of a table of questions (``query_id, q``): each meets the rows of its ``probes``
    nearest lists (``key, v, list``), list by list, and a task keeps the best ``depth`` of a question and list."""
    asked = listed(questions.select(F.col("query_id").alias("key"), F.col("q").alias("v")), book, probes)
    left = asked.select(F.col("key").alias("query_id"), F.col("v").alias("q"), F.lit(None).cast("array<string>").alias("anchors"), F.explode("lists").alias("list"))
    right = lists.select("key", "v", F.lit(None).cast("string").alias("group"), "list")
    key, asked_by = right.schema["key"].dataType, left.schema["query_id"].dataType
    arrow = pa.schema([("query_id", to_arrow_type(asked_by)), ("anchored", pa.bool_()), ("key", to_arrow_type(key)), ("score", pa.float64())])
    workers_import(lists.sparkSession)
    salts = 1 + (lists.groupBy("list").count().agg(F.max("count")).first()[0] or 0) * max(1, book.shape[1]) // BLOCK_VALUES
    left = left.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    right = right.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(salts)).cast("int"))
    met = left.groupBy("list", "salt").cogroup(right.groupBy("list", "salt"))
    found = met.applyInArrow(partial(_cell, depth=depth, margin=10.0**-places, schema=arrow), f"query_id {asked_by.simpleString()}, anchored boolean, key {key.simpleString()}, score double")
    return first_of_each(found, depth, places).drop("anchored")
