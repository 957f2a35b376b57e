"""Operator 12: vector codes by Lloyd's rounds, filtered through kd-trees.

1. Components become integers, ``floor(4096 * x)``; a vector is cut into 8 equal consecutive parts. The codebook of
   a part position starts as that part of the 16 first rows by id.
2. Every task cuts its rows into blocks and builds a balanced kd-tree over each part position of a block. A node
   keeps its bounding box and the sum and count of its parts; trees are written once and read by all rounds.
3. A round goes down all trees level by level. Of a node's candidates the one nearest to the box's middle is the
   rival; another leaves if no point of the box is as near to it (as near, with a lower index: it stays). A node with
   one candidate left gives its sum and count to it at once; leaves try the candidates that are left.
4. Tasks add up sums and counts by part and entry; Spark adds up those (16 entries of 8 parts a task), and an entry
   becomes the floor of its mean. Codebooks are all that the driver sees: 128 entries at every table size.
5. The last assignment gives whole subtrees their code in the same way; errors are then exact distances.

Arithmetic is exact: floats hold every integer met as long as squared distances stay below 2**53; blocks with larger
components run the same steps on Python's integers. Sums leave tasks in 30-bit limbs, so they cannot overflow.

Defined cases: rows with a null vector or with null or non-finite components are dropped. Null ids come after all
others in the choice of the first rows, equal ids are ordered by their vectors; repeated rows count again. Fewer than
16 rows make as many entries. Vectors are filled with zeros up to the longest one's length, and that up to a multiple
of 8. An error too large for a long is null, and so is its label's sum. An empty table gives an empty result. Other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import durable, map_arrow, passing, table

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
LEAF = 32
#: Rows and bytes of components in one block, at most.
BLOCK_ROWS = 8192
BLOCK_BYTES = 16 << 20
_LIMB = 30
_EXACT = float(1 << 53)


def kept_rows(vectors: DataFrame) -> DataFrame:
    """``vec_id, label, embedding`` (doubles) of the rows that take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("embedding"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return rows.where(F.col("embedding").isNotNull() & F.forall("embedding", finite))


def whole_numbers(flat: np.ndarray) -> np.ndarray:
    """``floor(SCALE * x)``: as 64-bit integers, or as Python's where one of them needs more."""
    if not len(flat) or np.abs(flat).max() < 2.0**48:
        return np.floor(flat * SCALE).astype(np.int64)
    parts = (float(x).as_integer_ratio() for x in flat)
    return np.array([SCALE * a // b for a, b in parts], dtype=object)


def _filled(vectors: pa.ChunkedArray, dim: int) -> np.ndarray:
    """One row a vector, zeros after its end."""
    sizes = pc.list_value_length(vectors).to_numpy().astype(np.int64)
    out = np.zeros((len(sizes), dim))
    out[np.arange(dim)[None, :] < sizes[:, None]] = pc.list_flatten(vectors).to_numpy()
    return out


def _exact(points: np.ndarray) -> np.ndarray:
    """``points`` as doubles if squared distances among them are exact then, else as Python's integers."""
    top = max((abs(int(points.max())), abs(int(points.min())))) if points.size else 0
    return points.astype(np.float64 if points.shape[-1] * (2 * top) ** 2 < _EXACT else object)


class Tree:
    """A balanced kd-tree over the rows of ``points``: level by level, each node is a range of ``order``."""

    def __init__(self, points: np.ndarray):
        n = len(points)
        self.depth = max(0, int(np.ceil(np.log2(max(1, n) / LEAF))))
        self.order = np.arange(n, dtype=np.int32)
        bounds = np.array([0, n])
        self.levels = []
        for level in range(self.depth + 1):
            self.levels.append(bounds)
            if level < self.depth:
                halves = [bounds[0]]
                for a, b in zip(bounds[:-1], bounds[1:]):
                    own = self.order[a:b]
                    at = points[own]
                    wide = int(np.argmax(at.max(axis=0) - at.min(axis=0)))
                    self.order[a:b] = own[np.argsort(at[:, wide], kind="stable")]
                    halves += [(a + b) // 2, b]
                bounds = np.array(halves)
        self.points = points[self.order]
        # leaves first: the inner nodes' boxes and sums follow from them
        starts = self.levels[-1][:-1]
        low, high, total = (f.reduceat(self.points, starts, axis=0) for f in (np.minimum, np.maximum, np.add))
        self.boxes = [(low, high, total)]
        for _ in range(self.depth):
            low, high, total = np.minimum(low[::2], low[1::2]), np.maximum(high[::2], high[1::2]), total[::2] + total[1::2]
            self.boxes.insert(0, (low, high, total))

    def filtered(self, book: np.ndarray) -> Iterator[tuple]:
        """Yields ``(starts, ends, sums, entry)`` of the nodes with one candidate left and, from the leaves,
        ``(rows, None, points, entry)``: places in ``points`` with their nearest entries."""
        norm = (book * book).sum(axis=1)
        k = len(book)
        index = np.arange(k)
        nodes = np.zeros(1, np.int64)
        open_ = np.ones((1, k), bool)
        for level in range(self.depth + 1):
            low, high, total = (x[nodes] for x in self.boxes[level])
            twice = low + high  # twice the middle: all stays whole
            gap = np.where(open_, norm[None, :] - twice @ book.T, np.inf if book.dtype != object else 1 << 4096)
            rival = np.argmin(gap, axis=1)
            apart = book[None, :, :] - book[rival][:, None, :]
            corner = np.where(apart > 0, high[:, None, :], low[:, None, :])
            least = norm[None, :] - norm[rival][:, None] - 2 * (corner * apart).sum(axis=2)
            open_ = open_ & ((least < 0) | ((least == 0) & (index[None, :] < rival[:, None])) | (index[None, :] == rival[:, None]))
            single = open_.sum(axis=1) == 1
            starts, ends = self.levels[level][nodes], self.levels[level][nodes + 1]
            if single.any():
                yield starts[single], ends[single], total[single], np.argmax(open_[single], axis=1)
            nodes, open_ = nodes[~single], open_[~single]
            if not len(nodes):
                return
            if level == self.depth:
                starts, ends = starts[~single], ends[~single]
                sizes = ends - starts
                rows = np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
                points = self.points[rows]
                far = norm[None, :] - 2 * (points @ book.T)
                far = np.where(np.repeat(open_, sizes, axis=0), far, np.inf if book.dtype != object else 1 << 4096)
                yield rows, None, points, np.argmin(far, axis=1)
                return
            nodes = np.stack([2 * nodes, 2 * nodes + 1], axis=1).ravel()
            open_ = np.repeat(open_, 2, axis=0)

    def totals(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums and counts of the parts nearest to each entry of ``book``."""
        sums, counts = np.zeros(book.shape, dtype=book.dtype), np.zeros(len(book), np.int64)
        for starts, ends, values, entry in self.filtered(book):
            np.add.at(sums, entry, values)
            np.add.at(counts, entry, 1 if ends is None else ends - starts)
        return sums, counts

    def nearest(self, book: np.ndarray) -> np.ndarray:
        """The nearest entry of each row, in the rows' first order."""
        out = np.empty(len(self.order), np.int64)
        for starts, ends, _, entry in self.filtered(book):
            if ends is None:
                out[self.order[starts]] = entry
            else:
                for a, b, e in zip(starts, ends, entry):
                    out[self.order[a:b]] = e
        return out


def _to_bytes(array: np.ndarray) -> bytes:
    """Whole numbers as bytes: 32 or 64 bits each, or text where one needs more."""
    if array.dtype != object:
        wide = array.astype(np.int64)
        small = wide.astype(np.int32)
        return b"4" + small.tobytes() if (small == wide).all() else b"8" + wide.tobytes()
    return b"t" + " ".join(map(str, array.ravel())).encode()


def _from_bytes(data: bytes, dim: int) -> np.ndarray:
    kind = data[:1]
    if kind == b"t":
        return np.array([int(x) for x in data[1:].split()], dtype=object).reshape(-1, dim)
    return np.frombuffer(data, np.int32 if kind == b"4" else np.int64, offset=1).astype(np.int64).reshape(-1, dim)


def _packed(tree: Tree) -> list[bytes]:
    """A tree as its order, its points and its nodes' boxes and sums."""
    nodes = [np.concatenate([level[k] for level in tree.boxes]) for k in range(3)]
    return [tree.order.tobytes(), _to_bytes(tree.points), *map(_to_bytes, nodes)]


def _unpacked(parts: list[bytes], dim: int, kind: type) -> Tree:
    tree = Tree.__new__(Tree)
    tree.order = np.frombuffer(parts[0], np.int32)
    n = len(tree.order)
    tree.points, *nodes = (_from_bytes(x, dim).astype(kind) for x in parts[1:])
    tree.depth = max(0, int(np.ceil(np.log2(max(1, n) / LEAF))))
    bounds, tree.levels, tree.boxes, at = np.array([0, n]), [], [], 0
    for level in range(tree.depth + 1):
        tree.levels.append(bounds)
        tree.boxes.append(tuple(x[at : at + (1 << level)] for x in nodes))
        at += 1 << level
        middle = (bounds[:-1] + bounds[1:]) // 2
        bounds = np.insert(bounds, np.arange(1, len(bounds)), middle)
    return tree


def _blocks(batches: Iterator[pa.RecordBatch], dim: int, label_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Rows in blocks: ids, labels and the trees of all part positions."""
    limit = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * dim)))

    def block(rows: pa.Table) -> pa.RecordBatch:
        whole = whole_numbers(_filled(rows.column("embedding"), dim).ravel()).reshape(-1, dim)
        width = dim // PARTS
        trees = [x for p in range(PARTS) for x in _packed(Tree(_exact(whole[:, p * width : (p + 1) * width])))]
        ids, labels = (pa.array([rows.column(c).to_pylist()], pa.list_(t)) for c, t in (("vec_id", pa.int64()), ("label", label_type)))
        return pa.RecordBatch.from_arrays([ids, labels, pa.array([trees], pa.list_(pa.binary()))], ["ids", "labels", "trees"])

    held, n = [], 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            take = min(limit - n, batch.num_rows - at)
            held.append(batch.slice(at, take))
            n, at = n + take, at + take
            if n == limit:
                yield block(pa.Table.from_batches(held))
                held, n = [], 0
    if n:
        yield block(pa.Table.from_batches(held))


def _limbs(value: int) -> Iterator[tuple[int, int]]:
    """``value`` as 30-bit limbs with its sign, lowest first; no zero limbs."""
    sign, value, at = (-1 if value < 0 else 1), abs(value), 0
    while value:
        if value & ((1 << _LIMB) - 1):
            yield at, sign * (value & ((1 << _LIMB) - 1))
        value, at = value >> _LIMB, at + 1


def _book(books: list[list[list[int]]], part: int, tree_parts: list[bytes]) -> np.ndarray:
    """The codebook of a part in the arithmetic that it and the tree need."""
    book = np.array(books[part], dtype=object)
    low, high = (_from_bytes(x, book.shape[1])[0] for x in tree_parts[2:4])  # the root's box
    return book.astype(_exact(np.concatenate([book, [low.astype(object)], [high.astype(object)]])).dtype)


def _summed(batches: Iterator[pa.RecordBatch], books: list[list[list[int]]]) -> Iterator[pa.RecordBatch]:
    """One round of one task: ``slot, limb, value`` of its sums and counts."""
    width = len(books[0][0])
    sums = np.zeros((PARTS, len(books[0]), width + 1), dtype=object)
    for batch in batches:
        for trees in batch.column("trees"):
            data = [x.as_py() for x in trees]
            for p in range(PARTS):
                own = data[5 * p : 5 * p + 5]
                book = _book(books, p, own)
                total, counts = _unpacked(own, width, book.dtype).totals(book)
                sums[p, :, :width] += np.array([[int(x) for x in row] for row in total], dtype=object).reshape(total.shape)
                sums[p, :, width] += counts.astype(object)
    rows = [(slot, limb, v) for slot, value in enumerate(sums.ravel()) for limb, v in _limbs(int(value))]
    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.int64()))], ["slot", "limb", "value"])


def _coded(batches: Iterator[pa.RecordBatch], books: list[list[list[int]]], label_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """``vec_id, label, code, error`` of every row."""
    width = len(books[0][0])
    for batch in batches:
        for ids, labels, trees in zip(batch.column("ids"), batch.column("labels"), batch.column("trees")):
            data = [x.as_py() for x in trees]
            n = len(ids)
            codes, errors = np.empty((n, PARTS), np.uint8), np.zeros(n, np.int64)
            for p in range(PARTS):
                own = data[5 * p : 5 * p + 5]
                book = _book(books, p, own)
                tree = _unpacked(own, width, book.dtype)
                codes[:, p] = tree.nearest(book)
                off = tree.points - book[codes[tree.order, p]]
                apart = (off * off).sum(axis=1)
                errors = errors.astype(apart.dtype if apart.dtype == object else errors.dtype)
                errors[tree.order] += apart if errors.dtype == object and apart.dtype == object else apart.astype(np.int64)
            digits = codes.tobytes().hex()
            code = [digits[k : k + 2 * PARTS] for k in range(0, len(digits), 2 * PARTS)]
            error = errors if errors.dtype != object else [int(e) if e < 1 << 63 else None for e in errors]
            yield pa.RecordBatch.from_arrays([ids.values, labels.values.cast(label_type), pa.array(code), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])


def _rounds(blocks: DataFrame, books: list[list[list[int]]]) -> list[list[list[int]]]:
    """The codebooks after all rounds."""
    shape = (PARTS, len(books[0]), len(books[0][0]) + 1)
    for _ in range(ROUNDS):
        parts = map_arrow(blocks.select("trees"), partial(_summed, books=books), "slot int, limb int, value long")
        sums = np.zeros(int(np.prod(shape)), dtype=object)
        for r in parts.groupBy("slot", "limb").agg(F.sum("value").alias("value")).collect():  # of the codebooks' entries alone
            sums[r.slot] += r.value << (_LIMB * r.limb)
        sums = sums.reshape(shape)
        books = [[[int(x) // int(s[-1]) for x in s[:-1]] if s[-1] else entry for s, entry in zip(sums[p], books[p])] for p in range(PARTS)]
    return books


def encode(vectors: DataFrame) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of every kept row of ``vectors``."""
    spark = vectors.sparkSession
    kept = kept_rows(vectors)
    label_type = kept.schema["label"].dataType
    empty = spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    longest = kept.agg(F.max(F.size("embedding"))).first()[0]
    if longest is None:
        return empty
    dim = PARTS * max(1, -(-longest // PARTS))
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(ENTRIES).collect()
    start = whole_numbers(_filled(pa.chunked_array([pa.array([r.embedding for r in first], pa.list_(pa.float64()))]), dim).ravel()).reshape(-1, dim)
    width = dim // PARTS
    books = [[[int(x) for x in row[p * width : (p + 1) * width]] for row in start] for p in range(PARTS)]
    arrow_label = to_arrow_type(label_type)
    with passing(spark, "vq-coded"):
        schema = f"ids array<long>, labels array<{label_type.simpleString()}>, trees array<binary>"
        blocks = durable(map_arrow(kept, partial(_blocks, dim=dim, label_type=arrow_label), schema), "vq-trees")
        books = _rounds(blocks, books)
        rows = map_arrow(blocks, partial(_coded, books=books, label_type=arrow_label), f"vec_id long, label {label_type.simpleString()}, code string, error long")
        coded = durable(rows, "vq-coded")
    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    whole = F.when(F.count("*") == F.count("error"), F.sum(F.col("error").cast("decimal(38,0)")))
    sums = coded.groupBy(F.col("label").alias("_label")).agg(whole.alias("_sum")).select("_label", F.expr("try_cast(_sum AS BIGINT)").alias("label_error"))
    out = coded.join(sums, F.col("label").eqNullSafe(F.col("_label")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    """The same rows in DuckDB: plain distances to every entry, the rounds one after the other."""
    near = "SELECT p.vec_id, p.part, p.v, b.entry, list_sum(list_transform(range(1, len(p.v) + 1), lambda i: (p.v[i] - b.c[i]) * (p.v[i] - b.c[i])))::BIGINT AS d FROM parts p JOIN b{r} b USING (part)"
    steps = [
        "kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "parts AS (SELECT vec_id, label, part, v[part * (len(v) // 8) + 1 : (part + 1) * (len(v) // 8)] AS v FROM kept, range(8) r(part))",
        "b0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, v AS c FROM parts WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 16))",
    ]
    for r in range(ROUNDS + 1):
        steps.append(f"n{r} AS MATERIALIZED (SELECT vec_id, part, any_value(v) AS v, arg_min(entry, d * 16 + entry) AS entry, min(d) AS d FROM ({near.format(r=r)}) GROUP BY vec_id, part)")
        if r < ROUNDS:
            steps.append(f"s{r} AS (SELECT part, entry, i, (sum(v[i]) - ((sum(v[i]) % count(*)) + count(*)) % count(*)) // count(*) AS m FROM n{r}, range(1, 9) t(i) GROUP BY part, entry, i)")
            steps.append(f"m{r} AS (SELECT part, entry, list(m::BIGINT ORDER BY i) AS c FROM s{r} GROUP BY part, entry)")
            steps.append(f"b{r + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.c, b.c) AS c FROM b{r} b LEFT JOIN m{r} m USING (part, entry))")
    steps.append(f"coded AS (SELECT vec_id, string_agg(printf('%02x', entry::INT), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM n{ROUNDS} GROUP BY vec_id)")
    steps.append(f"digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{ROUNDS})")
    return "WITH " + ",\n".join(steps) + "\nSELECT c.vec_id, code, error, sum(error) OVER (PARTITION BY k.label)::BIGINT AS label_error, codebooks_sha256 FROM coded c JOIN kept k USING (vec_id), digest"


SQL = _sql()
