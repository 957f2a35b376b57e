"""Vector codes against plain Lloyd rounds on Python's integers, the SQL twin and the defined cases."""

import hashlib
import math
import random
from fractions import Fraction

import duckdb
import numpy as np
from veristrata.llm import vq

SF = "/root/testdata/sf0.001"
COLS = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def _brute(rows):
    """rows: (vec_id, vector, label). Distances to every entry, exact fractions."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    if not kept:
        return []
    dim = 8 * max(1, -(-max(len(r[1]) for r in kept) // 8))
    width = dim // 8
    whole = [[math.floor(4096 * Fraction(x)) for x in r[1]] + [0] * (dim - len(r[1])) for r in kept]
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, kept[i][1]))
    part = lambda i, p: whole[i][p * width : (p + 1) * width]
    books = [[part(i, p) for i in order[:16]] for p in range(8)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for step in range(7):
        near = [[min((far(part(i, p), c), k) for k, c in enumerate(books[p])) for p in range(8)] for i in range(len(kept))]
        for p in range(8) if step < 6 else ():
            for k in range(len(books[p])):
                own = [part(i, p) for i in range(len(kept)) if near[i][p][1] == k]
                if own:
                    books[p][k] = [sum(c) // len(own) for c in zip(*own)]
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    errors = [sum(d for d, _ in n) for n in near]
    label = {}
    for r, e in zip(kept, errors):
        label[r[2]] = label.get(r[2], 0) + e
    fits = lambda e: e if e < 1 << 63 else None
    big = {r[2] for r, e in zip(kept, errors) if e >= 1 << 63}
    return sorted(((r[0], "".join(f"{k:02x}" for _, k in n), fits(e), None if r[2] in big else fits(label[r[2]]), digest) for r, n, e in zip(kept, near, errors)), key=str)


def _got(df):
    return sorted(map(tuple, vq.encode(df).select(*COLS).collect()), key=str)


def test_equals_brute_force(spark):
    r = random.Random(5)
    rows = [(i, [r.gauss(c, 0.05) for c in ([0.5, -0.5, 0.1] * 6)[i % 3 : i % 3 + 16]], i % 4 or None) for i in range(700)]
    rows += [(i, rows[i - 700][1], 2) for i in range(700, 760)]  # equal vectors
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    rows = [tuple(x) for x in df.collect()]
    assert _got(df.repartition(3)) == _brute(rows)


def test_query_equals_its_sql(spark):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    got = sorted(map(tuple, vq.query(spark, SF).select(*COLS).collect()))
    assert got == sorted(db.execute(f"SELECT {', '.join(COLS)} FROM ({vq.SQL})").fetchall()) and len(got) > 50


def test_boxes_eliminate_entries():
    """Subtrees are given away whole, and ties go to the lower index as in a full search."""
    r = np.random.default_rng(1)
    points = np.concatenate([r.integers(-9, 9, (900, 4)) + 200 * k for k in range(4)]).astype(float)
    book = np.array([[200.0 * k + d] * 4 for k in range(4) for d in (0, 3, 3, 6)])
    tree = vq.Tree(points)
    whole = sum(int((ends - starts).sum()) for starts, ends, _, _ in tree.filtered(book) if ends is not None)
    assert whole > 0 and vq.Tree(np.full((500, 4), 1.5)).nearest(book).tolist() == [0] * 500
    want = np.argmin(((points[:, None] - book[None]) ** 2).sum(axis=2), axis=1)
    assert (tree.nearest(book) == want).all()
    sums, counts = tree.totals(book)
    assert counts.tolist() == np.bincount(want, minlength=16).tolist() and sums.sum(axis=0).tolist() == points.sum(axis=0).tolist()


def test_defined_cases(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(5, [0.25] * 8, 1), (None, [1.0] * 8, 1), (None, [0.5] * 8, None), (5, [0.25] * 8, 1), (5, [0.1] * 9, 1), (1, None, 1), (2, [inf] * 8, 1), (3, [nan] + [0.0] * 7, 1), (4, [None] + [0.0] * 7, 1), (6, [], 2), (7, [-0.3] * 3, 2), (-8, [2.0] * 20, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    clash = df.selectExpr("*", "vec_id as code", "label as error", "embedding as trees", "label as _label")
    assert _got(df) == _got(clash) == _brute(rows)
    huge = [(i, [1e300 * (i % 3), -3e9, 1e20, float(i)] * 2, i % 2) for i in range(60)] + [(99, [0.5] * 8, 7)]
    assert _got(spark.createDataFrame(huge, df.schema)) == _brute(huge)
    assert _got(df.limit(0)) == [] and _got(df.where("vec_id = 1")) == []
