"""Spelling variants against brute force, the SQL twin and the defined cases."""

import random
import re
import zlib
from collections import Counter

import duckdb
from veristrata.llm import spelling

SF = "/root/testdata/sf0.001"


def _brute(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'null' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    letters = sorted({c for w in words for c in w})
    near = {w: {v for i in range(len(w) + 1) for v in [w[:i] + w[i + 1 :]] * (i < len(w)) + [w[:i] + c + w[i:] for c in letters] + [w[:i] + c + w[i + 1 :] for c in letters if i < len(w)] if v != w and v in words} for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 2 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out, key=str)


def _got(df):
    return sorted(map(tuple, spelling.group(df).select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)


def test_equals_brute_force(spark):
    r = random.Random(3)
    stems = ["".join(r.choice("aeinrstéœÀß") for _ in range(r.randint(4, 9))) for _ in range(60)]
    rows = []
    for i in range(400):
        w = list(r.choice(stems))
        for _ in range(r.randint(0, 2)):
            at = r.randrange(len(w))
            w[at : at + r.randint(0, 1)] = r.choice(["", "a", "É", "N", "÷"])
        rows.append((i % 90, " ".join(["".join(w)] * r.randint(1, 9))))
    rows += [(900, "kolume " * 4 + "kolumen " * 9 + "kolumnen " * 40)]  # a chain of forms
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = _brute(rows)
    assert _got(df) == want
    assert sum(w[1] is not None for w in want) > 5 and any(w[1] != w[2] for w in want if w[1])


def test_one_hot_half_and_band(spark):
    """Thousands of words share a half and their parities; pairs among them are found all the same."""
    tail = "nnnnnnnn"
    rows = [(i, f"{a}{b}{c}{d}{tail} " * 3) for i, (a, b, c, d) in enumerate((a, b, c, d) for a in "aeio" for b in "rsth" for c in "bcdf" for d in "lmpq")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = _got(df)
    assert got == _brute(rows) and sum(g[4] > 8 for g in got) > 200


def test_query_equals_its_sql(spark):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    cols = ["word", "form", "root", "n", "n_near", "form_n"]
    got = sorted(map(tuple, spelling.query(spark, SF).select(*cols).collect()), key=str)
    assert got == sorted(db.execute(f"SELECT {', '.join(cols)} FROM ({spelling.SQL})").fetchall(), key=str)
    assert len(got) > 1000


def test_defined_cases(spark):
    rows = [(1, "House houses HOUSE house. Houses; houses house!"), (1, "House houses HOUSE house. Houses; houses house!"), (None, "house"), (2, None), (3, ""), (4, "12 _ 34"), (5, "z" * 300_000), (5, "z" * 300_000), (5, "z" * 300_000), (6, "lorem " * 200_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    clash = df.selectExpr("*", "doc_id as n", "text as word", "text as form", "1 as key", "2 as b0", "3 as root")
    assert _got(df) == _got(clash) == _brute(rows)
    assert _got(df.limit(0)) == []


def test_words_are_never_broadcast(spark, capsys):
    """Few words stay below any limit by size, so that only the hints keep them from the driver."""
    words = spark.createDataFrame([("kolumne", 9), ("kolumnen", 4), ("house", 5)], "word string, n long")
    for df in (spelling.near_pairs(words), spelling.forms(words), spelling.group(spark.createDataFrame([(1, "house " * 9 + "houses " * 3)], "doc_id long, text string"))):
        df.explain()
        plan = capsys.readouterr().out
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_long_words_in_one_pass(spark, monkeypatch):
    """Words of any length one edit apart are found; the comparison does not take the square of their length."""
    long = "abcdé" * 40_000
    rows = [(i, w) for i, w in enumerate(("long " + long, long[:90] + long[91:], long + "z", "z" + long[1:], long[:7] + "zz" + long[9:]))] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(g[0] == long, g[4]) for g in _got(df) if len(g[0]) > 100_000}
    assert got == {(True, 3), (False, 1), (False, 0)}
    r = random.Random(5)
    rows = [(i, " ".join(["".join(r.choice("abé") for _ in range(r.randint(5, 7)))] * r.randint(1, 9))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(spelling, "LONG", 5)
    assert _got(df) == _brute(rows)
