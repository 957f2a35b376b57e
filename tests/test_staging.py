"""Staging of dependent tables: get-or-create, replay, crashes, two writers."""

import pytest
from pyspark.sql import functions as F
from veristrata.sources import staging

PARENTS = {"child": {"parent": "p"}, "leaf": {"child": "c", "parent": "p"}}


def _batches(spark, ids, suffix=""):
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    return {
        "leaf": (make([(1000 + i, 100 + i, i % 3) for i in ids], "l long, c long, p long"), "l"),
        "child": (make([(100 + i, i % 3, f"v{i}{suffix}") for i in ids], "c long, p long, v string"), "c"),
        "parent": (make([(i % 3,) for i in ids], "p long").distinct(), "p"),
    }


def _keys(spark, folder, table, key):
    rows = staging.read_table(spark, folder, table)
    return sorted(r[0] for r in rows.select(key).collect()) if rows is not None else []


def test_get_or_create_and_replay(spark, tmp_path):
    folder = f"file://{tmp_path}/s"
    assert staging.stage_tables(_batches(spark, range(5)), PARENTS, folder, "r1") == {"leaf": 5, "child": 5, "parent": 3}
    assert staging.stage_tables(_batches(spark, range(5), "new"), PARENTS, folder, "r1") == {"leaf": 0, "child": 0, "parent": 0}
    assert staging.stage_tables(_batches(spark, range(3, 8), "new"), PARENTS, folder, "r2") == {"leaf": 3, "child": 3, "parent": 0}
    assert _keys(spark, folder, "child", "c") == list(range(100, 108)) and _keys(spark, folder, "parent", "p") == [0, 1, 2]
    values = {r.c: (r.v, r.run_key) for r in staging.read_table(spark, folder, "child").collect()}
    assert values[104] == ("v4", "r1") and values[105] == ("v5new", "r2")  # what is stored stays
    assert [r.c for r in staging.read_table(spark, folder, "child", upto=1).orderBy("c").collect()] == list(range(100, 105))
    with pytest.raises(ValueError):
        staging.stage_tables(_batches(spark, [1]), PARENTS, folder, "../x")


def test_crash_between_tables_leaves_nothing(spark, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}/s"
    monkeypatch.setattr(staging, "_publish", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        staging.stage_tables(_batches(spark, range(5)), PARENTS, folder, "r1")
    monkeypatch.undo()
    assert _keys(spark, folder, "child", "c") == [] and list((tmp_path / "s" / "child").iterdir())
    assert staging.stage_tables(_batches(spark, range(5)), PARENTS, folder, "r1")["child"] == 5
    assert _keys(spark, folder, "child", "c") == list(range(100, 105))


def test_unknown_parents_are_refused(spark, tmp_path):
    folder = f"file://{tmp_path}/s"
    bad = _batches(spark, range(4))
    bad["parent"] = (bad["parent"][0].where(F.col("p") != 2), "p")
    with pytest.raises(ValueError, match="parent does not hold"):
        staging.stage_tables(bad, PARENTS, folder, "r1")
    assert staging.commits(spark, folder) == []


def test_two_writers(spark, tmp_path, monkeypatch):
    """The second writer commits between the first one's reading and publishing; its keys stay single."""
    folder, publish, raced = f"file://{tmp_path}/s", staging._publish, []

    def late(*args):
        if not raced:
            raced.append(True)
            assert staging.stage_tables(_batches(spark, range(2, 7), "second"), PARENTS, folder, "second")["child"] == 5
        return publish(*args)

    monkeypatch.setattr(staging, "_publish", late)
    assert staging.stage_tables(_batches(spark, range(5), "first"), PARENTS, folder, "first") == {"leaf": 2, "child": 2, "parent": 0}
    assert [(c["number"], c["run_key"]) for c in staging.commits(spark, folder)] == [(1, "second"), (2, "first")]
    assert _keys(spark, folder, "child", "c") == list(range(100, 107)) and _keys(spark, folder, "parent", "p") == [0, 1, 2]
    assert not publish(spark, folder, {"number": 2, "run_key": "x", "attempt": "y", "rows": {}})  # a number is given once
    assert len(staging.commits(spark, folder)) == 2
