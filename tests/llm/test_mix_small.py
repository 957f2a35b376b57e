"""A source's share of the mix must not depend on the size of the others."""

import pytest
from veristrata.llm import mixing


@pytest.mark.parametrize("size", [1, 7, 500, 2000, 20000])
def test_tiny_source_beside_huge_ones(spark, size):
    step = max(1, size // 5)
    rows = [(i, "w " * min(step, size - at), "tiny") for i, at in enumerate(range(0, size, step))]
    rows += [(1000 + i, "w " * 40_000, f"huge{i % 3}") for i in range(75)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs, blocks=120).collect()  # a block of about 25,000 words, as beside 5 billion
    tiny = [g for g in got if g.source_size == size]
    assert sum(g.taken for g in tiny) == round(tiny[0].target) == 2 * size  # the filling stops at twice its size
    assert all(0 <= g.taken <= 2 * g.size for g in got)
    assert {g.doc_id for g in tiny} <= {r.doc_id for r in mixing.repeat_by_mix(docs).collect()}


def test_head_of_the_stream_makes_up_the_rest(spark):
    rows = [(i, "w " * 30, "b") for i in range(40)] + [(1000 + i, "w " * 3000, "a") for i in range(40)]
    rows += [(2000 + i, "w " * 30, "c") for i in range(40)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), blocks=40).collect()
    for first in (0, 1000, 2000):
        own = [g for g in got if first <= g.doc_id < first + 40]
        assert sum(g.taken for g in own) == round(own[0].target)


def _sources(got):
    sums = {}
    for g in got:
        own = sums.setdefault(g.source_size, [g.target, 0, 0])
        own[1] += g.taken
        own[2] += g.slots
    return sums


def test_the_schedule_decides(spark, monkeypatch):
    """Without the golden ratio's points a source has the few settled slots only; with them its slots are even."""
    docs = spark.createDataFrame([(i, "w " * (40 + i % 7), f"s{min(i % 9, 4)}") for i in range(900)], "doc_id long, text string, source string")
    good = mixing.mix(docs).collect()
    assert all(taken == round(target) for target, taken, _ in _sources(good).values())
    slots = 1 + max(g.first_slot for g in good)
    first = sorted(g.first_slot for g in good if g.source_size == max(_sources(good)))
    assert first[0] < 0.01 * slots and first[-1] > 0.4 * slots  # a source's documents are spread over the schedule
    monkeypatch.setattr(mixing, "GOLDEN", 0.0)
    bad = _sources(mixing.mix(docs).collect())
    assert sum(taken < 0.1 * target for target, taken, _ in bad.values()) == len(bad) - 1


@pytest.mark.parametrize("cells", [(2500, 1000, 500), (1, 7, 2, 90_000, 3), (333, 334, 333)])
def test_discrepancy_is_within_what_is_settled(spark, cells):
    rows = [(i, sum(cells[:i]), c) for i, c in enumerate(cells)]
    given = mixing.schedule(spark, spark.createDataFrame(rows, "sid long, first_cell long, cells long"), sum(cells)).groupBy("sid").count()
    found = {r["sid"]: r["count"] for r in given.collect()}
    assert all(abs(found.get(i, 0) - c) <= mixing.SETTLED for i, c in enumerate(cells)) and sum(found.values()) == sum(cells)
