"""Joins and groupings whose tasks must not grow with the table: their plans, and their results on small rows."""

import hashlib
import re

import __spark_entry__
import pytest
from veristrata import session
from veristrata.operators import ingest, release
from veristrata.sources import scans


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_issue_rules_are_not_filters(spark):
    names = ("Assembly", "Contig", "VR", "HCVR", "Contig Length", "Start", "End", "Length", "VR Type")
    good = ("GCA_000000001.1", "CM000001.1", "vr1", "Yes", "3000", "0", "100", "100", "Integration")
    rows = spark.createDataFrame([good, ("x", *good[1:]), ("x", *good[1:4], "07", *good[5:])], ", ".join(f"`{n}` string" for n in names))
    found = ingest.issue_counts(ingest.normalize(rows, "s", "p"))
    assert {tuple(r) for r in found.collect()} == {("invalid_assembly_accession_version", 2), ("invalid_integer", 1)}
    assert not any("RLIKE" in line for line in _plan(found).splitlines() if "Filter" in line)


def test_line_marks_are_worked_out_once(spark):
    texts = ["t\n\na\nb\n \t\n\nc", "\n\n\na", "a\n", " \n\t", "", None, "x\n\n" * 300]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = scans.plain_block_lines(docs)
    rows = [tuple(r) for r in found.orderBy("doc_id", "block_index").collect()]
    head = [(0, 0, "title", "t", 1, 1), (0, 1, "paragraph", "a\nb", 3, 4), (0, 2, "paragraph", "c", 7, 7), (1, 0, "title", "a", 4, 4), (2, 0, "title", "a", 1, 1)]
    assert rows == head + [(6, i, "paragraph" if i else "title", "x", 2 * i + 1, 2 * i + 1) for i in range(300)]
    assert _plan(found).count("RLIKE") == 1


def test_keys_of_an_audit_are_worked_out_once(spark):
    names = ("Assembly", "Contig", "VR", "VR Type", "source_assessment", "outcome", "assembly_resolution", "contig_resolution", "stored_key", "locus_key", "record_key", "name")
    good, other, call = "locus:sha256:" + "a" * 64, "locus:sha256:" + "b" * 64, "source_record:sha256:" + "c" * 64
    first = ("a1", "c1", "vr1", "Integration", "source_high", "normalized_candidate", "exact", "exact", good, good, call, "n")
    rows = [first, first, (*first[:8], other, good, None, None), (*first[:8], None, good, None, ""), ("a2", None, None, None, "source_low", "quarantine", None, "unresolved", "LOCUS", None, "x", "m"), (None,) * 12]
    schema = ", ".join(f"`{n}` string" for n in names)
    want = dict.fromkeys(ingest.WORKSHEET_COUNTERS, 0) | {
        "source_records": 6, "source_high": 4, "source_low": 1, "normalized_candidate": 4, "quarantine": 1, "vr_type_integration": 4, "vr_type_other": 2,
        "assembly_resolution_exact": 4, "assembly_resolution_not_exact": 2, "contig_resolution_exact": 4, "contig_resolution_not_exact": 2,
        "missing_locus_key": 2, "missing_organism_name": 3, "invalid_call_key_format": 4, "invalid_locus_key_format": 1, "locus_key_preimage_error": 2, "locus_key_preimage_mismatch": 2,
        "assemblies": 2, "contigs": 1, "source_organism_names": 3, "call_key_values": 1, "call_key_extra_occurrences": 1, "locus_key_values": 1, "locus_key_extra_occurrences": 1,
    }
    assert list(ingest.worksheet_audit(spark.createDataFrame(rows, schema)).first().asDict().items()) == list(want.items())
    assert set(ingest.worksheet_audit(spark.createDataFrame([], schema)).first()) == {0}
    found = __spark_entry__.queries()["A11_worksheet_audit"](spark, "/root/testdata/sf0.001")
    assert _plan(found).count("sha2(") == 2  # one for each of the two keys


def test_assertions_meet_evidence_by_digests(spark):
    ids = {n: n * 400 for n in "abcde"}
    assertions = spark.createDataFrame([(ids["a"], 1, "A"), (ids["b"], 1, "B"), (ids["c"], 2, "A"), (ids["d"], 2, "B"), (ids["e"], 3, "A"), (None, 3, "B")], "assertion_id string, locus_id long, assertion_type string")
    evidence = spark.createDataFrame([(ids[n], "supports") for n in "aabcde"] + [(ids["d"], "contradicts"), (None, "supports")], "assertion_id string, relation string")
    found = release.public_assertions(assertions, evidence, ("A", "B"))
    assert [r.locus_id for r in found.collect()] == [1]
    assert "sha2(" in _plan(found)


def test_ranges_of_keys_are_sorted_by_their_own_tasks(spark):
    keys = [str(i * 7919 % 300_007) for i in range(3 * ingest.PIECE + 5)] + ["a\"b", "é", "", "0", "0"]
    found = ingest.key_set_digest(spark.createDataFrame([(k,) for k in [*keys, None]], "k string"), "k", limit=10)
    assert "Coalesce" not in _physical(found)
    want = "[" + ",".join('"' + k.replace('"', '\\"') + '"' for k in sorted(keys, key=str.encode)) + "]"
    assert tuple(found.first()) == (hashlib.sha256(want.encode()).hexdigest(), len(keys) + 1)


@pytest.mark.parametrize("name", ["F12_assertion_details", "F21_scoped_tables", "F10_locus_projection", "I2_projection_cardinality"])
def test_large_joins_are_dealt_by_rows(spark, name):
    found = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")
    dealt = [line for line in _physical(found).splitlines() if re.search(r"Exchange hashpartitioning\((locus_id|l_orderkey)#", line)]
    assert any("REPARTITION_BY_NUM" in line for line in dealt)  # the other side follows the dealt one
    assert session.tasks_for(spark.range(40 * session.ROWS_A_TASK + 1)) == 41


def test_covered_keys_are_grouped_once(spark):
    asked = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k long")
    held = spark.createDataFrame([(2,), (2,), (3,), (3,), (None,), (None,)], "k long")
    found = release.coverage_faults(asked, held, "k")
    assert sorted(map(tuple, found.collect()), key=str) == [(1, "missing"), (3, "unrequested"), (None, "missing"), (None, "unrequested")]
    assert "Join" not in _plan(found)
