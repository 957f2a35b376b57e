"""Lexical plans by the rules, and tables of questions."""

import pytest
from pyspark.sql import functions as F
from veristrata.plans import lexical, question_tables
from veristrata.plans.algebra import Refused
from veristrata.plans.language import Entry


def _terms(question, *labels):
    return {g.identifier or " ".join(g.terms) for g in lexical.draft_plan(question, labels).groups}


def test_rejected_matches_block_no_others():
    assert _terms("Show Circoviridae loci") == {"circoviridae"}
    assert _terms("List Parvoviridae genes in birds") == {"parvoviridae"}
    assert _terms("Retained Filoviridae regions of bats") == {"filoviridae"}
    assert _terms("Which sales of v2 and DNA in Picornavirales?") == {"picornavirales"}


def test_overlaps_go_to_the_first_priority_then_the_longest():
    assert _terms("Homo sapiens and AB_12345.2 near X. laevis") == {"homo sapiens", "AB_12345.2", "laevis"}
    assert _terms("see 10.1000/AB12345, ABC12-x") == {"10.1000/ab12345", "abc12 x"}


def test_given_names():
    assert _terms("what is erin thnt?", "erin  thnt ") == {"erin thnt"}
    assert _terms("hosts of the GCF_000001405.2 set", "the gcf_000001405.2 set") == {"GCF_000001405.2"}  # names inside a given name count
    draft = lexical.draft_plan("the DNA version 3 of Homo sapiens", ("dna version 3",))
    assert draft.warnings == ("entity_label_has_no_specific_entity",) and [g.terms for g in draft.groups] == [("homo", "sapiens")]
    for labels, code in (([" "], "invalid_entity_label"), (["x" * 257], "entity_label_too_long"), (["absent"], "entity_label_not_in_question"), (["red"] * 33, "too_many_entity_labels")):
        assert lexical.draft_plan("red and green", labels).warnings == (code,)


def test_bounds_refuse_the_whole_plan():
    many = " ".join(f"{chr(65 + i)}{chr(97 + i)}xidae" for i in range(9))
    assert lexical.draft_plan(many).warnings == ("too_many_query_groups",) and not lexical.draft_plan(many).groups
    with pytest.raises(Refused) as e:
        lexical.question_plan("ABC-" + "-".join(f"d{i}" for i in range(9)))
    assert e.value.code == "too_many_group_terms"


def test_separators_and_brackets():
    objects = lexical.question_objects("Homo sapiens (a, b) at 33.3 or Mus musculus；age of 10.1000/and,x")
    assert [[g.identifier or g.terms for g in o["groups"]] for o in objects] == [[("homo", "sapiens")], [("mus", "musculus")], ["10.1000/and,x"]]
    assert objects[0]["context"] == ["33.3", "b"] and objects[2]["context"] == ["age"]
    for bad in ("Homo sapiens (a]", "Homo sapiens )"):
        with pytest.raises(Refused):
            lexical.question_objects(bad)


def test_tables_of_questions(spark):
    rows = [(1, "Show Circoviridae loci"), (2, None), (3, "Homo sapiens (a, b"), (4, "List loci in this release"), (5, "Count detection calls assigned to source lineage Mars exactly")]
    df = spark.createDataFrame(rows, "id long, q string")
    plans = {r.id: (r.status, r.groups, r.warnings) for r in question_tables.plan_questions(df, "q").collect()}
    assert plans[1] == ("ready", ["entity:circoviridae"], []) and plans[2] == ("rejected", [], ["empty_question"]) and len(plans) == 5
    assert {r.id: r.code for r in question_tables.object_questions(df, "q").collect()}[3] == "unbalanced_brackets"
    parsed = {r.id: (r.intent, r.code) for r in question_tables.parse_questions(df, "q", "F", [Entry("lineage", "m", "Mars", "m")]).collect()}
    assert parsed[4] == (None, "scope_not_explicit") and parsed[5] == ("aggregate", None)
    assert {r.id: r.route for r in question_tables.route_questions(df, "q").collect()}[2] == "refused"
    assert question_tables.plan_questions(df.limit(0), "q").count() == 0


def test_targets_of_questions(spark):
    from veristrata.operators import facts

    rows = [("a", "lineage", "x", "y"), ("a", "locus", "2", None), ("a", "locus", "10", None), ("a", "locus", "2", None), ("a", "method", "m", None), ("b", "assembly", "g", None)] + [("c", "locus", str(i), None) for i in range(65)] + [("d", "locus", str(i % 64), None) for i in range(200)]
    got = {r.q: (r.targets, r.status) for r in facts.anchor_targets(spark.createDataFrame(rows, "q string, kind string, k1 string, k2 string"), "q").collect()}
    assert got["a"] == (["locus:10", "locus:2", "lineage:x:y", "method:m"], "ready") and got["b"] == (["assembly:g"], "ready")
    assert got["c"] == ([], "too_many_anchor_targets") and len(got["d"][0]) == 64


def test_claims_against_their_quotes(spark):
    from veristrata.operators import ranking

    evidence = spark.createDataFrame([("d1", "12 copies in CM000001.1, as shown."), ("d2", None)], "document string, text string")
    claims = spark.createDataFrame([(1, "12 copies in cm000001.1"), (2, "13 copies, 1.5 or CM000001"), (3, "none [D1]"), (4, "plain"), (5, None), (6, "12 of CM000001.10")], "claim_id long, claim string")
    quotes = spark.createDataFrame([(1, "d1", "12 copies in CM000001.1"), (2, "d1", "12 copies"), (2, "d9", "x"), (3, "d2", "none"), (6, "d1", "CM000001.1, as"), (6, "d1", "12 copies")], "claim_id long, document string, quote string")
    got = {r.claim_id: r.faults for r in ranking.claim_provenance(claims, quotes, evidence).collect()}
    assert got == {1: [], 2: ["unknown_citation:d9", "unsupported_value:1.5", "unsupported_value:13", "unsupported_value:CM000001"], 3: ["quote_not_contained:d2", "citation_marker"], 4: [], 5: [], 6: ["unsupported_value:CM000001.10"]}


def test_quotes_of_every_length(spark, monkeypatch):
    from veristrata.operators import ranking

    monkeypatch.setattr(ranking, "PATTERNS", 3)
    text = "alpha beta gamma delta epsilon zeta eta theta"
    words = text.split()
    quotes = [(n * 10 + k, " ".join(words[k : k + n])[1:-1]) for n in range(1, 9) for k in range(9 - n)] + [(900, ""), (901, "ta ga"), (902, "beta  gamma"), (903, None), (904, "a"), (905, "a")]
    docs = [(1, text), (2, "xbeta gamma delta"), (3, None), (4, ""), (5, text[3:-3] + "\n" + text)]
    made = ranking.quote_containment(spark.createDataFrame(docs, "k long, t string"), spark.createDataFrame(quotes, "q long, s string"), "k", "t", "q", "s")
    want = {(q, k) for k, t in docs for q, s in quotes if t is not None and s is not None and s in t}
    assert {(r.q, r.k) for r in made.collect()} == want and made.count() == len(want)


def test_questions_of_one_file_are_dealt_to_all_tasks(spark):
    rows = spark.createDataFrame([(i, f"Explain the literature evidence for x{i}") for i in range(400)], "k long, t string").coalesce(1)
    found = question_tables.route_questions(rows, "t")
    assert found.count() == 400 and found.select(F.spark_partition_id()).distinct().count() > 1
