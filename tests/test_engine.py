"""Operators on small fixtures: leaks, inflation, hierarchies, ingest rules, scans, sinks, metrics."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F
from veristrata.functions import keys, scalar
from veristrata.operators import facts as f
from veristrata.operators import ingest, metrics, ranking, release, taxonomy
from veristrata.plans.algebra import Plan, execute, total
from veristrata.sources import scans, sinks


@pytest.fixture(scope="module")
def catalog(spark):
    make = spark.createDataFrame
    nodes = make([("w", "World", "root"), ("r1", "R1", "region"), ("n1", "N1", "nation"), ("n2", "N2", "nation")], "node_id string, term_name string, rank string")
    edges = make([("r1", "w"), ("n1", "r1"), ("n2", "w")], "child_id string, parent_id string")
    return f.Facts(
        membership=make([("pub", i) for i in (1, 2, 3, 4)] + [("cand", 5)], "release string, locus_id long"),
        locus=make([(1, 10, "c1"), (2, 10, "c1"), (3, 20, "c1"), (4, 30, "c2"), (5, 10, "c9")], "locus_id long, group_id long, sequence_id string"),
        groups=make([(10, "A"), (20, "B"), (30, "C")], "group_id long, group_name string"),
        assignment=make([(10, "n1", "source"), (20, "n2", "source"), (30, "r1", "source"), (20, "n1", "host")], "group_id long, term_id string, role string"),
        term=nodes.withColumnRenamed("node_id", "term_id"),
        closure=taxonomy.closure(edges, nodes),
        assertion=make([(1, "X", "formal")] * 3 + [(3, "X", "formal"), (2, "X", "study"), (5, "X", "formal")], "locus_id long, category string, kind string"),
        call=make([(1, "k1", 1.0), (1, "k1", 1.0), (1, "k2", 2.0), (4, "k3", 1.0), (5, "k4", 1.0)], "locus_id long, call_key string, score double"),
    )


def _ids(df, col="locus_id"):
    return sorted(r[col] for r in df.select(col).collect())


def test_filters_never_leak_or_inflate(catalog):
    assert _ids(f.matched_loci(catalog, "pub")) == [1, 2, 3, 4]
    assert _ids(f.matched_loci(catalog, "pub", (f.CategoryFilter("X"),))) == [1, 3]
    assert _ids(f.matched_loci(catalog, "pub", (f.CategoryFilter("X", "study"),))) == [2]
    assert _ids(f.matched_loci(catalog, "pub", (f.LineageFilter("r1"),))) == [4]
    assert _ids(f.matched_loci(catalog, "pub", (f.LineageFilter("r1", True),))) == [1, 2, 4]
    assert _ids(f.matched_loci(catalog, "pub", (f.LineageFilter("n1"),))) == [1, 2]  # the host role does not count
    assert _ids(f.matched_loci(catalog, "pub", (f.LineageFilter("r1", True), f.CategoryFilter("X")))) == [1]
    assert _ids(f.matched_loci(catalog, "none")) == []
    with pytest.raises(TypeError):
        f.matched_loci(catalog, "pub", ("x",))


@pytest.mark.parametrize(("name", "value"), list(zip(f.METRICS, (4, 3, 3, 3, 3))))
def test_metrics(catalog, name, value):
    assert execute(Plan("aggregate", "pub", metric=name), catalog).first().value == value
    assert execute(Plan("aggregate", "none", metric=name), catalog).first().value == 0


def test_lists_and_pages(catalog):
    plan = Plan("list_loci", "pub", limit=2)
    first = execute(plan, catalog).collect()
    assert [r.locus_id for r in first] == [1, 2, 3] and total(plan, catalog).first().total == 4
    rest = execute(Plan("list_loci", "pub", limit=2, after=(first[1].group_id, first[1].locus_id)), catalog).collect()
    assert [r.locus_id for r in rest] == [3, 4]
    assert [(r.group_id, r.loci) for r in execute(Plan("list_assemblies", "pub"), catalog).collect()] == [(10, 2), (20, 1), (30, 1)]
    assert {(r.term_id, r.groups, r.loci) for r in execute(Plan("list_source_taxa", "pub"), catalog).collect()} == {("n1", 1, 2), ("n2", 1, 1), ("r1", 1, 1)}
    assert f.assignment_faults(catalog, f.matched_loci(catalog, "pub")).count() == 0
    assert f.assertion_details(catalog, f.matched_loci(catalog, "pub")).count() == 3


def test_hierarchy(spark, catalog):
    assert {(r.ancestor_id, r.depth) for r in catalog.closure.where("descendant_id = 'n1'").collect()} == {("n1", 0), ("r1", 1), ("w", 2)}
    loop = spark.createDataFrame([("a", "b"), ("b", "a")], "child_id string, parent_id string")
    with pytest.raises(ValueError):
        taxonomy.closure(loop, spark.createDataFrame([("a",), ("b",)], "node_id string"), 5)
    ids, merged = spark.createDataFrame([(1,), (2,), (3,)], "id long"), spark.createDataFrame([(1, 2), (2, 4)], "old_id long, new_id long")
    rows = taxonomy.resolve_merged(ids, merged, spark.createDataFrame([(3,)], "id long")).collect()
    assert {(r.id, r.resolved_id, r.status) for r in rows} == {(1, 4, "merged"), (2, 4, "merged"), (3, 3, "deleted")}


def _sheet_row(**change):
    row = dict.fromkeys(ingest.HEADER, "") | {"Assembly": "GCA_000000001.1", "Contig": "CM000001.1", "VR": "vr1", "HCVR": "Yes", "Contig Length": "1000", "Start": "0", "End": "1000", "Length": "1000", "VR Type": "Integration"}
    return tuple((row | change)[h] for h in ingest.HEADER)


CASES = [
    ({}, []),
    ({"End": "1001", "Length": "1001"}, ["interval_out_of_bounds"]),
    ({"Assembly": "GCA_1"}, ["invalid_assembly_accession_version"]),
    ({"Contig": "CM000001"}, ["invalid_sequence_accession_version"]),
    ({"VR": "vr0"}, ["invalid_vr_token"]),
    ({"Start": "1..5"}, ["multipart_interval"]),
    ({"Start": "join(1)"}, ["multipart_interval"]),
    ({"Start": "01"}, ["invalid_integer"]),
    ({"Start": "9", "End": "9", "Length": "0"}, ["invalid_interval"]),
    ({"Length": "5"}, ["length_mismatch"]),
    ({"Contig Length": "0"}, ["invalid_contig_length", "interval_out_of_bounds"]),
    ({"VR Type": "Viral contig"}, ["viral_contig_policy_quarantine"]),
    ({"VR Type": "Other"}, ["unsupported_vr_type"]),
]


def test_normalization(spark):
    rows = spark.createDataFrame([(i, *_sheet_row(**c)) for i, (c, _) in enumerate(CASES)], ["i", *ingest.HEADER])
    out = {r.i: r for r in ingest.normalize(rows, "s", "p").collect()}
    for i, (_, want) in enumerate(CASES):
        assert list(out[i].issues) == want and out[i].outcome == ("quarantine" if want else "normalized_candidate")
    assert out[0].locus_key == "locus:sha256:" + keys.digest({"source_snapshot_key": "s", "assembly_accession_version": "GCA_000000001.1", "contig_accession_version": "CM000001.1", "native_vr_token": "vr1", "identity_policy_version": "p"})
    assert out[2].locus_key is None


def test_authority(spark):
    index = ingest.authority_index(spark.createDataFrame([("GCA_000000001.1", "CM000001.1", "NC_000001.1", 1000), ("GCA_000000001.1", "CM000002.1", None, 7)], "assembly_accession string, genbank_accession string, refseq_accession string, length long"))
    rows = spark.createDataFrame([(i, *_sheet_row(**c)) for i, c in enumerate([{}, {"Contig": "NC_000001.1", "Contig Length": "999"}, {"Contig": "CM000009.1"}, {"Assembly": "GCA_000000002.1"}, {"Contig Length": "x"}])], ["i", *ingest.HEADER])
    out = {r.i: (r.assembly_resolution, r.contig_resolution) for r in ingest.resolve(rows, index).collect()}
    assert out == {0: ("exact", "exact"), 1: ("exact", "length_mismatch"), 2: ("exact", "unresolved"), 3: ("unresolved", "unresolved"), 4: ("exact", "length_unverified")}


def test_scalar_rules(spark):
    row = spark.range(1).select(
        scalar.chunk_starts(F.lit(384)).alias("a"), scalar.chunk_starts(F.lit(385)).alias("b"), scalar.chunk_starts(F.lit(704)).alias("c"), scalar.chunk_starts(F.lit(705)).alias("d"),
        scalar.ratio(F.lit(1), F.lit(3)).alias("r"), scalar.ratio(F.lit(1), F.lit(0)).alias("z"), scalar.ratio_reason(F.lit(0), "none").alias("why"),
        scalar.rrf_score(F.lit(1), F.lit(None).cast("int"), F.lit(3)).alias("s"), scalar.longest_run(F.lit("ACNNGNNNT"), "[^ACGT]").alias("n"), scalar.half_up(F.lit(0.0000005)).alias("h"),
        scalar.clean_source(F.lit("a \r\n\n\n\nb\t\n")).alias("t"), scalar.clean_source(F.lit("a\x07")).alias("bad"), keys.is_release_key(F.lit("x-20240230-v1")).alias("k"),
    ).first()
    assert (row.a, row.b, row.c, row.d) == ([0], [0, 320], [0, 320], [0, 320, 640])
    assert row.r == 0.333333333333 and row.z is None and row.why == "none" and row.s == round(1 / 61 + 1 / 63, 12) and row.n == 3
    assert str(row.h) == "0.000001" and row.t == "a\n\nb\n" and row.bad is None and row.k is False
    assert keys.digest({"b": "é", "a": 1}) == keys.digest({"a": 1, "b": "é"})
    with pytest.raises(ValueError):
        keys.canonical_text({"\u00e9": 1, "e\u0301": 2})
    assert keys.manifest_digest({"a": 1, "manifest_sha256": "x"}) == keys.digest({"a": 1})


def _workbook(rows):
    cell = lambda i, v: f'<c r="{chr(65 + i)}{{n}}" t="inlineStr"><is><t>{v}</t></is></c>' if i else f'<c r="A{{n}}" t="s"><v>{v}</v></c>'
    shared = [r[0] for r in rows]
    body = "".join(f'<row r="{n}">' + "".join(cell(i, k if i == 0 else v).format(n=n) for i, v in enumerate(r) if v != "") + "</row>" for n, (k, r) in enumerate(enumerate(rows), 1))
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="Data" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}">' + "".join(f"<si><t>{s}</t></si>" for s in shared) + "</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


def test_worksheet_rows_leave_the_parse_tree():
    import tracemalloc

    def peak(n):
        content = _workbook([("H1", "H2", "H3"), *[("x", f"v{i}", "z" * 20) for i in range(n)]])
        tracemalloc.start()
        rows = sum(1 for _ in scans.worksheet_rows(content, ("Data",), ("H1", "H2", "H3")))
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert rows == n
        return most - len(content)

    small, large = peak(1_000), peak(10_000)
    assert large < small + 150 * 9_000  # the shared strings grow, one short text a row; the rows themselves do not


def test_worksheet(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(_workbook([("H1", "H2", "H3"), ("x", "y", "z"), ("p", "", "q")]))
    rows = scans.scan_worksheet(spark, str(tmp_path), ("Data", "Sheet"), ("H1", "H2", "H3")).orderBy("source_row").collect()
    assert [tuple(r) for r in rows] == [(2, "x", "y", "z"), (3, "p", "", "q")]
    content = (tmp_path / "a.xlsx").read_bytes()
    with pytest.raises(ValueError):
        list(scans.worksheet_rows(content, ("Data",), ("H1", "H2", "other")))
    with pytest.raises(ValueError):
        list(scans.worksheet_rows(content, ("None",), ("H1", "H2", "H3")))


def test_articles(spark):
    md = "# Title\n\nIntro text\nmore\n\n## Part\n- one\n- two\n\n| a | b |\n|---|---|\n\n```\n# code\n```\n### Deep\nend"
    blocks = scans.markdown_blocks(md)
    assert [(b[1], b[3]) for b in blocks] == [("title", "Title"), ("paragraph", "Intro text\nmore"), ("heading", "Part"), ("list_item", "one"), ("list_item", "two"), ("table", "| a | b |\n|---|---|"), ("code", "```\n# code\n```"), ("heading", "Deep"), ("paragraph", "end")]
    assert blocks[-1][2] == ["Title", "Part", "Deep"] and blocks[1][4:] == (3, 4)
    jats = "<article><front><article-title>T</article-title><abstract><p>A</p></abstract></front><body><sec><title>S</title><p>P</p><sec><title>U</title><list><list-item><p>I</p></list-item></list></sec><fig><caption><p>C</p></caption></fig></sec></body></article>"
    assert [(b[1], b[2], b[3]) for b in scans.jats_blocks(jats)] == [("title", [], "T"), ("abstract", ["Abstract"], "A"), ("heading", ["S"], "S"), ("paragraph", ["S"], "P"), ("heading", ["S", "U"], "U"), ("list_item", ["S", "U"], "I"), ("figure_caption", ["S"], "C")]
    with pytest.raises(ValueError):
        scans.jats_blocks("<!DOCTYPE x><article/>")
    docs = spark.createDataFrame([(1, md), (2, None)], "id long, text string")
    assert scans.parse_blocks(docs, "markdown").count() == len(blocks)
    assert [r.text for r in scans.plain_blocks(spark.createDataFrame([(1, "t\n\na\nb\n \n\nc")], "id long, text string")).orderBy("block_index").collect()] == ["t", "a\nb", "c"]


def test_dumps_and_sinks(spark, tmp_path):
    (tmp_path / "nodes.dmp").write_text("1\t|\t1\t|\tno rank\t|\n2\t|\t1\t|\tphylum\t|\n")
    assert [tuple(r) for r in scans.scan_taxdump(spark, str(tmp_path / "nodes.dmp"), "nodes").collect()] == [("1", "1", "no rank"), ("2", "1", "phylum")]
    edges = scans.rank_edges(spark.createDataFrame([("R", "K", None), ("R", "", "P")], "a string, b string, c string"), ["a", "b", "c"]).collect()
    assert {(r["rank"], r["name"], r["parent_name"]) for r in edges} == {("a", "R", None), ("b", "K", "R"), ("c", "P", "R")}
    rows = spark.createDataFrame([(i, f"v{i}") for i in range(6)], "k long, v string")
    folder = f"file://{tmp_path}/staged"
    assert sinks.stage(rows.where("k < 4"), folder, "k", "r1") == 4 and sinks.stage(rows, folder, "k", "r2") == 2 and sinks.stage(rows, folder, "k", "r2") == 0
    assert sinks.markdown_table(spark.createDataFrame([("a|b", None)], "x string, y string")) == "| x | y |\n| --- | --- |\n| a\\|b |  |"
    vectors = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [0.0, 1.0])], "id string, v array<double>")
    sinks.write_vectors(vectors, f"{tmp_path}/vec", "id", "v", {"dim": 2})
    back, meta = sinks.read_vectors(spark, f"{tmp_path}/vec")
    assert [r.key for r in back.orderBy("key").collect()] == ["a", "b"] and meta == {"dim": 2}
    sinks.report_jsonl(rows, f"{tmp_path}/json", ["k"])
    sinks.report_csv(rows, f"{tmp_path}/csv", ["k"])
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").count() == 6
    sinks.write_tables({"t": rows}, f"{tmp_path}/tables")
    with pytest.raises(Exception):  # noqa: B017  an existing table is never overwritten
        sinks.write_tables({"t": rows}, f"{tmp_path}/tables")
    (tmp_path / "x.jsonl").write_text('{"k": 1}\n')
    assert scans.scan_jsonl(spark, str(tmp_path / "x.jsonl"), "k long").first().k == 1
    import hashlib

    raw = (tmp_path / "x.jsonl").read_bytes()
    assert scans.verify_bytes(spark, str(tmp_path / "x.jsonl"), hashlib.sha256(raw).hexdigest(), len(raw)).first().verified
    assert scans.scan_raw(spark, str(tmp_path / "x.jsonl")).first().text == raw.decode()


def test_stream_stages_once(spark, tmp_path):
    from veristrata.streaming.incremental import stage_files

    (tmp_path / "in").mkdir()
    for n in range(2):
        (tmp_path / "in" / f"{n}.json").write_text("".join(json.dumps({"k": k}) + "\n" for k in range(n, n + 3)))
        stage_files(spark, str(tmp_path / "in"), "k long", f"file://{tmp_path}/out", "k", str(tmp_path / "check")).awaitTermination()
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 1, 2, 3]


def test_ranking(spark):
    rows = spark.createDataFrame([(1, "a", "x", 1), (1, "b", "x", 2), (1, "b", "y", 1), (1, "c", "y", 2), (1, "a", "x", 5)], "q int, k string, branch string, rank int")
    fused = ranking.fuse(rows, ("x", "y"), ["q"], "k").orderBy("rank").collect()
    assert [(r.k, r.n_branches, r.min_rank) for r in fused] == [("b", 2, 1), ("a", 1, 1), ("c", 1, 2)]
    list_ = spark.createDataFrame([(1, k, i) for i, k in enumerate("abcd", 1)], "q int, k string, rank int")
    tier = ranking.tiered(list_.where("k in ('c', 'd')"), list_, ["q"], "k", 3).orderBy("rank").collect()
    assert [r.k for r in tier] == ["c", "d", "a"]
    posts = ranking.postings(spark.createDataFrame([(1, "Red fox", "the red"), (2, "", "red fox red")], "id int, t string, b string"), "id", {"A": "t", "D": "b"})
    assert [r.id for r in ranking.lexical_top(posts, ("red", "fox"), "id").orderBy("rank").collect()] == [1, 2]
    names = spark.createDataFrame([("Abc",), ("xyz",), ("zabc",)], "n string").select("n", scalar.similarity("abc")("n").alias("s"), scalar.normal_name("n").alias("m")).collect()
    assert {r.n: r.s.kind for r in names} == {"Abc": 2, "xyz": 0, "zabc": 1} and names[0].m == "abc"


def test_metrics_with_undefined_ratios(spark):
    rows = spark.createDataFrame([("q", "c", [["a", "b"], ["z"]], ["x", "b", "z"]), ("e", "c", [], ["x"])], "question_id string, category string, evidence_groups array<array<string>>, returned array<string>")
    out = {r.question_id: r for r in metrics.question_metrics(rows).collect()}
    assert (out["q"].recall_at_1, out["q"].recall_at_3, out["q"].mrr_at_10) == (0.0, 1.0, 0.5) and out["e"].recall_at_5 is None and out["e"].ndcg_at_10 is None
    assert out["q"].ndcg_at_10 == pytest.approx((1 / 1.5849625007 + 0.5) / (1 + 1 / 1.5849625007), abs=1e-9)
    none = metrics.association_scores(spark.createDataFrame([], "k string"), spark.createDataFrame([], "k string"), "k").first()
    assert (none.precision, none.precision_reason, none.recall_reason) == (None, "no_predictions", "no_gold")
    cost = spark.createDataFrame([("s", 1, 1, 1, 5), ("s", 2, 1, 1, None), ("t", 3, 1, 1, 4)], "system string, latency int, tokens int, rss int, cost int")
    assert {r.system: r.cost for r in metrics.efficiency(cost, ["system"]).collect()} == {"s": None, "t": 4}


def test_release_rules(spark):
    rows = spark.createDataFrame([(i, f"v{i % 3}") for i in range(20)], "k int, v string")
    assert release.table_digest(rows, "t").first() == release.table_digest(rows.orderBy(F.desc("k")).repartition(5), "t").first()
    assert release.table_digest(rows, "t").first().digest != release.table_digest(rows.unionByName(rows.limit(1)), "t").first().digest
    assert release.differences(rows, rows.where("k > 0")).first().side == "missing"
    hits = release.rule_violations(rows, "k", {"late": F.col("k") > 18, "v0": F.col("v") == "v0"}).collect()
    assert {(r.k, r.code) for r in hits if r.code == "late"} == {(19, "late")}
    assert release.orphans(rows, rows.where("k < 18"), ["k", "v"]).count() == 2
    assert release.coverage_faults(rows, rows.where("k > 0"), "k").first().fault == "missing"
