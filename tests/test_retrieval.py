"""Full text, question plans, composed retrieval, fixed commands, providers, loaders and staging."""

import hashlib
import io
import json
import tarfile
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F
from veristrata.functions import providers
from veristrata.operators import facts as f
from veristrata.operators import ingest, metrics, ranking, release, taxonomy
from veristrata.operators.facts import CategoryFilter
from veristrata.plans import lexical
from veristrata.plans.algebra import Refused
from veristrata.plans.commands import compile_commands
from veristrata.plans.language import Entry, Resolver, parse
from veristrata.sources import scans, sinks

RESOLVER = Resolver([Entry("category", "v1", "Promo", "PROMO"), Entry("group", "G1.1", "First", 1), Entry("locus", "L1", "L1", 11), Entry("locus", "L2", "L2", 12)])


def test_descendants_of_a_viral_lineage_are_kept():
    below = parse("list loci with formal viral lineage Promo including descendants", "F", RESOLVER)
    exact = parse("list loci with formal viral lineage Promo exactly", "F", RESOLVER)
    assert below.filters == (CategoryFilter("PROMO", "formal", True),) and exact.filters == (CategoryFilter("PROMO", "formal"),)
    assert below.identity() != exact.identity()


def test_descending_needs_a_closure(spark):
    make = spark.createDataFrame
    nodes = make([("all",), ("X",), ("Y",)], "node_id string")
    closed = taxonomy.closure(make([("X", "all"), ("Y", "X")], "child_id string, parent_id string"), nodes)
    own = f.Facts(make([("p", i) for i in range(4)], "release string, locus_id long"), make([(i, 1, "c") for i in range(4)], "locus_id long, group_id long, sequence_id string"), None, None, None, None, make([(0, "X", "formal"), (1, "Y", "formal"), (2, "Y", "study"), (3, "Z", "formal")], "locus_id long, category string, kind string"), None, closed)
    ids = lambda *flt: sorted(r.locus_id for r in f.matched_loci(own, "p", flt).collect())
    assert ids(CategoryFilter("X", "formal", True)) == [0, 1] and ids(CategoryFilter("X")) == [0] and ids(CategoryFilter("all", "study", True)) == [2]
    with pytest.raises(ValueError):
        f.matched_loci(f.Facts(own.membership, own.locus, None, None, None, None, own.assertion, None), "p", (CategoryFilter("X", "formal", True),))
    base = f.matched_loci(own, "p")
    details = base.where("locus_id > 0").unionByName(base.where("locus_id = 1"))
    assert {tuple(r) for r in f.cardinality_faults(base, details).collect()} == {(0, 1, 0), (1, 1, 2)}
    anchors = f.anchor_documents(make([("a", "d2"), ("a", "d1"), ("a", "d1")], "anchor_key string, document_key string"), make([("a",), ("b",)], "anchor_key string"))
    assert {r.anchor_key: r.documents for r in anchors.collect()} == {"a": ["d1", "d2"], "b": []}


def test_ordinary_questions_have_plans():
    groups, _ = lexical.question_plan("Which endogenous retroviruses are reported in Mus musculus genomes and how were they dated?")
    assert groups == [lexical.Group("entity", ("mus", "musculus"))]
    groups, _ = lexical.question_plan("How old are inserted copies?")
    assert groups == [lexical.Group("topic", ("copies", "inserted", "old"))]
    assert lexical.question_plan("What does DNA say on ABC‑1 here?")[0] == [lexical.Group("entity", ("abc",))]
    for text, code in (("", "empty_question"), ("a" * 9000, "question_too_long"), ("Which of the?", "no_usable_terms"), ("red green blue black white grey pink", "too_many_topic_terms"), ("a\x01b", "unsupported_control_character")):
        with pytest.raises(Refused) as e:
            lexical.question_plan(text)
        assert e.value.code == code
    with pytest.raises(Refused) as e:
        lexical.question_plan("nothing here", ("absent",))
    assert e.value.code == "entity_label_not_in_question"


def test_objects_by_clause():
    found = lexical.question_objects("Show the position of Homo sapiens copies, and the length in GCA_000001405.15 (a, b)")
    assert [[g.identifier or g.terms for g in o["groups"]] for o in found] == [[("homo", "sapiens")], ["GCA_000001405.15"]]
    assert found[0]["context"] == ["copies", "position"] and "length" in found[1]["context"]
    one = lexical.question_objects("position of Homo sapiens copies, their length")
    assert len(one) == 1 and one[0]["context"] == ["copies", "length", "position"]
    with pytest.raises(Refused):
        lexical.question_objects("Homo sapiens (open")


def test_doi_and_acronym_grammar():
    assert [s.text for s in lexical.entities("see 10.1000/ab，then XY−9 ok")] == ["10.1000/ab", "XY−9"]


def _density(words, terms):
    """All minimal stretches with every term, by definition."""
    hits = [(p, w) for p, w in enumerate(words) if w in terms]
    spans = {(a, z) for a, _ in hits for z, _ in hits if a <= z and {w for p, w in hits if a <= p <= z} == set(terms)}
    s = 0.0
    for a, z in (x for x in spans if not any(y != x and x[0] <= y[0] and y[1] <= x[1] for y in spans)):
        m = sum(a <= p <= z for p, _ in hits)
        s += 0.1 / (1 + (z - a) - (m - 1))
    return s / (s + 1)


def test_cover_density_by_definition(spark):
    texts = ["a b", "a x b y a b b x x a", "a a a", "b x x x x x a c", "", None, "c b a c a b"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, t string").select("k", ranking.lexemes(F.col("t")).alias("w"))
    for terms in (("a", "b"), ("a", "b", "c"), ("a",)):
        got = {r.k: r.s for r in rows.select("k", ranking.cover_density([(F.col("w"), 0.1)], terms).alias("s")).collect()}
        for k, t in enumerate(texts):
            assert got[k] == pytest.approx(_density((t or "").split(), terms))
    titled = rows.limit(1).select(ranking.cover_density([(F.array(F.lit("a")), 1.0), (F.array(F.lit("b")), 0.1)], ("a", "b")).alias("s")).first().s
    assert titled == pytest.approx((2 / 11) / (2 / 11 + 1))


def test_search_filter(spark):
    rows = spark.createDataFrame([(0, "red big fox"), (1, "red fox big"), (2, "red big fox dog"), (3, "a cat"), (4, None)], "k long, t string").select("k", ranking.lexemes(F.col("t")).alias("w"))
    asked = lexical.search_query('red "big fox" -dog or cat')
    assert sorted(r.k for r in rows.where(ranking.search_filter(F.col("w"), asked.alternatives)).collect()) == [0, 3]
    assert rows.where(ranking.search_filter(F.col("w"), [])).count() == 0


def test_planned_identifiers_are_exact(spark):
    rows = spark.createDataFrame([(1, "d1", "GCA_000001405.1 is here", None), (2, "d1", "GCA_000001405.15 and homo sapiens", None), (3, "d2", "homo sapiens", "10.1/X"), (4, "d3", "nothing", "10.1/x")], "k long, d string, t string, doi string")
    objects = lexical.question_objects("Homo sapiens GCA_000001405.1 position")
    assert [r.k for r in ranking.planned_candidates(rows, "d", "k", "t", objects).collect()] == [1]
    doi = [{"groups": [lexical.Group("doi", (), "10.1/x")], "context": ["sapiens"]}]
    assert [(r.k, r.context_score) for r in ranking.planned_candidates(rows, "d", "k", "t", doi).collect()] == [(3, 1), (4, 0)]


def test_batches_beyond_the_bound_are_not_broadcast(spark, monkeypatch):
    rows = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(30)], "k long, v array<double>")
    asked = rows.select(F.col("k").alias("query_id"), F.col("v").alias("q"))
    small = sorted(map(tuple, ranking.dense_batch(asked, rows, "k", 3).collect()))
    monkeypatch.setattr(ranking, "QUESTIONS", 5)
    assert sorted(map(tuple, ranking.dense_batch(asked, rows, "k", 3).collect())) == small and len(small) == 90


def test_commands():
    commands = {"REC-*": ["Show locus {A}", "Show locus {B}"], "REC-1": ["List loci in assembly {G}"], "BAD": ["List loci in assembly {X}"]}
    run = lambda q: compile_commands(commands, {"A": "L1", "B": "L2", "G": "G1.1"}, q, "F", RESOLVER)
    assert [p.intent for p in run("REC-7")] == ["locus_detail"] * 2 and [p.intent for p in run("REC-1")] == ["list_loci"]
    for q, code in (("NONE", "question_without_mapping"), ("BAD", "unbound_entity_slot")):
        with pytest.raises(Refused) as e:
            run(q)
        assert e.value.code == code


def test_providers_and_index(spark):
    docs = spark.createDataFrame([(1, "one two three four"), (2, "one"), (3, None)], "k long, t string")
    rows = {r.key: r for r in sinks.index_rows(docs, "k", "t", providers.embedder(providers.hashed_embeddings), providers.tokenizer(providers.word_offsets), 2).collect()}
    assert (rows[1].truncated, rows[1].truncated_tokens, rows[2].truncated) == (True, 2, False) and rows[3].vector is None
    same = sinks.index_rows(spark.createDataFrame([(9, "one two")], "k long, t string"), "k", "t", providers.embedder(providers.hashed_embeddings), providers.tokenizer(providers.word_offsets), 2).first()
    assert same.vector == rows[1].vector
    scorer = providers.reranker(lambda: lambda pairs: [float(len(a) + len(b)) for a, b in pairs])
    assert [r[0] for r in docs.select(scorer(F.lit("ab"), "t")).collect()] == [20.0, 5.0, 2.0]


def test_digests(spark):
    rows = spark.createDataFrame([(i % 700,) for i in range(2000)], "k long")
    one, other = (ingest.multiset_digest(df, "k").first() for df in (rows, rows.repartition(7)))
    assert one == other and one.n == 2000
    assert ingest.multiset_digest(rows.limit(1999), "k").first().digest != one.digest and ingest.multiset_digest(rows.limit(0), "k").first().n == 0
    held = ingest.key_set_digest(rows, "k", limit=2000).first()
    assert ingest.key_set_digest(rows.repartition(5), "k", limit=10).first() == held and held.n == 2000  # as a stream
    odd = spark.createDataFrame([('a"b',), ("é\n",), (None,), ("",)], "k string")
    assert ingest.key_set_digest(odd, "k", limit=1).first() == ingest.key_set_digest(odd, "k").first()


def test_release_rules_and_grounding(spark):
    t = spark.createDataFrame([(1, 5), (2, -1)], "k long, v int")
    found = {tuple(r) for r in release.validate_release({"t": t, "u": t}, {"t": "k", "u": "k"}, {"t": {"low": ("error", F.col("v") < 0), "odd": ("warning", F.col("v") == 5)}, "u": {"none": ("error", F.col("v") > 99)}}).collect()}
    assert found == {("t", "2", "low", "error"), ("t", "1", "odd", "warning"), ("t", None, "release_t_issues_present", "error")}
    row = {c: 0 for _, a, b, _ in metrics.GROUNDING for c in (a, b) if c not in ("fully_supported", "partially_supported", "unsupported", "assessable")}
    answers = spark.createDataFrame([{"g": "x", "claim_labels": ["fully_supported", "not_assessable", "unsupported"]} | row | {"judged": 4, "correct_documents": 3}])
    got = {r.metric: (r.value, r.reason) for r in metrics.grounding_rates(answers, ["g"]).collect()}
    assert got["fully_supported_claim_rate"] == (0.5, None) and got["citation_document_accuracy"] == (0.75, None) and got["citation_recall"] == (None, "no_required_evidence_groups")


def test_loaders(spark, tmp_path):
    files = {"nodes.dmp": "1\t|\t1\t|\tno rank\t|\n2\t|\t1\t|\tphylum\t|\n3\t|\t2\t|\tgenus\t|\n", "names.dmp": "".join(f"{i}\t|\tname{i}\t|\t\t|\tscientific name\t|\n" for i in (1, 2, 3)) + "3\t|\tother\t|\t\t|\tsynonym\t|\n", "merged.dmp": "9\t|\t3\t|\n", "delnodes.dmp": "7\t|\n"}
    with tarfile.open(tmp_path / "d.tar.gz", "w:gz") as tar:
        for name, text in files.items():
            info = tarfile.TarInfo(name)
            info.size = len(text)
            tar.addfile(info, io.BytesIO(text.encode()))
    lines = scans.scan_taxdump_archive(spark, str(tmp_path / "d.tar.gz"))
    tables = [scans.dump_table(lines, k) for k in ("nodes", "names", "merged", "delnodes")]
    need = lambda i: spark.createDataFrame([(i,)], "id string")
    got = {r.tax_id: (r["rank"], r.parent_id, r.name, r.aliases) for r in taxonomy.taxon_terms(*tables, need("9")).collect()}
    assert got == {"1": ("no rank", None, "name1", []), "2": ("phylum", "1", "name2", []), "3": ("genus", "2", "name3", ["other"])}
    with pytest.raises(ValueError):
        taxonomy.taxon_terms(*tables, need("7"))
    with pytest.raises(Exception, match="unknown or unnamed"):
        taxonomy.taxon_terms(*tables, need("55")).collect()
    cover = scans.species_coverage(spark.createDataFrame([("a",), ("b ",), (None,)], "Species string"), spark.createDataFrame([("b",), ("c",)], "Species string"))
    assert {tuple(r) for r in cover.collect()} == {("a", "sheet"), ("c", "list")}
    folder = tmp_path / "packet"
    folder.mkdir()
    (folder / "r.jsonl").write_text('{"k": 1}\n{"k": 2}\n')
    raw = (folder / "r.jsonl").read_bytes()
    manifest = {"r": {"file": "r.jsonl", "sha256": hashlib.sha256(raw).hexdigest(), "size": len(raw), "schema": "k long"}}
    assert sorted(r.k for r in scans.load_packet(spark, str(folder), manifest)["r"].collect()) == [1, 2]
    with pytest.raises(Exception, match="not the expected one"):
        scans.load_packet(spark, str(folder), {"r": manifest["r"] | {"size": 3}})["r"].collect()
    (folder / "more.txt").write_text("x")
    with pytest.raises(ValueError):
        scans.load_packet(spark, str(folder), manifest)
    sealed = [{"a": 1}, {"a": 2}]
    good = [r | {"record_sha256": hashlib.sha256(json.dumps(r, separators=(",", ":")).encode()).hexdigest()} for r in sealed]
    (tmp_path / "s.jsonl").write_text("\n".join(map(json.dumps, good)))
    assert scans.load_sealed(spark, str(tmp_path / "s.jsonl"), "a long, record_sha256 string").count() == 2
    (tmp_path / "t.jsonl").write_text(json.dumps(good[0] | {"a": 5}))
    with pytest.raises(Exception, match="record digest differs"):
        scans.load_sealed(spark, str(tmp_path / "t.jsonl"), "a long, record_sha256 string").collect()


def test_staging_survives_a_failed_attempt(spark, tmp_path):
    rows = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c")], "k long, v string")
    folder = f"file://{tmp_path}/staged"
    rows.limit(1).write.parquet(f"{folder}/run_key=r1")  # what an attempt left before its marker
    assert sinks.read_staged(spark, folder) is None
    assert sinks.stage(rows, folder, "k", "r1") == 2
    assert {(r.k, r.v, r.run_key) for r in sinks.read_staged(spark, folder).collect()} == {(1, "a", "r1"), (2, "c", "r1")}
    assert sinks.stage(rows, folder, "k", "r1") == 0 and sinks.stage(rows, folder, "k", "r2") == 0
    with pytest.raises(ValueError):
        sinks.stage(rows, folder, "k", "../x")


def test_entities_by_level(spark):
    catalog = spark.createDataFrame([("g", "K1", "Name One", ["n1", "x"]), ("g", "K2", "n1", None), ("g", "K3", "Name Three", ["x"])], "kind string, key string, name string, aliases array<string>")
    asked = spark.createDataFrame([("g", m) for m in ("K1", "k1", " name  ONE", "N1", "x", "none")] + [("h", "K1")], "kind string, mention string")
    got = {(r.kind, r.mention): (r.key, r.status) for r in taxonomy.resolve_entities(asked, catalog).collect()}
    assert got == {("g", "K1"): ("K1", "resolved"), ("g", "k1"): (None, "unresolved"), ("g", " name  ONE"): ("K1", "resolved"), ("g", "N1"): ("K2", "resolved"), ("g", "x"): (None, "ambiguous"), ("g", "none"): (None, "unresolved"), ("h", "K1"): (None, "unresolved")}


def test_questions_read_their_words_folders_only(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"word{i % 50} other{i % 7} the") for i in range(200)], "k long, t string")
    posts = ranking.postings(docs, "k", {"D": "t"})
    ranking.write_postings(posts, f"{tmp_path}/index", 16)
    found = ranking.read_postings(spark, f"{tmp_path}/index", ("word7", "the"), 16)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan or "PartitionFilters: [((part" in plan or "PartitionFilters: [part" in plan
    assert len({f.rpartition("part=")[2].split("/")[0] for f in found.inputFiles()}) <= 16
    whole = sorted(map(tuple, ranking.lexical_top(posts, ("word7", "the"), "k").collect()))
    assert sorted(map(tuple, ranking.lexical_top(found, ("word7", "the"), "k").collect())) == whole and len(whole) == 4


def test_quotes_meet_texts_by_inner_words(spark):
    quote = "ne two three four five six seven ei"
    docs = [(1, "one two three four five six seven eight"), (2, "one two  three four five six seven eight"), (3, "x " + quote + " y"), (4, "nothing of it"), (5, None), (6, "ab cd"), (7, "a b c"), (7, "one two three four five six seven eight")]
    quotes = [(10, quote), (11, "b c"), (12, None), (13, "three four five six seven eight nine"), (14, "")]
    made = ranking.quote_containment(spark.createDataFrame(docs, "k long, t string"), spark.createDataFrame(quotes, "q long, s string"), "k", "t", "q", "s")
    want = {(q, k) for k, t in docs for q, s in quotes if t is not None and s is not None and s in t}
    assert {(r.q, r.k) for r in made.collect()} == want and made.count() == len(want)


def test_digest_is_the_same_above_its_limit(spark):
    """Whatever the number of rows: 4,096 buckets of sorted entries, then their digests; null keys count as rows only."""
    rows = spark.createDataFrame([(i % 5000 if i % 90 else None,) for i in range(9000)], "k long")
    counts, buckets = Counter(hashlib.sha256(str(r.k).encode()).hexdigest() for r in rows.collect() if r.k is not None), {}
    for h in sorted(counts):
        buckets.setdefault(h[:3], []).append(f"{h}:{counts[h]}")
    want = hashlib.sha256(",".join(hashlib.sha256(",".join(buckets[b]).encode()).hexdigest() for b in sorted(buckets)).encode()).hexdigest()
    for limit in (9000, 10):
        found = ingest.multiset_digest(rows, "k", limit=limit).first()
        assert (found.digest, found.n) == (want, 9000)


def test_providers_answer_in_pieces():
    """No batch of a tokenizer or an embedder holds the answers for many long texts."""
    texts = pd.Series(["a b " * 100_000, None, "c"] * 9)
    for udf in (providers.tokenizer(providers.word_offsets), providers.embedder(lambda: lambda own: [[float(len(t))] for t in own])):
        found = list(udf.func(iter([texts])))
        assert len(found) > 2 and sum(map(len, found)) == 27
        assert list(pd.concat(found).index) == list(texts.index)


def test_words_of_a_text_are_made_once(spark, capsys):
    texts = ["red big fox", "red fox big", "Red BIG fox dog", "a Cat", None, "redbigfox cats"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    asked = lexical.search_query('red "big fox" -dog or cat')
    found = rows.where(ranking.search_texts(F.col("t"), asked.alternatives))
    assert sorted(r.k for r in found.collect()) == [0, 3]
    found.explain()
    assert capsys.readouterr().out.count("regexp_extract_all") == 1
    assert rows.where(ranking.search_texts(F.col("t"), [])).count() == 0
