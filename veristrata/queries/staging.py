"""Ingest queries: normalisation, authority resolution, ledger, audit, digests, release and policy rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys, scalar
from ..operators import ingest, release, taxonomy
from .mapping import WORKSHEET, table, worksheet

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {}


def _add(name: str, sql: str):
    def keep(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn, sql
        return fn

    return keep


_AUTHORITY = "SELECT 'GCA_' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') || '.1' AS assembly, 'CM' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') || '.1' AS accession, s_suppkey % 7 * 1000 + CASE WHEN s_suppkey % 5 = 0 THEN 2000 ELSE 3000 END AS length FROM (SELECT DISTINCT l_partkey AS p_partkey, l_suppkey AS s_suppkey FROM lineitem WHERE l_partkey % 3 <> 0 AND l_suppkey % 4 <> 1)"
_INT = "regexp_full_match({0}, '0|[1-9][0-9]*')"
_NORMAL = f"""SELECT *, CASE WHEN {_INT.format('contig_length')} THEN CAST(contig_length AS BIGINT) END AS cl, contains(start_, '..') AS compound,
 CASE WHEN NOT contains(start_, '..') AND {_INT.format('start_')} THEN TRY_CAST(start_ AS BIGINT) END AS s0, CASE WHEN NOT contains(start_, '..') THEN CAST(end_ AS BIGINT) END AS e0,
 CASE WHEN NOT contains(start_, '..') THEN CAST(length_ AS BIGINT) END AS len FROM ({WORKSHEET})"""
_ISSUES = f"""SELECT *, list_filter([
 CASE WHEN NOT regexp_full_match(assembly, 'GC[AF]_[0-9]{{9}}\\.[1-9][0-9]*') THEN 'invalid_assembly_accession_version' END,
 CASE WHEN vr = 'vr0' THEN 'invalid_vr_token' END,
 CASE WHEN compound THEN 'multipart_interval' END,
 CASE WHEN cl IS NULL THEN 'invalid_integer' END,
 CASE WHEN cl <= 0 THEN 'invalid_contig_length' END,
 CASE WHEN NOT (s0 >= 0 AND s0 < e0) THEN 'invalid_interval' END,
 CASE WHEN len <> e0 - s0 THEN 'length_mismatch' END,
 CASE WHEN e0 > cl THEN 'interval_out_of_bounds' END,
 CASE WHEN vr_type = 'Viral contig' THEN 'viral_contig_policy_quarantine' END,
 CASE WHEN vr_type NOT IN ('Viral contig', 'Integration') THEN 'unsupported_vr_type' END], lambda c: c IS NOT NULL) AS issues FROM ({_NORMAL})"""


def _normal(spark: SparkSession, d: str) -> DataFrame:
    return ingest.normalize(worksheet(spark, d), "snap-1", "policy-1")


@_add("F14_row_normalization", f"SELECT assembly AS \"Assembly\", contig AS \"Contig\", vr AS \"VR\", CASE WHEN hcvr = 'Yes' THEN 'source_high' ELSE 'source_low' END AS source_assessment, s0 AS start0, e0 AS end0, cl AS contig_length, array_to_string(issues, ',') AS issue_list, CASE WHEN len(issues) = 0 THEN 'normalized_candidate' ELSE 'quarantine' END AS outcome FROM ({_ISSUES})")
def normalization(spark: SparkSession, d: str) -> DataFrame:
    return _normal(spark, d).select("Assembly", "Contig", "VR", "source_assessment", "start0", "end0", "contig_length", F.array_join("issues", ",").alias("issue_list"), "outcome")


@_add("F14_locus_key_error", f"""SELECT vr_type AS "VR Type", count_if(bad) AS errors, count_if(good AND NOT bad) AS keys, count(*) AS n FROM (SELECT *, good AND vr_type IN ('Other', 'Viral contig') AS bad FROM (SELECT *, regexp_full_match(assembly, 'GC[AF]_[0-9]{{9}}\\.[1-9][0-9]*') AND vr <> 'vr0' AS good FROM ({WORKSHEET}))) GROUP BY vr_type""")
def locus_key_error(spark: SparkSession, d: str) -> DataFrame:
    """Rows with a valid identity whose snapshot is no exact token: empty, or with a blank before it."""
    snapshot = F.when(F.col("VR Type") == "Other", " snap-1").when(F.col("VR Type") == "Viral contig", "").otherwise("snap-1")
    rows = ingest.normalize(worksheet(spark, d), snapshot, "policy-1")
    return rows.groupBy("VR Type").agg(F.count_if(F.array_contains("issues", "locus_key_error")).alias("errors"), F.count("locus_key").alias("keys"), F.count("*").alias("n"))


@_add("X3_I4_locus_keys", f"""SELECT assembly AS "Assembly", contig AS "Contig", vr AS "VR", 'locus:sha256:' || sha256('{{"assembly_accession_version":"' || assembly || '","contig_accession_version":"' || contig || '","identity_policy_version":"policy-1","native_vr_token":"' || vr || '","source_snapshot_key":"snap-1"}}') AS locus_key FROM ({WORKSHEET}) WHERE regexp_full_match(assembly, 'GC[AF]_[0-9]{{9}}\\.[1-9][0-9]*') AND vr <> 'vr0'""")
def locus_keys(spark: SparkSession, d: str) -> DataFrame:
    return _normal(spark, d).where("locus_key is not null").select("Assembly", "Contig", "VR", "locus_key")


@_add("A24_ledger_counts", f"SELECT CASE WHEN len(issues) = 0 THEN 'normalized_candidate' ELSE 'quarantine' END AS outcome, count(*) AS n FROM ({_ISSUES}) GROUP BY 1")
def ledger(spark: SparkSession, d: str) -> DataFrame:
    return ingest.ledger_counts(_normal(spark, d))


@_add("A11_issue_counts", f"SELECT code, count(*) AS n FROM (SELECT unnest(issues) AS code FROM ({_ISSUES})) GROUP BY code")
def issues(spark: SparkSession, d: str) -> DataFrame:
    return ingest.issue_counts(_normal(spark, d))


@_add("I8_quarantine_has_issue", "SELECT doc_id FROM labels WHERE quality = 0 AND NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = labels.doc_id AND (contains(d.text, '!!') OR contains(d.text, ' | ')))")
def quarantine_has_issue(spark: SparkSession, d: str) -> DataFrame:
    """Quarantined rows (labels of quality 0) for which the table of issues (texts that shout or hold bars) has no row."""
    issues = table(spark, d, "documents").where(F.contains("text", F.lit("!!")) | F.contains("text", F.lit(" | "))).select("doc_id")
    return release.orphans(table(spark, d, "labels").where("quality = 0").select("doc_id"), issues, ["doc_id"])


@_add("I4_stored_keys", f"""SELECT assembly AS "Assembly", contig AS "Contig", vr AS "VR" FROM ({WORKSHEET}) WHERE regexp_full_match(assembly, 'GC[AF]_[0-9]{{9}}\\.[1-9][0-9]*') AND vr = 'vr3'""")
def stored_keys(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose stored key is not the one that their fields give; here those of ``vr3`` were stored for ``vr4``."""
    rows = _normal(spark, d).where("locus_key is not null")
    other = keys.locus_key(F.lit("snap-1"), F.col("Assembly"), F.col("Contig"), F.lit("vr4"), F.lit("policy-1"))
    stored = rows.withColumn("stored", F.when(F.col("VR") == "vr3", other).otherwise(F.col("locus_key")))
    return stored.where("stored <> locus_key").select("Assembly", "Contig", "VR")


def _authority(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").where("l_partkey % 3 <> 0 and l_suppkey % 4 <> 1").select(F.col("l_partkey").alias("p_partkey"), F.col("l_suppkey").alias("s_suppkey")).distinct()
    reports = rows.select(
        F.concat(F.lit("GCA_"), F.lpad(F.col("p_partkey").cast("string"), 9, "0"), F.lit(".1")).alias("assembly_accession"),
        F.concat(F.lit("CM"), F.lpad(F.col("s_suppkey").cast("string"), 6, "0"), F.lit(".1")).alias("genbank_accession"),
        F.lit(None).cast("string").alias("refseq_accession"),
        (F.col("s_suppkey") % 7 * 1000 + F.when(F.col("s_suppkey") % 5 == 0, 2000).otherwise(3000)).alias("length"),
    )
    return ingest.authority_index(reports)


@_add("S7_authority_index", f"SELECT assembly, accession, min(length) AS length, count(DISTINCT length) AS lengths FROM ({_AUTHORITY}) GROUP BY ALL")
def authority(spark: SparkSession, d: str) -> DataFrame:
    return _authority(spark, d)


@_add(
    "F17_J10_authority_resolution",
    f"""SELECT CASE WHEN k.assembly IS NULL THEN 'unresolved' ELSE 'exact' END AS assembly_resolution,
 CASE WHEN k.assembly IS NULL OR a.length IS NULL THEN 'unresolved' WHEN cl IS NULL OR cl <= 0 THEN 'length_unverified' WHEN cl <> a.length THEN 'length_mismatch' ELSE 'exact' END AS contig_resolution, count(*) AS n
 FROM ({_NORMAL}) r LEFT JOIN (SELECT DISTINCT assembly FROM ({_AUTHORITY})) k ON r.assembly = k.assembly LEFT JOIN (SELECT DISTINCT * FROM ({_AUTHORITY})) a ON r.assembly = a.assembly AND r.contig = a.accession GROUP BY ALL""",
)
def resolution(spark: SparkSession, d: str) -> DataFrame:
    return ingest.resolve(worksheet(spark, d), _authority(spark, d)).groupBy("assembly_resolution", "contig_resolution").agg(F.count("*").alias("n"))


_RESOLVED = f"""SELECT r.*, CASE WHEN k.assembly IS NULL THEN 'unresolved' ELSE 'exact' END AS ar, CASE WHEN k.assembly IS NULL OR a.length IS NULL THEN 'unresolved' WHEN cl IS NULL OR cl <= 0 THEN 'length_unverified' WHEN cl <> a.length THEN 'length_mismatch' ELSE 'exact' END AS cr
 FROM ({_ISSUES}) r LEFT JOIN (SELECT DISTINCT assembly FROM ({_AUTHORITY})) k ON r.assembly = k.assembly LEFT JOIN (SELECT DISTINCT * FROM ({_AUTHORITY})) a ON r.assembly = a.assembly AND r.contig = a.accession"""


def _resolved(spark: SparkSession, d: str) -> DataFrame:
    return ingest.normalize(ingest.resolve(worksheet(spark, d), _authority(spark, d)), "snap-1", "policy-1")


@_add("F14_issues_with_authority", f"""SELECT code, count(*) AS n FROM (SELECT unnest(issues) AS code FROM ({_RESOLVED}) UNION ALL SELECT 'ncbi_assembly_not_resolved' FROM ({_RESOLVED}) WHERE ar = 'unresolved'
 UNION ALL SELECT 'ncbi_sequence_not_resolved' FROM ({_RESOLVED}) WHERE ar = 'exact' AND cr = 'unresolved' UNION ALL SELECT 'ncbi_contig_length_mismatch' FROM ({_RESOLVED}) WHERE cr = 'length_mismatch') GROUP BY code""")
def issues_with_authority(spark: SparkSession, d: str) -> DataFrame:
    """Counts of all codes of rows that were looked up in the authority first."""
    return ingest.issue_counts(_resolved(spark, d))


_GOOD = "regexp_full_match(assembly, 'GC[AF]_[0-9]{9}\\.[1-9][0-9]*') AND vr <> 'vr0'"
_ANY = f"len(issues) > 0 OR ar = 'unresolved' OR (ar = 'exact' AND cr = 'unresolved') OR cr = 'length_mismatch'"


@_add("A11_worksheet_audit", f"""WITH r AS (SELECT *, {_GOOD} AS good, CASE WHEN {_GOOD} THEN assembly || contig || vr END AS k FROM ({_RESOLVED})), dup AS (SELECT count(*) AS n FROM r WHERE good GROUP BY k), calls AS (SELECT count(*) AS n FROM r GROUP BY assembly, contig, vr, start_)
 SELECT count(*) AS source_records, count_if(hcvr = 'Yes') AS source_high, count_if(hcvr <> 'Yes') AS source_low, count_if(NOT ({_ANY})) AS normalized_candidate, count_if({_ANY}) AS quarantine,
 count_if(vr_type = 'Integration') AS vr_type_integration, count_if(vr_type = 'Viral contig') AS vr_type_viral_contig, count_if(vr_type NOT IN ('Integration', 'Viral contig')) AS vr_type_other,
 count_if(ar = 'exact') AS assembly_resolution_exact, count_if(ar <> 'exact') AS assembly_resolution_not_exact, count_if(cr = 'exact') AS contig_resolution_exact, count_if(cr <> 'exact') AS contig_resolution_not_exact,
 count_if(NOT good) AS missing_locus_key, count_if(vr = 'vr7') AS missing_organism_name, 0 AS invalid_call_key_format, count_if(good AND vr = 'vr5') AS invalid_locus_key_format, count_if(NOT good) AS locus_key_preimage_error, count_if(good AND vr = 'vr5') AS locus_key_preimage_mismatch,
 count(DISTINCT assembly) AS assemblies, count(DISTINCT (assembly, contig)) AS contigs, count(DISTINCT contig) FILTER (vr <> 'vr7') AS source_organism_names,
 (SELECT count_if(n > 1) FROM calls) AS call_key_values, (SELECT CAST(sum(n - 1) AS BIGINT) FROM calls) AS call_key_extra_occurrences, (SELECT count_if(n > 1) FROM dup) AS locus_key_values, (SELECT CAST(sum(n - 1) AS BIGINT) FROM dup) AS locus_key_extra_occurrences FROM r""")
def worksheet_audit(spark: SparkSession, d: str) -> DataFrame:
    """Counters of the import; the keys of ``vr5`` were stored in upper case, ``vr7`` has no organism."""
    rows = _resolved(spark, d)
    stored = F.when(F.col("VR") == "vr5", F.upper("locus_key")).otherwise(F.col("locus_key"))
    record = ingest.source_record_key(F.lit("artifact"), F.lit("snap-1"), F.lit("sheet"), F.concat_ws("/", "Assembly", "Contig", "VR", "Start"))
    return ingest.worksheet_audit(rows.withColumn("stored_key", stored).withColumn("record_key", record).withColumn("name", F.when(F.col("VR") != "vr7", F.col("Contig"))))


@_add("F13_approved_scope", "SELECT p_partkey, p_brand, p_type FROM part WHERE p_brand IN ('Brand#2', 'Brand#4') AND p_type = 'PROMO' AND p_name LIKE 'red%'")
def scope(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("Assembly"), F.col("p_type").alias("Viral Major Taxon"), F.when(F.col("p_name").startswith("red"), "red").alias("Class"))
    return ingest.in_scope(rows, ("Brand#2", "Brand#4"), "PROMO", "red").select("p_partkey", F.col("Assembly").alias("p_brand"), F.col("Viral Major Taxon").alias("p_type"))


@_add("F15_strict_integer", f"SELECT DISTINCT t, CASE WHEN {_INT.format('t')} THEN CAST(t AS BIGINT) END AS v FROM (SELECT CASE o_orderkey % 5 WHEN 0 THEN CAST(o_orderkey AS VARCHAR) WHEN 1 THEN '0' || o_orderkey WHEN 2 THEN '+' || o_orderkey WHEN 3 THEN o_orderkey || ' ' ELSE '0' END AS t FROM orders)")
def strict(spark: SparkSession, d: str) -> DataFrame:
    k, m = F.col("o_orderkey").cast("string"), F.col("o_orderkey") % 5
    t = F.when(m == 0, k).when(m == 1, F.concat(F.lit("0"), k)).when(m == 2, F.concat(F.lit("+"), k)).when(m == 3, F.concat(k, F.lit(" "))).otherwise("0")
    return table(spark, d, "orders").select(t.alias("t")).distinct().withColumn("v", scalar.strict_integer(F.col("t")))


#: Texts of an interval by the order's number: the first seven are compound.
_INTERVALS = ("{0}..9", "{0},7", "{0};7", "{0}|7", "join({0}", "ORDER ({0}", "complement({0}", "{0}", "{0}.5", "joint {0}", "{0}-7", "-{0}")


@_add("F16_compound_interval", f"SELECT o_orderkey, regexp_matches(text, '(?i)[,;|]|\\b(join|order|complement)\\s*\\(|[.][.]') AS compound FROM (SELECT o_orderkey, replace([{', '.join(f"'{t}'" for t in _INTERVALS)}][o_orderkey % 12 + 1], '{{0}}', CAST(o_orderkey AS VARCHAR)) AS text FROM orders)")
def compound(spark: SparkSession, d: str) -> DataFrame:
    forms = F.array(*[F.lit(t) for t in _INTERVALS])
    text = F.replace(F.get(forms, (F.col("o_orderkey") % 12).cast("int")), F.lit("{0}"), F.col("o_orderkey").cast("string"))
    return table(spark, d, "orders").select("o_orderkey", scalar.is_compound_interval(text).alias("compound"))


@_add("F22_cohort_filter", f"SELECT assembly AS \"Assembly\", contig AS \"Contig\", vr AS \"VR\", start_ AS \"Start\" FROM ({_ISSUES}) WHERE hcvr = 'Yes' OR (len(issues) = 0 AND s0 < e0)")
def cohort(spark: SparkSession, d: str) -> DataFrame:
    return _normal(spark, d).where("source_assessment = 'source_high' or (outcome = 'normalized_candidate' and start0 < end0)").select("Assembly", "Contig", "VR", "Start")


@_add("F23_flank_window", "SELECT l_orderkey, greatest(0, s - 500) + 1 AS first1, least(8000, s + CAST(l_quantity AS BIGINT) + 500) AS last1 FROM (SELECT *, (l_linenumber - 1) * 1000 AS s FROM lineitem)")
def flank(spark: SparkSession, d: str) -> DataFrame:
    start = ((F.col("l_linenumber") - 1) * 1000).cast("long")
    first, last = ingest.flank_window(start, start + F.col("l_quantity").cast("long"), F.lit(8000).cast("long"), 500)
    return table(spark, d, "lineitem").select("l_orderkey", first.cast("int").alias("first1"), last.alias("last1"))


@_add("F24_X23_flank_verdict", "SELECT doc_id, length(regexp_replace(h, '[acgt]', '', 'g')) AS ambiguous, coalesce(list_max([length(x) FOR x IN regexp_extract_all(h, '[^acgt]+')]), 0) AS longest, regexp_matches(h, '^[acgt]') AS boundary_ok FROM (SELECT doc_id, md5(text) AS h FROM documents)")
def flank_verdict(spark: SparkSession, d: str) -> DataFrame:
    h = F.col("h")
    return table(spark, d, "documents").select("doc_id", F.md5("text").alias("h")).select("doc_id", F.regexp_count(h, F.lit("[^acgt]")).cast("long").alias("ambiguous"), scalar.longest_run(h, "[^acgt]").cast("long").alias("longest"), h.rlike("^[acgt]").alias("boundary_ok"))


@_add("A12_duplicate_metrics", "SELECT count_if(n > 1) AS repeated_values, CAST(sum(n - 1) AS BIGINT) AS extra_rows FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey * 10 + l_linenumber)")
def duplicates(spark: SparkSession, d: str) -> DataFrame:
    return ingest.duplicates(table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k")), "k")


@_add("A11_audit_counters", "SELECT count(*) AS rows, count(DISTINCT event_id) AS distinct_keys, count_if(value < 1) AS low, count_if(event_type = 'error') AS errors FROM events")
def audit(spark: SparkSession, d: str) -> DataFrame:
    return ingest.audit(table(spark, d, "events"), "event_id", {"low": F.col("value") < 1, "errors": F.col("event_type") == "error"})


@_add("A13_key_set_digest", "SELECT sha256('[' || string_agg('\"' || k || '\"', ',' ORDER BY k) || ']') AS digest, count(*) AS n FROM (SELECT n_name AS k FROM nation)")
def key_digest(spark: SparkSession, d: str) -> DataFrame:
    return ingest.key_set_digest(table(spark, d, "nation"), "n_name")


@_add("A13_key_set_stream", "SELECT sha256('[' || string_agg('\"' || k || '\"', ',' ORDER BY k) || ']') AS digest, count(*) AS n FROM (SELECT CAST(o_orderkey AS VARCHAR) AS k FROM orders)")
def key_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same digest of a key set that is not held as a list."""
    return ingest.key_set_digest(table(spark, d, "orders"), "o_orderkey", limit=100)


_BUCKETED = "SELECT sha256(string_agg(d, ',' ORDER BY b)) AS digest, CAST(sum(n) AS BIGINT) AS n FROM (SELECT b, sha256(string_agg(h || ':' || c, ',' ORDER BY h)) AS d, sum(c) AS n FROM (SELECT h, h[1:3] AS b, count(*) AS c FROM (SELECT sha256({0}) AS h FROM {1}) GROUP BY h) GROUP BY b)"


@_add("A13_multiset_digest", _BUCKETED.format("CAST(l_orderkey AS VARCHAR)", "lineitem"))
def multiset(spark: SparkSession, d: str) -> DataFrame:
    return ingest.multiset_digest(table(spark, d, "lineitem"), "l_orderkey")


_NATION_JSON = """sha256('{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}')"""


@_add("A14_table_digest", "SELECT 'nation' AS \"table\", digest, n FROM (" + _BUCKETED.format(_NATION_JSON, "nation") + ")")
def table_digest(spark: SparkSession, d: str) -> DataFrame:
    return release.table_digest(table(spark, d, "nation"), "nation")


_REGION_JSON = """sha256('{"r_name":"' || r_name || '","r_regionkey":' || r_regionkey || '}')"""


_LABEL_JSON = """sha256('{"doc_id":' || doc_id || ',"quality":' || quality || ',"toxic":' || toxic || '}')"""
_DIGESTS = {"labels": _LABEL_JSON, "nation": _NATION_JSON, "region": _REGION_JSON}
_EACH = " UNION ALL ".join(f"SELECT '{t}' AS t, digest, n FROM ({_BUCKETED.format(j, t)})" for t, j in _DIGESTS.items())


@_add("A15_release_digest", f"SELECT sha256(string_agg(t || ':' || digest, chr(10) ORDER BY t)) AS digest, CAST(sum(n) AS BIGINT) AS n FROM ({_EACH})")
def release_digest(spark: SparkSession, d: str) -> DataFrame:
    return release.release_digest({t: table(spark, d, t) for t in _DIGESTS})


@_add("A16_expected_vs_actual", "SELECT metric, expected, actual FROM (SELECT event_type AS metric, count(*) AS actual FROM events GROUP BY 1) FULL JOIN (SELECT * FROM (VALUES ('click', 1), ('gone', 2)) t(metric, expected)) USING (metric) WHERE expected IS DISTINCT FROM actual")
def expected_actual(spark: SparkSession, d: str) -> DataFrame:
    actual = table(spark, d, "events").groupBy(F.col("event_type").alias("metric")).agg(F.count("*").alias("value"))
    return ingest.compare(spark.createDataFrame([("click", 1), ("gone", 2)], "metric string, value int"), actual)


@_add("S15_I6_replay", "SELECT event_id FROM events WHERE event_id % 3 <> 0")
def replay(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("event_id")
    return ingest.new_rows(events, events.where("event_id % 3 = 0"), "event_id")


@_add("I6_H15_rebuild_differences", "SELECT n_nationkey, n_name, n_regionkey, 'missing' AS side FROM nation WHERE n_nationkey = 3 UNION ALL SELECT n_nationkey, n_name || 'x', n_regionkey, 'extra' FROM nation WHERE n_nationkey = 3")
def differences(spark: SparkSession, d: str) -> DataFrame:
    nation = table(spark, d, "nation")
    return release.differences(nation, nation.withColumn("n_name", F.when(F.col("n_nationkey") == 3, F.concat("n_name", F.lit("x"))).otherwise(F.col("n_name"))))


@_add("H15_corpus_rebuild", """SELECT 'benchmark' AS "table", 0 AS missing, 0 AS extra UNION ALL SELECT 'documents', count(*), count(*) FROM documents WHERE lang = 'de' UNION ALL SELECT 'embeddings', 0, count(*) FROM embeddings WHERE label = 3 UNION ALL SELECT 'labels', count(*), 0 FROM labels WHERE quality = 0""")
def corpus_rebuild(spark: SparkSession, d: str) -> DataFrame:
    """A corpus against a rebuild with other German texts, some vectors twice and no labels of quality 0."""
    then = {n: table(spark, d, n) for n in ("benchmark", "documents", "embeddings", "labels")}
    text = F.when(F.col("lang") == "de", F.concat("text", F.lit("."))).otherwise(F.col("text"))
    now = then | {"documents": then["documents"].withColumn("text", text), "embeddings": then["embeddings"].unionByName(then["embeddings"].where("label = 3")), "labels": then["labels"].where("quality <> 0")}
    return release.rebuild_report(then, now)


_RULES = {"price_negative": "p_retailprice < 0", "size_out_of_range": "p_size > 45", "type_unknown": "p_type NOT IN ('PROMO', 'ECONOMY', 'SMALL')"}


@_add("H16_rule_violations", " UNION ALL ".join(f"SELECT p_partkey, '{c}' AS code FROM part WHERE {r}" for c, r in sorted(_RULES.items())))
def rules(spark: SparkSession, d: str) -> DataFrame:
    return release.rule_violations(table(spark, d, "part"), "p_partkey", {c: F.expr(r) for c, r in _RULES.items()})


#: Rules by table and code: severity, and the condition of a fault in both dialects.
_RELEASE = {
    "part": {"part_price_not_positive": ("error", "p_retailprice <= 0"), "part_size_out_of_range": ("warning", "p_size > 45"), "part_type_unknown": ("error", "p_type NOT IN ('PROMO', 'ECONOMY', 'SMALL')"), "part_name_missing": ("error", "p_name IS NULL OR p_name = ''"), "part_brand_malformed": ("error", "p_brand NOT LIKE 'Brand#%'")},
    "supplier": {"supplier_balance_negative": ("warning", "s_acctbal < 0"), "supplier_nation_out_of_range": ("error", "s_nationkey < 0 OR s_nationkey > 20"), "supplier_name_missing": ("error", "s_name IS NULL")},
    "customer": {"customer_balance_negative": ("warning", "c_acctbal < 0"), "customer_segment_not_released": ("error", "c_mktsegment = 'MACHINERY'"), "customer_key_not_positive": ("error", "c_custkey < 0")},
    "orders": {"order_price_not_positive": ("error", "o_totalprice <= 0"), "order_state_pending": ("warning", "o_orderstatus = 'P'"), "order_priority_unspecified": ("warning", "o_orderpriority LIKE '4%'")},
}
_KEY_OF = {"part": "p_partkey", "supplier": "s_suppkey", "customer": "c_custkey", "orders": "o_orderkey"}
_BROKEN = " UNION ALL ".join(f"SELECT '{t}' AS \"table\", CAST({_KEY_OF[t]} AS VARCHAR) AS key, '{c}' AS code, '{s}' AS severity FROM {t} WHERE {cond}" for t, own in _RELEASE.items() for c, (s, cond) in own.items())


@_add("H16_release_validation", f"WITH f AS ({_BROKEN}) SELECT * FROM f UNION ALL SELECT DISTINCT \"table\", NULL, 'release_' || \"table\" || '_issues_present', 'error' FROM f")
def release_validation(spark: SparkSession, d: str) -> DataFrame:
    """The rules of four tables, each table in one pass, and the release's composed codes."""
    rules = {t: {c: (s, F.expr(cond)) for c, (s, cond) in own.items()} for t, own in _RELEASE.items()}
    return release.validate_release({t: table(spark, d, t) for t in _RELEASE}, _KEY_OF, rules)


_NAMED = "SELECT 'nation' AS kind, 'n' || n_nationkey AS key, n_name AS name, ['N ' || n_nationkey, CASE WHEN n_nationkey < 3 THEN 'first ones' ELSE 'alias ' || n_nationkey END] AS aliases FROM nation UNION ALL SELECT 'region', 'r' || r_regionkey, r_name, NULL FROM region"
_MENTIONS = "SELECT * FROM (VALUES ('nation', 'n4'), ('nation', 'N  7'), ('nation', 'First Ones'), ('nation', 'nowhere'), ('region', ' ' || (SELECT lower(r_name) FROM region WHERE r_regionkey = 1)), ('region', 'n4'), ('nation', 'ALIAS  9 ')) v(kind, mention)"
_FLAT = "lower(trim(regexp_replace({0}, '\\s+', ' ', 'g')))"


@_add("H21_H22_entity_resolution", f"""WITH names AS (SELECT kind, key, 1 AS level, key AS form FROM ({_NAMED}) UNION ALL SELECT kind, key, 2, {_FLAT.format('name')} FROM ({_NAMED}) UNION ALL SELECT kind, key, 3, {_FLAT.format('a')} FROM (SELECT kind, key, unnest(aliases) AS a FROM ({_NAMED}))),
 hits AS (SELECT m.kind, m.mention, level, count(DISTINCT key) AS n, min(key) AS key FROM ({_MENTIONS}) m JOIN names x ON m.kind = x.kind AND x.form = CASE WHEN level = 1 THEN trim(m.mention) ELSE {_FLAT.format('m.mention')} END GROUP BY ALL),
 best AS (SELECT * FROM hits QUALIFY level = min(level) OVER (PARTITION BY kind, mention))
 SELECT kind, mention, CASE WHEN n = 1 THEN key END AS key, CASE WHEN n IS NULL THEN 'unresolved' WHEN n > 1 THEN 'ambiguous' ELSE 'resolved' END AS status FROM ({_MENTIONS}) LEFT JOIN best USING (kind, mention)""")
def entity_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Names of questions looked up in a catalog that comes from the tables."""
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    n = F.col("n_nationkey").cast("string")
    catalog = nation.select(F.lit("nation").alias("kind"), F.concat(F.lit("n"), n).alias("key"), F.col("n_name").alias("name"), F.array(F.concat(F.lit("N "), n), F.when(F.col("n_nationkey") < 3, "first ones").otherwise(F.concat(F.lit("alias "), n))).alias("aliases"))
    catalog = catalog.unionByName(region.select(F.lit("region").alias("kind"), F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("key"), F.col("r_name").alias("name"), F.lit(None).cast("array<string>").alias("aliases")))
    fixed = spark.createDataFrame([("nation", "n4"), ("nation", "N  7"), ("nation", "First Ones"), ("nation", "nowhere"), ("region", "n4"), ("nation", "ALIAS  9 ")], "kind string, mention string")
    asked = fixed.unionByName(region.where("r_regionkey = 1").select(F.lit("region").alias("kind"), F.concat(F.lit(" "), F.lower("r_name")).alias("mention")))
    return taxonomy.resolve_entities(asked, catalog)


@_add(
    "H26_inclusion_decision",
    """SELECT key, CASE WHEN len(r) = 0 THEN 'include' WHEN q OR outcome = 'quarantine' THEN 'quarantine' WHEN c OR l = 'contradicted' THEN 'exclude' ELSE 'review' END AS decision,
 CASE WHEN len(r) = 0 THEN 'eligible_for_v0_pilot_inclusion' ELSE array_to_string(list_sort(r), ';') END AS reasons FROM (SELECT *, list_filter([CASE WHEN outcome <> 'normalized_candidate' THEN 'import_outcome:' || outcome END, CASE WHEN NOT gates THEN 'm1_gates_failed' END, CASE WHEN placements <> 1 THEN 'exact_placement_count_not_one' END, CASE WHEN l IS NULL THEN 'flank_evidence_missing' END, CASE WHEN coalesce(l, 'not_assessed') <> 'supported' THEN 'left_flank:' || coalesce(l, 'not_assessed') END, CASE WHEN coalesce(l, 'not_assessed') <> 'supported' THEN 'right_flank:' || coalesce(l, 'not_assessed') END, CASE WHEN q THEN 'quarantine_issue:size' END, CASE WHEN c THEN 'conflict:brand' END], lambda x: x IS NOT NULL) AS r FROM (SELECT p_partkey AS key, CASE WHEN p_partkey % 11 = 0 THEN 'quarantine' ELSE 'normalized_candidate' END AS outcome, p_partkey % 13 <> 0 AS gates, CASE WHEN p_partkey % 7 = 0 THEN 0 ELSE 1 END AS placements, CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'contradicted' ELSE 'supported' END AS l, p_size > 45 AS q, p_brand = 'Brand#3' AS c FROM part))""",
)
def inclusion(spark: SparkSession, d: str) -> DataFrame:
    k, none = F.col("p_partkey"), F.array().cast("array<string>")
    verdict = F.when(k % 5 == 0, F.lit(None).cast("string")).when(k % 5 == 1, "contradicted").otherwise("supported")
    rows = table(spark, d, "part").select(
        k.alias("key"), F.when(k % 11 == 0, "quarantine").otherwise("normalized_candidate").alias("outcome"), (k % 13 != 0).alias("gates_pass"), F.when(k % 7 == 0, 0).otherwise(1).alias("placements"), F.lit(True).alias("bound"),
        verdict.alias("left"), verdict.alias("right"), none.alias("unresolved"), F.when(F.col("p_size") > 45, F.array(F.lit("size"))).otherwise(none).alias("quarantine"), F.when(F.col("p_brand") == "Brand#3", F.array(F.lit("brand"))).otherwise(none).alias("conflict"),
    )
    return release.inclusion(rows).withColumn("reasons", F.array_join("reasons", ";"))


@_add("H17_adjudication_prefix", "SELECT o_custkey, o_orderkey FROM (SELECT *, coalesce(max(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM orders) WHERE done = 0")
def prefix(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").withColumn("decision", F.when(F.col("o_orderstatus") == "F", "include").otherwise("review"))
    return release.adjudication_prefix(rows, "o_custkey", "o_orderkey", "decision").select("o_custkey", "o_orderkey")


@_add("H27_public_assertions", "SELECT locus_id FROM (SELECT l_orderkey AS locus_id, count(DISTINCT CASE WHEN l_returnflag IN ('A', 'N', 'R') THEN l_returnflag END) AS k, min(CASE WHEN l_quantity > 1 AND l_discount < 0.095 THEN 1 ELSE 0 END) AS clean FROM lineitem GROUP BY l_orderkey) WHERE k = 3 AND clean = 1")
def public_assertions(spark: SparkSession, d: str) -> DataFrame:
    line = table(spark, d, "lineitem").withColumn("assertion_id", F.to_json(F.struct("*")))
    evidence = line.where("l_quantity > 1").select("assertion_id", F.lit("supports").alias("relation")).unionByName(line.where("l_discount >= 0.095").select("assertion_id", F.lit("contradicts").alias("relation")))
    return release.public_assertions(line.select("assertion_id", F.col("l_orderkey").alias("locus_id"), F.col("l_returnflag").alias("assertion_type")), evidence, ("A", "N", "R"))


@_add("H29_display_labels", "SELECT p_partkey, p_name, CASE WHEN p_brand IN ('Brand#1', 'Brand#2') AND p_name LIKE 'red%' THEN upper(p_name) ELSE p_name END AS display FROM part")
def labels(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select("p_partkey", "p_brand", "p_name")
    own = part.where("p_brand in ('Brand#1', 'Brand#2') and p_name like 'red%'").select("p_brand", F.col("p_name").alias("source_text"), F.upper("p_name").alias("label")).distinct()
    return release.display_labels(part, own, "p_brand", "p_name").select("p_partkey", "p_name", "display")


@_add("H14_exact_projection", "SELECT o_custkey, min(o_orderstatus) AS o_orderstatus, count(DISTINCT o_orderstatus) = 1 AS is_exact FROM orders GROUP BY o_custkey")
def projection(spark: SparkSession, d: str) -> DataFrame:
    return release.exact_projection(table(spark, d, "orders"), "o_custkey", ["o_orderstatus"])


@_add("H34_flank_coverage", "SELECT o_orderkey AS k, 'missing' AS fault FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def coverage(spark: SparkSession, d: str) -> DataFrame:
    return release.coverage_faults(table(spark, d, "orders").select(F.col("o_orderkey").alias("k")), table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k")), "k")


@_add("I3_completeness", "SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS documents_without_chunks, (SELECT count(*) FROM labels WHERE quality = 0) AS chunks_without_embeddings")
def completeness(spark: SparkSession, d: str) -> DataFrame:
    lab = table(spark, d, "labels").select(F.col("doc_id").alias("document_id"), F.col("doc_id").alias("chunk_id"), "quality")
    return release.completeness(table(spark, d, "documents").select(F.col("doc_id").alias("document_id")), lab, lab.where("quality = 1"))


_CORPUS = """WITH d AS (SELECT o_orderkey AS document_id, o_orderstatus <> 'P' AS licensed FROM orders WHERE o_orderkey % 50 <> 0), c AS (SELECT l_orderkey AS document_id, l_orderkey * 10 + l_linenumber AS chunk_id FROM lineitem WHERE l_quantity > 5),
 e AS (SELECT l_orderkey * 10 + l_linenumber AS chunk_id FROM lineitem WHERE l_discount < 0.08), a AS (SELECT c_custkey AS document_id FROM customer)"""


@_add("I3_corpus_faults", f"""{_CORPUS} SELECT 'document_not_licensed' AS fault, count(*) AS n FROM d WHERE NOT licensed UNION ALL SELECT 'document_without_chunk', count(*) FROM d WHERE document_id NOT IN (SELECT document_id FROM c) UNION ALL SELECT 'chunk_without_document', count(*) FROM c WHERE document_id NOT IN (SELECT document_id FROM d)
 UNION ALL SELECT 'chunk_without_embedding', count(*) FROM c WHERE chunk_id NOT IN (SELECT chunk_id FROM e) UNION ALL SELECT 'chunk_with_several_embeddings', count(*) FROM c WHERE chunk_id IN (SELECT chunk_id FROM e GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'embedding_without_chunk', count(*) FROM e WHERE chunk_id NOT IN (SELECT chunk_id FROM c)
 UNION ALL SELECT 'anchor_without_document', count(*) FROM a WHERE document_id NOT IN (SELECT document_id FROM d)""")
def corpus_faults(spark: SparkSession, d: str) -> DataFrame:
    """Orders as documents, line items as chunks, some of each left out."""
    line, key = table(spark, d, "lineitem"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("chunk_id")
    documents = table(spark, d, "orders").where("o_orderkey % 50 <> 0").select(F.col("o_orderkey").alias("document_id"), (F.col("o_orderstatus") != "P").alias("licensed"))
    anchors = table(spark, d, "customer").select(F.col("c_custkey").alias("document_id"))
    return release.corpus_faults(documents, line.where("l_quantity > 5").select(F.col("l_orderkey").alias("document_id"), key), line.where("l_discount < 0.08").select(key), anchors)


@_add("I7_placement_in_sequence", "SELECT l_orderkey, l_linenumber FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE (l_linenumber - 1) * 1000 + l_quantity > s_suppkey % 7 * 1000 + 500")
def placements(spark: SparkSession, d: str) -> DataFrame:
    start = (F.col("l_linenumber") - 1) * 1000
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), "l_orderkey", "l_linenumber", start.alias("start0"), (start + F.col("l_quantity")).alias("end0"))
    return release.outside_sequence(rows, table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), (F.col("s_suppkey") % 7 * 1000 + 500).alias("length")), "k").select("l_orderkey", "l_linenumber")


@_add("X30_release_keys", "SELECT DISTINCT k, k LIKE '%-v1' AND try_strptime(regexp_extract(k, '-(\\d{8})-', 1), '%Y%m%d') IS NOT NULL AS ok FROM (SELECT 'pilot-' || (20240000 + o_orderkey % 1400) || CASE WHEN o_orderkey % 10 = 0 THEN '-x1' ELSE '-v1' END AS k FROM orders)")
def release_keys(spark: SparkSession, d: str) -> DataFrame:
    k = F.concat(F.lit("pilot-"), (20240000 + F.col("o_orderkey") % 1400).cast("string"), F.when(F.col("o_orderkey") % 10 == 0, "-x1").otherwise("-v1"))
    return table(spark, d, "orders").select(k.alias("k")).distinct().withColumn("ok", keys.is_release_key(F.col("k")))


@_add("X1_X2_stable_keys", """SELECT n_nationkey, 'nation:sha256:' || sha256('{"name":"' || n_name || '","region":' || n_regionkey || '}') AS key FROM nation""")
def stable_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select("n_nationkey", keys.stable_key("nation", name=F.col("n_name"), region=F.col("n_regionkey")).alias("key"))


@_add("S19_canonical_rows", """SELECT '{"r_name":"' || r_name || '","r_regionkey":' || r_regionkey || '}' AS json FROM region""")
def canonical_rows(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.sinks import canonical_rows as rows

    return rows(table(spark, d, "region"))


@_add("X32_X33_json_path", "SELECT event_id, CAST(props->>'k' AS BIGINT) AS k, coalesce(CAST(props->>'missing' AS BIGINT), -1) AS m FROM events")
def json_path(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.coalesce(F.get_json_object("props", "$.missing").cast("long"), F.lit(-1).cast("long")).alias("m"))


_FIVE = range(5)


@_add("J8_five_aliases", "SELECT n_name, " + ", ".join(f"p{i}.r_name AS r{i}" for i in _FIVE) + " FROM nation " + " ".join(f"JOIN region p{i} ON p{i}.r_regionkey = (n_regionkey + {i}) % 5" for i in _FIVE))
def five_aliases(spark: SparkSession, d: str) -> DataFrame:
    """One dimension under five names, as five policies of one release are looked up."""
    rows, region = table(spark, d, "nation"), table(spark, d, "region")
    for i in _FIVE:
        own = region.select(F.col("r_regionkey").alias(f"_k{i}"), F.col("r_name").alias(f"r{i}"))
        rows = rows.join(own, (F.col("n_regionkey") + i) % 5 == F.col(f"_k{i}"))
    return rows.select("n_name", *[f"r{i}" for i in _FIVE])


@_add("J8_policy_alias_join", "SELECT n.n_name, a.r_name AS r0, b.r_name AS r1 FROM nation n JOIN region a ON a.r_regionkey = n.n_regionkey JOIN region b ON b.r_regionkey = (n.n_regionkey + 1) % 5")
def alias_join(spark: SparkSession, d: str) -> DataFrame:
    n, a, b = table(spark, d, "nation").alias("n"), table(spark, d, "region").alias("a"), table(spark, d, "region").alias("b")
    return n.join(a, F.col("a.r_regionkey") == F.col("n.n_regionkey")).join(b, F.col("b.r_regionkey") == (F.col("n.n_regionkey") + 1) % 5).select("n_name", F.col("a.r_name").alias("r0"), F.col("b.r_name").alias("r1"))
