"""Identities, timestamps, names, locators, anchor targets and claims of whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys, providers, scalar
from ..operators import facts, ranking, release
from ..sources import scans, sinks
from .mapping import table

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {}


def _add(name: str, sql: str):
    def keep(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn, sql
        return fn

    return keep


@_add("X4_canonical_digest", "SELECT doc_id, sha256(nfc_normalize(text || 'e' || chr(769))) AS digest FROM documents")
def canonical(spark: SparkSession, d: str) -> DataFrame:
    """Digests of texts in their NFC form; each ends in a letter with a combining mark."""
    return table(spark, d, "documents").select("doc_id", keys.text_digest(F.concat("text", F.lit("é"))).alias("digest"))


@_add("X6_question_digests", """SELECT c_custkey, sha256('{"anchors":[' || array_to_string(list_sort(['{"key":"' || c_name || '","kind":"assembly"}', '{"key":"' || n_name || '","kind":"lineage"}', '{"key":"' || c_mktsegment || '","kind":"method"}']), ',') || '],"question":"List ' || lower(c_mktsegment) || ' of ' || n_name || '"}') AS digest FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def questions(spark: SparkSession, d: str) -> DataFrame:
    """A digest of every question with its anchors, whatever their order."""
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    anchor = lambda key, kind: F.struct(key.alias("key"), F.lit(kind).alias("kind"))
    anchors = F.array(anchor(F.col("n_name"), "lineage"), anchor(F.col("c_mktsegment"), "method"), anchor(F.col("c_name"), "assembly"))
    return rows.select("c_custkey", keys.question_digest(F.concat(F.lit("List "), F.lower("c_mktsegment"), F.lit(" of "), "n_name"), anchors).alias("digest"))


_WORD = "('0x' || h[{0} + 7:{0} + 8] || h[{0} + 5:{0} + 6] || h[{0} + 3:{0} + 4] || h[{0} + 1:{0} + 2])::BIGINT"


@_add("X9_hashed_vectors", f"""SELECT item_id, k, round(CAST(CAST(v / norm AS FLOAT) AS DOUBLE), 5) AS v FROM (SELECT item_id, unnest(range(384)) AS k, unnest(vs) AS v, sqrt(list_sum([x * x FOR x IN vs])) AS norm FROM (SELECT item_id, list_transform(range(384), lambda k: {_WORD.format('k * 8')} / 2147483648.0::DOUBLE - 1) AS vs
 FROM (SELECT item_id, array_to_string([sha256(i || ':' || text) FOR i IN range(48)], '') AS h FROM benchmark)))""")
def hashed(spark: SparkSession, d: str) -> DataFrame:
    """The repeatable vectors of texts, component by component."""
    rows = table(spark, d, "benchmark").select("item_id", F.posexplode(keys.hashed_vector("text")).alias("k", "v"))
    return rows.select("item_id", F.col("k").cast("long").alias("k"), F.round(F.col("v").cast("double"), 5).alias("v"))


@_add("X11_normal_names", "SELECT p_partkey, lower(p_name || ' ' || p_type) AS name FROM part")
def names(spark: SparkSession, d: str) -> DataFrame:
    """Names without regard to case and white space: wide blanks and full-width letters are made plain."""
    wide = F.concat(F.lit("  "), F.upper("p_name"), F.lit(" \t　"), F.translate("p_type", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "".join(chr(0xFF21 + i) for i in range(26))))
    return table(spark, d, "part").select("p_partkey", scalar.normal_name(wide).alias("name"))


_STAMPS = """SELECT event_id, CASE event_type WHEN 'click' THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z' WHEN 'view' THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z' WHEN 'error' THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 'purchase' THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' ELSE strftime(ts, '%Y-13-%dT%H:%M:%S') || 'Z' END AS t, ts, event_type FROM events"""


@_add("X29_utc_timestamps", f"SELECT event_id, CASE event_type WHEN 'click' THEN CAST(floor(epoch(ts)) AS BIGINT) * 1000000 WHEN 'view' THEN epoch_us(ts) END AS us FROM ({_STAMPS})")
def stamps(spark: SparkSession, d: str) -> DataFrame:
    """Event times as texts: those in UTC with a Z are read, those with an offset, a blank or a thirteenth month are not."""
    form = lambda f: F.date_format("ts", f)
    kind = F.col("event_type")
    text = (
        F.when(kind == "click", form("yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(kind == "view", form("yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
        .when(kind == "error", form("yyyy-MM-dd HH:mm:ss"))
        .when(kind == "purchase", form("yyyy-MM-dd'T'HH:mm:ss'+00:00'"))
        .otherwise(form("yyyy-'13'-dd'T'HH:mm:ss'Z'"))
    )
    return table(spark, d, "events").select("event_id", F.unix_micros(scalar.utc_timestamp(text).cast("timestamp")).alias("us"))


@_add("X31_accessions", r"SELECT p_partkey, regexp_full_match(a, 'GC[AF]_[0-9]{9}\.[1-9][0-9]*') AS assembly, regexp_full_match(b, '[A-Z]{1,6}_?[0-9]{5,}\.[1-9][0-9]*') AS contig FROM (SELECT p_partkey, 'GCA_' || lpad(CAST(p_partkey AS VARCHAR), CASE WHEN p_size < 25 THEN 9 ELSE 8 END, '0') || '.' || p_size % 3 AS a, p_type || '_' || lpad(CAST(p_partkey AS VARCHAR), 5, '0') || CASE WHEN p_size > 40 THEN '' ELSE '.7' END AS b FROM part)")
def accessions(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("p_partkey").cast("string")
    a = F.concat(F.lit("GCA_"), F.when(F.col("p_size") < 25, F.lpad(key, 9, "0")).otherwise(F.lpad(key, 8, "0")), F.lit("."), (F.col("p_size") % 3).cast("string"))
    b = F.concat("p_type", F.lit("_"), F.lpad(key, 5, "0"), F.when(F.col("p_size") > 40, "").otherwise(".7"))
    return table(spark, d, "part").select("p_partkey", keys.is_accession(a, keys.ASSEMBLY_ACCESSION).alias("assembly"), keys.is_accession(b, keys.CONTIG_ACCESSION).alias("contig"))


@_add("X35_unresolved_locators", "SELECT o_orderkey AS k, o_custkey % 8 AS line FROM orders LEFT JOIN (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL) ON l_orderkey = o_orderkey AND l_linenumber = o_custkey % 8 WHERE coalesce(n, 0) <> 1")
def locators(spark: SparkSession, d: str) -> DataFrame:
    """Locators into items by order and line that name none, or several."""
    asked = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 8).alias("line"))
    blocks = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("long").alias("line"))
    return release.unresolved_locators(asked, blocks, ["k", "line"]).select("k", "line")


@_add("X41_sealed_rows", "SELECT s_suppkey FROM supplier WHERE s_acctbal < 1000")
def sealed(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers that were sealed with a digest of their fields; the name of the poor ones changed afterwards."""
    rows = table(spark, d, "supplier")
    own = rows.withColumn("record_sha256", F.sha2(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}), 256))
    changed = own.withColumn("s_name", F.when(F.col("s_acctbal") < 1000, F.concat("s_name", F.lit("!"))).otherwise(F.col("s_name")))
    return release.sealed_faults(changed).select("s_suppkey")


_NAMED = """SELECT o_custkey AS q, 1 AS o, CAST(o_orderkey AS VARCHAR) AS k1, NULL AS k2, 'locus' AS kind FROM orders UNION SELECT o_custkey, 2, 'a' || o_custkey, NULL, 'assembly' FROM orders UNION SELECT o_custkey, 3, o_orderstatus, o_orderpriority, 'lineage' FROM orders
 UNION SELECT o_custkey, 4, 'm' || l_suppkey, CAST(l_linenumber AS VARCHAR), 'method' FROM orders JOIN lineitem ON l_orderkey = o_orderkey"""


@_add("H4_anchor_targets", f"SELECT q, CASE WHEN count(*) > 64 THEN '' ELSE array_to_string(list(kind || ':' || k1 || coalesce(':' || k2, '') ORDER BY o, k1, k2 NULLS FIRST), ',') END AS targets, CASE WHEN count(*) > 64 THEN 'too_many_anchor_targets' ELSE 'ready' END AS status FROM ({_NAMED}) GROUP BY q")
def targets(spark: SparkSession, d: str) -> DataFrame:
    """Every customer's orders, states and suppliers as targets; those with too many are refused."""
    orders, line = table(spark, d, "orders"), table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey", "l_linenumber")
    none = F.lit(None).cast("string")
    row = lambda df, kind, k1, k2=none: df.select(F.col("o_custkey").alias("q"), F.lit(kind).alias("kind"), k1.cast("string").alias("k1"), k2.cast("string").alias("k2"))
    rows = row(orders, "locus", F.col("o_orderkey")).unionByName(row(orders, "assembly", F.concat(F.lit("a"), "o_custkey"))).unionByName(row(orders, "lineage", F.col("o_orderstatus"), F.col("o_orderpriority")))
    rows = rows.unionByName(row(orders.join(line, "o_orderkey"), "method", F.concat(F.lit("m"), "l_suppkey"), F.col("l_linenumber")))
    return facts.anchor_targets(rows, "q").select("q", F.array_join("targets", ",").alias("targets"), "status")


#: A claim about each order, with a quote from its customer's record: some claims name another value, some quotes are
#: altered, some cite nobody, some hold a marker.
_CLAIMS = """SELECT o_orderkey AS claim_id, CASE WHEN o_totalprice < 100000 THEN o_custkey + 100000000 ELSE o_custkey END AS document, 'AB_' || lpad(CAST(c_custkey AS VARCHAR(20)), 6, '0') || '.1 holds ' || CAST(c_nationkey AS VARCHAR(20)) || '.5 units' AS quote,
 'ab_' || lpad(CAST(c_custkey AS VARCHAR(20)), 6, '0') || '.1 has ' || CAST(CASE WHEN o_orderstatus = 'P' THEN c_nationkey + 100 ELSE c_nationkey END AS VARCHAR(20)) || '.5 units' || CASE WHEN o_orderpriority LIKE '1%' THEN ' [D1]' ELSE '' END AS claim, o_orderpriority LIKE '2%' AS altered, o_totalprice < 100000 AS lost, o_orderstatus = 'P' AS off, o_orderpriority LIKE '1%' AS marked, c_nationkey FROM orders JOIN customer ON c_custkey = o_custkey"""


@_add("X38_claim_provenance", f"""SELECT claim_id, array_to_string(list_filter([CASE WHEN lost THEN 'unknown_citation:' || document WHEN altered THEN 'quote_not_contained:' || document END, CASE WHEN off THEN 'unsupported_value:' || (c_nationkey + 100) || '.5' END, CASE WHEN marked THEN 'citation_marker' END], lambda x: x IS NOT NULL), ',') AS faults FROM ({_CLAIMS})""")
def claims(spark: SparkSession, d: str) -> DataFrame:
    """Every claim's quote against the record that it cites, and its identifier and number against the quote."""
    for name in ("orders", "customer"):
        table(spark, d, name).createOrReplaceTempView(f"_claim_{name}")
    rows = spark.sql(_CLAIMS.replace("FROM orders JOIN customer", "FROM _claim_orders JOIN _claim_customer"))
    key = F.col("c_custkey").cast("string")
    record = F.concat(F.lit("Record of "), "c_name", F.lit(": AB_"), F.lpad(key, 6, "0"), F.lit(".1 holds "), F.col("c_nationkey").cast("string"), F.lit(".5 units."))
    evidence = table(spark, d, "customer").select(key.alias("document"), record.alias("text"))
    quotes = rows.select("claim_id", F.col("document").cast("string").alias("document"), F.when(F.col("altered"), F.concat("quote", F.lit(" or so"))).otherwise(F.col("quote")).alias("quote"))
    found = ranking.claim_provenance(rows.select("claim_id", "claim"), quotes, evidence)
    return found.select("claim_id", F.array_join("faults", ",").alias("faults"))


_ARTICLE = """SELECT n_nationkey, '# ' || n_name || chr(10) || chr(10) || '## Abstract' || chr(10) || 'Nation ' || n_nationkey || chr(10) || 'of region ' || n_regionkey || chr(10) || chr(10) || '## Parts' || chr(10) || '- region ' || n_regionkey || chr(10) || '  > quoted' || chr(10) || '  - key' || chr(10) || '    ' || n_nationkey || chr(10) || '    ```' || chr(10) || '    - no item' || chr(10) || '    ```' || chr(10) || chr(10) || '| a | b |' || chr(10) || '|---|---|' || chr(10) || '| ' || n_name || ' | ' || n_regionkey || ' |' || chr(10) || chr(10) || '> Table 1 of ' || n_name AS text FROM nation"""


@_add("S8_markdown_blocks", """SELECT n_nationkey, CAST(unnest(range(6)) AS INT) AS block_index, unnest(['title', 'abstract', 'list_item', 'list_item', 'table', 'table_caption']) AS block_type, unnest(['', 'Abstract', 'Parts', 'Parts', 'Parts', 'Parts']) AS path,
 unnest([n_name, 'Nation ' || n_nationkey || ' of region ' || n_regionkey, 'region ' || n_regionkey, 'key ' || n_nationkey, 'a | b | ' || n_name || ' | ' || n_regionkey, 'Table 1 of ' || n_name]) AS text, unnest([1, 4, 8, 10, 16, 20]) AS first_line FROM nation""")
def markdown(spark: SparkSession, d: str) -> DataFrame:
    """Articles with a quote, an item and a fence inside an item, a table and a caption in a quote."""
    table(spark, d, "nation").createOrReplaceTempView("_article_nation")
    docs = spark.sql(_ARTICLE.replace("FROM nation", "FROM _article_nation"))
    found = scans.parse_blocks(docs, "commonmark")
    return found.select("n_nationkey", "block_index", "block_type", F.array_join("section_path", ">").alias("path"), "text", "first_line")


@_add("S10_jats_blocks", "SELECT n_nationkey, CAST(unnest(range(5)) AS INT) AS block_index, unnest(['title', 'abstract', 'heading', 'paragraph', 'list_item']) AS block_type, unnest(['', 'Abstract', 'Region ' || n_regionkey, 'Region ' || n_regionkey, 'Region ' || n_regionkey]) AS path, unnest([n_name, 'Nation ' || n_nationkey, 'Region ' || n_regionkey, n_name || ' & more', 'item ' || n_nationkey]) AS text FROM nation")
def jats(spark: SparkSession, d: str) -> DataFrame:
    key, part = F.col("n_nationkey").cast("string"), F.col("n_regionkey").cast("string")
    xml = F.concat(F.lit("<article><front><article-title>"), "n_name", F.lit("</article-title><abstract><p>Nation "), key, F.lit("</p></abstract></front><body><sec><title>Region "), part, F.lit("</title><p>"), "n_name", F.lit(" &amp; more</p><list><list-item><p>item "), key, F.lit("</p></list-item></list></sec></body></article>"))
    found = scans.parse_blocks(table(spark, d, "nation").select("n_nationkey", xml.alias("text")), "jats")
    return found.select("n_nationkey", "block_index", "block_type", F.array_join("section_path", ">").alias("path"), "text")


@_add("S20_markdown_lines", r"SELECT p_partkey, '| ' || p_partkey || ' | ' || replace(p_name, ' ', '\|') || ' | ' || CASE WHEN p_size > 25 THEN '' ELSE p_brand || '\\x' END || ' |' AS line FROM part")
def lines(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select("p_partkey", F.replace("p_name", F.lit(" "), F.lit("|")).alias("name"), F.when(F.col("p_size") <= 25, F.concat("p_brand", F.lit("\\x"))).alias("brand"))
    return sinks.markdown_lines(rows).select("p_partkey", "line")


def _closeness():
    """A scorer that needs no model: texts of like length are close."""
    return lambda pairs: [100.0 - abs(len(a) - len(b)) for a, b in pairs]


_POOL = "SELECT o_custkey % 25 AS q, o_custkey, o_orderkey AS k, CASE o_orderstatus WHEN 'F' THEN 1 ELSE 2 END AS tier, row_number() OVER (PARTITION BY o_custkey % 25 ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders"


@_add("H6_reranked_pool", f"SELECT q, k, tier, rank_before, score, row_number() OVER (PARTITION BY q ORDER BY tier, score DESC, rank_before, k) AS rank FROM (SELECT q, k, tier, rank AS rank_before, (100 - abs(length(n_name) - length(c_mktsegment)))::DOUBLE AS score FROM ({_POOL}) p JOIN nation ON n_nationkey = q JOIN customer ON c_custkey = p.o_custkey WHERE rank <= 50)")
def reranked(spark: SparkSession, d: str) -> DataFrame:
    """Pools of fifty candidates a question, scored by a reranker (question and passage) within their tiers."""
    orders = table(spark, d, "orders").select((F.col("o_custkey") % 25).alias("q"), F.col("o_orderkey").alias("k"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(2).alias("tier"), "o_totalprice", "o_custkey")
    pool = ranking.ranked(orders, [F.desc("o_totalprice"), F.col("k")], ["q"]).where("rank <= 50").drop("o_totalprice")
    texts = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    asked = table(spark, d, "nation").select(F.col("n_nationkey").alias("q"), "n_name")
    scored = pool.join(asked, "q").join(texts, "o_custkey").withColumn("score", providers.reranker(_closeness)(F.col("n_name"), F.col("c_mktsegment")))
    return ranking.rerank(scored.select("q", "k", "tier", "rank", "score"), ["q"], "k", "score")
