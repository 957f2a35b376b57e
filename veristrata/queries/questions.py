"""Whole tables of questions: lexical plans, objects by clause, routes and controlled-English plans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import question_tables as q
from ..plans.language import Entry
from .mapping import table

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {}


def _add(name: str, sql: str):
    def keep(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn, sql
        return fn

    return keep


#: A question about each part. Small parts name a taxon before a word for a kind of thing, the others a name of two
#: words; some name an acronym that stands for a kind of thing; the largest name no entity, or nothing at all.
_NAMED = """SELECT p_partkey, p_size, p_name, p_type, upper(left(p_name, 1)) || substr(p_name, 2) AS title, split_part(p_name, ' ', 1) AS color,
 CASE WHEN p_size BETWEEN 10 AND 20 THEN 'DNA' ELSE p_type END AS acronym, 'AB_' || lpad(CAST(p_partkey AS VARCHAR(20)), 6, '0') || '.' || CAST(p_size AS VARCHAR(20)) AS accession FROM part"""
_ASKED = f"""SELECT *, CASE WHEN p_size = 50 THEN 'Which of these are reported?' WHEN p_size > 45 THEN 'Which ' || p_name || ' are ' || lower(p_type) || ' or reported in version 3.1?'
 WHEN p_size < 10 THEN 'Show ' || upper(left(p_name, 1)) || substr(color, 2) || 'idae loci with ' || acronym || ', the length of ' || lower(accession) || ' (a, b) and its 7q21.2 band'
 ELSE 'Compare ' || title || ' with ' || acronym || '; the length of ' || accession || ' (a, b) and its 7q21.2 band' END AS question FROM ({_NAMED})"""
#: What the rules find in it: the words of each name, sorted.
_FOUND = f"""SELECT *, CASE WHEN p_size < 10 THEN 'entity:' || color || 'idae' ELSE 'entity:' || array_to_string(list_sort(string_split(p_name, ' ')), ' ') END AS subject,
 CASE WHEN acronym = 'DNA' THEN NULL ELSE 'entity:' || lower(acronym) END AS other, 'accession:' || accession AS identifier FROM ({_ASKED})"""


def _questions(spark: SparkSession, d: str) -> DataFrame:
    table(spark, d, "part").createOrReplaceTempView("_question_parts")
    return spark.sql(_ASKED.replace("FROM part", "FROM _question_parts"))


@_add("H7_question_plans", f"""SELECT p_partkey, CASE WHEN p_size = 50 THEN 'no_usable_terms' ELSE 'ready' END AS status,
 CASE WHEN p_size = 50 THEN '' WHEN p_size > 45 THEN 'topic:' || array_to_string(list_sort(list_distinct(list_append(string_split(p_name, ' '), lower(p_type)))), ' ')
 ELSE identifier || ',' || array_to_string(list_sort(list_filter([subject, other], lambda x: x IS NOT NULL)), ',') END AS "groups",
 CASE WHEN p_size = 50 THEN 'no_usable_terms' WHEN p_size > 45 THEN 'topic_keyword_fallback' ELSE '' END AS warnings FROM ({_FOUND})""")  # fmt: skip
def plans(spark: SparkSession, d: str) -> DataFrame:
    """Every question's plan, or why it has none."""
    found = q.plan_questions(_questions(spark, d), "question")
    return found.select("p_partkey", "status", F.array_join("groups", ",").alias("groups"), F.array_join("warnings", ",").alias("warnings"))


@_add("H8_question_objects", f"""SELECT p_partkey, object, "groups", context, code FROM (
 SELECT p_partkey, CAST(NULL AS INT) AS object, '' AS "groups", '' AS context, 'no_usable_terms' AS code FROM ({_FOUND}) WHERE p_size = 50
 UNION ALL SELECT p_partkey, 0, 'topic:' || array_to_string(list_sort(list_distinct(list_append(string_split(p_name, ' '), lower(p_type)))), ' '), '', NULL FROM ({_FOUND}) WHERE p_size BETWEEN 46 AND 49
 UNION ALL SELECT p_partkey, 0, array_to_string(list_sort(list_filter([subject, other], lambda x: x IS NOT NULL)), ','), array_to_string(list_filter([CASE WHEN acronym = 'DNA' THEN 'dna' END, CASE WHEN p_size < 10 THEN 'loci' END], lambda x: x IS NOT NULL), ','), NULL FROM ({_FOUND}) WHERE p_size <= 45
 UNION ALL SELECT p_partkey, 1, identifier, 'b,length', NULL FROM ({_FOUND}) WHERE p_size <= 45)""")  # fmt: skip
def objects(spark: SparkSession, d: str) -> DataFrame:
    """The objects of every question's clauses. The last clause names nothing, so its words belong to no object."""
    found = q.object_questions(_questions(spark, d), "question")
    return found.select("p_partkey", "object", F.array_join("groups", ",").alias("groups"), F.array_join("context", ",").alias("context"), "code")


#: A request by every customer: its segment and balance choose the sentence, its nation is the name in it.
_REQUEST = """SELECT c_custkey, c_mktsegment AS segment, c_acctbal AS balance, n_name AS nation, c_name AS name,
 CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'List loci assigned to source lineage ' || n_name || CASE WHEN c_acctbal < 2000 THEN '' ELSE ' including descendants' END
 WHEN 'BUILDING' THEN CASE WHEN c_acctbal < 2000 THEN 'List loci in this release' ELSE 'List all loci in this release.' END
 WHEN 'MACHINERY' THEN 'Explain the literature evidence for ' || c_name
 WHEN 'FURNITURE' THEN 'Count distinct contigs assigned exactly to source lineage ' || CASE WHEN c_acctbal < 2000 THEN c_name ELSE lower(n_name) END
 ELSE CASE WHEN c_acctbal < 2000 THEN 'Upload a sequence of ' || n_name ELSE 'Count detection calls in this release and explain the literature evidence' END END AS question FROM customer JOIN nation ON c_nationkey = n_nationkey"""


def _requests(spark: SparkSession, d: str) -> DataFrame:
    for name in ("customer", "nation"):
        table(spark, d, name).createOrReplaceTempView(f"_question_{name}")
    return spark.sql(_REQUEST.replace("FROM customer JOIN nation", "FROM _question_customer JOIN _question_nation"))


@_add("H19_question_routes", f"""SELECT c_custkey, CASE WHEN segment = 'MACHINERY' THEN 'literature' WHEN segment <> 'AUTOMOBILE' THEN 'structured' WHEN balance < 2000 THEN 'refused' ELSE 'hybrid' END AS route,
 CASE WHEN segment = 'MACHINERY' THEN name WHEN segment <> 'AUTOMOBILE' THEN question WHEN balance >= 2000 THEN 'Count detection calls in this release' END AS clause,
 CASE WHEN segment = 'AUTOMOBILE' AND balance < 2000 THEN 'forbidden_topic' END AS code FROM ({_REQUEST})""")  # fmt: skip
def routes(spark: SparkSession, d: str) -> DataFrame:
    """Where every request goes, with the clause to search for, or why it is refused."""
    return q.route_questions(_requests(spark, d), "question").select("c_custkey", "route", "clause", "code")


@_add("H20_question_parses", f"""SELECT c_custkey, CASE WHEN code IS NULL THEN CASE segment WHEN 'FURNITURE' THEN 'aggregate' ELSE 'list_loci' END END AS intent,
 CASE WHEN code IS NULL AND segment <> 'BUILDING' THEN 'LineageFilter' ELSE '' END AS filters, CASE WHEN code IS NULL AND segment = 'FURNITURE' THEN 'distinct_contig_count' END AS metric, code
 FROM (SELECT *, CASE WHEN segment = 'HOUSEHOLD' AND balance < 2000 THEN 'lineage_scope_missing' WHEN segment = 'BUILDING' AND balance < 2000 THEN 'scope_not_explicit' WHEN segment = 'MACHINERY' THEN 'unsupported_question'
  WHEN segment = 'FURNITURE' AND balance < 2000 THEN 'unresolved_entity' WHEN segment = 'AUTOMOBILE' THEN CASE WHEN balance < 2000 THEN 'unsupported_question' ELSE 'unsupported_filter' END END AS code FROM ({_REQUEST}))""")  # fmt: skip
def parses(spark: SparkSession, d: str) -> DataFrame:
    """The controlled-English plan of every request; the nations are the names that it may use (a fixed, short list)."""
    names = [Entry("lineage", f"n{r.n_nationkey}", r.n_name, f"n{r.n_nationkey}") for r in table(spark, d, "nation").collect()]
    found = q.parse_questions(_requests(spark, d), "question", "F", names)
    return found.select("c_custkey", "intent", F.array_join("filters", ",").alias("filters"), "metric", "code")
