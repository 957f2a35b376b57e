"""Operator 13: spelling variants grouped by letter-parity bands.

1. Runs of Latin letters of every whole text, A-Z lower-cased. Where 97 divides the crc32 of ``<doc_id>:<run>``
   one code point of the run is left out. Words are the results of five code points and three occurrences or more.
2. A word's mask has one bit for each letter, set if the letter occurs an odd number of times. Its three bands are
   the bits of every third letter. An inserted or deleted letter flips one bit, a replaced one flips two.
3. So words that differ by a replaced letter have the same length and agree in one band at least, and words that
   differ by an inserted letter have lengths one apart and agree in two bands. Words meet by length and equal bands.
4. One edit also leaves the first or the last half of the shorter word whole. Buckets are split by that half, so a
   band value that a third of all words share is no single task, and few words of a bucket fail the later steps.
5. Pairs in a bucket stay if their masks differ in two bits at most and their edit distance is one. A pair that
   meets in several buckets counts in the first one only, so nothing is made distinct afterwards.
6. A word's form is its near word of most occurrences (ties: first in code-point order), if these are at least twice
   its own. Counts double with each step, so doubling pointers finds the roots in a few rounds.

All is DataFrame functions. Counting adds up within tasks; near words of one word are bounded by its length and the
alphabet. Every join of words is a merge join by hint: Spark sizes exploded rows of a compressed table far too low and
would broadcast all words. Defined cases: null and empty texts hold no run; a null id is the text ``null`` in the hashed string;
repeated rows count again; other columns are not read; very long texts and runs are taken whole; an empty table gives
an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, passing, table

RUN = r"[A-Za-zÀ-ÿ]+"
EVERY = 97
LEAST_LETTERS = 5
LEAST_COUNT = 3
#: Pairs of longer words are compared in one pass: an edit distance takes the square of their length.
LONG = 255
#: Letters dealt to the bands in this order, so that each band has frequent ones.
LETTERS = "etaoinshrdlcumwfgypbvkjxqz" + "".join(map(chr, range(0xC0, 0x100)))
BANDS = 3
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lower_ascii(run: Column) -> Column:
    return F.when(F.octet_length(run) == F.length(run), F.lower(run)).otherwise(F.translate(run, _UPPER, _LOWER))


def runs(docs: DataFrame) -> DataFrame:
    """``doc_id, run`` (lower-cased) for every run of every text."""
    found = F.regexp_extract_all(F.col("text").cast("string"), F.lit(RUN), F.lit(0))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("null")).alias("doc_id"), F.explode(found).alias("run"))
    return rows.select("doc_id", _lower_ascii(F.col("run")).alias("run"))


def words(docs: DataFrame) -> DataFrame:
    """``word, n``: the words with their occurrences."""
    run = F.col("run")
    h = F.crc32(F.concat("doc_id", F.lit(":"), run).cast("binary"))
    cut = (h % F.length(run)).cast("int")
    short = F.concat(F.substring(run, F.lit(1), cut), F.substring(run, cut + 2, F.length(run)))
    made = runs(docs).select(F.when(h % EVERY == 0, short).otherwise(run).alias("word"))
    return made.where(F.length("word") >= LEAST_LETTERS).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _band(word: Column, band: int) -> Column:
    """Parities of the band's letters: one bit a letter, set if the word holds it an odd number of times."""
    own = LETTERS[band::BANDS]
    odd = [F.shiftleft((F.length(word) - F.length(F.replace(word, F.lit(c)))) % 2, i) for i, c in enumerate(own)]
    return reduce(lambda a, b: a.bitwiseOR(b), odd)


def _rows(words_: DataFrame, shorter: Column, longer: bool, keys: list[list[int]]) -> DataFrame:
    """One row a word, key and half: ``key``, ``at`` (which key and half) and the word's own columns.

    ``shorter``: length of the shorter word of the pairs sought; ``longer``: the row stands for the longer one."""
    half = F.floor(shorter / 2).cast("int")
    halves = [F.substring(F.col("word"), F.lit(1), half), F.substring(F.col("word"), half + (2 if longer else 1), F.length("word"))]
    made = []
    for k, bands in enumerate(keys):
        for side, part in enumerate(halves):
            at = 2 * k + side
            made.append(F.struct(F.xxhash64(F.lit(at), shorter, *[F.col(f"b{b}") for b in bands], part).alias("key"), F.lit(at).cast("byte").alias("at")))
    return words_.select("word", "n", *[f"b{b}" for b in range(BANDS)], F.explode(F.array(*made)).alias("_k")).select("_k.key", "_k.at", "word", "n", *[f"b{b}" for b in range(BANDS)])


def _flips(band: int) -> Column:
    return F.bit_count(F.col(f"x.b{band}").bitwiseXOR(F.col(f"y.b{band}")))


def _one_edit(a: Column, b: Column) -> Column:
    """Whether ``b``, of the length of ``a`` or one more, equals it after one edit: all behind the first difference agrees."""
    at = F.array_position(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: ~x.eqNullSafe(y)), True).cast("int")
    rest = at + F.when(F.length(a) == F.length(b), 1).otherwise(0)
    return (at > 0) & (F.substring(a, rest, F.length(a)) == F.substring(b, at + 1, F.length(b)))


def _pairs(left: DataFrame, right: DataFrame, first: Column, flips: int, long: bool) -> DataFrame:
    """``a, an, b, bn``: verified pairs of rows with one key; ``first``: the key is the pair's first one; ``long``: those
    whose shorter word is longer than ``LONG``, else the others."""
    half = F.floor(F.length("x.word") / 2).cast("int")
    front = F.substring(F.col("x.word"), F.lit(1), half) == F.substring(F.col("y.word"), F.lit(1), half)
    meets = (F.col("x.key") == F.col("y.key")) & (F.col("x.at") == F.col("y.at")) & first
    meets = meets & (sum((_flips(b) for b in range(BANDS)), F.lit(0)) <= flips) & ((F.col("x.at") % 2 == 0) | ~front)
    meets = meets & ((F.length("x.word") > LONG) if long else (F.length("x.word") <= LONG))
    near = _one_edit(F.col("x.word"), F.col("y.word")) if long else F.levenshtein(F.col("x.word"), F.col("y.word"), 1) == 1
    met = left.alias("x").hint("merge").join(right.alias("y").hint("merge"), F.when(meets, near).otherwise(False) & (F.col("x.key") == F.col("y.key")) & (F.col("x.at") == F.col("y.at")))
    return met.select(F.col("x.word").alias("a"), F.col("x.n").alias("an"), F.col("y.word").alias("b"), F.col("y.n").alias("bn"))


def near_pairs(words_: DataFrame) -> DataFrame:
    """``a, an, b, bn``: every pair of words one edit apart, once. ``words_``: distinct ``word`` with ``n``."""
    masked = durable(words_.select("word", "n", *[_band(F.col("word"), b).alias(f"b{b}") for b in range(BANDS)]), "spelling-masks")
    size = F.length("word")
    unequal = [F.lit(True)]
    for b in range(BANDS - 1):
        unequal.append(unequal[-1] & (F.col(f"x.b{b}") != F.col(f"y.b{b}")))
    own = F.floor(F.col("x.at") / 2)
    first = reduce(lambda a, b: a | b, [(own == b) & unequal[b] for b in range(BANDS)])
    others = [[b for b in range(BANDS) if b != changed] for changed in range(BANDS)]
    changed = reduce(lambda a, b: a | b, [(own == b) & (_flips(b) == 1) for b in range(BANDS)])
    found = []
    for long in (False, True):
        part = masked.where(size > LONG if long else size <= LONG + 1)
        if long and part.isEmpty():
            continue
        same = _rows(part, size, False, [[b] for b in range(BANDS)])
        found.append(_pairs(same, same, (F.col("x.word") < F.col("y.word")) & first, 2, long))
        found.append(_pairs(_rows(part, size, False, others), _rows(part.where(size > LEAST_LETTERS), size - 1, True, others), changed, 1, long))
    return reduce(DataFrame.unionAll, found)


def forms(words_: DataFrame) -> DataFrame:
    """``word, n, n_near, form, form_n`` of every word."""
    pairs = near_pairs(words_)
    both = pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("bn").alias("an"), F.col("a").alias("b"), F.col("an").alias("bn")))
    best = F.min(F.struct((-F.col("bn")).alias("less"), F.col("b").alias("form")))
    near = both.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), best.alias("best"))
    top = -F.col("best.less")
    found = words_.hint("merge").join(near, "word", "left")
    well = top >= 2 * F.col("n")
    return found.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(well, F.col("best.form")).alias("form"), F.when(well, top).alias("form_n"))


def roots(formed: DataFrame) -> DataFrame:
    """``word, root`` of the words with a form: each round doubles the steps that a pointer stands for."""
    now = durable(formed.where("form is not null").select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        stepped = now.alias("x").hint("merge").join(now.alias("y"), F.col("x.root") == F.col("y.word"), "left")
        nxt = durable(stepped.select(F.col("x.word").alias("word"), F.coalesce("y.root", "x.root").alias("root"), F.col("y.root").isNotNull().alias("moved")), "spelling-roots")
        moved = nxt.agg(F.max("moved")).first()[0]
        now = nxt.drop("moved")
        if not moved:
            return now


def group(docs: DataFrame) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of ``docs``."""
    with passing(docs.sparkSession, "spelling-forms", "spelling-last"):
        counted = durable(words(docs), "spelling-words")
        formed = durable(forms(counted), "spelling-forms")
        ends = durable(roots(formed), "spelling-last")
    out = formed.hint("merge").join(ends, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group(table(spark, sf_dir, "documents"))


#: The same rows in DuckDB. crc32 runs byte by byte over the distinct strings; near words are found by their deletions:
#: two words one edit apart share a result of deleting one code point at one place, or one is such a result of the other.
SQL = f"""WITH RECURSIVE found AS (SELECT coalesce(doc_id::VARCHAR, 'null') AS id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), '{_UPPER}', '{_LOWER}') AS run FROM documents),
runs AS (SELECT id || ':' || run AS s, run, count(*) AS c FROM found GROUP BY id, run),
step0 AS (SELECT range::BIGINT AS i, range::BIGINT AS v FROM range(256)),
crc_table AS (SELECT i, list_reduce(list_prepend(i, range(8)), lambda v, k: CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END) AS v FROM step0),
tab AS (SELECT list(v ORDER BY i) AS t FROM crc_table),
hashed AS (SELECT run, c, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, octet_length(encode(s)) * 2, 2), lambda p: ('0x' || substr(hex(encode(s)), p + 1, 2))::BIGINT)), lambda v, b: xor(v >> 8, t[(xor(v, b) & 255) + 1])), 4294967295::BIGINT) AS h FROM runs, tab),
made AS (SELECT CASE WHEN h % {EVERY} = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, c FROM hashed),
words AS (SELECT word, sum(c)::BIGINT AS n FROM made WHERE length(word) >= {LEAST_LETTERS} GROUP BY word HAVING sum(c) >= {LEAST_COUNT}),
cuts AS (SELECT word, n, i AS at, word[:i] || word[i + 2:] AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
near AS (SELECT a.word AS a, b.word AS b, b.n AS bn FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.at = b.at AND a.word <> b.word
 UNION SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.rest = b.word UNION SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.rest = b.word),
best AS (SELECT a AS word, count(*) AS n_near, max(bn) AS top FROM near GROUP BY a),
tops AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 2 * w.n THEN top END AS form_n FROM words w LEFT JOIN best USING (word)),
formed AS (SELECT t.*, (SELECT min(encode(b)) FROM near x WHERE x.a = t.word AND x.bn = t.form_n) AS form FROM tops t),
named AS (SELECT word, n, n_near, form_n, decode(form) AS form FROM formed),
walk AS (SELECT word, word AS root FROM named UNION ALL SELECT w.word, f.form FROM walk w JOIN named f ON f.word = w.root WHERE f.form IS NOT NULL),
ends AS (SELECT w.word, w.root FROM walk w JOIN named f ON f.word = w.root WHERE f.form IS NULL)
SELECT n.word, n.form, e.root, n.n, n.n_near, n.form_n FROM named n JOIN ends e USING (word)"""
