"""Top-k branches, reciprocal-rank fusion, tiers, reranking and round-robin merges."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator, Sequence
from functools import partial, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import RRF_K, dot, rrf_score
from ..session import workers_import

DEPTH = 100


def dense_top(rows: DataFrame, query: Sequence[float], key: str, vector: str, depth: int = DEPTH, places: int = 9) -> DataFrame:
    """Exact cosine top-k of one query over unit vectors, ties by key (take-ordered, no full sort)."""
    target = F.array(*[F.lit(float(v)) for v in query])
    scored = rows.select(key, F.round(dot(F.col(vector), target), places).alias("score"))
    return ranked(scored.orderBy(F.desc("score"), key).limit(depth), [F.desc("score"), F.col(key)])


def ranked(rows: DataFrame, order: list[Column], by: list[str] | None = None) -> DataFrame:
    """Adds ``rank`` from 1. Without ``by`` the rows are a bounded list already."""
    window = Window.partitionBy(*(by or [F.lit(0)])).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(window))


#: Questions that one broadcast may hold.
QUESTIONS = 1000


def dense_batch(queries: DataFrame, rows: DataFrame, key: str, depth: int = DEPTH, places: int = 9) -> DataFrame:
    """Exact top-k for a table of queries (``query_id, q``) over ``key, v`` in one job: the queries go to all
    tasks if they are ``QUESTIONS`` at most, else both sides meet in blocks."""
    if queries.limit(QUESTIONS + 1).count() > QUESTIONS:
        return dense_blocks(queries, rows, key, depth, places)
    scored = rows.join(F.broadcast(queries), F.lit(True)).select("query_id", key, F.round(dot(F.col("v"), F.col("q")), places).alias("score"))
    return ranked(scored, [F.desc("score"), F.col(key)], ["query_id"]).where(F.col("rank") <= depth)


def dense_blocks(queries: DataFrame, rows: DataFrame, key: str, depth: int = DEPTH, places: int = 9) -> DataFrame:
    """As :func:`dense_batch` for queries that grow with the rows: blocks of rows meet all queries, each
    block in a task, and neither side is broadcast."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = 4 * parts
    dealt = rows.withColumn("_block", F.pmod(F.xxhash64(key), F.lit(n)).cast("int")).repartition(parts, "_block")
    copied = queries.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).repartition(parts, "_block")
    scored = dealt.join(copied.hint("merge"), "_block").select("query_id", key, F.round(dot(F.col("v"), F.col("q")), places).alias("score"))
    return ranked(scored, [F.desc("score"), F.col(key)], ["query_id"]).where(F.col("rank") <= depth)


def first_ranks(rows: DataFrame, by: list[str]) -> DataFrame:
    """Least rank of every key; a repeated key keeps its first place."""
    return rows.groupBy(*by).agg(F.min("rank").alias("rank"))


def fuse(rows: DataFrame, branches: Sequence[str], by: list[str], key: str, k: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion of ``by, key, branch, rank`` rows: score, branch count, least rank, final rank."""
    wide = first_ranks(rows, [*by, key, "branch"]).groupBy(*by, key).pivot("branch", list(branches)).agg(F.min("rank"))
    cols = [F.col(b) for b in branches]
    count = sum((F.when(c.isNotNull(), 1).otherwise(0) for c in cols), F.lit(0))
    scored = wide.withColumn("score", rrf_score(*cols, k=k)).withColumn("n_branches", count).withColumn("min_rank", F.least(*cols) if len(cols) > 1 else cols[0])
    return ranked(scored, [F.desc("score"), F.desc("n_branches"), F.col("min_rank"), F.col(key)], by)


def tiered(anchored: DataFrame, corpus: DataFrame, by: list[str], key: str, top: int) -> DataFrame:
    """Anchored tier first, then corpus fill without repeats."""
    both = anchored.withColumn("tier", F.lit(1)).unionByName(corpus.withColumn("tier", F.lit(2)))
    best = both.groupBy(*by, key).agg(F.min(F.struct("tier", "rank")).alias("_b")).select(*by, key, "_b.tier", F.col("_b.rank").alias("tier_rank"))
    return ranked(best, [F.col("tier"), F.col("tier_rank"), F.col(key)], by).where(F.col("rank") <= top)


def rerank(rows: DataFrame, by: list[str], key: str, score: str) -> DataFrame:
    """Tier-preserving rerank: (tier, score down, rank before, key)."""
    return ranked(rows.withColumnRenamed("rank", "rank_before"), [F.col("tier"), F.desc(score), F.col("rank_before"), F.col(key)], by)


def rank_shift(before: DataFrame, after: DataFrame, by: list[str]) -> DataFrame:
    """Places gained by each key; a key in one list only has null (the lists must hold the same keys)."""
    b, a = before.select(*by, F.col("rank").alias("before")), after.select(*by, F.col("rank").alias("after"))
    return b.join(a, by, "full").withColumn("shift", F.col("before") - F.col("after"))


def document_balanced(rows: DataFrame, document: str, context: str, score: str, key: str | list[str], limit: int = DEPTH) -> DataFrame:
    """Context, then one row of each document before the second of any; ties by the columns of ``key``."""
    keys = [key] if isinstance(key, str) else key
    within = Window.partitionBy(document).orderBy(F.desc(context), F.desc(score), *keys)
    return rows.withColumn("document_rank", F.row_number().over(within)).orderBy(F.desc(context), "document_rank", F.desc(score), *keys).limit(limit)


#: What one context holds at most.
PACK_CHUNKS, PACK_BYTES = 8, 131_072


def packed(rows: DataFrame, by: str, text: str) -> DataFrame:
    """``by, chunks, bytes, status`` of the contexts that the rows of each ``by`` make: ``packed``, or why one is
    refused. All rows count; none is left out to make a context fit."""
    own = rows.groupBy(by).agg(F.count("*").alias("chunks"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).cast("long").alias("bytes"))
    return own.withColumn("status", F.when(F.col("chunks") > PACK_CHUNKS, "too_many_chunks").when(F.col("bytes") > PACK_BYTES, "too_many_bytes").otherwise("packed"))


def round_robin(rankings: Sequence[Sequence[str]], limit: int = DEPTH) -> list[str]:
    """Merges bounded ranked lists: each in turn gives its next unseen key (driver side, lists of at most ``limit``)."""
    queues, seen, out = [deque(r) for r in rankings], set(), []
    while len(out) < limit and any(queues):
        for queue in queues:
            key = next(iter(()), None)
            while queue:
                head = queue.popleft()
                if head not in seen:
                    key = head
                    break
            if key is not None and len(out) < limit:
                seen.add(key)
                out.append(key)
    return out


def postings(rows: DataFrame, key: str, fields: dict[str, str]) -> DataFrame:
    """``key, lexeme, weight, hits``: words of each weighted field, lower-cased."""
    parts = [rows.select(key, F.lit(weight).alias("weight"), F.explode(F.regexp_extract_all(F.lower(F.coalesce(F.col(col).cast("string"), F.lit(""))), F.lit(r"([\p{L}][\p{L}\p{N}]*)"), 1)).alias("lexeme")) for weight, col in fields.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(key, "lexeme", "weight").agg(F.count("*").alias("hits"))


def write_postings(posts: DataFrame, folder: str, parts: int = 1024) -> None:
    """Postings written once as an index: in ``parts`` folders by a hash of the lexeme, sorted by it, so that
    a question reads the folders and row groups of its words and no text at all."""
    dealt = posts.withColumn("part", F.pmod(F.xxhash64("lexeme"), F.lit(parts)))
    dealt.repartition("part").sortWithinPartitions("part", "lexeme").write.mode("errorifexists").partitionBy("part").parquet(folder)


def read_postings(spark: SparkSession, folder: str, terms: Sequence[str], parts: int = 1024) -> DataFrame:
    """The postings of some words from :func:`write_postings`; only their folders are listed and read."""
    wanted = [F.pmod(F.xxhash64(F.lit(t)), F.lit(parts)) for t in sorted(set(terms))]
    cond = _any([F.col("part") == w for w in wanted])
    return spark.read.parquet(folder).where(cond & F.col("lexeme").isin(*terms)).drop("part")


#: Weights of title, section and body words.
FIELD_WEIGHTS = {"A": 1.0, "B": 0.4, "D": 0.1}


def lexical_scores(posts: DataFrame, terms: Sequence[str], key: str, places: int = 9) -> DataFrame:
    """Conjunctive match: rows that hold every term. Rank ``s / (s + 1)`` of the weighted damped hits."""
    weight = F.coalesce(*[F.when(F.col("weight") == w, F.lit(v)) for w, v in FIELD_WEIGHTS.items()], F.lit(0.0))
    own = posts.where(F.col("lexeme").isin(*terms)).groupBy(key).agg(F.count_distinct("lexeme").alias("_n"), F.sum(weight * F.log(F.lit(1.0) + F.col("hits"))).alias("_s"))
    return own.where(F.col("_n") == len(set(terms))).select(key, F.round(F.col("_s") / (F.col("_s") + 1), places).alias("score"))


def lexical_top(posts: DataFrame, terms: Sequence[str], key: str, depth: int = DEPTH) -> DataFrame:
    return ranked(lexical_scores(posts, terms, key).orderBy(F.desc("score"), key).limit(depth), [F.desc("score"), F.col(key)])


# --- full text: words as arrays, so that a row that cannot match leaves before anything explodes -----


def lexemes(text: Column) -> Column:
    """Lower-case words of a text in order; a null text has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}][\p{L}\p{N}]*)"), 1)


def _has_phrase(words: Column, phrase: Sequence[str]) -> Column:
    n = len(phrase)
    wanted = F.array(*[F.lit(w) for w in phrase])
    starts = F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1)))
    return F.exists(starts, lambda i: F.slice(words, i, n) == wanted)


def search_filter(words: Column, alternatives: Sequence[dict]) -> Column:
    """Web-search syntax as a filter: of some alternative, all words and phrases are there and no excluded
    word is (``alternatives`` as :func:`veristrata.plans.lexical.search_query` parses them)."""
    out = F.lit(False)
    for a in alternatives:
        own = F.lit(True)
        for w in a["words"]:
            own = own & F.array_contains(words, w)
        for p in a["phrases"]:
            own = own & _has_phrase(words, p)
        for w in a["excluded"]:
            own = own & ~F.array_contains(words, w)
        out = out | own
    return out


def search_texts(text: Column, alternatives: Sequence[dict]) -> Column:
    """:func:`search_filter` over a text. A condition on words would make them again for each word that it names; here
    they are made once, and only of texts that hold the letters of all words of some alternative."""

    def letters(low: Column) -> Column:
        whole = [[*a["words"], *(w for p in a["phrases"] for w in p)] for a in alternatives]
        return reduce(lambda x, y: x | y, [reduce(lambda x, y: x & y, [F.contains(low, F.lit(w)) for w in own], F.lit(True)) for own in whole], F.lit(False))

    may = F.exists(F.array(F.lower(F.coalesce(text, F.lit("")))), letters)
    return may & F.exists(F.array(lexemes(text)), lambda words: search_filter(words, alternatives))


def cover_density(fields: Sequence[tuple[Column, float]], terms: Sequence[str]) -> Column:
    """Cover density of ``terms`` over weighted fields of :func:`lexemes`, one after the other. A cover is a
    shortest stretch that holds all terms; it adds the harmonic mean of its hits' weights over one plus the
    other words inside. The sum ``s`` comes as ``s / (s + 1)``; zero if a term is missing. One fold over the
    hits of a row: no shuffle."""
    wanted = sorted(set(terms))
    parts, offset = [], F.lit(0)

    def placed(words: Column, before: Column, weight: float) -> Column:
        hits = F.transform(words, lambda w, i: F.struct((i + before).cast("int").alias("p"), w.alias("w"), F.lit(1.0 / weight).alias("v")))
        return F.filter(hits, lambda x: x["w"].isin(*wanted))

    for words, weight in fields:
        parts.append(placed(words, offset, weight))
        offset = offset + F.size(words)
    last = F.array(*[F.struct(F.lit(-1).alias("p"), F.lit(0).alias("n"), F.lit(0.0).alias("v")) for _ in wanted])
    order = F.array(*[F.lit(w) for w in wanted])

    def step(acc: Column, x: Column) -> Column:
        place = F.array_position(order, x["w"])
        now = F.transform(acc["last"], lambda t, i: F.when(place == i + 1, F.struct(x["p"].alias("p"), acc["n"].alias("n"), acc["v"].alias("v"))).otherwise(t))
        begin = F.array_min(F.transform(now, lambda t: t["p"]))
        first = F.filter(now, lambda t: t["p"] == begin)[0]
        new = (begin >= 0) & (begin > acc["seen"])
        hits, inverse = acc["n"] + 1 - first["n"], acc["v"] + x["v"] - first["v"]
        gain = hits / inverse / (1 + x["p"] - begin - hits + 1)
        return F.struct(now.alias("last"), (acc["n"] + 1).alias("n"), (acc["v"] + x["v"]).alias("v"), F.when(new, begin).otherwise(acc["seen"]).alias("seen"), (acc["s"] + F.when(new, gain).otherwise(0.0)).alias("s"))

    zero = F.struct(last.alias("last"), F.lit(0).alias("n"), F.lit(0.0).alias("v"), F.lit(-1).alias("seen"), F.lit(0.0).alias("s"))
    return F.aggregate(F.concat(*parts), zero, step, lambda acc: acc["s"] / (acc["s"] + 1))


def full_text_top(rows: DataFrame, key: str, fields: dict[str, float], terms: Sequence[str], depth: int = DEPTH, places: int = 9) -> DataFrame:
    """The rows that hold every term, by cover density; ``fields``: weight of each text column."""
    wide = rows.select(key, *[lexemes(F.col(c)).alias(f"_{c}") for c in fields])
    every = [F.array_contains(F.concat(*[F.col(f"_{c}") for c in fields]), t) for t in terms]
    for cond in every:
        wide = wide.where(cond)
    score = F.round(cover_density([(F.col(f"_{c}"), w) for c, w in fields.items()], terms), places)
    return ranked(wide.select(key, score.alias("score")).orderBy(F.desc("score"), key).limit(depth), [F.desc("score"), F.col(key)])


def planned_candidates(rows: DataFrame, document: str, key: str, text: str, objects: Sequence[dict], depth: int = DEPTH, places: int = 9) -> DataFrame:
    """Candidates of planned objects: ``object, key, document, context_score, document_rank, score``, at most
    ``depth`` an object. An object (``groups, context``) admits a row that matches one of its groups; if it
    names accessions, one of these; if it names DOIs, one of these too. An accession or DOI matches as a whole
    token and before no version number, or (``doi`` column) by the row's own DOI. Rows of one document take
    turns; the context words in the text come first, then the groups' cover density."""
    wide = rows.withColumn("_w", lexemes(F.col(text)))
    out: DataFrame | None = None
    for n, obj in enumerate(objects):
        tests: dict[str, list[Column]] = {}
        score = F.lit(0.0)
        for g in obj["groups"]:
            if g.identifier:
                test = F.col(text).rlike(r"(?i)(?<![A-Za-z0-9_])" + re.escape(g.identifier) + r"(?![A-Za-z0-9_]|[.][0-9])")
                if g.kind == "doi" and "doi" in rows.columns:
                    test = test | F.coalesce(F.lower("doi") == g.identifier.lower(), F.lit(False))
            else:
                test = F.forall(F.array(*[F.lit(t) for t in g.terms]), lambda t: F.array_contains(F.col("_w"), t))
                score = score + cover_density([(F.col("_w"), 0.1)], g.terms)
            tests.setdefault(g.kind, []).append(test)
        admitted = tests.get("accession") or [t for own in tests.values() for t in own]
        own = wide.where(_any(admitted))
        if "doi" in tests:
            own = own.where(_any(tests["doi"]))
        context = sum((F.array_contains(F.col("_w"), t).cast("int") for t in obj["context"]), F.lit(0))
        own = own.select(F.lit(n).alias("object"), key, document, context.alias("context_score"), F.round(score, places).alias("score"))
        own = document_balanced(own, document, "context_score", "score", key, depth)
        out = own if out is None else out.unionByName(own)
    if out is None:
        raise ValueError("no object to search for")
    return out


def _any(tests: Sequence[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


GRAM = 5


def quote_containment(docs: DataFrame, quotes: DataFrame, key: str, text: str, quote_key: str, quote: str) -> DataFrame:
    """``quote_key, key`` of every row that holds a quote whole. Words inside a quote (all but its first and last)
    are whole words of a text that holds it, so the two meet by the digest of the quote's first inner words, ``GRAM`` of
    them or all it has: linear in the texts, whatever the number of quotes. The pairs are then tested on the texts
    themselves. Quotes of one or two words have no inner word; an automaton of them, built once a task, runs over every
    text. A null quote or text makes no pair; an id that several texts share is one row as soon as one of them holds the
    quote."""
    word = F.lit(r"([^\x20\x09-\x0D]+)")
    own = quotes.select(F.col(quote_key).alias("_q"), F.col(quote).alias("_quote"), F.regexp_extract_all(F.col(quote), word, 1).alias("_w")).where(F.col(quote).isNotNull())
    own = own.withColumn("_n", F.least(F.lit(GRAM), F.size("_w") - 2))
    digest = lambda ws: F.xxhash64(F.size(ws), F.array_join(ws, " "))
    long = own.where("_n > 0").select("_q", "_quote", F.slice("_w", F.lit(2), F.col("_n")).alias("_i")).select("_q", "_quote", digest(F.col("_i")).alias("_g"))
    wide = docs.select(F.col(key).alias("_k"), F.regexp_extract_all(F.col(text), word, 1).alias("_w"))
    texts = docs.select(F.col(key).alias("_k"), F.col(text).alias("_t"))
    found = texts.limit(0).select(F.lit(None).cast(own.schema["_q"].dataType).alias("_q"), "_k")
    sizes = sorted(r._n for r in own.select("_n").distinct().collect())  # GRAM + 2 numbers at most
    for n in (s for s in sizes if s > 0):
        at = F.sequence(F.lit(1), F.size("_w") - n + 1)
        grams = wide.where(F.size("_w") >= n).select("_k", F.explode(F.array_distinct(F.transform(at, lambda i: digest(F.slice("_w", i, n))))).alias("_g"))
        near = grams.join(long, "_g").select("_k", "_q", "_quote").distinct()
        found = found.unionByName(texts.join(near, "_k").where(F.contains("_t", "_quote")).select("_q", "_k"))
    if any(s <= 0 for s in sizes):
        found = found.unionByName(_short_quotes(texts, own.where("_n <= 0").select("_q", "_quote")))
    return found.distinct().select(F.col("_q").alias(quote_key), F.col("_k").alias(key))


#: Quotes of one automaton, at most about.
PATTERNS = 100_000


def _short_quotes(texts: DataFrame, quotes: DataFrame) -> DataFrame:
    """``_q, _k`` of texts that hold a short quote: every text once past an automaton of all of them (of ``PATTERNS``
    at a time). An empty quote is in every text."""
    parts = -(-quotes.count() // PATTERNS)
    kind = quotes.schema["_q"].dataType.simpleString()
    rows = texts.where(F.col("_t").isNotNull())
    out = rows.join(quotes.where("_quote = ''").select("_q")).select("_q", "_k")
    for part in range(parts):
        some = quotes.where((F.col("_quote") != "") & (F.pmod(F.xxhash64("_quote"), F.lit(parts)) == part))
        held = [(r._quote, r._q) for r in some.collect()]  # a bounded part
        workers_import(texts.sparkSession)
        out = out.unionByName(rows.mapInArrow(partial(_held_quotes, quotes=held), f"_q {kind}, _k {texts.schema['_k'].dataType.simpleString()}"))
    return out


def _held_quotes(batches: Iterator[pa.RecordBatch], quotes: list[tuple]) -> Iterator[pa.RecordBatch]:
    import ahocorasick

    machine, ids = ahocorasick.Automaton(), {}
    for text, q in quotes:
        ids.setdefault(text, []).append(q)
    for text in ids:
        machine.add_word(text, text)
    if not ids:
        return
    machine.make_automaton()
    kind = pa.array([q for own in ids.values() for q in own]).type
    for batch in batches:
        q, at = [], []
        for row, text in enumerate(batch.column("_t").to_pylist()):
            for found in {value for _, value in machine.iter(text)}:
                q += ids[found]
                at += [row] * len(ids[found])
        yield pa.RecordBatch.from_arrays([pa.array(q, kind), batch.column("_k").take(pa.array(at, pa.int64()))], ["_q", "_k"])


#: What a claim may name, with the boundaries of whole values.
_NUMBER = r"(?<![\w.])(\d+(?:\.\d+)?)(?![\w.])"
_ACCESSION = r"(?i)(?<![A-Za-z0-9_])((?:GC[AF]_\d{6,}|[A-Z]{1,6}_?\d{5,})(?:\.\d+)?)(?![A-Za-z0-9_]|\.\d)"
_MARKER = r"\[D?\d+\]"


def claim_provenance(claims: DataFrame, quotes: DataFrame, evidence: DataFrame) -> DataFrame:
    """``claim_id, faults``: mechanical checks of every claim (``claim_id, claim``) against its quotes (``claim_id,
    document, quote``) and the documents (``document, text``). A quote must be contained in its document and the
    document be known; every identifier and number of the claim must occur as a whole value in one of its quotes; a claim
    holds no citation marker. Quotes meet documents by an equality join; values are arrays within a claim's row."""
    held = quotes.join(evidence.select("document", F.col("text").alias("_t"), F.lit(True).alias("_known")), "document", "left")
    fault = F.when(F.col("_known").isNull(), F.concat(F.lit("unknown_citation:"), "document")).when(~F.coalesce(F.contains("_t", "quote"), F.lit(False)), F.concat(F.lit("quote_not_contained:"), "document"))
    values = lambda c: F.concat(F.regexp_extract_all(c, F.lit(_NUMBER), 1), F.transform(F.regexp_extract_all(c, F.lit(_ACCESSION), 1), F.upper))
    own = held.groupBy("claim_id").agg(F.array_sort(F.collect_set(fault)).alias("_f"), F.array_distinct(F.flatten(F.collect_list(values(F.coalesce("quote", F.lit("")))))).alias("_v"))
    none = F.array().cast("array<string>")
    said = F.coalesce("claim", F.lit(""))
    wanted = F.array_sort(F.array_except(values(said), F.coalesce("_v", none)))
    marked = F.when(said.rlike(_MARKER), F.array(F.lit("citation_marker"))).otherwise(none)
    unsupported = F.transform(wanted, lambda v: F.concat(F.lit("unsupported_value:"), v))
    return claims.join(own, "claim_id", "left").select("claim_id", F.concat(F.coalesce("_f", none), unsupported, marked).alias("faults"))


def branch_fusion(lists: dict[str, DataFrame], key: str, depth: int = DEPTH) -> DataFrame:
    """Reciprocal-rank fusion of single ranked lists (``key, rank``), one a branch."""
    rows = None
    for branch, ranks in lists.items():
        own = ranks.where(F.col("rank") <= depth).select(F.lit(0).alias("_q"), key, F.lit(branch).alias("branch"), "rank")
        rows = own if rows is None else rows.unionByName(own)
    return fuse(rows, tuple(lists), ["_q"], key).drop("_q")


def retrieve(chunks: DataFrame, vectors: DataFrame, summaries: DataFrame, key: str, document: str, fields: dict[str, float], terms: Sequence[str], vector: Sequence[float], anchored: DataFrame | None = None, top: int = 10) -> DataFrame:
    """Literature retrieval of one question: ``key, document, tier, branch ranks, rrf score, rank``. The
    lexical, dense and summary branches give 100 candidates each and are fused; with ``anchored`` (the
    documents of the question's anchors) the fusion inside these comes first and the whole corpus fills up.
    ``vectors`` and ``summaries``: ``key, v``. Terms may be none: then the lexical branch is empty."""

    def fused(allowed: DataFrame | None) -> DataFrame:
        own = chunks if allowed is None else chunks.join(allowed.select(document).distinct(), document, "left_semi")
        near = [v if allowed is None else v.join(own.select(key), key, "left_semi") for v in (vectors, summaries)]
        text = full_text_top(own, key, fields, terms) if terms else chunks.select(key).limit(0).withColumn("score", F.lit(0.0)).withColumn("rank", F.lit(1))
        return branch_fusion({"fts": text, "dense": dense_top(near[0], vector, key, "v", places=6), "summary": dense_top(near[1], vector, key, "v", places=6)}, key)

    corpus = fused(None).withColumn("_q", F.lit(0))
    first = corpus.limit(0) if anchored is None else fused(anchored).withColumn("_q", F.lit(0))
    both = tiered(first.select("_q", key, "rank"), corpus.select("_q", key, "rank"), ["_q"], key, top).drop("_q")
    held = first.withColumn("tier", F.lit(1)).unionByName(corpus.withColumn("tier", F.lit(2))).select(key, "tier", "fts", "dense", "summary", F.col("score").alias("rrf_score"))
    return both.join(held, [key, "tier"]).join(chunks.select(key, document), key).select(key, document, F.when(F.col("tier") == 1, "anchored").otherwise("corpus_fill").alias("tier"), "fts", "dense", "summary", "rrf_score", "rank")


def retrieval_warnings(found: DataFrame, has_anchors: bool) -> DataFrame:
    """One row, ``warnings``: ``anchor_miss`` if anchors were given and no row is anchored, ``no_chunks_retrieved``."""
    state = found.agg(F.count("*").alias("n"), F.count_if(F.col("tier") == "anchored").alias("a"))
    return state.select(F.filter(F.array(F.when((F.col("a") == 0) & F.lit(has_anchors), F.lit("anchor_miss")), F.when(F.col("n") == 0, F.lit("no_chunks_retrieved"))), lambda w: w.isNotNull()).alias("warnings"))


def retrieve_batch(lists: dict[str, DataFrame], key: str, top: int = 10, depth: int = DEPTH) -> DataFrame:
    """Literature retrieval of many questions in one plan: ``query_id, key, tier, branch ranks, rrf_score, rank``. Each
    branch (``query_id, anchored, key, rank`` as the index and vector searches give it) holds at most ``depth`` rows a
    question and scope. Branches are fused per question and scope; the anchored scope fills the first places, the whole
    corpus the rest."""
    rows = None
    for branch, ranks in lists.items():
        own = ranks.where(F.col("rank") <= depth).select("query_id", "anchored", F.col("key").alias(key), F.lit(branch).alias("branch"), "rank")
        rows = own if rows is None else rows.unionByName(own)
    tier = F.when(F.col("anchored"), 1).otherwise(2)
    fused = fuse(rows, tuple(lists), ["query_id", "anchored"], key).withColumnRenamed("score", "rrf_score").withColumn("tier", tier)
    first = Window.partitionBy("query_id", key).orderBy("tier")
    kept = fused.withColumn("_first", F.row_number().over(first)).where("_first = 1").withColumnRenamed("rank", "_rank")
    placed = ranked(kept, [F.col("tier"), F.col("_rank"), F.col(key)], ["query_id"]).where(F.col("rank") <= top)
    return placed.select("query_id", key, F.when(F.col("tier") == 1, "anchored").otherwise("corpus_fill").alias("tier"), *lists, "rrf_score", "rank")
