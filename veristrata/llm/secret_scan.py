"""Operator 11: secrets by fixed forms, and by what they cost a compressor that knows their surroundings.

1. Base spans: assignments to names like ``password`` or ``api_key``, access keys and long hex runs, leftmost and
   non-overlapping per kind, over whole texts.
2. Identifier dictionary: the ``IDENTIFIERS`` most frequent lower-case words of all texts (ties by code point), counted
   over the whole table. Only whole words count, so no piece of a key is one. It is all that goes to the driver and to
   the tasks: at most 4,096 words of 24 letters.
3. Candidates: runs of 12 or more letters, digits and ``+/_=-`` with a sensitive word in the ``CONTEXT`` bytes before
   them, outside the base spans.
4. Novelty: the text around a candidate (``AROUND`` bytes on each side, other copies of the candidate taken out) is
   compressed with and without it by zstandard, primed with the dictionary. A candidate is reported as ``novel`` if it
   costs ``NOVEL_BYTES`` bytes or more and ``NOVEL_SHARE`` of its length or more: words known to the surroundings or to
   the dictionary cost a few bytes, random strings nearly all of theirs.

Texts are scanned as UTF-8 in slices of about 4 MB (one text at least), places are given in code points. Row by row, so
no source or group of copies is hot. Defined cases: a null or empty text has no span; null and repeated ids are rows
like any other; other columns are not read; a very long text is one slice; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, map_arrow, passing, slices, table
from .textstats import IS_FIRST

KINDS = ("assign", "access", "hex", "novel")
IDENTIFIERS = 4096
CONTEXT = 48
AROUND = 512
NOVEL_BYTES = 12
NOVEL_SHARE = 0.6
LEVEL = 3
#: The lookahead names the letters that the alternatives start with; it only saves time.
_ASSIGN = re.compile(rb"""(?i:(?=[psta])(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]{12,}")  # a shorter run has no longer one inside
_HEX = re.compile(rb"[0-9a-f]{32,}")
_CANDIDATE = re.compile(rb"[A-Za-z0-9+/_=-]{12,}")
_SENSITIVE = re.compile(rb"(?i)pass|pwd|secret|token|key|auth|credential|bearer|private|signature|cert|salt|session|login")
_WORD = r"(?<![\p{L}\p{N}_])[a-z]{4,24}(?![\p{L}\p{N}_])"
_SPANS = "spans array<struct<kind:string,start:long,end:long,cost:int>>"


def identifiers(docs: DataFrame, limit: int = IDENTIFIERS) -> list[str]:
    """The most frequent lower-case words of all texts, most frequent first. How many words have each number of binary
    digits in their count tells below which count none can be among them, so that few words are sorted."""
    words = docs.select(F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(_WORD), F.lit(0))).alias("word"))
    with passing(docs.sparkSession):
        counted = durable(words.groupBy("word").agg(F.count("*").alias("n")), "scan-words")
        digits = F.length(F.bin("n"))
        held, least = 0, 1
        for row in counted.groupBy(digits.alias("digits")).agg(F.count("*").alias("n")).orderBy(F.desc("digits")).collect():  # 63 rows at most
            held, least = held + row.n, 1 << (row.digits - 1)
            if held >= limit:
                break
        top = counted.where(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(limit)
        return [r.word for r in top.collect()]  # bounded by the parameter


class Novelty:
    """Marginal compressed bytes under a dictionary of identifiers."""

    def __init__(self, words: list[str]):
        # the frequent ones last, where references to them are shortest
        known = " ".join(reversed(words)).encode() or b" "
        primed = zstandard.ZstdCompressionDict(known, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self._compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=primed, write_checksum=False, write_content_size=False)

    def cost(self, before: bytes, candidate: bytes, after: bytes) -> int:
        around = before.replace(candidate, b"") + after.replace(candidate, b"")
        return len(self._compressor.compress(around + candidate)) - len(self._compressor.compress(around))


def _base(blob: bytes) -> list[tuple[int, int, int]]:
    """``start, kind, end`` in bytes; a failing assignment is passed over whole, as its match was."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(blob) if m.end(1) - m.start(1) >= 8]
    found += [(m.start(), k, m.end()) for k, form in ((1, _ACCESS), (2, _HEX)) for m in form.finditer(blob)]
    return sorted(found)


def _novel(blob: bytes, base: list[tuple[int, int, int]], limits, novelty: Novelty) -> Iterator[tuple[int, int, int, int]]:
    """``start, kind, end, cost`` of the candidates that are reported. ``limits(at)``: ends of the text there."""
    starts = np.array([b[0] for b in base], np.int64)
    ends = np.maximum.accumulate(np.array([b[2] for b in base], np.int64)) if base else starts
    for m in _CANDIDATE.finditer(blob):
        s, e = m.span()
        if not _SENSITIVE.search(blob, max(0, s - CONTEXT), s):
            continue
        first, last = limits(s)
        if not _SENSITIVE.search(blob, max(first, s - CONTEXT), s):
            continue
        k = int(np.searchsorted(starts, e))  # base spans that start before the candidate's end
        if k and ends[k - 1] > s:
            continue
        cost = novelty.cost(blob[max(first, s - AROUND) : s], blob[s:e], blob[e : min(last, e + AROUND)])
        if cost >= NOVEL_BYTES and cost >= NOVEL_SHARE * (e - s):
            yield s, 3, e, cost


def find_spans(texts: list[bytes], novelty: Novelty) -> list[list[dict]]:
    """All spans of each text by start and kind, in code points."""
    blob = b"\n".join(texts)  # no form holds a line feed
    firsts = np.cumsum([0, *[len(t) + 1 for t in texts]])

    def limits(at: int) -> tuple[int, int]:
        k = int(np.searchsorted(firsts, at, "right"))
        return int(firsts[k - 1]), int(firsts[k]) - 1

    base = _base(blob)
    spans = sorted([(*b, None) for b in base] + list(_novel(blob, base, limits, novelty)), key=lambda x: x[:3])
    out: list[list[dict]] = [[] for _ in texts]
    if not spans:
        return out
    mask = IS_FIRST[np.frombuffer(blob, np.uint8)]
    doc = np.searchsorted(firsts, [s[0] for s in spans], "right") - 1
    wanted = np.unique(np.concatenate([firsts[doc], [s[0] for s in spans], [s[2] for s in spans]]))
    steps = [int(np.count_nonzero(mask[a:b])) for a, b in zip([0, *wanted[:-1]], wanted)]
    place = dict(zip(wanted.tolist(), np.cumsum(steps).tolist()))
    for (start, kind, end, cost), d in zip(spans, doc.tolist()):
        zero = place[int(firsts[d])]
        out[d].append({"kind": KINDS[kind], "start": place[start] - zero, "end": place[end] - zero, "cost": cost})
    return out


def _scan(batches: Iterator[pa.RecordBatch], words: list[str]) -> Iterator[pa.RecordBatch]:
    novelty = Novelty(words)
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("cost", pa.int32())]))
    for batch in slices(batches, "text"):
        texts = [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(find_spans(texts, novelty), span)], ["doc_id", "spans"])


def scan(docs: DataFrame, words: list[str] | None = None) -> DataFrame:
    """``doc_id, spans`` of every row of ``docs``: kind, first and last place, and for novel spans their cost in
    bytes. ``words``: the identifier dictionary, by default that of ``docs``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(rows, partial(_scan, words=identifiers(docs) if words is None else words), f"doc_id long, {_SPANS}")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    base = F.filter("spans", lambda s: s.kind != "novel")
    count = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(kind) for kind in KINDS]
    return found.select("doc_id", *counts[:3], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), counts[3])
