"""Scalar semantics that several operators share."""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values.
UNSIGNED_INTEGER = r"^(?:0|[1-9][0-9]*)$"
COMPOUND_INTERVAL = r"(?i)[,;|]|\b(?:join|order|complement)\s*\(|\.\."
RRF_K = 60
CHUNK_TOKENS, CHUNK_OVERLAP = 384, 64


def strict_integer(text: Column) -> Column:
    """Unsigned integers without sign, blanks or leading zeros; anything else is null."""
    return F.when(text.rlike(UNSIGNED_INTEGER), text.cast("long"))


def is_compound_interval(text: Column) -> Column:
    return F.coalesce(text.rlike(COMPOUND_INTERVAL), F.lit(False))


def ratio(numerator: Column, denominator: Column, places: int = 12) -> Column:
    """Half-even ratio; null when the denominator is zero, never 0."""
    return F.when(denominator != 0, F.bround(numerator.cast("double") / denominator.cast("double"), places))


def ratio_reason(denominator: Column, reason: str) -> Column:
    return F.when(denominator == 0, F.lit(reason))


def rrf_score(*ranks: Column, k: int = RRF_K) -> Column:
    """Sum of ``1 / (k + rank)`` over the branches that rank a key, half-even at 12 places."""
    total = F.lit(0.0)
    for rank in ranks:
        total = total + F.coalesce(F.lit(1.0) / (F.lit(float(k)) + rank), F.lit(0.0))
    return F.bround(total, 12)


def half_up(value: Column, places: int = 6) -> Column:
    return F.round(value.cast("decimal(38,18)"), places).cast(f"decimal(18,{places})")


def longest_run(text: Column, pattern: str) -> Column:
    """Length of the longest run of characters that match ``pattern``; 0 without one."""
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(text, F.lit(f"({pattern}+)"), 1), F.length)), F.lit(0))


def utc_timestamp(text: Column) -> Column:
    """RFC 3339 texts in UTC with a Z; anything else is null."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d{1,6})?Z$"), F.try_to_timestamp(text))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def chunk_starts(n_tokens: Column, size: int = CHUNK_TOKENS, overlap: int = CHUNK_OVERLAP) -> Column:
    """Starts of token windows; a window ends the list when it reaches the end of the text."""
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(n_tokens - 1, F.lit(0)).cast("int"), F.lit(step))
    return F.when(n_tokens > 0, F.filter(starts, lambda s: (s == 0) | (s + overlap < n_tokens)))


def terms(text: Column, stop: tuple[str, ...] = ()) -> Column:
    """Sorted distinct lower-case words without stop words; hyphens separate."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"([a-z][a-z0-9]*)"), 1)
    found = F.array_sort(F.array_distinct(words))
    return F.array_except(found, F.array(*[F.lit(s) for s in stop])) if stop else found


def clean_source(text: Column) -> Column:
    """Line ends to line feeds, trailing blanks off, blank lines collapsed; null if control characters are in it."""
    unix = F.regexp_replace(text, "\r\n?", "\n")
    trimmed = F.regexp_replace(unix, r"[ \t]+(?=\n|\z)", "")
    return F.when(~text.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F]"), F.regexp_replace(trimmed, r"\n{3,}", "\n\n"))


@F.pandas_udf(T.StringType())
def normal_name(names: pd.Series) -> pd.Series:
    """NFKC, case folding, single blanks."""
    return names.map(lambda n: None if n is None else " ".join(unicodedata.normalize("NFKC", n).split()).casefold())


def similarity(target: str):
    """UDF: class (2 prefix, 1 part, 0 other) and sequence ratio of a name against ``target``."""

    @F.pandas_udf("kind int, ratio double")
    def run(names: pd.Series) -> pd.DataFrame:
        own = " ".join(unicodedata.normalize("NFKC", target).split()).casefold()
        rows = []
        for name in names.fillna(""):
            other = " ".join(unicodedata.normalize("NFKC", name).split()).casefold()
            kind = 2 if other.startswith(own) or own.startswith(other) else 1 if own in other or other in own else 0
            rows.append((kind, SequenceMatcher(None, own, other).ratio()))
        return pd.DataFrame(rows, columns=["kind", "ratio"])

    return run
