"""Content-addressed identity: canonical JSON and stable keys as column expressions."""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Identifier grammars.
RELEASE_KEY = r"^[a-z0-9]+(?:-[a-z0-9]+)*-(\d{8})-v\d+$"
ASSEMBLY_ACCESSION = r"^GC[AF]_[0-9]{9}\.[1-9][0-9]*$"
CONTIG_ACCESSION = r"^[A-Z]{1,6}_?[0-9]{5,}\.[1-9][0-9]*$"
SHA256_HEX = r"^[0-9a-f]{64}$"


def canonical_json(**fields: Column) -> Column:
    """Compact JSON object with sorted names; nulls stay as null (ASCII texts without control characters)."""
    return F.to_json(F.struct(*[fields[name].alias(name) for name in sorted(fields)]), {"ignoreNullFields": "false"})


def stable_key(namespace: str, **fields: Column) -> Column:
    """``<namespace>:sha256:<hex of the canonical JSON>``."""
    return F.concat(F.lit(f"{namespace}:sha256:"), F.sha2(canonical_json(**fields), 256))


def locus_key(snapshot: Column, group: Column, sequence: Column, token: Column, policy: Column) -> Column:
    """Key of a locus: five fields, no coordinates."""
    return stable_key("locus", source_snapshot_key=snapshot, assembly_accession_version=group, contig_accession_version=sequence, native_vr_token=token, identity_policy_version=policy)


def is_release_key(key: Column) -> Column:
    """Grammar and calendar date of a release key; never null."""
    day = F.regexp_extract(key, RELEASE_KEY, 1)
    return F.coalesce(key.rlike(RELEASE_KEY) & F.try_to_date(day, "yyyyMMdd").isNotNull(), F.lit(False))


def is_accession(value: Column, pattern: str) -> Column:
    return F.coalesce(value.rlike(pattern), F.lit(False))


def _nfc(value: object) -> object:
    if isinstance(value, str):
        return unicodedata.normalize("NFC", value)
    if isinstance(value, dict):
        out = {_nfc(k): _nfc(v) for k, v in value.items()}
        if len(out) != len(value):
            raise ValueError("two names are equal after NFC")
        return out
    return [_nfc(v) for v in value] if isinstance(value, (list, tuple)) else value


def canonical_text(value: object) -> str:
    """Canonical JSON of driver-side values, NFC, finite floats allowed."""
    return json.dumps(_nfc(value), ensure_ascii=False, allow_nan=False, separators=(",", ":"), sort_keys=True)


def digest(value: object) -> str:
    return hashlib.sha256(canonical_text(value).encode()).hexdigest()


def manifest_digest(manifest: dict, own: str = "manifest_sha256") -> str:
    """Digest of a manifest without its own digest."""
    return digest({k: v for k, v in manifest.items() if k != own})


def query_digest(question: str, anchors: list[dict]) -> str:
    """Digest of a question with its anchors in canonical order."""
    return digest({"anchors": sorted(anchors, key=canonical_text), "question": question})


def question_digest(question: Column, anchors: Column) -> Column:
    """:func:`query_digest` as a column: ``anchors`` is an array of structs whose fields are in order of their names
    (ASCII texts without control characters)."""
    listed = F.array_sort(F.transform(anchors, lambda a: F.to_json(a, {"ignoreNullFields": "false"})))
    quoted = F.regexp_extract(F.to_json(F.array(question)), r"(?s)^\[(.*)\]$", 1)
    return F.sha2(F.concat(F.lit('{"anchors":['), F.array_join(listed, ","), F.lit('],"question":'), quoted, F.lit("}")), 256)


@F.pandas_udf(T.StringType())
def text_digest(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """SHA-256 of the NFC form; for texts that may hold control characters or combining marks."""
    for s in batches:
        yield s.map(lambda t: None if t is None else hashlib.sha256(unicodedata.normalize("NFC", t).encode()).hexdigest())


def embedding_digest(meta: str) -> Column:
    """UDF over a float array: SHA-256 of ``meta``, a zero byte and the little-endian 32-bit floats."""

    @F.pandas_udf(T.StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import numpy as np

        head = meta.encode() + b"\0"
        for s in batches:
            yield s.map(lambda v: None if v is None else hashlib.sha256(head + np.asarray(v, "<f4").tobytes()).hexdigest())

    return run


def hashed_unit(text: str | None):
    """Repeatable unit vector of 384 floats from SHA-256 blocks of a text."""
    import numpy as np

    if text is None:
        return None
    raw = b"".join(hashlib.sha256(f"{i}:{text}".encode()).digest() for i in range(48))
    v = np.frombuffer(raw, "<u4").astype(float) / 2**31 - 1
    return (v / np.linalg.norm(v)).astype(np.float32)


@F.pandas_udf(T.ArrayType(T.FloatType()))
def hashed_vector(texts: pd.Series) -> pd.Series:
    """:func:`hashed_unit` of every text: tests need no model."""
    return texts.map(hashed_unit)


def is_unit_vector(v: Column, size: int, slack: float = 1e-5) -> Column:
    """Length, finiteness and norm of an embedding; never null."""
    d = v.cast("array<double>")
    finite = F.forall(d, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    norm = F.sqrt(F.aggregate(d, F.lit(0.0), lambda a, x: a + x * x))
    return F.coalesce((F.size(v) == size) & finite & (F.abs(norm - 1) <= slack), F.lit(False))
