"""Secret spans against a text-by-text version, planted strings, known words and the defined cases."""

import hashlib
import random
import re
import string
from collections import Counter

import zstandard
from veristrata.llm import secret_scan

SF = "/root/testdata/sf0.01"


def _words(texts):
    counts = Counter(w for t in texts for w in re.findall(r"(?<![^\W])[a-z]{4,24}(?![^\W])", t or ""))
    return [w for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[: secret_scan.IDENTIFIERS]]


def _brute(text, words):
    text = text or ""
    spans = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 8:
            spans.append((m.start(), 0, m.end()))
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    primed = zstandard.ZstdCompressionDict((" ".join(reversed(words)) or " ").encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    size = lambda data: len(zstandard.ZstdCompressor(level=3, dict_data=primed, write_checksum=False, write_content_size=False).compress(data))
    raw, base = text.encode(), list(spans)
    for m in re.finditer("[A-Za-z0-9+/_=-]{12,}", text):
        at, end = len(text[: m.start()].encode()), len(text[: m.end()].encode())
        hint = re.search(rb"(?i)pass|pwd|secret|token|key|auth|credential|bearer|private|signature|cert|salt|session|login", raw[max(0, at - 48) : at])
        if not hint or any(s < m.end() and e > m.start() for s, _, e in base):
            continue
        own = raw[at:end]
        around = raw[max(0, at - 512) : at].replace(own, b"") + raw[end : end + 512].replace(own, b"")
        cost = size(around + own) - size(around)
        if cost >= 12 and cost >= 0.6 * len(own):
            spans.append((m.start(), 3, m.end()))
    named = lambda some: ",".join(f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e in sorted(some))
    return *(sum(s[1] == k for s in base) for k in range(3)), hashlib.sha256(named(base).encode()).hexdigest(), named(spans)


def _rows(seed=2):
    r = random.Random(seed)
    pick = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    code = string.ascii_letters + string.digits
    pieces = ["the parser reads configuration values", "élan vital ÄÖÜ 東京", "\n", 'token = "', "Password: ", "api_key=", "APIKEY : '", "client secret is ", "authorization bearer ", "ſecret=abcdefghijk", "AKIA", "private key material follows ", "session identifier of the authentication module ", "token=api_key: abcdefgh", '"', "' "]
    return [(i, "".join(r.choice(pieces) + r.choice(["", " ", pick(code, r.randint(3, 40)), pick("0123456789abcdef", r.randint(20, 45)), "AKIA" + pick(string.ascii_uppercase, r.randint(8, 20))]) for _ in range(r.randint(0, 30)))) for i in range(150)]


def test_equals_text_by_text(spark):
    rows = _rows()
    words = _words(t for _, t in rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert secret_scan.identifiers(df) == words
    got = {r.doc_id: [(s.start, secret_scan.KINDS.index(s.kind), s.end) for s in r.spans] for r in secret_scan.scan(df.repartition(3)).collect()}
    kinds = Counter()
    for i, text in rows:
        *_, named = _brute(text, words)
        assert ",".join(f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e in got[i]) == named
        kinds.update(k for _, k, _ in got[i])
    assert all(kinds[k] > 20 for k in range(4))


def test_query_equals_text_by_text(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    words = _words(r.text for r in rows)
    want = sorted((r.doc_id, *_brute(r.text, words)) for r in rows)
    got = sorted(tuple(r)[:6] for r in secret_scan.query(spark, SF).collect())
    assert got == want and sum(g[1] for g in got) > 0


def test_known_words_are_not_novel(spark):
    """Random strings after sensitive words are reported; names that the corpus or the text around knows are not."""
    plain = "The authentication middleware configuration validates internationalization settings. " * 6
    secret = "the signing key material is Zq8Rk2Lw9Xv4Tb7Nc3Hd6 and nothing else"
    known = "the session authentication internationalization middleware"
    docs = spark.createDataFrame([(i, plain) for i in range(20)] + [(90, secret), (91, known), (92, plain + secret), (93, known + " key authentication_middleware_configuration")], "doc_id long, text string")
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in secret_scan.scan(docs).collect()}
    at = secret.index("Zq8")
    assert got[90] == [("novel", at, at + 21)] and got[92] == [("novel", len(plain) + at, len(plain) + at + 21)]
    assert all(not spans for i, spans in got.items() if i not in (90, 92))


def test_defined_cases(spark):
    long = "wörter und zahlen " * 200_000 + 'token = "0123456789abcdef0123456789abcdef"'
    rows = [(1, None), (None, "password=hunter2hunter2"), (2, ""), (2, ""), (3, long), (4, "passwd: short"), (5, "AKIA" + "A" * 11), (6, "AKIA" + "A" * 12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    clash = df.selectExpr("*", "doc_id as start", "text as spans", "1 as kind", "2 as word", "3 as n")
    named = lambda d: sorted(((r.doc_id, [tuple(s)[:3] for s in r.spans]) for r in secret_scan.scan(d).collect()), key=str)
    at = len(long) - 42
    want = [(1, []), (None, [("assign", 0, 23)]), (2, []), (2, []), (3, [("assign", at, at + 41), ("hex", at + 9, at + 41)]), (4, []), (5, []), (6, [("access", 0, 16)])]
    assert named(df) == named(clash) == sorted(want, key=str)
    assert named(df.limit(0)) == []
