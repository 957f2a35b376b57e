"""Operator 7: language identification by hierarchical discrimination.

A text is a sequence of lower-cased letters with single blanks between words; its features are the
relative frequencies of hashed byte 2-grams and 3-grams. Linear support vector machines (dual
coordinate descent, trained here) first decide the family, one against one, by votes and then margin;
inside the family a second set decides the language in the same way, for the texts of that family alone.
A family of one language needs no second step. Weights are looked up for every n-gram of the whole text.
A machine is kept as its nonzero weights, so the model grows with the n-grams that its languages have.

Families are a fixed table of language codes; a code outside it is a family of its own. Learning sees
only rows with a language whose crc32(doc_id) mod 4 is not 2, at most about ``SAMPLE`` documents split
evenly over the languages and chosen by a hash of the id.

Defined cases: a null text or one without a letter is ``und`` with score 0; without training rows
every text is ``und``; with one language that language has score 1; equal votes go to the greater sum of
margins, then to the first language by code point; repeated rows give repeated rows; a score depends on its text
alone, very long texts are read whole; an empty table gives an empty result; other columns, whatever their names,
are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, slices, table
from .sampling import fold

SAMPLE = 4000
BITS = 16
#: Language codes by family.
FAMILIES = {
    "germanic": ("en", "de", "nl", "af", "sv", "da", "no", "nb", "nn", "is"),
    "romance": ("fr", "es", "it", "pt", "ca", "gl", "ro", "oc"),
    "slavic": ("ru", "uk", "be", "bg", "sr", "hr", "bs", "sl", "mk", "cs", "sk", "pl"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
    "indic": ("hi", "bn", "ur", "mr", "pa", "gu", "ne"),
    "sinitic": ("zh", "yue"),
}
_FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}
_OTHER = re.compile(r"[^\w]|[\d_]")
_MUL = np.uint32(0x9E3779B1)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of every place of all texts in order (but for a text's last place, after which another text
    follows), and where each text's n-grams end."""
    clean = [(" " + " ".join(_OTHER.sub(" ", t.lower()).split()) + " ").encode() for t in texts]
    lens = np.array([len(c) for c in clean])
    data = np.frombuffer(b"".join(clean) + b"  ", np.uint8).astype(np.uint32)
    two = (data[:-2] << np.uint32(8)) | data[1:-1]
    three = (two << np.uint32(8)) | data[2:]
    shift = np.uint32(32 - BITS)
    both = np.empty((len(two), 2), np.int32)
    both[:, 0] = ((two + np.uint32(1)) * _MUL) >> shift
    both[:, 1] = ((three + np.uint32(1 << 25)) * _MUL) >> shift
    within = np.ones(len(both), bool)
    within[np.cumsum(lens) - 1] = False
    return both[within].ravel(), 2 * np.cumsum(lens - 1)


def sparse(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, counts = np.unique(codes, return_counts=True)
    return at.astype(np.int32), (counts / max(1, len(codes))).astype(np.float32)


def fit_svm(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, c: float = 10.0, epochs: int = 15, seed: int = 3) -> np.ndarray:
    """Linear SVM, hinge loss, dual coordinate descent. Returns weights with the bias last."""
    r = np.random.default_rng(seed)
    w = np.zeros((1 << BITS) + 1)
    alpha = np.zeros(len(rows))
    scale = [1 / np.sqrt(float((v * v).sum()) + 1e-12) for _, v in rows]
    unit = [(np.append(i, 1 << BITS), np.append(v * s, 1.0)) for (i, v), s in zip(rows, scale)]
    norm = np.array([float((v * v).sum()) for _, v in unit])
    weight = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum()))) * c
    for _ in range(epochs):
        moved = 0.0
        for k in r.permutation(len(rows)):
            i, v = unit[k]
            g = y[k] * float(w[i] @ v) - 1
            new = min(max(alpha[k] - g / norm[k], 0.0), weight[k])
            if new != alpha[k]:
                w[i] += (new - alpha[k]) * y[k] * v
                moved = max(moved, abs(new - alpha[k]))
                alpha[k] = new
        if moved < 1e-3:
            break
    # texts are scored by mean weight (relative frequencies), so fold the usual row scale into the weights
    w[:-1] *= float(np.median(scale)) if scale else 1.0
    return w


class Hierarchy:
    """Pairwise machines over families, then over the languages of each family."""

    def __init__(self, rows: list[tuple[str, tuple[np.ndarray, np.ndarray]]]):
        langs = sorted({lang for lang, _ in rows})
        self.members: dict[str, list[str]] = {}
        for lang in langs:
            self.members.setdefault(_FAMILY_OF.get(lang, lang), []).append(lang)
        self.families = sorted(self.members)
        self.machines: list[tuple[np.ndarray, np.ndarray, float]] = []  # places and values of the weights, bias
        self.pairs: dict[str, list[tuple[int, int, int]]] = {}

        def fit(name: str, classes: list[str], of) -> None:
            self.pairs[name] = []
            for a, b in combinations(range(len(classes)), 2):
                own = [(x, 1.0 if of(lang) == classes[a] else -1.0) for lang, x in rows if of(lang) in (classes[a], classes[b])]
                self.pairs[name].append((a, b, len(self.machines)))
                w = fit_svm([x for x, _ in own], np.array([s for _, s in own]))
                at = np.flatnonzero(w[:-1]).astype(np.int32)
                self.machines.append((at, w[at].astype(np.float32), float(w[-1])))

        fit("", self.families, lambda lang: _FAMILY_OF.get(lang, lang))
        for family, own in self.members.items():
            fit(family, own, lambda lang: lang)

    def _vote(self, name: str, n: int, codes: np.ndarray, starts: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Winner of each text and its least margin against the others."""
        votes, total = np.zeros((len(starts), n)), np.zeros((len(starts), n))
        least = np.full((len(starts), n), np.inf)
        for a, b, k in self.pairs[name]:
            at, value, bias = self.machines[k]
            column = np.zeros(1 << BITS, np.float32)
            column[at] = value
            m = np.add.reduceat(column[codes], starts, dtype=np.float64) / count + bias
            votes[:, a] += m > 0
            votes[:, b] += m <= 0
            total[:, a] += m
            total[:, b] -= m
            least[:, a] = np.minimum(least[:, a], m)
            least[:, b] = np.minimum(least[:, b], -m)
        best = (votes + 1e-3 * np.tanh(total)).argmax(axis=1)
        return best, least[np.arange(len(starts)), best]

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        if not texts:
            return [], np.zeros(0)
        codes, ends = ngrams(texts)
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        count = np.maximum(ends - starts, 1)
        codes = codes[: ends[-1]]
        family, sure = self._vote("", len(self.families), codes, starts, count)
        langs = [""] * len(texts)
        for f, name in enumerate(self.families):
            own = np.flatnonzero(family == f)
            members = self.members[name]
            lang = np.zeros(len(own), np.int64)
            if len(own) and len(members) > 1:
                n = count[own]
                first = np.cumsum(n) - n
                at = np.repeat(starts[own] - first, n) + np.arange(int(n.sum()))
                lang, inner = self._vote(name, len(members), codes[at], first, n)
                sure[own] = np.minimum(sure[own], inner)
            for i, x in zip(own, lang):
                langs[i] = members[x]
        return langs, 1 / (1 + np.exp(-np.clip(3 * sure, -40, 40)))


def train(docs: DataFrame, limit: int = SAMPLE) -> Hierarchy | None:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), 4) != 2))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row a language
    if not counts:
        return None
    each = limit / len(counts)
    space = 1 << 30
    share = F.coalesce(*[F.when(F.col("lang") == lang, F.lit(int(space * min(1.0, each / n)))) for lang, n in sorted(counts.items())])
    chosen = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(space)) < share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out: list[list] = [[], [], [], []]
            for doc_id, lang, text in zip(batch.column("doc_id").to_pylist(), batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                if has_letter(text):
                    at, value = sparse(ngrams([text])[0])
                    for c, v in zip(out, (doc_id, lang, at.tobytes(), value.tobytes())):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.binary())], ["doc_id", "lang", "at", "value"])

    found = map_arrow(chosen, run, "doc_id long, lang string, at binary, value binary").collect()
    found.sort(key=lambda r: (r.doc_id, r.lang, bytes(r.at)))
    if not found:
        return None
    return Hierarchy([(r.lang, (np.frombuffer(bytes(r.at), np.int32), np.frombuffer(bytes(r.value), np.float32))) for r in found])


def identify(docs: DataFrame, model: Hierarchy | None) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = batch.column("text").to_pylist()
            langs, scores = ["und"] * len(texts), np.zeros(len(texts))
            own = [i for i, t in enumerate(texts) if model is not None and has_letter(t)]
            if own:
                found, sure = model.predict([texts[i] for i in own])
                for i, lang, s in zip(own, found, sure):
                    langs[i], scores[i] = lang, s
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(scores)], ["doc_id", "held_out", "lang_pred", "score"])

    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(doc_id.alias("doc_id"), F.coalesce(fold(doc_id, 4) == 2, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return map_arrow(rows, run, "doc_id long, held_out boolean, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs))
