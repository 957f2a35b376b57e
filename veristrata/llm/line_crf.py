"""Operator 1: quality rules; a linear-chain conditional random field labels lines.

Every line of a text is content or boilerplate. A linear-chain CRF with two states scores the lines by
the features of :func:`line_features` and by transitions; Viterbi decoding marks the best sequence, and
the share of the words in content lines decides: a text is kept at ``CONTENT_SHARE`` or more, unless a
base rule fails it (fewer than 50 words, or over half of the words in repeated 3-word windows).

Training labels are the lines' own, as evidence (:func:`evidence`): a line that its text repeats, that
is one of the sample's stock lines, or that is mostly symbols, capitals, bars or repeated words speaks
for boilerplate; a whole sentence speaks for content. Any other line is latent and leans to its
document's quality only. :meth:`LineCrf.fit` maximises the likelihood of this evidence with the states
summed out (forward-backward with and without it), so one document may hold both states. Stock lines
(:func:`stock_lines`) have different neighbours on both sides in several documents; the model keeps
their digests, and being one of them is a feature. At most ``TRAIN_DOCS`` labelled documents are used,
whole, chosen by a hash of their id; a long one trains as consecutive chains of ``CHAIN`` lines.
Without labelled documents the weights stay zero and every line is content.

Defined cases: a null or empty text has no words and fails the base rules; lines without a word
carry no weight; equal scores of both states count as content; a share of exactly ``CONTENT_SHARE``
is kept; repeated rows give repeated rows; a very long text is decoded whole; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textstats as ts
from .common import map_arrow, slices, table
from .sampling import hashed_share, train_labels

CONTENT_SHARE = 0.5
MIN_WORDS = 50
TRAIN_DOCS = 2000
CHAIN = 64
N_FEATURES = 16
#: Different neighbours on either side from which a line of the sample is a stock line.
STOCK = 3


def line_features(b: ts.Batch, repeated: np.ndarray, triple: np.ndarray, stock: np.ndarray) -> np.ndarray:
    """One row a line, every feature between 0 and 1; lines without a word are all zero."""
    n = len(b.line_starts)
    words = np.bincount(b.word_line, minlength=n)
    some = np.maximum(words, 1)
    length = np.maximum(np.diff(np.append(b.line_starts, len(b.data))) - 1, 1)
    letters = np.maximum(b.per_line(ts.IS_LETTER), 1)
    same = np.zeros(n)
    if len(b.words) > 1:
        pairs = (b.words[1:] == b.words[:-1]) & (b.word_line[1:] == b.word_line[:-1])
        same = np.bincount(b.word_line[1:], weights=pairs, minlength=n)
    ends = np.append(b.line_starts[1:], len(b.data)) - 2
    last = b.data[np.maximum(ends, 0)]
    capital = np.bincount(b.word_line, weights=ts.IS_UPPER[b.data[b.word_starts]], minlength=n)
    out = np.stack(
        [
            np.ones(n),
            np.minimum(b.per_line(ts.IS_SYMBOL) / some, 1),
            b.per_line(ts.IS_UPPER) / letters,
            np.minimum(b.per_line(ts._ALL == 33) / some, 1),
            np.minimum(b.per_line(ts._ALL == 124) / some, 1),
            np.minimum(same / some, 1),
            np.bincount(b.word_line, weights=triple, minlength=n) / some,
            repeated.astype(float),
            np.minimum(np.log1p(words) / 8, 1),
            words < 5,
            ts.IS_STOP[last].astype(float),
            b.per_line(ts.IS_DIGIT) / length,
            np.minimum(letters / length, 1),
            np.minimum(letters / some / 12, 1),
            capital / some,
            stock,
        ],
        axis=1,
    )
    out[words == 0] = 0
    return out


class LineCrf:
    """Two states (0 boilerplate, 1 content); ``weights``: feature by state, then the 2 x 2 transitions;
    ``stock``: sorted digests of stock lines."""

    def __init__(self, weights: np.ndarray | None = None, stock: np.ndarray | None = None):
        self.weights = np.zeros((N_FEATURES + 2, 2)) if weights is None else weights
        self.stock = np.zeros(0, np.uint64) if stock is None else stock

    def knows(self, digests: np.ndarray) -> np.ndarray:
        """Which of the lines are stock lines."""
        at = np.minimum(np.searchsorted(self.stock, digests), max(len(self.stock) - 1, 0))
        return (self.stock[at] == digests).astype(float) if len(self.stock) else np.zeros(len(digests))

    def _scores(self, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return features @ self.weights[:N_FEATURES], self.weights[N_FEATURES:]

    def viterbi(self, features: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Best states of all sequences; ``starts``: the first line of each. Sequences advance together."""
        score, move = self._scores(features)
        n = len(features)
        lens = np.diff(np.append(starts, n))
        order = np.argsort(-lens, kind="stable")
        starts, lens = starts[order], lens[order]
        states = np.zeros(n, np.int64)
        if not n:
            return states
        back = np.zeros((n, 2), np.int8)
        best = score[starts].copy()
        live = len(starts)
        for t in range(1, int(lens[0])):
            live = int(np.searchsorted(-lens, -t, "left"))  # sequences longer than t
            ways = best[:live, :, None] + move[None, :, :]
            back[starts[:live] + t] = ways[:, 1] >= ways[:, 0]
            best[:live] = ways.max(axis=1) + score[starts[:live] + t]
        now = (best[:, 1] >= best[:, 0]).astype(np.int64)
        states[starts + lens - 1] = now
        for t in range(int(lens[0]) - 1, 0, -1):
            live = int(np.searchsorted(-lens, -t, "left"))
            now[:live] = back[starts[:live] + t, now[:live]]
            states[starts[:live] + t - 1] = now[:live]
        return states

    def fit(self, features: np.ndarray, starts: np.ndarray, content: np.ndarray, steps: int = 150, rate: float = 0.2) -> LineCrf:
        """Adam on the mean log-likelihood of the evidence; ``content``: the share of each line's evidence
        that speaks for content. Ends early once a step gains next to nothing."""
        lens = np.diff(np.append(starts, len(features)))
        order = np.argsort(-lens, kind="stable")
        starts, lens = starts[order], lens[order]
        seen = np.log(np.clip(np.stack([1 - content, content], axis=1), 1e-6, 1))
        first, second = np.zeros_like(self.weights), np.zeros_like(self.weights)
        ridge = np.full_like(self.weights, 1e-3)
        ridge[N_FEATURES:] = 0.05  # what a line looks like outweighs its neighbours: one odd line inside content shows
        before = -np.inf
        for step in range(1, steps + 1):
            score, move = self._scores(features)
            free, single, double = _marginals(score, move, starts, lens)
            held, own, pairs = _marginals(score + seen, move, starts, lens)
            gain = np.concatenate([features.T @ (own - single), pairs - double]) / len(starts) - ridge * self.weights
            now = (held - free) / len(starts)
            if abs(now - before) < 1e-5 * max(1.0, abs(now)):
                break
            before = now
            first, second = 0.9 * first + 0.1 * gain, 0.99 * second + 0.01 * gain**2
            self.weights = self.weights + rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        return self


def _marginals(score: np.ndarray, move: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Forward-backward over all chains, longest first: the sum of their log partition functions, each
    line's state probabilities, the expected transitions."""
    alpha, beta = score.copy(), np.zeros_like(score)
    rows = [starts[: int(np.searchsorted(-lens, -t, "left"))] + t for t in range(1, int(lens[0]))]  # chains longer than t
    for at in rows:
        was = alpha[at - 1]
        alpha[at] += np.logaddexp(was[:, :1] + move[0], was[:, 1:] + move[1])
    for at in reversed(rows):
        ahead = score[at] + beta[at]
        beta[at - 1] = np.logaddexp(move[:, 0] + ahead[:, :1], move[:, 1] + ahead[:, 1:])
    total = np.logaddexp.reduce(alpha[starts + lens - 1], axis=1)
    each = np.zeros(len(score))
    each[starts] = total
    owner = np.zeros(len(score), np.int64)
    owner[starts] = 1
    each = each[np.maximum.accumulate(np.where(owner > 0, np.arange(len(score)), 0))]
    single = np.exp(alpha + beta - each[:, None])
    at = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    double = np.exp(alpha[at - 1][:, :, None] + move + (score[at] + beta[at])[:, None, :] - each[at][:, None, None]).sum(axis=0)
    return float(total.sum()), single, double


def evidence(features: np.ndarray, good: np.ndarray) -> np.ndarray:
    """How much speaks for content at each line; ``good``: its document is of quality 1. Lines without a
    word speak for neither."""
    symbols, upper, shout, bars, same, triple, again = features[:, 1:8].T
    few, stop = features[:, 9] > 0, features[:, 10] > 0
    noise = (symbols >= 0.5) | (upper >= 0.6) | (shout >= 0.3) | (bars >= 0.3) | (same >= 0.5) | (triple >= 0.5)
    sentence = ~few & stop & (upper < 0.3) & (symbols < 0.1) & (triple < 0.2)
    out = np.where(good, 0.7, 0.3)
    out[sentence] = np.where(good[sentence], 0.95, 0.8)
    out[noise | (again > 0) | (features[:, -1] > 0)] = 0.02
    out[features[:, 0] == 0] = 0.5
    return out


def line_digests(b: ts.Batch) -> np.ndarray:
    """One number a line, without the blanks around it; zero for a line without a word."""
    import xxhash

    return np.array([xxhash.xxh64_intdigest(x) if (x := line.strip()) else 0 for text in b.texts for line in text.split(b"\n")], np.uint64)


def stock_lines(docs: list[list[int]]) -> np.ndarray:
    """Sorted digests of the lines with ``STOCK`` different lines before and as many after them. Copies
    and near copies of a text show one neighbour on a side at least; the edge of a text counts as one of
    its own."""
    sides: dict[int, tuple[set, set]] = defaultdict(lambda: (set(), set()))
    for n, own in enumerate(docs):
        lines = [x for x in own if x]
        for before, line, after in zip([("first", n), *lines[:-1]], lines, [*lines[1:], ("last", n)]):
            for side, x in zip(sides[line], (before, after)):
                if len(side) < STOCK:
                    side.add(x)
    return np.array(sorted(line for line, (a, z) in sides.items() if len(a) >= STOCK and len(z) >= STOCK), np.uint64)


def _parts(batch: pa.RecordBatch) -> tuple[ts.Batch, np.ndarray, np.ndarray]:
    b = ts.Batch([(t or "").encode() for t in batch.column("text").to_pylist()])
    return b, b.line_is_repeat(), b.in_repeated_triple()


def train(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCS) -> LineCrf:
    """Fits the CRF on the lines of a bounded, hashed sample of labelled documents."""
    chosen = hashed_share(train_labels(labels, "quality"), limit)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", F.col("quality").cast("int").alias("label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            b, repeated, triple = _parts(batch)
            digests = line_digests(b)
            x = line_features(b, repeated, triple, np.zeros(len(digests))).astype(np.float32)
            bounds = np.searchsorted(b.line_doc, np.arange(b.n + 1))
            spans = list(zip(bounds, bounds[1:]))
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array([x[a:z].tobytes() for a, z in spans], pa.binary()), pa.array([digests[a:z].tobytes() for a, z in spans], pa.binary())], ["label", "lines", "digests"])

    # whole texts of at most about ``limit`` rows, copies once
    found = sorted({(r.label, bytes(r.lines), bytes(r.digests)) for r in map_arrow(rows, run, "label int, lines binary, digests binary").collect()})
    if not found:
        return LineCrf()
    seqs = [np.frombuffer(lines, np.float32).reshape(-1, N_FEATURES).astype(float) for _, lines, _ in found]
    digests = [np.frombuffer(d, np.uint64) for _, _, d in found]
    crf = LineCrf(stock=stock_lines([d.tolist() for d in digests]))
    x = np.concatenate(seqs)
    x[:, -1] = crf.knows(np.concatenate(digests))
    good = np.repeat([label == 1 for label, _, _ in found], [len(s) for s in seqs])
    starts = np.concatenate([np.arange(0, len(s), CHAIN) + at for s, at in zip(seqs, np.cumsum([0, *map(len, seqs[:-1])]))])
    return crf.fit(x, starts, evidence(x, good))


def apply_rules(docs: DataFrame, crf: LineCrf) -> DataFrame:
    """The base counts, the share of content and the verdict for every row."""
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, kept boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            b, repeated, triple = _parts(batch)
            states = crf.viterbi(line_features(b, repeated, triple, crf.knows(line_digests(b))), np.searchsorted(b.line_doc, np.arange(b.n)))
            words, again = b.n_words, np.bincount(b.word_doc, weights=triple, minlength=b.n).astype(np.int64)
            content = np.bincount(b.word_doc, weights=states[b.word_line], minlength=b.n)
            share = content / np.maximum(words, 1)
            failed = (words < MIN_WORDS) | (100 * again > 50 * words)
            cols = [words, b.word_chars(), b.symbols(), np.bincount(b.line_doc, weights=repeated, minlength=b.n).astype(np.int64), again, failed, share, ~failed & (share >= CONTENT_SHARE)]
            names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "content_share", "kept"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, cols)], ["doc_id", *names])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return apply_rules(docs, train(docs, table(spark, sf_dir, "labels")))
