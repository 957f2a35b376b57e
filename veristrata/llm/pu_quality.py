"""Operator 6: quality classifier by positive-unlabelled learning with the non-negative risk.

Trusted positives are labelled documents of quality 1; all training documents, labels unseen, are the
unlabelled set. A network with one hidden layer on the features of :func:`features` minimises the
non-negative unbiased risk ``p R+(g) + max(0, Ru-(g) - p Rp-(g))`` with the sigmoid loss; when the
bracket falls below zero the step ascends on it instead. The class prior ``p`` is estimated from the
scores of held-back positives and of all unlabelled rows: the least bound of the ratio of their shares
above a threshold. A final logistic map of the network's output minimises the unbiased logistic risk on
positives and unlabelled rows with the same prior, so labelled negatives take no part at all.

Learning sees rows outside the held-out fold only (crc32 of the id mod 5 is 0 there). The network and the
map are fitted on at most about ``SAMPLE`` positives and as many unlabelled rows, chosen by a hash of the
id; means, deviations and the shares behind the prior are aggregates over all training documents.
Scores use the text alone.

Defined cases: null and empty texts score like a text without words; without positives every score is
0.5; a score of exactly ``THRESHOLD`` is predicted 1; repeated rows give repeated rows and a repeated id
trains once for each of its texts; a null id belongs to no fold (``held_out`` false); very long texts are read whole;
other columns, whatever their names, are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textstats as ts
from .common import durable, map_arrow, passing, slices, table
from .sampling import fold, hashed_share, train_labels

SAMPLE = 12_000
THRESHOLD = 0.3
HIDDEN = 16


def features(texts: list[bytes]) -> np.ndarray:
    """Style of each whole text: shares of symbols, capitals, digits, repeated words and lines, lengths."""
    b = ts.Batch(texts)
    n, size = b.n, np.maximum(np.array([len(t) for t in texts], float), 1)
    words = b.n_words.astype(float)
    some = np.maximum(words, 1)
    letters = np.maximum(b.per_doc(ts.IS_LETTER[b.data]), 1)
    lines = np.bincount(b.line_doc, minlength=n).astype(float)
    same = np.zeros(n)
    if len(b.words) > 1:
        same = np.bincount(b.word_doc[1:], weights=(b.words[1:] == b.words[:-1]) & (b.word_doc[1:] == b.word_doc[:-1]), minlength=n)
    if len(b.words):
        key = np.sort(b.word_doc * b.distinct + b.words)
        new = np.concatenate([[True], key[1:] != key[:-1]])
        runs = np.diff(np.append(np.flatnonzero(new), len(key)))
        owner = key[new] // b.distinct
        kinds = np.bincount(owner, minlength=n)
        most = np.zeros(n)
        np.maximum.at(most, owner, runs)
    else:
        kinds, most = np.zeros(n), np.zeros(n)
    stops = b.per_doc(ts.IS_STOP[b.data])
    return np.stack(
        [
            b.symbols() / some,
            b.symbols() / size,
            b.per_doc(ts.IS_UPPER[b.data]) / letters,
            b.per_doc(b.data == 33) / some,
            b.per_doc(b.data == 124) / some,
            np.bincount(b.word_doc, weights=b.in_repeated_triple(), minlength=n) / some,
            same / some,
            kinds / some,
            most / some,
            np.log1p(words),
            b.per_doc(ts.IS_LETTER[b.data]) / some,
            b.per_doc(ts.IS_DIGIT[b.data]) / size,
            np.bincount(b.line_doc, weights=b.line_is_repeat(), minlength=n) / np.maximum(lines, 1),
            np.log1p(words / np.maximum(lines, 1)),
            stops / some,
            letters / size,
        ],
        axis=1,
    ).astype(np.float32)


def _forward(p: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hidden = np.tanh(x @ p["w1"] + p["b1"])
    return hidden, hidden @ p["w2"] + p["b2"]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, epochs: int = 60, rate: float = 0.01, seed: int = 5) -> dict:
    """Network weights that minimise the non-negative risk; inputs are standardised features."""
    r = np.random.default_rng(seed)
    d = positive.shape[1]
    p = {"w1": r.normal(0, 1 / np.sqrt(d), (d, HIDDEN)), "b1": np.zeros(HIDDEN), "w2": r.normal(0, 0.3, HIDDEN), "b2": np.zeros(1)}
    m1, m2 = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}
    step, size = 0, 512
    for _ in range(epochs):
        up, uu = r.permutation(len(positive)), r.permutation(len(unlabelled))
        for s in range(0, max(len(up), len(uu)), size):
            xp = positive[np.take(up, range(s, s + size), mode="wrap")]
            xu = unlabelled[np.take(uu, range(s, s + size), mode="wrap")]
            x = np.concatenate([xp, xu])
            hidden, z = _forward(p, x)
            loss = _sigmoid(z)  # sigmoid loss of calling the row negative
            slope = loss * (1 - loss)
            rest = loss[size:].mean() - prior * loss[:size].mean()
            up_slope, un_slope = slope[:size] / size, slope[size:] / size
            if rest >= 0:
                g = np.concatenate([-prior * up_slope - prior * up_slope, un_slope])
            else:  # the bracket is negative: step back up on it
                g = np.concatenate([prior * up_slope, -un_slope])
            back = g[:, None] * p["w2"] * (1 - hidden**2)
            grad = {"w1": x.T @ back + 1e-4 * p["w1"], "b1": back.sum(axis=0), "w2": hidden.T @ g + 1e-4 * p["w2"], "b2": np.array([g.sum()])}
            step += 1
            for k in p:
                m1[k] = 0.9 * m1[k] + 0.1 * grad[k]
                m2[k] = 0.999 * m2[k] + 0.001 * grad[k] ** 2
                p[k] = p[k] - rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    return p


def estimate_prior(positive: np.ndarray, above: Callable[[np.ndarray], np.ndarray], size: int) -> float:
    """Share of positives among ``size`` unlabelled scores: the least ratio of shares above a threshold, each
    with its deviation bound, over thresholds that keep at least a tenth of the positives. ``above`` counts
    the unlabelled scores at or above each of some thresholds."""
    slack = np.sqrt(np.log(20) / 2)
    steps = np.quantile(positive, np.linspace(0, 0.9, 46))
    own = (positive[None, :] >= steps[:, None]).mean(axis=1)
    share = above(steps) / size
    bound = (share + slack / np.sqrt(size) + slack / np.sqrt(len(positive))) / np.maximum(own, 1e-9)
    bound[own < 0.1] = np.inf
    best = int(bound.argmin())  # the tightest bound names the threshold, the ratio there is the estimate
    return float(np.clip(share[best] / own[best], 0.05, 0.98)) if np.isfinite(bound[best]) else 0.5


def fit_logistic(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[float, float]:
    """Slope and intercept that minimise the unbiased logistic risk ``-p E+[t] + Eu[log(1 + exp t)]`` of
    ``t = a z + b`` (convex), with a weak ridge, by Newton steps that never lose."""
    mean, std = unlabelled.mean(), unlabelled.std() + 1e-9
    x = np.stack([(unlabelled - mean) / std, np.ones(len(unlabelled))], axis=1)
    pull = prior * np.array([((positive - mean) / std).mean(), 1.0])
    ridge = np.array([1e-3, 1e-6])
    w = np.zeros(2)

    def risk(w: np.ndarray) -> float:
        return float(np.logaddexp(0, x @ w).mean() - pull @ w + 0.5 * (ridge * w * w).sum())

    now = risk(w)
    for _ in range(100):
        q = _sigmoid(x @ w)
        h = (x * (q * (1 - q))[:, None]).T @ x / len(x) + np.diag(ridge)
        move, step = np.linalg.solve(h, x.T @ q / len(x) - pull + ridge * w), 1.0
        while step > 1e-4 and risk(w - step * move) > now:
            step /= 2
        w, before = w - step * move, now
        now = risk(w)
        if before - now < 1e-10:
            break
    return float(w[0] / std), float(w[1] - w[0] * mean / std)


def _featured(docs: DataFrame) -> DataFrame:
    """``doc_id, x`` of every training document, once for each text of an id."""
    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(doc_id.alias("doc_id"), F.col("text").cast("string").alias("text")).where(doc_id.isNotNull() & (fold(doc_id, 5) != 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            x = features([(t or "").encode() for t in batch.column("text").to_pylist()])
            flat = pa.array(x.ravel(), pa.float32())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), flat)], ["doc_id", "x"])

    return map_arrow(rows, run, "doc_id long, x array<float>")


def _rows(df: DataFrame) -> np.ndarray:
    """A bounded sample's features, in the order of ids."""
    return np.array([r.x for r in sorted(df.collect(), key=lambda r: (r.doc_id, r.x))], float)


def train(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> dict | None:
    """Standardisation, network, prior and logistic map; ``None`` without trusted positives."""
    with passing(docs.sparkSession):
        rows = durable(_featured(docs), "pu-features")
        trusted = hashed_share(train_labels(labels, "quality").where("quality = 1"), limit).select("doc_id")
        xp = _rows(rows.join(F.broadcast(trusted), "doc_id", "left_semi").distinct())  # at most about ``limit`` ids
        if len(xp) < 2:
            return None
        xu = _rows(hashed_share(rows, limit).distinct())
        width = xp.shape[1]
        sums = rows.agg(F.count("*"), *[F.avg(F.col("x")[i].cast("double")) for i in range(width)], *[F.stddev_pop(F.col("x")[i].cast("double")) for i in range(width)]).first()
        size, stats = sums[0], np.array([float(f"{v:.8e}") for v in sums[1:]])  # sums in another order differ in later digits
        mean, std = stats[:width], stats[width:] + 1e-6
        norm = lambda x: np.clip((x - mean) / std, -6, 6)
        zp, zu = norm(xp), norm(xu)
        half, half_u = np.arange(len(zp)) % 2 == 0, np.arange(len(zu)) % 2 == 0
        first = fit_nnpu(zp[half], zu[half_u], 0.5, epochs=20)

        def above(steps: np.ndarray) -> np.ndarray:
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                total = np.zeros(len(steps), np.int64)
                for batch in batches:
                    x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(float)
                    total += (_forward(first, norm(x))[1][None, :] >= steps[:, None]).sum(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(steps))), pa.array(total)], ["step", "n"])

            counted = map_arrow(rows.select("x"), run, "step long, n long").groupBy("step").agg(F.sum("n").alias("n")).collect()  # one row a step
            return np.array([r.n for r in sorted(counted)], float)

        prior = estimate_prior(_forward(first, zp[~half])[1], above, size)
    net = fit_nnpu(zp, zu, prior)
    a, b = fit_logistic(_forward(net, zp)[1], _forward(net, zu)[1], prior)
    return {"mean": mean, "std": std, "net": net, "prior": prior, "a": a, "b": b}


def score_texts(model: dict | None, texts: list[bytes]) -> np.ndarray:
    if model is None:
        return np.full(len(texts), 0.5)
    x = np.clip((features(texts) - model["mean"]) / model["std"], -6, 6)
    return _sigmoid(model["a"] * _forward(model["net"], x)[1] + model["b"])


def score(docs: DataFrame, model: dict | None, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            s = score_texts(model, [(t or "").encode() for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(doc_id.alias("doc_id"), F.coalesce(fold(doc_id, 5) == 0, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return map_arrow(rows, run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: dict | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, with their columns."""
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            s = score_texts(model, [(t or "").encode() for t in batch.column(at).to_pylist()])
            yield batch.filter(pa.array(s >= threshold))

    return map_arrow(docs, run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
