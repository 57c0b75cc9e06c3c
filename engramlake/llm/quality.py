"""Quality classifier by positive-unlabelled learning.

Each text becomes a fixed row of shape features (repetition, symbols, case, lengths, line and sentence structure). A
small network with one hidden layer is trained to minimise the non-negative unbiased risk
``prior * E_P[l(+)] + max(0, E_U[l(-)] - prior * E_P[l(-)])`` with logistic loss, trusted positives P being labelled
rows of the training fold and U unlabelled texts of that fold. The class prior is estimated from P and U alone: two
networks, each trained on one half of the rows, rank the other half, and the prior is the least ratio of the share of U
to the share of P above a threshold, plus one standard error of that ratio, so that a doubt speaks for keeping
(``PRIOR_WITHOUT_EVIDENCE`` where either has under ``LEAST_ROWS`` rows). Labels of negatives are not used; labels,
language, source and id are never inputs.

Bounds: at most ``MAX_POSITIVE`` and ``MAX_UNLABELLED`` rows are drawn for training, by least digest of the id, so the
draw does not depend on partitions. Every text is scored in its own partition; nothing is shuffled but the ids drawn.

Defined cases: a text without words (or null) has score 0; without a trusted positive nothing can be judged and every
other text scores 1; a null id counts as training fold; labels of one id that disagree count as negative; an empty
table gives no rows; repeated rows keep one row each.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engramlake.llm.common import ship

FOLDS, HELD_OUT = 4, 2
MAX_POSITIVE, MAX_UNLABELLED = 10_000, 20_000
ACCEPT, PRIOR_WITHOUT_EVIDENCE, LEAST_ROWS = 0.7, 0.85, 20
#: Prior of the networks that only rank, and their epochs. Their order is that of the density ratio of P to U as long as
#: this value is below the true prior.
RANK_PRIOR, RANK_EPOCHS = 0.3, 150
HIDDEN, EPOCHS, SEED = 16, 400, 7
UPPER, LOWER, DIGITS, SYMBOLS, MARKS = (bytes(range(65, 91)), bytes(range(97, 123)), b"0123456789", b"#*$%&|<>@^~=_{}[]\\/", b"!?")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def features(text: str | None) -> list[float] | None:
    """Shape of a whole text; None without words."""
    raw = (text or "").encode()
    w = raw.split()
    n = len(w)
    if not n:
        return None
    size = len(raw)
    share = lambda chars: (size - len(raw.translate(None, chars))) / size
    lines = [x for x in raw.split(b"\n") if x.strip()]
    sentences = [x.strip() for x in raw.replace(b"\n", b". ").split(b". ")]
    tops = [c for _, c in Counter(w).most_common(3)]
    upper, lower = share(UPPER), share(LOWER)
    pairs = max(n - 1, 1)
    return [
        float(np.log1p(n)),
        sum(map(eq, w, w[1:])) / pairs,
        len(set(w)) / n ** 0.8,
        len(set(zip(w, w[1:]))) / pairs if n > 1 else 1.0,
        tops[0] / n,
        sum(tops) / n,
        share(SYMBOLS),
        share(MARKS),
        share(b"|"),
        share(DIGITS),
        share(b".,;:"),
        upper / (upper + lower + 1e-9),
        size / n,
        len(lines) / n,
        1 - len(set(lines)) / len(lines),
        1 - len(set(sentences)) / len(sentences),
        n / len(sentences),
        sum(len(x) <= 3 for x in w) / n,
        sum(len(x) > 14 for x in w) / n,
        sum(len(x) == 1 for x in w) / n,
    ]


def feature_table(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([features(t.as_py()) for t in b.column(1)], pa.list_(pa.float64()))], names=["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, x array<double>")


class PuNetwork:
    """One hidden layer on standardised features, trained on the non-negative risk by full-batch Adam."""

    def __init__(self, positive: np.ndarray, unlabelled: np.ndarray, prior: float, epochs: int = EPOCHS):
        both = np.concatenate([positive, unlabelled])
        self.mean, self.scale = both.mean(0), both.std(0) + 1e-6
        rng = np.random.default_rng(SEED)
        d = both.shape[1]
        self.par = [rng.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.array(0.0)]
        m, v = [np.zeros_like(p) for p in self.par], [np.zeros_like(p) for p in self.par]
        x = self._scaled(both)
        n_p, n_u = len(positive), len(unlabelled)
        is_p = np.arange(len(both)) < n_p
        for t in range(1, epochs + 1):
            h = np.tanh(x @ self.par[0] + self.par[1])
            g = h @ self.par[2] + self.par[3]
            s = 1 / (1 + np.exp(-np.clip(g, -30, 30)))
            minus = np.logaddexp(0, g)
            rest = minus[~is_p].mean() - prior * minus[is_p].mean()
            d_pos = np.where(is_p, prior * (s - 1) / n_p, 0.0)
            d_neg = np.where(is_p, -prior * s / n_p, s / n_u)
            # Below zero the negative part is overfitted: step against it.
            dg = d_pos + d_neg if rest >= 0 else -d_neg
            dh = np.outer(dg, self.par[2]) * (1 - h * h)
            grads = [x.T @ dh + 1e-4 * self.par[0], dh.sum(0), h.T @ dg + 1e-4 * self.par[2], dg.sum()]
            for i, gr in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * gr
                v[i] = 0.999 * v[i] + 0.001 * gr * gr
                self.par[i] = self.par[i] - 0.03 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def score(self, x: np.ndarray) -> np.ndarray:
        g = np.tanh(self._scaled(x) @ self.par[0] + self.par[1]) @ self.par[2] + self.par[3]
        return 1 / (1 + np.exp(-np.clip(g, -30, 30)))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among the unlabelled rows, from positives and unlabelled rows only.

    Above a threshold at which no negative is left, U holds the prior's share of what P holds; elsewhere it holds more.
    Thresholds keep at least half of the positives, and each half of the rows is ranked by a network of the other.
    """
    if min(len(positive), len(unlabelled)) < LEAST_ROWS:
        return PRIOR_WITHOUT_EVIDENCE
    found = []
    order = np.random.default_rng(SEED)
    positive, unlabelled = order.permutation(positive), order.permutation(unlabelled)
    for half in (0, 1):
        net = PuNetwork(positive[half::2], unlabelled[half::2], RANK_PRIOR, RANK_EPOCHS)
        p, u = np.sort(net.score(positive[1 - half :: 2])), np.sort(net.score(unlabelled[1 - half :: 2]))
        at = p[: len(p) // 2 + 1]
        in_p = 1 - np.searchsorted(p, at) / len(p)
        in_u = np.maximum(1 - np.searchsorted(u, at) / len(u), 1 / len(u))
        ratio = in_u / in_p
        found.append(np.min(ratio * (1 + np.sqrt((1 - in_u) / (in_u * len(u)) + (1 - in_p) / (in_p * len(p))))))
    return float(np.clip(np.mean(found), 0.02, 0.98))


def fit(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> PuNetwork | None:
    """Network from labels of the training fold and unlabelled texts; None without a trusted positive."""
    ship(docs.sparkSession)
    known = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    known = known.filter(~held_out(F.col("doc_id")))
    draw = lambda df, n: df.select("doc_id").orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(n)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null").filter(~held_out(F.col("doc_id")))
    plain = ids.join(labels.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "left_anti")
    chosen = draw(known.filter("quality = 1"), max_positive).withColumn("p", F.lit(1)).union(draw(plain, max_unlabelled).withColumn("p", F.lit(0)))
    # The draw is bounded by the two parameters, so it may be broadcast and its features collected.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id", "left_semi")
    got = feature_table(texts).filter("x is not null").join(F.broadcast(chosen), "doc_id").select("p", "x").toArrow()
    if not got.num_rows:
        return None
    p = np.array(got["p"].to_pylist(), dtype=int)
    x = np.array(got["x"].to_pylist(), dtype=np.float64).reshape(len(p), -1)
    if not (p == 1).any():
        return None
    x = x[np.lexsort((*x.T[::-1], p))]  # the order of rows from the cluster does not matter
    p = np.sort(p)
    unlabelled = x[p == 0] if (p == 0).sum() >= LEAST_ROWS else x
    return PuNetwork(x[p == 1], unlabelled, estimate_prior(x[p == 1], x[p == 0]))


def score_quality(docs: DataFrame, labels: DataFrame, accept: float = ACCEPT, **bounds) -> DataFrame:
    """doc_id, held_out, score, predicted of every whole text."""
    net = fit(docs, labels, **bounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [features(t.as_py()) for t in b.column(2)]
            out, have = np.zeros(len(rows)), [i for i, r in enumerate(rows) if r is not None]
            if have:
                out[have] = net.score(np.array([rows[i] for i in have])) if net else 1.0
            yield pa.record_batch([b.column(0), b.column(1), pa.array(out), pa.array((out >= accept).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return cols.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """Rows of ``docs``, every column as it was, whose text is accepted."""
    net = fit(docs, labels)
    schema, at = docs.schema, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [features(t.as_py()) for t in b.column(at)]
            have = [i for i, r in enumerate(rows) if r is not None]
            good = net.score(np.array([rows[i] for i in have])) >= accept if have and net else np.ones(len(have), bool)
            yield b.take(pa.array([i for i, g in zip(have, good, strict=True) if g], pa.int64()))

    return docs.mapInArrow(run, schema)
