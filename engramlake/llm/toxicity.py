"""Toxicity by a character n-gram linear classifier scaled with naive Bayes log-count ratios.

Features are pairs (n-gram, level): an n-gram of 3 to 6 characters of the lower-cased text, hashed into ``2**BITS``
buckets, that occurs at least ``level`` times. Every feature is 0 or 1. Over the labelled training rows the documents of
each class that hold a feature are counted on the cluster, which gives the log-count ratio
``r = log((p + 1/2) / (P + 1)) - log((n + 1/2) / (N + 1))``; the ``FEATURES`` features that tell the classes apart best
(G statistic) are kept. A logistic regression with an L2 penalty is fitted on the features multiplied by their ratio.
Labels, language, source and id are never inputs of a score.

Bounds: training takes at most ``MAX_TOXIC`` and ``MAX_CLEAN`` labelled rows, the weights at most ``FIT_TOXIC`` and
``FIT_CLEAN`` of them, all drawn by least digest of the id, so the draw does not depend on partitions; classes are
weighted back to their shares among all labelled rows. The driver receives the kept features and, of the rows of the
last draw, the numbers of their kept features. All texts are counted and scored whole, in their own partitions, in
pieces of ``PIECE`` characters that overlap; no text is shuffled.

Defined cases: a null text counts as empty; a text without any kept feature (an empty one too) has the score of the
intercept; without a toxic training row every text scores 0, without a clean one 1; labels of one id that disagree
count as toxic, null labels and null ids are left out of training; a null id counts as training fold; repeated rows keep
one row each (and count once each in training); an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engramlake.llm.common import ship

FOLDS, HELD_OUT = 4, 2
ACCEPT = 0.3
ORDERS, LEVELS, BITS, FEATURES = (3, 4, 5, 6), (1, 2, 3, 5), 20, 4096
MAX_TOXIC, MAX_CLEAN, FIT_TOXIC, FIT_CLEAN = 50_000, 100_000, 5_000, 15_000
PENALTY, EPOCHS, SEED = 1e-3, 200, 11
PIECE = 1 << 20


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def buckets(text: str | None) -> Iterator[np.ndarray]:
    """Bucket of the n-gram at each place of a text, order by order and piece by piece."""
    a = np.frombuffer(f" {(text or '').lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    a[(a >= 9) & (a <= 13)] = 32
    for at in range(0, len(a), PIECE):
        piece = a[at : at + PIECE + ORDERS[-1] - 1]
        h = np.zeros(len(piece), np.uint32)
        for n in range(1, min(ORDERS[-1], len(piece)) + 1):
            h = h[: len(piece) - n + 1] * np.uint32(0x9E3779B1) + piece[n - 1 :] + np.uint32(1)
            if n in ORDERS:
                k = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
                yield ((k ^ (k >> np.uint32(13))) >> np.uint32(32 - BITS))[:PIECE]


def tally(text: str | None, slot: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text, or their slots where they have one, with the number of occurrences."""
    found, times = [], []
    for k in buckets(text):
        if slot is not None:
            k = slot[k]
            k = k[k >= 0]
        u, n = np.unique(k, return_counts=True)
        found.append(u)
        times.append(n)
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    u, back = np.unique(np.concatenate(found), return_inverse=True)
    return u.astype(np.int64), np.bincount(back, np.concatenate(times), len(u)).astype(np.int64)


COUNTS = [f"{c}{i}" for i in range(len(LEVELS)) for c in ("p", "n")]


def feature_counts(rows: DataFrame) -> DataFrame:
    """bucket and, for each level, the toxic (p) and clean (n) texts of ``rows`` (text, toxic) that reach it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = np.zeros((len(COUNTS), 1 << BITS), np.int32)
        for b in batches:
            for text, toxic in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                u, n = tally(text.as_py())
                for i, level in enumerate(LEVELS):
                    c[2 * i + (0 if toxic else 1), u[n >= level]] += 1
        used = np.flatnonzero(c.any(0))
        for at in range(0, len(used), 100_000):
            part = used[at : at + 100_000]
            yield pa.record_batch([pa.array(part.astype(np.int32)), *[pa.array(x[part].astype(np.int64)) for x in c]], names=["bucket", *COUNTS])

    seen = rows.select(F.col("text").cast("string").alias("text"), "toxic").mapInArrow(run, "bucket int, " + ", ".join(f"{c} long" for c in COUNTS))
    return seen.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in COUNTS])


def best_features(counts: DataFrame, n_toxic: int, n_clean: int, keep: int) -> DataFrame:
    """bucket, level number, log-count ratio of the ``keep`` features with the greatest G statistic; ties by bucket and level."""
    rows = counts.select("bucket", F.explode(F.array(*[F.struct(F.lit(i).alias("level"), F.col(f"p{i}").alias("p"), F.col(f"n{i}").alias("n")) for i in range(len(LEVELS))])).alias("x")).select("bucket", "x.*").filter("p + n > 0")
    total = n_toxic + n_clean
    have = F.col("p") + F.col("n")

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    g = part(F.col("p"), have * n_toxic / total) + part(F.col("n"), have * n_clean / total) + part(n_toxic - F.col("p"), (total - have) * n_toxic / total) + part(n_clean - F.col("n"), (total - have) * n_clean / total)
    ratio = F.log((F.col("p") + 0.5) / (n_toxic + 1)) - F.log((F.col("n") + 0.5) / (n_clean + 1))
    return rows.select("bucket", "level", ratio.alias("ratio"), F.round(g, 9).alias("g")).orderBy(F.desc("g"), "bucket", "level").limit(keep).drop("g")


class RatioModel:
    """Weights of the kept features; a text's score is the logistic of their sum and the intercept."""

    def __init__(self, bucket: np.ndarray, level: np.ndarray, ratio: np.ndarray):
        used, self.row = np.unique(bucket, return_inverse=True)
        self.level, self.ratio = level, ratio
        self.slot = np.full(1 << BITS, -1, np.int16 if len(used) < 1 << 15 else np.int32)
        self.slot[used] = np.arange(len(used))
        self.number = np.full((len(used), len(LEVELS)), -1, np.int64)
        self.number[self.row, level] = np.arange(len(bucket))
        self.weight, self.intercept = np.zeros(len(bucket)), 0.0

    def active(self, text: str | None) -> np.ndarray:
        """Numbers of the kept features that a text has."""
        u, n = tally(text, self.slot)
        on = self.number[u][n[:, None] >= np.array(LEVELS)]
        return on[on >= 0]

    def fit(self, rows: list[np.ndarray], toxic: np.ndarray, n_toxic: int, n_clean: int) -> None:
        """Logistic loss weighted to ``n_toxic`` and ``n_clean`` rows, L2 penalty, full-batch Adam."""
        sizes = np.array([len(r) for r in rows])
        at, of = np.concatenate([np.zeros(0, np.int64), *rows]).astype(np.int64), np.repeat(np.arange(len(rows)), sizes)
        share = np.where(toxic, n_toxic / max(toxic.sum(), 1), n_clean / max((~toxic).sum(), 1)) / (n_toxic + n_clean)
        w, b = np.zeros(len(self.ratio)), 0.0
        m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
        for t in range(1, EPOCHS + 1):
            z = np.bincount(of, (w * self.ratio)[at], len(rows)) + b
            d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - toxic) * share
            g = np.append(np.bincount(at, d[of], len(w)) * self.ratio + PENALTY * w, d.sum())
            m = 0.9 * m + 0.1 * g
            v = 0.99 * v + 0.01 * g * g
            step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
            w, b = w - step[:-1], b - step[-1]
        self.weight, self.intercept = w * self.ratio, b

    def score(self, text: str | None) -> float:
        z = self.weight[np.sort(self.active(text))].sum() + self.intercept
        return round(float(1 / (1 + np.exp(-np.clip(z, -30, 30)))), 9)


class OneClass:
    """Stands in where the training rows hold one class only."""

    def __init__(self, value: float):
        self.value = value

    def score(self, text: str | None) -> float:
        return self.value


def fit(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN, fit_toxic: int = FIT_TOXIC, fit_clean: int = FIT_CLEAN, keep: int = FEATURES) -> RatioModel | OneClass:
    """Model from the labels of the training fold."""
    ship(docs.sparkSession)
    known = labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).alias("toxic"))
    known = known.filter(~held_out(F.col("doc_id")))
    n = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if len(n) < 2:
        return OneClass(1.0 if n.get(True) else 0.0)

    def draw(rows: DataFrame, toxic: bool, most: int) -> DataFrame:
        return rows.filter(F.col("toxic") == toxic).select("doc_id", "toxic", F.xxhash64("doc_id", F.lit(SEED)).alias("tx_draw")).orderBy("tx_draw", "doc_id").limit(most)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter(F.col("doc_id").isNotNull())

    def drawn(toxic_rows: int, clean_rows: int) -> DataFrame:
        # At most the sum of the two bounds, so the ids may be broadcast.
        ids = draw(known, True, toxic_rows).union(draw(known, False, clean_rows)).select("doc_id", "toxic")
        return texts.join(F.broadcast(ids), "doc_id")

    counted = drawn(max_toxic, max_clean)
    sizes = {r["toxic"]: r["count"] for r in counted.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return OneClass(1.0 if sizes.get(True) else 0.0)
    kept = best_features(feature_counts(counted), sizes[True], sizes[False], keep).toArrow()
    model = RatioModel(*[kept[c].to_numpy() for c in ("bucket", "level", "ratio")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            on = [np.sort(model.active(t.as_py())) for t in b.column(2)]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(on, pa.list_(pa.int32()))], names=["doc_id", "toxic", "on"])

    rows = drawn(fit_toxic, fit_clean).select("doc_id", "toxic", "text").mapInArrow(run, "doc_id long, toxic boolean, on array<int>").toArrow()
    on = [np.array(x, np.int64) for x in rows["on"].to_pylist()]
    ids = rows["doc_id"].to_pylist()
    order = sorted(range(len(on)), key=lambda i: (ids[i], on[i].tobytes()))  # the order of rows from the cluster does not matter
    model.fit([on[i] for i in order], np.array(rows["toxic"].to_pylist(), bool)[order], n[True], n[False])
    return model


def score_toxicity(docs: DataFrame, labels: DataFrame, accept: float = ACCEPT, **bounds) -> DataFrame:
    """doc_id, held_out, score, predicted of every whole text."""
    model = fit(docs, labels, **bounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.array([model.score(t.as_py()) for t in b.column(2)], np.float64)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(out), pa.array((out >= accept).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return cols.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, labels: DataFrame, accept: float = ACCEPT, **bounds) -> DataFrame:
    """Rows of ``docs``, every column as it was, whose text scores below the limit."""
    model = fit(docs, labels, **bounds)
    schema, at = docs.schema, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.take(pa.array([i for i, t in enumerate(b.column(at)) if model.score(t.as_py()) < accept], pa.int64()))

    return docs.mapInArrow(run, schema)
