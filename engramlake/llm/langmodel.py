"""Language-model scores by a hashed maximum-entropy model with a class-factored softmax.

Tokens are the words of the text (ASCII letters lower-cased) and one end. A word's surface (its last three bytes) is
hashed to one of 1,024 buckets; buckets with like neighbours form 64 classes, and the end has a class of its own. The
model is ``P(word | history) = P(class | history) * P(word | class)``. The class softmax is log-linear in hashed
features of the history: a bias, the class of the previous word (bigram), of the word before it (skip) and of both
together (trigram, hashed). Inside a class a word has ``(c + 1) / (N_class + V_class + 1)``; the one left over is the
class's unseen word, so the probabilities of a history sum to one.

Training. Counts come from every training text: word counts by a map-side combined aggregation, and counts of bucket
pairs (for the classes) and of (history, class), each packed into 16 blocks per task and summed in two streaming steps.
The latter are the sufficient statistics of the likelihood, so each gradient step is exact over all training text:
tasks hold blocks of histories, get the weights (a fixed 1.1 MB) and return the gradient of their blocks; the driver
adds a fixed number of small arrays.

Scoring. Numpy batches look up only the histories that occur in them. Counts of the most frequent words (at most
``HOT_WORDS``, chosen by a count threshold from the histogram of counts) are sent to the tasks; every other word leaves
the task as (document, word) and meets its count in a join, so no vocabulary is ever held whole.

Defined cases: a null text is empty and has only its end; a null id counts as training; repeated rows are scored alike
and train twice; without training text every count is zero; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engramlake.llm.common import ship
from engramlake.session import materialise

FOLDS, HELD_OUT = 7, 2
BUCKETS, GROUPS = 1024, 64
#: Before and after a text stands a bucket, and a class, of its own.
EDGE, CLASSES = BUCKETS, GROUPS + 1
HISTORIES = CLASSES * CLASSES
TRIGRAMS = 4096
FEATURES = 1 + 2 * CLASSES + TRIGRAMS
BLOCKS, SALTS, STEPS = 16, 32, 14
HOT_WORDS, FLUSH = 1_000_000, 300_000
#: Key of the end token; no word can hold a space.
END = b" end"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD_OUT, F.lit(False))


class Buckets(dict):
    """Bucket of a word by its last three bytes, remembered."""

    def __missing__(self, tail: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[tail] = b = zlib.crc32(tail) % BUCKETS
        return b


BUCKET = Buckets()


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def buckets(tokens: list[bytes]) -> np.ndarray:
    return np.fromiter((BUCKET[w[-3:]] for w in tokens), np.int32, len(tokens))


def bucket_pairs(tokens: list[bytes]) -> np.ndarray:
    """Cell of (bucket, next bucket) for every token, the end included."""
    b = np.concatenate([[EDGE], buckets(tokens), [EDGE]])
    return b[:-1] * (BUCKETS + 1) + b[1:]


def histories(tokens: list[bytes], groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """History number and class of every token, the end included."""
    g = np.concatenate([[GROUPS, GROUPS], groups[buckets(tokens)], [GROUPS]])
    return g[:-2] * CLASSES + g[1:-1], g[2:]


def bucket_groups(pairs: np.ndarray) -> np.ndarray:
    """Class of every bucket: k-means over the leading directions of its neighbours on either side."""
    m = np.sqrt(pairs.astype(np.float64))
    mass = pairs.sum(0) + pairs.sum(1)
    both = np.concatenate([m / (np.sqrt((m**2).sum(1, keepdims=True)) + 1e-9), (m / (np.sqrt((m**2).sum(0, keepdims=True)) + 1e-9)).T], 1)[:BUCKETS]
    w = np.sqrt(mass[:BUCKETS] + 1.0)
    mean = (both * w[:, None]).sum(0) / w.sum()
    centred = both - mean
    _, vectors = np.linalg.eigh((centred * w[:, None]).T @ centred)
    x = centred @ vectors[:, -24:]
    order = np.argsort(-mass[:BUCKETS], kind="stable")
    centre = x[order[:GROUPS]].copy()
    for _ in range(30):
        near = ((x[:, None, :] - centre[None]) ** 2).sum(2).argmin(1)
        for k in range(GROUPS):
            if (near == k).any():
                centre[k] = np.average(x[near == k], axis=0, weights=w[near == k])
    return np.append(near, GROUPS).astype(np.int32)


def feature_rows(pairs: np.ndarray) -> np.ndarray:
    """The four hashed feature numbers of each history."""
    two, one = pairs // CLASSES, pairs % CLASSES
    tri = ((pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % TRIGRAMS
    return np.stack([np.zeros_like(one), 1 + one, 1 + CLASSES + two, 1 + 2 * CLASSES + tri], 1)


def class_logs(weights: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    z = weights[feature_rows(pairs)].sum(1)
    z -= z.max(1, keepdims=True)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


def word_counts(train: DataFrame) -> DataFrame:
    """word, bucket, n over all training text; the end included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(found: Counter) -> Iterator[pa.RecordBatch]:
            items = list(found.items())
            for i in range(0, len(items), 50_000):
                part = items[i : i + 50_000]
                where = [EDGE if w == END else BUCKET[w[-3:]] for w, _ in part]
                yield pa.record_batch([pa.array([w for w, _ in part], pa.binary()), pa.array(where, pa.int32()), pa.array([n for _, n in part], pa.int64())], names=["word", "bucket", "n"])

        found: Counter = Counter()
        for b in batches:
            for t in b.column(0):
                found.update(words(t.as_py()))
                found[END] += 1
                if len(found) > FLUSH:
                    yield from out(found)
                    found = Counter()
        yield from out(found)

    return train.mapInArrow(run, "word binary, bucket int, n long").groupBy("word", "bucket").agg(F.sum("n").alias("n"))


def _blocks(sums: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    salt = (TaskContext.get().partitionId() if TaskContext.get() else 0) % SALTS
    for k, v in sums.items():
        yield pa.record_batch([pa.array([k], pa.int32()), pa.array([salt], pa.int32()), pa.array([zlib.compress(v.tobytes(), 1)], pa.binary())], names=["block", "salt", "counts"])


def packed_counts(train: DataFrame, cells_of, n_cells: int) -> DataFrame:
    """block, salt, counts: how often each cell of ``cells_of(tokens)`` occurs, one packed row per block."""
    width = -(-n_cells // BLOCKS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width * BLOCKS, np.int64)
        for b in batches:
            held: list[np.ndarray] = []
            size = 0
            for t in b.column(0):
                held.append(cells_of(words(t.as_py())))
                size += len(held[-1])
                if size > 2_000_000:
                    total += np.bincount(np.concatenate(held), minlength=len(total))
                    held, size = [], 0
            if held:
                total += np.bincount(np.concatenate(held), minlength=len(total))
        yield from _blocks({k: v for k, v in enumerate(total.reshape(BLOCKS, -1)) if v.any()})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, raw in zip(b.column(0).to_pylist(), b.column(2), strict=True):
                v = np.frombuffer(zlib.decompress(raw.as_py()), np.int64)
                sums[k] = sums[k] + v if k in sums else v
        yield from _blocks(sums)

    schema = "block int, salt int, counts binary"
    part = train.mapInArrow(count, schema).repartition(BLOCKS * 2, "block", "salt").mapInArrow(add, schema)
    return part.repartition(BLOCKS, "block").mapInArrow(add, schema)


def history_counts(train: DataFrame, groups: np.ndarray) -> DataFrame:
    def cells(tokens: list[bytes]) -> np.ndarray:
        pairs, cls = histories(tokens, groups)
        return pairs * CLASSES + cls

    # A whole number of histories in each block.
    return packed_counts(train, cells, -(-HISTORIES // BLOCKS) * BLOCKS * CLASSES)


def pair_matrix(train: DataFrame) -> np.ndarray:
    """Counts of neighbouring buckets over all training text; a matrix of fixed size."""
    side = BUCKETS + 1
    width = -(-side * side // BLOCKS)
    total = np.zeros(width * BLOCKS, np.int64)
    for block, raw in zip(*[c.to_pylist() for c in packed_counts(train, bucket_pairs, side * side).select("block", "counts").toArrow().columns], strict=True):
        total[block * width : (block + 1) * width] += np.frombuffer(zlib.decompress(raw), np.int64)
    return total[: side * side].reshape(side, side)


def train_weights(stats: DataFrame, steps: int = STEPS) -> np.ndarray:
    """Class-softmax weights after ``steps`` distributed gradient steps over the counted histories."""
    width = -(-HISTORIES // BLOCKS)
    weights = np.zeros((FEATURES, CLASSES), np.float32)
    seen = None
    for step in range(steps + 1):
        given = weights

        def gradient(batches: Iterator[pa.RecordBatch], given=given, start=step == 0) -> Iterator[pa.RecordBatch]:
            total = np.zeros((FEATURES, CLASSES))
            for b in batches:
                for k, raw in zip(b.column(0).to_pylist(), b.column(2), strict=True):
                    counts = np.frombuffer(zlib.decompress(raw.as_py()), np.int64).reshape(-1, CLASSES).astype(np.float64)
                    live = np.flatnonzero(counts.any(1))
                    pairs, counts = live + k * width, counts[live]
                    rows = feature_rows(pairs)
                    n = counts.sum(1, keepdims=True)
                    p = np.exp(class_logs(given, pairs)) if not start else 0 * counts
                    for f in range(rows.shape[1]):
                        np.add.at(total, rows[:, f], counts if start else n * p)
            yield pa.record_batch([pa.array([total.astype(np.float32).tobytes()], pa.binary())], names=["g"])

        parts = stats.mapInArrow(gradient, "g binary").toArrow().column(0).to_pylist()
        total = sum((np.frombuffer(g, np.float32).reshape(FEATURES, CLASSES).astype(np.float64) for g in parts), np.zeros((FEATURES, CLASSES)))
        if step == 0:
            seen = total
            bias = np.log((seen[0] + 1) / (seen[0] + 1).sum())
            weights = weights.copy()
            weights[0] = bias
            continue
        # Likelihood gradient (seen - expected), scaled by the expected mass of each weight.
        move = np.clip((seen - total) / (total + 3.0), -1.5, 1.5)
        weights = (weights + 0.5 * move).astype(np.float32)
    return weights


def score_documents(docs: DataFrame, steps: int = STEPS, hot_words: int = HOT_WORDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ship(docs.sparkSession)
    spark = docs.sparkSession
    train = docs.filter(~held_out(F.col("doc_id"))).select("text")
    counts = materialise(word_counts(train), "lm-words")
    groups = bucket_groups(pair_matrix(train))
    stats = materialise(history_counts(train, groups), "lm-histories")
    class_n, class_v = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    for r in counts.groupBy("bucket").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        class_n[groups[r["bucket"]]] += r["n"]
        class_v[groups[r["bucket"]]] += r["v"]
    n_all, v_all = int(class_n.sum()), int(class_v.sum())
    weights = train_weights(stats, steps)

    # The least count whose words are few enough to send; the histogram has as many rows as there are small counts.
    sizes = counts.select(F.least("n", F.lit(10_000)).alias("n")).groupBy("n").agg(F.count("*").alias("v")).collect()
    least, left = 10_001, hot_words
    for r in sorted(sizes, key=lambda r: -r["n"]):
        left -= r["v"]
        if left < 0:
            break
        least = r["n"]
    hot = counts.filter(F.col("n") >= least).select("word", "n").toArrow() if least <= 10_000 else None
    sent = spark.sparkContext.broadcast((weights, dict(zip(hot["word"].to_pylist(), hot["n"].to_pylist(), strict=True)) if hot else {}))
    inside = np.log10(class_n + class_v + 1.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, known = sent.value
        logs = {n: float(np.log10(n + 1)) for n in range(1, 4096)}
        names = ["doc_id", "text_key", "word", "rows", "tokens", "known", "log_counts", "context"]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        for b in batches:
            out: list[tuple] = []
            for i, key, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                tokens = words(t.as_py())
                pairs, cls = histories(tokens, groups)
                seen, place = np.unique(pairs, return_inverse=True)
                context = float((class_logs(weights, seen)[place, cls] / np.log(10)).sum() - inside[cls].sum())
                n_known, total = 0, 0.0
                for w, n in [*Counter(tokens).items(), (END, 1)]:
                    c = known.get(w)
                    if c is None:
                        out.append((i, key, w, 0, n, 0, 0.0, 0.0))
                    else:
                        n_known += n
                        total += n * (logs.get(c) or float(np.log10(c + 1)))
                out.append((i, key, b" %d %d" % (i or 0, key), 1, len(tokens) + 1, n_known, total, context))
                if len(out) > 50_000:
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                    out = []
            if out:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    schema = "doc_id long, text_key long, word binary, rows long, tokens long, known long, log_counts double, context double"
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), "text").mapInArrow(run, schema)
    rare = (counts.filter(F.col("n") < least) if hot else counts).select("word", "n")
    met = rows.join(rare, "word", "left")
    found = F.col("rows") == 0
    doc = met.groupBy("doc_id", "text_key").agg(
        F.sum("rows").alias("copies"),
        F.sum(F.when(~found, F.col("tokens"))).alias("n_tokens"),
        F.sum(F.when(found & F.col("n").isNotNull(), F.col("tokens")).when(~found, F.col("known")).otherwise(0)).alias("n_known"),
        F.sum(F.when(found, F.col("tokens") * F.log10(F.coalesce("n", F.lit(0)) + 1.0)).otherwise(F.col("log_counts"))).alias("logs"),
        F.sum("context").alias("context"),
    )
    doc = doc.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    each = lambda c: F.col(c) / F.col("copies")
    return doc.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"),
        each("n_tokens").cast("long").alias("n_tokens"), each("n_known").cast("long").alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"),
        (each("logs") - each("n_tokens") * F.lit(float(np.log10(n_all + v_all + 1)))).alias("base_score"),
        (each("logs") + each("context")).alias("score"),
    )
