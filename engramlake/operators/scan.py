"""Exact top-k of few questions over a whole table in one pass, without an index.

The questions' terms are sent to the tasks. A task reads its rows once, counts for every row the terms it shares with
every question (numpy, in batches of bounded size) and keeps the ``k`` best rows of each question, so a task gives at most
``k`` rows a question and nothing else is shuffled. What a task holds is bounded by the questions, whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engramlake.operators import skew

#: Questions, and terms of all of them together, up to which the questions are sent to the tasks.
MOST_QUESTIONS, MOST_TERMS = 1_000, 200_000
#: Pairs (row, question) that a task scores at a time.
PAIRS = 65_536


def question_terms(q: DataFrame, terms: Column) -> list[tuple[int, list[str]]] | None:
    """The distinct terms of each question, or None where the questions are too many to be sent."""
    t = q.select("query_id", F.array_distinct(F.coalesce(terms, F.array().cast("array<string>"))).alias("terms"))
    if len(t.select("query_id").head(MOST_QUESTIONS + 1)) > MOST_QUESTIONS or (t.agg(F.sum(F.size("terms"))).first()[0] or 0) > MOST_TERMS:
        return None
    found: dict[int, dict[str, None]] = {}
    for r in t.orderBy("query_id").collect():
        found.setdefault(r["query_id"], {}).update(dict.fromkeys(r["terms"]))
    return [(i, list(w)) for i, w in found.items()]


def best_rows(asked: list[tuple[int, list[str]]], rows: DataFrame, k: int, score: Callable, inside: bool = False) -> DataFrame:
    """query_id, id, matches, score, rank: the ``k`` best rows of every question that share a term with it; ties by id.

    ``rows``: id, words (binary, parted by white space) and value (double). ``score(matches, asked, words, value)`` gives the
    scores of a block of rows by questions from arrays: shared terms, terms of the question, distinct words and value of the
    row. With ``inside`` a term is shared by a row that has it anywhere in a word. Scores are rounded to nine digits.
    """
    ids = np.array([i for i, _ in asked], np.int64)
    terms = sorted({t.encode() for _, ts in asked for t in ts})
    number = {t: n for n, t in enumerate(terms)}
    # The questions of each term, one list after the other.
    held: list[list[int]] = [[] for _ in terms]
    for n, (_, ts) in enumerate(asked):
        for t in ts:
            held[number[t.encode()]].append(n)
    start = np.cumsum([0, *[len(h) for h in held]])
    holders = np.array([n for h in held for n in h], np.int64)
    a = np.array([len(ts) for _, ts in asked], np.int64)
    lengths = sorted({len(t) for t in terms})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from decimal import ROUND_HALF_UP, Decimal

        unit = Decimal("0.000000001")
        known: dict[bytes, tuple[int, ...]] = {}
        n_q = len(ids)
        best: list[tuple] = [(np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)) for _ in range(n_q)]
        least, last = np.full(n_q, -np.inf), np.full(n_q, np.iinfo(np.int64).max)

        def parts(word: bytes) -> tuple[int, ...]:
            """Numbers of the terms inside a word; remembered for words of common length."""
            found = {number[word[i : i + n]] for n in lengths if n <= len(word) for i in range(len(word) - n + 1) if word[i : i + n] in number}
            out = tuple(found)
            if len(word) <= 64:
                if len(known) > 300_000:
                    known.clear()
                known[word] = out
            return out

        def shared(words: set[bytes]) -> set[int]:
            if not inside:
                return {number[w] for w in words & number.keys()}
            out: set[int] = set()
            for w in words:
                p = known.get(w)
                out.update(parts(w) if p is None else p)
            return out

        def take(keys: np.ndarray, hits: list[list[int]], sizes: np.ndarray, values: np.ndarray) -> None:
            row = np.repeat(np.arange(len(hits)), [len(h) for h in hits])
            term = np.array([t for h in hits for t in h], np.int64)
            many = start[term + 1] - start[term]
            step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            pair = np.repeat(row, many) * n_q + holders[np.repeat(start[term], many) + step]
            matches = np.bincount(pair, minlength=len(hits) * n_q).reshape(-1, n_q)
            with np.errstate(divide="ignore", invalid="ignore"):
                raw = np.where(matches > 0, score(matches, a[None, :], sizes[:, None], values[:, None]), -np.inf)
            r, c = np.nonzero((raw >= least[None, :] - 1e-8) & (matches > 0))
            if not len(r):
                return
            # Rounded as Spark rounds, so that ties are the same.
            plain, where = np.unique(raw[r, c], return_inverse=True)
            exact = np.array([float(Decimal(repr(float(x))).quantize(unit, ROUND_HALF_UP)) for x in plain])[where]
            ok = (exact > least[c]) | ((exact == least[c]) & (keys[r] < last[c]))
            r, c, exact = r[ok], c[ok], exact[ok]
            order = np.argsort(c, kind="stable")
            r, c, exact = r[order], c[order], exact[order]
            found, first = np.unique(c, return_index=True)
            for n, lo, hi in zip(found, first, [*first[1:], len(c)], strict=True):
                s, i, m, x = (np.concatenate(z) for z in zip(best[n], (exact[lo:hi], keys[r[lo:hi]], matches[r[lo:hi], n], raw[r[lo:hi], n]), strict=True))
                keep = np.lexsort((i, -s))[:k]
                best[n] = (s[keep], i[keep], m[keep], x[keep])
                if len(keep) == k:
                    least[n], last[n] = best[n][0][-1], best[n][1][-1]

        size = max(1, PAIRS // max(1, n_q))
        for b in batches:
            keys, values = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64), b.column(2).to_numpy(zero_copy_only=False).astype(np.float64)
            at: list[int] = []
            hits: list[list[int]] = []
            sizes: list[int] = []
            for n in range(b.num_rows):
                words = set(b.column(1)[n].as_py().split())
                h = shared(words)
                if h:
                    at.append(n)
                    hits.append(list(h))
                    sizes.append(len(words))
                if len(at) >= size or (at and n == b.num_rows - 1):
                    take(keys[at], hits, np.array(sizes, np.int64), values[at])
                    at, hits, sizes = [], [], []
        out = [(q, x) for q, x in zip(ids.tolist(), best, strict=True) if len(x[1])]
        if out:
            cols = [np.concatenate(z) for z in ([np.full(len(x[1]), q) for q, x in out], [x[1] for _, x in out], [x[2] for _, x in out], [x[3] for _, x in out])]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64()]
            yield pa.record_batch([pa.array(z, kind) for z, kind in zip(cols, kinds, strict=True)], names=["query_id", "id", "matches", "score"])

    r = rows.select(F.col("id").cast("long").alias("id"), "words", F.col("value").cast("double").alias("value")).filter("id is not null and words is not null and value is not null")
    found = r.mapInArrow(run, "query_id long, id long, matches long, score double").withColumn("score", F.round("score", 9))
    return skew.top_k(found, ["query_id"], [F.desc("score"), F.col("id")], k)
