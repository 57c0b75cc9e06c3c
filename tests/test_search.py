"""Paths, components, vectors, term blocks and covering intervals against plain loops, with counts of the rows they form."""

from __future__ import annotations

import random
from collections import defaultdict
from itertools import permutations

import numpy as np
import pytest
from engramlake.operators import evidence, paths, recall, skew, temporal, topterms
from engramlake.operators import vectors as VX
from pyspark.sql import functions as F


@pytest.fixture
def written(monkeypatch):
    """Rows of every table a module writes, by label."""
    rows = defaultdict(list)

    def watch(module):
        plain = module.materialise

        def counted(df, label):
            out = plain(df, label)
            rows[label].append(out.count())
            return out

        monkeypatch.setattr(module, "materialise", counted)
        return rows

    return watch


# paths ---------------------------------------------------------------------------------------------------------------

def plain_paths(edges, pairs, depth):
    near = defaultdict(set)
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    out = {}
    for a, b in pairs:
        level = {a: (a,)}
        seen = {a}
        for d in range(1, depth + 1):
            nxt = {}
            for n, p in level.items():
                for m in near[n] - seen:
                    nxt[m] = min(nxt.get(m, (*p, m)), (*p, m))
            if b in nxt:
                out[a, b] = d, nxt[b]
                break
            seen |= set(nxt)
            level = nxt
    return out


@pytest.mark.parametrize("depth", [1, 3, 5])
def test_shortest_paths_against_plain_search(spark, depth):
    r = random.Random(depth)
    edges = {(r.randrange(60), r.randrange(60)) for _ in range(90)} | {(70, 71), (3, 3)}
    pairs = {(r.randrange(64), r.randrange(75)) for _ in range(150)}
    e = spark.createDataFrame([(a, b, "related", 0.5) for a, b in edges], "src long, dst long, type string, strength double")
    got = paths.shortest_paths(spark.createDataFrame(list(pairs), "a long, b long"), e, depth).collect()
    assert {(x.a, x.b): (x.length, tuple(x.path)) for x in got} == plain_paths(edges, [p for p in pairs if p[0] != p[1]], depth)
    assert len(got) == len({(x.a, x.b) for x in got})


def test_shortest_paths_do_not_open_hubs(spark, written):
    rows = written(paths)
    n = 100_000
    e = spark.range(1, n + 1).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"))
    e = e.union(spark.createDataFrame([(i, n + i) for i in range(1, 51)], "src long, dst long")).withColumn("type", F.lit("related")).withColumn("strength", F.lit(0.5))
    pairs = [(i, i + 50) for i in range(1, 40)] + [(n + i, i + 1) for i in range(1, 40)] + [(i, n + 50 - i) for i in range(1, 24)]
    got = {(x.a, x.b): x.path for x in paths.shortest_paths(spark.createDataFrame(pairs, "a long, b long"), e, 3).collect()}
    assert got[1, 51] == [1, 0, 51] and got[n + 3, 4] == [n + 3, 3, 0, 4] and got[2, n + 48] == [2, 0, 48, n + 48] and len(got) == len(pairs)
    assert sum(rows["path-step"]) < 10 * len(pairs) and sum(rows["path-front"]) < 20 * len(pairs)


def plain_cycles(edges, longest):
    nodes = sorted({x for e in edges for x in e})
    out = set()
    for n in range(2, longest + 1):
        for p in permutations(nodes, n):
            if p[0] == min(p) and all((p[i], p[(i + 1) % n]) in edges for i in range(n)):
                out.add(p)
    return out


def test_cycles_and_components_against_plain_search(spark):
    for seed in range(3):
        r = random.Random(seed)
        edges = {(r.randrange(9), r.randrange(9)) for _ in range(16)} | {(20, 21), (21, 22)}
        e = spark.createDataFrame(list(edges), "src long, dst long")
        got = [tuple(x.path) for x in paths.cycles(e, 4).collect()]
        assert sorted(got) == sorted(plain_cycles({x for x in edges if x[0] != x[1]}, 4))
        reach = {n: {n} for n in range(30)}
        for _ in range(30):
            for a, b in edges:
                reach[a] |= reach[b]
        same = defaultdict(set)
        for a in reach:
            for b in reach[a]:
                if a != b and a in reach[b]:
                    same[a] |= {a, b}
        found = {x.node: x.component for x in paths.strong_components(e).collect()}
        assert found == {n: max(m) for n, m in same.items()}


def test_long_acyclic_graph_grows_no_path(spark, written):
    rows = written(paths)
    n = spark.range(0, 500_000)
    e = n.select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")).union(n.select((F.col("id") * 7919 % 500_000).alias("src"), (F.col("id") * 7919 % 500_000 + 11).alias("dst")))
    assert paths.cycles(e).count() == 0
    assert rows["cycle-edges"] == [1_000_000, 0] and len(rows["trim"]) <= 1


# vectors -------------------------------------------------------------------------------------------------------------

def test_inverted_file_against_numpy(spark, tmp_path):
    r = np.random.default_rng(5)
    heart = r.normal(0, 1, (12, 16))
    x = heart[r.integers(0, 12, 900)] + r.normal(0, 0.3, (900, 16))
    x[700:800] = x[700]  # many copies of one vector
    vec = spark.createDataFrame([(i, v.tolist(), "k") for i, v in enumerate(x)] + [(5000, None, "k")], "vec_id long, embedding array<double>, cell string")
    index = VX.store_vectors(vec, str(tmp_path / "index"), cells=15)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    score = np.round(unit @ unit.T, 9)
    qv = vec.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    want = {(i, int(j), k + 1) for i in range(0, 900, 50) for k, j in enumerate(np.lexsort((np.arange(900), -score[i]))[:7])}
    for i in (index, VX.open_vectors(spark, str(tmp_path / "index"))):
        assert {(x.query_id, x.vec_id, x["rank"]) for x in VX.search(qv, i, 7, block=4).collect()} == want
    assert all(x.score >= 0.9 for x in VX.search(qv, index, 7, threshold=0.9).collect())
    recall_ = VX.recall_of(VX.ann(qv, index, 7), VX.knn(qv, index, 7)).agg(F.sum("found") / F.sum("expected")).first()[0]
    assert recall_ >= 0.9
    none = VX.store_vectors(vec.filter("false"), str(tmp_path / "none"))
    assert VX.search(qv, none, 3).count() == 0 and VX.search(qv.filter("false"), index, 3).count() == 0


# term blocks ---------------------------------------------------------------------------------------------------------

COMMON = ["the", "of", "and", "to", "in"]


def memory_rows(n, seed=2):
    r = random.Random(seed)
    text = lambda: " ".join([w for w in COMMON if r.random() < 0.7] + [f"word{r.randrange(3000)}" for _ in range(r.randint(0, 12))])
    return [(i, text(), round(0.3 + 0.1 * r.randrange(7), 1)) for i in range(n)]


def ranked(scores, k):
    return sorted(((-s, i) for i, s in scores.items()))[:k]


def test_word_searches_equal_plain_loops_with_few_pairs(spark, monkeypatch):
    rows = memory_rows(4000)
    mem = spark.createDataFrame(rows, "memory_id long, content string, importance double")
    queries = [(1, "the of and"), (2, "the and to in"), (3, "word5 word17 the"), (4, "ord1 of"), (5, "zzz"), (6, "in the word8 word9 word10 of")]
    q = spark.createDataFrame(queries, "query_id long, text string")
    pairs = {}
    plain = topterms.candidates

    def counted(units, *a, **k):
        out = plain(units, *a, **k)
        pairs.update({r.query_id: r["count"] for r in out.groupBy("query_id").count().collect()})
        return out

    monkeypatch.setattr(topterms, "candidates", counted)
    got = {(r.query_id, r["rank"]): (r.memory_id, r.score) for r in recall.keyword_search(q, mem, 5).collect()}
    want = {}
    for qid, t in queries:
        s = {i: round(0.5 * m + 0.3 * imp, 9) for i, c, imp in rows if (m := sum(any(w in x for x in c.split()) for w in set(t.split())))}
        want |= {(qid, k + 1): (i, -x) for k, (x, i) in enumerate(ranked(s, 5))}
    assert got == want
    formed = {qid: sum(sum(w in c.split() for w in t.split()) for _, c, _ in rows) for qid, t in queries}
    assert all(pairs[i] < 0.1 * formed[i] for i in (1, 2))
    got = {(r.query_id, r["rank"]): (r.memory_id, r.score) for r in recall.jaccard_search(q, mem, 5).collect()}
    want = {}
    for qid, t in queries:
        a = set(t.split())
        s = {i: round(len(a & set(c.split())) / len(a | set(c.split())), 9) for i, c, _ in rows if a & set(c.split())}
        want |= {(qid, k + 1): (i, -x) for k, (x, i) in enumerate(ranked(s, 5))}
    assert got == want
    assert all(pairs[i] < 0.1 * formed[i] for i in (1, 2))
    assert recall.keyword_search(q, mem.filter("false"), 5).count() == 0 and recall.jaccard_search(q.filter("false"), mem, 5).count() == 0


def turns(spark, n=600, seed=4):
    r = random.Random(seed)
    words = "plan team server review bought items moved never because meeting doctor physician planned reviews the and did may ago yesterday 2024 spent $5".split()
    rows = [(i, i // 20, i % 20, r.choice(["user", "assistant"]), f"user_{r.randrange(5)}", " ".join(r.choice(words) for _ in range(r.randint(1, 9))), f"20{20 + r.randrange(5)}-0{r.randrange(1, 9)}-11 10:00:00") for i in range(n)]
    return spark.createDataFrame(rows, "message_id long, conv_id long, turn long, role string, speaker string, text string, created_at string").withColumn("created_at", F.col("created_at").cast("timestamp"))


QUESTIONS = [(1, "When did the Team review items?", "user_1"), (2, "How many plans did I spend money on recently?", "user_2"), (3, "Which doctor did user_3 visit in May?", "user_3"), (4, "the and did", "user_9"), (5, "What is the current server, yesterday or 2024-02-11?", None)]


def test_best_evidence_equals_the_best_of_all_scores(spark):
    q, msg = spark.createDataFrame(QUESTIONS, "query_id long, text string, subject string"), turns(spark)
    blocks = temporal.turn_blocks(msg)
    full = evidence.evidence_score(q, msg)
    want = sorted((r.query_id, r["rank"], r.message_id, r.score) for r in evidence.top_evidence(full.select("query_id", "message_id", "score"), 9).collect())
    for b in (None, blocks):
        got = sorted((r.query_id, r["rank"], r.message_id, r.score) for r in evidence.top_evidence_scored(q, msg, 9, b).collect())
        assert got == want


def test_evidence_rank_with_synonyms_stop_words_and_time_notes(spark):
    msg = spark.createDataFrame([(1, "a", "the physician was kind", None, None), (2, "a", "the doctor was kind", None, None), (3, "b", "which doctorate", None, None), (4, "b", "a server", None, "since 2024"), (5, "b", "a server", "2021-06-01 00:00:00", None)],
                                "message_id long, speaker string, text string, created_at string, time_scope string").withColumn("created_at", F.col("created_at").cast("timestamp"))
    q = spark.createDataFrame([(1, "Which doctor?", "x"), (2, "the current server", "x"), (3, "can you help", "x")], "query_id long, text string, subject string")
    got = {(r.query_id, r.message_id): r.score for r in evidence.rank_evidence(q, msg, 10).collect()}
    # Question 1 has nine words with the synonyms, question 2 two without "the"; half points for physicians and doctors.
    assert got == {(1, 1): pytest.approx(15 / 9 + 10, abs=1e-6), (1, 2): pytest.approx(15 / 9 + 10, abs=1e-6), (1, 3): pytest.approx(10 / 9 + 10, abs=1e-6),
                   (2, 4): pytest.approx(5 + 10 + 7.5, abs=1e-6), (2, 5): pytest.approx(5 + 10 + 1.5 * (1.5 + 0.5), abs=1e-6)}


# intervals -----------------------------------------------------------------------------------------------------------

def test_latest_covering_interval_against_plain_loop(spark):
    r = random.Random(6)
    at = lambda s: f"2024-01-01 00:00:00.{s:06d}" if s < 1_000_000 else f"2024-0{1 + s // 1_000_000 % 9}-{1 + s % 27:02d} 0{s % 7}:00:00"
    spans = []
    for i in range(300):
        a, b = sorted((r.randrange(2_000_000, 9_000_000), r.randrange(2_000_000, 9_000_000))) if i % 2 else sorted((r.randrange(1000), r.randrange(1000)))
        a, b = sorted((at(a), at(b)))
        spans.append((r.choice("ab"), a, None if i % 7 == 0 else b, i))
    points = [(i, r.choice("abc"), at(r.randrange(1000) if i % 2 else r.randrange(1_000_000, 9_500_000))) for i in range(300)]
    ts = lambda df, *c: df.withColumns({x: F.col(x).cast("timestamp") for x in c})
    got = {x.pid: x.v for x in skew.latest_covering(ts(spark.createDataFrame(points, "pid long, k string, t string"), "t"), ts(spark.createDataFrame(spans, "k string, s string, e string, v long"), "s", "e"), "pid", ["k"], "t", "s", "e", ["v"], ["s", "v"]).collect()}
    want = {}
    for pid, k, t in points:
        hit = [(s, v) for kk, s, e, v in spans if kk == k and s <= t and (e is None or t < e)]
        if hit:
            want[pid] = max(hit)[1]
    assert got == want and len(got) > 50


def test_overlapping_intervals_of_one_key_do_not_multiply(spark, written):
    rows = written(skew)
    iv = spark.range(100_000).select(F.lit("k").alias("k"), F.timestamp_seconds(F.col("id") * 20).alias("s"), F.timestamp_seconds(F.col("id") * 20 + 1_500_000).alias("e"), F.col("id").alias("v"))
    points = spark.range(1000).select(F.col("id").alias("pid"), F.lit("k").alias("k"), F.timestamp_seconds(F.col("id") * 2000 + 7).alias("t"))
    got = {x.pid: x.v for x in skew.latest_covering(points, iv, "pid", ["k"], "t", "s", "e", ["v"], ["s"]).collect()}
    assert got == {i: (i * 2000 + 7) // 20 for i in range(1000)}
    assert sum(rows["cover"]) < 100_000 * 2 * 45
