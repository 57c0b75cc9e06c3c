"""Recall over whole memory tables for batches of queries: pools, scores, lexical search, gates.

Every operator takes a queries table.  Queries meet memories through a bounded pool per topic or
through shared terms, never as all pairs.  Scores of a pair are summed before the top-k, and the top-k
is limited in every task before the shuffle.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engramlake.functions import text as X
from engramlake.operators import scan, skew
from engramlake.operators import topterms as TT
from engramlake.session import materialise

# Candidate buckets (resolution, rows) of each recall level; None is any resolution of current memories.
LEVELS = {
    0: [(None, 50)],
    1: [(3, 30), (4, 30), (5, 30)],
    2: [(2, 40), (3, 20)],
    3: [(1, 30), (2, 15), (3, 15)],
    4: [(1, 20), (2, 20), (3, 20)],
}
UTILITY_WEIGHTS = {"relevance": 0.4, "importance": 0.2, "confidence": 0.15, "recency": 0.1, "resolution": 0.1, "efficiency": 0.05}
RESOLUTION_BONUS = [0.3, 0.8, 0.7, 1.0, 0.6, 0.3]
AGE_MODES = [(1, "immediate"), (7, "recent"), (30, "established"), (180, "distant"), (365, "archival")]
TYPE_SHIFT = {"decision": -1, "current": -1, "timeline": 0, "episode": 0, "semantic": 1, "conversation_style": 1}
BM25_K1, BM25_B = 1.5, 0.75


def candidates(mem: DataFrame, level: int, window: int | None = None) -> DataFrame:
    """Newest active memories per topic and bucket of the level; ``window`` overrides the bucket sizes."""
    m = mem.filter("status = 'active'")
    if level == 0:
        m = m.filter("is_current").withColumn("bucket", F.lit(0))
        limits = {0: window or LEVELS[0][0][1]}
    else:
        limits = {r: window or n for r, n in LEVELS[level]}
        m = m.filter(F.col("resolution").isin(list(limits))).withColumn("bucket", F.col("resolution"))
    top = skew.top_k(m, ["topic", "bucket"], [F.col("updated_at").desc(), F.col("memory_id")], max(limits.values()), "pool_rank")
    size = F.create_map(*[F.lit(x) for kv in limits.items() for x in kv])
    return top.filter(F.col("pool_rank") <= F.try_element_at(size, F.col("bucket"))).drop("bucket")


def _recency(as_of, ts: str, horizon: int) -> Column:
    return 1.0 - X.whole_days(X.as_ts(as_of), F.col(ts)) / horizon


def rank_base(q: DataFrame, pool: DataFrame, as_of) -> DataFrame:
    """Base score of each pool memory for the queries of its topic."""
    p = pool.withColumn("_w", F.array_distinct(X.space_words(F.col("content"))))
    j = q.select("query_id", "topic", F.array_distinct(X.space_words(F.col("text"))).alias("_q")).join(p, "topic")
    overlap = X.overlap(F.col("_q"), F.col("_w"))
    score = overlap * 0.5 + F.col("importance") * 0.3 + F.col("confidence") * 0.2 + F.greatest(F.lit(0.0), _recency(as_of, "updated_at", 365)) * 0.2 + F.least(F.col("access_count") * 0.05, F.lit(0.3))
    return j.withColumn("overlap", overlap.cast("long")).withColumn("query_terms", F.size("_q").cast("long")).withColumn("score", F.round(score, 9)).withColumn("tokens", X.token_estimate(F.col("content"))).drop("_q", "_w")


def within_budget(ranked: DataFrame, max_tokens: int) -> DataFrame:
    return skew.prefix_budget(ranked, ["query_id"], [F.col("score").desc(), F.col("memory_id")], "tokens", max_tokens)


def recall_events(sel: DataFrame, at) -> DataFrame:
    """One log row per query: number, tokens and mean score of the selected memories."""
    return sel.groupBy("query_id").agg(F.count("*").alias("n_memories"), F.sum("tokens").alias("total_tokens"), F.avg("score").alias("avg_score")).withColumn("created_at", X.as_ts(at))


def touch(mem: DataFrame, sel: DataFrame, at) -> DataFrame:
    """Access counters and times of memories after a batch of selections."""
    n = sel.groupBy("memory_id").agg(F.count("*").alias("_n"))
    j = mem.join(n, "memory_id", "left")
    return j.withColumn("access_count", F.col("access_count") + F.coalesce("_n", F.lit(0))).withColumn("last_accessed", F.when(F.col("_n").isNotNull(), X.as_ts(at)).otherwise(F.col("last_accessed"))).drop("_n")


def contained_in(terms: DataFrame, tokens: DataFrame) -> DataFrame:
    """Pairs (term, token) with the term inside the token; both are distinct vocabularies.

    Tokens are listed under their letter groups of one to three letters and met by the first letters of the term.
    """
    c = F.col("token")
    cut = lambda n: F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.length(c) - (n - 1)), lambda i: F.substring(c, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    t = tokens.select("token", F.explode(F.array_distinct(F.concat(cut(1), cut(2), cut(3)))).alias("g"))
    return terms.select("term", F.substring("term", 1, 3).alias("g")).join(t, "g").filter(c.contains(F.col("term"))).select("term", "token")


def token_blocks(mem: DataFrame) -> DataFrame:
    """Posting blocks of whole tokens, by importance in steps of a tenth."""
    return TT.term_blocks(mem, "memory_id", X.word_set(F.col("content")), {"level": F.ceil(F.col("importance") * 10) / 10})


def keyword_search(q: DataFrame, mem: DataFrame, k: int = 10, blocks: DataFrame | None = None) -> DataFrame:
    """0.5 per query word found anywhere in the text (also inside words) plus 0.3 importance.

    The substring test runs between vocabularies.  Blocks of the query vocabulary are then opened only where the words
    and the importance can still reach the k-th score.
    """
    blocks = blocks if blocks is not None else materialise(token_blocks(mem), "token-blocks")
    qt = q.select("query_id", F.explode(X.word_set(F.col("text"))).alias("term"))
    vocabulary = contained_in(qt.select("term").distinct(), blocks.select(F.col("key").alias("token")).distinct())
    of_term = blocks.join(vocabulary, F.col("key") == F.col("token")).select(F.col("term").alias("key"), "level", "slot", F.explode("rows").alias("id"))
    of_term = materialise(of_term.groupBy("key", "level", "slot").agg(F.collect_set("id").alias("rows")).withColumn("n", F.size("rows").cast("long")), "term-blocks")
    text = lambda pairs: TT.wanted(mem, pairs, "memory_id").select(F.col("memory_id").alias("id"), "importance", F.array_join(X.word_set(F.col("content")), " ").alias("tokens"))
    ask = q.select("query_id", X.word_set(F.col("text")).alias("terms"))

    def exact(pairs: DataFrame) -> DataFrame:
        j = pairs.join(text(pairs), "id").join(ask, "query_id").withColumn("matches", F.size(F.filter("terms", lambda t: F.contains(F.col("tokens"), t))).cast("long")).filter("matches > 0")
        return j.select("query_id", "id", "matches", "importance", F.round(F.col("matches") * 0.5 + F.col("importance") * 0.3, 9).alias("score"))

    units = qt.select("query_id", F.col("term").alias("unit"), F.col("term").alias("key"), F.lit(0.5).alias("most"))
    best = TT.best_rows(units, of_term, F.col("reach") + 0.3 * F.col("level"), exact, k)
    return best.withColumnRenamed("id", "memory_id")


def keyword_best(q: DataFrame, mem: DataFrame, k: int = 10, blocks: Callable[[], DataFrame] | None = None) -> DataFrame:
    """``keyword_search`` of one batch: few questions go to the tasks and the texts are read once, many meet posting blocks."""
    asked = scan.question_terms(q, X.word_set(F.col("text")))
    if asked is None:
        return keyword_search(q, mem, k, blocks() if blocks else None).drop("importance")
    rows = mem.select(F.col("memory_id").alias("id"), F.array_join(X.word_list(F.col("content")), " ").cast("binary").alias("words"), F.col("importance").alias("value"))
    return scan.best_rows(asked, rows, k, lambda matches, asked, words, value: matches * 0.5 + value * 0.3, inside=True).withColumnRenamed("id", "memory_id")


def rank_utility(q: DataFrame, pool: DataFrame, as_of, weights: dict[str, float] = UTILITY_WEIGHTS, threshold: float = 0.1, tokens: Column | None = None) -> DataFrame:
    """Weighted utility with its parts.  ``tokens`` may override the token estimate."""
    b = rank_base(q, pool, as_of)
    cost = tokens if tokens is not None else F.col("tokens")
    parts = {
        "relevance": F.least(F.lit(1.0), F.col("overlap") / F.greatest(F.lit(1), F.col("query_terms"))),
        "recency": F.greatest(F.lit(0.1), _recency(as_of, "created_at", 180)),
        "resolution_bonus": X.pick(RESOLUTION_BONUS, F.col("resolution")),
        "efficiency": 1.0 / (1.0 + cost / 100),
    }
    b = b.withColumns({"tokens": cost, **parts})
    w = {k: v / sum(weights.values()) for k, v in weights.items()}
    u = (w["relevance"] * F.col("relevance") + w["importance"] * F.col("importance") + w["confidence"] * F.col("confidence") + w["recency"] * F.col("recency")
         + w["resolution"] * F.col("resolution_bonus") + w["efficiency"] * F.col("efficiency"))
    return b.withColumn("score", F.round(u, 9)).filter(F.col("score") >= threshold)


def greedy_fill(ranked: DataFrame, ver: DataFrame, budget: int) -> DataFrame:
    """Best-first fill that skips what does not fit and tries the stored compressed versions.

    A fold over one sorted array per query.  A query's array holds its candidate pool, whose size the limits of
    the recall level (or the window given to ``candidates``) fix; it does not grow with the corpus.
    """
    v = ver.filter("resolution in (1, 3, 4, 5)").groupBy("memory_id").agg(F.array_sort(F.collect_list(F.struct("resolution", F.col("compressed_tokens").alias("t")))).alias("vs"))
    j = ranked.select("query_id", "memory_id", "score", "tokens", "resolution").join(v, "memory_id", "left")
    forms = F.concat(F.array(F.struct(F.col("resolution").alias("r"), F.col("tokens").alias("t"))), F.coalesce(F.transform(F.filter("vs", lambda x: x["resolution"] > F.col("resolution")), lambda x: F.struct(x["resolution"].alias("r"), x["t"].cast("long").alias("t"))), F.array().cast("array<struct<r:int,t:bigint>>")))
    a = j.select("query_id", F.struct((-F.col("score")).alias("s"), "memory_id", forms.alias("forms")).alias("x")).groupBy("query_id").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    zero = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<memory_id:bigint,r:int,t:bigint>>").alias("out"))

    def step(acc, x):
        fit = F.get(F.filter(x["forms"], lambda f: acc["used"] + f["t"] <= budget), F.lit(0))
        added = F.struct(x["memory_id"].alias("memory_id"), fit["r"].alias("r"), fit["t"].alias("t"))
        return F.when(fit.isNotNull(), F.struct((acc["used"] + fit["t"]).alias("used"), F.concat(acc["out"], F.array(added)).alias("out"))).otherwise(acc)

    r = a.select("query_id", F.aggregate("xs", zero, step).alias("r"))
    return r.select("query_id", F.posexplode("r.out").alias("pos", "o")).select("query_id", F.col("pos").cast("long").alias("pos"), "o.memory_id", F.col("o.r").alias("resolution"), F.col("o.t").alias("tokens"))


def explain(ranked: DataFrame, sel: DataFrame) -> DataFrame:
    """Every candidate with its score parts and whether it was selected."""
    s = sel.select("query_id", "memory_id").withColumn("selected", F.lit(True))
    return ranked.join(s, ["query_id", "memory_id"], "left").withColumn("selected", F.coalesce("selected", F.lit(False)))


def recall_mode(mem: DataFrame, as_of) -> DataFrame:
    """Age mode shifted by importance, and the target resolution by mode and type."""
    days = X.whole_days(X.as_ts(as_of), F.coalesce("last_accessed", "created_at"))
    idx = F.lit(len(AGE_MODES) - 1)
    for i, (limit, _) in reversed(list(enumerate(AGE_MODES))):
        idx = F.when(days < limit, i).otherwise(idx)
    imp = F.round(F.col("importance"), 9)
    shift = F.when(imp >= 0.9, 2).when(imp >= 0.7, 1).when(imp >= 0.5, 0).when(imp >= 0.3, -1).otherwise(0)
    mode = F.least(F.lit(len(AGE_MODES) - 1), F.greatest(F.lit(0), idx - shift))
    types = F.create_map(*[F.lit(x) for kv in TYPE_SHIFT.items() for x in kv])
    return mem.withColumn("_m", mode).withColumn("mode", X.pick([m for _, m in AGE_MODES], F.col("_m"))).withColumn(
        "target_resolution", F.greatest(F.lit(0), F.least(F.lit(5), F.col("_m") + F.coalesce(F.try_element_at(types, F.col("memory_type")), F.lit(0))))).drop("_m")


def human_recall(q: DataFrame, pool: DataFrame, ver: DataFrame, as_of, max_tokens: int) -> DataFrame:
    """Selected memories at their adapted resolution, by importance and recency within the budget."""
    m = recall_mode(pool, as_of)
    relevance = F.col("importance") * 0.6 + F.greatest(F.lit(0.0), 1.0 - X.whole_days(X.as_ts(as_of), F.coalesce("last_accessed", "created_at")) / 365) * 0.4
    v = ver.select("memory_id", F.col("resolution").alias("target_resolution"), F.col("compressed_tokens").alias("_t"))
    j = m.join(v, ["memory_id", "target_resolution"], "left")
    found = F.col("_t").isNotNull()
    j = j.select("topic", "memory_id", "mode", F.when(found, F.col("target_resolution")).otherwise(F.col("resolution")).alias("served_resolution"),
                 F.coalesce("_t", X.token_estimate(F.col("content"))).alias("tokens"), F.round(relevance, 9).alias("score"))
    return within_budget(q.select("query_id", "topic").join(j, "topic"), max_tokens)


def human_summary(sel: DataFrame) -> DataFrame:
    modes = sel.groupBy("query_id", "mode").agg(F.count("*").alias("n"))
    dom = modes.groupBy("query_id").agg(F.max_by("mode", F.struct("n", "mode")).alias("dominant_mode"))
    g = sel.groupBy("query_id").agg(F.count("*").alias("memories"), F.max("served_resolution").alias("resolution_used"), F.avg("score").alias("a"))
    return g.join(dom, "query_id").select("query_id", "memories", "dominant_mode", "resolution_used", F.least(F.lit(1.0), F.col("a") * (1 + F.col("memories") / 10)).alias("confidence"))


def jaccard_pairs(q: DataFrame, mem: DataFrame) -> DataFrame:
    """Jaccard of word sets for all (query, memory) pairs that share a word."""
    qs = q.select("query_id", F.array_distinct(X.space_words(F.col("text"))).alias("s"))
    ms = mem.select("memory_id", F.array_distinct(X.space_words(F.col("content"))).alias("s"))
    qt = qs.select("query_id", F.size("s").alias("a"), F.explode("s").alias("term"))
    mt = ms.select("memory_id", F.size("s").alias("b"), F.explode("s").alias("term"))
    g = qt.join(mt, "term").groupBy("query_id", "memory_id", "a", "b").agg(F.count("*").alias("inter"))
    return g.select("query_id", "memory_id", F.round(F.col("inter") / (F.col("a") + F.col("b") - F.col("inter")), 9).alias("score"))


def size_blocks(mem: DataFrame) -> DataFrame:
    """Posting blocks of words, by the class of a text's word set (half powers of two): its least and greatest size."""
    # The word set is a row value of its own, so that the levels do not compute it again.
    m = mem.select("memory_id", F.explode(F.array(F.array_distinct(X.space_words(F.col("content"))))).alias("words"))
    m = m.withColumn("n", F.size("words").cast("long")).filter("n > 0").withColumn("power", F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin("n")) - 1))
    upper = F.col("n") * 2 >= F.col("power") * 3
    low = F.when(upper, F.ceil(F.col("power") * 3 / 2)).otherwise(F.col("power"))
    high = F.when(upper, F.col("power") * 2 - 1).otherwise(F.ceil(F.col("power") * 3 / 2) - 1)
    return TT.term_blocks(m, "memory_id", F.col("words"), {"low": low, "high": high})


def jaccard_search(q: DataFrame, mem: DataFrame, k: int = 10, blocks: DataFrame | None = None) -> DataFrame:
    """Best ``k`` memories of each query by Jaccard of word sets.

    A text of n words that shares c of a query's a words has c / (a + n - c), so blocks of frequent words and of texts
    much longer or shorter than the query are opened only where that can reach the k-th score.
    """
    blocks = blocks if blocks is not None else materialise(size_blocks(mem), "size-blocks")
    ask = q.select("query_id", F.array_distinct(X.space_words(F.col("text"))).alias("qs"))
    text = lambda pairs: TT.wanted(mem, pairs, "memory_id").select(F.col("memory_id").alias("id"), F.array_distinct(X.space_words(F.col("content"))).alias("ms"))

    def exact(pairs: DataFrame) -> DataFrame:
        j = pairs.join(text(pairs), "id").join(ask, "query_id").withColumn("inter", X.overlap(F.col("qs"), F.col("ms"))).filter("inter > 0")
        return j.select("query_id", "id", F.round(F.col("inter") / (F.size("qs") + F.size("ms") - F.col("inter")), 9).alias("score"))

    units = ask.select("query_id", F.size("qs").alias("a"), F.explode("qs").alias("unit")).select("query_id", "unit", F.col("unit").alias("key"), F.lit(1.0).alias("most"), "a")
    most = F.least("matched", "high")
    bound = most / (F.col("a") + F.greatest(F.col("low"), most) - most)
    return TT.best_rows(units, blocks, bound, exact, k).withColumnRenamed("id", "memory_id")


def jaccard_best(q: DataFrame, mem: DataFrame, k: int = 10, blocks: Callable[[], DataFrame] | None = None) -> DataFrame:
    """``jaccard_search`` of one batch: few questions go to the tasks and the texts are read once, many meet posting blocks."""
    asked = scan.question_terms(q, X.space_words(F.col("text")))
    if asked is None:
        return jaccard_search(q, mem, k, blocks() if blocks else None)
    # White space of a binary is that of the pattern of ``space_words``.
    rows = mem.select(F.col("memory_id").alias("id"), F.lower("content").cast("binary").alias("words"), F.lit(0.0).alias("value"))
    return scan.best_rows(asked, rows, k, lambda matches, asked, words, value: matches / (asked + words - matches)).drop("matches").withColumnRenamed("id", "memory_id")


def hybrid(vec: DataFrame, key: DataFrame, k: int, w_vec: float = 0.7, w_key: float = 0.3) -> DataFrame:
    v = vec.select("query_id", "memory_id", F.col("score").alias("v"))
    s = key.select("query_id", "memory_id", F.col("score").alias("s"))
    j = v.join(s, ["query_id", "memory_id"], "full_outer")
    j = j.withColumn("score", F.round(w_vec * F.coalesce("v", F.lit(0.0)) + w_key * F.coalesce("s", F.lit(0.0)), 9))
    return skew.top_k(j, ["query_id"], [F.col("score").desc(), F.col("memory_id")], k)


def text_index(mem: DataFrame, key: str = "memory_id", text: str = "content", parts: int | None = None) -> DataFrame:
    """Postings with term frequency and document length: the table all BM25 jobs read.  Write it once per corpus.

    Documents are placed by their unique key before they are cut into tokens: the counts need no second
    shuffle, and all postings of a document lie together, so later sums per document combine in one task.
    """
    d = mem.select(key, X.search_tokens(F.col(text)).alias("t"))
    d = d.repartition(parts, key) if parts else d.repartition(key)
    return d.select(key, F.size("t").alias("dl"), F.explode("t").alias("token")).groupBy(key, "dl", "token").agg(F.count("*").alias("tf"))


def corpus_stats(index: DataFrame, key: str = "memory_id") -> DataFrame:
    """Number of documents and mean length, one row."""
    return index.groupBy(key).agg(F.max("dl").alias("dl")).agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avg_dl"))


def document_frequency(index: DataFrame) -> DataFrame:
    return index.groupBy("token").agg(F.count("*").alias("df"))


class TextIndex(NamedTuple):
    """Postings, one row of corpus statistics and the document frequency of each token."""

    postings: DataFrame
    stats: DataFrame
    frequency: DataFrame


#: Documents of one bucket of the stored index: what a task sums per query and document is bounded by them.  Spark allows 100,000 buckets.
BUCKET_DOCS, LEAST_BUCKETS, MOST_BUCKETS = 8_000, 16, 100_000


def store_index(mem: DataFrame, path: str, key: str = "memory_id", text: str = "content", buckets: int | None = None) -> TextIndex:
    """Write the index of a corpus once: postings bucketed by document, with the statistics beside them.

    Sums per document over a bucketed table need no exchange.  Without given ``buckets`` their number grows with the
    corpus, so that a task holds the sums of ``BUCKET_DOCS`` documents whatever the corpus.
    """
    spark = mem.sparkSession
    if buckets is None:
        buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, -(-mem.count() // BUCKET_DOCS)))
    name = f"text_index_{uuid.uuid4().hex}"
    # Documents are placed as the buckets are, so each bucket is one file.
    text_index(mem, key, text, buckets).write.bucketBy(buckets, key).option("path", f"{path}/postings").saveAsTable(name)
    postings = spark.table(name)
    corpus_stats(postings, key).write.parquet(f"{path}/stats")
    document_frequency(postings).write.parquet(f"{path}/frequency")
    return TextIndex(postings, spark.read.parquet(f"{path}/stats"), spark.read.parquet(f"{path}/frequency"))


def bm25(q: DataFrame, index: TextIndex | DataFrame, key: str = "memory_id") -> DataFrame:
    """BM25 of every (query, memory) pair that shares a term, and the greatest score the query could reach.

    Query terms are counted first: up to a bound they are broadcast and the postings stay where they are,
    so the sum of a pair is complete in the task that reads the document; beyond it the joins shuffle by term.
    """
    if isinstance(index, DataFrame):
        index = TextIndex(index, corpus_stats(index, key), document_frequency(index))
    terms = q.select("query_id", F.explode(F.array_distinct(X.search_tokens(F.col("text")))).alias("token"))
    n_terms = terms.count()
    n, avg = index.stats.select("n_docs").scalar(), index.stats.select("avg_dl").scalar()
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = index.frequency.join(skew.broadcast_within(terms, n_terms), "token").select("query_id", "token", idf.alias("idf"))
    norm = BM25_K1 * (1 - BM25_B + BM25_B * F.col("dl") / avg)
    part = F.col("idf") * (F.col("tf") * (BM25_K1 + 1)) / (F.col("tf") + norm)
    best = weighted.groupBy("query_id").agg((F.sum("idf") * (BM25_K1 + 1)).alias("max_possible"))
    scored = index.postings.join(skew.broadcast_within(weighted, n_terms), "token").groupBy("query_id", key).agg(F.round(F.sum(part), 9).alias("score"))
    return scored.join(skew.broadcast_within(best, n_terms), "query_id")


def top_scored(scored: DataFrame, k: int) -> DataFrame:
    return skew.top_k(scored, ["query_id"], [F.col("score").desc(), F.col("memory_id")], k)


def sessionise(df: DataFrame, keys: list[str], ts: str, order: str, gap_seconds: int = 300) -> DataFrame:
    """Session number per key: a new one after ``gap_seconds`` of silence.  Cut by hour, so no key (nor the whole stream, without keys) is one task."""
    d = df.withColumn("_d", F.date_trunc("hour", ts))
    d = skew.neighbour(d, keys, "_d", [ts, order], [ts], "_p_")
    gap = (F.unix_micros(ts) - F.unix_micros(f"_p_{ts}")) > gap_seconds * 1000000
    d = d.withColumn("_g", F.coalesce(gap.cast("long"), F.lit(0)))
    return skew.running_total(d, keys, "_d", [ts, order], "_g", "session").drop("_d", "_g", f"_p_{ts}")


def session_gate(scored: DataFrame, members: DataFrame, pool: int = 100, aggregation: str = "mean", k: int = 3, own_weight: float = 0.1, max_sessions: int | None = None, floor: float = 0.0) -> DataFrame:
    """Keep whole sessions: members ordered by session score plus a share of their own.

    ``members`` maps memory_id to session.  Only the best ``k`` rows of a session enter its score.
    """
    s = scored.filter(F.col("score") >= floor) if floor > 0 else scored
    s = s.select("query_id", "memory_id", "score").join(members.select("memory_id", "session"), "memory_id")
    top = skew.top_k(s, ["query_id", "session"], [F.col("score").desc(), F.col("memory_id")], 1 if aggregation == "max" else k, "_r")
    sess = top.groupBy("query_id", "session").agg(F.round(F.avg("score"), 9).alias("session_score"))
    if max_sessions is not None:
        sess = skew.top_k(sess, ["query_id"], [F.col("session_score").desc(), F.col("session")], max_sessions, "_s").drop("_s")
    j = s.join(sess, ["query_id", "session"]).withColumn("gate_score", F.round(F.col("session_score") + own_weight * F.col("score"), 9))
    return skew.top_k(j, ["query_id"], [F.col("gate_score").desc(), F.col("memory_id")], pool)


def abstain(scored: DataFrame, threshold: float) -> DataFrame:
    """Rows of queries whose best score is at least ``threshold`` of the possible score; others return nothing."""
    low = scored.groupBy("query_id").agg((F.max("score") / F.max("max_possible")).alias("r")).filter(F.col("r") < threshold)
    return scored.join(low.select("query_id"), "query_id", "left_anti")


def jaccard_gate(q: DataFrame, pool: DataFrame, pool_size: int = 64) -> DataFrame:
    """Best ``pool_size`` of each topic pool by Jaccard, earliest first on ties; small pools pass unchanged."""
    p = pool.select("topic", "memory_id", "created_at", F.array_distinct(X.space_words(F.col("content"))).alias("m"))
    j = q.select("query_id", "topic", F.array_distinct(X.space_words(F.col("text"))).alias("s")).join(p, "topic")
    j = j.select("query_id", "memory_id", F.round(X.jaccard(F.col("s"), F.col("m")), 9).alias("score"))
    return skew.top_k(j, ["query_id"], [F.col("score").desc(), F.col("memory_id")], pool_size)
