from pyspark.sql import functions as F

from engramlake.operators import recall as H
from engramlake.operators import vectors as V
from engramlake.session import AS_OF, fingerprint, materialise, work_path
from engramlake.sources import bindings as B
from registry import EXTRA_CTES, query
from registry import snippets as S
from registry.compression import versions

ts = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
r6 = lambda df, *cols: df.withColumns({c: F.round(c, 6) for c in cols})
NOW = f"TIMESTAMP '{AS_OF}'"


def _pool_sql(level):
    if level == 0:
        return "SELECT *, row_number() OVER (PARTITION BY topic ORDER BY updated_at DESC, memory_id) AS pool_rank FROM mem WHERE status = 'active' AND is_current QUALIFY pool_rank <= 50"
    lim = " ".join(f"WHEN {r} THEN {n}" for r, n in H.LEVELS[level])
    return f"SELECT *, row_number() OVER (PARTITION BY topic, resolution ORDER BY updated_at DESC, memory_id) AS pool_rank FROM mem WHERE status = 'active' QUALIFY pool_rank <= CASE resolution {lim} ELSE 0 END"


for _l in range(5):
    EXTRA_CTES[f"pool{_l}"] = _pool_sql(_l)


def pool(spark, d, level=0):
    return H.candidates(B.memories(spark, d), level)


@query("recall_candidates", " UNION ALL ".join(f"SELECT {l} AS level, topic, memory_id, pool_rank FROM pool{l}" for l in range(5)))
def recall_candidates(spark, d):
    out = None
    for l in range(5):
        c = pool(spark, d, l).select(F.lit(l).alias("level"), "topic", "memory_id", "pool_rank")
        out = c if out is None else out.unionByName(c)
    return out


_STORED: dict = {}


def stored(spark, d, what, tables, build):
    """Something built once per application from tables as they are now, and read by every query over them."""
    key = (spark.sparkContext.applicationId, d, what, *[fingerprint(B.table(spark, d, t)) for t in tables])
    if key not in _STORED:
        _STORED[key] = build()
    return _STORED[key]


def _q(spark, d):
    return B.recall_queries(spark, d)


EXTRA_CTES["rbase"] = f"""WITH j AS (SELECT q.query_id, p.*, list_distinct({S.space_words('q.text')}) AS qw, list_distinct({S.space_words('p.content')}) AS w FROM qry q JOIN pool0 p ON q.topic = p.topic)
SELECT * EXCLUDE (qw, w), CAST(len(list_intersect(qw, w)) AS BIGINT) AS overlap, CAST(len(qw) AS BIGINT) AS query_terms, {S.tokens('content')} AS tokens,
 round(len(list_intersect(qw, w)) * 0.5 + importance * 0.3 + confidence * 0.2 + greatest(0.0, 1.0 - {S.whole_days(NOW, 'updated_at')} / 365) * 0.2 + least(access_count * 0.05, 0.3), 9) AS score FROM j"""
EXTRA_CTES["rsel"] = "WITH a AS (SELECT *, sum(tokens) OVER (PARTITION BY query_id ORDER BY score DESC, memory_id ROWS UNBOUNDED PRECEDING) AS used_tokens FROM rbase) SELECT * FROM a WHERE used_tokens <= 4000"


def rbase(spark, d):
    return H.rank_base(_q(spark, d), pool(spark, d), AS_OF)


def rsel(spark, d):
    return H.within_budget(rbase(spark, d), 4000)


@query("rank_base", "SELECT query_id, memory_id, overlap, tokens, round(score, 6) AS score FROM rbase")
def rank_base(spark, d):
    return r6(rbase(spark, d).select("query_id", "memory_id", "overlap", "tokens", "score"), "score")


@query("recall_within_budget", "SELECT query_id, memory_id, tokens, CAST(used_tokens AS BIGINT) AS used_tokens FROM rsel")
def recall_within_budget(spark, d):
    return rsel(spark, d).select("query_id", "memory_id", "tokens", "used_tokens")


@query("recall_events", "SELECT query_id, count(*) AS n_memories, CAST(sum(tokens) AS BIGINT) AS total_tokens, round(avg(score), 6) AS avg_score FROM rsel GROUP BY query_id")
def recall_events(spark, d):
    return r6(H.recall_events(rsel(spark, d), AS_OF).drop("created_at"), "avg_score")


@query("touch_accessed", f"""WITH n AS (SELECT memory_id, count(*) AS n FROM rsel GROUP BY memory_id)
SELECT memory_id, access_count + coalesce(n, 0) AS access_count, {S.fmt(f'CASE WHEN n IS NOT NULL THEN {NOW} ELSE last_accessed END')} AS last_accessed FROM mem LEFT JOIN n USING (memory_id)""")
def touch_accessed(spark, d):
    return H.touch(B.memories(spark, d), rsel(spark, d), AS_OF).select("memory_id", "access_count", ts("last_accessed").alias("last_accessed"))


EXTRA_CTES["kws"] = f"""WITH t AS (SELECT DISTINCT query_id, unnest({S.words('text')}) AS term FROM qry), m AS (SELECT DISTINCT memory_id, unnest({S.words('content')}) AS token FROM mem),
p AS (SELECT t.term, v.token FROM (SELECT DISTINCT term FROM t) t JOIN (SELECT DISTINCT token FROM m) v ON contains(v.token, t.term)),
mt AS (SELECT DISTINCT memory_id, term FROM m JOIN p USING (token)), s AS (SELECT query_id, memory_id, count(*) AS matches FROM mt JOIN t USING (term) GROUP BY ALL)
SELECT query_id, memory_id, matches, round(matches * 0.5 + importance * 0.3, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(matches * 0.5 + importance * 0.3, 9) DESC, memory_id) AS rank FROM s JOIN mem USING (memory_id) QUALIFY rank <= 10"""


@query("keyword_search", "SELECT query_id, memory_id, matches, rank, round(score, 6) AS score FROM kws")
def keyword_search(spark, d):
    m = B.memories(spark, d)
    blocks = lambda: stored(spark, d, "token-blocks", ["documents"], lambda: materialise(H.token_blocks(m), "token-blocks"))
    return r6(H.keyword_best(_q(spark, d), m, 10, blocks), "score")


EXTRA_CTES["rutil"] = f"""WITH a AS (SELECT *, least(1.0, overlap / greatest(1, query_terms)) AS relevance, greatest(0.1, 1.0 - {S.whole_days(NOW, 'created_at')} / 180) AS recency,
 [0.3, 0.8, 0.7, 1.0, 0.6, 0.3][resolution + 1] AS rb, 1.0 / (1.0 + tokens / 100) AS te FROM rbase)
SELECT * REPLACE (round(0.4 * relevance + 0.2 * importance + 0.15 * confidence + 0.1 * recency + 0.1 * rb + 0.05 * te, 9) AS score) FROM a WHERE 0.4 * relevance + 0.2 * importance + 0.15 * confidence + 0.1 * recency + 0.1 * rb + 0.05 * te >= 0.1"""


def rutil(spark, d):
    return H.rank_utility(_q(spark, d), pool(spark, d), AS_OF)


@query("rank_utility", "SELECT query_id, memory_id, round(relevance, 6) AS relevance, round(recency, 6) AS recency, round(score, 6) AS score FROM rutil")
def rank_utility(spark, d):
    return r6(rutil(spark, d).select("query_id", "memory_id", "relevance", "recency", "score"), "relevance", "recency", "score")


@query("greedy_fill", """WITH RECURSIVE v AS (SELECT memory_id, list({'r': resolution, 't': compressed_tokens} ORDER BY resolution) AS vs FROM vers WHERE resolution IN (1, 3, 4, 5) GROUP BY memory_id),
p AS (SELECT query_id, memory_id, list_concat([{'r': resolution, 't': tokens}], coalesce(list_filter(vs, lambda x: x.r > resolution), [])) AS forms, row_number() OVER (PARTITION BY query_id ORDER BY -score, memory_id) AS rn FROM rutil LEFT JOIN v USING (memory_id)),
f AS (SELECT DISTINCT query_id, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS used, CAST(NULL AS BIGINT) AS memory_id, CAST(NULL AS INTEGER) AS resolution, CAST(NULL AS BIGINT) AS tokens FROM p
UNION ALL SELECT query_id, rn, used + coalesce(fit.t, 0), memory_id, fit.r, fit.t FROM (SELECT p.query_id, p.rn, f.used, p.memory_id, list_filter(p.forms, lambda x: f.used + x.t <= 2000)[1] AS fit FROM f JOIN p ON p.query_id = f.query_id AND p.rn = f.rn + 1) x)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rn) - 1 AS pos, memory_id, resolution, tokens FROM f WHERE tokens IS NOT NULL""")
def greedy_fill(spark, d):
    return H.greedy_fill(rutil(spark, d), versions(spark, d), 2000)


@query("explain_selection", """WITH a AS (SELECT *, sum(tokens) OVER (PARTITION BY query_id ORDER BY score DESC, memory_id ROWS UNBOUNDED PRECEDING) AS used FROM rutil)
SELECT query_id, memory_id, round(relevance, 6) AS relevance, round(score, 6) AS score, used <= 4000 AS selected FROM a""")
def explain_selection(spark, d):
    u = rutil(spark, d)
    return r6(H.explain(u, H.within_budget(u, 4000)).select("query_id", "memory_id", "relevance", "score", "selected"), "relevance", "score")


def _mode_sql(src):
    days = S.whole_days(NOW, "coalesce(last_accessed, created_at)")
    base = " ".join(f"WHEN {days} < {n} THEN {i}" for i, (n, _) in enumerate(H.AGE_MODES))
    imp = "round(importance, 9)"
    shift = f"CASE WHEN {imp} >= 0.9 THEN 2 WHEN {imp} >= 0.7 THEN 1 WHEN {imp} >= 0.5 THEN 0 WHEN {imp} >= 0.3 THEN -1 ELSE 0 END"
    ty = "CASE memory_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in H.TYPE_SHIFT.items()) + " ELSE 0 END"
    return f"""WITH a AS (SELECT *, CAST(least(4, greatest(0, CASE {base} ELSE 4 END - {shift})) AS INTEGER) AS m FROM {src})
SELECT *, {S.lst([m for _, m in H.AGE_MODES])}[m + 1] AS mode, CAST(greatest(0, least(5, m + {ty})) AS INTEGER) AS target_resolution FROM a"""


EXTRA_CTES["modes"] = _mode_sql("mem")
EXTRA_CTES["pmodes"] = _mode_sql("pool2")


@query("recall_mode", "SELECT memory_id, mode, target_resolution FROM modes")
def recall_mode(spark, d):
    return H.recall_mode(B.memories(spark, d), AS_OF).select("memory_id", "mode", "target_resolution")


EXTRA_CTES["hsel"] = f"""WITH a AS (SELECT p.topic, p.memory_id, p.mode, CASE WHEN v.memory_id IS NOT NULL THEN target_resolution ELSE p.resolution END AS served_resolution, coalesce(v.compressed_tokens, {S.tokens('p.content')}) AS tokens,
 round(importance * 0.6 + greatest(0.0, 1.0 - {S.whole_days(NOW, 'coalesce(last_accessed, created_at)')} / 365) * 0.4, 9) AS score FROM pmodes p LEFT JOIN vers v ON v.memory_id = p.memory_id AND v.resolution = p.target_resolution),
b AS (SELECT query_id, a.*, sum(tokens) OVER (PARTITION BY query_id ORDER BY score DESC, memory_id ROWS UNBOUNDED PRECEDING) AS used_tokens FROM qry JOIN a ON qry.topic = a.topic) SELECT * FROM b WHERE used_tokens <= 4000"""


def hsel(spark, d):
    return H.human_recall(_q(spark, d), pool(spark, d, 2), versions(spark, d), AS_OF, 4000)


@query("human_recall", "SELECT query_id, memory_id, mode, served_resolution, tokens, round(score, 6) AS score FROM hsel")
def human_recall(spark, d):
    return r6(hsel(spark, d).select("query_id", "memory_id", "mode", "served_resolution", "tokens", "score"), "score")


@query("human_recall_summary", """WITH m AS (SELECT query_id, mode, count(*) AS n FROM hsel GROUP BY ALL), dm AS (SELECT query_id, arg_max(mode, {'n': n, 'm': mode}) AS dominant_mode FROM m GROUP BY query_id)
SELECT query_id, count(*) AS memories, any_value(dominant_mode) AS dominant_mode, max(served_resolution) AS resolution_used, round(least(1.0, avg(score) * (1 + count(*) / 10)), 6) AS confidence FROM hsel JOIN dm USING (query_id) GROUP BY query_id""")
def human_recall_summary(spark, d):
    return r6(H.human_summary(hsel(spark, d)), "confidence")


EXTRA_CTES["cent"] = """WITH e AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), a AS (SELECT label, i, avg(x) AS x FROM e GROUP BY ALL)
SELECT CAST(label AS BIGINT) AS query_id, list(x ORDER BY i) AS c FROM a GROUP BY label"""


def topic_vectors(spark, d):
    vec = B.table(spark, d, "embeddings")
    return V.centroids(vec, "label").select(F.col("label").cast("long").alias("query_id"), "embedding"), vec


def stored_vectors(spark, d):
    return stored(spark, d, "vectors", ["embeddings"], lambda: V.store_vectors(B.table(spark, d, "embeddings"), work_path(spark, "vectors")))


@query("knn_topic_centroids", """WITH s AS (SELECT query_id, vec_id, round(list_cosine_similarity(c, embedding::DOUBLE[]), 9) AS score FROM cent, embeddings)
SELECT query_id, vec_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s WHERE score >= 0.1 QUALIFY rank <= 10""")
def knn_topic_centroids(spark, d):
    qv, _ = topic_vectors(spark, d)
    return r6(V.knn(qv, stored_vectors(spark, d), 10, 0.1), "score")


@query("ann_topic_centroids")
def ann_topic_centroids(spark, d):
    qv, _ = topic_vectors(spark, d)
    return V.ann(qv, stored_vectors(spark, d), 10)


@query("ann_recall", "SELECT vec_id AS query_id, CAST(10 AS BIGINT) AS expected, true AS enough FROM embeddings WHERE vec_id % 100 = 0")
def ann_recall(spark, d):
    """Approximate against exact search of every vector whose id is divisible by 100: at least 0.9 of the neighbours in the mean."""
    qv = B.table(spark, d, "embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    index = stored_vectors(spark, d)
    r = materialise(V.recall_of(V.ann(qv, index, 10), V.knn(qv, index, 10)), "ann-recall")
    mean = r.agg((F.sum("found") / F.sum("expected")).alias("mean"))
    return r.join(F.broadcast(mean)).select("query_id", "expected", (F.col("mean") >= 0.9).alias("enough"))  # one row


EXTRA_CTES["jac"] = f"""WITH a AS (SELECT query_id, list_distinct({S.space_words('text')}) AS s FROM qry), b AS (SELECT memory_id, list_distinct({S.space_words('content')}) AS s FROM mem),
x AS (SELECT query_id, len(s) AS n, unnest(s) AS t FROM a), y AS (SELECT memory_id, len(s) AS m, unnest(s) AS t FROM b),
g AS (SELECT query_id, memory_id, n, m, count(*) AS i FROM x JOIN y USING (t) GROUP BY ALL) SELECT query_id, memory_id, round(i / (n + m - i), 9) AS score FROM g"""
EXTRA_CTES["jacs"] = "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id) AS rank FROM jac QUALIFY rank <= 20"


def jaccard(spark, d, k):
    m = B.memories(spark, d)
    blocks = lambda: stored(spark, d, "size-blocks", ["documents"], lambda: materialise(H.size_blocks(m), "size-blocks"))
    return H.jaccard_best(_q(spark, d), m, k, blocks)


@query("jaccard_search", "SELECT query_id, memory_id, round(score, 6) AS score, rank FROM jacs WHERE rank <= 10")
def jaccard_search(spark, d):
    return r6(jaccard(spark, d, 10), "score")


def index(spark, d):
    return H.text_index(B.memories(spark, d))


EXTRA_CTES["idx"] = f"""WITH a AS MATERIALIZED (SELECT memory_id, {S.search_tokens('content')} AS t FROM mem), b AS MATERIALIZED (SELECT memory_id, len(t) AS dl, unnest(t) AS token FROM a)
SELECT memory_id, dl, token, count(*) AS tf FROM b GROUP BY ALL"""
EXTRA_CTES["bm"] = f"""WITH n AS (SELECT count(*) AS n, avg(dl) AS a FROM (SELECT memory_id, max(dl) AS dl FROM idx GROUP BY memory_id)), df AS (SELECT token, count(*) AS df FROM idx GROUP BY token),
t AS (SELECT DISTINCT query_id, unnest({S.search_tokens('text')}) AS token FROM qry), w AS (SELECT query_id, token, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf FROM t JOIN df USING (token), n),
b AS (SELECT query_id, sum(idf) * 2.5 AS max_possible FROM w GROUP BY query_id),
s AS (SELECT query_id, memory_id, round(sum(idf * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * dl / n.a))), 9) AS score FROM w JOIN idx USING (token), n GROUP BY query_id, memory_id) SELECT * FROM s JOIN b USING (query_id)"""


def stored_index(spark, d):
    """The index of a corpus is written once and read by every query over it."""
    return stored(spark, d, "text-index", ["documents"], lambda: H.store_index(B.memories(spark, d), work_path(spark, "text-index")))


def scored(spark, d):
    return H.bm25(_q(spark, d), stored_index(spark, d))


@query("corpus_stats", "SELECT count(*) AS n_docs, round(avg(dl), 6) AS avg_dl FROM (SELECT memory_id, max(dl) AS dl FROM idx GROUP BY memory_id)")
def corpus_stats(spark, d):
    return r6(H.corpus_stats(index(spark, d)), "avg_dl")


@query("document_frequency", "SELECT token, count(*) AS df FROM idx GROUP BY token")
def document_frequency(spark, d):
    return H.document_frequency(index(spark, d))


@query("recall_bm25", "SELECT query_id, memory_id, round(score, 5) AS score, round(max_possible, 5) AS max_possible, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id) AS rank FROM bm QUALIFY rank <= 20")
def recall_bm25(spark, d):
    return H.top_scored(scored(spark, d), 20).withColumn("score", F.round("score", 5)).withColumn("max_possible", F.round("max_possible", 5))


@query("recall_bm25_within_budget", f"""WITH a AS (SELECT query_id, memory_id, score, {S.tokens('content')} AS tokens FROM bm JOIN mem USING (memory_id)),
b AS (SELECT *, sum(tokens) OVER (PARTITION BY query_id ORDER BY score DESC, memory_id ROWS UNBOUNDED PRECEDING) AS used FROM a)
SELECT query_id, memory_id, round(score, 5) AS score, tokens, CAST(used AS BIGINT) AS used_tokens FROM b WHERE used <= 2000""")
def recall_bm25_within_budget(spark, d):
    t = B.memories(spark, d).select("memory_id", F.greatest(F.lit(1), F.floor(F.length("content") / 3)).cast("long").alias("tokens"))
    # Each row costs at least one token, so 2000 rows per query are enough before lengths are looked up.
    return H.within_budget(H.top_scored(scored(spark, d), 2000).join(t, "memory_id"), 2000).select("query_id", "memory_id", F.round("score", 5).alias("score"), "tokens", "used_tokens")


@query("hybrid_search", """WITH v AS (SELECT q.query_id, e.vec_id AS memory_id, round(list_cosine_similarity(x.embedding::DOUBLE[], e.embedding::DOUBLE[]), 9) AS score FROM qry q JOIN embeddings x ON x.vec_id = q.query_id, embeddings e
 QUALIFY row_number() OVER (PARTITION BY q.query_id ORDER BY score DESC, memory_id) <= 20),
j AS (SELECT coalesce(v.query_id, k.query_id) AS query_id, coalesce(v.memory_id, k.memory_id) AS memory_id, round(0.7 * coalesce(v.score, 0.0) + 0.3 * coalesce(k.score, 0.0), 9) AS score FROM v FULL JOIN jacs k ON v.query_id = k.query_id AND v.memory_id = k.memory_id)
SELECT query_id, memory_id, round(score, 5) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id) AS rank FROM j QUALIFY rank <= 10""")
def hybrid_search(spark, d):
    """The vector of a query is the one stored under its id."""
    q = _q(spark, d)
    qv = q.select("query_id").join(B.table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding"), "query_id")
    v = V.knn(qv, stored_vectors(spark, d), 20).withColumnRenamed("vec_id", "memory_id")
    return H.hybrid(v, jaccard(spark, d, 20), 10).select("query_id", "memory_id", F.round("score", 5).alias("score"), "rank")


_sess = """WITH a AS (SELECT *, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY entity ORDER BY ts, fact_id)) > 300000000, false) AS g FROM facts)
SELECT fact_id, entity, CAST(sum(CAST(g AS BIGINT)) OVER (PARTITION BY entity ORDER BY ts, fact_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM a"""


@query("sessionise_facts", _sess)
def sessionise_facts(spark, d):
    return H.sessionise(B.facts(spark, d), ["entity"], "ts", "fact_id").select("fact_id", "entity", "session")


@query("sessionise_stream_order", """WITH a AS (SELECT *, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (ORDER BY ts, fact_id)) > 300000000, false) AS g FROM facts)
SELECT fact_id, CAST(sum(CAST(g AS BIGINT)) OVER (ORDER BY ts, fact_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM a""")
def sessionise_stream_order(spark, d):
    return H.sessionise(B.facts(spark, d), [], "ts", "fact_id").select("fact_id", "session")


def _gate_sql(agg, k, mx, floor, pool):
    lim = f"QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY session_score DESC, session) <= {mx}" if mx else ""
    return f"""WITH s AS (SELECT query_id, memory_id, score, conv_id AS session FROM bm JOIN mem USING (memory_id) WHERE score >= {floor}),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id, session ORDER BY score DESC, memory_id) AS r FROM s), g0 AS (SELECT query_id, session, round(avg(score), 9) AS session_score FROM t WHERE r <= {k} GROUP BY ALL), g AS (SELECT * FROM g0 {lim}),
j AS (SELECT s.*, session_score, round(session_score + 0.1 * score, 9) AS gs FROM s JOIN g USING (query_id, session))
SELECT query_id, memory_id, session, round(session_score, 5) AS session_score, row_number() OVER (PARTITION BY query_id ORDER BY gs DESC, memory_id) AS rank FROM j QUALIFY rank <= {pool}"""


@query("session_gate", _gate_sql("mean", 3, None, 0.0, 100))
def session_gate(spark, d):
    m = B.memories(spark, d).select("memory_id", F.col("conv_id").alias("session"))
    return H.session_gate(scored(spark, d), m).select("query_id", "memory_id", "session", F.round("session_score", 5).alias("session_score"), "rank")


@query("session_gate_top_sessions", _gate_sql("max", 1, 5, 2.0, 64))
def session_gate_top_sessions(spark, d):
    m = B.memories(spark, d).select("memory_id", F.col("conv_id").alias("session"))
    g = H.session_gate(scored(spark, d), m, pool=64, aggregation="max", max_sessions=5, floor=2.0)
    return g.select("query_id", "memory_id", "session", F.round("session_score", 5).alias("session_score"), "rank")


@query("abstaining_recall", """WITH l AS (SELECT query_id FROM bm GROUP BY query_id HAVING max(score) / max(max_possible) < 0.45)
SELECT query_id, memory_id, round(score, 5) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id) AS rank FROM bm WHERE query_id NOT IN (SELECT query_id FROM l) QUALIFY rank <= 5""")
def abstaining_recall(spark, d):
    return H.top_scored(H.abstain(scored(spark, d), 0.45), 5).select("query_id", "memory_id", F.round("score", 5).alias("score"), "rank")


@query("jaccard_gate", f"""WITH j AS (SELECT q.query_id, p.memory_id, list_distinct({S.space_words('q.text')}) AS a, list_distinct({S.space_words('p.content')}) AS b FROM qry q JOIN pool0 p ON q.topic = p.topic),
s AS (SELECT query_id, memory_id, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 9) AS score FROM j)
SELECT query_id, memory_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id) AS rank FROM s QUALIFY rank <= 8""")
def jaccard_gate(spark, d):
    return r6(H.jaccard_gate(_q(spark, d), pool(spark, d), 8), "score")
