from pyspark.sql import functions as F

from engramlake.functions import lexicons as L
from engramlake.functions.text import pick
from engramlake.operators import evaluate as V
from engramlake.operators import graph as J
from engramlake.sources import bindings as B
from registry import EXTRA_CTES, query
from registry import snippets as S
from registry.textfeatures import abstain_sql

ts = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
r6 = lambda df, *cols: df.withColumns({c: F.round(c, 6) for c in cols})

EXTRA_CTES["answers"] = "SELECT message_id // 9 AS question_id, 'player_' || message_id % 9 // 3 AS player, CAST(message_id % 3 AS INTEGER) AS repeat, text, value * 10 AS latency_ms FROM notes JOIN events ON event_id = message_id"
EXTRA_CTES["quest"] = """SELECT event_id // 9 AS question_id, event_type AS category, [[event_type, 'plan'], ['v0', 'v1']] AS ground_truth, ['hates', 'risk'] AS forbidden, event_id // 9 % 7 = 0 AS expected_abstention,
 CASE WHEN event_id // 9 % 3 = 0 THEN 'How many days since ' || event_type WHEN event_id // 9 % 3 = 1 THEN 'why did ' || event_type || ' fail' ELSE 'what is ' || event_type END AS question FROM events WHERE event_id % 9 = 0"""


def answers(spark, d):
    n, e = B.notes(spark, d), B.table(spark, d, "events").select(F.col("event_id").alias("message_id"), (F.col("value") * 10).alias("latency_ms"))
    i = F.col("message_id")
    return n.join(e, "message_id").select(F.expr("message_id div 9").alias("question_id"), F.concat(F.lit("player_"), F.expr("message_id % 9 div 3")).alias("player"), (i % 3).cast("int").alias("repeat"), "text", "latency_ms")


def questions(spark, d):
    q = F.expr("event_id div 9")
    t = F.col("event_type")
    return B.table(spark, d, "events").filter("event_id % 9 = 0").select(
        q.alias("question_id"), t.alias("category"), F.array(F.array(t, F.lit("plan")), F.array(F.lit("v0"), F.lit("v1"))).alias("ground_truth"), F.array(F.lit("hates"), F.lit("risk")).alias("forbidden"), (q % 7 == 0).alias("expected_abstention"),
        F.when(q % 3 == 0, F.concat(F.lit("How many days since "), t)).when(q % 3 == 1, F.concat(F.lit("why did "), t, F.lit(" fail"))).otherwise(F.concat(F.lit("what is "), t)).alias("question"))


_cov = lambda p: f"len(list_filter(ground_truth, lambda g: len(list_filter(g, lambda t: contains({p}, ' ' || t || ' '))) > 0))"
_forb = lambda p: f"len(list_filter(forbidden, lambda t: contains({p}, ' ' || t || ' '))) > 0"
EXTRA_CTES["scored"] = f"""WITH j AS (SELECT a.*, q.* EXCLUDE (question_id), {S.padded('text')} AS p FROM answers a JOIN quest q USING (question_id)),
k AS (SELECT *, CAST({_cov('p')} AS BIGINT) AS covered, CAST(2 AS BIGINT) AS groups, {_forb('p')} AS forbidden_hit, {abstain_sql('text')} AS abstained FROM j),
o AS (SELECT *, CASE WHEN expected_abstention AND abstained AND forbidden_hit THEN 'false_positive' WHEN expected_abstention AND abstained THEN 'pass' WHEN expected_abstention AND covered = groups THEN 'pass' WHEN expected_abstention THEN 'false_positive'
 WHEN forbidden_hit THEN 'fail' WHEN covered = groups THEN 'pass' WHEN covered > 0 THEN 'partial' ELSE 'fail' END AS outcome, covered / groups AS coverage FROM k)
SELECT * EXCLUDE (p), CASE outcome WHEN 'pass' THEN 1.0 WHEN 'partial' THEN round(coverage, 9) ELSE 0.0 END AS score FROM o"""


def scored(spark, d):
    return V.score_answers(questions(spark, d), answers(spark, d))


EXTRA_CTES["metrics"] = "SELECT event_id, ts, event_type AS name, 'tenant_' || user_id % 7 AS tenant, value FROM events"


def metrics(spark, d):
    return B.table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("name"), F.concat(F.lit("tenant_"), F.col("user_id") % 7).alias("tenant"), "value")


@query("metric_summary", "SELECT name, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS low, max(value) AS high, round(sum(value), 3) AS total FROM metrics GROUP BY name")
def metric_summary(spark, d):
    return r6(V.metric_summary(metrics(spark, d), ["name"]), "mean").withColumn("total", F.round("total", 3))


def _pct(src, by, ps):
    cols = ", ".join(f"max(value) FILTER (i = least(n - 1, CAST(floor(n * {p} / 100) AS BIGINT))) AS p{p}" for p in ps)
    return f"""WITH a AS (SELECT {by}, value, row_number() OVER (PARTITION BY {by} ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY {by}) AS n FROM {src})
SELECT {by}, n, round(avg(value), 6) AS mean, round(median(value), 6) AS median, {cols} FROM a GROUP BY {by}, n"""


@query("metric_percentiles", _pct("metrics", "name", (50, 90, 95, 99)))
def metric_percentiles(spark, d):
    return r6(V.percentiles(metrics(spark, d), ["name"]), "mean", "median")


EXTRA_CTES["lmetrics"] = "SELECT l_returnflag AS name, l_extendedprice / 1000 AS value FROM lineitem"


@query("lineitem_percentiles", _pct("lmetrics", "name", (50, 90, 95, 99)))
def lineitem_percentiles(spark, d):
    return r6(V.percentiles(B.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("name"), (F.col("l_extendedprice") / 1000).alias("value")), ["name"]), "mean", "median")


@query("metric_percentiles_approx", "SELECT name, count(*) AS n, " + ", ".join(f"quantile_disc(value, {p / 100}) AS p{p}" for p in (50, 90, 95, 99)) + " FROM metrics GROUP BY name")
def metric_percentiles_approx(spark, d):
    return V.approx_percentiles(metrics(spark, d), ["name"])


_bounds = [5.0, 10.0, 25.0, 50.0, 100.0, 250.0]


@query("histogram_buckets", "SELECT name, b.le, count(*) FILTER (value <= b.v) AS n FROM metrics, (VALUES " + ", ".join(f"('{b}', {b})" for b in _bounds) + ", ('Infinity', 1e300)) b(le, v) GROUP BY name, b.le")
def histogram_buckets(spark, d):
    return V.histogram_buckets(metrics(spark, d), ["name"], _bounds)


@query("counters_and_gauges", "SELECT name, tenant, round(sum(value), 3) AS counter, arg_max(value, {'t': ts, 'i': event_id}) AS gauge FROM metrics GROUP BY name, tenant")
def counters_and_gauges(spark, d):
    return V.counters(metrics(spark, d), ["name", "tenant"], "event_id").withColumn("counter", F.round("counter", 3))


@query("token_usage", "SELECT event_type AS operation, 'model_' || user_id % 3 AS model, count(*) AS calls, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS tokens FROM events GROUP BY CUBE (event_type, 'model_' || user_id % 3)")
def token_usage(spark, d):
    return V.token_usage(B.table(spark, d, "events").select(F.col("event_type").alias("operation"), F.concat(F.lit("model_"), F.col("user_id") % 3).alias("model"), F.floor("value").alias("tokens")))


@query("score_answers", "SELECT question_id, player, repeat, covered, forbidden_hit, abstained, outcome, score FROM scored")
def score_answers(spark, d):
    return scored(spark, d).select("question_id", "player", "repeat", "covered", "forbidden_hit", "abstained", "outcome", "score")


EXTRA_CTES["major"] = """WITH t AS (SELECT player, question_id, text, count(*) AS n, min(repeat) AS f, any_value(outcome) AS outcome, any_value(score) AS score FROM scored GROUP BY player, question_id, text),
r AS (SELECT player, question_id, count(*) AS repeats FROM scored GROUP BY player, question_id), b AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY player, question_id ORDER BY n DESC, f) = 1),
g AS (SELECT b.player, b.question_id, count(*) FILTER (s.outcome = b.outcome) AS agree FROM b JOIN scored s USING (player, question_id) GROUP BY b.player, b.question_id)
SELECT player, question_id, text, outcome, score, repeats, round(agree / repeats, 9) AS consistency FROM b JOIN r USING (player, question_id) JOIN g USING (player, question_id)"""


@query("majority_answer", "SELECT * REPLACE (round(consistency, 6) AS consistency) FROM major")
def majority_answer(spark, d):
    return r6(V.majority(scored(spark, d)), "consistency")


@query("aggregate_scores", """SELECT player, category, count(*) AS answers, count(*) FILTER (outcome = 'pass') AS pass, count(*) FILTER (outcome = 'partial') AS partial, count(*) FILTER (outcome = 'fail') AS fail, count(*) FILTER (outcome = 'false_positive') AS false_positive,
round(avg(CASE WHEN outcome = 'pass' THEN 1 ELSE 0 END), 6) AS accuracy, round(avg(CASE WHEN forbidden_hit THEN 1 ELSE 0 END), 6) AS forbidden_rate, round(avg(coverage), 6) AS mean_coverage, round(avg(score), 6) AS mean_score FROM scored GROUP BY ROLLUP (player, category)""")
def aggregate_scores(spark, d):
    return r6(V.aggregate_scores(scored(spark, d)), "accuracy", "forbidden_rate", "mean_coverage", "mean_score")


EXTRA_CTES["ctx"] = "SELECT question_id, string_agg(text, ' ' ORDER BY player, repeat) AS context, bool_and(contains(text, 'know')) AS is_abstention FROM answers WHERE player = 'player_0' GROUP BY question_id"


def contexts(spark, d):
    a = answers(spark, d).filter("player = 'player_0'")
    g = a.groupBy("question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("player", "repeat", "text"))), lambda x: x["text"]), " ").alias("context"), F.bool_and(F.col("text").contains("know")).alias("is_abstention"))
    return g


EXTRA_CTES["rscore"] = f"""WITH j AS (SELECT c.*, q.* EXCLUDE (question_id), {S.padded('context')} AS p FROM ctx c JOIN quest q USING (question_id)), k AS (SELECT *, CAST({_cov('p')} AS BIGINT) AS covered, {_forb('p')} AS forbidden_hit FROM j),
l AS (SELECT *, CASE WHEN expected_abstention THEN is_abstention AND NOT forbidden_hit ELSE covered = 2 AND NOT forbidden_hit END AS passed FROM k)
SELECT *, CASE WHEN passed THEN 1.0 WHEN expected_abstention THEN 0.0 ELSE covered / 2 END AS score, length(context) // 4 AS tokens FROM l"""


@query("score_retrieval", "SELECT question_id, covered, forbidden_hit, passed, round(score, 6) AS score, tokens FROM rscore")
def score_retrieval(spark, d):
    return r6(V.score_retrieval(questions(spark, d), contexts(spark, d)), "score")


@query("extended_metrics", """WITH a AS (SELECT player, latency_ms AS value, row_number() OVER (PARTITION BY player ORDER BY latency_ms) - 1 AS i, count(*) OVER (PARTITION BY player) AS n FROM scored),
p AS (SELECT player, median(value) AS m, max(value) FILTER (i = least(n - 1, CAST(floor(n * 95 / 100) AS BIGINT))) AS p95, max(value) FILTER (i = least(n - 1, CAST(floor(n * 99 / 100) AS BIGINT))) AS p99 FROM a GROUP BY player, n),
b AS (SELECT player, count(*) AS answers, avg(score) AS accuracy, count(*) FILTER (outcome IN ('fail', 'false_positive')) AS fails, avg(CASE WHEN outcome = 'false_positive' OR forbidden_hit THEN 1 ELSE 0 END) AS fp, avg(coverage) AS mc, count(*) FILTER (repeat = 0) AS write_calls, count(*) FILTER (repeat > 0) AS read_calls FROM scored GROUP BY player)
SELECT player, answers, round(accuracy, 6) AS accuracy, fails, round(fp, 6) AS false_positive_rate, round(mc, 6) AS mean_coverage, write_calls, read_calls, round(m, 6) AS latency_p50, round(p95, 6) AS latency_p95, round(p99, 6) AS latency_p99 FROM b JOIN p USING (player)""")
def extended_metrics(spark, d):
    return r6(V.extended_metrics(scored(spark, d)), "accuracy", "false_positive_rate", "mean_coverage", "latency_p50", "latency_p95", "latency_p99")


@query("recall_curve", """WITH tr AS (SELECT memory_id AS query_id, CASE WHEN memory_id >= 11 THEN memory_id - 11 ELSE memory_id + 1 END AS node FROM mem WHERE memory_type = 'current' UNION SELECT memory_id, memory_id // 7 FROM mem WHERE memory_type = 'current'),
f AS (SELECT set_id, node, min(depth) AS hop FROM bfs GROUP BY ALL), j AS (SELECT tr.query_id, h.hop, avg(CASE WHEN f.hop <= h.hop THEN 1 ELSE 0 END) AS r FROM tr JOIN (VALUES (0), (1), (2)) h(hop) ON true LEFT JOIN f ON f.set_id = tr.query_id AND f.node = tr.node GROUP BY ALL)
SELECT hop, count(*) AS queries, round(avg(r), 6) AS mean_recall FROM j GROUP BY hop""")
def recall_curve(spark, d):
    m = B.memories(spark, d)
    seeds = m.filter("memory_type = 'current'").select(F.col("memory_id").alias("set_id"), F.col("memory_id").alias("node"))
    pools = J.traverse_memories(seeds, B.edges(spark, d), m).select(F.col("set_id").alias("query_id"), "node", F.col("depth").alias("hop"))
    i = F.col("node")
    truth = seeds.select(F.col("set_id").alias("query_id"), F.when(i >= 11, i - 11).otherwise(i + 1).alias("node")).union(seeds.select("set_id", F.expr("node div 7"))).distinct()
    return r6(V.recall_curve(truth, pools, 2), "mean_recall")


EXTRA_CTES["fails"] = """SELECT s.question_id, s.player, s.repeat, s.text, s.outcome, s.expected_abstention, s.question, r.context, s.question_id % 10 <> 0 AS in_corpus, r.covered = 2 AS in_context, r.covered > 0 AS retrieved, s.covered > 0 AS answered, r.is_abstention AS context_abstains
FROM scored s JOIN rscore r USING (question_id)"""


def fails(spark, d):
    q = questions(spark, d)
    s = scored(spark, d).select("question_id", "player", "repeat", "text", "outcome", "expected_abstention", "question", (F.col("question_id") % 10 != 0).alias("in_corpus"), (F.col("covered") > 0).alias("answered"))
    c = contexts(spark, d)
    r = V.score_retrieval(q, c).select("question_id", (F.col("covered") == 2).alias("in_context"), (F.col("covered") > 0).alias("retrieved"))
    return s.join(r, "question_id").join(c.select("question_id", "context", F.col("is_abstention").alias("context_abstains")), "question_id")


@query("attribute_failures", """SELECT question_id, player, repeat, CASE WHEN outcome = 'pass' THEN 'none' WHEN NOT expected_abstention AND NOT in_corpus THEN 'dataset' WHEN NOT expected_abstention AND NOT in_context AND retrieved THEN 'resolution' WHEN NOT expected_abstention AND NOT in_context THEN 'retrieval'
 WHEN NOT expected_abstention AND NOT answered THEN 'reasoning' WHEN expected_abstention AND context_abstains THEN 'reasoning' WHEN expected_abstention THEN 'resolution' ELSE 'evaluator' END AS origin FROM fails""")
def attribute_failures(spark, d):
    return V.attribute_failures(fails(spark, d)).select("question_id", "player", "repeat", "origin")


_al, _ql = "lower(text)", "lower(question)"


@query("failure_taxonomy", f"""WITH a AS (SELECT *, in_context AS oracle_recall, ['single', 'temporal-reasoning', 'knowledge-update', 'multi-hop', 'single', 'multi-session'][1 + question_id % 6] AS kind FROM fails WHERE outcome <> 'pass'),
c AS (SELECT CASE WHEN expected_abstention AND NOT {S.contains_any(_al, ['none', 'not mentioned', 'unknown', "i don't know"])} THEN 'abstention' WHEN NOT expected_abstention AND {S.contains_any(_al, ["i don't know", 'not mentioned'])} AND oracle_recall THEN 'abstention'
 WHEN kind = 'temporal-reasoning' OR {S.contains_any(_ql, L.TEMPORAL_QUESTIONS)} THEN 'temporal' WHEN kind = 'knowledge-update' OR {S.contains_any(_ql, L.STATE_QUESTIONS)} THEN 'state'
 WHEN (kind IN ('multi-hop', 'multi-session') OR {S.contains_any(_ql, L.COMPOSITION_QUESTIONS)}) AND oracle_recall THEN 'composition' WHEN NOT oracle_recall THEN 'retrieval' WHEN {S.contains_any(_al, ['her home country', 'her dog', 'the country', 'his'])} THEN 'entity'
 WHEN len({S.space_words('text')}) > 2 AND len(list_filter({S.space_words('text')}, lambda w: length(w) > 4 AND contains(lower(context), w))) = 0 THEN 'verification' ELSE 'grounding' END AS failure FROM a)
SELECT failure, count(*) AS n FROM c GROUP BY failure""")
def failure_taxonomy(spark, d):
    return V.failure_taxonomy(fails(spark, d).withColumn("oracle_recall", F.col("in_context")).withColumn("question_type", pick(["single", "temporal-reasoning", "knowledge-update", "multi-hop", "single", "multi-session"], F.expr("question_id % 6")))).groupBy("failure").agg(F.count("*").alias("n"))


@query("compare_runs", """WITH g AS (SELECT CAST(day(ts) AS INTEGER) AS run, name, avg(value) AS value FROM metrics GROUP BY ALL)
SELECT a.run, name, round(a.value, 6) AS value, round(b.value, 6) AS previous, round(a.value - b.value, 6) AS delta FROM g a JOIN g b USING (name) WHERE a.run = b.run + 1""")
def compare_runs(spark, d):
    return r6(V.compare_runs(metrics(spark, d).withColumn("run", F.dayofmonth("ts"))), "value", "previous", "delta")


@query("claim_provenance", f"""WITH c AS (SELECT entity || ' ' || property || ' ' || value AS claim, fact_id, fact_id % 5 AS hop FROM facts)
SELECT left(sha256(claim), 16) AS claim_id, claim, count(DISTINCT c.fact_id) AS turns, count(DISTINCT source) AS sources, {S.fmt('min(ts)')} AS first_at, round(greatest(0.5, 1.0 - 0.15 * min(hop)), 6) AS confidence FROM c JOIN facts f ON f.fact_id = c.fact_id GROUP BY claim""")
def claim_provenance(spark, d):
    f = B.facts(spark, d)
    c = f.select(F.concat_ws(" ", "entity", "property", "value").alias("claim"), "fact_id", (F.col("fact_id") % 5).alias("hop"))
    return r6(V.claim_provenance(c, f).withColumn("first_at", ts("first_at")), "confidence")
