from pyspark.sql import functions as F

from engramlake.functions import lexicons as L
from engramlake.operators import temporal as T
from engramlake.session import AS_OF, materialise
from engramlake.sources import bindings as B
from registry import EXTRA_CTES, query
from registry import snippets as S
from registry.beliefs import TIMES
from registry.textfeatures import _anchor_sql

ts = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
NOW = f"TIMESTAMP '{AS_OF}'"
_times = "[" + ", ".join(f"TIMESTAMP '{t}'" for t in TIMES) + "]"

EXTRA_CTES["cev"] = "SELECT memory_id, 0 AS from_resolution, resolution AS to_resolution, 1.0 + resolution * 0.5 AS ratio, updated_at AS created_at FROM mem WHERE resolution > 0"
EXTRA_CTES["mdec"] = f"""SELECT memory_id AS decision_id, memory_id, topic, conv_id, message_id, coalesce(content, '') AS text, created_at AS decided_at, valid_until, confidence, is_current
FROM mem WHERE memory_type = 'decision'"""
EXTRA_CTES["gone"] = """SELECT m.*, CASE WHEN status IN ('archived', 'deep_archived') THEN updated_at END AS gs, c.g,
 least(coalesce(CASE WHEN status IN ('archived', 'deep_archived') THEN updated_at END, c.g), coalesce(c.g, CASE WHEN status IN ('archived', 'deep_archived') THEN updated_at END)) AS gone_at
 FROM mem m LEFT JOIN (SELECT memory_id, min(created_at) AS g FROM cev WHERE to_resolution >= 4 GROUP BY memory_id) c USING (memory_id)"""


@query("valid_at", f"SELECT memory_id, {S.fmt('valid_from')} AS valid_from, {S.fmt('valid_until')} AS valid_until FROM mem WHERE valid_from <= TIMESTAMP '2024-02-01' AND (valid_until IS NULL OR TIMESTAMP '2024-02-01' < valid_until)")
def valid_at(spark, d):
    return T.valid_at(B.memories(spark, d), "2024-02-01").select("memory_id", ts("valid_from").alias("valid_from"), ts("valid_until").alias("valid_until"))


@query("state_at", f"""
WITH t AS (SELECT unnest({_times}) AS at_time)
SELECT {S.fmt('at_time')} AS at_time, 'memory' AS kind, memory_id AS id FROM t JOIN gone ON created_at <= at_time AND (gone_at IS NULL OR gone_at > at_time)
UNION ALL SELECT {S.fmt('at_time')}, 'decision', decision_id FROM t JOIN mdec ON decided_at <= at_time AND (valid_until IS NULL OR valid_until > at_time)""")
def state_at(spark, d):
    return T.state_at(B.memories(spark, d), B.memory_decisions(spark, d), B.compression_events(spark, d), TIMES).withColumn("at_time", ts("at_time"))


@query("changes_between", f"""
WITH a AS (SELECT *, created_at <= TIMESTAMP '{TIMES[0]}' AND (gone_at IS NULL OR gone_at > TIMESTAMP '{TIMES[0]}') AS la, created_at <= TIMESTAMP '{TIMES[1]}' AND (gone_at IS NULL OR gone_at > TIMESTAMP '{TIMES[1]}') AS lb,
 updated_at > TIMESTAMP '{TIMES[0]}' AND updated_at <= TIMESTAMP '{TIMES[1]}' AS ud FROM gone),
u AS (SELECT memory_id, 'added' AS change, created_at AS ts FROM a WHERE lb AND NOT la UNION ALL SELECT memory_id, 'removed', gone_at FROM a WHERE la AND NOT lb
UNION ALL SELECT memory_id, 'modified', updated_at FROM a WHERE la AND lb AND ud UNION ALL SELECT memory_id, 'status_changed', updated_at FROM a WHERE status IN ('archived', 'deep_archived') AND ud
UNION ALL SELECT memory_id, 'compressed', created_at FROM cev WHERE created_at > TIMESTAMP '{TIMES[0]}' AND created_at <= TIMESTAMP '{TIMES[1]}')
SELECT memory_id, change, {S.fmt('ts')} AS ts FROM u""")
def changes_between(spark, d):
    return T.changes_between(B.memories(spark, d), B.compression_events(spark, d), TIMES[0], TIMES[1]).withColumn("ts", ts("ts"))


@query("timeline", f"""
WITH u AS (SELECT created_at AS ts, 'memory_created' AS event, memory_id AS id, memory_type AS detail FROM mem UNION ALL SELECT created_at, 'memory_compressed', memory_id, from_resolution || '>' || to_resolution FROM cev
UNION ALL SELECT decided_at, 'decision_made', decision_id, substring(text, 1, 100) FROM decs) SELECT {S.fmt('ts')} AS ts, event, id, detail FROM u""")
def timeline(spark, d):
    return T.timeline(B.memories(spark, d), B.compression_events(spark, d), B.decisions(spark, d)).withColumn("ts", ts("ts"))


@query("time_range", f"SELECT memory_id, {S.fmt('created_at')} AS created_at FROM mem WHERE created_at BETWEEN TIMESTAMP '2023-03-01' AND TIMESTAMP '2024-03-01' AND memory_type = 'semantic' ORDER BY mem.created_at DESC, memory_id LIMIT 20")
def time_range(spark, d):
    return T.time_range(B.memories(spark, d), "2023-03-01", "2024-03-01", "semantic", 20).select("memory_id", ts("created_at").alias("created_at"))


@query("invalidate", f"""
WITH d AS (SELECT doc_id AS memory_id, min(TIMESTAMP '2024-01-15' + to_days(CAST(quality * 60 + toxic * 15 AS INTEGER))) AS u FROM labels GROUP BY doc_id)
SELECT memory_id, {S.fmt('least(coalesce(valid_until, u), coalesce(u, valid_until))')} AS valid_until FROM mem LEFT JOIN d USING (memory_id)""")
def invalidate(spark, d):
    delta = B.table(spark, d, "labels").select(F.col("doc_id").alias("memory_id"), F.expr("timestampadd(DAY, quality * 60 + toxic * 15, timestamp'2024-01-15')").alias("invalid_at"))
    return T.invalidate(B.memories(spark, d), delta).select("memory_id", ts("valid_until").alias("valid_until"))


@query("supersession_heads", """
WITH RECURSIVE nx AS (SELECT dst AS memory_id, max(src) AS head FROM edges WHERE type = 'supersedes' AND src > dst GROUP BY dst),
r AS (SELECT memory_id, head, 1 AS steps FROM nx UNION ALL SELECT r.memory_id, nx.head, steps + 1 FROM r JOIN nx ON r.head = nx.memory_id WHERE steps < 10)
SELECT memory_id, arg_max(head, steps) AS head, CAST(max(steps) AS BIGINT) AS steps FROM r GROUP BY memory_id""")
def supersession_heads(spark, d):
    return T.supersession_heads(B.edges(spark, d))


def _sup_sql(src, topic):
    return f"""t AS (SELECT decision_id, {topic}, decided_at, list_distinct({S.space_words('text')}) AS w FROM {src}),
p AS (SELECT a.decision_id, b.decision_id AS o, b.decided_at AS od FROM t a JOIN t b ON a.{topic} = b.{topic} AND b.decided_at > a.decided_at WHERE len(list_intersect(a.w, b.w)) >= 3)
SELECT decision_id, o AS superseded_by, od AS superseded_at FROM p QUALIFY row_number() OVER (PARTITION BY decision_id ORDER BY od, o) = 1"""


EXTRA_CTES["msup"] = "WITH " + _sup_sql("mdec", "topic")


@query("superseding_decisions", f"WITH {_sup_sql('decs', 'topic_id')}".replace("od AS superseded_at", f"{S.fmt('od')} AS superseded_at"))
def superseding_decisions(spark, d):
    return T.superseding_decisions(B.decisions(spark, d), "topic_id").withColumn("superseded_at", ts("superseded_at"))


EXTRA_CTES["dev"] = f"""WITH dw AS (SELECT decision_id, conv_id, message_id AS own, unnest(list_distinct({S.space_words('text')})) AS w FROM mdec),
mw AS (SELECT conv_id, message_id, created_at, unnest(list_distinct({S.space_words('text')})) AS w FROM msg WHERE role = 'assistant'),
s AS (SELECT decision_id, message_id, created_at FROM dw JOIN mw USING (conv_id, w) WHERE own IS NULL OR own <> message_id GROUP BY ALL HAVING count(*) >= 2),
c AS (SELECT DISTINCT src AS a, dst AS b FROM edges WHERE type = 'contradicts' UNION SELECT DISTINCT dst, src FROM edges WHERE type = 'contradicts')
SELECT decision_id, 'decided' AS event, decided_at AS ts, memory_id AS ref_id FROM mdec UNION ALL SELECT decision_id, 'supported', created_at, message_id FROM s
UNION ALL SELECT decision_id, 'challenged', created_at, b FROM mdec d JOIN c ON d.memory_id = a JOIN mem m ON m.memory_id = b UNION ALL SELECT decision_id, 'superseded', superseded_at, superseded_by FROM msup"""


def dec_events(spark, d, superseded=None):
    return T.decision_events(B.memory_decisions(spark, d), B.memories(spark, d), B.messages(spark, d), B.edges(spark, d), superseded=superseded)


@query("decision_events", f"SELECT decision_id, event, {S.fmt('ts')} AS ts, ref_id FROM dev")
def decision_events(spark, d):
    return dec_events(spark, d).withColumn("ts", ts("ts"))


@query("decision_traces", f"""
WITH e AS (SELECT decision_id, min(ts) AS first_at, max(ts) AS last_at, count(*) FILTER (event = 'supported') AS supported, count(*) FILTER (event = 'challenged') AS challenged, count(*) FILTER (event = 'superseded') AS superseded FROM dev GROUP BY decision_id),
p AS (SELECT memory_id, count(*) AS dependents FROM (SELECT src AS memory_id FROM edges WHERE type IN ('causes', 'follows', 'elaborates') UNION ALL SELECT dst FROM edges WHERE type IN ('causes', 'follows', 'elaborates')) GROUP BY memory_id),
b AS (SELECT memory_id, count(*) AS beliefs FROM bev WHERE polarity = 'supporting' GROUP BY memory_id)
SELECT decision_id, {S.fmt('first_at')} AS first_at, {S.fmt('last_at')} AS last_at, supported, challenged, superseded, coalesce(dependents, 0) AS dependents, coalesce(beliefs, 0) AS beliefs,
 round(least(1.0, (coalesce(dependents, 0) + coalesce(beliefs, 0)) * 0.1), 6) AS cascade_risk FROM mdec JOIN e USING (decision_id) LEFT JOIN p USING (memory_id) LEFT JOIN b USING (memory_id)""")
def decision_traces(spark, d):
    from registry.beliefs import beliefs

    t = T.decision_traces(B.memory_decisions(spark, d), dec_events(spark, d), B.edges(spark, d), beliefs(spark, d)[1])
    return t.drop("memory_id").withColumn("first_at", ts("first_at")).withColumn("last_at", ts("last_at")).withColumn("cascade_risk", F.round("cascade_risk", 6))


@query("compare_decisions", """
WITH pr AS (SELECT decision_id AS a, superseded_by AS b FROM msup UNION SELECT x.decision_id, y.decision_id FROM edges JOIN mdec x ON src = x.memory_id JOIN mdec y ON dst = y.memory_id),
sp AS (SELECT decision_id, min(ts) AS lo, max(ts) AS hi FROM dev GROUP BY decision_id),
sh AS (SELECT a, b, count(*) AS n FROM pr JOIN dev x ON x.decision_id = a AND x.event = 'supported' JOIN dev y ON y.decision_id = b AND y.event = 'supported' AND x.ref_id = y.ref_id GROUP BY a, b)
SELECT pr.a, pr.b, x.hi >= y.lo AND y.hi >= x.lo AS timeline_overlap, coalesce(sh.n, 0) AS supporting_overlap, coalesce(sa.superseded_by = pr.b, false) OR coalesce(sb.superseded_by = pr.a, false) AS conflict
FROM pr JOIN sp x ON x.decision_id = pr.a JOIN sp y ON y.decision_id = pr.b LEFT JOIN sh ON sh.a = pr.a AND sh.b = pr.b LEFT JOIN msup sa ON sa.decision_id = pr.a LEFT JOIN msup sb ON sb.decision_id = pr.b""")
def compare_decisions(spark, d):
    dec = B.memory_decisions(spark, d)
    sup = T.superseding_decisions(dec, "topic")
    ids = dec.select("decision_id")
    e = B.edges(spark, d).select(F.col("src").alias("a"), F.col("dst").alias("b"))
    e = e.join(ids, F.col("a") == F.col("decision_id"), "left_semi").join(ids, F.col("b") == F.col("decision_id"), "left_semi")
    pairs = sup.select(F.col("decision_id").alias("a"), F.col("superseded_by").alias("b")).union(e).distinct()
    return T.compare_decisions(pairs, materialise(dec_events(spark, d, sup), "decision-events"), sup)


EXTRA_CTES["ctxat"] = f"""WITH g AS (SELECT unnest(generate_series(TIMESTAMP '2023-01-01', {NOW}, INTERVAL 7 DAY)) AS at_time),
a AS (SELECT at_time, memory_id, {S.tokens('content')} AS tokens, round(importance * confidence, 9) AS priority FROM g JOIN gone ON is_current AND created_at <= at_time AND (gone_at IS NULL OR gone_at > at_time)
 AND valid_from <= at_time AND (valid_until IS NULL OR at_time < valid_until)),
b AS (SELECT *, sum(tokens) OVER (PARTITION BY at_time ORDER BY priority DESC, memory_id ROWS UNBOUNDED PRECEDING) AS used_tokens FROM a)
SELECT at_time, memory_id, tokens, priority, CAST(used_tokens AS BIGINT) AS used_tokens FROM b WHERE used_tokens <= 4000"""


@query("context_at", f"SELECT * REPLACE ({S.fmt('at_time')} AS at_time, round(priority, 6) AS priority) FROM ctxat")
def context_at(spark, d):
    c = T.context_at(B.memories(spark, d), B.compression_events(spark, d), T.time_grid("2023-01-01", AS_OF))
    return c.withColumn("at_time", ts("at_time")).withColumn("priority", F.round("priority", 6))


@query("decision_contexts", f"""WITH a AS (SELECT decision_id, g.memory_id, {S.tokens('content')} AS tokens, round(g.importance * g.confidence, 9) AS priority FROM mdec d JOIN gone g ON g.topic = d.topic AND g.is_current AND g.created_at <= d.decided_at
 AND (gone_at IS NULL OR gone_at > d.decided_at) AND g.valid_from <= d.decided_at AND (g.valid_until IS NULL OR d.decided_at < g.valid_until)),
b AS (SELECT *, sum(tokens) OVER (PARTITION BY decision_id ORDER BY priority DESC, memory_id ROWS UNBOUNDED PRECEDING) AS used_tokens FROM a)
SELECT decision_id, memory_id, tokens, round(priority, 6) AS priority, CAST(used_tokens AS BIGINT) AS used_tokens FROM b WHERE used_tokens <= 4000""")
def decision_contexts(spark, d):
    return T.decision_contexts(B.memory_decisions(spark, d), B.memories(spark, d), B.compression_events(spark, d)).withColumn("priority", F.round("priority", 6))


@query("compare_contexts", """
WITH l AS (SELECT memory_id, tokens FROM ctxat WHERE at_time = TIMESTAMP '2023-07-02'), r AS (SELECT memory_id, tokens FROM ctxat WHERE at_time = TIMESTAMP '2024-06-02')
SELECT coalesce(l.memory_id, r.memory_id) AS memory_id, l.tokens AS tokens_a, r.tokens AS tokens_b, CASE WHEN r.tokens IS NULL THEN 'part_removed' ELSE 'part_added' END AS change
FROM l FULL JOIN r ON l.memory_id = r.memory_id WHERE l.tokens IS NULL OR r.tokens IS NULL""")
def compare_contexts(spark, d):
    c = lambda t: T.context_at(B.memories(spark, d), B.compression_events(spark, d), F.array(F.lit(t).cast("timestamp")))
    return T.compare_contexts(c("2023-07-02"), c("2024-06-02"))


EXTRA_CTES["wq"] = """WITH e AS (SELECT event_type, min(event_id) AS i, min(user_id) AS u FROM events GROUP BY event_type)
SELECT i * 10 + k AS query_id, 'user_' || u AS subject, replace(t, '#', event_type) AS text FROM e, (VALUES (0, 'When did someone adopt a plan because of # failing?'), (1, 'When will Team Alpha review #?'), (2, 'When did they buy # items?')) v(k, t)"""


def when_questions(spark, d):
    e = B.table(spark, d, "events").groupBy("event_type").agg(F.min("event_id").alias("i"), F.min("user_id").alias("u"))
    forms = ["When did someone adopt a plan because of # failing?", "When will Team Alpha review #?", "When did they buy # items?"]
    e = e.select("event_type", "i", "u", F.posexplode(F.array(*[F.lit(x) for x in forms])).alias("k", "t"))
    return e.select((F.col("i") * 10 + F.col("k")).alias("query_id"), F.concat(F.lit("user_"), "u").alias("subject"), F.replace("t", F.lit("#"), F.col("event_type")).alias("text"))


_nums = "|".join(L.NUMBER_WORDS)


@query("when_answers", rf"""
WITH m AS (SELECT *, {S.padded('text')} AS pad FROM notes),
m2 AS (SELECT message_id, speaker, text, created_at, pad, {S.has_phrase('pad', T.TIME_WORDS)} AS timed, regexp_matches(pad, ' (?:\d+|{_nums}) years? (?:ago|now) ') AS years FROM m),
t0 AS (SELECT query_id, subject, unnest(list_filter({S.words('text')}, lambda w: length(w) >= 3 AND w NOT IN ({', '.join(S.q(w) for w in L.STOP_WORDS)}))) AS w FROM wq),
t AS (SELECT DISTINCT query_id, subject, {S.stem('w', L.IRREGULAR_STEMS)} AS term FROM t0), w0 AS (SELECT message_id, unnest({S.words('text')}) AS w FROM notes),
w AS (SELECT DISTINCT message_id, {S.stem('w', L.IRREGULAR_STEMS)} AS term FROM w0),
h AS (SELECT query_id, subject, message_id, sum(CASE WHEN length(term) > 4 THEN 1.5 ELSE 1.0 END) AS o FROM t JOIN w USING (term) GROUP BY ALL),
s AS (SELECT query_id, message_id, o * 3.0 + CASE WHEN lower(speaker) = lower(subject) THEN 1.0 ELSE 0.0 END + CASE WHEN timed THEN 2.0 ELSE 0.0 END + CASE WHEN years THEN 3.0 ELSE 0.0 END AS score FROM h JOIN m2 USING (message_id) WHERE o >= 2.0 OR timed),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, message_id) = 1)
SELECT query_id, message_id, round(score, 6) AS score, coalesce({_anchor_sql('pad')}, CASE WHEN contains(lower(text), 'since') AND regexp_extract(text, '(20\d{{2}})', 1) <> '' THEN 'Since ' || regexp_extract(text, '(20\d{{2}})', 1) END,
 nullif(regexp_extract(text, '(20\d{{2}})', 1), ''), strftime(created_at, '%-d %B %Y')) AS answer FROM b JOIN m2 USING (message_id)""")
def when_answers(spark, d):
    return T.when_answers(when_questions(spark, d), B.notes(spark, d)).withColumn("score", F.round("score", 6))


@query("event_durations", f"""
WITH q AS (SELECT min(event_id) AS query_id, 'bought ' || event_type || ' items' AS a, 'adopt plan because ' || event_type || ' failed' AS b FROM events GROUP BY event_type),
n AS (SELECT query_id, 'a' AS side, a AS text FROM q UNION ALL SELECT query_id, 'b', b FROM q),
t AS (SELECT query_id, side, unnest(list_filter(list_distinct({S.words('text')}), lambda w: length(w) >= 3 AND w NOT IN ('the', 'and', 'that', 'this', 'with', 'have', 'from', 'for', 'day'))) AS term FROM n),
w0 AS (SELECT conv_id, unnest({S.words('text')}) AS term FROM notes), w AS (SELECT DISTINCT conv_id, term FROM w0 WHERE length(term) >= 3),
h AS (SELECT query_id, side, conv_id, sum(CASE WHEN length(term) >= 4 THEN 3.0 ELSE 1.0 END) AS s FROM t JOIN w USING (term) GROUP BY ALL HAVING sum(CASE WHEN length(term) >= 4 THEN 3.0 ELSE 1.0 END) >= 2),
b AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY query_id, side ORDER BY s DESC, conv_id) = 1),
dd AS (SELECT conv_id, CAST(min(created_at) AS DATE) AS dt FROM notes GROUP BY conv_id),
p AS (SELECT query_id, max(dt) FILTER (side = 'a') AS da, max(dt) FILTER (side = 'b') AS db FROM b JOIN dd USING (conv_id) GROUP BY query_id),
g AS (SELECT *, abs(date_diff('day', da, db)) AS g, abs((year(db) - year(da)) * 12 + month(db) - month(da)) AS m FROM p WHERE da IS NOT NULL AND db IS NOT NULL)
SELECT query_id, CAST(da AS VARCHAR) AS date_a, CAST(db AS VARCHAR) AS date_b, g AS gap_days, CAST(round_even(g / 7.0, 0) AS BIGINT) AS gap_weeks, CASE WHEN m > 0 THEN CAST(m AS BIGINT) ELSE greatest(1, CAST(round_even(g / 30.0, 0) AS BIGINT)) END AS gap_months,
 CASE WHEN da < db THEN 'a' WHEN db < da THEN 'b' ELSE 'same' END AS first_event FROM g""")
def event_durations(spark, d):
    q = B.table(spark, d, "events").groupBy("event_type").agg(F.min("event_id").alias("query_id")).select(
        "query_id", F.concat(F.lit("bought "), "event_type", F.lit(" items")).alias("event_a"), F.concat(F.lit("adopt plan because "), "event_type", F.lit(" failed")).alias("event_b"))
    r = T.event_durations(q, B.notes(spark, d))
    return r.withColumn("date_a", F.col("date_a").cast("string")).withColumn("date_b", F.col("date_b").cast("string"))
