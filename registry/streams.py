from pyspark.sql import functions as F

from engramlake.sources import bindings as B
from engramlake.streaming import jobs as M
from registry import query
from registry import snippets as S

ts = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
US = lambda c: f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f')"


def events(spark, d):
    return M.read_stream(spark, f"{d}/events*.parquet", B.table(spark, d, "events"))


def facts(spark, d):
    return B.facts_of(events(spark, d))


def notes(spark, d):
    return B.notes_of(events(spark, d))


@query("stream_compile", "SELECT message_id, memory_type, resolution, importance, confidence FROM cands")
def stream_compile(spark, d):
    return M.compile_stream(notes(spark, d))[0].select("message_id", "memory_type", "resolution", "importance", "confidence")


@query("stream_state", "SELECT entity, property, arg_min(value, {'t': ts, 'i': fact_id}) AS initial_value, arg_max(value, {'t': ts, 'i': fact_id}) AS current_value, min(fact_id) AS first_turn, max(fact_id) AS last_turn, count(*) - 1 AS access_count FROM facts GROUP BY entity, property")
def stream_state(spark, d):
    return M.state_stream(facts(spark, d))


@query("stream_decay")
def stream_decay(spark, d):
    return M.decay_stream(facts(spark, d))


@query("stream_conflicts", """SELECT entity, property, count(*) AS facts, count(DISTINCT value) AS values, count(DISTINCT value) FILTER (status = 'active') AS active_values, arg_max(value, {'t': ts, 'i': fact_id}) FILTER (status = 'active') AS active_candidate
FROM facts GROUP BY entity, property HAVING count(DISTINCT value) FILTER (status = 'active') > 1""")
def stream_conflicts(spark, d):
    return M.conflict_stream(facts(spark, d))


@query("stream_sessions", f"""WITH a AS (SELECT entity, ts, fact_id, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY entity ORDER BY ts, fact_id)) >= 300000000, false) AS g FROM facts),
b AS (SELECT *, sum(CAST(g AS INTEGER)) OVER (PARTITION BY entity ORDER BY ts, fact_id ROWS UNBOUNDED PRECEDING) AS s FROM a)
SELECT entity, count(*) AS events, {US('min(ts)')} AS started_at, {US('max(ts)')} AS ended_at FROM b GROUP BY entity, s""")
def stream_sessions(spark, d):
    return M.session_stream(facts(spark, d), "entity", mode="complete").withColumn("started_at", ts("started_at")).withColumn("ended_at", ts("ended_at"))


def _metric(spark, d):
    return events(spark, d).select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")


@query("stream_metrics", f"SELECT {US('date_trunc(chr(104) || chr(111) || chr(117) || chr(114), ts)')} AS start, event_type, count(*) AS n, round(sum(value), 3) AS total, max(value) AS high FROM events GROUP BY 1, 2".replace("chr(104) || chr(111) || chr(117) || chr(114)", "'hour'"))
def stream_metrics(spark, d):
    return M.metric_stream(_metric(spark, d), "event_type").withColumn("start", ts("start")).withColumn("total", F.round("total", 3))


@query("stream_metrics_sliding", f"""WITH w AS (SELECT unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS s, event_type, value FROM events)
SELECT {US('s')} AS start, event_type, count(*) AS n, round(sum(value), 3) AS total, max(value) AS high FROM w GROUP BY 1, 2""")
def stream_metrics_sliding(spark, d):
    return M.metric_stream(_metric(spark, d), "event_type", "2 hours", "1 hour").withColumn("start", ts("start")).withColumn("total", F.round("total", 3))


@query("stream_dedup", "SELECT left(sha256(text), 16) AS content_hash, count(DISTINCT left(sha256(text), 16)) AS n FROM notes GROUP BY 1")
def stream_dedup(spark, d):
    return M.dedup_stream(notes(spark, d)).groupBy("content_hash").agg(F.count("*").alias("n"))


@query("stream_cooldown", "SELECT event_id AS proposal_id, user_id AS memory_id, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) < 3600000000, false) AS rejected FROM events")
def stream_cooldown(spark, d):
    e = events(spark, d)
    return M.cooldown_stream(e.select(F.col("user_id").alias("memory_id"), F.col("event_id").alias("proposal_id"), F.col("ts").cast("timestamp").alias("ts")))
