from pyspark.sql import functions as F

from engramlake.session import work_path
from engramlake.sources import bindings as B
from engramlake.sources import stores as A
from registry import query
from registry import snippets as S
from registry.compression import versions
from registry.governance import audit

ts = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")


@query("scan_memories", f"SELECT memory_id, topic, {S.fmt('updated_at')} AS updated_at FROM mem WHERE status = 'active' AND is_current ORDER BY mem.updated_at DESC, memory_id LIMIT 50 OFFSET 10")
def scan_memories(spark, d):
    return A.scan_memories(B.memories(spark, d), status="active", current=True, limit=50, offset=10).select("memory_id", "topic", ts("updated_at").alias("updated_at"))


@query("read_messages", "SELECT message_id, conv_id, turn, role, count(*) OVER (PARTITION BY conv_id) AS message_count FROM msg")
def read_messages(spark, d):
    return A.read_messages(B.messages(spark, d)).select("message_id", "conv_id", "turn", "role", "message_count")


@query("append_fact_tables", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS date, count(*) AS n FROM events GROUP BY 1")
def append_fact_tables(spark, d):
    path = work_path(spark, "usage-log")
    u = B.table(spark, d, "events").select("event_id", F.col("event_type").alias("operation"), F.col("ts").cast("timestamp").alias("created_at"), "value")
    A.append(u.filter("event_id % 2 = 0"), path)
    A.append(u.filter("event_id % 2 = 1"), path)
    return spark.read.parquet(path).groupBy(F.col("date").cast("string").alias("date")).agg(F.count("*").alias("n"))


@query("upsert_latest", """WITH b AS (SELECT entity || '/' || property AS belief_key, value, fact_id AS revision FROM facts) SELECT belief_key, arg_max(value, revision) AS value, max(revision) AS revision FROM b GROUP BY belief_key""")
def upsert_latest(spark, d):
    b = B.facts(spark, d).select(F.concat("entity", F.lit("/"), "property").alias("belief_key"), "value", F.col("fact_id").alias("revision"))
    return A.upsert_latest(b.filter("revision % 3 <> 0"), b.filter("revision % 3 = 0"), "belief_key", "revision")


@query("export_topic_digest", "SELECT topic, count(*) + count(DISTINCT memory_type) AS lines FROM mem GROUP BY topic")
def export_topic_digest(spark, d):
    path = work_path(spark, "digest")
    A.export_topic_digest(B.memories(spark, d), path)
    return spark.read.text(path).groupBy("topic").agg(F.count("*").alias("lines"))


@query("audit_log", f"SELECT event_id, {S.fmt('ts')} AS ts, type, severity, tenant FROM audit WHERE severity = 'error' AND tenant = 'tenant_3' AND ts >= TIMESTAMP '2024-01-05' ORDER BY audit.ts DESC, event_id LIMIT 100")
def audit_log(spark, d):
    path = work_path(spark, "audit")
    A.write_audit(audit(spark, d), path)
    return A.query_audit(spark, path, severity="error", tenant="tenant_3", start="2024-01-05").select("event_id", ts("ts").alias("ts"), "type", "severity", "tenant")


def _package(spark, d):
    return A.from_package(A.to_package(B.memories(spark, d), versions(spark, d), B.edges(spark, d).select("src", "dst", "type", "strength")))


@query("package_memories", "SELECT memory_id, topic, content, round(importance, 6) AS importance, round(confidence, 6) AS confidence FROM mem")
def package_memories(spark, d):
    return _package(spark, d)[0].withColumn("importance", F.round("importance", 6)).withColumn("confidence", F.round("confidence", 6))


@query("package_versions", "SELECT memory_id, resolution, method, content, round(ratio, 6) AS ratio FROM vers")
def package_versions(spark, d):
    return _package(spark, d)[1].withColumn("ratio", F.round("ratio", 6))


@query("package_edges", "SELECT src, dst, type, round(strength, 6) AS strength FROM edges")
def package_edges(spark, d):
    return _package(spark, d)[2].withColumn("strength", F.round("strength", 6))


@query("view_active_memories", "SELECT memory_id, topic, memory_type FROM mem WHERE status = 'active' AND is_current")
def view_active_memories(spark, d):
    A.create_views(B.memories(spark, d), B.memory_decisions(spark, d), versions(spark, d))
    return spark.sql("SELECT memory_id, topic, memory_type FROM active_memories")


@query("view_current_state", f"""WITH m AS (SELECT topic, count(*) AS memories, max(updated_at) AS u, arg_max(memory_id, {{'u': updated_at, 'm': memory_id}}) AS latest_memory FROM mem WHERE status = 'active' AND is_current GROUP BY topic),
d AS (SELECT topic, count(*) AS n FROM mem WHERE memory_type = 'decision' AND is_current GROUP BY topic) SELECT topic, memories, {S.fmt('u')} AS last_update, latest_memory, coalesce(n, 0) AS open_decisions FROM m LEFT JOIN d USING (topic)""")
def view_current_state(spark, d):
    return A.current_state(B.memories(spark, d), B.memory_decisions(spark, d)).withColumn("last_update", ts("last_update"))


@query("view_memory_hierarchy", "SELECT m.memory_id, topic, m.memory_type, m.resolution AS own_resolution, v.resolution, method, round(ratio, 6) AS ratio FROM mem m LEFT JOIN vers v ON v.memory_id = m.memory_id")
def view_memory_hierarchy(spark, d):
    return A.memory_hierarchy(B.memories(spark, d), versions(spark, d)).withColumn("ratio", F.round("ratio", 6))
