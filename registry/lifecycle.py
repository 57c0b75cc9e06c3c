from pyspark.sql import functions as F

from engramlake.operators import lifecycle as K
from engramlake.session import AS_OF
from engramlake.sources import bindings as B
from registry import EXTRA_CTES, query
from registry import snippets as S
from registry.compression import versions
from registry.recall import rsel

ts = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
r6 = lambda df, *cols: df.withColumns({c: F.round(c, 6) for c in cols})
NOW = f"TIMESTAMP '{AS_OF}'"
AGE = S.whole_days(NOW, "created_at")
USE = "coalesce(last_accessed, created_at)"
IDLE = S.whole_days(NOW, USE)
IMP = "round(importance, 9)"

EXTRA_CTES["tstat"] = f"""SELECT *, CASE WHEN {IMP} >= 0.7 AND {IDLE} <= 7 THEN 'active' WHEN {IMP} >= 0.7 THEN 'dormant' WHEN {IMP} <= 0.3 AND {AGE} > 365 THEN 'deep_archived' WHEN {IMP} <= 0.3 AND {AGE} > 90 THEN 'archived'
 WHEN {AGE} > 365 THEN 'deep_archived' WHEN {AGE} > 90 THEN 'archived' WHEN {AGE} > 30 THEN 'compressed' WHEN {AGE} > 7 THEN 'dormant' ELSE 'active' END AS target_status FROM mem"""
EXTRA_CTES["cons"] = """SELECT *, CAST(CASE WHEN target_status = 'dormant' AND resolution = 0 THEN 1 WHEN target_status = 'compressed' AND resolution <= 2 THEN resolution + 1 WHEN target_status = 'archived' AND resolution <= 2 THEN 3
 WHEN target_status = 'archived' AND resolution = 3 THEN 4 WHEN target_status = 'deep_archived' THEN 5 ELSE resolution END AS INTEGER) AS target_resolution FROM tstat"""


@query("target_status", "SELECT memory_id, target_status FROM tstat")
def target_status(spark, d):
    return K.target_status(B.memories(spark, d), AS_OF).select("memory_id", "target_status")


@query("consolidate", "SELECT memory_id, target_status, target_resolution, target_resolution > resolution AS compress FROM cons")
def consolidate(spark, d):
    return K.consolidate(B.memories(spark, d), AS_OF).select("memory_id", "target_status", "target_resolution", "compress")


@query("consolidation_stats", "SELECT topic, count(*) AS memories, count(*) FILTER (status <> target_status) AS status_changes, count(*) FILTER (target_resolution > resolution) AS compressions FROM cons GROUP BY topic")
def consolidation_stats(spark, d):
    return K.consolidation_stats(K.consolidate(B.memories(spark, d), AS_OF))


@query("consolidated_versions", """SELECT c.memory_id, c.target_resolution, v.method, v.compressed_tokens FROM cons c JOIN vers v ON v.memory_id = c.memory_id AND v.resolution = c.target_resolution WHERE c.target_resolution > c.resolution""")
def consolidated_versions(spark, d):
    c = K.consolidate(B.memories(spark, d), AS_OF).filter("compress").select("memory_id", "target_resolution")
    v = versions(spark, d).select("memory_id", F.col("resolution").alias("target_resolution"), "method", "compressed_tokens")
    return c.join(v, ["memory_id", "target_resolution"])


_to = S.lst(list(K.ALLOWED))
_ok = " OR ".join(f"(status = '{k}' AND to_status IN ({', '.join(S.q(x) for x in v)}))" for k, v in K.ALLOWED.items())


@query("apply_transitions", f"""WITH a AS (SELECT memory_id, status, {_to}[1 + (memory_id * 3) % 5] AS to_status FROM mem), b AS (SELECT *, ({_ok}) AS accepted FROM a)
SELECT memory_id, status, to_status, accepted, CASE WHEN accepted THEN to_status ELSE status END AS new_status, CASE WHEN accepted THEN to_status ELSE status END IN ('active', 'dormant') AS new_is_current FROM b""")
def apply_transitions(spark, d):
    from engramlake.functions.text import pick

    m = B.memories(spark, d)
    return K.apply_transitions(m, m.select("memory_id", pick(list(K.ALLOWED), F.col("memory_id") * 3 % 5).alias("to_status")))


EXTRA_CTES["sv"] = f"""WITH r AS (SELECT src AS memory_id, max(strength) AS r FROM edges WHERE type = 'contradicts' GROUP BY src),
a AS (SELECT m.*, greatest(0.0, least(1.0, coalesce(r, 0.0))) AS contradiction_risk, pow(0.5, greatest(0.0, {S.frac_days(NOW, USE)}) / 30.0) AS recency, access_count / (access_count + 10.0) AS usage,
 CASE WHEN valid_from <= {NOW} AND (valid_until IS NULL OR {NOW} < valid_until) THEN 1.0 ELSE 0.0 END AS temporal, 1.0 - resolution / 5 AS detail FROM mem m LEFT JOIN r USING (memory_id)),
b AS (SELECT *, least(1.0, 0.4 * temporal + 0.35 * recency + 0.25 * (1.0 - contradiction_risk)) AS currentness FROM a)
SELECT *, round(least(1.0, 0.35 * importance + 0.25 * confidence + 0.2 * usage + 0.1 * detail + 0.1 * currentness), 9) AS future_utility FROM b"""


def sv(spark, d):
    return K.state_vector(B.memories(spark, d), B.edges(spark, d), AS_OF)


@query("state_vector", "SELECT memory_id, round(contradiction_risk, 6) AS contradiction_risk, round(recency, 6) AS recency, round(usage, 6) AS usage, temporal, round(currentness, 6) AS currentness, round(future_utility, 6) AS future_utility FROM sv")
def state_vector(spark, d):
    return r6(sv(spark, d).select("memory_id", "contradiction_risk", "recency", "usage", "temporal", "currentness", "future_utility"), "contradiction_risk", "recency", "usage", "currentness", "future_utility")


@query("rank_by_utility", "SELECT topic, memory_id, round(future_utility, 6) AS future_utility, row_number() OVER (PARTITION BY topic ORDER BY future_utility DESC, memory_id) AS rank FROM sv QUALIFY rank <= 10")
def rank_by_utility(spark, d):
    return r6(K.rank_by_utility(sv(spark, d), 10), "future_utility")


EXTRA_CTES["stale"] = f"""WITH w AS (SELECT memory_id, topic, memory_type, created_at, list_distinct({S.space_words('content')}) AS s FROM mem),
sup AS (SELECT DISTINCT a.memory_id FROM w a JOIN w b ON a.topic = b.topic AND a.memory_type = b.memory_type AND b.created_at > a.created_at AND len(a.s) > 0 WHERE len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))) > 0.5),
con AS (SELECT memory_id, count(*) AS c FROM (SELECT src AS memory_id FROM edges WHERE type = 'contradicts' UNION ALL SELECT dst FROM edges WHERE type = 'contradicts') GROUP BY memory_id),
a AS (SELECT m.memory_id, topic, round(CASE WHEN valid_until < {NOW} THEN least(1.0, {S.whole_days(NOW, 'valid_until')} / 30) ELSE 0.0 END, 9) AS time_expired,
 round(CASE WHEN {IDLE} > 90 THEN least(1.0, {IDLE} / 180) ELSE 0.0 END, 9) AS no_recent_access, CASE WHEN access_count < 1 THEN 0.5 ELSE 0.0 END AS orphaned,
 round(CASE WHEN round(confidence, 9) < 0.6 THEN (0.6 - confidence) / 0.6 ELSE 0.0 END, 9) AS low_confidence, CASE WHEN sup.memory_id IS NOT NULL THEN 0.8 ELSE 0.0 END AS superseded,
 round(CASE WHEN c > 0 THEN least(1.0, c * 0.3) ELSE 0.0 END, 9) AS contradicted, CASE WHEN {S.contains_any('lower(content)', ['whst', 'keiteinheit'])} THEN 0.4 ELSE 0.0 END AS temporal_drift
 FROM mem m LEFT JOIN sup USING (memory_id) LEFT JOIN con USING (memory_id)),
b AS (SELECT *, round(1.0 - (1.0 - time_expired) * (1.0 - no_recent_access) * (1.0 - orphaned) * (1.0 - low_confidence) * (1.0 - superseded) * (1.0 - contradicted) * (1.0 - temporal_drift), 9) AS staleness FROM a)
SELECT *, CASE WHEN staleness >= 0.8 THEN 'archive_or_delete' WHEN staleness >= 0.6 THEN 'review_and_update' WHEN staleness >= 0.4 THEN 'monitor' ELSE 'keep' END AS action FROM b"""


def stale(spark, d):
    return K.staleness(B.memories(spark, d), B.edges(spark, d), AS_OF, confidence_floor=0.6, drift_words=["whst", "keiteinheit"])


@query("staleness", "SELECT memory_id, topic, " + ", ".join(f"round({s}, 6) AS {s}" for s in K.SIGNALS) + ", round(staleness, 6) AS staleness, action FROM stale")
def staleness(spark, d):
    return r6(stale(spark, d), *K.SIGNALS, "staleness")


@query("stale_summary", "SELECT topic, action, count(*) AS memories, " + ", ".join(f"count(*) FILTER ({s} > 0) AS {s}" for s in K.SIGNALS) + " FROM stale GROUP BY topic, action")
def stale_summary(spark, d):
    return K.stale_summary(stale(spark, d))


EXTRA_CTES["integ"] = f"""WITH v0 AS (SELECT memory_id, ratio, list_distinct({S.space_words('original')}) AS a, list_distinct({S.space_words('content')}) AS b FROM vers),
v AS (SELECT memory_id, avg(CASE WHEN len(a) + len(b) > 0 THEN len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) ELSE 0.0 END) AS j, avg(CASE WHEN ratio BETWEEN 1.5 AND 10 THEN 1.0 WHEN ratio < 1.5 THEN 0.7 WHEN ratio > 20 THEN 0.5 ELSE 0.8 END) AS q FROM v0 GROUP BY memory_id),
con AS (SELECT memory_id, count(*) AS c FROM (SELECT src AS memory_id FROM edges WHERE type = 'contradicts' UNION ALL SELECT dst FROM edges WHERE type = 'contradicts') GROUP BY memory_id),
a AS (SELECT m.memory_id, round(CASE WHEN resolution = 0 THEN 1.0 ELSE coalesce(j, 0.5) END, 9) AS semantic_drift,
 round(greatest(0.0, 1.0 - CASE WHEN valid_from > valid_until THEN 0.3 ELSE 0.0 END - CASE WHEN is_current AND valid_until < {NOW} THEN 0.4 ELSE 0.0 END - CASE WHEN valid_from < m.created_at THEN 0.2 ELSE 0.0 END), 9) AS temporal_inconsistency,
 round(greatest(0.0, 1.0 - CASE WHEN cv.conv_id IS NULL THEN 0.5 ELSE 0.0 END - CASE WHEN m.message_id IS NULL THEN 0.2 WHEN ms.message_id IS NULL THEN 0.4 ELSE 0.0 END), 9) AS provenance_broken,
 round(coalesce(q, 0.5), 9) AS compression_artifact, CASE WHEN coalesce(c, 0) = 0 THEN 1.0 WHEN c <= 2 THEN 0.8 WHEN c <= 5 THEN 0.6 ELSE 0.3 END AS contradiction
 FROM mem m LEFT JOIN v USING (memory_id) LEFT JOIN (SELECT DISTINCT conv_id FROM msg) cv ON m.conv_id = cv.conv_id LEFT JOIN msg ms ON ms.message_id = m.message_id AND ms.conv_id = m.conv_id LEFT JOIN con ON con.memory_id = m.memory_id)
SELECT *, round(0.3 * semantic_drift + 0.15 * temporal_inconsistency + 0.2 * provenance_broken + 0.15 * compression_artifact + 0.2 * contradiction, 9) AS overall FROM a"""
EXTRA_CTES["issues"] = "WITH u AS (" + " UNION ALL ".join(f"SELECT memory_id, '{k}' AS issue, {k} AS score FROM integ" for k in K.INTEGRITY_WEIGHTS) + ") SELECT *, CASE WHEN score < 0.3 THEN 'critical' ELSE 'warning' END AS severity FROM u WHERE score < 0.7"


def integ(spark, d):
    return K.integrity(B.memories(spark, d), versions(spark, d), B.messages(spark, d), B.edges(spark, d), AS_OF)


@query("integrity", "SELECT memory_id, " + ", ".join(f"round({k}, 6) AS {k}" for k in K.INTEGRITY_WEIGHTS) + ", round(overall, 6) AS overall FROM integ")
def integrity(spark, d):
    return r6(integ(spark, d), *K.INTEGRITY_WEIGHTS, "overall")


@query("integrity_issues", "SELECT memory_id, issue, round(score, 6) AS score, severity FROM issues")
def integrity_issues(spark, d):
    return r6(K.integrity_issues(integ(spark, d)), "score")


_act = " ".join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in K.HEALING.items())
_pri = " ".join(f"WHEN '{k}' THEN CASE WHEN severity = 'critical' THEN {v[1]} ELSE {v[2]} END" for k, v in K.HEALING.items())


@query("healing_plan", f"""WITH a AS (SELECT memory_id, issue, severity, CASE issue {_act} END AS action, CAST(CASE issue {_pri} END AS INTEGER) AS priority FROM issues)
SELECT *, row_number() OVER (PARTITION BY memory_id ORDER BY priority DESC, issue) AS step FROM a""")
def healing_plan(spark, d):
    return K.healing_plan(K.integrity_issues(integ(spark, d)))


@query("repair_provenance", f"""WITH m AS (SELECT turn AS memory_id, list_distinct({S.space_words('content')}) AS s FROM cands WHERE memory_type = 'semantic'), n0 AS (SELECT min(message_id) AS message_id, list_sort(list_distinct({S.space_words('text')})) AS s FROM notes GROUP BY 2),
ms AS (SELECT DISTINCT list_sort(s) AS s FROM m), c AS (SELECT ms.s, n0.message_id, round(len(list_intersect(ms.s, n0.s)) / len(list_distinct(list_concat(ms.s, n0.s))), 9) AS score FROM ms JOIN n0 ON len(n0.s) > 0.8 * len(ms.s) AND len(ms.s) > 0.8 * len(n0.s)),
b AS (SELECT * FROM c WHERE score > 0.8 QUALIFY row_number() OVER (PARTITION BY s ORDER BY score DESC, message_id) = 1)
SELECT memory_id, message_id AS repaired_message_id, round(score, 6) AS score FROM m JOIN b ON list_sort(m.s) = b.s""")
def repair_provenance(spark, d):
    from engramlake.operators.compilation import memory_candidates

    n = B.notes(spark, d)
    m = memory_candidates(n).filter("memory_type = 'semantic'").select(F.col("turn").alias("memory_id"), "content", F.lit(None).cast("long").alias("message_id"))
    return r6(K.repair_provenance(m, n), "score")


@query("restore_version", """SELECT m.memory_id, CAST(m.memory_id % 4 AS INTEGER) AS target, min(v.resolution) AS restored_resolution, arg_min(v.compressed_tokens, v.resolution) AS tokens
FROM mem m JOIN vers v ON v.memory_id = m.memory_id AND v.resolution >= m.memory_id % 4 GROUP BY m.memory_id""")
def restore_version(spark, d):
    return K.restore(B.memories(spark, d), versions(spark, d), F.col("memory_id") % 4)


def _groups(spark, d):
    return B.memories(spark, d).select("memory_id", F.concat("topic", F.lit("/"), "memory_type").alias("group_id"))


_mg = "SELECT topic || '/' || memory_type AS group_id, max(importance) AS importance, avg(confidence) AS confidence, count(*) AS members, arg_max(memory_id, {'c': updated_at, 'm': memory_id}) AS latest_id FROM mem GROUP BY 1"


@query("merge_groups_latest", f"WITH g AS ({_mg}) SELECT group_id, round(g.importance, 6) AS importance, round(g.confidence, 6) AS confidence, members, latest_id, content FROM g JOIN mem ON memory_id = latest_id")
def merge_groups_latest(spark, d):
    return r6(K.merge_groups(B.memories(spark, d), _groups(spark, d)).select("group_id", "importance", "confidence", "members", "latest_id", "content"), "importance", "confidence")


@query("merge_groups_combine", """WITH r AS (SELECT topic || '/' || memory_type AS group_id, memory_id, content, row_number() OVER (PARTITION BY topic, memory_type ORDER BY created_at, memory_id) AS place FROM mem)
SELECT group_id, place, memory_id, '=== Memory ' || place || ' (ID: ' || memory_id || ') ===' || chr(10) || content AS part FROM r""")
def merge_groups_combine(spark, d):
    return K.combine_groups(B.memories(spark, d), _groups(spark, d))


@query("merge_effects", "SELECT memory_id, 'archived' AS status, topic || '/' || memory_type AS merged_into, 'elaborates' AS edge_type, 0.8 AS strength FROM mem")
def merge_effects(spark, d):
    g = _groups(spark, d)
    return K.merge_effects(g, K.merge_groups(B.memories(spark, d), g))


@query("split_memories", f"""WITH a AS (SELECT memory_id, list_filter(list_transform(string_split_regex(content, '\\n(?:[A-Z][a-z]+ )'), lambda p: {S.strip('p')}), lambda p: p <> '') AS ps FROM mem),
b AS (SELECT memory_id, unnest(list_transform(ps, lambda p, i: {{'p': p, 'i': i - 1}})) AS u FROM a) SELECT memory_id, CAST(u.i AS BIGINT) AS part, u.p AS content FROM b""")
def split_memories(spark, d):
    return K.split_memories(B.memories(spark, d), r"\n(?:[A-Z][a-z]+ )")


_ops = ["revise", "reinforce", "reinterpret", "keep", "reject"]
_delta = f"SELECT memory_id, {S.lst(_ops)}[1 + memory_id % 5] AS op, 'revised ' || topic AS new_text FROM mem"
EXTRA_CTES["evo"] = f"""WITH d AS ({_delta}) SELECT memory_id, op, CASE WHEN op IN ('revise', 'reinterpret') THEN new_text ELSE content END AS content,
 round(CASE op WHEN 'reinforce' THEN least(1.0, confidence + 0.1) WHEN 'reject' THEN confidence * 0.5 ELSE confidence END, 9) AS confidence, CASE WHEN op = 'reject' THEN 'archived' ELSE status END AS status,
 CASE WHEN op = 'reinforce' THEN access_count + 1 ELSE access_count END AS access_count, CASE WHEN op = 'keep' THEN updated_at ELSE {NOW} END AS updated_at FROM mem JOIN d USING (memory_id)"""


def _evo(spark, d):
    from engramlake.functions.text import pick

    m = B.memories(spark, d)
    return K.apply_evolution(m, m.select("memory_id", pick(_ops, F.col("memory_id") % 5).alias("op"), F.concat(F.lit("revised "), "topic").alias("new_text")), AS_OF)


@query("apply_evolution", f"SELECT memory_id, op, content, round(confidence, 6) AS confidence, status, access_count, {S.fmt('updated_at')} AS updated_at FROM evo")
def apply_evolution(spark, d):
    return r6(_evo(spark, d).withColumn("updated_at", ts("updated_at")), "confidence")


@query("evolution_events", f"SELECT memory_id, op AS event, {S.fmt('updated_at')} AS created_at FROM evo WHERE op <> 'keep'")
def evolution_events(spark, d):
    return K.evolution_events(_evo(spark, d)).withColumn("created_at", ts("created_at"))


_pops = K.DISPATCHABLE + ["compress"]


@query("validate_proposals", f"""WITH p AS (SELECT event_id AS proposal_id, event_id % 1200 AS memory_id, {S.lst(_pops)}[1 + event_id % 14] AS op, value / 100 AS confidence, CASE WHEN event_id % 3 = 0 THEN '' ELSE 'seen' END AS evidence,
 CASE WHEN event_id % 11 = 0 THEN ' ' ELSE 'because' END AS reason, CASE WHEN event_id % 2 = 0 THEN 'archived' ELSE 'lost' END AS to_status, CASE WHEN event_id % 5 <> 0 THEN event_id % 1100 END AS other_id, ts AS created_at FROM events),
e AS (SELECT doc_id AS memory_id, max(TIMESTAMP '2024-01-10' + to_hours(CAST(doc_id AS BIGINT))) AS last FROM labels GROUP BY doc_id),
j AS (SELECT p.*, m.status AS ms, e.last, o.memory_id AS om FROM p LEFT JOIN mem m ON m.memory_id = p.memory_id LEFT JOIN e ON e.memory_id = p.memory_id LEFT JOIN mem o ON o.memory_id = p.other_id),
r AS (SELECT proposal_id, memory_id, op, list_filter([CASE WHEN op NOT IN ({', '.join(S.q(x) for x in K.DISPATCHABLE)}) THEN 'not dispatchable' END, CASE WHEN ms IS NULL THEN 'target missing' END, CASE WHEN NOT round(confidence, 9) BETWEEN 0 AND 1 THEN 'confidence out of range' END,
 CASE WHEN trim(reason) = '' THEN 'reason missing' END, CASE WHEN ms IS NOT NULL AND round(confidence, 9) < CASE WHEN op IN ({', '.join(S.q(x) for x in K.DESTRUCTIVE)}) THEN 0.6 ELSE 0.4 END THEN 'confidence too low' END,
 CASE WHEN ms IS NOT NULL AND op IN ({', '.join(S.q(x) for x in K.NEEDS_EVIDENCE)}) AND evidence = '' THEN 'evidence missing' END, CASE WHEN ms IS NOT NULL AND op = 'contradict' AND (other_id IS NULL OR other_id = memory_id OR om IS NULL) THEN 'other memory invalid' END,
 CASE WHEN ms IS NOT NULL AND op = 'transition' AND to_status NOT IN ({', '.join(S.q(x) for x in K.ALLOWED)}) THEN 'status invalid' END, CASE WHEN ms IN ('archived', 'deep_archived') AND op NOT IN ({', '.join(S.q(x) for x in K.ARCHIVE_SAFE)}) THEN 'archived target' END,
 CASE WHEN ms IS NOT NULL AND (epoch_us(created_at) - epoch_us(last)) / 1000000.0 < 3600 THEN 'cooldown' END], lambda x: x IS NOT NULL) AS rs FROM j)
SELECT proposal_id, memory_id, op, CASE WHEN len(rs) = 0 THEN 'approve' ELSE 'reject' END AS verdict, array_to_string(rs, '; ') AS reasons FROM r""")
def validate_proposals(spark, d):
    from engramlake.functions.text import pick

    i = F.col("event_id")
    p = B.table(spark, d, "events").select(
        i.alias("proposal_id"), (i % 1200).alias("memory_id"), pick(_pops, i % 14).alias("op"), (F.col("value") / 100).alias("confidence"), F.when(i % 3 == 0, "").otherwise("seen").alias("evidence"),
        F.when(i % 11 == 0, " ").otherwise("because").alias("reason"), F.when(i % 2 == 0, "archived").otherwise("lost").alias("to_status"), F.when(i % 5 != 0, i % 1100).alias("other_id"), F.col("ts").cast("timestamp").alias("created_at"))
    ev = B.table(spark, d, "labels").select(F.col("doc_id").alias("memory_id"), F.expr("timestampadd(HOUR, cast(doc_id as int), timestamp'2024-01-10')").alias("created_at"))
    return K.validate_proposals(p, B.memories(spark, d), ev)


EXTRA_CTES["ndup"] = f"""WITH a AS MATERIALIZED (SELECT memory_id, list_sort(list_distinct({S.search_tokens('content')})) AS s FROM mem), u AS MATERIALIZED (SELECT s, min(memory_id) AS k, count(*) AS copies FROM a WHERE len(s) > 0 GROUP BY s),
t AS MATERIALIZED (SELECT k, len(s) AS n, unnest(s) AS tok FROM u), p AS (SELECT x.k AS xk, y.k AS yk, count(*) / least(any_value(x.n), any_value(y.n)) AS c FROM t x JOIN t y ON x.tok = y.tok AND x.k <> y.k GROUP BY x.k, y.k),
g AS (SELECT xk AS k, count(*) AS near_sets, min(yk) AS near_key FROM p WHERE round(c, 9) >= 0.75 GROUP BY xk)
SELECT memory_id, u.k AS first_key, copies, coalesce(near_sets, 0) AS near_sets, near_key FROM a JOIN u ON a.s = u.s LEFT JOIN g ON g.k = u.k WHERE copies > 1 OR near_sets IS NOT NULL"""


@query("near_duplicates", "SELECT * FROM ndup")
def near_duplicates(spark, d):
    return K.near_duplicates(B.memories(spark, d))


@query("reflection_findings", f"""WITH s AS (SELECT *, round(0.3 * usage + 0.25 * importance + 0.25 * (1 - currentness) + 0.2 * (1 - future_utility), 9) AS priority FROM sv WHERE is_current AND status IN ('active', 'dormant')),
top AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY priority DESC, memory_id) AS rank FROM s QUALIFY rank <= 25), a AS MATERIALIZED (SELECT memory_id, list_sort(list_distinct({S.search_tokens('content')})) AS s FROM top),
tk AS MATERIALIZED (SELECT memory_id, len(s) AS n, unnest(s) AS tok FROM a), dup AS (SELECT DISTINCT x.memory_id FROM tk x JOIN tk y ON x.tok = y.tok AND x.memory_id <> y.memory_id GROUP BY x.memory_id, y.memory_id HAVING round(count(*) / least(any_value(x.n), any_value(y.n)), 9) >= 0.75),
rel AS (SELECT memory_id, count(*) AS r FROM (SELECT src AS memory_id FROM edges WHERE strength >= 0.4 UNION ALL SELECT dst FROM edges WHERE strength >= 0.4) GROUP BY memory_id)
SELECT top.memory_id, topic, rank, round(priority, 6) AS priority, CASE WHEN dup.memory_id IS NOT NULL THEN 'merge' WHEN future_utility <= 0.45 AND {S.frac_days(NOW, 'created_at')} >= 90 AND round(confidence, 9) <= 0.6 THEN 'archive'
 WHEN access_count >= 5 AND {IMP} >= 0.6 THEN 'reinforce' WHEN {IMP} >= 0.7 AND access_count <= 1 AND {S.frac_days(NOW, 'created_at')} >= 30 THEN 'keep' WHEN coalesce(r, 0) >= 3 THEN 'reinterpret' END AS finding
FROM top LEFT JOIN dup ON dup.memory_id = top.memory_id LEFT JOIN rel ON rel.memory_id = top.memory_id""")
def reflection_findings(spark, d):
    return r6(K.reflect(B.memories(spark, d), B.edges(spark, d), AS_OF), "priority")


EXTRA_CTES["mconf"] = f"""SELECT *, round(greatest(0.0, least(1.0, confidence * CASE status {' '.join(f"WHEN '{k}' THEN {v}" for k, v in K.STATUS_CONFIDENCE.items())} END * [1.0, 0.95, 0.9, 0.85, 0.75, 0.65][resolution + 1]
 * greatest(0.5, 1.0 - {AGE} / 365 * 0.3) * least(1.0, 1.0 + access_count * 0.02))), 9) AS memory_confidence FROM mem"""


@query("memory_confidence", "SELECT memory_id, round(memory_confidence, 6) AS memory_confidence FROM mconf")
def memory_confidence(spark, d):
    return r6(K.memory_confidence(B.memories(spark, d), AS_OF).select("memory_id", "memory_confidence"), "memory_confidence")


@query("result_confidence", f"""WITH g AS (SELECT query_id, count(*) AS n, avg(memory_confidence) AS mc, avg(CASE WHEN c.valid_from <= {NOW} AND (c.valid_until IS NULL OR {NOW} < c.valid_until) THEN 1 ELSE 0 END) AS tc, avg(CASE WHEN c.conv_id IS NOT NULL THEN 1 ELSE 0 END) AS sc FROM rsel r JOIN mconf c USING (memory_id) GROUP BY query_id),
o AS (SELECT *, round(0.4 * mc + 0.3 * least(1.0, mc * 1.0 * least(1.0, n / 5.0)) + 0.15 * tc + 0.15 * sc, 9) AS overall FROM g)
SELECT query_id, n AS memories, round(overall, 6) AS overall, CASE WHEN overall >= 0.95 THEN 'certain' WHEN overall >= 0.75 THEN 'confident' WHEN overall >= 0.5 THEN 'uncertain' ELSE 'vague' END AS level FROM o""")
def result_confidence(spark, d):
    return r6(K.result_confidence(rsel(spark, d), B.memories(spark, d), 0, AS_OF), "overall")


@query("influence", f"""WITH a AS (SELECT query_id, memory_id, m.importance, m.resolution, CAST(len({S.space_words('m.content')}) AS BIGINT) AS own FROM rsel r JOIN mem m USING (memory_id))
SELECT query_id, memory_id, CAST(sum(own) OVER (PARTITION BY query_id) AS BIGINT) AS total, CAST(sum(own) OVER (PARTITION BY query_id) AS BIGINT) - own AS without, round(least(1.0, least(1.0, own / 100) * importance * (1.0 + resolution / 5 * 0.5)), 6) AS influence FROM a""")
def influence(spark, d):
    return r6(K.influence(rsel(spark, d), B.memories(spark, d)), "influence")
