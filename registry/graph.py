from pyspark.sql import functions as F

from engramlake.operators import graph as J
from engramlake.operators import paths as Y
from engramlake.operators import recall as H
from engramlake.operators import temporal as T
from engramlake.session import AS_OF, materialise
from engramlake.sources import bindings as B
from registry import EXTRA_CTES, query
from registry import snippets as S
from registry.lifecycle import NOW
from registry.textfeatures import bigram_sql
from engramlake.functions import lexicons as L

ts = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
r6 = lambda df, *cols: df.withColumns({c: F.round(c, 6) for c in cols})
CUES = {"causes": ["from", "pour", "para"], "elaborates": ["that", "dans", "auch"], "summarizes": ["when", "sich"]}

_marks = "list_filter([" + ", ".join(f"CASE WHEN {S.has_phrase('pad', ws)} THEN '{t}' END" for t, ws in CUES.items()) + "], lambda x: x IS NOT NULL)"
EXTRA_CTES["assoc"] = f"""WITH a AS MATERIALIZED (SELECT memory_id, topic, conv_id, resolution, created_at, {S.padded('content')} AS pad, {S.entities('content')} AS e, list_sort(list_distinct({S.words('content')})) AS s FROM mem),
m AS MATERIALIZED (SELECT *, {_marks} AS k FROM a),
q AS (SELECT x.memory_id AS a, y.memory_id AS b, x.k AS ak, y.k AS bk, x.conv_id = y.conv_id AS same, abs(x.resolution - y.resolution) AS diff,
 CASE WHEN len(x.s) > 0 AND len(y.s) > 0 THEN round(len(list_intersect(x.s, y.s)) / (len(x.s) + len(y.s) - len(list_intersect(x.s, y.s))), 9) ELSE 0.0 END AS o,
 exp(-abs(epoch_us(x.created_at) - epoch_us(y.created_at)) / 86400000000.0 / 2.0) AS t, CASE WHEN len(x.e) > 0 AND len(y.e) > 0 THEN len(list_intersect(x.e, y.e)) / len(list_distinct(list_concat(x.e, y.e))) ELSE 0.0 END AS ej
 FROM m x JOIN m y ON x.topic = y.topic AND x.memory_id < y.memory_id),
j AS (SELECT *, round(o * 0.3 + t * 0.2 + ej * 0.2 + r * 0.3, 9) AS s FROM (SELECT *, CASE WHEN same AND diff BETWEEN 1 AND 2 THEN 0.8 WHEN same AND o > 0.5 THEN 0.6 ELSE 0.0 END AS r FROM q)),
l AS (SELECT a, b, 'related' AS type, s AS strength FROM j WHERE s >= 0.3 UNION ALL SELECT a, b, 'summarizes', r FROM j WHERE r > 0.5
 UNION ALL SELECT a, b, unnest(list_distinct(list_concat(ak, bk))), 0.7 FROM j WHERE s >= 0.3 OR r > 0.5)
SELECT a AS src, b AS dst, type, max(strength) AS strength FROM l GROUP BY a, b, type"""


@query("mine_associations", "SELECT src, dst, type, round(strength, 6) AS strength FROM assoc")
def mine_associations(spark, d):
    return r6(J.mine_associations(B.memories(spark, d), CUES), "strength")


EXTRA_CTES["und0"] = """WITH b AS (SELECT src AS node, dst AS next, type, strength FROM edges WHERE src <> dst UNION ALL SELECT dst, src, type, strength FROM edges WHERE src <> dst)
SELECT node, next, max(strength) AS strength, arg_max(type, {'s': strength, 't': type}) AS type FROM b GROUP BY node, next"""
EXTRA_CTES["und3"] = """WITH b AS (SELECT src AS node, dst AS next, type, strength FROM edges WHERE src <> dst AND round(strength, 9) >= 0.3 UNION ALL SELECT dst, src, type, strength FROM edges WHERE src <> dst AND round(strength, 9) >= 0.3)
SELECT node, next, max(strength) AS strength, arg_max(type, {'s': strength, 't': type}) AS type FROM b GROUP BY node, next"""
EXTRA_CTES["cstep"] = "SELECT node, next, strength FROM und3 WHERE next IN (SELECT memory_id FROM mem WHERE is_current)"


@query("neighbours", "SELECT node, next, type, round(und3.strength, 6) AS strength FROM und3 WHERE node IN (SELECT memory_id FROM mem) AND next IN (SELECT memory_id FROM mem WHERE is_current)")
def neighbours(spark, d):
    m = B.memories(spark, d)
    return r6(J.neighbours(m, B.edges(spark, d), m), "strength")


def bfs_sql(seed, step, depth, max_nodes):
    parts = [f"f0 AS (SELECT DISTINCT set_id, node, 0 AS depth, 1.0 AS strength, [node] AS path FROM ({seed})), v0 AS (SELECT * FROM f0)"]
    for i in range(1, depth + 1):
        parts.append(f"""n{i} AS (SELECT f.set_id, s.next AS node, round(f.strength * s.strength, 9) AS strength, list_append(f.path, s.next) AS path FROM f{i - 1} f JOIN {step} s ON f.node = s.node WHERE NOT EXISTS (SELECT 1 FROM v{i - 1} v WHERE v.set_id = f.set_id AND v.node = s.next)),
b{i} AS (SELECT set_id, node, min({{'s': -strength, 'p': path}}) AS b FROM n{i} GROUP BY set_id, node), f{i} AS (SELECT set_id, node, {i} AS depth, -b.s AS strength, b.p AS path FROM b{i}), v{i} AS (SELECT * FROM v{i - 1} UNION ALL SELECT * FROM f{i})""")
    return "WITH " + ", ".join(parts) + f" SELECT *, round(strength / (1 + depth), 9) AS proximity, row_number() OVER (PARTITION BY set_id ORDER BY depth, strength DESC, node) AS rank FROM v{depth} QUALIFY rank <= {max_nodes}"


EXTRA_CTES["bfs"] = bfs_sql("SELECT memory_id AS set_id, memory_id AS node FROM mem WHERE memory_type = 'current'", "cstep", 2, 64)
_path = "array_to_string(path, '>') AS path"
path_text = lambda df: df.withColumn("path", F.array_join(F.transform("path", lambda x: x.cast("string")), ">"))


def bfs_seeds(spark, d):
    return B.memories(spark, d).filter("memory_type = 'current'").select(F.col("memory_id").alias("set_id"), F.col("memory_id").alias("node"))


@query("traverse", f"SELECT set_id, node, depth, round(strength, 6) AS strength, {_path}, rank, round(proximity, 6) AS proximity FROM bfs")
def traverse(spark, d):
    return r6(path_text(J.traverse_memories(bfs_seeds(spark, d), B.edges(spark, d), B.memories(spark, d))), "strength", "proximity")


@query("associated_memories", "SELECT set_id AS memory_id, node AS associated, round(strength, 6) AS strength FROM bfs WHERE depth > 0")
def associated_memories(spark, d):
    t = J.traverse_memories(bfs_seeds(spark, d), B.edges(spark, d), B.memories(spark, d)).filter("depth > 0")
    return t.select(F.col("set_id").alias("memory_id"), F.col("node").alias("associated"), F.round("strength", 6).alias("strength"))


@query("shortest_paths", """WITH pr AS (SELECT DISTINCT memory_id AS a, memory_id // 7 AS b FROM mem WHERE memory_id <> memory_id // 7), f0 AS (SELECT a, b, a AS node, [a] AS path FROM pr),
f1 AS (SELECT a, b, next AS node, min(list_append(path, next)) AS path FROM f0 JOIN und0 u ON f0.node = u.node WHERE NOT list_contains(path, next) GROUP BY a, b, next),
f2 AS (SELECT a, b, next AS node, min(list_append(path, next)) AS path FROM f1 JOIN und0 u ON f1.node = u.node WHERE f1.node <> b AND NOT list_contains(path, next) GROUP BY a, b, next),
f3 AS (SELECT a, b, next AS node, min(list_append(path, next)) AS path FROM f2 JOIN und0 u ON f2.node = u.node WHERE f2.node <> b AND NOT list_contains(path, next) GROUP BY a, b, next),
h AS (SELECT a, b, 1 AS length, path FROM f1 WHERE node = b UNION ALL SELECT a, b, 2, path FROM f2 WHERE node = b UNION ALL SELECT a, b, 3, path FROM f3 WHERE node = b), m AS (SELECT a, b, min({'l': length, 'p': path}) AS x FROM h GROUP BY a, b)
SELECT a, b, CAST(x.l AS INTEGER) AS length, array_to_string(x.p, '>') AS path FROM m""")
def shortest_paths(spark, d):
    p = B.memories(spark, d).select(F.col("memory_id").alias("a"), F.expr("memory_id div 7").alias("b")).filter("a <> b")
    return path_text(Y.shortest_paths(p, B.edges(spark, d)))


EXTRA_CTES["evedge"] = f"""WITH a AS (SELECT message_id, {S.words('text')} AS ws FROM msg),
t AS (SELECT message_id, 'phrase' AS kind, unnest({bigram_sql('ws')}) AS term FROM a UNION ALL SELECT message_id, 'rare', unnest(list_distinct(list_filter(ws, lambda w: length(w) >= 6 AND w NOT IN ({', '.join(S.q(w) for w in L.PHRASE_STOP_WORDS)})))) FROM a),
g AS (SELECT kind, term FROM t GROUP BY ALL HAVING count(*) BETWEEN 2 AND CASE WHEN kind = 'phrase' THEN 6 ELSE 4 END), k AS (SELECT t.* FROM t JOIN g USING (kind, term)),
e AS (SELECT x.message_id AS src, y.message_id AS dst, x.kind, CASE WHEN x.kind = 'phrase' THEN 25.0 ELSE 10.0 END AS weight FROM k x JOIN k y ON x.kind = y.kind AND x.term = y.term AND x.message_id < y.message_id
 UNION ALL SELECT message_id, n, 'adjacent', 8.0 FROM (SELECT message_id, lead(message_id) OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM msg) WHERE n IS NOT NULL)
SELECT src, dst, kind, sum(weight) AS weight FROM e GROUP BY src, dst, kind"""


@query("evidence_edges", "SELECT * FROM evedge")
def evidence_edges(spark, d):
    return J.evidence_edges(B.messages(spark, d))


EXTRA_CTES["hseed"] = f"""WITH q AS (SELECT query_id, unnest(list_distinct({S.words('text')})) AS t FROM qry), m AS (SELECT message_id, unnest(list_distinct({S.words('text')})) AS t FROM msg), c AS (SELECT query_id, message_id, count(*) AS n FROM q JOIN m USING (t) GROUP BY ALL)
SELECT query_id, message_id AS node FROM c QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n DESC, message_id) <= 2"""


def hop_seeds(spark, d):
    from engramlake.functions.text import word_set
    from engramlake.operators.skew import top_k

    q = B.recall_queries(spark, d).select("query_id", F.explode(word_set(F.col("text"))).alias("t"))
    m = B.messages(spark, d).select("message_id", F.explode(word_set(F.col("text"))).alias("t"))
    c = q.join(m, "t").groupBy("query_id", "message_id").agg(F.count("*").alias("n"))
    return top_k(c, ["query_id"], [F.col("n").desc(), F.col("message_id")], 2).select("query_id", F.col("message_id").alias("node"))


EXTRA_CTES["hboost"] = """WITH b AS (SELECT src AS node, dst AS target, weight FROM evedge UNION ALL SELECT dst, src, weight FROM evedge), c AS (SELECT query_id, target, sum(weight) AS boost FROM hseed JOIN b USING (node) GROUP BY ALL)
SELECT query_id, target, boost, row_number() OVER (PARTITION BY query_id ORDER BY boost DESC, target) AS rank FROM c WHERE (query_id, target) NOT IN (SELECT (query_id, node) FROM hseed) QUALIFY rank <= 10"""


@query("hop_boost", "SELECT query_id, target, boost, rank FROM hboost")
def hop_boost(spark, d):
    return J.hop_boost(hop_seeds(spark, d), J.evidence_edges(B.messages(spark, d)))


EXTRA_CTES["lstep"] = "WITH s AS (SELECT dst AS node, src AS next, strength FROM edges WHERE type IN ('elaborates', 'summarizes', 'supersedes') UNION ALL SELECT src, dst, strength FROM edges WHERE type = 'supersedes') SELECT node, next, max(strength) AS strength FROM s WHERE node <> next GROUP BY node, next"
EXTRA_CTES["lin0"] = bfs_sql("SELECT memory_id AS set_id, memory_id AS node FROM mem", "lstep", 3, 10)
EXTRA_CTES["lin"] = "SELECT set_id AS memory_id, node, depth, resolution, m.conv_id, m.message_id, messages FROM lin0 JOIN mem m ON m.memory_id = node LEFT JOIN (SELECT conv_id, count(*) AS messages FROM msg GROUP BY conv_id) c ON c.conv_id = m.conv_id"


def lin(spark, d):
    m = B.memories(spark, d)
    return J.lineage(m, B.edges(spark, d), m, B.messages(spark, d))


@query("lineage", "SELECT * FROM lin")
def lineage(spark, d):
    return lin(spark, d)


EXTRA_CTES["heads"] = """WITH RECURSIVE nx AS (SELECT dst AS memory_id, max(src) AS head FROM edges WHERE type = 'supersedes' AND src > dst GROUP BY dst),
r AS (SELECT memory_id, head, 1 AS steps FROM nx UNION ALL SELECT r.memory_id, nx.head, steps + 1 FROM r JOIN nx ON r.head = nx.memory_id WHERE steps < 10) SELECT memory_id, arg_max(head, steps) AS successor FROM r GROUP BY memory_id"""


@query("explain_memory", f"""WITH l AS (SELECT memory_id, count(*) AS lineage_nodes, max(depth) AS lineage_depth FROM lin GROUP BY memory_id), c AS (SELECT memory_id, count(*) AS contradictions FROM (SELECT src AS memory_id FROM edges WHERE type = 'contradicts' UNION ALL SELECT dst FROM edges WHERE type = 'contradicts') GROUP BY memory_id),
e AS (SELECT memory_id, count(*) AS events, max(created_at) AS last_event FROM cev GROUP BY memory_id)
SELECT m.memory_id, status, valid_from <= {NOW} AND (valid_until IS NULL OR {NOW} < valid_until) AS valid, coalesce(lineage_nodes, 0) AS lineage_nodes, coalesce(lineage_depth, 0) AS lineage_depth, successor, coalesce(contradictions, 0) AS contradictions, coalesce(events, 0) AS events, {S.fmt('last_event')} AS last_event
FROM mem m LEFT JOIN l USING (memory_id) LEFT JOIN heads USING (memory_id) LEFT JOIN c USING (memory_id) LEFT JOIN e USING (memory_id)""")
def explain_memory(spark, d):
    e = B.edges(spark, d)
    return J.explain_memory(B.memories(spark, d), lin(spark, d), e, T.supersession_heads(e), B.compression_events(spark, d), AS_OF).withColumn("last_event", ts("last_event"))


_dt = ", ".join(S.q(t) for t in J.DEPENDENCY_TYPES)


def _lev(i):
    return f"l{i} AS (SELECT root, dependent AS node, max(round(impact * s * 0.8, 9)) AS impact FROM l{i - 1} JOIN de ON l{i - 1}.node = de.node WHERE round(impact * s * 0.8, 9) > 0.1 AND dependent <> root GROUP BY root, dependent)"


EXTRA_CTES["deps"] = f"""WITH de AS (SELECT dst AS node, src AS dependent, max(strength) AS s FROM edges WHERE type IN ({_dt}) AND src <> dst GROUP BY dst, src), l0 AS (SELECT memory_id AS root, memory_id AS node, 1.0 AS impact FROM mem), {_lev(1)}, {_lev(2)}, {_lev(3)}
SELECT root, node, max(impact) AS impact FROM (SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3) GROUP BY root, node"""


def deps(spark, d):
    return J.dependents(B.memories(spark, d), B.edges(spark, d))


@query("dependents", "SELECT root, node, round(impact, 6) AS impact FROM deps")
def dependents(spark, d):
    return r6(deps(spark, d), "impact")


@query("impact_prediction", """WITH a AS (SELECT root AS memory_id, count(*) AS affected, count(*) FILTER (impact > 0.5) AS high FROM deps GROUP BY root), b AS (SELECT memory_id, count(*) AS beliefs FROM bev WHERE polarity = 'supporting' GROUP BY memory_id),
j AS (SELECT memory_id, coalesce(affected, 0) AS affected, coalesce(beliefs, 0) AS beliefs, least(1.0, coalesce(high, 0) * 0.2 + coalesce(affected, 0) * 0.05) AS base FROM mem LEFT JOIN a USING (memory_id) LEFT JOIN b USING (memory_id)),
r AS (SELECT memory_id, affected, beliefs, op, CASE WHEN op = 'delete' THEN 1.0 ELSE round(base * f, 9) END AS risk FROM j, (VALUES ('modify', 1.0), ('supersede', 0.5), ('archive', 0.7), ('delete', 1.0)) v(op, f))
SELECT memory_id, affected, beliefs, op, round(risk, 6) AS cascade_risk, CASE WHEN op = 'delete' THEN 'supersede or archive instead' WHEN risk > 0.7 THEN 'create a new version' WHEN risk > 0.4 THEN 'review dependents' ELSE 'safe' END AS recommendation, CASE WHEN risk > 0.5 THEN 'supersede' ELSE 'modify_in_place' END AS strategy FROM r""")
def impact_prediction(spark, d):
    from registry.beliefs import beliefs

    return r6(J.impact(B.memories(spark, d), deps(spark, d), beliefs(spark, d)[1]), "cascade_risk")


@query("dependency_cycles", """WITH e AS (SELECT DISTINCT src, dst FROM edges WHERE src <> dst), p2 AS (SELECT src AS start, dst AS fin, [src, dst] AS path FROM e WHERE src < dst),
p3 AS (SELECT start, dst AS fin, list_append(path, dst) AS path FROM p2 JOIN e ON fin = src WHERE dst > start AND NOT list_contains(path, dst)), p4 AS (SELECT start, dst AS fin, list_append(path, dst) AS path FROM p3 JOIN e ON fin = src WHERE dst > start AND NOT list_contains(path, dst)),
p5 AS (SELECT start, dst AS fin, list_append(path, dst) AS path FROM p4 JOIN e ON fin = src WHERE dst > start AND NOT list_contains(path, dst)), c AS (SELECT * FROM p2 UNION ALL SELECT * FROM p3 UNION ALL SELECT * FROM p4 UNION ALL SELECT * FROM p5)
SELECT array_to_string(path, '>') AS path, CAST(len(path) AS BIGINT) AS length, CASE WHEN len(path) <= 2 THEN 'high' WHEN len(path) <= 4 THEN 'medium' ELSE 'low' END AS severity FROM c JOIN e ON fin = src AND dst = start""")
def dependency_cycles(spark, d):
    return path_text(Y.cycles(B.edges(spark, d)))


@query("single_supports", f"WITH o AS (SELECT src, count(DISTINCT dst) AS n, min(dst) AS support FROM edges WHERE type IN ({_dt}) GROUP BY src HAVING count(DISTINCT dst) = 1) SELECT support, count(*) AS sole_dependents, min(src) AS first_dependent FROM o GROUP BY support")
def single_supports(spark, d):
    return J.single_supports(B.edges(spark, d))


@query("propagate_invalidation", "SELECT root AS invalidated_by, node AS memory_id, round(deps.impact, 6) AS impact FROM deps WHERE deps.impact > 0.3 AND node IN (SELECT memory_id FROM mem)")
def propagate_invalidation(spark, d):
    return r6(J.propagate_invalidation(deps(spark, d), B.memories(spark, d)), "impact")


@query("graph_stats", "WITH g AS (SELECT node, count(*) AS n FROM (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges) GROUP BY node) SELECT count(*) AS nodes, CAST(sum(n) / 2 AS BIGINT) AS edges, round(avg(n), 6) AS avg_degree, max(n) AS max_degree FROM g")
def graph_stats(spark, d):
    return r6(J.graph_stats(B.edges(spark, d)), "avg_degree")
