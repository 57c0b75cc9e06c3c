from pyspark.sql import functions as F

from engramlake.operators import beliefs as K
from engramlake.session import AS_OF
from engramlake.sources import bindings as B
from registry import EXTRA_CTES, query
from registry import snippets as S

ts = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
TIMES = ["2023-07-01 00:00:00", "2024-03-01 00:00:00", "2024-12-01 00:00:00"]
PATTERNS = K.NEGATION_PATTERNS + [(["will"], ["will not"])]
NOW = f"TIMESTAMP '{AS_OF}'"


def statements(spark, d):
    m = B.memories(spark, d)
    return m.select(
        "memory_id", "topic", F.concat(F.lit("  "), F.upper("topic"), F.lit(" holds "), "memory_type", F.lit(" as decided; it is true ")).alias("proposition"),
        F.when(F.col("memory_id") % 7 == 3, "contradicting").otherwise("supporting").alias("polarity"), "created_at",
        F.when(F.col("memory_type") == "timeline", F.lit("2024-06-01").cast("timestamp")).alias("valid_until"))


EXTRA_CTES["stm"] = """SELECT memory_id, topic, '  ' || upper(topic) || ' holds ' || memory_type || ' as decided; it is true ' AS proposition,
 CASE WHEN memory_id % 7 = 3 THEN 'contradicting' ELSE 'supporting' END AS polarity, created_at, CASE WHEN memory_type = 'timeline' THEN TIMESTAMP '2024-06-01' END AS valid_until FROM mem"""
EXTRA_CTES["bev"] = "SELECT DISTINCT left(sha256(trim(lower(proposition))), 16) AS belief_key, memory_id, polarity FROM stm"
EXTRA_CTES["bel"] = """SELECT left(sha256(trim(lower(proposition))), 16) AS belief_key, arg_min(proposition, memory_id) AS proposition, any_value(topic) AS topic,
 count(*) FILTER (polarity = 'supporting') AS supporting, count(*) FILTER (polarity = 'contradicting') AS contradicting, min(created_at) AS valid_from, max(valid_until) AS valid_until FROM stm GROUP BY 1"""


def beliefs(spark, d):
    s = statements(spark, d)
    return K.build_beliefs(s).withColumn("topic", F.lower(F.regexp_extract("proposition", r"(SRC\d+)", 1))), K.belief_evidence(s), B.memories(spark, d)


@query("build_beliefs", f"SELECT belief_key, proposition, supporting, contradicting, {S.fmt('valid_from')} AS valid_from, {S.fmt('valid_until')} AS valid_until FROM bel")
def build_beliefs(spark, d):
    return beliefs(spark, d)[0].drop("topic").withColumn("valid_from", ts("valid_from")).withColumn("valid_until", ts("valid_until"))


@query("belief_evidence", "SELECT * FROM bev")
def belief_evidence(spark, d):
    return beliefs(spark, d)[1]


def _conf(base, ns, nc):
    return f"CASE WHEN {ns} = 0 THEN 0.3 ELSE greatest(0.0, least(1.0, coalesce({base}, 0.5) - 0.15 * {nc})) END"


@query("belief_confidence", f"""
WITH a AS (SELECT belief_key, polarity = 'supporting' AS sup, confidence AS c, importance * confidence * greatest(0.3, 1.0 - {S.whole_days(NOW, 'created_at')} / 365) AS w FROM bev JOIN mem USING (memory_id)),
b AS (SELECT belief_key, count(*) FILTER (sup) AS supporting, count(*) FILTER (NOT sup) AS contradicting, sum(w * c) FILTER (sup) / sum(w) FILTER (sup) AS base FROM a GROUP BY belief_key)
SELECT belief_key, supporting, contradicting, round({_conf('base', 'supporting', 'contradicting')}, 6) AS confidence FROM b""")
def belief_confidence(spark, d):
    _, ev, mem = beliefs(spark, d)
    return K.belief_confidence(ev, mem, AS_OF).withColumn("confidence", F.round("confidence", 6))


def _sides():
    rows = [f"CASE WHEN {S.has_phrase('pad', neg)} THEN {{'p': {i}, 's': 'b'}} WHEN {S.has_phrase('pad', pos)} THEN {{'p': {i}, 's': 'a'}} END" for i, (pos, neg) in enumerate(PATTERNS)]
    return f"list_filter([{', '.join(rows)}], lambda x: x IS NOT NULL)"


def _opp(src, group, key):
    g = ", ".join(group)
    return f"""o AS (SELECT {g}, count(*) FILTER (side = 'a') AS na, count(*) FILTER (side = 'b') AS nb, min({key}) FILTER (side = 'a') AS ma, min({key}) FILTER (side = 'b') AS mb FROM {src} GROUP BY {g})
SELECT {g}, {key}, side, CASE side WHEN 'a' THEN nb ELSE na END AS opponents, CASE side WHEN 'a' THEN mb ELSE ma END AS witness FROM {src} JOIN o USING ({g}) WHERE na > 0 AND nb > 0"""


@query("direct_contradictions", f"""
WITH a AS (SELECT message_id, text, {S.padded('text')} AS pad FROM notes), b AS (SELECT message_id, {S.entities('text')} AS es, unnest({_sides()}) AS x FROM a),
c AS (SELECT message_id, CAST(x.p AS INTEGER) AS pattern, x.s AS side, unnest(es) AS subject FROM b), {_opp('c', ['subject', 'pattern'], 'message_id')}""")
def direct_contradictions(spark, d):
    return K.direct_contradictions(B.notes(spark, d), "message_id", "text", PATTERNS)


@query("value_contradictions", """
WITH n AS (SELECT entity, property, value, count(*) AS n, min(fact_id) AS f FROM facts GROUP BY ALL),
w AS (SELECT a.entity, a.property, a.value, sum(b.n) AS opponents, min(b.f) AS witness FROM n a JOIN n b ON a.entity = b.entity AND a.property = b.property AND a.value <> b.value GROUP BY ALL)
SELECT fact_id, entity, property, value, CAST(opponents AS BIGINT) AS opponents, witness, 0.9 AS severity FROM facts JOIN w USING (entity, property, value)""")
def value_contradictions(spark, d):
    return K.value_contradictions(B.facts(spark, d))


_ord = lambda w: rf"regexp_extract(lower(text), '(?:^|\s){w}\s+([\p{{L}}\p{{N}}_]+)', 1)"


@query("order_contradictions", f"""
WITH c AS (SELECT message_id, {_ord('before')} AS anchor, 'a' AS side FROM notes WHERE {_ord('before')} <> '' UNION ALL SELECT message_id, {_ord('after')}, 'b' FROM notes WHERE {_ord('after')} <> ''),
{_opp('c', ['anchor'], 'message_id')}""")
def order_contradictions(spark, d):
    return K.order_contradictions(B.notes(spark, d), "message_id", "text")


def _pairs_sql():
    b, n = S.padded("b.proposition"), S.padded("n.text")
    return " OR ".join(f"(contains({b}, ' {p} ') AND contains({n}, ' {q} '))" for p, q in K.BELIEF_PAIRS + [("is", "hates"), ("decided", "suggested")])


@query("belief_conflicts", f"""
WITH n AS (SELECT message_id, 'src' || message_id % 20 AS topic, text FROM notes), b AS (SELECT * FROM bel)
SELECT b.belief_key, count(*) AS conflicting_memories, min(n.message_id) AS witness FROM b JOIN n ON b.topic = n.topic WHERE {_pairs_sql()} GROUP BY b.belief_key""")
def belief_conflicts(spark, d):
    n = B.notes(spark, d).select(F.col("message_id").alias("memory_id"), F.concat(F.lit("src"), F.col("message_id") % 20).alias("topic"), "text")
    return K.belief_conflicts(beliefs(spark, d)[0], n, "topic", "proposition", "text", K.BELIEF_PAIRS + [("is", "hates"), ("decided", "suggested")])


def _states(src, keys):
    return f"""l AS (SELECT *, coalesce(created_at <= at_time AND NOT (status IN ('archived', 'deep_archived') AND updated_at <= at_time), false) AS live,
  importance * confidence * greatest(0.3, 1.0 - {S.whole_days('at_time', 'created_at')} / 180) AS w FROM {src}),
g AS (SELECT belief_key, at_time, valid_until, count(*) FILTER (live AND polarity = 'supporting') AS supporting, count(*) FILTER (live AND polarity = 'contradicting') AS contradicting,
  sum(w * confidence) FILTER (live AND polarity = 'supporting') / sum(w) FILTER (live AND polarity = 'supporting') AS base FROM l GROUP BY belief_key, at_time, valid_until)
SELECT belief_key, at_time, supporting, contradicting, {_conf('base', 'supporting', 'contradicting')} AS confidence,
 CASE WHEN valid_until <= at_time THEN 'superseded' WHEN contradicting > 0 AND contradicting >= supporting * 0.5 THEN 'contested' WHEN supporting = 0 THEN 'rejected' ELSE 'accepted' END AS status FROM g"""


_evm = "SELECT e.belief_key, e.polarity, m.importance, m.confidence, m.created_at, m.updated_at, m.status, b.valid_from, b.valid_until, {at} AS at_time FROM bev e JOIN mem m USING (memory_id) JOIN bel b USING (belief_key)"
_times = "[" + ", ".join(f"TIMESTAMP '{t}'" for t in TIMES) + "]"
EXTRA_CTES["bat"] = f"WITH x AS ({_evm.format(at=f'unnest({_times})')}), y AS (SELECT * FROM x WHERE valid_from <= at_time), {_states('y', '')}"
EXTRA_CTES["bevo"] = f"""WITH x AS ({_evm.format(at=f"unnest(list_distinct(list_append(generate_series(b.valid_from, {NOW}, INTERVAL 30 DAY), {NOW})))")}), {_states('x', '')}"""


@query("beliefs_at", f"SELECT belief_key, {S.fmt('at_time')} AS at_time, supporting, contradicting, round(confidence, 6) AS confidence, status FROM bat")
def beliefs_at(spark, d):
    return K.beliefs_at(*beliefs(spark, d), TIMES).withColumn("at_time", ts("at_time")).withColumn("confidence", F.round("confidence", 6))


@query("belief_evolution", f"SELECT belief_key, {S.fmt('at_time')} AS at_time, supporting, contradicting, round(confidence, 6) AS confidence, status FROM bevo")
def belief_evolution(spark, d):
    return K.belief_evolution(*beliefs(spark, d), AS_OF).withColumn("at_time", ts("at_time")).withColumn("confidence", F.round("confidence", 6))


@query("belief_timeline", f"""SELECT topic, count(*) AS total, count(*) FILTER (status = 'contested') AS contested, count(*) FILTER (status = 'superseded') AS superseded
FROM bel JOIN bat USING (belief_key) WHERE at_time = TIMESTAMP '{TIMES[-1]}' GROUP BY topic""")
def belief_timeline(spark, d):
    b, ev, mem = beliefs(spark, d)
    return K.belief_timeline(b, K.beliefs_at(b, ev, mem, TIMES[-1:]), "topic")


@query("compare_beliefs", f"""
WITH l AS (SELECT * FROM bat WHERE at_time = TIMESTAMP '{TIMES[0]}'), r AS (SELECT * FROM bat WHERE at_time = TIMESTAMP '{TIMES[2]}'),
c AS (SELECT coalesce(l.belief_key, r.belief_key) AS belief_key, l.confidence AS ca, l.status AS sa, r.confidence AS cb, r.status AS sb FROM l FULL JOIN r ON l.belief_key = r.belief_key)
SELECT belief_key, round(ca, 6) AS confidence_a, sa AS status_a, round(cb, 6) AS confidence_b, sb AS status_b,
 CASE WHEN sb IS NULL THEN 'belief_lost' WHEN sa IS NULL THEN 'belief_gained' WHEN round(ca, 9) <> round(cb, 9) THEN 'confidence_changed' ELSE 'status_changed' END AS change
FROM c WHERE sb IS NULL OR sa IS NULL OR round(ca, 9) <> round(cb, 9) OR sa <> sb""")
def compare_beliefs(spark, d):
    s = K.beliefs_at(*beliefs(spark, d), [TIMES[0], TIMES[2]])
    at = lambda t: s.filter(F.col("at_time") == F.lit(t).cast("timestamp"))
    return K.compare_beliefs(at(TIMES[0]), at(TIMES[2])).withColumn("confidence_a", F.round("confidence_a", 6)).withColumn("confidence_b", F.round("confidence_b", 6))


@query("beliefs_by_topic", "SELECT belief_key, topic FROM bel WHERE topic IN ('src1', 'src2', 'src7')")
def beliefs_by_topic(spark, d):
    b, ev, mem = beliefs(spark, d)
    return K.beliefs_by_topic(b, ev, mem, ["src1", "src2", "src7"]).select("belief_key", "topic")


EXTRA_CTES["csides"] = """SELECT e.src, e.dst, e.strength, a.valid_from AS af, a.valid_until AS au, a.created_at AS ac, b.valid_from AS bf, b.valid_until AS bu, b.created_at AS bc
FROM (SELECT DISTINCT src, dst, strength FROM edges WHERE type = 'contradicts') e JOIN mem a ON e.src = a.memory_id JOIN mem b ON e.dst = b.memory_id"""


@query("unresolved_contradictions", f"SELECT src, dst, round(strength, 6) AS strength FROM csides WHERE af <= {NOW} AND (au IS NULL OR {NOW} < au) AND bf <= {NOW} AND (bu IS NULL OR {NOW} < bu)")
def unresolved_contradictions(spark, d):
    return K.unresolved_contradictions(B.edges(spark, d), B.memories(spark, d), AS_OF).withColumn("strength", F.round("strength", 6))


@query("resolve_as_transition", f"""
WITH m AS (SELECT CASE WHEN (ac, src) <= (bc, dst) THEN src ELSE dst END AS o, CASE WHEN (ac, src) <= (bc, dst) THEN dst ELSE src END AS n FROM csides),
d AS (SELECT memory_id, min(u) AS u, max(f) AS f FROM (SELECT o AS memory_id, TIMESTAMP '2024-03-01' AS u, NULL AS f FROM m UNION ALL SELECT n, NULL, TIMESTAMP '2024-03-01' FROM m) GROUP BY memory_id)
SELECT memory_id, {S.fmt('CASE WHEN f IS NULL THEN valid_from ELSE greatest(valid_from, f) END')} AS valid_from, {S.fmt('least(coalesce(valid_until, u), coalesce(u, valid_until))')} AS valid_until FROM mem JOIN d USING (memory_id)""")
def resolve_as_transition(spark, d):
    r = K.resolve_as_transition(B.edges(spark, d), B.memories(spark, d), "2024-03-01")
    return r.withColumn("valid_from", ts("valid_from")).withColumn("valid_until", ts("valid_until"))
