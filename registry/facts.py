from pyspark.sql import functions as F

from engramlake.operators import facts as E
from engramlake.sources import bindings as B
from registry import EXTRA_CTES, query
from registry import snippets as S

ts = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
NAMES = "click error login purchase view".split()
MUT = ["click", "purchase", "view"]


def _extract_sql():
    t = S.strip("text")
    g = lambda pat, i: f"trim(regexp_extract(t, {S.q(pat)}, {i}))"
    tidy = lambda c: rf"trim(regexp_replace(lower(trim(regexp_replace({c}, '\.+$', ''))), '^(?:the|a|an|our|my|their|its|his|her)\s+', ''))"
    val = lambda c: rf"regexp_replace({c}, '\.+$', '')"
    beh = S.contains_any("lower(t)", E.BEHAVIOUR_WORDS)
    m = lambda pat: f"regexp_matches(t, {S.q(pat)})"
    st = lambda rel, p, v, o="NULL", s="active": f"{{'r': '{rel}', 'p': {p}, 'v': {v}, 'o': CAST({o} AS VARCHAR), 's': '{s}'}}"
    setting = f"coalesce(nullif({g(E.SETTING, 1)}, ''), nullif({g(E.SETTING, 2)}, ''), nullif({g(E.SETTING, 3)}, ''), 'tool')"
    return f"""
WITH a AS (SELECT message_id, created_at, {t} AS t FROM notes),
b AS (SELECT *, CASE WHEN {m(E.MIGRATION)} THEN {st('migrated', tidy(f"regexp_replace({g(E.MIGRATION, 1)}, {S.q(E.PROJECT_PREFIX)}, '')"), val(g(E.MIGRATION, 3)), f"nullif({g(E.MIGRATION, 2)}, '')")}
 WHEN {m(E.NEGATION)} THEN {st('never', tidy(g(E.NEGATION, 1)), "'none'", s='unspecified')} WHEN {m(E.LOCATION)} THEN {st('located_at', "'location'", g(E.LOCATION, 1))}
 WHEN {m(E.HABIT)} THEN {st('prefers', "'drinks'", g(E.HABIT, 1))} WHEN {m(E.SETTING)} THEN {st('prefers', tidy(setting), val(g(E.SETTING, 4)))}
 WHEN {beh} THEN {st('behavior', "'behavior_tendency'", 't')} WHEN {m(E.ASSERTION)} THEN {st('asserts', tidy(g(E.ASSERTION, 1)), val(g(E.ASSERTION, 2)))}
 ELSE {st('asserts', "'statement'", 't')} END AS f, regexp_extract(lower(t), {S.q(E.ENTITY_NAME)}, 1) AS nm FROM a WHERE t <> '')
SELECT message_id AS fact_id, CASE WHEN nm <> '' THEN nm ELSE 'general' END AS entity, f.r AS relation, f.p AS property, f.v AS value, f.o AS old_value, f.s AS status,
  CASE WHEN contains(lower(t), 'teammate reported') THEN 'teammate' WHEN contains(lower(t), 'assistant') THEN 'assistant' ELSE 'user' END AS source, created_at AS ts, t AS raw FROM b"""


EXTRA_CTES["xfacts"] = _extract_sql()


@query("extract_facts", "SELECT * EXCLUDE (ts) FROM xfacts")
def extract_facts(spark, d):
    return E.extract_facts(B.notes(spark, d)).drop("ts")


@query("normalise_entities", "SELECT fact_id, CASE lower(trim(entity)) WHEN 'general' THEN 'everyone' WHEN 'alpha' THEN 'team_alpha' WHEN 'u1' THEN 'user_1' ELSE lower(trim(entity)) END AS entity FROM xfacts")
def normalise_entities(spark, d):
    return E.normalise_entities(E.extract_facts(B.notes(spark, d)), {"general": "everyone", "alpha": "team_alpha", "u1": "user_1"}).select("fact_id", "entity")


@query("dedup_facts", """
WITH a AS (SELECT *, min(fact_id) OVER (PARTITION BY raw) AS x, min(fact_id) OVER (PARTITION BY entity, property, value) AS y FROM xfacts)
SELECT fact_id, entity, property, value FROM a WHERE fact_id = x AND fact_id = y""")
def dedup_facts(spark, d):
    return E.dedup_facts(E.extract_facts(B.notes(spark, d))).select("fact_id", "entity", "property", "value")


@query("entity_clusters", """
SELECT entity, count(*) AS facts, count(DISTINCT property) AS properties, array_to_string(list_sort(list_distinct(list(property))), ',') AS covered FROM facts GROUP BY entity""")
def entity_clusters(spark, d):
    return E.entity_clusters(B.facts(spark, d))


EXTRA_CTES["confl"] = """
WITH a AS (SELECT entity, property, count(*) AS facts, count(DISTINCT value) AS values, count(DISTINCT value) FILTER (status = 'active') AS active_values,
 bool_or(relation = 'contradicts') AS con, count(DISTINCT value) FILTER (relation = 'migrated') AS mig, count(DISTINCT source) AS src,
 arg_max(value, {'t': ts, 'i': fact_id}) FILTER (status = 'active') AS ca, arg_max(value, {'t': ts, 'i': fact_id}) AS cl FROM facts GROUP BY entity, property),
b AS (SELECT *, CASE WHEN active_values > 1 OR con THEN 'high' WHEN mig > 0 THEN CASE WHEN mig > 1 THEN 'medium' END WHEN src > 1 THEN 'medium' END AS severity FROM a)
SELECT entity, property, facts, values, active_values, severity, coalesce(ca, cl) AS active_candidate FROM b WHERE values > 1 AND severity IS NOT NULL"""


@query("detect_conflicts", "SELECT * FROM confl")
def detect_conflicts(spark, d):
    return E.detect_conflicts(B.facts(spark, d))


@query("conflict_evidence", """
SELECT entity, property, value, count(*) AS n, arg_max(fact_id, {'t': ts, 'i': fact_id}) AS last_fact_id, any_value(active_candidate) AS active_candidate, any_value(severity) AS severity
FROM facts JOIN confl USING (entity, property) WHERE value <> active_candidate GROUP BY entity, property, value""")
def conflict_evidence(spark, d):
    f = B.facts(spark, d)
    return E.conflict_evidence(f, E.detect_conflicts(f))


@query("resolve_conflicts", """
WITH r AS (SELECT DISTINCT entity, property, 'v0' AS av FROM facts WHERE property IN ('click', 'view'))
SELECT entity, property, severity, active_candidate, coalesce(av, active_candidate) AS resolved_value, CASE WHEN av IS NULL THEN 'conflicted' ELSE 'resolved' END AS state FROM confl LEFT JOIN r USING (entity, property)""")
def resolve_conflicts(spark, d):
    f = B.facts(spark, d)
    r = f.filter(F.col("property").isin("click", "view")).select("entity", "property").distinct().withColumn("authoritative_value", F.lit("v0"))
    return E.resolve_conflicts(E.detect_conflicts(f), r).select("entity", "property", "severity", "active_candidate", "resolved_value", "state")


@query("supersede_facts", f"""
WITH a AS (SELECT *, count(DISTINCT value) OVER (PARTITION BY entity, property) AS nv, row_number() OVER (PARTITION BY entity, property ORDER BY ts DESC, fact_id DESC) AS rn FROM facts)
SELECT fact_id, entity, property, CASE WHEN property IN ({', '.join(S.q(x) for x in MUT)}) AND nv > 1 THEN CASE WHEN rn = 1 THEN 'active' ELSE 'superseded' END ELSE status END AS status FROM a""")
def supersede_facts(spark, d):
    return E.supersede_facts(B.facts(spark, d), MUT).select("fact_id", "entity", "property", "status")


EXTRA_CTES["hist"] = """
WITH a AS (SELECT *, lag(value) OVER w AS pv FROM facts WINDOW w AS (PARTITION BY entity, property ORDER BY ts, fact_id)),
b AS (SELECT * FROM a WHERE value IS DISTINCT FROM pv)
SELECT fact_id, entity, property, value, pv AS previous_value, ts AS valid_from, lead(ts) OVER (PARTITION BY entity, property ORDER BY ts, fact_id) AS valid_until,
 lead(ts) OVER (PARTITION BY entity, property ORDER BY ts, fact_id) IS NULL AS is_current FROM b"""


def hist(spark, d):
    return E.state_history(B.facts(spark, d))


@query("state_history", f"SELECT * REPLACE ({S.fmt('valid_from')} AS valid_from, {S.fmt('valid_until')} AS valid_until) FROM hist")
def state_history(spark, d):
    return hist(spark, d).withColumn("valid_from", ts("valid_from")).withColumn("valid_until", ts("valid_until"))


EXTRA_CTES["sq"] = "SELECT entity, property, min(fact_id) AS query_id, CASE WHEN min(fact_id) % 2 = 0 THEN 'current' ELSE 'previous' END AS wanted FROM facts GROUP BY entity, property"


def state_queries(spark, d):
    return B.facts(spark, d).groupBy("entity", "property").agg(F.min("fact_id").alias("query_id")).withColumn("wanted", F.when(F.col("query_id") % 2 == 0, "current").otherwise("previous"))


@query("answer_state", f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY entity, property ORDER BY valid_from DESC, fact_id DESC) AS k, count(*) OVER (PARTITION BY entity, property) AS n FROM hist)
SELECT query_id, entity, property, wanted, value AS answer, {S.fmt('valid_from')} AS as_of FROM sq JOIN r USING (entity, property) WHERE k = CASE WHEN wanted = 'previous' AND n >= 2 THEN 2 ELSE 1 END""")
def answer_state(spark, d):
    return E.answer_state(state_queries(spark, d), hist(spark, d)).withColumn("as_of", ts("as_of"))


@query("truth_sections", """
WITH a AS (SELECT entity, CASE WHEN status = 'active' THEN 'active' WHEN status IN ('superseded', 'deprecated') THEN 'superseded' ELSE 'mention' END AS section,
 CASE WHEN status = 'active' AND relation = 'migrated' THEN entity || ' ' || property || ' = ' || value || ' (migrated from ' || coalesce(old_value, 'previous') || ')'
  WHEN status = 'active' THEN entity || ' ' || property || ' = ' || value WHEN status IN ('superseded', 'deprecated') THEN entity || ' ' || property || ' was ' || value
  ELSE source || ' mentioned ' || value || ' for ' || entity END AS line FROM facts
 UNION ALL SELECT entity, 'superseded', entity || ' ' || property || ' was ' || old_value FROM facts WHERE status = 'active' AND relation = 'migrated')
SELECT entity, section, line, count(*) AS n FROM a WHERE line IS NOT NULL GROUP BY ALL""")
def truth_sections(spark, d):
    return E.truth_sections(B.facts(spark, d))


@query("resolve_facts", """
WITH q AS (SELECT fact_id AS query_id, entity, property, ts + INTERVAL 1 HOUR AS asked_at FROM facts),
n AS (SELECT DISTINCT entity, property FROM facts WHERE relation = 'never' AND status = 'active'),
f AS (SELECT q.query_id, h.value FROM q JOIN hist h ON q.entity = h.entity AND q.property = h.property AND h.valid_from <= asked_at AND (h.valid_until IS NULL OR asked_at < h.valid_until))
SELECT q.query_id, q.entity, q.property, n.entity IS NOT NULL AS abstain, CASE WHEN n.entity IS NULL THEN f.value END AS value, f.value AS held
FROM q LEFT JOIN n ON q.entity = n.entity AND q.property = n.property LEFT JOIN f ON q.query_id = f.query_id""")
def resolve_facts(spark, d):
    f = B.facts(spark, d)
    q = f.select(F.col("fact_id").alias("query_id"), "entity", "property", (F.col("ts") + F.expr("interval 1 hour")).alias("asked_at"))
    return E.resolve_facts(q, f.filter("status = 'active'"), hist(spark, d))


EXTRA_CTES["fq"] = "SELECT min(fact_id) AS query_id, entity, 'what did the user ' || max(property) || ' ' || min(value) || ' user_1' AS text FROM facts GROUP BY entity"


def fact_queries(spark, d):
    return B.facts(spark, d).groupBy("entity").agg(F.min("fact_id").alias("query_id"), F.concat(F.lit("what did the user "), F.max("property"), F.lit(" "), F.min("value"), F.lit(" user_1")).alias("text"))


_terms = f"list_filter(list_distinct({S.words('text')}), lambda w: length(w) >= 2 AND w NOT IN ({', '.join(S.q(w) for w in E.QUESTION_STOP)}))"
EXTRA_CTES["frank"] = f"""
WITH t AS (SELECT query_id, entity, unnest({_terms}) AS term FROM fq),
ft AS (SELECT fact_id, entity, relation, unnest(list_distinct(list_concat({S.words('property')}, {S.words('value')}, {S.words('raw')}))) AS term, {S.words('property')} AS pw, {S.words('value')} AS vw FROM facts),
s AS (SELECT query_id, fact_id, sum(CASE WHEN list_contains(pw, term) THEN 3.0 WHEN list_contains(vw, term) THEN 2.0 ELSE 1.0 END) + CASE WHEN any_value(relation) = 'migrated' THEN 1.5 ELSE 0.0 END AS score
 FROM t JOIN ft USING (entity, term) WHERE term <> lower(entity) GROUP BY query_id, fact_id)
SELECT query_id, fact_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, fact_id) AS rank FROM s QUALIFY rank <= 8"""


@query("rank_facts", "SELECT query_id, fact_id, round(score, 6) AS score, rank FROM frank")
def rank_facts(spark, d):
    return E.rank_facts(fact_queries(spark, d), B.facts(spark, d))


@query("expand_by_value", f"""
WITH w AS (SELECT DISTINCT query_id, lower(value) AS term FROM frank JOIN facts USING (fact_id)),
ft AS (SELECT fact_id, entity, unnest(list_distinct({S.words('raw')})) AS term FROM facts),
c AS (SELECT DISTINCT w.query_id, ft.fact_id, ft.entity FROM w JOIN fq USING (query_id) JOIN ft USING (term) WHERE ft.entity <> fq.entity)
SELECT query_id, fact_id, entity, row_number() OVER (PARTITION BY query_id ORDER BY fact_id) AS rank FROM c QUALIFY rank <= 3""")
def expand_by_value(spark, d):
    f, q = B.facts(spark, d), fact_queries(spark, d)
    return E.expand_by_value(q, E.rank_facts(q, f), f)


@query("behaviour_patterns", f"""
WITH a AS (SELECT entity, fact_id, row_number() OVER (PARTITION BY entity ORDER BY fact_id) AS k FROM facts WHERE {S.contains_any('lower(raw)', E.BEHAVIOUR_WORDS)} OR relation = 'behavior')
SELECT entity, count(*) AS signals, string_agg(CAST(fact_id AS VARCHAR), ',' ORDER BY fact_id) FILTER (k <= 4) AS evidence FROM a GROUP BY entity HAVING count(*) >= 2""")
def behaviour_patterns(spark, d):
    return E.behaviour_patterns(B.facts(spark, d))


_forms = ["how many # items were bought in total before", "what is the average of # items bought before", "how many times did someone buy # items before", "how much money was spent on # before", "when did i buy the most # items"]
EXTRA_CTES["aq"] = f"""WITH e AS (SELECT event_type, min(event_id) AS i FROM events GROUP BY event_type), x AS (SELECT i * 10 + k AS query_id, replace(t, '#', event_type) AS text FROM e, (VALUES {', '.join(f"({k}, '{t}')" for k, t in enumerate(_forms))}) v(k, t)),
y AS (SELECT query_id, text, CASE WHEN contains(text, 'average') THEN 'average' WHEN {S.contains_any('text', E.SUM_WORDS)} THEN 'sum' ELSE 'count' END AS op, regexp_extract(text, 'how (?:many|much) ([a-z_]+)', 1) AS noun FROM x WHERE {S.contains_any('text', E.AGGREGATE_WORDS)} AND NOT ({S.contains_any('text', E.OTHER_QUESTIONS)}))
SELECT query_id, text, op, CASE WHEN contains(text, 'money') OR contains(text, 'spent') THEN '$' WHEN noun <> '' AND noun NOT IN ({', '.join(S.q(w) for w in E.NO_UNIT)}) THEN noun END AS unit FROM y"""


def quantity_questions(spark, d):
    e = B.table(spark, d, "events").groupBy("event_type").agg(F.min("event_id").alias("i"))
    e = e.select("event_type", "i", F.posexplode(F.array(*[F.lit(t) for t in _forms])).alias("k", "t"))
    return e.select((F.col("i") * 10 + F.col("k")).alias("query_id"), F.replace("t", F.lit("#"), F.col("event_type")).alias("text"))


@query("read_questions", "SELECT query_id, op, unit FROM aq")
def read_questions(spark, d):
    return E.read_questions(quantity_questions(spark, d)).filter("op is not null").select("query_id", "op", "unit")


from engramlake.functions import lexicons as L  # noqa: E402

_num = r"\$?(\d+(?:\.\d+)?)"


@query("aggregate_quantities", rf"""
WITH s AS (SELECT conv_id, turn, unnest(list_transform({S.sentences('text')}, lambda x, i: {{'s': x, 'i': i}})) AS u FROM notes),
s2 AS (SELECT conv_id, turn, u.i AS pos, u.s AS sentence, regexp_matches(u.s, '{_num}') AS num FROM s),
t AS (SELECT query_id, unnest(list_filter(list_distinct({S.words('text')}), lambda w: length(w) >= 3 AND w NOT IN ({', '.join(S.q(w) for w in L.STOP_WORDS)}))) AS term FROM aq),
w AS (SELECT conv_id, turn, pos, num, unnest(list_distinct({S.words('sentence')})) AS term FROM s2),
h AS (SELECT query_id, conv_id, turn, pos, count(*) + CASE WHEN num THEN 2.0 ELSE 0.0 END AS score FROM t JOIN w USING (term) GROUP BY query_id, conv_id, turn, pos, num),
b AS (SELECT * FROM h WHERE score >= 2.5 QUALIFY row_number() OVER (PARTITION BY query_id, conv_id ORDER BY score DESC, turn, pos) = 1),
c AS (SELECT b.query_id, op, sentence, try_cast(CASE WHEN unit = '$' AND regexp_extract(sentence, '\$(\d+(?:\.\d+)?)', 1) <> '' THEN regexp_extract(sentence, '\$(\d+(?:\.\d+)?)', 1) WHEN unit <> '$' AND regexp_extract(sentence, '(?i){_num}\s+' || unit, 1) <> '' THEN regexp_extract(sentence, '(?i){_num}\s+' || unit, 1)
  ELSE regexp_extract(sentence, '{_num}', 1) END AS DOUBLE) AS amount FROM b JOIN s2 USING (conv_id, turn, pos) JOIN aq USING (query_id))
SELECT query_id, op, count(*) AS sessions, round(CASE op WHEN 'sum' THEN sum(amount) WHEN 'average' THEN avg(amount) ELSE CAST(count(DISTINCT sentence) AS DOUBLE) END, 6) AS answer FROM c GROUP BY query_id, op""")
def aggregate_quantities(spark, d):
    return E.aggregate_quantities(quantity_questions(spark, d), B.notes(spark, d)).select("query_id", "op", "sessions", F.round("answer", 6).alias("answer"))


EXTRA_CTES["pgraph"] = """SELECT 'fact:' || fact_id AS src, 'entity:' || lower(entity) AS dst, 'subject' AS kind, 1.0 AS weight FROM facts
UNION ALL SELECT 'fact:' || fact_id, 'entity:' || lower(value), 'object', 1.0 FROM facts WHERE length(value) >= 2
UNION ALL SELECT 'fact:' || fact_id, 'fact:' || n, 'supersedes', 1.5 FROM (SELECT fact_id, lead(fact_id) OVER (PARTITION BY entity, property ORDER BY valid_from, fact_id) AS n FROM hist) WHERE n IS NOT NULL"""


@query("proposition_graph", "SELECT * FROM pgraph")
def proposition_graph(spark, d):
    return E.proposition_graph(B.facts(spark, d), hist(spark, d))


@query("match_entities", """
WITH k AS (SELECT DISTINCT lower(CASE WHEN user_id % 3 = 0 THEN 'user_' || user_id WHEN user_id % 3 = 1 THEN 'r_' || user_id % 10 ELSE 'the user_' || user_id || ' account' END) AS key FROM events),
n AS (SELECT DISTINCT entity FROM facts), x AS (SELECT key, entity FROM k JOIN n ON key = entity)
SELECT key, entity, 'exact' AS how FROM x UNION ALL SELECT key, entity, 'part' FROM k, n WHERE key NOT IN (SELECT key FROM x) AND (contains(entity, key) OR contains(key, entity))""")
def match_entities(spark, d):
    u = F.col("user_id")
    k = B.table(spark, d, "events").select(F.when(u % 3 == 0, F.concat(F.lit("user_"), u)).when(u % 3 == 1, F.concat(F.lit("r_"), u % 10)).otherwise(F.concat(F.lit("the user_"), u, F.lit(" account"))).alias("key"))
    return E.match_entities(k, B.facts(spark, d))


@query("facts_for_entity", """
WITH k AS (SELECT DISTINCT 'r_' || user_id % 10 AS key FROM events)
SELECT key, fact_id, entity FROM k JOIN facts ON contains(entity, key)""")
def facts_for_entity(spark, d):
    k = B.table(spark, d, "events").select(F.concat(F.lit("r_"), F.col("user_id") % 10).alias("key"))
    return E.facts_for_entity(k, B.facts(spark, d)).select("key", "fact_id", "entity")


_role = f"CASE WHEN relation = 'migrated' THEN 'event' WHEN relation = 'behavior' THEN 'abstraction' WHEN {S.contains_any('lower(raw)', E.PROPOSAL_WORDS)} OR status IN ('superseded', 'deprecated') THEN 'evidence' ELSE 'state' END"


@query("tag_roles", f"SELECT fact_id, {_role} AS role FROM xfacts")
def tag_roles(spark, d):
    return E.tag_roles(E.extract_facts(B.notes(spark, d))).select("fact_id", "role")


@query("role_counts", f"""WITH a AS (SELECT entity, {_role} AS role FROM facts)
SELECT entity, count(*) FILTER (role = 'state') AS state, count(*) FILTER (role = 'event') AS event, count(*) FILTER (role = 'evidence') AS evidence, count(*) FILTER (role = 'abstraction') AS abstraction FROM a GROUP BY entity""")
def role_counts(spark, d):
    return E.role_counts(E.tag_roles(B.facts(spark, d)))


EXTRA_CTES["tlines"] = rf"""
WITH j AS (SELECT r.query_id, r.rank, r.fact_id, status = 'superseded' AS old, CASE WHEN status = 'superseded' THEN '  [SUPERSEDED] ' || trim(raw)
 WHEN rank <= 8 THEN raw ELSE '[FACT] ' || entity || ' -> ' || property || ': ' || value END AS line FROM frank r JOIN facts USING (fact_id)),
k AS (SELECT *, CAST(len({S.space_words('line')}) AS BIGINT) AS words, row_number() OVER (PARTITION BY query_id ORDER BY old DESC, rank) AS line_no FROM j),
u AS (SELECT *, coalesce(sum(words) OVER (PARTITION BY query_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM k)
SELECT query_id, line_no, fact_id, line, words FROM u WHERE used < 24"""


@query("render_tiered", "SELECT * FROM tlines")
def render_tiered(spark, d):
    f = B.facts(spark, d)
    return E.render_tiered(E.rank_facts(fact_queries(spark, d), f), f, 24)
