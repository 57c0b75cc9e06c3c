from pyspark.sql import functions as F

from engramlake.functions import lexicons as L
from engramlake.operators import compilation as C
from engramlake.sources import bindings as B
from registry import EXTRA_CTES, query
from registry import snippets as S


def ts(col):
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss")


@query("lexical_features", f"""
SELECT conv_id, CAST(sum(length(text)) AS BIGINT) AS char_count, CAST(sum(len({S.space_words('text')})) AS BIGINT) AS word_count,
  CAST(sum(len({S.sentences('text')})) AS BIGINT) AS sentence_count,
  CASE WHEN bool_or(regexp_matches(text, '[぀-ヿ一-鿿]')) THEN 'ja' ELSE 'en' END AS language
FROM msg GROUP BY conv_id""")
def lexical_features(spark, d):
    return C.lexical_features(B.messages(spark, d))


@query("conversation_structure", """
SELECT conv_id, count(*) AS turn_count, count(*) FILTER (role = 'user') AS user_turns, count(*) FILTER (role = 'assistant') AS assistant_turns,
  count(*) FILTER (role = 'system') AS system_turns, arg_min(role, turn) AS first_role, arg_max(role, turn) AS last_role,
  min(turn) FILTER (role = 'user') AS first_user_turn, substring(arg_min(text, turn) FILTER (role = 'user'), 1, 100) AS inferred_topic
FROM msg GROUP BY conv_id""")
def conversation_structure(spark, d):
    return C.structure(B.messages(spark, d))


def _unit_sql():
    kinds = ["CASE role WHEN 'user' THEN [{'t': 'role', 'v': 'usr'}] WHEN 'assistant' THEN [{'t': 'role', 'v': 'ast'}] ELSE [] END"]
    for k, p in L.IR_PATTERNS.items():
        win = rf"(?is).{{0,50}}?(?:{p}).{{0,100}}" if k in L.IR_INSIDE_WORDS else rf"(?is)(?:^|.{{0,49}}{S.NW})(?:{p})(?:{S.NW}.{{0,99}}|$)"
        kinds.append(f"list_transform(regexp_extract_all(text, '{win}'), lambda v: {{'t': '{k}', 'v': trim(v, ' ')}})")
    kinds.append(f"CASE WHEN {S.has_phrase('pad', L.CASUAL)} THEN [{{'t': 'tone', 'v': 'casual'}}] ELSE [] END")
    kinds.append(f"CASE WHEN {S.has_phrase('pad', L.HESITATION)} THEN [{{'t': 'tone', 'v': 'hesitation'}}] ELSE [] END")
    kinds.append("CASE WHEN contains(text, '?') OR contains(text, '？') THEN [{'t': 'tone', 'v': 'questioning'}] ELSE [] END")
    ents = rf"regexp_extract_all(text, '(?:^|{S.NW})(\p{{Lu}}\p{{Ll}}{{2,}}(?: +\p{{Lu}}\p{{Ll}}+)*)', 1)"
    acr = rf"regexp_extract_all(text, '(?:^|{S.NW})([A-Z]{{2,}}(?:[_-][A-Z0-9]+)*)', 1)"
    return kinds, ents, acr


_kinds, _ents, _acr = _unit_sql()
_uniq = "list_filter({x}, lambda y, i: list_position({x}, y) = i)"
EXTRA_CTES["units"] = f"""
WITH a AS (SELECT conv_id, turn, role, text, {S.padded('text')} AS pad FROM notes),
b AS (SELECT conv_id, turn, {' || '.join(_kinds)} AS u,
  list_concat(list_filter({_ents}, lambda e: e NOT IN ({', '.join(S.q(w) for w in L.ENTITY_STOP_WORDS)})), {_acr}) AS e FROM a),
c AS (SELECT conv_id, turn, list_concat(u, list_transform({_uniq.format(x='e')}, lambda v: {{'t': 'entity', 'v': trim(v, ' ')}})) AS u FROM b),
d AS (SELECT conv_id, turn, unnest(list_transform(u, lambda x, i: {{'t': x.t, 'v': x.v, 'i': i - 1}})) AS x FROM c)
SELECT conv_id, turn, CAST(x.i AS BIGINT) AS seq, x.t AS ir_type, x.v AS value, {S.tokens('x.v')} AS tokens FROM d"""


def units(spark, d):
    return C.ir_units(B.notes(spark, d))


@query("ir_units", "SELECT * FROM units")
def ir_units(spark, d):
    return units(spark, d)


@query("ir_type_distribution", "SELECT conv_id, " + ", ".join(f"count(*) FILTER (ir_type = '{t}') AS {t}" for t in L.IR_ORDER) + " FROM units GROUP BY conv_id")
def ir_type_distribution(spark, d):
    return C.ir_distribution(units(spark, d))


_dec, _imp = S.contains_any("lower(text)", L.DECISION_WORDS), S.contains_any("lower(text)", L.IMPORTANT_WORDS)
EXTRA_CTES["cands"] = f"""
WITH a AS (SELECT *, {_dec} AS dec, {_imp} AS imp FROM notes WHERE role = 'assistant')
SELECT message_id, conv_id, turn, 'decision' AS memory_type, 3 AS resolution, 0.85 AS importance, 0.8 AS confidence, text AS content, created_at FROM a WHERE dec
UNION ALL SELECT message_id, conv_id, turn, 'semantic', 3, CASE WHEN imp THEN 0.7 ELSE 0.6 END, 0.75, text, created_at FROM a WHERE imp OR dec
UNION ALL SELECT message_id, conv_id, turn, 'episode', 2, 0.6, 0.7, text, created_at FROM a WHERE length(text) > 100"""


@query("memory_candidates", f"SELECT message_id, conv_id, turn, memory_type, resolution, importance, confidence, content, {S.fmt('created_at')} AS created_at FROM cands")
def memory_candidates(spark, d):
    return C.memory_candidates(B.notes(spark, d)).withColumn("created_at", ts("created_at"))


@query("memory_candidates_long_turns", """
SELECT message_id, conv_id, turn, 'episode' AS memory_type, 2 AS resolution, 0.6 AS importance, 0.7 AS confidence, length(text) AS n_chars
FROM msg WHERE role = 'assistant' AND length(text) > 100""")
def memory_candidates_long_turns(spark, d):
    c = C.memory_candidates(B.messages(spark, d), ["決定"], ["重要"])
    return c.withColumn("n_chars", F.length("content").cast("long")).drop("content", "created_at")


@query("timeline_memories", f"""
WITH h AS (SELECT conv_id, min(created_at) AS started_at, arg_min(text, turn) FILTER (role = 'user') AS fu FROM notes GROUP BY conv_id),
e AS (SELECT conv_id, turn, CASE WHEN {_dec} THEN 'decided: ' ELSE 'important: ' END || substring(text, 1, 100) AS ev,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM notes WHERE role = 'assistant' AND ({_dec} OR {_imp})),
g AS (SELECT conv_id, string_agg('- ' || ev, chr(10) ORDER BY turn) AS evs FROM e WHERE n <= 5 GROUP BY conv_id)
SELECT conv_id, {S.fmt('started_at')} AS started_at, '**' || strftime(started_at, '%Y-%m-%d') || '**' || chr(10) || 'topic: ' || coalesce(substring(fu, 1, 200), '') || chr(10) || coalesce(evs, '') AS content
FROM h LEFT JOIN g USING (conv_id)""")
def timeline_memories(spark, d):
    return C.timeline_memories(B.notes(spark, d)).withColumn("started_at", ts("started_at"))


@query("conversation_transcripts", """
SELECT conv_id, turn // 100 AS page, count(*) AS turns, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS transcript FROM msg GROUP BY conv_id, turn // 100""")
def conversation_transcripts(spark, d):
    return C.transcripts(B.messages(spark, d))


@query("link_provenance", f"""
WITH a AS (SELECT memory_id, conv_id, unnest(list_distinct({S.space_words('content')})) AS w FROM mem WHERE message_id IS NULL),
b AS (SELECT message_id, conv_id, unnest(list_distinct({S.space_words('text')})) AS w FROM msg WHERE role = 'assistant'),
c AS (SELECT memory_id, message_id, count(*) AS shared_words FROM a JOIN b USING (conv_id, w) GROUP BY ALL HAVING count(*) > 3)
SELECT memory_id, message_id, shared_words FROM c QUALIFY row_number() OVER (PARTITION BY memory_id ORDER BY shared_words DESC, message_id) = 1""")
def link_provenance(spark, d):
    return C.link_provenance(B.memories(spark, d), B.messages(spark, d)).select("memory_id", "message_id", "shared_words")


def _with_parts(m):
    i = F.col("memory_id")
    return m.withColumn("importance", F.when(i % 5 != 0, F.col("importance"))).withColumn("confidence", F.when(i % 6 != 1, F.col("confidence") + 0.2)).withColumn(
        "retrieval_confidence", F.lit(0.4) + F.lit(0.1) * (i % 8)).withColumn("temporal_confidence", F.lit(0.2) * (i % 6)).withColumn("source_confidence", F.lit(0.9))


@query("normalise_confidence", f"""
WITH a AS (SELECT memory_id, memory_type, CASE WHEN memory_id % 5 <> 0 THEN importance END AS i, CASE WHEN memory_id % 6 <> 1 THEN confidence + 0.2 END AS c,
  0.4 + 0.1 * (memory_id % 8) AS r, 0.2 * (memory_id % 6) AS t FROM mem)
SELECT memory_id, memory_type, round(greatest(0.0, least(1.0, coalesce(i, CASE memory_type {' '.join(f"WHEN '{k}' THEN {v}" for k, v in L.DEFAULT_IMPORTANCE.items())} ELSE 0.6 END))), 6) AS importance,
  round(0.4 * greatest(0.0, least(1.0, coalesce(c, CASE memory_type {' '.join(f"WHEN '{k}' THEN {v}" for k, v in L.DEFAULT_CONFIDENCE.items())} ELSE 0.7 END)))
   + 0.3 * greatest(0.0, least(1.0, r)) + 0.15 * greatest(0.0, least(1.0, t)) + 0.15 * 0.9, 6) AS overall_confidence FROM a""")
def normalise_confidence(spark, d):
    r = C.normalise_confidence(_with_parts(B.memories(spark, d)))
    return r.select("memory_id", "memory_type", F.round("importance", 6).alias("importance"), F.round("overall_confidence", 6).alias("overall_confidence"))


@query("dedup_content", """
SELECT min(memory_id) AS memory_id, left(sha256(content), 16) AS content_hash, count(*) AS copies FROM mem GROUP BY 2""")
def dedup_content(spark, d):
    return C.dedup_content(B.memories(spark, d)).select("memory_id", "content_hash", "copies")


@query("lifecycle_temperature", """
SELECT memory_id, CASE WHEN memory_type IN ('current', 'decision') THEN 'hot' WHEN memory_type = 'timeline' THEN 'warm' WHEN importance >= 0.8 THEN 'hot'
  WHEN importance >= 0.5 THEN 'warm' ELSE 'cold' END AS lifecycle FROM mem""")
def lifecycle_temperature(spark, d):
    return C.lifecycle(B.memories(spark, d)).select("memory_id", "lifecycle")


@query("compile_diagnostics", f"""
WITH a AS (SELECT 'lexical' AS stage, 'warning' AS severity, 'no sentences' AS issue FROM msg WHERE len({S.sentences('text')}) = 0
UNION ALL SELECT 'structural', 'error', 'unknown role' FROM msg WHERE role NOT IN ('user', 'assistant', 'system')
UNION ALL SELECT 'provenance', 'warning', 'no source message' FROM mem WHERE message_id IS NULL
UNION ALL SELECT 'temporal', 'error', 'empty validity' FROM mem WHERE valid_until <= valid_from
UNION ALL SELECT 'classification', 'error', 'importance out of range' FROM mem WHERE NOT importance BETWEEN 0 AND 1
UNION ALL SELECT 'classification', 'error', 'confidence out of range' FROM mem WHERE NOT confidence BETWEEN 0 AND 1
UNION ALL SELECT 'compression', 'warning', 'no versions' FROM mem WHERE resolution < 4 AND length(content) < 400)
SELECT stage, severity, issue, count(*) AS n FROM a GROUP BY ALL""")
def compile_diagnostics(spark, d):
    mem = B.memories(spark, d)
    return C.diagnostics(B.messages(spark, d), mem, mem.filter(F.length("content") >= 400)).groupBy("stage", "severity", "issue").agg(F.count("*").alias("n"))


@query("prune_ir", f"""
WITH a AS (SELECT *, CASE ir_type {' '.join(f"WHEN '{k}' THEN {v}" for k, v in L.IR_PRIORITY.items())} ELSE 1 END AS p FROM units),
b AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY p DESC, turn, seq ROWS UNBOUNDED PRECEDING) AS used FROM a)
SELECT conv_id, turn, seq, ir_type, tokens, CAST(used AS BIGINT) AS used_tokens FROM b WHERE used <= 60""")
def prune_ir(spark, d):
    return C.prune_ir(units(spark, d), 60).select("conv_id", "turn", "seq", "ir_type", "tokens", "used_tokens")


EXTRA_CTES["compact"] = """
WITH a AS (SELECT *, lag(ir_type) OVER w AS pt, lag(value) OVER w AS pv FROM units WINDOW w AS (PARTITION BY conv_id ORDER BY turn, seq)),
b AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, seq) AS n FROM a WHERE ir_type IS DISTINCT FROM pt OR value IS DISTINCT FROM pv)
SELECT conv_id, n - 1 AS sequence, ir_type, value, tokens FROM b WHERE n <= 100"""


@query("compact_ir", "SELECT * FROM compact")
def compact_ir(spark, d):
    return C.compact_ir(units(spark, d))


@query("render_ir", f"""
SELECT conv_id, count(*) AS units, string_agg('[' || ir_type || '] ' || value, chr(10) ORDER BY list_position({S.lst(L.IR_ORDER)}, ir_type), sequence) AS rendered
FROM compact GROUP BY conv_id""")
def render_ir(spark, d):
    return C.render_ir(C.compact_ir(units(spark, d)))
