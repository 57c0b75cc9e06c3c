from pyspark.sql import functions as F

from engramlake.functions import lexicons as L
from engramlake.operators import compression as C
from engramlake.sources import bindings as B
from registry import EXTRA_CTES, query
from registry import snippets as S

# The documents hold invented words, so the markers are letter groups that occur in them.
LEX = C.CompressionLexicon(
    filler="haha|ouou|enen|[*#%]{3,}",
    markers=[["with", "avec", "mit ", "con "], ["from", "pour", "nicht", "para"], ["that", "dans", "auch"], ["when", "sich", "una "]],
    decision=["whst", "tionth", "eaux"],
    reason=["nding", "keitver", "iereau"],
)


def score(x):
    groups = " ".join(f"+ CASE WHEN {S.contains_any(f'lower({x})', g)} THEN 0.2 ELSE 0.0 END" for g in LEX.markers)
    return (f"round(least(0.5 {groups} + least(length({x}) / 200.0, 0.3) + CASE WHEN contains({x}, '?') OR contains({x}, '？') THEN 0.15 ELSE 0.0 END "
            f"+ CASE WHEN {S.contains_any(x, LEX.decision)} THEN 0.25 ELSE 0.0 END, 1.0), 9)")


def compress_cte(source, key):
    light = S.strip(rf"regexp_replace(regexp_replace(regexp_replace(content, '(?i){LEX.filler}', '', 'g'), '\s+', ' ', 'g'), '\s*([、。．，！？])\s*', '\1 ', 'g')")
    dec, rea = S.contains_any("lower(s)", LEX.decision), S.contains_any("lower(s)", LEX.reason)
    return f"""
WITH a AS (SELECT *, {S.sentences('content')} AS ss, {S.sentences(light)} AS ls FROM {source}),
e AS (SELECT {key}, unnest(list_transform(ss, lambda s, i: {{'s': s, 'i': i}})) AS u FROM a),
f AS (SELECT {key}, u.s AS s, u.i AS i, {score('u.s')} AS sc FROM e),
g AS (SELECT *, {dec} AS d, {rea} AS r, row_number() OVER (PARTITION BY {key} ORDER BY sc DESC, i) AS n, count(*) OVER (PARTITION BY {key}) AS c FROM f),
k AS (SELECT DISTINCT {key}, s FROM g WHERE n <= greatest(3, floor(c * 0.4))),
ep AS (SELECT {key}, string_agg(s, ' ' ORDER BY i) AS episode, count(*) AS sentences_kept FROM g JOIN k USING ({key}, s) GROUP BY {key}),
h AS (SELECT *, CASE WHEN d THEN 1 WHEN r THEN 2 WHEN sc > 0.7 THEN 3 END AS cls FROM g),
m AS (SELECT *, row_number() OVER (PARTITION BY {key}, cls ORDER BY i) AS q FROM h WHERE cls IS NOT NULL),
sm AS (SELECT {key}, concat_ws(chr(10), '**decisions:**' || chr(10) || string_agg(s, chr(10) ORDER BY i) FILTER (cls = 1 AND q <= 3),
   chr(10) || '**reasons:**' || chr(10) || string_agg(s, chr(10) ORDER BY i) FILTER (cls = 2 AND q <= 3),
   chr(10) || '**key points:**' || chr(10) || string_agg(s, chr(10) ORDER BY i) FILTER (cls = 3 AND q <= 2)) AS semantic,
   count(*) FILTER (cls = 1) AS decisions_found, count(*) FILTER (cls = 2) AS reasons_found FROM m GROUP BY {key}),
lt AS (SELECT {key}, coalesce(string_agg(s, ' ' ORDER BY n) FILTER (n <= 2 AND sc > 0.6), string_agg(s, ' ' ORDER BY i) FILTER (i = 1 OR i = c)) AS long_term FROM g GROUP BY {key})
SELECT a.*, array_to_string(list_filter(ls, lambda x, i: i = 1 OR x <> ls[i - 1]), ' ') AS light,
  CAST(len(ls) - len(list_filter(ls, lambda x, i: i = 1 OR x <> ls[i - 1])) AS BIGINT) AS sentences_removed, CAST(len(ss) AS BIGINT) AS sentences_total,
  coalesce(episode, '') AS episode, coalesce(sentences_kept, 0) AS sentences_kept, coalesce(semantic, '') AS semantic, coalesce(decisions_found, 0) AS decisions_found,
  coalesce(reasons_found, 0) AS reasons_found, coalesce(long_term, '') AS long_term
FROM a LEFT JOIN ep USING ({key}) LEFT JOIN sm USING ({key}) LEFT JOIN lt USING ({key})"""


EXTRA_CTES["comp"] = compress_cte("mem", "memory_id")
EXTRA_CTES["vers"] = f"""
WITH v AS (SELECT memory_id, memory_type, resolution AS own_resolution, content AS original,
  unnest([{{'r': 1, 'm': 'light', 'c': light}}, {{'r': 2, 'm': 'episode', 'c': episode}}, {{'r': 3, 'm': 'semantic', 'c': semantic}},
          {{'r': 4, 'm': 'long_term', 'c': long_term}}, {{'r': 5, 'm': 'deep_long_term', 'c': long_term}}]) AS v FROM comp WHERE resolution < 4)
SELECT memory_id, memory_type, own_resolution, original, v.r AS resolution, v.m AS method, v.c AS content, {S.tokens('original')} AS original_tokens,
  {S.tokens('v.c')} AS compressed_tokens, {S.tokens('original')} / {S.tokens('v.c')} AS ratio FROM v WHERE v.r > own_resolution"""


def versions(spark, d):
    return C.build_versions(B.memories(spark, d), LEX)


def checked(spark, d):
    return C.validate_versions(C.build_versions(B.memories(spark, d), LEX, rules=True))


@query("sentence_importance", f"""
WITH e AS (SELECT memory_id, unnest(list_transform({S.sentences('content')}, lambda s, i: {{'s': s, 'i': i}})) AS u FROM mem)
SELECT memory_id, CAST(u.i - 1 AS BIGINT) AS pos, u.s AS sentence, round({score('u.s')}, 6) AS importance FROM e""")
def sentence_importance(spark, d):
    return C.sentences(B.memories(spark, d), LEX).withColumn("importance", F.round("importance", 6))


@query("compress_light", "SELECT memory_id, light, sentences_removed FROM comp")
def compress_light(spark, d):
    return C.compress_light(B.memories(spark, d), LEX).select("memory_id", "light", "sentences_removed")


def _form(spark, d, *cols):
    return C.compress_all(B.memories(spark, d), LEX).select("memory_id", *cols)


@query("compress_episode", "SELECT memory_id, episode, sentences_total, sentences_kept FROM comp")
def compress_episode(spark, d):
    return _form(spark, d, "episode", "sentences_total", "sentences_kept")


@query("compress_semantic", "SELECT memory_id, semantic, decisions_found, reasons_found FROM comp")
def compress_semantic(spark, d):
    return _form(spark, d, "semantic", "decisions_found", "reasons_found")


@query("compress_long_term", "SELECT memory_id, long_term FROM comp")
def compress_long_term(spark, d):
    return _form(spark, d, "long_term")


@query("build_versions", "SELECT memory_id, resolution, method, content, original_tokens, compressed_tokens, round(ratio, 6) AS ratio FROM vers")
def build_versions(spark, d):
    return versions(spark, d).select("memory_id", "resolution", "method", "content", "original_tokens", "compressed_tokens", F.round("ratio", 6).alias("ratio"))


@query("compression_stats", """
SELECT method, count(*) AS n, round(avg(ratio), 6) AS avg_ratio, CAST(sum(original_tokens) AS BIGINT) AS original_tokens, CAST(sum(compressed_tokens) AS BIGINT) AS compressed_tokens,
  round((1 - sum(compressed_tokens) / sum(original_tokens)) * 100, 6) AS reduction_pct FROM vers GROUP BY method""")
def compression_stats(spark, d):
    s = C.compression_stats(versions(spark, d))
    return s.withColumn("avg_ratio", F.round("avg_ratio", 6)).withColumn("reduction_pct", F.round("reduction_pct", 6))


_ents = S.entities("original")
_keys = f"list_filter({S.lst(L.VALIDATION_DECISION)}, lambda w: contains(lower(original), w))"
_names = f"list_filter({_ents}, lambda e: e NOT IN ({', '.join(S.q(w) for w in L.ENTITY_STOP_WORDS)}))"
_new = (f"len(list_filter(list_distinct({S.space_words('content')}), lambda w: length(w) > 2 AND w NOT IN ({', '.join(S.q(w) for w in L.VALIDATION_FILLER)})"
        f" AND NOT list_contains(ow, w)))")
EXTRA_CTES["vrules"] = f"""
WITH a AS (SELECT *, {S.space_words('original')} AS ow, {_ents} AS ents, {_keys} AS keys, {_names} AS names FROM vers),
b AS (SELECT *, 1 - length(content) / greatest(length(original), 1) AS trunc,
  CASE WHEN len(ents) > 0 THEN len(list_filter(ents, lambda e: contains(lower(content), lower(e)))) / len(ents) ELSE 1.0 END AS ph,
  CASE WHEN len(keys) > 0 THEN len(list_filter(keys, lambda w: contains(lower(content), w))) / len(keys) ELSE 1.0 END AS de,
  CASE WHEN len(names) > 0 THEN len(list_intersect(names, {S.entities('content')})) / len(names) ELSE 1.0 END AS en, {_new} AS nw, {S.strip('content')} <> '' AS filled FROM a),
r AS (SELECT memory_id, resolution, 'min_ratio' AS rule, CASE WHEN ratio >= 1.2 THEN 'passed' ELSE 'warning' END AS status, least(1.0, ratio / 1.2) AS score FROM b
UNION ALL SELECT memory_id, resolution, 'max_ratio', CASE WHEN ratio <= 20 THEN 'passed' ELSE 'failed' END, CASE WHEN ratio <= 20 THEN 1.0 ELSE greatest(0.0, 1 - (ratio - 20) / 100) END FROM b
UNION ALL SELECT memory_id, resolution, 'not_empty', CASE WHEN filled THEN 'passed' ELSE 'failed' END, CASE WHEN filled THEN 1.0 ELSE 0.0 END FROM b
UNION ALL SELECT memory_id, resolution, 'truncation', CASE WHEN trunc <= 0.8 THEN 'passed' ELSE 'failed' END, greatest(0.0, 1 - trunc) FROM b
UNION ALL SELECT memory_id, resolution, 'semantic', CASE WHEN content = '' OR original = '' THEN 'failed' WHEN ph >= 0.7 THEN 'passed' WHEN ph >= 0.4 THEN 'warning' ELSE 'failed' END,
  CASE WHEN content = '' OR original = '' THEN 0.0 ELSE ph END FROM b
UNION ALL SELECT memory_id, resolution, 'decision', CASE WHEN de >= 0.8 THEN 'passed' WHEN de >= 0.5 THEN 'warning' ELSE 'failed' END, de FROM b WHERE memory_type = 'decision'
UNION ALL SELECT memory_id, resolution, 'entity', CASE WHEN en >= 0.7 THEN 'passed' WHEN en >= 0.4 THEN 'warning' ELSE 'failed' END, en FROM b
UNION ALL SELECT memory_id, resolution, 'new_words', CASE WHEN nw = 0 THEN 'passed' WHEN nw <= 3 THEN 'warning' ELSE 'failed' END,
  CASE WHEN nw = 0 THEN 1.0 WHEN nw <= 3 THEN 0.8 ELSE greatest(0.0, 1 - nw / 10) END FROM b)
SELECT * FROM r"""


@query("validate_versions", "SELECT memory_id, resolution, rule, status, round(score, 6) AS score FROM vrules")
def validate_versions(spark, d):
    return checked(spark, d).withColumn("score", F.round("score", 6))


@query("version_verdicts", """
SELECT memory_id, resolution, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'warning') AS warnings,
  CASE WHEN count(*) FILTER (status = 'failed') > 0 THEN 'failed' WHEN count(*) FILTER (status = 'warning') > 0 THEN 'warning' ELSE 'passed' END AS overall
FROM vrules GROUP BY memory_id, resolution""")
def version_verdicts(spark, d):
    return C.validation_status(checked(spark, d))


@query("expand_to_resolution", """
WITH w AS (SELECT memory_id, resolution AS own, CAST(memory_id % 5 AS INTEGER) AS target FROM mem),
n AS (SELECT w.memory_id, min(v.resolution) AS found, arg_min(v.method, v.resolution) AS method FROM w JOIN vers v ON v.memory_id = w.memory_id AND v.resolution >= w.target GROUP BY w.memory_id)
SELECT memory_id, own, target, method, coalesce(found, own) AS served FROM w LEFT JOIN n USING (memory_id)""")
def expand_to_resolution(spark, d):
    mem = B.memories(spark, d)
    return C.expand(mem, versions(spark, d), F.col("memory_id") % 5)
