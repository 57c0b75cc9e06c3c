from pyspark.sql import functions as F

from engramlake.functions import lexicons as L
from engramlake.functions import text as X
from engramlake.operators import textfeatures as D
from engramlake.sources import bindings as B
from registry import EXTRA_CTES, query
from registry import snippets as S

r6 = lambda df, *cols: df.withColumns({c: F.round(c, 6) for c in cols})


def docs(spark, d):
    return B.spread(B.table(spark, d, "documents"))


EXTRA_CTES["postings"] = f"SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest({S.search_tokens('text')}) AS token FROM documents) GROUP BY doc_id, token"


@query("token_postings", "SELECT doc_id, token, tf FROM postings")
def token_postings(spark, d):
    return D.token_postings(docs(spark, d), "doc_id", "text")


@query("stem_vocabulary", f"""
WITH a AS (SELECT DISTINCT doc_id, unnest({S.words('text')}) AS word FROM documents),
b AS (SELECT *, {S.stem('word', L.IRREGULAR_STEMS)} AS stem FROM a WHERE length(word) >= 3 AND word NOT IN ({', '.join(S.q(w) for w in L.STOP_WORDS)}))
SELECT stem, count(DISTINCT doc_id) AS doc_freq, count(DISTINCT word) AS members, min(word) AS first_member, max(word) AS last_member FROM b GROUP BY stem""")
def stem_vocabulary(spark, d):
    return D.stem_vocabulary(docs(spark, d), "doc_id", "text")


@query("keywords", f"""
WITH a AS (SELECT doc_id, unnest({S.words('text')}) AS word FROM documents),
b AS (SELECT doc_id, word, count(*) AS n FROM a WHERE length(word) >= 3 AND word NOT IN ({', '.join(S.q(w) for w in L.KEYWORD_STOP_WORDS)}) GROUP BY ALL),
c AS (SELECT *, sum(n) OVER (PARTITION BY doc_id) AS total, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, word) AS rank FROM b)
SELECT doc_id, rank, word, round(n / total, 6) AS score FROM c WHERE rank <= 10""")
def keywords(spark, d):
    return r6(D.keywords(docs(spark, d), "doc_id", "text", 10), "score")


def _topics(spark, d):
    """One topic per source, named by its most frequent keywords."""
    words = docs(spark, d).select("source", F.explode(F.filter(X.word_list(F.col("text"), 3), lambda w: ~w.isin(L.KEYWORD_STOP_WORDS))).alias("word"))
    counts = words.groupBy("source", "word").agg(F.count("*").alias("n"))
    from engramlake.operators.skew import top_k

    top = top_k(counts, ["source"], [F.col("n").desc(), F.col("word")], 6)
    return top.groupBy(F.regexp_extract("source", r"(\d+)", 1).cast("long").alias("topic_id")).agg(
        F.max(F.when(F.col("rank") == 6, F.col("word"))).alias("name"),
        F.concat(F.max(F.when(F.col("rank") == 1, F.col("word"))), F.lit("/"), F.max(F.when(F.col("rank") == 6, F.col("word")))).alias("path"),
        F.map_from_entries(F.collect_list(F.when(F.col("rank").between(2, 5), F.struct("word", (1.0 - 0.05 * F.col("rank")).alias("w"))))).alias("category_weights"),
    )


@query("classify_topics", f"""
WITH a AS (SELECT source, unnest({S.words('text')}) AS word FROM documents),
b AS (SELECT source, word, count(*) AS n FROM a WHERE length(word) >= 3 AND word NOT IN ({', '.join(S.q(w) for w in L.KEYWORD_STOP_WORDS)}) GROUP BY ALL),
c AS (SELECT CAST(regexp_extract(source, '(\\d+)', 1) AS BIGINT) AS topic_id, word, row_number() OVER (PARTITION BY source ORDER BY n DESC, word) AS k FROM b QUALIFY k <= 6),
w AS (SELECT topic_id, word, CASE WHEN k = 6 THEN 0.15 WHEN k BETWEEN 2 AND 5 THEN (1.0 - 0.05 * k) * 0.1 ELSE 0.0 END AS weight, k = 6 AS is_name, k IN (1, 6) AS is_path FROM c),
dw AS (SELECT DISTINCT doc_id, unnest({S.words('text')}) AS word FROM documents),
s AS (SELECT doc_id, topic_id, round(least(1.0, sum(weight) + CASE WHEN bool_or(is_name) THEN 0.5 ELSE 0.0 END + CASE WHEN count(*) FILTER (is_path) = 2 THEN 0.3 ELSE 0.0 END), 9) AS score
  FROM dw JOIN w USING (word) GROUP BY ALL)
SELECT doc_id, topic_id, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, topic_id) = 1 AND score >= 0.3""")
def classify_topics(spark, d):
    return r6(D.classify_topics(docs(spark, d), _topics(spark, d), "doc_id", "text"), "score")


# Categories by common words of the four languages of the test text.
CATEGORIES = {"english": ["the", "and", "that", "with"], "french": ["les", "des", "dans", "avec"], "german": ["der", "und", "nicht", "mit"], "spanish": ["los", "para", "una", "con"]}


def _cat_sql(lexicon, text, words):
    rows = []
    for i, (c, kws) in enumerate(lexicon.items()):
        hits = " + ".join(f"CAST(contains(lower({text}), {S.q(k)}) AS BIGINT)" for k in kws)
        rows.append(f"{{'hits': {hits}, 'o': {-i}, 'c': {S.q(c)}, 'w': array_to_string(list_filter({S.lst(kws[:3])}, lambda w: list_contains({words}, w))[1:2], '-')}}")
    return f"list_max([{', '.join(rows)}])"


@query("suggest_category", f"""
WITH a AS (SELECT doc_id, text, {S.words('text')} AS ws FROM documents), b AS (SELECT doc_id, {_cat_sql(CATEGORIES, 'text', 'ws')} AS b FROM a)
SELECT doc_id, CASE WHEN b.hits > 0 THEN b.c ELSE 'general' END AS category, b.hits AS hits,
  CASE WHEN b.hits > 0 AND b.w <> '' THEN b.w WHEN b.hits > 0 THEN b.c ELSE 'general' END AS name FROM b""")
def suggest_category(spark, d):
    return D.suggest_category(docs(spark, d), "doc_id", "text", CATEGORIES)


def _style_sql(src):
    flags = [(e, i, p) for e, ps in L.STYLE_EMOTIONS.items() for i, p in enumerate(ps)]
    fill = lambda ph: " + ".join(f"(len(string_split(pad, {S.q(' ' + p + ' ')})) - 1)" for p in ph)
    parts = f"list_filter(list_transform(string_split_regex(text, '[。！？.!?]'), lambda s: {S.strip('s')}), lambda s: s <> '')"
    return f"""
WITH a AS (SELECT conv_id, role, text, {S.padded('text')} AS pad, {parts} AS ps, {S.words('text')} AS ws FROM {src}),
b AS (SELECT conv_id, role, CAST(sum({fill(L.STYLE_FILLERS)}) AS BIGINT) AS fillers, CAST(sum({fill(L.STYLE_HESITATIONS)}) AS BIGINT) AS hesitations,
  {', '.join(f"max(CAST(regexp_matches(text, {S.q('(?i)' + p)}) AS BIGINT)) AS f_{e}_{i}" for e, i, p in flags)},
  sum(len(ps)) AS sents, sum(length(array_to_string(ps, ''))) AS chars, sum(len(ws)) AS nw FROM a GROUP BY ALL),
v AS (SELECT conv_id, role, count(DISTINCT w) AS nd FROM (SELECT conv_id, role, unnest(ws) AS w FROM a) GROUP BY ALL),
c AS (SELECT b.*, nd, {', '.join(' + '.join(f'f_{e}_{i}' for i in range(len(ps))) + f' AS {e}' for e, ps in L.STYLE_EMOTIONS.items())} FROM b LEFT JOIN v USING (conv_id, role))
SELECT conv_id, role, fillers, hesitations, {', '.join(L.STYLE_EMOTIONS)},
  list_max([{', '.join(f"{{'n': {e}, 'o': {-i}, 'e': '{e}'}}" for i, e in enumerate(L.STYLE_EMOTIONS))}]).e AS tone,
  CASE WHEN polite + casual > 0 THEN polite / (polite + casual) ELSE 0.5 END AS formality,
  CASE WHEN sents > 0 THEN chars / sents ELSE 0.0 END AS avg_sentence_length, CASE WHEN nw > 0 THEN nd / nw ELSE 0.0 END AS vocabulary_richness FROM c"""


EXTRA_CTES["style"] = _style_sql("notes")


@query("style_features", "SELECT * REPLACE (round(formality, 6) AS formality, round(avg_sentence_length, 6) AS avg_sentence_length, round(vocabulary_richness, 6) AS vocabulary_richness) FROM style")
def style_features(spark, d):
    return r6(D.style_features(B.notes(spark, d)), "formality", "avg_sentence_length", "vocabulary_richness")


@query("style_profile", """
WITH a AS (SELECT conv_id // 100 AS speaker_id, conv_id * 2 + CAST(role = 'user' AS INTEGER) AS ord, formality, avg_sentence_length, vocabulary_richness FROM style),
b AS (SELECT *, row_number() OVER (PARTITION BY speaker_id ORDER BY ord DESC) AS age, count(*) OVER (PARTITION BY speaker_id) AS n FROM a),
c AS (SELECT *, CASE WHEN age = n THEN pow(0.5, n - 1) ELSE pow(0.5, age) END AS w FROM b)
SELECT speaker_id, n, round(sum(formality * w), 6) AS formality, round(sum(avg_sentence_length * w), 6) AS avg_sentence_length, round(sum(vocabulary_richness * w), 6) AS vocabulary_richness
FROM c GROUP BY speaker_id, n""")
def style_profile(spark, d):
    s = D.style_features(B.notes(spark, d)).withColumn("speaker_id", F.expr("conv_id div 100")).withColumn("ord", F.expr("conv_id * 2 + int(role = 'user')"))
    vals = ["formality", "avg_sentence_length", "vocabulary_richness"]
    return r6(D.style_profile(s, "speaker_id", "ord", vals), *vals)


_roles = "|".join(L.PERSONA_ROLES)


def _dom(x):
    rows = [f"{{'n': {' + '.join(f'CAST(contains({x}, {S.q(k)}) AS BIGINT)' for k in kws)}, 'o': {-i}, 'd': {S.q(c)}}}" for i, (c, kws) in enumerate(L.PERSONA_DOMAINS.items())]
    m = f"list_max([{', '.join(rows)}])"
    return f"CASE WHEN {m}.n > 0 THEN {m}.d ELSE 'general' END"


EXTRA_CTES["persona"] = rf"""
WITH a AS (SELECT speaker, message_id, created_at, lower(text) AS t FROM notes WHERE role = 'user'),
b AS (SELECT *, '(?:^|[^a-z0-9_])as\s+an?\s+([a-z0-9_\s-]+?)\s+({_roles})(?:[^a-z0-9_]|$)' AS rp, '(?:^|[^a-z0-9_])i\s+(?:really\s+)?(?:prefer|love|like|enjoy|favorite)\s+([^.,;!?]+)' AS pp FROM a),
c AS (SELECT *, CASE WHEN regexp_matches(t, '(?:^|[^a-z0-9_])as\s+an?\s+([a-z0-9_\s-]+?)\s+({_roles})(?:[^a-z0-9_]|$)')
  THEN trim(regexp_extract(t, '(?:^|[^a-z0-9_])as\s+an?\s+([a-z0-9_\s-]+?)\s+({_roles})(?:[^a-z0-9_]|$)', 1)) || ' ' || regexp_extract(t, '(?:^|[^a-z0-9_])as\s+an?\s+([a-z0-9_\s-]+?)\s+({_roles})(?:[^a-z0-9_]|$)', 2) END AS r,
  trim(regexp_extract(t, '(?:^|[^a-z0-9_])i\s+(?:really\s+)?(?:prefer|love|like|enjoy|favorite)\s+([^.,;!?]+)', 1)) AS p FROM b)
SELECT speaker, message_id, created_at, 'role_identity' AS attribute, r AS value, {_dom("(r || ' ' || t)")} AS domain FROM c WHERE r IS NOT NULL
UNION ALL SELECT speaker, message_id, created_at, 'preference', p, {_dom('p')} FROM c WHERE length(p) > 3 AND NOT ({' OR '.join(f"starts_with(p, {S.q(v)})" for v in L.PERSONA_VAGUE)})"""


@query("persona_attributes", "SELECT speaker, message_id, attribute, value, domain FROM persona")
def persona_attributes(spark, d):
    return D.persona_attributes(B.notes(spark, d)).drop("created_at")


@query("persona_profile", f"""
WITH v AS (SELECT speaker, domain, attribute, value, count(*) AS mentions, max(created_at) AS last_seen FROM persona GROUP BY ALL)
SELECT speaker, domain, attribute, value, mentions, {S.fmt('last_seen')} AS last_seen, count(*) OVER w AS distinct_values, last_seen = max(last_seen) OVER w AS is_latest
FROM v WINDOW w AS (PARTITION BY speaker, domain, attribute)""")
def persona_profile(spark, d):
    return D.persona_profile(D.persona_attributes(B.notes(spark, d))).withColumn("last_seen", F.date_format("last_seen", "yyyy-MM-dd HH:mm:ss"))


_D = "CAST(created_at AS DATE)"
_day = lambda x: f"strftime({x}, '%-d %B %Y')"
_mon = lambda k: f"strftime({_D} + INTERVAL ({k}) MONTH, '%B %Y')"


def _norm_sql():
    sep = chr(2)
    steps = []

    def rule(phrase, note):
        pat = phrase.replace(" ", f"{sep} {sep}")
        return lambda t: f"regexp_replace({t}, '(?i)(^|{sep}){pat}({sep}|$)', '\\1{pat} (' || {note} || ')\\2', 'g')"

    def counts(unit, days):
        # The templates write at most one such phrase per text, so one replacement is enough.
        pat = f"(^|{sep})(\\d{{1,4}}){sep} {sep}{unit}s?{sep} {sep}ago({sep}|$)"
        n = lambda t: f"CAST(nullif(regexp_extract({t}, '(?i){pat}', 2), '') AS INTEGER)"
        return lambda t: (f"(SELECT CASE WHEN {n('x')} IS NULL THEN x ELSE regexp_replace(x, '(?i){pat}', '\\1\\2 {unit}s ago (' || {_day(f'{_D} - {n(chr(120))} * {days}')} || ')\\3') END FROM (SELECT {t} AS x))")

    steps += [rule("the day before yesterday", _day(f"{_D} - 2")), rule("yesterday", _day(f"{_D} - 1")), rule("tomorrow", _day(f"{_D} + 1")),
              rule("last year", f"CAST(year({_D}) - 1 AS VARCHAR)"), rule("last month", _mon(-1)), counts("day", 1), counts("week", 7),
              rule("last week", f"'the week before ' || {_day(_D)}"), rule("last weekend", f"'the weekend before ' || {_day(_D)}")]
    for name, forms in D.WEEKDAYS:
        steps.append(lambda t, name=name, forms=forms: f"regexp_replace({t}, '(?i)(^|{sep})last{sep} {sep}(?:{forms})({sep}|$)', '\\1last {name} (the {name} before ' || {_day(_D)} || ')\\2', 'g')")
    steps += [rule("this month", _mon(0)), rule("next month", _mon(1)), rule("two days ago", _day(f"{_D} - 2"))]
    ctes = [f"t0 AS (SELECT message_id, created_at, regexp_replace(text, '([^\\p{{L}}\\p{{N}}_])', '{sep}\\1{sep}', 'g') AS t FROM notes)"]
    for i, st in enumerate(steps):
        ctes.append(f"t{i + 1} AS (SELECT message_id, created_at, {st('t')} AS t FROM t{i})")
    return "WITH " + ",\n".join(ctes) + f" SELECT message_id, replace(t, '{sep}', '') AS dated_text FROM t{len(steps)}"


@query("normalise_dates", _norm_sql())
def normalise_dates(spark, d):
    return D.normalise_dates(B.notes(spark, d), "text", "created_at").select("message_id", "dated_text")


def _anchor_sql(pad):
    has = lambda *p: S.has_phrase(pad, p)
    nums = "|".join(L.NUMBER_WORDS)
    dur = rf" (\d{{1,4}}|{nums}) (day|week|month|year)s? (?:ago|now) "
    raw, unit = f"regexp_extract({pad}, '{dur}', 1)", f"regexp_extract({pad}, '{dur}', 2)"
    n = f"coalesce(CASE {raw} {' '.join(f'WHEN {S.q(k)} THEN {v}' for k, v in L.NUMBER_WORDS.items())} END, try_cast({raw} AS INTEGER))"
    before = lambda name: f"'The {name} before ' || {_day(_D)}"
    days = " ".join(f"WHEN regexp_matches({pad}, ' last (?:{f}) ') THEN {before(name)}" for name, f in D.WEEKDAYS)
    return f"""CASE WHEN {has('the day before yesterday')} THEN {_day(f'{_D} - 2')} WHEN {has('yesterday', 'last night')} THEN {_day(f'{_D} - 1')} WHEN {has('tomorrow')} THEN {_day(f'{_D} + 1')}
  WHEN {has('last year')} THEN CAST(year({_D}) - 1 AS VARCHAR) WHEN {has('next year')} THEN CAST(year({_D}) + 1 AS VARCHAR)
  WHEN regexp_matches({pad}, '{dur}') THEN CASE {unit} WHEN 'day' THEN {_day(f'{_D} - {n}')} WHEN 'week' THEN CASE WHEN {n} = 1 THEN {before('week')} ELSE {n} || ' weeks before ' || {_day(_D)} END
     WHEN 'month' THEN strftime({_D} - to_months({n}), '%B %Y') ELSE 'Since ' || (year({_D}) - {n}) END
  WHEN {has('two weekend', 'two weekends')} THEN 'two weekends before ' || {_day(_D)} WHEN {has('last weekend', 'past weekend')} THEN {before('weekend')}
  WHEN {has('last week')} THEN {before('week')} WHEN {has('this week')} THEN 'The week of ' || {_day(_D)} {days}
  WHEN {has('next month')} THEN {_mon(1)} WHEN {has('last month')} THEN {_mon(-1)} WHEN {has('this month')} THEN {_mon(0)} END"""


EXTRA_CTES["anch"] = f"WITH a AS (SELECT *, {S.padded('text')} AS pad FROM notes) SELECT * EXCLUDE (pad), {_anchor_sql('pad')} AS anchored_date FROM a"


@query("anchor_expression", "SELECT message_id, anchored_date FROM anch")
def anchor_expression(spark, d):
    return D.anchor_expression(B.notes(spark, d), "text", "created_at").select("message_id", "anchored_date")


_flat = r"regexp_replace(replace(mention, ',', ''), '\s+', ' ', 'g')"
_short = rf"regexp_replace({_flat}, '([A-Za-z]{{3}})[A-Za-z]*', '\1', 'g')"
EXTRA_CTES["mentions"] = rf"""
WITH a AS (SELECT message_id, speaker, unnest(list_transform(regexp_extract_all(text, '{D.MENTION}', 1), lambda m, i: {{'m': m, 'i': i - 1}})) AS u FROM notes),
b AS (SELECT message_id, speaker, CAST(u.i AS BIGINT) AS pos, u.m AS mention FROM a),
c AS (SELECT *, CAST(coalesce(try_strptime(replace({_flat}, '/', '-'), '%Y-%m-%d'), try_strptime({_short}, '%d %b %Y'), try_strptime({_short}, '%b %d %Y')) AS DATE) AS mention_date FROM b)
SELECT * FROM c WHERE mention_date IS NOT NULL"""


@query("date_mentions", "SELECT message_id, pos, mention, CAST(mention_date AS VARCHAR) AS mention_date FROM mentions")
def date_mentions(spark, d):
    return D.date_mentions(B.notes(spark, d), "message_id", "text").withColumn("mention_date", F.col("mention_date").cast("string"))


@query("event_gaps", """
WITH a AS (SELECT speaker, min(mention_date) AS first_date, max(mention_date) AS last_date FROM mentions GROUP BY speaker),
b AS (SELECT *, date_diff('day', first_date, last_date) AS g, abs((year(last_date) - year(first_date)) * 12 + month(last_date) - month(first_date)) AS m FROM a)
SELECT speaker, CAST(first_date AS VARCHAR) AS first_date, CAST(last_date AS VARCHAR) AS last_date, g AS gap_days, CAST(round_even(g / 7.0, 0) AS BIGINT) AS gap_weeks,
  CASE WHEN m > 0 THEN CAST(m AS BIGINT) ELSE greatest(1, CAST(round_even(g / 30.0, 0) AS BIGINT)) END AS gap_months FROM b""")
def event_gaps(spark, d):
    n = B.notes(spark, d)
    m = D.date_mentions(n, "message_id", "text").join(n.select("message_id", "speaker"), "message_id")
    pairs = m.groupBy("speaker").agg(F.min("mention_date").alias("first_date"), F.max("mention_date").alias("last_date"))
    g = D.event_gaps(pairs, "first_date", "last_date")
    return g.withColumn("first_date", F.col("first_date").cast("string")).withColumn("last_date", F.col("last_date").cast("string"))


def bigram_sql(x):
    bad = f"IN ({', '.join(S.q(w) for w in L.PHRASE_STOP_WORDS)})"
    return (f"list_distinct(list_filter(list_transform({x}, lambda w, i: CASE WHEN i < len({x}) AND length(w) > 2 AND w NOT {bad} AND length({x}[i + 1]) > 2 AND {x}[i + 1] NOT {bad} "
            f"THEN w || ' ' || {x}[i + 1] END), lambda b: b IS NOT NULL))")


@query("bigram_counts", f"""
WITH a AS (SELECT doc_id, {S.words('text')} AS ws FROM documents), b AS (SELECT unnest({bigram_sql('ws')}) AS bigram FROM a)
SELECT bigram, count(*) AS doc_freq FROM b GROUP BY bigram""")
def bigram_counts(spark, d):
    return D.bigram_counts(docs(spark, d), "text")


def _pii_sql(table, key, text):
    ctes, prev = [], f"(SELECT {key}, {text} AS t FROM {table})"
    for i, (n, p, m) in enumerate(D.PII):
        ctes.append(f"p{i} AS (SELECT * EXCLUDE (t), CAST(len(regexp_extract_all(t, '{p}')) AS BIGINT) AS {n}_hits, regexp_replace(t, '{p}', '{m}', 'g') AS t FROM {prev})")
        prev = f"p{i}"
    return "WITH " + ", ".join(ctes), prev


@query("mask_pii", "{0} SELECT doc_id, ssn_hits, card_hits, email_hits, ip_hits, t AS text FROM {1}".format(*_pii_sql("documents", "doc_id", "text")))
def mask_pii(spark, d):
    return D.mask_pii(docs(spark, d).select("doc_id", "text"), "text")


@query("mask_pii_pages", "{0} SELECT page_id, ssn_hits, card_hits, email_hits, ip_hits, t AS html FROM {1}".format(*_pii_sql("pages", "page_id", "html")))
def mask_pii_pages(spark, d):
    return D.mask_pii(B.spread(B.table(spark, d, "pages")).select("page_id", "html"), "html")


@query("pii_by_source", "{0} SELECT source, CAST(sum(ssn_hits) AS BIGINT) AS ssn_hits, CAST(sum(card_hits) AS BIGINT) AS card_hits, CAST(sum(email_hits) AS BIGINT) AS email_hits, CAST(sum(ip_hits) AS BIGINT) AS ip_hits, count(*) AS texts FROM {1} GROUP BY source".format(*_pii_sql("documents", "source", "text")))
def pii_by_source(spark, d):
    return D.pii_by_source(docs(spark, d), "text", "source")


def abstain_sql(x):
    form = rf"trim(regexp_replace(lower({x}), '\s+', ' ', 'g'))"
    return "(" + " OR ".join(f"regexp_matches({form}, {S.q(f'(?:^|{S.NW}){m}(?:{S.NW}|$)')})" for m in L.ABSTENTION_MARKERS) + ")"


@query("abstention_rate", f"""
SELECT speaker, count(*) AS answers, count(*) FILTER ({abstain_sql('text')}) AS abstained, round(avg(CAST({abstain_sql('text')} AS INTEGER)), 6) AS abstention_rate FROM notes GROUP BY speaker""")
def abstention_rate(spark, d):
    return r6(D.abstention_rate(B.notes(spark, d), "text", "speaker"), "abstention_rate")


def _intent_sql(rules, x, default, recall=False):
    cases = []
    for name, words in rules:
        cond = "(" + " OR ".join(f"regexp_matches({x}, {S.q(w)})" if w.startswith("^") else f"contains({x}, {S.q(w)})" for w in words) + ")"
        if recall and name == "aggregation":
            cases.append(f"WHEN {cond} AND {S.contains_any(x, L.RECALL_PHRASES)} THEN 'state'")
        cases.append(f"WHEN {cond} THEN '{name}'")
    return f"CASE {' '.join(cases)} ELSE '{default}' END"


_btw = r"between\s+(.*?)\s+and\s+(.*?)(?:\?|$)"
EXTRA_CTES["planned"] = rf"""
WITH a AS (SELECT message_id, trim(lower(text)) AS t FROM notes)
SELECT message_id, {_intent_sql(L.PLANNER_RULES, 't', 'fact_lookup')} AS planner_intent, {_intent_sql(L.INTENT_RULES, 't', 'state', True)} AS state_intent,
  array_to_string(list_distinct(regexp_extract_all(t, '([a-z0-9_-]+)''s(?:[^a-z0-9_]|$)', 1)), ',') AS possessives,
  CASE WHEN regexp_matches(t, '{_btw}') THEN trim(regexp_extract(t, '{_btw}', 1)) END AS sub_a, CASE WHEN regexp_matches(t, '{_btw}') THEN trim(regexp_extract(t, '{_btw}', 2)) END AS sub_b FROM a"""


@query("plan_queries", "SELECT * FROM planned")
def plan_queries(spark, d):
    return D.plan_queries(B.notes(spark, d).select("message_id", "text")).drop("text")


@query("intent_counts", "SELECT planner_intent, state_intent, count(*) AS queries FROM planned GROUP BY ALL")
def intent_counts(spark, d):
    return D.intent_counts(D.plan_queries(B.notes(spark, d).select("message_id", "text")))


_sig = rf"array_to_string(list_filter(list_transform({S.space_words('text')}, lambda w: regexp_replace(w, '[^\p{{L}}\p{{N}}]', '', 'g')), lambda w: w <> ''), ' ')"


@query("query_families", f"""
WITH a AS (SELECT message_id AS query_id, text, {_sig} AS signature FROM notes),
b AS (SELECT *, min(query_id) OVER (PARTITION BY signature) AS leader, arg_min(text, query_id) OVER (PARTITION BY signature) AS lt, count(*) OVER (PARTITION BY signature) AS family_size FROM a)
SELECT query_id, signature, leader, family_size, CASE WHEN query_id = leader THEN 'FULL' WHEN text = lt THEN 'REUSE' ELSE 'REINDEX' END AS plan FROM b""")
def query_families(spark, d):
    return D.query_families(B.notes(spark, d).select(F.col("message_id").alias("query_id"), "text"))


@query("evaluate_by_family", f"""
WITH a AS (SELECT message_id AS query_id, text, {_sig} AS signature FROM notes),
b AS (SELECT *, min(query_id) OVER (PARTITION BY signature) AS leader, arg_min(text, query_id) OVER (PARTITION BY signature) AS lt FROM a),
f AS (SELECT entity, count(*) AS facts FROM facts GROUP BY entity),
e AS (SELECT query_id AS leader, facts FROM b JOIN f ON entity = 'user_' || regexp_extract(text, 'User U(\\d+)', 1) WHERE query_id = leader)
SELECT query_id, CASE WHEN query_id = b.leader THEN 'FULL' WHEN text = lt THEN 'REUSE' ELSE 'REINDEX' END AS plan, facts FROM b JOIN e ON b.leader = e.leader""")
def evaluate_by_family(spark, d):
    f = B.facts(spark, d).groupBy("entity").agg(F.count("*").alias("facts"))
    ask = lambda q: q.select("query_id", F.concat(F.lit("user_"), F.regexp_extract("text", r"User U(\d+)", 1)).alias("entity")).join(f, "entity").drop("entity")
    return D.evaluate_by_family(B.notes(spark, d).select(F.col("message_id").alias("query_id"), "text"), ask)
