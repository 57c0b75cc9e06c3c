"""Text, date and topic feature jobs over whole tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from engramlake.functions import lexicons as L
from engramlake.functions import text as X
from engramlake.operators import skew


def token_postings(df: DataFrame, key: str, text: str) -> DataFrame:
    """Term frequencies per document; a document sits in one task, so the partial count is already final."""
    return df.select(key, F.explode(X.search_tokens(F.col(text))).alias("token")).groupBy(key, "token").agg(F.count("*").alias("tf"))


def stem_vocabulary(df: DataFrame, key: str, text: str, stop=L.STOP_WORDS, irregular=L.IRREGULAR_STEMS) -> DataFrame:
    """Document and member counts of each stem.

    Words are stemmed once per distinct (document, word), and pairs are made unique before the count,
    so no stem gathers its documents in one task.
    """
    words = df.select(key, F.explode(X.word_set(F.col(text), 3)).alias("word")).filter(~F.col("word").isin(stop))
    words = words.withColumn("stem", X.stem(F.col("word"), irregular))
    docs = words.select(key, "stem").distinct().groupBy("stem").agg(F.count("*").alias("doc_freq"))
    members = words.select("stem", "word").distinct().groupBy("stem").agg(
        F.count("*").alias("members"), F.min("word").alias("first_member"), F.max("word").alias("last_member"))
    return docs.join(members, "stem")


def keywords(df: DataFrame, key: str, text: str, n: int = 10, stop=L.KEYWORD_STOP_WORDS) -> DataFrame:
    words = df.select(key, F.explode(F.filter(X.word_list(F.col(text), 3), lambda w: ~w.isin(stop))).alias("word"))
    counts = words.groupBy(key, "word").agg(F.count("*").alias("n"))
    total = counts.groupBy(key).agg(F.sum("n").alias("total"))
    top = skew.top_k(counts, [key], [F.col("n").desc(), F.col("word")], n)
    return top.join(total, key).select(key, "rank", "word", (F.col("n") / F.col("total")).alias("score"))


def classify_topics(df: DataFrame, topics: DataFrame, key: str, text: str, threshold: float = 0.3) -> DataFrame:
    """Best topic per text.

    Topics (topic_id, name, path, category words) become rows of weighted words, and only topics that
    share a word with a text are scored: an equi-join, never all pairs.
    """
    parts = topics.select("topic_id", X.word_set(F.col("name")).alias("nw"), X.word_set(F.col("path")).alias("pw"), "category_weights")
    need = parts.select("topic_id", F.size("nw").alias("n_name"), F.size("pw").alias("n_path"))
    rows = F.concat(
        F.transform("nw", lambda w: F.struct(w.alias("word"), F.lit("name").alias("kind"), F.lit(0.15).alias("weight"))),
        F.transform("pw", lambda w: F.struct(w.alias("word"), F.lit("path").alias("kind"), F.lit(0.0).alias("weight"))),
        F.transform(F.map_entries("category_weights"), lambda e: F.struct(e["key"].alias("word"), F.lit("category").alias("kind"), (e["value"] * 0.1).alias("weight"))),
    )
    words = parts.select("topic_id", F.explode(rows).alias("r")).select("topic_id", "r.*")
    mine = df.select(key, F.explode(X.word_set(F.col(text))).alias("word"))
    hit = mine.join(words, "word").groupBy(key, "topic_id").agg(
        F.sum("weight").alias("w"), F.count_if(F.col("kind") == "name").alias("hn"), F.count_if(F.col("kind") == "path").alias("hp"))
    scored = hit.join(need, "topic_id").select(
        key, "topic_id",
        F.round(F.least(F.lit(1.0), F.col("w") + F.when(F.col("hn") == F.col("n_name"), 0.5).otherwise(0.0) + F.when(F.col("hp") == F.col("n_path"), 0.3).otherwise(0.0)), 9).alias("score"),
    )
    best = skew.latest_rows(scored, [key], [F.col("score"), -F.col("topic_id")])
    return best.filter(F.col("score") >= threshold)


def suggest_category(df: DataFrame, key: str, text: str, lexicon: dict[str, list[str]]) -> DataFrame:
    """Category with most keyword hits and a name from its first two hit words; inside the row."""
    low = F.lower(text)
    scored = F.array(*[
        F.struct(X.count_true(*[low.contains(k) for k in kws]).alias("hits"), F.lit(-i).alias("order"), F.lit(cat).alias("category"),
                 F.slice(F.filter(F.array(*[F.lit(k) for k in kws[:3]]), lambda w: F.array_contains(F.col("_w"), w)), 1, 2).alias("words"))
        for i, (cat, kws) in enumerate(lexicon.items())
    ])
    best = df.withColumn("_w", X.word_set(F.col(text))).select(key, F.array_max(scored).alias("b"))
    found = F.col("b.hits") > 0
    name = F.when(found & (F.size("b.words") > 0), F.array_join("b.words", "-")).when(found, F.col("b.category")).otherwise(F.lit("general"))
    return best.select(key, F.when(found, F.col("b.category")).otherwise(F.lit("general")).alias("category"), F.col("b.hits").cast("long").alias("hits"), name.alias("name"))


def style_features(msg: DataFrame, fillers=L.STYLE_FILLERS, hesitations=L.STYLE_HESITATIONS, emotions=L.STYLE_EMOTIONS) -> DataFrame:
    """Style counts per conversation and role; turns are reduced to numbers before the shuffle."""
    pad = F.col("_pad")
    parts = F.filter(F.transform(F.split("text", "[。！？.!?]"), X.strip), lambda s: s != "")
    base = msg.withColumn("_pad", X.padded(F.col("text"))).withColumn("_s", parts)
    hits = lambda phrases: sum((F.size(F.split(pad, f" {p} ")) - 1 for p in phrases), F.lit(0))
    flags = [F.col("text").rlike(f"(?i){p}").cast("int").alias(f"{e}_{i}") for e, ps in emotions.items() for i, p in enumerate(ps)]
    rows = base.select(
        "conv_id", "role", hits(fillers).alias("fillers"), hits(hesitations).alias("hesitations"), *flags,
        F.size("_s").alias("sents"), F.aggregate("_s", F.lit(0), lambda a, s: a + F.length(s)).alias("chars"), X.word_list(F.col("text")).alias("words"))
    sums = rows.groupBy("conv_id", "role").agg(
        F.sum("fillers").alias("fillers"), F.sum("hesitations").alias("hesitations"),
        *[F.max(f"{e}_{i}").alias(f"{e}_{i}") for e, ps in emotions.items() for i in range(len(ps))],
        F.sum("sents").alias("sents"), F.sum("chars").alias("chars"), F.sum(F.size("words")).alias("n_words"))
    vocab = skew.salted_distinct_count(rows.select("conv_id", "role", F.explode("words").alias("word")), ["conv_id", "role"], "word", "n_distinct")
    for e, ps in emotions.items():
        sums = sums.withColumn(e, sum((F.col(f"{e}_{i}") for i in range(len(ps))), F.lit(0)).cast("long"))
    names = list(emotions)
    tone = F.array_max(F.array(*[F.struct(F.col(e).alias("n"), F.lit(-i).alias("o"), F.lit(e).alias("e")) for i, e in enumerate(names)]))["e"]
    polite, total = F.col("polite"), F.col("polite") + F.col("casual")
    return sums.join(vocab, ["conv_id", "role"], "left").select(
        "conv_id", "role", "fillers", "hesitations", *names, tone.alias("tone"),
        F.when(total > 0, polite / total).otherwise(F.lit(0.5)).alias("formality"),
        F.when(F.col("sents") > 0, F.col("chars") / F.col("sents")).otherwise(F.lit(0.0)).alias("avg_sentence_length"),
        F.when(F.col("n_words") > 0, F.col("n_distinct") / F.col("n_words")).otherwise(F.lit(0.0)).alias("vocabulary_richness"),
    )


def style_profile(style: DataFrame, group: str, order: str, values: list[str]) -> DataFrame:
    """Successive half-and-half merges in closed form: weight 0.5^age, the oldest row keeps the last remainder.

    Weights below 2^-1074 are zero in double arithmetic, so rows of an age beyond 1080 cannot change
    the result and the rank limit is exact.
    """
    top = skew.top_k(style, [group], [F.col(order).desc()], 1080, "age")
    n = style.groupBy(group).agg(F.count("*").alias("n"))
    w = F.when(F.col("age") == F.col("n"), F.pow(F.lit(0.5), F.col("n") - 1)).otherwise(F.pow(F.lit(0.5), F.col("age")))
    return top.join(n, group).groupBy(group, "n").agg(*[F.sum(F.col(v) * w).alias(v) for v in values])


def _domain(text: Column, domains: dict[str, list[str]]) -> Column:
    scored = F.array(*[F.struct(X.count_true(*[text.contains(k) for k in kws]).alias("n"), F.lit(-i).alias("o"), F.lit(d).alias("d")) for i, (d, kws) in enumerate(domains.items())])
    best = F.array_max(scored)
    return F.when(best["n"] > 0, best["d"]).otherwise(F.lit("general"))


def persona_attributes(msg: DataFrame, domains: dict[str, list[str]] = L.PERSONA_DOMAINS, speaker: str = "speaker") -> DataFrame:
    """Role and preference statements of user turns with the domain of most keyword hits."""
    low = F.lower("text")
    role_pat = r"(?:^|[^a-z0-9_])as\s+an?\s+([a-z0-9_\s-]+?)\s+(" + "|".join(L.PERSONA_ROLES) + r")(?:[^a-z0-9_]|$)"
    pref_pat = r"(?:^|[^a-z0-9_])i\s+(?:really\s+)?(?:prefer|love|like|enjoy|favorite)\s+([^.,;!?]+)"
    role = F.when(low.rlike(role_pat), F.concat(F.trim(F.regexp_extract(low, role_pat, 1)), F.lit(" "), F.regexp_extract(low, role_pat, 2)))
    pref = F.trim(F.regexp_extract(low, pref_pat, 1))
    vague = F.lit(False)
    for v in L.PERSONA_VAGUE:
        vague = vague | pref.startswith(v)
    pref = F.when((F.length(pref) > 3) & ~vague, pref)
    found = F.array_compact(F.array(
        F.when(role.isNotNull(), F.struct(F.lit("role_identity").alias("attribute"), role.alias("value"), _domain(F.concat(role, F.lit(" "), low), domains).alias("domain"))),
        F.when(pref.isNotNull(), F.struct(F.lit("preference").alias("attribute"), pref.alias("value"), _domain(pref, domains).alias("domain"))),
    ))
    users = msg.filter(F.col("role") == "user")
    return users.select(F.col(speaker).alias("speaker"), "message_id", "created_at", F.explode(found).alias("a")).select("speaker", "message_id", "created_at", "a.*")


def persona_profile(attrs: DataFrame) -> DataFrame:
    """Distinct values per speaker, domain and attribute with counts, last mention and a latest flag (long form, nothing collected)."""
    keys = ["speaker", "domain", "attribute"]
    values = attrs.groupBy(*keys, "value").agg(F.count("*").alias("mentions"), F.max(F.struct("created_at", "message_id")).alias("last"))
    latest = values.groupBy(*keys).agg(F.max("last").alias("newest"), F.count("*").alias("distinct_values"))
    return values.join(latest, keys).select(*keys, "value", "mentions", F.col("last.created_at").alias("last_seen"), "distinct_values", (F.col("last") == F.col("newest")).alias("is_latest"))


_B, _E = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
WEEKDAYS = [("Monday", "monday|mon"), ("Tuesday", "tuesday|tues|tue"), ("Wednesday", "wednesday|weds|wed"), ("Thursday", "thursday|thurs|thur|thu"),
            ("Friday", "friday|fri"), ("Saturday", "saturday|sat"), ("Sunday", "sunday|sun")]


def _replace_counts(text: Column, pattern: str, unit: str, days: int, ref: Column) -> Column:
    """Rewrite every "N <unit> ago" with its own date: pieces between the hits and the dated hits, zipped again."""
    pieces = F.split(text, pattern)
    counts = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    dated = F.transform(counts, lambda c: F.concat(c, F.lit(f" {unit} ago ("), X.day_text(F.date_sub(ref, (c.cast("int") * days))), F.lit(")")))
    return F.when(text.rlike(pattern), F.array_join(F.zip_with(pieces, dated, lambda p, d: F.concat(p, F.coalesce(d, F.lit("")))), "")).otherwise(text)


def normalise_dates(df: DataFrame, text: str, ref: str, out: str = "dated_text") -> DataFrame:
    """Write the calendar date behind each relative date expression."""
    day = F.to_date(ref)
    t = F.col(text)

    def rule(t, phrase, note):
        return F.regexp_replace(t, F.lit(f"(?i){_B}{phrase}{_E}"), F.concat(F.lit(f"{phrase} ("), note, F.lit(")")))

    month = lambda n: F.date_format(F.add_months(day, n), "MMMM yyyy")
    t = rule(t, "the day before yesterday", X.day_text(F.date_sub(day, 2)))
    t = rule(t, "yesterday", X.day_text(F.date_sub(day, 1)))
    t = rule(t, "tomorrow", X.day_text(F.date_add(day, 1)))
    t = rule(t, "last year", (F.year(day) - 1).cast("string"))
    t = rule(t, "last month", month(-1))
    t = _replace_counts(t, rf"(?i){_B}(\d{{1,4}})\s+days?\s+ago{_E}", "days", 1, day)
    t = _replace_counts(t, rf"(?i){_B}(\d{{1,4}})\s+weeks?\s+ago{_E}", "weeks", 7, day)
    t = rule(t, "last week", F.concat(F.lit("the week before "), X.day_text(day)))
    t = rule(t, "last weekend", F.concat(F.lit("the weekend before "), X.day_text(day)))
    for name, forms in WEEKDAYS:
        t = F.regexp_replace(t, F.lit(rf"(?i){_B}last\s+(?:{forms}){_E}"), F.concat(F.lit(f"last {name} (the {name} before "), X.day_text(day), F.lit(")")))
    t = rule(t, "this month", month(0))
    t = rule(t, "next month", month(1))
    t = rule(t, "two days ago", X.day_text(F.date_sub(day, 2)))
    return df.withColumn(out, t)


def anchored(text: Column, ref: Column) -> Column:
    """Date or interval text of the most specific relative expression, null where there is none."""
    day, low = F.to_date(ref), X.padded(text)
    has = lambda *p: X.has_phrase(low, p)
    nums = "|".join(L.NUMBER_WORDS)
    dur = rf" (\d{{1,4}}|{nums}) (day|week|month|year)s? (?:ago|now) "
    words = F.create_map(*[F.lit(x) for kv in L.NUMBER_WORDS.items() for x in kv])
    raw, unit = F.regexp_extract(low, dur, 1), F.regexp_extract(low, dur, 2)
    n = F.coalesce(F.try_element_at(words, raw), F.expr("1") * raw.try_cast("int"))
    lapse = (
        F.when(unit == "day", X.day_text(F.date_sub(day, n)))
        .when((unit == "week") & (n == 1), F.concat(F.lit("The week before "), X.day_text(day)))
        .when(unit == "week", F.concat(n.cast("string"), F.lit(" weeks before "), X.day_text(day)))
        .when(unit == "month", F.date_format(F.add_months(day, -n), "MMMM yyyy"))
        .when(unit == "year", F.concat(F.lit("Since "), (F.year(day) - n).cast("string")))
    )
    before = lambda name: F.concat(F.lit(f"The {name} before "), X.day_text(day))
    month = lambda k: F.date_format(F.add_months(day, k), "MMMM yyyy")
    expr = (
        F.when(has("the day before yesterday"), X.day_text(F.date_sub(day, 2)))
        .when(has("yesterday", "last night"), X.day_text(F.date_sub(day, 1)))
        .when(has("tomorrow"), X.day_text(F.date_add(day, 1)))
        .when(has("last year"), (F.year(day) - 1).cast("string"))
        .when(has("next year"), (F.year(day) + 1).cast("string"))
        .when(low.rlike(dur), lapse)
        .when(has("two weekend", "two weekends"), F.concat(F.lit("two weekends before "), X.day_text(day)))
        .when(has("last weekend", "past weekend"), before("weekend"))
        .when(has("last week"), before("week"))
        .when(has("this week"), F.concat(F.lit("The week of "), X.day_text(day)))
    )
    for name, forms in WEEKDAYS:
        expr = expr.when(low.rlike(f" last (?:{forms}) "), before(name))
    return expr.when(has("next month"), month(1)).when(has("last month"), month(-1)).when(has("this month"), month(0))


def anchor_expression(df: DataFrame, text: str, ref: str) -> DataFrame:
    return df.withColumn("anchored_date", anchored(F.col(text), F.col(ref)))


MENTION = r"(\d{4}[/-]\d{1,2}[/-]\d{1,2}|\d{1,2}\s+[A-Za-z]+,?\s+\d{4}|[A-Za-z]+\s+\d{1,2},?\s+\d{4})"


def date_mentions(df: DataFrame, key: str, text: str) -> DataFrame:
    """Calendar dates written in a text, in order of appearance; unreadable ones are left out."""
    m = df.select(key, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(MENTION), F.lit(1))).alias("pos", "mention"))
    flat = F.regexp_replace(F.regexp_replace("mention", ",", ""), r"\s+", " ")
    short = F.regexp_replace(flat, r"([A-Za-z]{3})[A-Za-z]*", "$1")
    parsed = F.coalesce(
        F.try_to_timestamp(F.regexp_replace(flat, "/", "-"), F.lit("yyyy-M-d")),
        F.try_to_timestamp(F.initcap(short), F.lit("d MMM yyyy")),
        F.try_to_timestamp(F.initcap(short), F.lit("MMM d yyyy")),
    )
    return m.select(key, F.col("pos").cast("long").alias("pos"), "mention", F.to_date(parsed).alias("mention_date")).filter("mention_date is not null")


def event_gaps(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Gap of two dates in days, rounded weeks and calendar months (at least one month)."""
    days = F.abs(F.datediff(b, a))
    months = F.abs((F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a))
    return pairs.select(
        *pairs.columns, days.cast("long").alias("gap_days"), F.bround(days / 7.0).cast("long").alias("gap_weeks"),
        F.when(months > 0, months).otherwise(F.greatest(F.lit(1), F.bround(days / 30.0).cast("int"))).cast("long").alias("gap_months"))


def bigrams(text: Column, stop=L.PHRASE_STOP_WORDS) -> Column:
    """Distinct pairs of neighbouring words that are both longer than two characters and no stop words."""
    w = X.word_list(text)
    good = lambda x: (F.length(x) > 2) & ~x.isin(stop)
    pairs = F.zip_with(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0))),
                       lambda a, b: F.when(good(a) & good(b), F.concat(a, F.lit(" "), b)))
    return F.array_distinct(F.array_compact(pairs))


def bigram_counts(df: DataFrame, text: str) -> DataFrame:
    return df.select(F.explode(bigrams(F.col(text))).alias("bigram")).groupBy("bigram").agg(F.count("*").alias("doc_freq"))


# Detector patterns and placeholders, applied in this order.
PII = [
    ("ssn", r"\b\d{3}-\d{2}-\d{4}\b", "[SSN]"),
    ("card", r"\b\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b", "[CREDIT_CARD]"),
    ("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", "[EMAIL]"),
    ("ip", r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "[IP]"),
]


def mask_pii(df: DataFrame, text: str) -> DataFrame:
    """Masked text and hit counts; each detector sees the text the earlier ones left."""
    for name, pattern, mark in PII:
        df = df.withColumn(f"{name}_hits", F.regexp_count(text, F.lit(pattern)).cast("long")).withColumn(text, F.regexp_replace(text, pattern, mark.replace("[", "\\[").replace("]", "\\]")))
    return df


def pii_by_source(df: DataFrame, text: str, source: str) -> DataFrame:
    m = mask_pii(df, text)
    return m.groupBy(source).agg(*[F.sum(f"{n}_hits").alias(f"{n}_hits") for n, _, _ in PII], F.count("*").alias("texts"))


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Unicode compatibility form in Arrow batches; Spark has no such function."""
    return s.str.normalize("NFKC")


def answer_form(text: Column) -> Column:
    """Lower case, single spaces, compatibility form.  Pure ASCII needs no normalisation and stays in the JVM."""
    return X.strip(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " "))


def abstains(form: Column, markers=L.ABSTENTION_MARKERS) -> Column:
    found = F.lit(False)
    for m in markers:
        found = found | form.rlike(rf"(?:^|[^\p{{L}}\p{{N}}_]){m}(?:[^\p{{L}}\p{{N}}_]|$)")
    return found


def abstention_rate(answers: DataFrame, text: str, by: str, markers=L.ABSTENTION_MARKERS, compat: bool = True) -> DataFrame:
    form = answer_form(nfkc(F.col(text)) if compat else F.col(text))
    a = answers.select(by, form.alias("f")).select(by, abstains(F.col("f"), markers).cast("int").alias("x"))
    return a.groupBy(by).agg(F.count("*").alias("answers"), F.sum("x").alias("abstained"), F.avg("x").alias("abstention_rate"))


def plan_queries(q: DataFrame, text: str = "text") -> DataFrame:
    """Both intent classes, possessive entities and the two halves of a "between A and B" question."""
    low = F.trim(F.lower(text))
    planner = F.lit(None).cast("string")
    cases = []
    for name, words in L.PLANNER_RULES:
        hit = F.lit(False)
        for w in words:
            hit = hit | (low.rlike(w) if w.startswith("^") else low.contains(w))
        cases.append((hit, name))
    planner = X.label(*cases, default="fact_lookup")
    recall = X.contains_any(low, L.RECALL_PHRASES)
    intents = []
    for name, words in L.INTENT_RULES:
        if name == "aggregation":
            intents.append((X.contains_any(low, words) & recall, "state"))
        intents.append((X.contains_any(low, words), name))
    between = r"between\s+(.*?)\s+and\s+(.*?)(?:\?|$)"
    poss = F.array_distinct(F.regexp_extract_all(low, F.lit(r"([a-z0-9_-]+)'s(?:[^a-z0-9_]|$)"), F.lit(1)))
    return q.select(
        *q.columns, planner.alias("planner_intent"), X.label(*intents, default="state").alias("state_intent"), F.array_join(poss, ",").alias("possessives"),
        F.when(low.rlike(between), F.trim(F.regexp_extract(low, between, 1))).alias("sub_a"),
        F.when(low.rlike(between), F.trim(F.regexp_extract(low, between, 2))).alias("sub_b"))


def intent_counts(planned: DataFrame) -> DataFrame:
    return planned.groupBy("planner_intent", "state_intent").agg(F.count("*").alias("queries"))


def query_signature(text: Column) -> Column:
    words = F.transform(X.space_words(text), lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}]", ""))
    return F.array_join(F.filter(words, lambda w: w != ""), " ")


def query_families(q: DataFrame, key: str = "query_id", text: str = "text") -> DataFrame:
    """Family leader (first of its signature) and the reuse label of every query.

    The shared result is computed for the leaders alone and joined back on the signature.
    """
    s = q.withColumn("signature", query_signature(F.col(text)))
    lead = s.groupBy("signature").agg(F.min(key).alias("leader"), F.min_by(text, key).alias("_t"), F.count("*").alias("family_size"))
    return s.join(lead, "signature").select(
        key, "signature", "leader", "family_size",
        X.label((F.col(key) == F.col("leader"), "FULL"), (F.col(text) == F.col("_t"), "REUSE"), default="REINDEX").alias("plan"))


def evaluate_by_family(q: DataFrame, evaluate, key: str = "query_id", text: str = "text") -> DataFrame:
    """Run ``evaluate`` (leaders -> rows keyed by query) once per family and fan the rows out to all members."""
    fam = query_families(q, key, text)
    leaders = q.join(fam.filter(F.col(key) == F.col("leader")).select(key), key, "left_semi")
    result = evaluate(leaders).withColumnRenamed(key, "leader")
    return fam.select(key, "leader", "plan").join(result, "leader").drop("leader")
