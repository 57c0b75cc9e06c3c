"""Facts (entity, property, value): extraction, conflicts, supersession, state history and fact recall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engramlake.functions import lexicons as L
from engramlake.functions import text as X
from engramlake.operators import skew
from engramlake.session import materialise

KEY = ["entity", "property"]

# Mutable properties, behaviour words, question stop words and injection wording.
MUTABLE = (
    "residence,city,location,employer,job,status,habit,ratio,weight,car,team,project,database,hours,time,spent,count,own,attend,amount,"
    "move,relocate,price,cost,salary,pet,dog,cat,personal best,frequency,how often,schedule,plan"
).split(",")
BEHAVIOUR_WORDS = ["reverts", "backup", "copies files", "revert"]
QUESTION_STOP = "for project what which did the user say is in a an to of and our conversations about that runs".split()
INJECTION = r"(?i)ignore\s+all\s+previous\s+instructions|system\s+prompt\s*:|you\s+are\s+an\s+attacker"
PROPOSAL_WORDS = ["proposed", "suggested", "meeting"]
# Sentence patterns, tried in this order.
MIGRATION = r"(?i)(?:migrated|migrate|moved|move|switched|switch)\s+(?:the\s+)?([a-zA-Z0-9_\s]+?)\s+(?:from\s+([a-zA-Z0-9_\s]+?)\s+)?to\s+([a-zA-Z0-9_\s.-]+)"
NEGATION = r"(?i)never\s+(?:a\s+)?([a-zA-Z0-9_\s]+)"
LOCATION = r"(?i)(?:working\s+from|relocated\s+to|located\s+in)\s+([a-zA-Z0-9_\s]+?)(?:\s+until|\s+on|\s+from|\.|$)"
HABIT = r"(?i)usually\s+drinks\s+([a-zA-Z0-9_\s]+?)\s+while\s+working\s+on\s+([a-zA-Z0-9_-]+)"
SETTING = r"(?i)(?:pinned\s+(?:the\s+)?([a-zA-Z0-9_\s]+?)\s+to|set\s+(?:the\s+)?([a-zA-Z0-9_\s]+?)\s+to|preferred\s+([a-zA-Z0-9_\s]+?)\s+is|settled\s+on)\s+([a-zA-Z0-9_\s.-]+)"
ASSERTION = r"(?i)(?:the\s+)?([a-zA-Z0-9_\s]+?)\s+(?:actually\s+runs\s+on|runs\s+on|was|is)\s+([a-zA-Z0-9_\s.-]+)"
ENTITY_NAME = r"(?i)(?:project|user|team)\s+([a-z]*[0-9_-][a-z0-9_-]*|alpha)"


PROJECT_PREFIX = r"(?i)^(?:project\s+[a-zA-Z0-9_-]+\s+|the\s+)"
ROLES = ["user", "assistant", "teammate", "general"]


def extract_facts(msg: DataFrame, entity_pattern: str = ENTITY_NAME, default_source: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """One fact per turn; the first sentence pattern that matches decides.  A narrow pass of expressions.

    ``keep`` names columns of the turn that go with its fact.

    ``default_source`` names who speaks where the text does not tell; a name that is no role is also the entity of a
    turn that names none.
    """
    # Worked out once: every pattern below reads them.
    msg = msg.withColumn("_t", X.strip(F.col("text"))).withColumn("_low", F.lower("_t"))
    t, low = F.col("_t"), F.col("_low")
    got = lambda pat, i: F.trim(F.regexp_extract(t, pat, i))
    tidy = lambda c: F.trim(F.regexp_replace(F.lower(F.trim(F.regexp_replace(c, r"\.+$", ""))), r"^(?:the|a|an|our|my|their|its|his|her)\s+", ""))
    value_of = lambda c: F.regexp_replace(c, r"\.+$", "")
    none = lambda c: F.when(c != "", c)
    fact = lambda rel, prop, value, old=None, status="active": F.struct(
        F.lit(rel).alias("relation"), prop.alias("property"), value.alias("value"),
        (old if old is not None else F.lit(None).cast("string")).alias("old_value"), F.lit(status).alias("status"))
    setting = F.coalesce(none(got(SETTING, 1)), none(got(SETTING, 2)), none(got(SETTING, 3)), F.lit("tool"))
    f = (
        F.when(t.rlike(MIGRATION), fact("migrated", tidy(F.regexp_replace(got(MIGRATION, 1), PROJECT_PREFIX, "")), value_of(got(MIGRATION, 3)), none(got(MIGRATION, 2))))
        .when(t.rlike(NEGATION), fact("never", tidy(got(NEGATION, 1)), F.lit("none"), status="unspecified"))
        .when(t.rlike(LOCATION), fact("located_at", F.lit("location"), got(LOCATION, 1)))
        .when(t.rlike(HABIT), fact("prefers", F.lit("drinks"), got(HABIT, 1)))
        .when(t.rlike(SETTING), fact("prefers", tidy(setting), value_of(got(SETTING, 4))))
        .when(X.contains_any(low, BEHAVIOUR_WORDS), fact("behavior", F.lit("behavior_tendency"), t))
        .when(t.rlike(ASSERTION), fact("asserts", tidy(got(ASSERTION, 1)), value_of(got(ASSERTION, 2))))
        .otherwise(fact("asserts", F.lit("statement"), t))
    )
    name = F.regexp_extract(low, entity_pattern, 1)
    said = default_source if default_source is not None else F.lit("user")
    source = F.when(low.contains("teammate reported"), "teammate").when(low.contains("assistant"), "assistant").otherwise(said)
    speaker = F.when(~F.lower(said).isin(ROLES), F.lower(said))
    return msg.filter(t != "").select(
        F.col("message_id").alias("fact_id"), F.when(name != "", name).otherwise(F.coalesce(speaker, F.lit("general"))).alias("entity"), source.alias("source"),
        F.col("created_at").alias("ts"), t.alias("raw"), f.alias("f"), *keep).select("fact_id", "entity", "f.*", "source", "ts", "raw", *keep)


def normalise_entities(f: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Alias table of fixed size as a literal map: no join."""
    pairs = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    low = F.lower(F.trim("entity"))
    return f.withColumn("entity", F.coalesce(F.try_element_at(pairs, low), low))


def dedup_facts(f: DataFrame) -> DataFrame:
    """Keep a fact that is the first of its wording and the first of its triple.

    Only hashes and ids are grouped (combined before the shuffle) and the ids, which are unique, are
    joined back, so a fact copied a million times stays cheap.
    """
    by_text = f.groupBy(F.xxhash64("raw").alias("a"), F.sha2("raw", 256).alias("b")).agg(F.min("fact_id").alias("fact_id")).select("fact_id")
    by_triple = f.groupBy("entity", "property", "value").agg(F.min("fact_id").alias("fact_id")).select("fact_id")
    return f.join(by_text, "fact_id", "left_semi").join(by_triple, "fact_id", "left_semi")


def entity_clusters(f: DataFrame) -> DataFrame:
    pairs = f.groupBy(*KEY).agg(F.count("*").alias("n"))
    return pairs.groupBy("entity").agg(F.sum("n").alias("facts"), F.count("*").alias("properties"), F.array_join(F.array_sort(F.collect_set("property")), ",").alias("covered"))


def value_table(f: DataFrame) -> DataFrame:
    """One row per (entity, property, value): everything conflict work needs, combined before the shuffle."""
    active = F.col("status") == "active"
    order = F.struct("ts", "fact_id")
    return f.groupBy(F.lower(F.trim("entity")).alias("entity"), F.lower(F.trim("property")).alias("property"), F.lower(F.trim("value")).alias("value")).agg(
        F.count("*").alias("n"), F.bool_or(active).alias("is_active"), F.bool_or(F.col("relation") == "contradicts").alias("contradicts"),
        F.bool_or(F.col("relation") == "migrated").alias("migrated"), F.max(F.when(active, order)).alias("last_active"), F.max(order).alias("last"),
        F.min("fact_id").alias("first_id"), F.min("source").alias("s1"), F.max("source").alias("s2"))


def detect_conflicts(f: DataFrame) -> DataFrame:
    """Conflict per key with severity and candidate.  Values are collapsed first, so a hot key is a few rows here."""
    g = value_table(f).groupBy(*KEY).agg(
        F.sum("n").alias("facts"), F.count("*").alias("values"), F.count_if("is_active").alias("active_values"), F.bool_or("contradicts").alias("contradicts"),
        F.count_if("migrated").alias("migrated_values"), (F.min("s1") != F.max("s2")).alias("many_sources"),
        F.max_by("value", "last_active").alias("a"), F.max_by("value", "last").alias("l"))
    migrated = F.col("migrated_values")
    severity = (
        F.when((F.col("active_values") > 1) | F.col("contradicts"), F.lit("high"))
        .when(migrated > 0, F.when(migrated > 1, F.lit("medium")))
        .when(F.col("many_sources"), F.lit("medium"))
    )
    return g.withColumn("severity", severity).filter("values > 1 and severity is not null").select(
        *KEY, "facts", "values", "active_values", "severity", F.coalesce("a", "l").alias("active_candidate"))


def conflict_evidence(f: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Values that speak against the candidate of each conflict, with counts and last mention."""
    v = value_table(f).select(*KEY, "value", "n", F.col("last.fact_id").alias("last_fact_id"))
    return v.join(conflicts.select(*KEY, "active_candidate", "severity"), KEY).filter("value <> active_candidate")


def resolve_conflicts(conflicts: DataFrame, resolutions: DataFrame) -> DataFrame:
    return conflicts.join(resolutions.select(*KEY, "authoritative_value"), KEY, "left").select(
        *conflicts.columns, F.coalesce("authoritative_value", "active_candidate").alias("resolved_value"),
        F.when(F.col("authoritative_value").isNotNull(), F.lit("resolved")).otherwise(F.lit("conflicted")).alias("state"))


def supersede_facts(f: DataFrame, mutable=MUTABLE) -> DataFrame:
    """Newest fact of a mutable, changing property is active and the others are superseded."""
    m = f.filter(F.lower("property").isin(list(mutable)))
    v = value_table(m).groupBy(*KEY).agg(F.max("last").alias("newest"), F.count("*").alias("values")).filter("values > 1")
    j = f.withColumn("_e", F.lower(F.trim("entity"))).withColumn("_p", F.lower(F.trim("property"))).join(
        v.select(F.col("entity").alias("_e"), F.col("property").alias("_p"), F.col("newest.fact_id").alias("_n")), ["_e", "_p"], "left")
    return j.withColumn("status", F.when(F.col("_n").isNull(), F.col("status")).when(F.col("fact_id") == F.col("_n"), F.lit("active")).otherwise(F.lit("superseded"))).drop("_e", "_p", "_n")


def state_history(f: DataFrame) -> DataFrame:
    """Consecutive distinct values of each key with from/to times (half-open) and the previous value.

    Where a key holds very many facts it works day by day inside a key and carries the last value of a day over, so a hot
    key is cut into its days instead of being sorted in one task.
    """
    d = f.select("fact_id", *KEY, "value", "ts", F.to_date("ts").alias("day"))
    if skew.small_keys(d, KEY):
        w = Window.partitionBy(*KEY).orderBy(F.col("ts").asc_nulls_last(), "fact_id")
        changes = d.withColumn("prev", F.lag(F.struct("value")).over(w)).withColumn("prev_value", F.col("prev.value"))
        changes = changes.filter(~F.col("value").eqNullSafe(F.col("prev_value"))).withColumn("next_ts", F.lead("ts").over(w))
        return changes.select("fact_id", *KEY, "value", F.col("prev_value").alias("previous_value"), F.col("ts").alias("valid_from"), F.col("next_ts").alias("valid_until"), F.col("next_ts").isNull().alias("is_current"))
    d = skew.neighbour(d, KEY, "day", ["ts", "fact_id"], ["value", "fact_id"], "prev_")
    changes = d.filter(~F.col("value").eqNullSafe(F.col("prev_value")))
    changes = skew.neighbour(changes, KEY, "day", ["ts", "fact_id"], ["ts"], "next_", forward=True)
    return changes.select("fact_id", *KEY, "value", F.col("prev_value").alias("previous_value"), F.col("ts").alias("valid_from"), F.col("next_ts").alias("valid_until"), F.col("next_ts").isNull().alias("is_current"))


def answer_state(q: DataFrame, hist: DataFrame) -> DataFrame:
    """Current or previous value per state query (query_id, entity, property, wanted)."""
    last_two = skew.top_k(hist.select(*KEY, "value", "valid_from", "fact_id"), KEY, [F.col("valid_from").desc(), F.col("fact_id").desc()], 2)
    a = last_two.groupBy(*KEY).agg(F.max(F.when(F.col("rank") == 1, F.struct("value", "valid_from"))).alias("cur"), F.max(F.when(F.col("rank") == 2, F.struct("value", "valid_from"))).alias("prev"))
    pick = F.when((F.col("wanted") == "previous") & F.col("prev").isNotNull(), F.col("prev")).otherwise(F.col("cur"))
    return q.join(a, KEY).select("query_id", *KEY, "wanted", pick["value"].alias("answer"), pick["valid_from"].alias("as_of"))


def truth_sections(f: DataFrame) -> DataFrame:
    """Distinct lines per entity under active truth, superseded history and mentions, with counts; long form."""
    e, p, v, o = F.col("entity"), F.col("property"), F.col("value"), F.col("old_value")
    moved = (F.col("status") == "active") & (F.col("relation") == "migrated")
    line = lambda section, *parts: F.struct(F.lit(section).alias("section"), F.concat(*parts).alias("line"))
    old = line("superseded", e, F.lit(" "), p, F.lit(" was "), F.when(moved, o).otherwise(v))
    rows = (
        F.when(moved, F.array(line("active", e, F.lit(" "), p, F.lit(" = "), v, F.lit(" (migrated from "), F.coalesce(o, F.lit("previous")), F.lit(")")), old))
        .when(F.col("status") == "active", F.array(line("active", e, F.lit(" "), p, F.lit(" = "), v)))
        .when(F.col("status").isin("superseded", "deprecated"), F.array(old))
        .otherwise(F.array(line("mention", F.col("source"), F.lit(" mentioned "), v, F.lit(" for "), e)))
    )
    return f.select("entity", F.explode(rows).alias("r")).filter("r.line is not null").groupBy("entity", "r.section", "r.line").agg(F.count("*").alias("n"))


def resolve_facts(q: DataFrame, f: DataFrame, hist: DataFrame) -> DataFrame:
    """Value held on the asked date within the entity's scope (the latest to begin); a "never" fact about the property abstains."""
    h = hist.select(*KEY, "value", "valid_from", "valid_until")
    # Of a history of consecutive values the last to begin holds; only where it has ended are longer ones searched.
    asked = materialise(skew.last_begun(q.select("query_id", *KEY, "asked_at"), h, KEY, "asked_at", "valid_from", "valid_until", ["value"]), "asked")
    ended = F.col("last.valid_until") <= F.col("asked_at")
    j = asked.withColumn("value", F.when(~F.coalesce(ended, F.lit(False)), F.col("last.value")))
    rest = asked.filter(ended).drop("last")
    if not rest.isEmpty():
        found = skew.latest_covering(rest, h, "query_id", KEY, "asked_at", "valid_from", "valid_until", ["value"], ["valid_from", "value"])
        j = j.join(found.select("query_id", F.col("value").alias("_v")), "query_id", "left").withColumn("value", F.coalesce("value", "_v")).drop("_v")
    never = f.filter("relation = 'never'").select(*KEY).distinct().withColumn("abstain", F.lit(True))
    j = j.join(never, KEY, "left")
    abstain = F.coalesce("abstain", F.lit(False))
    return j.select("query_id", *KEY, abstain.alias("abstain"), F.when(~abstain, F.col("value")).alias("value"), F.col("value").alias("held"))


def fact_terms(f: DataFrame, scope: str = "entity") -> DataFrame:
    """Term rows per fact: 3 for a property word, else 2 for a value word, else 1 for a word of the text."""
    p, v = X.word_set(F.col("property")), X.word_set(F.col("value"))
    w = F.array_union(F.array_union(p, v), X.word_set(F.col("raw")))
    weight = lambda t: F.when(F.array_contains(p, t), 3.0).when(F.array_contains(v, t), 2.0).otherwise(1.0)
    return f.select("fact_id", scope, "relation", F.explode(F.transform(w, lambda t: F.struct(t.alias("term"), weight(t).alias("w")))).alias("x")).select("fact_id", scope, "relation", "x.term", "x.w")


def rank_facts(q: DataFrame, f: DataFrame, k: int = 8, fallback: int = 10) -> DataFrame:
    """Top facts in the entity scope of each query (query_id, entity, text); without any hit the first facts of the entity."""
    safe = f.filter(~((F.col("property") == "statement") & F.col("raw").rlike(INJECTION)))
    terms = q.select("query_id", "entity", F.explode(F.filter(X.word_set(F.col("text"), 2), lambda w: ~w.isin(QUESTION_STOP))).alias("term"))
    terms = terms.filter(F.col("term") != F.lower("entity"))
    hit = terms.join(fact_terms(safe), ["entity", "term"]).groupBy("query_id", "fact_id", "relation").agg(F.sum("w").alias("s"))
    scored = hit.select("query_id", "fact_id", (F.col("s") + F.when(F.col("relation") == "migrated", 1.5).otherwise(0.0)).alias("score"))
    top = skew.top_k(scored, ["query_id"], [F.col("score").desc(), F.col("fact_id")], k)
    empty = q.join(top.select("query_id").distinct(), "query_id", "left_anti")
    first = skew.top_k(safe.filter(~F.col("raw").rlike(INJECTION)).select("entity", "fact_id"), ["entity"], [F.col("fact_id")], fallback)
    rest = empty.join(first, "entity").select("query_id", "fact_id", F.lit(0.0).alias("score"), "rank")
    return top.unionByName(rest)


def expand_by_value(q: DataFrame, top: DataFrame, f: DataFrame, k: int = 3) -> DataFrame:
    """Facts of other entities that mention the value of a top fact, at most ``k`` per query.

    Per value word the first ``k`` facts of each entity and of these the first 2k are enough for any
    query: leaving its own entity out removes at most k of them.  So no query meets all mentions.
    """
    words = f.select("fact_id", "entity", F.explode(X.word_set(F.col("raw"))).alias("term"))
    each = skew.top_k(words, ["term", "entity"], [F.col("fact_id")], k, "r1").drop("r1")
    first = skew.top_k(each, ["term"], [F.col("fact_id")], 2 * k, "r2").drop("r2")
    want = top.join(f.select("fact_id", F.lower("value").alias("term")), "fact_id").filter(F.length("term") >= 2).select("query_id", "term").distinct()
    want = want.join(q.select("query_id", F.col("entity").alias("own")), "query_id")
    found = want.join(first, "term").filter("entity <> own").select("query_id", "fact_id", "entity").distinct()
    return skew.top_k(found, ["query_id"], [F.col("fact_id")], k)


def behaviour_patterns(f: DataFrame, signals=BEHAVIOUR_WORDS, sample: int = 4) -> DataFrame:
    """Entities with at least two signal facts, and the first facts as evidence."""
    s = f.filter(X.contains_any(F.lower("raw"), signals) | (F.col("relation") == "behavior")).select("entity", "fact_id")
    n = s.groupBy("entity").agg(F.count("*").alias("signals")).filter("signals >= 2")
    ev = skew.top_k(s, ["entity"], [F.col("fact_id")], sample).groupBy("entity").agg(F.array_join(F.transform(F.array_sort(F.collect_list("fact_id")), lambda x: x.cast("string")), ",").alias("evidence"))
    return n.join(ev, "entity")


QUANTITY = r"\$?(\d+(?:\.\d+)?)"


MONEY = r"\$(\d+(?:\.\d+)?)"
# Words of questions for an aggregate, of comparisons and dates that are none, and of the three operations.
AGGREGATE_WORDS = ["how many", "how much", "total", "combined", "altogether", "sum of", "average", "how long"]
OTHER_QUESTIONS = ["compared to", "difference in", "difference between", "how much more", "how much faster", "how much earlier", "how much older", "percentage of", "the most", "the least", "when did i", "what time did i"]
SUM_WORDS = ["how much", "total", "combined", "altogether", "sum of", "how long"]
#: Words after "how many" that name no unit.
NO_UNIT = ["times", "of", "did", "do", "does", "have", "has", "is", "are", "was", "were", "different"]


def read_questions(q: DataFrame) -> DataFrame:
    """The questions with the operation they ask for (count, sum, average; null for another question) and its unit.

    The unit is "$" for questions of money, else the word after "how many" or "how much".
    """
    low = F.lower("text")
    asks = X.contains_any(low, AGGREGATE_WORDS) & ~X.contains_any(low, OTHER_QUESTIONS)
    op = F.when(asks, X.label((F.contains(low, F.lit("average")), "average"), (X.contains_any(low, SUM_WORDS), "sum"), default="count"))
    noun = F.regexp_extract(low, r"how (?:many|much) ([\p{L}_]+)", 1)
    unit = F.when(X.contains_any(low, L.MONEY_QUESTIONS), "$").when((noun != "") & ~noun.isin(NO_UNIT), noun)
    return q.withColumn("op", op).withColumn("unit", F.when(op.isNotNull(), unit))


def aggregate_quantities(q: DataFrame, msg: DataFrame, min_score: float = 2.5) -> DataFrame:
    """Count, sum or average over the one best sentence of each session for each question (query_id, text).

    ``op`` and ``unit`` may be given as columns; else they are read from the question, and questions that ask for no
    aggregate are left out.
    """
    q = q if "op" in q.columns else read_questions(q).filter("op is not null")
    s = msg.select("conv_id", "turn", F.posexplode(X.sentence_list(F.col("text"))).alias("pos", "sentence"))
    s = s.select("conv_id", "turn", "pos", "sentence", F.col("sentence").rlike(QUANTITY).alias("num"))
    terms = q.select("query_id", F.explode(F.filter(X.word_set(F.col("text"), 3), lambda w: ~w.isin(L.STOP_WORDS))).alias("term"))
    words = s.select("conv_id", "turn", "pos", "num", F.explode(X.word_set(F.col("sentence"), 3)).alias("term"))
    hit = terms.join(words, "term").groupBy("query_id", "conv_id", "turn", "pos", "num").agg(F.count("*").alias("n"))
    hit = hit.withColumn("score", F.col("n") + F.when(F.col("num"), 2.0).otherwise(0.0)).filter(F.col("score") >= min_score)
    best = skew.latest_rows(hit.select("query_id", "conv_id", "turn", "pos", "score"), ["query_id", "conv_id"], [F.col("score"), -F.col("turn"), -F.col("pos")])
    best = best.join(s.select("conv_id", "turn", "pos", "sentence"), ["conv_id", "turn", "pos"]).join(q.select("query_id", "op", "unit"), "query_id")
    by_unit = F.when(F.col("unit") == "$", F.regexp_extract("sentence", MONEY, 1)).otherwise(F.expr(r"regexp_extract(sentence, concat('(?i)', '\\$?(\\d+(?:\\.\\d+)?)\\s+', unit), 1)"))
    plain = F.regexp_extract("sentence", QUANTITY, 1)
    amount = F.when(F.col("unit").isNotNull() & (by_unit != ""), by_unit).otherwise(plain).try_cast("double")
    g = best.withColumn("amount", amount).groupBy("query_id", "op").agg(
        F.count("*").alias("sessions"), F.sum("amount").alias("total"), F.avg("amount").alias("mean"), F.count_distinct("sentence").alias("distinct_sentences"))
    return g.withColumn("answer", F.when(F.col("op") == "sum", F.col("total")).when(F.col("op") == "average", F.col("mean")).otherwise(F.col("distinct_sentences").cast("double")))


def proposition_graph(f: DataFrame, hist: DataFrame) -> DataFrame:
    """Edges fact-subject, fact-object (one pass) and value-to-next-value supersession."""
    subj, obj = F.lower(F.trim("entity")), F.lower(F.trim("value"))
    node = F.concat(F.lit("fact:"), F.col("fact_id"))
    both = F.array_compact(F.array(
        F.when(subj != "", F.struct(F.concat(F.lit("entity:"), subj).alias("dst"), F.lit("subject").alias("kind"))),
        F.when(F.length(obj) >= 2, F.struct(F.concat(F.lit("entity:"), obj).alias("dst"), F.lit("object").alias("kind")))))
    e = f.select(node.alias("src"), F.explode(both).alias("x")).select("src", "x.dst", "x.kind", F.lit(1.0).alias("weight"))
    h = skew.neighbour(hist.withColumn("day", F.to_date("valid_from")), KEY, "day", ["valid_from", "fact_id"], ["fact_id"], "next_", forward=True).filter("next_fact_id is not null")
    s = h.select(F.concat(F.lit("fact:"), F.col("fact_id")).alias("src"), F.concat(F.lit("fact:"), F.col("next_fact_id")).alias("dst"), F.lit("supersedes").alias("kind"), F.lit(1.5).alias("weight"))
    return e.unionByName(s)


def match_entities(keys: DataFrame, f: DataFrame) -> DataFrame:
    """Entity names for each key: the equal one, else all that contain the key or are contained in it.

    A contained text equals a piece of the other, so names are cut into pieces as long as some key and keys into pieces as
    long as some name, and equal texts meet. No piece that many names share is joined unless it is a key of its own.
    """
    names = materialise(f.select(F.lower(F.trim("entity")).alias("entity")).distinct().filter("entity is not null"), "names")
    k = materialise(keys.select(F.lower(F.trim("key")).alias("key")).distinct().filter("key is not null"), "keys")
    exact = k.join(names, k["key"] == names["entity"]).select("key", "entity", F.lit("exact").alias("how"))
    rest = k.join(exact.select("key"), "key", "left_anti")

    def pieces(rows: DataFrame, text: str, other: DataFrame, part: str) -> DataFrame:
        """Distinct pieces of each text that are as long as some text of ``other``; the lengths are a few small numbers."""
        lengths = sorted(r[0] for r in other.select(F.length(part)).distinct().collect())
        cut = lambda n: F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substring(text, i, F.lit(n))) if n else F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
        return rows.select(text, F.explode(F.array_distinct(F.flatten(F.array(*[cut(n) for n in lengths])))).alias(part)) if lengths else rows.select(text, F.lit(None).cast("string").alias(part)).limit(0)

    # Merge joins: a key that many names hold is split over tasks, and the planner does not see how many pieces ``explode`` makes.
    a = pieces(names, "entity", rest, "key").join(rest.hint("merge"), "key")
    b = pieces(rest, "key", names, "entity").join(names.hint("merge"), "entity")
    part = a.select("key", "entity").union(b.select("key", "entity")).distinct().withColumn("how", F.lit("part"))
    return exact.unionByName(part)


def facts_for_entity(keys: DataFrame, f: DataFrame) -> DataFrame:
    return match_entities(keys, f).join(f.withColumn("entity", F.lower(F.trim("entity"))), "entity")


def tag_roles(f: DataFrame, proposal_words=PROPOSAL_WORDS) -> DataFrame:
    role = X.label(
        (F.col("relation") == "migrated", "event"), (F.col("relation") == "behavior", "abstraction"),
        (X.contains_any(F.lower("raw"), proposal_words) | F.col("status").isin("superseded", "deprecated"), "evidence"), default="state")
    return f.withColumn("role", role)


def role_counts(tagged: DataFrame) -> DataFrame:
    return tagged.groupBy("entity").agg(*[F.count_if(F.col("role") == r).alias(r) for r in ("state", "event", "evidence", "abstraction")])


SPEECH_FILLER = r"(?i)(?<![\p{L}\p{N}_])(?:yeah|yep|oh|ah|haha|thanks|okay|ok|well)(?![\p{L}\p{N}_]),?\s*"


def strip_filler(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, SPEECH_FILLER, ""), r"\s+", " "))


def render_tiered(ranked: DataFrame, f: DataFrame, word_budget: int = 600) -> DataFrame:
    """Lines per query: current/superseded first, ranks 1-3 verbatim, 4-8 without filler, 9+ as triples; stops at the word budget."""
    j = ranked.join(f.select("fact_id", *KEY, "value", "raw", "status", "ts"), "fact_id")
    plain = F.when(F.col("rank") <= 3, F.col("raw")).when(F.col("rank") <= 8, strip_filler(F.col("raw"))).otherwise(
        F.concat(F.lit("[FACT] "), "entity", F.lit(" -> "), "property", F.lit(": "), "value"))
    old = F.col("status") == "superseded"
    j = j.select("query_id", F.col("rank").alias("source_rank"), "fact_id", old.alias("old"), F.when(old, F.concat(F.lit("  [SUPERSEDED] "), strip_filler(F.col("raw")))).otherwise(plain).alias("line"))
    j = j.withColumn("words", F.size(X.space_words(F.col("line"))).cast("long")).filter("words > 0")
    head = skew.top_k(j, ["query_id"], [F.col("old").desc(), F.col("source_rank")], word_budget, "line_no")
    from pyspark.sql import Window

    before = Window.partitionBy("query_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    return head.withColumn("used", F.coalesce(F.sum("words").over(before), F.lit(0))).filter(F.col("used") < word_budget).select("query_id", "line_no", "fact_id", "line", "words")
