"""Beliefs and contradictions.

Contradictions are reported per row - how many opponents a memory has and one witness - instead of as
all pairs of a group, so the result and the work stay linear where one subject holds much of the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engramlake.functions import text as X
from engramlake.operators import skew

# Opposing wordings.
NEGATION_PATTERNS = [
    (["is", "was", "will be"], ["is not", "was not", "will not be"]),
    (["adopted", "chose", "selected", "decided on"], ["rejected", "did not choose", "did not select"]),
    (["agree", "agreed", "consensus"], ["disagree", "disagreed", "no consensus"]),
    (["true", "correct", "right"], ["false", "incorrect", "wrong"]),
    (["yes", "yeah", "yep"], ["no", "nope", "nah"]),
    (["can", "could", "able to"], ["cannot", "could not", "unable to"]),
]
BELIEF_PAIRS = [("is", "is not"), ("was", "was not"), ("will", "will not"), ("adopted", "rejected"), ("chose", "did not choose"), ("true", "false"), ("yes", "no"), ("decided", "undecided")]


def belief_key(proposition: Column) -> Column:
    return F.substring(F.sha2(F.trim(F.lower(proposition)), 256), 1, 16)


def belief_evidence(statements: DataFrame) -> DataFrame:
    """Distinct (belief_key, memory_id, polarity) rows from statements (memory_id, proposition, polarity, created_at)."""
    return statements.select(belief_key(F.col("proposition")).alias("belief_key"), "memory_id", "polarity").distinct()


def build_beliefs(statements: DataFrame) -> DataFrame:
    """One belief per normalised proposition with evidence counts; the evidence itself stays a long table."""
    s = statements.withColumn("belief_key", belief_key(F.col("proposition")))
    u = s.groupBy("belief_key", "memory_id", "polarity").agg(F.min_by("proposition", "memory_id").alias("proposition"), F.min("created_at").alias("created_at"), F.max("valid_until").alias("valid_until"))
    return u.groupBy("belief_key").agg(
        F.min_by("proposition", "memory_id").alias("proposition"), F.count_if(F.col("polarity") == "supporting").alias("supporting"),
        F.count_if(F.col("polarity") == "contradicting").alias("contradicting"), F.min("created_at").alias("valid_from"), F.max("valid_until").alias("valid_until"))


def _weighted(as_of: Column, horizon: int) -> tuple[Column, Column]:
    recency = F.greatest(F.lit(0.3), 1.0 - X.whole_days(as_of, F.col("created_at")) / horizon)
    w = F.col("importance") * F.col("confidence") * recency
    return w, w * F.col("confidence")


def _confidence(base: str, n_sup: Column, n_con: Column) -> Column:
    return F.when(n_sup == 0, F.lit(0.3)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col(base), F.lit(0.5)) - 0.15 * n_con)))


def belief_confidence(evidence: DataFrame, mem: DataFrame, as_of) -> DataFrame:
    """Weighted confidence of each belief less a fixed penalty per contradicting item; sums combine before the shuffle."""
    m = mem.select("memory_id", "importance", "confidence", "created_at")
    w, wc = _weighted(X.as_ts(as_of), 365)
    sup = F.col("polarity") == "supporting"
    j = evidence.join(m, "memory_id").select("belief_key", sup.alias("sup"), F.when(sup, w).alias("w"), F.when(sup, wc).alias("wc"))
    g = j.groupBy("belief_key").agg((F.sum("wc") / F.sum("w")).alias("base"), F.count_if("sup").alias("supporting"), F.count_if(~F.col("sup")).alias("contradicting"))
    return g.select("belief_key", "supporting", "contradicting", _confidence("base", F.col("supporting"), F.col("contradicting")).alias("confidence"))


def opponents(rows: DataFrame, group: list[str], key: str) -> DataFrame:
    """For rows (group, key, side): number of rows of the other side in the group and the least key among them."""
    g = rows.groupBy(*group).agg(
        F.count_if(F.col("side") == "a").alias("na"), F.count_if(F.col("side") == "b").alias("nb"),
        F.min(F.when(F.col("side") == "a", F.col(key))).alias("ma"), F.min(F.when(F.col("side") == "b", F.col(key))).alias("mb")).filter("na > 0 and nb > 0")
    a = F.col("side") == "a"
    return rows.join(g, group).select(*group, key, "side", F.when(a, F.col("nb")).otherwise(F.col("na")).alias("opponents"), F.when(a, F.col("mb")).otherwise(F.col("ma")).alias("witness"))


def direct_contradictions(mem: DataFrame, key: str, text: str, patterns=NEGATION_PATTERNS) -> DataFrame:
    """Assertions against negations of one pattern about one capitalised subject."""
    pad = F.col("_pad")
    sides = []
    for i, (pos, neg) in enumerate(patterns):
        n = X.has_phrase(pad, neg)
        sides.append(F.when(n, F.struct(F.lit(i).alias("pattern"), F.lit("b").alias("side"))).when(X.has_phrase(pad, pos), F.struct(F.lit(i).alias("pattern"), F.lit("a").alias("side"))))
    rows = mem.withColumn("_pad", X.padded(F.col(text))).select(key, X.entity_set(F.col(text)).alias("es"), F.explode(F.array_compact(F.array(*sides))).alias("s"))
    rows = rows.select(key, "s.pattern", "s.side", F.explode("es").alias("subject"))
    return opponents(rows, ["subject", "pattern"], key)


def value_contradictions(f: DataFrame) -> DataFrame:
    """For each fact the number of facts of the same key with another value, and the least of them."""
    v = f.groupBy("entity", "property", "value").agg(F.count("*").alias("n"), F.min("fact_id").alias("first_id"))
    k = v.groupBy("entity", "property").agg(F.sum("n").alias("total"), F.count("*").alias("values"), F.min(F.struct("first_id", "value")).alias("m1"))
    k = k.filter("values > 1")
    second = v.join(k.select("entity", "property", "m1"), ["entity", "property"]).filter(F.col("value") != F.col("m1.value")).groupBy("entity", "property").agg(F.min("first_id").alias("m2"))
    per_value = v.join(k, ["entity", "property"]).join(second, ["entity", "property"]).select(
        "entity", "property", "value", (F.col("total") - F.col("n")).alias("opponents"), F.when(F.col("value") == F.col("m1.value"), F.col("m2")).otherwise(F.col("m1.first_id")).alias("witness"))
    return f.select("fact_id", "entity", "property", "value").join(per_value, ["entity", "property", "value"]).withColumn("severity", F.lit(0.9))


def order_contradictions(mem: DataFrame, key: str, text: str) -> DataFrame:
    """ "before X" in one memory against "after X" in another."""
    low = F.lower(text)
    got = lambda w: F.regexp_extract(low, rf"(?:^|\s){w}\s+([\p{{L}}\p{{N}}_]+)", 1)
    sides = F.array_compact(F.array(*[F.when(got(w) != "", F.struct(got(w).alias("anchor"), F.lit(s).alias("side"))) for w, s in (("before", "a"), ("after", "b"))]))
    rows = mem.select(key, F.explode(sides).alias("s")).select(key, "s.anchor", "s.side")
    return opponents(rows, ["anchor"], key)


def _mask(text: Column, words: list[str]) -> Column:
    pad = X.padded(text)
    return sum((F.when(pad.contains(f" {w} "), 1 << i).otherwise(0) for i, w in enumerate(words)), F.lit(0))


def belief_conflicts(beliefs: DataFrame, mem: DataFrame, topic: str, belief_text: str, mem_text: str, pairs=BELIEF_PAIRS) -> DataFrame:
    """Memories of the same topic that word the opposite of a belief.

    A memory matters only by which negative words it holds, so memories are counted per topic and word
    set (at most 2^pairs rows per topic) before beliefs meet them.
    """
    b = beliefs.select("belief_key", topic, _mask(F.col(belief_text), [p for p, _ in pairs]).alias("bm")).filter("bm <> 0")
    m = mem.select(topic, "memory_id", _mask(F.col(mem_text), [n for _, n in pairs]).alias("mm")).filter("mm <> 0")
    m = m.groupBy(topic, "mm").agg(F.count("*").alias("n"), F.min("memory_id").alias("first_id"))
    return b.join(m, topic).filter(F.col("bm").bitwiseAND(F.col("mm")) != 0).groupBy("belief_key").agg(F.sum("n").alias("conflicting_memories"), F.min("first_id").alias("witness"))


def existing_at(at: Column) -> Column:
    """Memory existed at a time: created, and neither archived nor strongly compressed before it."""
    gone = F.col("status").isin("archived", "deep_archived") & (F.col("updated_at") <= at)
    return (F.col("created_at") <= at) & ~gone


def _states(j: DataFrame, keys: list[str]) -> DataFrame:
    """Evidence rows with column ``at_time`` and belief columns -> belief state per (belief, at)."""
    w, wc = _weighted(F.col("at_time"), 180)
    live = F.coalesce(existing_at(F.col("at_time")), F.lit(False))
    sup, con = live & (F.col("polarity") == "supporting"), live & (F.col("polarity") == "contradicting")
    g = j.groupBy(*keys).agg((F.sum(F.when(sup, wc)) / F.sum(F.when(sup, w))).alias("base"), F.count_if(sup).alias("supporting"), F.count_if(con).alias("contradicting"))
    status = X.label(
        (F.col("valid_until") <= F.col("at_time"), "superseded"), ((F.col("contradicting") > 0) & (F.col("contradicting") >= F.col("supporting") * 0.5), "contested"),
        (F.col("supporting") == 0, "rejected"), default="accepted")
    return g.select(*keys, "supporting", "contradicting", _confidence("base", F.col("supporting"), F.col("contradicting")).alias("confidence"), status.alias("status"))


def _with_memories(evidence: DataFrame, beliefs: DataFrame, mem: DataFrame) -> DataFrame:
    m = mem.select("memory_id", "importance", "confidence", "created_at", "updated_at", F.col("status"))
    return evidence.join(m, "memory_id").join(beliefs.select("belief_key", "valid_from", "valid_until"), "belief_key")


def beliefs_at(beliefs: DataFrame, evidence: DataFrame, mem: DataFrame, times: list[str]) -> DataFrame:
    """State of every belief at each of a few given times; the times are literals, so no join is needed for them."""
    at = F.array(*[X.as_ts(t) for t in times])
    j = _with_memories(evidence, beliefs, mem).withColumn("at_time", F.explode(F.filter(at, lambda t: F.col("valid_from") <= t)))
    return _states(j, ["belief_key", "at_time", "valid_until"]).drop("valid_until")


def belief_evolution(beliefs: DataFrame, evidence: DataFrame, mem: DataFrame, end: str, step_days: int = 30) -> DataFrame:
    """Snapshots every ``step_days`` from the start of each belief, and one at the end."""
    e = X.as_ts(end)
    j = _with_memories(evidence, beliefs, mem).filter(F.col("valid_from") <= e)
    grid = F.array_union(F.sequence(F.col("valid_from"), e, F.expr(f"interval {step_days} days")), F.array(e))
    return _states(j.withColumn("at_time", F.explode(grid)), ["belief_key", "at_time", "valid_until"]).drop("valid_until")


def belief_timeline(beliefs: DataFrame, states: DataFrame, topic: str) -> DataFrame:
    j = beliefs.select("belief_key", topic).join(states.select("belief_key", "status"), "belief_key")
    return j.groupBy(topic).agg(F.count("*").alias("total"), F.count_if(F.col("status") == "contested").alias("contested"), F.count_if(F.col("status") == "superseded").alias("superseded"))


def compare_beliefs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Changes between two belief snapshots."""
    l = a.select("belief_key", F.col("confidence").alias("confidence_a"), F.col("status").alias("status_a"))
    r = b.select("belief_key", F.col("confidence").alias("confidence_b"), F.col("status").alias("status_b"))
    change = X.label(
        (F.col("status_b").isNull(), "belief_lost"), (F.col("status_a").isNull(), "belief_gained"),
        (F.round("confidence_a", 9) != F.round("confidence_b", 9), "confidence_changed"), (F.col("status_a") != F.col("status_b"), "status_changed"))
    return l.join(r, "belief_key", "full_outer").withColumn("change", change).filter("change is not null")


def beliefs_by_topic(beliefs: DataFrame, evidence: DataFrame, mem: DataFrame, topics: list[str]) -> DataFrame:
    keys = evidence.join(mem.filter(F.col("topic").isin(topics)).select("memory_id"), "memory_id", "left_semi")
    return beliefs.join(keys.select("belief_key"), "belief_key", "left_semi")


def contradiction_sides(edges: DataFrame, mem: DataFrame) -> DataFrame:
    m = mem.select("memory_id", "valid_from", "valid_until", "created_at")
    side = lambda p: m.select(*[F.col(c).alias(f"{p}_{c}") for c in m.columns])
    e = edges.filter("type = 'contradicts'").select("src", "dst", "strength").distinct()
    return e.join(side("a"), F.col("src") == F.col("a_memory_id")).join(side("b"), F.col("dst") == F.col("b_memory_id"))


def unresolved_contradictions(edges: DataFrame, mem: DataFrame, as_of) -> DataFrame:
    """Contradiction edges whose two sides are both valid at the time."""
    t = X.as_ts(as_of)
    valid = lambda p: (F.col(f"{p}_valid_from") <= t) & (F.col(f"{p}_valid_until").isNull() | (t < F.col(f"{p}_valid_until")))
    return contradiction_sides(edges, mem).filter(valid("a") & valid("b")).select("src", "dst", "strength")


def resolve_as_transition(edges: DataFrame, mem: DataFrame, at) -> DataFrame:
    """Read each contradiction as a change of state: the older side ends and the newer begins at the time.

    A memory in several contradictions keeps its earliest end and latest start; applying it twice changes nothing.
    """
    t = X.as_ts(at)
    s = contradiction_sides(edges, mem)
    a_old = F.struct("a_created_at", "a_memory_id") <= F.struct("b_created_at", "b_memory_id")
    moves = F.array(
        F.struct(F.when(a_old, F.col("src")).otherwise(F.col("dst")).alias("memory_id"), t.alias("new_until"), F.lit(None).cast("timestamp").alias("new_from")),
        F.struct(F.when(a_old, F.col("dst")).otherwise(F.col("src")).alias("memory_id"), F.lit(None).cast("timestamp").alias("new_until"), t.alias("new_from")))
    d = s.select(F.explode(moves).alias("m")).groupBy("m.memory_id").agg(F.min("m.new_until").alias("new_until"), F.max("m.new_from").alias("new_from"))
    return mem.join(d, "memory_id").select(
        "memory_id", F.when(F.col("new_from").isNotNull(), F.greatest("valid_from", "new_from")).otherwise(F.col("valid_from")).alias("valid_from"),
        F.least(F.coalesce("valid_until", "new_until"), F.coalesce("new_until", "valid_until")).alias("valid_until"))
