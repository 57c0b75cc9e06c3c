"""Lifecycle and quality jobs over the memories table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engramlake.functions import text as X
from engramlake.operators import skew
from engramlake.operators import similar as SIM
from engramlake.operators.temporal import is_valid
from engramlake.session import materialise

# Allowed status changes, drift words, issue actions and priorities.
ALLOWED = {
    "active": ["dormant", "compressed", "archived"],
    "compressed": ["dormant", "archived", "active"],
    "dormant": ["active", "archived"],
    "archived": ["deep_archived", "active"],
    "deep_archived": ["archived", "active"],
}
DRIFT_WORDS = ["version", "v1.", "v2.", "api", "endpoint", "service", "library", "framework", "deprecated", "migrate"]
INTEGRITY_WEIGHTS = {"semantic_drift": 0.3, "temporal_inconsistency": 0.15, "provenance_broken": 0.2, "compression_artifact": 0.15, "contradiction": 0.2}
HEALING = {
    "semantic_drift": ("recompile", 10, 5), "compression_artifact": ("recompress", 8, 4), "provenance_broken": ("repair_provenance", 7, 3),
    "contradiction": ("resolve_contradiction", 9, 5), "temporal_inconsistency": ("restore_version", 6, 6), "stale": ("reactivate", 4, 4),
}
DESTRUCTIVE = ["merge", "split", "reject", "reinterpret"]
NEEDS_EVIDENCE = ["revise", "reinterpret", "supersede"]
ARCHIVE_SAFE = ["restore", "reactivate", "keep", "transition"]
DISPATCHABLE = ["revise", "merge", "split", "reinforce", "reinterpret", "restore", "reactivate", "keep", "reject", "heal", "contradict", "supersede", "transition"]
STATUS_CONFIDENCE = {"active": 1.0, "dormant": 0.9, "compressed": 0.8, "archived": 0.6, "deep_archived": 0.4}
RESOLUTION_CONFIDENCE = [1.0, 0.95, 0.9, 0.85, 0.75, 0.65]
LEVEL_CONFIDENCE = [1.0, 0.9, 0.85, 0.95, 0.98]


def _last_use() -> Column:
    return F.coalesce("last_accessed", "created_at")


def target_status(mem: DataFrame, as_of) -> DataFrame:
    now = X.as_ts(as_of)
    age, idle = X.whole_days(now, F.col("created_at")), X.whole_days(now, _last_use())
    imp = F.round(F.col("importance"), 9)
    high, low = imp >= 0.7, imp <= 0.3
    return mem.withColumn("target_status", X.label(
        (high & (idle <= 7), "active"), (high, "dormant"), (low & (age > 365), "deep_archived"), (low & (age > 90), "archived"),
        (age > 365, "deep_archived"), (age > 90, "archived"), (age > 30, "compressed"), (age > 7, "dormant"), default="active"))


def consolidate(mem: DataFrame, as_of) -> DataFrame:
    """Status and resolution each memory should have, and whether it must be compressed."""
    r, s = F.col("resolution"), F.col("target_status")
    target = (
        F.when((s == "dormant") & (r == 0), 1)
        .when((s == "compressed") & (r <= 2), r + 1)
        .when((s == "archived") & (r <= 2), 3)
        .when((s == "archived") & (r == 3), 4)
        .when(s == "deep_archived", 5)
        .otherwise(r)
    )
    return target_status(mem, as_of).withColumn("target_resolution", target.cast("int")).withColumn("compress", F.col("target_resolution") > r)


def consolidation_stats(c: DataFrame) -> DataFrame:
    return c.groupBy("topic").agg(F.count("*").alias("memories"), F.count_if(F.col("status") != F.col("target_status")).alias("status_changes"), F.count_if("compress").alias("compressions"))


def apply_transitions(mem: DataFrame, delta: DataFrame) -> DataFrame:
    """Requested status changes checked against the allowed graph (a literal map); others are rejected."""
    allowed = F.create_map(*[x for k, v in ALLOWED.items() for x in (F.lit(k), F.array(*[F.lit(t) for t in v]))])
    j = mem.join(delta.select("memory_id", "to_status"), "memory_id")
    ok = F.coalesce(F.array_contains(F.try_element_at(allowed, F.col("status")), F.col("to_status")), F.lit(False))
    new = F.when(ok, F.col("to_status")).otherwise(F.col("status"))
    return j.select("memory_id", "status", "to_status", ok.alias("accepted"), new.alias("new_status"), new.isin("active", "dormant").alias("new_is_current"))


def state_vector(mem: DataFrame, edges: DataFrame, as_of) -> DataFrame:
    """Signals, currentness and future utility of every memory."""
    now = X.as_ts(as_of)
    risk = edges.filter("type = 'contradicts'").groupBy(F.col("src").alias("memory_id")).agg(F.max("strength").alias("_r"))
    m = mem.join(risk, "memory_id", "left").withColumns({
        "contradiction_risk": X.clamp01(F.coalesce("_r", F.lit(0.0))),
        "recency": F.pow(F.lit(0.5), F.greatest(F.lit(0.0), X.frac_days(now, _last_use())) / 30.0),
        "usage": F.greatest(F.lit(0), F.col("access_count")) / (F.greatest(F.lit(0), F.col("access_count")) + 10.0),
        "temporal": F.when(is_valid(now), 1.0).otherwise(0.0),
        "detail": 1.0 - F.col("resolution") / 5,
    }).drop("_r")
    m = m.withColumn("currentness", X.clamp01(0.4 * F.col("temporal") + 0.35 * F.col("recency") + 0.25 * (1.0 - F.col("contradiction_risk"))))
    u = 0.35 * F.col("importance") + 0.25 * X.clamp01(F.col("confidence")) + 0.2 * F.col("usage") + 0.1 * F.col("detail") + 0.1 * F.col("currentness")
    return m.withColumn("future_utility", F.round(X.clamp01(u), 9))


def rank_by_utility(state: DataFrame, k: int) -> DataFrame:
    """Best memories of each topic by future utility."""
    return skew.top_k(state.select("topic", "memory_id", "future_utility"), ["topic"], [F.col("future_utility").desc(), F.col("memory_id")], k)


def superseded_by_similar(mem: DataFrame, t: float = 0.5) -> DataFrame:
    """Memories with a newer memory of the same topic and type whose words overlap by more than ``t`` (Jaccard)."""
    keys = ["topic", "memory_type"]
    w = X.space_words(F.col("content"))
    sets = SIM.collapse(mem, "memory_id", w, keys, [F.max("created_at").alias("newest")])
    o = SIM.by_rarity(sets)
    p = SIM.jaccard_pairs(o, o, keys, t).filter(F.col("score") > t)
    near = p.join(sets.select(F.col("first_key").alias("b_id"), "newest"), "b_id").groupBy(F.col("a_id").alias("first_key")).agg(F.max("newest").alias("newest"))
    near = near.join(sets.select("first_key", "set_id"), "first_key").select("set_id", "newest")
    m = mem.select("memory_id", "created_at", *keys, F.sha2(F.concat_ws(" ", *keys, F.array_join(F.array_sort(F.array_distinct(w)), " ")), 256).alias("set_id"))
    return m.join(near, "set_id").filter(F.col("newest") > F.col("created_at")).select("memory_id")


def staleness(mem: DataFrame, edges: DataFrame, as_of, confidence_floor: float = 0.4, inactive_days: int = 90, drift_words=DRIFT_WORDS) -> DataFrame:
    """Seven signals and the composite 1 - prod(1 - weight), with the advised action."""
    now = X.as_ts(as_of)
    sup = superseded_by_similar(mem).withColumn("_s", F.lit(True))
    ends = F.array("src", "dst")
    con = edges.filter("type = 'contradicts'").select(F.explode(ends).alias("memory_id")).groupBy("memory_id").agg(F.count("*").alias("_c"))
    idle = X.whole_days(now, _last_use())
    m = mem.join(sup, "memory_id", "left").join(con, "memory_id", "left").withColumn("_low", F.lower("content"))
    w = {
        "time_expired": F.when(F.col("valid_until") < now, F.least(F.lit(1.0), X.whole_days(now, F.col("valid_until")) / 30)),
        "no_recent_access": F.when(idle > inactive_days, F.least(F.lit(1.0), idle / (inactive_days * 2))),
        "orphaned": F.when(F.col("access_count") < 1, 0.5),
        "low_confidence": F.when(F.round(F.col("confidence"), 9) < confidence_floor, (confidence_floor - F.col("confidence")) / confidence_floor),
        "superseded": F.when(F.col("_s"), 0.8),
        "contradicted": F.when(F.col("_c") > 0, F.least(F.lit(1.0), F.col("_c") * 0.3)),
        "temporal_drift": F.when(X.contains_any(F.col("_low"), drift_words), 0.4),
    }
    m = m.withColumns({k: F.round(F.coalesce(v, F.lit(0.0)), 9) for k, v in w.items()})
    keep = F.lit(1.0)
    for k in w:
        keep = keep * (1.0 - F.col(k))
    m = m.withColumn("staleness", F.round(1.0 - keep, 9))
    s = F.col("staleness")
    return m.select("memory_id", "topic", *w, "staleness", X.label((s >= 0.8, "archive_or_delete"), (s >= 0.6, "review_and_update"), (s >= 0.4, "monitor"), default="keep").alias("action"))


SIGNALS = ["time_expired", "no_recent_access", "orphaned", "low_confidence", "superseded", "contradicted", "temporal_drift"]


def stale_summary(st: DataFrame) -> DataFrame:
    return st.groupBy("topic", "action").agg(F.count("*").alias("memories"), *[F.count_if(F.col(s) > 0).alias(s) for s in SIGNALS])


def integrity(mem: DataFrame, ver: DataFrame, msg: DataFrame, edges: DataFrame, as_of) -> DataFrame:
    """Five quality scores per memory and their weighted sum."""
    now = X.as_ts(as_of)
    r = F.col("ratio")
    quality = F.when(r.between(1.5, 10), 1.0).when(r < 1.5, 0.7).when(r > 20, 0.5).otherwise(0.8)
    v = ver.select("memory_id", X.jaccard(F.array_distinct(X.space_words(F.col("original"))), F.array_distinct(X.space_words(F.col("content")))).alias("j"), quality.alias("q"))
    v = v.groupBy("memory_id").agg(F.avg("j").alias("_j"), F.avg("q").alias("_q"))
    convs = msg.select("conv_id").distinct().withColumn("_conv", F.lit(True))
    msgs = msg.select("conv_id", "message_id").withColumn("_msg", F.lit(True))
    con = edges.filter("type = 'contradicts'").select(F.explode(F.array("src", "dst")).alias("memory_id")).groupBy("memory_id").agg(F.count("*").alias("_c"))
    m = mem.join(v, "memory_id", "left").join(convs, "conv_id", "left").join(msgs, ["conv_id", "message_id"], "left").join(con, "memory_id", "left")
    n = F.coalesce("_c", F.lit(0))
    scores = {
        "semantic_drift": F.when(F.col("resolution") == 0, 1.0).otherwise(F.coalesce("_j", F.lit(0.5))),
        "temporal_inconsistency": F.greatest(F.lit(0.0), 1.0 - F.when(F.col("valid_from") > F.col("valid_until"), 0.3).otherwise(0.0)
                                             - F.when(F.col("is_current") & (F.col("valid_until") < now), 0.4).otherwise(0.0) - F.when(F.col("valid_from") < F.col("created_at"), 0.2).otherwise(0.0)),
        "provenance_broken": F.greatest(F.lit(0.0), 1.0 - F.when(F.col("conv_id").isNull(), 0.3).when(F.col("_conv").isNull(), 0.5).otherwise(0.0)
                                        - F.when(F.col("message_id").isNull(), 0.2).when(F.col("_msg").isNull(), 0.4).otherwise(0.0)),
        "compression_artifact": F.coalesce("_q", F.lit(0.5)),
        "contradiction": F.when(n == 0, 1.0).when(n <= 2, 0.8).when(n <= 5, 0.6).otherwise(0.3),
    }
    m = m.withColumns({k: F.round(c, 9) for k, c in scores.items()})
    overall = sum((F.col(k) * w for k, w in INTEGRITY_WEIGHTS.items()), F.lit(0.0))
    return m.select("memory_id", *scores, F.round(overall, 9).alias("overall"))


def integrity_issues(integ: DataFrame) -> DataFrame:
    """One row per score below 0.7; below 0.3 is critical."""
    rows = F.array(*[F.struct(F.lit(k).alias("issue"), F.col(k).alias("score")) for k in INTEGRITY_WEIGHTS])
    i = integ.select("memory_id", F.explode(F.filter(rows, lambda x: x["score"] < 0.7)).alias("i")).select("memory_id", "i.issue", "i.score")
    return i.withColumn("severity", F.when(F.col("score") < 0.3, F.lit("critical")).otherwise(F.lit("warning")))


def healing_plan(issues: DataFrame) -> DataFrame:
    """Action and order of repair for each issue."""
    act = F.create_map(*[x for k, v in HEALING.items() for x in (F.lit(k), F.struct(F.lit(v[0]).alias("action"), F.lit(v[1]).alias("hi"), F.lit(v[2]).alias("lo")))])
    h = issues.withColumn("h", F.try_element_at(act, F.col("issue"))).filter("h is not null")
    h = h.select("memory_id", "issue", "severity", "h.action", F.when(F.col("severity") == "critical", F.col("h.hi")).otherwise(F.col("h.lo")).alias("priority"))
    return skew.top_k(h, ["memory_id"], [F.col("priority").desc(), F.col("issue")], len(HEALING), "step")


def repair_provenance(mem: DataFrame, msg: DataFrame, t: float = 0.8) -> DataFrame:
    """Most similar message (Jaccard above ``t``) of each memory without a source.  Copies count once.

    Equal sets are the only ones of score 1, so they are joined at once; only memories without one go into the search.
    """
    a = SIM.collapse(mem.filter("message_id is null"), "memory_id", X.space_words(F.col("content")), [])
    b = SIM.collapse(msg, "message_id", X.space_words(F.col("text")), [])
    equal = a.select("set_id").join(b.select("set_id", F.col("first_key").alias("message_id")), "set_id").select("set_id", "message_id", F.lit(1.0).alias("score"))
    rest = materialise(a.select("set_id", "s").join(b.select("set_id"), "set_id", "left_anti"), "sets-left")
    if rest.isEmpty():
        both = b.select("set_id").limit(0).withColumn("o", F.array().cast("array<int>"))
    else:
        both = SIM.by_rarity(rest.unionByName(b.select("set_id", "s")), "set_id")
    o = both.select("set_id", "o")
    p = SIM.jaccard_pairs(o.join(rest.select("set_id"), "set_id", "left_semi"), o.join(b.select("set_id"), "set_id", "left_semi"), [], t, id_col="set_id").filter(F.col("score") > t)
    p = p.join(b.select(F.col("set_id").alias("b_id"), F.col("first_key").alias("message_id")), "b_id")
    best = skew.latest_rows(p.select(F.col("a_id").alias("set_id"), "message_id", "score"), ["set_id"], [F.col("score"), -F.col("message_id")])
    best = best.select("set_id", "message_id", "score").unionByName(equal)
    m = mem.filter("message_id is null").select("memory_id", F.sha2(F.array_join(F.array_sort(F.array_distinct(X.space_words(F.col("content")))), " "), 256).alias("set_id"))
    return m.join(best, "set_id").select("memory_id", F.col("message_id").alias("repaired_message_id"), "score")


def restore(mem: DataFrame, ver: DataFrame, target: Column) -> DataFrame:
    """Most detailed stored version that is at least as compressed as the target and less than the memory itself."""
    want = mem.select("memory_id", target.cast("int").alias("target"))
    v = ver.select("memory_id", "resolution", "compressed_tokens")
    return want.join(v, "memory_id").filter(F.col("resolution") >= F.col("target")).groupBy("memory_id", "target").agg(
        F.min("resolution").alias("restored_resolution"), F.min_by("compressed_tokens", "resolution").alias("tokens"))


def merge_groups(mem: DataFrame, groups: DataFrame) -> DataFrame:
    """Merged memory per group: importance, confidence, size and the most recently updated member, whose text it takes."""
    j = mem.join(groups.select("memory_id", "group_id"), "memory_id")
    base = j.groupBy("group_id").agg(F.max("importance").alias("importance"), F.avg("confidence").alias("confidence"), F.count("*").alias("members"),
                                     F.max_by("memory_id", F.struct("updated_at", "memory_id")).alias("latest_id"))
    return base.join(mem.select(F.col("memory_id").alias("latest_id"), "content"), "latest_id")


def combine_groups(mem: DataFrame, groups: DataFrame) -> DataFrame:
    """Combined text of every group in long form: each member with its place and its titled part, in time order.

    A group is numbered day by day, so no task holds a whole group, and no row gathers its texts; writing the
    rows in order of group and place gives the combined text.
    """
    j = mem.join(groups.select("memory_id", "group_id"), "memory_id").select("group_id", "memory_id", "created_at", F.to_date("created_at").alias("_d"), F.lit(1).cast("long").alias("_one"), "content")
    j = skew.running_total(j, ["group_id"], "_d", ["created_at", "memory_id"], "_one", "place")
    title = F.concat(F.lit("=== Memory "), F.col("place").cast("string"), F.lit(" (ID: "), F.col("memory_id").cast("string"), F.lit(") ===\n"))
    return j.select("group_id", "place", "memory_id", F.concat(title, F.col("content")).alias("part"))


def merge_effects(groups: DataFrame, merged: DataFrame) -> DataFrame:
    """Archived originals and the edge each of them gets to the merged memory."""
    return groups.join(merged.select("group_id"), "group_id").select(
        "memory_id", F.lit("archived").alias("status"), F.col("group_id").alias("merged_into"), F.lit("elaborates").alias("edge_type"), F.lit(0.8).alias("strength"))


def split_memories(mem: DataFrame, header: str, key: str = "memory_id", text: str = "content") -> DataFrame:
    """Parts of each text cut at section headers; blank parts are dropped."""
    parts = F.filter(F.transform(F.split(F.col(text), header), X.strip), lambda p: p != "")
    return mem.select(key, F.posexplode(parts).alias("part", "content")).select(key, F.col("part").cast("long").alias("part"), "content")


def apply_evolution(mem: DataFrame, delta: DataFrame, at) -> DataFrame:
    """Revise, reinforce, reinterpret, keep and reject rows of a delta (memory_id, op, new_text) applied at once."""
    j = mem.join(delta, "memory_id")
    op = F.col("op")
    return j.select(
        "memory_id", "op",
        F.when(op.isin("revise", "reinterpret"), F.col("new_text")).otherwise(F.col("content")).alias("content"),
        F.round(F.when(op == "reinforce", F.least(F.lit(1.0), F.col("confidence") + 0.1)).when(op == "reject", F.col("confidence") * 0.5).otherwise(F.col("confidence")), 9).alias("confidence"),
        F.when(op == "reject", F.lit("archived")).otherwise(F.col("status")).alias("status"),
        F.when(op == "reinforce", F.col("access_count") + 1).otherwise(F.col("access_count")).alias("access_count"),
        F.when(op == "keep", F.col("updated_at")).otherwise(X.as_ts(at)).alias("updated_at"),
    )


def evolution_events(applied: DataFrame) -> DataFrame:
    return applied.filter("op <> 'keep'").select("memory_id", F.col("op").alias("event"), F.col("updated_at").alias("created_at"))


def validate_proposals(p: DataFrame, mem: DataFrame, events: DataFrame, cooldown_seconds: int = 3600) -> DataFrame:
    """Verdict and reasons of each proposal (proposal_id, memory_id, op, confidence, evidence, reason, to_status, other_id, created_at)."""
    last = events.groupBy("memory_id").agg(F.max("created_at").alias("_last"))
    known = mem.select(F.col("memory_id").alias("other_id")).withColumn("_other", F.lit(True))
    j = p.join(mem.select("memory_id", F.col("status").alias("_status")), "memory_id", "left").join(last, "memory_id", "left").join(known, "other_id", "left")
    op, conf, exists = F.col("op"), F.round(F.col("confidence"), 9), F.col("_status").isNotNull()
    elapsed = (F.unix_micros("created_at") - F.unix_micros("_last")) / 1e6
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    rules = [
        (~op.isin(DISPATCHABLE), "not dispatchable"),
        (~exists, "target missing"),
        (~conf.between(0, 1), "confidence out of range"),
        (blank("reason"), "reason missing"),
        (exists & (conf < F.when(op.isin(DESTRUCTIVE), 0.6).otherwise(0.4)), "confidence too low"),
        (exists & op.isin(NEEDS_EVIDENCE) & blank("evidence"), "evidence missing"),
        (exists & (op == "contradict") & (F.col("other_id").isNull() | (F.col("other_id") == F.col("memory_id")) | F.col("_other").isNull()), "other memory invalid"),
        (exists & (op == "transition") & ~F.coalesce(F.col("to_status").isin(list(ALLOWED)), F.lit(False)), "status invalid"),
        (exists & F.col("_status").isin("archived", "deep_archived") & ~op.isin(ARCHIVE_SAFE), "archived target"),
        (exists & (elapsed < cooldown_seconds), "cooldown"),
    ]
    reasons = F.array_compact(F.array(*[F.when(c, F.lit(r)) for c, r in rules]))
    return j.select("proposal_id", "memory_id", "op", F.when(F.size(reasons) == 0, F.lit("approve")).otherwise(F.lit("reject")).alias("verdict"), F.array_join(reasons, "; ").alias("reasons"))


def near_duplicates(mem: DataFrame, t: float = 0.75, text: str = "content") -> DataFrame:
    """For each memory its exact-set copies, the number of near-duplicate sets and the least memory among them."""
    w = X.search_tokens(F.col(text))
    sets = SIM.collapse(mem, "memory_id", w, [])
    # Many shared rare words before long sets are compared, for the pairs compared are shuffled with their sets.
    agg = SIM.containment_counts(SIM.by_rarity(sets), t, 24)
    s = sets.select("set_id", "first_key", "copies").join(agg, "first_key", "left")
    m = mem.select("memory_id", F.sha2(F.concat_ws(" ", F.array_join(F.array_sort(F.array_distinct(w)), " ")), 256).alias("set_id"))
    d = m.join(s, "set_id").filter("copies > 1 or near_sets is not null")
    return d.select("memory_id", "first_key", "copies", F.coalesce("near_sets", F.lit(0)).alias("near_sets"), "near_key")


def reflect(mem: DataFrame, edges: DataFrame, as_of, k: int = 25) -> DataFrame:
    """Best reflection candidates of each topic and one finding each: merge > archive > reinforce > keep > reinterpret."""
    s = state_vector(mem.filter("is_current and status in ('active', 'dormant')"), edges, as_of)
    pr = 0.3 * F.col("usage") + 0.25 * F.col("importance") + 0.25 * (1 - F.col("currentness")) + 0.2 * (1 - F.col("future_utility"))
    top = skew.top_k(s.withColumn("priority", F.round(pr, 9)), ["topic"], [F.col("priority").desc(), F.col("memory_id")], k)
    dup = near_duplicates(top).select("memory_id", F.lit(True).alias("_d"))
    rel = edges.filter("strength >= 0.4").select(F.explode(F.array("src", "dst")).alias("memory_id")).groupBy("memory_id").agg(F.count("*").alias("_rel"))
    j = top.join(dup, "memory_id", "left").join(rel, "memory_id", "left")
    age = X.frac_days(X.as_ts(as_of), F.col("created_at"))
    imp = F.round(F.col("importance"), 9)
    find = X.label(
        (F.col("_d"), "merge"), ((F.col("future_utility") <= 0.45) & (age >= 90) & (F.round("confidence", 9) <= 0.6), "archive"),
        ((F.col("access_count") >= 5) & (imp >= 0.6), "reinforce"), ((imp >= 0.7) & (F.col("access_count") <= 1) & (age >= 30), "keep"), (F.coalesce("_rel", F.lit(0)) >= 3, "reinterpret"))
    return j.withColumn("finding", find).select("memory_id", "topic", "rank", "priority", "finding")


def memory_confidence(mem: DataFrame, as_of) -> DataFrame:
    st = F.create_map(*[F.lit(x) for kv in STATUS_CONFIDENCE.items() for x in kv])
    age = F.greatest(F.lit(0.5), 1.0 - X.whole_days(X.as_ts(as_of), F.col("created_at")) / 365 * 0.3)
    use = F.least(F.lit(1.0), 1.0 + F.col("access_count") * 0.02)
    c = F.col("confidence") * F.coalesce(F.try_element_at(st, F.col("status")), F.lit(1.0)) * X.pick(RESOLUTION_CONFIDENCE, F.col("resolution")) * age * use
    return mem.withColumn("memory_confidence", F.round(X.clamp01(c), 9))


def result_confidence(sel: DataFrame, mem: DataFrame, level: int, as_of) -> DataFrame:
    """Confidence of the result set of each query (query_id, memory_id) with its label."""
    m = memory_confidence(mem, as_of).select("memory_id", "memory_confidence", is_valid(X.as_ts(as_of)).cast("int").alias("v"), F.col("conv_id").isNotNull().cast("int").alias("s"))
    g = sel.select("query_id", "memory_id").join(m, "memory_id").groupBy("query_id").agg(F.avg("memory_confidence").alias("mc"), F.avg("v").alias("tc"), F.avg("s").alias("sc"), F.count("*").alias("n"))
    rc = X.clamp01(F.col("mc") * LEVEL_CONFIDENCE[level] * F.least(F.lit(1.0), F.col("n") / 5.0))
    g = g.withColumn("overall", F.round(0.4 * F.col("mc") + 0.3 * rc + 0.15 * F.col("tc") + 0.15 * F.col("sc"), 9))
    o = F.col("overall")
    return g.select("query_id", F.col("n").alias("memories"), "overall", X.label((o >= 0.95, "certain"), (o >= 0.75, "confident"), (o >= 0.5, "uncertain"), default="vague").alias("level"))


def influence(sel: DataFrame, mem: DataFrame) -> DataFrame:
    """Influence of each selected memory: tokens the context loses without it, by importance and resolution.

    Leaving one out is the total less its own words, so nothing is run again per memory.
    """
    m = mem.select("memory_id", "importance", "resolution", F.size(X.space_words(F.col("content"))).cast("long").alias("own"))
    j = sel.select("query_id", "memory_id").join(m, "memory_id")
    total = j.groupBy("query_id").agg(F.sum("own").alias("total"))
    score = F.least(F.lit(1.0), F.least(F.lit(1.0), F.col("own") / 100) * F.col("importance") * (1.0 + F.col("resolution") / 5 * 0.5))
    return j.join(total, "query_id").select("query_id", "memory_id", "total", (F.col("total") - F.col("own")).alias("without"), F.round(score, 9).alias("influence"))
