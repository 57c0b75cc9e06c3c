"""Governance jobs: retention, rule violations, compliance, trust, sharing, tenants and audit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramlake.functions import text as X
from engramlake.operators.textfeatures import mask_pii

# Default rules.  Rule sets are literal and small, so they are expressions on each row, not joins.
RETENTION_RULES = [
    {"rule": "delete_after_20_years", "action": "delete", "priority": 5, "min_age": 7300},
    {"rule": "keep_critical_forever", "action": "review", "priority": 5, "min_importance": 0.9},
    {"rule": "archive_after_7_years", "action": "archive", "priority": 10, "min_age": 2555},
    {"rule": "compress_after_1_year", "action": "compress", "priority": 20, "min_age": 365},
    {"rule": "archive_low_importance", "action": "archive", "priority": 25, "min_age": 365, "max_importance": 0.3},
    {"rule": "archive_unaccessed_2_years", "action": "archive", "priority": 30, "min_idle": 730},
]
VIOLATION_RULES = [
    {"rule": "memory_max_size", "domain": "memory", "severity": "error", "action": "deny", "max_bytes": 10 * 1024 * 1024},
    {"rule": "memory_confidence_minimum", "domain": "memory", "severity": "warning", "action": "require_approval", "min_confidence": 0.3},
    {"rule": "recall_token_limit", "domain": "recall", "severity": "error", "action": "deny", "max_tokens": 8000},
    {"rule": "compression_ratio_limit", "domain": "compression", "severity": "warning", "action": "require_approval", "max_ratio": 20.0},
    {"rule": "retention_max_age", "domain": "retention", "severity": "info", "action": "log", "max_age": 2555},
    {"rule": "pii_detection", "domain": "security", "severity": "critical", "action": "quarantine", "patterns": ["ssn", "credit_card", "api_key", "password"]},
    {"rule": "injection_attempt", "domain": "security", "severity": "critical", "action": "quarantine", "patterns": ["ignore previous", "system prompt", "override"]},
]
TRUST_RULES = [("untrusted", "deny", 1), ("high", "allow", 1), ("low", "deny", 1), ("implicit", "allow", 2)]
TRUST_DEFAULT = "deny"
SHARE_FLOOR = {"low": 0.3, "medium": 0.5, "high": 0.8, "implicit": 1.0}


def retention_plan(mem: DataFrame, as_of, rules=RETENTION_RULES) -> DataFrame:
    """Best rule per memory by priority, equal priorities in rule order."""
    now = X.as_ts(as_of)
    age, idle = X.whole_days(now, F.col("created_at")), X.whole_days(now, F.coalesce("last_accessed", "created_at"))
    imp = F.round(F.col("importance"), 9)

    def applies(r):
        c = F.lit(True)
        if "min_age" in r:
            c = c & (age >= r["min_age"])
        if "min_idle" in r:
            c = c & (idle >= r["min_idle"])
        if "min_importance" in r:
            c = c & (imp >= r["min_importance"])
        if "max_importance" in r:
            c = c & (imp <= r["max_importance"])
        return c

    ordered = sorted(rules, key=lambda r: r["priority"])
    hit = F.coalesce(*[F.when(applies(r), F.struct(F.lit(r["rule"]).alias("rule"), F.lit(r["action"]).alias("action"), F.lit(r["priority"]).alias("priority"))) for r in ordered])
    return mem.select("memory_id", hit.alias("h")).filter("h is not null").select("memory_id", "h.*")


def apply_retention(mem: DataFrame, plan: DataFrame) -> DataFrame:
    """Memories after archive, compress, anonymise and review; deleted ones are gone."""
    kept = mem.join(plan.filter("action = 'delete'").select("memory_id"), "memory_id", "left_anti").join(plan.select("memory_id", "action"), "memory_id", "left")
    masked = mask_pii(kept.withColumn("_m", F.col("content")), "_m")
    a = F.col("action")
    return masked.select(
        "memory_id", "action", F.when(a == "archive", F.lit("archived")).otherwise(F.col("status")).alias("status"),
        F.when(a == "compress", F.least(F.lit(5), F.col("resolution") + 1)).otherwise(F.col("resolution")).cast("int").alias("resolution"),
        F.when(a == "anonymise", F.col("_m")).otherwise(F.col("content")).alias("content"), F.coalesce(a == "review", F.lit(False)).alias("needs_review"))


def violations(ctx: DataFrame, as_of, rules=VIOLATION_RULES) -> DataFrame:
    """Rows (memory_id, rule, domain, severity, action) of every broken rule."""
    low = F.lower("content")
    age = X.whole_days(X.as_ts(as_of), F.col("created_at"))

    def broken(r):
        c = F.lit(False)
        if "max_bytes" in r:
            c = c | (F.octet_length("content") > r["max_bytes"])
        if "min_confidence" in r:
            c = c | (F.round("confidence", 9) < r["min_confidence"])
        if "max_tokens" in r:
            c = c | (X.token_estimate(F.col("content")) > r["max_tokens"])
        if "max_ratio" in r and "ratio" in ctx.columns:
            c = c | (F.col("ratio") > r["max_ratio"])
        if "max_age" in r:
            c = c | (age > r["max_age"])
        if "patterns" in r:
            c = c | X.contains_any(low, r["patterns"])
        return c

    rows = F.array_compact(F.array(*[F.when(broken(r), F.struct(*[F.lit(r[k]).alias(k) for k in ("rule", "domain", "severity", "action")])) for r in rules]))
    return ctx.select("memory_id", F.explode(rows).alias("v")).select("memory_id", "v.*")


def compliance(v: DataFrame) -> DataFrame:
    """Counts by domain, severity and resolution with subtotals."""
    return v.rollup("domain", "severity", "resolved").agg(F.count("*").alias("violations"))


def trust_decisions(nodes: DataFrame, rules=TRUST_RULES, default: str = TRUST_DEFAULT) -> DataFrame:
    """Decision per node (node_id, trust_level): rules in rising priority, the last match wins."""
    ordered = sorted(rules, key=lambda r: r[2])
    d = F.lit(default)
    for level, action, _ in ordered:
        d = F.when(F.col("trust_level") == level, F.lit(action)).otherwise(d)
    return nodes.withColumn("decision", d).withColumn("allowed", d == "allow")


def share_filter(req: DataFrame, mem: DataFrame, as_of) -> DataFrame:
    """Approval of each requested memory (request_id, memory_id, trust_level, topic_filter, expires_at) in long form."""
    j = req.join(mem.select("memory_id", "topic", "importance", "confidence"), "memory_id", "left")
    floor = F.create_map(*[F.lit(x) for kv in SHARE_FLOOR.items() for x in kv])
    value = F.round(F.col("importance") * F.col("confidence"), 9)
    ok = (
        (F.col("trust_level") != "untrusted") & (F.col("expires_at").isNull() | (F.col("expires_at") >= X.as_ts(as_of))) & F.col("topic").isNotNull()
        & (F.col("topic_filter").isNull() | (F.col("topic") == F.col("topic_filter"))) & (value <= F.coalesce(F.try_element_at(floor, F.col("trust_level")), F.lit(0.0)))
    )
    return j.select("request_id", "memory_id", F.coalesce(ok, F.lit(False)).alias("approved"))


def share_summary(s: DataFrame) -> DataFrame:
    g = s.groupBy("request_id").agg(F.count_if("approved").alias("approved"), F.count_if(~F.col("approved")).alias("rejected"))
    return g.withColumn("status", F.when(F.col("approved") > 0, F.lit("approved")).otherwise(F.lit("rejected")))


def tenant_usage(mem: DataFrame, tenants: DataFrame) -> DataFrame:
    """Memories, tokens and bytes per tenant against its limits (tenant, max_memories, max_tokens)."""
    u = mem.groupBy("tenant").agg(F.count("*").alias("memories"), F.sum(X.token_estimate(F.col("content"))).alias("tokens"), F.sum(F.octet_length("content").cast("long")).alias("bytes"))
    j = u.join(tenants, "tenant", "left")
    v = F.array_join(F.array_compact(F.array(F.when(F.col("memories") > F.col("max_memories"), F.lit("memories")), F.when(F.col("tokens") > F.col("max_tokens"), F.lit("tokens")))), ",")
    return j.select("tenant", "memories", "tokens", "bytes", v.alias("over_quota"))


def audit_stats(ev: DataFrame) -> DataFrame:
    """Counts by type, by severity and by tenant in one pass."""
    rows = F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).alias("value")) for c in ("type", "severity", "tenant")])
    return ev.select(F.explode(rows).alias("r")).groupBy("r.dimension", "r.value").agg(F.count("*").alias("events"))
