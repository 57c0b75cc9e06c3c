from pyspark.sql import functions as F

from engramlake.operators import governance as G
from engramlake.operators import textfeatures as D
from engramlake.session import AS_OF
from engramlake.sources import bindings as B
from registry import EXTRA_CTES, query
from registry import snippets as S
from registry.lifecycle import AGE, IDLE, IMP, NOW
from registry.textfeatures import _pii_sql

RULES = [dict(r, min_age=r["min_age"] // 10) if "min_age" in r else dict(r, min_idle=300) if "min_idle" in r else dict(r, min_importance=0.8) for r in G.RETENTION_RULES]
RULES.append({"rule": "anonymise_recent", "action": "anonymise", "priority": 40, "min_age": 10})


def _cond(r):
    c = []
    if "min_age" in r:
        c.append(f"{AGE} >= {r['min_age']}")
    if "min_idle" in r:
        c.append(f"{IDLE} >= {r['min_idle']}")
    if "min_importance" in r:
        c.append(f"{IMP} >= {r['min_importance']}")
    if "max_importance" in r:
        c.append(f"{IMP} <= {r['max_importance']}")
    return " AND ".join(c)


_cases = " ".join(f"WHEN {_cond(r)} THEN {{'r': '{r['rule']}', 'a': '{r['action']}', 'p': {r['priority']}}}" for r in sorted(RULES, key=lambda r: r["priority"]))
EXTRA_CTES["rplan"] = f"WITH a AS (SELECT memory_id, CASE {_cases} END AS h FROM mem) SELECT memory_id, h.r AS rule, h.a AS action, CAST(h.p AS INTEGER) AS priority FROM a WHERE h IS NOT NULL"


@query("retention_plan", "SELECT * FROM rplan")
def retention_plan(spark, d):
    return G.retention_plan(B.memories(spark, d), AS_OF, RULES)


_p, _last = _pii_sql("documents", "doc_id", "text")


@query("apply_retention", f"""{_p} SELECT m.memory_id, r.action, CASE WHEN action = 'archive' THEN 'archived' ELSE status END AS status, CAST(CASE WHEN action = 'compress' THEN least(5, resolution + 1) ELSE resolution END AS INTEGER) AS resolution,
CASE WHEN action = 'anonymise' THEN {_last}.t ELSE content END AS content, coalesce(action = 'review', false) AS needs_review FROM mem m JOIN {_last} ON {_last}.doc_id = m.memory_id LEFT JOIN rplan r ON r.memory_id = m.memory_id WHERE action IS NULL OR action <> 'delete'""")
def apply_retention(spark, d):
    m = B.memories(spark, d)
    return G.apply_retention(m, G.retention_plan(m, AS_OF, RULES))


VRULES = [dict(r, max_bytes=8000) if "max_bytes" in r else dict(r, min_confidence=0.55) if "min_confidence" in r else dict(r, max_tokens=2000) if "max_tokens" in r else dict(r, max_age=500) if "max_age" in r
          else dict(r, patterns=["@example", "haha"]) if r["rule"] == "pii_detection" else r for r in G.VIOLATION_RULES]


def _vsql(src):
    conds = {"max_bytes": "octet_length(encode(content)) > {}", "min_confidence": "round(confidence, 9) < {}", "max_tokens": S.tokens("content") + " > {}", "max_age": AGE + " > {}", "max_ratio": "false"}
    rows = []
    for r in VRULES:
        k = next(k for k in list(conds) + ["patterns"] if k in r)
        c = S.contains_any("lower(content)", r["patterns"]) if k == "patterns" else conds[k].format(r[k])
        rows.append(f"SELECT memory_id, '{r['rule']}' AS rule, '{r['domain']}' AS domain, '{r['severity']}' AS severity, '{r['action']}' AS action FROM {src} WHERE {c}")
    return " UNION ALL ".join(rows)


EXTRA_CTES["viol"] = _vsql("mem")


@query("rule_violations", "SELECT * FROM viol")
def rule_violations(spark, d):
    return G.violations(B.memories(spark, d), AS_OF, VRULES)


@query("compliance_report", "SELECT domain, severity, memory_id % 3 = 0 AS resolved, count(*) AS violations FROM viol GROUP BY ROLLUP (domain, severity, memory_id % 3 = 0)")
def compliance_report(spark, d):
    return G.compliance(G.violations(B.memories(spark, d), AS_OF, VRULES).withColumn("resolved", F.col("memory_id") % 3 == 0))


@query("trust_decisions", """WITH a AS (SELECT c_custkey AS node_id, ['untrusted', 'low', 'medium', 'high', 'implicit'][1 + c_custkey % 5] AS trust_level FROM customer)
SELECT *, CASE trust_level WHEN 'untrusted' THEN 'deny' WHEN 'low' THEN 'deny' WHEN 'high' THEN 'allow' WHEN 'implicit' THEN 'allow' ELSE 'deny' END AS decision, trust_level IN ('high', 'implicit') AS allowed FROM a""")
def trust_decisions(spark, d):
    from engramlake.functions.text import pick

    n = B.table(spark, d, "customer").select(F.col("c_custkey").alias("node_id"), pick(["untrusted", "low", "medium", "high", "implicit"], F.col("c_custkey") % 5).alias("trust_level"))
    return G.trust_decisions(n)


EXTRA_CTES["share"] = f"""WITH r AS (SELECT event_id // 20 AS request_id, event_id % 1050 AS memory_id, ['untrusted', 'low', 'medium', 'high', 'implicit'][1 + (event_id // 20) % 5] AS trust_level, CASE WHEN (event_id // 20) % 4 = 0 THEN 'src' || (event_id // 20) % 20 END AS topic_filter,
 CASE WHEN (event_id // 20) % 9 = 0 THEN TIMESTAMP '2024-06-01' END AS expires_at FROM events)
SELECT DISTINCT request_id, r.memory_id, coalesce(trust_level <> 'untrusted' AND (expires_at IS NULL OR expires_at >= {NOW}) AND topic IS NOT NULL AND (topic_filter IS NULL OR topic = topic_filter)
 AND round(importance * confidence, 9) <= CASE trust_level WHEN 'low' THEN 0.3 WHEN 'medium' THEN 0.5 WHEN 'high' THEN 0.8 WHEN 'implicit' THEN 1.0 ELSE 0.0 END, false) AS approved FROM r LEFT JOIN mem m ON m.memory_id = r.memory_id"""


def _share(spark, d):
    from engramlake.functions.text import pick

    e = B.table(spark, d, "events").select(F.expr("event_id div 20").alias("request_id"), (F.col("event_id") % 1050).alias("memory_id")).distinct()
    r = F.col("request_id")
    e = e.withColumn("trust_level", pick(["untrusted", "low", "medium", "high", "implicit"], r % 5)).withColumn("topic_filter", F.when(r % 4 == 0, F.concat(F.lit("src"), r % 20))).withColumn("expires_at", F.when(r % 9 == 0, F.lit("2024-06-01").cast("timestamp")))
    return G.share_filter(e, B.memories(spark, d), AS_OF)


@query("share_filter", "SELECT * FROM share")
def share_filter(spark, d):
    return _share(spark, d)


@query("share_summary", "SELECT request_id, count(*) FILTER (approved) AS approved, count(*) FILTER (NOT approved) AS rejected, CASE WHEN bool_or(approved) THEN 'approved' ELSE 'rejected' END AS status FROM share GROUP BY request_id")
def share_summary(spark, d):
    return G.share_summary(_share(spark, d))


@query("tenant_usage", f"""WITH u AS (SELECT topic AS tenant, count(*) AS memories, CAST(sum({S.tokens('content')}) AS BIGINT) AS tokens, CAST(sum(octet_length(encode(content))) AS BIGINT) AS bytes FROM mem GROUP BY topic),
t AS (SELECT DISTINCT source AS tenant, 50 AS mm, 38000 AS mt FROM documents WHERE source <> 'src3')
SELECT tenant, memories, tokens, bytes, concat_ws(',', CASE WHEN memories > mm THEN 'memories' END, CASE WHEN tokens > mt THEN 'tokens' END) AS over_quota FROM u LEFT JOIN t USING (tenant)""")
def tenant_usage(spark, d):
    m = B.memories(spark, d).withColumn("tenant", F.col("topic"))
    t = B.table(spark, d, "documents").filter("source <> 'src3'").select(F.col("source").alias("tenant")).distinct().withColumn("max_memories", F.lit(50)).withColumn("max_tokens", F.lit(38000))
    return G.tenant_usage(m, t)


EXTRA_CTES["audit"] = "SELECT event_id, ts, event_type AS type, ['info', 'warning', 'error', 'critical'][1 + event_id % 4] AS severity, 'tenant_' || user_id % 7 AS tenant, user_id FROM events"


def audit(spark, d):
    from engramlake.functions.text import pick

    return B.table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("type"), pick(["info", "warning", "error", "critical"], F.col("event_id") % 4).alias("severity"),
                                              F.concat(F.lit("tenant_"), F.col("user_id") % 7).alias("tenant"), "user_id")


@query("audit_stats", "SELECT 'type' AS dimension, type AS value, count(*) AS events FROM audit GROUP BY type UNION ALL SELECT 'severity', severity, count(*) FROM audit GROUP BY severity UNION ALL SELECT 'tenant', tenant, count(*) FROM audit GROUP BY tenant")
def audit_stats(spark, d):
    return G.audit_stats(audit(spark, d))
