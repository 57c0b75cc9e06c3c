"""Context assembly: parts, tier budgets, final selection and representation allocation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engramlake.functions import text as X
from engramlake.operators import recall as H
from engramlake.operators import skew

# Base priority of each recall level, tier shares, allocation weights and thresholds.
LEVEL_BASE = [(0, 0.9), (1, 0.7), (2, 0.5), (3, 0.3)]
TIERS = [("high", 0.50), ("medium", 0.35), ("low", 0.15)]
ALLOC = {"relevance": 0.40, "importance": 0.20, "confidence": 0.15, "temporal": 0.10, "detail": 0.05, "contradiction": 0.30}
CUT_MARK = "... [truncated]"
LEVELS = [("full", 0.7), ("compressed", 0.5), ("summary", 0.3), ("tag", -1.0)]


def context_parts(q: DataFrame, mem: DataFrame) -> DataFrame:
    """Parts per query: pool 0 as current state with priority one, pools 1 to 3 by base, importance and confidence.

    A memory found at several levels keeps its first level.
    """
    pools = []
    for level, base in LEVEL_BASE:
        p = H.candidates(mem, level).select("topic", "memory_id", F.lit(level).alias("level"), X.token_estimate(F.col("content")).alias("tokens"),
                                            F.round(F.lit(1.0) if level == 0 else F.lit(base) * F.col("importance") * F.col("confidence"), 9).alias("priority"))
        pools.append(p)
    u = reduce(DataFrame.unionByName, pools).groupBy("topic", "memory_id").agg(F.min_by(F.struct("level", "tokens", "priority"), "level").alias("x")).select("topic", "memory_id", "x.*")
    pr = F.col("priority")
    return q.select("query_id", "topic").join(u, "topic").withColumn("tier", X.label((pr >= 0.7, "high"), (pr >= 0.3, "medium"), default="low"))


def _ordered() -> list[Column]:
    return [F.col("priority").desc(), F.col("memory_id")]


def tier_budget(parts: DataFrame, max_tokens: int) -> DataFrame:
    """Fill tiers of 50, 35 and 15 per cent in part order; a part that does not fit its tier may use a lower one.

    A fold over one sorted array per query; the pools of the recall levels bound it.
    """
    items = F.array_sort(F.collect_list(F.struct("level", (-F.col("priority")).alias("np"), "memory_id", "tokens", "tier")))
    a = parts.groupBy("query_id").agg(items.alias("xs"))
    cap = {t: int(max_tokens * r) for t, r in TIERS}
    zero = F.struct(*[F.lit(0).cast("long").alias(t) for t, _ in TIERS], F.array().cast("array<struct<memory_id:bigint,tier:string,tokens:bigint>>").alias("out"))

    def step(acc, x):
        fits = lambda t: acc[t] + x["tokens"] <= cap[t]
        use = F.when((x["tier"] == "high") & fits("high"), F.lit("high")).when(fits("medium") & (x["tier"] != "low"), F.lit("medium")).when(fits("low"), F.lit("low"))
        new = F.struct(*[F.when(use == t, acc[t] + x["tokens"]).otherwise(acc[t]).alias(t) for t, _ in TIERS], F.concat(acc["out"], F.array(F.struct(x["memory_id"].alias("memory_id"), use.alias("tier"), x["tokens"].alias("tokens")))).alias("out"))
        return F.when(use.isNotNull(), new).otherwise(acc)

    return a.select("query_id", F.explode(F.aggregate("xs", zero, step)["out"]).alias("o")).select("query_id", "o.*")


def select_parts(parts: DataFrame, max_tokens: int, min_rest: int = 100) -> DataFrame:
    """Prefix of the parts within the budget; the first that overflows is cut if more than ``min_rest`` tokens remain.

    Parts that bring their text (``content``) return it, cut to three characters a token and marked where it is cut.
    """
    from pyspark.sql import Window

    head = skew.top_k(parts, ["query_id"], _ordered(), max_tokens + 1, "n")
    w = Window.partitionBy("query_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    h = head.withColumn("before", F.coalesce(F.sum("tokens").over(w), F.lit(0)))
    rest = F.lit(max_tokens) - F.col("before")
    fits = F.col("tokens") <= rest
    # Only the first overflowing part still has a positive rest and all parts before it fit.
    first = ~fits & (rest > min_rest)
    h = h.withColumn("fits", fits).withColumn("cut", first)
    text = [F.when(F.col("cut"), F.concat(F.substring(F.col("content"), F.lit(1), (rest * 3).cast("int")), F.lit(CUT_MARK))).otherwise(F.col("content")).alias("content")] if "content" in parts.columns else []
    return h.filter("fits or cut").select("query_id", "memory_id", "priority", F.when(F.col("cut"), rest).otherwise(F.col("tokens")).alias("tokens"), F.col("cut").alias("truncated"), *text)


def selection_stats(parts: DataFrame, sel: DataFrame) -> DataFrame:
    a = parts.groupBy("query_id").agg(F.count("*").alias("parts"), F.sum("tokens").alias("raw_tokens"))
    b = sel.groupBy("query_id").agg(F.count("*").alias("selected"), F.sum("tokens").alias("effective_tokens"), F.count_if("truncated").alias("truncated"))
    return a.join(b, "query_id").withColumn("ratio", F.col("raw_tokens") / F.col("effective_tokens"))


def allocation_priority(q: DataFrame, pool: DataFrame, state: DataFrame) -> DataFrame:
    """Priority and desired representation of each pool memory for the queries of its topic."""
    ask = q.select("query_id", "topic", F.array_distinct(X.search_tokens(F.col("text"))).alias("qt"))
    s = state.select("memory_id", "temporal", "detail", "contradiction_risk")
    p = pool.select("topic", "memory_id", "resolution", "importance", "confidence", X.token_estimate(F.col("content")).alias("tokens"), F.array_distinct(X.search_tokens(F.col("content"))).alias("mt")).join(s, "memory_id")
    j = ask.join(p, "topic").withColumn("relevance", F.when(F.size("qt") > 0, X.overlap(F.col("qt"), F.col("mt")) / F.size("qt")).otherwise(0.0))
    pr = (ALLOC["relevance"] * F.col("relevance") + ALLOC["importance"] * F.col("importance") + ALLOC["confidence"] * F.col("confidence") + ALLOC["temporal"] * F.col("temporal")
          + ALLOC["detail"] * F.col("detail") - ALLOC["contradiction"] * F.col("contradiction_risk"))
    j = j.withColumn("priority", F.round(X.clamp01(pr), 9))
    return j.select("query_id", "memory_id", "resolution", "tokens", "relevance", "priority", X.label(*[(F.col("priority") >= t, n) for n, t in LEVELS[:3]], default="tag").alias("desired"))


def allocate(prio: DataFrame, ver: DataFrame, budget: int, tag_tokens: int = 8) -> DataFrame:
    """Best representation that fits, full to tag, in priority order; a fold over one bounded array per query."""
    v = ver.groupBy("memory_id").agg(F.map_from_entries(F.collect_list(F.struct("resolution", "compressed_tokens"))).alias("vs"))
    j = prio.join(v, "memory_id", "left")
    at = lambda k: F.try_element_at(F.col("vs"), F.col("resolution") + k)
    comp, summ = at(1), F.coalesce(at(1), at(2))
    form = lambda n, t: F.struct(F.lit(n).alias("level"), t.cast("long").alias("t"))
    ladder = F.array(form("full", F.col("tokens")), form("compressed", comp), form("summary", summ), form("tag", F.lit(tag_tokens)))
    start = F.array_position(F.array(*[F.lit(n) for n, _ in LEVELS]), F.col("desired"))
    j = j.select("query_id", F.struct((-F.col("priority")).alias("np"), "memory_id", "desired", F.filter(F.slice(ladder, start.cast("int"), F.lit(4)), lambda x: x["t"].isNotNull()).alias("forms")).alias("x"))
    a = j.groupBy("query_id").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    zero = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<memory_id:bigint,desired:string,level:string,tokens:bigint>>").alias("out"))

    def step(acc, x):
        fit = F.get(F.filter(x["forms"], lambda f: acc["used"] + f["t"] <= budget), F.lit(0))
        row = F.struct(x["memory_id"].alias("memory_id"), x["desired"].alias("desired"), F.coalesce(fit["level"], F.lit("omit")).alias("level"), F.coalesce(fit["t"], F.lit(0).cast("long")).alias("tokens"))
        return F.struct((acc["used"] + F.coalesce(fit["t"], F.lit(0).cast("long"))).alias("used"), F.concat(acc["out"], F.array(row)).alias("out"))

    return a.select("query_id", F.explode(F.aggregate("xs", zero, step)["out"]).alias("o")).select("query_id", "o.*")


def allocation_stats(alloc: DataFrame, prio: DataFrame) -> DataFrame:
    """Used tokens, rows per level and priority per token of each query."""
    j = alloc.join(prio.select("query_id", "memory_id", "priority"), ["query_id", "memory_id"])
    g = j.groupBy("query_id").agg(F.sum("tokens").alias("used_tokens"), *[F.count_if(F.col("level") == n).alias(n) for n in ("full", "compressed", "summary", "tag", "omit")],
                                  F.sum(F.when(F.col("level") != "omit", F.col("priority"))).alias("_u"))
    return g.withColumn("utility_per_token", F.when(F.col("used_tokens") > 0, F.col("_u") / F.col("used_tokens")).otherwise(0.0)).drop("_u")
