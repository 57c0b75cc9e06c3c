"""Metrics and evaluation analytics over answer, question and metric tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engramlake.functions import lexicons as L
from engramlake.functions import text as X
from engramlake.operators import skew
from engramlake.operators.textfeatures import abstains, answer_form
from engramlake.session import materialise

OUTCOMES = ["pass", "partial", "fail", "false_positive"]


def metric_summary(m: DataFrame, by: list[str]) -> DataFrame:
    return m.groupBy(*by).agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"), F.sum("value").alias("total"))


#: Ranges into which each doubling of the value is cut.
RANGES = 16


def percentiles(m: DataFrame, by: list[str], ps: tuple[int, ...] = (50, 90, 95, 99)) -> DataFrame:
    """Exact order statistics at index floor(n * p / 100) per key.

    Equal values are counted first and the running count is cut into value ranges, ``RANGES`` to each doubling of the
    value, so no key is sorted in one task whatever the scale of its values.
    """
    v = m.groupBy(*by, "value").agg(F.count("*").alias("c"))
    # Rises with the value: 1,100 doublings lie below the least positive double.
    size = F.floor((F.log2(F.abs("value")) + 1100) * RANGES)
    v = v.withColumn("_range", F.when(F.col("value") == 0, F.lit(0)).otherwise(F.signum("value") * size).cast("long"))
    v = skew.running_total(v, by, "_range", ["value"], "c", "cum")
    n = v.groupBy(*by).agg(F.sum("c").alias("n"))
    j = v.join(n, by)
    at = lambda p: F.min(F.when(F.col("cum") > F.least(F.col("n") - 1, F.floor(F.col("n") * p / 100)), F.col("value"))).alias(f"p{p}")
    lo, hi = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    med = ((F.min(F.when(F.col("cum") > lo, F.col("value"))) + F.min(F.when(F.col("cum") > hi, F.col("value")))) / 2).alias("median")
    return j.groupBy(*by, "n").agg((F.sum(F.col("value") * F.col("c")) / F.sum("c")).alias("mean"), med, *[at(p) for p in ps])


def approx_percentiles(m: DataFrame, by: list[str], ps: tuple[int, ...] = (50, 90, 95, 99), accuracy: int = 10000) -> DataFrame:
    """Least value that p percent of the rows of a key do not exceed: brackets from the approximate sketch, exact by a second pass.

    The sketch is off by at most n / accuracy ranks, so the values four times as far to either side hold the wanted one.
    Rows below a bracket are only counted; the values inside, a bounded share of the key, are counted one by one.
    """
    part = lambda x: min(1.0, max(0.0, x))
    ends = m.groupBy(*by).agg(F.count("value").alias("_n"), F.count("*").alias("n"), *[
        F.struct(F.percentile_approx("value", part(p / 100 - 4 / accuracy), accuracy).alias("lo"), F.percentile_approx("value", part(p / 100 + 4 / accuracy), accuracy).alias("hi")).alias(f"_e{p}") for p in ps])
    ends = materialise(ends, "percentile-ends")
    e = ends.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(by)], "_n", F.explode(F.array(*[F.struct(F.lit(p).alias("p"), f"_e{p}.lo", f"_e{p}.hi") for p in ps])).alias("_e"))
    same = [m[k].eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(by)]
    keys = [F.col(f"_k{i}") for i in range(len(by))]
    j = m.join(e, same).filter(F.col("value") <= F.col("_e.hi"))
    # One row for all values below a bracket and one for each value inside.
    c = j.groupBy(*keys, "_n", "_e.p", F.when(F.col("value") >= F.col("_e.lo"), F.col("value")).alias("_v")).agg(F.count("*").alias("_c"))
    along = Window.partitionBy(*keys, "p").orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    c = c.withColumn("_cum", F.sum("_c").over(along)).filter(F.col("_v").isNotNull() & (F.col("_cum") >= F.ceil(F.col("_n") * F.col("p") / 100)))
    exact = c.groupBy(*keys).agg(*[F.min(F.when(F.col("p") == p, F.col("_v"))).alias(f"p{p}") for p in ps])
    return ends.select(*by, "n").join(exact, [ends[k].eqNullSafe(exact[f"_k{i}"]) for i, k in enumerate(by)], "left").select(*by, "n", *[f"p{p}" for p in ps])


def histogram_buckets(m: DataFrame, by: list[str], bounds: list[float]) -> DataFrame:
    """Cumulative counts of values up to each bound."""
    rows = F.array(*[F.struct(F.lit(float(b)).alias("le"), F.count_if(F.col("value") <= b).alias("n")) for b in bounds], F.struct(F.lit(float("inf")).alias("le"), F.count("*").alias("n")))
    return m.groupBy(*by).agg(rows.alias("r")).select(*by, F.explode("r").alias("x")).select(*by, F.col("x.le").cast("string").alias("le"), F.col("x.n").alias("n"))


def counters(m: DataFrame, by: list[str], order: str) -> DataFrame:
    """Counter total and latest gauge value of each label set."""
    return m.groupBy(*by).agg(F.sum("value").alias("counter"), F.max_by("value", F.struct("ts", order)).alias("gauge"))


def token_usage(u: DataFrame) -> DataFrame:
    return u.cube("operation", "model").agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"))


def _has(term: Column, text: Column) -> Column:
    """Term as a whole word (or phrase) of a padded text; the term itself is padded the same way."""
    return text.contains(X.padded(term))


def score_answers(q: DataFrame, a: DataFrame, markers=L.ABSTENTION_MARKERS) -> DataFrame:
    """Outcome and score of every answer against synonym groups, forbidden terms and expected abstention."""
    j = a.join(q, "question_id").withColumn("_p", X.padded(F.col("text"))).withColumn("_f", answer_form(F.col("text")))
    covered = F.size(F.filter("ground_truth", lambda g: F.exists(g, lambda t: _has(t, F.col("_p")))))
    j = j.withColumns({
        "covered": covered.cast("long"), "groups": F.size("ground_truth").cast("long"),
        "forbidden_hit": F.exists("forbidden", lambda t: _has(t, F.col("_p"))), "abstained": abstains(F.col("_f"), markers), "blank": F.col("_f") == "",
    })
    full = (F.col("groups") > 0) & (F.col("covered") == F.col("groups"))
    outcome = X.label(
        (F.col("blank"), "fail"),
        (F.col("expected_abstention") & F.col("abstained") & F.col("forbidden_hit"), "false_positive"), (F.col("expected_abstention") & F.col("abstained"), "pass"),
        (F.col("expected_abstention") & full, "pass"), (F.col("expected_abstention"), "false_positive"),
        (F.col("forbidden_hit"), "fail"), (F.col("covered") == F.col("groups"), "pass"), (F.col("covered") > 0, "partial"), default="fail")
    j = j.withColumn("outcome", outcome).withColumn("coverage", F.when(F.col("groups") > 0, F.col("covered") / F.col("groups")).otherwise(1.0))
    s = F.when(F.col("outcome") == "pass", 1.0).when(F.col("outcome") == "partial", F.col("coverage")).otherwise(0.0)
    return j.withColumn("score", F.round(s, 9)).drop("_p", "_f", "ground_truth", "forbidden", "blank")


def majority(scored: DataFrame) -> DataFrame:
    """Official answer per player and question: the most frequent text, least repeat on ties, and the share of repeats that agree."""
    keys = ["player", "question_id"]
    t = scored.groupBy(*keys, "text").agg(F.count("*").alias("n"), F.min("repeat").alias("first"), F.first("outcome").alias("outcome"), F.first("score").alias("score"))
    best = t.groupBy(*keys).agg(F.max_by(F.struct("text", "outcome", "score"), F.struct("n", -F.col("first"))).alias("b"), F.sum("n").alias("repeats"))
    agree = scored.join(best, keys).groupBy(*keys).agg(F.count_if(F.col("outcome") == F.col("b.outcome")).alias("agree"))
    return best.join(agree, keys).select(*keys, "b.text", "b.outcome", "b.score", "repeats", F.round(F.col("agree") / F.col("repeats"), 9).alias("consistency"))


def aggregate_scores(s: DataFrame) -> DataFrame:
    """Rates per player, per player and category, and overall."""
    return s.rollup("player", "category").agg(
        F.count("*").alias("answers"), *[F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES],
        F.avg((F.col("outcome") == "pass").cast("int")).alias("accuracy"), F.avg(F.col("forbidden_hit").cast("int")).alias("forbidden_rate"),
        F.avg("coverage").alias("mean_coverage"), F.avg("score").alias("mean_score"))


def score_retrieval(q: DataFrame, ctx: DataFrame) -> DataFrame:
    """Does the context (question_id, context, is_abstention) hold all ground truth and nothing forbidden?"""
    j = ctx.join(q, "question_id").withColumn("_p", X.padded(F.col("context")))
    j = j.withColumn("covered", F.size(F.filter("ground_truth", lambda g: F.exists(g, lambda t: _has(t, F.col("_p"))))).cast("long")).withColumn("forbidden_hit", F.exists("forbidden", lambda t: _has(t, F.col("_p"))))
    passed = F.when(F.col("expected_abstention"), F.col("is_abstention") & ~F.col("forbidden_hit")).otherwise((F.col("covered") == F.size("ground_truth")) & ~F.col("forbidden_hit"))
    score = F.when(passed, 1.0).when(F.col("expected_abstention") | (F.size("ground_truth") == 0), 0.0).otherwise(F.col("covered") / F.size("ground_truth"))
    return j.select("question_id", "covered", "forbidden_hit", passed.alias("passed"), F.round(score, 9).alias("score"), F.floor(F.length("context") / 4).alias("tokens"))


def extended_metrics(s: DataFrame) -> DataFrame:
    """Accuracy, rates and exact latency percentiles per player."""
    base = s.groupBy("player").agg(
        F.count("*").alias("answers"), F.avg("score").alias("accuracy"), F.count_if(F.col("outcome").isin("fail", "false_positive")).alias("fails"),
        F.avg(((F.col("outcome") == "false_positive") | F.col("forbidden_hit")).cast("int")).alias("false_positive_rate"), F.avg("coverage").alias("mean_coverage"),
        F.count_if(F.col("repeat") == 0).alias("write_calls"), F.count_if(F.col("repeat") > 0).alias("read_calls"))
    p = percentiles(s.select("player", F.col("latency_ms").alias("value")), ["player"], (95, 99)).select("player", F.col("median").alias("latency_p50"), F.col("p95").alias("latency_p95"), F.col("p99").alias("latency_p99"))
    return base.join(p, "player")


def recall_curve(truth: DataFrame, pools: DataFrame, hops: int) -> DataFrame:
    """Share of ground-truth rows (query_id, node) found within each number of hops (pools: query_id, node, hop)."""
    first = pools.groupBy("query_id", "node").agg(F.min("hop").alias("hop"))
    j = truth.join(first, ["query_id", "node"], "left")
    flags = F.array(*[F.struct(F.lit(h).alias("hop"), F.coalesce((F.col("hop") <= h).cast("int"), F.lit(0)).alias("found")) for h in range(hops + 1)])
    per = j.select("query_id", F.explode(flags).alias("f")).select("query_id", "f.hop", "f.found").groupBy("query_id", "hop").agg(F.avg("found").alias("recall"))
    return per.groupBy("hop").agg(F.count("*").alias("queries"), F.avg("recall").alias("mean_recall"))


def attribute_failures(s: DataFrame) -> DataFrame:
    """Origin of each failure from joined flags: in_corpus, in_context, retrieved, answered, context_abstains."""
    e = F.col("expected_abstention")
    return s.withColumn("origin", X.label(
        (F.col("outcome") == "pass", "none"), (~e & ~F.col("in_corpus"), "dataset"), (~e & ~F.col("in_context") & F.col("retrieved"), "resolution"), (~e & ~F.col("in_context"), "retrieval"),
        (~e & ~F.col("answered"), "reasoning"), (e & F.col("context_abstains"), "reasoning"), (e, "resolution"), default="evaluator"))


def failure_taxonomy(s: DataFrame) -> DataFrame:
    """Failure class of wrong answers (question, text, context, oracle_recall, expected_abstention, outcome, question_type)."""
    kind = F.coalesce(F.col("question_type"), F.lit("")) if "question_type" in s.columns else F.lit("")
    ql, al = F.lower("question"), F.lower("text")
    words = F.filter(X.space_words(F.col("text")), lambda w: F.length(w) > 4)
    ungrounded = (F.size(X.space_words(F.col("text"))) > 2) & ~F.exists(words, lambda w: F.lower("context").contains(w))
    c = X.label(
        (F.col("expected_abstention") & ~X.contains_any(al, ["none", "not mentioned", "unknown", "i don't know"]), "abstention"),
        (~F.col("expected_abstention") & X.contains_any(al, ["i don't know", "not mentioned"]) & F.col("oracle_recall"), "abstention"),
        (kind.isin(L.TEMPORAL_TYPES) | X.contains_any(ql, L.TEMPORAL_QUESTIONS), "temporal"),
        (kind.isin(L.STATE_TYPES) | X.contains_any(ql, L.STATE_QUESTIONS), "state"),
        ((kind.isin(L.COMPOSITION_TYPES) | X.contains_any(ql, L.COMPOSITION_QUESTIONS)) & F.col("oracle_recall"), "composition"),
        (~F.col("oracle_recall"), "retrieval"), (X.contains_any(al, ["her home country", "her dog", "the country", "his"]), "entity"), (ungrounded, "verification"), default="grounding")
    return s.filter("outcome <> 'pass'").withColumn("failure", c)


def compare_runs(m: DataFrame) -> DataFrame:
    """Metric deltas of each run against the previous one (run, name, value), by run number."""
    g = m.groupBy("run", "name").agg(F.avg("value").alias("value"))
    prev = g.select((F.col("run") + 1).alias("run"), "name", F.col("value").alias("previous"))
    return g.join(prev, ["run", "name"]).select("run", "name", "value", "previous", (F.col("value") - F.col("previous")).alias("delta"))


def claim_provenance(claims: DataFrame, facts: DataFrame) -> DataFrame:
    """Certificate per claim text: hash id, distinct source turns, first time, confidence by hop distance."""
    c = claims.select(F.substring(F.sha2("claim", 256), 1, 16).alias("claim_id"), "claim", "fact_id", "hop")
    u = c.join(facts.select("fact_id", "source", "ts"), "fact_id").groupBy("claim_id", "claim", "fact_id", "source").agg(F.min("ts").alias("ts"), F.min("hop").alias("hop"))
    return u.groupBy("claim_id", "claim").agg(
        F.count("*").alias("turns"), F.count_distinct("source").alias("sources"), F.min("ts").alias("first_at"), F.greatest(F.lit(0.5), 1.0 - 0.15 * F.min("hop")).alias("confidence"))
