"""Temporal queries: validity, states at many times, changes, supersession chains, decision traces, dated answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engramlake.functions import lexicons as L
from engramlake.functions import text as X
from engramlake.operators import similar as SIM
from engramlake.operators import skew
from engramlake.operators import topterms as TT
from engramlake.operators.textfeatures import anchored
from engramlake.session import materialise

TIME_WORDS = ["yesterday", "last night", "last week", "last weekend", "last fri", "last tue", "next month", "this month", "last month", "last year", "ago",
              "years now", "since", "two weekends", "past weekend", "friday before", "weekend before"]


def is_valid(at: Column, start: str = "valid_from", end: str = "valid_until") -> Column:
    """Half-open window, null is open."""
    return (F.col(start).isNull() | (F.col(start) <= at)) & (F.col(end).isNull() | (at < F.col(end)))


def valid_at(df: DataFrame, at) -> DataFrame:
    return df.filter(is_valid(X.as_ts(at)))


def archived_since(mem: DataFrame, events: DataFrame) -> DataFrame:
    """Memories with the time from which they count as archived (status change or strong compression)."""
    strong = events.filter("to_resolution >= 4").groupBy("memory_id").agg(F.min("created_at").alias("_c"))
    by_status = F.when(F.col("status").isin("archived", "deep_archived"), F.col("updated_at"))
    return mem.join(strong, "memory_id", "left").withColumn("gone_at", F.least(by_status, F.col("_c"))).drop("_c")


def live_at(at: Column) -> Column:
    return (F.col("created_at") <= at) & (F.col("gone_at").isNull() | (F.col("gone_at") > at))


def state_at(mem: DataFrame, dec: DataFrame, events: DataFrame, times: list[str]) -> DataFrame:
    """Memories and decisions alive at each of a few given times (times are literals: no join)."""
    at = F.array(*[X.as_ts(t) for t in times])
    m = archived_since(mem, events).withColumn("at_time", F.explode(F.filter(at, live_at))).select("at_time", F.lit("memory").alias("kind"), F.col("memory_id").alias("id"))
    ok = lambda t: (F.col("decided_at") <= t) & (F.col("valid_until").isNull() | (F.col("valid_until") > t))
    d = dec.withColumn("at_time", F.explode(F.filter(at, ok))).select("at_time", F.lit("decision").alias("kind"), F.col("decision_id").alias("id"))
    return m.unionByName(d)


def changes_between(mem: DataFrame, events: DataFrame, t1, t2) -> DataFrame:
    """Added, removed and modified memories plus status and compression events of the period; one pass per table."""
    a, b = X.as_ts(t1), X.as_ts(t2)
    during = lambda c: (F.col(c) > a) & (F.col(c) <= b)
    alive = archived_since(mem, events).withColumn("_a", live_at(a)).withColumn("_b", live_at(b))
    what = F.array_compact(F.array(
        F.when(F.col("_b") & ~F.col("_a"), F.struct(F.lit("added").alias("change"), F.col("created_at").alias("ts"))),
        F.when(F.col("_a") & ~F.col("_b"), F.struct(F.lit("removed").alias("change"), F.col("gone_at").alias("ts"))),
        F.when(F.col("_a") & F.col("_b") & during("updated_at"), F.struct(F.lit("modified").alias("change"), F.col("updated_at").alias("ts"))),
        F.when(F.col("status").isin("archived", "deep_archived") & during("updated_at"), F.struct(F.lit("status_changed").alias("change"), F.col("updated_at").alias("ts"))),
    ))
    rows = alive.select("memory_id", F.explode(what).alias("w")).select("memory_id", "w.change", "w.ts")
    comp = events.filter(during("created_at")).select("memory_id", F.lit("compressed").alias("change"), F.col("created_at").alias("ts"))
    return rows.unionByName(comp)


def timeline(mem: DataFrame, events: DataFrame, dec: DataFrame) -> DataFrame:
    """All events in time order (range-partitioned sort)."""
    a = mem.select(F.col("created_at").alias("ts"), F.lit("memory_created").alias("event"), F.col("memory_id").alias("id"), F.col("memory_type").alias("detail"))
    b = events.select(F.col("created_at").alias("ts"), F.lit("memory_compressed").alias("event"), F.col("memory_id").alias("id"), F.concat("from_resolution", F.lit(">"), "to_resolution").alias("detail"))
    c = dec.select(F.col("decided_at").alias("ts"), F.lit("decision_made").alias("event"), F.col("decision_id").alias("id"), F.substring("text", 1, 100).alias("detail"))
    return a.unionByName(b).unionByName(c).orderBy("ts", "event", "id")


def time_range(mem: DataFrame, start, end, memory_type: str | None = None, limit: int = 20) -> DataFrame:
    m = mem.filter(F.col("created_at").between(X.as_ts(start), X.as_ts(end)))
    m = m.filter(F.col("memory_type") == memory_type) if memory_type else m
    return m.orderBy(F.col("created_at").desc(), "memory_id").limit(limit)


def invalidate(mem: DataFrame, delta: DataFrame) -> DataFrame:
    """Set ends of validity; the earlier end always wins, so applying a delta twice changes nothing."""
    d = delta.groupBy("memory_id").agg(F.min("invalid_at").alias("_u"))
    return mem.join(d, "memory_id", "left").withColumn("valid_until", F.least("valid_until", "_u")).drop("_u")


def supersession_heads(edges: DataFrame, depth: int = 10) -> DataFrame:
    """Newest successor of each superseded memory, following at most ``depth`` steps, by pointer jumping.

    Step tables for 1, 2, 4, ... steps are composed after the binary digits of ``depth``: log(depth)
    joins instead of depth joins.  A memory is superseded only by a later id, so there are no cycles.
    """
    nxt = edges.filter("type = 'supersedes' and src > dst").groupBy(F.col("dst").alias("memory_id")).agg(F.max("src").alias("head"))
    jump = nxt.withColumn("steps", F.lit(1).cast("long"))

    def then(a: DataFrame, b: DataFrame) -> DataFrame:
        right = b.select(F.col("memory_id").alias("head"), F.col("head").alias("_h"), F.col("steps").alias("_s"))
        return a.join(right, "head", "left").select("memory_id", F.coalesce("_h", "head").alias("head"), (F.col("steps") + F.coalesce("_s", F.lit(0))).alias("steps"))

    result, bits = None, depth
    while bits:
        if bits & 1:
            result = jump if result is None else then(result, jump)
        bits >>= 1
        if bits:
            jump = then(jump, jump)
    return result


def superseding_decisions(dec: DataFrame, topic: str, shared: int = 3, look: int = 16, rounds: tuple[int, ...] = (8, 32, 128)) -> DataFrame:
    """First later decision of the same topic that shares at least three words.

    Most decisions find it among the next few of their topic (``rounds``); then spans grow by four from ``look`` on.
    """
    words = dec.select(F.col(topic).alias("topic"), F.col("decided_at").alias("at"), F.col("decision_id").alias("id"), F.array_distinct(X.space_words(F.col("text"))).alias("w"))
    words = materialise(words.filter(F.col("topic").isNotNull() & F.col("at").isNotNull() & (F.size("w") >= shared)), "decision-words")
    return SIM.first_later(words, shared, rounds, look).select(F.col("id").alias("decision_id"), F.col("other").alias("superseded_by"), F.col("at").alias("superseded_at"))


def decision_events(dec: DataFrame, mem: DataFrame, msg: DataFrame, edges: DataFrame, min_shared: int = 2, superseded: DataFrame | None = None) -> DataFrame:
    """Decided, supported, challenged and superseded events of each decision; takes the superseding decisions if they are known."""
    base = dec.select("decision_id", "memory_id", "conv_id", "message_id", "text", "decided_at")
    made = base.select("decision_id", F.lit("decided").alias("event"), F.col("decided_at").alias("ts"), F.col("memory_id").alias("ref_id"))
    words = F.array_distinct(X.space_words(F.col("text"))).alias("w")
    dw = base.select(F.col("conv_id").alias("grp"), F.col("decision_id").alias("id"), F.col("message_id").alias("own"), words)
    mw = msg.filter("role = 'assistant'").select(F.col("conv_id").alias("grp"), F.col("message_id").alias("id"), F.col("created_at").alias("ts"), words)
    sup = SIM.sharing(dw, mw, min_shared).select(F.col("id").alias("decision_id"), F.lit("supported").alias("event"), "ts", F.col("other").alias("ref_id"))
    ends = F.array(F.struct(F.col("src").alias("memory_id"), F.col("dst").alias("ref_id")), F.struct(F.col("dst").alias("memory_id"), F.col("src").alias("ref_id")))
    con = edges.filter("type = 'contradicts'").select(F.explode(ends).alias("e")).select("e.*").distinct()
    cha = base.select("decision_id", "memory_id").join(con, "memory_id").join(mem.select(F.col("memory_id").alias("ref_id"), F.col("created_at").alias("ts")), "ref_id")
    cha = cha.select("decision_id", F.lit("challenged").alias("event"), "ts", "ref_id")
    s = superseding_decisions(dec, "topic") if superseded is None else superseded
    sd = s.select("decision_id", F.lit("superseded").alias("event"), F.col("superseded_at").alias("ts"), F.col("superseded_by").alias("ref_id"))
    return made.unionByName(sup).unionByName(cha).unionByName(sd)


def decision_traces(dec: DataFrame, events: DataFrame, edges: DataFrame, evidence: DataFrame) -> DataFrame:
    """Event counts, dependent memories, affected beliefs and cascade risk per decision."""
    ev = events.groupBy("decision_id").agg(
        F.min("ts").alias("first_at"), F.max("ts").alias("last_at"),
        *[F.count_if(F.col("event") == e).alias(e) for e in ("supported", "challenged", "superseded")])
    ends = F.array(F.struct(F.col("src").alias("memory_id"), F.col("dst").alias("o")), F.struct(F.col("dst").alias("memory_id"), F.col("src").alias("o")))
    dep = edges.filter("type in ('causes', 'follows', 'elaborates')").select(F.explode(ends).alias("e")).groupBy("e.memory_id").agg(F.count("*").alias("dependents"))
    bel = evidence.filter("polarity = 'supporting'").groupBy("memory_id").agg(F.count("*").alias("beliefs"))
    j = dec.select("decision_id", "memory_id").join(ev, "decision_id").join(dep, "memory_id", "left").join(bel, "memory_id", "left").fillna(0, ["dependents", "beliefs"])
    return j.withColumn("cascade_risk", F.least(F.lit(1.0), (F.col("dependents") + F.col("beliefs")) * 0.1))


def compare_decisions(pairs: DataFrame, events: DataFrame, superseded: DataFrame) -> DataFrame:
    """Timeline overlap, shared supporting messages and supersession conflict of given decision pairs (a, b)."""
    span = events.groupBy("decision_id").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    sup = events.filter("event = 'supported'").select("decision_id", "ref_id")
    s = superseded.select("decision_id", "superseded_by")
    as_ = lambda df, p, *cols: df.select(F.col("decision_id").alias(p), *[F.col(c).alias(f"{p}_{c}") for c in cols])
    j = pairs.join(as_(span, "a", "lo", "hi"), "a").join(as_(span, "b", "lo", "hi"), "b").join(as_(s, "a", "superseded_by"), "a", "left").join(as_(s, "b", "superseded_by"), "b", "left")
    both = pairs.join(as_(sup, "a", "ref_id"), "a").join(as_(sup, "b", "ref_id").withColumnRenamed("b_ref_id", "a_ref_id"), ["b", "a_ref_id"]).groupBy("a", "b").agg(F.count("*").alias("shared"))
    j = j.join(both, ["a", "b"], "left")
    return j.select(
        "a", "b", ((F.col("a_hi") >= F.col("b_lo")) & (F.col("b_hi") >= F.col("a_lo"))).alias("timeline_overlap"), F.coalesce("shared", F.lit(0)).alias("supporting_overlap"),
        (F.coalesce(F.col("a_superseded_by") == F.col("b"), F.lit(False)) | F.coalesce(F.col("b_superseded_by") == F.col("a"), F.lit(False))).alias("conflict"))


def time_grid(start: str, end: str, days: int = 7) -> Column:
    return F.sequence(X.as_ts(start), X.as_ts(end), F.expr(f"interval {days} days"))


def context_at(mem: DataFrame, events: DataFrame, grid: Column, budget: int = 4000) -> DataFrame:
    """Parts of the context that would have been built at each grid point: current memories by priority within a budget.

    Each task keeps only the best rows of each grid point before anything is shuffled.
    """
    m = archived_since(mem.filter("is_current"), events)
    at = m.withColumn("at_time", F.explode(F.filter(grid, lambda t: live_at(t) & is_valid(t))))
    at = at.select("at_time", "memory_id", X.token_estimate(F.col("content")).alias("tokens"), F.round(F.col("importance") * F.col("confidence"), 9).alias("priority"))
    return skew.prefix_budget(at, ["at_time"], [F.col("priority").desc(), F.col("memory_id")], "tokens", budget)


def contexts_at(points: DataFrame, mem: DataFrame, events: DataFrame, budget: int = 4000, keys: list[str] = []) -> DataFrame:
    """The context at each of a table of moments (at_id, at_time, *keys): current memories of the same keys by priority within a budget.

    The lives of memories are laid on dyadic nodes of time.  Of a node only the rows within the budget and the one that
    overflows it can matter to a context, and a moment reads the nodes above it, so no memory is repeated for every
    moment of its life.
    """
    m = archived_since(mem.filter("is_current"), events)
    m = m.select(*keys, "memory_id", X.token_estimate(F.col("content")).alias("tokens"), F.round(F.col("importance") * F.col("confidence"), 9).alias("priority"),
                 F.greatest("created_at", "valid_from").alias("_from"), F.least("gone_at", "valid_until").alias("_to"))
    order = [F.col("priority").desc(), F.col("memory_id")]

    def enough(rows: DataFrame, by: list[str]) -> DataFrame:
        head = skew.top_k(rows, by, order, budget + 1, "_rk")
        before = Window.partitionBy(*by).orderBy("_rk").rowsBetween(Window.unboundedPreceding, -1)
        return head.withColumn("_before", F.coalesce(F.sum("tokens").over(before), F.lit(0))).filter(F.col("_before") <= budget)

    found = skew.covering(points, m, "at_id", keys, "at_time", "_from", "_to", ["memory_id", "tokens", "priority"], enough)
    return skew.prefix_budget(found, ["at_id"], order, "tokens", budget)


def decision_contexts(dec: DataFrame, mem: DataFrame, events: DataFrame, budget: int = 4000) -> DataFrame:
    """The context of the topic of each decision (decision_id, topic, decided_at) when it was made."""
    points = dec.select(F.col("decision_id").alias("at_id"), "topic", F.col("decided_at").alias("at_time"))
    return contexts_at(points, mem, events, budget, ["topic"]).withColumnRenamed("at_id", "decision_id")


def compare_contexts(a: DataFrame, b: DataFrame) -> DataFrame:
    l = a.select("memory_id", F.col("tokens").alias("tokens_a"))
    r = b.select("memory_id", F.col("tokens").alias("tokens_b"))
    c = X.label((F.col("tokens_b").isNull(), "part_removed"), (F.col("tokens_a").isNull(), "part_added"), (F.col("tokens_a") != F.col("tokens_b"), "tokens_changed"))
    return l.join(r, "memory_id", "full_outer").withColumn("change", c).filter("change is not null")


def event_terms(text: Column) -> Column:
    return F.array_distinct(F.transform(F.filter(X.word_list(text, 3), lambda w: ~w.isin(L.STOP_WORDS)), lambda w: X.stem(w, L.IRREGULAR_STEMS)))


def _timed(pad: Column) -> tuple[Column, Column]:
    """Does a turn hold a word of time, and a number of years ago or from now?"""
    return X.has_phrase(pad, TIME_WORDS), pad.rlike(rf" (?:\d+|{'|'.join(L.NUMBER_WORDS)}) years? (?:ago|now) ")


def turn_blocks(msg: DataFrame) -> DataFrame:
    """Posting blocks of turns: stems (s:), four-letter beginnings (p:) and speakers (@), by time bonus and year."""
    words = X.word_list(F.col("text"))
    stems = F.transform(words, lambda w: F.concat(F.lit("s:"), X.stem(w, L.IRREGULAR_STEMS)))
    heads = F.transform(F.filter(words, lambda w: F.length(w) >= 3), lambda w: F.concat(F.lit("p:"), F.substring(w, 1, 4)))
    timed, years = _timed(X.padded(F.col("text")))
    bonus = F.when(timed, 2.0).otherwise(0.0) + F.when(years, 3.0).otherwise(0.0)
    return TT.term_blocks(msg, "message_id", F.concat(stems, heads, F.array(F.concat(F.lit("@"), F.coalesce(F.lower("speaker"), F.lit(""))))), {"time": bonus, "year": F.coalesce(F.year("created_at"), F.lit(0))})


def when_answers(q: DataFrame, msg: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """Best dated turn per "when" question (query_id, text, subject) and the calendar date it means.

    Without given ``blocks`` a few questions look at the first turn of each kind they can tell apart.
    """
    timed, years = _timed(X.padded(F.col("text")))
    if blocks is None:
        asked = q.select(event_terms(F.col("text")).alias("stems"), F.lower("subject").alias("subject")).limit(TT.FEW_QUESTIONS + 1).collect()
        if len(asked) <= TT.FEW_QUESTIONS:
            said = F.lower("speaker")
            traits = [X.words_like(F.col("text"), {s for r in asked for s in r["stems"] or []}, L.IRREGULAR_STEMS), F.when(said.isin(sorted({r["subject"] for r in asked if r["subject"]})), said), timed, years]
            msg = TT.few_rows(msg, "message_id", traits, 1)
    stems = F.array_distinct(F.transform(X.word_list(F.col("text")), lambda x: X.stem(x, L.IRREGULAR_STEMS)))
    turn = lambda pairs: TT.wanted(msg, pairs, "message_id").select(F.col("message_id").alias("id"), "speaker", timed.alias("timed"), years.alias("years"), stems.alias("stems"))
    ask = q.select("query_id", "subject", event_terms(F.col("text")).alias("terms"))
    worth = lambda t: F.when(F.length(t) > 4, 1.5).otherwise(1.0)

    def exact(pairs: DataFrame) -> DataFrame:
        j = pairs.join(turn(pairs), "id").join(ask, "query_id").withColumn("overlap", F.aggregate(F.array_intersect("terms", "stems"), F.lit(0.0), lambda a, t: a + worth(t)))
        score = F.col("overlap") * 3.0 + F.when(F.lower("speaker") == F.lower("subject"), 1.0).otherwise(0.0) + F.when(F.col("timed"), 2.0).otherwise(0.0) + F.when(F.col("years"), 3.0).otherwise(0.0)
        return j.filter((F.col("overlap") >= 2.0) | (F.col("timed") & (F.col("overlap") > 0))).select("query_id", "id", score.alias("score"))

    best = TT.best_of_few(q, msg, "message_id", exact, 1) if blocks is None else None
    if best is None:
        blocks = blocks if blocks is not None else materialise(turn_blocks(msg), "turn-blocks")
        units = ask.select("query_id", F.explode("terms").alias("unit")).select("query_id", "unit", F.concat(F.lit("s:"), F.col("unit")).alias("key"), (3.0 * worth(F.col("unit"))).alias("most"))
        best = TT.best_rows(units, blocks, F.col("reach") + 1.0 + F.col("time"), exact, 1)
    best = materialise(best.select("query_id", F.col("id").alias("message_id"), "score"), "best-turns")
    year = F.regexp_extract("text", r"(20\d{2})", 1)
    date = F.coalesce(anchored(F.col("text"), F.col("created_at")), F.when(F.lower("text").contains("since") & (year != ""), F.concat(F.lit("Since "), year)), F.when(year != "", year), X.day_text(F.col("created_at")))
    return best.join(msg.select("message_id", "text", "created_at"), "message_id").select("query_id", "message_id", "score", date.alias("answer"))


def event_dates(named: DataFrame, msg: DataFrame) -> DataFrame:
    """Session date of each named event (event_id, text): word overlap per session, two more for words of four letters or more."""
    t = named.select("event_id", F.explode(F.filter(X.word_set(F.col("text"), 3), lambda w: ~w.isin("the", "and", "that", "this", "with", "have", "from", "for", "day"))).alias("term"))
    w = msg.select("conv_id", F.explode(X.word_set(F.col("text"), 3)).alias("term")).distinct()
    hit = t.join(w, "term").groupBy("event_id", "conv_id").agg(F.sum(F.when(F.length("term") >= 4, 3.0).otherwise(1.0)).alias("score")).filter("score >= 2")
    best = skew.latest_rows(hit, ["event_id"], [F.col("score"), -F.col("conv_id")])
    day = msg.groupBy("conv_id").agg(F.to_date(F.min("created_at")).alias("event_date"))
    return best.join(day, "conv_id").select("event_id", "conv_id", "score", "event_date")


def event_durations(q: DataFrame, msg: DataFrame) -> DataFrame:
    """Gap and order of two named events per question (query_id, event_a, event_b)."""
    from engramlake.operators.textfeatures import event_gaps

    named = q.select("query_id", F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("event_a").alias("text")), F.struct(F.lit("b").alias("side"), F.col("event_b").alias("text")))).alias("e"))
    named = named.select(F.struct("query_id", "e.side").alias("event_id"), "e.text")
    d = event_dates(named, msg).groupBy("event_id.query_id").agg(
        F.max(F.when(F.col("event_id.side") == "a", F.col("event_date"))).alias("date_a"), F.max(F.when(F.col("event_id.side") == "b", F.col("event_date"))).alias("date_b"))
    d = event_gaps(d.filter("date_a is not null and date_b is not null"), "date_a", "date_b")
    return d.withColumn("first_event", X.label((F.col("date_a") < F.col("date_b"), "a"), (F.col("date_b") < F.col("date_a"), "b"), default="same"))
