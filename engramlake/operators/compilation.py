"""Conversation compilation: features, instruction units and memory candidates from message tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engramlake.functions import lexicons as L
from engramlake.functions import text as X
from engramlake.operators import skew

CJK = r"[぀-ヿ一-鿿]"


def lexical_features(msg: DataFrame) -> DataFrame:
    """Character, word and sentence counts and a language flag per conversation; sums combine before the shuffle."""
    return (
        msg.select(
            "conv_id",
            F.length("text").alias("c"),
            F.size(X.space_words(F.col("text"))).alias("w"),
            F.size(X.sentence_list(F.col("text"))).alias("s"),
            F.col("text").rlike(CJK).alias("j"),
        )
        .groupBy("conv_id")
        .agg(
            F.sum("c").alias("char_count"),
            F.sum("w").alias("word_count"),
            F.sum("s").alias("sentence_count"),
            F.when(F.bool_or("j"), F.lit("ja")).otherwise(F.lit("en")).alias("language"),
        )
    )


def structure(msg: DataFrame) -> DataFrame:
    user_turn = F.when(F.col("role") == "user", F.col("turn"))
    return msg.groupBy("conv_id").agg(
        F.count("*").alias("turn_count"),
        F.count_if(F.col("role") == "user").alias("user_turns"),
        F.count_if(F.col("role") == "assistant").alias("assistant_turns"),
        F.count_if(F.col("role") == "system").alias("system_turns"),
        F.min_by("role", "turn").alias("first_role"),
        F.max_by("role", "turn").alias("last_role"),
        F.min(user_turn).alias("first_user_turn"),
        F.substring(F.min_by(F.col("text"), user_turn), 1, 100).alias("inferred_topic"),
    )


def _units(kind: str, values: Column) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(kind).alias("ir_type"), F.trim(v).alias("value")))


def ir_units(msg: DataFrame, patterns: dict[str, str] = L.IR_PATTERNS, casual=L.CASUAL, hesitation=L.HESITATION) -> DataFrame:
    """Typed units of each turn with their surrounding text: one narrow pass, no union, no shuffle."""
    text, pad = F.col("text"), F.col("_pad")
    parts = [
        F.when(F.col("role") == "user", F.array(F.struct(F.lit("role").alias("ir_type"), F.lit("usr").alias("value"))))
        .when(F.col("role") == "assistant", F.array(F.struct(F.lit("role").alias("ir_type"), F.lit("ast").alias("value"))))
    ]
    for kind, pattern in patterns.items():
        inside = kind in L.IR_INSIDE_WORDS
        window = rf"(?is).{{0,50}}?(?:{pattern}).{{0,100}}" if inside else rf"(?is)(?:^|.{{0,49}}[^\p{{L}}\p{{N}}_])(?:{pattern})(?:[^\p{{L}}\p{{N}}_].{{0,99}}|$)"
        # The plain search rules most turns out before the costly search with context.
        present = text.rlike(rf"(?i){pattern}" if inside else rf"(?i)(?:^|[^\p{{L}}\p{{N}}_])(?:{pattern})(?:[^\p{{L}}\p{{N}}_]|$)")
        parts.append(F.when(present, _units(kind, F.regexp_extract_all(text, F.lit(window), F.lit(0)))))
    tones = [
        F.when(X.has_phrase(pad, casual), F.lit("casual")),
        F.when(X.has_phrase(pad, hesitation), F.lit("hesitation")),
        F.when(text.contains("?") | text.contains("？"), F.lit("questioning")),
    ]
    parts.append(_units("tone", F.array_compact(F.array(*tones))))
    names = F.filter(X.entity_set(text), lambda e: ~e.isin(L.ENTITY_STOP_WORDS))
    acronyms = F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?:^|[^\p{L}\p{N}_])([A-Z]{2,}(?:[_-][A-Z0-9]+)*)"), F.lit(1)))
    parts.append(_units("entity", F.array_distinct(F.concat(names, acronyms))))
    empty = F.array().cast("array<struct<ir_type:string,value:string>>")
    units = F.concat(*[F.coalesce(p, empty) for p in parts])
    return (
        msg.withColumn("_pad", X.padded(text))
        .select("conv_id", "turn", F.posexplode(units).alias("seq", "u"))
        .select("conv_id", "turn", F.col("seq").cast("long").alias("seq"), "u.ir_type", "u.value", X.token_estimate(F.col("u.value")).alias("tokens"))
    )


def ir_distribution(units: DataFrame, types=L.IR_ORDER) -> DataFrame:
    """Unit counts per conversation, one column per type; the type list is given, so no extra pass finds it."""
    return units.groupBy("conv_id").agg(*[F.count_if(F.col("ir_type") == t).alias(t) for t in types])


def memory_candidates(msg: DataFrame, decision_words=L.DECISION_WORDS, important_words=L.IMPORTANT_WORDS) -> DataFrame:
    """Memory candidates of assistant turns: decision, semantic and episode rules on one row each."""
    low = F.lower("text")
    decision, important = X.contains_any(low, decision_words), X.contains_any(low, important_words)

    def cand(kind, resolution, importance, confidence):
        return F.struct(F.lit(kind).alias("memory_type"), F.lit(resolution).alias("resolution"),
                        importance.alias("importance"), F.lit(confidence).alias("confidence"))

    options = F.array_compact(
        F.array(
            F.when(decision, cand("decision", 3, F.lit(0.85), 0.8)),
            F.when(important | decision, cand("semantic", 3, F.when(important, F.lit(0.7)).otherwise(F.lit(0.6)), 0.75)),
            F.when(F.length("text") > 100, cand("episode", 2, F.lit(0.6), 0.7)),
        )
    )
    return (
        msg.filter(F.col("role") == "assistant")
        .select("message_id", "conv_id", "turn", F.col("text").alias("content"), "created_at", F.explode(options).alias("c"))
        .select("message_id", "conv_id", "turn", "c.*", "content", "created_at")
    )


def timeline_memories(msg: DataFrame, decision_words=L.DECISION_WORDS, important_words=L.IMPORTANT_WORDS, keep: int = 5) -> DataFrame:
    """One timeline memory per conversation.  Only the first ``keep`` events of a conversation are ever gathered."""
    low = F.lower("text")
    kind = F.when(X.contains_any(low, decision_words), F.lit("decided: ")).when(X.contains_any(low, important_words), F.lit("important: "))
    events = msg.filter(F.col("role") == "assistant").select("conv_id", "turn", F.concat(kind, F.substring("text", 1, 100)).alias("event")).filter("event is not null")
    events = skew.top_k(events, ["conv_id"], [F.col("turn")], keep)
    events = events.groupBy("conv_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "event"))), lambda e: F.concat(F.lit("- "), e["event"])), "\n").alias("events")
    )
    user_turn = F.when(F.col("role") == "user", F.col("turn"))
    head = msg.groupBy("conv_id").agg(F.min("created_at").alias("started_at"), F.min_by("text", user_turn).alias("first_user"))
    return head.join(events, "conv_id", "left").select(
        "conv_id",
        "started_at",
        F.concat(
            F.lit("**"), F.date_format("started_at", "yyyy-MM-dd"), F.lit("**\ntopic: "),
            F.coalesce(F.substring("first_user", 1, 200), F.lit("")), F.lit("\n"), F.coalesce("events", F.lit("")),
        ).alias("content"),
    )


def transcripts(msg: DataFrame, page_turns: int = 100) -> DataFrame:
    """Role-prefixed transcript in pages of at most ``page_turns`` turns, so no row gathers a whole long conversation."""
    return (
        msg.withColumn("page", F.expr(f"turn div {page_turns}"))
        .groupBy("conv_id", "page")
        .agg(F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(": "), "text").alias("line")))).alias("t"))
        .select("conv_id", "page", F.size("t").cast("long").alias("turns"), F.array_join(F.col("t.line"), "\n").alias("transcript"))
    )


def link_provenance(mem: DataFrame, msg: DataFrame, min_shared: int = 4) -> DataFrame:
    """Assistant turn of the same conversation sharing most words, for memories that name no message."""
    need = mem.filter("message_id is null").select("memory_id", "conv_id", F.explode(F.array_distinct(X.space_words(F.col("content")))).alias("word"))
    have = msg.filter("role = 'assistant'").select("conv_id", "message_id", F.explode(F.array_distinct(X.space_words(F.col("text")))).alias("word"))
    shared = need.join(have, ["conv_id", "word"]).groupBy("memory_id", "message_id").agg(F.count("*").alias("shared_words"))
    shared = shared.filter(F.col("shared_words") >= min_shared)
    return skew.latest_rows(shared, ["memory_id"], [F.col("shared_words"), -F.col("message_id")])


def normalise_confidence(mem: DataFrame) -> DataFrame:
    """Type defaults for missing scores, clamped parts and the weighted overall confidence."""

    def default(table, other):
        pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
        return F.coalesce(F.try_element_at(pairs, F.col("memory_type")), F.lit(other))

    c = X.clamp01(F.coalesce("confidence", default(L.DEFAULT_CONFIDENCE, 0.7)))
    overall = 0.4 * c + 0.3 * X.clamp01(F.col("retrieval_confidence")) + 0.15 * X.clamp01(F.col("temporal_confidence")) + 0.15 * X.clamp01(F.col("source_confidence"))
    return mem.withColumn("importance", X.clamp01(F.coalesce("importance", default(L.DEFAULT_IMPORTANCE, 0.6)))).withColumn("overall_confidence", overall)


def dedup_content(mem: DataFrame) -> DataFrame:
    """First memory of each content hash.  Only hash and id are shuffled for the choice, then ids are joined back."""
    first = mem.groupBy(F.substring(F.sha2("content", 256), 1, 16).alias("content_hash")).agg(
        F.min("memory_id").alias("memory_id"), F.count("*").alias("copies"))
    return mem.join(first, "memory_id")


def lifecycle(mem: DataFrame) -> DataFrame:
    kind, imp = F.col("memory_type"), F.col("importance")
    return mem.withColumn(
        "lifecycle",
        X.label((kind.isin("current", "decision"), "hot"), (kind == "timeline", "warm"), (imp >= 0.8, "hot"), (imp >= 0.5, "warm"), default="cold"),
    )


def diagnostics(msg: DataFrame, mem: DataFrame, versions: DataFrame) -> DataFrame:
    """Warning and error rows of all stages: one pass per table and an anti join for missing versions."""

    def rows(df, key, checks):
        found = F.array_compact(F.array(*[
            F.when(cond, F.struct(F.lit(stage).alias("stage"), F.lit(sev).alias("severity"), F.lit(issue).alias("issue"))) for cond, stage, sev, issue in checks]))
        return df.select(F.col(key).alias("row_id"), F.explode(found).alias("d")).select("row_id", "d.*")

    m = rows(msg, "message_id", [
        (F.size(X.sentence_list(F.col("text"))) == 0, "lexical", "warning", "no sentences"),
        (F.col("conv_id").isNull(), "structural", "error", "no conversation"),
        (~F.col("role").isin("user", "assistant", "system"), "structural", "error", "unknown role"),
    ])
    c = rows(mem, "memory_id", [
        (F.col("valid_from").isNull(), "temporal", "error", "no valid_from"),
        (F.col("conv_id").isNull(), "provenance", "warning", "no conversation"),
        (F.col("message_id").isNull(), "provenance", "warning", "no source message"),
        (~F.col("importance").between(0, 1), "classification", "error", "importance out of range"),
        (~F.col("confidence").between(0, 1), "classification", "error", "confidence out of range"),
        (F.col("valid_until") <= F.col("valid_from"), "temporal", "error", "empty validity"),
    ])
    lacking = mem.filter("resolution < 4").join(versions.select("memory_id").distinct(), "memory_id", "left_anti").select(
        F.col("memory_id").alias("row_id"), F.lit("compression").alias("stage"), F.lit("warning").alias("severity"), F.lit("no versions").alias("issue"))
    return m.unionByName(c).unionByName(lacking)


def prune_ir(units: DataFrame, max_tokens: int, priority: dict[str, int] = L.IR_PRIORITY) -> DataFrame:
    """Keep the units of highest type priority while their tokens fit; stops at the first overflow."""
    pairs = F.create_map(*[F.lit(x) for kv in priority.items() for x in kv])
    ranked = units.withColumn("priority", F.coalesce(F.try_element_at(pairs, F.col("ir_type")), F.lit(1)))
    return skew.prefix_budget(ranked, ["conv_id"], [F.col("priority").desc(), F.col("turn"), F.col("seq")], "tokens", max_tokens)


def compact_ir(units: DataFrame, max_units: int = 100) -> DataFrame:
    """Drop units equal to their predecessor, keep the first ``max_units`` and number them from zero."""
    u = units.withColumn("_b", F.expr("turn div 64"))
    u = skew.neighbour(u, ["conv_id"], "_b", ["turn", "seq"], ["ir_type", "value"], "prev_")
    changed = u.filter(~(F.col("ir_type").eqNullSafe(F.col("prev_ir_type")) & F.col("value").eqNullSafe(F.col("prev_value"))))
    kept = skew.top_k(changed, ["conv_id"], [F.col("turn"), F.col("seq")], max_units, "n")
    return kept.select("conv_id", (F.col("n") - 1).alias("sequence"), "ir_type", "value", "tokens")


def render_ir(compact: DataFrame, order=L.IR_ORDER) -> DataFrame:
    """Text of a compacted unit sequence in fixed type order; at most ``max_units`` rows per conversation reach it."""
    rank = F.array_position(F.array(*[F.lit(t) for t in order]), F.col("ir_type"))
    return (
        compact.groupBy("conv_id")
        .agg(F.array_sort(F.collect_list(F.struct(rank.alias("r"), "sequence", F.concat(F.lit("["), "ir_type", F.lit("] "), "value").alias("line")))).alias("u"))
        .select("conv_id", F.size("u").cast("long").alias("units"), F.array_join(F.col("u.line"), "\n").alias("rendered"))
    )
