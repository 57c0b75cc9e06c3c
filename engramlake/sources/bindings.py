"""Logical tables (messages, memories, facts, edges, ...) derived from the parquet tables.

Everything here is a projection: no shuffle, and ids, attributes and edges grow with the input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engramlake.functions.text import pick

MEMORY_TYPES = ["current", "timeline", "decision", "episode", "semantic", "conversation_style"]
STATUSES = ["active", "dormant", "compressed", "archived", "deep_archived"]
STATUS_MIX = ["active", "active", "active", "dormant", "compressed", "archived", "deep_archived"]
EDGE_TYPES = ["related", "causes", "follows", "contradicts", "elaborates", "summarizes", "supersedes"]
RELATIONS = ["asserts", "prefers", "migrated", "located_at", "never", "contradicts", "supports", "behavior"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Give costly row work all cores where a small table has fewer splits than the cluster has cores.

    A table of many splits is left as it is, so nothing large is ever shuffled for this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spread(table(spark, sf_dir, "conversations"))
    return c.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("message_id"),
        "conv_id",
        "turn",
        "role",
        "text",
        F.expr("timestampadd(MINUTE, cast(conv_id * 60 + turn as int), timestamp'2024-01-01')").alias("created_at"),
    )


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spread(table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("i"), "source", "text")
    created = F.expr("timestampadd(DAY, cast(i * 7 % 700 as int), timestamp'2023-01-01')")
    d = d.withColumn("created_at", created)
    return d.select(
        F.col("i").alias("memory_id"),
        F.col("source").alias("topic"),
        pick(MEMORY_TYPES, F.expr("i div 6 % 6")).alias("memory_type"),
        F.col("text").alias("content"),
        F.expr("cast(i % 6 as int)").alias("resolution"),
        (F.lit(0.3) + F.lit(0.1) * F.expr("i % 7")).alias("importance"),
        (F.lit(0.5) + F.lit(0.1) * F.expr("i % 5")).alias("confidence"),
        pick(STATUS_MIX, F.expr("i div 7 % 7")).alias("status"),
        F.expr("i % 10 <> 9").alias("is_current"),
        F.col("created_at").alias("valid_from"),
        F.expr("case when i % 4 = 0 then timestampadd(DAY, cast(200 + i % 300 as int), created_at) end").alias("valid_until"),
        F.expr("i div 10").alias("conv_id"),
        F.expr("case when i % 3 <> 0 then (i div 10) * 1000 + 1 end").alias("message_id"),
        "created_at",
        F.expr("timestampadd(DAY, cast(i % 13 as int), created_at)").alias("updated_at"),
        F.expr("case when i % 11 <> 0 then timestampadd(DAY, cast(i % 50 as int), created_at) end").alias("last_accessed"),
        F.expr("i % 9").alias("access_count"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three typed edges per memory: to a tree parent, to the memory eleven back, and some parent-to-child."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("i"))
    created = "timestampadd(DAY, cast(i * 7 % 700 as int), timestamp'2023-01-01')"
    up = d.filter("i >= 1").select(
        F.col("i").alias("src"), F.expr("(i - 1) div 3").alias("dst"), pick(EDGE_TYPES, F.expr("i % 7")).alias("type"),
        (F.lit(0.3) + F.lit(0.1) * F.expr("i % 7")).alias("strength"), F.expr(created).alias("created_at"))
    back = d.filter("i >= 11").select(
        F.col("i").alias("src"), F.expr("i - 11").alias("dst"), pick(EDGE_TYPES, F.expr("i div 7 % 7")).alias("type"),
        (F.lit(0.2) + F.lit(0.1) * F.expr("i % 8")).alias("strength"), F.expr(created).alias("created_at"))
    down = d.filter("i >= 1 and (i - 1) div 3 % 20 = 0").select(
        F.expr("(i - 1) div 3").alias("src"), F.col("i").alias("dst"), pick(EDGE_TYPES, F.expr("i div 3 % 7")).alias("type"),
        F.lit(0.5).alias("strength"), F.expr(created).alias("created_at"))
    return up.unionByName(back).unionByName(down)


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts_of(table(spark, sf_dir, "events"))


def facts_of(events: DataFrame) -> DataFrame:
    """Facts of an events table or of a stream of events."""
    return events.select(
        F.col("event_id").alias("fact_id"),
        F.concat(F.lit("user_"), F.col("user_id")).alias("entity"),
        F.col("event_type").alias("property"),
        F.concat(F.lit("v"), F.floor(F.col("value") / 50).cast("long")).alias("value"),
        F.concat(F.lit("v"), F.floor(F.col("value") / 70).cast("long")).alias("old_value"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.concat(F.lit("src"), F.expr("event_id % 3")).alias("source"),
        pick(RELATIONS, F.expr("event_id % 8")).alias("relation"),
        F.expr("case when event_id % 5 = 0 then 'superseded' when event_id % 17 = 0 then 'deprecated' else 'active' end").alias("status"),
        F.concat(F.lit("user_"), F.col("user_id"), F.lit(" "), F.col("event_type"), F.lit(" is v"),
                 F.floor(F.col("value") / 50).cast("long")).alias("raw"),
    )


def recall_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    return b.select(
        F.col("item_id").alias("query_id"),
        F.col("text"),
        F.concat(F.lit("src"), F.expr("item_id % 20")).alias("topic"),
        F.expr("timestampadd(DAY, cast(item_id % 400 as int), timestamp'2023-12-01')").alias("asked_at"),
    )


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as decisions; the next order of the same customer ends the validity."""
    from engramlake.operators.skew import neighbour

    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("decision_id"),
        F.col("o_custkey").alias("topic_id"),
        F.concat(F.lower("o_orderpriority"), F.lit(" status-"), F.lower("o_orderstatus"), F.lit(" total-"),
                 F.floor(F.col("o_totalprice") / 100000).cast("long"), F.lit(" year-"), F.year("o_orderdate")).alias("text"),
        F.col("o_orderdate").cast("timestamp").alias("decided_at"),
        F.year("o_orderdate").alias("year"),
    )
    o = neighbour(o, ["topic_id"], "year", ["decided_at", "decision_id"], ["decided_at"], "next_", forward=True)
    return o.select("decision_id", "topic_id", "text", "decided_at", F.col("decided_at").alias("valid_from"),
                    F.col("next_decided_at").alias("valid_until"))


NOTE_TEMPLATES = [
    "User {u} decided to adopt plan {v} because {p} failed yesterday.",
    "I moved the server from {w} to {v} 3 days ago.",
    "User {u} never used a {p} plan.",
    "I prefer {p} over {v}, okay.",
    "As a {p} user, I think {v} is great!!",
    "User {u} relocated to {v} on {d}. It was last month.",
    "The {p} of User {u} is {v} tomorrow.",
    "How many {p} items did we see between {v} and {w}?",
    "User {u} spent ${n} on {p} on {d}.",
    "User {u} bought {n} {p} items before {v} last week.",
    "Team Alpha will review {p} after {v} next month.",
    "Team Alpha will not review {p}, maybe {n} weeks ago.",
    "I don't know why {p} is not specified.",
    "User {u} always reverts to {v} when {p} fails, as two days ago.",
    "Meeting suggested {v} for {p}; status pending, risk of {w}.",
    "User {u} likes {v} and hates {w} last Fri.",
    "User {u} hates {v} and likes {w} this month.",
]


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short English turns worded from the events, one per event; a conversation is a user's day."""
    return notes_of(spread(table(spark, sf_dir, "events")))


def notes_of(events: DataFrame) -> DataFrame:
    """Turns of an events table or of a stream of events."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    text = pick(NOTE_TEMPLATES, F.expr("event_id % 17"))
    fill = {
        "{u}": F.concat(F.lit("U"), F.col("user_id")),
        "{p}": F.col("event_type"),
        "{v}": F.concat(F.lit("v"), F.floor(F.col("value") / 50).cast("long")),
        "{w}": F.concat(F.lit("v"), F.floor(F.col("value") / 70).cast("long")),
        "{n}": F.expr("cast(event_id % 30 + 1 as string)"),
        "{d}": F.date_format("ts", "d MMMM yyyy"),
    }
    for mark, value in fill.items():
        text = F.replace(text, F.lit(mark), value)
    return e.select(
        F.col("event_id").alias("message_id"),
        F.expr("user_id * 100 + day(ts)").alias("conv_id"),
        F.col("event_id").alias("turn"),
        F.expr("case when event_id % 2 = 0 then 'user' else 'assistant' end").alias("role"),
        text.alias("text"),
        F.col("ts").alias("created_at"),
        F.concat(F.lit("user_"), F.col("user_id")).alias("speaker"),
    )


def memory_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decision memories as decisions worded by their whole text."""
    m = memories(spark, sf_dir).filter("memory_type = 'decision'")
    return m.select(F.col("memory_id").alias("decision_id"), "memory_id", "topic", "conv_id", "message_id", F.coalesce("content", F.lit("")).alias("text"),
                    F.col("created_at").alias("decided_at"), "valid_until", "confidence", "is_current")


def compression_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event per memory above the raw resolution, at its last update."""
    m = memories(spark, sf_dir).filter("resolution > 0")
    return m.select("memory_id", F.lit(0).alias("from_resolution"), F.col("resolution").alias("to_resolution"), (F.lit(1.0) + F.col("resolution") * 0.5).alias("ratio"), F.col("updated_at").alias("created_at"))
