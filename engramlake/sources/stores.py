"""Scans, sinks, views and exchange formats of the memory tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engramlake.functions import text as X
from engramlake.operators import skew


def scan_memories(mem: DataFrame, topic=None, memory_type=None, resolution=None, status=None, current=None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Newest-updated memories by optional predicates; filters reach the file scan, order and limit are a top-k."""
    for col, value in (("topic", topic), ("memory_type", memory_type), ("resolution", resolution), ("status", status), ("is_current", current)):
        if value is not None:
            mem = mem.filter(F.col(col) == value)
    out = mem.orderBy(F.col("updated_at").desc(), "memory_id")
    out = out.offset(offset) if offset else out
    return out.limit(limit) if limit is not None else out


def read_messages(msg: DataFrame) -> DataFrame:
    """Messages with the number of messages of their conversation, in conversation order."""
    n = msg.groupBy("conv_id").agg(F.count("*").alias("message_count"))
    return msg.join(n, "conv_id").orderBy("conv_id", "turn")


def append(df: DataFrame, path: str, ts: str = "created_at") -> None:
    """Append to a fact table partitioned by date.

    Rows are rebalanced by date: small dates share a task, and Spark splits a busy date by size into as many as it needs.
    """
    d = df.withColumn("date", F.to_date(ts))
    d.hint("rebalance", F.col("date")).write.mode("append").partitionBy("date").parquet(path)


def upsert_latest(base: DataFrame, delta: DataFrame, key: str, version: str) -> DataFrame:
    """Latest revision of each key; combines before the shuffle."""
    both = base.unionByName(delta)
    return skew.latest_rows(both, [key], [F.col(version)])


DIGEST_SECTIONS = ["current", "timeline", "decision", "episode", "semantic", "conversation_style"]


def export_topic_digest(mem: DataFrame, path: str) -> DataFrame:
    """Text files per topic with a heading line per section and one line per memory in order.

    Lines are rows, range-partitioned by topic and place, so a large topic becomes several files in
    order and is never gathered.  Returns the line table that was written.
    """
    place = F.array_position(F.array(*[F.lit(s) for s in DIGEST_SECTIONS]), F.col("memory_type"))
    body = mem.select("topic", place.alias("section"), F.lit(1).alias("kind"), "created_at", "memory_id",
                      F.concat(F.lit("- ["), F.date_format("created_at", "yyyy-MM-dd"), F.lit("] "), F.regexp_replace("content", r"\s+", " ")).alias("value"))
    head = mem.select("topic", "memory_type", place.alias("section")).distinct().select(
        "topic", "section", F.lit(0).alias("kind"), F.lit(None).cast("timestamp").alias("created_at"), F.lit(-1).cast("long").alias("memory_id"), F.concat(F.lit("## "), "memory_type").alias("value"))
    lines = head.unionByName(body)
    order = ["topic", "section", "kind", "created_at", "memory_id"]
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select("topic", "value").write.mode("errorifexists").partitionBy("topic").text(path)
    return lines


def write_audit(ev: DataFrame, path: str) -> None:
    ev.write.mode("append").json(path, compression="gzip")


AUDIT_SCHEMA = "event_id bigint, ts timestamp, type string, severity string, tenant string, user_id bigint"


def query_audit(spark: SparkSession, path: str, type=None, severity=None, tenant=None, user=None, start=None, end=None, limit: int = 100) -> DataFrame:
    """Filtered audit events, newest first."""
    ev = spark.read.schema(AUDIT_SCHEMA).json(path)
    for col, value in (("type", type), ("severity", severity), ("tenant", tenant), ("user_id", user)):
        if value is not None:
            ev = ev.filter(F.col(col) == value)
    ev = ev.filter(F.col("ts") >= X.as_ts(start)) if start else ev
    ev = ev.filter(F.col("ts") < X.as_ts(end)) if end else ev
    return ev.orderBy(F.col("ts").desc(), "event_id").limit(limit)


PACKAGE_SCHEMA = (
    "memory struct<memory_id: bigint, topic: string, content: string, importance: double, confidence: double>, "
    "versions array<struct<resolution: int, method: string, content: string, ratio: double>>, edges array<struct<dst: bigint, type: string, strength: double>>"
)


def to_package(mem: DataFrame, ver: DataFrame, edges: DataFrame, part_size: int = 500) -> DataFrame:
    """Memory, versions and relations as JSON documents.

    A memory has at most five versions.  Its relations are spread over parts of about ``part_size``
    by hash, so a memory with very many edges becomes many documents.
    """
    v = ver.groupBy("memory_id").agg(F.array_sort(F.collect_list(F.struct("resolution", "method", "content", "ratio"))).alias("versions"))
    n = edges.groupBy("src").agg(F.ceil(F.count("*") / part_size).alias("parts"))
    e = edges.join(n, "src").withColumn("part", F.pmod(F.xxhash64("dst", "type"), F.col("parts"))).groupBy(F.col("src").alias("memory_id"), "part").agg(F.collect_list(F.struct("dst", "type", "strength")).alias("edges"))
    base = mem.select("memory_id", F.struct("memory_id", "topic", "content", "importance", "confidence").alias("memory")).join(v, "memory_id", "left")
    head = base.join(e.filter("part = 0").drop("part"), "memory_id", "left").select("memory_id", F.lit(0).cast("long").alias("part"), "memory", "versions", "edges")
    ids = mem.select("memory_id", F.struct("memory_id", *[F.lit(None).cast(t).alias(c) for c, t in (("topic", "string"), ("content", "string"), ("importance", "double"), ("confidence", "double"))]).alias("memory"))
    more = e.filter("part > 0").join(ids, "memory_id").select("memory_id", "part", "memory", F.lit(None).cast("array<struct<resolution:int,method:string,content:string,ratio:double>>").alias("versions"), "edges")
    return head.unionByName(more).select("memory_id", "part", F.to_json(F.struct("memory", "versions", "edges")).alias("document"))


def from_package(pkg: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Memories, versions and edges back from documents."""
    p = pkg.select("part", F.from_json("document", PACKAGE_SCHEMA).alias("d"))
    mem = p.filter("part = 0").select("d.memory.*")
    ver = p.select(F.col("d.memory.memory_id").alias("memory_id"), F.explode("d.versions").alias("v")).select("memory_id", "v.*")
    edges = p.select(F.col("d.memory.memory_id").alias("src"), F.explode("d.edges").alias("e")).select("src", "e.*")
    return mem, ver, edges


def create_views(mem: DataFrame, dec: DataFrame, ver: DataFrame) -> None:
    """Views: active memories, current state per topic, memory hierarchy."""
    active_memories(mem).createOrReplaceTempView("active_memories")
    current_state(mem, dec).createOrReplaceTempView("current_state")
    memory_hierarchy(mem, ver).createOrReplaceTempView("memory_hierarchy")


def active_memories(mem: DataFrame) -> DataFrame:
    return mem.filter("status = 'active' and is_current")


def current_state(mem: DataFrame, dec: DataFrame) -> DataFrame:
    """Counts and latest change of current memories and open decisions per topic."""
    m = active_memories(mem).groupBy("topic").agg(F.count("*").alias("memories"), F.max("updated_at").alias("last_update"), F.max_by("memory_id", F.struct("updated_at", "memory_id")).alias("latest_memory"))
    d = dec.filter("is_current").groupBy("topic").agg(F.count("*").alias("open_decisions"))
    return m.join(d, "topic", "left").fillna(0, ["open_decisions"])


def memory_hierarchy(mem: DataFrame, ver: DataFrame) -> DataFrame:
    return mem.select("memory_id", "topic", "memory_type", F.col("resolution").alias("own_resolution")).join(ver.select("memory_id", "resolution", "method", "ratio"), "memory_id", "left")
