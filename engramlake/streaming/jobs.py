"""Structured Streaming jobs: ingest, key states, conflicts, sessions, metrics, deduplication, cooldown.

Sinks are tables in the shared folder; with sink and checkpoint given, a restart goes on with its state.  Aggregations run in update mode and append the changed rows of
each batch; ``latest`` reads the newest row per key, so a batch written twice after a failure is harmless.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from engramlake.operators import facts as E
from engramlake.session import work_path


def read_stream(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", 64).parquet(path)


def run_available(stream: DataFrame, label: str, mode: str = "append", write=None, sink: str | None = None, checkpoint: str | None = None, beside: dict | None = None) -> DataFrame:
    """Run over everything that has arrived and return the sink table with the batch number of each row.

    ``sink`` and ``checkpoint`` are folders that outlive the run: a later call with the same two goes on where the
    last one ended, with its state.  Without them a new pair is used (one-off runs and tests).  A batch replaces its
    own folder, so a retried batch leaves one copy.  ``beside`` maps further sink folders to functions of the batch.
    """
    if (sink is None) != (checkpoint is None):
        raise ValueError("give sink and checkpoint together: the one is only right with the other")
    spark = stream.sparkSession
    sink, checkpoint = sink or work_path(spark, label), checkpoint or work_path(spark, f"{label}-checkpoint")

    def store(batch: DataFrame, batch_id: int) -> None:
        out = write(batch) if write else batch
        out.write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")
        for folder, fn in (beside or {}).items():
            fn(spark.read.parquet(f"{sink}/batch_id={batch_id}")).write.mode("overwrite").parquet(f"{folder}/batch_id={batch_id}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(store).start()
    q.awaitTermination()
    return spark.read.parquet(sink)


def latest(table: DataFrame, keys: list[str]) -> DataFrame:
    from engramlake.operators.skew import latest_rows

    return latest_rows(table, keys, [F.col("batch_id")]).drop("batch_id")


def compile_stream(msg: DataFrame, label: str = "stream-memories", sink: str | None = None, checkpoint: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Memories of arriving turns and their versions, both written batch by batch inside the stream."""
    from engramlake.operators.compilation import memory_candidates
    from engramlake.operators.compression import build_versions

    spark = msg.sparkSession
    if sink is None:
        sink, checkpoint = work_path(spark, label), work_path(spark, f"{label}-checkpoint")
    versions = f"{sink}-versions"
    keyed = lambda m: build_versions(m.withColumn("memory_id", F.concat_ws("/", F.col("message_id").cast("string"), "memory_type")))
    mem = run_available(memory_candidates(msg), label, sink=sink, checkpoint=checkpoint, beside={versions: keyed})
    return mem, spark.read.parquet(versions)


def state_stream(facts: DataFrame, label: str = "stream-state", sink: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Initial and current value, first and last turn and access count per entity and property.

    A streaming aggregation with partial sums, so a hot key is combined before it reaches its state.
    """
    o = F.struct("ts", "fact_id")
    g = facts.groupBy("entity", "property").agg(
        F.min_by("value", o).alias("initial_value"), F.max_by("value", o).alias("current_value"), F.min("fact_id").alias("first_turn"), F.max("fact_id").alias("last_turn"), (F.count("*") - 1).alias("access_count"))
    return latest(run_available(g, label, "update", sink=sink, checkpoint=checkpoint), ["entity", "property"])


def conflict_stream(facts: DataFrame, label: str = "stream-conflicts", sink: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Conflicts of all keys; the state holds one row per (entity, property, value)."""
    active = F.col("status") == "active"
    o = F.struct("ts", "fact_id")
    v = facts.groupBy("entity", "property", "value").agg(F.count("*").alias("n"), F.bool_or(active).alias("is_active"), F.max(F.when(active, o)).alias("last_active"), F.max(o).alias("last"))
    table = latest(run_available(v, label, "update", sink=sink, checkpoint=checkpoint), ["entity", "property", "value"])
    g = table.groupBy("entity", "property").agg(F.sum("n").alias("facts"), F.count("*").alias("values"), F.count_if("is_active").alias("active_values"), F.max_by("value", "last_active").alias("a"), F.max_by("value", "last").alias("l"))
    return g.filter("values > 1 and active_values > 1").select("entity", "property", "facts", "values", "active_values", F.coalesce("a", "l").alias("active_candidate"))


def session_stream(events: DataFrame, key: str, gap: str = "300 seconds", watermark: str = "1 hour", mode: str = "append", label: str = "stream-sessions", sink: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Live sessions by inactivity.  Append gives closed sessions; complete also the open ones at the end."""
    s = events.withWatermark("ts", watermark).groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("events"), F.min("ts").alias("started_at"), F.max("ts").alias("ended_at")).drop("w")
    out = run_available(s, label, mode, sink=sink, checkpoint=checkpoint)
    return out.filter(F.col("batch_id") == out.agg(F.max("batch_id")).scalar()).drop("batch_id") if mode == "complete" else out.drop("batch_id")


def metric_stream(m: DataFrame, by: str, width: str = "1 hour", slide: str | None = None, watermark: str = "2 hours", label: str = "stream-metrics", sink: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Counts and sums per tumbling or sliding window; rows later than the watermark are dropped."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    g = m.withWatermark("ts", watermark).groupBy(w.alias("w"), by).agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.max("value").alias("high"))
    flat = g.select(F.col("w.start").alias("start"), by, "n", "total", "high")
    return latest(run_available(flat, label, "update", sink=sink, checkpoint=checkpoint), ["start", by])


def dedup_stream(msg: DataFrame, watermark: str = "30 days", label: str = "stream-dedup", sink: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """First arrival of each content hash within the watermark."""
    d = msg.withColumn("content_hash", F.substring(F.sha2("text", 256), 1, 16)).withWatermark("created_at", watermark).dropDuplicatesWithinWatermark(["content_hash"])
    return run_available(d.select("content_hash", "created_at"), label, sink=sink, checkpoint=checkpoint).drop("batch_id")


def _cooldown(seconds: int):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # A key's rows of a batch may come in several Arrow batches in any order: they are sorted as a whole.
        pdf = pd.concat(list(batches), ignore_index=True).sort_values(["ts_us", "proposal_id"], ignore_index=True)
        last = state.get[0] if state.exists else None
        at = pdf["ts_us"]
        # A row older than one already judged is late: it neither follows that one nor moves the state.
        late = at < last if last is not None else at != at
        prev = at.where(~late).ffill().shift(1)
        if last is not None:
            prev = prev.fillna(last)
        rejected = ~late & (at - prev < seconds * 1_000_000)
        newest = int(at.max()) if last is None else max(last, int(at.max()))
        state.update((newest,))
        yield pd.DataFrame({"memory_id": key[0], "proposal_id": pdf["proposal_id"], "rejected": rejected.fillna(False).astype(bool)})

    return run


def cooldown_stream(proposals: DataFrame, seconds: int = 3600, label: str = "stream-cooldown", sink: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Proposals that follow the previous event of the same memory too soon; the state is one time per memory.

    A proposal that arrives in a later batch than a newer one of its memory is late: it is not rejected."""
    p = proposals.select("memory_id", "proposal_id", F.unix_micros("ts").alias("ts_us"))
    out = p.groupBy("memory_id").applyInPandasWithState(
        _cooldown(seconds), "memory_id long, proposal_id long, rejected boolean", "last_us long", "append", GroupStateTimeout.NoTimeout)
    return run_available(out, label, sink=sink, checkpoint=checkpoint).drop("batch_id")


def _decay(light_after: int, episode_after: int):
    """Keys of one bucket with their states and timers; the timer of the bucket is the earliest of theirs."""
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        watermark = state.getCurrentWatermarkMs()
        held = {(e, p): (c, last, level) for e, p, c, last, level in zip(*state.get, strict=True)} if state.exists else {}
        changed: set[tuple] = set()
        if not state.hasTimedOut:
            plain = lambda x: x if isinstance(x, str) else None
            for pdf in batches:
                for (e, p), n, last in pdf.groupby(["entity", "property"], dropna=False, sort=False)["ts_ms"].agg(["size", "max"]).itertuples():
                    k = plain(e), plain(p)
                    count, before, _ = held.get(k, (0, 0, 0))
                    held[k] = count + int(n), max(before, int(last)), 3 if count + n >= 3 else 0
                    changed.add(k)
        out = [(*k, held[k][2], held[k][0], False) for k in changed]
        timer = lambda last, level: last + (light_after if level in (0, 3) else episode_after) * 1000 + 1
        due: list[int] = []
        for k, (count, last, level) in list(held.items()):
            at = timer(last, level)
            if k not in changed and at < watermark:
                idle = (watermark - last) // 1000
                level = 3 if count >= 3 else 2 if idle > episode_after else 1 if idle > light_after else max(level, 0)
                out.append((*k, level, count, True))
                if level >= 2:
                    del held[k]
                    continue
                # -1: the first timer has fired and the level has stayed.
                held[k] = count, last, level or -1
                at = last + episode_after * 1000 + 1
            due.append(at)
        if held:
            state.update(tuple(list(c) for c in zip(*[(*k, *v) for k, v in held.items()], strict=True)))
            state.setTimeoutTimestamp(max(min(due), watermark + 1))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["entity", "property", "resolution", "access_count", "decayed"])

    return run


#: Buckets of keys: a task calls Python once for a bucket, not once for a key.
DECAY_BUCKETS = 16_384


def decay_stream(facts: DataFrame, light_after: int = 36000, episode_after: int = 72000, watermark: str = "1 hour", label: str = "stream-decay", sink: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Resolution of each key after silence: event-time timers move idle keys to light and then to episode.

    The keys of a bucket share one state row, in which each key has its own count, time and timer.
    """
    f = facts.withWatermark("ts", watermark).select("entity", "property", "ts", F.unix_millis("ts").alias("ts_ms"), F.pmod(F.xxhash64("entity", "property"), F.lit(DECAY_BUCKETS)).alias("bucket"))
    out = f.groupBy("bucket").applyInPandasWithState(
        _decay(light_after, episode_after), "entity string, property string, resolution int, access_count long, decayed boolean",
        "entity array<string>, property array<string>, count array<long>, last_ms array<long>, level array<int>", "append", GroupStateTimeout.EventTimeTimeout)
    return run_available(out, label, sink=sink, checkpoint=checkpoint).drop("batch_id")
