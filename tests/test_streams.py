"""Streams over several files: late arrival order, decay by silence, restart-safe sinks."""

import datetime as dt

from pyspark.sql import functions as F

from engramlake.session import work_path
from engramlake.streaming import jobs as M

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "fact_id long, entity string, property string, value string, ts timestamp, status string"


def _stream(spark, batches):
    path = work_path(spark, "stream-in")
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def test_state_is_the_newest_value_whatever_the_order(spark):
    rows = [(i, "a", "mode", f"v{i}", T0 + dt.timedelta(days=i), "active") for i in (3, 2, 1)]
    out = M.state_stream(_stream(spark, [[r] for r in rows])).collect()
    assert len(out) == 1 and out[0].current_value == "v3" and out[0].initial_value == "v1" and out[0].access_count == 2


def test_conflict_appears_with_the_second_value(spark):
    one = [(1, "a", "mode", "x", T0, "active")]
    two = [(2, "a", "mode", "y", T0 + dt.timedelta(hours=1), "active")]
    assert M.conflict_stream(_stream(spark, [one])).count() == 0
    assert M.conflict_stream(_stream(spark, [one, two])).count() == 1


def test_idle_keys_decay_and_busy_keys_are_semantic(spark):
    first = [(1, "idle", "p", "x", T0, "active")] + [(i, "busy", "p", "x", T0 + dt.timedelta(minutes=i), "active") for i in (2, 3, 4)]
    later = [(9, "other", "p", "x", T0 + dt.timedelta(days=3), "active")]
    last = [(10, "other", "p", "x", T0 + dt.timedelta(days=4), "active")]
    rows = M.decay_stream(_stream(spark, [first, later, last])).collect()
    assert {r.resolution for r in rows if r.entity == "idle" and r.decayed} == {2}
    assert {r.resolution for r in rows if r.entity == "busy"} == {3}


def test_closed_sessions_only_in_append_mode(spark):
    rows = [(1, "a", "p", "x", T0, "active"), (2, "a", "p", "x", T0 + dt.timedelta(seconds=60), "active")]
    late = [(3, "a", "p", "x", T0 + dt.timedelta(days=2), "active")]
    s = M.session_stream(_stream(spark, [rows, late, late]), "entity")
    assert [(r.events) for r in s.filter(F.col("started_at") < F.lit(T0 + dt.timedelta(days=1))).collect()] == [2]


def test_restart_goes_on_with_its_state(spark):
    path, sink, check = (work_path(spark, x) for x in ("stream-in", "stream-sink", "stream-check"))
    put = lambda rows: spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    read = lambda: spark.readStream.schema(SCHEMA).parquet(path)
    put([(1, "a", "mode", "x", T0, "active"), (2, "a", "mode", "y", T0 + dt.timedelta(hours=1), "active")])
    M.state_stream(read(), sink=sink, checkpoint=check)
    put([(3, "a", "mode", "z", T0 + dt.timedelta(hours=2), "active")])
    out = M.state_stream(read(), sink=sink, checkpoint=check).collect()
    assert [(r.initial_value, r.current_value, r.access_count) for r in out] == [("x", "z", 2)]
    assert [(r.current_value) for r in M.state_stream(read(), sink=sink, checkpoint=check).collect()] == ["z"]  # nothing new


def test_cooldown_of_a_key_over_several_arrow_batches(spark):
    import random

    rows = [(1, i, T0 + dt.timedelta(minutes=7 * (i * i % 53))) for i in range(60)] + [(2, 100 + i, T0 + dt.timedelta(hours=3 * i)) for i in range(9)]
    random.Random(1).shuffle(rows)
    want, last = {}, {}
    for m, p, t in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        want[p] = m in last and t - last[m] < dt.timedelta(hours=1)
        last[m] = t
    schema, path = "memory_id long, proposal_id long, ts timestamp", work_path(spark, "stream-in")
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        sink, check = work_path(spark, "stream-sink"), work_path(spark, "stream-check")
        read = lambda: spark.readStream.schema(schema).parquet(path)
        got = {r.proposal_id: r.rejected for r in M.cooldown_stream(read(), sink=sink, checkpoint=check).collect()}
        assert got == want
        late = [(2, 900, T0 + dt.timedelta(minutes=5)), (2, 901, T0 + dt.timedelta(hours=24, minutes=5))]
        spark.createDataFrame(late, schema).coalesce(1).write.mode("append").parquet(path)
        again = {r.proposal_id: r.rejected for r in M.cooldown_stream(read(), sink=sink, checkpoint=check).collect()}
        assert (again[900], again[901]) == (False, True) and {k: v for k, v in again.items() if k < 900} == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_versions_are_written_inside_the_stream(spark):
    schema, path = "conv_id long, turn long, message_id long, role string, text string, created_at timestamp", work_path(spark, "stream-in")
    spark.createDataFrame([(1, 1, 11, "assistant", "We decided to use the blue server because it is important. I prefer it. " * 20, T0)], schema).coalesce(1).write.parquet(path)
    mem, ver = M.compile_stream(spark.readStream.schema(schema).parquet(path))
    assert mem.count() > 0 and ver.select("memory_id").distinct().count() == mem.count() and "batch_id" in ver.columns


def test_keys_of_one_bucket_keep_timers_of_their_own(spark, monkeypatch):
    """Python was called for every key; with one bucket the rows are those of keys held alone."""
    h = lambda n: T0 + dt.timedelta(hours=n)
    batches = [[(1, "a", "p", "x", h(0), "active"), (2, None, "p", "x", h(1), "active")] + [(i, "b", "p", "x", h(2), "active") for i in (3, 4, 5)], [(6, "c", "p", "x", h(13), "active")],
               [(7, "c", "p", "x", h(14), "active"), (8, "a", "q", "x", h(14), "active")], [(9, "c", "p", "x", h(26), "active")], [(10, "a", "p", "x", h(90), "active")], [(11, "d", "p", "x", h(200), "active")]]
    got = {}
    for n in (1, 4096):
        monkeypatch.setattr(M, "DECAY_BUCKETS", n)
        got[n] = sorted(map(str, M.decay_stream(_stream(spark, batches)).collect()))
    assert got[1] == got[4096]
    assert sum("entity='a'" in r and "property='p'" in r and "decayed=True" in r for r in got[1]) == 2  # light, and episode after its return, which came in the batch of its second timer
