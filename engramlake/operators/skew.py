"""Grouped and ordered computations that never put a whole key into one task.

A key may hold a third of all rows, so a plain window over the key would sort that third in one
task.  The helpers cut each key into buckets of its ordering (for instance days), work inside the
buckets, and carry the state between buckets through a table with one row per bucket.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engramlake.session import materialise


def latest_rows(df: DataFrame, keys: list[str], order: list[Column], first: bool = False) -> DataFrame:
    """One row per key, the greatest (or least) by ``order``; combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.min_by if first else F.max_by
    return (
        df.groupBy(*keys)
        .agg(pick(F.struct(*rest), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])).alias("_r"))
        .select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])
    )


#: Spark limits the groups of a rank window in each task only for limits below this; longer ones raise it.
GROUP_LIMIT = "spark.sql.optimizer.windowGroupLimitThreshold"
PARTS = 64


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """Rows of rank <= k per key.

    Every task limits its groups before the shuffle.  A long limit (1,000 and more) is first applied to ``PARTS``
    hashed parts of each key, so no task sorts more of a key than ``PARTS * k`` rows whatever the key holds.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    if k >= 1000:
        conf = df.sparkSession.conf
        if int(conf.get(GROUP_LIMIT, "1000")) <= k:
            conf.set(GROUP_LIMIT, str(k + 1))
        plain = [c for c, t in df.dtypes if "map<" not in t]
        part = Window.partitionBy(*keys, "_part").orderBy(*order)
        df = df.withColumn("_part", F.pmod(F.xxhash64(*plain), F.lit(PARTS))).withColumn("_rp", F.row_number().over(part)).filter(F.col("_rp") <= k).drop("_part", "_rp")
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k).withColumn(name, F.col(name).cast("long"))


def neighbour(df: DataFrame, keys: list[str], bucket: str, order: list[str], cols: list[str], prefix: str, forward: bool = False) -> DataFrame:
    """Values of the previous (or next) row of the same key, bucket by bucket.

    ``bucket`` must rise with ``order``.  Only the outermost row of each bucket looks at another bucket.
    """
    names = [f"{prefix}{c}" for c in cols]
    direction = (lambda c: F.col(c).desc()) if forward else (lambda c: F.col(c).asc())
    inside = Window.partitionBy(*keys, bucket).orderBy(*[direction(c) for c in order])
    packed = df.withColumn("_n", F.lag(F.struct(*cols)).over(inside))
    pick = F.min_by if forward else F.max_by
    ends = df.groupBy(*keys, bucket).agg(pick(F.struct(*cols), F.struct(*order)).alias("_e"))
    across = Window.partitionBy(*keys).orderBy(direction(bucket))
    ends = ends.select(*keys, bucket, F.lag("_e").over(across).alias("_p"))
    joined = packed.join(ends, [*keys, bucket], "left")
    return joined.withColumn("_v", F.coalesce("_n", "_p")).select(
        *[c for c in df.columns], *[F.col(f"_v.{c}").alias(n) for c, n in zip(cols, names)]
    )


def running_total(df: DataFrame, keys: list[str], bucket: str, order: list[str], value: str, name: str) -> DataFrame:
    """Inclusive running sum per key: inside the bucket plus the sum of all earlier buckets."""
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = df.groupBy(*keys, bucket).agg(F.sum(value).alias("_t"))
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, bucket, F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_before"))
    return (
        df.withColumn("_i", F.sum(value).over(inside))
        .join(sums, [*keys, bucket], "left")
        .withColumn(name, F.col("_i") + F.col("_before"))
        .drop("_i", "_before")
    )


def prefix_budget(ranked: DataFrame, keys: list[str], order: list[Column], tokens: str, budget: int) -> DataFrame:
    """Longest prefix per key whose token sum stays within ``budget``; stops at the first overflow.

    Each row costs at least one token, so the prefix holds at most ``budget`` rows: the rank limit
    is exact, and ``top_k`` keeps what one task sorts bounded by it.
    """
    head = top_k(ranked, keys, order, budget, "_rk")
    w = Window.partitionBy(*keys).orderBy("_rk").rowsBetween(Window.unboundedPreceding, 0)
    return head.withColumn("used_tokens", F.sum(tokens).over(w)).filter(F.col("used_tokens") <= budget).drop("_rk")


def salted_distinct_count(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Exact distinct count per key: first unique (key, value), then count; no key in one task."""
    return df.select(*keys, value).distinct().groupBy(*keys).agg(F.count(value).alias(name))


def interval_join(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, start: str, end: str) -> DataFrame:
    """Points inside half-open intervals [start, end) of the same keys; a null end is open.

    Both sides are cut into calendar months: the equi-join is on keys and month, so neither a long
    history nor many points of one key meet in one task as a plain range join would make them.
    """
    month = lambda c: F.year(c) * 12 + F.month(c)
    last = points.agg(F.max(month(F.col(at)))).scalar()
    p = points.withColumn("_m", month(F.col(at)))
    stop = F.least(F.coalesce(month(F.col(end)), last), last)
    begin = month(F.col(start))
    i = intervals.filter(begin <= stop).withColumn("_m", F.explode(F.sequence(begin, stop)))
    return p.join(i, [*keys, "_m"]).filter((F.col(start) <= F.col(at)) & (F.col(end).isNull() | (F.col(at) < F.col(end)))).drop("_m")


#: Bits of a microsecond position below which only points near the end of an interval look: about 18 minutes.
FINE = 30


def _cover(low: Column, high: Column, levels: int) -> Column:
    """Dyadic nodes (level, index) that make up [low, high): at most two of each level."""
    def at(level: Column) -> Column:
        a = F.call_function("shiftright", low + F.call_function("shiftleft", F.lit(1).cast("long"), level) - 1, level)
        b = F.call_function("shiftright", high, level)
        node = lambda cond, i: F.when((a < b) & cond, F.struct(level.alias("level"), i.alias("index")))
        return F.array(node(a % 2 == 1, a), node(b % 2 == 1, b - 1))

    return F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels - 1)), at)))


def covering(points: DataFrame, intervals: DataFrame, point_id: str, keys: list[str], at: str, start: str, end: str, value: list[str], best: Callable[[DataFrame, list[str]], DataFrame]) -> DataFrame:
    """``value`` columns of intervals that cover each point, after ``best`` has reduced every node.

    Intervals are half-open and a null end is open.  Every interval is laid on the at most two dyadic nodes per level
    that make it up; ``best(rows, node)`` keeps of each node the rows that can matter to a point under it, so overlapping
    intervals of one key cost what it keeps.  A point asks its ancestors: all coarse ones, and the fine ones only where
    an interval begins or ends near by.
    """
    place = lambda c, base: F.unix_micros(c) - F.lit(base)
    base, top = intervals.agg(F.min(F.unix_micros(start)), F.max(F.unix_micros(F.coalesce(end, start)))).first()
    last = points.agg(F.max(F.unix_micros(at))).first()[0]
    if base is None or last is None or last < base:
        return points.select(point_id, *[F.lit(None).cast(dict(intervals.dtypes)[v]).alias(v) for v in value]).limit(0)
    span = max(top, last) - base + 1
    levels = max(span.bit_length() + 1, FINE + 1)
    iv = intervals.withColumn("_lo", place(F.col(start), base)).withColumn("_hi", F.coalesce(place(F.col(end), base), F.lit(span))).filter("_lo < _hi")
    nodes = iv.select(*keys, *value, F.explode(_cover(F.col("_lo"), F.col("_hi"), levels)).alias("n")).select(*keys, *value, F.col("n.level").alias("_level"), F.col("n.index").alias("_index"))
    node = [*keys, "_level", "_index"]
    nodes = materialise(best(nodes, node).select(*node, *value), "cover")
    used = [r[0] for r in nodes.select("_level").distinct().collect()]  # at most 64 levels
    p = points.select(point_id, *keys, place(F.col(at), base).alias("_x")).filter("_x >= 0")
    # Points near the ends of intervals of their key.
    edge = nodes.filter(F.col("_level") < FINE).select(*keys, F.expr(f"shiftright(_index, {FINE} - _level)").alias("_leaf")).distinct()
    near = p.withColumn("_leaf", F.shiftright("_x", FINE)).join(edge.hint("merge"), [*keys, "_leaf"], "left_semi")
    found = points.select(point_id, *[F.lit(None).cast(t).alias(v) for v, t in nodes.select(*value).dtypes]).limit(0)
    # Merge joins: the planner does not see how many rows ``explode`` makes of the points and would broadcast them.
    for rows, some in ((p, [x for x in used if x >= FINE]), (near, [x for x in used if x < FINE])):
        if some:
            up = rows.select(point_id, *keys, "_x", F.explode(F.array(*[F.lit(x) for x in some])).alias("_level")).withColumn("_index", F.expr("shiftright(_x, _level)"))
            found = found.unionByName(up.join(nodes.hint("merge"), node).select(point_id, *value))
    return found


def latest_covering(points: DataFrame, intervals: DataFrame, point_id: str, keys: list[str], at: str, start: str, end: str, value: list[str], order: list[str]) -> DataFrame:
    """``value`` columns of the interval of greatest ``order`` that covers each point; points without one are left out."""
    cols = list(dict.fromkeys([*value, *order]))
    greatest = lambda rows, by: rows.groupBy(*by).agg(F.max(F.struct(F.struct(*order).alias("o"), F.struct(*cols).alias("v"))).alias("_b")).select(*by, "_b.v.*")
    found = covering(points, intervals, point_id, keys, at, start, end, cols, greatest)
    return greatest(found, [point_id]).select(point_id, *value)


#: Rows of one key that a task sorts whole.
WHOLE_KEY = 1_000_000


def small_keys(df: DataFrame, keys: list[str]) -> bool:
    """Does no key hold more rows than one task may sort?  Counts them, before a shuffle."""
    most = df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    return (most or 0) <= WHOLE_KEY


def last_begun(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, start: str, end: str, order: list[str]) -> DataFrame:
    """Points with the interval of their keys (struct ``last``) that was the last to begin at or before them, by start and ``order``.

    Points and intervals are sorted together, so both are shuffled once; where a key holds very many rows, day by day
    with the last interval of the earlier days.
    """
    cols = [c for c in intervals.columns if c not in keys]
    known = intervals.filter(F.col(start).isNotNull() & (F.col(end).isNull() | (F.col(start) < F.col(end))))
    known = known.filter(" and ".join(f"`{k}` is not null" for k in keys))
    known = known.select(*keys, F.col(start).alias("_t"), F.lit(None).cast(points.select(F.struct(*points.columns)).schema[0].dataType).alias("_p"), F.struct(F.struct(*order).alias("_o"), *cols).alias("_v"))
    both = points.select(*keys, F.col(at).alias("_t"), F.struct(*points.columns).alias("_p"), F.lit(None).cast(known.schema["_v"].dataType).alias("_v")).unionByName(known)
    along = ["_t", F.col("_p").isNotNull(), "_v._o"]
    if small_keys(both.select(*keys), keys):
        last = F.last("_v", True).over(Window.partitionBy(*keys).orderBy(*along))
        return both.withColumn("last", last).filter("_p is not null").select("_p.*", "last")
    both = both.withColumn("_b", F.to_date("_t"))
    inside = F.last("_v", True).over(Window.partitionBy(*keys, "_b").orderBy(*along).rowsBetween(Window.unboundedPreceding, 0))
    ends = both.groupBy(*keys, "_b").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.struct("_t", "_v._o"))).alias("_e"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*keys, "_b", F.last("_e", True).over(before).alias("_e"))
    return both.withColumn("last", inside).filter("_p is not null").join(ends, [*keys, "_b"], "left").select("_p.*", F.coalesce("last", "_e").alias("last"))


# Rows up to which a side is broadcast; beyond it the join is left to a shuffle.
BROADCAST_ROWS = 1_000_000


def broadcast_within(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` if a counted bound of its rows is small, else leave the join to the planner."""
    return F.broadcast(df) if rows <= limit else df
