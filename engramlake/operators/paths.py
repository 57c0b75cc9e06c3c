"""Shortest paths from both ends, strongly connected components and short cycles.

Every step is a join of a frontier with an edge table and is written once; the driver sees row counts only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engramlake.functions import text as X
from engramlake.session import materialise

PAIR = ["a", "b"]


def undirected(edges: DataFrame, min_strength: float = 0.0, types: list[str] | None = None) -> DataFrame:
    """Both directions of each edge, strongest edge per pair and no loops."""
    e = edges.filter(F.round("strength", 9) >= min_strength).filter("src <> dst")
    e = e.filter(F.col("type").isin(types)) if types else e
    both = F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("next")), F.struct(F.col("dst").alias("node"), F.col("src").alias("next")))
    return e.select(F.explode(both).alias("b"), "type", "strength").select("b.*", "type", "strength").groupBy("node", "next").agg(F.max("strength").alias("strength"), F.max_by("type", F.struct("strength", "type")).alias("type"))


def shortest_paths(pairs: DataFrame, edges: DataFrame, depth: int = 3) -> DataFrame:
    """Shortest path (fewest edges, then least path) between given pairs (a, b) of at most ``depth`` edges.

    Both ends of a pair grow breadth-first, each round on the side whose frontier has fewer edges, so a hub is only
    entered, not opened, while the other side is smaller.  A pair is done in the round in which a new node lies on the
    other side's frontier.  The last round needs no new frontier: where it is cheaper, the two frontiers are tested
    against the edges instead.  Rows are visited nodes of a pair and the edges that led to them; paths are rebuilt
    from these, one node per position.
    """
    adj = materialise(undirected(edges).select("node", "next"), "path-edges")
    degree = adj.groupBy("node").agg(F.count("*").alias("degree"))
    ends = F.array(F.struct(F.lit("a").alias("side"), F.col("a").alias("node")), F.struct(F.lit("b").alias("side"), F.col("b").alias("node")))
    front = materialise(pairs.select("a", "b").filter("a <> b").distinct().select("a", "b", F.explode(ends).alias("e")).select("a", "b", "e.*", F.lit(0).alias("d")), "path-front")
    seen, led, met, crossed = [front.select("a", "b", "side", "node")], [], [], None
    for r in range(1, depth + 1):
        cost = front.join(degree, "node", "left").groupBy("a", "b", "side").agg(F.sum(F.coalesce("degree", F.lit(0))).alias("edges"), F.count("*").alias("nodes"), F.max("d").alias("d"))
        pick = cost.groupBy("a", "b").agg(F.min_by("side", F.struct("edges", "side")).alias("side"), F.min("edges").alias("edges"), F.product("nodes").alias("probes"), F.count("*").alias("sides")).filter("sides = 2")
        if r == depth:
            pick = materialise(pick.withColumn("probe", F.col("probes") < F.col("edges")), "path-pick")
            probe = front.join(pick.filter("probe").select("a", "b"), PAIR)
            left = probe.filter("side = 'a'").select("a", "b", F.col("node").alias("x"), F.col("d").alias("pos"))
            tried = left.join(probe.filter("side = 'b'").select("a", "b", F.col("node").alias("y")), PAIR)
            crossed = materialise(tried.join(adj.select(F.col("node").alias("x"), F.col("next").alias("y")), ["x", "y"], "left_semi").withColumn("r", F.lit(r)), "path-cross")
            pick = pick.filter("not probe")
        grow = front.join(pick.select("a", "b", "side"), [*PAIR, "side"]).join(adj, "node").select("a", "b", "side", F.col("next").alias("node"), F.col("node").alias("parent"), (F.col("d") + 1).alias("d"))
        step = materialise(grow.join(reduce(DataFrame.union, seen), [*PAIR, "side", "node"], "left_anti").select("a", "b", "side", "node", "parent", "d").distinct(), "path-step")
        led.append(step)
        new = step.select("a", "b", "side", "node", "d").distinct()
        rest = front.join(pick.select("a", "b"), PAIR, "left_semi").join(pick.select("a", "b", "side"), [*PAIR, "side"], "left_anti")
        hit = new.join(rest.select("a", "b", "node", F.col("d").alias("other")), [*PAIR, "node"])
        hit = materialise(hit.select("a", "b", "node", F.when(F.col("side") == "a", F.col("d")).otherwise(F.col("other")).alias("pos"), F.lit(r).alias("r")), "path-hit")
        met.append(hit)
        if r < depth:
            front = materialise(new.union(rest.select(new.columns)).join(hit.select("a", "b").distinct(), PAIR, "left_anti"), "path-front")
            seen.append(new.select("a", "b", "side", "node"))
    met, led = reduce(DataFrame.union, met), reduce(DataFrame.union, led)
    # Edges of shortest paths: from the meeting nodes back to a and on to b.
    found = [crossed.select("a", "b", "pos", F.col("x").alias("node"), F.col("y").alias("to"))]
    back = met.select("a", "b", "node", "pos").union(crossed.select("a", "b", F.col("x").alias("node"), "pos")).distinct()
    on = met.select("a", "b", "node", "pos", "r").union(crossed.select("a", "b", F.col("y").alias("node"), F.col("pos") + 1, "r")).distinct()
    for _ in range(depth):
        e = materialise(back.join(led.filter("side = 'a'").select("a", "b", "node", "parent", F.col("d").alias("pos")), [*PAIR, "node", "pos"]).select("a", "b", (F.col("pos") - 1).alias("pos"), F.col("parent").alias("node"), F.col("node").alias("to")), "path-back")
        found.append(e)
        back = e.select("a", "b", "node", "pos").distinct()
        e = on.withColumn("d", F.col("r") - F.col("pos")).join(led.filter("side = 'b'").select("a", "b", "node", "parent", "d"), [*PAIR, "node", "d"])
        e = materialise(e.select("a", "b", "pos", "node", F.col("parent").alias("to"), "r"), "path-on")
        found.append(e.drop("r"))
        on = e.select("a", "b", F.col("to").alias("node"), (F.col("pos") + 1).alias("pos"), "r").distinct()
    least = materialise(reduce(DataFrame.union, found).groupBy("a", "b", "pos", "node").agg(F.min("to").alias("to")), "path-least")
    out = met.select("a", "b", "r").union(crossed.select("a", "b", "r")).distinct().withColumn("path", F.array("a"))
    for p in range(depth):
        nxt = least.filter(F.col("pos") == p).select("a", "b", F.col("node").alias("last"), "to")
        out = out.withColumn("last", F.element_at("path", -1)).join(nxt, [*PAIR, "last"], "left").select("a", "b", "r", F.when(F.col("to").isNull(), F.col("path")).otherwise(F.concat("path", F.array("to"))).alias("path"))
    return out.select("a", "b", F.col("r").alias("length"), "path")


def _same(now: DataFrame, before: int) -> tuple[int, bool]:
    n = now.count()
    return n, n == before


def trimmed(e: DataFrame, rounds: int | None = None) -> DataFrame:
    """Edges (src, dst) left when nodes without an edge in or without an edge out are taken away until none is left."""
    n, done, i = e.count(), False, 0
    while n and not done and (rounds is None or i < rounds):
        e = materialise(e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"), "trim")
        n, done = _same(e, n)
        i += 1
    return e


def strong_components(edges: DataFrame) -> DataFrame:
    """node, component (greatest member) of every strongly connected component of two nodes or more.

    Forward-backward colouring: after trimming, the greatest id that reaches a node becomes its colour; the nodes of a
    colour that reach its root backwards are one component.  Components are settled and taken away until no edge is
    left.  Rounds grow with the longest shortest path, not with the number of nodes.
    """
    e = trimmed(materialise(edges.filter("src <> dst").select("src", "dst").distinct(), "scc"))
    settled = []
    while not e.isEmpty():
        colour = materialise(e.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("colour", F.col("node")), "colour")
        changed = True
        while changed:
            better = e.join(colour.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.max("colour").alias("best"))
            new = materialise(colour.join(better, "node", "left").select("node", F.greatest("colour", "best").alias("colour"), (F.col("best") > F.col("colour")).alias("moved")), "colour")
            changed = not new.filter("moved").isEmpty()
            colour = new.select("node", "colour")
        # Only edges inside a colour can lie on a cycle.
        inner = materialise(e.join(colour.withColumnRenamed("node", "src"), "src").join(colour.select(F.col("node").alias("dst"), F.col("colour").alias("other")), "dst").filter("colour = other").select("src", "dst", "colour"), "scc-inner")
        front = inner.select("colour").distinct().select(F.col("colour").alias("node"), "colour")
        mine = [front]
        while not front.isEmpty():
            back = inner.join(front.select(F.col("node").alias("dst"), "colour"), ["dst", "colour"]).select(F.col("src").alias("node"), "colour").distinct()
            front = materialise(back.join(reduce(DataFrame.union, mine), ["node", "colour"], "left_anti"), "scc-back")
            mine.append(front)
        members = materialise(reduce(DataFrame.union, mine), "scc-done")
        settled.append(members)
        left = inner.join(members.select(F.col("node").alias("src")), "src", "left_anti").join(members.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst")
        e = trimmed(materialise(left, "scc"))
    if not settled:
        return edges.select(F.col("src").alias("node"), F.col("src").alias("component")).limit(0)
    found = reduce(DataFrame.union, settled).select("node", F.col("colour").alias("component"))
    return found.join(found.groupBy("component").agg(F.count("*").alias("n")).filter("n > 1").select("component"), "component", "left_semi").select("node", "component")


#: Width of the reach signature of a node, in 64-bit words.
WORDS = 16


def short_cycle_edges(edges: DataFrame, max_length: int, passes: int = 3) -> DataFrame:
    """Edges that may lie on a cycle of at most ``max_length``; no edge that does is lost.

    Every node carries a bit signature of the nodes it reaches in ``max_length - 1`` steps; an edge stays if its source
    is in the signature of its target.  Chains and trees of any depth go in a fixed number of rounds; the bits are dealt
    anew in each pass, so chance hits go in the next one.
    """
    e, n = edges, edges.count()
    for p in range(passes):
        if not n:
            break

        def word(c: str, i: int, p: int = p) -> Column:
            bit = F.pmod(F.xxhash64(c, F.lit(p)), F.lit(64 * WORDS)).cast("int")
            return F.when(F.floor(bit / 64) == i, F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(bit, F.lit(64)))).otherwise(F.lit(0).cast("long"))

        own = [word("node", i).alias(f"w{i}") for i in range(WORDS)]
        reach = materialise(e.select(F.explode(F.array("src", "dst")).alias("node")).distinct().select("node", *own), "reach")
        for _ in range(max_length - 1):
            onward = e.join(reach.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(*[F.bit_or(f"w{i}").alias(f"v{i}") for i in range(WORDS)])
            reach = materialise(reach.join(onward, "node", "left").select("node", *[F.col(f"w{i}").bitwiseOR(F.coalesce(f"v{i}", F.lit(0))).alias(f"w{i}") for i in range(WORDS)]), "reach")
        back = reduce(Column.__or__, [word("src", i).bitwiseAND(F.col(f"w{i}")) != 0 for i in range(WORDS)])
        e = materialise(e.join(reach.withColumnRenamed("node", "dst"), "dst").filter(back).select("src", "dst"), "reach-edges")
        n, done = _same(e, n)
        if done:
            break
    return e


def cycles(edges: DataFrame, max_length: int = 5) -> DataFrame:
    """Directed cycles up to a length, each reported once from its least node.

    Edges that cannot lie on a short cycle go first, then those between strongly connected components; paths grow
    inside a component only.
    """
    e = materialise(edges.filter("src <> dst").select("src", "dst").distinct(), "cycle-edges")
    e = short_cycle_edges(e, max_length)
    c = strong_components(e)
    one = lambda s: c.select(F.col("node").alias(s), F.col("component").alias(f"{s}_c"))
    e = materialise(e.join(one("src"), "src").join(one("dst"), "dst").filter("src_c = dst_c").select("src", "dst"), "cycle-edges")
    path = e.filter("src < dst").select(F.col("src").alias("start"), F.col("dst").alias("end"), F.array("src", "dst").alias("path"))
    found = []
    for _ in range(max_length - 1):
        n = path.join(e.select(F.col("src").alias("end"), F.col("dst").alias("nxt")), "end")
        found.append(n.filter("nxt = start").select("path"))
        path = n.filter(F.col("nxt") > F.col("start")).filter(~F.array_contains(F.col("path"), F.col("nxt"))).select("start", F.col("nxt").alias("end"), F.concat("path", F.array("nxt")).alias("path"))
    c = reduce(DataFrame.unionByName, found)
    n = F.size("path")
    return c.select("path", n.cast("long").alias("length"), X.label((n <= 2, "high"), (n <= 4, "medium"), default="low").alias("severity"))
