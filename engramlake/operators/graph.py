"""Association, evidence and dependency graphs: bounded frontier joins over edge tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engramlake.functions import text as X
from engramlake.operators import similar as SIM
from engramlake.operators import skew
from engramlake.operators.paths import cycles, shortest_paths, undirected  # noqa: F401
from engramlake.operators.textfeatures import bigrams
from engramlake.session import materialise
from engramlake.functions import lexicons as L

# English cue words of each association type.
CUES = {
    "causes": ["thus", "therefore", "because"],
    "follows": ["later", "then", "after", "followed by"],
    "contradicts": ["nevertheless", "contrary"],
    "elaborates": ["in detail", "specifically", "elaborate"],
    "summarizes": ["summary", "in short", "tl dr"],
}


#: Limits of the overlaps of words and of entities: below both limits a pair stays below the total of 0.3, by its distance in time.
#: On one day or the next (0.3 o + 0.2 e >= 0.1), from two to six days (0.1786) and beyond (0.29).
NEAR_DAYS, SAME_DAY, SOME_DAYS, ANY_TIME = 6, (0.266, 0.1), (0.35, 0.367), (0.7, 0.4)
#: Prefix words and entities that a far pair must share before it is compared: many words, for comparing them costs more.
FAR_MATCHES = (16, 3)
#: Memories of one conversation and topic up to which all of them are compared; larger groups meet in tiles.
FEW_MEMORIES = 64


def _association_sets(mem: DataFrame, cues: dict[str, list[str]]) -> DataFrame:
    """What pairs are compared by: sets of words and entities and marks of cue words; texts are cut once."""
    marks = F.array_compact(F.array(*[F.when(X.has_phrase(F.col("_p"), ws), F.lit(t)) for t, ws in cues.items()]))
    m = mem.withColumn("_p", X.padded(F.col("content"))).select(
        "topic", "memory_id", "conv_id", "resolution", "created_at", F.unix_date(F.to_date("created_at")).alias("day"), F.array_distinct(X.entity_set(F.col("content"))).alias("e"),
        marks.alias("k"), F.array_sort(F.array_distinct(X.word_list(F.col("content")))).alias("w"))
    return materialise(m, "association-sets")


def association_pairs(mem: DataFrame, sets: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b) of one topic that can reach a total of 0.3 or have a part for resolution, without forming the pairs of a topic.

    With word overlap o, closeness t, entity overlap e and resolution part r the total is 0.3 o + 0.2 t + 0.2 e + 0.3 r:
    * r = 0.8: memories of one conversation whose resolutions differ by one or two;
    * r = 0.6: o > 0.5 within a conversation;
    * else 0.3 o + 0.2 e >= 0.3 - 0.2 t: one of two limits is reached, of words or of entities (``SAME_DAY``, ``SOME_DAYS``,
      ``ANY_TIME``): exact set-similarity joins within days, within spans of a week, and within the topic.
    Copies of one text are linked like any other texts.
    """
    m = _association_sets(mem, {}) if sets is None else sets
    numbered = lambda c: SIM.by_rarity(m.select("topic", "day", "conv_id", "memory_id", F.col(c).alias("s")).filter(F.size("s") > 0), "memory_id")
    words, entities = numbered("w"), numbered("e")
    c = mem.filter("conv_id is not null").select("topic", "conv_id", "resolution", "memory_id")
    steps = c.withColumn("resolution", F.explode(F.array(*[F.col("resolution") + d for d in (1, 2)]))).withColumnRenamed("memory_id", "lower")
    same = c.join(steps, ["topic", "conv_id", "resolution"]).select(F.least("lower", "memory_id").alias("a"), F.greatest("lower", "memory_id").alias("b"))
    # Within a conversation o > 0.5 is enough.
    sizes = m.filter("conv_id is not null").groupBy("topic", "conv_id").agg(F.count("*").alias("n")).filter("n > 1")
    few = m.select("topic", "conv_id", "memory_id", F.size("w").alias("n")).join(sizes.filter(F.col("n") <= FEW_MEMORIES).drop("n"), ["topic", "conv_id"], "left_semi")
    beside = few.join(few.select("topic", "conv_id", F.col("memory_id").alias("b"), F.col("n").alias("bn")), ["topic", "conv_id"])
    beside = beside.filter((F.col("memory_id") < F.col("b")) & (2 * F.least("n", "bn") > F.greatest("n", "bn"))).select(F.col("memory_id").alias("a"), "b")
    many = words.join(sizes.filter(F.col("n") > FEW_MEMORIES).drop("n"), ["topic", "conv_id"], "left_semi")
    many = SIM.jaccard_pairs(many, many, ["topic", "conv_id"], 0.5, id_col="memory_id", less=True).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    # Topics and days with another day of two to six days' distance; only their memories meet within spans.
    days = materialise(m.select("topic", "day").distinct(), "topic-days")
    other = days.select("topic", F.explode(F.transform(F.array(*[F.lit(i) for i in range(-NEAR_DAYS, NEAR_DAYS + 1) if abs(i) > 1]), lambda i: F.col("day") + i)).alias("day"))
    days = materialise(days.join(other.distinct(), ["topic", "day"], "left_semi"), "near-days")
    some = skew.broadcast_within(days, days.count())
    # Sizes and times of a pair bound its total before texts are read.
    at = lambda n: m.select(F.col("memory_id").alias(f"{n}_id"), F.unix_micros("created_at").alias(f"{n}t"), F.size("w").alias(f"{n}w"), F.size("e").alias(f"{n}e"))
    gap = F.abs(F.col("at") - F.col("bt")) / F.lit(86400000000.0)
    most = lambda x: F.when(F.least(f"a{x}", f"b{x}") > 0, F.least(f"a{x}", f"b{x}") / F.greatest(f"a{x}", f"b{x}")).otherwise(0.0)
    found = [same, beside, many]
    for i, s in enumerate((words, entities)):
        by_day = s.withColumn("day", F.explode(F.array(F.col("day") - 1, F.col("day"), F.col("day") + 1)))
        span = s.join(some, ["topic", "day"], "left_semi").withColumn("span", F.floor(F.col("day") / (NEAR_DAYS + 1)))
        around = span.withColumn("span", F.explode(F.array(F.col("span") - 1, F.col("span"), F.col("span") + 1)))
        o, e = (F.col("score"), most("e")) if i == 0 else (most("w"), F.col("score"))
        for pairs in (SIM.jaccard_pairs(s, by_day, ["topic", "day"], SAME_DAY[i], id_col="memory_id", less=True),
                      SIM.jaccard_pairs(span, around, ["topic", "span"], SOME_DAYS[i], id_col="memory_id", less=True),
                      SIM.jaccard_pairs(s, s, ["topic"], ANY_TIME[i], FAR_MATCHES[i], id_col="memory_id", less=True)):
            p = pairs.join(at("a"), "a_id").join(at("b"), "b_id").filter(0.3 * o + 0.2 * F.exp(-gap / 2.0) + 0.2 * e > 0.3 - 1e-6)
            found.append(materialise(p.select(F.col("a_id").alias("a"), F.col("b_id").alias("b")), "close-pairs"))
    return materialise(reduce(DataFrame.union, found).distinct(), "association-pairs")


def mine_associations(mem: DataFrame, cues: dict[str, list[str]] = CUES, threshold: float = 0.3) -> DataFrame:
    """Typed links between memories of one topic: related by the total, summarizes by resolution, and by cue words.

    ``threshold`` is at least 0.3, the least total for which ``association_pairs`` is complete.
    """
    if threshold < 0.3:
        raise ValueError("pairs are complete from a total of 0.3 on")
    m = _association_sets(mem, cues)
    pairs = association_pairs(mem, m)
    ids = pairs.select(F.explode(F.array("a", "b")).alias("memory_id")).distinct()
    m = m.join(skew.broadcast_within(ids, 2 * pairs.count()), "memory_id", "left_semi")
    side = lambda s: m.select(*[F.col(c).alias(f"{s}_{c}") for c in ("memory_id", "conv_id", "resolution", "created_at", "e", "k", "w")])
    j = pairs.join(side("a"), F.col("a") == F.col("a_memory_id")).join(side("b"), F.col("b") == F.col("b_memory_id"))
    j = j.withColumn("overlap", F.when((F.size("a_w") > 0) & (F.size("b_w") > 0), F.round(X.jaccard(F.col("a_w"), F.col("b_w")), 9)).otherwise(0.0)).drop("a_w", "b_w")
    gap = F.abs(F.unix_micros("a_created_at") - F.unix_micros("b_created_at")) / F.lit(86400000000.0)
    both = (F.size("a_e") > 0) & (F.size("b_e") > 0)
    diff = F.abs(F.col("a_resolution") - F.col("b_resolution"))
    same = F.col("a_conv_id") == F.col("b_conv_id")
    res = F.when(same & diff.between(1, 2), 0.8).when(same & (F.col("overlap") > 0.5), 0.6).otherwise(0.0)
    s = F.round(F.col("overlap") * 0.3 + F.exp(-gap / 2.0) * 0.2 + F.when(both, X.jaccard(F.col("a_e"), F.col("b_e"))).otherwise(0.0) * 0.2 + res * 0.3, 9)
    j = j.withColumn("res", res).withColumn("s", s).filter((F.col("s") >= threshold) | (F.col("res") > 0.5))
    link = lambda t, v: F.struct(t.alias("type"), v.alias("strength"))
    links = F.concat(
        F.array_compact(F.array(F.when(F.col("s") >= threshold, link(F.lit("related"), F.col("s"))), F.when(F.col("res") > 0.5, link(F.lit("summarizes"), F.col("res"))))),
        F.transform(F.array_union("a_k", "b_k"), lambda t: link(t, F.lit(0.7))))
    return j.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.explode(links).alias("l")).groupBy("src", "dst", "l.type").agg(F.max("l.strength").alias("strength"))


def neighbours(ids: DataFrame, edges: DataFrame, mem: DataFrame, min_strength: float = 0.3, types: list[str] | None = None) -> DataFrame:
    """Current neighbours of each given memory with type and strength."""
    u = undirected(edges, min_strength, types)
    n = ids.select(F.col("memory_id").alias("node")).join(u, "node")
    return n.join(mem.filter("is_current").select(F.col("memory_id").alias("next")), "next", "left_semi").select("node", "next", "type", "strength")


def traverse(seeds: DataFrame, steps: DataFrame, depth: int = 2, max_nodes: int = 64) -> DataFrame:
    """Breadth-first expansion per seed set (set_id, node) over steps (node, next, strength).

    A set keeps at most ``max_nodes`` nodes in the order depth, strength, id.  A node with very many
    neighbours is cut to its 2 * max_nodes strongest first: of a set's neighbours at most max_nodes are
    already visited, so the cut cannot change the result.
    """
    adj = skew.top_k(steps, ["node"], [F.col("strength").desc(), F.col("next")], 2 * max_nodes, "_r").drop("_r")
    front = seeds.select("set_id", "node", F.lit(0).alias("depth"), F.lit(1.0).cast("double").alias("strength"), F.array(F.col("node").cast("long")).alias("path")).dropDuplicates(["set_id", "node"])
    seen = front
    for d in range(1, depth + 1):
        a = adj.select("node", F.col("next"), F.col("strength").alias("_s"))
        nxt = front.select("set_id", "node", "strength", "path").join(a, "node").select(
            "set_id", F.col("next").alias("node"), F.round(F.col("strength") * F.col("_s"), 9).alias("strength"), F.concat("path", F.array("next")).alias("path"))
        nxt = nxt.join(seen.select("set_id", "node"), ["set_id", "node"], "left_anti")
        best = nxt.groupBy("set_id", "node").agg(F.min(F.struct((-F.col("strength")).alias("s"), "path")).alias("b"))
        # Each hop is written once: the next hop and the set of visited nodes both read it.
        front = materialise(best.select("set_id", "node", F.lit(d).alias("depth"), (-F.col("b.s")).alias("strength"), F.col("b.path").alias("path")), "hop")
        seen = seen.unionByName(front)
    top = skew.top_k(seen, ["set_id"], [F.col("depth"), F.col("strength").desc(), F.col("node")], max_nodes, "rank")
    return top.withColumn("proximity", F.round(F.col("strength") / (1 + F.col("depth")), 9))


def traverse_memories(seeds: DataFrame, edges: DataFrame, mem: DataFrame, depth: int = 2, min_strength: float = 0.3, max_nodes: int = 64) -> DataFrame:
    steps = undirected(edges, min_strength).join(mem.filter("is_current").select(F.col("memory_id").alias("next")), "next", "left_semi")
    return traverse(seeds, steps.select("node", "next", "strength"), depth, max_nodes)


def evidence_edges(msg: DataFrame, phrase_nodes: tuple[int, int] = (2, 6), rare_nodes: tuple[int, int] = (2, 4)) -> DataFrame:
    """Weighted links between turns: shared bigram 25, shared rare long word 10, next turn of the session 8.

    Terms are counted first and only those of a few turns are gathered, so a group has at most six members.
    """
    phrase = F.transform(bigrams(F.col("text")), lambda b: F.struct(F.lit("phrase").alias("kind"), b.alias("term")))
    rare = F.transform(F.filter(X.word_set(F.col("text"), 6), lambda w: ~w.isin(L.PHRASE_STOP_WORDS)), lambda w: F.struct(F.lit("rare").alias("kind"), w.alias("term")))
    t = msg.select("message_id", F.explode(F.concat(phrase, rare)).alias("x")).select("message_id", "x.kind", "x.term")
    n = t.groupBy("kind", "term").agg(F.count("*").alias("n"))
    ok = ((F.col("kind") == "phrase") & F.col("n").between(*phrase_nodes)) | ((F.col("kind") == "rare") & F.col("n").between(*rare_nodes))
    g = t.join(n.filter(ok).select("kind", "term"), ["kind", "term"]).groupBy("kind", "term").agg(F.array_sort(F.collect_list("message_id")).alias("m"))
    pairs = F.flatten(F.transform("m", lambda a: F.transform(F.filter("m", lambda b: b > a), lambda b: F.struct(a.alias("src"), b.alias("dst")))))
    shared = g.select("kind", F.explode(pairs).alias("p")).select("p.src", "p.dst", "kind", F.when(F.col("kind") == "phrase", 25.0).otherwise(10.0).alias("weight"))
    nx = skew.neighbour(msg.select("conv_id", "turn", "message_id", F.expr("turn div 64").alias("b")), ["conv_id"], "b", ["turn"], ["message_id"], "next_", forward=True).filter("next_message_id is not null")
    adj = nx.select(F.col("message_id").alias("src"), F.col("next_message_id").alias("dst"), F.lit("adjacent").alias("kind"), F.lit(8.0).alias("weight"))
    return shared.unionByName(adj).groupBy("src", "dst", "kind").agg(F.sum("weight").alias("weight"))


def hop_boost(seeds: DataFrame, edges: DataFrame, k: int = 10) -> DataFrame:
    """Summed weight of edges from the seeds (query_id, node) to other nodes, best ``k`` per query."""
    both = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("target")), F.struct(F.col("dst").alias("node"), F.col("src").alias("target")))).alias("e"), "weight").select("e.*", "weight")
    b = seeds.join(both, "node").groupBy("query_id", "target").agg(F.sum("weight").alias("boost"))
    b = b.join(seeds.select("query_id", F.col("node").alias("target")), ["query_id", "target"], "left_anti")
    return skew.top_k(b, ["query_id"], [F.col("boost").desc(), F.col("target")], k)


def lineage_steps(edges: DataFrame) -> DataFrame:
    """Steps from a memory to what it came from: evidence sources, and both directions of supersession."""
    up = edges.filter("type in ('elaborates', 'summarizes', 'supersedes')").select(F.col("dst").alias("node"), F.col("src").alias("next"), "strength")
    down = edges.filter("type = 'supersedes'").select(F.col("src").alias("node"), F.col("dst").alias("next"), "strength")
    return up.unionByName(down).filter("node <> next").groupBy("node", "next").agg(F.max("strength").alias("strength"))


def lineage(ids: DataFrame, edges: DataFrame, mem: DataFrame, msg: DataFrame, depth: int = 3, max_nodes: int = 10) -> DataFrame:
    """Provenance chain of each memory with source conversation and its number of messages."""
    t = traverse(ids.select(F.col("memory_id").alias("set_id"), F.col("memory_id").alias("node")), lineage_steps(edges), depth, max_nodes)
    conv = msg.groupBy("conv_id").agg(F.count("*").alias("messages"))
    m = mem.select(F.col("memory_id").alias("node"), "resolution", "conv_id", "message_id").join(conv, "conv_id", "left")
    return t.join(m, "node").select(F.col("set_id").alias("memory_id"), "node", "depth", "resolution", "conv_id", "message_id", "messages")


def explain_memory(mem: DataFrame, lin: DataFrame, edges: DataFrame, heads: DataFrame, events: DataFrame, as_of) -> DataFrame:
    """Validity, lineage size, newest successor, contradictions and last event of each memory."""
    from engramlake.operators.temporal import is_valid

    l = lin.groupBy("memory_id").agg(F.count("*").alias("lineage_nodes"), F.max("depth").alias("lineage_depth"))
    c = edges.filter("type = 'contradicts'").select(F.explode(F.array("src", "dst")).alias("memory_id")).groupBy("memory_id").agg(F.count("*").alias("contradictions"))
    e = events.groupBy("memory_id").agg(F.count("*").alias("events"), F.max("created_at").alias("last_event"))
    j = mem.select("memory_id", "status", is_valid(X.as_ts(as_of)).alias("valid")).join(l, "memory_id", "left").join(heads.select("memory_id", F.col("head").alias("successor")), "memory_id", "left").join(c, "memory_id", "left").join(e, "memory_id", "left")
    return j.fillna(0, ["lineage_nodes", "lineage_depth", "contradictions", "events"])


DEPENDENCY_TYPES = ["causes", "follows", "elaborates", "summarizes"]


def dependents(ids: DataFrame, edges: DataFrame, depth: int = 3, cut: float = 0.1, decay: float = 0.8) -> DataFrame:
    """Transitive dependents (sources of edges into a node) with the greatest impact per node; a true depth bound."""
    dep = edges.filter(F.col("type").isin(DEPENDENCY_TYPES) & (F.col("src") != F.col("dst"))).groupBy(F.col("dst").alias("node"), F.col("src").alias("dependent")).agg(F.max("strength").alias("s"))
    front = ids.select(F.col("memory_id").alias("root"), F.col("memory_id").alias("node"), F.lit(1.0).alias("impact"))
    levels = []
    for _ in range(depth):
        n = front.join(dep, "node").select("root", F.col("dependent").alias("node"), F.round(F.col("impact") * F.col("s") * decay, 9).alias("impact")).filter((F.col("impact") > cut) & (F.col("node") != F.col("root")))
        front = n.groupBy("root", "node").agg(F.max("impact").alias("impact"))
        levels.append(front)
    return reduce(DataFrame.unionByName, levels).groupBy("root", "node").agg(F.max("impact").alias("impact"))


def impact(ids: DataFrame, dep: DataFrame, evidence: DataFrame, ops: dict[str, float] = {"modify": 1.0, "supersede": 0.5, "archive": 0.7}) -> DataFrame:
    """Cascade risk and advice per memory and operation; deleting always has full risk."""
    a = dep.groupBy(F.col("root").alias("memory_id")).agg(F.count("*").alias("affected"), F.count_if(F.col("impact") > 0.5).alias("high"))
    b = evidence.filter("polarity = 'supporting'").groupBy("memory_id").agg(F.count("*").alias("beliefs"))
    j = ids.select("memory_id").join(a, "memory_id", "left").join(b, "memory_id", "left").fillna(0, ["affected", "high", "beliefs"])
    base = F.least(F.lit(1.0), F.col("high") * 0.2 + F.col("affected") * 0.05)
    rows = F.array(*[F.struct(F.lit(o).alias("op"), (base * f).alias("risk")) for o, f in ops.items()], F.struct(F.lit("delete").alias("op"), F.lit(1.0).alias("risk")))
    r = j.select("memory_id", "affected", "beliefs", F.explode(rows).alias("r")).select("memory_id", "affected", "beliefs", "r.op", F.round("r.risk", 9).alias("cascade_risk"))
    risk = F.col("cascade_risk")
    return r.withColumn("recommendation", X.label((F.col("op") == "delete", "supersede or archive instead"), (risk > 0.7, "create a new version"), (risk > 0.4, "review dependents"), default="safe")).withColumn(
        "strategy", F.when(risk > 0.5, F.lit("supersede")).otherwise(F.lit("modify_in_place")))


def single_supports(edges: DataFrame) -> DataFrame:
    """Memories that are the only support of some dependents, with how many."""
    one = edges.filter(F.col("type").isin(DEPENDENCY_TYPES)).select("src", "dst").distinct().groupBy("src").agg(F.count("*").alias("n"), F.min("dst").alias("support")).filter("n = 1")
    return one.groupBy("support").agg(F.count("*").alias("sole_dependents"), F.min("src").alias("first_dependent"))


def propagate_invalidation(dep: DataFrame, mem: DataFrame, cut: float = 0.3) -> DataFrame:
    """Dependents hit hard enough by the invalidation of a root."""
    return dep.filter(F.col("impact") > cut).join(mem.select(F.col("memory_id").alias("node")), "node", "left_semi").select(F.col("root").alias("invalidated_by"), F.col("node").alias("memory_id"), "impact")


def graph_stats(edges: DataFrame) -> DataFrame:
    deg = edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("d"))
    return deg.agg(F.count("*").alias("nodes"), (F.sum("d") / 2).cast("long").alias("edges"), F.avg("d").alias("avg_degree"), F.max("d").alias("max_degree"))


ACTORS = "user assistant system me i you he she they we it general".split()


def retain_chains(q: DataFrame, top: DataFrame, f: DataFrame, k: int = 3, min_score: float = 5.0) -> DataFrame:
    """Bridging facts outside the top facts of each query (query_id, text; top: query_id, fact_id).

    Forward hop 12, backward hop 10, shared phrase 12, shared entity with a query word 8 or without 4,
    same session 2 on top of 8 or more.
    """
    t = top.select("query_id", "fact_id").join(f, "fact_id")
    ent = t.select("query_id", F.lower("entity").alias("term")).distinct().filter(~F.col("term").isin(ACTORS) & (F.length("term") > 1))
    val = t.select("query_id", F.lower("value").alias("term")).distinct().filter(F.length("term") > 2)
    phr = t.select("query_id", F.explode(bigrams(F.col("raw"))).alias("term")).distinct()
    fe = f.select("fact_id", F.lower("entity").alias("term"))
    fv = f.select("fact_id", F.lower("value").alias("term"))
    words = f.select("fact_id", F.explode(X.word_set(F.col("raw"))).alias("term"))
    fwd = val.join(fe, "term").select("query_id", "fact_id", F.lit("forward").alias("kind"))
    bwd = ent.join(fv, "term").select("query_id", "fact_id", F.lit("backward").alias("kind"))
    ph = phr.join(f.select("fact_id", F.explode(bigrams(F.col("raw"))).alias("term")), "term").select("query_id", "fact_id", F.lit("phrase").alias("kind"))
    sh = ent.join(words, "term").select("query_id", "fact_id", F.lit("shared").alias("kind"))
    qw = q.select("query_id", F.explode(X.word_set(F.col("text"), 3)).alias("term")).join(words, "term").select("query_id", "fact_id", F.lit("word").alias("kind"))
    g = reduce(DataFrame.unionByName, [fwd, bwd, ph, sh, qw]).groupBy("query_id", "fact_id").agg(*[F.bool_or(F.col("kind") == x).alias(x) for x in ("forward", "backward", "phrase", "shared", "word")])
    g = g.join(top.select("query_id", "fact_id"), ["query_id", "fact_id"], "left_anti").join(f.select("fact_id", "session"), "fact_id")
    s = (F.when(F.col("forward"), 12.0).otherwise(0.0) + F.when(F.col("backward"), 10.0).otherwise(0.0) + F.when(F.col("phrase"), 12.0).otherwise(0.0)
         + F.when(F.col("shared") & F.col("word"), 8.0).when(F.col("shared"), 4.0).otherwise(0.0))
    sess = t.select("query_id", "session").distinct().withColumn("_in", F.lit(True))
    g = g.withColumn("s", s).filter(F.col("s") >= min_score).join(sess, ["query_id", "session"], "left")
    g = g.withColumn("score", F.col("s") + F.when((F.col("s") >= 8) & F.col("_in"), 2.0).otherwise(0.0))
    return skew.top_k(g.select("query_id", "fact_id", "score"), ["query_id"], [F.col("score").desc(), F.col("fact_id")], k)


def expand_hops(pool: DataFrame, steps: DataFrame, text: DataFrame, referents: str, hops: int = 3, per_hop: int = 15) -> DataFrame:
    """Grow the pool of each query (query_id, node) by graph hops while it still holds unresolved referents.

    ``text`` is (node, raw); a query stops growing once none of its newest rows matches ``referents``.
    """
    seen = materialise(pool.select("query_id", "node", F.lit(0).alias("hop")), "hop")
    front = seen
    for h in range(1, hops + 1):
        open_q = front.join(text, "node").filter(F.col("raw").rlike(referents)).select("query_id").distinct()
        n = front.join(open_q, "query_id", "left_semi").join(steps, "node").groupBy("query_id", F.col("next").alias("node")).agg(F.max("strength").alias("s"))
        n = n.join(seen.select("query_id", "node"), ["query_id", "node"], "left_anti")
        front = materialise(skew.top_k(n, ["query_id"], [F.col("s").desc(), F.col("node")], per_hop).select("query_id", "node", F.lit(h).alias("hop")), "hop")
        seen = seen.unionByName(front)
    return seen
