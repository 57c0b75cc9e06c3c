"""Near-duplicate documents: SuperMinHash signatures, banding, exact verification and union-find grouping.

A document's set holds its distinct 5-word shingles as 64-bit hashes (ASCII letters lower-cased; fewer words: the whole
sequence as one). SuperMinHash gives each element one rank and one slot per level from a seeded partial permutation;
a slot keeps the least rank + level, and levels stop as soon as no later level can lower any slot. Signatures of 125
slots are cut into 25 bands of 5: two sets of Jaccard 0.85 share no band with a probability of about 4e-7, two of
Jaccard 0.8 with about 5e-5. The limit of a link is an argument, 85 % by default.

Plan. Equal sets collapse to their smallest id first, so copies are never paired. Within a band bucket every member is
verified against one pivot, the member that meets most others in its buckets. Links are grouped; afterwards a pair of
one bucket can only still matter if its components differ and one of them is not the pivot's. Those pairs are formed
through size classes, and only where an exact bound allows a link: shingles that no other candidate has cannot be
shared, and the shared ones are split into those inside and outside the pivot's set. So a bucket of thousands of copies
costs one verification per member, and no link between different texts is lost by this pruning. Links are confirmed on the full sets. Grouping first runs union-find inside each partition, which leaves a
forest, then alternates large-star and small-star steps over the remaining links, cut by reliable checkpoints.

Defined cases: null or blank texts have no set and stay alone; a null id links with nothing and is kept; rows that repeat
an id keep one row each, grouped by their own texts; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramlake.llm.common import aside, restored, ship
from engramlake.session import cut_lineage, materialise

SHINGLE, BANDS, ROWS, PERCENT = 5, 25, 5, 85
SLOTS = BANDS * ROWS
_ODD1, _ODD2, _ODD3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _ODD2
    x = (x ^ (x >> np.uint64(27))) * _ODD3
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the 5-word shingles of a whole text."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(SHINGLE, len(h))
    s = np.zeros(len(h) - size + 1, np.uint64)
    for k in range(size):
        s = (s ^ h[k : len(h) - size + 1 + k]) * _ODD1 + np.uint64(k + 1)
        s ^= s >> np.uint64(29)
    return np.unique(_mix(s + np.uint64(size)))


def super_minhash(elements: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash signature: per slot the least rank + level over all elements, computed level by level."""
    low = np.full(slots, np.inf)
    perm, rows = None, np.arange(len(elements))
    for level in range(slots):
        bits = _mix(elements + np.uint64((level + 1) * int(_ODD1) % 2**64))
        rank = (bits >> np.uint64(11)).astype(np.float64) * 2.0**-53
        pick = level + (_mix(bits + _ODD3) % np.uint64(slots - level)).astype(np.int64)
        if level == 0:
            slot = pick
        else:
            if perm is None:
                perm = np.tile(np.arange(slots, dtype=np.int16), (len(elements), 1))
                perm[rows, first], perm[rows, 0] = 0, first
            slot = perm[rows, pick]
            perm[rows, pick] = perm[rows, level]
            perm[rows, level] = slot
        np.minimum.at(low, slot, rank + level)
        first = pick if level == 0 else first
        if low.max() < level + 1:
            break
    return low


def band_keys(signature: np.ndarray) -> list[int]:
    import xxhash

    raw = signature.tobytes()
    step = ROWS * 8
    return [xxhash.xxh3_64_intdigest(raw[b * step : (b + 1) * step], seed=b) - 2**63 for b in range(BANDS)]


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, digest of the set and its band keys (null without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            n, digest, keys = [], [], []
            for t in b.column(1):
                s = shingles(t.as_py())
                n.append(len(s))
                digest.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                keys.append(band_keys(super_minhash(s)) if len(s) else None)
            yield pa.record_batch([b.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "digest", "keys"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_shingles long, digest binary, keys array<long>")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """node, n, items of every text with words; the node is named after the digest of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            sets = [x for t in b.column(0) if len(x := shingles(t.as_py()))]
            yield pa.record_batch([pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in sets], pa.binary()), pa.array([len(x) for x in sets], pa.int64()), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], names=["digest", "n", "items"])

    return docs.select("text").mapInArrow(run, "digest binary, n long, items array<long>").select(F.xxhash64("digest").alias("node"), "n", "items")


def local_forest(links: DataFrame) -> DataFrame:
    """Union-find inside each partition: the same connections with at most one link per node and partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while (p := up.setdefault(x, x)) != x:
                up[x] = up[p]
                x = p
            return x

        for b in batches:
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x, y = root(x), root(y)
                if x != y:
                    up[max(x, y)] = min(x, y)
        pairs = [(x, r) for x in up if (r := root(x)) != x]
        for i in range(0, len(pairs), 50_000):
            a, c = zip(*pairs[i : i + 50_000], strict=True)
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(c, pa.int64())], names=["a", "b"])

    return links.select("a", "b").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node, component (smallest node reachable, itself included) of every node that has a link in ``links`` (a, b)."""
    state, last = cut_lineage(local_forest(links).distinct()), None
    while True:
        mark = state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == last:
            break
        last = mark
        # Large star: the larger neighbours of a node get its least neighbour (or itself).
        both = state.union(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        # Small star: a node and its smaller neighbours get the least of them.
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        state = cut_lineage(large.join(small, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b"))).distinct())
    both = state.select(F.col("a").alias("node"), F.col("b").alias("component")).union(state.select("b", "b"))
    return both.groupBy("node").agg(F.min("component").alias("component"))


def _fits(n1: str, v1: str, n2: str, v2: str, percent: int) -> str:
    """A link is still possible: intersections are at most the shared shingles of either side."""
    return f"(100 + {percent}) * least({v1}, {v2}) >= {percent} * ({n1} + {n2})"


def overlaps(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """a, b, both (size of the intersection of the full sets) and whether that links them."""
    left = sets.select(F.col("node").alias("a"), F.col("items").alias("ai"))
    right = sets.select(F.col("node").alias("b"), F.col("items").alias("bi"))
    found = pairs.join(left, "a").join(right, "b").select("a", "b", F.size(F.array_intersect("ai", "bi")).alias("both"), (F.size("ai") + F.size("bi")).alias("all"))
    return found.select("a", "b", "both", (100 * F.col("both") >= percent * (F.col("all") - F.col("both"))).alias("linked"))


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document; sets that share ``percent`` of their union are linked."""
    ship(docs.sparkSession)
    sig = materialise(signatures(docs).withColumn("node", F.xxhash64("digest")), "nd-signatures")
    reps = sig.filter("digest is not null and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("keys").alias("keys"))
    reps = materialise(reps, "nd-sets")
    banded = reps.select("node", F.posexplode("keys").alias("band", "key"))
    buckets = banded.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    met = materialise(banded.join(buckets, "key"), "nd-buckets")
    nodes = met.groupBy("node").agg(F.sum("size").alias("meets"))
    # The ids to fetch grow with the input, so they are never broadcast: one shuffle of the texts, at every size.
    wanted = reps.join(nodes, "node", "left_semi").select(F.col("rep").alias("doc_id")).distinct().hint("merge")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sets = materialise(shingle_sets(texts.join(wanted, "doc_id", "left_semi")), "nd-items")
    own = sets.select("node", F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("c"), F.min("node").alias("node")).filter("c = 1")
    own = own.groupBy("node").agg(F.count("*").alias("own"))
    facts = sets.groupBy("node").agg(F.max("n").alias("n")).join(own, "node", "left").join(nodes, "node").select("node", "n", (F.col("n") - F.coalesce("own", F.lit(0))).alias("v"), "meets")
    members = materialise(met.join(facts, "node"), "nd-members")
    pivots = members.groupBy("key").agg(F.max(F.struct("meets", "node", "n", "v")).alias("p")).select("key", F.col("p.node").alias("pivot"), F.col("p.n").alias("pn"), F.col("p.v").alias("pv"))
    star = members.join(pivots, "key").filter("node <> pivot").filter(F.expr(_fits("n", "v", "pn", "pv", percent)) | (F.col("size") > 2))
    star = materialise(overlaps(star.select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct(), sets, percent).distinct(), "nd-star")
    links = star.filter("linked").select("a", "b")
    first = components(links)

    # What the pivots leave open: pairs of one bucket in different components, one of them outside the pivot's. What two
    # members share lies inside the pivot's set (at most the lesser overlap with it) or outside (at most the lesser
    # number of further shared shingles). A pair that meets in several buckets is formed in the first of them only.
    ratio = F.log(F.lit(1.02))
    label = members.filter("size > 2").join(pivots.select("key", "pivot"), "key").filter("node <> pivot")
    label = label.join(star.select(F.col("a").alias("node"), F.col("b").alias("pivot"), F.col("both").alias("ip")), ["node", "pivot"])
    label = label.join(first, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")
    label = label.join(first.select(F.col("node").alias("pivot"), F.col("component").alias("centre")), "pivot", "left").withColumn("centre", F.coalesce("centre", "pivot"))
    label = label.join(reps.select("node", "keys"), "node").withColumn("earlier", F.slice("keys", F.lit(1), F.col("band")))
    label = materialise(label.select("key", "earlier", "node", "n", "v", "ip", (F.col("v") - F.col("ip")).alias("o"), "comp", "centre", F.floor(F.log("n") / ratio).alias("cls")), "nd-labels")
    lo, hi = F.ceil(F.lit(percent / 100) * F.col("n") - 1e-6), F.floor((100 + percent) / percent * F.col("v") - F.col("n") + 1e-6)
    side = lambda df, x: df.select("key", "cls", *[F.col(c).alias(x + c) for c in ("node", "n", "ip", "o", "comp", "earlier")])
    outer = label.filter("comp <> centre").withColumn("lo", lo).withColumn("hi", hi).filter("hi >= lo")
    outer = side(outer.withColumn("cls", F.explode(F.sequence(F.floor(F.log("lo") / ratio), F.floor(F.log("hi") / ratio)))), "a")
    fits = f"(100 + {percent}) * (least(aip, bip) + least(ao, bo)) >= {percent} * (an + bn)"
    rest = outer.join(side(label, "b"), ["key", "cls"]).filter("acomp <> bcomp").filter(fits).filter("not arrays_overlap(aearlier, bearlier)").select(F.least("anode", "bnode").alias("a"), F.greatest("anode", "bnode").alias("b")).distinct()
    comp = components(links.union(overlaps(rest, sets, percent).filter("linked").select("a", "b")))

    least = comp.join(reps.select("node", "rep"), "node")
    least = least.join(least.groupBy("component").agg(F.min("rep").alias("smallest")), "component").select("node", "smallest")
    out = sig.join(reps.select("node", "rep").join(least, "node", "left"), "node", "left")
    group = F.when(F.col("doc_id").isNull(), F.lit(None)).when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.coalesce("smallest", "rep")).cast("long")
    return out.select("doc_id", "n_shingles", group.alias("component_id"), F.coalesce(F.col("doc_id") == group, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Documents without all but the smallest id of each group; of rows that repeat a kept id and its text one stays.

    Different texts under one kept id all stay.  Other columns stay as they are whatever their names.
    """
    found = near_duplicates(docs, percent).filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("nd_rows"), F.bool_or("kept").alias("nd_kept")).filter("nd_rows > 1 or not nd_kept")
    flags = materialise(found.select(F.col("doc_id").alias("nd_id"), "nd_rows", "nd_kept"), "nd-flags")
    rows, names = aside(docs, ["doc_id", "text"])
    marked = rows.join(flags, F.col("doc_id") == F.col("nd_id"), "left").filter("nd_kept is null or nd_kept")
    once = marked.filter("nd_rows is null or nd_rows = 1")
    again = marked.filter("nd_rows > 1").dropDuplicates(["doc_id", "text"])
    return once.union(again).select(*restored(names))
