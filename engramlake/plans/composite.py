"""Composite jobs built from the operators: compile, reconstruct evidence, dense context."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramlake.operators import compilation as C
from engramlake.operators import compression as Z
from engramlake.operators import evidence as V
from engramlake.operators import facts as E
from engramlake.operators import graph as J
from engramlake.operators import lifecycle as K
from engramlake.operators import recall as H
from engramlake.session import materialise


def compile_conversations(msg: DataFrame, lex: Z.CompressionLexicon = Z.CompressionLexicon()) -> tuple[DataFrame, DataFrame]:
    """Messages to memories and versions.  Narrow up to the content hash, the only shuffle."""
    c = C.memory_candidates(msg).withColumn("memory_id", F.col("message_id") * 10 + F.when(F.col("memory_type") == "decision", 1).when(F.col("memory_type") == "semantic", 2).otherwise(3))
    mem = C.lifecycle(C.dedup_content(c))
    return mem, Z.build_versions(mem)


def reconstruct(q: DataFrame, mem: DataFrame, edges: DataFrame, index: DataFrame, as_of, seeds: int = 4, k: int = 20) -> DataFrame:
    """Evidence package rows per query: BM25 seeds, graph expansion, evidence rank and an open-conflict flag."""
    top = materialise(H.top_scored(H.bm25(q, index), seeds).select(F.col("query_id").alias("set_id"), F.col("memory_id").alias("node")), "seeds")
    nodes = J.traverse_memories(top, edges, mem).select(F.col("set_id").alias("query_id"), F.col("node").alias("memory_id"), "depth", "proximity")
    ranked = materialise(V.rank_nodes(q, nodes, K.state_vector(mem, edges, as_of), k), "ranked-nodes")
    sides = F.array(F.struct(F.col("src").alias("memory_id"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("memory_id"), F.col("src").alias("other")))
    con = edges.filter("type = 'contradicts'").select(F.explode(sides).alias("s")).select("s.*").distinct()
    ids = ranked.select("query_id", "memory_id")
    inside = ids.join(con, "memory_id").join(ids.withColumnRenamed("memory_id", "other"), ["query_id", "other"], "left_semi").select("query_id", "memory_id").distinct().withColumn("_c", F.lit(True))
    return ranked.join(inside, ["query_id", "memory_id"], "left").select("query_id", "memory_id", "rank", "depth", "score", F.coalesce("_c", F.lit(False)).alias("in_conflict"))


def dense_context(q: DataFrame, turns: DataFrame, word_budget: int = 200, mutable=E.MUTABLE) -> DataFrame:
    """Slice, extract facts, deduplicate, supersede, rank, retain chains and render, for a batch of questions.

    ``mutable``: properties whose newest value supersedes the others.
    """
    f = E.supersede_facts(E.dedup_facts(E.extract_facts(turns)), mutable)
    f = materialise(f.join(turns.select(F.col("message_id").alias("fact_id"), F.col("conv_id").alias("session")), "fact_id"), "turn-facts")
    pool = V.wide_slice(q, turns).select("query_id", F.col("message_id").alias("fact_id"))
    kept = pool.join(f.select("fact_id"), "fact_id", "left_semi")
    ranked = V.rank_evidence(q, turns, 60).select("query_id", F.col("message_id").alias("fact_id"), "rank").join(kept, ["query_id", "fact_id"], "left_semi")
    first = materialise(ranked.filter("rank <= 10"), "first-facts")
    chains = J.retain_chains(q, first.select("query_id", "fact_id"), f).select("query_id", "fact_id", (F.col("rank") + 100).alias("rank"))
    return E.render_tiered(first.unionByName(chains), f, word_budget)
