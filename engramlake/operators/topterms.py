"""Exact top-k over shared terms that does not form the pairs of frequent terms.

Postings are kept in blocks: the rows of a term whose static values (``levels``) agree, at most ``WIDTH`` of them. A few
blocks of the terms of a query give first rows; their exact scores give the score that a row has to reach. A row
whose rarest shared term is t can score no more than t and all terms more frequent than t together with what its levels
allow, so a block of t is opened only if that bound reaches the score. Frequent terms therefore add to the scores of rows
found through rarer ones, but are not looked up themselves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engramlake.operators import skew
from engramlake.session import materialise

#: Row ids that fall into one block (its greatest length), and blocks of a query that give its first rows.
WIDTH, FIRST_BLOCKS = 128, 256
#: Scores are rounded; bounds get this much for it.
SLACK = 1e-6
#: Questions up to which rows are told apart by all that these questions read of them (``few_rows``).
FEW_QUESTIONS = 64
#: Rows left by ``few_rows`` up to which each is scored for each of these questions; more are looked up in blocks.
FEW_ROWS = 100_000


def term_blocks(rows: DataFrame, id_: str, keys: Column, levels: dict[str, Column] | None = None) -> DataFrame:
    """key, the levels, slot, rows (ids), n of a table with an array of keys per row.  Write it once per corpus.

    A level is a static value of a row that a bound reads; it should take few values.
    """
    e = rows.select(F.col(id_).alias("id"), *[c.alias(n) for n, c in (levels or {}).items()], F.explode(F.array_distinct(keys)).alias("key"))
    by = ["key", *(levels or {}), F.floor(F.col("id") / WIDTH).alias("slot")]
    return e.groupBy(*by).agg(F.collect_list("id").alias("rows"), F.count("*").alias("n"))


def _until(blocks: DataFrame, keys: list[str], order: list[Column], rows: int) -> DataFrame:
    """The first blocks of each key until they hold ``rows`` rows; of few blocks a key."""
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumn("_rows", F.coalesce(F.sum("n").over(before), F.lit(0))).filter(F.col("_rows") < rows).drop("_rows")


def candidates(units: DataFrame, blocks: DataFrame, bound: Column, exact: Callable[[DataFrame], DataFrame], k: int) -> DataFrame:
    """Pairs (query_id, id) that hold the ``k`` best rows of every query, and as few others as the bounds allow.

    ``units``: query_id, unit, key, most and query columns; a unit counts once whichever of its keys a row has, and adds
    at most ``most``. ``bound`` is the greatest score by the columns reach (sum of ``most`` of the unit and all more
    frequent ones), matched (their number), the levels of the block and the query columns. ``exact`` scores pairs
    (query_id, id): it returns query_id, id, score.
    """
    units = units.distinct()
    few = units.count()
    small = lambda df: skew.broadcast_within(df, few)
    seen = blocks.join(small(units.select("key").distinct()), "key", "left_semi")
    size = materialise(seen.groupBy("key").agg(F.sum("n").alias("df")), "top-keys")
    held = units.join(size, "key")
    one = held.groupBy("query_id", "unit").agg(F.max("most").alias("most"), F.sum("df").alias("df"))
    frequent = Window.partitionBy("query_id").orderBy(F.desc("df"), "unit").rowsBetween(Window.unboundedPreceding, 0)
    # A window over the terms of one query, whose number its text fixes.
    one = one.select("query_id", "unit", F.sum("most").over(frequent).alias("reach"), F.count("*").over(frequent).alias("matched"))
    # First rows: of every term some blocks, rare terms first and those whose levels allow most, as if their rows had all terms.
    levels = [c for c in blocks.columns if c not in ("key", "slot", "rows", "n")]
    lead = _until(skew.top_k(seen, ["key", *levels], [F.col("slot")], 64, "_b"), ["key", *levels], [F.col("slot")], max(WIDTH, 4 * k))
    whole = one.groupBy("query_id").agg(F.max("reach").alias("reach"), F.max("matched").alias("matched"))
    open_first = held.join(whole, "query_id").join(lead, "key").withColumn("_s", bound)
    order = [F.desc("_s"), F.col("df"), F.col("key"), F.col("slot")]
    first = skew.top_k(open_first.select("query_id", "key", "df", "slot", "rows", "n", "_s"), ["query_id"], order, FIRST_BLOCKS, "_b")
    first = materialise(_until(first, ["query_id"], [F.col("_b")], max(32 * WIDTH, 8 * k)).select("query_id", F.explode("rows").alias("id")).distinct(), "top-first")
    best = skew.top_k(exact(first).select("query_id", "id", "score"), ["query_id"], [F.desc("score"), F.col("id")], k, "_r")
    need = best.groupBy("query_id").agg(F.count("*").alias("_n"), F.min("score").alias("need")).filter(F.col("_n") == k).select("query_id", "need")
    probe = units.join(one.select("query_id", "unit", "reach", "matched"), ["query_id", "unit"]).join(need, "query_id", "left")
    open_ = F.col("need").isNull() | (bound + SLACK >= F.col("need"))
    return seen.join(small(probe), "key").filter(open_).select("query_id", F.explode("rows").alias("id"))


def few_rows(rows: DataFrame, id_: str, traits: list[Column], k: int, order: list[Column] | None = None) -> DataFrame:
    """The rows that can be among the ``k`` best of a question, written once.

    ``traits`` are all that a score reads of a row, so rows that agree in them score alike, and of these only the first
    ``k`` by ``order`` (by id) can be among the best. Every task keeps ``k`` rows of a kind before anything is shuffled.
    """
    names = [f"_trait{i}" for i in range(len(traits))]
    t = rows.withColumns(dict(zip(names, traits, strict=True)))
    ids = materialise(skew.top_k(t, names, order or [F.col(id_)], k, "_r").select(id_), "kinds")
    return materialise(rows.join(skew.broadcast_within(ids, ids.count()), id_, "left_semi"), "few-rows")


def best_of_few(q: DataFrame, rows: DataFrame, id_: str, exact: Callable[[DataFrame], DataFrame], k: int) -> DataFrame | None:
    """``best_rows`` of few questions and few rows, each scored for each; None where either are many."""
    if len(q.select("query_id").head(FEW_QUESTIONS + 1)) > FEW_QUESTIONS or rows.select(id_).limit(FEW_ROWS + 1).count() > FEW_ROWS:
        return None
    pairs = F.broadcast(q.select("query_id").distinct()).crossJoin(rows.select(F.col(id_).alias("id")))
    return skew.top_k(exact(materialise(pairs, "few-pairs")), ["query_id"], [F.desc("score"), F.col("id")], k)


def wanted(rows: DataFrame, pairs: DataFrame, id_: str) -> DataFrame:
    """Rows of the ids in ``pairs``: what a score needs of a row is worked out for these alone."""
    return rows.join(pairs.select(F.col("id").alias(id_)).distinct(), id_, "left_semi")


def best_rows(units: DataFrame, blocks: DataFrame, bound: Column, exact: Callable[[DataFrame], DataFrame], k: int) -> DataFrame:
    """The ``k`` best rows of every query by ``exact``, with all its columns and their rank; ties by id."""
    pairs = materialise(candidates(units, blocks, bound, exact, k).distinct(), "top-pairs")
    return skew.top_k(exact(pairs), ["query_id"], [F.desc("score"), F.col("id")], k)
