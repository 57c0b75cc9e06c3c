"""Mixing sources to target weights by Poisson replication.

The volume of each source (characters, at least one per document) is summed over all documents. A source whose target
share of the total volume is ``w`` gets the mean repetition rate ``w * total / volume``. Each document draws a uniform
number from a digest of seed and id and inverts the Poisson distribution of its source's rate, so the draw does not
depend on partitions, order or retries. Rows are exploded by their count and sorted globally by a digest of seed, id
and copy number, which is a uniform shuffle of the whole output.

Target weights default to ``volume ** temperature``. One row per source is aggregated map-side first, so a source that
holds a third of the rows is no hot key; the table of sources is broadcast only after its rows were counted.

Defined cases: a null source is a source of its own; a null text has volume 1; a null id draws as one id; repeated rows
draw alike; sources absent from given weights have weight 0; an empty table gives no rows. Columns that clash with
the added ``mix_`` names are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from engramlake.session import materialise

SEED, TEMPERATURE, EPOCHS = "mix-1", 0.5, 1.0
#: Sources that may be broadcast; a table of more is joined by shuffle.
BROADCAST_SOURCES = 20_000


def uniform(seed: str, *parts: Column) -> Column:
    """Number in [0, 1) from the first 52 bits of a digest."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), *parts)), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def _id() -> Column:
    return F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = TEMPERATURE, epochs: float = EPOCHS) -> DataFrame:
    """One row per source: mix_source, volume, weight, mix_rate."""
    src = F.coalesce(F.col("source"), F.lit(""))
    vol = docs.groupBy(src.alias("mix_source")).agg(F.sum(F.greatest(F.coalesce(F.length("text"), F.lit(0)), F.lit(1))).cast("long").alias("volume"))
    if weights is None:
        raw = F.pow(F.col("volume").cast("double"), F.lit(float(temperature)))
    else:
        raw = F.lit(0.0)
        for name, w in weights.items():
            raw = F.when(F.col("mix_source") == name, float(w)).otherwise(raw)
    vol = vol.withColumn("raw", raw)
    total = vol.agg(F.sum("volume").cast("double").alias("all_volume"), F.sum("raw").alias("all_raw"))
    return vol.crossJoin(F.broadcast(total)).select(
        "mix_source", "volume", (F.col("raw") / F.col("all_raw")).alias("weight"),
        (F.lit(float(epochs)) * F.col("raw") / F.col("all_raw") * F.col("all_volume") / F.col("volume")).alias("mix_rate"),
    )


def poisson_cdf(rates: DataFrame) -> DataFrame:
    """Adds mix_cdf: the distribution function of Poisson(mix_rate) at 0, 1, 2, ... until its tail is negligible."""
    top = F.ceil(F.col("mix_rate") + 12 * F.sqrt("mix_rate") + 30).cast("int")
    steps = rates.filter(F.col("mix_rate") > 0).select("mix_source", "mix_rate", F.explode(F.sequence(F.lit(0), top)).alias("k"))
    w = Window.partitionBy("mix_source").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    log_p = F.col("k") * F.log("mix_rate") - F.col("mix_rate") - F.sum(F.log(F.greatest(F.col("k"), F.lit(1)).cast("double"))).over(w)
    cdf = steps.withColumn("p", F.exp(log_p)).withColumn("c", F.sum("p").over(w))
    return cdf.groupBy("mix_source", "mix_rate").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "c"))), lambda x: x["c"]).alias("mix_cdf"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = TEMPERATURE, epochs: float = EPOCHS, seed: str = SEED) -> DataFrame:
    """Every copy of every drawn document in a global random order, with mix_rate, mix_copies, mix_copy and mix_key."""
    docs = docs.drop("mix_source", "mix_rate", "mix_cdf", "mix_copies", "mix_copy", "mix_key")
    rates = materialise(poisson_cdf(source_rates(docs, weights, temperature, epochs)), "mix-rates")
    few = rates.count() <= BROADCAST_SOURCES
    out = docs.withColumn("mix_source", F.coalesce(F.col("source"), F.lit(""))).join(F.broadcast(rates) if few else rates, "mix_source")
    u = uniform(seed, _id())
    out = out.withColumn("mix_u", u).withColumn("mix_copies", F.size(F.filter("mix_cdf", lambda c: c <= F.col("mix_u"))))
    out = out.drop("mix_source", "mix_cdf", "mix_u").filter("mix_copies > 0").withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_copies"))))
    key = F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), _id(), F.col("mix_copy").cast("string"))), 1, 16)
    return out.withColumn("mix_key", key).orderBy("mix_key", "doc_id", "mix_copy")


def mix_sql(relation: str, temperature: float = TEMPERATURE, epochs: float = EPOCHS, seed: str = SEED) -> str:
    """The same rows in SQL (doc_id, source, mix_rate, mix_copies, mix_copy, mix_key)."""
    return f"""
    WITH vol AS (SELECT coalesce(source, '') AS s, CAST(sum(greatest(coalesce(length(text), 0), 1)) AS BIGINT) AS volume FROM {relation} GROUP BY 1),
    tot AS (SELECT CAST(sum(volume) AS DOUBLE) AS av, sum(pow(CAST(volume AS DOUBLE), {temperature}e0)) AS ar FROM vol),
    rates AS (SELECT s, {epochs}e0 * pow(CAST(volume AS DOUBLE), {temperature}e0) / ar * av / volume AS rate FROM vol, tot),
    steps AS (SELECT s, rate, unnest(range(0, CAST(ceil(rate + 12 * sqrt(rate) + 30) AS BIGINT) + 1)) AS k FROM rates),
    prob AS (SELECT s, rate, k, exp(k * ln(rate) - rate - sum(ln(CAST(greatest(k, 1) AS DOUBLE))) OVER (PARTITION BY s ORDER BY k)) AS p FROM steps),
    cdf AS (SELECT s, rate, k, sum(p) OVER (PARTITION BY s ORDER BY k) AS c FROM prob),
    d AS (SELECT doc_id, source, coalesce(source, '') AS s, CAST('0x' || substr(md5('{seed}:' || doc_id), 1, 13) AS BIGINT) / CAST(4503599627370496 AS DOUBLE) AS u FROM {relation}),
    n AS (SELECT d.doc_id, d.source, cdf.rate AS mix_rate, CAST(count(*) FILTER (cdf.c <= d.u) AS INTEGER) AS mix_copies FROM d JOIN cdf USING (s) GROUP BY ALL),
    e AS (SELECT *, CAST(unnest(range(1, mix_copies + 1)) AS INTEGER) AS mix_copy FROM n)
    SELECT doc_id, source, mix_rate, mix_copies, mix_copy, substr(md5('{seed}:order:' || doc_id || ':' || mix_copy), 1, 16) AS mix_key FROM e"""
