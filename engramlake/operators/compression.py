"""Multi-resolution compression of text columns.

A text is one row, so sentence ranking and selection use array functions inside the row: the whole
family is a narrow pass over the table and shuffles nothing.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engramlake.functions import lexicons as L
from engramlake.functions import text as X

METHODS = ["light", "episode", "semantic", "long_term", "deep_long_term"]


@dataclass(frozen=True)
class CompressionLexicon:
    filler: str = L.COMPRESS_FILLER
    markers: list = field(default_factory=lambda: L.COMPRESS_MARKERS)
    decision: list = field(default_factory=lambda: L.COMPRESS_DECISION)
    reason: list = field(default_factory=lambda: L.COMPRESS_REASON)


def sentence_score(s: Column, lex: CompressionLexicon, low: Column | None = None) -> Column:
    """Importance of a sentence; ``low`` is its lower-case form where that is at hand."""
    score = F.lit(0.5)
    low = F.lower(s) if low is None else low
    for group in lex.markers:
        score = score + F.when(X.contains_any(low, group), 0.2).otherwise(0.0)
    score = score + F.least(F.length(s) / 200.0, F.lit(0.3))
    score = score + F.when(s.contains("?") | s.contains("？"), 0.15).otherwise(0.0)
    score = score + F.when(X.contains_any(s, lex.decision), 0.25).otherwise(0.0)
    return F.round(F.least(score, F.lit(1.0)), 9)


def sentences(df: DataFrame, lex: CompressionLexicon = CompressionLexicon(), key: str = "memory_id", text: str = "content") -> DataFrame:
    """Sentence table with position and importance."""
    s = df.select(key, F.posexplode(X.sentence_list(F.col(text))).alias("pos", "sentence"))
    return s.select(key, F.col("pos").cast("long").alias("pos"), "sentence", sentence_score(F.col("sentence"), lex).alias("importance"))


def remove_fillers(text: Column, lex: CompressionLexicon) -> Column:
    out = F.regexp_replace(text, f"(?i){lex.filler}", "")
    out = F.regexp_replace(out, r"\s+", " ")
    return X.strip(F.regexp_replace(out, r"\s*([、。．，！？])\s*", "$1 "))


def _drop_repeats(s: Column) -> Column:
    return F.filter(s, lambda x, i: (i == 0) | (x != F.get(s, i - 1)))


def compress_light(df: DataFrame, lex: CompressionLexicon = CompressionLexicon(), text: str = "content") -> DataFrame:
    """Fillers out, white space tidied, consecutive equal sentences dropped."""
    tidy = df.withColumn("_s", X.sentence_list(remove_fillers(F.col(text), lex)))
    kept = _drop_repeats(F.col("_s"))
    return tidy.withColumn("light", F.array_join(kept, " ")).withColumn("sentences_removed", (F.size("_s") - F.size(kept)).cast("long")).drop("_s")


def _heading(title: str, items: Column) -> Column:
    return F.when(F.size(items) > 0, F.concat(F.lit(title), F.array_join(items, "\n")))


def _once(value: Column) -> Column:
    """A column of its own that no expression above computes again, as it would inside a lambda for every element."""
    return F.explode(F.array(value))


def compress_all(df: DataFrame, lex: CompressionLexicon = CompressionLexicon(), text: str = "content") -> DataFrame:
    """All compressed forms of each row from one split and one scoring of its sentences."""
    def read(x: Column, i: Column) -> Column:
        marks = lambda low: F.struct((-sentence_score(x, lex, low)).alias("neg"), i.alias("pos"), x.alias("s"), X.contains_any(low, lex.decision).alias("d"), X.contains_any(low, lex.reason).alias("r"))
        return F.transform(F.array(F.lower(x)), marks)[0]

    d = compress_light(df, lex, text).withColumn("_x", _once(F.transform(X.sentence_list(F.col(text)), read)))
    d = d.withColumn("_r", _once(F.array_sort("_x")))
    x, s, r = F.col("_x"), F.col("_x")["s"], F.col("_r")
    d = d.withColumn("_k", _once(F.slice(r, F.lit(1), F.greatest(F.lit(3), F.floor(F.size(r) * 0.4).cast("int")))["s"]))
    d = d.withColumn("_e", _once(F.filter(s, lambda y: F.array_contains(F.col("_k"), y))))
    reasoned = lambda y: ~y["d"] & y["r"]
    dec = F.slice(F.filter(x, lambda y: y["d"])["s"], 1, 3)
    rea = F.slice(F.filter(x, reasoned)["s"], 1, 3)
    oth = F.slice(F.filter(x, lambda y: ~y["d"] & ~y["r"] & (y["neg"] < -0.7))["s"], 1, 2)
    semantic = F.array_join(F.array_compact(F.array(_heading("**decisions:**\n", dec), _heading("\n**reasons:**\n", rea), _heading("\n**key points:**\n", oth))), "\n")
    best = F.filter(F.slice(r, 1, 2), lambda y: y["neg"] < -0.6)["s"]
    ends = F.when(F.size(s) > 1, F.array(F.get(s, F.lit(0)), F.element_at(s, -1))).otherwise(s)
    long_term = F.array_join(F.when(F.size(best) > 0, best).otherwise(ends), " ")
    return (
        d.withColumn("episode", F.array_join("_e", " "))
        .withColumn("semantic", semantic)
        .withColumn("long_term", long_term)
        .withColumn("sentences_total", F.size(x).cast("long"))
        .withColumn("sentences_kept", F.size("_e").cast("long"))
        .withColumn("decisions_found", F.size(F.filter(x, lambda y: y["d"])).cast("long"))
        .withColumn("reasons_found", F.size(F.filter(x, reasoned)).cast("long"))
        .drop("_x", "_r", "_k", "_e")
    )


#: What the rules of ``validate_versions`` read of an original, by name of the column.
OF_ORIGINAL = {
    "original_words": lambda o: F.array_distinct(F.split(F.lower(o), r"\s+")),
    "original_names": lambda o: F.transform(X.entity_set(o), lambda e: F.struct(e.alias("e"), F.lower(e).alias("low"))),
    "original_keys": lambda o: F.transform(F.array(F.lower(o)), lambda low: F.filter(F.array(*[F.lit(w) for w in L.VALIDATION_DECISION]), lambda w: low.contains(w)))[0],
}


def build_versions(mem: DataFrame, lex: CompressionLexicon = CompressionLexicon(), policy_version: str = "1", algorithm_version: str = "1", rules: bool = False) -> DataFrame:
    """One row per resolution below the memory's own, with token counts, ratio and method; a single narrow pass.

    With ``rules`` also what ``validate_versions`` reads of the original, worked out once for all versions of a memory.
    """
    c = compress_all(mem.filter("resolution < 4"), lex)
    of = {n: fn(F.col("content")) for n, fn in OF_ORIGINAL.items()} if rules else {}
    c = c.select("*", *[v.alias(n) for n, v in of.items()])
    forms = [(1, "light", "light"), (2, "episode", "episode"), (3, "semantic", "semantic"), (4, "long_term", "long_term"), (5, "deep_long_term", "long_term")]
    fan = F.array(*[F.struct(F.lit(r).alias("resolution"), F.lit(m).alias("method"), F.col(src).alias("content")) for r, m, src in forms])
    v = c.select("memory_id", F.col("resolution").alias("own"), F.col("memory_type"), F.col("content").alias("original"), *of, F.explode(fan).alias("v"))
    v = v.filter(F.col("v.resolution") > F.col("own"))
    orig, comp = X.token_estimate(F.col("original")), X.token_estimate(F.col("v.content"))
    return v.select(
        "memory_id", F.col("own").alias("own_resolution"), "memory_type", "original", "v.resolution", "v.method", "v.content",
        orig.alias("original_tokens"), comp.alias("compressed_tokens"), (orig / comp).alias("ratio"),
        F.lit(policy_version).alias("policy_version"), F.lit(algorithm_version).alias("algorithm_version"), *of,
    )


def compression_stats(versions: DataFrame, by: list[str] = ["method"]) -> DataFrame:
    return versions.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg("ratio").alias("avg_ratio"),
        F.sum("original_tokens").alias("original_tokens"),
        F.sum("compressed_tokens").alias("compressed_tokens"),
        ((1 - F.sum("compressed_tokens") / F.sum("original_tokens")) * 100).alias("reduction_pct"),
    )


def _three(score: Column, ok: float, warn: float) -> Column:
    return X.label((score >= ok, "passed"), (score >= warn, "warning"), default="failed")


def validate_versions(ver: DataFrame) -> DataFrame:
    """Rule outcomes of every version as one row per rule, computed inside the row of the version."""
    ver = ver.withColumns({n: fn(F.col("original")) for n, fn in OF_ORIGINAL.items() if n not in ver.columns})
    # Columns of their own, so that the lambdas below do not compute them for every element.
    v = ver.withColumn("lc", _once(F.lower("content"))).withColumn("cents", _once(X.entity_set(F.col("content"))))
    ents, keys = F.col("original_names"), F.col("original_keys")
    v = v.withColumn("names", F.filter(ents["e"], lambda e: ~e.isin(L.ENTITY_STOP_WORDS)))
    names = F.col("names")
    part = lambda hits, of: F.when(F.size(of) > 0, hits / F.size(of)).otherwise(F.lit(1.0))
    v = v.select(
        "memory_id", "resolution", "memory_type", "ratio",
        (1 - F.length("content") / F.greatest(F.length("original"), F.lit(1))).alias("truncation"),
        (X.strip(F.col("content")) != "").alias("filled"),
        ((F.col("original") == "") | (F.col("content") == "")).alias("blank"),
        part(F.size(F.filter(ents, lambda e: F.col("lc").contains(e["low"]))), ents).alias("phrase"),
        part(F.size(F.filter(keys, lambda w: F.col("lc").contains(w))), keys).alias("dec"),
        part(X.overlap(names, F.col("cents")), names).alias("ent"),
        F.size(F.filter(F.array_except(F.split("lc", r"\s+"), F.col("original_words")), lambda w: (F.length(w) > 2) & ~w.isin(L.VALIDATION_FILLER))).alias("new"),
    )
    ratio, new, filled, blank = F.col("ratio"), F.col("new"), F.col("filled"), F.col("blank")
    rules = [
        ("min_ratio", X.label((ratio >= 1.2, "passed"), default="warning"), F.least(F.lit(1.0), ratio / 1.2)),
        ("max_ratio", X.label((ratio <= 20, "passed"), default="failed"), F.when(ratio <= 20, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - (ratio - 20) / 100))),
        ("not_empty", X.label((filled, "passed"), default="failed"), F.when(filled, 1.0).otherwise(0.0)),
        ("truncation", X.label((F.col("truncation") <= 0.8, "passed"), default="failed"), F.greatest(F.lit(0.0), 1 - F.col("truncation"))),
        ("semantic", F.when(blank, F.lit("failed")).otherwise(_three(F.col("phrase"), 0.7, 0.4)), F.when(blank, 0.0).otherwise(F.col("phrase"))),
        ("decision", F.when(F.col("memory_type") == "decision", _three(F.col("dec"), 0.8, 0.5)), F.col("dec")),
        ("entity", _three(F.col("ent"), 0.7, 0.4), F.col("ent")),
        ("new_words", X.label((new == 0, "passed"), (new <= 3, "warning"), default="failed"),
         F.when(new == 0, 1.0).when(new <= 3, 0.8).otherwise(F.greatest(F.lit(0.0), 1 - new / 10))),
    ]
    outcome = F.array(*[F.struct(F.lit(n).alias("rule"), st.alias("status"), sc.cast("double").alias("score")) for n, st, sc in rules])
    return v.select("memory_id", "resolution", F.explode(outcome).alias("r")).select("memory_id", "resolution", "r.*").filter("status is not null")


def validation_status(rules: DataFrame) -> DataFrame:
    """Overall verdict per version: failed over warning over passed."""
    g = rules.groupBy("memory_id", "resolution").agg(F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("status") == "warning").alias("warnings"))
    return g.withColumn("overall", X.label((F.col("failed") > 0, "failed"), (F.col("warnings") > 0, "warning"), default="passed"))


def expand(mem: DataFrame, ver: DataFrame, target: Column) -> DataFrame:
    """Stored version at the target resolution, else the nearest more compressed one, else the memory itself."""
    want = mem.select("memory_id", F.col("resolution").alias("own"), target.cast("int").alias("target"))
    near = (
        want.join(ver.select("memory_id", "resolution", "method"), "memory_id")
        .filter(F.col("resolution") >= F.col("target"))
        .groupBy("memory_id")
        .agg(F.min("resolution").alias("found"), F.min_by("method", "resolution").alias("method"))
    )
    return want.join(near, "memory_id", "left").withColumn("served", F.coalesce("found", "own")).drop("found")
