"""Quality rules with cross-document line frequency.

Base rules of one text: words, their characters, symbols, repeated lines, and words inside 5-word windows that occur
twice or more. Across documents: lines are normalised (lower case, single spaces), hashed, and the distinct documents
of a host that hold a line are counted; copies of one text count as one document. A line in more than
``max(min_docs, share * documents of the host)`` documents is removed, and a document is rejected as depleted when
fewer than ``least_words`` words or less than ``least_share`` of its words remain. A line repeated inside one document
counts once in that balance.

Only DataFrame functions; per-text work stays inside the row. Lines are first reduced to one row per (host, text, line)
before counts; counts combine map-side, and the join back is on (host, line), which Spark may split where a line is
very common.

Defined cases: a null text has no words and fails the base rules; a null host is a host of its own; repeated rows keep
one row each with equal verdicts; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engramlake.llm.common import SPACE, WORD, aside, fold, let, restored, whole_text, words_of

WINDOW, LEAST_BASE_WORDS, REPEAT_PERCENT = 5, 10, 20
MIN_DOCS, SHARE, LEAST_WORDS, LEAST_SHARE = 10, 0.01, 5, 0.1
SYMBOLS = "#*$%&|<>"


def _repeat_words(h: Column) -> Column:
    """Words covered by windows that occur twice or more, from the hashes of all windows in order."""
    placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
    again = let(placed, lambda z: F.filter(z, lambda x, i: ((i > 0) & (F.get(z, i - 1)["h"] == x["h"])) | F.coalesce(F.get(z, i + 1)["h"] == x["h"], F.lit(False))))
    starts = F.array_sort(F.transform(again, lambda x: x["p"]))
    covered = let(starts, lambda p: F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)))))
    return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(F.aggregate(covered, F.lit(0), lambda a, x: a + x))


def base_rules(docs: DataFrame, host: str = "source") -> DataFrame:
    """One row per document with the counts of its own text, its host and the digest of its text."""
    t = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), whole_text().alias("t"))
    t = t.select("*", fold(F.struct(words_of(F.col("t")).alias("w"), F.filter(F.split("t", "\n"), lambda x: F.regexp_like(x, F.lit(WORD))).alias("l"))).alias("f"))
    n = F.size("f.w")
    windows = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), F.greatest(n - (WINDOW - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(F.col("f.w"), i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))
    t = t.select("doc_id", "host", "t", "f", fold(windows).alias("h"))
    row = t.select(
        "doc_id", "host", F.xxhash64("t").alias("text_key"),
        n.cast("long").alias("n_words"),
        F.length(F.regexp_replace("t", SPACE, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("f.l") - F.size(F.array_distinct("f.l"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("h")).cast("long").alias("n_repeat_words"),
    )
    return row.withColumn("base_failed", (F.col("n_words") < LEAST_BASE_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")))


def document_lines(docs: DataFrame, host: str = "source") -> DataFrame:
    """One row per host, distinct text and distinct normalised line: host, text_key, line_key, words."""
    t = docs.select(F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), whole_text().alias("t"))
    lines = F.transform(F.split("t", "\n"), lambda x: F.trim(F.regexp_replace(F.lower(x), SPACE, " ")))
    rows = t.select("host", F.xxhash64("t").alias("text_key"), F.explode(F.array_distinct(lines)).alias("line")).filter("line <> ''")
    rows = rows.select("host", "text_key", F.xxhash64("line").alias("line_key"), (F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit(""))) + 1).alias("words"))
    return rows.groupBy("host", "text_key", "line_key").agg(F.max("words").alias("words"))


def common_lines(docs: DataFrame, lines: DataFrame, host: str = "source", min_docs: int = MIN_DOCS, share: float = SHARE) -> DataFrame:
    """host, line_key, line_docs of the lines that go."""
    texts = docs.select(F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.xxhash64(whole_text()).alias("text_key")).distinct()
    hosts = texts.groupBy("host").agg(F.count("*").alias("host_docs"))
    common = lines.groupBy("host", "line_key").agg(F.count("*").alias("line_docs"), F.max("words").alias("line_words")).filter(F.col("line_docs") > min_docs)
    return common.join(hosts, "host").filter(F.col("line_docs") > F.lit(float(share)) * F.col("host_docs")).select("host", "line_key", "line_docs")


def depleted_texts(docs: DataFrame, host: str = "source", min_docs: int = MIN_DOCS, share: float = SHARE, least_words: int = LEAST_WORDS, least_share: float = LEAST_SHARE) -> DataFrame:
    """host, text_key, removed and left words of texts that lose lines; ``depleted`` tells which go."""
    lines = document_lines(docs, host)
    common = common_lines(docs, lines, host, min_docs, share)
    marked = lines.join(common, ["host", "line_key"], "left")
    per = marked.groupBy("host", "text_key").agg(F.sum("words").alias("words"), F.sum(F.when(F.col("line_docs").isNotNull(), F.col("words")).otherwise(0)).alias("removed"))
    left = F.col("words") - F.col("removed")
    return per.filter("removed > 0").withColumn("depleted", (left < least_words) | (left < F.lit(float(least_share)) * F.col("words")))


def quality_rules(docs: DataFrame, host: str = "source", **limits) -> DataFrame:
    """Counts and verdict of every document; see the module text for the rules."""
    gone = depleted_texts(docs, host, **limits).filter("depleted").select("host", "text_key", "depleted")
    out = base_rules(docs, host).join(gone, ["host", "text_key"], "left")
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.col("depleted").isNull()).alias("kept"),
    )


def clean_documents(docs: DataFrame, host: str = "source", min_docs: int = MIN_DOCS, share: float = SHARE, **limits) -> DataFrame:
    """Documents that ``quality_rules`` keeps, their common lines taken out of ``text`` and ``n_chars``, if there, counted anew."""
    mine, names = aside(docs, ["text", "n_chars"])
    mine = mine.select("*", F.coalesce(F.col(names[host]).cast("string"), F.lit("")).alias("lf_host"), F.xxhash64(whole_text()).alias("lf_key"))
    common = common_lines(docs, document_lines(docs, host), host, min_docs, share)
    gone = depleted_texts(docs, host, min_docs, share, **limits)
    bad = base_rules(docs, host).filter("base_failed").select("host", "text_key").union(gone.filter("depleted").select("host", "text_key")).distinct()
    kept = mine.join(bad, (F.col("lf_host") == bad["host"]) & (F.col("lf_key") == bad["text_key"]), "left_anti")
    some = gone.filter("not depleted").select("host", "text_key")
    once = kept.select("lf_host", "lf_key", whole_text().alias("t")).dropDuplicates(["lf_host", "lf_key"]).withColumnsRenamed({"lf_host": "host", "lf_key": "text_key"}).join(some, ["host", "text_key"], "left_semi")
    parts = once.select("host", "text_key", F.posexplode(F.split("t", "\n")).alias("at", "line"))
    parts = parts.withColumn("line_key", F.xxhash64(F.trim(F.regexp_replace(F.lower("line"), SPACE, " ")))).join(common, ["host", "line_key"], "left_anti")
    parts = parts.groupBy("host", "text_key").agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("l"))
    left = parts.select(F.col("host").alias("lf_h"), F.col("text_key").alias("lf_k"), F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("lf_text"))
    out = kept.join(left, (F.col("lf_host") == F.col("lf_h")) & (F.col("lf_key") == F.col("lf_k")), "left").withColumn("text", F.coalesce("lf_text", "text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("lf_text").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*restored(names))


def quality_rules_sql(relation: str = "documents", host: str = "source") -> str:
    sp = r"[\x20\x09-\x0D]+"
    return rf"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({host}, '') AS host, coalesce(text, '') AS t FROM {relation}),
    w AS (SELECT r, doc_id, host, t, list_filter(regexp_split_to_array(t, '{sp}'), lambda x: x <> '') AS w,
          list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
    win AS (SELECT r, i, w[i:i + 4] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
    rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c > 1),
    cov AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM rep) GROUP BY r),
    ln AS (SELECT DISTINCT host, t, line FROM (SELECT host, t, unnest(list_transform(string_split(t, chr(10)), lambda x: trim(regexp_replace(lower(x), '{sp}', ' ', 'g')))) AS line FROM d) WHERE line <> ''),
    hosts AS (SELECT host, count(DISTINCT t) AS n FROM d GROUP BY 1),
    common AS (SELECT host, line, count(*) AS c FROM ln GROUP BY 1, 2 HAVING count(*) > {MIN_DOCS}),
    hot AS (SELECT host, line FROM common JOIN hosts USING (host) WHERE c > {SHARE}e0 * n),
    per AS (SELECT host, t, sum(length(line) - length(replace(line, ' ', '')) + 1) AS words,
            sum(CASE WHEN hot.line IS NOT NULL THEN length(ln.line) - length(replace(ln.line, ' ', '')) + 1 ELSE 0 END) AS removed
            FROM ln LEFT JOIN hot USING (host, line) GROUP BY 1, 2),
    gone AS (SELECT host, t FROM per WHERE removed > 0 AND (words - removed < {LEAST_WORDS} OR words - removed < {LEAST_SHARE}e0 * words)),
    b AS (SELECT w.r, doc_id, host, t, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '{sp}', '', 'g')) AS BIGINT) AS word_chars,
          CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
          CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN cov USING (r)),
    f AS (SELECT *, n_words < {LEAST_BASE_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed FROM b)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND gone.t IS NULL AS kept
    FROM f LEFT JOIN gone ON f.host = gone.host AND f.t = gone.t"""
