"""Secret scans: candidate strings judged by a random forest.

Candidates are found in whole texts by one pattern: known key prefixes, private-key blocks, and runs of at least 16 key
characters that hold a digit and a letter or stand as the value of an assignment (quoted or not; the name is no part of
it). Each is described by its length, its
transitions between character classes, repeated and distinct characters, the share that dictionary words cover, the
kind of place it was found in (source or path), and the words before and after it. A random forest, trained from
labelled findings, removes false positives (placeholders, digests of commits and files, identifiers, long words).

Labelled findings may be given as a table (candidate, before, after, path, label). By default ``FINDINGS`` labelled
findings are built by rule with a seed: keys of customary formats in customary places, and the customary false alarms.
The forest is small and becomes one nested CASE expression per tree, so scoring stays inside the row and runs where the
rows are; nothing is shuffled or broadcast. Main path: DataFrame functions only. Training uses Spark's own random
forest on the bounded table of findings.

Defined cases: null or blank texts have no findings; a null source is the path ""; ties between trees count half;
repeated rows keep their findings each; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import random
import re
import string
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engramlake.llm.common import aside, fold, restored, whole_text

FINDINGS, TREES, DEPTH, SEED, ACCEPT = 3000, 15, 6, 5, 0.5
NEAR = 48
MARK = "[SECRET]"
# Prefixes of public key formats.
PREFIXES = r"(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,}|glpat-[A-Za-z0-9_-]{20,}|sk_(?:live|test)_[A-Za-z0-9]{16,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{8,}"
#: The parts are possessive and start only where no key character stands before, so a scan is linear in the text. An
#: equals sign ends a name and may stand before a candidate; inside it is padding at the end only. A private key goes on
#: to its END line, whatever its length, but not beyond the next line of five dashes.
CANDIDATE = (
    r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----(?:[^-]*+(?:-(?!----)[^-]*+)*+-----END [A-Z ]{0,30}PRIVATE KEY-----|[A-Za-z0-9+/=\s]*+)"
    rf"|(?<![A-Za-z0-9_+/-])(?:{PREFIXES}"
    r"|(?=[A-Za-z_+/-]*+[0-9])(?=[0-9_+/-]*+[A-Za-z])[A-Za-z0-9_+/-]{16,}+(?:={1,2}(?![A-Za-z0-9_+/=\"'-]))?+)"
    r"|(?<=[:=\s\"'])(?<=(?:[kK]ey|KEY|[tT]oken|TOKEN|[sS]ecret|SECRET|[pP]assword|PASSWORD|[pP]asswd|pwd)\s{0,2}[:=]\s{0,2}[\"']?)(?:[^\s\"',;<>&]|&(?!\w{1,40}=)){8,}+"
)
# Words that speak for a placeholder or an ordinary identifier.
DICTIONARY = "example sample test your here change replace insert placeholder dummy default fake demo null none undefined user name client server config value string number index image file path page section article version release build commit branch main master data table column http https www com org net the and for with that this from are was will have not key token secret password api access auth public private id uuid hash sha md5".split()
CLUES = {
    "owner": r"(?i)(?:key|token|secret|passw(?:or)?d|pwd|credential|auth(?:orization)?|bearer|apikey|access)",
    "digest": r"(?i)(?:commit|sha-?\d*|md5|checksum|digest|hash|integrity|etag|revision|fingerprint|sum)",
    "identity": r"(?i)(?:uuid|guid|\bid\b|trace|session|build|isbn|doi|serial)",
    "assign": r"[:=]\s*[\"'`]?$",
    "quoted": r"[\"'`]$",
    "link": r"(?i)(?:https?://|www\.|[/?&#]$|src=|href=|data:image|base64,)",
}
FEATURES = ["length", "upper", "lower", "digit", "other", "switches", "digit_switches", "case_switches", "runs", "distinct", "hex", "covered", "vowels", "known_prefix", "test_path", *(f"before_{k}" for k in CLUES), "after_quote", "after_link", "after_assign"]


def _flag(cond: Column) -> Column:
    return F.when(cond, 1.0).otherwise(0.0)


def describe(c: Column, before: Column, after: Column, path: Column) -> dict[str, Column]:
    """Feature columns of a candidate, its neighbours and its path."""
    count = lambda pattern: F.regexp_count(c, F.lit(pattern)).cast("double")
    n = F.greatest(F.length(c), F.lit(1)).cast("double")
    share = lambda pattern: count(pattern) / n
    kind = F.concat_ws("|", *map(F.lit, sorted(DICTIONARY, key=lambda w: (-len(w), w))))
    covered = n - F.length(F.regexp_replace(F.lower(c), kind, ""))
    chars = F.array_distinct(F.split(c, ""))
    return {
        "length": F.least(n, F.lit(400.0)), "upper": share("[A-Z]"), "lower": share("[a-z]"), "digit": share("[0-9]"), "other": share("[^A-Za-z0-9]"),
        "switches": share("(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])"),
        "digit_switches": share("(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])"), "case_switches": share("(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])"),
        "runs": share(r"(.)(?=\1)"), "distinct": F.size(chars) / F.least(n, F.lit(200.0)),
        "hex": _flag(F.regexp_like(c, F.lit("^[0-9a-fA-F-]+$"))), "covered": covered / n, "vowels": share("[aeiouAEIOU]"),
        "known_prefix": _flag(F.regexp_like(c, F.lit(rf"^(?:{PREFIXES})|PRIVATE KEY"))),
        "test_path": _flag(F.regexp_like(path, F.lit("(?i)test|example|fixture|sample|mock|docs?/"))),
        **{f"before_{k}": _flag(F.regexp_like(before, F.lit(v))) for k, v in CLUES.items()},
        "after_quote": _flag(F.regexp_like(after, F.lit("^[\"'`]"))), "after_link": _flag(F.regexp_like(after, F.lit("^[./?#&]"))),
        "after_assign": _flag(F.regexp_like(after, F.lit(r"^\s?[:=]"))),
    }


def labelled_findings(n: int = FINDINGS, seed: int = SEED) -> list[tuple[str, str, str, str, int]]:
    """(candidate, before, after, path, label) built by rule: 1 for a secret, 0 for a false alarm."""
    r = random.Random(seed)
    some = lambda chars, k: "".join(r.choices(chars, k=k))
    hexa, alnum, url = "0123456789abcdef", string.ascii_letters + string.digits, string.ascii_letters + string.digits + "_-"
    syl = "an ber th er ing tion ou re st on es ed ha nd qu ment ver ch le".split()
    word = lambda: "".join(r.choice(syl) for _ in range(r.randint(1, 4)))
    around = lambda: " ".join(word() for _ in range(r.randint(0, 5)))
    rows = []
    for _ in range(n):
        left, right, path = around(), around(), r.choice(["", "src1", "web", "app/config.py", "notes.txt", ".env", "crawl"])
        if r.random() < 0.5:
            owner = r.choice(["token", "api_key", "apiKey", "secret", "password", "SECRET_KEY", "access_token", "auth", "Authorization: Bearer", "client_secret", "key", "AWS_SECRET_ACCESS_KEY", "DB_PASSWORD", "GITHUB_TOKEN_2"])
            c = r.choice([some(hexa, r.choice([32, 40, 64])), some(alnum, r.randint(20, 64)), some(url, r.randint(24, 48)), "AKIA" + some(string.ascii_uppercase + string.digits, 16), "ghp_" + some(alnum, 36), "sk_live_" + some(alnum, 24), "xoxb-" + some(string.digits, 11) + "-" + some(alnum, 24), "AIza" + some(url, 35), "eyJ" + some(alnum, 20) + "." + some(url, 60) + "." + some(url, 43), some(alnum, 10) + some("!@#", 2) + some(alnum, 6), "-----BEGIN RSA PRIVATE KEY-----\n" + some(alnum, 200)])
            sep, quote = r.choice([" = ", "=", ": ", ":", " "]), r.choice(['"', '"', "'", ""])
            if "Bearer" in owner:
                sep, quote = " ", ""
            named = r.random() < 0.88 or not re.match(r"AKIA|ghp_|sk_live|xoxb|AIza|eyJ|-----", c)
            before = f"{left} {owner}{sep}{quote}" if named else f"{left} "
            rows.append((c, before[-NEAR:], (quote + " " + right)[:NEAR], path, 1))
        else:
            k = r.randrange(10)
            quote = r.choice(['"', "", ""])
            if k == 0:
                c, before = some(hexa, r.choice([32, 40, 64])), f"{left} {r.choice(['commit', 'sha256:', 'md5', 'checksum', 'sha1 =', 'digest:', 'etag ', 'revision'])} {quote}"
            elif k == 1:
                c, before = "-".join(some(hexa, x) for x in (8, 4, 4, 4, 12)), f"{left} {r.choice(['uuid', 'id', 'trace', 'session id', 'guid'])}{r.choice([' ', '=', ': '])}{quote}"
            elif k == 2:
                c, before = r.choice(["your_api_key_here_123", "example-token-0000000000", "xxxxxxxxxxxxxxxx1", "replace-with-your-secret-1", "test_test_test_1234", "changeme12345678", "INSERT_YOUR_TOKEN_HERE_1", "dummy-password-value-1", "0000000000000000000a"]), f"{left} {r.choice(['token', 'api_key', 'secret', 'password', 'key'])}{r.choice([' = ', '=', ': '])}{quote}"
            elif k == 3:
                c, before = "-".join(word() for _ in range(r.randint(3, 7))) + str(r.randint(1, 2030)), f"{left} {r.choice(['http://a.b/', 'https://site.org/x/', '', 'www.', 'href=', '/'])}"
            elif k == 4:
                c, before = "".join(word() for _ in range(r.randint(3, 6))) + some(string.digits, r.randint(1, 4)), f"{left} "
            elif k == 5:
                c, before = r.choice(["Version", "release", "build", "image", "file", "section"]) + "_" + word() + "_" + some(string.digits, r.randint(2, 8)) + word(), f"{left} "
            elif k == 6:
                c, before = some(alnum + "+/", r.randint(60, 300)), f"{left} data:image/png;base64,"
            elif k == 7:
                c, before = "_".join(word() for _ in range(r.randint(2, 5))) + "_" + some(string.digits, 2), f"{left} {r.choice(['def', 'self', 'import', 'var', 'call'])} "
            elif k == 8:  # the name of an assignment, whose value is another candidate
                c, before = "_".join([word(), *r.choices(["access", "api", "secret", "key", "token", "password", "auth", "client"], k=r.randint(1, 3)), str(r.randint(1, 99))]), f"{left} {r.choice(['', 'export ', 'set '])}"
                c, quote = r.choice([c, c.upper(), c.upper()]), r.choice(["=", "=", " =", ":"])
            else:
                c, before = some(hexa, r.choice([16, 24, 32, 40])), f"{left} "
            rows.append((c, before[-NEAR:], (quote + " " + right)[:NEAR], r.choice([path, "tests/fixtures/a.json", "docs/example.md"]) if k in (2, 3, 5) else path, 0))
    return rows


def _tree_sql(node, names: list[str]) -> str:
    """One tree of Spark's forest as a CASE expression that gives its share of secrets."""
    if node.numDescendants() == 0:
        stats = list(node.impurityStats().stats())
        return f"{stats[1] / max(sum(stats), 1e-12)!r}D"
    split = node.split()
    test = f"{names[split.featureIndex()]} <= {split.threshold()!r}D"
    return f"CASE WHEN {test} THEN {_tree_sql(node.leftChild(), names)} ELSE {_tree_sql(node.rightChild(), names)} END"


def train_forest(findings: DataFrame) -> str:
    """SQL expression of the forest's mean share over the feature columns, from (candidate, before, after, path, label)."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    d = describe(F.col("candidate"), F.col("before"), F.col("after"), F.col("path"))
    rows = VectorAssembler(inputCols=FEATURES, outputCol="x").transform(findings.select(*[d[f].alias(f) for f in FEATURES], F.col("label").cast("double").alias("label")).coalesce(1))
    model = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="onethird").fit(rows.select("x", "label"))
    trees = [_tree_sql(t._call_java("rootNode"), FEATURES) for t in model.trees]
    return "(" + " + ".join(trees) + f") / {len(trees)}D"


@lru_cache(maxsize=4)
def _default_forest(application: str) -> str:
    spark = SparkSession.getActiveSession()
    return train_forest(spark.createDataFrame(labelled_findings(), "candidate string, before string, after string, path string, label int"))


def _forest(spark: SparkSession, findings: DataFrame | None) -> str:
    return train_forest(findings) if findings is not None else _default_forest(spark.sparkContext.applicationId)


def _tails(s: str, c: str) -> Column:
    """The ends of a text's parts in order: what stands before each candidate (``s``), and the candidate (``c``)."""
    return F.flatten(F.transform(s, lambda x, i: F.array(F.right(x, F.lit(NEAR)), F.right(F.coalesce(F.get(c, i), F.lit("")), F.lit(NEAR)))))


def _before(tails: str, i: Column) -> Column:
    """The text before candidate ``i``, earlier candidates included; as each has 8 characters, NEAR / 8 of them reach."""
    back = 2 * (NEAR // 8)
    return F.right(F.array_join(F.slice(tails, F.greatest(F.lit(1), 2 * i + 1 - back), F.least(F.lit(back + 1), 2 * i + 1)), ""), F.lit(NEAR))


def candidates(docs: DataFrame, *keep: str, path: str = "source") -> DataFrame:
    """One row per candidate: kept columns, place (1-based) among the candidates, candidate, before, after, path."""
    where = F.coalesce(F.col(path).cast("string"), F.lit("")) if path in docs.columns else F.lit("")
    t = docs.select(*keep, where.alias("path"), whole_text().alias("t"))
    t = t.select(*keep, "path", "t", fold(F.regexp_extract_all("t", F.lit(CANDIDATE), F.lit(0))).alias("c")).filter(F.size("c") > 0)
    t = t.select(*keep, "path", "c", fold(F.split("t", CANDIDATE, -1)).alias("s"))
    t = t.select(*keep, "path", "c", "s", fold(_tails("s", "c")).alias("b"))
    near = F.transform("c", lambda c, i: F.struct(c.alias("candidate"), _before("b", i).alias("before"), F.left(F.get("s", i + 1), F.lit(NEAR)).alias("after"), F.length(F.get("s", i)).alias("gap")))
    return t.select(*keep, "path", F.posexplode(near).alias("place", "x")).select(*keep, "path", (F.col("place") + 1).alias("place"), "x.*")


def find_secrets(docs: DataFrame, findings: DataFrame | None = None, path: str = "source", accept: float = ACCEPT) -> DataFrame:
    """doc_id, place, length, digest, score, is_secret of every candidate."""
    forest = _forest(docs.sparkSession, findings)
    rows = candidates(docs.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id", path=path)
    d = describe(F.col("candidate"), F.col("before"), F.col("after"), F.col("path"))
    x = rows.select("doc_id", "place", F.col("candidate").alias("c"), fold(F.struct(*[d[f].alias(f) for f in FEATURES])).alias("f")).select("doc_id", "place", "c", "f.*")
    x = x.withColumn("score", F.expr(forest))
    return x.select("doc_id", "place", F.length("c").cast("long").alias("n_chars"), F.sha2("c", 256).alias("digest"), "score", (F.col("score") >= accept).alias("is_secret"))


def redact_secrets(docs: DataFrame, findings: DataFrame | None = None, path: str = "source", accept: float = ACCEPT) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``MARK`` and ``n_chars``, if there, counted anew.

    Other columns stay as they are whatever their names.
    """
    forest = _forest(docs.sparkSession, findings)
    counted = docs.schema["n_chars"].dataType if "n_chars" in docs.columns else None
    t, own = aside(docs, ["text", "n_chars"])
    where = F.coalesce(F.col(own[path]).cast("string"), F.lit("")) if path in own else F.lit("")
    t = t.withColumn("sec_p", where).withColumn("sec_c", fold(F.regexp_extract_all(whole_text(), F.lit(CANDIDATE), F.lit(0))))
    s = F.when(F.size("sec_c") > 0, F.split(F.col("text"), CANDIDATE, -1)).otherwise(F.array().cast("array<string>"))
    t = t.withColumn("sec_s", fold(s))
    t = t.withColumn("sec_b", fold(_tails("sec_s", "sec_c")))

    def verdict(c: Column, i: Column) -> Column:
        d = describe(c, _before("sec_b", i), F.left(F.get("sec_s", i + 1), F.lit(NEAR)), F.col("sec_p"))
        return F.struct(c.alias("c"), *[d[f].alias(f) for f in FEATURES])

    t = t.withColumn("sec_f", fold(F.when(F.size("sec_c") > 0, F.transform("sec_c", verdict))))
    names = "|".join(sorted(FEATURES, key=lambda x: -len(x)))
    score = re.sub(rf"\b({names}) <=", r"sec_x.\1 <=", forest)
    t = t.withColumn("sec_v", fold(F.expr(f"transform(sec_f, sec_x -> named_struct('c', sec_x.c, 'p', {score}))")))
    text = F.concat_ws("", F.flatten(F.transform("sec_s", lambda s, i: F.array(s, F.when(F.get("sec_v", i)["p"] >= accept, F.lit(MARK)).otherwise(F.coalesce(F.get("sec_v", i)["c"], F.lit("")))))))
    changed = F.coalesce(F.exists("sec_v", lambda v: v["p"] >= accept), F.lit(False))
    t = t.withColumn("text", F.when(changed, text).otherwise(F.col("text")))
    if counted is not None:
        t = t.withColumn("n_chars", F.when(changed, F.length("text").cast(counted)).otherwise(F.col("n_chars")))
    return t.select(*restored(own))

