"""Toxicity, fill-in-middle and source divergence against held-out labels, round trips and plain loops."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from engramlake.llm import divergence, infill, toxicity
from test_operators import D, documents, empty, odd_rows

# 11 ------------------------------------------------------------------------------------------------------------------

def test_toxicity_on_held_out_labels(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = documents(spark, d), spark.read.parquet(f"{d}/labels.parquet")
    got = toxicity.score_toxicity(docs, labels).collect()
    known = {r.doc_id: r.toxic for r in labels.collect()}
    y = [(r.predicted, known[r.doc_id]) for r in got if r.held_out and r.doc_id in known]
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert np.mean([p for p, t in y if t]) > 0.9 and np.mean([p for p, t in y if not t]) < 0.01


def plain_grams(text):
    t = re.sub(r"[\x09-\x0D]", " ", f" {(text or '').lower()} ")
    return Counter(t[i : i + n] for n in toxicity.ORDERS for i in range(len(t) - n + 1))


@pytest.mark.parametrize("piece", [toxicity.PIECE, 7])
def test_ngram_tallies_and_ratios(spark, monkeypatch, piece):
    """Tallies by pieces equal whole counts, and counts, ratios and kept features equal a plain loop."""
    monkeypatch.setattr(toxicity, "PIECE", piece)
    texts = ["you are a LOSER, loser loser", "a quiet\tday in the höfe", "", None, "loser", "x", "a quiet day " * 9]
    bucket = {}
    for t in texts:
        want = Counter()
        for g, n in plain_grams(t).items():
            want[bucket.setdefault(g, hashed(g))] += n
        u, n = toxicity.tally(t)
        assert dict(zip(u.tolist(), n.tolist(), strict=True)) == want
    rows = spark.createDataFrame([(t, i in (0, 4)) for i, t in enumerate(texts)], "text string, toxic boolean")
    p, n = Counter(), Counter()
    for i, t in enumerate(texts):
        total = Counter()
        for g, k in plain_grams(t).items():
            total[hashed(g)] += k
        for b, k in total.items():
            for j, level in enumerate(toxicity.LEVELS):
                if k >= level:
                    (p if i in (0, 4) else n)[b, j] += 1
    counts = toxicity.feature_counts(rows)
    got = {(r["bucket"], j): (r[f"p{j}"], r[f"n{j}"]) for r in counts.collect() for j in range(len(toxicity.LEVELS)) if r[f"p{j}"] + r[f"n{j}"]}
    assert got == {k: (p[k], n[k]) for k in p | n}

    def g2(k):
        a, b, s = p[k], n[k], p[k] + n[k]
        part = lambda o, e: o * np.log(o / e) if o else 0.0
        return round(part(a, s * 2 / 7) + part(b, s * 5 / 7) + part(2 - a, (7 - s) * 2 / 7) + part(5 - b, (7 - s) * 5 / 7), 9)

    best = toxicity.best_features(counts, 2, 5, 10).collect()
    assert sorted(g2((r.bucket, r.level)) for r in best) == sorted(g2(k) for k in p | n)[-10:]
    for r in best:
        k = r.bucket, r.level
        assert r.ratio == pytest.approx(np.log((p[k] + 0.5) / 3) - np.log((n[k] + 0.5) / 6))


def hashed(gram):
    h = 0
    for c in gram:
        h = (h * 0x9E3779B1 + ord(c) + 1) & 0xFFFFFFFF
    k = ((h ^ h >> 15) * 0x85EBCA6B) & 0xFFFFFFFF
    return (k ^ k >> 13) >> (32 - toxicity.BITS)


def test_toxicity_odd_input(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 1), (None, 1, 1), (7, 0, None), (1, 1, 0), (3, 1, 0), (8, 1, 1), (8, 1, 0)], "doc_id long, quality int, toxic int")
    odd = odd_rows(spark)
    got = toxicity.score_toxicity(odd, labels).collect()
    assert len(got) == 11 and len({r.score for r in got if r.doc_id in (3, 4)}) == 1
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in odd.collect())
    assert {r.score for r in toxicity.score_toxicity(odd, labels.filter("false")).collect()} == {0.0}
    assert {r.score for r in toxicity.score_toxicity(odd, labels.filter("toxic = 1")).collect()} == {1.0}
    assert toxicity.score_toxicity(empty(spark), labels).count() == 0
    kept = toxicity.drop_toxic(odd, labels)
    assert kept.columns == odd.columns and kept.count() == sum(r.predicted == 0 for r in got)


# 12 ------------------------------------------------------------------------------------------------------------------

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_infill(doc_id, text):
    w = TOKEN.findall(text or "")
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(w) + 1), h2 % (len(w) + 1)))
    p, m, s = "".join(w[:a]), "".join(w[a:b]), "".join(w[b:])
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return doc_id, len(w), "plain", None, None, sha(text or ""), sha(text or "")
    out = f"<S>{s}<P>{p}<M>{m}" if h4 % 100 < 80 else f"<P>{p}<S>{s}<M>{m}"
    return doc_id, len(w), "spm" if h4 % 100 < 80 else "psm", len(p), len(m), sha(out), sha(text)


def test_infill_against_plain_loop(spark):
    marks = [(100 + i, t) for i, t in enumerate(["a <P> b", "<S", "x <S", "> y < M > <", " lead", "trail \n", " nbsp one two", "é́ \U0001f600 z"] * 12)]
    rows = [(r.doc_id, r.text) for r in documents(spark).union(odd_rows(spark).select("doc_id", "text", "lang", "source", "n_chars")).collect()] + marks
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as n", "'y' as form")
    got = Counter(tuple(r) for r in infill.digests(docs).collect())
    assert got == Counter(plain_infill(*r) for r in rows)
    assert {"psm", "spm", "plain"} == {r[2] for r in got} and infill.digests(empty(spark)).count() == 0
    out = infill.transform(docs)
    assert out.columns == [*docs.columns, "fim_text", "fim_form"]
    assert Counter((r.text or "") for r in out.collect()) == Counter(infill.restore(r.fim_text, r.fim_form) for r in out.collect())
    with pytest.raises(ValueError):
        infill.transform(docs, text_as="Form")


def test_rank_index_is_exact_and_bounded(spark):
    r = random.Random(8)
    texts = ["", "a", " ", "a" * 5000 + " b", " ".join("x" * r.choice([1, 2, 3, 900]) for _ in range(5000)), "w " * 40_000, " ".join("y" * (1 + i // 40) for i in range(4000))]
    for t in texts:
        b = infill.boundaries(t)
        want = np.cumsum([0, *map(len, TOKEN.findall(t))])
        assert np.array_equal(b, want)
        x = infill.RankIndex.fit(b)
        assert [x.boundary(k) for k in range(len(b))] == b.tolist()
        assert np.abs(x.residual.astype(int)).max() <= infill.ERROR + 1 and len(x.first) <= max(1, len(b) // 2 + 1)
    assert len(infill.RankIndex.fit(infill.boundaries("w " * 40_000)).first) == 1
    docs = spark.createDataFrame([*enumerate(texts), (None, "null id here"), (7, None)], "doc_id long, text string")
    cuts = infill.cut_by_index(infill.index_table(docs), 5).collect()
    for i, t in [(q.doc_id, q.text or "") for q in docs.collect()]:
        w = TOKEN.findall(t)
        h1, h2, _, _ = infill.draws(i, 5)
        assert (i, *sorted(len("".join(w[: h % (len(w) + 1)])) for h in (h1, h2))) in [tuple(c) for c in cuts]


# 13 ------------------------------------------------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain_audit(rows, min_docs):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    df, groups = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        w = TERM.findall((text or "").translate(lower))
        df[lang or ""].update(set(w))
        groups[lang or "", source or ""].update(w)
    out = []
    for (lang, source), c in groups.items():
        kept = [t for t, n in df[lang].items() if n >= min_docs]

        def share(count):
            n = sum(count[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (count[t] + 2) // (n + 2 * len(kept)) for t in kept}

        p, f = share(c), lambda a, b: (a - b) ** 2 // (a + b)
        q = share(sum((x for (la, _), x in groups.items() if la == lang), Counter()))
        items = []
        for (la, other), x in groups.items():
            if la == lang and other != source:
                s = share(x)
                items.append((other, sum(f(p[t], s[t]) for t in kept)))
        items.sort(key=lambda i: (-i[1], i[0].encode()))
        out += [(lang, source, "pair", i, v, k + 1) for k, (i, v) in enumerate(items)]
        terms = sorted(((t, f(p[t], q[t])) for t in kept if c[t] and p[t] > q[t]), key=lambda i: (-i[1], i[0].encode()))
        out += [(lang, source, "term", i, v, k + 1) for k, (i, v) in enumerate(terms[:10])]
    return Counter(out)


def audit_rows(n=240, seed=3):
    r = random.Random(seed)
    words = ["Abc", "abc", "abcdefgh", "abcdefghi", "abcdefghij", "é", "straße", "STRASSE", "日本語", "x" * 23, "x" * 24, "x" * 24 + "y", "z"] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    glue = [" ", ", ", "1", "\x00", "\n", "_", "@", "[", "~"]
    rows = [("".join(r.choice(words) + r.choice(glue) for _ in range(r.randint(0, 40))), r.choice(["en", "de", None]), r.choice(["a", "b", "c", "ä", None])) for _ in range(n)]
    return rows + [(None, "en", "only null"), ("", "xx", "alone"), ("solo words", "yy", "p"), ("other", "yy", "q"), ("tail", "en", "a"), ("head", "en", "a")]


def test_divergence_against_plain_loop(spark):
    rows = audit_rows()
    docs = spark.createDataFrame([(i, t, g, s, "k") for i, (t, g, s) in enumerate(rows)], "doc_id long, text string, lang string, source string, term string").withColumnsRenamed({"term": "count"})
    for docs in (docs, docs.repartition(5).withColumnRenamed("count", "p0")):
        got = Counter((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in divergence.audit(docs).collect())
        assert got == plain_audit(rows, 10)
    assert divergence.audit(empty(spark)).count() == 0
    odd = divergence.audit(odd_rows(spark), min_docs=1).collect()
    assert Counter((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in odd) == plain_audit([(r.text, r.lang, r.source) for r in odd_rows(spark).collect()], 1)


def test_divergence_in_blocks_and_tiles(spark):
    """Many small blocks of terms and tiles of sources give the same sums."""
    r = random.Random(5)
    rows = [(" ".join(f"t{chr(97 + r.randrange(26))}{chr(97 + r.randrange(8))}" for _ in range(30)), "en", f"s{r.randrange(23)}") for _ in range(300)]
    counts = divergence.term_counts(spark.createDataFrame(rows, "text string, lang string, source string"))
    kept = divergence.kept_terms(counts, 1)
    total = counts.groupBy("lang", "source").agg({"count": "sum"}).withColumnRenamed("sum(count)", "total")
    groups = total.crossJoin(kept.groupBy().count().withColumnRenamed("count", "v")).withColumn("p0", divergence._share(divergence.F.lit(0), "total", "v"))
    shares = counts.join(groups, ["lang", "source"]).withColumn("p", divergence._share(divergence.F.col("count"), "total", "v")).select("lang", "source", "term", "p")
    got = {(x.source, x["item"]): x.value for x in divergence.pair_sums(shares, groups, block=16, tile=4).collect()}
    want = {(k[1], k[3]): k[4] for k in plain_audit(rows, 1) if k[2] == "pair"}
    assert got == want


def test_pointer_sort_groups_equal_words():
    r = random.Random(1)
    words = ["".join(r.choice("ab") for _ in range(r.choice([1, 7, 8, 9, 15, 16, 17, 40]))) for _ in range(3000)] + ["a" * n for n in range(1, 60)] * 2
    data = np.frombuffer((" ".join(words) + " " * 8).encode(), np.uint8)
    length = np.array([len(w) for w in words])
    start = np.cumsum(length + 1) - length - 1
    order, new = divergence.sort_pointers(data, start, length)
    assert [words[i] for i in order] == sorted(words)
    runs = np.split(order, np.flatnonzero(new)[1:])
    assert all(len({words[i] for i in x}) == 1 and list(x) == sorted(x) for x in runs) and len(runs) == len(set(words))


def test_whole_texts_of_long_documents(spark):
    """The last word of a very long text counts in every operator."""
    long_text = "filler words " * 400_000 + "zzlast"
    docs = spark.createDataFrame([(1, long_text, "en", "a"), (2, "zzlast", "en", "b")], "doc_id long, text string, lang string, source string")
    assert {r.source: r["count"] for r in divergence.term_counts(docs).filter("term = 'zzlast'").collect()} == {"a": 1, "b": 1}
    assert {r.doc_id: r.n for r in infill.digests(docs).collect()} == {1: 800_001, 2: 1}
    u, _ = toxicity.tally(long_text)
    assert hashed("zzlast") in set(u.tolist())


def test_results_do_not_depend_on_partitions(spark):
    docs, labels = documents(spark), spark.read.parquet(f"{D}/labels.parquet")
    one = sorted(toxicity.score_toxicity(docs, labels).collect())
    assert one == sorted(toxicity.score_toxicity(docs.repartition(7), labels.repartition(3)).collect())
