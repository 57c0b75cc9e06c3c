"""Stages keep their input whole: clashing column names, different texts under one id, and leaks against a plain loop."""

from __future__ import annotations

import random
from collections import Counter

from engramlake.llm import decontaminate, lines, neardup, secrets

KEY = "9f8b7c6d5e4f3a2b1c0d9e8f7a6b5c4d3e2f1a0b"


def test_columns_with_the_names_used_inside(spark):
    text = f'some words token = "{KEY}" and more of the words that follow here'
    taken = ["sec_c", "sec_p", "sec_s", "sec_b", "sec_f", "sec_v", "nd_kept", "nd_rows", "nd_id", "lf_host", "lf_key", "lf_text", "in_0", "host", "kind"]
    docs = spark.createDataFrame([(i, text if i else None, "s", *[f"{c}{i}" for c in taken]) for i in (0, 1, 1, 2)], "doc_id long, text string, source string, " + ", ".join(f"{c} string" for c in taken))
    own = Counter(tuple(r[c] for c in taken) for r in docs.collect())
    out = secrets.redact_secrets(docs)
    assert out.columns == docs.columns and Counter(tuple(r[c] for c in taken) for r in out.collect()) == own
    assert not any(KEY in str(r[c]) for r in out.collect() for c in out.columns)
    once = neardup.drop_near_duplicates(docs)
    assert once.columns == docs.columns and sorted(r.doc_id for r in once.collect()) == [0, 1]
    clean = lines.clean_documents(docs)
    assert clean.columns == docs.columns and Counter(tuple(r[c] for c in taken) for r in clean.collect()) <= own


def test_different_texts_under_one_id_stay(spark):
    rows = [(1, "alpha beta gamma delta epsilon zeta"), (1, "one two three four five six"), (1, "one two three four five six"), (2, "seven eight nine")]
    got = Counter((r.doc_id, r.text) for r in neardup.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter(set(rows))


def test_leaks_against_a_plain_loop(spark):
    """Counts of matched windows on random texts with numbers, units and names, for items of several lengths."""
    r = random.Random(9)
    pool = "red blue stone river old bridge market walks sells 5 12 7.5 km Berlin Anna Paul hours".split()
    text = lambda n: "go " + " ".join(r.choice(pool) for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([2, 3, 3, 8, 12, 20, 30])]
    docs = [(i, " ".join([text(r.randint(0, 30)), *[items[r.randrange(7)][1] for _ in range(r.randint(0, 2))], text(r.randint(0, 9))])) for i in range(60)]
    di, ii = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    rows = {k: {x[k]: x for x in decontaminate._template_rows(df, k).collect()} for df, k in ((di, "doc_id"), (ii, "item_id"))}
    known = {}
    for x in decontaminate.item_windows(ii).collect():
        known.setdefault((x.item_id, x.plain), {})[x.h] = (x["size"], len(x.slots))
    want = {}
    for d, x in rows["doc_id"].items():
        for (item, plain), windows in known.items():
            size = next(iter(windows.values()))[0]
            have = set()
            for i in range(len(x.th) - size + 1):
                slots = any(v is not None for v in x.sv[i : i + size])
                have.add(tuple(x.wh[i : i + size]) if plain and slots else tuple(x.th[i : i + size]))
            hashed = {h for h in windows if h in hashes(spark, have)}
            if 100 * len(hashed) >= 80 * len(windows):
                want.setdefault((d, item), {})[plain] = (len(hashed), len(windows))
    got = {(x.doc_id, x.item_id): (x.matched, x.n_windows) for x in decontaminate.matches(di, ii).collect()}
    assert got == {k: v.get(False, v.get(True)) for k, v in want.items()} and len(got) > 40


_HASHES: dict = {}


def hashes(spark, windows):
    """xxhash64 of arrays of longs, as the operator takes it."""
    new = [w for w in windows if w not in _HASHES]
    if new:
        from pyspark.sql import functions as F

        for row in spark.createDataFrame([(list(w),) for w in new], "w array<long>").select("w", F.xxhash64("w").alias("h")).collect():
            _HASHES[tuple(row.w)] = row.h
    return {_HASHES[w] for w in windows}
