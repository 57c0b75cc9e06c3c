"""Steps that grew faster than their input: what they form and how they join, on small frames with known outcomes."""

import datetime as dt
import random
import re
import time

from pyspark.sql import functions as F

from engramlake.operators import evaluate as EV
from engramlake.operators import evidence as VE
from engramlake.operators import lifecycle as LC
from engramlake.operators import recall as RE
from engramlake.operators import similar as SIM
from engramlake.operators import skew
from engramlake.operators import temporal as TE
from engramlake.operators import topterms as TT

T0 = dt.datetime(2024, 1, 1)
RE_WORD = re.compile(r"\w+")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_near_decisions_are_found_without_word_lists(spark, monkeypatch):
    """texts of common words form no lists and no pairs of word sets."""
    seen = []
    write = TE.materialise
    monkeypatch.setattr(TE, "materialise", lambda df, label: (seen.append(label), write(df, label))[1])
    rows = [(i, "t", f"we all decided on plan number{i}", T0 + dt.timedelta(days=i)) for i in range(40)]
    got = {x.decision_id: x.superseded_by for x in TE.superseding_decisions(spark.createDataFrame(rows, "decision_id long, topic string, text string, decided_at timestamp"), "topic").collect()}
    assert got == {i: i + 1 for i in range(39)}
    assert "decision-lists" not in seen


def test_superseding_decisions_near_and_far_against_loop(spark):
    r = random.Random(5)
    rows = [(i, f"t{i % 2}", " ".join(r.choice("abcdefghijklmnopqrstuvwxyz") * 2 for _ in range(r.randint(2, 7))), T0 + dt.timedelta(days=i // 3)) for i in range(240)]
    want = {}
    for i, t, x, d in rows:
        later = [(e, j) for j, u, y, e in rows if u == t and e > d and len(set(x.split()) & set(y.split())) >= 3]
        if later:
            want[i] = min(later)[1]
    df = spark.createDataFrame(rows, "decision_id long, topic string, text string, decided_at timestamp")
    for rounds in ((2, 4), (8, 32, 128)):
        assert {x.decision_id: x.superseded_by for x in TE.superseding_decisions(df, "topic", look=2, rounds=rounds).collect()} == want


def test_exploded_points_are_not_broadcast(spark):
    """points exploded over the levels of time come from a small file; a broadcast of them went through the driver."""
    iv = spark.createDataFrame([("a", T0 + dt.timedelta(days=i), T0 + dt.timedelta(days=i + 1), i) for i in range(20)], "k string, s timestamp, e timestamp, v long")
    points = spark.createDataFrame([(i, "a", T0 + dt.timedelta(days=i, hours=3)) for i in range(20)], "pid long, k string, t timestamp")
    found = skew.latest_covering(points, iv, "pid", ["k"], "t", "s", "e", ["v"], ["s"])
    assert "BroadcastHashJoin" not in plan(found)
    assert {x.pid: x.v for x in found.collect()} == {i: i for i in range(20)}


def test_propositions_do_not_pair_words_of_all_facts(spark, monkeypatch):
    """a word that every fact holds met every question of every entity."""
    rows = [(i, f"user_{i % 60}", f"p{i % 5}", f"v{i % 7}") for i in range(1800)]
    f = spark.createDataFrame(rows, "fact_id long, entity string, property string, value string").withColumn("raw", F.concat_ws(" ", "entity", "property", F.lit("is"), "value"))
    q = spark.createDataFrame([(e, f"user_{e}", f"what is the p{e % 5} v{e % 7}", "p0") for e in range(60)], "query_id long, entity string, text string, cue string")
    graph = spark.createDataFrame([], "src string, dst string, kind string, weight double")
    pairs = []
    write = TT.materialise
    monkeypatch.setattr(TT, "materialise", lambda df, label: (lambda t: (pairs.append(t.count()) if label == "top-pairs" else None, t)[1])(write(df, label)))
    got = {}
    for x in VE.search_propositions(q, f, graph).collect():
        got.setdefault(x.query_id, []).append((x.rank, x.fact_id, x.score))
    for e in range(60):
        ask = {"what", "is", "the", f"p{e % 5}", f"v{e % 7}"}
        score = {i: len(ask & {u, p, "is", v}) + (5 if u == f"user_{e}" else 0) for i, u, p, v in rows}
        want = sorted(score.items(), key=lambda x: (-x[1], x[0]))[:4]
        assert sorted(got[e]) == [(k + 1, i, float(n)) for k, (i, n) in enumerate(want)]
    assert sum(pairs) < 60 * 1800 / 4


def test_percentiles_of_many_distinct_values(spark):
    """with more distinct values than the sketch keeps, its percentile is another value than the SQL's."""
    m = spark.range(60000).select(F.lit("a").alias("name"), (F.pmod(F.col("id") * 7919, F.lit(60000)) / 7).alias("value"))
    few = spark.createDataFrame([("b", 1.0), ("b", 2.0), ("b", 2.0), ("c", 5.0)], "name string, value double")
    got = {x.name: tuple(x)[1:] for x in EV.approx_percentiles(m.unionByName(few), ["name"], accuracy=100).collect()}
    assert got["a"] == (60000, *[(60000 * p // 100 - 1) / 7 for p in (50, 90, 95, 99)])
    assert got["b"] == (3, 2.0, 2.0, 2.0, 2.0) and got["c"] == (1, 5.0, 5.0, 5.0, 5.0)


def test_equal_sets_are_no_search(spark, monkeypatch):
    """a memory worded as a message was searched among all messages that share its words."""
    seen = []
    write = SIM.materialise
    monkeypatch.setattr(SIM, "materialise", lambda df, label: (seen.append(label), write(df, label))[1])
    msg = spark.createDataFrame([(i, f"user {i // 2} likes the plan and hates the rest") for i in range(20)], "message_id long, text string")
    mem = lambda rows: spark.createDataFrame(rows, "memory_id long, content string, message_id long")
    got = LC.repair_provenance(mem([(1, "user 3 likes the plan and hates the rest", None), (2, "hates the rest and the user 0 likes plan", None)]), msg).collect()
    assert {(x.memory_id, x.repaired_message_id, x.score) for x in got} == {(1, 6, 1.0), (2, 0, 1.0)}
    assert "numbered-sets" not in seen
    more = LC.repair_provenance(mem([(1, "user 3 likes the plan and hates the rest", None), (3, "user 3 likes the plan and hates the rest too", None), (4, "nothing", None)]), msg).collect()
    assert {(x.memory_id, x.repaired_message_id, round(x.score, 6)) for x in more} == {(1, 6, 1.0), (3, 6, 0.888889)}


def test_similar_sets_meet_in_tiles_without_shuffled_pairs(spark, monkeypatch):
    """pairs that share a prefix word were joined, shuffled and sorted; now a tile counts them, however small tiles and batches are."""
    rng = random.Random(7)
    words = [f"w{i}" for i in range(30)]
    sets = {i: frozenset(rng.sample(words, rng.choice([1, 2, 3, 6, 12, 20]))) for i in range(90)}
    df = spark.createDataFrame([(i, " ".join(sorted(s)), f"g{i % 2}") for i, s in sets.items()], "memory_id long, content string, g string")
    first = {}
    for i, s in sorted(sets.items()):
        first.setdefault(s, i)
    near = {i: sorted(j for y, j in first.items() if i != j and len(x & y) / min(len(x), len(y)) >= 0.75) for x, i in first.items()}
    groups = {}
    for i, s in sorted(sets.items()):
        groups.setdefault((i % 2, s), i)
    like = {(i, j) for (g, x), i in groups.items() for (h, y), j in groups.items() if g == h and len(x & y) / len(x | y) >= 0.3}
    one = SIM.by_rarity(SIM.collapse(df, "memory_id", F.split("content", " "), []))
    two = SIM.by_rarity(SIM.collapse(df, "memory_id", F.split("content", " "), ["g"]))
    for tile, short, batch in ((8_000_000, 64, 4_000_000), (150, 4, 20)):
        for name, value in (("TILE", tile), ("SHORT", short), ("AT_ONCE", batch)):
            monkeypatch.setattr(SIM, name, value)
        got = {r.first_key: (r.near_sets, r.near_key) for r in SIM.containment_counts(one, 0.75).collect()}
        assert got == {i: (len(v), v[0]) for i, v in near.items() if v}
        pairs = SIM.jaccard_pairs(two, two, ["g"], 0.3)
        assert "CoGroup" in plan(pairs) and "SortMergeJoin" not in plan(pairs)
        assert {(r.a_id, r.b_id) for r in pairs.collect()} == like


def test_a_frequent_name_on_one_day_forms_no_pairs(spark):
    """F8: all memories of a day that began a sentence with the same word became pairs and met with all their words."""
    from engramlake.operators import graph as GR

    name = lambda n: "N" + "".join(chr(97 + n // 26 ** k % 26) for k in range(3))
    rows = [(i, "t", "The " + " ".join(f"w{i}x{j} {name(10 * i + j)}" for j in range(10)), 0, None, T0) for i in range(60)]
    rows += [(100, "t", "The Alpha Beta met in Gamma", 0, None, T0), (101, "t", "The Alpha Beta left for Gamma", 0, None, T0)]
    mem = spark.createDataFrame(rows, "memory_id long, topic string, content string, resolution int, conv_id long, created_at timestamp")
    assert {(r.a, r.b) for r in GR.association_pairs(mem).collect()} == {(100, 101)}
    assert ("related", 100, 101) in {(r.type, r.src, r.dst) for r in GR.mine_associations(mem).collect()}


def test_few_rows_keep_the_first_of_each_kind(spark):
    """Rows that a question cannot tell apart are not scored one by one."""
    rows = spark.range(5000).select(F.col("id").alias("message_id"), (F.col("id") % 7).alias("a"))
    got = sorted(r.message_id for r in TT.few_rows(rows, "message_id", [F.col("a")], 3).collect())
    assert got == list(range(21))


def test_rank_evidence_scores_few_turns_and_agrees_with_blocks(spark, monkeypatch):
    q = spark.createDataFrame([(1, "When did someone adopt a plan?", "user_3"), (2, "How many items did they buy now?", "user_5"), (3, "what happened on 2024-01-05", "user_1")], "query_id long, text string, subject string")
    forms = ["I bought {n} items for user_{u}.", "User_{u} adopted plan v{n}", "The planning of user_{u} failed, they paid $ {n}", "Nothing here"]
    rows = [(i, i // 50, i, "user", f"user_{i % 9}", forms[i % 4].format(n=i % 11, u=i * 3 % 9), T0 + dt.timedelta(days=i % 6), ["asserts", "never", None][i % 3]) for i in range(3000)]
    msg = spark.createDataFrame(rows, "message_id long, conv_id long, turn long, role string, speaker string, text string, created_at timestamp, relation string")
    blocks = TE.turn_blocks(msg)
    seen = []
    few = TT.few_rows
    monkeypatch.setattr(TT, "few_rows", lambda *a: (lambda r: (seen.append(r.count()), r)[1])(few(*a)))
    got = [sorted((r.query_id, r["rank"], r.message_id, r.score) for r in VE.rank_evidence(q, msg, 4, b).collect()) for b in (None, blocks)]
    assert got[0] == got[1] and got[0]
    assert len(seen) == 1 and seen[0] < 1500


def test_buckets_of_the_text_index_grow_with_the_corpus(spark, tmp_path, monkeypatch):
    """A task sums the pairs of a bounded number of documents."""
    monkeypatch.setattr(RE, "BUCKET_DOCS", 10)
    mem = spark.range(400).select(F.col("id").alias("memory_id"), F.concat(F.lit("word number"), F.col("id")).alias("content"))
    index = RE.store_index(mem, str(tmp_path))
    files = [f for f in index.postings.inputFiles()]
    assert len(files) > 30
    assert index.postings.groupBy(F.input_file_name()).agg(F.count_distinct("memory_id").alias("n")).agg(F.max("n")).first()[0] < 30
    assert index.postings.select("memory_id").distinct().count() == 400


def test_few_questions_are_searched_in_one_pass(spark, monkeypatch):
    """pairs of questions and texts were shuffled; now tasks give their k best rows, and ties are kept by id."""
    monkeypatch.setattr(RE, "materialise", None)  # nothing is written
    r = random.Random(3)
    texts = [" ".join(r.choice(["the", "Of", "and", "été"]) if r.random() < 0.5 else f"word{r.randrange(200)}" for _ in range(r.randint(0, 14))) for _ in range(600)]
    texts += [" ".join(f"x{i}" for i in range(1024)), " ".join(f"x{i}" for i in range(1023)), None, "a\x0bthe\u00a0of"]
    rows = [(i, t, round(0.3 + 0.1 * (i % 7), 1)) for i, t in enumerate(texts)]
    mem = spark.createDataFrame(rows, "memory_id long, content string, importance double").repartition(7)
    queries = [(1, "the of"), (2, "word1 the and"), (3, "ord19 été"), (4, "zzz"), (5, "x0"), (6, None), (7, "the\u00a0of a")]
    q = spark.createDataFrame(queries, "query_id long, text string")
    for k in (3, 10):
        for new, pairs in ((RE.jaccard_best(q, mem, k), RE.jaccard_pairs(q, mem)),):
            want = {(x.query_id, x.memory_id, x.score, x["rank"]) for x in RE.top_scored(pairs, k).collect()}
            assert {(x.query_id, x.memory_id, x.score, x["rank"]) for x in new.collect()} == want
        want = set()
        for i, t in queries:
            words = set(RE_WORD.findall((t or "").lower()))
            s = [(-round(0.5 * m + 0.3 * imp, 9), j) for j, c, imp in rows if (m := sum(any(w in x for x in RE_WORD.findall((c or "").lower())) for w in words))]
            want |= {(i, j, -x, n + 1) for n, (x, j) in enumerate(sorted(s)[:k])}
        found = RE.keyword_best(q, mem, k)
        assert {(x.query_id, x.memory_id, x.score, x["rank"]) for x in found.collect()} == want
        assert "Join" not in plan(found)
    monkeypatch.setattr(RE.scan, "MOST_QUESTIONS", 3)
    assert RE.scan.question_terms(q, F.split("text", " ")) is None


def test_entity_names_meet_by_equal_pieces(spark):
    """names that share three letters were paired and then searched in each other."""
    from engramlake.operators import facts as FA

    names = [f"user_{i}" for i in range(120)] + ["ab", "日本語", " User_7 ", "x" * 30, "aaa"]
    keys = ["user_5", "r_1", "the user_11 account", "zzz", "本", "cabd", "a", "USER_7", None, "aaaa"]
    found = FA.match_entities(spark.createDataFrame([(k,) for k in keys], "key string"), spark.createDataFrame([(n,) for n in [*names, None]], "entity string"))
    assert "contains(" not in plan(found).lower()
    low_n, low_k = {n.strip().lower() for n in names}, {k.strip().lower() for k in keys if k}
    want = {(k, k, "exact") for k in low_k & low_n} | {(k, n, "part") for k in low_k - low_n for n in low_n if k in n or n in k}
    assert sorted((x.key, x.entity, x.how) for x in found.collect()) == sorted(want)


def test_sentences_are_ranked_once_a_text(spark):
    """a selected form computed the ranking for every sentence, and every version read its original again."""
    from engramlake.operators import compression as CO

    texts = ["We decided on Plan Alpha. It is cheap! Because Bob Miller said so? We decided on Plan Alpha.", "", None, "The Old House stood. " * 9 + "Fine"]
    mem = spark.createDataFrame([(i, "decision" if i % 2 else "episode", i % 4, t) for i, t in enumerate(texts * 3)], "memory_id long, memory_type string, resolution int, content string")
    assert re.search(r"array_contains\(_k", plan(CO.compress_all(mem).select("episode")))
    once, each = CO.build_versions(mem, rules=True), CO.build_versions(mem)
    assert sorted(map(str, CO.validate_versions(once).collect())) == sorted(map(str, CO.validate_versions(each).collect()))


def test_decision_words_are_not_written_as_rows(spark, monkeypatch):
    """a row was written for every word of every decision, for each round; now only decisions are."""
    for name, value in (("BLOCK", 60), ("FAR_BLOCKS", 2), ("AT_ONCE", 15)):
        monkeypatch.setattr(SIM, name, value, raising=False)
    counts = []
    for module in (TE, SIM):
        monkeypatch.setattr(module, "materialise", lambda df, label, write=module.materialise: (lambda t: (counts.append(t.count()), t)[1])(write(df, label)))
    r = random.Random(11)
    rows = [(i, "hot" if i % 4 else f"t{i % 8}", " ".join({"so", "then", *(f"w{r.randrange(120)}" for _ in range(r.randint(0, 6)))}), T0 + dt.timedelta(days=i // 3)) for i in range(300)]
    rows += [(900, "hot", "far1 far2 far3 x", T0 - dt.timedelta(days=1)), (901, "hot", "far3 far1 far2 y", T0 + dt.timedelta(days=999)), (902, None, "far3 far1 far2", T0), (903, "hot", "far3 far1 far2 z", T0 + dt.timedelta(days=999))]
    want = {}
    for i, t, x, d in rows:
        later = [(e, j) for j, u, y, e in rows if u == t and t and e > d and len(set(x.split()) & set(y.split())) >= 3]
        if later:
            want[i] = min(later)[1]
    got = TE.superseding_decisions(spark.createDataFrame(rows, "decision_id long, topic string, text string, decided_at timestamp"), "topic", look=2, rounds=(2,))
    assert {x.decision_id: x.superseded_by for x in got.collect()} == want and want[900] == 901
    assert max(counts) <= len(rows)


def test_supporting_messages_are_counted_in_tasks(spark, monkeypatch):
    """every word of decisions and messages was a shuffled row; a conversation of very many is cut into tiles."""
    for name, value in (("BLOCK", 40), ("AT_ONCE", 15)):
        monkeypatch.setattr(SIM, name, value, raising=False)
    r = random.Random(12)
    text = lambda: " ".join(r.choice("abcdefghijkl") for _ in range(r.randint(1, 5)))
    dec = [(i, i, "t", [7, i % 9, None][i % 3], [None, 500 + i][i % 2], text(), T0) for i in range(60)]
    msg = [(500 + i, [7, i % 9][i % 2], "assistant" if i % 5 else "user", text() if i != 3 else None, T0) for i in range(60)]
    msg.append(msg[1])  # a repeated row: its words count twice
    want = set()
    for i, _, _, c, own, x, _ in dec:
        for m, k, role, y, t in msg:
            n = len(set(x.split()) & set((y or "").split())) * msg.count((m, k, role, y, t))
            if role == "assistant" and c == k and m != own and n >= 2:
                want.add((i, m))
    frames = [spark.createDataFrame(dec, "decision_id long, memory_id long, topic string, conv_id long, message_id long, text string, decided_at timestamp"),
              spark.createDataFrame([], "memory_id long, created_at timestamp"), spark.createDataFrame(msg, "message_id long, conv_id long, role string, text string, created_at timestamp"),
              spark.createDataFrame([], "src long, dst long, type string"), spark.createDataFrame([], "decision_id long, superseded_by long, superseded_at timestamp")]
    events = TE.decision_events(*frames[:4], superseded=frames[4]).filter("event = 'supported'")
    assert "FlatMapCoGroups" not in plan(events) and "Generate explode(array_distinct" not in plan(events)
    got = [(x.decision_id, x.ref_id) for x in events.collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


def test_written_tables_leave_no_shuffle_files(spark):
    """Every step of a job left its shuffle files until the driver collected garbage."""
    from engramlake.session import CLEANUP, materialise

    store = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {str(f.getName()) for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.getAllFiles()) if str(f.getName()).startswith("shuffle_")}
    before = files()
    t = materialise(spark.range(1000).groupBy((F.col("id") % 9).alias("k")).count(), "cleanup")
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before
    assert t.count() == 9
    assert spark.conf.get(CLEANUP, None) is None


def test_associations_of_copies_against_all_pairs(spark, monkeypatch):
    """copies of a text were linked by words through their first memory only; F2: pairs are found by joins of higher limits."""
    from engramlake.functions import text as TX
    from engramlake.operators import graph as GR

    r = random.Random(21)
    base = [" ".join(r.choice(["alpha", "beta", "so", "The", "Of", "Rex", "Oslo"]) if r.random() < 0.4 else f"{r.choice('wW')}x{'abcdefghij'[r.randrange(10)]}" for _ in range(r.randint(3, 14))) for _ in range(25)]
    texts = [r.choice(base) if r.random() < 0.6 else r.choice(base) + f" w{i}" for i in range(70)] + ["", None]
    rows = [(i, f"t{i % 5 // 3}", x, r.randrange(6), [None, i // 9][i % 7 > 0], T0 + dt.timedelta(days=r.choice([0, 1, 2, 5, 6, 9, 40]), hours=r.randrange(24))) for i, x in enumerate(texts)]
    mem = spark.createDataFrame(rows, "memory_id long, topic string, content string, resolution int, conv_id long, created_at timestamp")
    sets = {x.memory_id: (set(x.w or []), set(x.e or [])) for x in mem.select("memory_id", TX.word_list(F.col("content")).alias("w"), TX.entity_set(F.col("content")).alias("e")).collect()}
    share = lambda x, y: len(x & y) / len(x | y) if x and y else 0.0
    want = {}
    for i, t, _, p, c, d in rows:
        for j, u, _, q, k, e in rows:
            if t == u and i < j:
                o, n = (share(x, y) for x, y in zip(sets[i], sets[j]))
                part = 0.8 if c == k and c is not None and 1 <= abs(p - q) <= 2 else 0.6 if c == k and c is not None and o > 0.5 else 0.0
                s = round(0.3 * round(o, 9) + 0.2 * 2.718281828459045 ** (-abs((d - e).total_seconds()) / 172800) + 0.2 * n + 0.3 * part, 9)
                want |= {(i, j, "related"): round(s, 6)} if s >= 0.3 else {}
                want |= {(i, j, "summarizes"): part} if part > 0.5 else {}
    for few in (64, 2):
        monkeypatch.setattr(GR, "FEW_MEMORIES", few, raising=False)
        assert {(x.src, x.dst, x.type): round(x.strength, 6) for x in GR.mine_associations(mem, {}).collect()} == want


def test_facts_are_resolved_in_time_order(spark, monkeypatch):
    """every interval of the history was laid on all levels of time; now only asked dates after an ended interval look there."""
    from engramlake.operators import facts as FA

    seen = []
    monkeypatch.setattr(skew, "materialise", lambda df, label, write=skew.materialise: (seen.append(label), write(df, label))[1])
    r = random.Random(8)
    keys = [("a", "x"), ("a", "y"), ("b", "x"), (None, "x")]
    rows = [(i, *r.choice(keys), r.choice("uvw"), T0 + dt.timedelta(hours=r.randrange(120)), r.choice(["never", "asserts"])) for i in range(120)]
    f = spark.createDataFrame(rows, "fact_id long, entity string, property string, value string, ts timestamp, relation string")
    asked = [(i, *r.choice([*keys, ("c", "x")]), T0 + dt.timedelta(hours=r.randrange(-5, 130))) for i in range(90)]
    q = spark.createDataFrame(asked, "query_id long, entity string, property string, asked_at timestamp")
    over = [(*r.choice(keys), r.choice("uvw"), T0 + dt.timedelta(hours=(h := r.randrange(100))), r.choice([None, T0 + dt.timedelta(hours=h + r.randrange(60))])) for _ in range(60)]
    names = "entity string, property string, value string, valid_from timestamp, valid_until timestamp"
    no = {(e, p) for _, e, p, _, _, rel in rows if rel == "never"}
    for whole in (1_000_000, 5):
        monkeypatch.setattr(skew, "WHOLE_KEY", whole, raising=False)
        hist = FA.state_history(f.filter("entity is not null"))
        steps = [tuple(x) for x in hist.select("entity", "property", "value", "valid_from", "valid_until").collect()]
        for h, df in ((steps, hist), (over, spark.createDataFrame(over, names))):
            want = {}
            for i, e, p, at in asked:
                held = max(((b, v) for k, o, v, b, u in h if e and (k, o) == (e, p) and b <= at and (u is None or at < u)), default=(0, None))[1]
                want[i] = (bool(e) and (e, p) in no, held)
            seen.clear()
            got = FA.resolve_facts(q, f, df).collect()
            assert {x.query_id: (x.abstain, x.held) for x in got} == want and len(got) == len(asked)
            assert all(x.value == (None if x.abstain else x.held) for x in got)
            assert h is over or "cover" not in seen


def test_repair_goes_on_after_a_row_that_does_not_fit(spark):
    """F8: the first row beyond the budget ended the repair, and it counted for its session."""
    words = {1: 3, 2: 50, 3: 4, 4: 60, 5: 1, 6: 1, 7: 1, 8: 2, 9: 1}
    conv = {1: 1, 2: 2, 3: 3, 4: 4, 5: 4, 6: 4, 7: 4, 8: 4, 9: 5}
    msg = spark.createDataFrame([(i, conv[i], "w " * n) for i, n in words.items()], "message_id long, conv_id long, text string")
    ranked = spark.createDataFrame([(1, i, i) for i in words] + [(2, 2, 1)], "query_id long, message_id long, rank long")
    sel = spark.createDataFrame([(1, 1, 1)], "query_id long, message_id long, conv_id long")
    got = VE.repair_coverage(sel, ranked, msg, per_session=3, budget=8)
    assert {(x.query_id, x.message_id, x.restored) for x in got.collect()} == {(1, 1, False), *((1, i, True) for i in (3, 5, 6, 7, 9))}


def test_tiles_without_groups_meet_in_rounds(spark, monkeypatch):
    """all tiles were shuffled at once, so the disk grew with the square of the sets; now a part of the left is a round."""
    for name, value in (("TILE", 120), ("SHORT", 4), ("ROUND", 4)):
        monkeypatch.setattr(SIM, name, value, raising=False)
    sent = []
    monkeypatch.setattr(SIM, "materialise", lambda df, label, write=SIM.materialise: (sent.append(label), write(df, label))[1])
    rng = random.Random(17)
    sets = {i: frozenset(rng.sample([f"w{j}" for j in range(30)], rng.choice([1, 3, 6, 12, 20]))) for i in range(80)}
    first = {}
    for i, s in sorted(sets.items()):
        first.setdefault(s, i)
    near = {i: sorted(j for y, j in first.items() if i != j and len(x & y) / min(len(x), len(y)) >= 0.75) for x, i in first.items()}
    df = spark.createDataFrame([(i, " ".join(sorted(s))) for i, s in sets.items()], "memory_id long, content string")
    one = SIM.by_rarity(SIM.collapse(df, "memory_id", F.split("content", " "), []))
    got = {r.first_key: (r.near_sets, r.near_key) for r in SIM.containment_counts(one, 0.75).collect()}
    assert got == {i: (len(v), v[0]) for i, v in near.items() if v}
    assert sent.count("partners") > 2
    pairs = {(r.a_id, r.b_id) for r in SIM.containment_pairs(one, 0.75).collect()}
    assert {x for a, b in pairs for x in ((a, b), (b, a))} == {(i, j) for i, v in near.items() for j in v}
    like = {(i, j) for x, i in first.items() for y, j in first.items() if len(x & y) / len(x | y) >= 0.4}
    assert {(r.a_id, r.b_id) for r in SIM.jaccard_pairs(one, one, [], 0.4).collect()} == like
    assert {(r.a_id, r.b_id) for r in SIM.jaccard_pairs(one, one, [], 0.4, less=True).collect()} == {p for p in like if p[0] < p[1]}
