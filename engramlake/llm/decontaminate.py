"""Benchmark decontamination by template canonicalisation.

Both sides are cut into words and turned into templates: a number becomes ``<num>``, a unit or currency sign after or
in a number ``<unit>``, and a capitalised word inside a sentence ``<name>``; other words are lower-cased and stripped
of punctuation. Hashes of all windows of 5 template words of every benchmark item meet the windows of every whole text
in a hash join. For each (document, item) the distinct windows that match are counted against all distinct windows of
the item; a match of at least 80 % is a candidate. Windows of the lower-cased words are counted in the same way, so a
copy in other capitals or with one changed value is found by its words. Then the slots are compared occurrence by
occurrence (hits by document place less item place, those of near offsets together): a document that puts the same
value wherever the item repeats a value is consistent. ``exact`` is a match whose slots are all equal, ``verbatim`` one
of 80 % of the word windows, ``reparameterised`` one with an occurrence of 80 % whose slots map consistently;
``inconsistent`` matches are reported but do not count as leaks.

Only DataFrame functions. The windows of the benchmark are counted before they are broadcast; beyond
``BROADCAST_WINDOWS`` rows both sides are shuffled by window hash instead, with the same rows. Matches combine map-side
per (document, item), so an item that occurs in a third of all documents makes one row per document, and an item keeps
one place per distinct window, so repeated passages do not multiply. Texts are read and cut into windows once.

Defined cases: null or blank texts and items match nothing; a window without at least two literal words is not looked
up, since placeholders alone are no evidence (an item made of such windows only cannot match); repeated rows of a
document count as one; null ids are left out of matches; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engramlake.llm.common import fold, let, whole_text, words_of
from engramlake.session import materialise

WINDOW, COVER_PERCENT, LITERALS = 5, 80, 2
BROADCAST_WINDOWS = 2_000_000
NUMBER = r"^[\p{Sc}(]*[-+]?\d[\d.,:/]*(?:%|[a-zA-Z]{1,3}|[\p{Sc}])?[).,;:!?]*$"
#: Units that follow a number as a word of their own.
UNITS = "mm cm m km in ft yd mi mg g kg lb oz ml l gal s sec min h hr hrs hours minutes seconds days weeks months years dollars euros pounds cents percent meters metres miles feet inches liters litres grams kilograms degrees".split()
EDGES = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"


def _templates(w: Column) -> Column:
    """Template word and slot value of every word: array of struct(t, v)."""

    def one(x: Column, i: Column) -> Column:
        bare = F.lower(F.regexp_replace(x, EDGES, ""))
        before = F.when(i > 0, F.get(w, i - 1)).otherwise(F.lit("."))
        number, after_number = F.regexp_like(x, F.lit(NUMBER)), F.regexp_like(before, F.lit(NUMBER))
        name = F.regexp_like(x, F.lit(r"^[^\p{L}\p{N}]*\p{Lu}[\p{Ll}\p{M}'-]")) & ~F.regexp_like(before, F.lit(r"[.!?:|]['\")\]]*$"))
        t = F.when(number, "<num>").when(after_number & bare.isin(UNITS), "<unit>").when(name, "<name>").when(bare == "", x).otherwise(bare)
        slot = let(t, lambda y: F.struct(y.alias("t"), F.when(y.isin("<num>", "<unit>", "<name>"), bare).alias("v")))
        # Most words are plain lower case and no unit; they stand for themselves.
        plain = F.regexp_like(x, F.lit(r"^\p{Ll}+$")) & ~x.isin(UNITS)
        return F.when(plain, F.struct(x.alias("t"), F.lit(None).cast("string").alias("v"))).otherwise(slot)

    return F.transform(w, one)


def _template_rows(table: DataFrame, key: str) -> DataFrame:
    """key, hashes of the template words (th) and of the words (wh), and slot values (sv; null for a literal word) of every text."""
    t = table.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias(key), fold(words_of(whole_text())).alias("w")).filter(F.size("w") > 0)
    t = t.select(key, fold(_templates(F.col("w"))).alias("t"))
    words = F.transform("t", lambda x: F.xxhash64(F.coalesce(x["v"], x["t"])))
    return t.select(key, fold(F.struct(F.transform("t", lambda x: F.xxhash64(x["t"])).alias("th"), words.alias("wh"), F.transform("t", lambda x: x["v"]).alias("sv"), F.exists("t", lambda x: x["v"].isNotNull()).alias("any"))).alias("t")).select(key, "t.*")


def _windows(size: Column, of: str) -> Column:
    """Windows of a text: place, hash (of the template or the words) and the slot values inside."""
    none = F.array().cast("array<string>")
    slots = lambda i: F.when(F.col("any"), F.filter(F.slice("sv", i, size), lambda v: v.isNotNull())).otherwise(none)
    starts = F.sequence(F.lit(1), F.greatest(F.size("th") - size + 1, F.lit(1)))
    return F.when(F.size("th") >= size, F.transform(starts, lambda i: F.struct(i.alias("at"), F.xxhash64(F.slice(of, i, size)).alias("h"), slots(i).alias("slots"))))


def item_windows(items: DataFrame) -> DataFrame:
    """item_id, plain, h, size, at, slots, n_windows: a row per distinct window of templates and of words (plain) of each item."""
    t = _template_rows(items, "item_id").withColumn("size", F.least(F.size("th"), F.lit(WINDOW)))
    two = [t.select("item_id", "size", F.lit(of == "wh").alias("plain"), F.explode(_windows(F.col("size"), of)).alias("x")) for of in ("th", "wh")]
    # Among words a name is a literal too; numbers are not.
    held = F.when(F.col("plain"), F.size(F.filter("x.slots", lambda v: F.regexp_like(v, F.lit(r"\d"))))).otherwise(F.size("x.slots"))
    rows = two[0].union(two[1]).filter(F.col("size") - held >= F.least(F.lit(LITERALS), F.col("size")))
    rows = rows.groupBy("item_id", "plain", "size", F.col("x.h").alias("h")).agg(F.min("x.at").alias("at"), F.min_by("x.slots", "x.at").alias("slots"))
    total = rows.groupBy("item_id", "plain").agg(F.count("*").alias("n_windows"))
    return rows.join(total, ["item_id", "plain"])


def _lookups(t: DataFrame, sizes: list[int]) -> DataFrame:
    """doc_id, size, h, doc_at, doc_slots, kind of all windows of the given sizes, in one pass over the texts.

    Kind 0 is the template of every window, without slots; the few windows that hold a slot come again with their slots,
    by their template (1) and by their words (2).
    """
    none = F.array().cast("array<string>")
    places = F.array_compact(F.transform("sv", lambda v, i: F.when(v.isNotNull(), i + 1)))
    t = t.select("*", fold(F.when(F.col("any"), places).otherwise(F.array().cast("array<int>"))).alias("sp"))

    def windows(size: int) -> Column:
        n = F.size("th") - size + 1
        held = F.array_distinct(F.flatten(F.transform("sp", lambda p: F.sequence(F.greatest(p - size + 1, F.lit(1)), F.least(p, n)))))

        def row(of: str, i: Column, slots: Column, kind: int) -> Column:
            return F.struct(F.lit(size).alias("size"), F.xxhash64(F.slice(of, i, size)).alias("h"), i.alias("doc_at"), slots.alias("doc_slots"), F.lit(kind).alias("kind"))

        def with_slots(i: Column) -> Column:
            slots = F.filter(F.slice("sv", i, size), lambda v: v.isNotNull())
            return F.array(row("th", i, slots, 1), row("wh", i, slots, 2))

        every = F.transform(F.sequence(F.lit(1), n), lambda i: row("th", i, none, 0))
        return F.when(n >= 1, F.when(F.size("sp") > 0, F.concat(every, F.flatten(F.transform(held, with_slots)))).otherwise(every))

    parts = [windows(size) for size in sizes]
    rows = parts[0] if len(parts) == 1 else F.flatten(F.array_compact(F.array(*parts)))
    return t.select("doc_id", F.explode(rows).alias("x")).select("doc_id", "x.*")


def matches(docs: DataFrame, items: DataFrame, cover: int = COVER_PERCENT) -> DataFrame:
    """doc_id, item_id, matched, n_windows, kind of every document that holds the template or the words of an item."""
    known = materialise(item_windows(items), "dc-items")
    few = known.count() <= BROADCAST_WINDOWS
    sizes = sorted(r[0] for r in known.select("size").distinct().collect())  # at most WINDOW sizes: one, unless items are shorter than a window
    if not sizes:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, matched long, n_windows long, kind string")
    # A window without slots has one hash for template and words; a template with placeholders meets windows with slots only.
    fit = F.when(F.col("kind") == 0, F.col("plain") | (F.size("slots") == 0)).when(F.col("kind") == 2, F.col("plain")).otherwise(True)
    found = _lookups(_template_rows(docs, "doc_id"), sizes).join(F.broadcast(known) if few else known, ["size", "h"]).filter(fit)
    # Few windows hit; they are read twice below, the texts once.
    found = materialise(found, "dc-hits")
    # One row per distinct window with its places; the slots are compared place by place.
    equal = F.col("doc_slots") == F.col("slots")
    place = F.struct((F.col("doc_at") - F.col("at")).alias("off"), F.zip_with("slots", "doc_slots", lambda a, b: F.struct(a.alias("a"), b.alias("b"))).alias("pairs"))
    one = found.groupBy("doc_id", "item_id", "plain", "h").agg(F.first("n_windows").alias("n_windows"), F.bool_or(equal).alias("equal"), F.collect_set(F.when(~F.col("plain"), place)).alias("places"))
    pair = one.groupBy("doc_id", "item_id", "plain").agg(F.count("*").alias("matched"), F.first("n_windows").alias("n_windows"), F.bool_and("equal").alias("equal"), F.collect_list(F.struct("h", "places")).alias("hits"))
    pair = pair.filter(100 * F.col("matched") >= cover * F.col("n_windows"))
    # Offsets closer than half the item are one occurrence with words put in or left out; another copy lies further off.
    spread = pair.filter("not plain and not equal").select("doc_id", "item_id", "n_windows", F.explode("hits").alias("x")).select("doc_id", "item_id", "n_windows", F.col("x.h").alias("h"), F.explode("x.places").alias("p"))
    along = Window.partitionBy("doc_id", "item_id").orderBy("p.off")
    starts = F.coalesce(2 * (F.col("p.off") - F.lag("p.off").over(along)) > F.col("n_windows"), F.lit(False))
    spread = spread.withColumn("new", starts.cast("int")).withColumn("copy", F.sum("new").over(along))
    each = spread.groupBy("doc_id", "item_id", "copy", "h").agg(F.first("n_windows").alias("n_windows"), F.min_by("p.pairs", F.struct("p.off", "p.pairs")).alias("pairs"))
    each = each.groupBy("doc_id", "item_id", "copy").agg(F.count("*").alias("n"), F.first("n_windows").alias("n_windows"), F.array_distinct(F.flatten(F.collect_list("pairs"))).alias("pairs"))
    fits = (100 * F.col("n") >= cover * F.col("n_windows")) & (F.size(F.array_distinct(F.transform("pairs", lambda p: p["a"]))) == F.size("pairs"))
    steady = each.groupBy("doc_id", "item_id").agg(F.bool_or(fits).alias("steady"))
    both = pair.groupBy("doc_id", "item_id").agg(F.bool_or("plain").alias("verbatim"), *[F.max(F.when(~F.col("plain"), F.col(c))).alias(f"t_{c}") for c in ("matched", "n_windows", "equal")], *[F.max(F.when(F.col("plain"), F.col(c))).alias(f"w_{c}") for c in ("matched", "n_windows")])
    both = both.join(steady, ["doc_id", "item_id"], "left")
    kind = F.when(F.col("t_equal"), "exact").when(F.col("verbatim"), "verbatim").when(F.col("steady"), "reparameterised").otherwise("inconsistent")
    return both.select("doc_id", "item_id", *[F.coalesce(f"t_{c}", f"w_{c}").alias(c) for c in ("matched", "n_windows")], kind.alias("kind"))


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Documents that hold no benchmark item, neither word for word nor with other values."""
    bad = matches(docs, items).filter("kind <> 'inconsistent'").select(F.col("doc_id").alias("dc_id")).distinct()
    return docs.join(bad, docs["doc_id"].cast("long") == bad["dc_id"], "left_anti")
