"""Source divergence audit by sorted word-start pointers.

Every shard (a slice of an Arrow batch) keeps its texts as one byte buffer. Pointers to the word starts are sorted by
the words they point at, eight bytes at a time: a stable sort of the first slice, then only the runs whose slice is full
are sorted on by the next one (multikey quicksort on wide symbols). Rows of a shard are put in order of (lang, source)
beforehand, so inside a run of equal words the pointers lie by group and document: run lengths are the counts of a group,
changes of document its document frequency. Shards hand on one row per (lang, source, term); Spark adds them up.

A language keeps the terms of at least ``MIN_DOCS`` of its documents. With N a group's number of kept terms and V their
number in the language, p = 1 + floor(10^9 (count + 2) / (N + 2 V)). Sources are compared by the sum over all kept terms
of floor((p - q)^2 / (p + q)), and each source with its language term by term. All arithmetic is exact (decimals for p,
whole 64-bit numbers after it).

Scale: counts combine in each task, then by (lang, source, term), then by (lang, term), so a word that every document
holds is one row per shard and group, then one per group. Pairs of sources are summed in blocks of about ``BLOCK`` terms
by ``TILE`` sources by ``TILE`` sources, each a bounded matrix; only one row per block and pair leaves a block, and the
number of pairs is that of the result. Groups without a term in a block enter it as one row.

Defined cases: null text, lang and source count as ''; a group whose documents hold no kept term still gets its rows
(with V = 0 every value is 0); repeated rows count as documents of their own; ties rank by item in UTF-8 order; an empty
table gives no rows; other columns are not read. A shard holds whole texts, so its memory is bounded by ``SHARD_BYTES``
or the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engramlake.llm.common import ship
from engramlake.session import materialise

MIN_DOCS, TOP_TERMS, UNIT = 10, 10, 1_000_000_000
SHARD_BYTES, BLOCK, TILE = 16 << 20, 4096, 256
#: Bytes of a term: ASCII letters and everything beyond ASCII.
IN_TERM = np.array([b >= 128 or chr(b).isalpha() for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def _slices(data: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The next eight bytes at each pointer as one number, zero beyond ``left`` bytes; data is padded by eight."""
    k = data[at[:, None] + np.arange(8)]
    k[np.arange(8) >= left[:, None]] = 0
    return k.view(">u8").ravel().astype(np.uint64)


def sort_pointers(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the pointers by word (equal words keep their order) and the places where a new word begins."""
    key = _slices(data, start, length)
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.ones(len(order), bool)
    new[1:] = key[1:] != key[:-1]
    # A full slice may go on; all pointers of its run are sorted by the next slice.
    live, depth = np.flatnonzero(key & np.uint64(255)), 8
    while len(live):
        run = np.cumsum(new)[live]
        p = order[live]
        key = _slices(data, start[p] + depth, length[p] - depth)
        o = np.lexsort((key, run))
        order[live], key = p[o], key[o]
        new[live[1:]] |= key[1:] != key[:-1]
        live, depth = live[(key & np.uint64(255)) != 0], depth + 8
    return order, new


def shard_counts(text: pa.StringArray, group: np.ndarray) -> tuple[pa.StringArray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms of a shard with group, occurrences and documents, a row per (term, group)."""
    by = np.argsort(group, kind="stable")
    text, group = text.take(pa.array(by)), group[by]
    offsets = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    raw = text.buffers()[2]
    raw = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    data = np.append(LOWER[raw], np.zeros(8, np.uint8))
    inside = IN_TERM[raw]
    # A word ends with its document, so both kinds of edges also lie at document borders.
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    border = np.unique(offsets[1:-1])
    border = border[(border > 0) & (border < len(raw))]
    first[border] = inside[border]
    last[border - 1] = inside[border - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    none = pa.array([], pa.string()), *[np.zeros(0, np.int64)] * 3
    if not len(start):
        return none
    order, new = sort_pointers(data, start, end - start)
    doc = (np.searchsorted(offsets, start, "right") - 1)[order]
    g = group[doc]
    of_group = new.copy()
    of_group[1:] |= g[1:] != g[:-1]
    of_doc = of_group.copy()
    of_doc[1:] |= doc[1:] != doc[:-1]
    at = np.flatnonzero(of_group)
    count = np.diff(np.append(at, len(order)))
    docs = np.add.reduceat(of_doc, at, dtype=np.int64)
    a, n = start[order[at]], (end - start)[order[at]]
    ends = np.cumsum(n)
    body = data[np.repeat(a - (ends - n), n) + np.arange(ends[-1])]
    terms = pa.Array.from_buffers(pa.string(), len(n), [None, pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(body)])
    return terms, g[at], count, docs


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, count, docs over all texts."""
    ship(docs.sparkSession)
    names = ["lang", "source", "term", "count", "docs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            text = b.column(2)
            size = np.cumsum(np.diff(np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1]).astype(np.int64))
            shard = size // SHARD_BYTES
            edges = [0, *(np.flatnonzero(np.diff(shard)) + 1), b.num_rows]
            keys = pa.StructArray.from_arrays([b.column(0), b.column(1)], names=["lang", "source"])
            pairs = {}
            group = np.array([pairs.setdefault((k["lang"], k["source"]), len(pairs)) for k in keys.to_pylist()], np.int64)
            lang, source = (pa.array([p[i] for p in pairs], pa.string()) for i in (0, 1))
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                terms, g, count, n = shard_counts(text.slice(i, j - i), group[i:j])
                yield pa.record_batch([lang.take(pa.array(g)), source.take(pa.array(g)), terms, pa.array(count), pa.array(n)], names=names)

    full = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return full.mapInArrow(run, "lang string, source string, term string, count long, docs long").groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def kept_terms(counts: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, term, lang_count of the terms in at least ``min_docs`` documents of their language."""
    return counts.groupBy("lang", "term").agg(F.sum("count").alias("lang_count"), F.sum("docs").alias("docs")).filter(F.col("docs") >= min_docs).drop("docs")


def _share(count, total, v):
    """1 + floor(UNIT * (count + 2) / (total + 2 v)) without overflow; v and total of groups of a language without terms give 1."""
    d = F.col(total) + 2 * F.col(v)
    top = F.lit(UNIT).cast("decimal(10,0)") * (count.cast("decimal(20,0)") + F.lit(2).cast("decimal(1,0)"))
    return F.when(d > 0, 1 + F.call_function("div", top, d.cast("decimal(20,0)"))).otherwise(F.lit(1).cast("long"))


def _distance(p, q):
    return F.call_function("div", (p - q) * (p - q), p + q)


def _block_sums(t: pa.Table) -> pa.Table:
    """Sums over the terms of one block for the pairs of sources of two tiles."""
    tile, names = t["tile"].to_numpy(), t["source"].combine_chunks().dictionary_encode()
    who, where = names.indices.to_numpy(zero_copy_only=False), t["term"].combine_chunks().dictionary_encode()
    seen = where.indices.is_valid().to_numpy(zero_copy_only=False)
    p = t["p"].to_numpy()
    n = len(where.dictionary)
    full = np.zeros((len(names.dictionary), n), np.int64)
    of_tile = np.zeros(len(names.dictionary), np.int64)
    # Rows without a term carry a source's value for terms it does not have.
    full[who[~seen]] = p[~seen][:, None]
    of_tile[who] = tile
    full[who[seen], where.indices.drop_null().to_numpy()] = p[seen]
    a, b = t["a"][0].as_py(), t["b"][0].as_py()
    left, right = np.flatnonzero(of_tile == a), np.flatnonzero(of_tile == b)
    label = names.dictionary.to_pylist()
    rows = []
    for i in left:
        js = right[right > i] if a == b else right
        gap = full[i] - full[js]
        value = (gap * gap // (full[i] + full[js])).sum(1)
        rows += [(*sorted((label[i], label[j])), v) for j, v in zip(js, value.tolist(), strict=True)]
    x, y, v = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.table({"lang": pa.array([t["lang"][0].as_py()] * len(rows), pa.string()), "x": pa.array(x, pa.string()), "y": pa.array(y, pa.string()), "value": pa.array(v, pa.int64())})


def pair_sums(shares: DataFrame, groups: DataFrame, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """lang, source, item, value for every ordered pair of sources of a language.

    ``shares``: lang, source, term, p of terms a group has; ``groups``: lang, source, v, p0 (p of terms it does not have).
    """
    size = groups.groupBy("lang").agg(F.max(F.greatest(F.ceil(F.col("v") / block), F.lit(1))).alias("blocks"), F.ceil(F.count("*") / tile).alias("tiles"))
    of_tile = F.pmod(F.xxhash64("source"), F.col("tiles")).alias("tile")
    pick = ["lang", "source", "term", "p", "block", "tile", "tiles"]
    rows = shares.join(size, "lang").withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks"))).withColumn("tile", of_tile).select(*pick)
    empty = groups.join(size, "lang").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).withColumn("tile", of_tile)
    rows = rows.union(empty.withColumn("term", F.lit(None).cast("string")).withColumn("p", F.col("p0")).select(*pick))
    meet = F.transform(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1), lambda o: F.struct(F.least(o, F.col("tile")).alias("a"), F.greatest(o, F.col("tile")).alias("b")))
    rows = rows.withColumn("m", F.explode(meet)).select("lang", "block", F.col("m.a").alias("a"), F.col("m.b").alias("b"), "tile", "source", "term", "p")
    sums = rows.groupBy("lang", "a", "b", "block").applyInArrow(_block_sums, "lang string, x string, y string, value long")
    sums = sums.groupBy("lang", "x", "y").agg(F.sum("value").alias("value"))
    both = F.array(F.struct(F.col("x").alias("source"), F.col("y").alias("item")), F.struct(F.col("y").alias("source"), F.col("x").alias("item")))
    return sums.select("lang", F.explode(both).alias("s"), "value").select("lang", "s.source", "s.item", "value")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: distances to the other sources, and the terms a source has in excess."""
    counts = materialise(term_counts(docs), "sd-counts")
    kept = materialise(kept_terms(counts, min_docs), "sd-kept")
    rows = materialise(counts.select("lang", "source", "term", "count").join(kept, ["lang", "term"]), "sd-rows")
    every = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    of_lang = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_count").alias("lang_total"))
    groups = every.join(rows.groupBy("lang", "source").agg(F.sum("count").alias("total")), ["lang", "source"], "left").join(of_lang, "lang", "left").fillna(0, ["total", "v", "lang_total"])
    groups = materialise(groups.withColumn("p0", _share(F.lit(0), "total", "v")), "sd-groups")
    r = rows.join(groups, ["lang", "source"]).withColumn("p", _share(F.col("count"), "total", "v")).withColumn("q", _share(F.col("lang_count"), "lang_total", "v"))
    pairs = pair_sums(r.select("lang", "source", "term", "p"), groups)
    along = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(along)).select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")
    terms = r.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _distance(F.col("p"), F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(along)).filter(F.col("rank") <= top)
    return pairs.unionByName(terms)


def audit_sql(table: str = "documents") -> str:
    term = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
    return f"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{term}') AS w FROM {table}),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d), k AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS lc FROM t GROUP BY ALL HAVING count(DISTINCT r) >= {MIN_DOCS}),
c AS (SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL), g AS (SELECT DISTINCT lang, source FROM d),
l AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v, sum(lc) AS total FROM k GROUP BY lang), s AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(s.total, 0) + 2 * l.v) AS p, 1 + (1000000000::HUGEINT * (lc + 2)) // (l.total + 2 * l.v) AS q
 FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN s ON s.lang = g.lang AND s.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
a AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(f.value, 0) AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN f ON f.lang = x.lang AND f.source = x.source AND f.item = y.source
 UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM a QUALIFY part = 'pair' OR rank <= {TOP_TERMS}"""
